from siftspark.operators.index import Index, documents
from siftspark.streaming import live
from tests.test_search import docs


def test_watch(spark, tmp_path):
    Index(documents(docs(spark, {1: "old words", 2: "stay here"}))).save(str(tmp_path / "ix"))
    changes = [("upsert", 1, 1, "/d/1.txt", "1.txt", "txt", 3, 0, "first"), ("upsert", 2, 1, "/d/1.txt", "1.txt", "txt", 3, 0, "second"), ("delete", 3, 2, "/d/2.txt", "2.txt", "txt", 0, 0, None)]
    spark.createDataFrame(changes, live.schema_of_changes()).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(live.schema_of_changes()).parquet(str(tmp_path / "in"))
    live.watch(stream, str(tmp_path / "ix"), str(tmp_path / "cp")).awaitTermination()
    assert [r.content for r in Index.load(spark, str(tmp_path / "ix")).docs.collect()] == ["second"]


def test_sessions(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES ('s', timestamp'2024-01-01 00:00:00', 'impression'), ('s', timestamp'2024-01-01 00:10:00', 'click'), ('s', timestamp'2024-01-01 05:00:00', 'impression'), ('t', timestamp'2024-01-02 00:00:00', 'click') t(session_id, event_time, kind)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = live.session_metrics(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("sessions").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.impressions, r.clicks) for r in spark.table("sessions").filter("session_id = 's'").collect()) == [(1, 0), (1, 1)]


def test_bucket():
    state, granted = None, []
    for now in [0.0] * 6 + [59.0, 60.0]:
        state, ok = live.take(state, now, 10)
        granted.append(ok)
    assert granted == [True] * 5 + [False, False, True]


def test_bucket_batch(spark):
    rows = spark.createDataFrame([("k", float(i), 20) for i in range(4)], "key string, ts double, n int")
    assert [r.granted for r in live.rate_limited_batch(rows).orderBy("ts").collect()] == [True, True, False, False]
