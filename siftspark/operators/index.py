"""The index as a set of tables, built by plans and kept as Parquet.

docs      doc_id, path, file_name, extension, size_bytes, modified_unix, acl, content, the columns of web pages (null for files), and what one pass
          over the texts gives: exact_hash, token_count, fingerprint hi and lo, terms with tfs and positions, lexical vector as buckets and weights
postings  term, doc_id, tf, positions       vocab  term, df, cf       stats  one row: n_docs, total_tokens, avg_length
chunks    doc_id, chunk_index, chunk, and its vector as buckets and weights       mentions  doc_id, name, kind, ts

fingerprints (doc_id, exact_hash, hi, lo), vectors (doc_id, bucket, w) and chunk_vectors (doc_id, chunk_index, bucket, w) are columns of docs and chunks.
Terms are kept words with their places among all words, so gaps remain where stop words were.
"""

from __future__ import annotations

import json
import zlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import batch as B
from ..functions import text as T
from . import entities

VERSION = 2
TABLES = ("docs", "postings", "vocab", "stats", "chunks", "mentions")
#: Postings of a part, about; parts are hash ranges of terms, so a lookup reads few files.
PART_POSTINGS, MOST_PARTS = 250_000, 16_384
#: Documents whose postings of a part are in one file, about: a term that a third of all documents have is spread over many.
SPREAD_DOCS = 4_000_000
ACL = "struct<owner:string,allowed_principals:array<string>,allowed_groups:array<string>,public:boolean>"
FLAG = "struct<category:string,confidence:double>"
WEB = {
    "url": "string", "domain": "string", "title": "string", "lang": "string", "author": "string", "content_type": "string", "fetched_unix": "bigint",
    "redirect_chain": "array<string>", "depth": "int", "pagerank": "double", "spam_score": "double", "policy_flag": FLAG,
}
DOCS = ("doc_id", "path", "file_name", "extension", "size_bytes", "modified_unix", "acl", "content")


def public_acl() -> Column:
    return F.struct(F.lit(None).cast("string").alias("owner"), F.array().cast("array<string>").alias("allowed_principals"), F.array().cast("array<string>").alias("allowed_groups"), F.lit(True).alias("public"))


def documents(df: DataFrame) -> DataFrame:
    """df with every column of docs: acl public and web columns null where they are missing."""
    have = set(df.columns)
    acl = F.col("acl") if "acl" in have else public_acl()
    return df.select(*[F.col(c) for c in DOCS if c != "acl"], acl.cast(ACL).alias("acl"), *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in WEB.items()])


#: Columns that the pass over the texts adds to docs.
ANALYSED = ("exact_hash", "token_count", "hi", "lo", "terms", "tfs", "positions", "buckets", "weights")
WORDS = ("token_count", "terms", "tfs", "positions")


def term_part(term: Column, parts: int) -> Column:
    return F.pmod(F.crc32(term), F.lit(parts)).cast("int")


def term_part_of(term: str, parts: int) -> int:
    return zlib.crc32(term.encode()) % parts


def analysed(docs: DataFrame, parts: tuple[str, ...] = ("prints", "vectors")) -> DataFrame:
    """docs with the columns ANALYSED; a query that needs no fingerprints or no vectors may leave that part out."""
    return B.analysed(docs.drop(*ANALYSED).withColumn("exact_hash", T.exact_hash(F.col("content"))), parts=parts)


def checksum(df: DataFrame) -> tuple[int, int]:
    """(rows, a sum of the rows' hashes, whatever their order)"""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64(*columns), F.lit(1 << 40))).alias("h")).first()
    return row.n, int(row.h or 0)


@dataclass
class Index:
    """Tables given or derived from docs. A table that several queries use should be saved; nothing is cached here. `parts` is set where postings have a column part."""

    docs: DataFrame
    tables: dict[str, DataFrame] | None = None
    parts: int | None = None

    def _table(self, name: str) -> DataFrame | None:
        return (self.tables or {}).get(name)

    @cached_property
    def analysed(self) -> DataFrame:
        """docs with the columns ANALYSED: as they are where docs have them, else by one pass over the texts."""
        return self._having(*ANALYSED)

    def _having(self, *columns: str) -> DataFrame:
        """docs as they are where they have these columns, else with all that a pass over their texts gives."""
        if set(columns) <= set(self.docs.columns):
            return self.docs
        return analysed(self.docs) if columns == ANALYSED else self.analysed

    @cached_property
    def narrow(self) -> DataFrame:
        """What search needs of every document: no text, no words but their number."""
        return self._having(*WORDS).drop("content", *[c for c in ANALYSED if c != "token_count"])

    @cached_property
    def postings(self) -> DataFrame:
        return self._table("postings") or postings(self._having(*WORDS))

    @cached_property
    def vocab(self) -> DataFrame:
        return self._table("vocab") or vocabulary(self.postings)

    @cached_property
    def stats(self) -> DataFrame:
        if self._table("stats") is not None:
            return self._table("stats")
        n = F.count(F.lit(1))
        return self._having("token_count").agg(n.alias("n_docs"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("total_tokens"), F.when(n > 0, F.sum("token_count") / n).otherwise(0.0).alias("avg_length"))

    @cached_property
    def fingerprints(self) -> DataFrame:
        return self._having("exact_hash", "hi", "lo").select("doc_id", "exact_hash", "hi", "lo")

    @cached_property
    def vectors(self) -> DataFrame:
        return T.vector_rows(self._having("buckets", "weights"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Chunks, with their vectors, of documents of more than CHUNK_ABOVE kept words."""
        return self._table("chunks") or chunks(self._having("token_count"))

    @cached_property
    def chunk_vectors(self) -> DataFrame:
        return T.vector_rows(self.chunks, ("doc_id", "chunk_index"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self._table("mentions") or entities.mentions(self.docs.select("doc_id", "content", "modified_unix"))

    def table(self, name: str) -> DataFrame:
        return self.analysed if name == "docs" else getattr(self, name)

    def save(self, path: str, version: int = 1) -> None:
        """Every table under path/v<version>, then the manifest that makes the version current. Texts are read word by word once, for docs; all else is made from what is written."""
        spark = self.docs.sparkSession
        base, source, sums, schemas = f"{path}/v{version}", self, {}, {}
        parts = spread = 1
        for name in TABLES:
            df = source.table(name)
            if name == "postings":
                df = df.drop("part").withColumn("part", term_part(F.col("term"), parts))
                # Terms of a part stay together but for the documents' spread: no file has more than about SPREAD_DOCS postings of a term.
                df = df.repartition("part", F.pmod(F.xxhash64("doc_id"), F.lit(spread))).sortWithinPartitions("part", "term", "doc_id")
                df.write.mode("overwrite").partitionBy("part").parquet(f"{base}/{name}")
            else:
                df.write.mode("overwrite").parquet(f"{base}/{name}")
            schemas[name] = df.schema.jsonValue()
            done = spark.read.schema(df.schema).parquet(f"{base}/{name}")
            sums[name] = checksum(done)
            if name == "docs":
                source = Index(done, dict(self.tables or {}))
                n = done.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
                parts, spread = min(max(8, n // PART_POSTINGS), MOST_PARTS), 1 + sums[name][0] // SPREAD_DOCS
            elif name == "postings":
                source = Index(source.docs, {**source.tables, "postings": done})
        manifest = json.dumps({"format": VERSION, "version": version, "parts": parts, "tables": sums, "schemas": schemas})
        spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, check: bool = True) -> Index:
        """The current version; with check, tables whose rows aren't those that were written are an error."""
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
        if manifest["format"] != VERSION:
            raise ValueError(f"index format {manifest['format']}, {VERSION} is read here")
        tables = {name: spark.read.schema(StructType.fromJson(manifest["schemas"][name])).parquet(f"{path}/v{manifest['version']}/{name}") for name in TABLES}
        if check:
            wrong = [name for name, kept in manifest["tables"].items() if list(checksum(tables[name])) != kept]
            if wrong:
                raise ValueError(f"damaged tables: {', '.join(wrong)}")
        return Index(tables["docs"], tables, manifest["parts"])

    @staticmethod
    def version(spark: SparkSession, path: str) -> int:
        return json.loads(spark.read.text(f"{path}/manifest").first()[0])["version"]

    def upsert(self, rows: DataFrame) -> Index:
        """The index with these documents in place of those of the same path or doc_id. Only their texts are read word by word."""
        old = self.docs.select("doc_id", "path")
        gone = old.join(rows.select("path"), "path", "left_semi").select("doc_id").union(old.join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id"))
        return self.changed(gone, rows)

    def remove(self, doc_ids: DataFrame) -> Index:
        """Every table without these documents. The vocabulary keeps its terms, whose df may fall to 0."""
        return self.changed(doc_ids.select("doc_id"), None, keep_terms=True)

    def changed(self, gone: DataFrame, rows: DataFrame | None, keep_terms: bool = False) -> Index:
        """Every table without the documents `gone` (doc_id) and with those of rows."""
        gone = gone.distinct()
        new = None if rows is None else Index(analysed(documents(rows)))
        tables = {}
        for name in ("docs", "postings", "chunks", "mentions"):
            # docs keep the columns that they have: texts that weren't read yet aren't for a change.
            left = (self.docs if name == "docs" else self.table(name)).join(gone, "doc_id", "left_anti")
            if new is not None:
                more = new.table(name)
                if name == "docs":
                    more = (more if set(ANALYSED) & set(left.columns) else documents(rows)).select(*left.columns)
                if "part" in left.columns:
                    more = more.withColumn("part", term_part(F.col("term"), self.parts))
                left = left.select(*more.columns).unionByName(more)
            tables[name] = left
        # The vocabulary changes by the terms of what goes and comes, not by counting all postings again.
        moved = self.postings.join(gone, "doc_id", "left_semi").groupBy("term").agg((-F.count(F.lit(1))).alias("df"), (-F.sum("tf")).alias("cf"))
        if new is not None:
            moved = moved.unionByName(vocabulary(new.postings))
        vocab = self.vocab.unionByName(moved).groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))
        tables["vocab"] = vocab if keep_terms else vocab.filter("df > 0")
        return Index(tables["docs"], tables, self.parts)

    def remove_folder(self, folder: str) -> Index:
        return self.remove(self.docs.filter(F.col("path").startswith(folder.rstrip("/") + "/")))

    def by_path(self, paths: list[str]) -> DataFrame:
        """The documents of these paths."""
        return self.docs.filter(F.col("path").isin(*paths))


def postings(docs: DataFrame) -> DataFrame:
    """A row for each term of each document that analysed() read: nothing is shuffled."""
    return docs.select("doc_id", F.explode(F.arrays_zip("terms", "tfs", "positions")).alias("_p")).select(F.col("_p.terms").alias("term"), "doc_id", F.col("_p.tfs").alias("tf"), F.col("_p.positions").alias("positions"))


def chunks(docs: DataFrame) -> DataFrame:
    rows = T.chunk_rows(docs.filter(F.col("token_count") > T.CHUNK_ABOVE))
    return T.lexical_vectors(rows, "chunk", ("doc_id", "chunk_index", "chunk"), nest=True)


def vocabulary(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def statistics(docs: DataFrame) -> DataFrame:
    """Files by extension, most first."""
    return docs.groupBy("extension").agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("bytes")).orderBy(F.desc("files"), "extension")
