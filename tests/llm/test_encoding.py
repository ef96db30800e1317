"""Token blocks and packed sequences: exact round trips."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftspark.llm import packing, rans
from siftspark.llm.tokens import tokenizer

ROWS = [(1, "Hello there, world.  Two  spaces\n\nand lines"), (1, "Hello there, world.  Two  spaces\n\nand lines"), (2, ""), (3, None), (None, "no id"), (4, "naïve café 日本 🙂 it's 12345"), (5, " ".join(f"word{i % 97}" for i in range(9000)))]


def docs(spark, rows=ROWS):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({"tokens": F.lit("clash"), "ids": F.lit(1), "kind": F.lit("clash"), "block": F.lit(None)})


def ids_of(text):
    return tokenizer().encoding.encode_ordinary(text or "")


def test_batches_give_the_ids_of_single_texts():
    import pyarrow as pa

    texts = [t for _, t in ROWS]
    ids, at = tokenizer().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in texts]


def test_pieces_of_like_hashes_keep_their_ids(monkeypatch):
    """Thue-Morse words collide in any polynomial hash modulo 2**64; and with a hash of 2 bits, nearly all pieces do."""
    import pyarrow as pa

    from siftspark.llm import tokens

    one = "".join("ab"[bin(i).count("1") & 1] for i in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    texts = [f"{one} {two}", f" {two} {one}", "".join("ab"[bin(i).count("1") & 1] for i in range(4096)) + " " + one, *[t for _, t in ROWS]]
    for bits in (64, 2):
        real = tokens.span_hashes
        if bits == 2:
            monkeypatch.setattr(tokens, "span_hashes", lambda d, a, b, seed=0: real(d, a, b, seed) if seed else real(d, a, b) & np.uint64(3))
        own = tokens.Tokenizer()
        for _ in range(2):
            ids, at = own.encode(pa.array(texts))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [ids_of(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=700), st.integers(0, 10_000))
def test_block_round_trip(tokens, seed):
    ids = np.array(tokens, dtype=np.int64)
    counts = np.bincount(ids, minlength=41) + np.random.default_rng(seed).integers(0, 3, 41)
    freq = rans.normalised(counts)
    assert counts.sum() == 0 or (freq.sum() == 1 << rans.SCALE_BITS and ((freq > 0) == (counts > 0)).all())
    [(states, payload, _)] = rans.encode_blocks(ids, np.array([0]), np.array([len(ids)]), freq)
    assert rans.decode_block(states, payload, len(ids), freq).tolist() == tokens


def test_checkpoints_start_inside_a_block():
    ids = np.random.default_rng(1).geometric(0.01, 4096).clip(max=5000).astype(np.int64)
    freq = rans.normalised(np.bincount(ids, minlength=5001))
    [(_, payload, marks)] = rans.encode_blocks(ids, np.array([0]), np.array([4096]), freq)
    points = rans.checkpoints_of(marks)
    assert len(points) == 4096 // (rans.LANES * rans.CHECKPOINT_STEPS) - 1
    for token, word, states in points:
        assert (rans.decode_block(states, payload[4 * word :], 4096, freq, token) == ids[token:]).all()


def test_corpus_round_trip(spark, tmp_path):
    rans.encode(docs(spark)).write.parquet(str(tmp_path / "b"))
    blocks = spark.read.parquet(str(tmp_path / "b"))
    found = {}
    for r in sorted(rans.decode(blocks).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.block)):
        found.setdefault((r.doc_id, r.block), []).append(r.ids)
    assert len(found[(1, 0)]) == 2
    for i, text in ROWS:
        got = [x for (d, b), v in sorted(found.items(), key=str) if d == i for x in v[0]] if i != 5 else [x for b in range(sum(d == 5 for d, _ in found)) for x in found[(5, b)][0]]
        assert got == ids_of(text)
    size = blocks.filter("kind = 'block'").agg(F.sum(F.length("payload"))).first()[0]
    assert size < 2 * sum(len(ids_of(t)) for _, t in ROWS)
    broken = blocks.withColumn("payload", F.when(F.col("n_tokens") > 4000, F.concat(F.unhex(F.lit("01020304")), F.expr("substring(payload, 5, 1000000)"))).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="checksum"):
        rans.decode(broken).collect()


def test_texts_come_back(spark):
    rows = [(i, t) for i, (_, t) in enumerate(ROWS)]
    got = {r.doc_id: r.text for r in rans.texts_of(rans.decode(rans.encode(docs(spark, rows)))).collect()}
    assert got == {i: t or "" for i, t in rows}


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert [r.kind for r in rans.encode(none).collect()] == ["table"] and packing.pack(none).count() == 0


@given(st.lists(st.integers(0, 100_000), min_size=1, max_size=20))
def test_pieces_are_the_binary_digits(sizes):
    each, length = packing.pieces(np.array(sizes), 4096)
    at = 0
    for n, k in zip(sizes, each):
        own = length[at : at + k].tolist()
        at += k
        assert own == [4096] * (n // 4096) + [1 << b for b in range(11, -1, -1) if n % 4096 >> b & 1]


def test_packed_sequences_give_the_documents_back(spark):
    rows = packing.pack(docs(spark), max_length=1024).collect()
    assert all(len(r.tokens) == r.length == 1 << r.bucket <= 1024 for r in rows)
    for i, text in ROWS:
        if i != 1:
            own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
            assert [t for r in own for t in r.tokens] == ids_of(text) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own]])[: len(own)].tolist()
    assert sum(r.length for r in rows if r.doc_id == 1) == 2 * len(ids_of(ROWS[0][1]))
    with pytest.raises(ValueError):
        packing.pack(docs(spark), max_length=1000)
