"""A searchable index that its holder can't read: terms are keyed hashes, posting lists are sealed blobs.

A term becomes HMAC-SHA256(key, term), built from SHA2 in the JVM; the documents of a term are a list sealed by AES-GCM.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalize_word

LEAST_PASSPHRASE = 16


def key_from(passphrase: str, salt: bytes = b"siftspark sealed index") -> bytes:
    if len(passphrase.encode()) < LEAST_PASSPHRASE:
        raise ValueError(f"a passphrase has {LEAST_PASSPHRASE} bytes at least")
    return hashlib.pbkdf2_hmac("sha256", passphrase.encode(), salt, 200_000)


def _pads(key: bytes) -> tuple[bytes, bytes]:
    block = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in block), bytes(b ^ 0x5C for b in block)


def _binary(raw: bytes) -> Column:
    return F.unhex(F.lit(raw.hex()))


def trapdoor(key: bytes, term: Column) -> Column:
    inner, outer = _pads(key)
    first = F.unhex(F.sha2(F.concat(_binary(inner), F.encode(term, "UTF-8")), 256))
    return F.sha2(F.concat(_binary(outer), first), 256)


def _sealing(key: bytes) -> Column:
    return _binary(hashlib.sha256(b"seal" + key).digest())


#: Documents of one sealed list, about; a more frequent term has several.
LIST_DOCS = 1_000_000


def build(postings: DataFrame, key: bytes, list_docs: int = LIST_DOCS) -> DataFrame:
    """(trapdoor, blob). The documents of a term of more than list_docs are spread over several lists, so none gathers in one task."""
    most = postings.groupBy("term").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1 + most // list_docs))
    lists = postings.groupBy("term", spread.alias("_k")).agg(F.array_join(F.sort_array(F.collect_set("doc_id")), ",").alias("_ids"))
    return lists.select(trapdoor(key, F.col("term")).alias("trapdoor"), F.aes_encrypt(F.encode("_ids", "UTF-8"), _sealing(key), F.lit("GCM")).alias("blob"))


def save(sealed: DataFrame, path: str) -> None:
    """As Parquet in order of trapdoors, so that a lookup reads few row groups."""
    sealed.repartitionByRange("trapdoor").sortWithinPartitions("trapdoor").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trapdoor string, blob binary").parquet(path)


def _opened(sealed: DataFrame, key: bytes, terms: list[str]) -> DataFrame:
    wanted = sealed.sparkSession.createDataFrame([(t,) for t in terms], "t string").select(trapdoor(key, F.col("t")).alias("trapdoor")).distinct()
    ids = F.split(F.decode(F.aes_decrypt("blob", _sealing(key), F.lit("GCM")), "UTF-8"), ",")
    return sealed.join(F.broadcast(wanted), "trapdoor").select("trapdoor", F.explode(ids).alias("_id")).select("trapdoor", F.col("_id").cast("bigint").alias("doc_id"))  # the terms of one query


def lookup(sealed: DataFrame, key: bytes, term: str) -> DataFrame:
    return _opened(sealed, key, [normalize_word(term)]).select("doc_id").orderBy("doc_id")


def lookup_all(sealed: DataFrame, key: bytes, terms: list[str]) -> DataFrame:
    """Documents of every term."""
    words = sorted({normalize_word(t) for t in terms})
    return _opened(sealed, key, words).groupBy("doc_id").agg(F.count_distinct("trapdoor").alias("_n")).filter(F.col("_n") == len(words)).select("doc_id").orderBy("doc_id")
