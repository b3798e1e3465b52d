"""Token counts with a cache keyed by content digest and tokenizer version."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickledger.llm.encoding import encoder
from brickledger.llm.shared import new_path, with_row, written

CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file: another file never meets counts stored for this one."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(path, "count")
        for batch in batches:
            counts = [sum(values) for values in counter.pieces(t.as_py() for t in batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, n_bytes, n_tokens) for every row of `docs`; new counts are appended to the table at `cache`.

    tokenizer: a `tokenizers` file that all executors can read.  Content is normalised only in that null equals the
    empty text, as byte-level tokenizers see every other difference; its SHA-256 is joined to the cache.  Of each
    distinct missing digest one text is encoded, whole, without added special tokens, truncation or padding.  This
    reads `docs` at once and runs the encoding; the returned rows are lazy.  Two runs at a time may both append the
    same count, which changes nothing.

    Null and empty texts: 0 bytes, 0 tokens.  Repeated rows, null or repeated doc_id: each row gets its text's count.
    Further columns are kept in `row` and take no part.  Tables without rows give none.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)  # so that it can be read
    content = F.coalesce(F.col(text), F.lit(""))
    digest = F.unhex(F.sha2(content.cast("binary"), 256))
    keyed = written(docs.select(F.col(doc_id).alias("id"), digest.alias("digest")))

    def cached() -> DataFrame:
        found = spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)
        return found.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))

    # One text for each digest: its least id tells which, so that no group of copies meets in a task.
    one = keyed.groupBy("digest").agg(F.min("id").alias("one")).join(cached(), "digest", "left_anti")
    texts = docs.select(F.col(doc_id).alias("id"), digest.alias("d"), content.alias("text"))
    chosen = texts.join(one.hint("shuffle_hash"), (F.col("d") == one["digest"]) & F.col("id").eqNullSafe(one["one"]))
    counts = chosen.select("digest", "text").mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
    counts = counts.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))
    counts.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)

    rows = with_row(docs, d=digest, n_bytes=F.octet_length(content).cast("long"))
    known = cached()
    return rows.join(known, rows["d"] == known["digest"], "left").select("row", "n_bytes", "n_tokens")


def op5_token_counts(spark, sf_dir):
    """Bytes and tokens of every document; the cache is a new one in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark))
    return counted.select("row.doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
