"""Packing by power-of-two decomposition: each document is cut into pieces of binary lengths, equal lengths are bucketed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brickledger.llm.encoding import encoder

LONGEST = 2048
#: Rows of output are handed on whenever they hold so many bytes of ids.
_BATCH_BYTES = 8 << 20


def cuts(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: as many of `longest` as fit, then the rest's binary digits, large first."""
    whole, rest = divmod(n, longest)
    out = [(k * longest, longest) for k in range(whole)]
    at = whole * longest
    for bit in range(rest.bit_length() - 1, -1, -1):
        if rest >> bit & 1:
            out.append((at, 1 << bit))
            at += 1 << bit
    return out


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int = 1, longest: int = LONGEST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per sequence: (doc_id, start, length, ids, ids_crc32, doc_tokens, bucket, offset, sequence_id).

    A document's ids, as the `tokenizers` file gives them without added special tokens, and then `end_id`, are cut at
    powers of two up to `longest` (itself one).  Every piece is a sequence of its own, which needs no padding and
    crosses no documents: offset is 0, bucket is its length, ids its ids as little-endian unsigned 32-bit numbers.
    sequence_id is unique, not dense.  It follows from the partition and the place in it, so equal for equal splits of
    the input.  A projection of the input without a shuffle; `write_buckets` lays the sequences out by length.

    Null and empty texts: the one id `end_id`.  Null, repeated doc_id and repeated rows: each row is packed by itself.
    Further columns take no part.  Tables without rows give none.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids binary, ids_crc32 long, doc_tokens long"
    last = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer, "bytes")
        for batch in batches:
            owners: list[int] = []
            rows: list[tuple] = []
            size = 0

            def flush(batch=batch, owners=owners, rows=rows):
                columns = list(zip(*rows, strict=True)) or [()] * 5
                types = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
                made = [batch.column(0).take(pa.array(owners, pa.int64())), *map(pa.array, columns, types)]
                owners.clear()
                rows.clear()
                return pa.RecordBatch.from_arrays(made, ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"])

            for at, values in enumerate(coder.pieces(t.as_py() or "" for t in batch.column(1))):
                ids = b"".join(values) + last
                total = len(ids) // 4
                for start, length in cuts(total, longest):
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((start, length, piece, zlib.crc32(piece), total))
                    owners.append(at)
                size += len(ids)
                if size >= _BATCH_BYTES:
                    yield flush()
                    size = 0
            yield flush()

    packed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
    return packed.select(
        "*", F.col("length").alias("bucket"), F.lit(0).cast("long").alias("offset"),
        F.monotonically_increasing_id().alias("sequence_id"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """The sequences as Parquet with one folder per length, so that a batch is read from one bucket."""
    packed.write.partitionBy("bucket").parquet(path)


def op10_packing(spark, sf_dir):
    """All documents as sequences of at most 2048 ids, one row per piece."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
