"""Substring dedup with difference-cover anchors: windows are hashed at cover positions only, then extended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of a window that must not occur twice.
WINDOW = 35
#: Difference covers: {period: positions}; any difference modulo the period is one of two positions.
COVERS = {1: (0,), 7: (1, 2, 4), 13: (0, 1, 3, 9), 21: (0, 1, 6, 8, 18)}
#: Shortest anchor in words.
LEAST_ANCHOR = 12
#: A task forgets word hashes beyond this many.
MOST_WORDS = 1_000_000
#: So many hashes are combined in a map task before they are sent.
COMBINED = 2_000_000
#: Two odd bases of the window hashes, and the inverse of each modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > MOST_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_words = _WordHashes()
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, 4096), base, np.uint64)
        factors[0] = 1
        known = np.multiply.accumulate(factors)
        if n <= 1 << 20:
            _powers[base] = known
    return known[:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def window_hashes(words: np.ndarray, starts: np.ndarray, size: int, which: int) -> np.ndarray:
    """A polynomial hash modulo 2**64 of the `size` words from each start."""
    if which:  # other values for the second hash
        words = words ^ (words >> np.uint64(31))
        words = words * np.uint64(0xBF58476D1CE4E5B9)
        words = words ^ (words >> np.uint64(29))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_BASES[which], len(words)), out=sums[1:])
    return (sums[starts + size] - sums[starts]) * _power(_INVERSES[which], len(words))[starts]


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, positions, words of an anchor): the largest period that leaves anchors of LEAST_ANCHOR words.

    Equal windows at i and j have a shift below the period that takes both to cover positions; an anchor of
    window - period + 1 words there lies within both windows.
    """
    period = max(p for p in COVERS if window - p + 1 >= min(LEAST_ANCHOR, window))
    return period, COVERS[period], window - period + 1


def _split(text) -> list[bytes]:
    return (text.as_py() or "").encode().split()



def _flat(parts: list[np.ndarray], kind) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, kind)


def _anchors(window: int):
    """(key, first hashes, second hashes, places) of each text's anchors."""
    period, positions, size = cover_for(window)
    cover = np.zeros(period, bool)
    cover[list(positions)] = True

    def hashes(batch: pa.RecordBatch):
        for key, text in zip(batch.column(0).to_numpy(), batch.column(1), strict=True):
            words = _split(text)
            if len(words) >= window:
                starts = np.arange(len(words) - size + 1)
                starts = starts[cover[starts % period]]
                yield key, window_hashes(word_hashes(words), starts, size, 0), None, starts

    return hashes


def _windows(window: int):
    """The same of all windows that hold one of the anchors at the places given beside the text."""
    period, _, _ = cover_for(window)

    def hashes(batch: pa.RecordBatch):
        for key, text, at in zip(batch.column(0).to_numpy(), batch.column(1), batch.column(2), strict=True):
            words = _split(text)
            if len(words) >= window:
                at = at.values.to_numpy()
                starts = np.flatnonzero(_cover(np.maximum(at - period + 1, 0), at + 1, len(words))[: len(words) - window + 1])
                known = word_hashes(words)
                yield key, window_hashes(known, starts, window, 0), window_hashes(known, starts, window, 1), starts

    return hashes


def _cover(first: np.ndarray, behind: np.ndarray, n: int) -> np.ndarray:
    """How many of the stretches from `first` to before `behind` cover each of n places."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, first, 1)
    np.add.at(edges, np.minimum(behind, n), -1)
    return np.cumsum(edges)[:-1]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start."""
    if not len(columns[0]):
        return np.empty(0, np.int64)
    change = np.zeros(len(columns[0]), bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _lists(values: np.ndarray, bucket: np.ndarray, n: int) -> pa.ListArray:
    """`values`, sorted by bucket, as a list for each of n buckets."""
    offsets = np.searchsorted(bucket, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


_BLOCKS = {
    "bucket": "int", "h1": "array<long>", "h2": "array<long>", "keys": "array<long>", "sizes": "array<int>", "at": "array<int>",
    "seen1": "array<long>", "seen2": "array<long>", "hit_keys": "array<long>", "hit_sizes": "array<int>", "hit_at": "array<int>",
}


def _block(docs: list[tuple], buckets: list[int]) -> pa.RecordBatch:
    """The hashes of some documents by bucket.  Those that occur more than once among them are known to be repeated:
    each is sent on once (seen), and where they stand as hits.  The others are sent with their places."""
    n = len(buckets)
    keys = np.array([d[0] for d in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    h1 = _flat([d[1] for d in docs], np.uint64)
    wide = bool(docs) and docs[0][2] is not None
    h2 = _flat([d[2] for d in docs], np.uint64) if wide else np.zeros(len(h1), np.uint64)
    at = _flat([d[3] for d in docs], np.int64).astype(np.int32)
    order = np.lexsort((h2, h1)) if wide else np.argsort(h1)
    first = _runs(h1[order], h2[order])
    times = np.diff(np.r_[first, len(order)])
    often = np.repeat(times > 1, times)
    bucket_of = lambda h: ((h >> np.uint64(33)) % np.uint64(n)).astype(np.int64)

    one = np.sort(order[~often])
    one = one[np.argsort(bucket_of(h1[one]), kind="stable")]
    one_bucket = bucket_of(h1[one])
    run = _runs(one_bucket, doc[one])
    seen = order[first[times > 1]]
    seen = seen[np.argsort(bucket_of(h1[seen]), kind="stable")]
    seen_bucket = bucket_of(h1[seen])
    hits = np.sort(order[often])
    hit_run = _runs(doc[hits])
    hit_bucket = doc[hits] * n // max(len(docs), 1)  # any will do; a document's stay together
    long = lambda h: h.view(np.int64)
    second = long(h2) if wide else np.empty(0, np.int64)
    columns = {
        "bucket": pa.array(buckets, pa.int32()),
        "h1": _lists(long(h1)[one], one_bucket, n),
        "h2": _lists(second[one] if wide else second, one_bucket if wide else second, n),
        "keys": _lists(keys[doc[one[run]]], one_bucket[run], n),
        "sizes": _lists(np.diff(np.r_[run, len(one)]).astype(np.int32), one_bucket[run], n),
        "at": _lists(at[one], one_bucket, n),
        "seen1": _lists(long(h1)[seen], seen_bucket, n),
        "seen2": _lists(second[seen] if wide else second, seen_bucket if wide else second, n),
        "hit_keys": _lists(keys[doc[hits[hit_run]]], hit_bucket[hit_run], n),
        "hit_sizes": _lists(np.diff(np.r_[hit_run, len(hits)]).astype(np.int32), hit_bucket[hit_run], n),
        "hit_at": _lists(at[hits], hit_bucket, n),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _columns(batches: Iterator[pa.RecordBatch], names: list[str]) -> dict[str, np.ndarray]:
    """The lists of all rows, one behind the other, by column."""
    parts: dict[str, list[np.ndarray]] = {name: [] for name in names}
    for batch in batches:
        for name in names:
            parts[name].append(batch.column(name).flatten().to_numpy(zero_copy_only=False))
    return {name: _flat(values, np.int64) for name, values in parts.items()}


_PLACES = {"bucket": "int", "keys": "array<long>", "sizes": "array<int>", "at": "array<int>"}


def _meet(buckets: list[int]):
    """Places whose hash occurs again, of the blocks of one partition, by bucket of their document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x = _columns(batches, list(_BLOCKS)[1:])
        n = len(x["h1"])
        h1 = np.r_[x["h1"], x["seen1"]]
        h2 = np.r_[x["h2"], x["seen2"]]
        order = np.lexsort((h2, h1)) if len(h2) else np.argsort(h1)
        first = _runs(h1[order], h2[order]) if len(h2) else _runs(h1[order])
        times = np.diff(np.r_[first, len(order)])
        again = order[np.repeat(times > 1, times)]
        again = again[again < n]
        keys = np.r_[np.repeat(x["keys"], x["sizes"])[again], np.repeat(x["hit_keys"], x["hit_sizes"])].astype(np.int64)
        at = np.r_[x["at"][again], x["hit_at"]].astype(np.int32)
        bucket = keys.view(np.uint64) % np.uint64(len(buckets))
        order = np.lexsort((at, keys, bucket))
        keys, at, bucket = keys[order], at[order], bucket[order].astype(np.int64)
        run = _runs(keys)
        lists = [
            _lists(keys[run], bucket[run], len(buckets)),
            _lists(np.diff(np.r_[run, len(keys)]).astype(np.int32), bucket[run], len(buckets)),
            _lists(at, bucket, len(buckets)),
        ]
        yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *lists], list(_PLACES))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document with its places, of the blocks of one partition."""
    x = _columns(batches, list(_PLACES)[1:])
    keys, at = np.repeat(x["keys"], x["sizes"]).astype(np.int64), x["at"].astype(np.int32)
    order = np.lexsort((at, keys))
    keys, at = keys[order], at[order]
    if len(keys):  # equal rows send equal places
        one = _runs(keys, at)
        keys, at = keys[one], at[one]
    run = _runs(keys)
    offsets = np.r_[run, len(keys)].astype(np.int32)
    yield pa.RecordBatch.from_arrays([pa.array(keys[run]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(at))], ["key", "at"])


def _repeated(texts: DataFrame, hashes: Callable) -> DataFrame:
    """(key, at): for each document that has any, the places whose hash occurs more than once in all.

    Hashes are combined in each map task before they are shuffled, so a passage that any number of documents hold
    is sent at most once by each.  Every partition gets one bucket of hashes; spark.sql.shuffle.partitions bounds it.
    """
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Numbers that hash partitioning deals to partitions 0 .. n - 1, one for each.
    dealt = spark.range(64 * n).select(F.col("id").cast("int").alias("v")).groupBy(F.pmod(F.hash("v"), F.lit(n)).alias("p"))
    found = {r.p: r.v for r in dealt.agg(F.min("v").alias("v")).collect()}
    buckets = [found.get(p, p) for p in range(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        size = 0
        for batch in batches:
            for doc in hashes(batch):
                waiting.append(doc)
                size += len(doc[3])
                if size >= COMBINED:
                    yield _block(waiting, buckets)
                    waiting, size = [], 0
        if waiting:
            yield _block(waiting, buckets)

    schema = lambda columns: ", ".join(f"{name} {kind}" for name, kind in columns.items())
    blocks = texts.mapInArrow(run, schema(_BLOCKS)).repartition(n, "bucket")
    places = blocks.mapInArrow(_meet(buckets), schema(_PLACES)).repartition(n, "bucket")
    return places.mapInArrow(_gather, "key long, at array<int>")


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                words = _split(text)
                total.append(len(words))
                if at.is_valid:
                    starts = at.values.to_numpy()
                    stay = np.flatnonzero(_cover(starts, starts + window, len(words)) == 0)
                    gone.append(len(words) - len(stay))
                    words = [words[i] for i in stay.tolist()]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "n_removed", "kept_text"],
            )

    return run


def remove_repeated_passages(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): every document less the words of repeated windows.

    Words are separated by ASCII white space and compared as they are.  Each word covered by a window of `window`
    words that also starts elsewhere, in the same document or another, goes; all occurrences go.  First, anchors at
    difference-cover positions are hashed and those that occur once dropped.  Each left is extended to all windows
    around it, and these are compared by 128 bits.  Nothing is paired: each map task sends a hash at most once for
    every COMBINED hashes, so a passage of any number of documents is no hot key.  A document's own positions are
    gathered, as its text is; the texts are shuffled once, for both joins.

    Null and empty texts and texts shorter than a window: nothing is removed, kept_text has single spaces.  Documents
    are told apart by 64 bits of doc_id and text, so null or repeated doc_ids with different texts are different
    documents; rows that repeat both are each other's copies and both lose what they share.  Further columns take no
    part.  Tables without rows give none.
    """
    base = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("key"), F.col(text).alias("text"), F.col(doc_id).alias("doc_id"))
    hits = _repeated(base.select("key", "text"), _anchors(window))
    texts = base.select("key", "text", "doc_id")
    # With doc_id, which is not needed here, so that both joins share one shuffle of the texts.
    covered = _repeated(texts.join(hits, "key").select("key", "text", "at", "doc_id"), _windows(window))
    rows = texts.join(covered, "key", "left").select("doc_id", "text", "at")
    kind = docs.schema[doc_id].dataType.simpleString()
    return rows.mapInArrow(_cut(window), f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def op9_substring_dedup(spark, sf_dir):
    """Words and removed words of every document, and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    kept = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return remove_repeated_passages(docs).select("doc_id", "n_words", "n_removed", kept)


ORACLE_SUBSTRING_DEDUP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i : i + {WINDOW - 1}], ' ') AS s
  FROM d, unnest(range(1, len(w) - {WINDOW - 2})) AS u(i) WHERE len(w) >= {WINDOW}),
hashed AS (SELECT doc_id, i, md5(s) AS s FROM win),
twice AS (SELECT s FROM hashed GROUP BY s HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hashed JOIN twice USING (s), unnest(range(0, {WINDOW})) AS v(k)),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) FILTER (g.i IS NULL) AS text, count(g.i) AS n_removed
  FROM word x LEFT JOIN gone g ON x.doc_id = g.doc_id AND x.i = g.i GROUP BY x.doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
