"""SimHash near-dedup by meet-in-the-middle ball hashing; near-dedup by Jaccard similarity of the same shingles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickledger.llm.shared import class_of, components, with_row, written

SHINGLE = 3
SEED = 42
RADIUS = 3
#: Parts of the 64 bits of which one is masked at a time when the radius is odd.
PARTS = 4
_CHUNK = 1 << 15
#: Bands of least shingle hashes, and hashes in a band: a pair of Jaccard similarity j meets in some band with
#: probability 1 - (1 - j ** BAND_ROWS) ** BANDS; 0.99993 at 0.8.
BANDS = 24
BAND_ROWS = 5
#: A candidate is counted exactly if the number of equal least hashes is no more than so many standard deviations
#: below what the similarity gives; at 0.8 a pair is passed over with a probability of 4e-5.
ESTIMATE_SDS = 4.2
#: A shingle of up to so many sets counts as their own; sets of the first turn for one shingle.
SPARSE = 8


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits: bit i is 1 if more than half of the shingles' XXH64 have it; A-Z in lower case, words between ASCII
    white space, repeated shingles count each time, fewer words than a shingle are one shingle, no words give 0."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    total = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for start in range(0, total, _CHUNK):
        n = min(_CHUNK, total - start)
        hashes = np.fromiter((digest(next(grams), seed) for _ in range(n)), np.dtype("<u8"), n)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _balls(radius: int, parts: int) -> list[tuple[int, int]]:
    """(mask, flips) of the variants that each fingerprint emits.

    An even radius 2r: all flips of up to r bits, so that balls around two fingerprints within 2r bits meet.  An odd
    radius 2r+1: the same with one part of the bits masked at a time.  Two fingerprints that differ in 2r+1 bits
    differ in at most 2r outside some part; so the balls of radius r there meet.
    """
    half = radius // 2
    if half > 1:
        raise ValueError("radius up to 3")
    step = 64 // parts
    masks = [sum(1 << b for b in range(64) if b // step != p) for p in range(parts)] if radius % 2 else [(1 << 64) - 1]
    flips = [0, *(1 << b for b in range(64))] if half else [0]
    return [(_signed(m), _signed(f)) for m in masks for f in flips if f & ~m == 0]


def fingerprint_links(marks: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """(a, b): distinct pairs of the distinct fingerprints `marks` (fp) that differ in at most `radius` bits.

    Every fingerprint emits its variants (see _balls), variants are shuffled, pairs that meet are verified on all
    64 bits and deduplicated.  No variant, bucket or pair is capped.
    """
    balls = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(f).alias("f")) for m, f in _balls(radius, parts)])
    emitted = marks.select("fp", F.explode(balls).alias("v")).select(
        F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("variant"), "fp"
    )
    # Sizes before the explosion would make one side look small enough to broadcast.
    a, b = emitted.alias("a"), emitted.alias("b").hint("merge")
    close = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
    met = a.join(b, (F.col("a.variant") == F.col("b.variant")) & (F.col("a.fp") < F.col("b.fp")) & close)
    return met.select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """(doc_id, fp, class_id) for every row: class_id is the least doc_id reachable by links of up to `radius` bits.

    Documents of equal fingerprint meet as one, so copies are never paired.  Runs its jobs when called.

    Null and empty texts and texts of white space alone: fingerprint 0, linked like any other.  Null doc_id: gets the
    class of its fingerprint; the class is null only if it has no other doc_id.  Repeated rows: each is returned.
    Further columns take no part.  Tables without rows give none.
    """
    found = written(fingerprints(docs, doc_id, text, shingle))
    marks = written(found.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("first")))
    links = fingerprint_links(marks.select(F.col("node").alias("fp")), radius)
    classes = class_of(marks, links)
    return found.join(classes.select(F.col("node").alias("fp"), "class_id"), "fp").select("doc_id", "fp", "class_id")


def _least_of_each(docs: DataFrame, classes: DataFrame, doc_id: str) -> DataFrame:
    keys = classes.where(F.col("doc_id") == F.col("class_id")).select(F.col("doc_id").alias("doc")).distinct()
    rows = with_row(docs, doc=F.col(doc_id))
    kept = rows.join(keys, "doc", "left_semi").dropDuplicates(["doc"])
    return kept.unionByName(rows.where(F.col("doc").isNull())).select("row.*")


def keep_one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """One row of each class of near-duplicates: the one of the least doc_id.

    Rows that repeat a doc_id: one of them stays.  Rows of null doc_id link others, but all stay themselves, as
    nothing tells them apart.  All columns are returned as they were.
    """
    return _least_of_each(docs, near_duplicates(docs, doc_id, text, radius, shingle), doc_id)


def shingle_set(text: str | None, shingle: int, seed: int = SEED) -> np.ndarray:
    """The distinct hashes of the shingles that `fingerprint` counts, in order; none without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(gram, seed) for gram in grams), np.uint64, max(1, len(words) - shingle + 1)))


def _least_products(hashes: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """For each factor the least product with a hash."""
    least = np.full(len(factors), np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 512):
        np.minimum(least, np.multiply.outer(factors, hashes[start : start + 512]).min(axis=1), out=least)
    return least


def _set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def _banded(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(doc_id, digest, size, least, bands): 128 bits that stand for the set of shingles, its size and least hashes.

    `least` has 32 bits of each of the BANDS * BAND_ROWS least products, `bands` a hash of each band of them.
    """
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["doc_id", "digest", "size", "least", "bands"]
    kinds = [pa.binary(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch, made = whole.slice(start, 1024), []
                for t in batch.column(1):
                    hashes = shingle_set(t.as_py(), shingle)
                    least = _least_products(hashes, factors)
                    bands = [_signed(xxhash.xxh64_intdigest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, BAND_ROWS))]
                    high = (least >> np.uint64(32)).astype(np.uint32).view(np.int32)
                    made.append((_set_digest(hashes), len(hashes), high, bands if len(hashes) else []))
                columns = [pa.array(column, kind) for column, kind in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    kind = docs.schema[doc_id].dataType.simpleString()
    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, digest binary, size int, least array<int>, bands array<long>")


class _Sets:
    """The shingle sets of nodes that are asked for, made anew from their texts, as few are: all sets are larger than
    all texts.  `sets` (node, size, least, bands), `marks` (node, digest, first: the least doc_id of that set)."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, shingle: int, sets: DataFrame, marks: DataFrame):
        self.docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
        self.shingle, self.sets, self.marks = shingle, sets, marks

    def hashes(self, nodes: DataFrame) -> DataFrame:
        """(node, hashes) for the distinct `nodes` (node)."""
        shingle = self.shingle

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    made = [shingle_set(t.as_py(), shingle) for t in batch.column(0).slice(start, 256)]
                    digests = pa.array([_set_digest(h) for h in made], pa.binary())
                    yield pa.RecordBatch.from_arrays([digests, pa.array([h.view(np.int64) for h in made], pa.list_(pa.int64()))], ["digest", "hashes"])

        wanted = written(self.marks.join(nodes, "node", "left_semi").select("node", "digest", "first"))
        # A set of rows without a doc_id is looked for among all of those.
        ids = wanted.select(F.col("first").alias("id")).distinct()
        texts = self.docs.join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        made = texts.mapInArrow(run, "digest binary, hashes array<long>").join(wanted.select("node", "digest"), "digest")
        return written(made.select("node", "hashes").dropDuplicates(["node"]))

    def similar(self, pairs: DataFrame, similarity: float, made: DataFrame | None = None) -> DataFrame:
        """The pairs (a, b) whose sets have a Jaccard similarity of at least `similarity`; `made`: their hashes, if at hand.

        First by the share of equal least hashes: pairs more than ESTIMATE_SDS standard deviations below `similarity`
        go.  What is left is counted exactly.  The sets of b meet the pairs first, so that the set of a node with many
        partners, which are all its b, is sent once and not once per partner.
        """
        rows = BANDS * BAND_ROWS
        fewest = rows * similarity - ESTIMATE_SDS * (rows * similarity * (1 - similarity)) ** 0.5
        least = lambda name: self.sets.select(F.col("node").alias(name), F.col("least").alias(f"least_{name}")).hint("merge")
        equal = F.size(F.filter(F.zip_with("least_a", "least_b", lambda x, y: x == y), lambda same: same))
        near = written(pairs.join(least("b"), "b").join(least("a"), "a").where(equal >= fewest).select("a", "b"))
        if near.isEmpty():
            return near
        if made is None:
            made = self.hashes(near.select(F.col("a").alias("node")).union(near.select("b")).distinct())
        of = lambda name: made.select(F.col("node").alias(name), F.col("hashes").alias(f"hashes_{name}")).hint("merge")
        both = F.size(F.array_intersect("hashes_a", "hashes_b"))
        share = both / (F.size("hashes_a") + F.size("hashes_b") - both)
        return written(near.join(of("b"), "b").join(of("a"), "a").where(share >= similarity).select("a", "b"))


def prefixes(words: DataFrame, similarity: float) -> DataFrame:
    """(hash, node, size, root, place, own) of `words` (node, size, root, hash): the shingles by which sets can meet.

    With a set's shingles in order of their frequency (then hash), two sets of similarity s share one of the first
    (1 - s) * size + 1 of each.  `own` is the share of a set's shingles that up to SPARSE sets have.
    """
    counts = words.groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    of_node = W.partitionBy("node")
    placed = words.join(counts.hint("merge"), "hash").withColumns({
        "place": F.row_number().over(of_node.orderBy("n", "hash")),
        "own": F.count_if(F.col("n") <= SPARSE).over(of_node) / F.col("size"),
    })
    # The product of two doubles may fall just below a whole number.
    within = F.col("place") <= F.floor(F.col("size") * (1 - similarity) + 1e-6) + 1
    return placed.where(within & (F.col("n") > 1)).select("hash", "node", "size", "root", "place", "own")


def _meeting(a: DataFrame, b: DataFrame, similarity: float) -> DataFrame:
    """(a, b): pairs of rows of different roots that share a shingle at places that leave enough to have in common.

    All that two sets share stands at or after the first shingle that they share.  So at that one both have at least
    as many shingles left as sets of these sizes must share; pairs that have fewer can't be similar.
    """
    shared = F.ceil((F.col("a.size") + F.col("b.size")) * (similarity / (1 + similarity)) - 1e-6)
    left = F.least(F.col("a.size") - F.col("a.place"), F.col("b.size") - F.col("b.place")) + 1
    same = (F.col("a.hash") == F.col("b.hash")) & (F.col("a.root") != F.col("b.root")) & (left >= shared)
    met = a.alias("a").join(b.alias("b").hint("merge"), same)
    return met.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def apart_links(members: DataFrame, sets: _Sets, links: DataFrame, similarity: float) -> DataFrame:
    """`links` and those (a, b) that join nodes of different roots: no two classes that a link joins stay apart.

    `members` (band, node, size, root); those of buckets of several roots take part.  They meet by the shingles of
    their prefixes, where enough of both is left (_meeting).  Texts that share a passage and little else have the
    shingles of their prefixes to themselves and never meet, however many they are.

    Where many meet by one shingle, they are compared in turns, and roots are joined after each, as members of one
    root need no comparison.  First all with the one that has least of its own.  Then the members outside the largest
    root, drawn by a hash into turns of about SPARSE, 2 * SPARSE, 4 * SPARSE, ..., each with all others of other roots.
    The turns are as many as the logarithm of the members; nothing is left out.
    """
    mixed = members.groupBy("band").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one < other")
    open_nodes = written(members.join(mixed.select("band"), "band", "left_semi").select("node", "size", "root").distinct())
    if open_nodes.isEmpty():
        return links
    hashes = sets.hashes(open_nodes.select("node"))
    words = open_nodes.join(hashes.hint("merge"), "node").select("node", "size", "root", F.explode("hashes").alias("hash"))
    found = written(prefixes(written(words), similarity))

    def several(rows: DataFrame) -> DataFrame:
        roots = rows.groupBy("hash").agg(F.min("root").alias("one"), F.max("root").alias("other")).where("one < other")
        return written(rows.join(roots.select("hash"), "hash", "left_semi"))

    def joined(rows: DataFrame, fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
        """`rows` and `roots` after the links `fresh`: only roots that these join are looked at, not all links again."""
        of = lambda name: roots.select(F.col("node").alias(name), F.col("root").alias(f"root_{name}"))
        ends = fresh.join(of("a"), "a").join(of("b"), "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        moved = components(ends).select(F.col("node").alias("root"), F.col("root").alias("now"))
        if moved.isEmpty():
            return rows, roots
        moved = written(moved)
        moving = lambda df: df.join(moved, "root", "left").withColumn("root", F.coalesce("now", "root")).drop("now")
        return several(moving(rows)), written(moving(roots))

    roots = open_nodes.select("node", "root")
    live = several(found)
    centre = live.groupBy("hash").agg(F.min(F.struct("own", "node", "size", "root", "place")).alias("c")).select("hash", "c.*")
    fresh = sets.similar(written(_meeting(live, centre, similarity)), similarity, hashes)
    links = links.union(fresh)
    live, roots = joined(live, fresh)
    by_root = live.groupBy("hash", "root").agg(F.count(F.lit(1)).alias("n"))
    groups = by_root.groupBy("hash").agg(F.max(F.struct("n", "root")).alias("most"), F.sum("n").alias("n"))
    drawn = F.pmod(F.xxhash64("hash", "node"), F.lit(1 << 20)) / (1 << 20) * (F.col("n") - F.col("most.n"))
    turn = F.when(F.col("root") != F.col("most.root"), F.floor(F.log2(drawn / SPARSE + 1)).cast("int"))
    live = written(live.join(groups.hint("merge"), "hash").withColumn("turn", turn).drop("n", "most"))
    turns = live.agg(F.max("turn")).first()[0]
    for k in range(0 if turns is None else turns + 1):
        pairs = written(_meeting(live.where(F.col("turn") == k), live, similarity))
        if pairs.isEmpty():
            continue
        fresh = sets.similar(pairs, similarity, hashes)
        links = links.union(fresh)
        if k < turns:
            live, roots = joined(live, fresh)
    return links


def similar_classes(
    docs: DataFrame, shingle: int, similarity: float, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, class_id) for every row: class_id is the least doc_id reachable by links of Jaccard similarity.

    A link: the sets of shingles have at least `similarity` in common, counted exactly for every candidate.  Two
    documents are candidates if a band of their least hashes is equal (see BANDS); a fingerprint of 64 bits does not
    tell such pairs from others.  Each member of a bucket is first compared with the bucket's least, so a group of
    copies costs as many pairs as it has members; then the members that this left in different classes are compared where
    they share what is rare (apart_links), so that pairs grow with the members of a bucket, not their square, unless
    most of a bucket are apart and yet made of the same frequent shingles.  No bucket is cut.  Equal sets meet as one (by 128 bits).  Candidates are passed over whose equal least
    hashes say that they are far below the similarity (see ESTIMATE_SDS).  Runs its jobs when called and reads `docs`
    up to four times, once whole and then for the texts of candidates.

    Null and empty texts and texts of white space alone: the empty set, all one class.  Null doc_id, repeated rows
    and further columns: as in near_duplicates.  Tables without rows give none.
    """
    found = written(_banded(docs, doc_id, text, shingle).withColumn("row", F.monotonically_increasing_id()))
    marks = written(found.groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("first")))
    chosen = found.select(F.col("row").alias("node"), "size", "least", "bands").join(marks.select("node"), "node", "left_semi")
    sets = _Sets(docs, doc_id, text, shingle, written(chosen), marks)
    buckets = sets.sets.select(F.explode("bands").alias("band"), "node", "size")
    least = buckets.groupBy("band").agg(F.min(F.struct("node", "size")).alias("least"), F.max("node").alias("last"))
    shared = written(buckets.join(least.where("least.node < last").drop("last"), "band"))
    fits = F.least("size", "least.size") / F.greatest("size", "least.size") >= similarity
    stars = shared.where(F.col("node") != F.col("least.node")).where(fits)
    stars = written(stars.select(F.col("least.node").alias("a"), F.col("node").alias("b")).distinct())
    links = sets.similar(stars, similarity)
    rooted = shared.join(components(links), "node", "left").select("band", "node", "size", F.coalesce("root", "node").alias("root"))
    links = apart_links(written(rooted), sets, links, similarity)
    classes = class_of(marks.select("node", "first"), links)
    of_digest = marks.select("digest", "node").join(classes.select("node", "class_id"), "node").select("digest", "class_id")
    return found.select("doc_id", "digest").join(of_digest, "digest").select("doc_id", "class_id")


def keep_one_of_similar(
    docs: DataFrame, shingle: int, similarity: float, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row of each class of similar_classes, by the rules of keep_one_of_each."""
    return _least_of_each(docs, similar_classes(docs, shingle, similarity, doc_id, text), doc_id)


def keep_one_by_either(
    docs: DataFrame, shingle: int, similarity: float, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS
) -> DataFrame:
    """One row of each class by links of either kind, by the rules of keep_one_of_each; doc_id is a long.

    Documents are linked by fingerprints that differ in at most `radius` bits (near_duplicates) and by Jaccard similarity
    of at least `similarity` (similar_classes), which fingerprints tell for few pairs at 0.8.  Classes of both kinds that
    share a row are one.  Where a doc_id is null or repeated, rows are told apart by numbers, with which `docs` is written.
    """
    apart = docs.agg(F.count("*") == F.count_distinct(doc_id)).first()[0]
    keyed = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    if not apart:
        keyed = written(keyed.withColumn("row", F.monotonically_increasing_id()))
    key = "id" if apart else "row"
    by_bits = near_duplicates(keyed, key, "text", radius, shingle).select("doc_id", F.col("class_id").alias("a"))
    by_sets = similar_classes(keyed, shingle, similarity, key, "text").select("doc_id", F.col("class_id").alias("b"))
    both = written(by_bits.join(by_sets, "doc_id"))
    nodes = both.select(F.col("a").alias("node")).union(both.select("b")).distinct()
    classes = class_of(nodes.withColumn("first", F.col("node")), both.select("a", "b"))
    found = both.join(classes.select(F.col("node").alias("a"), "class_id"), "a").select("doc_id", "class_id")
    if not apart:
        ids = keyed.select("id", F.col("row").alias("doc_id")).join(found, "doc_id")
        least = ids.groupBy("class_id").agg(F.min("id").alias("least"))
        found = ids.join(least, "class_id").select(F.col("id").alias("doc_id"), F.col("least").alias("class_id"))
    return _least_of_each(docs, found, doc_id)


def op6_simhash(spark, sf_dir):
    """Fingerprint and class of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("class_id").alias("component_id")
    )
