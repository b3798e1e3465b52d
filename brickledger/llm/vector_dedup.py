"""Embedding near-dedup by product quantisation: coarse inverted lists, residual codes, table-lookup distances, exact rerank."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brickledger.llm.shared import class_of, written

THRESHOLD = 0.9
#: Vectors that the codebooks are fitted on: the least by a hash of the id, so a sample that no order of rows biases.
TRAIN_ROWS = 4096
LISTS = 256
SUBSPACES = 16
CODES = 64
#: About so many rows of a list, and so many look-ups in it, meet in one task; larger lists are split into cells.
CELL_ROWS = 2048
_SEED = 11


def _kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    rng = np.random.default_rng(_SEED)
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


class Index:
    """Coarse centres and a codebook of residuals for each subspace, fitted on unit vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int = LISTS, subspaces: int = SUBSPACES, codes: int = CODES):
        self.centres = _kmeans(sample, lists)
        self.apart = np.stack([np.sqrt(((self.centres - c) ** 2).sum(1)) for c in self.centres])
        self.edges = np.linspace(0, sample.shape[1], min(subspaces, sample.shape[1]) + 1).astype(int)
        rest = sample - self.centres[self.nearest(sample)]
        self.books = [_kmeans(rest[:, a:b], codes) for a, b in zip(self.edges, self.edges[1:], strict=False)]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        return ((self.centres**2).sum(1) - 2 * x @ self.centres.T).argmin(1)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals, and each vector's distance from what its code stands for."""
        rest = x - self.centres[lists]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:], strict=False)):
            part = rest[:, a:b]
            codes[:, m] = ((book**2).sum(1) - 2 * part @ book.T).argmin(1)
            error += ((part - book[codes[:, m]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, x: np.ndarray, reach: float) -> np.ndarray:
        """rows x lists: where a vector is looked up; its own list always.

        The gap to a list is half of what the squared distance of its centre exceeds that of the own centre by.  Of two
        vectors at most `reach` apart, each has its gap to the other's list; as functions of the vector the two gaps
        are opposite and change by the centres' distance a unit, so they add up to at most `reach` times that
        distance and one is at most half of it.  So one of the two vectors is looked up in the other's list.
        """
        near = (self.centres**2).sum(1) - 2 * x @ self.centres.T
        own = self.nearest(x)
        gaps = (near - near[np.arange(len(x)), own][:, None]) / 2
        return gaps <= reach * self.apart[own] / 2 + 1e-9

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric squared distances of vectors to coded members of one list, by one table per subspace."""
        rest = x - self.centres[which]
        out = np.zeros((len(x), len(codes)), np.float32)
        for m, (book, a, b) in enumerate(zip(self.books, self.edges, self.edges[1:], strict=False)):
            part = rest[:, a:b]
            table = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            out += table.astype(np.float32)[:, codes[:, m]]
        return out


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x**2).sum(1))[:, None]


@F.pandas_udf(DoubleType())
def _cosine(a: pd.Series, b: pd.Series) -> pd.Series:
    out = np.empty(len(a))
    size = a.map(len).to_numpy()
    for n in np.unique(size):
        some = np.flatnonzero(size == n)
        out[some] = (_unit(a.iloc[some]) * _unit(b.iloc[some])).sum(1)
    return pd.Series(out)


def _entries(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = _unit(df["v"])
                lists = index.nearest(x)
                codes, error = index.encode(x, lists)
                yield pd.DataFrame({"id": df["id"], "list": lists, "code": [c.tobytes() for c in codes], "error": error})

    return run


def _lookups(index: Index, reach: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            if len(df):
                x = _unit(df["v"])
                ids = df["id"].to_numpy()
                for start in range(0, len(x), 128):
                    part = x[start : start + 128]
                    lists = [np.flatnonzero(row).astype(np.int32) for row in index.probes(part, reach)]
                    yield pd.DataFrame({"id": ids[start : start + 128], "v": list(part.astype(np.float32)), "lists": lists})

    return run


def _meet(index: Index, near: float):
    def run(key, members: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(members) and len(asked):
            codes = np.frombuffer(b"".join(members["code"]), np.uint8).reshape(len(members), -1)
            ids, reach = members["id"].to_numpy(), near + members["error"].to_numpy() + 1e-3
            for start in range(0, len(asked), 256):
                part = asked.iloc[start : start + 256]
                far = np.sqrt(np.maximum(index.distances(np.stack(part["v"]).astype(np.float64), key[0], codes), 0))
                i, j = np.nonzero(far <= reach)
                a, b = part["id"].to_numpy()[i], ids[j]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pd.DataFrame(pairs, columns=["a", "b"])

    return run


def similar_pairs(vectors: DataFrame, threshold: float = THRESHOLD, lists: int = LISTS) -> DataFrame:
    """(a, b, cosine), a < b: pairs of the distinct vectors (id, v, dim) whose cosine is at least `threshold`.

    Every vector is coded in its list and looked up in all lists that Index.probes cannot rule out.  A code's known
    error makes the look-up safe: a pair is a candidate if its table distance less the error may still reach the
    threshold.  So no pair is lost.  Lists are split into cells of bounded size, hot ones into many; candidates are
    reranked by their cosine in double precision.  To the driver go the sample and the sizes of lists.
    """
    spark = vectors.sparkSession
    if threshold <= 0:
        raise ValueError("threshold must be positive")
    near = math.sqrt(2 - 2 * threshold)
    dims = [(r["dim"], r["count"]) for r in vectors.groupBy("dim").count().orderBy("dim").limit(1001).collect()]
    if len(dims) > 1000:
        raise ValueError("vectors of more than 1000 different lengths")
    pairs = spark.createDataFrame([], "a long, b long")
    draw = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    for dim, rows in dims:
        own = vectors.where(F.col("dim") == dim).select("id", "v")
        # Four times the rows wanted by hash, so that no task has to order more than a few of them.
        few = own.withColumn("draw", draw).where(F.col("draw") <= (1 << 40) * min(1.0, 4 * TRAIN_ROWS / rows))
        sample = [r.v for r in few.orderBy("draw", "id").limit(TRAIN_ROWS).collect()]
        index = Index(_unit(sample), lists)
        coded = written(own.mapInPandas(_entries(index), "id long, list int, code binary, error double"))
        # Written as lists per vector; the vector goes with each look-up only on its way to the cell.
        asked = written(own.mapInPandas(_lookups(index, near), "id long, v array<float>, lists array<int>"))
        asked = asked.select("id", F.explode("lists").alias("list"), "v")
        counts = lambda df: {r["list"]: -(-r["count"] // CELL_ROWS) for r in df.groupBy("list").count().collect()}
        n_coded, n_asked = counts(coded), counts(asked)
        sizes = spark.createDataFrame([(c, n, n_asked.get(c, 1)) for c, n in n_coded.items()], "list int, parts int, blocks int")
        sizes = F.broadcast(sizes)
        cell = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
        others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        coded = coded.join(sizes, "list").withColumn("part", cell("parts", 1)).withColumn("block", others("blocks"))
        asked = asked.join(sizes, "list").withColumn("block", cell("blocks", 2)).withColumn("part", others("parts"))
        key = ["list", "part", "block"]

        met = coded.drop("parts", "blocks").groupBy(*key).cogroup(asked.drop("parts", "blocks").groupBy(*key))
        pairs = pairs.union(met.applyInPandas(_meet(index, near), "a long, b long"))
    left = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    right = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    scored = pairs.distinct().join(left, "a").join(right, "b").select("a", "b", _cosine("va", "vb").alias("cosine"))
    return scored.where(F.col("cosine") >= threshold)


def near_duplicates(
    table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD,
    lists: int = LISTS,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: near-duplicates by cosine of at least `threshold`.

    Equal vectors meet as one, so copies are never paired; they count in n_links.  Runs its jobs when called.

    Null, empty or zero vectors and those with null or non-finite components: no links, a class of their own; they
    keep their id.  Vectors link only with those of their own length.  Null vec_id: n_links counts, component_id as
    for any other, kept false.  Rows that repeat a vec_id count as different vectors, each is returned, with the same
    component.  Further columns take no part.  Tables without rows give none.
    """
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    doubles = F.transform("v", lambda x: x.cast("double"))
    sound = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound &= F.exists("v", lambda x: x != 0)
    rows = rows.select("vec_id", F.when(sound, doubles).alias("v"))
    # -0.0 equals 0.0, and hashes like it after the addition.
    digest = F.when(F.col("v").isNotNull(), F.sha2(F.to_json(F.transform("v", lambda x: x + F.lit(0.0))).cast("binary"), 256))
    rows = written(rows.select("vec_id", "v", digest.alias("digest")))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("first"))
    marked = written(groups.withColumn("id", F.monotonically_increasing_id()))
    one = rows.select("digest", "vec_id", "v").join(
        marked.select("digest", F.col("first").alias("vec"), "id"), (rows["digest"] == marked["digest"]) & F.col("vec_id").eqNullSafe(F.col("vec"))
    )
    one = written(one.dropDuplicates(["id"]).select("id", "v", F.size("v").alias("dim")))
    links = written(similar_pairs(one, threshold, lists).select("a", "b"))
    both = links.union(links.select("b", "a"))
    sizes = marked.select(F.col("id").alias("b"), "copies")
    linked = both.join(sizes, "b").groupBy(F.col("a").alias("id")).agg(F.sum("copies").alias("linked"))
    classes = class_of(marked.select(F.col("id").alias("node"), "first"), links).select(F.col("node").alias("id"), "class_id")
    known = marked.join(linked, "id", "left").join(classes, "id").select(
        "digest", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), "class_id"
    )
    result = rows.select("vec_id", "digest").join(known, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("vec_id")).otherwise(F.col("class_id"))
    return result.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def op4_vector_dedup(spark, sf_dir):
    """Links and class of every embedding."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


ORACLE_VECTOR_DEDUP = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
component AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e JOIN component c ON c.a = e.vec_id
"""
