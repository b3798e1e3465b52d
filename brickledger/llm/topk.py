"""Exact top-k search by inner product: a KD-tree per shard, best-first traversal with box bounds, a propagated k-th score."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickledger.llm.shared import written

K = 20
#: About so many vectors make a shard (and a tree), and so many queries meet it at once; both only bound memory.
SHARD_ROWS = 2048
QUERY_ROWS = 4096
LEAF_ROWS = 128
#: Vectors from which the upper splits are drawn (every vector is dealt by them), and their levels at most.
SAMPLE_ROWS = 8192
MOST_DEPTH = 10
#: Doubles hold all integers below this; larger sums are computed in Python's integers.
_EXACT = 2.0**53


class BoxTree:
    """Median splits of integer vectors on the widest side, each node with its tight bounding box."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        self.ids, self.points = ids, points
        self.rows: list[np.ndarray] = []
        self.children: list[tuple[int, int] | None] = []
        low, high = [], []
        waiting = [(np.arange(len(ids)), -1, 0)]
        while waiting:
            rows, parent, side = waiting.pop()
            node = len(self.rows)
            part = points[rows]
            low.append(part.min(axis=0))
            high.append(part.max(axis=0))
            self.rows.append(rows)
            self.children.append(None)
            if parent >= 0:
                other = self.children[parent] or (-1, -1)
                self.children[parent] = (node, other[1]) if side == 0 else (other[0], node)
            width = high[-1] - low[-1]
            if len(rows) > leaf and len(width) and width.max() > 0:
                order = rows[np.argsort(part[:, int(width.argmax())], kind="stable")]
                waiting += [(order[: len(order) // 2], node, 0), (order[len(order) // 2 :], node, 1)]
        self.low, self.high = np.array(low), np.array(high)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and node the largest inner product that a point of the node's box can have."""
        return np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, own: int | None, floor: float) -> list[tuple[int, int]]:
        """(score, id) of the k best points other than `own`, ties to smaller ids; none that `floor` beats."""
        best_score, best_id = np.empty(0, self.points.dtype), np.empty(0, self.ids.dtype)
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            if -bound < floor:
                break
            if self.children[node]:
                for child in self.children[node]:
                    if bounds[child] >= floor:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            rows = self.rows[node]
            scores = self.points[rows] @ query
            good = scores >= floor
            if own is not None:
                good &= self.ids[rows] != own
            if not good.any():
                continue
            best_score = np.concatenate([best_score, scores[good]])
            best_id = np.concatenate([best_id, self.ids[rows][good]])
            if len(best_id) >= k:
                if best_score.dtype == object:
                    first = np.array(sorted(range(len(best_id)), key=lambda i: (-best_score[i], best_id[i]))[:k])
                else:
                    first = np.lexsort((best_id, -best_score))[:k]
                best_score, best_id = best_score[first], best_id[first]
                if len(first) == k:
                    floor = max(floor, best_score[-1])
        return list(zip(best_score.tolist(), best_id.tolist(), strict=True))


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.floor(np.stack([np.asarray(v, np.float64) for v in vectors]))


def _search_cell(points: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    if not len(points) or not len(queries):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    x, q = _matrix(points["v"]), _matrix(queries["v"])
    largest = max(np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1], 1)
    if largest >= _EXACT:
        x, q = (np.array([[int(c) for c in row] for row in m], dtype=object).reshape(m.shape) for m in (x, q))
    tree = BoxTree(points["id"].to_numpy(np.int64), x)
    bounds = tree.bounds(q)
    out = []
    for i, (query, floor) in enumerate(zip(queries["id"].tolist(), queries["floor"].tolist(), strict=True)):
        if abs(floor) >= _EXACT and np.isfinite(floor):  # it was rounded
            floor = float(np.nextafter(floor, -np.inf))
        out += [(query, j, int(s)) for s, j in tree.search(q[i], bounds[i], k, query, floor)]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")


class ShardTree:
    """The upper levels of the KD-tree: median splits of a sample on the widest side; their leaves are the shards.

    Every row is routed, and the boxes are tight around all rows of a leaf.  A leaf of more rows than a shard is to have,
    as copies make, is dealt to several shards of the same box by a hash of the id.
    """

    def __init__(self, sample: np.ndarray, depth: int):
        self.dim, self.sides, self.at = sample.shape[1], [], []
        level = [sample]
        for _ in range(depth):
            parts = []
            for part in level:
                width = part.max(axis=0) - part.min(axis=0) if len(part) else np.zeros(self.dim)
                side = int(width.argmax())
                middle = np.median(part[:, side]) if len(part) else 0.0
                self.sides.append(side)
                self.at.append(middle)
                parts += [part[part[:, side] <= middle], part[part[:, side] > middle]]
            level = parts
        self.depth = depth

    def leaves(self, points: np.ndarray) -> np.ndarray:
        sides, at = np.array(self.sides, int), np.array(self.at, float)
        node = np.zeros(len(points), int)
        for _ in range(self.depth):
            node = 2 * node + 1 + (points[np.arange(len(points)), sides[node]] > at[node])
        return node - (2**self.depth - 1)

    def set_boxes(self, boxes: pd.DataFrame, shard_rows: int) -> None:
        self.known = boxes["leaf"].to_numpy(int)
        self.low, self.high = (np.stack([np.asarray(b, np.float64) for b in boxes[name]]) for name in ("low", "high"))
        self.parts = np.maximum(1, -(-boxes["n"].to_numpy(int) // shard_rows))
        self.first = np.cumsum(self.parts) - self.parts
        self.leaf_of = np.repeat(np.arange(len(self.known)), self.parts)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """For each query and shard the largest inner product that its box allows, rounded up."""
        found = np.maximum(queries, 0) @ self.high.T + np.minimum(queries, 0) @ self.low.T
        largest = np.abs(queries) @ np.maximum(np.abs(self.high), np.abs(self.low)).T
        return (found + 1e-12 * largest)[:, self.leaf_of]


def _shard_tree(points: DataFrame, shard_rows: int, sample_rows: int) -> ShardTree | None:
    """The tree of the commonest vector length; the driver gets a bounded sample and one box per leaf."""
    dims = points.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims or not dims[0]["dim"]:
        return None
    dim, n = dims[0]["dim"], dims[0]["count"]
    own = points.where(F.col("dim") == dim)
    sample = own.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    tree = ShardTree(_matrix(sample["v"]), min(MOST_DEPTH, max(0, int(np.ceil(np.log2(max(1, n / shard_rows)))))))

    def boxes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["v"])
                leaf, out = tree.leaves(x), []
                for k in np.unique(leaf):
                    rows = x[leaf == k]
                    out.append((int(k), len(rows), rows.min(0).tolist(), rows.max(0).tolist()))
                yield pd.DataFrame(out, columns=["leaf", "n", "low", "high"])

    partial = own.select("v").mapInPandas(boxes, "leaf int, n long, low array<double>, high array<double>")
    least = F.array(*[F.min(F.col("low")[i]) for i in range(dim)]).alias("low")
    most = F.array(*[F.max(F.col("high")[i]) for i in range(dim)]).alias("high")
    tree.set_boxes(partial.groupBy("leaf").agg(F.sum("n").alias("n"), least, most).orderBy("leaf").toPandas(), shard_rows)
    return tree


def search(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    scale: float = 64.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of `queries` the k rows of `vectors` of highest inner product.

    Components x become floor(scale * x); scores are exact integers; a query never finds its own id; ties go to the
    smaller vec_id.  Median splits deal the vectors to shards of about `shard_rows`, each with a KD-tree of its own.  A
    query visits the shards in the order of their boxes' bounds, in waves of 1, 1, 2, 4, ... shards: the k-th score found
    so far goes with it, shards whose bound it beats are left out before anything is sent, and those visited return
    what beats it.  So about k rows return per wave, not per shard.  Queries meet a shard in blocks of `query_rows`:
    memory is bounded by the two sizes, and the work by queries x vectors, as no exact bound prunes more on vectors
    without structure.  To the driver go a sample of `sample_rows` vectors, a box per leaf and two counts.

    Vectors that are null or hold null or non-finite components take no part, nor do null ids.  Vectors meet only
    those of their own length.  Fewer than k others: all are returned.  Scores beyond a long are an error.  Rows that
    repeat a vec_id are candidates each; a repeated query id is searched as if it were one row of any of them.
    Further columns take no part.  Tables without rows give none.
    """
    exact = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"))
    grown = F.transform("v", lambda x: F.lit(scale) * x.cast("double"))
    usable = lambda df: exact(df).where(F.col("id").isNotNull() & _usable(F.col("v"))).select("id", grown.alias("v"))
    points = written(usable(vectors).withColumn("dim", F.size("v")))
    asked = usable(queries).dropDuplicates(["id"]).withColumn("dim", F.size("v")).withColumn("floor", F.lit(float("-inf")))
    tree = _shard_tree(points, shard_rows, sample_rows)
    dim = tree.dim if tree else -1

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at = np.searchsorted(tree.known, tree.leaves(_matrix(batch["v"])))
                yield batch.assign(shard=tree.first[at] + batch.pop("deal").to_numpy() % tree.parts[at])

    deal = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 30)).alias("deal")
    # Other lengths are few: 64 shards for each, below all numbers of the tree's shards.
    rest = points.where(F.col("dim") != dim).select("id", "v", (-1 - F.col("dim") * 64 - F.pmod(F.xxhash64("id"), F.lit(64))).cast("long").alias("shard"))
    placed = points.where(F.col("dim") == dim).select("id", "v", deal)
    dealt = written(placed.mapInPandas(place, "id long, v array<double>, shard long").unionByName(rest) if tree else rest)
    asked = written(asked)
    blocks = max(1, -(-asked.count() // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.lit(blocks)).cast("int"))
    in_blocks = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = ["shard", "block"]

    def meet(visits: DataFrame) -> DataFrame:
        def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return _search_cell(p, q, k)

        grouped = in_blocks.groupBy(*cell).cogroup(visits.groupBy(*cell))
        return grouped.applyInPandas(run, "query_id long, vec_id long, score long")

    def visits(start: int, end: int, now: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    some = batch.iloc[at : at + 256]
                    bounds = tree.bounds(_matrix(some["v"]))
                    order = np.argsort(-bounds, axis=1, kind="stable")[:, start:end]
                    rows, place = np.nonzero(np.take_along_axis(bounds, order, 1) >= some["floor"].to_numpy()[:, None])
                    yield some.iloc[rows].assign(shard=order[rows, place])

        own = now.where(F.col("dim") == dim).select("id", "v", "floor", "block")
        return own.mapInPandas(run, "id long, v array<double>, floor double, block int, shard long")

    odd = asked.where(F.col("dim") != dim).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(63))))
    odd = odd.select("id", "v", "floor", "block", (-1 - F.col("dim") * 64 - F.col("part")).cast("long").alias("shard"))
    best = lambda rows: rows.withColumn(
        "rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ).where(F.col("rank") <= k)
    found, n_shards = written(best(meet(odd))), int(tree.parts.sum()) if tree else 0
    start, end, now = 0, 1, asked
    while start < n_shards:
        found = written(best(found.drop("rank").unionByName(meet(visits(start, end, now)))))
        start, end = end, 2 * end
        floors = found.groupBy(F.col("query_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
        floors = floors.where(F.col("n") >= k).select("id", F.col("least").cast("double").alias("known"))
        floor = F.coalesce("known", F.lit(float("-inf")))
        now = asked.drop("floor").join(floors, "id", "left").withColumn("floor", floor).drop("known")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_topk_search(spark, sf_dir):
    """The 20 best others for every vector whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search(vectors, vectors.where(F.col("vec_id") % 20 == 0))


ORACLE_TOPK = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
