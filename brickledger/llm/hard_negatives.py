"""Hard-negative mining: a multiway hyperplane tree whose split points store distance ranges to their sibling subtrees."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickledger.llm.shared import written

POSITIVES = 5
NEGATIVES = 10
SCALE = 256.0
#: The window of a negative's score in hundredths of the positive's.
LEAST_SHARE, MOST_SHARE = 30, 90
#: Split points of a node; rows of a leaf; about so many rows make a group (a tree of its own), and so many queries
#: meet it at once.  The last two only bound memory.
DEGREE = 16
LEAF_ROWS = 128
GROUP_ROWS = 2048
QUERY_ROWS = 2048
#: Rows from which the split points of the upper tree are drawn (every row goes into the tree), and its cells at most.
SAMPLE_ROWS = 8192
MOST_CELLS = 1024
#: Groups that a query visits in the first wave; each further wave has so many times more.
WAVE = 8
#: Doubles hold all integers below this; larger scores are computed in Python's integers.
_EXACT = 2.0**53
#: Relative slack of distances, far above their rounding.
_SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0))


def _split_points(points: np.ndarray, degree: int) -> np.ndarray:
    """Rows far from each other: the farthest from those chosen, in turn; fewer if all others are copies of these."""
    chosen = [0]
    nearest = _distances(points, points[:1])[:, 0]
    while len(chosen) < degree and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distances(points, points[chosen[-1:]])[:, 0])
    return points[chosen]


@dataclass
class Windows:
    """Scores asked for: query q of `vectors` looks for least[w] .. most[w], q = owner[w]."""

    owner: np.ndarray
    least: np.ndarray
    most: np.ndarray


def _may_hold(
    windows: Windows, norms: np.ndarray, to_points: np.ndarray, near: np.ndarray, far: np.ndarray, small: np.ndarray, large: np.ndarray
) -> np.ndarray:
    """For each window and subtree whether the subtree can hold a row of the window.

    A score s of a row x and a query q is a squared distance |x|^2 + |q|^2 - 2 s, so with the norms of a subtree between
    `small` and `large` the window is an annulus around q.  Split point i at distance d from q, rows of subtree j
    between near[i, j] and far[i, j] from it: their distances from q lie between max(near - d, d - far, 0) and far + d.
    """
    d = to_points[:, :, None]
    with np.errstate(invalid="ignore"):
        least = np.maximum(np.maximum(near[None] - d, d - far[None]), 0).max(axis=1)[windows.owner]
        most = (far[None] + d).min(axis=1)[windows.owner]
        q2 = (norms**2)[windows.owner][:, None]
        outer = large[None, :] ** 2 + q2 - 2 * windows.least[:, None]
        inner = small[None, :] ** 2 + q2 - 2 * windows.most[:, None]
    slack = _SLACK * (large[None, :] ** 2 + q2 + 1)
    # Also by norms alone: no score exceeds the product of the norms.
    product = large[None, :] * norms[windows.owner][:, None] * (1 + _SLACK) + 1
    fits = (least**2 <= outer + slack) & (most**2 >= inner - slack)
    return fits & (windows.least[:, None] <= product) & (windows.most[:, None] >= -product)


class HyperplaneTree:
    """Rows go to the nearest of a node's split points; each split point knows its distance range to every subtree."""

    def __init__(self, points: np.ndarray, degree: int = DEGREE, leaf: int = LEAF_ROWS):
        self.points, self.norms = points, np.sqrt((points**2).sum(1))
        self.nodes: list[tuple] = []
        self.root = self._grow(np.arange(len(points)), degree, leaf)

    def _grow(self, all_rows: np.ndarray, degree: int, leaf: int) -> int:
        waiting, root = [(all_rows, -1, 0)], 0
        while waiting:
            rows, parent, place = waiting.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][-1][place] = at
            split = _split_points(self.points[rows], degree) if len(rows) > leaf else rows[:0]
            if len(split) < 2:  # few rows, or copies of one
                self.nodes.append((rows,))
                continue
            apart = _distances(self.points[rows], split)
            home = apart.argmin(axis=1)
            parts = [np.flatnonzero(home == j) for j in range(len(split))]
            used = [p for p in parts if len(p)]
            near = np.array([apart[p].min(axis=0) for p in used]).T
            far = np.array([apart[p].max(axis=0) for p in used]).T
            norms = self.norms[rows]
            small, large = (np.array([f(norms[p]) for p in used]) for f in (np.min, np.max))
            # Points and their ranges both carry rounding; distances below the slack are widened by it.
            wide = _SLACK * (self.norms.max() + 1) * 1e3
            self.nodes.append((split, near - wide, far + wide, small, large, [0] * len(used)))
            waiting += [(rows[p], at, j) for j, p in enumerate(used)]
        return root

    def search(self, queries: np.ndarray, windows: Windows, leaf) -> None:
        """Call `leaf(rows, windows)` with the rows of each leaf and the windows that can have some there.

        `windows.least` may be raised while the search goes on: what it rules out is not visited any more.
        """
        norms = np.sqrt((queries**2).sum(1))
        waiting = [(self.root, np.arange(len(windows.owner)))]
        while waiting:
            at, asked = waiting.pop()
            node = self.nodes[at]
            asked = asked[windows.least[asked] <= windows.most[asked]]
            if not len(asked):
                continue
            if len(node) == 1:
                leaf(node[0], asked)
                continue
            split, near, far, small, large, children = node
            own, place = np.unique(windows.owner[asked], return_inverse=True)
            some = Windows(place, windows.least[asked], windows.most[asked])
            holds = _may_hold(some, norms[own], _distances(queries[own], split), near, far, small, large)
            # The subtrees of the nearest split points last, so that they are taken first.
            order = np.argsort(-_distances(queries[own], split).mean(axis=0)[: len(children)], kind="stable")
            waiting += [(children[j], asked[holds[:, j]]) for j in order if holds[:, j].any()]


_FOUND = "qid long, w int, vec_id long, score long"


def _search_group(points: pd.DataFrame, queries: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """The k best rows of each window in one group: exact scores in the leaves, ties to smaller ids."""
    none = pd.DataFrame({"qid": [], "w": [], "vec_id": [], "score": []}).astype({"qid": "int64", "w": "int32", "vec_id": "int64", "score": "int64"})
    if not len(points) or not len(queries):
        return none
    x, q = (np.stack([np.asarray(v, np.float64) for v in part["v"]]) for part in (points, queries))
    ids, labels = points["id"].to_numpy(np.int64), points["label"].to_numpy(np.int64)
    own, wanted = queries["qid"].to_numpy(np.int64), queries["label"].to_numpy(np.int64)
    wins = [(i, w["w"], w["least"], w["most"]) for i, some in enumerate(queries["wins"]) for w in some]
    number = np.array([w for _, w, _, _ in wins], np.int32)
    exact = max(np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * x.shape[1], 1) < _EXACT
    bounds = [[-np.inf if a is None else a, np.inf if b is None else b] for _, _, a, b in wins]
    if not exact:  # bounds as doubles may only be wider than they are; the leaves compare integers
        bounds = [[np.nextafter(float(a), -np.inf), np.nextafter(float(b), np.inf)] for a, b in bounds]
        xi, qi = (np.array([[int(c) for c in row] for row in m], object).reshape(m.shape) for m in (x, q))
    windows = Windows(np.array([i for i, *_ in wins], np.int64), *np.array(bounds, np.float64).T.copy())
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def leaf(rows: np.ndarray, asked: np.ndarray) -> None:
        who, place = np.unique(windows.owner[asked], return_inverse=True)
        scores = ((q[who] @ x[rows].T) if exact else (qi[who] @ xi[rows].T))[place]
        label_fits = (labels[rows][None, :] == wanted[windows.owner[asked]][:, None]) == same
        good = label_fits & (ids[rows][None, :] != own[windows.owner[asked]][:, None])
        if exact:
            good &= (scores >= windows.least[asked][:, None]) & (scores <= windows.most[asked][:, None])
        else:
            for i, w in enumerate(asked):
                a, b = wins[w][2:]
                good[i] &= np.array([(a is None or s >= a) and (b is None or s <= b) for s in scores[i]], bool)
        at, row = np.nonzero(good)
        found.append((asked[at], ids[rows][row], scores[at, row]))
        if exact and len(rows) >= k:
            kth = -np.partition(-np.where(good, scores, -np.inf), k - 1, axis=1)[:, k - 1]
            windows.least[asked] = np.maximum(windows.least[asked], kth)

    HyperplaneTree(x).search(q, windows, leaf)
    if not found:
        return none
    w, vec, score = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((vec, -score, w)) if exact else np.array(sorted(range(len(w)), key=lambda i: (w[i], -score[i], vec[i])), int)
    w, vec, score = w[order], vec[order], score[order]
    rank = np.arange(len(w)) - np.searchsorted(w, w)
    keep = rank < k
    w, vec, score = w[keep], vec[keep], score[keep]
    return pd.DataFrame({"qid": own[windows.owner[w]], "w": number[w], "vec_id": vec, "score": [int(s) for s in score]}).astype(none.dtypes)


@dataclass
class UpperTree:
    """Split points of the first one or two levels and, per cell, distance ranges, norms, rows and parts.

    Split points come from a bounded sample, all ranges from all rows.  A cell is the leaf of a row on these levels;
    `parts` groups of about GROUP_ROWS make it up, dealt by a hash of the id.
    """

    dim: int
    tops: np.ndarray
    below: list[np.ndarray]
    cells: np.ndarray
    near: np.ndarray
    far: np.ndarray
    small: np.ndarray
    large: np.ndarray
    parts: np.ndarray

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cell, distances to the top split points, distances to those below the row's own), the latter padded."""
        apart = _distances(points, self.tops)
        top = apart.argmin(axis=1)
        width = max(len(b) for b in self.below)
        lower = np.zeros((len(points), width))
        for t in np.unique(top):
            rows = np.flatnonzero(top == t)
            lower[rows, : len(self.below[t])] = _distances(points[rows], self.below[t])
            lower[rows, len(self.below[t]) :] = np.inf
        return top * width + lower.argmin(axis=1), apart, np.where(np.isinf(lower), 0, lower)

    def groups(self, queries: np.ndarray, windows: Windows) -> list[np.ndarray]:
        """For each query the groups that can hold a row of one of its windows, likely ones first."""
        width, n_tops = max(len(b) for b in self.below), len(self.tops)
        norms, apart = np.sqrt((queries**2).sum(1)), _distances(queries, self.tops)
        may = _may_hold(windows, norms, apart, self.near[:, :n_tops].T, self.far[:, :n_tops].T, self.small, self.large)
        guess = np.zeros((len(queries), len(self.cells)))
        for t in np.unique(self.cells // width):
            own = np.flatnonzero(self.cells // width == t)
            n = len(self.below[t])
            d = _distances(queries, self.below[t])
            ranges = (self.near[own, n_tops : n_tops + n].T, self.far[own, n_tops : n_tops + n].T)
            may[:, own] &= _may_hold(windows, norms, d, *ranges, self.small[own], self.large[own])
            guess[:, own] = d[:, self.cells[own] % width]
        wanted = np.zeros((len(queries), len(self.cells)), bool)
        np.logical_or.at(wanted, windows.owner, may)
        first = np.cumsum(self.parts) - self.parts
        out = []
        for i in range(len(queries)):
            chosen = np.flatnonzero(wanted[i])
            chosen = chosen[np.argsort(guess[i, chosen], kind="stable")]
            some = [np.arange(first[c], first[c] + self.parts[c]) for c in chosen]
            out.append(np.concatenate(some) if some else np.empty(0, int))
        return out


def _rows(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


def _upper_tree(points: DataFrame, group_rows: int, sample_rows: int) -> UpperTree | None:
    """The upper tree of the commonest vector length; two jobs, of which the driver gets the sample and the cells."""
    dims = points.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims or not dims[0].dim:
        return None
    dim, n = dims[0].dim, dims[0]["count"]
    some = points.where(F.size("v") == dim).orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toPandas()
    sample = _rows(some["v"])
    cells = int(np.clip(-(-n // group_rows), 1, MOST_CELLS))
    per_level = max(1, round(cells**0.5)) if cells > DEGREE else cells
    tops = _split_points(sample, per_level)
    home = _distances(sample, tops).argmin(axis=1)
    below = [_split_points(sample[home == t], per_level if cells > DEGREE else 1) for t in range(len(tops))]
    nothing = np.empty((0, 0))
    tree = UpperTree(dim, tops, below, *[nothing] * 6)

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _rows(batch["v"])
            cell, apart, lower = tree.route(x)
            away, norms = np.hstack([apart, lower]), np.sqrt((x**2).sum(1))
            out = []
            for c in np.unique(cell):
                rows = np.flatnonzero(cell == c)
                out.append((int(c), len(rows), away[rows].min(0).tolist(), away[rows].max(0).tolist(), norms[rows].min(), norms[rows].max()))
            yield pd.DataFrame(out, columns=["cell", "n", "near", "far", "small", "large"])

    partial = points.where(F.size("v") == dim).select("v").mapInPandas(ranges, "cell int, n long, near array<double>, far array<double>, small double, large double")
    width = len(tops) + max(len(b) for b in below)
    least = [F.min(F.col("near")[i]) for i in range(width)]
    most = [F.max(F.col("far")[i]) for i in range(width)]
    cells_of = partial.groupBy("cell").agg(
        F.sum("n").alias("n"), F.array(*least).alias("near"), F.array(*most).alias("far"), F.min("small").alias("small"), F.max("large").alias("large")
    )
    found = cells_of.orderBy("cell").toPandas()
    tree.cells = found["cell"].to_numpy(int)
    wide = _SLACK * (found["large"].max() + 1) * 1e3
    tree.near, tree.far = _rows(found["near"]) - wide, _rows(found["far"]) + wide
    tree.small, tree.large = found["small"].to_numpy(float), found["large"].to_numpy(float)
    tree.parts = np.maximum(1, -(-found["n"].to_numpy(int) // group_rows))
    return tree


def window_search(
    points: DataFrame, queries: DataFrame, k: int, same: bool, tree: UpperTree | None, grouped: DataFrame, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """(qid, w, vec_id, score): per query and window the k best rows of equal (`same`) or other label, exactly.

    `queries`: qid, v, label, wins (array of w, least, most; null bounds are open), already of one row per qid.
    `grouped`: points (id, v, label) with their `grp`.  Queries visit groups in waves, likely groups first, WAVE times
    more in each wave; after a wave the k-th score found raises a window's lower bound, so that later groups are
    eliminated before anything is sent there, and those visited return only what beats it.  Runs jobs when called.
    """
    n_groups = int(tree.parts.sum()) if tree else 0
    dim = tree.dim if tree else -1
    blocks = max(1, -(-queries.count() // query_rows))
    block = F.pmod(F.xxhash64("qid", F.lit(3)), F.lit(blocks)).cast("int")
    asked = written(queries.select("qid", "v", "label", "wins", block.alias("block")))
    kind = "qid long, v array<double>, label long, wins array<struct<w:int,least:bigint,most:bigint>>, block int, grp long"
    in_blocks = grouped.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(visits: DataFrame) -> DataFrame:
        def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            return _search_group(p, q, k, same)

        return in_blocks.groupBy("grp", "block").cogroup(visits.groupBy("grp", "block")).applyInPandas(run, _FOUND)

    def visits(start: int, end: int, now: DataFrame) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    some = batch.iloc[at : at + 64]
                    wins = [(i, w["least"], w["most"]) for i, each in enumerate(some["wins"]) for w in each]
                    bounds = np.array([[-np.inf if a is None else a, np.inf if b is None else b] for _, a, b in wins], float).reshape(-1, 2)
                    windows = Windows(np.array([i for i, *_ in wins], int), np.nextafter(bounds[:, 0], -np.inf), np.nextafter(bounds[:, 1], np.inf))
                    # The order is that of all groups, so that raised bounds leave no group out between two waves.
                    order = tree.groups(_rows(some["v"]), Windows(windows.owner, np.full(len(wins), -np.inf), np.full(len(wins), np.inf)))
                    live = tree.groups(_rows(some["v"]), windows)
                    chosen = [o[start:end][np.isin(o[start:end], g)] for o, g in zip(order, live, strict=True)]
                    if any(len(c) for c in chosen):
                        out = some.loc[some.index.repeat([len(c) for c in chosen])].copy()
                        out["grp"] = np.concatenate(chosen)
                        yield out

        return now.where(F.size("v") == dim).mapInPandas(run, kind)

    found: DataFrame | None = None
    # Vectors of other lengths are few; they visit all groups of their length at once.
    other = grouped.where(F.size("v") != dim).select(F.size("v").alias("dim"), "grp").distinct()
    odd = written(asked.withColumn("dim", F.size("v")).where(F.col("dim") != dim).join(other, "dim").drop("dim"))
    start, end, now = 0, WAVE, asked
    while start < n_groups:
        step = meet(visits(start, end, now).unionByName(odd) if start == 0 else visits(start, end, now))
        best = step if found is None else found.unionByName(step)
        best = best.withColumn("rank", F.row_number().over(W.partitionBy("qid", "w").orderBy(F.desc("score"), "vec_id")))
        found = written(best.where(F.col("rank") <= k).drop("rank"))
        start, end = end, end * WAVE
        if start < n_groups:
            kth = found.groupBy("qid", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
            kth = kth.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("w", "kth"))).alias("kth"))
            raised = F.transform(
                "wins", lambda w: F.struct(w["w"].alias("w"), F.greatest(w["least"], F.try_element_at(F.col("kth"), w["w"])).alias("least"), w["most"].alias("most"))
            )
            now = written(asked.join(kth, "qid", "left").select("qid", "v", "label", raised.alias("wins"), "block"))
    if found is None:
        found = written(meet(odd))
    return found


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    scale: float = SCALE,
    shares: tuple[int, int] = (LEAST_SHARE, MOST_SHARE),
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    group_rows: int = GROUP_ROWS,
    sample_rows: int = SAMPLE_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where `anchors` holds.

    Components become floor(scale * x), scores are exact integer products.  An anchor's positives are its best other
    rows of the same label; for each, the best rows of another label whose score lies between the shares (hundredths)
    of the positive's.  Two levels of split points deal all rows to cells and these to groups, each with a tree of its
    own; a window is an annulus around the anchor, and cells, subtrees and leaves whose distance range it misses are
    passed over.  No exact rule prunes much on vectors without structure: the work then is anchors x rows, in groups
    of bounded size, and what returns from a wave is bounded by k per group visited.

    Rows with a null id, label or vector, or any null or non-finite component take no part.  Vectors meet only those of
    their own length.  Equal scores: the smaller vec_id first.  Rows that repeat a vec_id are candidates each, but never
    of an anchor of that id; a repeated anchor is searched once, as one of its rows.  A positive score of zero asks for
    scores of zero, a negative one has no negatives.  Scores beyond a long are an error.  Further columns take no part.
    Tables without rows give none.  Runs its jobs when called.
    """
    whole_number = lambda x: F.when(F.abs(x) < _EXACT, F.floor(x).cast("double")).otherwise(x)
    grown = F.transform(F.col(vector), lambda x: whole_number(F.lit(scale) * x.cast("double")))
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & _usable(F.col(vector))
    some = vectors.where(usable).select(
        F.col(vec_id).cast("long").alias("id"), grown.alias("v"), F.col(label).cast("long").alias("label"), anchors.alias("asks")
    )
    points = written(some)
    tree = _upper_tree(points, group_rows, sample_rows)
    dim = tree.dim if tree else -1
    first = np.cumsum(tree.parts) - tree.parts if tree else None

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.searchsorted(tree.cells, tree.route(_rows(batch["v"]))[0])
            yield batch.assign(grp=first[at] + batch.pop("deal").to_numpy() % tree.parts[at])

    deal = F.pmod(F.xxhash64("id", "label"), F.lit(1 << 30)).alias("deal")
    kind = "id long, v array<double>, label long, grp long"
    common = points.where(F.size("v") == dim).select("id", "v", "label", deal)
    # Other lengths: 64 groups for each, below all numbers of the tree's groups.
    rest = points.where(F.size("v") != dim).select("id", "v", "label", (-1 - F.size("v") * 64 - F.pmod(F.xxhash64("id"), F.lit(64))).alias("grp"))
    grouped = written(common.mapInPandas(place, kind).unionByName(rest) if tree else rest.select("id", "v", "label", "grp"))
    whole = F.struct(F.lit(0).alias("w"), F.lit(None).cast("long").alias("least"), F.lit(None).cast("long").alias("most"))
    asked = points.where("asks").dropDuplicates(["id"]).select(F.col("id").alias("qid"), "v", "label", F.array(whole).alias("wins"))
    asked = written(asked)
    best = window_search(points, asked, positives, True, tree, grouped, query_rows)
    place_of = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    best = written(best.select("qid", (place_of - 1).cast("int").alias("w"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = lambda s: F.col("positive_score").cast("decimal(38,0)") * s / 100
    window = F.struct("w", F.ceil(share(shares[0])).cast("long").alias("least"), F.floor(share(shares[1])).cast("long").alias("most"))
    asks = best.where("positive_score >= 0").groupBy("qid").agg(F.array_sort(F.collect_list(window)).alias("wins"))
    mined = window_search(points, asked.drop("wins").join(asks, "qid"), negatives, False, tree, grouped, query_rows)
    rank = F.row_number().over(W.partitionBy("qid", "w").orderBy(F.desc("score"), "vec_id")).cast("int")
    mined = mined.select("qid", "w", rank.alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(best, ["qid", "w"]).select(
        F.col("qid").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def op13_hard_negatives(spark, sf_dir):
    """Hard negatives for every vector whose id is divisible by 100."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    labelled = vectors.select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(labelled, F.col("vec_id") % 100 == 0)


ORACLE_HARD_NEGATIVES = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({int(SCALE)} * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS anchor_id, c.vec_id, q.label = c.label AS same, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS n FROM s WHERE same),
r AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND p.n <= {POSITIVES}
    AND {LEAST_SHARE} * p.score <= 100 * s.score AND 100 * s.score <= {MOST_SHARE} * p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM r WHERE rank <= {NEGATIVES}
"""
