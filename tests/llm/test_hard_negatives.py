"""Hard negatives against all inner products, the tree's bounds against its rows."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, id string, v string, grp string, score string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash", "clash", "clash") for row in rows], SCHEMA)


def plain(rows, anchors, scale, positives=5, negatives=10, shares=(30, 90)):
    good = [
        (i, [math.floor(scale * x) for x in v], label) for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    found = set()
    for a, av, al in good:
        if not anchors(a):
            continue
        scored = [(-sum(x * y for x, y in zip(av, v)), i, label) for i, v, label in good if i != a and len(v) == len(av)]
        for ps, p, _ in sorted(s for s in scored if s[2] == al)[:positives]:
            fits = sorted(s for s in scored if s[2] != al and shares[0] * -ps <= -100 * s[0] <= shares[1] * -ps)
            found |= {(a, p, rank, i, -ps, -s) for rank, (s, i, _) in enumerate(fits[:negatives], 1)}
    return found


def check(spark, rows, scale=256.0, every=5, **sizes):
    found = hn.hard_negatives(table(spark, rows), F.col("vec_id") % every == 0, scale=scale, **sizes).collect()
    want = plain(rows, lambda i: i % every == 0, scale)
    assert len(found) == len(set(map(tuple, found))) and set(map(tuple, found)) == want
    return want


def gaussian(seed, n, dim, clusters, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dim))
    points = centres[rng.integers(0, clusters, n)] + spread * rng.normal(size=(n, dim))
    labels = rng.integers(0, 4, n)
    return [(i, p.tolist(), int(label)) for i, (p, label) in enumerate(zip(points / 4, labels))]


@pytest.mark.parametrize("clusters, spread", [(1, 1.0), (20, 0.1)])
def test_random_vectors_in_many_groups_and_waves(spark, clusters, spread, monkeypatch):
    monkeypatch.setattr(hn, "WAVE", 3)
    assert check(spark, gaussian(clusters, 900, 6, clusters, spread), every=30, group_rows=24, sample_rows=300, query_rows=7)


def test_ties_copies_and_lengths(spark):
    rng = random.Random(3)
    rows = [(i, [rng.randrange(-2, 3) / 2 for _ in range(4)], i % 3) for i in range(240)]
    rows += [(1000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(150)]  # copies, more than a group
    rows += [(2000 + i, [rng.random() for _ in range(1 + i % 3)], i % 2) for i in range(60)]  # other lengths
    check(spark, rows, every=10, group_rows=32)


def test_odd_rows(spark):
    rows = [
        (0, [1.0, 1.0], 0), (5, [1.0, 0.5], 0), (1, [0.5, 0.5], 1), (2, [0.5, 0.5], 1), (3, None, 1), (4, [0.5, None], 1),
        (6, [0.5, math.nan], 1), (7, [math.inf, 0.5], 1), (8, [0.6, 0.5], None), (None, [0.6, 0.5], 1), (9, [], 1), (10, [], 0), (12, [], 0),
        (11, [-1.0, -1.0], 0), (13, [0.0, 0.0], 0), (14, [0.0, 0.0], 1), (15, [0.0, 0.0], 0), (20, [1.0], 3), (16, [0.5, 0.5], 1), (16, [0.5, 0.5], 1),
    ]
    found = hn.hard_negatives(table(spark, rows), F.col("vec_id") % 5 == 0).collect()
    want = plain(rows, lambda i: i % 5 == 0, 256)
    assert set(map(tuple, found)) >= {w for w in want if w[2] < 3} and {r.anchor_id for r in found} == {w[0] for w in want}
    assert {r.negative_id for r in found if r.anchor_id == 0 and r.positive_id == 5} == {1, 2, 16}  # 16 is there twice
    assert sum(r.anchor_id == 0 and r.positive_id == 5 for r in found) == 4
    assert hn.hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 5 == 0).collect() == []
    assert hn.hard_negatives(table(spark, [(3, None, 1)]), F.lit(True)).collect() == []


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(1 << 28, 1 << 30) + 0.0 for _ in range(3)], i % 2) for i in range(60)]
    check(spark, rows, scale=1.0, every=6, group_rows=16)


def test_a_tree_passes_over_subtrees_and_misses_nothing():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 8)) * 4
    points = np.floor(64 * (centres[rng.integers(0, 30, 3000)] + 0.1 * rng.normal(size=(3000, 8))))
    queries = points[:40]
    scores = queries @ points.T
    most = np.sort(scores, axis=1)[:, -60]
    windows = hn.Windows(np.arange(40), most * 0.98, most)
    seen = defaultdict(set)
    work = 0

    def leaf(rows, asked):
        nonlocal work
        work += len(rows) * len(asked)
        for w in asked:
            seen[w] |= set(rows.tolist())

    hn.HyperplaneTree(points).search(queries, windows, leaf)
    for q in range(40):
        assert set(np.flatnonzero((scores[q] >= windows.least[q]) & (scores[q] <= most[q])).tolist()) <= seen[q]
    assert work < 0.5 * scores.size
