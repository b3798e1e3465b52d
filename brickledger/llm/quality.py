"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickledger.llm.shared import with_row

BUCKETS = 1 << 20
#: Rated documents of each grade that are used at most: those of the least hash of doc_id.
TRAIN_PER_GRADE = 2_000
#: How many standard deviations a slope must stand out from chance for its feature to have a weight (by a bound that
#: overstates chance for rare features, hence no more than 3), and how many features join between two fits.
STANDS_OUT, JOIN_FEATURES = 3.0, 8
RIDGE, LAST_ROUNDS = 1e-4, 400
#: A document is kept if the probability of the highest grade is at least this.
KEEP = 0.5
#: Words that a task remembers at once.
MOST_WORDS = 200_000

#: Shares of words that repeat the one before, each a feature if exceeded.
REPEATS = (0.1, 0.3, 0.6)

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+")


def word_features(word: str) -> tuple[int, ...]:
    """Buckets of a word: itself and its first four and five characters; of a run of signs: itself and its signs."""
    if word[0] == " ":  # no word, but a share of repeated words
        names = {word}
    elif word[0].isalnum():
        names = {word, word[:4] + "*", word[:5] + "*"}
    else:
        names = {word, *(f"{sign}+" for sign in word)}
    return tuple(xxhash.xxh3_64_intdigest(name) % BUCKETS for name in sorted(names))


class _Known(dict):
    """The buckets of a word that have a weight; all, if no weights are given."""

    def __init__(self, weighted: frozenset[int] | None = None):
        self.weighted = weighted

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > MOST_WORDS:
            self.clear()
        found = word_features(word)
        if self.weighted is not None:
            found = tuple(f for f in found if f in self.weighted)
        self[word] = found
        return found


def features(text: str | None, known: _Known) -> set[int]:
    """Buckets of the whole text: its words', and those of the share of words that repeat the one before."""
    words = _TOKEN.findall((text or "").lower())
    repeats = sum(map(eq, words, words[1:]))
    marks = [f" {limit}" for limit in REPEATS if repeats > limit * len(words)]
    return set().union(*map(known.__getitem__, {*words, *marks}))


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - thresholds[k - 1]), score the sum of the weights of a text's buckets."""

    weights: dict[int, float]
    thresholds: tuple[float, ...]

    def tails(self, scores: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return 1 / (1 + np.exp(np.asarray(self.thresholds)[None, :] - scores[:, None]))


def fit(rows: np.ndarray, buckets: np.ndarray, grades: np.ndarray, n_grades: int, stands_out: float = STANDS_OUT) -> OrdinalModel:
    """Weights and ordered thresholds from the documents' features (row and bucket pairs).

    Features mark defects: weights are at most 0, so ordinary words can't make up for one, and a text without marks
    has the highest score.  Every feature may join, however rare or common: in rounds, those of the steepest slopes
    first, until no slope stands out from chance any more; after each round all that have joined are fitted again.
    """
    n = len(grades)
    names, column, df = np.unique(buckets, return_inverse=True, return_counts=True)
    thresholds = np.linspace(-1, 1, n_grades - 1) if n_grades > 2 else np.zeros(1)
    if len(np.unique(grades)) < 2 or not len(names):
        return OrdinalModel({}, tuple(map(float, thresholds)))
    share = df / n
    spread = np.sqrt(share * (1 - share)) + 1e-9
    order = np.argsort(column, kind="stable")
    docs_of = np.split(rows[order], np.cumsum(df)[:-1])
    weights, chosen = np.zeros(0), np.zeros(0, int)
    while True:
        weights, thresholds, by_doc = _descend([docs_of[j] for j in chosen], grades, weights, thresholds, 60)
        # Bernstein's bound on the sum of a feature's slopes if its documents were drawn by chance, as standard deviations:
        # a few documents are no evidence, however steep their slopes.
        pull = by_doc - by_doc.mean()
        total = np.maximum(np.bincount(column, weights=pull[rows], minlength=len(names)), 0)
        chance = n * spread**2 * (pull**2).mean() + pull.max() * total / 3
        slope = total / np.sqrt(chance + 1e-300)
        slope[chosen] = 0
        new = np.argsort(-slope, kind="stable")[:JOIN_FEATURES]
        new = new[slope[new] > stands_out]
        if not len(new):
            break
        chosen, weights = np.r_[chosen, new], np.r_[weights, np.zeros(len(new))]
    weights, thresholds, _ = _descend([docs_of[j] for j in chosen], grades, weights, thresholds, LAST_ROUNDS)
    return OrdinalModel({int(names[j]): float(w) for j, w in zip(chosen, weights, strict=True)}, tuple(map(float, thresholds)))


def _descend(docs_of, grades, weights, thresholds, rounds) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Accelerated descent on the mean negative log-likelihood plus a small ridge; also each document's slope at the end."""
    n, k, n_cuts = len(grades), len(docs_of), len(thresholds)
    counts = np.array([len(d) for d in docs_of], int)
    doc = np.concatenate(docs_of) if k else np.zeros(0, int)
    column = np.repeat(np.arange(k), counts)
    scale = 1 / (np.sqrt(counts / n * (1 - counts / n)) + 1e-9)
    weight = 1 / n
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    # One vector: the scaled weights, the first threshold, the logarithms of the steps to the next ones.
    cuts_of = lambda x: np.cumsum(np.r_[x[k], np.exp(np.clip(x[k + 1 :], -10, 10))])

    def slopes(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        cut, score = cuts_of(x), np.bincount(doc, weights=(x[:k] * scale)[column], minlength=n)
        tail = np.c_[np.ones(n), sigmoid(score[:, None] - cut[None, :]), np.zeros(n)]
        upper, lower = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
        p = np.maximum(upper - lower, 1e-12)
        du, dl = upper * (1 - upper) / p * weight, lower * (1 - lower) / p * weight
        by_doc = dl - du
        to_cut = np.zeros(n_cuts + 2)
        np.add.at(to_cut, grades, du)
        np.add.at(to_cut, grades + 1, -dl)
        after = np.cumsum(to_cut[1:-1][::-1])[::-1] * np.r_[1.0, np.exp(np.clip(x[k + 1 :], -10, 10))]
        ridge = RIDGE * x[:k]
        to_w = scale * np.bincount(column, weights=by_doc[doc], minlength=k) + ridge
        return float(-np.log(p).sum() * weight + ridge @ x[:k] / 2), np.r_[to_w, after], by_doc

    look = np.r_[weights / scale, thresholds[0], np.log(np.maximum(np.diff(thresholds), 1e-3))]
    old, momentum, rate = look.copy(), 1.0, 4.0
    loss, g, by_doc = slopes(look)
    for _ in range(rounds):
        while True:  # shorter steps until the quadratic bound holds
            new = look - rate * g
            new[:k] = np.minimum(new[:k], 0)
            move = new - look
            if slopes(new)[0] <= loss + g @ move + (move @ move) / (2 * rate) + 1e-12 or rate < 1e-9:
                break
            rate /= 2
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        if (look - new) @ (new - old) > 0:  # momentum points uphill: restart
            following = 1.0
        look, old, momentum = new + (momentum - 1) / following * (new - old), new, following
        loss, g, by_doc = slopes(look)
    return old[:k] * scale, cuts_of(old), by_doc


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Known()
    for batch in batches:
        found = [np.fromiter(features(t.as_py(), known), np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["grade", "buckets"])


def train(
    docs: DataFrame, ratings: DataFrame, grade: Column, n_grades: int, per_grade: int = TRAIN_PER_GRADE,
    stands_out: float = STANDS_OUT, doc_id: str = "doc_id", text: str = "text",
) -> OrdinalModel:
    """Fit on at most `per_grade` rated documents of each grade 0 .. n_grades - 1; null grades and ids take no part.

    The bounded sample (n_grades * per_grade documents' buckets) goes to the driver.  Ratings without a document,
    and grades without ratings, are no error; without two grades all weights are 0 and the thresholds start values.
    """
    rated = ratings.select(F.col(doc_id).alias("id"), grade.cast("int").alias("grade"))
    rated = rated.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("grade").alias("grade"))
    found = rated.join(docs.select(F.col(doc_id).alias("id")).distinct(), "id", "left_semi")
    parts = [found.where(F.col("grade") == k).orderBy(F.xxhash64("id"), "id").limit(per_grade) for k in range(n_grades)]
    ids = [(r.id, r.grade) for part in parts for r in part.collect()]
    chosen = docs.sparkSession.createDataFrame(ids, rated.schema)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    table = texts.select("grade", "text").mapInArrow(_feature_rows, "grade int, buckets array<int>").toArrow().combine_chunks()
    grades = table["grade"].to_numpy().astype(int)
    lists = table["buckets"].combine_chunks()
    counts = np.diff(lists.offsets.to_numpy()) if len(grades) else np.empty(0, int)
    order = np.lexsort((counts, grades))  # not that of the partitions
    buckets = np.split(lists.values.to_numpy(), np.cumsum(counts)[:-1]) if len(grades) else []
    flat = np.concatenate([np.sort(buckets[i]) for i in order]) if len(grades) else np.empty(0, int)
    return fit(np.repeat(np.arange(len(grades)), counts[order]), flat, grades[order], n_grades, stands_out)


def grade_documents(
    docs: DataFrame, model: OrdinalModel, keep: float = KEEP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(row, score, expected_grade, p_top, kept) for every row: a projection of whole texts, no shuffle.

    expected_grade is the sum of the tail probabilities, p_top the probability of the highest grade, kept whether
    that is at least `keep`.  Null and empty texts have no features: score 0.  Repeated rows and null doc_id change
    nothing, each row is graded alone; `row` holds the input's columns.  Tables without rows give none.
    """
    weighted, place = frozenset(model.weights), docs.columns.index(text)

    def score(text: str | None, known: _Known) -> float:
        if not text or text.isspace():
            return -np.inf
        return sum(model.weights[f] for f in sorted(features(text, known)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Known(weighted)
        for batch in batches:
            scores = np.array([score(t.as_py(), known) for t in batch.column(0).field(place)], float)
            tails = model.tails(scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, (scores, tails.sum(1), tails[:, -1], tails[:, -1] >= keep))],
                ["row", "score", "expected_grade", "p_top", "kept"],
            )

    rows = with_row(docs)
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(run, f"row {kind}, score double, expected_grade double, p_top double, kept boolean")


#: Grades from the labels: one point for quality, one for not being toxic.
GRADES = 3


def label_grade() -> Column:
    return F.col("quality") + 1 - F.col("toxic")


def trained_on_labels(spark, docs: DataFrame, sf_dir: str) -> OrdinalModel:
    return train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label_grade(), GRADES)


def op3_quality(spark, sf_dir):
    """Grade and decision for every document; the classifier is fitted on the table `labels`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    graded = grade_documents(docs, trained_on_labels(spark, docs, sf_dir))
    return graded.select("row.doc_id", "score", "expected_grade", "p_top", "kept")
