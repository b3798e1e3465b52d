"""The ordinal classifier: common and rare defects, texts without words, the fit against its own conditions, figures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brickledger.llm import quality
from tests.llm.test_operators import docs, prose


def graded(spark, texts, grades, **options):
    table = docs(spark, texts)
    ratings = spark.createDataFrame(list(enumerate(grades)), "doc_id long, grade int")
    model = quality.train(table, ratings, F.col("grade"), max(grades) + 1, **options)
    return model, {r.row.doc_id: r for r in quality.grade_documents(table, model).collect()}


def test_a_defect_of_nine_in_ten_documents(spark):
    texts = [prose(i, 60, 4000) + (" spoiltmark" if i % 10 else "") for i in range(1000)]
    _, found = graded(spark, texts, [0 if i % 10 else 2 for i in range(1000)])
    assert all(found[i].kept == (i % 10 == 0) for i in range(1000))


def test_a_rare_defect_beside_a_common_one(spark):
    marks = ["" if i % 3 else " commonmark" for i in range(3000)]
    marks = [" raremark" if i % 100 == 1 else m for i, m in enumerate(marks)]  # 1 in 100
    _, found = graded(spark, [prose(i, 60, 4000) + m for i, m in enumerate(marks)], [0 if m else 2 for m in marks])
    assert all(found[i].kept == (not m) for i, m in enumerate(marks))


def test_texts_without_words_are_not_the_best(spark):
    texts = [prose(i, 30, 500) + (" bad" if i % 2 else "") for i in range(300)] + [None, "", " \n\t", "　", "word"]
    _, found = graded(spark, texts, [2 - 2 * (i % 2) for i in range(300)])
    for i in range(300, 304):
        assert (found[i].score, found[i].expected_grade, found[i].p_top, found[i].kept) == (-math.inf, 0.0, 0.0, False)
    assert found[304].kept


def plain_loss(weights, cuts, buckets, grades):
    """The mean negative log-likelihood, document by document, and the ridge on weights times their features' spread."""
    total = 0.0
    for some, grade in zip(buckets, grades):
        score = sum(weights.get(b, 0.0) for b in some)
        tails = [1.0, *[1 / (1 + math.exp(cut - score)) for cut in cuts], 0.0]
        total -= math.log(max(tails[grade] - tails[grade + 1], 1e-12))
    share = {b: sum(b in some for some in buckets) / len(buckets) for b in weights}
    return total / len(grades) + quality.RIDGE / 2 * sum(w * w * share[b] * (1 - share[b]) for b, w in weights.items())


def test_the_fit_is_where_the_likelihood_has_its_top():
    rng = random.Random(2)
    buckets, grades = [], []
    for _ in range(4000):
        some = {b for b in range(12) if rng.random() < [0.5, 0.95, 0.04, 0.3][b % 4]}
        pull = 2.0 * (0 in some) + 2.5 * (1 in some) + 3.0 * (2 in some) + rng.gauss(0, 1)
        buckets.append(some)
        grades.append(2 if pull < 2.2 else 1 if pull < 4 else 0)
    rows = np.array([i for i, some in enumerate(buckets) for _ in some])
    model = quality.fit(rows, np.array([b for some in buckets for b in sorted(some)]), np.array(grades), 3)
    assert {0, 1, 2} <= set(model.weights) and all(w <= 0 for w in model.weights.values()) and model.thresholds[0] < model.thresholds[1]
    best = plain_loss(model.weights, model.thresholds, buckets, grades)
    step = 0.05
    for b in model.weights:
        for sign in (-step, step):
            if model.weights[b] + sign <= 0:
                assert plain_loss({**model.weights, b: model.weights[b] + sign}, model.thresholds, buckets, grades) > best
    for k in range(2):
        for sign in (-step, step):
            cuts = [c + sign * (i == k) for i, c in enumerate(model.thresholds)]
            assert plain_loss(model.weights, cuts, buckets, grades) > best


def test_tails_and_grades_are_those_of_the_model(spark):
    texts = [prose(i, 40, 800) + [" worst", " worse", ""][i % 3] for i in range(900)]
    model, found = graded(spark, texts, [i % 3 for i in range(900)])
    known = quality._Known(frozenset(model.weights))
    for i in range(0, 900, 50):
        score = sum(model.weights[b] for b in quality.features(texts[i], known))
        tails = [1 / (1 + math.exp(cut - score)) for cut in model.thresholds]
        assert found[i].score == pytest.approx(score) and found[i].expected_grade == pytest.approx(sum(tails))
        assert found[i].p_top == pytest.approx(tails[-1]) and found[i].kept == (tails[-1] >= quality.KEEP)
