"""Mixing sources to target weights: tempered token shares, realised as budgeted permutations of blocks.

Built-in functions only; no Python runs on the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickledger.llm.shared import with_row, written

#: More sources than this are an error: their totals go to the driver and back as a broadcast.
MAX_SOURCES = 100_000
#: Halvings of the exponent's interval.
STEPS = 50
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Mix:
    exponent: float
    budget: int
    weights: tuple[float, ...]


def _weights(tokens: list[int], exponent: float) -> list[float]:
    total = sum(tokens)
    raised = [(t / total) ** exponent if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def _passes(tokens: list[int], weights: list[float], budget: int | None) -> tuple[float, float]:
    """(budget, largest number of passes over a source); no budget: the least that gives each source a whole pass."""
    need = float(budget) if budget is not None else max(t / w for t, w in zip(tokens, weights, strict=True) if t)
    return need, max(need * w / t for t, w in zip(tokens, weights, strict=True) if t)


def solve_mix(
    tokens: list[int], budget: int | None = None, repetition_limit: float | None = None, target_entropy: float | None = None
) -> Mix:
    """Bisect the exponent of the token shares: 1 keeps the shares, 0 makes all sources equal.

    target_entropy (nats): the exponent whose weights have it, or the nearest end.  repetition_limit: the least
    exponent at which no source is passed more often; a budget that needs more even at 1 is lowered to the limit.
    """
    if (repetition_limit is None) == (target_entropy is None):
        raise ValueError("give one of repetition_limit and target_entropy")
    if not sum(tokens):
        return Mix(1.0, 0, tuple(0.0 for _ in tokens))
    if repetition_limit is not None:
        if repetition_limit < 1:
            raise ValueError("repetition_limit must be at least 1")
        if budget is not None:
            budget = min(budget, math.floor(repetition_limit * sum(tokens)))
        fits = lambda x: _passes(tokens, _weights(tokens, x), budget)[1] <= repetition_limit
    else:
        fits = lambda x: -sum(w * math.log(w) for w in _weights(tokens, x) if w) <= target_entropy
    low, high = 0.0, 1.0
    if fits(low):
        high = low
    for _ in range(STEPS):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    weights = _weights(tokens, high)
    return Mix(high, round(_passes(tokens, weights, budget)[0]), tuple(weights))


def _short(value: Column) -> Column:
    return F.substring(F.md5(value), 1, 8)


def _order(seed: int, epoch: Column, source: Column, b1: Column, b2: Column, mark: Column) -> Column:
    """Place of a row in its source's permutation of this epoch: of blocks, of blocks in them, of rows in those."""
    start = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), source)
    return F.concat(
        _short(F.concat_ws("|", start, b1)), _short(F.concat_ws("|", start, b1, b2)), F.md5(F.concat_ws("|", start, mark))
    )


def _boundary(blocks: DataFrame, by: list[str], rest: str, key: Column) -> DataFrame:
    """Of each source's blocks in order of `key`, the one in which the running sum passes `rest`; what is left there."""
    running = F.sum("tokens").over(W.partitionBy("source").orderBy("key", *by).rowsBetween(W.unboundedPreceding, W.currentRow))
    summed = blocks.withColumn("key", key).withColumn("upto", running)
    passing = summed.where((F.col("upto") > F.col(rest)) & (F.col("upto") - F.col("tokens") <= F.col(rest)) & (F.col("tokens") > 0))
    return passing.select("source", *by, (F.col(rest) - (F.col("upto") - F.col("tokens"))).alias("left"), "partial")


def mix_sources(
    docs: DataFrame,
    budget: int | None = None,
    repetition_limit: float | None = None,
    target_entropy: float | None = None,
    seed: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """(row, source, epoch, n_tokens, order_key, position) for every row of the mix; a row may occur in several epochs.

    Tokens are words between ASCII white space.  Weights are solve_mix's.  Each source is passed
    weight * budget / tokens times: whole epochs hold all its rows, the last one a part, which follows a permutation
    of 256 blocks, of 256 blocks in each, and of rows by hashes of (seed, epoch, source, block); rows are taken in
    that order as long as their sum of tokens stays within the quota.  `position` in [0, 1) interleaves the sources:
    sorted by it, every stretch of the mix has about the weights asked for.  The docs are not shuffled: one scan
    sums blocks, one finds the last row of each source's last block, one picks rows by comparing order_key.  What is
    collected and broadcast has one row per source; more than MAX_SOURCES sources are an error.

    Null source: a source of its own.  Null and empty texts: no tokens; a source without tokens has weight 0 and is
    passed once.  Null doc_id: ordered like an empty one.  Rows that repeat a doc_id are chosen together.  Further
    columns are kept in `row`.  Tables without rows give none.
    """
    name = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("null"))
    mark = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    tokens = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    block = {"b1": F.substring("mark", 1, 2), "b2": F.substring("mark", 3, 2)}
    small = docs.select(name.alias("source"), mark.alias("mark"), tokens.alias("tokens")).withColumns(block)
    leaves = written(small.groupBy("source", "b1", "b2").agg(F.sum("tokens").alias("tokens")))
    totals = leaves.groupBy("source").agg(F.sum("tokens").alias("tokens")).orderBy("source").limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    mix = solve_mix([t.tokens for t in totals], budget, repetition_limit, target_entropy)
    quotas = []
    for t, weight in zip(totals, mix.weights, strict=True):
        quota = round(weight * mix.budget) if t.tokens else 0
        whole, partial = divmod(quota, t.tokens) if t.tokens else (1, 0)
        quotas.append((t.source, weight, whole, partial, quota / t.tokens if t.tokens else 1.0))
    plan = docs.sparkSession.createDataFrame(quotas, "source string, weight double, partial long, quota long, passes double")

    # `partial` numbers the epoch that is passed in part; `left` is what remains of its quota.
    at = lambda epoch, b1, b2, m: _order(seed, epoch, F.col("source"), b1, b2, m)
    asked = F.broadcast(plan.where("quota > 0").select("source", "partial", F.col("quota").alias("rest")))
    none = F.lit("")
    first = leaves.groupBy("source", "b1").agg(F.sum("tokens").alias("tokens")).join(asked, "source")
    first = _boundary(first, ["b1"], "rest", F.substring(at(F.col("partial"), F.col("b1"), none, none), 1, 8))
    second = leaves.join(F.broadcast(first), ["source", "b1"])
    second = _boundary(second, ["b1", "b2"], "left", F.substring(at(F.col("partial"), F.col("b1"), F.col("b2"), none), 9, 8))
    last = small.join(F.broadcast(written(second)), ["source", "b1", "b2"])
    last = last.withColumn("key", at(F.col("partial"), F.col("b1"), F.col("b2"), F.col("mark")))
    last = last.groupBy("source", "key", "left").agg(F.sum("tokens").alias("tokens"))
    running = F.sum("tokens").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow))
    last = last.withColumn("upto", running).groupBy("source").agg(
        F.max(F.when(F.col("upto") <= F.col("left"), F.col("key"))).alias("taken"), F.min("key").alias("block")
    )
    # Nothing taken of the last block: all keys before it, that is below its first sixteen digits.
    upto = last.select("source", F.coalesce("taken", F.substring("block", 1, 16)).alias("upto"))
    plan = F.broadcast(written(plan.join(upto, "source", "left")).withColumnRenamed("source", "name"))

    rows = with_row(docs, source=name, mark=mark, n_tokens=tokens).withColumns(block).join(plan, F.col("source") == F.col("name"))
    key = at(F.col("epoch"), F.col("b1"), F.col("b2"), F.col("mark"))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("partial").cast("int")))).withColumn("order_key", key)
    rows = rows.where((F.col("epoch") < F.col("partial")) | (F.col("order_key") <= F.col("upto")))
    share = F.conv(F.substring("order_key", 1, 13), 16, 10).cast("double") / float(16**13)
    position = (F.col("epoch") + share) / F.col("passes")
    return rows.select("row", "source", "epoch", "n_tokens", "order_key", position.alias("position"), "weight")


#: The limit of the registered query and of the pipeline's stage: the scarcest source is passed at most twice.
REPETITION_LIMIT = 2.0


def op1_mixing(spark, sf_dir):
    """The rows of the mix in which no source is left out in part or passed more than twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    mixed = mix_sources(docs, repetition_limit=REPETITION_LIMIT)
    return mixed.select("row.doc_id", "row.source", "epoch", "n_tokens", "order_key", F.round("weight", 6).alias("weight"))


ORACLE_MIXING = rf"""
WITH RECURSIVE small AS (
  SELECT doc_id, source, coalesce('=' || source, 'null') AS name, md5(coalesce(doc_id::VARCHAR, '')) AS mark,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
totals AS (SELECT name, sum(n) AS t, sum(n) / (SELECT sum(n) FROM small) AS share FROM small GROUP BY name),
bisect(step, low, high) AS (
  SELECT 0, 0.0::DOUBLE, CASE WHEN (SELECT max(1 / t) / min(1 / t) FROM totals) <= {REPETITION_LIMIT} THEN 0.0 ELSE 1.0 END::DOUBLE
  UNION ALL
  SELECT step + 1, CASE WHEN fits THEN low ELSE (low + high) / 2 END, CASE WHEN fits THEN (low + high) / 2 ELSE high END
  FROM (SELECT *, (SELECT max(pow(share, (low + high) / 2) / t) / min(pow(share, (low + high) / 2) / t) FROM totals)
               <= {REPETITION_LIMIT} AS fits FROM bisect) WHERE step < {STEPS}),
raised AS (SELECT name, t, pow(share, (SELECT high FROM bisect WHERE step = {STEPS})) AS r FROM totals),
weights AS (SELECT name, t, r / (SELECT sum(r) FROM raised) AS weight FROM raised),
quotas AS (
  SELECT name, t, weight, round(weight * (SELECT round(max(t / weight)) FROM weights))::BIGINT AS quota FROM weights),
plan AS (SELECT name, weight, (quota // t)::BIGINT AS partial, (quota % t)::BIGINT AS rest FROM quotas),
keyed AS (
  SELECT s.*, p.weight, p.partial, p.rest, e AS epoch,
         substr(md5('0|' || e || '|' || s.name || '|' || substr(mark, 1, 2)), 1, 8)
         || substr(md5('0|' || e || '|' || s.name || '|' || substr(mark, 1, 2) || '|' || substr(mark, 3, 2)), 1, 8)
         || md5('0|' || e || '|' || s.name || '|' || mark) AS order_key
  FROM small s JOIN plan p ON s.name = p.name, unnest(range(0, p.partial + 1)) AS u(e)),
summed AS (SELECT *, sum(n) OVER (PARTITION BY name, epoch ORDER BY order_key) AS upto FROM keyed)
SELECT doc_id, source, epoch::INT AS epoch, n::BIGINT AS n_tokens, order_key, round(weight, 6) AS weight
FROM summed WHERE epoch < partial OR (rest > 0 AND upto <= rest)
"""
