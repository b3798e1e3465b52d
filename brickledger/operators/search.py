"""Listing search: keep candidates, drop noise, apply hard tags, score, return the best.

A search is a filter, a projection and a top-k in one read: candidates are ordered with noise last and rows without
the required tags behind others, so the first row tells whether there is a candidate that is no noise, and the results
are those of the first rows that are like it and have the tags.  Each task keeps its best rows and nothing is shuffled
but those.  Many searches at once are a table of their own, see batch_search.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions import cells
from brickledger.functions.numbers import to_number
from brickledger.functions.text import is_text, joined_text, pinned_number
from brickledger.operators.dedup import ROW_ORDER
from brickledger.operators.ranking import first_rows

HARD_TAGS = ("tag_near_subway", "tag_lighting", "tag_has_balcony")


def hard_tag_flag(tag: str) -> str:
    """The field of a search that requires a tag."""
    return f"require_{tag}"


@dataclass(frozen=True)
class SearchIntent:
    """What a user looks for.  Only ``require_*`` and the district exclude; the rest orders the rows."""

    needs_row_samples: bool = False
    district_contains: str | None = None
    community_contains: str | None = None
    layout_contains: str | None = None
    min_unit_price: float | None = None
    max_unit_price: float | None = None
    min_total_price_wan: float | None = None
    max_total_price_wan: float | None = None
    near_subway: bool | None = None
    has_balcony: bool | None = None
    lighting_preferred: bool | None = None
    require_tag_near_subway: bool = False
    require_tag_lighting: bool = False
    require_tag_has_balcony: bool = False
    subway_station_contains: str | None = None
    min_build_year: int | None = None
    max_rows: int = fixed.SEARCH_ROWS

    def __post_init__(self):
        if self.max_rows < 1:
            raise ValueError("max_rows must be at least 1")

    def asked(self, name: str) -> str:
        return (getattr(self, name) or "").strip()

    @property
    def hard_tags(self) -> list[str]:
        return [tag for tag in HARD_TAGS if getattr(self, hard_tag_flag(tag))]


def _spellings(name: str) -> list[str]:
    """A district name with and without its 区 or 县."""
    name = name.strip()
    forms = [name] if name else []
    if len(name) > 1 and name[-1] in "区县":
        forms.append(name[:-1])
    elif len(name) > 1 and name[-1] != "市":
        forms.append(name + "区")
    return forms


def geo_keywords(district: str) -> list[str]:
    """All texts by which a district asked for may be listed."""
    district = district.strip()
    names = [district]
    for part, others in fixed.DISTRICT_ALIASES:
        if part in district:
            names += others
    return list(dict.fromkeys(form for name in names for form in _spellings(name)))


def _same_in_lower_case(word: str) -> bool:
    """Whether a text has the word if and only if the text in lower case has it: no letter becomes one of these characters,
    or one of these another.  So the text need not be put into lower case, which costs more than the search."""
    return re.fullmatch(r"[\u4e00-\u9fff0-9]*", word) is not None


class _Listings:
    """The conditions of a search as expressions over one listings table; ``lowered``: all words are looked for in lower case."""

    def __init__(self, df: DataFrame, lowered: bool = False):
        self.columns = df.columns
        geo = [F.col(c).cast("string") for c in fixed.GEO_COLUMNS if c in df.columns]
        rooms = [
            cells.max_rooms(F.coalesce(F.col(c).cast("string"), F.lit("")))
            for c in ("layout_normalized", "layout", "house_info_raw") if c in df.columns
        ]
        family = [c for c in ("layout_normalized", "layout") if c in df.columns]
        self.text = F.col("__text")  # in lower case
        given = joined_text(df, fixed.SEARCH_TEXT_COLUMNS)
        self.given = self.text if lowered else F.col("__as_given")
        self.frame = df if lowered else df.withColumn("__as_given", given)
        self.frame = self.frame.withColumn("__text", F.lower(given if lowered else self.given)).withColumns({
            "__parking": self._said(*fixed.PARKING_WORDS),
            "__absurd": self._any([r >= fixed.ABSURD_ROOMS for r in rooms]),
            "__family": self._any([
                cells.max_rooms(F.coalesce(F.col(c).cast("string"), F.lit(""))).between(*fixed.FAMILY_ROOMS)
                for c in family
            ]),
        })
        self.noise = F.col("__parking") | F.col("__absurd")
        self.geo = geo
        self.numbers = {c: to_number(df, c) for c in fixed.NUMERIC_COLUMNS if c in df.columns}

    @staticmethod
    def _any(conditions: list[Column]) -> Column:
        conditions = [F.coalesce(c, F.lit(False)) for c in conditions]
        return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)

    @staticmethod
    def _has(text: Column, word: str, lower: Column | None = None) -> Column:
        """Whether a text has the word, in either case; ``lower``: the text in lower case, if at hand."""
        if _same_in_lower_case(word):
            return text.contains(word)
        return (F.lower(text) if lower is None else lower).contains(word.lower())

    def _said(self, *words: str) -> Column:
        return self._any([self._has(self.given, w, self.text) for w in words])

    def _in(self, columns, word: str) -> Column:
        present = [c for c in columns if c in self.columns]
        return self._any([self._has(F.col(c).cast("string"), word) for c in present])

    def _tag(self, name: str) -> Column:
        present = name in self.columns
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if present else F.lit(False)

    def geo_match(self, words: list[str]) -> Column:
        if not self.geo or not words:
            return F.lit(True)
        return self._any([self._has(c, w) for c in self.geo for w in words])

    def candidate(self, intent: SearchIntent) -> Column:
        district = intent.asked("district_contains")
        if not district:
            return F.lit(True)
        words = geo_keywords(district)
        return self.geo_match(words) | self._said(*words)

    def hard(self, intent: SearchIntent) -> Column:
        return reduce(lambda a, b: a & b, [self._tag(t) for t in intent.hard_tags], F.lit(True))

    def score(self, intent: SearchIntent) -> Column:
        parts = [F.lit(0.0)]

        def add(condition: Column, points: float) -> None:
            parts.append(F.when(condition, points).otherwise(0.0))

        def add_capped(tag: str, tag_points: float, words, text_points: float, cap: float) -> None:
            both = F.when(self._tag(tag), tag_points).otherwise(0.0) + F.when(
                self._said(*words), text_points
            ).otherwise(0.0)
            parts.append(F.least(both, F.lit(cap)))

        if intent.asked("district_contains"):
            words = geo_keywords(intent.asked("district_contains"))
            add(self.geo_match(words), fixed.GEO_SCORE)
            add(self._said(*words), fixed.GEO_SCORE * fixed.GEO_TEXT_SHARE)
        if word := intent.asked("community_contains"):
            add(self._in(["community"], word), fixed.COMMUNITY_SCORE)
            add(self._said(word), fixed.COMMUNITY_SCORE * fixed.COMMUNITY_TEXT_SHARE)
        if word := intent.asked("layout_contains"):
            add(self._in(["layout", "layout_normalized"], word), fixed.LAYOUT_SCORE)
            add(self._said(word), fixed.LAYOUT_SCORE * fixed.LAYOUT_TEXT_SHARE)
        for column, low, high, near in (
            ("unit_price", intent.min_unit_price, intent.max_unit_price, fixed.UNIT_PRICE_NEAR_FACTOR),
            (
                "total_price", intent.min_total_price_wan, intent.max_total_price_wan,
                fixed.TOTAL_PRICE_NEAR_FACTOR,
            ),
        ):
            if column not in self.numbers:
                continue
            value = self.numbers[column]
            if high is not None:
                add(value <= high, fixed.PRICE_IN_RANGE)
                add((value > high) & (value <= high * near), fixed.PRICE_NEAR)
            if low is not None:
                add(value >= low, fixed.PRICE_IN_RANGE * fixed.PRICE_MIN_SHARE)
        if intent.near_subway:
            add_capped(
                "tag_near_subway", fixed.SUBWAY_TAG, fixed.SUBWAY_WORDS, fixed.SUBWAY_TEXT, fixed.SUBWAY_CAP
            )
        if word := intent.asked("subway_station_contains"):
            add(self._said(word) | self._in(["tag_subway_station_hint"], word), fixed.STATION_SCORE)
        if intent.has_balcony:
            add_capped(
                "tag_has_balcony", fixed.BALCONY_TAG, fixed.BALCONY_WORDS, fixed.BALCONY_TEXT,
                fixed.BALCONY_CAP,
            )
        if intent.lighting_preferred:
            add_capped(
                "tag_lighting", fixed.LIGHTING_TAG, fixed.LIGHTING_WORDS, fixed.LIGHTING_TEXT,
                fixed.LIGHTING_CAP,
            )
        if intent.min_build_year is not None and "build_year" in self.numbers:
            year, wanted = self.numbers["build_year"], int(intent.min_build_year)
            add(year >= wanted, fixed.YEAR_OK)
            add((year >= wanted - fixed.YEAR_NEAR_SPAN) & (year < wanted), fixed.YEAR_NEAR)
        add(F.col("__parking"), -fixed.PARKING_PENALTY)
        add(F.col("__absurd"), -fixed.ABSURD_PENALTY)
        if intent.asked("layout_contains"):
            add(F.col("__family"), fixed.FAMILY_BONUS)
        return reduce(lambda a, b: a + b, parts)

    def price(self) -> Column:
        return F.coalesce(self.numbers.get("unit_price", F.lit(0.0)), F.lit(fixed.NO_PRICE))

    def row_order(self) -> list[str]:
        return [c for c in ROW_ORDER if c in self.columns]


def mark_candidates(df: DataFrame, intent: SearchIntent) -> DataFrame:
    """The rows in the district asked for, never all rows when there is none."""
    rows = _Listings(df)
    return rows.frame.filter(rows.candidate(intent)).select(*df.columns)


def drop_noise(df: DataFrame, intent: SearchIntent = SearchIntent()) -> DataFrame:
    """Candidates without parking lots and absurd layouts, unless that would leave none.

    Whether it would is found by a second read, which each task ends at its first candidate that is no noise.
    """
    rows = _Listings(df)
    candidate = rows.candidate(intent)
    clean = rows.frame.filter(candidate & ~rows.noise).select(F.lit(1)).limit(1).agg(F.count("*")).scalar() > 0
    return rows.frame.filter(candidate).filter(~rows.noise | ~clean).select(*df.columns)


def require_tags(df: DataFrame, intent: SearchIntent) -> DataFrame:
    """Rows with all required tags; NULL and absent tags do not count."""
    return df.filter(_Listings(df).hard(intent))


def score_rows(df: DataFrame, intent: SearchIntent) -> DataFrame:
    rows = _Listings(df)
    return rows.frame.withColumn("score", pinned_number(rows.score(intent))).select(*df.columns, "score")


def search_listings(df: DataFrame, intent: SearchIntent) -> DataFrame:
    """The best rows for an intent with their ``score``, in order."""
    rows = _Listings(df)
    scored = rows.frame.filter(rows.candidate(intent)).select(
        *df.columns, rows.noise.alias("__noise"), rows.hard(intent).alias("__hard"), pinned_number(rows.score(intent)).alias("score"),
        rows.price().alias("__price"),
    )
    if not intent.needs_row_samples:
        return scored.select(*df.columns, "score").limit(0)
    order = ["__noise", F.desc("__hard"), F.desc("score"), "__price", *rows.row_order()]
    best = first_rows(scored, order, intent.max_rows)
    like = F.first("__noise").over(Window.partitionBy(F.lit(0)).orderBy("__rank"))
    best = best.withColumn("__like", like).filter(F.col("__hard") & (F.col("__noise") == F.col("__like")))
    return best.orderBy("__rank").select(*df.columns, "score")


def _stage_counts(rows: _Listings, intent: SearchIntent) -> dict[str, Column]:
    candidate = rows.candidate(intent)
    stages = {"candidates": F.count_if(candidate), "clean_candidates": F.count_if(candidate & ~rows.noise)}
    passed, passed_clean = candidate, candidate & ~rows.noise
    for tag in intent.hard_tags:
        passed, passed_clean = passed & rows._tag(tag), passed_clean & rows._tag(tag)
        stages[f"any_{tag}"], stages[f"clean_{tag}"] = F.count_if(passed), F.count_if(passed_clean)
    return stages


def _outcome(df: DataFrame, intent: SearchIntent) -> Column:
    """A struct of the outcome from the stages' counts."""
    use_clean = F.col("clean_candidates") > 0
    left = F.when(use_clean, F.col("clean_candidates")).otherwise(F.col("candidates"))
    reason = F.when(F.col("table_rows") == 0, "empty_table")
    if not intent.needs_row_samples:
        reason = F.lit("not_requested")
    else:
        reason = reason.when(F.col("candidates") == 0, "no_district_match")
    matched = left
    for tag in intent.hard_tags:
        matched = F.when(use_clean, F.col(f"clean_{tag}")).otherwise(F.col(f"any_{tag}"))
        if intent.needs_row_samples:
            why = f"no_column:{tag}" if tag not in df.columns else f"no_row:{tag}"
            reason = reason.when(matched == 0, why)
    results = F.lit(0) if not intent.needs_row_samples else F.least(matched, F.lit(intent.max_rows))
    outcome = {
        "table_rows": F.col("table_rows"), "candidates": F.col("candidates"), "after_noise": left,
        "after_hard_tags": matched, "results": results.cast("bigint"), "reason": reason,
        "hard_tags": F.lit(",".join(intent.hard_tags)),
    }
    return F.struct(*[c.alias(name) for name, c in outcome.items()])


def search_outcome(df: DataFrame, intent: SearchIntent) -> DataFrame:
    """One row: rows left after each stage, the reason for an empty result or NULL, and the hard tags.

    All stages are counted in one aggregation.
    """
    rows = _Listings(df)
    stages = {"table_rows": F.count("*"), **_stage_counts(rows, intent)}
    counted = rows.frame.agg(*[c.alias(name) for name, c in stages.items()])
    return counted.select(_outcome(df, intent).alias("o")).select("o.*")


def display(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """The columns shown to a user, texts cut to ``max_chars`` characters; None leaves them whole."""
    return df.select(*[
        F.substring(c, 1, max_chars).alias(c) if max_chars is not None and is_text(df, c) else F.col(c)
        for c in fixed.DISPLAY_COLUMNS if c in df.columns
    ])


def display_json(df: DataFrame, max_chars: int | None = None) -> DataFrame:
    """:func:`display` as one JSON document per row; NULL fields are kept."""
    shown = display(df, max_chars)
    return shown.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("listing"))
