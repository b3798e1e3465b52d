"""Batch search: the searches are a table, joined to the listings through an inverted index of district keywords.

The plan is the same for any number of searches.  A listing's pairs of characters are looked up in the index, which
gives the districts asked for that it is a candidate of; these are joined to the searches, whose words, limits and wishes
are columns of the score.  A listing only meets the searches whose candidate it is.

Searches that differ in their limits and numbers of rows only have one wish, and wishes that differ in the words for
community, layout and station only have one base.  A listing first meets the bases, as one that none of those words is in,
and, through an index of the words, the wishes of which it has a word.  It can only be better for that, so the listings
without a word that are among the first of a search are among the first of its base, too.

Of the listings that no search of a base or a wish can tell apart by its score, as all its limits lie on the same side of
their numbers, the first go on to the searches, as many as are asked for at most: the others come after them in every
search.  Most limits on the unit price tell none apart: of two listings that are alike otherwise the cheaper one has the
points, if any, and comes first without them.
"""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brickledger import fixed
from brickledger.functions.text import pinned, pinned_number, strip
from brickledger.operators.ranking import first_rows
from brickledger.operators.search import HARD_TAGS, SearchIntent, _Listings, hard_tag_flag

#: Up to so many searches, some megabytes with their keywords, both joins broadcast them; beyond, Spark shuffles.
BROADCAST_INTENTS = 20_000
_BITS, _WORD = 1 << 16, 64
#: Up to so many different beginnings of keywords, each is looked for in a listing's text; beyond, the text's pairs of
#: characters are looked up.
_FEW_ANCHORS = 64
#: Up to so many different limits on a number, listings are told apart by the limits they lie between, else by the number.
_MOST_LIMITS = 1000
_LIMITS = ("min_unit_price", "max_unit_price", "min_total_price_wan", "max_total_price_wan", "min_build_year")
#: What a listing may say of a wish, and the columns beside the text where it may; each gives points only.
_WORDS = {
    "community_contains": ("community",), "layout_contains": ("layout", "layout_normalized"),
    "subway_station_contains": ("tag_subway_station_hint",),
}
_TYPES = {"str": "string", "bool": "boolean", "float": "double", "int": "int"}
_FIELDS = {f.name: (_TYPES[f.type.split(" ")[0]], f.default) for f in fields(SearchIntent)}


def intent_table(spark: SparkSession, intents: dict[str, SearchIntent]) -> DataFrame:
    """Searches by their id as the table that the functions here take."""
    schema = ", ".join(["intent_id string", *[f"{name} {kind}" for name, (kind, _) in _FIELDS.items()]])
    return spark.createDataFrame([(key, *astuple(intent)) for key, intent in intents.items()], schema)


def _normal(intents: DataFrame) -> DataFrame:
    """All fields of a search, with its type; the default where the column or the value is missing."""
    columns = {"intent_id": F.col("intent_id").cast("string")}
    for name, (kind, default) in _FIELDS.items():
        given = F.col(name).cast(kind) if name in intents.columns else F.lit(None).cast(kind)
        if kind == "string":
            given = F.nullif(strip(given), F.lit(""))
        columns[name] = given if default is None else F.coalesce(given, F.lit(default))
    return intents.select(*[c.alias(name) for name, c in columns.items()])


def keywords(district: Column) -> Column:
    """All texts by which a district may be listed, in lower case, as :func:`search.geo_keywords` gives them."""
    names = [F.array(district)]
    names += [
        F.when(district.contains(part), F.array(*map(F.lit, others))).otherwise(F.array().cast("array<string>"))
        for part, others in fixed.DISTRICT_ALIASES
    ]

    def spellings(name: Column) -> Column:
        last, long = F.right(name, F.lit(1)), F.char_length(name) > 1
        short = F.substring(name, F.lit(1), F.char_length(name) - 1)
        both = F.when(long & last.isin("区", "县"), F.array(name, short))
        return both.when(long & (last != "市"), F.array(name, F.concat(name, F.lit("区")))).otherwise(F.array(name))

    forms = F.flatten(F.transform(F.flatten(F.array(*names)), lambda n: spellings(strip(n))))
    return F.array_distinct(F.transform(F.filter(forms, lambda f: f != ""), F.lower))


@dataclass(frozen=True)
class _Anchors:
    """The first two characters of some keywords: all, if they are few, else as bits of their hashes."""

    few: list[str] | None
    bits: Column | None

    def inside(self, text: Column) -> Column:
        """Those in a text, and where they are bits, other pairs of characters with the same hashes."""
        if self.few is not None:
            # Without a lambda, in which all tests would be interpreted.
            return F.array_remove(F.array(*[F.when(text.contains(a), a).otherwise("") for a in self.few], F.lit("")), F.lit(""))
        parts = F.concat(F.regexp_extract_all(text, F.lit("(?s)(?=(..))"), F.lit(1)), F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))
        known = lambda a: F.getbit(F.get(self.bits, (_bit(a) / _WORD).cast("int")), (_bit(a) % _WORD).cast("int")) == 1
        return F.array_distinct(F.filter(parts, known))


def _anchor(keyword: Column) -> Column:
    return F.substring(keyword, F.lit(1), F.lit(2))


def _bit(anchor: Column) -> Column:
    return F.pmod(F.xxhash64(anchor), F.lit(_BITS))


def _anchors(keyword: DataFrame) -> _Anchors:
    """Of a table with the one column ``word``; runs a small job, or two."""
    anchors = keyword.select(_anchor(F.col("word")).alias("anchor")).dropna().distinct()
    few = [r["anchor"] for r in anchors.limit(_FEW_ANCHORS + 1).collect()]
    if len(few) <= _FEW_ANCHORS:
        return _Anchors(sorted(few), None)
    marks = anchors.select(_bit(F.col("anchor")).alias("bit"))
    marked = marks.groupBy((F.col("bit") / _WORD).cast("int").alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, int(bit % {_WORD}))")).alias("mask")
    )
    words = [0] * (_BITS // _WORD)
    for row in marked.collect():  # at most 1024 numbers
        words[row["word"]] = row["mask"]
    return _Anchors(None, F.split(F.lit(",".join(map(str, words))), ",").cast("array<bigint>"))


@dataclass(frozen=True)
class _Asked:
    """The searches, and what small jobs over them say."""

    table: DataFrame
    districts: DataFrame
    count: int
    wishes: int
    most_rows: int
    anchors: _Anchors
    open: bool
    worded: bool


def _asked(intents: DataFrame) -> _Asked:
    table = _normal(intents)
    words = [F.col(w).isNotNull() for w in _WORDS]
    facts = table.agg(
        F.count("*").alias("n"), F.count_distinct("intent_id").alias("ids"), F.min("max_rows").alias("least"), F.max("max_rows").alias("most"),
        F.count_if(F.col("district_contains").isNull()).alias("open"), F.count_distinct(F.struct(*_same(table))).alias("wishes"),
        F.count_if(reduce(lambda a, b: a | b, words)).alias("worded"),
    ).first()
    if facts["n"] != facts["ids"]:
        raise ValueError("intent_id must be filled and different for each search")
    if facts["n"] and facts["least"] < 1:
        raise ValueError("max_rows must be at least 1")
    districts = table.select("district_contains").dropna().distinct().withColumn("words", keywords(F.col("district_contains")))
    anchors = _anchors(districts.select(F.explode("words").alias("word")))
    return _Asked(table, districts, facts["n"], facts["wishes"], facts["most"] or 1, anchors, facts["open"] > 0, facts["worded"] > 0)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_INTENTS else df


def _same(table: DataFrame) -> list[str]:
    """The columns that the searches of a wish have in common."""
    return [c for c in table.columns if c not in ("intent_id", "max_rows", *_LIMITS)]


def _wishes(asked: _Asked) -> DataFrame:
    """The searches with the least id of those (``__wish``) that differ from them in limits and numbers of rows only, and
    that of those (``__base``) that differ in words, too."""
    same = _same(asked.table)
    base = [c for c in same if c not in _WORDS] + ["__family_asked"]
    rows = asked.table.withColumn("__family_asked", F.col("layout_contains").isNotNull())
    return rows.withColumns({"__wish": F.min("intent_id").over(Window.partitionBy(*same)), "__base": F.min("intent_id").over(Window.partitionBy(*base))})


def _bases(wishes: DataFrame) -> DataFrame:
    """One row for each base: what its searches have in common, the most rows asked for, and which numbers need cells."""
    limited = {c: reduce(lambda a, b: a | b, [F.col(name).isNotNull() for name in names]) for c, names in _CELLS.items()}
    kept = [c for c in _same(wishes) if c not in (*_WORDS, "__wish", "__base")]
    return wishes.groupBy("__base", *kept).agg(
        F.max("max_rows").alias("max_rows"), *[F.bool_or(some).alias(f"__limits_{c}") for c, some in limited.items()]
    )


def _prepared(rows: _Listings, asked: _Asked) -> None:
    """Add what is the same for a row in all searches, so that it is told once: texts in lower case and anchors in them."""
    lowered = {c for c in (*fixed.GEO_COLUMNS, *[c for columns in _WORDS.values() for c in columns]) if c in rows.columns}
    rows.frame = rows.frame.withColumns({_low(c): pinned(F.lower(F.col(c).cast("string"))) for c in sorted(lowered)})
    geo = [F.coalesce(F.col(_low(c)), F.lit("")) for c in fixed.GEO_COLUMNS if c in rows.columns]
    rows.frame = rows.frame.withColumn("__listed", pinned(F.concat_ws("\x01", *geo, F.col("__text"))))
    every = F.array(F.lit(""))  # stands for the searches without a district
    if not rows.geo:
        anchors = every  # without a column to say it, all rows are in every district
    else:
        anchors = asked.anchors.inside(F.col("__listed"))
        if asked.open:
            anchors = F.concat(every, anchors)
    rows.frame = rows.frame.withColumn("__anchors", anchors)


def _low(column: str) -> str:
    return f"__low_{column}"


def _candidates(rows: _Listings, asked: _Asked, table: DataFrame | None = None) -> DataFrame:
    """The rows with one search (``__q``) each whose candidate they are, and whether its district is said where.

    ``table`` has what is to be met in place of the searches, as many as there are wishes at most.
    """
    n_table, table = (asked.count, asked.table) if table is None else (asked.wishes, table)
    _prepared(rows, asked)
    geo = [F.coalesce(F.col(_low(c)), F.lit("")) for c in fixed.GEO_COLUMNS if c in rows.columns]

    def in_geo(word: Column) -> Column:
        found = F.lit(False)
        for c in geo:
            found = found | c.contains(word)
        return found

    def in_text(word: Column) -> Column:
        return F.col("__text").contains(word)

    index = asked.districts.select(F.col("district_contains").alias("__key"), "words", F.posexplode("words").alias("nth", "word"))
    index = index.select("__key", F.struct("words", "nth", "word").alias("__w"), _anchor(F.col("word")).alias("__anchor"))
    nothing = F.struct(F.array().cast("array<string>").alias("words"), F.lit(0).alias("nth"), F.lit(None).cast("string").alias("word"))
    index = index.unionByName(asked.table.sparkSession.range(1).select(F.lit("").alias("__key"), nothing.alias("__w"), F.lit("").alias("__anchor")))
    met = rows.frame.withColumn("__anchor", F.explode("__anchors")).drop("__anchors", "__listed")
    hits = met.join(_small(index, asked.wishes), "__anchor")
    # A district is met by its first keyword that the row has.
    has = lambda w: in_geo(w) | in_text(w)
    before = F.slice(F.col("__w.words"), F.lit(1), F.col("__w.nth"))
    hits = hits.filter(F.col("__w.word").isNull() | (has(F.col("__w.word")) & ~F.exists(before, has)))
    said = {"__in_geo": F.exists("__w.words", in_geo), "__in_text": F.exists("__w.words", in_text)}
    key = F.coalesce("district_contains", F.lit(""))
    if not geo:
        key, said = F.lit(""), {}
    searches = table.select(key.alias("__key"), F.struct(*table.columns).alias("__q"))
    pairs = hits.withColumns(said).join(_small(searches, n_table), "__key").drop("__key", "__anchor", "__w")
    if not geo:
        pairs = pairs.withColumn("__in_geo", F.col("__q.district_contains").isNotNull())
        pairs = pairs.withColumn("__in_text", F.exists(keywords(F.col("__q.district_contains")), in_text))
    return pairs


def _word(name: str) -> Column:
    """A word of the wish beside a row, in lower case; NULL in its base."""
    return F.col(f"__w.{name}")


def _said_in(rows: _Listings, name: str, word: Column) -> list[Column]:
    """Whether a column for it, and whether the text, has a word."""
    columns = [c for c in _WORDS[name] if c in rows.columns]
    return [rows._any([F.col(_low(c)).contains(word) for c in columns]), rows._any([F.col("__text").contains(word)])]


def _meeting_wishes(rows: _Listings, asked: _Asked, wishes: DataFrame, pairs: DataFrame) -> DataFrame:
    """For each row beside a base (``__q``) a row for the base and one for each of its wishes that it has a word of, by the
    first of them; ``__meets`` names base or wish, ``__w`` has the words."""
    none = F.struct(*[F.lit(None).cast("string").alias(w) for w in _WORDS])
    base = F.concat(F.lit("b"), _q("__base"))
    if not asked.worded:
        return pairs.withColumns({"__meets": base, "__w": none})
    index = _word_index(wishes)
    hits = pairs.withColumns({"__base": _q("__base"), "__anchor": F.explode(F.concat(F.array(F.lit("")), "__word_anchors"))})
    hits = hits.drop("__word_anchors").join(_small(index, asked.wishes), ["__base", "__anchor"], "left")
    hits = hits.filter((F.col("__anchor") == "") | F.col("__meets").isNotNull())
    met, earlier = F.col("__anchor") == "", F.lit(False)
    for nth, name in enumerate(_WORDS):
        here = reduce(lambda a, b: a | b, _said_in(rows, name, _word(name)))
        met, earlier = met | ((F.col("__nth") == nth) & here & ~earlier), earlier | here
    return hits.filter(met).withColumns({"__meets": F.coalesce("__meets", base)}).drop("__base", "__anchor", "__nth")


def _word_index(wishes: DataFrame) -> DataFrame:
    words = [F.lower(w).alias(w) for w in _WORDS]
    found = wishes.filter("intent_id = __wish").select(
        "__base", F.concat(F.lit("w"), "__wish").alias("__meets"), F.struct(*words).alias("__w"),
        F.posexplode(F.array(*words)).alias("__nth", "word"),
    ).dropna(subset=["word"])
    return found.withColumn("__anchor", _anchor(F.col("word"))).drop("word")


def _q(name: str) -> Column:
    return F.col(f"__q.{name}")


def _hard(rows: _Listings, tag: str) -> Column:
    """Whether a row has a tag that its search requires; true where it doesn't."""
    return ~_q(hard_tag_flag(tag)) | rows._tag(tag)


def _points(condition: Column, n: float) -> Column:
    return F.when(condition, n).otherwise(0.0)


def _capped(rows: _Listings) -> dict[str, Column]:
    """The points of a row for each wish that it has a tag or words for, the same in all searches that have the wish."""
    def capped(tag: str, tag_points: float, words, text_points: float, cap: float) -> Column:
        return F.least(_points(rows._tag(tag), tag_points) + _points(rows._said(*words), text_points), F.lit(cap))

    return {
        "near_subway": capped("tag_near_subway", fixed.SUBWAY_TAG, fixed.SUBWAY_WORDS, fixed.SUBWAY_TEXT, fixed.SUBWAY_CAP),
        "has_balcony": capped("tag_has_balcony", fixed.BALCONY_TAG, fixed.BALCONY_WORDS, fixed.BALCONY_TEXT, fixed.BALCONY_CAP),
        "lighting_preferred": capped("tag_lighting", fixed.LIGHTING_TAG, fixed.LIGHTING_WORDS, fixed.LIGHTING_TEXT, fixed.LIGHTING_CAP),
    }


def _parts(rows: _Listings) -> list[Column | str]:
    """The summands of :meth:`_Listings.score` for the base ``__q`` and the words ``__w`` beside a row; names of numbers stand
    for those of limits on them."""
    points, parts = _points, [
        _points(F.col("__in_geo"), fixed.GEO_SCORE), _points(F.col("__in_text"), fixed.GEO_SCORE * fixed.GEO_TEXT_SHARE),
    ]
    for name, score, share in (
        ("community_contains", fixed.COMMUNITY_SCORE, fixed.COMMUNITY_TEXT_SHARE), ("layout_contains", fixed.LAYOUT_SCORE, fixed.LAYOUT_TEXT_SHARE)
    ):
        inside, said = _said_in(rows, name, _word(name))
        parts += [points(inside, score), points(said, score * share)]
    parts += [column for column in _PRICES if column in rows.numbers]
    inside, said = _said_in(rows, "subway_station_contains", _word("subway_station_contains"))
    wished = {wish: F.when(_q(wish), F.col(f"__for_{wish}")).otherwise(0.0) for wish in ("near_subway", "has_balcony", "lighting_preferred")}
    parts += [wished["near_subway"], points(said | inside, fixed.STATION_SCORE), wished["has_balcony"], wished["lighting_preferred"]]
    if "build_year" in rows.numbers:
        parts.append("build_year")
    return [
        *parts,
        points(F.col("__parking"), -fixed.PARKING_PENALTY), points(F.col("__absurd"), -fixed.ABSURD_PENALTY),
        points(F.col("__family") & _q("__family_asked"), fixed.FAMILY_BONUS),
    ]


_PRICES = {
    "unit_price": ("min_unit_price", "max_unit_price", fixed.UNIT_PRICE_NEAR_FACTOR),
    "total_price": ("min_total_price_wan", "max_total_price_wan", fixed.TOTAL_PRICE_NEAR_FACTOR),
}


#: The limits by which listings are told apart, by their numbers.
_CELLS = {
    "unit_price": ("min_unit_price",), "total_price": ("min_total_price_wan", "max_total_price_wan"), "build_year": ("min_build_year",),
}


def _by_limits(column: str, value: Column) -> list[Column]:
    """The summands that come from the limits on a number."""
    if column == "build_year":
        wanted = _q("min_build_year")
        near = (value >= wanted - fixed.YEAR_NEAR_SPAN) & (value < wanted)
        return [_points(value >= wanted, fixed.YEAR_OK), _points(near, fixed.YEAR_NEAR)]
    low, high, near = _PRICES[column]
    return [
        _points(value <= _q(high), fixed.PRICE_IN_RANGE),
        _points((value > _q(high)) & (value <= _q(high) * near), fixed.PRICE_NEAR),
        _points(value >= _q(low), fixed.PRICE_IN_RANGE * fixed.PRICE_MIN_SHARE),
    ]


def _between(asked: _Asked, column: str, value: Column) -> Column:
    """What is the same for numbers that all limits on the column have on the same side: how many lie below or at them.

    Runs a small job over the searches.  Listings come by their unit price, those without one last, so most limits on it
    need not tell them apart but from the prices that come after none.
    """
    above = []
    if column == "build_year":
        at = [F.col("min_build_year"), F.col("min_build_year") - fixed.YEAR_NEAR_SPAN]
    else:
        low, high, near = _PRICES[column]
        at = [F.col(low)]
        if column != "unit_price":
            above = [F.col(high), F.col(high) * near]
    cells = []
    for limits, beyond in ((above, lambda t: value > t), (at, lambda t: value >= t)):
        if limits:
            given = asked.table.select(F.explode(F.array(*[c.cast("double") for c in limits])).alias("t")).dropna().distinct()
            found = sorted(r["t"] for r in given.limit(_MOST_LIMITS + 1).collect())
            if len(found) > _MOST_LIMITS:
                return value
            if found:
                many = F.array(*map(F.lit, found))
                cells.append(F.size(F.filter(many, beyond)))
    return F.when(value.isNotNull(), F.array(*cells) if cells else F.array(F.lit(0)))


def _first_alike(rows: _Listings, asked: _Asked, wishes: DataFrame, columns: list[str]) -> DataFrame:
    """The rows with one base or wish each (``__meets``) that can be among the first of one of its searches, with the parts
    of their score and, where a search has words, the texts these may be in."""
    numbers = {f"__{c}": value for c, value in rows.numbers.items() if c in _CELLS}
    hard = F.lit(True)
    for tag in HARD_TAGS:
        hard = hard & _hard(rows, tag)
    parts = [p for p in _parts(rows) if not isinstance(p, str)]
    # What does not depend on the wishes is told once for a row, before it meets them.  Here and below, pinned columns keep
    # a projection out of the stage's one generated method, beside doing what they do.
    rows.frame = rows.frame.withColumns({
        **{f"__at{c}": _between(asked, c.removeprefix("__"), value) for c, value in numbers.items()},
        **{f"__for_{wish}": points for wish, points in _capped(rows).items()},
    })
    texts = []
    if asked.worded:
        texts = ["__text", *[_low(c) for names in _WORDS.values() for c in names if c in rows.columns]]
        said = [F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for names in _WORDS.values() for c in names if c in rows.columns]
        anchors = _anchors(_word_index(wishes).select(F.col("__anchor").alias("word")))
        rows.frame = rows.frame.withColumn("__worded", pinned(F.concat_ws("\x01", *said, F.col("__text"))))
        rows.frame = rows.frame.withColumn("__word_anchors", anchors.inside(F.col("__worded"))).drop("__worded")
    pairs = _meeting_wishes(rows, asked, wishes, _candidates(rows, asked, _bases(wishes)))
    beyond = F.coalesce(rows.price() >= fixed.NO_PRICE, F.lit(False)) & rows.numbers.get("unit_price", F.lit(None)).isNotNull()
    alike = {f"__at{c}": F.when(_q(f"__limits_{c.removeprefix('__')}"), F.col(f"__at{c}")) for c in numbers}
    pairs = pairs.select(
        *columns, *texts, rows.noise.alias("__noise"), pinned_number(rows.price()).alias("__price"), "__meets", _q("max_rows").alias("__first"),
        hard.alias("__hard"), beyond.alias("__beyond"), *[value.alias(name) for name, value in numbers.items()],
        *[cell.alias(name) for name, cell in alike.items()],
        F.array(*parts).alias("__parts"),
    )
    # Whole numbers in place of the parts, of which one has few values, far more than that apart.
    said = [F.floor(F.get("__parts", F.lit(i)) * 10_000 + 0.5) for i in range(len(parts))]
    pairs = pairs.withColumn("__said", F.array(*said))
    alike = Window.partitionBy("__meets", "__noise", "__hard", "__beyond", "__said", *alike)
    place = F.row_number().over(alike.orderBy("__price", *rows.row_order()))
    first = pairs.withColumn("__place", place).filter(F.col("__place") <= asked.most_rows).filter(F.col("__place") <= F.col("__first"))
    return first.drop("__place", "__first", "__beyond", "__said", *[f"__at{c}" for c in numbers])


def _score(rows: _Listings) -> Column:
    """The score of a row with the parts of a wish for the search ``__q`` beside it, summed in the order of :func:`_parts`."""
    total, nth = F.lit(0.0), 0
    for part in _parts(rows):
        if isinstance(part, str):
            for points in _by_limits(part, F.col(f"__{part}")):
                total = total + points
        else:
            total, nth = total + F.get("__parts", F.lit(nth)), nth + 1
    return total


def search_batch(df: DataFrame, intents: DataFrame | dict[str, SearchIntent]) -> DataFrame:
    """Search for all rows of ``intents``: (intent_id, rank, row, score) of the best rows of each.

    ``intents`` has an ``intent_id`` and any of the fields of :class:`SearchIntent` as columns; a missing column or NULL
    is the field's default.  The listings are read once, every task keeps the first rows of those alike before the
    shuffle, and a search that asks for no rows gets none.  Runs small jobs over the searches.
    """
    table = intent_table(df.sparkSession, intents) if isinstance(intents, dict) else intents
    asked = _asked(table.filter(F.coalesce(F.col("needs_row_samples"), F.lit(False))) if "needs_row_samples" in table.columns else table.limit(0))
    rows = _Listings(df, lowered=True)
    wishes = _wishes(asked)
    worded = reduce(lambda a, b: a | b, [F.col(w).isNotNull() for w in _WORDS])
    meets = [F.concat(F.lit(kind), f"__{name}") for kind, name in (("b", "base"), ("w", "wish"))]
    searches = wishes.select(
        F.explode(F.when(worded, F.array(*meets)).otherwise(F.array(meets[0]))).alias("__meets"), F.struct(*asked.table.columns).alias("__q"),
        F.struct(*[F.lower(w).alias(w) for w in _WORDS]).alias("__w"),
    )
    hits = _first_alike(rows, asked, wishes, df.columns).join(_small(searches, asked.count), "__meets")
    if asked.worded:  # a row with a word of the search is there for its wish, not for the base
        said = reduce(lambda a, b: a | b, [c for name in _WORDS for c in _said_in(rows, name, _word(name))])
        hits = hits.filter(~(F.col("__meets").startswith("b") & said))
    hits = hits.select(
        *df.columns, "__noise", "__price", _q("intent_id").alias("intent_id"),
        _q("max_rows").alias("__most"), "__hard", pinned_number(_score(rows)).alias("score"),
    )
    order = [F.col("__noise"), F.desc("__hard"), F.desc("score"), F.col("__price"), *[F.col(c) for c in rows.row_order()]]
    best = first_rows(hits, order, asked.most_rows, "intent_id", F.col("__most"))
    like = F.first("__noise").over(Window.partitionBy("intent_id").orderBy("__rank"))
    best = best.withColumn("__like", like).filter(F.col("__hard") & (F.col("__noise") == F.col("__like")))
    # Rows with the tags come first among equals in noise, so the ranks of those that are left have no gap.
    return best.select("intent_id", F.col("__rank").alias("rank"), *df.columns, "score")


def search_outcomes(df: DataFrame, intents: DataFrame | dict[str, SearchIntent]) -> DataFrame:
    """:func:`search.search_outcome` of all searches with their intent_id, from one aggregation by search."""
    table = intent_table(df.sparkSession, intents) if isinstance(intents, dict) else intents
    asked, rows = _asked(table), _Listings(df, lowered=True)
    clean, passed = ~rows.noise, F.lit(True)
    counts = [F.count("*").alias("candidates"), F.count_if(clean).alias("clean")]
    for tag in HARD_TAGS:
        passed = passed & _hard(rows, tag)
        counts += [F.count_if(passed).alias(f"any_{tag}"), F.count_if(passed & clean).alias(f"clean_{tag}")]
    counted = _candidates(rows, asked).groupBy(_q("intent_id").alias("intent_id")).agg(*counts)
    names = [name for tag in HARD_TAGS for name in (f"any_{tag}", f"clean_{tag}")]
    found = asked.table.join(counted, "intent_id", "left").fillna(0, ["candidates", "clean", *names])
    found = found.withColumn("table_rows", df.agg(F.count("*")).scalar())
    use_clean = F.col("clean") > 0
    reason = F.when(~F.col("needs_row_samples"), "not_requested").when(F.col("table_rows") == 0, "empty_table")
    reason = reason.when(F.col("candidates") == 0, "no_district_match")
    matched = F.when(use_clean, F.col("clean")).otherwise(F.col("candidates"))
    left, listed = matched, []
    for tag in HARD_TAGS:
        matched = F.when(use_clean, F.col(f"clean_{tag}")).otherwise(F.col(f"any_{tag}"))
        asks = F.col(hard_tag_flag(tag))
        why = f"no_column:{tag}" if tag not in df.columns else f"no_row:{tag}"
        reason = reason.when(asks & (matched == 0), why)
        listed.append(F.when(asks, F.lit(tag)))
    results = F.when(F.col("needs_row_samples"), F.least(matched, F.col("max_rows"))).otherwise(F.lit(0))
    return found.select(
        "table_rows", "candidates", left.alias("after_noise"), matched.alias("after_hard_tags"), results.cast("bigint").alias("results"),
        reason.alias("reason"), F.concat_ws(",", *listed).alias("hard_tags"), "intent_id",
    )
