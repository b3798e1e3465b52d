"""URL filters: host rules first, then a weighted vocabulary found by Aho-Corasick with boundary checks."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Mapping

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (host and path, verdict); a rule fits its host and all subdomains, if the path starts with the rule's.
RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}
#: One of these blocks a url.
STRICT_TERMS = ("casino", "porn", "xxx", "viagra", "spam", "phishing", "malware", "escort")
#: SOFT_HITS different ones of these block a url.
SOFT_TERMS = (
    "ads", "adult", "bet", "betting", "bonus", "cheap", "click", "deal", "farm", "free", "loan", "lottery", "offer",
    "pills", "poker", "prize", "promo", "replica", "sex", "slots", "track", "win",
)
SOFT_HITS = 2
#: Rules or terms that a worker holds at most: some hundred MB.
MOST_ENTRIES = 1_000_000

_A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host after the first "://" up to one of "/?#", A-Z in lower case; path from there up to one of "?#"."""
    start = -1 if url is None else url.find("://")
    if start < 0:
        return "", ""
    rest = url[start + 3 :]
    rest = rest[: min((p for p in (rest.find("?"), rest.find("#")) if p >= 0), default=len(rest))]
    host, slash, path = rest.partition("/")
    return host.translate(_A_Z), slash + path


class UrlJudge:
    """Rules by host, and one automaton over all terms."""

    def __init__(self, rules: Mapping[str, str], strict: Iterable[str], soft: Iterable[str], soft_hits: int):
        self.by_host: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules.items():
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((slash + path, rule, verdict))
        self.soft_hits = soft_hits
        self.terms = ahocorasick.Automaton()
        for kind, words in (("soft", soft), ("strict", strict)):
            for word in words:
                self.terms.add_word(word, (kind, word))
        if len(self.terms):
            self.terms.make_automaton()

    def rule(self, host: str, path: str) -> tuple[str | None, str | None]:
        """The longest rule that fits (equal lengths: the host's own before its parents'), and its verdict."""
        best: tuple[str | None, str | None] = (None, None)
        labels = host.split(".")
        for k in range(len(labels)):
            for start, rule, verdict in self.by_host.get(".".join(labels[k:]), ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
        return best

    def hits(self, text: str) -> tuple[int, int]:
        """Different strict and soft terms in `text` that no letter or digit touches on either side."""
        found = set()
        if len(self.terms):
            for end, (kind, word) in self.terms.iter(text):
                start = end - len(word) + 1
                if (start == 0 or text[start - 1] not in _WORD) and (end + 1 == len(text) or text[end + 1] not in _WORD):
                    found.add((kind, word))
        strict = sum(kind == "strict" for kind, _ in found)
        return strict, len(found) - strict

    def judge(self, url: str | None) -> tuple[str, str, str | None, int, int, str]:
        host, path = host_and_path(url)
        rule, verdict = self.rule(host, path)
        strict, soft = self.hits((url or "").translate(_A_Z))
        return host, path, rule, strict, soft, verdict or ("block" if strict or soft >= self.soft_hits else "allow")


_judges: dict[bytes, UrlJudge] = {}


def _judge(key: bytes, arguments: tuple) -> UrlJudge:
    """This worker's judge, built once for all tasks that follow; that of other arguments goes."""
    if key not in _judges:
        _judges.clear()
        _judges[key] = UrlJudge(*arguments)
    return _judges[key]


def _listed(table: DataFrame, key: str, value: str, most: int) -> dict[str, str]:
    """A table of two text columns as a dictionary of `most` entries at most; null keys and empty ones are no entries."""
    rows = table.select(F.col(key).cast("string"), F.col(value).cast("string")).where(F.length(F.col(key)) > 0)
    rows = rows.groupBy(key).agg(F.min(value).alias(value)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries of {key}; raise most_entries if a task can hold them")
    return {row[0]: row[1] for row in rows}


def judge_urls(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    rules: Mapping[str, str] | DataFrame = RULES,
    strict: Iterable[str] = STRICT_TERMS,
    soft: Iterable[str] = SOFT_TERMS,
    soft_hits: int = SOFT_HITS,
    vocabulary: DataFrame | None = None,
    most_entries: int = MOST_ENTRIES,
) -> DataFrame:
    """(page_id, host, path, rule, n_strict, n_soft, verdict) for every row of `pages`; a projection, no shuffle.

    A rule's verdict goes before the vocabulary's.  The vocabulary blocks a url with one strict or `soft_hits`
    different soft terms anywhere in it, A-Z in lower case; a term counts only where neither neighbour is a letter
    a-z or a digit.

    Rules may be a table (rule, verdict), and `vocabulary` a table (term, class) in place of `strict` and `soft`, class
    "strict" or "soft".  Terms are taken in lower case; one of both classes is strict, one of any other class an error.
    Both tables go to every worker, which builds one automaton for all its tasks: more than `most_entries` rows of
    either are an error, never cut.

    Null url or none of "://": host and path empty, no rule; null has no hits and is allowed.  Repeated rows, null
    page_id and further columns change nothing: each row is judged alone.  No rows give none.
    """
    if isinstance(rules, DataFrame):
        rules = _listed(rules, "rule", "verdict", most_entries)
    if vocabulary is not None:
        lowered = vocabulary.select(F.lower("term").alias("term"), F.when(F.col("class") == "strict", "a").when(F.col("class") == "soft", "b").otherwise("?").alias("class"))
        # The least class of a term: strict before soft; what is neither comes first and is refused.
        terms = _listed(lowered, "term", "class", most_entries)
        if "?" in terms.values():
            raise ValueError("a class that is neither strict nor soft")
        strict, soft = ([term for term, kind in sorted(terms.items()) if kind == wanted] for wanted in "ab")
    arguments = (dict(rules), tuple(strict), tuple(soft), soft_hits)
    key = hashlib.sha256(repr(arguments).encode()).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(key, arguments).judge
        for batch in batches:
            columns = list(zip(*map(judge, batch.column(1).to_pylist()), strict=True)) or [()] * 6
            types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, columns, types)],
                ["page_id", "host", "path", "rule", "n_strict", "n_soft", "verdict"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    schema = f"page_id {kind}, host string, path string, rule string, n_strict int, n_soft int, verdict string"
    return pages.select(pages[page_id].alias("page_id"), pages[url].alias("url")).mapInArrow(run, schema)


def op8_url_filters(spark, sf_dir):
    """The verdict on every page's url."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def _count(terms: Iterable[str]) -> str:
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::INT" for t in terms)


ORACLE_URL_FILTERS = rf"""
WITH u AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT *, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path,
         {_count(STRICT_TERMS)} AS n_strict, {_count(SOFT_TERMS)} AS n_soft
  FROM u),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM p)
SELECT page_id, host, path, rule, n_strict, n_soft,
       CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN n_strict >= 1 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END AS verdict
FROM r
"""
