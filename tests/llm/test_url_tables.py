"""Rules and vocabulary as tables."""

import random

import pytest

from brickledger.llm import urls

PAGES = "page_id long, url string, rule string, term string"


def test_a_vocabulary_of_a_hundred_thousand_terms(spark):
    rng = random.Random(3)
    terms = {f"{''.join(rng.choices('abcdefgh', k=8))}": "soft" if i % 4 else "strict" for i in range(100_000)}
    listed = [*terms.items(), (" ", "soft"), ("", "strict"), (None, "soft"), *list(terms.items())[:50]]
    vocabulary = spark.createDataFrame(listed, "term string, class string")
    known, links = sorted(terms), []
    for i in range(600):
        picked = rng.sample(known, rng.randrange(0, 4))
        glue = rng.choice(["/", "-", "x", "=", "é"])
        links.append(f"https://Host.org/{glue.join(p.upper() if i % 2 else p for p in picked)}?q={rng.choice(known) if i % 3 == 0 else ''}")
    pages = spark.createDataFrame([(i, url, "c", "c") for i, url in enumerate(links)], PAGES)
    found = {r.page_id: r for r in urls.judge_urls(pages, rules={}, vocabulary=vocabulary).collect()}
    judge = urls.UrlJudge({}, [t for t, c in terms.items() if c == "strict"], [t for t, c in terms.items() if c == "soft"], 2)
    word = set("abcdefghijklmnopqrstuvwxyz0123456789")
    for i, url in enumerate(links):
        low, hits = url.translate(urls._A_Z), set()
        for start in range(len(low)):
            part = low[start : start + 8]
            if part in terms and (not start or low[start - 1] not in word) and low[start + 8 : start + 9] not in word:
                hits.add(part)
        strict = sum(terms[h] == "strict" for h in hits)
        assert (found[i].n_strict, found[i].n_soft) == (strict, len(hits) - strict) == judge.hits(low)
        assert found[i].verdict == ("block" if strict or len(hits) > 1 else "allow")


def test_rules_as_a_table(spark):
    rules = spark.createDataFrame([*urls.RULES.items(), *urls.RULES.items(), (None, "block"), ("", "block")], "rule string, verdict string")
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    assert sorted(urls.judge_urls(pages, rules=rules).collect()) == sorted(urls.judge_urls(pages).collect())
    mixed = spark.createDataFrame([("Bad", "soft"), ("bad", "strict"), ("odd", "soft")], "term string, class string")
    one = spark.createDataFrame([(1, "http://a/bad", "", ""), (2, "http://a/odd", "", ""), (3, None, "", "")], PAGES)
    found = {r.page_id: (r.n_strict, r.n_soft, r.verdict) for r in urls.judge_urls(one, rules=rules.limit(0), vocabulary=mixed).collect()}
    assert found == {1: (1, 0, "block"), 2: (0, 1, "allow"), 3: (0, 0, "allow")}
    assert urls.judge_urls(one, vocabulary=mixed.limit(0)).where("n_strict + n_soft > 0").count() == 0
    for wrong in ({"vocabulary": spark.createDataFrame([("x", "hard")], "term string, class string")}, {"vocabulary": mixed, "most_entries": 1}):
        with pytest.raises(ValueError):
            urls.judge_urls(one, **wrong)
