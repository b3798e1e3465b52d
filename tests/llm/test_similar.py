"""Near-duplicates by Jaccard similarity where buckets are large: work grows with members, and no link is lost."""

import random

import pytest

from brickledger.llm import simhash
from tests.llm.test_operators import components_of, docs, jaccard, prose, replaced


@pytest.fixture
def verified(monkeypatch):
    """The numbers of candidate pairs of each round."""
    counts, similar = [], simhash._Sets.similar

    def counted(self, pairs, *rest):
        counts.append(pairs.count())
        return similar(self, pairs, *rest)

    monkeypatch.setattr(simhash._Sets, "similar", counted)
    return counts


def test_pairs_of_texts_that_share_a_passage_grow_with_their_number(spark, verified):
    passage = prose(1, 60, 500)
    totals = []
    for n in (200, 400, 800):
        verified.clear()
        texts = [f"{passage} {prose(1000 + i, 40, 5000)}" for i in range(n)]
        found = {r.doc_id: r.class_id for r in simhash.similar_classes(docs(spark, texts), 5, 0.8).collect()}
        assert found == {i: i for i in range(n)}
        totals.append(sum(verified))
        assert totals[-1] <= 24 * n
    assert totals[2] <= 2.5 * totals[1] <= 6.25 * totals[0]


def test_copies_of_a_template_that_are_apart_do_not_pair_up(spark, verified):
    """Every pair is at a similarity of about 0.7, but for twins, which are found."""
    base = prose(7, 120, 4000)
    totals = []
    for n in (150, 300, 600):
        verified.clear()
        texts = [replaced(base, 4, f"t{i}") for i in range(n)]  # the same places, other words
        twins = [replaced(t, 1, "z") for t in texts[:10]]
        assert 0.6 < jaccard(texts[0], texts[1]) < 0.8 <= min(map(jaccard, texts, twins))
        found = {r.doc_id: r.class_id for r in simhash.similar_classes(docs(spark, texts + twins), 5, 0.8).collect()}
        assert found == {**{i: i for i in range(n)}, **{n + i: i for i in range(10)}}
        totals.append(sum(verified))
    assert totals[2] <= 3 * totals[1] <= 9 * totals[0]


@pytest.mark.parametrize("sparse", [4, 8])
def test_groups_in_one_bucket_equal_brute_force(spark, monkeypatch, sparse):
    monkeypatch.setattr(simhash, "SPARSE", sparse)
    rng = random.Random(4)
    passage, texts = prose(2, 70, 400), []
    for group in range(12):
        base = f"{passage} {prose(50 + group, 30, 4000)}"
        texts += [replaced(base, rng.randrange(0, 4), f"g{group}m{i}") for i in range(rng.randrange(1, 9))]
    rng.shuffle(texts)
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = components_of(range(len(texts)), links)
    assert len(set(want.values())) > 10
    found = {r.doc_id: r.class_id for r in simhash.similar_classes(docs(spark, texts), 5, 0.8).collect()}
    assert found == want


@pytest.mark.parametrize("sparse", [1, 2, 8])
def test_texts_made_of_the_same_frequent_passages_equal_brute_force(spark, monkeypatch, sparse):
    """No text has shingles of its own, so that all meet by frequent ones: a centre alone would not find every link."""
    monkeypatch.setattr(simhash, "SPARSE", sparse)
    rng = random.Random(11)
    common = prose(3, 60, 900)
    pool = [prose(300 + i, 8, 60) for i in range(14)]
    texts = [" ".join([common, *(pool[i] for i in sorted(rng.sample(range(14), rng.randrange(2, 7))))]) for _ in range(160)]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(texts[i], texts[j]) >= 0.8]
    want = components_of(range(len(texts)), links)
    assert 3 < len(set(want.values())) < len(texts)
    found = {r.doc_id: r.class_id for r in simhash.similar_classes(docs(spark, texts), 5, 0.8).collect()}
    assert found == want


def test_rows_without_an_id_link_others(spark):
    base = prose(9, 200, 3000)
    near = [replaced(base, 2, "x"), replaced(base, 2, "y")]
    table = docs(spark, [near[0], base, near[1], base], ids=[7, None, 3, None])
    found = sorted((r.doc_id is None, r.doc_id or 0, r.class_id) for r in simhash.similar_classes(table, 5, 0.8).collect())
    assert found == [(False, 3, 3), (False, 7, 3), (True, 0, 3), (True, 0, 3)]


def test_turns_look_at_new_links_only(spark, monkeypatch):
    """The edges whose components are sought: each link once, not all links again after each turn."""
    monkeypatch.setattr(simhash, "SPARSE", 2)
    edges, links, components, apart = [], [], simhash.components, simhash.apart_links

    def seen(df):
        edges.append(df.count())
        return components(df)

    def kept(*given):
        links.append(apart(*given))
        return links[0]

    monkeypatch.setattr(simhash, "components", seen)
    monkeypatch.setattr(simhash, "apart_links", kept)
    base = prose(7, 120, 4000)
    texts = [replaced(base, 4, f"t{i}") for i in range(100)]
    simhash.similar_classes(docs(spark, texts + [replaced(t, 1, "z") for t in texts[:20]]), 5, 0.8).count()
    assert len(edges) >= 2 and edges[0] > 0 and sum(edges) <= links[0].count()
