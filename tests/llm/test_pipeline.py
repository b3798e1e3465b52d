"""The pipeline against its stages' plain rules."""

import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
import public_tokenizers
from brickledger.llm import mixing, quality, simhash
from tests.llm.test_operators import components_of, jaccard, plain_lines, prose, replaced

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, row string"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(8)
    texts, grades = [], []
    for i in range(240):
        words = prose(i, rng.randrange(20, 60), 300).split()
        lines = [" ".join(words[k : k + 5]) for k in range(0, len(words), 5)]
        if i % 6 == 1:
            lines[1:1] = ["same one", "same two", "same three"]
        if i % 8 == 3:
            lines.append("you utter scoundrel")
        texts.append("\n".join(lines))
        grades.append((i, 1, int(i % 8 == 3)))
    texts += [texts[0], texts[2] + " x", texts[4], "", None, None]
    rows = [(i, t, "en", "ab"[i % 3 == 0], len(t or ""), "clash") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(grades, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages_follow_each_other(spark, tables):
    folder, rows = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(pipeline.STAGES)
    assert len(stages) == 5

    kept = stages["quality classifier"](spark, docs, folder).cache()
    model = quality.trained_on_labels(spark, docs, folder)
    known = quality._Known(frozenset(model.weights))
    scores = np.array([sum(model.weights[f] for f in sorted(quality.features(r[1], known))) for r in rows])
    good = {r[0] for r, p in zip(rows, model.tails(scores)[:, -1]) if p >= quality.KEEP and r[1]}
    assert {r.doc_id for r in kept.collect()} == good
    assert {i for i in range(240) if i % 8 != 3} <= good and not good & {i for i in range(240) if i % 8 == 3}
    assert kept.columns == docs.columns

    lined = stages["line dedup"](spark, kept, folder).cache()
    want = plain_lines([(r.doc_id, r.text) for r in kept.collect() if r.text is not None])
    found = {r.doc_id: r for r in lined.collect()}
    assert {i: r.text for i, r in found.items() if r.text is not None} == {i: t for i, (_, _, t) in want.items()}
    assert all(r.n_chars == len(r.text or "") for r in found.values()) and lined.columns == docs.columns

    one = stages["SimHash near-dedup"](spark, lined, folder).cache()
    texts = {i: r.text or "" for i, r in found.items()}
    links = [(i, j) for i in texts for j in texts if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    assert {r.doc_id for r in one.collect()} == set(components_of(texts, links).values()) and one.columns == docs.columns

    mixed = stages["mixing sources to target weights"](spark, one, folder).cache()
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) == {r.doc_id for r in one.collect()} and max(times.values()) <= 2 and mixed.columns == docs.columns

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages["packing"](spark, mixed, folder).collect()
    want = Counter()
    for r in mixed.collect():
        want[r.doc_id] += len(library.encode(r.text or "", add_special_tokens=False).ids) + 1
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.length
    assert got == want


def test_near_dedup_stage_finds_copies_of_similarity_0_8(spark):
    base = [prose(1000 + i, 200, 3000) for i in range(100)]
    near = [replaced(t, 4, f"z{i}") for i, t in enumerate(base)]
    assert all(0.8 <= jaccard(a, b) < 0.85 for a, b in zip(base, near))
    rows = [(i, t, "en", "a", len(t), "clash") for i, t in enumerate(base + near)]
    kept = dict(pipeline.STAGES)["SimHash near-dedup"](spark, spark.createDataFrame(rows, COLUMNS), "")
    assert {r.doc_id for r in kept.collect()} == set(range(100))


def test_mixing_stage_keeps_the_order_of_the_mix(spark):
    rows = [(i, prose(i, 20, 100), "en", "abc"[min(2, i % 7)], 9, "clash") for i in range(200)]
    table = spark.createDataFrame(rows, COLUMNS)
    mixed = mixing.mix_sources(table, repetition_limit=mixing.REPETITION_LIMIT).orderBy("position", "order_key")
    stage = dict(pipeline.STAGES)["mixing sources to target weights"]
    assert [r.doc_id for r in stage(spark, table, "").collect()] == [r.doc_id for r in mixed.select("row.doc_id").collect()]


def test_run_gives_the_last_stage(spark, tables):
    folder, _ = tables
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = Counter(map(tuple, pipeline.run(spark, folder).select(*columns).collect()))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert found == Counter(map(tuple, docs.select(*columns).collect()))


def test_run_on_empty_tables(spark, tables, tmp_path):
    folder, _ = tables
    for name in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []


def test_near_dedup_stage_links_by_fingerprints_and_by_shingles(spark):
    """Texts whose fingerprints are near and whose sets of shingles are not; rows without an id join what they link."""
    cycle = "one two three four five six seven " * 60
    far = [cycle + prose(70, 9, 5000), cycle + prose(71, 9, 5000)]
    assert jaccard(*far) < 0.8 and (simhash.fingerprint(far[0], 5) ^ simhash.fingerprint(far[1], 5)).bit_count() <= 3
    base = prose(72, 200, 3000)
    texts = [*far, prose(73, 100, 3000), base, replaced(base, 4, "z"), far[0]]
    rows = [(i, t, "en", "a", len(t), "clash") for i, t in zip([4, 2, 7, 5, 6, None], texts)]
    stage = dict(pipeline.STAGES)["SimHash near-dedup"]
    kept = stage(spark, spark.createDataFrame(rows, COLUMNS), "")
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["2", "5", "7", "None"]
    assert sorted(r.doc_id for r in stage(spark, spark.createDataFrame(rows[:5], COLUMNS), "").collect()) == [2, 5, 7]
