"""The registered queries against their SQL, and those without SQL against plain code, on the smallest tables."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brickledger.llm.queries import ORACLE, QUERIES
from tests.llm.test_operators import components_of, plain_fingerprint
from verification.compare import compare

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.mark.parametrize("key", sorted(ORACLE))
def test_query_agrees_with_sql(spark, key):
    assert compare(spark, SMALL, key) == ""


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    counts = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}
    found = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op5_token_counts"](spark, SMALL).collect()}
    assert found == {i: (len(t.encode()), counts[i], counts[i] > 512) for i, t in texts.items()}


def test_simhash(spark, texts):
    marks = {i: plain_fingerprint(t) for i, t in texts.items()}
    ids = sorted(marks)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (marks[a] ^ marks[b]).bit_count() <= 3]
    want = components_of(ids, links)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in QUERIES["op6_simhash"](spark, SMALL).collect()}
    assert found == {i: (f"{marks[i]:016x}", want[i]) for i in ids}


def test_packing(spark, texts):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = QUERIES["op10_packing"](spark, SMALL).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) and {r.offset for r in rows} == {0}
    done = dict.fromkeys(texts, 0)
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = np.array([*library.encode(texts[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert r.doc_tokens == len(ids) and r.start == done[r.doc_id]
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.length.bit_count() == 1
        done[r.doc_id] += r.length
        if done[r.doc_id] == len(ids):
            done[r.doc_id] = -1
    assert set(done.values()) == {-1}


def test_quality_rejects_poor_and_toxic_documents(spark):
    directory = "/root/testdata/sf0.01"
    rated = spark.read.parquet(f"{directory}/labels.parquet")
    rows = QUERIES["op3_quality"](spark, directory).join(rated, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r.kept for r in rows if r.quality == 0 or r.toxic == 1]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)
