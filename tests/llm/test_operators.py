"""The ten operators against brute force and on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brickledger.llm import line_dedup, mixing, packing, quality, simhash, substring_dedup, token_counts, topk, urls, vector_dedup
from brickledger.llm.encoding import PieceEncoder
from brickledger.llm.shared import components, new_path

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, row string, key string, text_ string, tokens string"
ODD = [None, "", " ", "\n\n", "one", "one two", "a  b\tc\n\x0b d", "É É é ßẞ", "x\x00y", "<|endoftext|> <|startoftext|> a", "\x1c\x85\xa0 q"]


def docs(spark, texts, ids=None, source="s"):
    rows = [(i, t, source, "clash", "clash", "clash", "clash") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    return " ".join(rng.choices(vocabulary, k=n))


def components_of(nodes, links):
    least = {n: n for n in nodes}

    def root(n):
        while least[n] != n:
            n = least[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        least[b] = a
    return {n: root(n) for n in nodes}


# --- shared ----------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(200)]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = components_of({n for link in links for n in link}, links)
    groups = defaultdict(set)
    for node, root in found.items():
        groups[root].add(node)
    expected = defaultdict(set)
    for node, root in want.items():
        expected[root].add(node)
    loops = {a for a, b in links if a == b}
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in expected.values() if len(g) > 1 or not g <= loops)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- 1 mixing --------------------------------------------------------------------------------------


def test_solve_mix():
    tokens = [1000, 100, 10]
    assert mixing.solve_mix(tokens, 1110, target_entropy=math.log(3)).exponent == pytest.approx(0, abs=1e-6)
    natural = mixing.solve_mix(tokens, 1110, repetition_limit=1.0)
    assert natural.exponent == pytest.approx(1) and natural.weights == pytest.approx([t / 1110 for t in tokens])
    twice = mixing.solve_mix(tokens, repetition_limit=2.0)
    passes = [w * twice.budget / t for w, t in zip(twice.weights, tokens)]
    assert min(passes) == pytest.approx(1, rel=1e-3) and max(passes) == pytest.approx(2, rel=1e-3)
    half = mixing.solve_mix(tokens, 500, target_entropy=0.8)
    assert -sum(w * math.log(w) for w in half.weights) == pytest.approx(0.8, abs=1e-6) and half.budget == 500
    assert mixing.solve_mix([0, 0], repetition_limit=2.0).budget == 0
    with pytest.raises(ValueError):
        mixing.solve_mix(tokens)


@pytest.mark.parametrize("budget", [None, 700, 4000])
def test_mix_keeps_quotas(spark, budget):
    rng = random.Random(3)
    rows = [(i, prose(i, rng.randrange(0, 30), 50), "abc"[min(2, i % 7)]) for i in range(300)] + [(900, None, None), (None, "x y", "a")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, source string, epoch string")
    found = mixing.mix_sources(table, budget, repetition_limit=3.0).select("row.doc_id", "source", "epoch", "n_tokens", "order_key", "position").collect()
    tokens = Counter()
    for _, text, source in rows:
        tokens["null" if source is None else "=" + source] += len(WORDS.findall(text or ""))
    names = sorted(tokens)
    mix = mixing.solve_mix([tokens[n] for n in names], budget, repetition_limit=3.0)
    for name, weight in zip(names, mix.weights):
        own = [r for r in found if r.source == name]
        if not tokens[name]:
            assert {r.epoch for r in own} == {0}
            continue
        whole, partial = divmod(round(weight * mix.budget), tokens[name])
        per_epoch = Counter()
        for r in own:
            per_epoch[r.epoch] += r.n_tokens
        assert all(per_epoch[e] == tokens[name] for e in range(whole)), name
        assert per_epoch[whole] <= partial < per_epoch[whole] + 30 + 1
        last = sorted((r.order_key for r in own if r.epoch == whole))
        first = {r.doc_id: r.order_key for r in own if r.epoch == whole}
        assert len(last) == len(first)
    assert mixing.mix_sources(table.limit(0), budget, repetition_limit=3.0).collect() == []


# --- 2 top-k ---------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = {i: rng.normal(size=8).round(1).tolist() for i in range(400)}
    for i in range(50, 90):
        vectors[i] = vectors[50]
    vectors |= {500: None, 501: [1.0, float("nan")] * 4, 502: [float("inf")] * 8, 503: [1.0] * 3, 504: [2.0] * 3, 505: [1.0, None] * 4}
    table = spark.createDataFrame([(i, v, "clash") for i, v in vectors.items()], "vec_id long, embedding array<double>, score string")
    found = defaultdict(list)
    asked = table.where("vec_id % 20 = 0 or vec_id = 503")
    for r in topk.search(table, asked, shard_rows=64, query_rows=8, k=20).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
        assert r.rank == len(found[r.query_id])
    good = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in [i for i in good if i % 20 == 0 or i == 503]:
        scores = [(-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q and len(v) == len(good[q])]
        assert found[q] == [(i, -s) for s, i in sorted(scores)[:20]]
    assert set(found) <= set(good)
    assert topk.search(table.limit(0), table.limit(0)).collect() == []


def test_topk_of_large_numbers(spark):
    table = spark.createDataFrame([(i, [1e7 * i, 3e7 - i]) for i in range(30)], "vec_id long, embedding array<double>")
    found = topk.search(table, table.where("vec_id = 0"), k=3).orderBy("rank").collect()
    exact = [(int(64e7 * i), math.floor(64 * (3e7 - i))) for i in range(30)]
    scores = sorted((-sum(a * b for a, b in zip(exact[0], exact[i])), i) for i in range(1, 30))[:3]
    assert [(r.vec_id, r.score) for r in found] == [(i, -s) for s, i in scores]


# --- 3 quality -------------------------------------------------------------------------------------


def test_quality_on_held_out_rows(spark):
    directory = "/root/testdata/sf0.1"
    table = spark.read.parquet(f"{directory}/documents.parquet").select("doc_id", "text")
    ratings = spark.read.parquet(f"{directory}/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(3)) == 0
    model = quality.train(table, ratings.where(~held), quality.label_grade(), quality.GRADES)
    graded = quality.grade_documents(table, model).select("row.doc_id", "kept", "expected_grade", "p_top")
    rows = graded.join(ratings.where(held), "doc_id").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0)).collect()
    good, bad = [r for r in rows if r.good], [r for r in rows if not r.good]
    assert sum(r.kept for r in good) >= 0.97 * len(good)
    assert sum(not r.kept for r in bad) >= 0.9 * len(bad)
    assert all(0 <= r.p_top <= r.expected_grade <= 2 for r in rows)


def test_quality_of_odd_rows(spark):
    table = docs(spark, [*ODD, "so bad", "so good"] * 2, [None, *range(25)])
    ratings = spark.createDataFrame([(11, 0), (12, 1), (99, 1), (None, 1), (5, None)], "doc_id long, grade int")
    for some in (ratings, ratings.limit(0)):
        model = quality.train(table, some, F.col("grade"), 2)
        graded = quality.grade_documents(table, model)
        assert graded.count() == 26 and graded.where("kept is null").count() == 0
        assert graded.select("row.*").columns == table.columns
    assert quality.grade_documents(table.limit(0), model).collect() == []


# --- 4 vectors -------------------------------------------------------------------------------------


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(300, 16))
    near = base[rng.integers(0, 300, 300)] + rng.normal(size=(300, 16)) * 0.32
    vectors = [*base.tolist(), *near.tolist(), *[base[0].tolist()] * 20, (2 * base[0]).tolist()]
    odd = [None, [], [0.0] * 16, [1.0, None], [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0], [1.0, 0.1], [-0.0, 1.0], [0.0, 1.0]]
    table = list(enumerate(vectors + odd)) + [(5, vectors[5])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in table], "vec_id long, embedding array<double>, digest string")
    found = vector_dedup.near_duplicates(frame).collect()
    usable = [(k, np.array(v)) for k, (_, v) in enumerate(table) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = [
        (j, k) for n, (j, a) in enumerate(usable) for k, b in usable[n + 1 :]
        if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9
    ]
    degree = Counter(x for link in links for x in link)
    ids = [i for i, _ in table]
    classes = components_of(set(ids), [(ids[a], ids[b]) for a, b in links])
    total = sum(degree.values())
    assert len(found) == len(table)
    assert sum(r.n_links for r in found) == total
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in found) == sorted((ids[k], degree[k], classes[ids[k]]) for k in range(len(ids)))
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)
    assert vector_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_vector_links_of_a_skewed_spectrum(spark):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(3000, 32)) / np.arange(1, 33) ** 1.5
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=x.shape) / np.arange(1, 33) ** 1.5
    away -= (away * x).sum(1)[:, None] * x
    away /= np.linalg.norm(away, axis=1)[:, None]
    near = 0.902 * x + np.sqrt(1 - 0.902**2) * away
    both = np.concatenate([x, near])
    frame = spark.createDataFrame(list(enumerate(both.tolist())), "vec_id long, embedding array<double>")
    cosine = both @ both.T
    assert np.abs(cosine - 0.9).min() > 1e-12
    want = (cosine >= 0.9).sum(1) - 1
    found = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(frame).collect()}
    assert [found[i] for i in range(len(both))] == want.tolist()


def test_vector_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = table.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = int((x @ x.T >= 0.9).sum()) - len(x)
    found = sum(r.n_links for r in vector_dedup.near_duplicates(table).collect())
    assert found == want


# --- 5 and 10 tokens -------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_the_library(name):
    rng = random.Random(2)
    parts = [" ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "a", "B", "'s", "'ll", "é", "é", "Σ", "9", "²", ".", "!!",
             "<|endoftext|>", "<|startoftext|>", "世界", "​", "\r\n", "\x0b", "İ", "ĳ", "ﬁ", "\x00", "🙂", "Straße", "ºC", "_"]
    texts = [t or "" for t in ODD] + ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(4000)] + [prose(1, 5000, 900)]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    ids = PieceEncoder(public_tokenizers.path(name), False)
    assert [np.frombuffer(b"".join(v), "<u4").tolist() for v in ids.pieces(texts)] == want
    assert [sum(v) for v in PieceEncoder(public_tokenizers.path(name), True).pieces(texts)] == list(map(len, want))


def test_token_counts_and_cache(spark):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), new_path(spark)
    texts = [*ODD, *ODD, prose(2, 30000, 300), "new"]
    table = docs(spark, texts, [None, None, *range(len(texts) - 2)])
    library = Tokenizer.from_file(path)
    want = Counter((t, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    for part in (table.where("text is null or text <> 'new'"), table, table):
        found = token_counts.count_tokens(part, path, cache).select("row.text", "n_bytes", "n_tokens").collect()
        assert Counter(map(tuple, found)) == want - (Counter() if part is table else Counter({k: 1 for k in want if k[0] == "new"}))
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for t in texts})
    assert token_counts.count_tokens(table.limit(0), path, cache).collect() == []


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [*ODD, prose(3, 6000, 500), prose(4, 2047, 5)]
    table = docs(spark, texts, [None, *range(len(texts) - 2), 3])
    library = Tokenizer.from_file(path)
    want = Counter(tuple([*library.encode(t or "", add_special_tokens=False).ids, 1]) for t in texts)
    rows = packing.pack_documents(table.repartition(3), path).orderBy("sequence_id").collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    found, current = Counter(), []
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.length == len(ids) == r.bucket <= 2048 and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.start == len(current) and r.ids_crc32 == zlib.crc32(r.ids)
        current += ids
        if len(current) == r.doc_tokens:
            found[tuple(current)] += 1
            current = []
    assert found == want and not current
    assert packing.cuts(5000, 2048) == [(0, 2048), (2048, 2048), (4096, 512), (4608, 256), (4864, 128), (4992, 8)]
    folder = new_path(spark)
    packing.write_buckets(packing.pack_documents(table, path), folder)
    assert spark.read.parquet(folder).where("bucket = 1").count() == sum(r.bucket == 1 for r in rows)
    assert packing.pack_documents(table.limit(0), path).collect() == []


# --- 6 SimHash -------------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    for text in [*ODD, prose(5, 40, 9), "A B c d", prose(6, 70000, 1000)]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links_equal_brute_force(spark, radius):
    rng = random.Random(radius)
    marks = {rng.getrandbits(64) for _ in range(30)}
    for mark in list(marks):
        for _ in range(8):
            for bit in rng.sample(range(64), rng.randrange(1, 4)):
                mark ^= 1 << bit
            marks.add(mark)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    table = spark.createDataFrame([(signed(m),) for m in marks], "fp long")
    found = {tuple(sorted((r.a, r.b))) for r in simhash.fingerprint_links(table, radius).collect()}
    ordered = sorted(marks)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(ordered) for b in ordered[i + 1 :] if (a ^ b).bit_count() <= radius}
    assert found == want


def test_near_duplicates(spark):
    base = [prose(i, 60, 400) for i in range(20)]
    texts = [*ODD, *base, *[b + " tail" for b in base], *base[:5], prose(99, 3000, 400)]
    table = docs(spark, texts)
    found = {r.doc_id: (r.fp % (1 << 64), r.class_id) for r in simhash.near_duplicates(table).collect()}
    marks = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    links = [(i, j) for i in marks for j in marks if i < j and (marks[i] ^ marks[j]).bit_count() <= 3]
    want = components_of(marks, links)
    assert found == {i: (marks[i], want[i]) for i in marks}
    kept = simhash.keep_one_of_each(table)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == table.columns
    nulls = docs(spark, ["a b c d", "a b c d", "other words here now"], [None, 3, None]).union(docs(spark, ["a b c d"], [3]))
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_each(nulls).collect()) == ["3", "None", "None"]
    assert simhash.near_duplicates(table.limit(0)).collect() == []


def replaced(text, n, seed):
    """The text with n of its words, spread evenly, replaced by new ones."""
    words = text.split()
    for k in range(n):
        words[(2 * k + 1) * len(words) // (2 * n)] = f"new{seed}x{k}"
    return " ".join(words)


def jaccard(x, y, n=5):
    x, y = ({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} for w in (x.lower().split(), y.lower().split()))
    return len(x & y) / len(x | y)


def test_similar_classes_equal_brute_force(spark):
    texts = [t for t in ODD if t is None or t.isascii()]
    for i in range(60):
        base = prose(i, [40, 60, 200, 400][i % 4], 3000)
        texts += [base, *[replaced(base, n, f"{i}y{n}") for n in (1, 2, 4, 7)], base.upper()]
    # A chain: neighbours are similar, its ends are not.
    for n in range(12):
        texts.append(replaced(prose(77, 300, 3000), 3 * n, "chain") if n else prose(77, 300, 3000))
    none = [i for i, t in enumerate(texts) if not (t or "").split()]
    sound = [i for i in range(len(texts)) if i not in none]
    links = [(none[0], i) for i in none] + [(i, j) for i in sound for j in sound if i < j and jaccard(texts[i], texts[j]) >= 0.8]
    want = components_of(range(len(texts)), links)
    table = docs(spark, texts)
    assert {r.doc_id: r.class_id for r in simhash.similar_classes(table, 5, 0.8).collect()} == want
    kept = simhash.keep_one_of_similar(table, 5, 0.8)
    assert {r.doc_id for r in kept.collect()} == set(want.values()) and kept.columns == table.columns
    nulls = docs(spark, ["a b c d", "a b c d", "other words here now"], [None, 3, None]).union(docs(spark, ["a b c d"], [3]))
    assert sorted(str(r.doc_id) for r in simhash.keep_one_of_similar(nulls, 5, 0.8).collect()) == ["3", "None", "None"]
    assert simhash.similar_classes(table.limit(0), 5, 0.8).collect() == []


def test_shingle_of_near_duplicates(spark):
    texts = [prose(i, 30, 400) for i in range(5)]
    found = {r.doc_id: r.fp % (1 << 64) for r in simhash.near_duplicates(docs(spark, texts), shingle=5).collect()}
    assert found == {i: simhash.fingerprint(t, 5) for i, t in enumerate(texts)}


# --- 7 lines ---------------------------------------------------------------------------------------


def plain_lines(rows):
    """What stays of (id, text) rows of different ids, by the rule of remove_repeated_lines."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = (text or "").split("\n")
        full = [k for k, line in enumerate(lines) if line.strip(" \t\r\x0b\x0c")]
        gone = set()
        for k in range(len(full) - 2):
            window = tuple(lines[p].strip(" \t\r\x0b\x0c") for p in full[k : k + 3])
            if window in seen:
                gone |= set(full[k : k + 3])
            seen.add(window)
        out[i] = (0 if text is None else len(lines), len(gone), text and "\n".join(x for k, x in enumerate(lines) if k not in gone))
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["\n".join(rng.choices(["a", "b ", " c", "", "d", "e", "f"], k=rng.randrange(12))) for _ in range(300)]
    texts += ["\n".join(str(k % 5) for k in range(3000)), None, "", "\n\n\n"]
    table = docs(spark, texts)
    found = {r.doc_id: (r.n_lines, r.n_removed, r.kept_text) for r in line_dedup.remove_repeated_lines(table).select("row.doc_id", "n_lines", "n_removed", "kept_text").collect()}
    assert found == plain_lines(list(enumerate(texts)))
    twice = docs(spark, ["x\ny\nz", "x\ny\nz", "x\ny\nz"], [1, 1, None])
    assert sorted(r.n_removed for r in line_dedup.remove_repeated_lines(twice).collect()) == [0, 3, 3]
    assert line_dedup.remove_repeated_lines(table.limit(0)).collect() == []


# --- 8 urls ----------------------------------------------------------------------------------------


def test_urls(spark):
    cases = {
        None: ("", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "http://A.Example.NET/en/x?casino": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.net": ("example.net", "", None, "allow"),
        "http://example.net/fr": ("example.net", "/fr", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://x.example.com/de/": ("x.example.com", "/de/", "example.com/de/", "block"),
        "http://a.org/fr/#/en": ("a.org", "/fr/", "org/fr/", "allow"),
        "http://a.org#/fr/": ("a.org", "", None, "allow"),
        "https://my-CASINO.test/": ("my-casino.test", "/", None, "block"),
        "https://mycasino.test/": ("mycasino.test", "/", None, "allow"),
        "https://ads.test/ads": ("ads.test", "/ads", None, "allow"),
        "https://ads.test/track": ("ads.test", "/track", None, "block"),
    }
    table = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, host string")
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(table).collect()}
    assert found == dict(enumerate(cases.values()))
    assert urls.judge_urls(table.limit(0)).collect() == []
    assert [r.verdict for r in urls.judge_urls(table, rules={}, strict=[], soft=[]).collect()] == ["allow"] * len(cases)


# --- 9 passages ------------------------------------------------------------------------------------


def plain_passages(texts, window):
    words = [WORDS.findall(t or "") for t in texts]
    starts = defaultdict(list)
    for d, own in enumerate(words):
        for i in range(len(own) - window + 1):
            starts[tuple(own[i : i + window])].append((d, i))
    gone = defaultdict(set)
    for places in starts.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + window))
    return [(len(w), len(gone[d]), " ".join(x for i, x in enumerate(w) if i not in gone[d])) for d, w in enumerate(words)]


@pytest.mark.parametrize("window", [3, 20, 35])
def test_passages_equal_brute_force(spark, window):
    rng = random.Random(window)
    shared = [prose(i, 90, 5000).split() for i in range(6)]
    texts = [*ODD, "a " * 200, prose(77, 40, 3)]
    for i in range(60):
        words = prose(1000 + i, rng.randrange(0, 160), 5000).split()
        cut = rng.randrange(0, 91)
        at = rng.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + rng.choice(shared)[cut : cut + rng.randrange(91)] + words[at:]))
    texts.append(texts[20])
    table = docs(spark, texts)
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.remove_repeated_passages(table, window).collect()}
    assert found == dict(enumerate(plain_passages(texts, window)))
    repeated = docs(spark, [texts[20], texts[20], None], [1, 1, None])
    assert sorted(r.n_words - r.n_removed for r in substring_dedup.remove_repeated_passages(repeated, 3).collect())[0] == 0
    assert substring_dedup.remove_repeated_passages(table.limit(0), window).collect() == []


def test_covers_meet_at_every_shift():
    for period, cover in substring_dedup.COVERS.items():
        for i in range(period):
            for j in range(period):
                assert any((i + s) % period in cover and (j + s) % period in cover for s in range(period))
