"""The prefix trie against plain prefixes, with shards small enough that nodes span many and rounds repeat."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from brickledger.llm.prefix_trie import TernaryTree, conversation_trie, digests_of_ids, median_order

SCHEMA = "conv_id long, turn long, role string, text string, depth string, n string, id string"


def table(spark, rows):
    return spark.createDataFrame([(*row, "clash", "clash", "clash") for row in rows], SCHEMA)


def plain_trie(rows):
    """{(conv_id, depth): the other columns}"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (c % 5 if c >= 0 else -(-c % 5))
        whole[c] = own[c] if source == c else own.get(source, [])[:h] + own[c][h:]
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    sums = {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[node]]
        won = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        sums[node] = (sum(b[0] for b in below) or 1, won + sum(b[1] for b in below))
    found = {}
    for node, some in members.items():
        ends = ",".join(str(c) for c in sorted(some) if len(whole[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        found[min(some), len(node)] = (parent, len(some), len(children[node]), *sums[node], hashlib.sha256(ends.encode()).hexdigest())
    return found


def check(spark, rows, **sizes):
    found = conversation_trie(table(spark, rows), **sizes).collect()
    want = plain_trie(rows)
    got = {
        (r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found
    }
    assert len(found) == len(got) and got == want


def some_conversations(seed, n, words, longest):
    rng = random.Random(seed)
    return [
        (c, t if rng.random() < 0.95 else None, rng.choice(["user", None]), rng.choice(words))
        for c in rng.sample(range(-n, 2 * n), n)
        for t in range(rng.randrange(1, longest))
    ]


@pytest.mark.parametrize("shard_turns", [3, 40, 10_000])
def test_random_conversations(spark, shard_turns):
    check(spark, some_conversations(shard_turns, 150, ["a", "b", "é", "", None, "long text"], 9), shard_turns=shard_turns, chunk_ids=3)


def test_hot_first_turn_and_a_common_conversation(spark):
    rows = []
    for c in range(0, 600, 3):
        turns = ["hello", "how", "are", "you"] if c % 2 else ["hello", f"own {c % 7}", f"rest {c}", "same", f"{c}"]
        rows += [(c, t, "user", text) for t, text in enumerate(turns)]
    check(spark, rows, shard_turns=16, chunk_ids=4)


def test_one_long_conversation_and_its_copy(spark):
    long = [(c, t, "user", f"{t % 3} {t // 50}") for c in (0, 10, 25) for t in range(400)]
    check(spark, [*long, (30, 0, "user", "0 0"), (30, 1, "user", "1 0")], shard_turns=8)


def test_odd_rows(spark):
    rows = [
        (None, 1, "a", "b"), (5, None, None, None), (5, None, "", ""), (5, 1, "a", "b"), (5, 1, "a", "b"), (6, 0, "x", "y"),
        (7, 0, "a", ""), (7, 0, "", "a"), (11, 3, "q", "r"), (0, 2, "a", "b"), (0, 2, "b", "a"), (2**63 - 1, 0, "a", "b"), (-3, 1, "a", "b"),
    ]
    check(spark, rows)
    check(spark, rows, shard_turns=1)
    check(spark, [(8, 0, "a", "b")])  # its own turns all fall away: a root without turns
    assert conversation_trie(table(spark, [])).collect() == []
    assert conversation_trie(table(spark, [(None, 1, "a", "b")])).collect() == []


def test_median_insertion_is_balanced():
    assert sorted(median_order(1000)) == list(range(1000))
    tree = TernaryTree()
    for i in median_order(1023):
        tree.insert([i], [1])
    deepest, waiting = 0, [(tree.equal[0], 1)]
    while waiting:
        node, depth = waiting.pop()
        if node >= 0:
            deepest = max(deepest, depth)
            waiting += [(tree.low[node], depth + 1), (tree.high[node], depth + 1)]
    assert deepest == 10


def test_digest_of_a_hot_group_is_joined_in_all_tasks(spark):
    members = spark.range(0, 20_000, 1, 8).selectExpr("CASE WHEN id % 10 = 0 THEN unhex('00') ELSE unhex('01') END AS mark", "id AS conv_id")
    found = {bytes(r.mark): r.ends_sha256 for r in digests_of_ids(members, 64).collect()}
    want = lambda some: hashlib.sha256(",".join(map(str, some)).encode()).hexdigest()
    assert found == {b"\0": want(range(0, 20_000, 10)), b"\1": want(i for i in range(20_000) if i % 10)}
