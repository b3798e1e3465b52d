"""Prefix trie of conversations: ternary search trees over turn ids per range shard, boundary nodes merged in rounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brickledger.llm.shared import written

#: About so many turns make a shard; bounds the memory of a task, as does the longest conversation's shared part.
SHARD_TURNS = 16_384
#: So many ids of conversations are joined to one row before a node's digest is taken.
CHUNK_IDS = 8192

_CARRY = "array<struct<depth:int,n:bigint,first:bigint,children:bigint,leaves:bigint,saved:bigint,mark:binary>>"
_ITEM = f"ids array<bigint>, bytes array<bigint>, carry {_CARRY}"
_NODE = (
    "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
    "mark binary, key binary, parent_key binary"
)


class TernaryTree:
    """A ternary search tree of id sequences; node 0 is the root, every other node one prefix, made after its parent."""

    def __init__(self):
        self.key, self.low, self.equal, self.high = [0], [-1], [-1], [-1]
        self.parent, self.depth, self.weight = [-1], [0], [0]

    def _new(self, key: int, parent: int, weight: int) -> int:
        self.key.append(key)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.weight.append(weight)
        for link in (self.low, self.equal, self.high):
            link.append(-1)
        return len(self.key) - 1

    def insert(self, ids: list[int], weights: list[int]) -> list[int]:
        """The nodes of the sequence's prefixes, the root first."""
        path = [0]
        for one, weight in zip(ids, weights, strict=True):
            above = path[-1]
            node = self.equal[above]
            if node < 0:
                node = self.equal[above] = self._new(one, above, weight)
            while self.key[node] != one:
                side = self.low if one < self.key[node] else self.high
                if side[node] < 0:
                    side[node] = self._new(one, above, weight)
                node = side[node]
            path.append(node)
        return path


def median_order(n: int) -> Iterator[int]:
    """0 .. n-1, the median of each range before its halves: sorted keys so inserted make balanced trees."""
    waiting = [(0, n)]
    while waiting:
        start, end = waiting.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            waiting += [(middle + 1, end), (start, middle)]


def _prefix_keys(ids: list[int]) -> Iterator[bytes]:
    """A digest of each prefix, the empty one first."""
    digest = hashlib.sha256()
    yield digest.digest()
    for one in ids:
        digest.update(one.to_bytes(8, "little", signed=True))
        yield digest.digest()


def grow_shard(items: list[dict], whole: bool, later: bool = False) -> tuple[list[dict], list[dict]]:
    """(nodes, items): the finished nodes of a shard, and its first and last path with what their nodes have so far.

    The nodes of these two paths may go on in neighbouring shards, so they are handed on, unless the shard is all
    there is (`whole`).  A node that was handed on before (`later`) has a key, by which its finished children know it.
    An item is a path with, at some depths, members, children, leaves and savings of finished
    subtrees below.
    """
    items = sorted(items, key=lambda item: item["ids"])
    if not items:
        return [], []
    tree, paths = TernaryTree(), [[]] * len(items)
    for i in median_order(len(items)):
        paths[i] = tree.insert(items[i]["ids"], items[i]["bytes"])
    size = len(tree.key)
    n, first, children, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    mark: list[bytes | None] = [None] * size

    def add(node: int, some: int, least: int | None, below: int, ends: int, won: int) -> None:
        n[node] += some
        if least is not None and (first[node] is None or least < first[node]):
            first[node] = least
        children[node] += below
        leaves[node] += ends
        saved[node] += won

    for item, path in zip(items, paths, strict=True):
        for c in item["carry"]:
            node = path[c["depth"]]
            add(node, c["n"], c["first"], c["children"], c["leaves"], c["saved"])
            mark[node] = c["mark"] or mark[node]
    handed = [] if whole else list(dict.fromkeys([0, len(items) - 1]))
    open_nodes = {node for i in handed for node in paths[i]}
    for node in range(size - 1, -1, -1):  # children come after their parents, so all of a node's are done here
        if node not in open_nodes:
            leaves[node] = leaves[node] if children[node] else 1
            saved[node] += (n[node] - 1) * tree.weight[node]
            if node:
                add(tree.parent[node], n[node], first[node], 1, leaves[node], saved[node])
    keys = {}
    for i in range(len(items)) if later else handed:
        keys |= zip(paths[i], _prefix_keys(items[i]["ids"]), strict=True)
    nodes = []
    for node in range(size):
        if node not in open_nodes:
            above = tree.parent[node]
            nodes.append(
                {
                    "conv_id": first[node], "depth": tree.depth[node], "n_convs": n[node], "n_children": children[node],
                    "parent_conv_id": first[above] if node and above not in open_nodes else None,
                    "n_leaves": leaves[node], "saved_tokens": saved[node], "mark": mark[node],
                    "key": keys.get(node) if later else None, "parent_key": keys[above] if above in open_nodes else None,
                }
            )
    rest, done = [], set()
    for i in handed:
        carry = []
        for depth, node in enumerate(paths[i]):
            if node not in done:
                done.add(node)
                carry.append(
                    {"depth": depth, "n": n[node], "first": first[node], "children": children[node],
                     "leaves": leaves[node], "saved": saved[node], "mark": mark[node]}
                )
        rest.append({"ids": items[i]["ids"], "bytes": items[i]["bytes"], "carry": carry})
    return nodes, rest


def _round(items: DataFrame, whole: bool, later: bool) -> DataFrame:
    """One tree per partition: rows (node, item), one of both null."""
    schema = f"node struct<{','.join(part.strip().replace(' ', ':') for part in _NODE.split(','))}>, item struct<ids:array<bigint>,bytes:array<bigint>,carry:{_CARRY}>"
    empty = items.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, rest = grow_shard([row for batch in batches for row in batch.to_pylist()], whole, later)
        rows = [{"node": node, "item": None} for node in nodes] + [{"node": None, "item": item} for item in rest]
        for start in range(0, len(rows), 4096):
            yield pa.RecordBatch.from_pylist(rows[start : start + 4096], schema=empty)

    return items.mapInArrow(run, schema)


def prefix_nodes(paths: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The trie's nodes from distinct paths (ids, bytes, n, first, children, leaves, mark); runs its jobs when called.

    Paths go to shards by range, so a prefix shared by any number of paths spans neighbouring shards; each shard's
    tree finishes all nodes but those on its first and last path.  These two are the items of the next round, which
    has at most half as many, until they fit one shard.  `mark` comes back on the path's own node.
    """
    start = F.struct(
        F.size("ids").alias("depth"), "n", "first", F.col("children").cast("long"), F.col("leaves").cast("long"),
        F.lit(0).cast("long").alias("saved"), "mark",
    )
    items = written(paths.select("ids", "bytes", F.array(start).cast(_CARRY).alias("carry")))
    done: list[DataFrame] = []
    while True:
        total = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids") + 1).alias("turns")).first()
        shards = min(-(-(total["turns"] or 0) // shard_turns), max(1, total["n"] // 4))
        # Without a key the number of partitions is as asked for: the last tree must hold all.
        dealt = items.repartition(1) if shards <= 1 else items.repartitionByRange(shards, "ids")
        grown = written(_round(dealt, shards <= 1, bool(done)))
        done.append(grown.where("node IS NOT NULL").select("node.*"))
        if shards <= 1:
            break
        items = grown.where("item IS NOT NULL").select("item.*")
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    if len(done) == 1:
        return nodes.drop("key", "parent_key")
    # Parents that were finished in a later round than their child.
    parents = nodes.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("later"))
    late = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(parents, "parent_key")
    early = nodes.where("parent_key IS NULL").drop("parent_key")
    return early.unionByName(late.withColumnRenamed("later", "parent_conv_id").drop("parent_key")).drop("key")


def digests_of_ids(members: DataFrame, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """(mark, ends_sha256): SHA-256 of each mark's decimal conv_ids, ascending and joined by commas.

    Ranges of (mark, conv_id) join up to `chunk_ids` ids to one row each, in all tasks; then one pass per mark over
    its rows in order feeds the digest, which has no parallel form.  Nothing but a row is held.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            at, out = 0, []
            for i in range(1, len(marks) + 1):
                if i == len(marks) or marks[i] != marks[at] or i - at == chunk_ids:
                    out.append((marks[at], ids[at], ",".join(map(str, ids[at:i]))))
                    at = i
            columns = zip(*out, strict=True) if out else ((), (), ())
            arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["mark", "at", "part"])

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, digest, out = None, None, []
        for batch in batches:
            for one, part in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if one == mark:
                    digest.update(b"," + part.encode())
                    continue
                if digest:
                    out.append((mark, digest.hexdigest()))
                mark, digest = one, hashlib.sha256(part.encode())
            if len(out) >= 4096:
                yield rows(out)
                out = []
        if digest:
            out.append((mark, digest.hexdigest()))
        yield rows(out)

    def rows(out: list[tuple[bytes, str]]) -> pa.RecordBatch:
        arrays = [pa.array([m for m, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["mark", "ends_sha256"])

    ordered = members.select("mark", "conv_id").repartitionByRange("mark", "conv_id").sortWithinPartitions("mark", "conv_id")
    parts = ordered.mapInArrow(joined, "mark binary, at long, part string")
    return parts.repartition("mark").sortWithinPartitions("mark", "at").mapInArrow(digested, "mark binary, ends_sha256 string")


def _turn_digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))


def rebuilt_turns(conversations: DataFrame, spread: int = 5, longest: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns): (conv_id, n) with n rebuilt turns, and (conv_id, depth, digest, bytes) for each of them.

    A conversation c has the first h turns of conversation c - c % spread, then its own after its first h;
    h = crc32(decimal c) % longest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    given = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", _turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "digest"))
    own = written(given.select("conv_id", place.alias("place"), "digest", "bytes"))
    counts = own.groupBy("conv_id").agg(F.max("place").alias("n"))
    whole = F.col("conv_id") % spread == 0
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    heads = counts.where(whole).select(F.col("conv_id").alias("source"), F.col("n").alias("source_n"))
    at = F.col("conv_id") - F.col("conv_id") % spread
    taken = F.least("head", F.coalesce("source_n", F.lit(0)))
    joined = counts.select("conv_id", "n", at.alias("source"), head.alias("head")).join(heads, "source", "left")
    kept = F.when(whole, F.lit(0)).otherwise(F.least("head", "n"))
    convs = joined.select(
        "conv_id", F.when(whole, 0).otherwise(taken).alias("taken"), kept.alias("dropped"),
        (F.col("n") - kept + F.when(whole, 0).otherwise(taken)).alias("n"),
    )
    convs = written(convs)
    moved = own.join(convs.select("conv_id", "taken", "dropped"), "conv_id").where("place > dropped")
    moved = moved.select("conv_id", (F.col("place") - F.col("dropped") + F.col("taken")).alias("depth"), "digest", "bytes")
    # A source's first turns go to the spread - 1 ids after it (before it, if negative; both sides of 0).
    steps = F.array(*[F.lit(s) for s in range(-spread + 1, spread) if s])
    same_side = (F.signum("conv_id") == 0) | (F.signum("conv_id") == F.signum("step"))
    sent = own.where(whole & (F.col("place") < longest)).withColumn("step", F.explode(steps)).where(same_side)
    sent = sent.select(F.try_add("conv_id", F.col("step").cast("long")).alias("conv_id"), F.col("place").alias("depth"), "digest", "bytes")
    borrowed = sent.join(convs.select("conv_id", "taken"), "conv_id").where("depth <= taken").drop("taken")
    return convs.select("conv_id", "n"), moved.unionByName(borrowed)


def conversation_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """One row per distinct sequence of first turns of the rebuilt conversations; see rebuilt_turns.

    Turns of more than one conversation get dictionary ids.  A conversation's path ends before its first turn that no
    other has: what follows is a chain of one member, known without a tree.  Equal paths are counted first, so
    copies meet as one, and distinct paths grow the trees (prefix_nodes).  A task holds the shared part of the longest
    conversation, never a group of conversations.

    Null conv_id: the row takes no part.  Null role or text: empty, equal to the empty one.  Equal turn numbers (null,
    too): in the order of the SHA-256 of role and text.  Rows that repeat a turn are turns of their own.  Further
    columns take no part.  Tables without rows give none, not even a root.
    """
    convs, turns = rebuilt_turns(conversations)
    turns = written(turns)
    shared = turns.groupBy("digest").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).where("a < b")
    dictionary = written(shared.select("digest", F.monotonically_increasing_id().alias("id")))
    coded = written(turns.join(dictionary, "digest", "left").select("conv_id", "depth", "id", "bytes"))
    cut = coded.where("id IS NULL").groupBy("conv_id").agg(F.min("depth").alias("cut"))
    before = coded.join(cut, "conv_id", "left").where("cut IS NULL OR depth < cut")
    turn = F.struct("depth", "id", "bytes")
    paths = before.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("path"))
    none = F.array().cast("array<bigint>")
    members = convs.join(paths, "conv_id", "left").select(
        "conv_id", "n", F.coalesce("path.id", none).alias("ids"), F.coalesce("path.bytes", none).alias("bytes")
    )
    mark = F.unhex(F.sha2(F.array_join("ids", ","), 256))
    members = written(members.withColumn("mark", mark))
    ends = F.col("n") == F.size("ids")
    distinct = members.groupBy("mark", "ids", "bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"), F.count_if(~ends).alias("children"), F.count_if(~ends).alias("leaves")
    )
    nodes = written(prefix_nodes(distinct, shard_turns))
    digests = digests_of_ids(members.where(ends), chunk_ids)
    empty = F.sha2(F.lit("").cast("binary"), 256)
    own = F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    tree = nodes.join(digests, "mark", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).drop("mark")
    # The chains of one member: the first node's parent is the node of the path.
    tops = nodes.where("mark IS NOT NULL").select("mark", F.col("conv_id").alias("parent_conv_id"))
    first = members.where(~ends).select("conv_id", "n", F.size("ids").alias("above"), "mark").join(tops, "mark")
    chain = first.select(
        "conv_id", "n", "above", "parent_conv_id", F.explode(F.sequence(F.col("above") + 1, F.col("n"))).alias("depth")
    )
    last = F.col("depth") == F.col("n")
    alone = chain.select(
        "conv_id", "depth", F.when(F.col("depth") == F.col("above") + 1, F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, own).otherwise(empty).alias("ends_sha256"),
    )
    return tree.unionByName(alone).withColumn("depth", F.col("depth").cast("long"))


def op12_prefix_trie(spark, sf_dir):
    """All nodes of the prefix trie of all conversations."""
    found = conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    )


#: CRC-32 of the decimal digits bit by bit: each byte is followed by eight steps.
_CRC = """
  xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
    lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, s: CASE WHEN s >= 0 THEN xor(a, s) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295)
"""
ORACLE_PREFIX_TRIE = f"""
WITH own AS (
  SELECT conv_id, list(struct_pack(d := sha256(strlen(r)::VARCHAR || ':' || r || t), b := strlen(t))
                       ORDER BY turn NULLS FIRST, sha256(strlen(r)::VARCHAR || ':' || r || t)) AS turns
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)
  GROUP BY conv_id),
heads AS (SELECT conv_id, turns, {_CRC} % 9 AS h FROM own),
whole AS (
  SELECT c.conv_id, CASE WHEN c.conv_id % 5 = 0 THEN c.turns
    ELSE list_concat(coalesce(s.turns, [])[1:c.h], c.turns[c.h + 1:]) END AS turns
  FROM heads c LEFT JOIN own s ON s.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (
  SELECT conv_id, d AS depth, len(turns) = d AS ends, list_transform(turns[1:d], lambda x: x.d) AS node,
    list_transform(turns[1:d - 1], lambda x: x.d) AS above, CASE WHEN d > 0 THEN turns[d].b ELSE 0 END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM whole)),
nodes AS (
  SELECT node, any_value(above) AS above, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    any_value(bytes) * (count(*) - 1) AS saved, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM prefixes GROUP BY node),
kids AS (SELECT above, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY above),
sums AS (
  SELECT t.node, count(*) FILTER (k.n IS NULL) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM (SELECT node, saved, unnest(list_transform(range(0, depth + 1), lambda d: node[1:d])) AS top FROM nodes) u
  JOIN nodes t ON t.node = u.top LEFT JOIN kids k ON k.above = u.node GROUP BY t.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
  s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.above = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = n.above
"""
