"""A trie of conversation prefixes: ternary search trees per range shard, merged along the borders of shards.

1. A turn is named by a digest of its role and text; a conversation is the sequence of its digests.
2. Sequences are range-partitioned in their order, ties by conversation, into shards; so a prefix stands
   in neighbouring shards only, and copies of one sequence fill as many shards as they need.
3. A shard's digests are dictionary-encoded, in order, and its different sequences go into a ternary
   search tree, the median first, then the medians of both halves, and so on: the tree stays balanced
   though its input is sorted.  One walk over the tree, without recursion, adds up members, leaves and
   savings from the bottom.
4. A shard knows how many turns its first sequence shares with the last one of the shard before it, and
   its last with the first one of the next.  Nodes on these two paths are boundary nodes.  Each counts as
   owned by the first shard that has it, a leaf by the last; so the parts of a boundary node add up, and
   all other nodes are complete where they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docframe.llm.common import join_spread, stage
from docframe.session import ship

#: Turns of a shard, about: at most, and at least where more shards would only keep more tasks busy.
SHARD_TURNS, LEAST_TURNS = 1_000_000, 4096
#: Characters of a row that lists conversations which end at a boundary node.
LISTED = 1 << 20
EMPTY = hashlib.sha256(b"").hexdigest()

_NODE = "key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard long, nth long, listed binary"
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class SearchTree:
    """A ternary search tree over sequences of whole numbers; node 0 is the root, every other one ends a prefix."""

    def __init__(self) -> None:
        self.code, self.less, self.next, self.more = [-1], [-1], [-1], [-1]
        self.ends: dict[int, list[int]] = {}

    def _new(self, code: int) -> int:
        self.code.append(code)
        for links in (self.less, self.next, self.more):
            links.append(-1)
        return len(self.code) - 1

    def add(self, sequence: tuple[int, ...], members: list[int]) -> None:
        """A sequence with the members that end there."""
        node = 0
        for code in sequence:
            links, at = self.next, node
            while (child := links[at]) >= 0 and self.code[child] != code:
                links, at = (self.less if code < self.code[child] else self.more), child
            if child < 0:
                child = links[at] = self._new(code)
            node = child
        self.ends[node] = members

    def walk(self) -> tuple[list[int], list[int]]:
        """All nodes, each after its parent, and every node's parent by number."""
        order, parent, open_ = [], [-1] * len(self.code), [(0, -1)]
        while open_:
            node, above = open_.pop()
            order.append(node)
            parent[node] = above
            # the roots of the other alternatives hang below the same parent
            for links, over in ((self.less, above), (self.more, above), (self.next, node)):
                if links[node] >= 0:
                    open_.append((links[node], over))
        return order, parent

    def path(self, sequence: tuple[int, ...]) -> list[int]:
        """The nodes of a sequence that is in the tree, the root first."""
        found = [0]
        for code in sequence:
            child = self.next[found[-1]]
            while self.code[child] != code:
                child = self.less[child] if code < self.code[child] else self.more[child]
            found.append(child)
        return found


def build(sequences: list[tuple[int, ...]], members: list[list[int]]) -> SearchTree:
    """Different sequences in order, and the members of each: the median goes in first, then those of both halves."""
    tree, open_ = SearchTree(), [(0, len(sequences))]
    while open_:
        low, high = open_.pop()
        if low < high:
            mid = (low + high) // 2
            tree.add(sequences[mid], members[mid])
            open_ += [(low, mid), (mid + 1, high)]
    return tree


def _grouped(ids: list[list[bytes]], conv_ids: list[int]) -> tuple[np.ndarray, list[tuple[int, ...]], list[list[int]]]:
    """The dictionary of a shard's digests, its different sequences as codes, in order, and their members, ascending."""
    words = sorted({d for s in ids for d in s})
    code = {d: k for k, d in enumerate(words)}
    found: dict[tuple[int, ...], list[int]] = {}
    for s, c in zip(ids, conv_ids):
        found.setdefault(tuple(code[d] for d in s), []).append(c)
    order = sorted(found)
    return words, order, [sorted(found[s]) for s in order]


def shard_nodes(ids: list[list[bytes]], sizes: list[list[int]], conv_ids: list[int], shard: int, before: int, after: int) -> Iterator[dict]:
    """Rows of a shard's nodes, and of the members listed at its boundary nodes.

    before, after: turns that its first sequence shares with the shard before it and its last one with
    the next; -1 where there is no such shard.
    """
    words, sequences, members = _grouped(ids, conv_ids)
    size_of = dict(zip((d for s in ids for d in s), (n for s in sizes for n in s)))
    size = [size_of[d] for d in words]
    tree = build(sequences, members)
    first, last = tree.path(sequences[0])[: before + 1], tree.path(sequences[-1])
    # the last sequence goes on in the next shard, or stands there again: it is no leaf here
    goes_on = last[-1] if after == len(last) - 1 else -1
    last = last[: after + 1]
    foreign = set(first)
    keys: dict[int, bytes] = {}
    for path in (first, last):
        for above, node in zip([-1, *path], path):
            keys[node] = b"" if node == 0 else hashlib.blake2b(keys[above] + words[tree.code[node]], digest_size=16).digest()

    order, parent = tree.walk()
    n = len(order)
    count, least, children, leaves, spent, own, depth = [0] * n, [1 << 63] * n, [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    inner = [x >= 0 for x in tree.next]
    for node in order[1:]:
        depth[node] = depth[parent[node]] + 1
    for node in reversed(order):
        ends = tree.ends.get(node)
        if ends:
            count[node] += len(ends)
            least[node] = min(least[node], ends[0])
        if not inner[node] and node != goes_on:
            leaves[node] = 1
        letters = size[tree.code[node]] if node else 0
        spent[node] += count[node] * letters
        own[node] += 0 if node in foreign else letters
        if (above := parent[node]) >= 0:
            count[above] += count[node]
            least[above] = min(least[above], least[node])
            children[above] += node not in foreign
            leaves[above] += leaves[node]
            spent[above] += spent[node]
            own[above] += own[node]
    for node in order:
        above, ends = parent[node], ",".join(map(str, tree.ends.get(node, ()))).encode()
        yield {
            "key": keys.get(node), "parent_key": keys.get(above), "conv_id": least[node], "depth": depth[node], "parent_conv_id": least[above] if above >= 0 and above not in keys else None,
            "n_convs": count[node], "n_children": children[node], "n_leaves": leaves[node], "saved_tokens": spent[node] - own[node], "ends_sha256": hashlib.sha256(ends).hexdigest() if node not in keys else None,
            "shard": shard, "nth": None, "listed": None,
        }
        if node in keys and ends:
            for nth, at in enumerate(range(0, len(ends), LISTED)):
                yield {"key": keys[node], "shard": shard, "nth": nth, "listed": ends[at : at + LISTED]}


def _shard(borders: dict[int, tuple[int, int]], schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        rows = shard_nodes(table.column("ids").to_pylist(), table.column("sizes").to_pylist(), table.column("conv_id").to_pylist(), shard, *borders[shard])
        return pa.Table.from_pylist(list(rows), schema)

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lists in order of key, shard and number: the hash of each key's whole list, a row at a time."""
    key, now, shard = None, None, None
    out = lambda: pa.RecordBatch.from_pylist([{"key": key, "ends_sha256": now.hexdigest()}])
    for batch in batches:
        for k, s, listed in zip(*(batch.column(c).to_pylist() for c in ("key", "shard", "listed"))):
            if k != key:
                if now is not None:
                    yield out()
                key, now, shard = k, hashlib.sha256(), s
            elif s != shard:
                now.update(b",")
                shard = s
            now.update(listed)
    if now is not None:
        yield out()


def turn_sequences(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turns (array of turn, id, size): each conversation's turns in order, a null turn first.

    A turn's id is a digest of its role and text, null as empty; its size counts the text's code points.
    Equal turn numbers go by that id; repeated rows are turns each.  Rows without a conversation are no
    part of any.  The ids of one conversation are one row: its turns, 16 bytes each, fit a task.
    """
    role, text = (F.coalesce(conversations[c].cast("string"), F.lit("")) for c in (role_col, text_col))
    name = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    turns = conversations.select(conversations[id_col].cast("long").alias("conv_id"), F.struct(conversations[turn_col].alias("turn"), name.alias("id"), F.length(text).cast("long").alias("size")).alias("t"))
    return turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def with_shared_heads(sequences: DataFrame, every: int = 100, heads: int = 6) -> DataFrame:
    """conv_id, ids, sizes: each conversation with its first h turns replaced by those of conversation c - c % every, h = crc32(c) % heads."""
    base = sequences.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    found = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left").withColumn("h", h)
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    whole = F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))))
    return found.select("conv_id", whole.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def _borders(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """For every shard, in order: turns shared with the one before it and with the next.  A row a shard meets in one task."""
    ends = shards.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    order = Window.orderBy("shard")

    def shared(a, b):
        differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
        return F.when(differs > 0, differs - 1).otherwise(F.size(a).cast("long"))

    before, after = F.lag("last").over(order), F.lead("first").over(order)
    rows = ends.select("shard", "first", "last", before.alias("before"), after.alias("after"))
    found = rows.select("shard", F.coalesce(shared(F.col("before"), F.col("first")), F.lit(-1)).alias("b"), F.coalesce(shared(F.col("last"), F.col("after")), F.lit(-1)).alias("a"), F.col("before").isNull().alias("start"), F.col("after").isNull().alias("end"))
    return {r.shard: (-1 if r.start else int(r.b), -1 if r.end else int(r.a)) for r in found.collect()}


def prefix_nodes(sequences: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """One row per different prefix of the sequences (conv_id, ids, sizes), the empty one (depth 0) included.

    conv_id (its smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (nodes
    without children below it or itself), saved_tokens (over the nodes from it down, members less one
    times the size of the last turn), ends_sha256 (of the conv_ids of the members that end there,
    ascending, joined by commas).  An empty table gives no rows.

    A list of conversations that end at one node is hashed as one stream by one task, in bounded memory.
    """
    spark = sequences.sparkSession
    ship(spark)
    whole = stage(sequences, "trie-sequences")
    total = whole.agg(F.sum(F.size("ids") + 1)).first()[0] or 0
    n = max(1, -(-total // shard_turns), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // least_turns)))
    dealt = whole.repartitionByRange(n, "ids", "conv_id").withColumn("shard", F.spark_partition_id().cast("long"))
    shards = stage(dealt, "trie-shards")
    borders = _borders(shards)
    schema = spark.createDataFrame([], _NODE).schema
    arrow = pa.schema([(f.name, pa.string() if f.dataType.typeName() == "string" else pa.binary() if f.dataType.typeName() == "binary" else pa.int64()) for f in schema])
    parts = stage(shards.groupBy("shard").applyInArrow(_shard(borders, arrow), _NODE), "trie-nodes")

    nodes = parts.filter("listed IS NULL")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = nodes.filter("key IS NOT NULL").groupBy("key").agg(F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), *sums)
    lists = parts.filter("listed IS NOT NULL").select("key", "shard", "nth", "listed").repartition("key").sortWithinPartitions("key", "shard", "nth")
    ends = lists.mapInArrow(_hashed, "key binary, ends_sha256 string")
    boundary = stage(merged.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY))), "trie-boundary")

    inside, at_border = nodes.filter("key IS NULL AND parent_key IS NULL"), nodes.filter("key IS NULL AND parent_key IS NOT NULL")
    below = at_border.select("parent_key", *[c for c in _OUT if c != "parent_conv_id"]).unionByName(boundary.drop("key"))
    above = boundary.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    return inside.select(*_OUT).unionByName(join_spread(below, above, "parent_key").select(*_OUT))
