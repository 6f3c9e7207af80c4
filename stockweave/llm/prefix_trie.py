"""Prefix tries of conversations as tables of nodes behind minimal perfect hashes.

A prefix has a 128-bit digest: the exclusive or of the digests of its turns with their places, so that prefixes of very long conversations come from
slices too. Distinct prefixes are the nodes. They are dealt to shards by subtree: the top of a shard's subtree is the first prefix of a path beneath which at
most a bounded number of turns lie, so a first turn that very many conversations share is split further down. Each shard numbers its
digests by a minimal perfect hash, keeps them at their slots to tell a foreign digest from one of its own, scatters the nodes' counts into
flat arrays, and adds them up through an array of parents' slots, deepest nodes first. The few prefixes above the tops sum what the shards report.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockweave.operators.ordering import numbered_within, running

from .common import mix, partitions, small_or_shuffled, stage, unstage

# The turns of its hundred's first conversation with which a conversation may begin are under HEADS, of HUNDRED conversations.
HEADS, HUNDRED = 6, 100
#: Turns beneath the top of a shard's subtree at most, and at least where there are few; ids of a chunk of members.
SHARD_TURNS, LEAST_TURNS, CHUNK_IDS = 250_000, 1000, 4096
#: Bits of a hash's level for each of its keys; levels at most.
SPARE, LEVELS = 2, 200


# ---- conversations ----


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> conv_id, i (from 1), sha (of role and text), chars (code points of the text).

    By turn, null first, ties by role, then by the digest of role and text, so that no text is moved; rows alike in all are further turns.
    Null roles and texts are empty; rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), sha.alias("sha"), F.length(text).cast("long").alias("chars"))
    return numbered_within(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("sha")], "i").select("conv_id", "i", "sha", "chars")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """turns of ordered_turns -> (staged conv_id, depth, sha, chars, n_turns; staged conv_id, n_turns): each conversation c begins with the first h turns of c - c % 100, h = crc32(c) % 6, and goes on with its own after the first h."""
    per = stage(turns.groupBy("conv_id").agg(F.count("*").alias("own")), "convs")
    named = per.select("conv_id", "own", (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = per.where(F.col("conv_id") % HUNDRED == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("base_turns"))
    taken = F.least("h", F.coalesce("base_turns", F.lit(0)))
    convs = named.join(small_or_shuffled(bases, 16), "base", "left").withColumn("taken", taken).select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = stage(convs, "convs")
    # at most HEADS - 1 turns of a base, for at most HUNDRED conversations
    heads = turns.where((F.col("conv_id") % HUNDRED == 0) & (F.col("i") < HEADS)).select(F.col("conv_id").alias("base"), "i", "sha", "chars")
    begun = convs.join(heads, "base").where("i <= taken").select("conv_id", F.col("i").alias("depth"), "sha", "chars", "n_turns")
    gone_on = turns.join(small_or_shuffled(convs.select("conv_id", "h", "taken", "n_turns"), 32), "conv_id").where("i > h").select("conv_id", (F.col("taken") + F.col("i") - F.col("h")).alias("depth"), "sha", "chars", "n_turns")
    rows = stage(begun.unionByName(gone_on), "rebuilt")
    members = stage(convs.select("conv_id", "n_turns"), "members")
    unstage(per, convs)
    return rows, members


def paths(rows: DataFrame) -> DataFrame:
    """rows (conv_id, depth, sha, ...) -> the same with a, b (the digest of the first depth turns) and pa, pb (that of the turns before; 0, 0 at the root)."""
    own = {"a": F.xxhash64("depth", "sha"), "b": F.xxhash64("sha", "depth")}
    out = running(rows, ["conv_id"], [F.col("depth")], {k: ("bit_xor", c) for k, c in own.items()})
    return out.withColumns({f"p{k}": F.col(k).bitwiseXOR(c) for k, c in own.items()})


# ---- a shard ----


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit numbers: each level has a bit for every key that is alone in its place there; a key's slot is the rank of its bit."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.levels, rest, before = [], np.arange(len(a)), 0
        while len(rest):
            if len(self.levels) == LEVELS:  # distinct keys part long before
                raise ValueError("a key was given twice")
            size = SPARE * len(rest)
            place = self._place(a[rest], b[rest], len(self.levels), size)
            alone = np.bincount(place, minlength=size) == 1
            rank = before + np.cumsum(alone) - 1
            self.levels.append((size, alone, rank))
            before += int(alone.sum())
            rest = rest[~alone[place]]
        self.size = before

    @staticmethod
    def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            seed = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)
            return (mix(a.view(np.uint64) ^ mix(b.view(np.uint64) + seed)) % np.uint64(size)).astype(np.int64)

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key that was given; of others any, or -1."""
        out, rest = np.full(len(a), -1, np.int64), np.arange(len(a))
        for level, (size, alone, rank) in enumerate(self.levels):
            if not len(rest):
                break
            place = self._place(a[rest], b[rest], level, size)
            hit = alone[place]
            out[rest[hit]] = rank[place[hit]]
            rest = rest[~hit]
        return out


class NodeTable:
    """The nodes of a shard at the slots of their digests."""

    def __init__(self, a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, depth: np.ndarray):
        self.hash = PerfectHash(a, b)
        n = self.hash.size
        at = self.hash.slots(a, b)
        self.at, self.a, self.b, self.depth = at, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.a[at], self.b[at], self.depth[at] = a, b, depth
        self.parent = np.full(n, -1, np.int64)
        self.parent[at] = self.find(pa_, pb)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slots of digests, -1 for those that the table does not hold: the digest kept at a slot says whose it is."""
        at = self.hash.slots(a, b)
        own = (at >= 0) & (self.a[at] == a) & (self.b[at] == b)
        return np.where(own, at, -1)

    def scattered(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.a), np.int64)
        out[self.at] = values
        return out

    def children(self) -> np.ndarray:
        return np.bincount(self.parent[self.parent >= 0], minlength=len(self.a)).astype(np.int64)

    def add_up(self, *values: np.ndarray) -> None:
        """Adds each node's values to its parent's, deepest first, in place."""
        order = np.argsort(-self.depth, kind="stable")
        edges = np.flatnonzero(np.diff(self.depth[order])) + 1
        for nodes in np.split(order, edges):
            below = nodes[self.parent[nodes] >= 0]
            for v in values:
                np.add.at(v, self.parent[below], v[below])


_NODE = "a long, b long, pa long, pb long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _of_shard(cols: list[np.ndarray]) -> pa.RecordBatch:
    a, b, pa_, pb, depth, conv, n, chars = cols
    t = NodeTable(a, b, pa_, pb, depth)
    convs, members, saved = t.scattered(conv), t.scattered(n), t.scattered((n - 1) * chars)
    children = t.children()
    leaves = (children == 0).astype(np.int64)
    t.add_up(leaves, saved)
    inside = t.parent >= 0
    parent_conv = pa.array(np.where(inside, convs[t.parent], 0), mask=~inside)
    given = [t.scattered(pa_), t.scattered(pb)]
    return pa.RecordBatch.from_arrays([*map(pa.array, (t.a, t.b, *given, t.depth, convs)), parent_conv, *map(pa.array, (members, children, leaves, saved, ~inside))], names=[c.split()[0] for c in _NODE.split(", ")])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (shard, a, b, pa, pb, depth, conv_id, n_convs, chars) sorted by shard -> the nodes of one shard at a time."""
    now, held = None, []
    for batch in batches:
        shard, *cols = (c.to_numpy() for c in batch.columns)
        edges = np.r_[0, np.flatnonzero(np.diff(shard)) + 1, len(shard)]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if lo == hi:
                continue
            if shard[lo] != now and held:
                yield _of_shard([np.concatenate(c) for c in zip(*held, strict=True)])
                held = []
            now = shard[lo]
            held.append([c[lo:hi] for c in cols])
    if held:
        yield _of_shard([np.concatenate(c) for c in zip(*held, strict=True)])


# ---- the trie ----


def _ends(rows: DataFrame) -> DataFrame:
    """rows (a, b, conv_id) -> a, b, ends_sha256 over the ids in order, comma-joined: ranges of ids become chunks of text, and the chunks of a node are digested as a stream."""
    n = partitions(rows.sparkSession)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids = None, []

        def row() -> tuple:
            return (*now, ids[0], ",".join(map(str, ids)))

        for batch in batches:
            out = []
            for a, b, conv in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if ids and ((a, b) != now or len(ids) == CHUNK_IDS):
                    out.append(row())
                    ids = []
                now = (a, b)
                ids.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "first", "ids"])
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row()], names=["a", "b", "first", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)], strict=True):
                if (a, b) == now:
                    sha.update(b",")
                else:
                    if sha:
                        out.append((*now, sha.hexdigest()))
                    now, sha = (a, b), hashlib.sha256()
                sha.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names=["a", "b", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, sha.hexdigest())], names=["a", "b", "ends_sha256"])

    order = ["a", "b", "conv_id"]
    cut = rows.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(chunks, "a long, b long, first long, ids string")
    return cut.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digests, "a long, b long, ends_sha256 string")


def _upper(open_: DataFrame, on_path: DataFrame, tops: DataFrame) -> DataFrame:
    """Nodes above the tops -> their rows: each counts the tops beneath it as its own, and its subtree is summed along the paths of the nodes' smallest members, each node once.

    open_ (a, b, pa, pb, depth, conv_id, n_convs, chars), tops (pa, pb, n_leaves, saved_tokens).
    """
    below = tops.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("tops"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    inner = open_.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("inner"))
    own = open_.join(below, ["a", "b"], "left").join(inner, ["a", "b"], "left").na.fill(0, ["tops", "leaves", "saved", "inner"]).withColumn("n_children", F.col("tops") + F.col("inner"))
    own = stage(own.select("a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "n_children", F.when(F.col("n_children") == 0, 1).otherwise(F.col("leaves")).alias("own_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("own_saved")), "upper")
    named = small_or_shuffled(own.select("a", "b", F.col("conv_id").alias("rep"), "own_leaves", "own_saved"), 40)
    reps = small_or_shuffled(own.select("conv_id").distinct(), 8)
    rows = on_path.join(reps, "conv_id", "left_semi").join(named, ["a", "b"])
    mine = F.col("rep") == F.col("conv_id")
    rows = rows.select("conv_id", "depth", "a", "b", F.when(mine, F.col("own_leaves")).otherwise(0).alias("x"), F.when(mine, F.col("own_saved")).otherwise(0).alias("y"))
    # from the deepest on: what each row and those after it on its path hold
    after = running(rows, ["conv_id"], [F.col("depth").desc()], {"sx": ("sum", F.col("x")), "sy": ("sum", F.col("y"))})
    sums = after.groupBy("a", "b").agg(F.sum("sx").alias("n_leaves"), F.sum("sy").alias("saved_tokens"))
    return own.drop("own_leaves", "own_saved").join(sums, ["a", "b"])


def prefix_trie(conversations: DataFrame, shard_turns: int | None = None) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> a row per distinct prefix of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns and conversations as in ordered_turns and rebuilt. The root, of depth 0, has no text, no parent and all conversations as members, those without turns too.
    A table without conversations has no rows, not even a root. Columns of other names are not read.
    shard_turns bounds the turns beneath a shard's top; else it follows from the number of turns and partitions.
    """
    spark = conversations.sparkSession
    turns = stage(ordered_turns(conversations), "turns")
    rows, members = rebuilt(turns)
    on_path = stage(paths(rows), "paths")
    unstage(turns, rows)
    left = F.sum(F.col("n_turns") - F.col("depth") + 1).alias("beneath")
    alike = (F.min("sha") == F.max("sha")) & (F.min("pa") == F.max("pa")) & (F.min("pb") == F.max("pb")) & (F.min("depth") == F.max("depth"))
    nodes = on_path.groupBy("a", "b").agg(*[F.min(c).alias(c) for c in ("pa", "pb", "depth", "conv_id", "chars")], F.count("*").alias("n_convs"), left, alike.alias("alike"))
    nodes = stage(nodes, "nodes")
    if nodes.where("NOT alike").take(1):
        raise ValueError("two prefixes have one digest")
    total = on_path.count()
    bound = shard_turns or max(LEAST_TURNS, min(SHARD_TURNS, total // (2 * partitions(spark))))
    open_ = stage(nodes.where(F.col("beneath") > bound).select("a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "chars"), "open")
    any_open = bool(open_.take(1))
    # the top of a path is its first prefix that is not open; a node's path is that of its smallest member
    closed = on_path.select("conv_id", "depth", "a", "b")
    if any_open:
        closed = closed.join(small_or_shuffled(open_.select("a", "b"), 16), ["a", "b"], "left_anti")
    tops_of = closed.groupBy("conv_id").agg(F.min_by(F.xxhash64("a", "b"), "depth").alias("top_hash"))
    rest = nodes.where(F.col("beneath") <= bound).select("a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "chars")
    shards = max(partitions(spark), -(-total // bound))
    dealt = rest.join(tops_of, "conv_id").select(F.pmod("top_hash", F.lit(shards)).alias("shard"), "a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "chars")
    made = stage(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards, _NODE), "made")
    tops = made.where("top").select("a", "b", "pa", "pb", "n_leaves", "saved_tokens")
    at_root = (F.col("pa") == 0) & (F.col("pb") == 0)
    names = ["a", "b", "pa", "pb", "depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    zero = F.lit(0).cast("long")
    upper = open_.select(*names[:7], *[zero.alias(c) for c in names[7:]])
    if any_open:
        upper = stage(_upper(open_, on_path, tops).select(*names), "upper")
    first = tops.where(at_root).select("n_leaves", "saved_tokens").unionByName(upper.where(at_root).select("n_leaves", "saved_tokens"))
    n_children, n_leaves, saved = first.agg(F.count("*"), F.coalesce(F.sum("n_leaves"), F.lit(1)), F.coalesce(F.sum("saved_tokens"), F.lit(0))).first()
    n_convs, least = members.agg(F.count("*"), F.min("conv_id")).first()
    facts = {"a": 0, "b": 0, "pa": None, "pb": None, "depth": 0, "conv_id": least, "n_convs": n_convs, "n_children": n_children, "n_leaves": n_leaves, "saved_tokens": saved}
    roots = spark.range(1 if n_convs else 0).select(*[F.lit(v).cast("long").alias(k) for k, v in facts.items()])
    above = stage(roots.unionByName(upper), "above")
    parents = small_or_shuffled(above.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("above_id")), 24)
    orphans = made.where("top").drop("top", "parent_conv_id").unionByName(above).join(parents, ["pa", "pb"], "left").withColumnRenamed("above_id", "parent_conv_id")
    every = made.where("NOT top").drop("top").unionByName(orphans)
    ended = on_path.where("depth = n_turns").select("a", "b", "conv_id").unionByName(members.where("n_turns = 0").select(zero.alias("a"), zero.alias("b"), "conv_id"))
    out = every.join(_ends(ended), ["a", "b"], "left")
    ends: Column = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", ends.alias("ends_sha256"))
