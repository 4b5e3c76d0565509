"""Prefix trie of conversations, rolled up by bands of depths.

A node is named by its smallest member and its depth. Texts become hashes before anything is shuffled; a prefix is the sum of its turns' hashes
times powers of an odd base, 128 bits in two lanes, so that prefixes of a conversation that several tasks hold are sums carried from task to
task, and the prefix of a rebuilt conversation follows from those of its two parts. Equal prefixes are taken as equal texts.

Rows are sorted by ranges of (conversation, turn) and numbered there; only a row or two for each partition reach the driver. A conversation that is
the smallest member of a node is that of all deeper nodes on its way, so a small table (`above`) says who leads the nodes above.

Sums over subtrees: every node adds its own numbers to its ancestors within its band of BAND depths, so an explosion is at most BAND rows. The nodes
at the top of the bands are then a trie of their own, BAND times lower, which is summed in the same way; completed tops are added to the nodes
between them and the top above. Rounds grow with the logarithm of the greatest depth.

Turns follow their number, null first, then role and hashes of text; null roles and texts are empty; repeated rows are turns of their own. Rows without
a conversation id are no conversation. An empty table gives no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import streams
from .common import tidy, written

#: Bases of the two lanes, odd, so that their powers can be undone.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
INVERSE = tuple(pow(b, -1, 1 << 64) for b in BASES)
#: Depths of a band; turns that a conversation may take from its group's first one, and how many conversations share that.
BAND, HEAD, GROUP = 16, 6, 100
NODE = ["conv_id", "depth"]


def powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n modulo 2**64."""
    out, square, n = np.ones(len(n), np.uint64), np.array([base], np.uint64), n.astype(np.int64)
    while n.any():
        out = np.where(n & 1, out * square, out)
        square, n = square * square, n >> 1
    return out


def _lane(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy().view(np.uint64)


def _longs(a: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(a).view(np.int64))


# Turns in order


def _numbered(rows: DataFrame) -> DataFrame:
    """Sorted rows with `at`, their number within the task's part of the conversation, and p0, p1, the sums up to and with them; and for the first
    and last conversation of each partition a row with `edge`: how many turns are here, and their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends, key, at, sums = TaskContext.get().partitionId(), [], None, 0, [0, 0]
        names = ["part", "edge", "conv_id", "at", "p0", "p1", "chars"]

        def edges() -> pa.RecordBatch:
            k, n, s = zip(*ends)
            return pa.RecordBatch.from_arrays([pa.array([part] * len(k), pa.int32()), pa.array([True] * len(k)), pa.array(k, pa.int64()), pa.array(n, pa.int64()), *(_longs(np.array(x, np.uint64)) for x in zip(*s)), pa.array([0] * len(k), pa.int64())], names)

        for batch in batches:
            ids = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            size = np.diff(np.append(first, len(ids)))
            number = np.arange(len(ids)) - np.repeat(first, size)
            goes_on = key is not None and ids[0] == key
            if goes_on:
                number[: size[0]] += at
            elif key is not None and not ends:
                ends.append((key, at, sums))
            lanes = []
            for lane, base in enumerate(BASES):
                total = np.cumsum(_lane(batch, f"x{lane}") * powers(base, number))
                total -= np.repeat(np.where(first, total[first - 1], np.uint64(0)), size)
                if goes_on:
                    total[: size[0]] += np.uint64(sums[lane])
                lanes.append(total)
            if not ends and len(first) > 1:
                ends.append((int(ids[0]), int(number[first[1] - 1]) + 1, [int(t[first[1] - 1]) for t in lanes]))
            key, at, sums = int(ids[-1]), int(number[-1]) + 1, [int(t[-1]) for t in lanes]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(np.zeros(len(ids), bool)), batch.column("conv_id"), pa.array(number), *map(_longs, lanes), batch.column("chars").cast(pa.int64())], names)
        if key is not None:
            ends.append((key, at, sums))
            yield edges()

    return rows.mapInArrow(tidy(run), "part int, edge boolean, conv_id long, at long, p0 long, p1 long, chars long")


def _carried(edges: list) -> dict[int, tuple[int, int, list[int]]]:
    """For each partition that begins within a conversation: (conversation, turns before it, their sums)."""
    parts: dict[int, list] = {}
    for e in edges:
        parts.setdefault(e.part, []).append(e)
    out, key, before, sums = {}, None, 0, [0, 0]
    for part in sorted(parts):
        # a partition of one conversation has one row, others have the first and the last one
        own = sorted(parts[part], key=lambda e: e.conv_id)
        head = own[0]
        if head.conv_id != key:
            before, sums = 0, [0, 0]
        elif before:
            out[part] = (key, before, sums)
        done = [(s + pow(b, before, 1 << 64) * p) % (1 << 64) for s, b, p in zip(sums, BASES, (head.p0, head.p1))]
        key, before, sums = (head.conv_id, before + head.at, done) if len(own) == 1 else (own[1].conv_id, own[1].at, [own[1].p0 % (1 << 64), own[1].p1 % (1 << 64)])
    return out


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, at, p0, p1, chars): every turn with its number from 0 in its conversation, its prefix's sums, and the code points of its text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), F.xxhash64(role, text).alias("x0"), F.xxhash64(F.lit(1), text, role).alias("x1"), F.length(text).cast("long").alias("chars"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "x0", "x1").drop("turn", "role")
    rows = written(_numbered(rows), "turns")
    sent = rows.sparkSession.sparkContext.broadcast(_carried(rows.where("edge").collect()))  # a row or two for each partition

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at, part = (batch.column(c).to_numpy() for c in ("conv_id", "at", "part"))
            at, lanes = at.copy(), [_lane(batch, "p0").copy(), _lane(batch, "p1").copy()]
            for p in np.unique(part):
                if int(p) in sent.value:
                    key, before, sums = sent.value[int(p)]
                    here = (part == p) & (ids == key)
                    at[here] += before
                    for lane, base, s in zip(lanes, BASES, sums):
                        lane[here] = lane[here] * np.uint64(pow(base, before, 1 << 64)) + np.uint64(s)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(at), *map(_longs, lanes), batch.column("chars")], ["conv_id", "at", "p0", "p1", "chars"])

    return rows.where("NOT edge").select("part", "conv_id", "at", "p0", "p1", "chars").mapInArrow(tidy(run), "conv_id long, at long, p0 long, p1 long, chars long")


# Rebuilt conversations


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, p0, p1, chars, last) of every turn of every rebuilt conversation, and (conv_id, depth), how many turns each has: the first h
    turns of the conversation whose number is the next lower multiple of GROUP, then its own after its first h; h is a hash of its number."""
    rows = turns(conversations)
    head = F.sort_array(F.collect_list(F.when(F.col("at") < HEAD - 1, F.struct("at", "p0", "p1", "chars"))))
    convs = written(rows.groupBy("conv_id").agg(F.count("*").alias("n"), head.alias("head")), "conversations")
    base = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("n").alias("m"), F.col("head").alias("taken"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD
    plan = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(base, "base", "left").withColumn("h", h)
    plan = plan.withColumn("k", F.least("h", F.coalesce("m", F.lit(0)))).withColumn("depth", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    last = lambda array, n, c: F.when(n > 0, F.try_element_at(array, n.cast("int"))[c]).otherwise(0)
    plan = written(
        plan.select("conv_id", "depth", "h", "k", F.slice("taken", 1, F.col("k").cast("int")).alias("taken"), *(last(F.col(a), F.col(n), f"p{i}").alias(f"{to}{i}") for a, n, to in (("taken", "k", "q"), ("head", "h", "o")) for i in (0, 1))), "plan"
    )
    first = plan.select("conv_id", F.explode("taken").alias("t"), F.col("depth").alias("all"))
    first = first.select("conv_id", (F.col("t.at") + 1).alias("depth"), "t.p0", "t.p1", "t.chars", (F.col("t.at") + 1 == F.col("all")).alias("last"))
    own = rows.join(plan.drop("taken"), "conv_id").where("at >= h")
    own = own.select("conv_id", (F.col("at") - F.col("h") + F.col("k") + 1).alias("number"), "depth", "h", "k", "p0", "p1", "q0", "q1", "o0", "o1", "chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = batch.column("h").to_numpy() - batch.column("k").to_numpy()
            lanes = [_lane(batch, f"q{i}") + powers(INVERSE[i], back) * (_lane(batch, f"p{i}") - _lane(batch, f"o{i}")) for i in (0, 1)]
            number = batch.column("number").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("number"), *map(_longs, lanes), batch.column("chars"), pa.array(number == batch.column("depth").to_numpy())], ["conv_id", "depth", "p0", "p1", "chars", "last"])

    own = own.mapInArrow(tidy(run), "conv_id long, depth long, p0 long, p1 long, chars long, last boolean")
    return written(first.unionByName(own), "rebuilt"), plan.select("conv_id", "depth")


# Nodes


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes (conv_id, depth) at which conversations `member` end: the digest of their numbers."""
    dealt = members.repartitionByRange("conv_id", "depth", "member").sortWithinPartitions("conv_id", "depth", "member")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, depth, member = (batch.column(c).to_numpy() for c in ("conv_id", "depth", "member"))
            first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (depth[1:] != depth[:-1])]))
            held = [",".join(map(str, m)).encode() for m in np.split(member, first[1:])]
            whole = [0 < i < len(held) - 1 for i in range(len(held))]  # the first and the last may have more in other batches
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[first]), pa.array(depth[first]), pa.array([part] * len(held), pa.int32()), pa.array(seq + np.arange(len(held))), pa.array(whole),
                    pa.array([hashlib.sha256(h).hexdigest() if w else None for h, w in zip(held, whole)], pa.string()), pa.array([None if w else h for h, w in zip(held, whole)], pa.binary()),
                ], ["conv_id", "depth", "part", "seq", "whole", "ends_sha256", "ends_bytes"],
            )
            seq += len(held)

    return streams.finished(dealt.mapInArrow(tidy(run), f"conv_id long, depth long, {streams.PLACE}, {streams.fields(['ends'])}"), NODE, [], ["ends"], b",")


class _Ways:
    """Who leads the nodes on a conversation's way from the root: itself from some depth on, others above, which `above` (conv_id, depth, leader) names."""

    def __init__(self, root: int, above: DataFrame):
        self.root, self.above = root, above

    def leader(self, rows: DataFrame, depth: Column, name: str) -> DataFrame:
        """rows, with the leader of the node at that depth on their conv_id's way."""
        met = rows.withColumn("_depth", depth).join(self.above.select("conv_id", F.col("depth").alias("_depth"), "leader"), ["conv_id", "_depth"], "left")
        return met.withColumn(name, F.when(F.col("_depth") == 0, self.root).otherwise(F.coalesce("leader", "conv_id"))).drop("leader", "_depth")

    def lifted(self, nodes: DataFrame, first: Column, last: Column, step: int, numbers: list[str]) -> DataFrame:
        """The numbers of nodes, added up in each of their ancestors at the depths from first to last."""
        total = [F.sum(c).alias(c) for c in numbers]
        rows = nodes.select("conv_id", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("depth"), *numbers)
        rows = self.leader(rows.groupBy(*NODE).agg(*total), F.col("depth"), "to")
        return rows.groupBy(F.col("to").alias("conv_id"), "depth").agg(*total)


def subtree_sums(nodes: DataFrame, ways: _Ways, deepest: int, numbers: list[str], band: int = BAND) -> DataFrame:
    """(conv_id, depth, numbers): each node's numbers and those of all below it."""
    depth, levels, step = F.col("depth"), [], 1
    while True:
        sums = written(ways.lifted(nodes, depth - depth % (step * band), depth, step, numbers), "band")
        levels.append((step, sums))
        if deepest < step * band:
            break
        nodes, step = sums.where(depth % (step * band) == 0), step * band
    complete = levels[-1][1]
    for step, sums in reversed(levels[:-1]):
        more = ways.lifted(complete.where(depth > 0), depth - step * (band - 1), depth - step, step, numbers)
        between = sums.where(depth % (step * band) != 0).unionByName(more).groupBy(*NODE).agg(*[F.sum(c).alias(c) for c in numbers])
        complete = written(complete.unionByName(between), "complete")
    return complete


def trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    spark = conversations.sparkSession
    rows, lengths = rebuilt(conversations)
    all_of = lengths.agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.max("depth").alias("deepest")).first()
    if not all_of.n:
        return spark.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    named = written(rows.groupBy("depth", "p0", "p1").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("leader"), F.max("chars").alias("chars")), "nodes")
    names = named.select("depth", "p0", "p1", "leader")
    leads = named.groupBy(F.col("leader").alias("conv_id")).agg(F.min("depth").alias("from"))
    ways = _Ways(all_of.least, written(rows.join(leads, "conv_id").where(F.col("depth") < F.col("from")).select("conv_id", "depth", "p0", "p1").join(names, ["depth", "p0", "p1"]).select("conv_id", "depth", "leader"), "above"))
    nodes = ways.leader(named.select(F.col("leader").alias("conv_id"), "depth", "n_convs", "chars"), F.col("depth") - 1, "parent_conv_id")
    top = spark.range(1).select(F.lit(all_of.least).alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(all_of.n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("chars"), F.lit(None).cast("long").alias("parent_conv_id"))
    nodes = nodes.unionByName(top)
    # a node and its children meet in one grouping instead of a join
    children = nodes.where("depth > 0").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), F.lit(1).cast("long").alias("n_children"))
    nodes = nodes.unionByName(children, allowMissingColumns=True).groupBy(*NODE).agg(F.max("parent_conv_id").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.count("n_children").alias("n_children"), F.max("chars").alias("chars"))
    nodes = written(nodes.select(*NODE, "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), "trie")
    sums = subtree_sums(nodes.select(*NODE, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"), "saved_tokens"), ways, all_of.deepest, ["n_leaves", "saved_tokens"])
    ended = rows.where("last").select(F.col("conv_id").alias("member"), "depth", "p0", "p1").join(names, ["depth", "p0", "p1"]).select(F.col("leader").alias("conv_id"), "depth", "member")
    ended = ended.unionByName(lengths.where("depth = 0").select(F.lit(all_of.least).alias("conv_id"), "depth", F.col("conv_id").alias("member")))
    parts = nodes.drop("saved_tokens").unionByName(sums, allowMissingColumns=True).unionByName(_ends(ended), allowMissingColumns=True)
    columns = ["parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = parts.groupBy(*NODE).agg(*[F.max(c).alias(c) for c in columns])  # each comes from one part
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
