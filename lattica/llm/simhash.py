"""SimHash fingerprints and near-duplicate classes by anchor points.

Two fingerprints of 64 bits that differ in 3 or fewer differ in at most 1 of one of their halves. The anchors of a half are the words of
a covering code: the perfect Hamming code of length 31 with one free bit, of radius 1. Every half is within the radius of its home anchor,
and a half within distance 1 of it is within radius + threshold = 2 of that anchor. So fingerprints are copied to the at most 17 anchors
within distance 2 of each half, and at each anchor those that are at home there are compared with all. No pair is missed, and a
half meets about 17 / 2**27 of the other halves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, forest, majorities, slabs, SPACE, tidy, word_bounds, written, xxh64
from .components import components

SEED, THRESHOLD = 42, 3
#: An anchor with more fingerprints than this is compared in squares of SQUARE x SQUARE, each its own task's work.
FULL, SQUARE = 32768, 8192
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(column: pa.Array, shingle: int = 3) -> np.ndarray:
    """64 bits of each text, each 1 if it is set in over half the XXH64 hashes of the shingles; 0 without words. Fewer words make one shingle."""
    raw, offsets = buffers(column)
    raw = _LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    first, size = np.searchsorted(starts, offsets), ends - starts
    n = np.diff(first)
    # the words one behind the other, with one space between them
    to = np.cumsum(size + 1) - (size + 1)
    joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
    letters = raw[~SPACE[raw]]
    joined[np.arange(len(letters)) + np.repeat(np.arange(len(size)), size)] = letters
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    row = np.repeat(np.arange(len(n)), count)
    word = first[:-1][row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
    last = np.minimum(word + shingle, first[1:][row]) - 1
    return majorities(xxh64(joined, to[word], to[last] + size[last], SEED), count)


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp): fp is the fingerprint of the whole text as a signed long; a null text has fingerprint zero. Other columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slabs(batches, 1 << 19):
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(fingerprint(rows.column(1), shingle).view(np.int64))], ["key", "fp"])

    return docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(tidy(run), "key long, fp long")


def _syndromes() -> list[np.ndarray]:
    """For each byte of a half what its bits add to the syndrome; bit p - 1 stands at place p of the code, the top bit at none."""
    out = []
    for byte in range(4):
        t = np.zeros(256, np.uint32)
        for bit in range(8):
            place = 8 * byte + bit + 1
            if place < 32:
                t[np.arange(256) >> bit & 1 == 1] ^= np.uint32(place)
        out.append(t)
    return out


_SYNDROME = _syndromes()


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors, distinct) of 32-bit halves: row 0 is the home anchor, then all others within distance 2; where an anchor repeats, distinct
    is False."""
    half = half.astype(np.uint32)
    s = np.zeros(len(half), np.uint32)
    for byte in range(4):
        s ^= _SYNDROME[byte][half >> np.uint32(8 * byte) & np.uint32(255)]
    at = lambda place: np.where(place > 0, np.uint32(1) << (np.maximum(place, 1) - 1).astype(np.uint32), np.uint32(0))
    home = half ^ at(s)
    rows, good = [home, home ^ np.uint32(1 << 31)], [np.ones(len(half), bool), np.ones(len(half), bool)]
    for i in range(1, 32):
        j = s ^ np.uint32(i)
        ok = (s > 0) & (j > i)
        rows.append(np.where(ok, half ^ np.uint32(1 << (i - 1)) ^ at(j), 0).astype(np.uint32))
        good.append(ok)
    return np.stack(rows), np.stack(good)


def replicate(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor key, fingerprint, at home) rows; the key's bit 32 tells the half."""
    fps = fps.view(np.uint64)
    out = []
    for block in (0, 1):
        key, good = anchors(fps >> np.uint64(32 * block) & np.uint64(0xFFFFFFFF))
        which = np.broadcast_to(np.arange(len(fps)), key.shape)[good]
        home = (np.broadcast_to(np.arange(len(key))[:, None], key.shape) == 0)[good]
        out.append((key[good].astype(np.int64) | np.int64(block) << np.int64(32), fps[which].view(np.int64), home))
    return tuple(np.concatenate(x) for x in zip(*out))


def close_pairs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with x[i] and y[j] different in 1 to THRESHOLD bits, some rows of x at a time."""
    step, found = max(1, (1 << 20) // max(1, len(y))), [(np.empty(0, np.int64),) * 2]
    x, y = x.view(np.uint64), y.view(np.uint64)
    for at in range(0, len(x), step):
        d = np.bitwise_count(x[at : at + step, None] ^ y[None, :])
        i, j = np.nonzero((d <= THRESHOLD) & (d > 0))
        found.append((i + at, j))
    return tuple(np.concatenate(z) for z in zip(*found))


def _compare(key: np.ndarray, fp: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among whole groups of equal keys, reduced to a forest."""
    order = np.lexsort((~home, key))  # those at home come first
    key, fp, home = key[order], fp[order], home[order]
    cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(cut, len(key)))
    homes = np.add.reduceat(home.astype(np.int64), cut) if len(cut) else cut
    pairs = homes * size
    a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    small = (size > 1) & (homes > 0) & (pairs <= 4096)
    c, s, h = cut[small], size[small], homes[small]
    left = np.repeat(c, h) + (np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h))
    width = np.repeat(s, h)
    i = np.repeat(left, width)
    j = np.repeat(np.repeat(c, h), width) + (np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width))
    d = np.bitwise_count(fp[i].view(np.uint64) ^ fp[j].view(np.uint64))
    near = (d <= THRESHOLD) & (d > 0)
    a.append(fp[i[near]])
    b.append(fp[j[near]])
    for c, s, h in zip(*(x[pairs > 4096] for x in (cut, size, homes))):
        for at in range(c, c + h, 1024):
            i, j = close_pairs(fp[at : min(at + 1024, c + h)], fp[c : c + s])
            u, v = forest(fp[at + i], fp[c + j])
            a.append(u)
            b.append(v)
    return forest(np.concatenate(a), np.concatenate(b))


def fingerprint_links(fps: DataFrame, column: str = "fp") -> DataFrame:
    """Links (a, b) whose components are those of all pairs of distinct fingerprints at distance 1 to 3. Not every pair is listed: each
    batch of anchors emits a spanning forest, so a dense group gives no more rows than it has members."""
    schema = "a long, b long, part int, home boolean"

    def spread(batches):
        for rows in batches:
            for at in range(0, len(rows), 8192):
                key, fp, home = replicate(rows.column(0).slice(at, 8192).to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(home)], ["key", "fp", "home"])

    def out(a, b, part=None, home=None):
        n = len(a)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(part, pa.int32()) if part is not None else pa.nulls(n, pa.int32()), pa.array(home) if home is not None else pa.nulls(n, pa.bool_())], ["a", "b", "part", "home"])

    def compare(batches):
        """Groups of sorted rows, whole groups at a time; a group beyond FULL goes out as it is, cut into numbered parts."""
        held, full, seen = None, None, 0
        for rows in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in rows.columns]
            held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            key = held[0]
            if full is not None:
                n = int(np.searchsorted(key, full, "right"))
                yield out(key[:n], held[1][:n], (seen + np.arange(n)) // SQUARE, held[2][:n])
                seen += n
                held = [x[n:] for x in held]
                key = held[0]
                if not len(key):
                    continue
            done = int(np.searchsorted(key, key[-1], "left"))
            if len(key) - done > FULL:
                full, seen = key[-1], len(key) - done
                yield out(key[done:], held[1][done:], np.arange(seen) // SQUARE, held[2][done:])
                if done:
                    yield out(*_compare(*(x[:done] for x in held)))
                held = None
                continue
            full = None
            if done >= 1 << 16:
                yield out(*_compare(*(x[:done] for x in held)))
                held = [x[done:] for x in held]
        if held is not None and len(held[0]):
            yield out(*_compare(*held))

    def squares(batches):
        """One square of a full anchor: the rows of one part at home there against those of another, on either side."""
        held = None

        def one(key, x, y, fp, home, side):
            one_side, other = side == 0, side == 1
            links = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for at_home, all_of in ((one_side, other), (other, one_side)):
                p, q = fp[at_home & home], fp[all_of]
                for at in range(0, len(p), 1024):
                    i, j = close_pairs(p[at : at + 1024], q)
                    u, v = forest(p[at + i], q[j])
                    links[0].append(u)
                    links[1].append(v)
            return out(*forest(np.concatenate(links[0]), np.concatenate(links[1])))

        for rows in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in rows.columns]
            held = new if held is None else [np.concatenate(z) for z in zip(held, new)]
            mark = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1]) | (held[2][1:] != held[2][:-1])) + 1
            for a, b in zip(np.concatenate([[0], mark[:-1]]), mark):
                yield one(*(c[a:b] for c in held))
            if len(mark):
                held = [c[mark[-1] :] for c in held]
        if held is not None and len(held[0]):
            yield one(*held)

    copies = fps.select(column).where(F.col(column).isNotNull()).distinct().mapInArrow(tidy(spread), "key long, fp long, home boolean")
    first = written(copies.repartition("key").sortWithinPartitions("key").mapInArrow(tidy(compare), schema), "anchors")
    rest = first.where("part IS NOT NULL")
    links = first.where("part IS NULL").select("a", "b")
    if rest.isEmpty():
        return links
    parts = rest.groupBy(F.col("a").alias("key")).agg(F.max("part").alias("last"))
    rest = rest.select(F.col("a").alias("key"), F.col("b").alias("fp"), "part", "home").join(parts, "key")
    there = rest.select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    side = F.when(F.col("part") <= F.col("other"), 0).otherwise(1)
    cells = there.select("key", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "fp", "home", side.alias("side"))
    cells = cells.unionByName(cells.where("x = y").withColumn("side", F.lit(1)))
    more = cells.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(tidy(squares), schema)
    return links.unionByName(more.select("a", "b"))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fp, component_id) for every row: component_id is the smallest key reachable over links of fingerprints, the row's own
    included. Equal fingerprints are one node, so copies are never paired. Rows without words have fingerprint zero and are linked like
    any other; a null key takes part but never is the smallest, unless its class has no other. An empty table gives an empty table."""
    rows = written(fingerprints(docs, key, text, shingle), "fingerprints")
    nodes = written(rows.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
    roots = components(fingerprint_links(nodes))
    linked = nodes.join(roots.withColumnRenamed("node", "fp"), "fp")
    low = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_linked = linked.join(low, "root").select("fp", "component_id")
    of_all = nodes.join(of_linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return rows.join(written(of_all, "classes"), "fp").select(F.col("key").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of docs without those that are not the first of their class, with the columns of docs. Rows with the same key are the same
    document and stay or go together; a row without a key cannot be named and stays."""
    gone = classes(docs, key, text, shingle).where(F.col(key) != F.col("component_id")).select(key).distinct()
    return docs.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)
