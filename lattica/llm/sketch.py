"""Near duplicates by similarity: documents whose sets of five-word shingles have a Jaccard similarity of SIMILARITY or more.

Documents meet where all ROWS minima of one of BANDS bands agree (MinHash). A pair of similarity j misses all bands with probability
(1 - j ** ROWS) ** BANDS, 2.4e-9 at 0.8 and less above, whatever the lengths. All pairs of a meeting are compared by short signatures, which
only part those that are far apart (a pair of similarity 0.8 is parted with probability 3e-10); what stays together over any number of meetings is a group.
In a group all pairs are judged by the exact similarity of their sets, large groups in squares; only a forest of the accepted links goes
out, so that a crowd gives no more rows than it has members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix64, slabs, tidy, window_hashes, word_bounds, word_hashes, written
from .components import components
from .simhash import classes

SHINGLE, SIMILARITY = 5, 0.8
ROWS, BANDS = 5, 50
#: A signature is a byte of each of SIGNATURE minima; pairs that agree in fewer than AGREE are far apart.
SIGNATURE, AGREE = 32, 10
#: Shingles of one side of a square.
SQUARE = 1_000_000
_SEEDS = mix64(np.arange(1, 2 * ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the different shingles of each text, text after text and in order; how many each text has). Texts without words have
    none, those with fewer words than a shingle have one shingle."""
    raw, offsets = buffers(column)
    raw = _LOWER[raw]
    starts, ends = word_bounds(raw, offsets)
    first = np.searchsorted(starts, offsets)
    words = word_hashes(raw, starts, ends)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    long = window_hashes(words, shingle)
    inside = np.flatnonzero(row[: len(long)] == row[shingle - 1 :]) if len(long) else np.empty(0, np.int64)
    keys, rows = [long[inside]], [row[inside]]
    for k in range(1, shingle):
        some = np.flatnonzero(n == k)
        keys.append(window_hashes(words, k)[first[:-1][some]] if len(some) else np.empty(0, np.uint64))
        rows.append(some)
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    key, row = key[new], row[new]
    return key, np.bincount(row, minlength=len(n))


def minima(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts x BANDS * ROWS) least hashes of each text's shingles; of texts without shingles all ones."""
    out = np.full((len(count), BANDS * ROWS), np.uint64(0xFFFFFFFFFFFFFFFF))
    some = np.flatnonzero(count)
    if len(some):
        begin, h = (np.cumsum(count) - count)[some], np.empty_like(key)
        for i in range(BANDS * ROWS):
            np.bitwise_xor(key, _SEEDS[0, i], out=h)
            np.multiply(h, _SEEDS[1, i] | np.uint64(1), out=h)
            out[some, i] = np.minimum.reduceat(h, begin)
    return out


def bands(least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(texts x BANDS) keys of the bands, (texts x SIGNATURE) bytes."""
    by_band = least.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), by_band.shape[:2])
    for r in range(ROWS):
        key = mix64((key ^ by_band[:, :, r]) * np.uint64(0xD1B54A32D192ED03))
    # the bytes come from one minimum of each band, mixed, as a minimum's high bits are zeros
    return key, (mix64(np.ascontiguousarray(by_band[:, :SIGNATURE, 0])) >> np.uint64(56)).astype(np.uint8)


def tied(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph of n members in which i is linked to those of `left` where near(i, left). A member is compared with
    all that are not reached yet, so that no link between two trees is missed."""
    left, a, b = np.arange(n), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(left) > 1:
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            i = reached.pop()
            hit = near(i, left)
            if hit.any():
                new, left = left[hit], left[~hit]
                a.append(np.full(len(new), i))
                b.append(new)
                reached.extend(new.tolist())
    return np.concatenate(a), np.concatenate(b)


def similar(key: np.ndarray, count: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs of texts whose sets, as of shingle_sets(), are that similar; exact. A text without shingles is linked
    to none."""
    words, code = np.unique(key, return_inverse=True)
    code, ends = code.astype(np.int32), np.cumsum(count)
    mark = np.zeros(len(words), np.uint8)
    held, begin, codes = None, None, None

    def near(i: int, left: np.ndarray) -> np.ndarray:
        nonlocal held, begin, codes
        if held is None or 2 * len(left) < len(held):
            held = left
            inside = np.zeros(len(count), bool)
            inside[left] = True
            codes = code[np.repeat(inside, count)]
            begin = np.cumsum(count[left]) - count[left]
        own = code[ends[i] - count[i] : ends[i]]
        mark[own] = 1
        common = np.add.reduceat(mark[codes], begin, dtype=np.int64)[np.searchsorted(held, left)]
        mark[own] = 0
        return common >= similarity * (count[left] + len(own) - common)

    some = np.flatnonzero(count)
    count, ends = count[some], ends[some]
    a, b = tied(len(some), near)
    return some[a], some[b]


def groups(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes (id, bands: binary, signature: binary) that meet and are not far apart."""
    parts = [f"p{i}" for i in range(SIGNATURE // 8)]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                rows = batch.slice(at, 1024)
                key = np.frombuffer(b"".join(rows.column(1).to_pylist()), np.int64)
                part = np.frombuffer(b"".join(rows.column(2).to_pylist()), np.int64).reshape(len(rows), -1)
                ids = rows.column(0).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids, BANDS)), *(pa.array(np.repeat(part[:, i], BANDS)) for i in range(len(parts)))], ["k", "id", *parts])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ties(key, ids, part):
            sign = np.ascontiguousarray(part).view(np.uint8).reshape(len(ids), SIGNATURE)
            cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(cut, len(key)))
            two = cut[size == 2]
            near = (sign[two] == sign[two + 1]).sum(1) >= AGREE
            a, b = [ids[two[near]]], [ids[two[near] + 1]]
            for c, s in zip(cut[size > 2], size[size > 2]):
                own = sign[c : c + s]
                u, v = tied(s, lambda i, left: (own[left] == own[i]).sum(1) >= AGREE)
                a.append(ids[c + u])
                b.append(ids[c + v])
            a, b = np.concatenate(a), np.concatenate(b)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        held, n = [], 0
        for batch in batches:
            new = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if not len(new[0]):
                continue
            # a meeting that goes on over many batches is put together once
            if n >= 1 << 16 and new[0][0] != held[-1][0][-1] or n >= 1 << 16 and new[0][0] != new[0][-1]:
                whole = [np.concatenate(x) for x in zip(*held, new)]
                done = int(np.searchsorted(whole[0], whole[0][-1], "left"))
                yield ties(whole[0][:done], whole[1][:done], np.stack([c[:done] for c in whole[2:]], 1))
                held, n = [[c[done:].copy() for c in whole]], len(whole[0]) - done
            else:
                held.append(new)
                n += len(new[0])
        if n:
            whole = [np.concatenate(x) for x in zip(*held)]
            yield ties(whole[0], whole[1], np.stack(whole[2:], 1))

    longs = ", ".join(f"{p} long" for p in parts)
    copies = nodes.select("id", "bands", "signature").mapInArrow(tidy(spread), f"k long, id long, {longs}")
    return copies.repartition("k").sortWithinPartitions("k", "id").mapInArrow(tidy(meet), "a long, b long").distinct()


def similar_links(nodes: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, square: int = SQUARE) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of nodes (id, n, bands, signature) that are that similar, n being the size of a
    node's set; texts (id, text) has what they are. A group of more than `square` shingles is dealt into parts, and each two parts
    meet in a task."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(ids, keys, counts):
            ids = np.concatenate(ids)
            a, b = similar(np.concatenate(keys), np.concatenate(counts), similarity)
            return pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], ["a", "b"])

        now, held = None, ([], [], [])
        for rows in slabs(batches):
            cell = np.stack([rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in range(3)], 1)
            key, count = shingle_sets(rows.column(4))
            ids, ends = rows.column(3).to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(count)])
            cut = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]).any(1)]))
            for i, j in zip(cut, np.append(cut[1:], len(ids))):
                if now is not None and now != tuple(cell[i]):
                    yield links(*held)
                    held = ([], [], [])
                now = tuple(cell[i])
                for x, y in zip(held, (ids[i:j], key[ends[i] : ends[j]], count[i:j])):
                    x.append(y)
        if now is not None:
            yield links(*held)

    of = written(components(groups(nodes)).join(nodes.select(F.col("id").alias("node"), "n"), "node"), "groups")
    last = of.groupBy("root").agg(F.floor((F.sum("n") - 1) / square).cast("int").alias("last"))
    part = F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int")
    dealt = of.join(last, "root").select("root", F.col("node").alias("id"), part.alias("part"), F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    # parts meet in two; a part meets itself only where it is the only one
    dealt = dealt.where("other <> part").unionByName(of.join(last.where("last = 0"), "root").select("root", F.col("node").alias("id"), F.lit(0).alias("part"), F.lit(0).alias("other")))
    cells = dealt.select("root", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "id").join(texts, "id").select("root", "x", "y", "id", "text")
    return cells.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(tidy(judge), "a long, b long")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs without those that are not the smallest of their class, with the columns of docs. Documents are linked if their 64-bit
    fingerprints differ in 3 or fewer bits or if their shingles of five words are similar. Rows with the same key are the same document
    and stay or go together; a row without a key cannot be named and stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slabs(batches, 1 << 19):
            sets, count = shingle_sets(rows.column(1))
            key, sign = bands(minima(sets, count))
            ends = np.cumsum(count)
            same = [hashlib.blake2b(sets[e - n : e], digest_size=16).digest() for e, n in zip(ends, count)]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(same, pa.binary()), pa.array(count.astype(np.int64)), pa.array([x.tobytes() for x in key], pa.binary()), pa.array([x.tobytes() for x in sign], pa.binary())], ["key", "same", "n", "bands", "signature"])

    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL")
    rows = written(named.mapInArrow(tidy(run), "key long, same binary, n long, bands binary, signature binary"), "sets")
    nodes = written(rows.groupBy("same", "n", "bands", "signature").agg(F.min("key").alias("id")), "nodes")
    same = rows.select("key", "same").join(nodes.select("same", "id"), "same").where("key <> id").select(F.col("key").alias("a"), F.col("id").alias("b"))
    texts = named.withColumnRenamed("key", "id")
    short = classes(docs, key, text).where(F.col(key) != F.col("component_id")).select(F.col(key).alias("a"), F.col("component_id").alias("b"))
    links = same.unionByName(similar_links(nodes.where("n > 0"), texts, similarity)).unionByName(short)
    # a table, so that judging pairs and contracting links do not run side by side in every task
    gone = components(written(links, "links")).where("node <> root").select(F.col("node").alias(key))
    return docs.join(gone.hint("merge"), key, "left_anti").select(*docs.columns)
