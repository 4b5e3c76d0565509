"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks.

A phrase is a window of `window` words. Its anchor is the least hash among its runs of GRAM words, so equal phrases have equal anchors, and
neighbouring phrases with the same anchor are one run. The reference is cut into blocks by anchor: a block holds, once each, the different
runs around one anchor, and how often they stand in the corpus. Every phrase that could match a run is in the run's own block, so a
document that is parsed run by run against one block each is parsed against the whole corpus, whatever its size.

1. Anchors are counted. A run whose anchor occurs once has an empty block and matches nothing.
2. A block's phrases are indexed by a suffix array. A run is factored greedily: the longest stretch of phrases from the current one on that
   stands elsewhere in the block, or in another copy of the run, is a factor of at least `window` words. Parsing goes on at the first
   phrase that the factor does not hold, not behind its last word, so phrases across the boundary of two factors are checked too.
3. Factors go to all documents that have the run. One that reaches its run's end goes on in the next run, which is parsed by its own block,
   so spans in a document are the unions of its factors.
4. Words under a factor are removed.

Where very many different runs share an anchor (a common passage in different surroundings), one task does not hold the block: its phrases
are counted by hash instead, which spreads them over all tasks. Words are compared by 64-bit hashes: two phrases must agree in the hash of
their anchor and in their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buffers, mix64, slabs, sliding_min, tidy, window_hashes, word_bounds, word_hashes, _words, written

WINDOW, GRAM = 35, 8
#: Different runs around one anchor up to which they are one block, and phrases of whole blocks that are indexed at a time.
BLOCK_RUNS, INDEXED = 2000, 1 << 17


def hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and the number of the first word of each text (one more for the end)."""
    raw, offsets = buffers(column)
    starts, ends = word_bounds(raw, offsets)
    return word_hashes(raw, starts, ends), np.searchsorted(starts, offsets)


def runs(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(text, start in the text, phrases, anchor, hash of the run's words) of every run."""
    gram = min(GRAM, window)
    width = window - gram + 1
    n = len(words) - window + 1
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    grams = window_hashes(words, gram)
    least = sliding_min(grams >> np.uint64(28) << np.uint64(28) | np.arange(len(grams), dtype=np.uint64), width)
    place = (least & np.uint64((1 << 28) - 1)).astype(np.int64)
    whole = row[:n] == row[window - 1 :]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | ~whole[:-1] | (row[1:n] != row[: n - 1])
    start = np.flatnonzero(whole & new)
    ends = np.flatnonzero(whole & np.append(new[1:] | ~whole[1:], True))
    length = ends - start + 1
    up, down = _words.upto(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    stop = start + length + window - 1
    whole_hash = mix64((total[stop] - total[start]) * down[start] + length.astype(np.uint64))
    return row[start], start - first[row[start]], length, grams[place[start]], whole_hash


def longest(phrase: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each phrase of runs that stand one behind the other the longest stretch from it on, within its run, that also starts elsewhere.

    Ranks of stretches of 1, 2, 4, ... phrases give the suffix array and the length that two suffixes share; the longest match of a
    suffix is with one of its neighbours there. A stretch beyond a run's end is equal to none."""
    n = len(phrase)
    if not n:
        return np.empty(0, np.int64)
    at = np.arange(n)
    left = np.repeat(np.cumsum(length), length) - at
    rank = np.unique(phrase, return_inverse=True)[1].astype(np.int64)
    levels, step = [rank], 1
    while step < int(length.max()):
        second = np.where(left > step, rank[np.minimum(at + step, n - 1)], at - n)
        rank = np.unique(rank * (2 * n + 1) + second + n, return_inverse=True)[1].astype(np.int64)
        # beyond the end a stretch has a rank of its own already
        levels.append(rank)
        step *= 2
    order = np.lexsort((at, rank))
    a, b = order[:-1], order[1:]
    common, room = np.zeros(n - 1, np.int64), np.minimum(left[a], left[b])
    for k in range(len(levels) - 1, -1, -1):
        here = np.flatnonzero(common + (1 << k) <= room)
        same = levels[k][a[here] + common[here]] == levels[k][b[here] + common[here]]
        common[here[same]] += 1 << k
    out = np.zeros(n, np.int64)
    out[b] = common
    out[a] = np.maximum(out[a], common)
    return out


def parse(anchor: np.ndarray, twice: np.ndarray, length: np.ndarray, phrase: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (run, first phrase, phrases) of the runs of whole blocks. A run that stands twice or more in the corpus has its other copy
    in the block, so its factor is the whole run."""
    most = longest(mix64(phrase ^ mix64(np.repeat(anchor, length))), length)
    begin = np.cumsum(length) - length
    left = np.repeat(begin + length, length) - np.arange(len(phrase))
    most = np.where(np.repeat(twice, length), left, most)
    run, at, out = np.arange(len(length)), np.zeros(len(length), np.int64), [(np.empty(0, np.int64),) * 3]
    while len(run):
        found = most[begin[run] + at]
        hit = found > 0
        out.append((run[hit], at[hit], found[hit]))
        at = at + np.maximum(found, 1)
        more = at < length[run]
        run, at = run[more], at[more]
    return tuple(np.concatenate(x) for x in zip(*out))


def spans(docs: DataFrame, window: int) -> DataFrame:
    """(did, th, start, n): n phrases from word `start` of a document on stand elsewhere. docs: did, th and text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slabs(batches):
            text, start, n, anchor, run = runs(*hashed(rows.column(2)), window)
            did, th = rows.column(0).take(pa.array(text)), rows.column(1).take(pa.array(text))
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(run.view(np.int64)), did, th, pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], ["anchor", "run", "did", "th", "start", "n"])

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The phrases of the listed runs, eight bytes each."""
        for rows in slabs(batches, 1 << 20):
            words, first = hashed(rows.column(0))
            listed = rows.column(1)
            own = listed.flatten()
            anchor, run, start, n, twice, crowd = (own.field(i).to_numpy(zero_copy_only=False) for i in range(6))
            begin = np.repeat(first[:-1], np.diff(listed.offsets.to_numpy())) + start
            n = n.astype(np.int64)
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
            data = window_hashes(words, window)[at]
            ends = np.concatenate([[0], 8 * np.cumsum(n)]).astype(np.int32)
            packed = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(data)])
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(run), pa.array(twice), pa.array(crowd), packed], ["anchor", "run", "twice", "crowd", "phrases"])

    def unpacked(rows: pa.RecordBatch) -> list[np.ndarray]:
        """anchor, run, twice, length, phrases of (anchor, run, twice, phrases)"""
        raw, offsets = buffers(rows.column(3))
        return [*(rows.column(i).to_numpy(zero_copy_only=False) for i in range(3)), np.diff(offsets) // 8, raw.view(np.uint64)]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out(anchor, run, twice, length, phrase):
            # rows of a document that stands twice in the table list a run twice
            new = np.ones(len(run), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (run[1:] != run[:-1])
            phrase, anchor, run, twice, length = phrase[np.repeat(new, length)], anchor[new], run[new], twice[new], length[new]
            which, at, k = parse(anchor.view(np.uint64), twice, length, phrase)
            return pa.RecordBatch.from_arrays([pa.array(anchor[which]), pa.array(run[which]), pa.array(at.astype(np.int32)), pa.array(k.astype(np.int32))], ["anchor", "run", "at", "k"])

        for batch in batches:
            for i in range(0, len(batch), 2048):
                held.append(unpacked(batch.slice(i, 2048)))
                n += len(held[-1][4])
                if n < INDEXED or held[0][0][0] == held[-1][0][-1]:
                    continue
                whole = [np.concatenate(x) for x in zip(*held)]
                done = int(np.searchsorted(whole[0], whole[0][-1], "left"))
                cut_at = int(whole[3][:done].sum())
                yield out(*(c[:done] for c in whole[:4]), whole[4][:cut_at])
                held = [[*(c[done:] for c in whole[:4]), whole[4][cut_at:]]]
                n = len(held[0][4])
        if n:
            yield out(*(np.concatenate(x) for x in zip(*held)))

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 2048):
                anchor, run, twice, length, phrase = unpacked(batch.slice(i, 2048))
                at = np.arange(len(phrase)) - np.repeat(np.cumsum(length) - length, length)
                phrase = mix64(phrase ^ mix64(np.repeat(anchor.view(np.uint64), length))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(phrase), *(pa.array(np.repeat(c, length)) for c in (anchor, run, twice)), pa.array(at.astype(np.int32))], ["phrase", "anchor", "run", "twice", "at"])

    all_runs = docs.mapInArrow(tidy(cut), "anchor long, run long, did long, th long, start int, n int")
    # a table of its own, so that Spark can split an anchor that is in very many documents
    anchors = written(all_runs.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "anchors")
    shared = written(all_runs.join(anchors, "anchor"), "runs")
    kinds = written(shared.groupBy("anchor", "run").agg(F.count("*").alias("times"), F.min(F.struct("did", "th", "start", "n")).alias("one")), "kinds")
    crowds = written(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where(F.col("kinds") > BLOCK_RUNS).select("anchor", F.lit(True).alias("crowd")), "crowds")
    one = F.struct("anchor", "run", "one.start", "one.n", (F.col("times") > 1).alias("twice"), F.coalesce("crowd", F.lit(False)).alias("crowd"))
    listed = kinds.join(crowds, "anchor", "left").select("one.did", "one.th", one.alias("x")).groupBy("did", "th").agg(F.collect_list("x").alias("runs"))
    block = docs.join(listed, ["did", "th"]).select("text", "runs").mapInArrow(tidy(phrases), "anchor long, run long, twice boolean, crowd boolean, phrases binary")
    block = written(block, "phrases")
    few = block.where("NOT crowd").select("anchor", "run", "twice", "phrases")
    factors = few.repartition("anchor").sortWithinPartitions("anchor", "run").mapInArrow(tidy(parsed), "anchor long, run long, at int, k int")
    many = block.where("crowd").select("anchor", "run", "twice", "phrases").mapInArrow(tidy(single), "phrase long, anchor long, run long, twice boolean, at int").distinct()
    common = written(many.groupBy("phrase").agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("times")).where("times > 1").select("phrase"), "common")
    factors = written(factors.unionByName(many.join(common, "phrase").select("anchor", "run", "at", F.lit(1).alias("k"))), "factors")
    return shared.join(factors, ["anchor", "run"]).select("did", "th", (F.col("start") + F.col("at")).alias("start"), F.col("k").alias("n"))


def remove_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_removed, kept_sha256 and kept (the kept words, joined by one space) for every row of docs.

    A word is removed if it is in a window of `window` words whose words also start at another place of any document, its own included;
    windows are judged on the input. Null and empty texts, and those below `window` words, lose nothing; of two equal rows both lose
    everything from `window` words on. The key may be null or repeated, texts may have any length; an empty table gives an empty table, and
    other columns are dropped."""
    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("did"), F.xxhash64(F.col(key).isNull(), F.col(text)).alias("th"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = written(spans(rows.select("did", "th", "text"), window), "spans").groupBy("did", "th").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    schema = "key long, n_words long, n_removed long, kept_sha256 string, kept string"

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slabs(batches):
            out = []
            for k, t, listed in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                words = t.as_py().encode().split()
                n = len(words)
                if listed:
                    cover = np.zeros(n + 1, np.int64)
                    start, length = np.array([(x["start"], x["n"]) for x in listed]).T
                    np.add.at(cover, start, 1)
                    np.add.at(cover, start + length + window - 1, -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
                kept = b" ".join(words)
                out.append((k, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["key", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.join(found, ["did", "th"], "left").select("key", "text", "spans").mapInArrow(tidy(keep), schema).withColumnRenamed("key", key)
