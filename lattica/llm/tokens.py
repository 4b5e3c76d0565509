"""Token ids in word-aligned Simple-8b files: encode documents, write shards in document order, read them back.

A shard is a run of segments. A segment holds whole documents and about a million ids:

    header   magic b"S8BSEG1\\0", documents, ids, blocks, words (4 little-endian uint64)
    documents  doc_id (int64), 1 if the id is null (uint8), number of ids (uint64)
    blocks     for each 256 ids the place of their first word (uint64)
    words      64-bit words: 4 bits of selector above 60 bits of payload

Selector s below 14 packs COUNT[s] ids of BITS[s] bits each, the first in the low bits; a block's last word may have unused
places, which are zero. Selector 15 is the escape: its payload is unused and the next word is one id as it is. Every block
starts at a word of its own, so blocks are packed and unpacked side by side in numpy, and any block can be read alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import buffers, filesystem, kept, mix64, shared_dir, slabs, tidy, word_bounds

MAGIC, BLOCK, SEGMENT_IDS = b"S8BSEG1\0", 256, 1 << 20
COUNT = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = 60 // COUNT
ESCAPE = 15
CACHED_WORDS = 800_000
_SPAN = np.zeros(16, np.int64)
_SPAN[:14] = COUNT


def _widest(width: np.ndarray) -> dict[int, np.ndarray]:
    """For each count of COUNT the greatest width among so many neighbours along the rows, built from shorter runs."""
    runs = {1: width}
    for n, a, b in ((2, 1, 1), (3, 2, 1), (4, 2, 2), (5, 3, 2), (6, 3, 3), (7, 4, 3), (8, 4, 4), (10, 5, 5), (12, 6, 6), (15, 8, 7), (20, 10, 10), (30, 15, 15), (60, 30, 30)):
        runs[n] = np.maximum(runs[a][:, : width.shape[1] - n + 1], runs[b][:, a : a + width.shape[1] - n + 1])
    return runs


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of unsigned 64-bit ids; all blocks advance together, one word a step."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    # ids behind a block's end are zero, so that a last word may reach over it
    room = np.zeros((blocks, BLOCK + 60), np.uint64)
    whole = np.zeros(blocks * BLOCK, np.uint64)
    whole[:n] = ids
    room[:, :BLOCK] = whole.reshape(blocks, BLOCK)
    width = np.zeros(room.shape, np.uint8)
    # bits of a number: a double's exponent, except where rounding could carry into it
    exponent = (whole.astype(np.float64).view(np.int64) >> 52) - 1022
    wide = np.flatnonzero(whole >> np.uint64(53))
    exponent[wide] = np.searchsorted(np.uint64(1) << np.arange(64, dtype=np.uint64), whole[wide], "right")
    width[:, :BLOCK] = np.maximum(exponent, 0).reshape(blocks, BLOCK)
    runs = _widest(width)
    best = np.full((blocks, BLOCK), ESCAPE, np.int8)
    for s in range(13, -1, -1):
        best[runs[COUNT[s]][:, :BLOCK] <= BITS[s]] = s
    last = np.minimum(np.arange(1, blocks + 1) * BLOCK, n) - np.arange(blocks) * BLOCK
    span = np.maximum(_SPAN, 1)
    pos, rows, steps, picks = np.zeros(blocks, np.int64), np.arange(blocks), [], []
    while (pos < last).any():
        chosen = best[rows, np.minimum(pos, BLOCK - 1)].astype(np.int64)
        steps.append(pos)
        picks.append(chosen)
        pos = pos + span[chosen]
    at, pick = np.stack(steps, 1), np.stack(picks, 1)
    real = at < last[:, None]
    block, here, chosen = np.nonzero(real)[0], at[real], pick[real]
    place = np.concatenate([[0], np.cumsum(1 + (chosen == ESCAPE))])
    words = np.zeros(place[-1], np.uint64)
    place, flat = place[:-1], block * (BLOCK + 60) + here
    room = room.ravel()
    for s in range(14):
        some = np.flatnonzero(chosen == s)
        if not len(some):
            continue
        word, start = np.full(len(some), np.uint64(s) << np.uint64(60)), flat[some]
        for j in range(COUNT[s]):
            word |= room[start + j] << np.uint64(j * BITS[s])
        words[place[some]] = word
    some = np.flatnonzero(chosen == ESCAPE)
    words[place[some]] = np.uint64(ESCAPE) << np.uint64(60)
    words[place[some] + 1] = room[flat[some]]
    return words, place[np.searchsorted(block, np.arange(blocks))].astype(np.uint64)


def unpack(words: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """The n ids of pack(); only raw words after an escape need a look at their neighbour."""
    out = np.zeros(-(-n // BLOCK) * BLOCK + 64, np.uint64)
    if not n:
        return out[:0]
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(selector == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    span = np.where(raw, 1, np.where(selector == ESCAPE, 0, _SPAN[selector]))
    before = np.concatenate([[0], np.cumsum(span)])[:-1]
    block = np.searchsorted(first, np.arange(len(words), dtype=np.uint64), "right") - 1
    pos = block * BLOCK + before - before[first.astype(np.int64)][block]
    for s in range(14):
        rows = np.flatnonzero((selector == s) & ~raw)
        if not len(rows):
            continue
        mask = np.uint64((1 << int(BITS[s])) - 1)
        end = np.minimum((block[rows] + 1) * BLOCK, n)
        for j in range(COUNT[s]):
            there = pos[rows] + j
            ok = there < end
            out[there[ok]] = ((words[rows] >> np.uint64(j * BITS[s])) & mask)[ok]
    rows = np.flatnonzero(raw)
    out[pos[rows]] = words[rows]
    return out[:n]


def segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    words, first = pack(ids)
    null = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([
        MAGIC, struct.pack("<4Q", len(doc_ids), len(ids), len(first), len(words)),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), null.tobytes(), counts.astype("<u8").tobytes(),
        first.astype("<u8").tobytes(), words.astype("<u8").tobytes(),
    ])


def segments(stream) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc_ids, counts, ids) of each segment of an open shard, one at a time."""
    while head := stream.read(len(MAGIC) + 32):
        if head[: len(MAGIC)] != MAGIC or len(head) < len(MAGIC) + 32:
            raise ValueError("not a segment of Simple-8b ids")
        docs, n, blocks, words = struct.unpack("<4Q", head[len(MAGIC) :])
        take = lambda kind, k: np.frombuffer(stream.read(np.dtype(kind).itemsize * k), kind)
        keys, null, counts, first, packed = take("<i8", docs), take("u1", docs), take("<u8", docs), take("<u8", blocks), take("<u8", words)
        yield [None if z else int(k) for k, z in zip(keys, null)], counts, unpack(packed, first, n)


def word_keys(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, first 8 bytes, last 8 bytes) of words. Up to 16 bytes a word is its length and its two ends, which the key hashes; Python's
    hash of the bytes goes into the key of a longer one."""
    eights = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), 0, (1,))
    size = ends - starts
    unused = (8 * (8 - np.minimum(size, 8))).astype(np.uint64)
    head = eights[starts] << unused
    tail = eights[np.maximum(ends - 8, starts)] << unused
    key = mix64(head ^ mix64(tail + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    long = np.flatnonzero(size > 16)
    if len(long):
        key[long] ^= np.fromiter((hash(data[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist())), np.int64, len(long)).view(np.uint64)
    return key, head, tail


class Encoder:
    """Ids of whole texts. A tokenizer that splits at white space before its merges gives a text the ids of its words in turn, so each
    distinct word is encoded once and kept, CACHED_WORDS at most. Any other tokenizer gets the whole text."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = self._splits_at_space()
        self.mark = next(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not t.normalized and t.content[:1] == "<"), None)
        self.forget()

    def forget(self) -> None:
        """Empties what is kept: of each word the key, length and ends (sorted by key) and its number, and in `ids` the ids of word w from
        start[w] to start[w + 1]."""
        self.key, self.head, self.tail = (np.empty(0, np.uint64) for _ in range(3))
        self.size, self.number = np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.start, self.uses = np.empty(0, np.uint32), np.zeros(1, np.int64), np.empty(0, np.int32)

    def prune(self) -> None:
        """Keeps the words that most batches had, half as many as may be kept at most."""
        most, least = CACHED_WORDS // 2, 2
        while (self.uses >= least).sum() > most:
            least += 1
        keep = self.uses >= least
        size = np.diff(self.start)
        of_key = keep[self.number]
        self.key, self.head, self.tail, self.size = (c[of_key] for c in (self.key, self.head, self.tail, self.size))
        self.number = (np.cumsum(keep) - 1)[self.number[of_key]]
        self.ids, self.start, self.uses = self.ids[np.repeat(keep, size)], np.concatenate([[0], np.cumsum(size[keep])]), self.uses[keep]

    def _splits_at_space(self) -> bool:
        """Whether white space separates words and leaves no trace: it is dropped, and added tokens hold none and take none from beside them."""
        import json

        said = json.loads(self.tokenizer.to_str())
        split = json.dumps(said.get("pre_tokenizer") or "")
        added = said.get("added_tokens") or []
        dropped = "\\\\s\\\\p{L}\\\\p{N}]+" in split and '"behavior": "Removed"' in split and '"invert": true' in split
        return dropped and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or not a["content"].strip() or a["content"].split() != [a["content"]] for a in added)

    def _learn(self, new: list[bytes]) -> np.ndarray:
        """Encodes new words, many to a call, and gives their numbers: an added token that no word contains stands between them and shows
        where each ends."""
        mark = self.mark and self.mark[1]
        odd = [i for i, w in enumerate(new) if not mark or b"<" in w]
        plain = [i for i, w in enumerate(new) if mark and b"<" not in w]
        parts, sizes = [], []
        groups = [[new[i] for i in plain[at : at + 256]] for at in range(0, len(plain), 256)]
        for words, said in zip(groups, self.tokenizer.encode_batch_fast([self.mark[0].join(w.decode() for w in g) for g in groups], add_special_tokens=False)):
            got = np.array(said.ids, np.uint32)
            ends = np.append(np.flatnonzero(got == mark), len(got))
            if len(ends) != len(words):
                raise ValueError("the tokenizer lost a mark between words")
            sizes.append(np.diff(ends, prepend=-1) - 1)
            parts.append(got[got != mark])
        for x in self.tokenizer.encode_batch([new[i].decode() for i in odd], add_special_tokens=False):
            sizes.append(np.array([len(x.ids)]))
            parts.append(np.array(x.ids, np.uint32))
        number = np.empty(len(new), np.int64)
        number[[*plain, *odd]] = np.arange(len(new)) + len(self.uses)
        self.ids = np.concatenate([self.ids, *parts])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.concatenate(sizes))])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int32)])
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one behind the other, how many each text has); a null is an empty text."""
        raw, offsets = buffers(texts)
        starts, ends = word_bounds(raw, offsets)
        data = raw.tobytes()
        key, head, tail = word_keys(data, starts, ends)
        which, names = pd.factorize(key)
        first = np.empty(len(names), np.int64)
        first[which[::-1]] = np.arange(len(key) - 1, -1, -1)
        size = ends - starts
        if not self.by_word or any((x[first][which] != x).any() for x in (head, tail, size)):
            # no tokenizer of words, or two words share a key: whole texts
            found = [x.ids for x in self.tokenizer.encode_batch([t or "" for t in texts.to_pylist()], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.array([len(x) for x in found], np.int64)
        if len(self.key) > CACHED_WORDS:
            self.prune()
        key, head, tail, size = key[first], head[first], tail[first], size[first]
        at = np.minimum(np.searchsorted(self.key, key), max(len(self.key) - 1, 0))
        known = (self.key[at] == key) & (self.head[at] == head) & (self.tail[at] == tail) & (self.size[at] == size) if len(self.key) else np.zeros(len(key), bool)
        word = np.empty(len(key), np.int64)
        word[known] = self.number[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            word[new] = self._learn([data[a:b] for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist())])
            new = new[np.argsort(key[new])]
            to = np.searchsorted(self.key, key[new])
            self.key, self.head, self.tail, self.size, self.number = (np.insert(c, to, x[new]) for c, x in ((self.key, key), (self.head, head), (self.tail, tail), (self.size, size), (self.number, word)))
        self.uses[word] += 1
        word = word[which]
        begin = self.start[word]
        size = self.start[word + 1] - begin
        total = np.concatenate([[0], np.cumsum(size)])
        there = np.arange(total[-1], dtype=np.int32) + np.repeat((begin - total[:-1]).astype(np.int32), size)
        bounds = np.searchsorted(starts, offsets)
        return self.ids[there], np.diff(total[bounds])


_encoders: dict[str, Encoder] = {}
kept.append(_encoders)


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every whole text, adds end_id, and writes one shard for each range of keys, in ascending order of key (null first; equal
    keys by a hash of the text). A null text is empty: its document is the end id alone. Other columns are ignored. Returns a manifest: a row for
    each shard with its path, documents, ids, and `start`, the ids of all shards before it. An empty table has no shards.

    A shard has its task's attempt in its name and is renamed after its last byte. The manifest has the shards of the attempts that counted,
    so a task that runs again, wherever its first run ended, changes nothing."""
    spark = docs.sparkSession
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        task = TaskContext.get()
        part = task.partitionId()
        fs, root = filesystem(folder)
        name, temporary = f"{root}/shard-{part:07d}-{task.taskAttemptId()}.s8b", f"{root}/_shard-{part:07d}-{task.taskAttemptId()}"
        tok, docs_n, ids_n, stream = encoder(tokenizer), 0, 0, None
        held_ids, held_counts, held_docs, held = [], [], [], 0

        def flush():
            nonlocal held_ids, held_counts, held_docs, held
            stream.write(segment(held_docs, np.concatenate(held_counts), np.concatenate(held_ids)))
            held_ids, held_counts, held_docs, held = [], [], [], 0

        for rows in slabs(batches, 4 << 20):
            stream = stream or fs.open_output_stream(temporary)
            ids, counts = tok.encode(rows.column(1))
            ids = np.insert(ids, np.cumsum(counts), end_id)
            held_ids.append(ids)
            held_counts.append(counts + 1)
            held_docs += rows.column(0).to_pylist()
            held, docs_n, ids_n = held + len(ids), docs_n + len(rows), ids_n + len(ids)
            if held >= SEGMENT_IDS:
                flush()
        if stream:
            if held:
                flush()
            stream.close()
            fs.move(temporary, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name.rsplit("/", 1)[1]], "documents": [docs_n], "ids": [ids_n]}, pa.schema([("part", pa.int32()), ("name", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    # the ranges are found from a sample of ids, hashes and, for rows that are the same in both, row numbers, so equal rows can be any number
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).withColumn("h", F.xxhash64("t")).withColumn("r", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange("k", "h", "r").sortWithinPartitions("k", "h", "t").select("k", "t")
    shards = sorted(ordered.mapInArrow(tidy(write, keeping=True), "part int, name string, documents long, ids long").collect())  # a row for each task
    start, rows = 0, []
    for s in shards:
        rows.append((f"{folder}/{s.name}", s.documents, s.ids, start))
        start += s.ids
    return spark.createDataFrame(rows, "path string, documents long, ids long, start long")


def read_ids(manifest: DataFrame) -> DataFrame:
    """Documents of the shards of a manifest: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as
    little-endian unsigned 32-bit integers) and first_id. A segment is in memory at a time."""

    def read(batches):
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns)):
                fs, file = filesystem(path)
                with fs.open_input_stream(file) as stream:
                    for keys, counts, ids in segments(stream):
                        ends = np.cumsum(counts.astype(np.int64))
                        small = ids.astype("<u4")
                        crc = [zlib.crc32(small[e - int(c) : e].tobytes()) for e, c in zip(ends, counts)]
                        starts = start + ends - counts.astype(np.int64)
                        start = int(start + ends[-1])
                        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(starts, pa.int64()), pa.array(counts.astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = manifest.select("path", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(tidy(read, keeping=True), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes the shards to the shared folder and reads them back."""
    return read_ids(write_ids(docs, shared_dir(spark, "tokens"), tokenizer, end_id))
