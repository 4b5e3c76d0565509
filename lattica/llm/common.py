"""What the operators of this package share: the cluster's shared folder, tables written there, and hashing of word sequences in numpy."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes that end a word: space and the controls 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder named by spark.checkpoint.dir, with the scheme of the file system that it is in. Where the session names no
    folder, a local session gets one of its own (tests); a cluster must name one that all its machines share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lattica-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = spark._jvm.org.apache.hadoop.fs.Path(base)
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once to the shared folder and read from there: lineage ends here and lost executors cost nothing."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it, so that no column of df has it in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI; works on executors and on the driver."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd, so invertible modulo 2**64
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_BYTES = (_BYTE, mix64(_BYTE))


class Powers:
    """Powers of a base and of its inverse modulo 2**64, kept and extended on demand."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.empty(0, np.uint64), np.empty(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self.up[:n], self.down[:n]


_bytes, _words = Powers(_BASE), Powers(_STEP)


def word_bounds(raw: np.ndarray, offsets: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes; with offsets, a run ends where a text begins."""
    n = len(raw)
    word = np.zeros(n + 2, bool)
    np.logical_not(SPACE[raw], out=word[1:-1])
    begin, end = word[1:] & ~word[:-1], word[:-1] & ~word[1:]  # at byte i, between i - 1 and i
    if offsets is not None:
        cut = offsets[word[offsets] & word[np.minimum(offsets + 1, n + 1)]]
        begin[cut] = end[cut] = True
    return np.flatnonzero(begin), np.flatnonzero(end)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word raw[start:end]; equal words give equal hashes wherever they stand. There are two such hashes."""
    up, down = _bytes.upto(len(raw))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTES[which][raw] * up, out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each run of k word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _words.upto(len(words))
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up, out=total[1:])
    return mix64((total[k:] - total[:n]) * down[:n])


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
#: Spans longer than this are hashed one by one.
_LONG_SPAN = 512


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return x << np.uint64(r) | x >> np.uint64(64 - r)


def xxh64(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of each span raw[start:end], all spans side by side."""
    import xxhash

    data = raw.tobytes()
    eights = np.ndarray((len(raw) + 1,), "<u8", data + bytes(8), 0, (1,))
    mixed = lambda acc, lane: _rotl(acc + lane * _P2, 31) * _P1
    size, at, zero = ends - starts, starts.copy(), np.uint64(0)
    h = np.uint64(seed) + _P5 + size.astype(np.uint64)
    wide = np.flatnonzero((size >= 32) & (size <= _LONG_SPAN))
    if len(wide):
        stripes = size[wide] // 32
        order = np.argsort(-stripes, kind="stable")
        wide, stripes = wide[order], stripes[order]
        lanes = [np.full(len(wide), v & 0xFFFFFFFFFFFFFFFF, np.uint64) for v in (seed + int(_P1) + int(_P2), seed + int(_P2), seed, seed - int(_P1))]
        for k in range(int(stripes[0])):
            n = int(np.searchsorted(-stripes, -k, "left"))
            for i, lane in enumerate(lanes):
                lane[:n] = mixed(lane[:n], eights[starts[wide[:n]] + 32 * k + 8 * i])
        acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            acc = (acc ^ mixed(zero, lane)) * _P1 + _P4
        h[wide] = acc + size[wide].astype(np.uint64)
        at[wide] += 32 * stripes
    left = np.where(size > _LONG_SPAN, 0, ends - at)
    for _ in range(3):
        some = np.flatnonzero(left >= 8)
        h[some] = _rotl(h[some] ^ mixed(zero, eights[at[some]]), 27) * _P1 + _P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    h[some] = _rotl(h[some] ^ (eights[at[some]] & np.uint64(0xFFFFFFFF)) * _P1, 23) * _P2 + _P3
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero(left > 0)
        h[some] = _rotl(h[some] ^ (eights[at[some]] & np.uint64(0xFF)) * _P5, 11) * _P1
        at[some] += 1
        left[some] -= 1
    h = (h ^ h >> np.uint64(33)) * _P2
    h = (h ^ h >> np.uint64(29)) * _P3
    h ^= h >> np.uint64(32)
    for i in np.flatnonzero(size > _LONG_SPAN):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]], seed)
    return h


#: A byte's bits, the high one first, as eight counters of eight bits.
_LANES = np.array([int.from_bytes(bytes((b >> (7 - i)) & 1 for i in range(8)), "little") for b in range(256)], np.uint64)


def majorities(h: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A word of 64 bits for each text, whose hashes stand one behind the other: a bit is 1 if it is set in over half of them."""
    out = np.zeros(len(count), np.uint64)
    if not len(h):
        return out
    row = np.repeat(np.arange(len(count)), count)
    place = np.arange(len(h)) - (np.cumsum(count) - count)[row]
    # eight counters share a word, so they are emptied after 255 hashes
    piece = np.flatnonzero(place % 255 == 0)
    owner = row[piece]
    cut = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    half, byte_of = count[owner[cut]][:, None], h.astype(">u8").view(np.uint8).reshape(-1, 8)
    bits = np.empty((len(cut), 64), bool)
    for byte in range(8):
        part = np.add.reduceat(_LANES[byte_of[:, byte]], piece).view(np.uint8).reshape(-1, 8)
        bits[:, 8 * byte : 8 * byte + 8] = 2 * np.add.reduceat(part.astype(np.int64), cut) > half
    out[owner[cut]] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it is linked to over any number of the links) without the smallest nodes themselves."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        # roots are hung under smaller roots; other nodes follow their root, or they would lose it
        low = np.minimum(label[i], label[j])
        np.minimum.at(label, np.concatenate([label[i], label[j]]), np.concatenate([low, low]))
        while (label != label[label]).any():
            label = label[label]
        more = label[i] != label[j]
        i, j = i[more], j[more]
    own = label != np.arange(len(nodes))
    return nodes[own], nodes[label[own]]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by doubling."""
    done = 1
    while done < w:
        step = min(done, w - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def slabs(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices whose first string column has about `most` bytes; a longer row is alone."""
    for batch in batches:
        column = next(c for c in batch.columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type))
        _, offsets = buffers(column)
        at = 0
        while at < len(batch):
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def trimmed() -> None:
    """Gives back to the system what is free."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library only
    if trim:
        trim(0)


#: What workers keep from task to task, emptied by the first task that is not `keeping`.
kept: list[dict] = []


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeping: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, and what it freed goes back to the system at its end: workers outlive their tasks and wait beside those of later stages."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeping and any(kept):
            for store in kept:
                store.clear()
            trimmed()
        try:
            yield from run(batches)
        finally:
            for powers in (_bytes, _words):
                powers.up = powers.down = np.empty(0, np.uint64)
            trimmed()

    return outer
