"""Label images and channels in TIFF files (baseline: grey, strips, uncompressed or zlib) as voxel rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 8: 2, 9: 4, 11: 4, 12: 8}


def decode(data: bytes) -> Iterator[np.ndarray]:
    """The pages of a file, one at a time."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(order + "I", data[4:8])[0]
    while at:
        n = struct.unpack(order + "H", data[at : at + 2])[0]
        tags = {}
        for i in range(n):
            tag, kind, count = struct.unpack(order + "HHI", data[at + 2 + 12 * i : at + 10 + 12 * i])
            size = _SIZES.get(kind, 1) * count
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(order + "I", data[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            if kind in (3, 4):
                tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I") * count, data[place : place + size]) if count == 1 else struct.unpack(f"{order}{count}{'H' if kind == 3 else 'I'}", data[place : place + size])
        width, height, bits, packed = tags[256][0], tags[257][0], tags.get(258, (8,))[0], tags.get(259, (1,))[0]
        if packed not in (1, 8, 32946) or tags.get(277, (1,))[0] != 1:
            raise ValueError("only grey images, uncompressed or zlib")
        raw = b"".join(zlib.decompress(data[o : o + c]) if packed != 1 else data[o : o + c] for o, c in zip(tags[273], tags[279]))
        kind = {1: "u", 2: "i", 3: "f"}[tags.get(339, (1,))[0]]
        yield np.frombuffer(raw, f"{order}{kind}{bits // 8}", width * height).reshape(height, width)
        at = struct.unpack(order + "I", data[at + 2 + 12 * n : at + 6 + 12 * n])[0]


def encode(pages: list[np.ndarray], compress: bool = True) -> bytes:
    """A little-endian file with a strip for each page."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        kind = {"u": 1, "i": 2, "f": 3}[page.dtype.kind]
        raw = np.ascontiguousarray(page.astype(page.dtype.newbyteorder("<"))).tobytes()
        raw = zlib.compress(raw) if compress else raw
        strip = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        at = len(out)
        struct.pack_into("<I", out, link, at)
        tags = [(256, 4, page.shape[1]), (257, 4, page.shape[0]), (258, 3, page.dtype.itemsize * 8), (259, 3, 8 if compress else 1), (262, 3, 1), (273, 4, strip), (277, 3, 1), (278, 4, page.shape[0]), (279, 4, len(raw)), (339, 3, kind)]
        out += struct.pack("<H", len(tags))
        for tag, t, value in tags:
            out += struct.pack("<HHI", tag, t, 1) + (struct.pack("<HH", value, 0) if t == 3 else struct.pack("<I", value))
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_voxels(spark: SparkSession, path: str, value: str = "label") -> DataFrame:
    """(file, z, y, x, value) of the voxels that are not zero; a file of one page has the layer 0. Pages are decoded one at a time."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kind = "long" if value == "label" else "double"

    def rows(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for z, page in enumerate(decode(bytes(content))):
                    y, x = np.nonzero(page)
                    yield pd.DataFrame({"file": name, "z": np.full(len(y), z, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), value: page[y, x].astype(np.int64 if kind == "long" else float)})

    return files.mapInPandas(rows, f"file string, z int, y int, x int, {value} {kind}")


def write_voxels(voxels: DataFrame, folder: str, shape: tuple[int, int, int]) -> DataFrame:
    """A file for each layer, made by the task that has the layer's rows; returns (z, path). Layers without rows have no file."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        z = int(pdf["z"].iloc[0])
        page = np.zeros(shape[1:], np.uint32)
        page[pdf["y"], pdf["x"]] = pdf["label"]
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/layer-{z:06d}.tif") as f:
            f.write(encode([page]))
        return pd.DataFrame({"z": [z], "path": [f"{folder}/layer-{z:06d}.tif"]})

    return voxels.groupBy("z").applyInPandas(one, "z int, path string")
