"""Volumes in NIfTI files (one file, grey, either byte order, plain or gzip) as voxel rows, and layers written as such files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Size of the header, and numpy's names of the data types by their codes. Fixed values.
HEADER = 348
TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}


def header(data: bytes) -> dict:
    """What a reader needs of a header: type, shape (nz, ny, nx), where voxels begin, and the scale of their values; one or no volume in time."""
    order = next((o for o in "<>" if len(data) >= HEADER and struct.unpack(o + "i", data[:4])[0] == HEADER), None)
    if order is None or data[344:347] != b"n+1":
        raise ValueError("not a NIfTI file with its voxels inside")
    dim, code = struct.unpack(order + "8h", data[40:56]), struct.unpack(order + "h", data[70:72])[0]
    if code not in TYPES or not 1 <= dim[0] <= 7 or any(n > 1 for n in dim[4 : dim[0] + 1]):
        raise ValueError("only one volume of grey values")
    sides = [max(1, n) for n in dim[1 : min(dim[0], 3) + 1]] + [1, 1, 1]
    at, slope, inter = struct.unpack(order + "3f", data[108:120])
    plain = slope == 0 or not np.isfinite(slope)
    return {"type": order + TYPES[code], "shape": (sides[2], sides[1], sides[0]), "at": int(at), "slope": 1.0 if plain else slope, "inter": 0.0 if plain else inter}


def encode(volume: np.ndarray) -> bytes:
    """A little-endian file of a (nz, ny, nx) volume."""
    kind = np.dtype(volume.dtype).newbyteorder("<")
    code = next(c for c, t in TYPES.items() if t == kind.str[1:])
    head = bytearray(352)
    struct.pack_into("<i", head, 0, HEADER)
    struct.pack_into("<8h", head, 40, 3, *volume.shape[::-1], 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, kind.itemsize * 8)
    struct.pack_into("<8f", head, 76, *[1.0] * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    head[344:348] = b"n+1\0"
    return bytes(head) + np.ascontiguousarray(volume.astype(kind)).tobytes()


def _unpacked(stream) -> Iterator[bytes]:
    """Parts of a gzip stream; it is never in memory as a whole."""
    unzip = zlib.decompressobj(31)
    while part := stream.read(1 << 20):
        yield unzip.decompress(part)
    yield unzip.flush()


def read_voxels(spark: SparkSession, path: str, value: str = "label") -> DataFrame:
    """(file, z, y, x, value) of the voxels that are not zero. A task reads the headers; layers are then dealt out and each is read as a range of
    bytes, so that a volume may have any size. Gzip has no ranges: such a file passes one task as a stream, a layer at a time."""
    files = spark.read.format("binaryFile").load(path).select("path")
    kind = "long" if value == "label" else "double"
    schema = f"file string, z int, y int, x int, {value} {kind}"

    def opened(name: str):
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(name.replace("file:/", "file:///", 1) if name.startswith("file:/") and not name.startswith("file://") else name)
        return where, at

    def layer(name: str, h: dict, z: int, raw: bytes) -> pd.DataFrame:
        page = np.frombuffer(raw, h["type"]).reshape(h["shape"][1:])
        page = page if (h["slope"], h["inter"]) == (1.0, 0.0) else page * h["slope"] + h["inter"]
        y, x = np.nonzero(page)
        return pd.DataFrame({"file": name, "z": np.full(len(y), z, np.int32), "y": y.astype(np.int32), "x": x.astype(np.int32), value: page[y, x].astype(np.int64 if kind == "long" else float)})

    def layers(batches):
        for batch in batches:
            for name in batch["path"]:
                where, at = opened(name)
                with where.open_input_file(at) as f:
                    h = header(f.read(HEADER))
                yield pd.DataFrame({"path": name, "z": np.arange(h["shape"][0], dtype=np.int32)})

    def ranges(batches):
        for batch in batches:
            for name, own in batch.groupby("path"):
                where, at = opened(name)
                with where.open_input_file(at) as f:
                    h = header(f.read(HEADER))
                    size = h["shape"][1] * h["shape"][2] * np.dtype(h["type"]).itemsize
                    for z in own["z"]:
                        f.seek(h["at"] + int(z) * size)
                        yield layer(name, h, int(z), f.read(size))

    def streams(batches):
        for batch in batches:
            for name in batch["path"]:
                where, at = opened(name)
                with where.open_input_stream(at, compression=None) as f:
                    held, h, z = bytearray(), None, 0
                    for part in _unpacked(f):
                        held += part
                        if h is None and len(held) >= HEADER:
                            h = header(bytes(held[:HEADER]))
                            size, skip = h["shape"][1] * h["shape"][2] * np.dtype(h["type"]).itemsize, h["at"]
                        while h and z < h["shape"][0] and len(held) >= skip + size:
                            yield layer(name, h, z, bytes(held[skip : skip + size]))
                            del held[: skip + size]
                            z, skip = z + 1, 0

    packed = F.lower("path").endswith(".gz")
    plain = files.where(~packed).mapInPandas(layers, "path string, z int").repartition("path", "z").mapInPandas(ranges, schema)
    return plain.unionByName(files.where(packed).mapInPandas(streams, schema))


def write_voxels(voxels: DataFrame, folder: str, shape: tuple[int, int, int]) -> DataFrame:
    """A file for each layer, made by the task that has the layer's rows; returns (z, path). Layers without rows have no file."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        z = int(pdf["z"].iloc[0])
        page = np.zeros((1, *shape[1:]), np.int64)
        page[0, pdf["y"], pdf["x"]] = pdf["label"]
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        with where.open_output_stream(f"{root}/layer-{z:06d}.nii") as f:
            f.write(encode(page))
        return pd.DataFrame({"z": [z], "path": [f"{folder}/layer-{z:06d}.nii"]})

    return voxels.groupBy("z").applyInPandas(one, "z int, path string")
