"""NIfTI volumes: types, byte orders, scaled values, gzip, and files that are none."""

import gzip
import struct

import numpy as np
import pytest

from lattica.sources import nifti


def voxels(df):
    return {(r.file.rsplit("/", 1)[1], r.z, r.y, r.x): r.value for r in df.collect()}


def test_volumes_of_many_kinds(spark, tmp_path):
    rng, want = np.random.default_rng(1), {}
    for kind in ("u1", "i2", "i4", "f4", "f8", "u2", "i8"):
        volume = (rng.integers(0, 3, (4, 5, 6)) * 7).astype(kind)
        for name, data in ((f"{kind}.nii", nifti.encode(volume)), (f"{kind}.nii.gz", gzip.compress(nifti.encode(volume)))):
            (tmp_path / name).write_bytes(data)
            want |= {(name, *map(int, p)): float(volume[tuple(p)]) for p in np.argwhere(volume)}
    # the other byte order, a gap before the voxels, a scale of values, and a plane instead of a volume
    plane = np.arange(12, dtype=">i2").reshape(3, 4)
    head = bytearray(400)
    struct.pack_into(">i", head, 0, 348)
    struct.pack_into(">8h", head, 40, 2, 4, 3, 1, 1, 1, 1, 1)
    struct.pack_into(">2h", head, 70, 4, 16)
    struct.pack_into(">3f", head, 108, 400.0, 0.5, -1.0)
    head[344:348] = b"n+1\0"
    (tmp_path / "plane.nii").write_bytes(bytes(head) + plane.tobytes())
    want |= {("plane.nii", 0, y, x): plane[y, x] * 0.5 - 1 for y in range(3) for x in range(4) if plane[y, x] != 2}
    assert voxels(nifti.read_voxels(spark, f"file://{tmp_path}", "value")) == want
    assert {r.label for r in nifti.read_voxels(spark, f"file://{tmp_path}/i4.nii").collect()} == {7, 14}


def test_other_files_are_refused():
    volume = np.ones((2, 3, 4), np.float32)
    for bad in (b"", b"x" * 400, nifti.encode(volume)[:344] + b"ni1\0"):
        with pytest.raises(ValueError):
            nifti.header(bad)
    many = bytearray(nifti.encode(volume))
    struct.pack_into("<8h", many, 40, 4, 4, 3, 2, 5, 1, 1, 1)
    with pytest.raises(ValueError):
        nifti.header(bytes(many))
    assert nifti.header(nifti.encode(volume)) == {"type": "<f4", "shape": (2, 3, 4), "at": 352, "slope": 1.0, "inter": 0.0}
