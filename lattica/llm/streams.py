"""Digests over ordered groups of any length: SHA-256 takes its bytes in order, so what a task holds of a group is a piece, digested at once where
the group is known to be whole and sent on where it was cut. Cut pieces are dealt by group, sorted, and pass one task as a stream, so that
memory does not grow with a group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Where a piece stands: its partition, and its place there.
PLACE = "part int, seq long, whole boolean"


def fields(streams: list[str]) -> str:
    """Columns of a piece for each stream: its digest if it is whole, else its bytes."""
    return ", ".join(f"{s}_sha256 string, {s}_bytes binary" for s in streams)


def finished(pieces: DataFrame, keys: list[str], sums: list[str], streams: list[str], between: bytes = b"") -> DataFrame:
    """(keys, sums, digests), a row for each group of pieces: numbers are added, bytes are joined in order with `between` between pieces. Keys may be null."""
    at = {c: i for i, c in enumerate([*keys, "whole", *sums, *(f"{s}_{x}" for s in streams for x in ("sha256", "bytes"))])}
    kept = [*keys, *sums, *(f"{s}_sha256" for s in streams)]
    out = pieces.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, key, hashes, totals, pieces_of = None, None, [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(kept, [*key, *totals, *(h.hexdigest() for h in hashes)]))], schema=schema)

        for batch in batches:
            if schema is None:
                schema = pa.schema([batch.schema.field(at[c]) for c in kept])
            whole = batch.column(at["whole"])
            done = batch.filter(whole)
            if len(done):
                yield pa.RecordBatch.from_arrays([done.column(at[c]) for c in kept], schema=schema)
            for i in [i for i, w in enumerate(whole.to_pylist()) if not w]:
                value = lambda c: batch.column(at[c])[i].as_py()  # noqa: B023, E731
                own = tuple(map(value, keys))
                if own != key or not pieces_of:
                    if pieces_of:
                        yield row()
                    key, hashes, totals, pieces_of = own, [hashlib.sha256() for _ in streams], [0] * len(sums), 0
                for h, s in zip(hashes, streams):
                    if pieces_of:
                        h.update(between)
                    h.update(batch.column(at[f"{s}_bytes"])[i].as_buffer())
                totals = [t + value(c) for t, c in zip(totals, sums)]
                pieces_of += 1
        if pieces_of:
            yield row()

    dealt = pieces.repartition(*keys).sortWithinPartitions(*[F.asc_nulls_first(k) for k in keys], "part", "seq")
    return dealt.select(*at).mapInArrow(tidy(run), out.schema)
