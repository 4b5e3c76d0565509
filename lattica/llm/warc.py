"""WARC archives, index first: every record's offset, length, URL and digest are written beside the archives, and reads are coalesced,
sorted byte ranges of the selected records.

Each record is a gzip member of its own, so that it can be read alone. A payload that occurs more than once is stored once: the record
with the smallest id is the response, the others are revisit records that name it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, tidy, written

#: Payloads shorter than this are stored as they are, however often they occur.
LEAST_SHARED = 100
#: Gaps of unselected bytes up to this size are read rather than skipped, and a range grows to about RANGE bytes.
GAP, RANGE = 1 << 16, 8 << 20
INDEX = "page_id long, record_type string, refers_to long, url string, payload_digest string, payload_bytes long, archive string, offset long, length long"
_INDEX = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_URN = "urn:page:"


def record(kind: str, key: int | None, url: str | None, payload: bytes, digest: str, refers: int | None) -> bytes:
    """One record, compressed alone; a revisit carries the size and digest of its payload but not the payload."""
    body = payload if kind == "response" else b""
    clean = None if url is None else "".join(c if c > " " and c != "\x7f" else "%%%02X" % ord(c) for c in url)
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{_URN}{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head += [f"WARC-Target-URI: {clean}"] if clean is not None else []
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URN}{refers}>"]
    head.append(f"Content-Length: {len(body)}")
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one record."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    n = int(headers["Content-Length"])
    if rest[n : n + 4] != b"\r\n\r\n" or len(rest) != n + 4:
        raise ValueError("a WARC record has another length than it says")
    return headers, rest[:n]


def _number(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").removeprefix(_URN)
    return int(digits) if digits else None


def plan(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first: the smallest page_id with the same payload, null where the payload is stored by itself.
    Payloads are counted by digest before anything moves. Digests that occur twice or more are a table of their own, so that Spark knows its
    size, sends it to the tasks if its threshold for that allows it, and can otherwise split a page that is very common. A null html is
    empty; a null page_id is never a first, and of rows with the smallest id and the same payload each is a response."""
    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    shared = rows.where(F.octet_length("html") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return rows.join(written(shared, "shared"), "digest", "left")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes a record for each row into one archive for each task, and the index as a table; returns the index. Archives get their names
    by a rename after their last byte; the index table has the rows of the tasks that counted."""
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, root = filesystem(folder)
        # a retried task may see its rows in another order, so each attempt has a name of its own and the index says which one counts
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        stream, offset = None, 0
        for batch in batches:
            stream = stream or fs.open_output_stream(f"{root}/_{name}", compression=None)
            rows = []
            for key, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                payload = html.encode()
                again = first is not None and key != first
                data = record("revisit" if again else "response", key, url, payload, digest, first if again else None)
                stream.write(data)
                rows.append((key, "revisit" if again else "response", first if again else None, url, digest, len(payload), f"{folder}/{name}", offset, len(data)))
                offset += len(data)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if stream:
            stream.close()
            fs.move(f"{root}/_{name}", f"{root}/{name}")

    spark = pages.sparkSession
    index = f"{folder}/index"
    plan(pages).select("page_id", "url", "html", "digest", "first").mapInArrow(tidy(write), INDEX).write.parquet(index)
    return spark.read.schema(INDEX).parquet(index)


def ranges(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int, int, int]]:
    """Sorted (offset, length) spans as reads: (from, to, first span, last span + 1)."""
    at = 0
    while at < len(spans):
        begin, end, to = spans[at][0], sum(spans[at]), at + 1
        while to < len(spans) and spans[to][0] - end <= GAP and sum(spans[to]) - begin <= RANGE:
            end, to = max(end, sum(spans[to])), to + 1
        yield begin, end, at, to
        at = to


def read_records(selected: DataFrame, payload: bool = False) -> DataFrame:
    """Reads the selected rows of an index from their archives: records are dealt out by archive and megabytes of offset, sorted, and
    neighbours are read at once. Every stored payload is checked against its digest. With payload=True the html comes along, null for
    revisits."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", html string" * payload
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.string()] * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def fetch(archive: str, spans: list[tuple[int, int]]) -> pa.RecordBatch | None:
        fs, path = filesystem(archive)
        with fs.open_input_file(path) as file:
            for begin, end, at, to in ranges(spans):
                block, rows = file.read_at(end - begin, begin), []
                for offset, length in spans[at:to]:
                    head, body = parse(block[offset - begin : offset - begin + length])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if head["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                        raise ValueError(f"a record of {archive} at {offset} has another digest than it says")
                    row = (_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), int(head["X-Payload-Length"]), digest, head["WARC-Type"], _number(head.get("WARC-Refers-To")))
                    rows.append(row + ((body.decode() if head["WARC-Type"] == "response" else None),) * payload)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def read(batches):
        archive, spans = None, []
        for batch in batches:
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if name != archive or len(spans) >= 4096:
                    if spans:
                        yield from fetch(archive, spans)
                    archive, spans = name, []
                spans.append((offset, length))
        if spans:
            yield from fetch(archive, spans)

    dealt = selected.select("archive", "offset", "length", F.floor(F.col("offset") / (8 * RANGE)).alias("part"))
    # rows of an index are small and their records are not, so tasks are counted by the bytes they will read
    tasks = 2 + (selected.agg(F.sum("length")).first()[0] or 0) // (4 * RANGE)
    dealt = dealt.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(tidy(read), schema)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes the archives to the shared folder, then reads every record back by the index."""
    return read_records(write_archives(pages, shared_dir(spark, "warc")))
