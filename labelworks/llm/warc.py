"""Operator 2: WARC files written by tasks and read back by byte ranges.

Writing: each task writes one file of gzip members, a member per record. The file's name holds the task attempt, and the
returned manifest lists only files of attempts that Spark accepted, so a repeated or lost attempt leaves no record twice.

Reading: files are cut into byte ranges at any place. A task looks for the gzip magic in its range, validates a candidate
by decoding the member's beginning (it has to start with ``WARC/1.``), and owns all records that start inside its range,
also where they end beyond it. After a record the next one starts where the member ended, so bytes inside a member are
only ever candidates before the range's first record.

Files go through ``pyarrow.fs``, so the folder may be in any store that it knows, ``file:`` included.
Edge cases: a null payload is an empty one; null ids and urls are written as empty; repeated ids stay separate records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, fresh_path, pieces, stored

GZIP_MAGIC = b"\x1f\x8b\x08"
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: A payload with more copies is looked up apart, so that no task gets all of them; of such payloads at most so many are broadcast.
HOT_COPIES, MOST_HOT = 10_000, 500_000
NO_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes, level: int) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


def record(key: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the response's headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, key)}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Record-Key: {key}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {NO_REVISIT}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, refers_to)}>", f"X-Refers-To-Key: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write a record per row; the manifest (path, n_bytes, n_records).

    Rows with equal payloads of at least ``min_revisit_bytes`` bytes: the one with the smallest key is the response, the
    others revisit it. Keys and digests are shuffled to find repeats. The repeats' digests go to all tasks where the session's
    broadcast threshold allows it. Beyond that pages are shuffled by digest once, but for those of payloads with more than
    ``HOT_COPIES`` copies, which find theirs in a broadcast table and are spread evenly.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("u"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("p"))
    digests = rows.select("k", F.sha1(F.col("p").cast("binary")).alias("d"), F.octet_length("p").alias("n"))
    # Only payloads that occur twice are needed beside the pages: the others are responses.
    again = digests.where(F.col("n") >= min_revisit_bytes).groupBy("d").agg(F.min("k").alias("first"), F.count("*").alias("c")).where("c > 1")
    again = stored(again, "warc-revisits")
    marked = rows.withColumn("d", F.sha1(F.col("p").cast("binary"))).withColumn("hot_first", F.lit(None).cast("long"))
    repeats, hot = again.agg(F.count("*"), F.count_if(F.col("c") > HOT_COPIES)).first()
    if 0 < hot <= MOST_HOT:
        apart = again.where(F.col("c") > HOT_COPIES).select("d", F.col("first").alias("hot_first"))
        marked = marked.drop("hot_first").join(F.broadcast(apart), "d", "left")
        marked = marked.withColumn("d", F.when(F.col("hot_first").isNull(), F.col("d")).otherwise(F.concat(F.lit("-"), F.xxhash64("k", "u").cast("string"))))
    if repeats > hot or hot > MOST_HOT:
        marked = marked.join(again.select("d", "first"), "d", "left").select("k", "u", "p", F.coalesce("hot_first", "first").alias("first"))
    else:
        marked = marked.select("k", "u", "p", F.col("hot_first").alias("first"))
    spark.createDataFrame([], "x int").write.mode("overwrite").parquet(f"{folder}/_made")  # the folder, through Spark

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        t = TaskContext.get()
        path, out, n, size = f"{folder}/part-{t.partitionId():05d}-{uuid.uuid4().hex}.warc.gz", None, 0, 0
        for batch in batches:
            for part in pieces(batch, "p"):
                if out is None:
                    fs, at = _open(path)
                    out = fs.open_output_stream(at, compression=None)
                for k, u, p, first in zip(part.column("k").to_pylist(), part.column("u").to_pylist(), bytes_of(part, "p"), part.column("first").to_pylist(), strict=True):
                    revisit = first is not None and k != first
                    name = "" if k is None else str(k)
                    u = re.sub(r"[\r\n]", " ", u)
                    data = _member(record(name, u, p, payload_digest(p), str(first) if revisit else None, date), level)
                    out.write(data)
                    n, size = n + 1, size + len(data)
        if out is not None:
            out.close()
            yield pa.record_batch([[path], [size], [n]], names=["path", "n_bytes", "n_records"])

    return stored(marked.mapInArrow(write, "path string, n_bytes long, n_records long"), "warc-manifest")


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    return {"": lines[0]} | {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


class _Window:
    """A file from some byte on, read piece by piece; forgets what lies before the reader."""

    def __init__(self, path: str, start: int):
        fs, at = _open(path)
        self.file = fs.open_input_file(at)
        self.size = self.file.size()
        self.base, self.data = start, b""

    def need(self, till: int) -> None:
        """Hold all bytes up to ``till``, or to the file's end."""
        have = self.base + len(self.data)
        if till > have and have < self.size:
            self.file.seek(have)
            self.data += self.file.read(min(max(till - have, READ_BYTES), self.size - have))

    def forget(self, before: int) -> None:
        if before - self.base > READ_BYTES:
            self.data, self.base = self.data[before - self.base :], before


def _is_record(window: _Window, at: int) -> bool:
    """Whether a gzip member that holds a WARC record starts here: decode as much as its first bytes."""
    window.need(at + 4096)
    try:
        return zlib.decompressobj(31).decompress(window.data[at - window.base : at - window.base + 4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def _inflate(window: _Window, at: int) -> tuple[bytes, int]:
    """A whole member and the place where it ended."""
    d, out, pos = zlib.decompressobj(31), [], at
    while not d.eof:
        window.need(pos + 1)
        chunk = window.data[pos - window.base : pos - window.base + READ_BYTES]
        if not chunk:
            raise ValueError("a WARC record is cut off at the file's end")
        out.append(d.decompress(chunk))
        pos += len(chunk)
    return b"".join(out), pos - len(d.unused_data)


def records_of_range(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], dict[str, str], bytes]]:
    """Offset, WARC headers, HTTP headers and payload of each record that starts in [start, end)."""
    window, at = _Window(path, start), start
    while at < min(end, window.size):
        if not _is_record(window, at):
            window.need(at + READ_BYTES)
            found = window.data.find(GZIP_MAGIC, at + 1 - window.base)
            at = window.base + found if found >= 0 else max(at + 1, window.base + len(window.data) - 2)
            window.forget(at)
            continue
        data, after = _inflate(window, at)
        head, _, rest = data.partition(b"\r\n\r\n")
        warc = _headers(head)
        block = rest[: int(warc.get("content-length", len(rest)))]
        http, _, body = block.partition(b"\r\n\r\n")
        yield at, warc, _headers(http), body
        at = after
        window.forget(at)


def read_warc(manifest: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = False) -> DataFrame:
    """Records of all files of a manifest, a task taking some byte ranges: key, url, record_type, payload_bytes,
    payload_digest, refers_to_key, path, offset and, if asked for, payload (empty for revisits)."""
    ranges = manifest.where("n_bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    names = ["key", "url", "record_type", "payload_bytes", "payload_digest", "refers_to_key", "path", "offset", *(["payload"] if with_payload else [])]
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), *([pa.binary()] if with_payload else [])]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                held = 0
                for at, warc, http, body in records_of_range(path, start, start + range_bytes):
                    revisit = warc["warc-type"] == "revisit"
                    said = warc.get("warc-payload-digest", "").removeprefix("sha1:")
                    if not revisit and said and payload_digest(body) != said:
                        raise ValueError(f"payload digest differs at {at} of {path}")
                    row = (warc.get("x-record-key"), warc.get("warc-target-uri"), warc["warc-type"], int(http.get("content-length", 0)) if revisit else len(body), said, warc.get("x-refers-to-key"), path, at)
                    rows.append((*row, body) if with_payload else row)
                    held += len(body) if with_payload else 300
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    # A few ranges of a few kB each: deal them out over the tasks, by place and not by key.
    tasks = max(1, manifest.sparkSession.sparkContext.defaultParallelism)
    total = manifest.agg(F.coalesce(F.sum(F.ceil(F.col("n_bytes") / range_bytes)), F.lit(0))).first()[0]
    dealt = ranges.repartition(int(max(1, min(total, max(tasks * 4, total // 4)))))
    extra = ", payload binary" if with_payload else ""
    return dealt.mapInArrow(read, "key string, url string, record_type string, payload_bytes long, payload_digest string, refers_to_key string, path string, offset long" + extra)


def op2_query(pages: DataFrame) -> DataFrame:
    manifest = write_warc(pages, fresh_path(pages.sparkSession, "warc"))
    back = read_warc(manifest)
    key = lambda c: F.when(F.col(c) != "", F.col(c)).cast("long")
    return back.select(key("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", key("refers_to_key").alias("refers_to"))
