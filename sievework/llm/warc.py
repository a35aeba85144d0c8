"""WARC archives: written as Spark text, read back by boundary-chain verification.

A reader that looks for the record magic also finds it inside payloads. Here each
task scans one byte range of an archive, and each candidate header names its
successor: the offset at which the next record must begin. A task contracts the
chain inside its range to one jump out of it (candidate -> first offset beyond
the range); then the jumps are doubled from the file's start, so that a file of n
ranges needs log2(n) rounds, and only what is reachable from offset 0 is a record.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.shared import Scratch

MAGIC = b"WARC/1.0\r\n"
#: How a header line begins.
FIELD = re.compile(rb"[A-Za-z0-9!#$%&'*+.^_`|~-]{1,200}:")
#: Payloads below this many bytes are always stored in full.
LEAST_REVISIT = 100
RANGE_BYTES = 16 << 20
END = -1  # the chain ends in a place that is no record and not the file's end


def records(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, url, html, payload_bytes, payload_digest, record_type, refers_to of each page.

    A null html is empty. Of equal payloads of at least LEAST_REVISIT bytes, that with the smallest
    page_id is the response and the others revisit it. Rows that repeat a page_id give one record each;
    among equal payloads with the same, smallest page_id all are responses.
    """
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url"), F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    p = p.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (
        p.filter(F.col("payload_bytes") >= LEAST_REVISIT)
        .groupBy(F.col("payload_digest").alias("d"))
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    # only digests that occur again are joined, and their size is known: the payloads need no shuffle while these are few
    firsts = scratch.keep(firsts.select("d", "first"), "firsts")
    p = p.join(firsts, (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") >= LEAST_REVISIT), "left")
    again = F.coalesce(F.col("page_id") > F.col("first"), F.lit(False))
    return p.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def _one_line(c):
    """Header values hold no line ends."""
    return F.regexp_replace(c, "[\r\n]+", " ")


def write(recs: DataFrame, path: str) -> None:
    """Write archives, one a task, by Spark's text writer: its commit protocol holds if executors are lost.

    A record ends in CR LF CR LF, whose last LF is the writer's line separator.
    """
    kept = F.col("record_type") == "response"
    block = F.when(kept, F.col("html")).otherwise("")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), "record_type",
        F.lit("\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), _one_line(F.col("url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), "payload_digest",
        F.lit("\r\nX-Payload-Length: "), F.col("payload_bytes").cast("string"),
        F.when(kept, F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"),
    )
    recs.select(F.concat(head, block, F.lit("\r\n\r")).alias("value")).write.text(path)


def ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """file, size, start of each byte range; from the folder's listing."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = [(s.getPath().toString(), s.getLen()) for s in fs.listStatus(at) if s.isFile() and s.getLen() and s.getPath().getName()[0] not in "._"]
    listed = spark.createDataFrame(files, "file string, size long")
    cut = listed.select("file", "size", F.explode(F.expr(f"sequence(0L, size - 1, {range_bytes}L)")).alias("start"))
    count = sum(-(-size // range_bytes) for _, size in files)
    return cut.repartition(max(1, count))


def _open(file: str):
    """An input of the file system that the URI names."""
    from pyarrow import fs

    if file.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", file))
    where, path = fs.FileSystem.from_uri(file)
    return where.open_input_file(path)


def _length(value: bytes) -> int | None:
    """The number of bytes that a header field names; None for other texts and for more digits than any file's size has."""
    digits = value.lstrip(b"0") or value[-1:]
    return int(digits) if digits.isdigit() and len(digits) < 19 else None


class _Bytes:
    """A byte range of a file and, on demand, bytes beyond it."""

    def __init__(self, source, start: int, stop: int):
        self.source, self.start, self.stop = source, start, stop
        self.data = source.read_at(stop - start + len(MAGIC) - 1, start)
        self.block: tuple | None = None  # first line, end, the last line with a length, that length

    def at(self, offset: int, n: int) -> bytes:
        i = offset - self.start
        if 0 <= i and i + n <= len(self.data):
            return self.data[i : i + n]
        return self.source.read_at(n, offset)

    def line(self, offset: int, n: int = 1024) -> bytes | None:
        """The header line at ``offset`` without its end, empty at the end of a block; None if none is there.

        What doesn't begin like one is told from its first bytes, however far away the next line's end is.
        """
        if not (raw := self.at(offset, n)).startswith(b"\r\n") and not FIELD.match(raw):
            return None
        while (end := raw.find(b"\r\n")) < 0:
            if len(raw) < n:
                return None
            n *= 4
            raw = self.at(offset, n)
        return raw[:end]

    def header(self, offset: int) -> tuple[int, dict] | None:
        """Bytes of the header block at ``offset``, and its fields; None if there is no well-formed one."""
        if self.at(offset, len(MAGIC)) != MAGIC:
            return None
        place, fields = offset + len(MAGIC), {}
        while line := self.line(place):
            name, _, value = line.partition(b":")
            fields[name] = value.removeprefix(b" ")
            place += len(line) + 2
        return (place + 2 - offset, fields) if line is not None and _length(fields.get(b"Content-Length", b"")) is not None else None

    def after(self, offset: int) -> int | None:
        """Where the record at ``offset``, a place of the magic, ends; None if no header block is there.

        Magic may end many lines of one block: the lines are read once for all of them, as each sees those below it.
        """
        place = offset + len(MAGIC)
        if not self.block or place > self.block[1] or place < self.block[0]:
            start, last, length = place, -1, None
            while line := self.line(place):
                name, _, value = line.partition(b":")
                if name == b"Content-Length":
                    last, length = place, _length(value.removeprefix(b" "))
                place += len(line) + 2
            self.block = (start, place, last, length if line is not None else None)
            place = start
        _, end, last, length = self.block
        return None if length is None or last < place else end + 2 + length + 4


def _scan(batches):
    """Candidates of each range, with the jump that leaves the range."""
    for b in batches:
        for r in b.to_pylist():
            stop = min(r["start"] + r["range_bytes"], r["size"])
            with _open(r["file"]) as source:
                data, step, i = _Bytes(source, r["start"], stop), {}, -1
                while (i := data.data.find(MAGIC, i + 1)) >= 0:
                    offset = r["start"] + i
                    if offset < stop and (after := data.after(offset)) is not None and after <= r["size"]:
                        step[offset] = after
            for offset in sorted(step, reverse=True):  # successors lie behind, so they are contracted first
                after = step[offset]
                if after < stop:
                    step[offset] = step.get(after, END)
            n = len(step)
            yield pa.RecordBatch.from_arrays([pa.array([r["file"]] * n, pa.string()), pa.array(list(step), pa.int64()), pa.array(list(step.values()), pa.int64())], names=["file", "at", "jump"])


def chain_entries(spark: SparkSession, cut: DataFrame, scratch: Scratch) -> DataFrame:
    """file, at: the offset at which the record chain enters each range, by pointer jumping from offset 0."""
    jumps = scratch.keep(cut.mapInArrow(_scan, "file string, at long, jump long").filter(f"jump <> {END}"), "jumps")
    reached = scratch.keep(cut.select("file", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    most = cut.groupBy("file").count().agg(F.max("count")).first()[0] or 1
    span = 1
    while span < most:
        onward = reached.join(jumps, ["file", "at"]).select("file", F.col("jump").alias("at"))
        reached, old = scratch.keep(reached.union(onward).distinct(), "reached"), reached
        scratch.drop(old)
        span *= 2
        if span < most:
            twice = jumps.select("file", F.col("at").alias("from"), F.col("jump").alias("at")).join(jumps, ["file", "at"]).select("file", F.col("from").alias("at"), "jump")
            jumps, old = scratch.keep(twice, "jumps"), jumps
            scratch.drop(old)
    return reached


READ_SCHEMA = "file string, record_offset long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, stored_digest string, payload string"


def _page(value: bytes | None) -> int | None:
    digits = re.fullmatch(rb"<urn:page:(-?[0-9]{1,19})>", value or b"")
    return int(digits[1]) if digits else None


def _follow(batches, payloads: bool, whole_files: bool):
    """The records of each range, from where the chain enters it; digests are of the bytes as stored."""
    names = [x.split()[0] for x in READ_SCHEMA.split(", ")]
    for b in batches:
        for r in b.to_pylist():
            rows, size = [], 0
            stop = min(r["start"] + r["range_bytes"], r["size"])
            with _open(r["file"]) as source:
                data, offset = _Bytes(source, r["start"], stop), r["entry"]
                while offset < stop and (h := data.header(offset)):
                    n, f = _length(h[1][b"Content-Length"]), h[1]
                    body = data.at(offset + h[0], n)
                    kind = f[b"WARC-Type"].decode()
                    said = f[b"WARC-Payload-Digest"].decode().rpartition(":")[2]
                    whole = kind == "response"
                    rows.append((r["file"], offset, _page(f.get(b"WARC-Record-ID")), f[b"WARC-Target-URI"].decode(), kind, _page(f.get(b"WARC-Refers-To")), len(body) if whole else int(f[b"X-Payload-Length"]), hashlib.sha256(body).hexdigest() if whole else said, said, body.decode() if payloads and whole else None))
                    offset += h[0] + n + 4
                    size += n * payloads
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=_schema())
                        rows, size = [], 0
                if whole_files and not stop <= offset <= r["size"]:
                    raise ValueError(f"{r['file']}: the record chain ends at {offset}, not at the file's end {r['size']}")
            yield pa.RecordBatch.from_pylist([dict(zip(names, x, strict=True)) for x in rows], schema=_schema())


def _schema() -> pa.Schema:
    return pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in READ_SCHEMA.split(", "))])


def read(spark: SparkSession, path: str, scratch: Scratch, range_bytes: int = RANGE_BYTES, payloads: bool = True, whole_files: bool = False) -> DataFrame:
    """The records of all archives in a folder: where each lies, its fields, and its payload if asked for.

    ``payload_digest`` is computed from a response's stored bytes; ``stored_digest`` is what its header says.
    A revisit has no bytes of its own: both are what its header says, and its payload is null.
    Bytes that cannot be reached from a file's start are no records; with ``whole_files`` they raise. Empty files and folders give no rows.
    """
    cut = scratch.keep(ranges(spark, path, range_bytes).withColumn("range_bytes", F.lit(range_bytes).cast("long")), "ranges")
    entries = chain_entries(spark, cut, scratch)
    entries = entries.select("file", (F.floor(F.col("at") / range_bytes) * range_bytes).cast("long").alias("start"), "at").groupBy("file", "start").agg(F.min("at").alias("entry"))
    todo = cut.join(entries, ["file", "start"]).select("file", "size", "start", "range_bytes", "entry")
    return todo.repartition(max(1, cut.count()), "file", "start").mapInArrow(partial(_follow, payloads=payloads, whole_files=whole_files), READ_SCHEMA)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages as archives into the shared folder, read them back, and report each page's record.

    page_id, payload_bytes, payload_digest, record_type, refers_to. A null html is an empty payload; an empty
    table gives no rows; repeated page_ids give a row each; other columns of ``pages`` are ignored.
    """
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    path = scratch.path("archives")
    write(records(pages, scratch), path)
    return read(spark, path, scratch, payloads=False, whole_files=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
