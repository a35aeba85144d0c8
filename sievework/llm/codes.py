"""Vector code compression: a byte for each part of a vector, by codebooks from weighted Lloyd rounds.

Components become integers and vectors are cut into equal parts. Equal parts of a position are one row with a weight, so a
round works on each different part once; its tasks give partial sums by entry, and what reaches the driver is one row an
entry. Codes and errors are joined back to the vectors by the part's 128-bit key. All sums are of integers and exact.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Scratch, hot_over, split_join

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integers beyond this count as this: so 64-bit sums of squares hold.
MOST = 1 << 27
#: Below this distances are whole numbers of less than 53 bits all the way, so that float64 products are exact.
EXACT = 1 << 21
#: Distances held at once.
CELLS = 4_000_000


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector has a component and no null or non-finite one."""
    x = F.col("embedding")
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(F.coalesce(F.forall(x, finite), F.lit(False)))


def integers(vectors: pa.Array, width: int, scale: int) -> np.ndarray:
    """floor(scale * component), a row a vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.clip(np.floor(flat * scale), -MOST, MOST).astype(np.int32).reshape(-1, width)


def _cut(batches, width, parts, scale):
    """A row a part: its position, its integers as bytes."""
    for b in batches:
        x = integers(b.column("embedding"), width, scale).reshape(-1, width // parts)
        raw, size = pa.py_buffer(np.ascontiguousarray(x)), x.shape[1] * 4
        binary = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(size)), raw])
        yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), b.num_rows)), binary], names=["position", "part"])


def _keyed(batches, width, parts, scale):
    """Each row's other columns, and its parts as a list of bytes."""
    for b in batches:
        (cut,) = _cut([b], width, parts, scale)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * parts), cut.column("part"))
        yield b.drop_columns(["embedding"]).append_column("parts", lists)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the entry of least squared distance, the first of several, and that distance."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    exact = max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) < EXACT
    step = max(1, CELLS // (len(book) * (1 if exact else book.shape[1])))
    b = book.astype(np.float64)
    for i in range(0, len(x), step):
        if exact:
            part = x[i : i + step].astype(np.float64)
            d = (part * part).sum(1)[:, None] - 2 * (part @ b.T) + (b * b).sum(1)
        else:
            d = ((x[i : i + step, None].astype(np.int64) - book) ** 2).sum(2)
        code[i : i + step] = d.argmin(1)
        error[i : i + step] = d.min(1)
    return code, error


def _parts_of(b):
    """(position, rows, their integers) of each position in a batch."""
    position = b.column("position").to_numpy()
    x = np.frombuffer(b"".join(b.column("part").to_pylist()), np.int32).reshape(len(position), -1)
    for p in np.unique(position):
        at = np.flatnonzero(position == p)
        yield int(p), at, x[at]


def _sums(batches, books):
    """(position, entry, count, sums) of a task's parts, each counted as often as it occurs."""
    shape = books.value.shape
    count, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
    for b in batches:
        n = b.column("n").to_numpy()
        for p, at, x in _parts_of(b):
            code, _ = nearest(x, books.value[p])
            np.add.at(count[p], code, n[at])
            np.add.at(sums[p], code, x * n[at][:, None])
    position, entry = np.nonzero(count)
    found = sums[position, entry]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * shape[2]), pa.array(found.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(position.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[position, entry]), lists], names=["position", "entry", "n", "sums"])


def _assign(batches, books):
    for b in batches:
        code, error = np.empty(b.num_rows, np.int32), np.empty(b.num_rows, np.int64)
        for p, at, x in _parts_of(b):
            code[at], error[at] = nearest(x, books.value[p])
        yield b.drop_columns(["part"]).append_column("code", pa.array(code)).append_column("error", pa.array(error))


@dataclass
class Compressed:
    """``rows``: vec_id, label, codes (an entry for each part), error. ``books``: the entries (part, entry, component), whole numbers."""

    rows: DataFrame
    books: np.ndarray


def decoded(codes: np.ndarray, books: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The vectors that rows of codes stand for: the middle of each integer's interval."""
    return (books[np.arange(books.shape[0]), codes].reshape(len(codes), -1) + 0.5) / scale


def compress(vectors: DataFrame, scratch: Scratch, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Compressed:
    """Codes of (vec_id, embedding, label) rows.

    Dropped are rows whose embedding is null or empty or holds a null or non-finite component, and those whose length is not
    that of the first row kept (by vec_id, nulls last, then by embedding), which ``parts`` must divide, or this raises.
    The codebooks start as the parts of the first ``entries`` rows in that order, fewer if there are fewer; equal entries
    leave the later one unused. Repeated vec_ids are rows like others. Components beyond 2^27 / ``scale`` count as that. Other
    columns are ignored; an empty table gives no rows and empty books.
    """
    spark = scratch.spark
    good = _usable(vectors.select("vec_id", "embedding", "label"))
    first = good.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(1).collect()
    if not first:
        empty = good.select("vec_id", "label", F.array().cast("array<int>").alias("codes"), F.lit(0).cast("long").alias("error"))
        return Compressed(empty.limit(0), np.zeros((parts, 0, 0), np.int64))
    width = len(first[0].embedding)
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    good = good.filter(F.size("embedding") == width)
    start = good.select("vec_id", "embedding").orderBy(F.asc_nulls_last("vec_id"), "embedding").limit(entries).toArrow()
    books = integers(start.column("embedding").combine_chunks(), width, scale).reshape(-1, parts, width // parts).transpose(1, 0, 2).astype(np.int64)
    options = {"width": width, "parts": parts, "scale": scale}
    every = good.select("embedding").mapInArrow(partial(_cut, **options), "position int, part binary")
    unlike = scratch.keep(every.groupBy("position", "part").agg(F.count("*").alias("n")), "unlike")
    scratch.release()
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)
        sums = unlike.mapInArrow(partial(_sums, books=sent), "position int, entry int, n long, sums array<long>")
        sums = sums.groupBy("position", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(width // parts)))
        books = books.copy()
        for r in sums.collect():  # parts * entries rows at most
            books[r[0], r[1]] = [s // r[2] for s in r[3:]]
        sent.unpersist()
    sent = spark.sparkContext.broadcast(books)
    key = [F.xxhash64("position", "part").alias("k1"), F.xxhash64("part", F.col("position") + 1000).alias("k2")]
    known = scratch.keep(unlike.select("position", *key, "n", "part").mapInArrow(partial(_assign, books=sent), "position int, k1 long, k2 long, n long, code int, error long"), "known")
    scratch.drop(unlike)
    types = {f.name: f.dataType.simpleString() for f in good.schema}
    rows = good.mapInArrow(partial(_keyed, **options), f"vec_id {types['vec_id']}, label {types['label']}, parts array<binary>").withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "vec_id", "label", F.posexplode("parts").alias("position", "part")).select("row", "vec_id", "label", "position", *key)
    rows = scratch.keep(rows, "rows")
    met = split_join(rows, known.select("k1", "k2", "n", "code", "error"), ["k1", "k2"], hot_over(rows.count()))
    found = met.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.sort_array(F.collect_list(F.struct("position", "code"))).alias("c"), F.sum("error").alias("error"))
    return Compressed(scratch.keep(found.select("vec_id", "label", F.col("c.code").alias("codes"), "error"), "codes"), books)


def label_errors(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (kept) with label_error, the sum of error over the rows of the same label; null is a label of its own. Null if beyond 64 bits."""
    rows = rows.withColumn("_label", F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-")))
    sums = scratch.keep(rows.groupBy("_label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n")), "labels")
    return split_join(rows, sums, ["_label"], hot_over(rows.count())).drop("_label")
