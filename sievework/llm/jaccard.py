"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Rows with equal sets are one class and compared once. MinHash bands give candidate
groups (see groups.py). Inside a group, pairs are compared a few MinHash values at a time: with m of n values equal, a
uniform prior makes the posterior of the similarity a beta distribution, and a pair is dropped when the probability
that it reaches the threshold falls below the tolerance. The pairs that are left are verified exactly.
"""

from __future__ import annotations

from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import groups
from sievework.llm.shared import Scratch, chunks, hot_over, mix, pieces, split_join

WORDS, THRESHOLD = 5, 0.8
HASHES, BANDS, ROWS = 64, 16, 4
#: MinHash values compared at a time, and the posterior probability below which a pair is dropped.
STEP, TOLERANCE = 8, 1e-6


def shingles(texts: list[str | None], words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted, distinct shingle hashes of all texts, end to end, and how many each text has.

    A text with fewer words is one shingle; one without words has none. A-Z count as a-z.
    """
    values, lengths = [], []
    for i, j in chunks([t or "" for t in texts]):
        split = [(t or "").encode().lower().split() for t in texts[i:j]]
        sizes = np.array([len(w) for w in split])
        distinct: dict[bytes, int] = {}
        flat = np.array([distinct.setdefault(w, len(distinct)) for ws in split for w in ws], np.int64)
        own = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
        h = own[flat] if len(flat) else np.empty(0, np.uint64)
        doc = np.repeat(np.arange(len(split)), sizes)
        begin = np.cumsum(sizes) - sizes
        place = np.arange(len(flat)) - begin[doc]
        count = np.maximum(sizes - words + 1, np.minimum(sizes, 1))
        starts = place < count[doc]
        total = np.zeros(len(flat), np.uint64)
        for k in range(words):
            ahead = np.zeros(len(flat), np.uint64)
            inside = np.flatnonzero(place + k < sizes[doc])
            ahead[inside] = h[inside + k]
            total = total * np.uint64(0x9E3779B97F4A7C15) + ahead
        got, owner = mix(total[starts], 5), doc[starts]
        order = np.lexsort((got, owner))
        got, owner = got[order], owner[order]
        new = np.ones(len(got), bool)
        new[1:] = (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])
        values.append(got[new])
        lengths.append(np.bincount(owner[new], minlength=len(split)))
    return (np.concatenate(values), np.concatenate(lengths)) if values else (np.empty(0, np.uint64), np.empty(0, np.int64))


def minhash(values: np.ndarray, lengths: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Signatures of the sets; those of empty sets are all ones."""
    out = np.full((len(lengths), hashes), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(lengths)
    if len(some):
        starts = (np.cumsum(lengths) - lengths)[some]
        low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        for k in range(hashes):
            # two independent halves make a family of hashes; the mixing makes their order random
            x = low + np.uint32(k * 0x9E3779B1 & 0xFFFFFFFF) * high
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            x ^= x >> np.uint32(12)
            out[some, k] = np.minimum.reduceat(x, starts)
    return out


def fewest(threshold: float, hashes: int = HASHES, step: int = STEP, tolerance: float = TOLERANCE) -> list[int]:
    """After each step, how many equal values a pair needs so that P(similarity >= threshold) isn't below the tolerance."""
    out = []
    for n in range(step, hashes + 1, step):
        below, m = 0.0, -1
        while below < tolerance and m < n:
            m += 1
            below = sum(comb(n + 1, x) * threshold**x * (1 - threshold) ** (n + 1 - x) for x in range(m + 1))
        out.append(m)
    return out


def survivors(signatures: np.ndarray, left: np.ndarray, right: np.ndarray, need: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a left and a right member (each pair once) that no step drops."""
    a, b = signatures[left], signatures[right]
    equal = np.zeros((len(a), len(b)), np.uint8)
    for k in range(STEP):
        equal += a[:, k, None] == b[None, :, k]
    x, y = np.nonzero((equal >= need[0]) & (left[:, None] < right[None, :] if left is right or np.array_equal(left, right) else np.ones((1, 1), bool)))
    m = equal[x, y].astype(np.int64)
    for s in range(1, len(need)):
        for lo in range(0, len(x), 1 << 20):
            cut = slice(lo, lo + (1 << 20))
            m[cut] += (a[x[cut], s * STEP : (s + 1) * STEP] == b[y[cut], s * STEP : (s + 1) * STEP]).sum(1)
        keep = m >= need[s]
        x, y, m = x[keep], y[keep], m[keep]
    return left[x], right[y]


def _sign(batches, words):
    for b in pieces(batches):
        values, lengths = shingles(b.column("text").to_pylist(), words)
        sig = minhash(values, lengths)
        starts = np.cumsum(lengths) - lengths
        some = np.flatnonzero(lengths)
        keys = np.zeros((2, len(lengths)), np.int64)
        for k in range(2):
            if len(some):
                keys[k, some] = np.add.reduceat(mix(values, 31 + k), starts[some]).astype(np.int64)
        cols = [b.column("row_id"), pa.array(lengths.astype(np.int64)), *map(pa.array, keys), groups.packed(sig)]
        yield pa.RecordBatch.from_arrays(cols, names=["row_id", "size", "set1", "set2", "sig"])


def _band(batches):
    for b in batches:
        sig = groups.unpacked(b.column("sig"), np.uint32, HASHES)
        keys = groups.bands(sig, BANDS, ROWS)
        yield pa.RecordBatch.from_arrays([b.column("id"), groups.packed(keys)], names=["id", "bands"])


def _decide(rows, left, right, threshold, words, need):
    sig = groups.unpacked(rows["sig"], np.uint32, HASHES)
    x, y = survivors(sig, left, right, need)
    if not len(x):
        return x, y
    values, lengths = shingles(rows["text"].to_pylist(), words)
    sets = np.split(values, np.cumsum(lengths)[:-1])
    both = groups.intersections(sets, x, y)
    ok = both >= threshold * (lengths[x] + lengths[y] - both) - 1e-9
    return x[ok], y[ok]


def join(docs: DataFrame, scratch: Scratch, text_col: str = "text", threshold: float = THRESHOLD, words: int = WORDS) -> DataFrame:
    """Add to each row of ``docs``: ``row_id``, ``group_id``, ``n_links`` and ``n_text_links``.

    Two rows are linked if the Jaccard similarity of their shingle sets is at least ``threshold``. row_id numbers the rows;
    group_id is the smallest row_id that links lead to; n_links counts the rows that a row is linked to, n_text_links
    those with different sets, copies once. Null, empty and blank texts have no shingles; they are copies of each other and linked to nothing else.
    Repeated rows are copies of each other. Columns of the added names are replaced, others pass through. An empty table
    gives an empty result.
    """
    rows = _rows(docs, scratch)
    found = _found(rows, scratch, text_col, threshold, words).withColumnRenamed("root", "group_id")
    out = rows.join(found, "row_id", "left")
    return out.withColumns({"group_id": F.coalesce("group_id", "row_id"), **{c: F.coalesce(c, F.lit(0)) for c in ("n_links", "n_text_links")}})


def _rows(docs: DataFrame, scratch: Scratch) -> DataFrame:
    rows = scratch.keep_by(docs.drop("row_id", "group_id", "n_links", "n_text_links").withColumn("row_id", F.monotonically_increasing_id()), "row_id", "rows")
    scratch.release()
    return rows


def _found(rows: DataFrame, scratch: Scratch, text_col: str, threshold: float, words: int) -> DataFrame:
    """(row_id, root, n_links, n_text_links) of the rows that are linked to others; ``rows`` lie in buckets by row_id."""
    texts = rows.select("row_id", F.col(text_col).alias("text"))
    signed = scratch.keep(texts.mapInArrow(partial(_sign, words=words), "row_id long, size long, set1 long, set2 long, sig binary"), "signed")
    sets = scratch.keep(signed.groupBy("set1", "set2", "size").agg(F.min("row_id").alias("id"), F.count("*").alias("n")), "sets")
    firsts = signed.filter("size > 0").select(F.col("row_id").alias("id"), "sig").join(sets.select("id"), "id", "left_semi")
    bands = scratch.keep(firsts.mapInArrow(_band, "id long, bands binary"), "bands")
    candidates = scratch.keep(groups.grouped(groups.star_edges(bands, scratch, BANDS), scratch).join(sets, "id").select("id", "root", "size", F.col("n").alias("copies")), "candidates")
    scratch.release()
    content = candidates.select("id", "copies").join(signed.select(F.col("row_id").alias("id"), "sig"), "id")
    content = texts.withColumnRenamed("row_id", "id").join(content, "id")
    decide = partial(_decide, threshold=threshold, words=words, need=fewest(threshold))
    found = scratch.keep(groups.linked(candidates, content, bands, decide, ["sig", "text"], scratch), "linked")
    scratch.release()
    links = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("weight").alias("weight"))
    roots = groups.grouped(found.filter("low < id").select(F.col("id").alias("a"), F.col("low").alias("b")).distinct(), scratch)
    counts = F.coalesce("weight", F.lit(0)) + F.col("n") - 1
    by_set = sets.join(links, "id", "left").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")).withColumn("n_links", counts)
    by_set = scratch.keep(by_set.filter("n_links > 0").select("set1", "set2", "size", "root", "n_links", F.coalesce("links", F.lit(0)).alias("n_text_links"), "n"), "by_set")
    of_rows = signed.select("row_id", "set1", "set2", "size")
    return scratch.keep(split_join(of_rows, by_set, ["set1", "set2", "size"], hot_over(signed.count())).select("row_id", "root", "n_links", "n_text_links"), "found")


def representatives(docs: DataFrame, scratch: Scratch, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without those that ``join`` links, directly or over others, to a row before them."""
    rows = _rows(docs, scratch)
    gone = _found(rows, scratch, text_col, threshold, WORDS).filter("root < row_id").select("row_id")
    return rows.join(gone, "row_id", "left_anti").drop("row_id")
