"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

The first pass over the texts counts how often each n-gram of the test items occurs; an item's seeds are its rarer half
and the rarest of each few neighbours, so that a copied run of that many has a seed however often it is copied. The second
pass cuts out the passages around seeds. Both passes know the n-grams by a bit table of fixed size, whatever the size of
the benchmark; joins with the seeds then settle which items a passage has to be aligned with, and how far.

An alignment of at least half the score of an item of n words has at most n words of a text that match and as many that
don't: it lies within 2 n words of any seed in it (REACH).
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import groups
from sievework.llm.shared import Scratch, chunks, hot_over, mix, pieces, split_join

SEED_WORDS = 3
#: Of so many neighbouring n-grams of an item the rarest is a seed.
NEIGHBOURS = 8
MATCH, MISMATCH, GAP = 2, -1, -1
#: Contaminated from this share of the score of the whole item on.
THRESHOLD = 0.5
#: An alignment lies within so many times the item's words of a seed in it.
REACH = 2
#: Cells of one step of aligned pairs.
CELLS = 2_000_000


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().split()


def _bare(word: bytes) -> bytes:
    """A word without the ASCII marks around it; marks alone stay."""
    return word.strip(b"!\"'()*,-./:;?[]_`{}#$%&|<>+=~^@\\") or word


def hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, end to end, and how many words each has."""
    split = [words(t) for t in texts]
    ids: dict[bytes, int] = {}
    flat = [ids.setdefault(w, len(ids)) for ws in split for w in ws]
    own = np.fromiter((xxhash.xxh64_intdigest(_bare(w), seed=7) for w in ids), np.uint64, len(ids))
    return (own[np.array(flat, np.int64)] if flat else np.empty(0, np.uint64)), np.array([len(w) for w in split], np.int64)


def grams(flat: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that lie within one text, and where each begins in ``flat``."""
    if len(flat) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(owner[: len(flat) - n + 1] == owner[n - 1 :])
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + flat[at + k]
    return mix(h, 13), at


def _items(batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        flat, lengths = hashes(texts)
        ends = np.cumsum(lengths)
        yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array([flat[e - n : e].astype(np.int64) for e, n in zip(ends, lengths, strict=True)], pa.list_(pa.int64()))], names=["item_id", "words"])


def _seeds(batches):
    """Distinct n-grams of each item; an item of fewer words is one n-gram."""
    for b in batches:
        for item, ws in zip(b.column("item_id").to_pylist(), b.column("words").to_pylist(), strict=True):
            n = min(SEED_WORDS, len(ws))
            if n:
                h, _ = grams(np.array(ws, np.int64).astype(np.uint64), np.array([len(ws)]), n)
                h = np.unique(h).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(h), n, np.int32)), pa.array([item] * len(h), pa.int64())], names=["gram", "n", "item_id"])


def _choose(batches):
    """The seeds of each item, with how often the texts have them."""
    for b in batches:
        for item, ws, counted in zip(*(b.column(c).to_pylist() for c in ("item_id", "words", "counted")), strict=True):
            n, count = min(SEED_WORDS, len(ws)), {c["gram"]: c["count"] for c in counted}
            h, _ = grams(np.array(ws, np.int64).astype(np.uint64), np.array([len(ws)]), n)
            order = h.astype(np.int64)
            often = np.array([count[g] for g in order.tolist()], np.int64)
            seeds = {g for g, c in zip(order.tolist(), often.tolist(), strict=True) if c <= max(3, np.median(often))}
            for at in range(max(1, len(order) - NEIGHBOURS + 1)):
                seeds.add(int(order[at + int(often[at : at + NEIGHBOURS].argmin())]))
            found = sorted(seeds)
            cols = [pa.array(found, pa.int64()), pa.array([n] * len(found), pa.int32()), pa.array([item] * len(found), pa.int64()), pa.array([count[g] for g in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["gram", "n", "item_id", "count"])


def table_of(seeds: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bits at the seeds' hashes, and the lengths of their n-grams: three at most."""
    return groups.bit_table(seeds.select("gram")), sorted(r[0] for r in seeds.select("n").distinct().collect())


def _hits(bits, lengths_n, flat, lengths):
    all_h, all_at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in lengths_n:
        h, at = grams(flat, lengths, n)
        hit = np.flatnonzero(groups.in_table(bits, h))
        all_h.append(h[hit])
        all_at.append(at[hit])
    h, at = np.concatenate(all_h), np.concatenate(all_at)
    order = np.argsort(at, kind="stable")
    return h[order], at[order]


def _tally(batches, table):
    bits, ns = table.value
    for b in pieces(batches):
        texts = [t or "" for t in b.column(0).to_pylist()]
        for i, j in chunks(texts):
            h, _ = _hits(bits, ns, *hashes(texts[i:j]))
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int64)), pa.array(n.astype(np.int64))], names=["gram", "count"])


PASSAGE = "row_id long, start long, words array<long>, grams array<long>, places array<long>"


def _passages(batches, table, text_col, reach):
    """The stretches of each text within ``reach`` words of a hit; ``places`` has where in the stretch each of ``grams`` begins."""
    bits, ns = table.value
    for b in pieces(batches):
        texts, rows = [t or "" for t in b.column(text_col).to_pylist()], b.column("row_id").to_numpy()
        for i, j in chunks(texts):
            flat, lengths = hashes(texts[i:j])
            h, at = _hits(bits, ns, flat, lengths)
            if not len(h):
                continue
            first = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(lengths)), lengths)[at]
            cut = np.flatnonzero((owner[1:] != owner[:-1]) | (at[1:] - at[:-1] > 2 * reach)) + 1
            out = []
            for a, z in zip([0, *cut.tolist()], [*cut.tolist(), len(at)], strict=True):
                k = owner[a]
                lo, hi = max(first[k], at[a] - reach), min(first[k] + lengths[k], at[z - 1] + max(ns) + reach)
                out.append((rows[i + k], lo - first[k], flat[lo:hi].astype(np.int64), h[a:z].astype(np.int64), at[a:z] - lo))
            for c in range(0, len(out), 500):
                cols = list(zip(*out[c : c + 500], strict=True))
                lists = [pa.array(x, pa.list_(pa.int64())) for x in cols[2:]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), *lists], names=["row_id", "start", "words", "grams", "places"])


def smith_waterman(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment score of each pair, and the passage word at which that alignment ends (exclusive)."""
    p, wide, long = len(items), max(map(len, passages), default=0), max(map(len, items), default=0)
    a, b = np.full((p, long), -1, np.int64), np.full((p, wide), -2, np.int64)
    ok = np.zeros((p, long), bool)
    for k in range(p):
        a[k, : len(items[k])], ok[k, : len(items[k])], b[k, : len(passages[k])] = items[k], True, passages[k]
    inside = np.arange(wide) < np.array([len(x) for x in passages])[:, None]
    h = np.zeros((p, wide + 1), np.int32)
    best, end = np.zeros(p, np.int32), np.zeros(p, np.int64)
    slope = np.arange(wide, dtype=np.int32) * -GAP
    for i in range(long):
        x = h[:, :-1] + np.where((a[:, i, None] == b) & ok[:, i, None] & inside, MATCH, MISMATCH)
        x = np.maximum(np.maximum(x, h[:, 1:] + GAP), 0)
        row = np.maximum.accumulate(x + slope, 1) - slope
        row = np.where(ok[:, i, None], row, h[:, 1:]).astype(np.int32)
        h[:, 1:] = row
        at = row.argmax(1)
        top = row[np.arange(p), at]
        end = np.where(top > best, at + 1, end)
        best = np.maximum(best, top)
    return best, end


def windows(places: list[int], words: int, length: int) -> list[tuple[int, int]]:
    """The parts of a passage of ``length`` words that an alignment through one of the seeds at ``places`` can touch."""
    reach, out = REACH * words, []
    for p in sorted(places):
        lo, hi = max(0, p - reach), min(length, p + SEED_WORDS + reach)
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _align(batches, threshold):
    for b in pieces(batches):
        items, found, owner, begins = [], [], [], []
        for k, (item, words, places) in enumerate(zip(*(b.column(c).to_pylist() for c in ("item_words", "words", "places")), strict=True)):
            item, words = np.array(item, np.int64), np.array(words, np.int64)
            for lo, hi in windows(places, len(item), len(words)):
                items.append(item)
                found.append(words[lo:hi])
                owner.append(k)
                begins.append(lo)
        order = np.argsort([len(x) * 4096 + len(y) for x, y in zip(found, items, strict=True)], kind="stable")
        score, end = np.zeros(len(items)), np.zeros(len(items), np.int64)
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and (j + 1 - i) * len(found[order[j]]) < CELLS // 50:
                j += 1
            part = order[i:j]
            s, e = smith_waterman([items[k] for k in part], [found[k] for k in part])
            score[part] = s / np.maximum(1, [MATCH * len(items[k]) for k in part])
            end[part] = e
            i = j
        keep = np.flatnonzero(score >= threshold)
        of = np.array(owner, np.int64)[keep]
        ends = b.column("start").to_numpy()[of] + np.array(begins, np.int64)[keep] + end[keep]
        yield pa.RecordBatch.from_arrays([b.column("row_id").take(pa.array(of)), b.column("item_id").take(pa.array(of)), pa.array(score[keep]), pa.array(ends)], names=["row_id", "item_id", "score", "end_word"])


def hits(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """row_id, item_id, score and end_word: each row of ``docs`` (row_id, text) with each item that it holds a copy of.

    score is the best alignment's share of what the whole item would score; end_word is the word behind that
    alignment's last. Items and texts that are null or have no words match nothing; repeated item_ids are items each, and
    the best counts; repeated texts are found each. Empty tables give an empty result.
    """
    sc = docs.sparkSession.sparkContext
    items = scratch.keep(benchmark.selectExpr("cast(item_id as long) item_id", "text").mapInArrow(_items, "item_id long, words array<long>").filter("size(words) > 0"), "items")
    all_grams = scratch.keep(items.mapInArrow(_seeds, "gram long, n int, item_id long"), "grams")
    table = sc.broadcast(table_of(all_grams))
    counts = docs.select(text_col).mapInArrow(partial(_tally, table=table), "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count"))
    counted = all_grams.join(counts, "gram", "left").groupBy("item_id").agg(F.collect_list(F.struct("gram", F.coalesce("count", F.lit(0)).alias("count"))).alias("counted"))
    seeds = scratch.keep(items.join(counted, "item_id").mapInArrow(_choose, "gram long, n int, item_id long, count long").distinct(), "seeds")
    table.destroy()
    rare, longest = sc.broadcast(table_of(seeds)), items.agg(F.max(F.size("words"))).first()[0] or 0
    found = scratch.keep(docs.select("row_id", text_col).mapInArrow(partial(_passages, table=rare, text_col=text_col, reach=REACH * longest), PASSAGE), "passages")
    met = scratch.keep(found.select("row_id", "start", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("row_id", "start", F.col("h.grams").alias("gram"), F.col("h.places").alias("place")), "met")
    # a gram of very many passages is dealt out in shares, and its items, however many, go to each share
    hot = hot_over(met.count())
    often = seeds.groupBy("gram").agg(F.max("count").alias("n")).filter(F.col("n") > hot)
    often = F.broadcast(scratch.keep(often.select("gram", F.ceil(F.col("n") / hot).cast("int").alias("shares")), "often"))
    one = F.lit(1)
    dealt = met.join(often, "gram", "left").withColumn("share", F.pmod(F.xxhash64("row_id", "start", "place"), F.coalesce("shares", one)).cast("int")).drop("shares")
    asked = seeds.join(often, "gram", "left").select("gram", "item_id", F.explode(F.sequence(F.lit(0), F.coalesce("shares", one) - 1)).alias("share"))
    pairs = dealt.join(asked, ["gram", "share"]).groupBy("row_id", "start", "item_id").agg(F.collect_set("place").alias("places"))
    pairs = scratch.keep(pairs.join(found.select("row_id", "start", "words"), ["row_id", "start"]), "pairs")
    items = items.withColumnRenamed("words", "item_words").join(pairs.groupBy("item_id").agg(F.count("*").alias("n")), "item_id")
    pairs = split_join(pairs, items, ["item_id"], hot_over(pairs.count()))
    aligned = pairs.select("row_id", "item_id", "start", "words", "places", "item_words").mapInArrow(partial(_align, threshold=threshold), "row_id long, item_id long, score double, end_word long")
    best = aligned.groupBy("row_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("b"))
    return best.select("row_id", "item_id", "b.score", "b.end_word")


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The contaminated rows: doc_id, item_id, score, end_word; a null doc_id stays null. See ``hits``."""
    rows = scratch.keep(docs.select("doc_id", text_col).withColumn("row_id", F.monotonically_increasing_id()), "rows")
    found = scratch.keep(hits(rows, benchmark, scratch, text_col, threshold), "hits")
    return found.join(rows.select("row_id", "doc_id"), "row_id").select("doc_id", "item_id", "score", "end_word")


def clean(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold no copy of an item, with their columns. See ``hits``."""
    rows = scratch.keep(docs.withColumn("row_id", F.monotonically_increasing_id()), "rows")
    found = scratch.keep(hits(rows, benchmark, scratch, text_col, threshold).select("row_id").distinct(), "hits")
    return rows.join(found, "row_id", "left_anti").drop("row_id")
