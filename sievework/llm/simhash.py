"""Near-duplicates by SimHash: 64-bit fingerprints, compared exactly in tiles.

Equal fingerprints count once. The different ones are dealt to tiles by their number of set bits; two fingerprints that
differ in r bits differ in their number of set bits by r at most, so only tiles that near are brought together. A task
compares two tiles with exclusive-or and bit counts, skipping smaller tiles whose quarters' bit counts are too far apart.
Nothing is sampled and no bucket stands between two fingerprints: every pair within the radius is found.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm import groups
from sievework.llm.shared import Scratch, chunks, hot_over, partitions, pieces, split_join

RADIUS, WORDS, SEED = 3, 3, 42
#: Fingerprints of a tile, about, and of the smaller tiles inside it; comparisons and links held at once.
TILE, SMALL, STRIP, LINKS = 32_768, 256, 8_192, 1_000_000
#: Shingles hashed, and texts whose bits are counted, at once.
SHINGLES, TEXTS = 500_000, 128
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The bits of each byte.
BITS = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)


def shingles(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all words with one space behind each, where each shingle starts and ends there, and the number of each text's.

    ``data`` has the texts' bytes one after the other, text k from ``bounds[k]`` to ``bounds[k + 1]``. Fewer than three words are one
    shingle; A-Z become a-z.
    """
    word = ~SPACE[data]
    before, after = np.ones(len(data), bool), np.ones(len(data), bool)
    before[1:], after[:-1] = ~word[:-1], ~word[1:]
    some = bounds[:-1] < bounds[1:]
    before[bounds[:-1][some]] = True
    after[bounds[1:][some] - 1] = True
    first, last = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    words = np.diff(np.searchsorted(first, bounds))
    ends = np.cumsum(last - first + 1) - 1
    starts = ends - (last - first)
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    letters = np.ones(len(joined), bool)
    letters[ends] = False
    joined[letters] = LOWER[data[word]]
    count = np.maximum(words - (WORDS - 1), np.minimum(words, 1))
    base = np.repeat(np.cumsum(words) - words, count)
    at = base + np.arange(len(base)) - np.repeat(np.cumsum(count) - count, count)
    return joined, starts[at], ends[at + np.repeat(np.minimum(words, WORDS), count) - 1], count


def bit_counts(hashes: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each text, how many of its hashes have each bit set: of each byte's values first, then of their bits."""
    out = np.zeros((len(count), 64), np.int64)
    ends = np.cumsum(count)
    for a in range(0, len(count), TEXTS):
        n = count[a : a + TEXTS]
        for lo in range(ends[a] - n[0], ends[a + len(n) - 1], SHINGLES):
            hi = min(lo + SHINGLES, ends[a + len(n) - 1])
            owner = np.searchsorted(ends[a : a + len(n)], np.arange(lo, hi), "right")
            place = (owner[:, None] * 8 + np.arange(8)) * 256 + hashes[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8)
            out[a : a + len(n)] += (np.bincount(place.ravel(), minlength=len(n) * 2048).reshape(-1, 8, 256) @ BITS).reshape(-1, 64)
    return out


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A text's bit is set if it is in more than half of its shingles' hashes; a text without words has none."""
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    joined, starts, ends, count = shingles(np.frombuffer(b"".join(texts), np.uint8), bounds)
    raw, hashed, h = joined.tobytes(), np.empty(len(starts), np.uint64), xxhash.xxh64_intdigest
    for lo in range(0, len(starts), SHINGLES):
        a, z = starts[lo : lo + SHINGLES].tolist(), ends[lo : lo + SHINGLES].tolist()
        hashed[lo : lo + len(a)] = [h(raw[i:j], SEED) for i, j in zip(a, z, strict=True)]
    bits = 2 * bit_counts(hashed, count) > count[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _sign(batches):
    for b in pieces(batches):
        texts = b.column("text").cast(pa.binary()).to_pylist()
        texts = [t or b"" for t in texts]
        found = [fingerprints(texts[i:j]) for i, j in chunks(texts)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["doc_id", "fingerprint"])


def quarters(x: np.ndarray) -> np.ndarray:
    """Bit counts of the four quarters of each fingerprint."""
    return np.stack([np.bitwise_count(x >> np.uint64(16 * k) & np.uint64(0xFFFF)) for k in range(4)], 1).astype(np.int16)


def _small_tiles(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints ordered by their quarters' bit counts, and the least and greatest of these in each small tile."""
    q = quarters(x)
    order = np.lexsort(q.T[::-1])
    starts = np.arange(0, len(x), SMALL)
    return x[order], np.minimum.reduceat(q[order], starts), np.maximum.reduceat(q[order], starts)


def _forest(links: list[np.ndarray], n: int) -> np.ndarray:
    """As few links (a, b) that connect the same."""
    a, b = np.concatenate([x[0] for x in links]), np.concatenate([x[1] for x in links])
    label = groups.smallest_connected(n, a, b)
    at = np.flatnonzero(label < np.arange(n))
    return np.stack([at, label[at]])


def connected(x: np.ndarray, y: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect all fingerprints of ``x`` and ``y`` (of ``x`` alone if that is None) that differ in ``radius`` bits or fewer."""
    x, lx, hx = _small_tiles(x)
    same, shift = y is None, 0 if y is None else len(x)
    y, ly, hy = (x, lx, hx) if same else _small_tiles(y)
    links, held = [np.empty((2, 0), np.int64)], 0
    for k in range(len(lx)):
        near = np.maximum(0, np.maximum(ly - hx[k], lx[k] - hy)).sum(1) <= radius
        if same:
            near[:k] = False
        at = np.flatnonzero(np.repeat(near, SMALL)[: len(y)])
        mine = x[k * SMALL : (k + 1) * SMALL]
        for s in range(0, len(at), STRIP):
            other = at[s : s + STRIP]
            i, j = np.nonzero(np.bitwise_count(mine[:, None] ^ y[other]) <= radius)
            pair = np.stack([i + k * SMALL, other[j] + shift])
            links.append(pair[:, pair[0] < pair[1]])
            held += links[-1].shape[1]
            if held > LINKS:
                links = [_forest(links, shift + len(y))]
                held = links[0].shape[1]
    every = x if same else np.concatenate([x, y])
    found = _forest(links, len(every))
    return every[found[0]], every[found[1]]


def _compare(batches, radius):
    """A pair of tiles a row; its links as (a, b), a > b as signed numbers."""
    for batch in batches:
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            mine = x.values.to_numpy().view(np.uint64)
            a, b = connected(mine, y.values.to_numpy().view(np.uint64) if y.is_valid else None, radius)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def links(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b), a > b: links between the different fingerprints of ``prints`` that connect all within ``radius`` bits of each other.

    Tiles hold about ``tile`` fingerprints of one bit count; how many a bit count has follows from its rows (65 rows, broadcast).
    """
    prints = prints.select("fingerprint", F.bit_count("fingerprint").alias("bits"))
    sizes = scratch.keep(prints.groupBy("bits").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")), "sizes")
    dealt = prints.join(F.broadcast(sizes), "bits").withColumn("tile", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
    tiles = scratch.keep(dealt.groupBy("bits", "tile").agg(F.collect_list("fingerprint").alias("x")), "tiles")
    others = F.broadcast(sizes.select(F.col("bits").alias("to_bits"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("to_tile")).withColumn("to", F.struct("to_bits", "to_tile")).groupBy("to_bits").agg(F.collect_list("to").alias("to")))
    reach = tiles.select("bits", "tile", F.explode(F.sequence(F.col("bits"), F.col("bits") + radius)).alias("to_bits")).join(others, "to_bits")
    jobs = reach.select("bits", "tile", F.explode("to").alias("to")).select("bits", "tile", "to.*").filter("to_bits > bits or to_tile >= tile")
    jobs = jobs.repartition(partitions(scratch.spark), "bits", "tile", "to_bits", "to_tile")
    right = tiles.select(F.col("bits").alias("to_bits"), F.col("tile").alias("to_tile"), F.col("x").alias("y"))
    self_ = (F.col("bits") == F.col("to_bits")) & (F.col("tile") == F.col("to_tile"))
    met = jobs.join(tiles, ["bits", "tile"]).join(right, ["to_bits", "to_tile"]).withColumn("y", F.when(~self_, F.col("y")))
    met = met.repartition(partitions(scratch.spark), "bits", "tile", "to_bits", "to_tile").select("x", "y")
    return met.mapInArrow(partial(_compare, radius=radius), "a long, b long")


def near_duplicates(docs: DataFrame, scratch: Scratch, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, n_same, component_id) of every row.

    ``fingerprint`` has 16 hexadecimal digits; n_same rows have the same one; component_id is the smallest doc_id that
    links lead to, the row's own included. Null and empty texts, and those of white space, have the fingerprint zero and are
    linked like any other. Long texts are worked on whole, one at a time. Null doc_ids are rows like others, but never a
    component's smallest, unless it has no other (then null); repeated rows are rows of one fingerprint. Other columns are
    ignored; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = scratch.keep(docs.select("doc_id", "text").mapInArrow(_sign, f"doc_id {kind}, fingerprint long"), "signed")
    prints = scratch.keep(signed.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")), "prints")
    edges = scratch.keep(links(prints, scratch, radius).distinct(), "links")
    found = groups.components(edges, scratch).withColumnRenamed("id", "fingerprint")
    rooted = scratch.keep(prints.join(found, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")), "rooted")
    least = scratch.keep(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n")), "least")
    known = split_join(rooted.select("fingerprint", F.col("n").alias("n_same"), "root"), least, ["root"], hot_over(rooted.count()))
    known = scratch.keep(known.select("fingerprint", "n_same", F.col("n_same").alias("n"), "component_id"), "known")
    out = split_join(signed, known, ["fingerprint"], hot_over(signed.count()))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "n_same", "component_id")
