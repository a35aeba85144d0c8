"""Groups of similar sets: banded candidates, distributed union-find, and comparison inside candidate groups.

No step emits the pairs of a bucket. A bucket links its members to its smallest one; union-find over these links
gives candidate groups, and every pair that any band brings together lies in one of them. A group is then dealt in
blocks, and a task compares two blocks in memory and emits, for each member, a count of its links and one edge. Ids
are dealt first; the members' content follows once it is known where it goes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Scratch, hot_over, mix, partitions, split_join

#: A block has about so many members, and so many elements of their sets, at most.
BLOCK_MEMBERS, BLOCK_ELEMENTS = 1024, 400_000
#: Rows that compared groups hand on at a time, about.
OUT_ROWS = 10_000
#: Bits of a table of keys: 8 MB, whatever the number of keys.
TABLE_BITS = 26
#: Bands whose keys are shuffled at a time: what lies on disk at once is that part of all keys.
BANDS_AT_ONCE = 4


def bands(signatures: np.ndarray, count: int, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    parts = signatures.reshape(-1, count, rows)
    out = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        out ^= parts[:, :, k]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return mix(out)


def packed(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width))
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    """The matrix that ``packed`` made binary values of."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def bit_table(keys: DataFrame) -> np.ndarray:
    """2^TABLE_BITS bits, set at the leading bits of the keys (one column of 64 hashed bits); at most 8 MB reach the driver."""
    key = keys.columns[0]
    byte, bit = F.shiftrightunsigned(key, 64 - TABLE_BITS + 3), F.shiftrightunsigned(key, 64 - TABLE_BITS).bitwiseAND(F.lit(7))
    at = keys.select(byte.alias("byte"), bit.cast("int").alias("bit")).groupBy("byte").agg(F.bit_or(F.expr("shiftleft(1, bit)")).alias("bits")).toArrow()
    out = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    out[at.column("byte").to_numpy()] = at.column("bits").to_numpy()
    return out


def in_table(bits: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the 64-bit hashes have their bit set: all that went into the table, and some others."""
    place = hashed.astype(np.uint64) >> np.uint64(64 - TABLE_BITS)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def _keys(batches, some=None, part=slice(None)):
    """(key, id) of each band of each row, or of those in ``part``; with a table, of the keys in it."""
    for b in batches:
        ids, offsets = b.column("id").to_numpy(), b.column("bands")
        keys = np.frombuffer(b"".join(offsets.to_pylist()), np.int64)
        keys = keys.reshape(len(ids), len(keys) // max(1, len(ids)))[:, part]
        ids, keys = np.repeat(ids, keys.shape[1]), keys.ravel()
        if some is not None:
            keep = in_table(some.value, keys)
            keys, ids = keys[keep], ids[keep]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], names=["key", "id"])


KEYED = "key long, id long"


def star_edges(banded: DataFrame, scratch: Scratch, count: int) -> DataFrame:
    """(a, b), a > b: each member of a bucket and the bucket's smallest; ``banded`` has (id, bands), ``count`` 64-bit keys a row.

    Buckets are counted with partial sums, BANDS_AT_ONCE bands after the other, as a band's number is part of its keys: the
    shuffled keys of one turn go before the next. One of two members is an edge by that alone; only the keys of larger ones are
    read again. A key of very many members is not dealt to one task.
    """
    least, most = F.min("id").alias("b"), F.max("id").alias("a")
    buckets = None
    for at in range(0, count, BANDS_AT_ONCE):
        keyed = banded.mapInArrow(partial(_keys, part=slice(at, at + BANDS_AT_ONCE)), KEYED)
        turn = scratch.keep(keyed.groupBy("key").agg(least, most, F.count("*").alias("n")).filter("n > 1"), "buckets")
        buckets = turn if buckets is None else buckets.union(turn)
        del keyed, turn
        scratch.release()
    large = buckets.filter("n > 2").select("key", "b", "n")
    some = scratch.spark.sparkContext.broadcast(bit_table(large.select("key")))
    again = scratch.keep(banded.mapInArrow(partial(_keys, some=some), KEYED), "again")
    met = split_join(again, large, ["key"], hot_over(again.count())).filter("id > b").select(F.col("id").alias("a"), "b")
    return scratch.keep(met.union(buckets.filter("n = 2").select("a", "b")).distinct(), "stars")


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down or only edges up."""
    ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("b", F.lit(0), F.lit(1)))
    bad = ends.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up")).filter("down > 1 or (down = 1 and up = 1)")
    return bad.isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) of every id in ``edges`` (a > b, distinct): root is the smallest id that it is connected to.

    Alternates two steps until only stars are left. The large star hangs each neighbour that is larger than a node on the
    smallest of the node and its neighbours; the small star does so with the smaller neighbours and the node itself.
    The number of rounds grows with the logarithm of the longest path; each round's edges are written to the shared folder.
    A node with very many neighbours is not dealt to one task.
    """
    mine = False
    while not _are_stars(edges):
        hot = hot_over(edges.count())
        up = edges.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(1).alias("up"))
        least = up.union(edges.select("a", "b", F.lit(0))).groupBy("u").agg(F.min("v").alias("m"), F.sum("up").alias("n"))
        least = scratch.keep(least.filter("n > 0").select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = scratch.keep(split_join(up.drop("up"), least, ["u"], hot).select(F.col("v").alias("a"), F.col("m").alias("b")).distinct(), "large")
        scratch.drop(least)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        before, edges = edges, scratch.keep(small, "small")
        scratch.drop(large, *[before] * mine)
        mine = True
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))


def grouped(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, root) with a row for each root too."""
    found = components(edges, scratch)
    return scratch.keep(found.union(found.select(F.col("root").alias("id"), "root").distinct()), "groups")


def dealt(members: DataFrame, banded: DataFrame, scratch: Scratch) -> DataFrame:
    """Members (id, root, size) dealt to pairs of blocks of their group: (id, root, i, j, side), side the member's own block.

    The number of a group's blocks follows from its members and their sizes; a member's block from its id. A member goes
    to its own block, and to those other blocks that hold a member of one of its buckets: in a group that is
    a long chain these are few, in one where all are alike all.
    """
    members = scratch.keep(members.select("id", "root", "size"), "members")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_MEMBERS), F.ceil(F.sum("size") / BLOCK_ELEMENTS)).cast("int").alias("blocks")
    sizes = scratch.keep(members.groupBy("root").agg(blocks, F.count("*").alias("n")).filter("blocks > 1"), "sizes")
    zero = F.lit(0)
    if sizes.isEmpty():
        return members.select("id", "root", zero.alias("i"), zero.alias("j"), zero.alias("side"))
    large = split_join(members, sizes, ["root"], hot_over(members.count()))
    large = scratch.keep(large.select("id", "root", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("side")), "large")
    keyed = scratch.keep(banded.join(large.select("id"), "id", "left_semi").mapInArrow(_keys, KEYED).join(large, "id"), "keyed")
    there = keyed.groupBy("key", "side").agg(F.first("root").alias("root")).select("key", F.col("side").alias("other"))
    met = keyed.join(there, "key").select("id", "root", "side", "other").union(large.select("id", "root", "side", F.col("side").alias("other"))).distinct()
    met = met.select("id", "root", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side")
    return members.join(sizes.select("root"), "root", "left_anti").select("id", "root", zero.alias("i"), zero.alias("j"), zero.alias("side")).union(met)


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one (root, i, j) after the other, from sorted batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in ("root", "i", "j")], 1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            k = tuple(keys[a])
            if held and k != key:
                yield pa.Table.from_batches(held)
                held = []
            key = k
            held.append(b.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs (left[k], right[k]) of sorted sets."""
    if len(left) <= 4 * len(sets):
        return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(left, right, strict=True)], np.int64)
    rows, cols = np.unique(left), np.unique(right)
    use = np.union1d(rows, cols)
    place = np.zeros(len(sets), np.int64)
    place[use] = np.arange(len(use))
    values = np.concatenate([sets[k] for k in use])
    owner = np.repeat(np.arange(len(use)), [len(sets[k]) for k in use])
    _, at, df = np.unique(values, return_inverse=True, return_counts=True)
    keep = df[at] > 1
    column = np.cumsum(df > 1) - 1
    at, owner = column[at[keep]], owner[keep]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    total = np.zeros((len(rows), len(cols)), np.float32)
    width = max(64, 16_000_000 // (4 * len(use)))
    for a in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        lo, hi = np.searchsorted(at, [a, a + width])
        m = np.zeros((len(use), width), np.float32)
        m[owner[lo:hi], at[lo:hi] - a] = 1
        total += m[place[rows]] @ m[place[cols]].T
    return total[np.searchsorted(rows, left), np.searchsorted(cols, right)].astype(np.int64)


def smallest_connected(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is connected to."""
    label = np.arange(n)
    while len(left):
        before = label.copy()
        low = np.minimum(label[left], label[right])
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def compare(batches, decide: Callable[[dict, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], columns: list[str], prepare: Callable | None = None):
    """For each pair of blocks: (id, links, weight, low) of the members that ``decide`` finds links for.

    ``decide(columns, left side, right side)`` gives the linked pairs, as indices; weight sums the partners' ``copies``.
    ``prepare`` goes over the batches first, where what each member needs is made for many groups at once.
    """
    held, size = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in zip(*held, strict=True)], names=["id", "links", "weight", "low"])

    for t in runs(prepare(batches) if prepare else batches):
        ids, side = t.column("id").to_numpy(), t.column("side").to_numpy()
        copies = t.column("copies").to_numpy()
        order = np.argsort(ids, kind="stable")
        rows = {c: t.column(c).take(pa.array(order)) for c in columns}
        ids, side, copies = ids[order], side[order], copies[order]
        i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
        left, right = decide(rows, np.flatnonzero(side == i), np.flatnonzero(side == j))
        n = len(ids)
        if not len(left):
            continue
        links = np.bincount(left, minlength=n) + np.bincount(right, minlength=n)
        weight = np.bincount(left, copies[right], n) + np.bincount(right, copies[left], n)
        some = np.flatnonzero(links)
        low = smallest_connected(n, left, right)
        held.append((ids[some], links[some].astype(np.int64), weight[some].astype(np.int64), ids[low[some]]))
        size += len(some)
        if size > OUT_ROWS:  # groups are small: a batch each would cost more than comparing them
            yield out()
            held, size = [], 0
    if held:
        yield out()


COMPARED = "id long, links long, weight long, low long"


def linked(members: DataFrame, content: DataFrame, banded: DataFrame, decide: Callable, columns: list[str], scratch: Scratch, prepare: Callable | None = None, made: list[str] | None = None) -> DataFrame:
    """Compare the members (id, root, size) of each candidate group; ``content`` has (id, copies and ``columns``), of which ``prepare`` makes those that ``made`` names. See ``compare``."""
    jobs = dealt(members, banded, scratch).join(content.select("id", "copies", *columns), "id")
    jobs = jobs.repartition(partitions(scratch.spark), "root", "i", "j").sortWithinPartitions("root", "i", "j")
    return jobs.mapInArrow(partial(compare, decide=decide, columns=made or columns, prepare=prepare), COMPARED)
