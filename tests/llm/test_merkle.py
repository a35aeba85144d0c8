"""Manifests against plain trees: groups of many sizes, nulls, repeated rows, clashing names."""

import hashlib
import random
import zlib

from pyspark.sql import functions as F
from sievework.llm import merkle
from sievework.llm.shared import Scratch

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int, group int, index int, size int, name int"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for level in tree[:-1]:
        start = i // 16 * 16
        out.append((level[start:i], level[i + 1 : start + 16]))
        i //= 16
    return out


def plain(rows):
    leaf = lambda r: h(*map(part, r))
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([leaf(r) for r in sorted(groups[s], key=order)]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    for k, s in enumerate(names):
        for i, r in enumerate(sorted(groups[s], key=order)):
            proof, end = siblings(trees[s], i) + siblings(top, k), leaf(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                end = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for a, b in proof:
                end = h(*a, end, *b)
            yield r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*("".join(a + b) for a, b in proof)), end, end == top[-1][0]


def key(r):
    return tuple((x is not None, str(x)) for x in r)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, 2, 3, 4, 5) for r in rows], SCHEMA)
    return sorted((tuple(r) for r in merkle.verified(merkle.manifest(df, Scratch(spark, "test-merkle"), **options)).collect()), key=key)


def test_groups_of_many_sizes(spark):
    r, rows = random.Random(1), []
    for s, n in [("a", 1), ("b", 2), ("c", 16), ("d", 17), ("É", 256), ("e", 257), ("", 33), (None, 18), *((f"s{k}", 1) for k in range(20))]:
        rows += [(len(rows) + k, s, r.choice(["en", None]), r.choice([5, None]), r.choice(["Upper CASE É", "lower", "", None])) for k in range(n)]
    rows += [(None, "d", None, None, None), (None, "d", "x", 1, "AB"), (7, "d", "y", 1, "AB"), (7, "d", "y", 1, "AB"), (5_000_000_000, "a", "z", 2, "Long " * 200_000)]
    got = run(spark, rows)
    assert got == sorted(plain(rows), key=key)
    assert {x[-1] for x in got} == {True, False}


def test_hot_joins_and_smallest_inputs(spark, monkeypatch):
    monkeypatch.setattr(merkle, "hot_over", lambda rows: 3)  # broadcasts and joins both have rows
    rows = [(k, "a" if k % 3 else "b", "en", k, f"Text {k}") for k in range(700)]
    assert run(spark, rows) == sorted(plain(rows), key=key)
    assert run(spark, rows[:1]) == list(plain(rows[:1]))
    assert run(spark, []) == []


def test_coordinates(spark):
    """Every sibling of a proof is a node of the table, and the index follows the order of keys."""
    df = spark.createDataFrame([(k, "g", None, None, None) for k in range(300)], "doc_id long, source string, lang string, n_chars long, text string")
    found = merkle.manifest(df, Scratch(spark, "test-merkle"))
    assert found.select(F.sum(F.aggregate("proof", F.lit(0), lambda n, s: n + F.char_length(s.before) + F.char_length(s.after)))).first()[0] == 64 * sum(len(a) + len(b) for k in range(300) for a, b in siblings(levels([""] * 300), k))
