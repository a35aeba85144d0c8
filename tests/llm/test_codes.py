"""Codes and codebooks against a plain run of the same rounds in whole numbers."""

import math
import random

import numpy as np
from sievework.llm import codes
from sievework.llm.shared import Scratch


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """codes, error by row, and the books; rows are (vec_id, vector, label)."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts
    cut = [[[min(max(math.floor(x * scale), -codes.MOST), codes.MOST) for x in v[p * width : (p + 1) * width]] for p in range(parts)] for _, v, _ in good]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            mine = [nearest(c[p], books[p])[1] for c in cut]
            new.append([[sum(c[p][i] for c, m in zip(cut, mine, strict=True) if m == k) // mine.count(k) for i in range(width)] if k in mine else e for k, e in enumerate(books[p])])
        books = new
    out = []
    for (i, _, label), c in zip(good, cut, strict=True):
        found = [nearest(c[p], books[p]) for p in range(parts)]
        out.append((i, label, [k for _, k in found], sum(d for d, _ in found)))
    return out, books


def same(found, want):
    got = [(r.vec_id, r.label, r.codes, r.error) for r in found.rows.collect()]
    assert sorted(got, key=str) == sorted(want[0], key=str)
    assert found.books.tolist() == want[1]


SCHEMA = "vec_id long, embedding array<float>, label int, codes int, position string, n int"


def test_rounds(spark, monkeypatch):
    r = random.Random(5)
    some = [[r.choice([-0.5, 0.25, 1.5]) + r.gauss(0, 0.2) for _ in range(8)] for _ in range(60)]
    vectors = [r.choice(some)[:4] + r.choice(some)[4:] for _ in range(300)] + [[0.001 * k % 0.01] * 8 for k in range(40)]
    rows = [(k, np.float32(v).tolist(), r.choice([1, 2, None])) for k, v in enumerate(vectors)]
    rows += [(None, rows[3][1], 1), (7, rows[9][1], 2), (7, rows[8][1], 2), (1000, None, 1), (1001, [], 1), (1002, [1.0] * 7 + [None], 1), (1003, [float("nan")] * 8, 1), (1004, [float("inf")] + [0.0] * 7, 2), (1005, [1.0] * 4, 2)]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], SCHEMA)
    for entries in (256, 10):
        same(codes.compress(df, Scratch(spark, "test-codes"), entries=entries), plain(rows, entries=entries))
    monkeypatch.setattr(codes, "hot_over", lambda n: 5)
    found = codes.compress(df, Scratch(spark, "test-codes"), parts=2, entries=16, rounds=1)
    want = plain(rows, 2, 16, 1)
    same(found, want)
    sums = {x: sum(e for _, y, _, e in want[0] if y == x) for x in (1, 2, None)}
    assert {(x.label, x.label_error) for x in codes.label_errors(found.rows, Scratch(spark, "test-codes")).collect()} == set(sums.items())
    middle = codes.decoded(np.array([x[2] for x in want[0]]), found.books)
    good = {x[0]: x[1] for x in rows}
    for (i, _, _, error), m in zip(want[0], middle, strict=True):
        if i is not None and i != 7:
            assert ((np.floor(np.array(good[i]) * 1024) - (m * 1024 - 0.5)) ** 2).sum() == error


def test_large_numbers_few_rows_and_none(spark):
    rows = [(1, [1e30, -1e30, 5000.0, -7000.0], 1), (2, [3.0, 2.0, 5001.0, 1.0], 1), (3, [130000.0, 2.0, -5001.0, 1.0], None)]
    df = spark.createDataFrame([(*x, 1, "p", 2) for x in rows], SCHEMA)
    same(codes.compress(df, Scratch(spark, "test-codes"), entries=2), plain(rows, entries=2))
    same(codes.compress(df.limit(1), Scratch(spark, "test-codes")), plain(rows[:1]))
    none = codes.compress(df.limit(0), Scratch(spark, "test-codes"))
    assert none.rows.count() == 0 and none.books.size == 0
    assert codes.label_errors(none.rows, Scratch(spark, "test-codes")).count() == 0


def test_nearest_is_exact_at_every_size():
    r = np.random.default_rng(6)
    for most in (3, 1 << 20, 1 << 27):
        x, b = r.integers(-most, most, (500, 16)), r.integers(-most, most, (40, 16))
        b[20] = b[3]
        code, error = codes.nearest(x.astype(np.int32), b)
        d = ((x[:, None].astype(object) - b) ** 2).sum(2)
        assert code.tolist() == [row.index(min(row)) for row in d.tolist()] and error.tolist() == d.min(1).tolist()
