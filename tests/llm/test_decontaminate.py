"""Alignment against a plain table, and planted copies."""

import random

import numpy as np
import pytest

from sievework.llm import decontaminate as dec
from sievework.llm.shared import Scratch


def plain(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (dec.MATCH if a[i] == b[j] else dec.MISMATCH), h[i, j + 1] + dec.GAP, h[i + 1, j] + dec.GAP)
    return h.max()


def test_alignment():
    r = np.random.default_rng(1)
    items = [r.integers(0, 6, r.integers(1, 15)) for _ in range(120)]
    found = [r.integers(0, 6, r.integers(0, 25)) for _ in range(120)]
    score, _ = dec.smith_waterman(items, found)
    assert score.tolist() == [plain(a, b) for a, b in zip(items, found, strict=True)]
    assert dec.smith_waterman([np.array([1, 2, 3])], [np.array([9, 1, 2, 3, 9])])[1].tolist() == [4]


@pytest.fixture(scope="module")
def planted(spark):
    r = random.Random(2)
    words = ["".join(r.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = {k: text(r.randint(12, 60)) for k in range(20)} | {100: ["only", "two"], 101: []}
    docs, truth = {}, set()
    for k in range(150):
        w = text(r.randint(0, 120))
        if k % 3 == 0:
            item = r.randrange(20) if k % 2 else 0  # one item in many texts
            copy = [x if r.random() > 0.12 else r.choice(words) for x in items[item]]
            at = r.randint(0, len(w))
            w[at:at] = copy
            truth.add((k, item))
        docs[k] = " ".join(w).capitalize() + "."
    docs[500], docs[501] = None, ""
    docs[502] = "Only, TWO"
    truth.add((502, 100))
    d = spark.createDataFrame([(k, t, "x") for k, t in docs.items()] + [(3, docs[3], "x")], "doc_id long, text string, item_id string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()] + [(102, None)], "item_id long, text string")
    return d, b, truth


def test_planted_copies(spark, planted):
    d, b, truth = planted
    got = dec.find(d, b, Scratch(spark, "test-dec")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert sum(r.doc_id == 3 for r in got) == 2 * sum(k == 3 for k, _ in truth)
    left = {r.doc_id for r in dec.clean(d, b, Scratch(spark, "test-dec")).collect()}
    assert left == {*range(150), 500, 501, 502} - {k for k, _ in truth}


def test_empty(spark, planted):
    d, b, _ = planted
    assert dec.find(d.limit(0), b, Scratch(spark, "test-dec")).count() == 0
    assert dec.find(d, b.limit(0), Scratch(spark, "test-dec")).count() == 0


def test_long_items(spark):
    """Items of 50 to 400 words, whole, cut, edited and much quoted, against alignment of every text with every item."""
    r = random.Random(8)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(900)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    items = {0: text(200), 1: text(400), 2: text(50), 3: text(120)}
    docs = [items[0][:100] + text(30) for _ in range(10)] + [text(40) + items[0][:130] + text(40), text(5) + items[0]]
    docs += [items[1][:150] + text(12) + items[1][150:260] + text(70), items[1][100:320], items[2][5:40] + text(10), items[3][:50]]
    docs += [[w for k, w in enumerate(items[3]) if k % 7], [w if k % 9 else r.choice(words) for k, w in enumerate(items[1])], text(500) + items[1] + text(1500)]
    docs += [text(r.randint(0, 400)) for _ in range(10)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    ids = {w: k for k, w in enumerate(words)}
    want = {}
    for k, w in enumerate(docs):
        for item, x in items.items():
            score, _ = dec.smith_waterman([np.array([ids[v] for v in x])], [np.array([ids[v] for v in w])])
            if (share := int(score[0]) / (2 * len(x))) >= dec.THRESHOLD:
                want[k, item] = share
    got = {(x.doc_id, x.item_id): x.score for x in dec.find(d, b, Scratch(spark, "test-dec")).collect()}
    assert got == want and len(want) >= 16


def test_grams_of_many_items_and_most_texts(spark, monkeypatch):
    """A stock phrase that 20 items and nearly all texts share is split among tasks, and what is found stays the same."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(300)]
    text = lambda n: [r.choice(words) for _ in range(n)]
    stock = ["choose", "the", "right", "answer"]
    items = {k: stock + text(6) for k in range(20)}
    docs = [text(r.randint(0, 20)) + stock + text(r.randint(0, 20)) for _ in range(120)] + [text(9) + items[k] + text(4) for k in range(20)]
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(docs)], "doc_id long, text string")
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in items.items()], "item_id long, text string")
    ids = {w: k for k, w in enumerate([*words, *stock])}
    want = set()
    for k, w in enumerate(docs):
        for item, x in items.items():
            score, _ = dec.smith_waterman([np.array([ids[v] for v in x])], [np.array([ids[v] for v in w])])
            if int(score[0]) / (2 * len(x)) >= dec.THRESHOLD:
                want.add((k, item))
    assert {(120 + k, k) for k in range(20)} <= want
    for hot in (3, 10_000):
        monkeypatch.setattr(dec, "hot_over", lambda rows, hot=hot: hot)
        assert {(x.doc_id, x.item_id) for x in dec.find(d, b, Scratch(spark, "test-dec")).collect()} == want
