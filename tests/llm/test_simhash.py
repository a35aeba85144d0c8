"""Fingerprints and their components against the definition."""

import random
import re

import numpy as np
import xxhash
from sievework.llm import simhash
from sievework.llm.shared import Scratch


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    found = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in found]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in hashes) > len(hashes))


def components(prints, radius=3):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_fingerprints(monkeypatch):
    r = random.Random(2)
    texts = [None, "", " \t\n", "one", "One TWO", "a b c", "a  b\x0bc\n", "\x1c\x85   　É Ü", "x " * 5000, "x" * 100_000]
    texts += [" ".join(r.choice(["Ab", "c", "dÉ", "ef g", ""]) for _ in range(r.randrange(40))) for _ in range(300)]
    data = [(t or "").encode() for t in texts]
    want = [plain(t) for t in texts]
    assert simhash.fingerprints(data).tolist() == want
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    monkeypatch.setattr(simhash, "TEXTS", 5)
    assert simhash.fingerprints(data).tolist() == want
    assert simhash.fingerprints([]).tolist() == []


def test_connected(monkeypatch):
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    x = base[r.integers(0, 40, 900)]
    for _ in range(4):
        x = x ^ np.where(r.random(900) < 0.7, np.uint64(1) << r.integers(0, 64, 900).astype(np.uint64), np.uint64(0))
    x = np.unique(x)
    for small, strip, held in [(256, 8192, 1_000_000), (16, 30, 50)]:
        monkeypatch.setattr(simhash, "SMALL", small)
        monkeypatch.setattr(simhash, "STRIP", strip)
        monkeypatch.setattr(simhash, "LINKS", held)
        a, b = simhash.connected(x, None)
        assert (np.bitwise_count(x[:, None] ^ x) <= 3).sum() > len(x)
        at = {int(v): k for k, v in enumerate(x)}
        label = simhash.groups.smallest_connected(len(x), np.array([at[int(v)] for v in a]), np.array([at[int(v)] for v in b]))
        assert label.tolist() == components([int(v) for v in x])
        half = len(x) // 2
        a, b = simhash.connected(x[:half], x[half:])
        near = {(int(p), int(q)) for p in x[:half] for q in x[half:] if bin(int(p) ^ int(q)).count("1") <= 3}
        assert {v for p in near for v in p} == {int(v) for v in a} | {int(v) for v in b}


def test_components(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(200)]
    texts = [None, "", " ", "one", "a b"]
    for k in range(60):  # a long chain of small edits
        base[r.randrange(200)] = r.choice(words)
        texts += [" ".join(base)] * r.choice([1, 1, 4])
    texts += [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(200)]
    ids = r.sample(range(10_000), len(texts))
    rows = [(i, t, 9, "x") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int, bits string")
    prints = [plain(t) for t in texts]
    root = components(prints)
    least = {c: min(i for i, x in zip(ids, root, strict=True) if x == c) for c in set(root)}
    want = {i: (f"{p:016x}", prints.count(p), least[c]) for i, p, c in zip(ids, prints, root, strict=True)}
    assert len(set(root)) < len(set(prints))
    got = {x.doc_id: (x.fingerprint, x.n_same, x.component_id) for x in simhash.near_duplicates(df, Scratch(spark, "test-simhash")).collect()}
    assert got == want
    assert simhash.near_duplicates(df.limit(0), Scratch(spark, "test-simhash")).count() == 0


def test_small_tiles_and_null_ids(spark, monkeypatch):
    texts = [" ".join(f"{c}{k}" for k in range(30)) for c in "abcdefghijklmnop"] * 3
    rows = [(None if k % 5 == 0 else k, t) for k, t in enumerate(texts)] + [(None, "alone in its component"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(simhash, "hot_over", lambda rows: 1)
    got = [tuple(x) for x in simhash.near_duplicates(df, Scratch(spark, "test-simhash")).collect()]
    prints = [plain(t) for _, t in rows]
    root = components(prints)
    least = {c: min((i for (i, _), x in zip(rows, root, strict=True) if x == c and i is not None), default=None) for c in set(root)}
    want = [(i, f"{p:016x}", prints.count(p), least[c]) for (i, _), p, c in zip(rows, prints, root, strict=True)]
    show = lambda found: sorted(found, key=str)
    assert show(got) == show(want)
    signed = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in dict.fromkeys(prints)], "fingerprint long")
    pairs = {tuple(x) for x in simhash.links(signed, Scratch(spark, "test-simhash"), tile=2).collect()}
    assert len({v for p in pairs for v in p}) == len({p for p in set(prints) for q in set(prints) if p != q and bin(p ^ q).count("1") <= 3})
