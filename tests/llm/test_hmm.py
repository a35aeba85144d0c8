"""The hidden Markov model: recursions against sums over all paths, base scores, and the gain over the base."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sievework.llm import hmm
from sievework.llm.shared import Scratch


def parameters(states, symbols, seed):
    r = np.random.default_rng(seed)
    start, move, emit = r.random(states), r.random((states, states)), r.random((symbols, states))
    return start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)


def test_forward_is_the_sum_over_paths():
    start, move, emit = parameters(3, 5, 1)
    seqs = [np.array(s) for s in ([0], [1, 4, 2, 2], [3, 3, 3], [0, 1, 2, 3, 4])]
    for s, got in zip(seqs, hmm.forward(seqs, start, move, emit), strict=True):
        total = sum(start[p[0]] * emit[s[0], p[0]] * math.prod(move[a, b] * emit[o, b] for a, b, o in zip(p, p[1:], s[1:], strict=False)) for p in itertools.product(range(3), repeat=len(s)))
        assert abs(got - math.log(total)) < 1e-9


def test_expected_counts_and_growth():
    start, move, emit = parameters(2, 4, 2)
    seqs = [np.array(s) for s in ([0, 1, 3], [2], [1, 1, 0, 2, 3])]
    sums = [np.zeros(2), np.zeros((2, 2)), np.zeros((4, 2))]
    before = hmm.expect(seqs, start, move, emit, sums)
    assert abs(sums[0].sum() - 3) < 1e-9 and abs(sums[1].sum() - 6) < 1e-9 and abs(sums[2].sum() - 9) < 1e-9
    assert np.allclose(sums[2].sum(1), [2, 3, 2, 2])
    # one expected count by enumeration: transitions 0 -> 1
    want = 0.0
    for s in seqs:
        paths = {p: start[p[0]] * emit[s[0], p[0]] * math.prod(move[a, b] * emit[o, b] for a, b, o in zip(p, p[1:], s[1:], strict=False)) for p in itertools.product(range(2), repeat=len(s))}
        want += sum(v * sum((a, b) == (0, 1) for a, b in zip(p, p[1:], strict=False)) for p, v in paths.items()) / sum(paths.values())
    assert abs(sums[1][0, 1] - want) < 1e-9
    again = hmm.forward(seqs, sums[0] / 3, sums[1] / sums[1].sum(1, keepdims=True), sums[2] / sums[2].sum(0)).sum()
    assert again > before


@pytest.fixture(scope="module")
def scored(spark):
    r = np.random.default_rng(3)
    vocab = [[f"{p}{k}" for k in range(40)] for p in "xy"]
    rows = [(i, " ".join(vocab[i % 2][int(k)] for k in r.zipf(1.3, 60) % 40) + f" Rare{i}") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "Ünseen WORDS\x0bx1"), (None, "x1 x2"), (5, rows[5][1])]
    df = spark.createDataFrame([(*x, 1.5) for x in rows], "doc_id long, text string, score double")
    return rows, hmm.score(df, Scratch(spark, "test-hmm"), states=4, rounds=3).collect()


def test_base_scores(scored):
    rows, got = scored
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(t for i, text in rows if not held(i) for t in tokens(text))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(rows)
    texts = {}
    for i, text in rows:
        texts[i] = text
    for r in got:
        k = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(k), sum(c[t] > 0 for t in k), n)
        assert abs(r.base_score - sum(math.log10((c[t] + 1) / (n + v + 1)) for t in k)) < 1e-6
        assert math.isfinite(r.score) and r.score < 0


def test_the_model_beats_the_base(scored):
    held = [r for r in scored[1] if r.held_out and r.n_tokens > 10]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert hmm.score(df.limit(0), Scratch(spark, "test-hmm")).count() == 0
    only_held = spark.createDataFrame([(i, "a b") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert all(r.train_tokens == 0 and r.base_score == 0 for r in hmm.score(only_held, Scratch(spark, "test-hmm")).collect())


def plain_counts(seqs, start, move, emit):
    """Expected counts of whole texts by logarithms of all sums."""
    first, moves, emits, total = np.zeros(len(start)), np.zeros_like(move), np.zeros_like(emit), 0.0
    for s in seqs:
        fore, back = np.zeros((len(s), len(start))), np.zeros((len(s), len(start)))
        fore[0] = np.log(start * emit[s[0]])
        for t in range(1, len(s)):
            fore[t] = np.logaddexp.reduce(fore[t - 1][:, None] + np.log(move), axis=0) + np.log(emit[s[t]])
        for t in range(len(s) - 2, -1, -1):
            back[t] = np.logaddexp.reduce(np.log(move) + np.log(emit[s[t + 1]]) + back[t + 1], axis=1)
        all_ = np.logaddexp.reduce(fore[-1])
        total += all_
        first += np.exp(fore[0] + back[0] - all_)
        for t in range(len(s)):
            emits[s[t]] += np.exp(fore[t] + back[t] - all_)
            if t:
                moves += np.exp(fore[t - 1][:, None] + np.log(move) + np.log(emit[s[t]]) + back[t] - all_)
    return [first, moves, emits], total


@pytest.mark.parametrize("block", [1, 7, 512, 5000])
def test_whole_texts_are_counted(block):
    """Texts of up to 2,000 tokens, wherever the blocks end."""
    start, move, emit = parameters(3, 6, 4)
    r = np.random.default_rng(5)
    seqs = [r.integers(0, 6, n) for n in (2000, 1, 512, 513, 30, 1024)]
    want, total = plain_counts(seqs, start, move, emit)
    sums = [np.zeros(3), np.zeros((3, 3)), np.zeros((6, 3))]
    assert abs(hmm.expect(seqs, start, move, emit, sums, block) - total) < 1e-6
    assert all(np.allclose(a, b, rtol=1e-8, atol=1e-8) for a, b in zip(sums, want, strict=True))


def test_emissions_are_taken_once_a_batch():
    """The steps of a batch work on one table of emissions: none looks its symbols up again, forwards or backwards."""

    class Counted(np.ndarray):
        looked_up = 0

        def __getitem__(self, key):
            if isinstance(key, np.ndarray):
                Counted.looked_up += 1
            return np.asarray(self)[key]

    r = np.random.default_rng(5)
    seqs = [r.integers(0, 20, n).astype("<u2") for n in (1, 7, 30, 30, 2)]
    start, move, emit = r.dirichlet(np.ones(3)), r.dirichlet(np.ones(3), 3), r.dirichlet(np.ones(20), 3).T.copy()
    plain, counted = ([np.zeros(3), np.zeros((3, 3)), np.zeros((20, 3))] for _ in range(2))
    want = hmm.expect(seqs, start, move, emit, plain)
    got = hmm.expect(seqs, start, move, emit.view(Counted), counted)
    assert Counted.looked_up == 1 and got == want and all(np.allclose(a, b) for a, b in zip(plain, counted, strict=True))
    assert np.isclose(want, hmm.forward(seqs, start, move, emit).sum()) and np.isclose(plain[2].sum(), sum(map(len, seqs)))
