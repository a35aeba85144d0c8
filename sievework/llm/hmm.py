"""A hidden Markov language model, trained by Baum-Welch over all texts and scored by the exact forward recursion.

Latent states emit symbols. A token that makes up at least COMMON of the training tokens is a symbol of its own (there
are 1 / COMMON of these at most); any other, seen or not, falls into one of CLASSES by its ending, its class is the
symbol, and the token then has its own share of the class: an absolutely discounted relative frequency, with the
discounts' sum left to tokens that training has not seen. So the parameters that are broadcast have a proven
bound, while the counts of all the other tokens stay distributed and are joined to the texts that hold them.

A text's probability is the product of its symbols' (the forward recursion, over the whole text, ends included)
and of its tokens' shares.
"""

from __future__ import annotations

import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Scratch, chunks

STATES, ROUNDS = 10, 4
COMMON = 2e-5  # of the training tokens: a symbol of its own
KNOWN = 2e-7  # its count is broadcast: 1 / KNOWN entries of 18 bytes at most
CLASSES = 1024
ANCHORS = 128
#: Symbols of a text that one row of a batch goes through; texts count whole all the same.
BLOCK = 2048
BATCH_TOKENS = 600_000
#: Distinct tokens that a task counts before it hands them on.
HELD = 400_000


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, seed=42)


def _class(token: bytes) -> int:
    return zlib.crc32(token[-3:]) % CLASSES


def _tokens(text: str | None) -> list[bytes]:
    """Words of the lower-cased text (A-Z only, as bytes fold no others), split at ASCII white space."""
    return (text or "").encode().lower().split()


def _count(batches):
    def out():
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array(np.fromiter(map(_hash, keys), np.uint64, len(keys)).astype(np.int64)), pa.array(np.fromiter(map(_class, keys), np.int16, len(keys))), pa.array(np.fromiter(held.values(), np.int64, len(keys)))], names=["h", "cls", "n"])

    held: Counter = Counter()
    for b in batches:
        for t in b.column(0).to_pylist():
            held.update(_tokens(t))
            if len(held) > HELD:
                yield out()
                held.clear()
    if held:
        yield out()


class Lexicon:
    """What tasks need of the training counts: symbols of common tokens, counts of known ones, figures of classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, types: int, texts: int, classes: np.ndarray, discount: float):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.total, self.types, self.texts = total, types, texts
        common = np.flatnonzero(self.counts >= max(2.0, COMMON * total))
        self.symbol = np.full(len(self.hashes), -1, np.int32)
        self.symbol[common] = np.arange(1, len(common) + 1)  # 0 is the end of a text
        self.first_class = len(common) + 1
        self.symbols = self.first_class + CLASSES
        self.class_n, self.class_types, self.discount = classes[:, 0], classes[:, 1], discount
        self.top = common[np.argsort(-self.counts[common], kind="stable")[:ANCHORS]]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.total + self.types + 1))

    def share(self, counts: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """log10 of a token's share of its class; of all unseen tokens' together, at count 0."""
        n = np.maximum(self.class_n[cls], 1)
        rest = np.where(self.class_n[cls] > 0, self.discount * self.class_types[cls] / n, 1.0)
        return np.log10(np.where(counts > 0, (counts - self.discount) / n, rest))


def lexicon(docs: DataFrame, scratch: Scratch) -> tuple[Lexicon, DataFrame]:
    """Count the training texts' tokens; the second result has the counts that stay distributed (h, c)."""
    learn = docs.filter("not held_out")
    counts = learn.select("text").mapInArrow(_count, "h long, cls short, n long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("n").alias("n"))
    counts = scratch.keep(counts, "counts")
    texts = learn.count()
    words, types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = words + texts
    known = counts.filter(F.col("n") >= max(2.0, KNOWN * total)).toArrow()
    rare = counts.filter(F.col("n") < max(2.0, COMMON * total))
    by_class = rare.groupBy("cls").agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)).collect()
    classes = np.zeros((CLASSES, 2))
    for r in by_class:
        classes[r[0]] = r[1], r[2]
    n1, n2 = (sum(r[i] for r in by_class) for i in (3, 4))
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2))) if n1 else 0.5
    lex = Lexicon(known.column("h").to_numpy().astype(np.uint64), known.column("n").to_numpy().astype(np.int64), total, types + bool(texts), texts, classes, discount)
    return lex, counts.filter(F.col("n") < max(2.0, KNOWN * total)).select("h", F.col("n").alias("c"))


def _encode(batches, lex):
    """Symbols of each text; sums over the tokens whose counts are at hand; hashes of the others."""
    lex = lex.value
    end_base = float(lex.base(np.array([lex.texts]))[0])
    for b in batches:
        texts = b.column("text").to_pylist()
        cols = {"n_tokens": [], "n_known": [], "base": [], "share": [], "symbols": [], "h": [], "k": [], "cls": []}
        for i, j in chunks(texts if None not in texts else [t or "" for t in texts]):
            words = [_tokens(t) for t in texts[i:j]]
            ids: dict[bytes, int] = {}
            flat = [ids.setdefault(w, len(ids)) for ws in words for w in ws]
            flat = np.array(flat, np.int32)
            keys = list(ids)
            h = np.fromiter(map(_hash, keys), np.uint64, len(keys))
            cls = np.fromiter(map(_class, keys), np.int32, len(keys))
            at = lex.find(h)
            c = np.where(at >= 0, lex.counts[at] if len(lex.counts) else 0, 0)
            own = np.where(at >= 0, lex.symbol[at] if len(lex.counts) else -1, -1)
            symbol = np.where(own >= 0, own, lex.first_class + cls)
            base, share = np.where(at >= 0, lex.base(c), 0), np.where((at >= 0) & (own < 0), lex.share(np.maximum(c, 1), cls), 0)
            bounds = np.cumsum([0] + [len(w) for w in words])
            sums = [np.concatenate([[0], np.cumsum(x[flat])]) for x in (base, share)]
            sure = np.concatenate([[0], np.cumsum((at >= 0)[flat])])
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                f = flat[a:z]
                away, k = np.unique(f[at[f] < 0], return_counts=True)
                cols["n_tokens"].append(z - a + 1)
                cols["n_known"].append(int(sure[z] - sure[a]) + (lex.texts > 0))
                cols["base"].append(float(sums[0][z] - sums[0][a]) + end_base)
                cols["share"].append(float(sums[1][z] - sums[1][a]))
                cols["symbols"].append(np.append(symbol[f], 0).astype("<u4" if lex.symbols > 65535 else "<u2").tobytes())
                cols["h"].append(h[away].astype(np.int64))
                cols["k"].append(k.astype(np.int32))
                cols["cls"].append(cls[away].astype(np.int16))
        kinds = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base": pa.float64(), "share": pa.float64(), "symbols": pa.binary(), "h": pa.list_(pa.int64()), "k": pa.list_(pa.int32()), "cls": pa.list_(pa.int16())}
        yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), b.column("held_out"), *(pa.array(cols[c], t) for c, t in kinds.items())], names=["uid", "doc_id", "held_out", *kinds])


ENCODED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, symbols binary, h array<long>, k array<int>, cls array<short>"


def _sequences(batches, wide):
    for b in batches:
        yield [np.frombuffer(x, "<u4" if wide else "<u2") for x in b.column("symbols").to_pylist()], b


def _pairs(batches, anchors, wide):
    """How many texts hold both of two anchor symbols."""
    total = np.zeros((len(anchors),) * 2)
    place = np.full(1 << (32 if wide else 16) if not wide else int(anchors.max()) + 2, -1, np.int64)
    place[anchors] = np.arange(len(anchors))
    for seqs, _ in _sequences(batches, wide):
        held = np.zeros((len(seqs), len(anchors)), np.float32)
        for i, s in enumerate(seqs):
            at = place[s[s < len(place)]]
            held[i, at[at >= 0]] = 1
        total += held.T @ held
    i, j = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "n"])


def begin(together: np.ndarray, anchors: np.ndarray, unigram: np.ndarray, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameters to start from: anchors that occur in the same texts fall into clusters, and a state prefers the symbols of its own."""
    emit = np.tile(unigram[:, None], (1, states)) * (1 + 0.01 * np.cos(np.outer(np.arange(len(unigram)), np.arange(1, states + 1))))
    if len(anchors) > 1:
        d = np.sqrt(np.maximum(np.diag(together), 1))
        near = together / np.outer(d, d)
        values, vectors = np.linalg.eigh(near - near.mean())
        points = vectors[:, -min(states, len(anchors)) :] * np.sqrt(np.maximum(values[-min(states, len(anchors)) :], 0))
        points /= np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-9)
        centre = [0]
        while len(centre) < min(states, len(points)):
            centre.append(int(((points[:, None] - points[centre]) ** 2).sum(2).min(1).argmax()))
        means = points[centre]
        for _ in range(20):
            own = ((points[:, None] - means) ** 2).sum(2).argmin(1)
            means = np.stack([points[own == k].mean(0) if (own == k).any() else means[k] for k in range(len(means))])
        for k in range(len(means)):
            emit[anchors[own == k], k] *= 6
            emit[anchors[own != k], k] *= 0.3
    emit /= emit.sum(0)
    move = np.full((states, states), 0.15 / states) + 0.85 * np.eye(states)
    return np.full(states, 1 / states), move, emit


def _steps(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequences laid end to end, the longest first: all symbols, where each sequence begins, how many reach each step, the order."""
    lengths = np.array([len(s) for s in seqs])
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    reach = np.searchsorted(-lengths, -np.arange(lengths[0] if len(lengths) else 0), "left")
    return np.concatenate([seqs[i] for i in order]), np.cumsum(lengths) - lengths, reach, order


def forward(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """ln p of each sequence by the scaled forward recursion, exact over its whole length."""
    flat, at, reach, order = _steps(seqs)
    out = np.zeros(len(seqs))
    for t, n in enumerate(reach):
        a = emit[flat[at[:n] + t]] * (a[:n] @ move if t else start)
        c = a.sum(1)
        a /= c[:, None]
        out[:n] += np.log(c)
    back = np.empty_like(out)
    back[order] = out
    return back


def _entries(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, block: int) -> tuple[list, list, list]:
    """Pieces of at most ``block`` symbols, and what the rest of its text says to each: the state before it (null at a text's start),
    and the weights of the state at its end, which are all 1 at a text's end.

    A piece's effect on the state is a matrix: its steps from each single state, made for all pieces at once. The matrices of a
    text are applied one after the other, forwards and backwards; so no count stops at a piece's end, and a long text
    takes as many steps as a piece, not as it has symbols. Texts of one piece cost nothing here.
    """
    cut = [[s[i : i + block] for i in range(0, len(s), block)] for s in seqs]
    long_ = [c for c in cut if len(c) > 1]
    ones, ahead, behind = np.ones(len(start)), {}, {}
    if long_:
        heads = np.stack([c[0] for c in long_])  # all of ``block`` symbols; the first is met without a move
        state = start * emit[heads[:, 0]]
        for t in range(1, block):
            state = (state / state.sum(1)[:, None]) @ move * emit[heads[:, t]]
        inner = [p for c in long_ for p in c[1:]]
        flat, at, reach, order = _steps(inner)
        effect = np.repeat(np.eye(len(start))[None], len(inner), 0)
        for t, n in enumerate(reach):
            effect[:n] = (effect[:n] @ move) * emit[flat[at[:n] + t]][:, None, :]
            effect[:n] /= effect[:n].sum((1, 2))[:, None, None]
        place = np.empty(len(inner), np.int64)
        place[order] = np.arange(len(inner))
        k = 0
        for c, a in zip(long_, state, strict=True):
            of = [effect[place[k + i]] for i in range(len(c) - 1)]
            k += len(of)
            entered, left = [], [ones]
            for m in of:
                entered.append(a / a.sum())
                a = entered[-1] @ m
            for m in of[::-1]:
                w = m @ left[-1]
                left.append(w / w.sum())
            ahead[id(c)], behind[id(c)] = [None, *entered], left[::-1]
    return [p for c in cut for p in c], [x for c in cut for x in ahead.get(id(c), [None])], [x for c in cut for x in behind.get(id(c), [ones])]


def expect(seqs: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray, sums: list[np.ndarray], block: int = BLOCK) -> float:
    """Baum-Welch: add the expected counts of first states, transitions and emissions to ``sums``; returns ln p of all.

    Sequences count whole. Long ones go through their steps in pieces side by side, each from the state that the pieces before it
    lead to and under the weights of those behind it (see ``_entries``). Of the pieces about ``BATCH_TOKENS`` symbols are
    held at a time, however long a text is.
    """
    pieces, before, after = _entries(seqs, start, move, emit, block)
    out, low, size = 0.0, 0, 0
    for i, p in enumerate(pieces):
        size += len(p)
        if size > BATCH_TOKENS or i == len(pieces) - 1:
            out += _gather(pieces[low : i + 1], before[low : i + 1], after[low : i + 1], start, move, emit, sums)
            low, size = i + 1, 0
    return out


def _gather(pieces: list[np.ndarray], before: list, after: list, start: np.ndarray, move: np.ndarray, emit: np.ndarray, sums: list[np.ndarray]) -> float:
    """Forward and backward through pieces of texts; adds to ``sums``.

    Rows lie step by step, each step's pieces in one stretch: emissions are taken once, and each step works in place.
    """
    flat, at, reach, order = _steps(pieces)
    first = np.array([before[i] is None for i in order])
    enter = np.array([start if before[i] is None else before[i] for i in order], emit.dtype)
    leave = np.array([after[i] for i in order], emit.dtype)
    ends = np.cumsum(reach)
    begins = ends - reach
    step = np.repeat(np.arange(len(reach)), reach)
    piece = np.arange(len(step)) - begins[step]
    symbols = flat[at[piece] + step]
    seen = emit[symbols]
    ahead, scale, spans = np.empty_like(seen), np.empty((len(seen), 1), seen.dtype), list(zip(begins.tolist(), ends.tolist(), strict=True))
    for t, (i, j) in enumerate(spans):
        a = ahead[i:j]
        if t:
            np.matmul(ahead[(o := spans[t - 1][0]) : o + j - i], move, out=a)
            a *= seen[i:j]
        else:
            np.multiply(seen[i:j], np.where(first[:, None], enter, enter @ move), out=a)
        c = scale[i:j]
        np.sum(a, axis=1, keepdims=True, out=c)
        a /= c
    out = float(np.log(scale, dtype=np.float64).sum())
    seen /= scale
    back, m, moved = np.empty_like(seen), 0, np.ascontiguousarray(move.T)
    for i, j in reversed(spans):
        b = back[i:j]
        if m:
            np.matmul(seen[j : j + m], moved, out=b[:m])
        if m < j - i:  # pieces that end here
            b[m:] = leave[m : j - i] / (ahead[i + m : j] * leave[m : j - i]).sum(1)[:, None]
        seen[i:j] *= b
        m = j - i
    later = seen.astype(np.float64)
    n = len(pieces)
    sums[1] += ahead[begins[step[n:] - 1] + piece[n:]].T.astype(np.float64) @ later[n:] * move
    sums[1] += enter[~first].T.astype(np.float64) @ later[:n][~first] * move  # from one piece into the next
    ahead *= back
    sums[0] += ahead[:n][first].sum(0)
    for k in range(len(start)):
        sums[2][:, k] += np.bincount(symbols, ahead[:, k], len(emit))
    return out


def _expect(batches, model, wide):
    start, move, emit = model.value
    sums = [np.zeros_like(start, np.float64), np.zeros_like(move, np.float64), np.zeros_like(emit, np.float64)]
    out = 0.0
    held, size = [], 0
    for seqs, _ in _sequences(batches, wide):
        for q in seqs:
            held.append(q)
            size += len(q)
            if size > BATCH_TOKENS:
                out += expect(held, start, move, emit, sums)
                held, size = [], 0
    if held:
        out += expect(held, start, move, emit, sums)
    some = np.flatnonzero(sums[2].sum(1))
    ids = np.concatenate([some, -1 - np.arange(len(move)), [-1 - len(move), -2 - len(move)]]).astype(np.int32)
    rows = np.concatenate([sums[2][some], sums[1], [sums[0]], [np.full(len(start), out)]])
    yield pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(rows[:, k]) for k in range(len(start)))], names=["id", *(f"k{k}" for k in range(len(start)))])


def train(encoded: DataFrame, lex: Lexicon, states: int = STATES, rounds: int = ROUNDS) -> tuple[tuple, list[float]]:
    """Start, transition and emission probabilities, and ln p of the training texts before each round.

    Every round reads all training texts; each task adds up its own expected counts, Spark adds those up by symbol.
    """
    sc, wide = encoded.sparkSession.sparkContext, lex.symbols > 65535
    learn = encoded.filter("not held_out").select("symbols")
    unigram = np.full(lex.symbols, 0.1)
    unigram[0] += lex.texts
    common = lex.symbol > 0
    unigram[lex.symbol[common]] += lex.counts[common]
    unigram[lex.first_class :] += lex.class_n
    unigram /= unigram.sum()
    anchors = lex.symbol[lex.top].astype(np.int64)
    together = np.zeros((len(anchors),) * 2)
    if len(anchors) > 1:
        for i, j, n in learn.mapInArrow(partial(_pairs, anchors=anchors, wide=wide), "i int, j int, n double").groupBy("i", "j").agg(F.sum("n")).collect():
            together[i, j] = n
    model, course = begin(together, anchors, unigram, states), []
    schema = "id int, " + ", ".join(f"k{k} double" for k in range(states))
    for _ in range(rounds if lex.texts else 0):
        sent = sc.broadcast(tuple(x.astype(np.float32) for x in model))
        got = learn.mapInArrow(partial(_expect, model=sent, wide=wide), schema).groupBy("id").agg(*(F.sum(f"k{k}").alias(f"k{k}") for k in range(states))).toArrow()
        ids = got.column("id").to_numpy()
        rows = np.column_stack([got.column(f"k{k}").to_numpy() for k in range(states)])
        emit = 0.5 * unigram[:, None] * np.ones(states)
        np.add.at(emit, ids[ids >= 0], rows[ids >= 0])
        move, start = np.full((states, states), 0.1), np.full(states, 0.1)
        for i, r in zip(ids, rows, strict=True):
            if -states <= i < 0:
                move[-1 - i] += r
            elif i == -1 - states:
                start += r
            elif i == -2 - states:
                course.append(float(r[0]))
        model = start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)
        sent.destroy()
    return model, course


def _score(batches, model, wide):
    model = model.value
    for b in batches:
        seqs = [np.frombuffer(x, "<u4" if wide else "<u2") for x in b.column("symbols").to_pylist()]
        total = forward(seqs, *model) / np.log(10) if seqs else np.empty(0)
        yield b.drop_columns(["symbols"]).append_column("chain", pa.array(total))


def score(docs: DataFrame, scratch: Scratch, states: int = STATES, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs`` (doc_id, text).

    The model learns from the rows whose crc32(doc_id as text) mod 7 isn't 2 (a null doc_id learns too). A null text is
    empty: one token, its end. Repeated rows are scored each. Other columns are ignored. An empty table, or one without
    training rows, is scored with no counts.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False)))
    sc = docs.sparkSession.sparkContext
    lex, away = lexicon(docs, scratch)
    sent = sc.broadcast(lex)
    encoded = scratch.keep(docs.withColumn("uid", F.monotonically_increasing_id()).mapInArrow(partial(_encode, lex=sent), ENCODED), "encoded")
    model, _ = train(encoded, lex, states, rounds)
    final = sc.broadcast(tuple(x.astype(np.float64) for x in model))
    scored = encoded.select("uid", "doc_id", "held_out", "n_tokens", "n_known", "base", "share", "symbols")
    schema = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, share double, chain double"
    scored = scored.mapInArrow(partial(_score, model=final, wide=lex.symbols > 65535), schema)
    # the tokens whose counts were not at hand
    pairs = encoded.select("uid", F.explode(F.arrays_zip("h", "k", "cls")).alias("x")).select("uid", "x.h", "x.k", "x.cls")
    c = F.coalesce("c", F.lit(0))
    figures = docs.sparkSession.createDataFrame([(i, float(n), float(v)) for i, (n, v) in enumerate(zip(lex.class_n, lex.class_types, strict=True))], "cls short, class_n double, class_types double")
    joined = pairs.join(away, "h", "left").join(F.broadcast(figures), "cls")
    share = F.when(F.col("c") > 0, (c - lex.discount) / F.col("class_n")).when(F.col("class_n") > 0, lex.discount * F.col("class_types") / F.col("class_n")).otherwise(1.0)
    more = joined.groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("k")).otherwise(0)).alias("k2"),
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(float(lex.total + lex.types + 1)))).alias("base2"),
        F.sum(F.col("k") * F.log10(share)).alias("share2"),
    )
    zero = F.lit(0.0)
    return scored.join(more, "uid", "left").select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("k2", F.lit(0))).cast("long").alias("n_known"),
        F.lit(lex.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", zero)).alias("base_score"),
        (F.col("chain") + F.col("share") + F.coalesce("share2", zero)).alias("score"),
    )
