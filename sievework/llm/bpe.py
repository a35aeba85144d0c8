"""Byte-pair encoding by a tokenization automaton, and decoding.

The automaton reads tokens: its language is the set of correct tokenizations.
It starts as one state with an arc for every byte, and each merge (u, v) -> w
is worked in as a gadget, in the order of the merges: the state that u leads to
loses its arc v, and every state that can read u and then v gets an arc w to
where v led. All arcs of one token lead to one state, so a state is named by
the token read last; the state of w begins as a copy of v's. Copies are kept as
a reference to the parent and the time of the copy, and a cell of the
transition table is computed from these when it is first used, since the whole
table has a cell for each pair of tokens.

Every prefix of a correct tokenization is correct, so one pass over a word
finds, for each end, the only last token that the state before it has an arc for.
The tokens that end at a place come from a search automaton over the vocabulary.
"""

from __future__ import annotations

import hashlib
import json
from functools import partial
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sievework.llm.shared import chunks, pieces
from sievework.shipping import ship

#: The pre-tokenizer's pattern, a fixed value of the vocabulary's format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words in a worker's newer table from which on it becomes the older one, and cells of the transition table, which starts anew when full.
KEPT_WORDS, KEPT_CELLS = 150_000, 500_000
#: Between words, a character that no byte stands for; and the state at a word's begin.
APART, BEGIN = "\u0100", -2
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte in the vocabulary file: printable ones stand for themselves, the others follow from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out = {b: chr(b) for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + n)
    return out


class Automaton:
    """Word to ids (little-endian, unsigned, 32 bits). Words met lately are kept, in two tables of which the older is dropped when the newer is full."""

    def __init__(self, raw: str):
        model = json.loads(raw)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.to_char = byte_alphabet()
        to_byte = {c: b for b, c in self.to_char.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.ids = {}  # reachable tokens: their bytes to ids
        self.emit = {i: t.encode() for t, i in self.special.items()}
        for t, i in vocab.items():
            if t not in self.special:
                self.emit[i] = bytes(to_byte[c] for c in t)
        self.born, self.left, self.right, self.merge = {}, {}, {}, {}
        for c in self.to_char.values():
            if c in vocab:
                self.born[vocab[c]] = -1
                self.ids[self.emit[vocab[c]]] = vocab[c]
        self.cells: dict[int, bool] = {}  # of the transition table, state << 20 | token: whether there is an arc
        for k, (u, v) in enumerate(merges):
            u, v, w = vocab[u], vocab[v], vocab[u + v]
            if u in self.born and v in self.born and w not in self.born and self._arc(u, v, k):
                self.merge[u, v] = k
                self.born[w], self.left[w], self.right[w] = k, u, v
                self.ids[self.emit[w]] = w
        tree = ahocorasick.Automaton()
        for raw, token in self.ids.items():
            tree.add_word(raw.decode("latin-1"), (token, len(raw)))
        tree.make_automaton()
        self.find = tree.iter  # every token at every end, the longest first
        self.sizes = {token: len(raw) for raw, token in self.ids.items()}
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.split = regex.compile(SPLIT).findall
        self.apart = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _arc(self, state: int, token: int, time: int) -> bool:
        """Whether ``state`` has an arc for ``token`` before merge number ``time`` is worked in."""
        born, right, merge = self.born, self.right, self.merge
        got = born[token]
        if got >= time:
            return False
        now, until = state, time
        while True:
            removed = merge.get((now, token))
            if removed is not None and max(got, born[now]) < removed < until:
                return False
            if born[now] < got or born[now] == -1:
                break
            now, until = right[now], born[now]
        if got == -1:
            return True
        u, v = self.left[token], right[token]
        if now == u == v and until > got:
            return False  # this state lost the arc in the same gadget
        return self._arc(now, u, got)

    def __getitem__(self, word: str) -> bytes:
        self.learn([word])
        return self.words[word]

    def learn(self, words) -> None:
        """Encode those of ``words`` that aren't kept, all in one walk over their bytes.

        For each end in turn, the tokens that end there are tried on the state that the prefix before the token leads to;
        ``last`` has, for each prefix, its only last token, or BEGIN where a word begins.
        """
        kept, before = self.words, self.before
        fresh = []
        for word in words:
            if word not in kept:
                if (ids := before.get(word)) is None:
                    fresh.append(word)
                else:
                    kept[word] = ids
        if not fresh:
            return
        raws = [w.encode().decode("latin-1") for w in fresh]
        joined, at, begins = APART.join(raws), 0, []
        last = [-1] * (len(joined) + 1)
        for r in raws:
            begins.append(at)
            last[at] = BEGIN
            at += len(r) + 1
        cells, arc = self.cells, self._arc
        for end, (token, size) in self.find(joined):
            end += 1
            if last[end] >= 0:
                continue
            state = last[end - size]
            if state != BEGIN:
                cell = state << 20 | token
                ok = cells.get(cell)
                if ok is None:
                    if len(cells) >= KEPT_CELLS:
                        cells.clear()
                    ok = cells[cell] = arc(state, token, 1 << 40)
                if not ok:
                    continue
            last[end] = token
        sizes = self.sizes
        for word, raw, begin in zip(fresh, raws, begins, strict=True):
            out, end = [], begin + len(raw)
            while end > begin:
                token = last[end]
                out.append(token)
                end -= sizes[token]
            kept[word] = pack(f"<{len(out)}I", *out[::-1])

    def _settle(self) -> None:
        """Words not asked for since the table was last full go."""
        if len(self.words) >= KEPT_WORDS:
            self.before, self.words = self.words, {}

    def encode(self, text: str) -> bytes:
        """Ids of a text, four bytes each; strings of added tokens become those tokens."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a word that several texts of a range hold is looked at once."""
        return [ids for i, j in chunks(texts) for ids in self._encode_some(texts[i:j])]

    def _encode_some(self, texts: list[str]) -> list[bytes]:
        parts = [self._parts(t) for t in texts]
        self._settle()
        self.learn({w for words in parts for w in words if w.__class__ is str})
        ids = self.words
        return [b"".join([w if w.__class__ is bytes else ids[w] for w in words]) for words in parts]

    def _special_in(self, text: str) -> bool:
        return any(t in text for t in self.special)

    def _parts(self, text: str) -> list:
        """The words of a text, in order; for an added token its id, as bytes."""
        if not self._special_in(text):
            return self.split(text)
        out, at = [], 0
        for m in self.apart.finditer(text):
            out += [*self.split(text[at : m.start()]), pack("<I", self.special[m[0]])]
            at = m.end()
        return out + self.split(text[at:])

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, one after the other."""
        return b"".join(map(self.emit.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def automaton(raw: str) -> Automaton:
    """One automaton a task: workers outlive a query, and its tables, of 130 MB when full, would lie in them through whatever they run next."""
    return Automaton(raw)


def _read(tokenizer: str) -> str:
    with open(tokenizer, encoding="utf-8") as f:
        return f.read()


def _encode(batches, raw, text_col, decoded):
    a = automaton(raw.value)
    for b in pieces(batches):
        ids = a.encode_all([t or "" for t in b.column(text_col).to_pylist()])
        out = b.append_column("token_ids", pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())))
        yield out.append_column("decoded", pa.array([a.decode(x) for x in ids], pa.string())) if decoded else out


def encode(docs: DataFrame, tokenizer: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """Add ``token_ids`` (array of int), and ``decoded`` if asked for, to the rows of ``docs``.

    ``tokenizer`` is the path of a byte-level BPE vocabulary on the driver; its size does not grow with
    the data, so it is broadcast. A null or empty text has no ids and decodes to an empty text; repeated rows stay;
    other columns pass through, save that columns of the two names above are replaced. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    made = ["token_ids", "decoded"] if decoded else ["token_ids"]
    docs = docs.drop(*made)
    raw = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    types = {"token_ids": "array<int>", "decoded": "string"}
    schema = docs.schema
    for c in made:
        from pyspark.sql.types import _parse_datatype_string

        schema = type(schema)(list(schema.fields)).add(c, _parse_datatype_string(types[c]))
    return docs.mapInArrow(partial(_encode, raw=raw, text_col=text_col, decoded=decoded), schema)


def _digest(batches, raw):
    a, sha = automaton(raw.value), lambda x: hashlib.sha256(x).hexdigest()
    for b in pieces(batches):
        n, digests, back = [], [], []
        for ids in a.encode_all([t or "" for t in b.column("text").to_pylist()]):
            n.append(len(ids) // 4)
            digests.append(sha(ids))
            back.append(sha(a.decode(ids).encode()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, a row a document.

    Null and empty texts have no tokens; repeated rows give repeated results; other columns are ignored. A very long text
    takes time in proportion; its words are Python objects at a time. An empty table gives an empty result.
    """
    ship(docs.sparkSession)
    raw = docs.sparkSession.sparkContext.broadcast(_read(tokenizer))
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(partial(_digest, raw=raw), SCHEMA)
