"""Personal data: four plain patterns, and a semi-Markov conditional random field that adds what they miss.

A pattern takes the longest run it can and is dropped if that run fails its test, so two numbers side by side
hide each other. The field scores whole candidate segments instead: features of the segment as one piece (its
form, its check digit, how its groups are laid out, what stands at either end), and a dynamic programme over
segments of bounded length chooses boundaries and kinds together. Text without a digit or an at sign can only
be outside of every entity, so the programme runs on the stretches of tokens that have one; the result is that
of a run over the whole text.
"""

from __future__ import annotations

import hashlib
import random
import re
from array import array
from functools import cache, cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.shipping import ship

KINDS = ["email", "ip", "card", "phone"]
#: The contract's patterns; fixed values.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches in linear time: a match of numbers begins with a whole run of digits, and an address is read from its
#: at sign both ways, so no run is gone over again from each of its characters.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
STRETCH = re.compile(r"[0-9@]\S*(?:\s\S*[0-9@]\S*)*")
#: The same where an address may be spelled out: with the word before such an at sign.
SPELLED = re.compile(r"(?:[0-9@]|[A-Za-z0-9._%+-]{1,64} ?[(\[] ?at ?[)\]] ?)\S*(?: ?[(\[] ?(?:at|dot) ?[)\]] ?\S+| \S+ ?[(\[] ?dot ?[)\]] ?\S+|\s\S*[0-9@]\S*)*")
#: What a candidate segment may look like: the plain patterns' matches, and spaced, bracketed, spelled out or broken forms.
FORMS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+(?:@| ?[(\[] ?at ?[)\]] ?)[A-Za-z0-9-]+(?:(?:\.| ?[(\[] ?dot ?[)\]] ?)[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]+){3}"),
    "card": re.compile(r"[0-9](?:[ ./-]{0,3}[0-9])+"),
    "phone": re.compile(r"(?:\+|00)?[ ]?\(?[0-9][ ().0-9/-]+[0-9]"),
}
UNIT = re.compile(r"[0-9]+|[^\W\d_]+|\s|.", re.S)
#: Units in an entity at most.
BOUND = 32
#: Labelled stretches that the weights are fitted on, made by rule; and passes over them.
EXAMPLES, PASSES = 900, 8
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _passes(kind: str, s: str) -> bool:
    if kind == "ip":
        s = re.sub(r"[ \[\]()]", "", s)
        return all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    if kind == "phone":
        return 8 <= len(_digits(s)) <= 15
    return True


def _emails(text: str):
    """(start, end) of the addresses: what stands before an at sign, back to the last address, and the host after it."""
    low = 0
    for m in HOST.finditer(text):
        start = m.start()
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            low = m.end()
            yield start, low


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain patterns: leftmost, not overlapping, failing matches dropped."""
    out = [(0, a, b) for a, b in _emails(text)]
    for k, pattern in ((1, IP), (2, PATTERNS["card"]), (3, PATTERNS["phone"])):
        out += [(k, m.start(), m.end()) for m in pattern.finditer(text) if _passes(KINDS[k], m[0])]
    return out


def _segment(kind: int, s: str, before: str, after: str) -> list[str] | None:
    """Features of ``s`` as one entity of a kind; None if it can't be one."""
    if not FORMS[KINDS[kind]].fullmatch(s):
        return None
    f = ["any"] if PATTERNS[KINDS[kind]].fullmatch(s) else ["other form"]
    word = lambda c: c.isalnum() or c == "_"
    if word(before) or before in "+.-@%=" and before:
        f.append("joined before")
    if word(after) or after in "@%=" and after:
        f.append("joined after")
    if kind == 0:
        top = s.rpartition(".")[2]
        f.append("letters at the top" if top.isalpha() and len(top) > 1 else "odd top")
        f += ["odd edge"] * (s[0] in ".%+-" or s[-1] == "-" or ".." in s) + ["spelled out"] * ("@" not in s)
    elif kind == 1:
        f += ["parts in range" if _passes("ip", s) else "parts too large"]
        f += ["leading zero"] * any(len(p) > 1 and p[0] == "0" for p in s.split("."))
    else:
        d, groups = _digits(s), re.split("[^0-9]+", s.strip("+"))
        seps = set(re.findall("[^0-9+]+", s))
        if kind == 2:
            if not 13 <= len(d) <= 19:
                return None
            f += ["check digit" if luhn(d) else "no check digit", f"{len(d)} digits" if len(d) >= 16 else "few digits"]
            f += ["one group"] * (len(groups) == 1) + ["fours"] * (len(groups) > 1 and all(len(g) == 4 for g in groups)) + ["uneven groups"] * (len(groups) > 1 and any(len(g) != 4 for g in groups))
            f += ["mixed marks"] * (len(seps) > 1) + ["issuer"] * (d[0] in "3456")
        else:
            if not 7 <= len(d) <= 16:
                return None
            f += ["plain length" if 10 <= len(d) <= 13 else "odd length"]
            if s[0] != "+":
                # without a plus its groups have to look like those of a number that is dialled
                sizes = [len(g) for g in re.split("[^0-9]+", s) if g]
                dialled = sizes in ([3, 3, 4], [1, 3, 3, 4]) or s[0] in "(0" and 2 <= len(sizes) <= 5 and 2 <= sizes[0] <= 5
                date = re.fullmatch(r"(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ][0-9]{1,2}.*|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}.*", s)
                f += ["dialled without a plus" if dialled else "undialled without a plus"] + ["date"] * bool(date) + [f"{len(seps)} marks without a plus"] + ["thousands"] * (len(sizes) > 2 and all(x == 3 for x in sizes[1:]))
            f += ["brackets"] * bool(re.search(r"\([0-9]+\)", s)) + ["loose bracket"] * (s.count("(") != s.count(")")) + ["dots"] * ("." in s)
            f += ["fours last"] * (len(groups[-1]) == 4) + ["long group"] * any(len(g) > 8 for g in groups) + ["short last"] * (len(groups[-1]) < 3) + [f"{min(len(groups), 6)} groups"]
            f += ["out of range"] * (not 8 <= len(d) <= 15)
    return [f"{KINDS[kind]}: {x}" for x in f]


def _outside(unit: str) -> list[str]:
    if unit[0].isdigit() and unit.isascii():
        return [f"out: {min(len(unit), 9)} digits"]
    return ["out: at" if unit == "@" else "out: plus" if unit == "+" else "out: other"]


class Lattice:
    """The candidate segments of one stretch: (from unit, to unit, label, features); label 0 is outside."""

    def __init__(self, text: str, start: int, end: int):
        self.text, self.at = text, array("q", [*(m.start() for m in UNIT.finditer(text, start, end)), end])

    def leaving(self, i: int):
        """(to unit, label, features) of the segments that begin at a unit."""
        text, at = self.text, self.at
        yield i + 1, 0, _outside(text[at[i] : at[i + 1]])
        first = text[at[i]]
        if not (first in "+(" or first.isascii() and first.isalnum() or first in "._%-"):
            return
        before, digits = text[at[i] - 1] if at[i] else "", 0
        for j in range(i + 1, min(len(at) - 1, i + BOUND) + 1):
            last = text[at[j] - 1]
            if last.isspace() and last != " ":
                return
            s = text[at[i] : at[j]]
            digits += sum(c.isdigit() for c in text[at[j - 1] : min(at[j], at[j - 1] + 20)])
            if not (last.isascii() and (last.isalnum() or last == "-")):
                continue
            after = text[at[j]] if at[j] < len(text) else ""
            at_sign = "@" in s or "at)" in s or "at]" in s
            if at_sign:
                kinds = [0]
            elif first.isdigit():
                kinds = [1] * (s.count(".") == 3) + [2] * (digits > 12) + [3] * (digits > 7)
            else:
                kinds = [3] * (first in "+(")
            if digits > 19 and not at_sign:
                return
            for k in kinds:
                if (f := _segment(k, s, before, after)) is not None:
                    yield j, k + 1, f

    @cached_property
    def arcs(self) -> list[list[tuple[int, int, list[str]]]]:
        """All segments by the unit that they end before, for the sums over all segmentations."""
        into: list[list[tuple[int, int, list[str]]]] = [[] for _ in self.at]
        for i in range(len(self.at) - 1):
            for j, y, f in self.leaving(i):
                into[j].append((i, y, f))
        return into

    def best(self, weights: dict[str, float], turns: np.ndarray) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation's entities, by the bounded dynamic programme.

        Scores are kept for as many units as a segment may have; of each unit and label only the way back stays.
        """
        n, labels, ring = len(self.at), len(KINDS) + 1, BOUND + 1
        score = np.full((ring, labels), -np.inf)
        score[0, 0] = 0
        length, came_from = bytearray(n * labels), bytearray(n * labels)
        for i in range(n - 1):
            here = score[i % ring]
            for j, y, f in self.leaving(i):
                came = here + turns[:, y]
                p = int(came.argmax())
                if (s := came[p] + sum(weights.get(x, 0.0) for x in f)) > score[j % ring, y]:
                    score[j % ring, y] = s
                    length[j * labels + y], came_from[j * labels + y] = j - i, p
            here[:] = -np.inf
        out, j, y = [], n - 1, int(score[(n - 1) % ring].argmax())
        while j:
            i, p = j - length[j * labels + y], came_from[j * labels + y]
            if y:
                out.append((y - 1, self.at[i], self.at[j]))
            j, y = i, p
        return out[::-1]


def _add(a: np.ndarray) -> float:
    top = a.max()
    return top + np.log(np.exp(a - top).sum()) if np.isfinite(top) else -np.inf


def _gradient(lattice: Lattice, truth: set, weights: dict, turns: np.ndarray, rate: float) -> None:
    """One step up the log likelihood of a stretch's true segmentation, by the forward and backward sums over all segmentations."""
    n, labels = len(lattice.arcs), len(KINDS) + 1
    ahead, behind = np.full((n, labels), -np.inf), np.full((n, labels), -np.inf)
    ahead[0, 0], behind[-1] = 0, 0
    scored = [[(i, y, f, sum(weights.get(x, 0.0) for x in f)) for i, y, f in arcs] for arcs in lattice.arcs]
    for j in range(1, n):
        for i, y, _, s in scored[j]:
            ahead[j, y] = np.logaddexp(ahead[j, y], _add(ahead[i] + turns[:, y]) + s)
    for j in range(n - 1, 0, -1):
        for i, y, _, s in scored[j]:
            behind[i] = np.logaddexp(behind[i], turns[:, y] + s + behind[j, y])
    total, last = _add(ahead[-1]), 0
    expected = np.zeros_like(turns)
    for j in range(1, n):
        for i, y, f, s in scored[j]:
            each = np.exp(ahead[i] + turns[:, y] + s + behind[j, y] - total)
            expected[:, y] += each
            at = (y - 1, lattice.at[i], lattice.at[j])
            true = at in truth if y else not any(a < at[2] and at[1] < b for _, a, b in truth)
            if true:
                expected[last, y] -= 1
                last = y
            if step := rate * (true - each.sum()):
                for x in f:
                    weights[x] = weights.get(x, 0.0) + step
    turns -= rate * expected


def examples(count: int = EXAMPLES, seed: int = 20) -> list[tuple[str, set]]:
    """Labelled stretches: entities alone and side by side, and things that look like them."""
    r = random.Random(seed)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda a, b: "".join(r.choice("abcdefghilmnoprst") for _ in range(r.randint(a, b)))

    def card():
        body = r.choice("3456") + num(14)
        d = next(body + c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", " ", "-", "."])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c = num(3), num(3), num(4)
        if r.random() < 0.3:
            return r.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{num(2)}/{num(7)}", f"0049 {num(2)} {num(7)}", f"0{num(3)} {num(6)}", f"1-{a}-{b}-{c}"])
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}-{a}-{b}-{c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"+{r.randint(1, 99)} {a} {num(7)}"])

    def email():
        if r.random() < 0.2:
            at, dot = r.choice([("(at)", "(dot)"), ("[at]", "[dot]"), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
            return f"{letters(3, 8)}{r.choice(['', '.' + letters(3, 6)])}{at}{letters(3, 8)}{dot}{r.choice(['com', 'org', 'de'])}"
        return f"{letters(3, 8)}{r.choice(['', '.', '_', '-'])}{r.choice([letters(2, 6), num(2)])}@{letters(3, 8)}{r.choice(['', num(1)])}.{r.choice(['', 'example.'])}{r.choice(['com', 'org', 'net', 'de', 'fr'])}"

    def ip():
        return r.choice([".", ".", ".", ".", "[.]", "(.)"]).join(str(r.randint(0, 255)) for _ in range(4))

    def other():
        d = num(16)
        return r.choice([num(r.randint(1, 7)), d if not luhn(d) else d + "x7", f"{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", f"20{num(2)}-0{r.randint(1, 9)}-1{num(1)}", f"{r.randint(300, 999)}.{num(2)}.{num(2)}.{num(3)}", f"password={letters(1, 3)}{num(4)}{letters(2, 4)}{num(5)}", f"@{letters(3, 8)}", num(12), f"{num(3)}-{num(4)}", f"{r.randint(1, 999)} {num(3)} {num(3)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.20{num(2)}", f"20{num(2)}-{num(2)}-{num(2)} {num(2)}:{num(2)}", f"978-{num(1)}-{num(2)}-{num(6)}-{num(1)}", f"{num(4)} {num(5)}", f"{num(2)}.{num(3)}.{num(3)}", f"19{num(2)}-19{num(2)}", f"{num(6)}-{num(6)}"])

    make = [email, ip, card, phone, other]
    out = []
    for _ in range(count):
        text, truth = "", set()
        for _ in range(r.choice([1, 1, 1, 2, 2, 3, 4])):
            y = r.choice([0, 1, 2, 3, 4])
            piece = make[y]()
            text += " " * bool(text)
            if y < 4:
                truth.add((y, len(text), len(text) + len(piece)))
            text += piece
        out.append((text + r.choice(["", "", ".", ","]), truth))
    return out


@cache
def train(rate: float = 0.3) -> tuple[dict[str, float], np.ndarray]:
    """Weights of features and of label pairs, fitted to the labelled stretches by stochastic gradient ascent."""
    weights: dict[str, float] = {}
    turns = np.zeros((len(KINDS) + 1,) * 2)
    data = [(Lattice(t, 0, len(t)), truth) for t, truth in examples()]
    for k in range(PASSES):
        for lattice, truth in data:
            _gradient(lattice, truth, weights, turns, rate / (1 + k))
    return weights, turns


def spans(text: str, model: tuple[dict, np.ndarray]) -> tuple[list, list]:
    """The plain patterns' spans, and those that the field adds: outside of every plain span, or a part of one of its kind."""
    base = base_spans(text)
    added = []
    spelled = any(x in text for x in ("at)", "at]", "at )", "at ]"))
    low = 0
    for m in (SPELLED if spelled else STRETCH).finditer(text):
        start = m.start()
        while start > low and not text[start - 1].isspace():
            start -= 1
        low = m.end()
        for k, a, b in Lattice(text, start, m.end()).best(*model):
            if _passes(KINDS[k], text[a:b]) and not any(a < y and x < b and not (k == q and x <= a and b <= y and b - a < y - x) for q, x, y in base):
                added.append((k, a, b))
    return base, added


def _show(found: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(found))


def _find(batches, model):
    for b in batches:
        rows = []
        for t in b.column("text").to_pylist():
            base, added = spans(t or "", model.value)
            rows.append([*(sum(k == x for x, _, _ in base) for k in range(4)), hashlib.sha256(_show(base).encode()).hexdigest(), _show(base + added), len(added), len(base) + len(added)])
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, the number of plain spans of each kind, their digest, all spans, the number added and that of all, a row a document.

    Offsets count code points; ends are exclusive. Time and memory grow in proportion to a text's length, whatever it is
    made of. A null or empty text has no spans (an empty string); repeated
    rows give repeated results; other columns are ignored; an empty table gives an empty result.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(train())
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(partial(_find, model=model), SCHEMA)
