"""The main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is read by a tolerant scanner into its leaf blocks, the runs of text between block-level tags, each with its
ancestors. The field scores the chain of blocks, main text or not, by features of the ancestors' tags and names and
of the text, and Viterbi decoding picks the best chain. It is fitted on labelled pages that are made by rule, in the
shapes that sites commonly have.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from functools import cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sievework.shipping import ship
from sievework.sources.files import short_references

#: Tags that begin and end a block; fixed values of the HTML standard's flow content.
BLOCK = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is never text of the page.
RAW = "script style noscript template iframe object svg math textarea canvas audio video".split()
#: Of these, only those that reach the page's end if no end tag follows.
TO_END = set("script style noscript template iframe textarea".split())
#: A start tag of these that ends in a slash, outside an attribute's bare value, is an empty element.
FOREIGN, SLASH = {"svg", "math"}, re.compile(r"""(?:^|["'\s]|(?:^|\s)[^\s="']+)/$""")
#: A start tag of the key ends an open element of these, as end tags may be left out.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TAG, PLAIN, COMMENT = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)"), re.compile(r"[^>\"']*+"), re.compile(r"<!--(?:>|.*?(?:-->|\Z))", re.S)
RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|aria-label|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Words in names of elements, by what they tell; fixed values.
NAMES = {
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc skip tabs toolbar",
    "foot": "footer foot copyright colophon bottom legal imprint",
    "head": "header head masthead banner topbar top logo branding hero",
    "side": "sidebar side aside widget widgets rail related recommended recommendations more popular trending complementary",
    "ad": "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion promoted",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup subscription paywall disclaimer",
    "share": "share sharing social follow tags tag byline author meta date",
    "comment": "comment comments reply replies respond discussion disqus responses",
    "form": "form search login contactform searchform searchbox",
    "main": "article post content entry story main text body articlebody maincontent prose page",
}
GROUP = {w: g for g, ws in NAMES.items() for w in ws.split()}
STRONG = {"nav": "menu", "menu": "menu", "footer": "foot", "header": "head", "aside": "side", "form": "form", "article": "main", "main": "main", "button": "form", "select": "form", "fieldset": "form", "dialog": "notice", "head": "title", "search": "form"}
#: Labelled pages, passes over them.
PAGES, PASSES = 400, 8
SCHEMA = "page_id long, url string, text string, n_chars long"


class Element(NamedTuple):
    """An open element, and what it and its ancestors tell: groups of names, the nearest of them, whether main is among them."""

    tag: str
    groups: frozenset[str]
    nearest: str
    main: bool


#: Where no element is open.
NOWHERE = Element("none", frozenset(), "", False)


def _names(attributes: str) -> list[str]:
    out = []
    for key, a, b, c in ATTRIBUTE.findall(attributes):
        value, key = (a or b or c).lower(), key.lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            out.append("hidden")
        elif key != "aria-label":
            out += [GROUP[w] for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", a or b or c).lower()) if w in GROUP]
            joined = re.sub("[^a-z]", "", value)
            out += [GROUP[joined]] if joined in GROUP else []
    return list(dict.fromkeys(out))


def _tag_end(page: str, at: int, lost: set[int]) -> int:
    """Where the tag whose attributes begin at ``at`` ends: at the first > outside of quotes, or else the first; -1 without one.

    ``lost`` gathers the opening quotes that a search came through in vain; one that meets them again stops, so that
    all searches of a page together take linear time.
    """
    k, path = at, []
    while (k := PLAIN.match(page, k).end()) < len(page) and k not in lost:
        if page[k] == ">":
            return k
        path.append(k)
        if (close := page.find(page[k], k + 1)) < 0:
            break
        k = close + 1
    lost.update(path)
    return page.find(">", at)


def blocks(page: str) -> list[tuple[str, list[str]]]:
    """The leaf blocks of a page, in order: text with references decoded and white space joined, and features."""
    found: list[tuple[str, list[str]]] = []
    stack: list[Element] = []
    count: Counter[str] = Counter()  # open elements by tag
    unclosed: set[str] = set()  # tags without an end tag from here on
    pieces: list[str] = []
    linked = chars = 0
    links = 0  # open anchors

    def end() -> None:
        nonlocal linked, chars
        if pieces:
            text = " ".join(entities.unescape(short_references("".join(pieces))).split())
            if text:
                found.append((text, _features(text, stack[-1] if stack else NOWHERE, linked / max(1, chars))))
            pieces.clear()
        linked = chars = 0

    def add(text: str) -> None:
        nonlocal linked, chars
        if text:
            pieces.append(text)
            n = len(text)
            chars += n
            linked += n * (links > 0)

    at, n, last, lost = 0, len(page), page.rfind(">"), set()
    while at < n:
        open_at = page.find("<", at)
        if open_at < 0:
            add(page[at:])
            break
        m = TAG.match(page, open_at)
        if not m:
            rest = COMMENT.match(page, open_at)
            mark = page[open_at + 1 : open_at + 3]
            if not rest and not (mark[:1] in ("!", "?") and (open_at < last or mark[1:].isascii() and mark[1:].isalpha())):
                add(page[at : open_at + 1])
                at = open_at + 1
                continue
            add(page[at:open_at])
            at = rest.end() if rest else page.find(">", open_at) + 1 or n
            continue
        add(page[at:open_at])
        close = _tag_end(page, m.end(), lost) if open_at < last else -1
        if close < 0:
            break
        at, name, attributes = close + 1, m[2].lower(), page[m.end() : close]
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCK:
                end()
            while count[name]:
                count[stack[-1].tag] -= 1
                if stack.pop().tag == name:
                    break
            if name == "p":
                pieces.append(" ")
            continue
        if name in RAW_END:
            if name in FOREIGN and SLASH.search(attributes):
                continue
            closing = None if name in unclosed else RAW_END[name].search(page, at)
            if not closing:
                unclosed.add(name)
            at = closing.end() if closing else n if name in TO_END else at
            continue
        if name == "br":
            add(" ")
        if name in BLOCK:
            end()
            links = 0
            while stack and stack[-1].tag == "p":
                count[stack.pop().tag] -= 1
            if stack and stack[-1].tag in CLOSES.get(name, ()):
                count[stack.pop().tag] -= 1
            if name == "body":
                stack.clear()
                count.clear()
        elif name == "a":
            links += 1
        if name not in VOID and name in BLOCK:
            stack.append(_inside(stack[-1] if stack else NOWHERE, name, _names(attributes) if attributes.strip() else []))
            count[name] += 1
    end()
    return found


def _inside(outer: Element, tag: str, names: list[str]) -> Element:
    """An element within another: the features of all its ancestors follow from the next one's, so depth costs nothing."""
    groups, nearest, main = outer.groups, outer.nearest, outer.main
    for g in [*([STRONG[tag]] if tag in STRONG else []), *names]:
        nearest = "head of main" if g == "head" and main else g
        groups, main = groups | {nearest}, main or g == "main"
    return Element(tag, groups, nearest, main)


def _features(text: str, at: Element, linked: float) -> list[str]:
    nearest = at.nearest
    f = ["any", *(f"in {g}" for g in sorted(at.groups))]
    words = text.count(" ") + 1
    f += [f"tag {at.tag}", f"nearest {nearest or 'none'}", f"links {min(3, int(linked * 3.99))}", f"words {min(6, words.bit_length())}"]
    f += ["sentence" if text[-1] in ".!?…:;\"'”»)" else "no sentence end"]
    if "©" in text or "all rights reserved" in text.lower():
        f.append("copyright")
    if nearest not in ("", "main", "head of main"):
        f.append("inside something else")
    elif at.main:
        f.append("plainly in main")
    return f


def examples(count: int = PAGES, seed: int = 8) -> list[tuple[str, set[str]]]:
    """Labelled pages made by rule, and the set of their main blocks' texts."""
    r = random.Random(seed)

    def words(a: int, b: int) -> str:
        return " ".join("".join(r.choice("abcdefghiklmnoprstuvz") for _ in range(r.randint(2, 9))) for _ in range(r.randint(a, b)))

    def sentence(a: int = 4, b: int = 40) -> str:
        return words(a, b).capitalize() + r.choice([".", ".", ".", "?", "!"])

    out = []
    for _ in range(count):
        main: set[str] = set()

        def text(s: str, keep: bool, main=main) -> str:
            if keep:
                main.add(s)
            return s

        def items(n: int, keep: bool = False, link: bool = True) -> str:
            return "".join(f"<li><a href='/{words(1, 1)}'>{words(1, 3)}</a></li>" if link else f"<li>{text(sentence(2, 12), keep)}</li>" for _ in range(n))

        menu = r.choice(["<nav><ul>{}</ul></nav>", "<div class='menu'><ul>{}</ul></div>", "<div id='navbar'><ul>{}</ul></div>", "<ul class='main-nav'>{}</ul>", "<header><nav>{}</nav></header>"]).format(items(r.randint(2, 8)))
        head = r.choice(["", f"<header><h2>{words(1, 4)}</h2><p>{sentence(2, 9)}</p></header>", f"<div class='site-header'><p>{sentence(2, 9)}</p></div>"])
        ad = lambda: r.choice(["", "<div class='ad'>{}</div>", "<div class='sponsored'><p>{}</p></div>", "<aside class='promo'>{}</aside>", "<div id='ads-top'><p>{}</p></div>"]).format(sentence(2, 25))
        notice = r.choice(["", "<div class='cookie-notice'><p>{}</p><button>OK</button></div>", "<div id='gdpr'>{}</div>", "<div class='newsletter'><p>{}</p></div>", "<dialog>{}</dialog>"]).format(sentence(3, 30))
        body = []
        if r.random() < 0.85:
            title = f"<h1>{text(words(2, 9).capitalize() + r.choice(['', '.']), True)}</h1>"
            body.append(r.choice(["{}", "{}", "<header>{}</header>"]).format(title))
        for _ in range(r.randint(1, 12)):
            kind = r.random()
            if kind < 0.62:
                body.append(r.choice(["<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<div>{}</div>"]).format(text(sentence(1, 90), True)))
            elif kind < 0.7:
                body.append(f"<h{r.choice('23')}>{text(words(1, 6), True)}</h2>")
            elif kind < 0.77:
                body.append(f"<ul>{items(r.randint(1, 5), True, False)}</ul>")
            elif kind < 0.83:
                body.append(f"<blockquote><p>{text(sentence(4, 30), True)}</p></blockquote>")
            elif kind < 0.87:
                body.append(f"<table><tr><td>{text(words(1, 4), True)}</td><td>{text(words(1, 4), True)}</td></tr></table>")
            elif kind < 0.9:
                body.append(f"<pre>{text(words(3, 12), True)}</pre>")
            elif kind < 0.94:
                body.append(ad())
            elif kind < 0.97:
                body.append(f"<div class='share'><a href='#'>{words(1, 2)}</a></div>")
            else:
                body.append(f"<aside><p>{sentence(3, 20)}</p></aside>")
        inner = "".join(body)
        if r.random() < 0.15:
            inner += f"<footer><p>{sentence(2, 10)}</p></footer>"
        if r.random() < 0.15:
            inner += f"<section class='comments'><h3>{words(1, 2)}</h3><p>{sentence(3, 30)}</p></section>"
        article = r.choice(["<article>{}</article>", "<article>{}</article>", "<main><article>{}</article></main>", "<main>{}</main>", "<div class='content'>{}</div>", "<div id='post-body' class='entry'>{}</div>", "<div class='article-text'>{}</div>", "<section class='story'>{}</section>"]).format(inner)
        side = r.choice(["", "<aside><ul>{}</ul></aside>", "<div class='sidebar'><ul>{}</ul><p>" + sentence(2, 20) + "</p></div>", "<section class='related'><ul>{}</ul></section>"]).format(items(3))
        comments = r.choice(["", "", "<div id='comments'>{}</div>", "<ol class='comment-list'>{}</ol>", "<section class='comments'>{}</section>"]).format("".join(r.choice(["<div class='comment'><p>{}</p></div>", "<li class='reply'><p>{}</p></li>"]).format(sentence(2, 40)) for _ in range(r.randint(1, 5))))
        form = r.choice(["", "<form><label>{}</label><input><button>{}</button></form>", "<form class='search'><p>{}</p><select><option>{}</option></select></form>"]).format(sentence(2, 8), words(1, 2))
        foot = r.choice(["<footer>{}</footer>", "<footer><p>{}</p></footer>", "<div class='footer'><p>{}</p></div>", "<div id='site-footer'><ul>" + items(2) + "</ul>{}</div>"]).format(r.choice(["&copy; ", "", "© 20 "]) + sentence(2, 12))
        middle = [article, ad(), form] if r.random() < 0.5 else [article, form]
        if r.random() < 0.3:
            r.shuffle(middle)
        page = f"<html><head><title>{words(1, 8)}</title><style>p{{}}</style></head><body>{notice if r.random() < 0.5 else ''}{menu}{head}{ad()}{''.join(middle)}{comments}{side}{foot}{notice}</body></html>"
        out.append((page, main))
    return out


class Chain:
    """A two-label conditional random field: weights of features for main text against other, and of label pairs."""

    def __init__(self):
        self.weight: dict[str, float] = {}
        self.turn = np.zeros((2, 2))

    def _scores(self, feats: list[list[str]]) -> np.ndarray:
        get = self.weight.get
        return np.array([sum([get(x, 0.0) for x in f]) for f in feats])

    def viterbi(self, feats: list[list[str]]) -> list[bool]:
        (a, b), (c, d) = self.turn.tolist()
        off, on, back = 0.0, 0.0, []
        for i, s in enumerate(self._scores(feats).tolist()):
            if i:
                to_off, to_on = (off + a >= on + c), (off + b >= on + d)
                off, on = (off + a if to_off else on + c), (off + b if to_on else on + d) + s
                back.append((to_off, to_on))
            else:
                on = s
        y = on > off
        out = [y]
        for to_off, to_on in reversed(back):
            y = not (to_on if y else to_off)
            out.append(y)
        return out[::-1]

    def step(self, feats: list[list[str]], truth: list[bool], rate: float) -> None:
        """One step up the log likelihood of a page's labels."""
        s = self._scores(feats)
        n = len(s)
        node = np.stack([np.zeros(n), s], 1)
        ahead, behind = node.copy(), np.zeros((n, 2))
        for i in range(1, n):
            ahead[i] += np.logaddexp(ahead[i - 1][0] + self.turn[0], ahead[i - 1][1] + self.turn[1])
        for i in range(n - 2, -1, -1):
            x = node[i + 1] + behind[i + 1]
            behind[i] = np.logaddexp(self.turn[:, 0] + x[0], self.turn[:, 1] + x[1])
        total = np.logaddexp(*ahead[-1])
        on = np.exp(ahead[:, 1] + behind[:, 1] - total)
        expected = np.zeros((2, 2))
        for i in range(1, n):
            expected += np.exp(ahead[i - 1][:, None] + self.turn + (node[i] + behind[i])[None] - total)
        for a, b in zip(truth[:-1], truth[1:], strict=True):
            expected[int(a), int(b)] -= 1
        self.turn -= rate * (expected + 0.001 * self.turn)
        for f, y, p in zip(feats, truth, on, strict=True):
            g = rate * (y - p)
            if abs(g) > 1e-6:
                for x in f:
                    self.weight[x] = self.weight.get(x, 0.0) + g


@cache
def train() -> Chain:
    """The field fitted to the labelled pages, once a process."""
    chain = Chain()
    data = []
    for page, main in examples():
        found = blocks(page)
        data.append(([f for _, f in found], [t in main for t, _ in found]))
    for k in range(PASSES):
        for feats, truth in data:
            if feats:
                chain.step(feats, truth, 0.2 / (1 + k))
    return chain


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    if not found:
        return ""
    return "\n\n".join(t for (t, _), on in zip(found, chain.viterbi([f for _, f in found]), strict=True) if on)


def _extract(batches, chain):
    for b in batches:
        texts = [main_text(p or "", chain.value) for p in b.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    A null or empty html has an empty text; a null url stays null; repeated rows give repeated results; other columns
    are ignored; an empty table gives an empty result. Nothing is dropped for its length, and time grows in proportion to it,
    however deep elements lie and whatever is left open.
    """
    ship(pages.sparkSession)
    chain = pages.sparkSession.sparkContext.broadcast(train())
    return pages.selectExpr("cast(page_id as long) page_id", "url", "html").mapInArrow(partial(_extract, chain=chain), SCHEMA)
