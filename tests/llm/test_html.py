"""Blocks, decoding against all chains, and main text of pages of several shapes."""

import itertools

import pytest

from sievework.llm import html


@pytest.fixture(scope="module")
def chain():
    return html.train()


def test_blocks():
    page = "<!-- <p>no</p> --><p>a &amp; b&nbsp;&lt;<b>c</b>\n d<br>e<p>f<script>var t='</p>';</script>g<ul><li>h<li>i</ul><style>x</style><p>j &am"
    assert [t for t, _ in html.blocks(page)] == ["a & b <c d e", "fg", "h", "i", "j &am"]
    assert html.blocks("") == [] and html.blocks("<") == [] or [t for t, _ in html.blocks("<")] == ["<"]
    assert [t for t, _ in html.blocks("1 < 2 <p title='a>b'>x</p><foot")] == ["1 < 2", "x"]
    assert [t for t, _ in html.blocks("<p>x<!-- open")] == ["x"] and [t for t, _ in html.blocks("<p>x<script>y")] == ["x"]


def test_viterbi_is_the_best_chain(chain):
    feats = [f for _, f in html.blocks("<nav>a</nav><h1>b</h1><p>c.</p><div class=ad>d</div><footer>e</footer>")]
    s = chain._scores(feats)
    value = lambda y: sum(s[i] * y[i] for i in range(len(y))) + sum(chain.turn[a, b] for a, b in zip(y[:-1], y[1:], strict=True))
    best = max(itertools.product((0, 1), repeat=len(feats)), key=value)
    assert [bool(x) for x in best] == chain.viterbi(feats)


def test_held_out_pages(chain):
    wrong = total = 0
    for page, main in html.examples(150, seed=77):
        found = html.blocks(page)
        for (t, _), on in zip(found, chain.viterbi([f for _, f in found]), strict=True):
            total, wrong = total + 1, wrong + (on != (t in main))
    assert wrong <= 0.01 * total


def test_main_text(chain):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href='/'>Menu</a></ul></nav><div class=ad>Buy</div><article><h1>Head</h1><p><b>One  two.<br><p>Three &copy;.</p></article><section class='comments'><p>Nice article.</p></section><form><p>Your name</p></form><footer>&copy; me</footer></body>"
    assert html.main_text(page, chain) == "Head\n\nOne two.\n\nThree ©."
    assert html.main_text("", chain) == ""


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>x y.</p></article>", 9), (2, None, None, 9), (2, None, None, 9), (3, "v", "<article>" + "<p>word word." * 20_000, 9)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert (got[1].text, got[1].n_chars) == ("x y.", 4) and (got[2].text, got[2].n_chars, got[2].url) == ("", 0, None)
    assert got[3].n_chars == 20_000 * 10 + 19_999 * 2 and html.extract(df).count() == 4 and html.extract(df.limit(0)).count() == 0


def test_elements_without_an_end_tag():
    texts = lambda page: [t for t, _ in html.blocks(page)]
    assert texts("<p>A</p><svg class=icon /><p>B</p>") == ["A", "B"] == texts("<p>A</p><svg/><p>B</p>") == texts("<p>A</p><math id='m'/><p>B</p>")
    assert texts("<p>A</p><object data=x><p>B</p>") == ["A", "B"] and texts("<p>A</p><svg/><p>B</p><svg><text>c</text></svg><p>D") == ["A", "B", "D"]
    assert texts("<p>A</p><svg class=a/><text>c</text></svg><p>B</p>") == ["A", "B"] and texts("<p>A</p><textarea>x<p>B") == ["A"]


def test_broken_pages_take_linear_time(chain):
    """Deep nesting, end tags of nothing, elements that never end, and quotes that never close."""
    import time

    began = time.process_time()
    deep = html.main_text("<article>" + "<div class='content'>word word.<section>" * 50_000, chain)
    assert deep.count("word word.") == 50_000
    for page in ("<div>" * 100_000 + "</section>" * 100_000, "<object>x" * 100_000, "<a '>'" * 50_000, "<a '>'\"<b \">" * 50_000, "<!1" * 100_000):
        html.main_text(page, chain)
    assert time.process_time() - began < 60
    assert [t for t, _ in html.blocks("<p title='a>b'>x</p><b c='>d</p><p>e")] == ["x", "d", "e"]


def test_references_of_any_length():
    page = f"<p>a&#{'9' * 5000};b&#x{'F' * 5000};c&#{'0' * 5000}65;d&#65;&#x42 e&amp;</p>"
    assert [t for t, _ in html.blocks(page)] == ["a\ufffdb\ufffdcAdAB e&"]
