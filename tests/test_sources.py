"""Documents, tables and writers on small files."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.sources import documents, files, sinks
from sievework.streaming import snapshot

SUGGESTED = {
    "g": {
        "m": {"p": {"1": {"top3": ["a", "b"], "time_seconds": 1.5}, "2": {"top_3": "a; b,c", "time": "2"}, "3": {"top3": None, "suggested": ["z"]}, "4": "bad", "5": {"suggested": []}}, "odd": 3},
        "x": [1],
    },
    "y": None,
}


def test_suggestions_with_other_keys(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps(SUGGESTED, indent=1))
    (tmp_path / "a.txt").write_text("no")
    rows = {r.instance: r for r in documents.suggestions(documents.json_files(spark, str(tmp_path))).collect()}
    assert sorted(rows) == ["1", "2", "3", "4", "5"]
    assert rows["1"].top3 == ["a", "b"] and rows["1"].time_seconds == 1.5 and rows["1"].top1 == "a"
    assert rows["2"].top3 == ["a", "b", "c"] and rows["2"].time_seconds == 2
    assert rows["3"].top3 is None and rows["4"].top3 is None  # the first key that is there counts, though null
    assert rows["5"].top3 == [] and rows["5"].top1 is None
    with pytest.raises(Exception):
        documents.json_files(spark, str(tmp_path / "none")).count()


def test_results_and_merge(spark):
    doc = {"p": {"category": "MIN", "1": [{"Solver": "a", "Status": "S", "Time": "1.5", "Objective": "", "Score": "x"}, {"Solver": "b", "Objective": "7"}]}, "q": {"category": "", "2": []}}
    df = spark.createDataFrame([("f", json.dumps(doc))], "file string, text string")
    rows = {r.solver: r for r in documents.results(df).collect()}
    assert rows["a"].category == "MIN" and rows["a"].time == 1.5 and rows["a"].objective is None and rows["b"].objective == 7 and rows["b"].status is None
    other = documents.results(spark.createDataFrame([("g", json.dumps({"p": {"category": "MAX", "1": [{"Solver": "c"}]}}))], "file string, text string"))
    assert {r.solver: r.category for r in documents.merged(documents.results(df), other).collect()} == {"a": "MIN", "b": "MIN", "c": "MIN"}


def test_catalogues(spark):
    make = lambda x: spark.createDataFrame([("f", json.dumps(x))], "file string, text string")
    assert documents.catalogue(make({"p": {"description": "d", "top3_solvers": ["a"]}})).first().top3_solvers == ["a"]
    assert {r.key: r.value for r in documents.flat_map(make({"mapping": {"a": "1"}, "swaps": []})).collect()} == {"a": "1"}
    assert {r.key: r.value for r in documents.flat_map(make({"a": "1"})).collect()} == {"a": "1"}
    assert [(r.id, r.size) for r in documents.models(make({"data": [{"id": "m", "context_window": 5}, {"id": "n"}]})).collect()] == [("m", 5), ("n", None)]
    assert {r.model: r.rpm for r in documents.limits(make({"groq_models": [{"model_id": "m", "rpm": 3}], "gemini_models": [{"model": "n"}]})).collect()} == {"m": 3, "n": None}
    assert documents.categories(make({"categories": {"c": {"x": "t", "y": "u"}}})).count() == 2
    whole = {"categories": {"c": {"x": "", "y": "u"}, "b": {"x": "t"}}, "multi_category": {"x": {"categories": ["c", "d"], "description": "m"}}, "uncategorized": {"z": "w"}}
    got = {r.member: (r.categories, r.description, r.multi) for r in documents.memberships(documents.categories(make(whole))).collect()}
    assert got == {"x": (["c", "b", "d"], "t", True), "y": (["c"], "u", False), "z": (["Uncategorized"], "w", False)}
    got = spark.createDataFrame([("chat_Pdesc_T0p3.json",)], "f string").select(*(c.alias(n) for n, c in documents.variant_of(F.col("f")).items())).first()
    assert (got.variant, got.temperature) == ("chat_Pdesc", 0.3)


def test_html_tables(spark):
    row = "<tr>" + "".join(f"<td>{x}</td>" for x in "p i s S 1 2 3 4 5".split()) + "</tr>"
    again = "<tr><td></td><td> </td><td>t</td>" + "<td>0</td>" * 6 + "</tr>"
    html = f"<table><thead><tr><td>x</td></tr></thead><tbody>{row}{again}<tr><td>short</td></tr><tr><td>TOTAL</td>{'<td>9</td>' * 8}</tr></tbody></table>"
    pages = spark.createDataFrame([("u", html), ("n", None)], "url string, html string")
    assert [(r.problem, r.instance, r.solver) for r in files.result_tables(pages).orderBy("row").collect()] == [("p", "i", "s"), ("p", "i", "t")]
    d = spark.createDataFrame([("u", "<tbody><tr><td>f</td><td>one  &amp; two</td></tr></tbody>"), ("v", "<tbody><tr><td>f</td><td>x</td></tr></tbody>")], "url string, html string")
    assert [tuple(r) for r in files.definitions(d).collect()] == [("f", "one & two")]
    found = spark.createDataFrame([("a", '<a href="/x#1"></a><a href="/y">'), ("b", '<a href="/x">')], "url string, html string")
    assert sorted((r.link, r.url) for r in files.links(found, "/").collect()) == [("/x", "a"), ("/y", "a")]


def test_folders_and_short_copies(spark, tmp_path):
    for f, t in (("atsp/atsp.mzn", "m"), ("atsp/a.mzn", "n"), ("atsp/x_commented.mzn", "c"), ("is/model.mzn", "k"), ("is/1.dzn", "d")):
        (tmp_path / f).parent.mkdir(exist_ok=True)
        (tmp_path / f).write_text(t)
    found = files.model_files(spark, str(tmp_path))
    assert {(r.folder, r.file) for r in files.primary_models(found).collect()} == {("atsp", "atsp.mzn"), ("is", "model.mzn")}
    sub = tmp_path / "csv" / "deep"
    sub.mkdir(parents=True)
    (sub / "r.csv").write_text("name,v\nx,1.23456\n")
    out = sinks.short_copy(spark, str(tmp_path / "csv")).path
    assert sorted(r._c1 for r in spark.read.csv(out).collect()) == ["1.234", "v"]
    with pytest.raises(Exception):
        sinks.short_copy(spark, str(tmp_path / "csv"))
    assert files.csv(spark, str(tmp_path / "csv"), "name string, v double").first().v == 1.23456


def test_nested_json_comes_back(spark):
    rows = [("g", "m", "p", "1", ["a"], 1.0), ("g", "m", "p", "2", None, None), ("g", "n", 'q"', "1", [], 2.0)]
    df = spark.createDataFrame(rows, "provider string, model string, problem string, instance string, top3 array<string>, time_seconds double")
    text = sinks.nested(df).first().value
    assert json.loads(text)["g"]["n"]['q"']["1"]["time_seconds"] == 2.0
    back = documents.suggestions(spark.createDataFrame([("f", text)], "file string, text string"))
    assert sorted((r.model, r.instance, r.top3) for r in back.collect() if r.instance == "1") == [("m", "1", ["a"]), ("n", "1", [])]


def test_merges(spark):
    a, b = (spark.createDataFrame(x, "key string, value string") for x in ([("k", "1"), ("l", "2")], [("k", "3"), ("m", "4")]))
    assert {r.key: r.value for r in sinks.merge(a, b).collect()} == {"k": "1", "l": "2", "m": "4"}
    assert {r.key: r.value for r in sinks.merge(a, b, True).collect()}["k"] == "3"
    assert json.loads(sinks.sorted_map(sinks.merge(a, b)).first().value) == {"k": "1", "l": "2", "m": "4"}


def test_prompts_and_streams(spark, tmp_path):
    df = spark.createDataFrame([("m", "p", "1", "text")], "model string, problem string, instance string, prompt string")
    sinks.prompts(df, str(tmp_path / "j"))
    sinks.prompts(df, str(tmp_path / "t"), lines=False)
    assert spark.read.json(str(tmp_path / "j")).first().prompt == "text"
    assert [r.value for r in spark.read.text(str(tmp_path / "t")).collect()] == ["=== m / p / 1 ===", "text"]
    for k, (m, v, at) in enumerate([("a", 1, 1), ("b", 2, 1), ("a", 3, 2)]):
        spark.createDataFrame([(m, v, at)], "model string, v int, finished int").write.parquet(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema("model string, v int, finished int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in"))
    q = snapshot.snapshots(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.partition("=")[2]))
    assert {r.model: r.v for r in spark.read.parquet(str(last)).collect()} == {"a": 3, "b": 2}
    e = spark.createDataFrame([("2024-01-01 00:10:00", "x", 1.0), ("2024-01-01 00:50:00", "x", 2.0)], "ts string, event_type string, value double")
    assert [(r.n, r.value) for r in snapshot.event_windows(e).collect()] == [(2, 3.0)]


def test_plain_pages_need_no_parser(monkeypatch):
    """Pages of bare tags and text are cut at their tags, with the cells that the parser finds; others go through it."""
    plain = "<table><tbody><tr><td> a &lt; b</TD><td>&#83;<b>x </b>\n y<tr><td>open</tbody><tr><td>after</td>"
    others = [plain + "<td class=x>", "<!-- <tbody> -->" + plain, "<title><tbody></title>" + plain, plain + "1 < 2", plain.replace("<td>", "<td >")]
    fed, feed = [], files._Cells.feed
    monkeypatch.setattr(files._Cells, "feed", lambda self, x: (fed.append(x), feed(self, x)))
    for page in [plain, *others]:
        p = files._Cells()
        feed(p, page)
        p.close()
        assert files.cell_texts(page) == p.rows
    assert files.cell_texts(plain)[0] == ["a < b"]
    assert fed == others
