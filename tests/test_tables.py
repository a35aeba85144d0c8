"""Tables of measures, categories, constraint statistics and reports."""

import pytest
from pyspark.sql import functions as F

from sievework.operators import arrays, flatzinc, selection, taxonomy


def test_metric_tables(spark):
    make = lambda rows, cols: spark.createDataFrame(rows, cols)
    one = make([("p", "a", 1.0), ("p", "b", None), (None, "c", 3.0)], "provider string, model string, Top1TotalScore double")
    three = make([("p", "a", "2"), ("q", "d", "x")], "provider string, model string, LLM_TotalScore string")
    gap = make([("p", "b", 0.5), ("p", "a", -0.5)], "provider string, model string, ClosedGap double")
    rows = selection.metric_table(one, three, gap, provider=True, fill=0, sort_by="Single Score").collect()
    assert [r.model for r in rows][:2] == ["c (None)", "a (p)"] and {(r.model, r.single_score, r.parallel_score, r.closed_gap) for r in rows} == {("c (None)", 3.0, 0.0, None), ("a (p)", 1.0, 2.0, -0.5), ("b (p)", 0.0, 0.0, 0.5), ("d (q)", 0.0, 0.0, None)}
    assert [r.model for r in selection.metric_table(gap=gap, sort_by="ClosedGap", ascending=True).collect()] == ["a", "b"]
    assert [(r.model, r.single_score) for r in selection.metric_table(make([("m (x)", 1.0)], "model_variant string, SingleScore double")).collect()] == [("m (x)", 1.0)]
    assert selection.metric_table() is None
    assert selection.metric_table(one, on=["model"]).columns == ["model", "single_score", "parallel_score", "closed_gap"]
    for bad in ({"single": three}, {"gap": gap.drop("model")}):
        with pytest.raises(KeyError):
            selection.metric_table(**bad)
    texts = make([("3", 1), ("x", 2), (" 1e2 ", None), (None, 4)], "t string, n int")
    assert selection.metric_max(texts, "t").first().value == 100 and selection.metric_max(texts, "n").first().value == 4
    assert selection.metric_max(texts, "none").first().value is None and selection.metric_max(texts.limit(0), "t").first().value is None
    assert selection.complete(texts, ["t", "none"]).count() == 3 and selection.complete(texts, ["none"]).count() == 4


def test_categories_and_reports(spark):
    found = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("b", "x"), ("c", "Uncategorized")], "name string, category string")
    assert {tuple(r) for r in taxonomy.category_report(found).collect()} == {("x", 2, 1), ("y", 1, 1), ("Uncategorized", 1, 0)}
    rows = spark.createDataFrame([("f", 2, "bb", "2", "second"), ("f", 1, "a", "a long value", None)], "file string, n int, name string, value string, text string")
    got = arrays.aligned(rows, "file", "n", ["name", "value"], [6, 4], "text").first().text
    assert got == "\\n".join(["NAME   VALUE TEXT", "=" * 40, "a      a long value ", "bb     2    second"])


def test_constraint_statistics(spark):
    text = """var 1..4: x; var 5..5: k; var int: y; array [1..2] of var int: xs = [x,y]; array [1..3] of var int: open; array [1..2] of int: c = [1,2];
constraint lin(c,xs,x); constraint lin(xs,[k,y],3); constraint all(open,x); constraint none(1,2); solve satisfy;"""
    m = flatzinc.parse(text)
    t = flatzinc.tables(spark.createDataFrame([("f", text)], "file string, text string")).cache()
    got = {r.type: (r.constraints, r.arity) for r in flatzinc.type_counts(t).collect()}
    want = {}
    for c in m.constraints:
        n, a = want.get(c["type"], (0, 0))
        want[c["type"]] = (n + 1, a + flatzinc.arity(m, c))
    assert got == {k: (n, a / n) for k, (n, a) in want.items()}
    categories = spark.createDataFrame([("g", "lin"), ("b", "lin"), ("b", "all")], "category string, member string")
    heads = {r.category: (r.types, r.constraints, r.arity) for r in flatzinc.type_headers(flatzinc.type_counts(t), categories).collect()}
    assert heads == {"b": (2, 3, (2 + 2 + 4) / 3), "Uncategorized": (1, 1, 0.0)}
    assert {r.name: r.degree for r in flatzinc.degree_table(t).collect()} == flatzinc.degrees(m) == {"x": 2, "k": 1, "y": 1}
    assert {r.name: (r.elements, r.low, r.high) for r in flatzinc.array_spans(t).collect()} == {"xs": (2, 1, 4), "open": (0, None, None)}
    assert t.filter("kind = 'constraint'").select(F.count_distinct("place")).first()[0] == 4
    t.unpersist()
