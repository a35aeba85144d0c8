"""Scores and summaries on hand-made results."""

import pytest

from sievework.operators import selection as sel
from sievework.operators.scoring import restrict, score

RESULTS = [
    ("p", "MIN", "1", "a", "SC", 10.0), ("p", "MIN", "1", "b", "S", 20.0), ("p", "MIN", "1", "c", "S", 15.0), ("p", "MIN", "1", "d", "UNK", None), ("p", "MIN", "1", "e", "C", None), ("p", "MIN", "1", "f", "s", 10.0),
    ("q", "MAX", "1", "a", "S", 10.0), ("q", "MAX", "1", "b", "SC", 20.0), ("q", "MAX", "1", "c", "S", 20.0),
    ("r", "SAT", "2", "a", "S", None), ("r", "SAT", "2", "b", "ERR", None),
    ("t", "MIN", "3", "a", "S", 5.0), ("t", "MIN", "3", "b", "S", 5.0), ("t", "MIN", "3", "c", None, 5.0),
]


@pytest.fixture(scope="module")
def results(spark):
    return spark.createDataFrame(RESULTS, "problem string, category string, instance string, solver string, status string, objective double")


def scores(df):
    return {(r.problem, r.solver): r.score for r in df.collect()}


def test_scores_as_published(results):
    s = scores(score(results))
    assert s["p", "a"] == 1 and s["p", "d"] == 0 and s["p", "e"] is None
    assert s["p", "b"] == 0.25 and s["p", "c"] == 0.5 and s["p", "f"] == 0.75
    assert s["q", "a"] == 0.75 and s["q", "b"] == 1 and s["q", "c"] == 0.25  # MAX is turned round
    assert s["r", "a"] == 1 and s["r", "b"] == 0
    assert s["t", "a"] is None and s["t", "c"] is None


def test_scores_as_in_the_text(results):
    s = scores(score(results, "paper"))
    assert s["q", "a"] == 0.25 and s["q", "c"] == 0.75 and s["p", "e"] == 1 and s["t", "a"] == 0.75
    with pytest.raises(ValueError):
        score(results, "other")


def test_restrict_trims_and_passes_through(spark, results):
    df = spark.createDataFrame([(" a ",), ("b",)], "solver string")
    assert [r.solver for r in restrict(df, ["a"]).collect()] == ["a"]
    assert restrict(df, []).count() == 2 and restrict(df, [" "]).count() == 2 and restrict(df, ["a"], "none").count() == 2


@pytest.fixture(scope="module")
def llm(spark):
    rows = [("g", "m", "p", "1", ["b", " a"]), ("g", "m", "q", "1", []), ("g", "m", "r", "2", None), ("g", "m", "t", "3", ["zzz"]), ("g", "n", "r", "2", ["a", "b"])]
    return spark.createDataFrame(rows, "provider string, model string, problem string, instance string, top3 array<string>")


def test_best_of_three(results, llm):
    got = {r.model: r for r in sel.top3_summary(llm, score(results)).collect()}
    assert (got["m"].total, got["m"].covered) == (1.0, 2)  # labels 1 and 3: equal labels of two problems are one
    assert (got["n"].total, got["n"].covered, got["n"].average) == (1.0, 1, 1.0)


def test_first_choice_averages_over_matches_only(results, llm):
    got = {r.model: r for r in sel.top1_summary(sel.top1(llm, score(results))).collect()}
    assert (got["m"].total, got["m"].average, got["m"].covered) == (0.25, 0.25, 2)


def test_subset_takes_instances_away(results, llm):
    got = {r.model: r.covered for r in sel.top3_summary(llm, score(restrict(results, ["a"])), ["a"]).collect()}
    assert got == {"m": 1, "n": 1}


def test_gap_and_table(results, llm):
    s = score(results)
    assert sel.virtual_best(s).first().vbs == 3.0
    assert sel.single_best(s).first().solver == "a" and sel.single_best(s, "b").first().sbs == 1.25
    first = sel.top1(llm, s)
    gap = sel.closed_gap(first, s, "b")
    assert {r.model: round(r.gap, 6) for r in gap.collect()} == {"m": round((0.25 - 1.25) / 1.75, 6), "n": round(-0.25 / 1.75, 6)}
    table = sel.performance_table(sel.top3_summary(llm, s), sel.top1_summary(first).filter("model = 'm'"), gap)
    assert {r.model: r.single_score for r in table.collect()} == {"m": 0.25, "n": 0.0}
    flat = score(results).filter("problem = 't'")
    assert sel.closed_gap(sel.top1(llm, flat), flat, "a").filter("gap is not null").count() == 0


def test_empty_tables(spark, results, llm):
    s = score(results.limit(0))
    assert s.count() == 0 and sel.virtual_best(s).first().vbs == 0.0
    assert sel.top1_summary(sel.top1(llm.limit(0), s)).count() == 0
    none = {r.model: (r.total, r.average) for r in sel.top1_summary(sel.top1(llm, s)).collect()}
    assert none["m"] == (0.0, None)  # a total of nothing is 0, an average is null


def test_variants_and_upsert(spark):
    a = spark.createDataFrame([("m", 1)], "model string, x int")
    b = spark.createDataFrame([("m", 2.0)], "model string, y double")
    got = sel.variants(("A", a), ("B", b)).collect()
    assert [r.model_variant for r in got] == ["m (A)", "m (B)"] and got[0].y is None and got[1].x is None
    new = spark.createDataFrame([("m", 5), ("k", 6)], "model string, x int")
    assert sorted((r.model, r.x) for r in sel.upsert(a, new, "model").collect()) == [("k", 6), ("m", 5)]
