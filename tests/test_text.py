"""Text columns, prompts, chats and taxonomy."""

import pytest
from pyspark.sql import functions as F

from sievework.functions import text as tx
from sievework.operators import arrays, prompts, taxonomy


@pytest.fixture(scope="module")
def one(spark):
    def value(column, *cells):
        df = spark.createDataFrame([(c,) for c in cells], "x string")
        return [r[0] for r in df.select(column(F.col("x"))).collect()]

    return value


def test_numbers_and_percent(one, spark):
    assert one(tx.number, "1", " 2.5 ", "1d", "1.5f", "", "-3e2", None, "x") == [1, 2.5, None, None, None, -300, None, None]
    df = spark.createDataFrame([(32, 33), (1, 8), (1, 1), (1, 0)], "a int, b int")
    assert [r[0] for r in df.select(tx.percent(F.col("a"), F.col("b"))).collect()] == ["96.97%", "12.5%", "100.0%", None]


def test_lists_and_brackets(one):
    assert one(tx.names, "a, b;c,, ") == [["a", "b", "c"]]
    assert one(tx.first_bracket, "so [a, b] then [c]", "none") == ["a, b", None]
    assert one(tx.after_bracket, "so [a]  because\nit is ", "none") == ["because\nit is", ""]
    assert one(tx.pairs, "p1: [a, b]\np-2: [c] why") == [[("p1", "a, b"), ("p-2", "c")]]


def test_durations_and_errors(one):
    assert one(tx.seconds, "Please try again in 24m8.928s.", "try again after 1h2m", "wait 5s", "try again in 26m29.328s") == [1448, 3720, None, 1589]
    assert one(tx.error_policy, "Error 429", "413: token limit", "413 Payload", "503", "RESOURCE_EXHAUSTED", "odd", "rate_limit_exceeded", "context_length_exceeded", "rate limit") == ["rate", "rate", "too_large", "unavailable", "exhausted", "other", "rate", "too_large", "other"]


def test_truncation(one):
    assert one(tx.tokens, "", "a", "a" * 9, None) == [0, 1, 2, 0]
    assert one(lambda c: tx.truncated(c, 5), "a" * 20, "b" * 30) == ["a" * 20, "b" * 20 + tx.MARKER]
    assert one(lambda c: tx.decimals(c, 3), "-1.0469999", "1.5", "1e-7", " 2.12345 ", "n", "12") == ["-1.046", "1.5", "1e-7", " 2.123 ", "n", "12"]
    assert one(lambda c: tx.decimals(c, 0), "3.9") == ["3"]


def test_names_of_files_and_letters(one, spark):
    assert one(tx.temperature, "LLM_chat_Sdesc_T0p2.json", "T0.json", "none") == [0.2, 0.0, None]
    assert one(tx.key_of_path, "/a/b/atsp/inst.1.dzn", "atsp/x", "c:\\p\\q.json", "bare") == ["atsp/inst.1.dzn", "atsp/x", "p/q.json", None]
    assert one(lambda c: tx.key_of_path(c, ("/r", "/r/s")), "/r/p/q/i.json", "/r", "/z/a/b") == ["p/q/i.json", "/r", "a/b"]
    got = spark.createDataFrame([(0,), (25,), (26,), (701,), (702,), (18277,), (18278,), (10**15,)], "n long").select(tx.letters("n")).collect()
    assert [r[0] for r in got][:7] == ["a", "z", "aa", "zz", "aaa", "zzz", "aaaa"] and len(got[7][0]) == 11


def test_packing_starts_a_chat_when_full(spark):
    df = spark.createDataFrame([(1, k, "x" * n) for k, n in enumerate([40, 40, 40, 400, 4])] + [(2, 0, "")], "c int, k int, t string")
    got = {(r.c, r.k): r.chat for r in prompts.packed(df, "c", "k", "t", 20).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 4): 3, (2, 0): 0}


def test_responses_last_name_wins(spark):
    df = spark.createDataFrame([(1, "p: [a]\nq: [b, c]\np: [d]")], "id int, response string")
    assert sorted((r.name, r.picks) for r in prompts.responses(df).collect()) == [("p", ["d"]), ("q", ["b", "c"])]
    assert prompts.answered(df.select(F.lit("hi").alias("prompt")), str.upper).first().response == "HI"


def test_context_windows(spark):
    models = spark.createDataFrame([("a", "kimi-k2"), ("gpt", "gpt"), ("odd", "odd"), ("x", "tiny"), ("y", "")], "model string, label string")
    windows = spark.createDataFrame([("moonshotai/Kimi-K2-instruct", 1, 5000), ("gpt", 2, 1000), ("odd", 3, 0), ("a-tiny", 5, 100), ("tiny-b", 6, 9000)], "id string, place int, size int")
    got = {r.model: r.window for r in prompts.with_window(models, windows).collect()}
    assert got == {"a": 5000 - 256, "gpt": 1000 - 256, "odd": 250_000 - 256, "x": 0, "y": 250_000 - 256}


def test_answers_without_names(spark):
    rows = [(1, ["Instance: i1\nrest", "i2", "i3"], "so [a, b]\nand [c]"), (2, ["i1"], "p q : [a,]\nz: [b]\nz: [c]"), (3, [], "[a]"), (4, None, None)]
    got = {(r.id, r.name): (r.picks, r.error) for r in prompts.parsed(spark.createDataFrame(rows, "id int, asked array<string>, response string")).collect()}
    assert got == {(1, "i1"): (["a", "b"], None), (1, "i2"): (["c"], None), (1, "i3"): (None, "no parsed response"), (2, "p q"): (["a", ""], None), (2, "z"): (["c"], None)}


def test_halves_of_a_chat(spark):
    s, u = lambda x: ("system", x), lambda x: ("user", x)
    chats = [[s("S"), u("1"), u("2"), u("3")], [s("S"), u("a\nb\nc")], [u("abcde")], [s("S")], []]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(chats)], "k int, m array<struct<role: string, content: string>>").select("k", *prompts.halves(F.col("m"))).orderBy("k")
    got = [[[x.content for x in h] for h in r[1:]] for r in df.collect()]
    assert got == [[["S", "1"], ["S", "2", "3"]], [["S", "a\n"], ["S", "b\nc"]], [["ab"], ["cde"]], [["S"], ["S"]], [[], []]]


def test_models_asked_and_tasks_skipped(spark):
    models = spark.createDataFrame([("a",), ("b",), ("c",)], "model string")
    assert [r.model for r in prompts.selected(models, ["a"], top=["a", "b"]).collect()] == ["b"]
    assert [r.model for r in prompts.selected(models, [], best="c").collect()] == ["c"]
    labels = spark.createDataFrame([("a", 1, "A"), ("a", 0, "AA")], "model string, place int, label string")
    assert sorted((r.model, r.label) for r in prompts.labelled(models, labels).collect()) == [("a", "AA"), ("b", "b"), ("c", "c")]
    tasks = spark.createDataFrame([("/r/p/i.json",), ("p/j.json",), (None,)], "path string")
    summaries = spark.createDataFrame([("p/i.json", "text"), ("p/j.json", "")], "key string, summary string")
    assert sorted((r.path or "", r.summary, r.skipped) for r in prompts.with_summary(tasks, summaries).collect()) == [("", None, True), ("/r/p/i.json", "text", False), ("p/j.json", None, True)]


def test_forward_fill_then_totals_go(spark):
    rows = [("t", 0, "p", "1"), ("t", 1, " ", ""), ("t", 2, "TOTAL", "9"), ("t", 3, "q", ""), ("u", 0, None, None)]
    got = taxonomy.filled(spark.createDataFrame(rows, "k string, r int, problem string, instance string"), "k", "r", ["problem", "instance"])
    assert sorted((r.k, r.r, r.problem or "", r.instance or "") for r in got.collect()) == [("t", 0, "p", "1"), ("t", 1, "p", "1"), ("t", 3, "q", "9"), ("u", 0, "", "")]


def test_taxonomy(spark):
    names = spark.createDataFrame([("fzn_all_different_int",), ("other_x",), ("none",)], "name string")
    known = spark.createDataFrame([("all_different",), ("other_x",)], "known string")
    assert {r.name: r.known for r in taxonomy.looked_up(names, known).collect()} == {"fzn_all_different_int": "all_different", "other_x": "other_x", "none": None}
    defs = spark.createDataFrame([("array_int_max", "D"), ("array_int_min", " D"), ("x", "E"), ("y", "F")], "name string, definition string")
    assert {r.definition: r.unified for r in taxonomy.unified(defs).collect()} == {"D": "array_int", "E": "x", "F": "y"}
    asked = spark.createDataFrame([("ATSP",), ("is",), ("hole",), ("t",), ("black-hole-2",), (" Atsp ",)], "name string")
    found = taxonomy.resolved(asked, spark.createDataFrame([("atsp",), ("is",), ("black-hole",), ("tower",)], "known string"))
    assert {r.name: r.known for r in found.collect()} == {"ATSP": "atsp", "is": "is", "hole": "black-hole", "t": None, "black-hole-2": None, " Atsp ": "atsp"}


def test_arrays(spark):
    long = "a = [" + ", ".join(["1"] * 10) + "];\nb = 2;"
    assert arrays.shortened(long, most=5, keep=3) == "a = [1, 1, 1]; // array too long to display, dimensions: (10)\n\nb = 2;"
    assert arrays.shortened(long) == long and arrays.shortened("x = [1, [2") == "x = [1, [2"
    assert arrays.shortened(long, most=5, keep=1, compat=True).startswith("a = a = [1]; //")
    assert arrays.shape("[1,2],[3,4],[5,6]") == (6, (3, 2)) and arrays.shape("[1],[2,3]") == (3, (3,))
    df = spark.createDataFrame([(1, "1, x")], "k int, values string")
    assert [(r.feature, r.value) for r in arrays.features(df, ["a", "b"]).collect()] == [("a", 1.0), ("b", None)]
    with pytest.raises(Exception, match="expected 3 values"):
        arrays.features(df, ["a", "b", "c"]).collect()
