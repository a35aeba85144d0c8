"""The stages' contract on a small corpus: what goes, what stays, and the columns."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    r = random.Random(6)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8))) for _ in range(600)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    item = text(40)
    rows = {k: text(80) + ".\n" + text(30) for k in range(120)}
    rows |= {200: "tiny", 201: None, 202: "%%%# " * 60 + text(40), 203: rows[0] + "\n" + text(40), 204: text(60) + " " + item + " " + text(20), 205: rows[1], 206: rows[2].replace(" ", "  ", 1)}
    df = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")).coalesce(1), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        assert name == "bpe_tokens" or docs.columns == corpus_pipeline.COLUMNS
        seen[name] = {x.doc_id: x for x in docs.collect()}
    first = seen["quality_rules"]
    assert not {200, 201, 202} & set(first) and set(range(120)) <= set(first)
    assert set(seen["line_dedup"]) == set(first)
    assert seen["line_dedup"][0].text == rows[0] and seen["line_dedup"][205].text == "" and seen["line_dedup"][205].n_chars == 0
    assert seen["line_dedup"][203].text == rows[203].split("\n")[2]
    assert set(range(120)) <= set(seen["jaccard_join"]) and len({205, 206} & set(seen["jaccard_join"])) == 1  # both are empty by now
    assert set(seen["decontamination"]) == set(seen["jaccard_join"]) - {204}
    last = seen["bpe_tokens"]
    assert set(last) == set(seen["decontamination"]) and all(x.decodes and len(x.token_ids) == x.n_tokens for x in last.values())
    whole = {x.doc_id: x.n_tokens for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert whole == {k: x.n_tokens for k, x in last.items()}
