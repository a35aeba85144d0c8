"""Suggestions joined to scores: best of three, first choice, portfolio totals and the closed gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import number
from sievework.operators.scoring import restrict

MODEL = ["provider", "model"]
PAIR = ["problem", "instance"]


def clean(c):
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def exploded(llm: DataFrame, solvers: list[str] | None = None) -> DataFrame:
    """One row for each suggested name; a list without names gives one row with the name 'nan', no list gives none."""
    rows = llm.filter(F.col("top3").isNotNull()).withColumn("solver", F.explode_outer("top3"))
    return restrict(rows.withColumn("solver", clean(F.coalesce("solver", F.lit("nan")))), solvers)


def matched(suggested: DataFrame, scored: DataFrame, solvers: list[str] | None = None) -> DataFrame:
    """Left join to the scores of the same instance and solver; repeated result rows fan out."""
    scores = restrict(scored, solvers).select(*PAIR, "solver", "score")
    return suggested.join(scores, [*PAIR, "solver"], "left")


def top3_detail(llm: DataFrame, scored: DataFrame, solvers: list[str] | None = None) -> DataFrame:
    """The best score of each list; names without a score count 0."""
    found = matched(exploded(llm, solvers), scored, solvers)
    return found.groupBy(*MODEL, *PAIR).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best_score"))


def top3_summary(llm: DataFrame, scored: DataFrame, solvers: list[str] | None = None) -> DataFrame:
    """Each model's total, the instances it covers (labels, whatever the problem) and their ratio."""
    per = top3_detail(llm, scored, solvers).groupBy(*MODEL).agg(F.sum("best_score").alias("total"), F.count_distinct("instance").alias("covered"))
    return per.withColumn("average", F.try_divide("total", "covered"))


def top1(llm: DataFrame, scored: DataFrame, solvers: list[str] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The first name of each list with its score, null if there is none; names are trimmed only if solvers are given."""
    first = llm.withColumn("solver", F.get("top3", F.lit(0))).filter(F.col("solver").isNotNull())
    return matched(restrict(first, solvers).select(*MODEL, *(keep or []), *PAIR, "solver"), scored, solvers)


def top1_summary(detail: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals over all rows, but averages over those with a score."""
    return detail.groupBy(*(by or MODEL)).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.avg("score").alias("average"), F.count_distinct("instance").alias("covered"))


def virtual_best(scored: DataFrame) -> DataFrame:
    """One row, vbs: the sum of every instance's best score."""
    return scored.groupBy(*PAIR).agg(F.max("score").alias("s")).agg(F.coalesce(F.sum("s"), F.lit(0.0)).alias("vbs"))


def solver_totals(scored: DataFrame) -> DataFrame:
    """Every solver's sum of scores and number of scores of exactly 1, those with most of the latter first."""
    return scored.groupBy("solver").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count_if(F.col("score") == 1.0).alias("optimal")).orderBy(F.desc("optimal"), "solver")


def single_best(scored: DataFrame, solver: str | None = None, digits: int = 6) -> DataFrame:
    """One row, solver and sbs: the solver named, or that with the largest total (equal to so many digits: by name)."""
    totals = scored.groupBy("solver").agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("sbs"))
    if solver is not None:
        return totals.filter(F.col("solver") == solver)
    return totals.orderBy(F.desc(F.round("sbs", digits)), "solver").limit(1)


def closed_gap(detail: DataFrame, scored: DataFrame, solver: str | None = None) -> DataFrame:
    """(total - SBS) / (VBS - SBS) of each model; SBS and VBS over all instances, totals over those a model covers."""
    both = virtual_best(scored).crossJoin(single_best(scored, solver).select("sbs"))  # one row each
    per = detail.groupBy(*MODEL).agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("total"), F.count_distinct(F.struct(*PAIR)).alias("covered"))
    return per.crossJoin(F.broadcast(both)).withColumn("gap", F.try_divide(F.col("total") - F.col("sbs"), F.col("vbs") - F.col("sbs")))


def performance_table(top3: DataFrame, first: DataFrame, gap: DataFrame, fill: bool = True) -> DataFrame:
    """Full outer join of the three summaries by model: parallel_score, single_score, closed_gap."""
    out = top3.select(*MODEL, F.col("total").alias("parallel_score")).join(first.select(*MODEL, F.col("total").alias("single_score")), MODEL, "full").join(gap.select(*MODEL, F.col("gap").alias("closed_gap")), MODEL, "full")
    return out.fillna(0.0, ["parallel_score", "single_score"]) if fill else out


def variant_names(df: DataFrame, label: str) -> DataFrame:
    """Add model_variant = 'model (label)' where the label is a column."""
    return df.withColumn("model_variant", F.concat("model", F.lit(" ("), label, F.lit(")")))


def variants(*labelled: tuple[str, DataFrame]) -> DataFrame:
    """UNION ALL by name, with missing columns null, and model_variant = 'model (label)'."""
    out = None
    for label, df in labelled:
        part = df.withColumn("model_variant", F.concat("model", F.lit(f" ({label})")))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``old`` without a row of the same key in ``new``, then ``new``."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def first_of(df: DataFrame, by: list[str], *order) -> DataFrame:
    """One row of each group: the first in an order that must settle ties."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("_rank = 1").drop("_rank")


def largest_score(scored: DataFrame) -> DataFrame:
    """One score for each instance and solver: of repeated rows the largest, nothing counting 0."""
    return scored.groupBy(*PAIR, "solver").agg(F.max(F.coalesce("score", F.lit(0.0))).alias("score"))


def last_score(scored: DataFrame, place: str = "place") -> DataFrame:
    """One score for each instance and solver: of repeated rows the last by its place in the results, a missing score included; of
    rows in one place that with the largest."""
    return scored.groupBy(*PAIR, "solver").agg(F.max_by("score", F.struct(place, F.coalesce("score", F.lit(-1.0)))).alias("score"))


def candidates(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """``pairs`` (problem, instance) with solvers, the sorted names of those with a result there; an empty list where there is none."""
    have = results.groupBy(*PAIR).agg(F.sort_array(F.collect_set("solver")).alias("solvers"))
    return pairs.select(*PAIR).distinct().join(have, PAIR, "left").withColumn("solvers", F.coalesce("solvers", F.array().cast("array<string>")))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin (from 1) and n of equal bins between the smallest and the largest value, the last one closed; nulls are left out.

    Values that are all equal lie in the middle of a range of 1. The range, one row, is all that is broadcast.
    """
    x = df.select(F.col(column).cast("double").alias("x")).filter("x is not null")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.select(F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    at = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    return x.join(F.broadcast(ends)).groupBy(F.least(F.lit(bins), at).cast("long").alias("bin")).agg(F.count("*").alias("n"))


#: Names under which a table's measures are known, the first there counts; and names to sort by.
MEASURES = {
    "single_score": ["LLM_Top1_TotalScore", "SingleScore", "Top1TotalScore", "single_score"],
    "parallel_score": ["LLM_TotalScore", "ParallelScore", "TotalScore", "parallel_score"],
    "closed_gap": ["ClosedGap", "closed_gap"],
}
SORT_NAMES = {"TotalScore": "parallel_score", "ParallelScore": "parallel_score", "Parallel Score": "parallel_score", "Top1TotalScore": "single_score", "SingleScore": "single_score", "Single Score": "single_score", "ClosedGap": "closed_gap", "Closed Gap": "closed_gap"}


def metric_table(single: DataFrame | None = None, parallel: DataFrame | None = None, gap: DataFrame | None = None, on: list[str] | None = None, provider: bool = False, fill: float | None = None, sort_by: str | None = None, ascending: bool = False) -> DataFrame | None:
    """model, single_score, parallel_score and closed_gap of up to three tables, joined fully; null without any.

    They are joined on ``on``, else on model_variant if one of them has it, else on provider and model; a table without the key, or
    without its measure under any of the known names, raises. A missing table's measure is null. ``provider`` puts the
    provider behind the model, both as text, None where null; ``fill`` is for scores that are missing, and turns texts that are no numbers into it. Sorting
    takes the names of older tables too, nulls come last; an unknown name doesn't sort.
    """
    given = {m: t for m, t in zip(MEASURES, (single, parallel, gap), strict=True) if t is not None}
    if not given:
        return None
    if on is None:
        on = ["model_variant"] if any("model_variant" in t.columns for t in given.values()) else ["provider", "model"]
    out = None
    for measure, t in given.items():
        name = next((n for n in MEASURES[measure] if n in t.columns), None)
        if name is None or not set(on) <= set(t.columns):
            raise KeyError(f"{measure}: needs {on} and one of {MEASURES[measure]}, has {t.columns}")
        part = t.select(*on, F.col(name).alias(measure))
        out = part if out is None else out.join(part, on, "full")
    out = out.withColumns({m: F.lit(None).cast("double") for m in MEASURES if m not in given})
    if on == ["model_variant"]:
        out = out.withColumnRenamed("model_variant", "model")
    if fill is not None:
        number_ = {m: F.coalesce(F.col(m).try_cast("double"), F.lit(float(fill))) for m in ("single_score", "parallel_score")}
        out = out.withColumns(number_)
    if "model" not in out.columns:
        out = out.withColumn("model", F.lit(None).cast("string"))
    if provider and "provider" in out.columns:
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
        out = out.withColumn("model", F.concat(text("model"), F.lit(" ("), text("provider"), F.lit(")")))
    out = out.select("model", *MEASURES)
    by = SORT_NAMES.get(sort_by, sort_by)
    return out.orderBy(F.asc_nulls_last(by) if ascending else F.desc_nulls_last(by)) if by in out.columns else out


def metric_max(df: DataFrame, column: str) -> DataFrame:
    """One row, value: the largest number of a column of any type, texts that are none left out; null without one or without the column."""
    c = number(F.col(column).cast("string")) if column in df.columns else F.lit(None).cast("double")
    return df.agg(F.max(c).alias("value"))


def complete(df: DataFrame, subset: list[str]) -> DataFrame:
    """Rows without a null, or NaN, in the columns of ``subset`` that there are."""
    return df.dropna(subset=[c for c in subset if c in df.columns]) if any(c in df.columns for c in subset) else df


def with_metadata(df: DataFrame, **values) -> DataFrame:
    """Add a constant column for each value, such as a variant and a temperature; columns of these names are replaced."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})
