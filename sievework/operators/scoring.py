"""Scores of solver results against the best and worst objective of their instance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.enums import ALPHA, BETA, FAILED, SOLVED

INSTANCE = ["problem", "instance"]


def restrict(df: DataFrame, solvers: list[str] | None, column: str = "solver") -> DataFrame:
    """Rows of the solvers named, their names trimmed; all rows if there are no names or no such column."""
    names = [s.strip() for s in solvers or [] if s and s.strip()]
    if not names or column not in df.columns:
        return df
    trimmed = F.regexp_replace(F.col(column), r"^\s+|\s+$", "")
    return df.withColumn(column, trimmed).filter(F.col(column).isin(names))


def best_and_worst(results: DataFrame) -> DataFrame:
    """Add best and worst: of the solved rows of each instance, one pass by window. MIN problems want the smallest."""
    w = Window.partitionBy(*INSTANCE)
    solved = F.when(F.col("status").isin(*SOLVED), F.col("objective"))
    low, high, small = F.min(solved).over(w), F.max(solved).over(w), F.col("category") == "MIN"
    return results.withColumns({"best": F.when(small, low).otherwise(high), "worst": F.when(small, high).otherwise(low)})


def score(results: DataFrame, mode: str = "code") -> DataFrame:
    """Add best, worst, derived and score.

    mode "code" keeps what published scores were computed by: the best MAX value gets 0.25 and the worst 0.75; proofs
    without an objective, and instances whose best equals the worst, have no score. mode "paper" follows the text: the
    best gets 0.75, proofs 1, equal values 0.75, and nothing is below 0.
    """
    if mode not in ("code", "paper"):
        raise ValueError(f"mode {mode!r} is neither 'code' nor 'paper'")
    df = results.withColumn("status", F.upper(F.coalesce("status", F.lit("None"))))
    df = best_and_worst(df)
    status, category = F.col("status"), F.col("category")
    value, best, worst = F.col("objective"), F.col("best"), F.col("worst")
    proved = ((category == "MIN") & (value <= best)) | ((category == "MAX") & (value >= best))
    derived = (
        F.when(status.isin(*FAILED), "UNK")
        .when(status.isin(*SOLVED) & (category == "SAT"), "OPT")
        .when(status == "SC", F.when(F.coalesce(proved, F.lit(False)), "OPT").otherwise("SAT"))
        .when(status == "S", "SAT")
        .otherwise(status)
    )
    df, d = df.withColumn("derived", derived), F.col("derived")
    span = F.lit(BETA - ALPHA)
    ranked = (d == "SAT") & (best != worst)
    found = F.when(d.isin(*FAILED), F.lit(0.0)).when(d == "OPT", F.lit(1.0)).when(ranked & (category == "MIN"), ALPHA + span * (value - worst) / (best - worst))
    if mode == "code":
        found = found.when(ranked & (category == "MAX"), ALPHA + span * (best - value) / (best - worst))
    else:
        found = found.when(ranked & (category == "MAX"), ALPHA + span * (value - worst) / (best - worst))
        found = found.when((d == "SAT") & (best == worst), F.lit(BETA)).when(d.isin("C", "UNSAT"), F.lit(1.0))
        found = F.when(found < 0, F.lit(0.0)).otherwise(found)
    return df.withColumn("score", found)
