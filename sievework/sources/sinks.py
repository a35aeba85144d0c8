"""Writers: CSV, nested JSON, prompts, merged maps and shortened copies."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType
from pyspark.sql.window import Window

from sievework.functions.text import decimals
from sievework.sources.files import csv_cells, csv_lines, joined


def csv(df: DataFrame, path: str, single: bool = True, mode: str = "errorifexists") -> None:
    """CSV with a header; ``single`` is for reports, whose rows are few."""
    (df.coalesce(1) if single else df).write.mode(mode).option("header", True).csv(path)


def nested(rows: DataFrame) -> DataFrame:
    """One JSON document of provider, model, problem, instance, top3 and time_seconds, built level by level, keys in order."""
    leaf = F.struct("top3", "time_seconds")
    level = rows.select("provider", "model", "problem", F.col("instance").alias("k"), F.to_json(leaf, {"ignoreNullFields": "false"}).alias("v"))
    for keys in (["provider", "model", "problem"], ["provider", "model"], ["provider"], []):
        pair = F.concat(F.lit('"'), F.regexp_replace("k", r'(["\\])', r"\\$1"), F.lit('": '), "v")
        packed = F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", pair.alias("p")))), lambda x: x.p), ", "), F.lit("}"))
        level = level.groupBy(*keys).agg(packed.alias("v"))
        if keys:
            level = level.withColumnRenamed(keys[-1], "k")
    return level.select(F.col("v").alias("value"))


def prompts(df: DataFrame, path: str, lines: bool = True, mode: str = "errorifexists") -> None:
    """Prompts as JSON lines, or as text with a header line before each."""
    if lines:
        df.write.mode(mode).json(path)
    else:
        df.select(F.concat(F.lit("=== "), "model", F.lit(" / "), "problem", F.lit(" / "), "instance", F.lit(" ===\n"), "prompt").alias("value")).write.mode(mode).text(path)


def merge(old: DataFrame, new: DataFrame, overwrite: bool = False) -> DataFrame:
    """Entries (key, value) of both; where both have a key the old value stays, unless ``overwrite``."""
    both = old.select("key", F.col("value").alias("a")).join(new.select("key", F.col("value").alias("b")), "key", "full")
    return both.select("key", (F.coalesce("b", "a") if overwrite else F.coalesce("a", "b")).alias("value"))


def upsert_latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def sorted_map(entries: DataFrame) -> DataFrame:
    """Entries (key, value) as one JSON object with its keys in order."""
    rows = F.array_sort(F.collect_list(F.struct("key", "value")))
    return entries.agg(F.to_json(F.map_from_entries(rows)).alias("value"))


def shortened(rows: DataFrame, places: int = 3) -> DataFrame:
    """Rows with the decimals of their ``cells`` cut to so many places; other columns stay."""
    return rows.withColumn("cells", F.transform("cells", lambda c: decimals(c, places)))


class Copied(NamedTuple):
    """Where a copy lies, and how many files were read and lines written."""

    path: str
    files: int
    rows: int


def short_copy(spark: SparkSession, path: str, places: int = 3, overwrite: bool = False) -> Copied:
    """A folder of CSV files mirrored as NAME_short, a folder below it for each file, by each file's own delimiter.

    An error if it exists, unless ``overwrite``. The lines are counted by the job that writes them, as they pass; the files
    are those of the listing, empty ones included.
    """
    out = path.rstrip("/") + "_short"
    lines = csv_lines(spark, path)
    seen = Observation()
    rows = shortened(csv_cells(lines), places).observe(seen, F.count("*").alias("rows"))
    name = F.regexp_extract("file", r"(?i)([^/]+)\.csv$", 1).alias("name")
    rows.select(name, joined(F.col("cells"), F.col("delimiter")).alias("value")).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("name").text(out)
    return Copied(out, len(lines.inputFiles()), seen.get["rows"])


def unification_report(groups: DataFrame) -> DataFrame:
    """Counts of a unification as one JSON text: names, definitions, and how many names were changed."""
    n = F.size("names")
    return groups.agg(F.to_json(F.struct(F.sum(n).alias("names"), F.count("*").alias("definitions"), F.sum(F.size(F.filter("names", lambda x: x != F.col("unified")))).alias("renamed"))).alias("value"))


def styled(df: DataFrame, places: int = 3, others: dict[str, int] | None = None) -> DataFrame:
    """Numbers as text with so many decimals, ``others`` by column; nulls and other columns stay."""
    digits = {f.name: (others or {}).get(f.name, places) for f in df.schema if isinstance(f.dataType, NumericType)}
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{n}f", F.col(c).cast("double"))) for c, n in digits.items()})
