"""Prompts from segments: a table says which parts a prompt has, in which order and under what; a fold puts them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.enums import PROMPT_SEGMENTS, QUESTION, QUESTION_END, QUESTION_END_REASONED, SCRIPT_NOTE, SOLVER_HEAD, SUMMARY_MARKER
from sievework.functions.text import strip, tokens, truncated

#: The part that is cut to the budget, by mode.
CUT = {"model": "script", "summary": "summary"}


def segments(spark: SparkSession) -> DataFrame:
    """mode, place, before, part, after: the published prompts' segments; a segment is left out where its part is empty."""
    return spark.createDataFrame(PROMPT_SEGMENTS, "mode string, place int, before string, part string, after string")


def question(solvers: Column, reasoned: bool = False) -> Column:
    """What is asked about a list of solvers: their names, a line each, and how to answer."""
    lines = F.array_join(F.transform(solvers, lambda s: F.concat(F.lit("- "), s)), "\n")
    return F.concat(F.lit(QUESTION), lines, F.lit(QUESTION_END_REASONED if reasoned else QUESTION_END))


def described(solvers: Column, descriptions: Column) -> Column:
    """A list of solvers, in its order, with their descriptions of a map; empty for an empty or null map, as it has none to tell."""
    lines = F.array_join(F.transform(solvers, lambda s: F.concat(F.lit("- "), s, F.lit(": "), F.coalesce(F.try_element_at(descriptions, s), F.lit("")))), "\n")
    return F.when(F.size(F.coalesce(descriptions, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))) > 0, F.concat(F.lit(SOLVER_HEAD), lines, F.lit("\n"))).otherwise("")


def composed(tasks: DataFrame, parts: DataFrame, mode: str) -> DataFrame:
    """``tasks`` with prompt, was_cut and prompt_tokens; those without what the mode is about are left out (see ``dry_run``).

    Tasks have description, script, data, summary, solver_text, question (null counts as empty) and allowed, the tokens that a
    prompt may have. In mode "model" the script has what the other parts leave; in mode "summary" the whole prompt is kept if it
    fits, else the summary has what the text before it and behind it leaves. ``parts`` has the segments of every mode; the few of this
    one travel as one array, and each prompt is folded where its task lies: nothing is shuffled.
    """
    rows = F.array_sort(F.collect_list(F.struct("place", "before", "part", "after")))
    found = tasks.join(F.broadcast(parts.filter(F.col("mode") == mode).agg(rows.alias("_parts"))))  # one row
    fields = {c: F.coalesce(F.col(c), F.lit("")) for c in ("description", "script", "data", "solver_text", "question")}
    fields["summary"] = strip(F.coalesce("summary", F.lit("")))

    def fold(values: dict[str, Column], which=lambda s: F.lit(True)) -> Column:
        value = lambda s: F.coalesce(*(F.when(s.part == k, v) for k, v in values.items()), F.lit(""))
        add = lambda text, s: F.when(value(s) != "", F.concat(text, s.before, value(s), s.after)).otherwise(text)
        return F.aggregate(F.filter("_parts", which), F.lit(""), add)

    what, allowed = CUT[mode], F.col("allowed")
    if mode == "model":
        found = found.withColumn("_left", F.greatest(F.lit(0).cast("long"), allowed - tokens(F.concat(F.lit("\n\n"), fold(fields, lambda s: s.part != what)))))
        found = found.withColumn("was_cut", (F.col("_left") <= 0) | (tokens(fields[what]) > F.col("_left")))
        safe = truncated(fields[what], F.col("_left"), script=True)
        # an empty script leaves its heading behind
        out = fold(fields | {what: F.concat(safe, F.lit("\x00")), "note": F.when(F.col("was_cut"), SCRIPT_NOTE).otherwise("")})
        found = found.withColumn("prompt", F.replace(out, F.lit("\x00")))
    else:
        found = found.filter(fields[what] != "")
        place = F.element_at(F.filter("_parts", lambda s: s.part == what), 1)
        head = F.concat(fold(fields, lambda s: s.place < place.place), place.before)
        tail = fold(fields, lambda s: s.place > place.place)
        found = found.withColumns({"_whole": fold(fields), "_left": F.greatest(F.lit(0).cast("long"), allowed - tokens(tail) - tokens(head))})
        long_ = tokens(F.col("_whole")) > allowed
        found = found.withColumn("was_cut", long_ & ((F.col("_left") <= 0) | (tokens(fields[what]) > F.col("_left"))))
        safe = truncated(fields[what], F.col("_left"), marker=SUMMARY_MARKER)
        found = found.withColumn("prompt", F.when(long_, F.concat(head, safe, place.after, tail)).otherwise(F.col("_whole"))).drop("_whole")
    return found.withColumn("prompt_tokens", tokens(F.col("prompt"))).drop("_parts", "_left")


def dry_run(tasks: DataFrame, parts: DataFrame, mode: str, by: list[str]) -> DataFrame:
    """What a run would send, by model: tasks, prompts, those skipped for want of a summary, those cut, and the tokens in all."""
    sent = composed(tasks, parts, mode).groupBy(*by).agg(F.count("*").alias("prompts"), F.count_if("was_cut").alias("cut"), F.sum("prompt_tokens").alias("tokens"))
    every = tasks.groupBy(*by).agg(F.count("*").alias("tasks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return every.join(sent, by, "left").select(*by, "tasks", zero("prompts"), (F.col("tasks") - F.coalesce("prompts", F.lit(0).cast("long"))).alias("skipped"), zero("cut"), zero("tokens"))


def run_name(top: bool = False, description: bool = False, summary: bool = False, categorized: bool = False, solver_text: bool = False, reasoned: bool = False, temperature: float | None = None) -> str:
    """The suffix that names a run's file by its options, such as _top_desc_fzncat_T0p2; empty without any."""
    parts = [n for n, on in (("top", top), ("desc", description), ("fzncat" if categorized else "fzn", summary), ("solverdesc", solver_text), ("reason", reasoned)) if on]
    if temperature is not None:
        parts.append(f"T{temperature:g}".replace(".", "p"))
    return "".join(f"_{p}" for p in parts)
