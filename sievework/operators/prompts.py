"""Prompt tasks: models by instances, token budgets, prompts, responses and chats packed under a budget."""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sievework.enums import CONTEXT_RESERVE, DEFAULT_CONTEXT
from sievework.functions.text import brackets, key_of_path, pairs, strip, tokens
from sievework.shipping import ship


def tasks(models: DataFrame, instances: DataFrame) -> DataFrame:
    """Every model with every instance: the product is what is wanted, and Spark picks how from the sides' sizes."""
    return instances.crossJoin(models)


def selected(models: DataFrame, left_out: list[str], best: str | None = None, top: list[str] | None = None) -> DataFrame:
    """The models (model, ...) that are asked: not those left out; if given, the best one alone, or those of the top alone."""
    out = models.filter(~F.col("model").isin(left_out)) if left_out else models
    out = out if best is None else out.filter(F.col("model") == best)
    return out if top is None else out.filter(F.col("model").isin(top))


def labelled(models: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label``: the first (by place) that ``labels`` (model, place, label) has for a model, else the model's id."""
    first = labels.groupBy("model").agg(F.min_by("label", "place").alias("label"))
    return models.drop("label").join(first, "model", "left").withColumn("label", F.coalesce("label", "model"))


def with_summary(tasks: DataFrame, summaries: DataFrame, path: str = "path", roots: tuple[str, ...] = ()) -> DataFrame:
    """Add ``summary`` of the parser summaries (key, summary) by the key of each task's path; ``skipped`` marks tasks that have none.

    An empty summary counts as none. Keys are unique in ``summaries``.
    """
    found = summaries.select(F.col("key").alias("_key"), F.nullif("summary", F.lit("")).alias("summary"))
    out = tasks.withColumn("_key", key_of_path(F.col(path), roots)).join(found, "_key", "left").drop("_key")
    return out.withColumn("skipped", F.col("summary").isNull())


def with_window(models: DataFrame, windows: DataFrame) -> DataFrame:
    """Add ``window``: the size at the model's id, else at the first id (by place) that contains its label, whatever the case, else the default; less the reserve, not below 0.

    ``models`` has model and label (without one, the id is the label); ``windows`` has id, place and size, a size of 0 being none.
    """
    models = models if "label" in models.columns else models.withColumn("label", F.col("model"))
    known = windows.filter("size > 0")
    exact = models.join(known.select(F.col("id").alias("model"), F.col("size").alias("exact")), "model", "left")
    labels = models.select("label").filter("label <> ''").distinct()
    part = labels.join(known, F.lower("id").contains(F.lower("label"))).groupBy("label").agg(F.min_by("size", "place").alias("part"))
    size = F.coalesce("exact", "part", F.lit(DEFAULT_CONTEXT))
    return exact.join(part, "label", "left").withColumn("window", F.greatest(F.lit(0), size - CONTEXT_RESERVE).cast("long")).drop("exact", "part")


def prompt(script: Column, solvers: Column, description: Column | None = None, solver_text: Column | None = None) -> Column:
    """The text that asks for the three best solvers of a model; missing parts are left out."""
    parts = [F.lit("The following is a constraint model:\n"), script]
    if description is not None:
        parts += [F.coalesce(F.concat(F.lit("\n\nDescription:\n"), description), F.lit(""))]
    if solver_text is not None:
        parts += [F.coalesce(F.concat(F.lit("\n\nSolvers:\n"), solver_text), F.lit(""))]
    return F.concat(*parts, F.lit("\n\nChoose the three best among: "), solvers, F.lit(". Answer only with [first, second, third]."))


def listed(c: Column) -> Column:
    """The parts of a list between commas, stripped; blank ones stay."""
    return F.transform(F.split(c, ","), strip)


def responses(df: DataFrame, column: str = "response", reasoned: bool = False) -> DataFrame:
    """Rows of every 'name: [list]' in a response: name, picks, and ``reasoned`` reasoning; of a name given twice the last counts."""
    every = df.select(*[c for c in df.columns if c != column], F.posexplode(pairs(F.col(column), reasoned)).alias("pos", "pair"))
    keys = [c for c in df.columns if c != column]
    last = every.groupBy(*keys, F.col("pair.name").alias("name")).agg(F.max_by("pair", "pos").alias("p"))
    return last.select(*keys, "name", listed(F.col("p.list")).alias("picks"), *([F.col("p.tail").alias("reasoning")] if reasoned else []))


def parsed(chats: DataFrame, response: str = "response", asked: str = "asked", reasoned: bool = False) -> DataFrame:
    """Rows of a chat's answer: name, picks, error, and ``reasoned`` reasoning, the text behind a named list.

    Named lists count, the last of each name. A response without any gives its n-th bracket to the n-th message of ``asked``, the
    texts of the user in order, named by their first line; a message beyond the last bracket has null picks and an error.
    Messages of one name in a chat share a row, that of the last.
    """
    keys = [c for c in chats.columns if c not in (response, asked)]
    none = F.lit(None).cast("string")
    named = F.transform(pairs(F.col(response), reasoned), lambda p: F.struct(p["name"].alias("name"), p["list"].alias("list"), (p["tail"] if reasoned else none).alias("tail")))
    first_line = lambda m: strip(F.replace(F.substring_index(m, "\n", 1), F.lit("Instance:"), F.lit("")))
    by_place = F.transform(F.col(asked), lambda m, i: F.struct(first_line(m).alias("name"), F.get(brackets(F.col(response)), i).alias("list"), none.alias("tail")))
    every = chats.select(*keys, F.posexplode(F.when(F.size(named) > 0, named).otherwise(by_place)).alias("pos", "e"))
    last = every.groupBy(*keys, F.col("e.name").alias("name")).agg(F.max_by(F.struct("e.list", "e.tail"), "pos").alias("e"))
    return last.select(*keys, "name", listed(F.col("e.list")).alias("picks"), F.when(F.col("e.list").isNull(), "no parsed response").alias("error"), *([F.col("e.tail").alias("reasoning")] if reasoned else []))


def _pack(batches, budget):
    """Chats of messages that come in order, key by key."""
    last, chat, used = object(), 0, 0
    for b in batches:
        keys, sizes, out = b.column("k").to_pylist(), b.column("n").to_pylist(), []
        for k, n in zip(keys, sizes, strict=True):
            if k != last:
                last, chat, used = k, 0, 0
            elif used > 0 and used + n > budget:
                chat, used = chat + 1, 0
            used += n
            out.append(chat)
        yield pa.RecordBatch.from_arrays([b.column("k"), b.column("o"), pa.array(out, pa.int64())], names=["k", "o", "chat"])


def packed(messages: DataFrame, key: str, order: str, text: str, budget: int) -> DataFrame:
    """Number each message's chat: messages go, in order, into the open chat while its estimated tokens stay within ``budget``.

    A message above the budget has a chat of its own. The running total starts anew with each chat, which no window frame
    can say; it is carried along the sorted messages of a key. Their sizes alone are dealt, not their texts.
    """
    ship(messages.sparkSession)
    sizes = messages.select(F.col(key).alias("k"), F.col(order).alias("o"), tokens(F.col(text)).alias("n"))
    kinds = StructType([StructField("k", sizes.schema["k"].dataType), StructField("o", sizes.schema["o"].dataType), StructField("chat", LongType())])
    dealt = sizes.repartition("k").sortWithinPartitions("k", "o", "n")
    return dealt.mapInArrow(partial(_pack, budget=budget), kinds).toDF(key, order, "chat")


def halves(messages: Column) -> tuple[Column, Column]:
    """A chat (array of role and content) in two: the system's messages in both, the user's halved, the first half the smaller.

    A single message is halved by lines, which keep their ends, and a single line by characters. Without a message of the user
    both halves are the whole.
    """
    of = lambda role: F.filter(messages, lambda m: m.role == role)
    system, user = of("system"), of("user")
    n = F.floor(F.size(user) / 2).cast("int")
    text = F.coalesce(F.get(user, F.lit(0)).content, F.lit(""))
    lines = F.regexp_extract_all(text, F.lit(r"[^\n]*\n|[^\n]+"), F.lit(0))
    half = F.floor(F.size(lines) / 2).cast("int")
    cut = F.when(F.size(lines) <= 1, F.floor(F.char_length(text) / 2)).otherwise(F.char_length(F.array_join(F.slice(lines, F.lit(1), half), ""))).cast("int")
    one = lambda t: F.array(F.struct(F.lit("user").alias("role"), t.alias("content")))
    parts = [F.substring(text, F.lit(1), cut), F.substring(text, cut + 1, F.char_length(text))]
    several = [F.slice(user, F.lit(1), n), F.slice(user, n + 1, F.size(user) - n)]
    return tuple(F.when(F.size(user) == 0, messages).when(F.size(user) == 1, F.concat(system, one(p))).otherwise(F.concat(system, s)) for p, s in zip(parts, several, strict=True))


def answered(prompts: DataFrame, ask, column: str = "prompt") -> DataFrame:
    """Add ``response``: ``ask(prompt)`` of a pluggable provider, called on the executors batch by batch."""

    def run(batches):
        for pdf in batches:
            yield pdf.assign(response=[ask(p) for p in pdf[column]])

    ship(prompts.sparkSession)
    return prompts.mapInPandas(run, StructType([*prompts.schema.fields, StructField("response", StringType())]))
