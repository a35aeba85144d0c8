"""Names, definitions and categories of constraints: grouping, categories, suffix look-up, unified names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.text import strip
from sievework.rounds import Rounds

#: Tokens that say a type.
TYPES = ["int", "float", "bool", "set", "var", "opt", "array"]


def by_definition(names: DataFrame) -> DataFrame:
    """Names (name, definition) with the same definition: definition, names sorted."""
    return names.groupBy(strip(F.col("definition")).alias("definition")).agg(F.sort_array(F.collect_set("name")).alias("names"))


def categorized(names: DataFrame, categories: DataFrame) -> DataFrame:
    """Every name with each of its categories, or 'Uncategorized'; ``categories`` has category and member."""
    found = names.select("name").distinct().join(categories, F.col("name") == F.col("member"), "left")
    return found.select("name", F.coalesce("category", F.lit("Uncategorized")).alias("category")).distinct()


def primary(found: DataFrame) -> DataFrame:
    """The alphabetically first category of each name."""
    return found.groupBy("name").agg(F.min("category").alias("category"), F.count("*").alias("categories"))


def looked_up(names: DataFrame, known: DataFrame, prefix: str = "fzn_") -> DataFrame:
    """The longest known form of each name: itself, then without the prefix, then with last tokens taken away one by one.

    ``known`` has known; names without a known form have null.
    """
    bare = F.regexp_replace("name", f"^{prefix}", "")
    tokens = F.split(bare, "_")
    shorter = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), lambda i: F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - i), "_"))
    tries = names.select("name").distinct().select("name", F.posexplode(F.concat(F.array("name"), shorter)).alias("rank", "known"))
    hit = tries.join(known.select("known").distinct(), "known").groupBy("name").agg(F.min_by("known", "rank").alias("known"))
    return names.select("name").distinct().join(hit, "name", "left")


def common_prefix(names):
    """The tokens that all names of an array begin with, joined again; empty if there are none."""
    parts = F.transform(names, lambda n: F.split(n, "_"))
    first = F.get(parts, F.lit(0))
    same = F.filter(F.sequence(F.lit(1), F.size(first)), lambda i: F.forall(parts, lambda p: F.slice(p, F.lit(1), i) == F.slice(first, F.lit(1), i)))
    return F.array_join(F.slice(first, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), "_")


def untyped(name: Column) -> Column:
    """A name's tokens without those of types in front; a name of types alone keeps them all."""
    tokens = F.split(name, "_")
    kept = F.filter(F.sequence(F.lit(1), F.size(tokens)), lambda i: F.exists(F.slice(tokens, F.lit(1), i), lambda t: ~t.isin(TYPES)))
    return F.when(F.size(kept) > 0, F.array_join(F.slice(tokens, F.get(kept, F.lit(0)), F.size(tokens)), "_")).otherwise(name)


def unified(names: DataFrame, drop_types: bool = False) -> DataFrame:
    """One name for all names of a definition: definition, names, unified.

    A definition wants the common prefix of its names, else the shortest. Definitions are served in the order of their number
    of names and their text: one whose wish is taken gets its shortest name that isn't, else its wish with __2, __3 and so on.
    That order is not walked: all ask at once, each name goes to the first that asks, and the others ask for their next
    choice, until none is turned away. As every name prefers the same order, the end is that of a walk. What is asked for
    with a number is at least as high as the number of those that come before and ask with one, so that n
    definitions of one wish take few rounds, not n.
    """
    rounds = Rounds(names.sparkSession)
    groups = by_definition(names)
    first = lambda c: F.transform(F.array_sort(F.transform(c, lambda n: F.struct(F.char_length(n).alias("l"), n.alias("n")))), lambda x: x.n)
    forms = F.transform("names", untyped) if drop_types else F.col("names")
    wish = F.when(F.size("names") == 1, F.get("names", F.lit(0))).otherwise(F.coalesce(F.nullif(common_prefix(forms), F.lit("")), F.get(first(F.col("names")), F.lit(0))))
    asking = rounds.kept(groups.select("definition", "names", wish.alias("wish"), first(F.col("names")).alias("others")).select("*", F.lit(0).alias("at")))
    order = F.struct(F.size("names"), "definition")
    while True:
        n = F.size("others")
        ahead = F.row_number().over(Window.partitionBy("wish", F.col("at") > n).orderBy(F.size("names"), "definition")) - 1
        at = F.when(F.col("at") > n, F.greatest("at", n + 1 + ahead)).otherwise(F.col("at"))
        asking = asking.withColumn("at", at)
        asked = F.when(F.col("at") == 0, F.col("wish")).when(F.col("at") <= n, F.get("others", F.col("at") - 1)).otherwise(F.concat("wish", F.lit("__"), F.col("at") - n + 1))
        asking = asking.withColumn("unified", asked).withColumn("_order", order)
        winners = asking.groupBy("unified").agg(F.min("_order").alias("_first"))
        met = asking.join(winners, "unified").withColumn("lost", F.col("_order") != F.col("_first"))
        asking = rounds.kept(met.select("definition", "names", "wish", "others", (F.col("at") + F.col("lost").cast("int")).alias("at"), "unified", "lost"))
        if asking.filter("lost").isEmpty():
            break
        asking = asking.drop("unified", "lost")
    out = asking.select("definition", "names", "unified")
    rounds.close(asking)
    return out


def filled(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """Blank cells take the last cell above that isn't blank, within a table ``key`` in its row order; then TOTAL rows go.

    The fill runs over all rows first, so a TOTAL row's cells carry on; a column isn't reset when another changes.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({c: F.last(F.nullif(strip(F.col(c)), F.lit("")), ignorenulls=True).over(w) for c in columns})
    return out.filter(F.upper(F.coalesce(F.col(columns[0]), F.lit(""))) != "TOTAL")


def resolved(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Names resolved in tiers: equal, equal but for case and outer white space (the first of several), the only known name that contains it; else null.

    ``known`` (known) is a catalogue; its size decides how the names are brought together.
    """
    a, low = asked.select("name").distinct(), F.lower(strip(F.col("name")))
    fit = a.join(known.select("known").distinct(), F.lower("known").contains(low) | (F.col("known") == F.col("name")))
    tier = F.when(F.col("known") == F.col("name"), 1).when(F.lower("known") == low, 2).otherwise(3)
    fit = fit.withColumn("tier", tier).groupBy("name", "tier").agg(F.min("known").alias("known"), F.count("*").alias("n"))
    fit = fit.filter("tier < 3 or n = 1").groupBy("name").agg(F.min_by("known", "tier").alias("known"))
    return a.join(fit, "name", "left")


def recoded(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """``column`` with its values replaced by their labels (value, label; a row a value); values without a label stay."""
    found = labels.select(F.col("value").alias(column), "label")
    return df.join(found, column, "left").withColumn(column, F.coalesce("label", column)).drop("label").select(*df.columns)


def category_report(found: DataFrame) -> DataFrame:
    """category, names and several of ``categorized`` rows (name, category): how many names each has, and how many of these have others too."""
    per = found.distinct().groupBy("name").agg(F.count("*").alias("n"))
    return found.distinct().join(per, "name").groupBy("category").agg(F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("several"))
