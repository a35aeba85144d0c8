"""Suggestion and result documents: nested JSON whose keys are data, flattened into rows.

The levels above the leaf are decoded as maps of JSON text, level by level, so that a level that isn't an object
is passed over and a leaf that isn't one gives a row of nulls, whatever the other files hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.enums import TIME_KEYS, TOP3_KEYS
from sievework.functions.text import names, number, strip

MAP = "map<string, string>"


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """file, text of each JSON file of a folder, or of one file; an error if there is none."""
    return spark.read.text(path, wholetext=True, pathGlobFilter="*.json").select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def _level(df: DataFrame, name: str) -> DataFrame:
    """Explode the object in ``text`` into ``name`` and ``text``; what isn't an object has no rows."""
    keep = [c for c in df.columns if c != "text"]
    entries = F.expr("map_filter(coalesce(from_json(text, 'map<string, string>'), map()), (k, v) -> k is not null)")
    return df.filter(F.col("text").rlike(r"^\s*\{")).select(*keep, F.explode(entries).alias(name, "text"))


def _first_key(leaf: Column, keys: tuple[str, ...]) -> Column:
    """The value of the first key that is present, null or not."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for k in keys:
        out = out.when(F.map_contains_key(leaf, k), F.try_element_at(leaf, F.lit(k)))
    return out


def suggestions(files: DataFrame) -> DataFrame:
    """file, provider, model, problem, instance, top3, top1, time_seconds of each (file, text).

    A list of names may be a JSON list or text split at commas and semicolons.
    """
    rows = files.select("file", "text")
    for level in ("provider", "model", "problem", "instance"):
        rows = _level(rows, level)
    leaf = F.when(F.col("text").rlike(r"^\s*\{"), F.from_json("text", MAP))
    rows = rows.withColumn("leaf", leaf)
    raw = _first_key(F.col("leaf"), TOP3_KEYS)
    listed = F.when(raw.rlike(r"^\s*\["), F.from_json(raw, "array<string>")).otherwise(F.when(F.length(strip(raw)) > 0, names(raw)))
    rows = rows.withColumn("top3", listed)
    return rows.select("file", "provider", "model", "problem", "instance", "top3", F.get("top3", F.lit(0)).alias("top1"), number(_first_key(F.col("leaf"), TIME_KEYS)).alias("time_seconds"))


def results(files: DataFrame) -> DataFrame:
    """file, problem, category, instance, solver, status, time, objective, score, score_incomplete, score_area of each (file, text).

    Among a problem's entries, 'category' is text and the others are lists of rows whose values are all text.
    """
    problems = _level(files.select("file", "text"), "problem")
    entries = F.from_json("text", MAP)
    rows = problems.select("file", "problem", F.try_element_at(entries, F.lit("category")).alias("category"), F.explode(F.map_filter(entries, lambda k, v: k != "category")).alias("instance", "text"))
    row = F.from_json("text", "array<map<string, string>>")
    rows = rows.select("file", "problem", "category", "instance", F.explode(row).alias("r"))
    get = lambda k: F.try_element_at("r", F.lit(k))
    return rows.select("file", "problem", "category", "instance", get("Solver").alias("solver"), get("Status").alias("status"), *(number(get(k)).alias(k.lower().replace(" ", "_")) for k in ("Time", "Objective", "Score", "Score Incomplete", "Score Area")))


def merged(*documents: DataFrame) -> DataFrame:
    """Result rows of several documents, the first first; a problem's category is the first that isn't empty."""
    out = None
    for k, d in enumerate(documents):
        part = d.withColumn("_order", F.lit(k))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    first = out.filter(F.coalesce(strip(F.col("category")), F.lit("")) != "").groupBy("problem").agg(F.min_by("category", "_order").alias("_category"))
    return out.join(first, "problem", "left").withColumn("category", F.col("_category")).drop("_category", "_order")


def catalogue(files: DataFrame) -> DataFrame:
    """key, description, script, script_commented, top3_solvers of each problem catalogue (file, text)."""
    entry = F.from_json("text", "description string, script string, script_commented string, top3_solvers array<string>")
    return _level(files.select("file", "text"), "key").select("key", entry.alias("e")).select("key", "e.*")


def flat_map(files: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """The entries of a flat JSON object; of one with 'mapping', the entries of that."""
    m = F.from_json("text", MAP)
    inner = F.when(F.map_contains_key(m, "mapping"), F.from_json(F.try_element_at(m, F.lit("mapping")), MAP)).otherwise(m)
    return files.select(F.explode(inner).alias(key, value))


def models(files: DataFrame) -> DataFrame:
    """id, place, size, owner and active of each model of a list {"data": [...]}; a missing window is null."""
    data = F.from_json("text", "data array<struct<id: string, owned_by: string, active: boolean, context_window: bigint>>").data
    return files.select(F.posexplode(data).alias("place", "m")).select("m.id", "place", F.col("m.context_window").alias("size"), F.col("m.owned_by").alias("owner"), "m.active")


def limits(files: DataFrame) -> DataFrame:
    """model, rpm, rpd, tpm, tpd of each entry of groq_models and gemini_models, whichever the file has."""
    row = "array<struct<model_id: string, model: string, rpm: bigint, rpd: bigint, tpm: bigint, tpd: bigint>>"
    found = F.from_json("text", f"groq_models {row}, gemini_models {row}")
    both = F.concat(F.coalesce(found.groq_models, F.array()), F.coalesce(found.gemini_models, F.array()))
    return files.select(F.inline(both)).select(F.coalesce("model_id", "model").alias("model"), "rpm", "rpd", "tpm", "tpd")


def categories(files: DataFrame) -> DataFrame:
    """category, member, description, pos and source of {"categories": {category: {name: text}}, "multi_category": {name: {categories, description}}, "uncategorized": {name: text}}.

    The three parts come in this order, and each pair of member and category once, at its first place (pos). Uncategorized members
    have the category Uncategorized. ``memberships`` gathers these by member.
    """
    kind = "categories map<string, map<string, string>>, multi_category map<string, struct<categories: array<string>, description: string>>, uncategorized map<string, string>"
    m = files.select(F.from_json("text", kind).alias("m"))
    empty = F.lit(None).cast("string")
    plain = m.select(F.posexplode("m.categories").alias("p", "category", "members")).select("category", F.posexplode("members").alias("q", "member", "description"), F.lit(0).alias("source"), "p")
    many = m.select(F.posexplode("m.multi_category").alias("p", "member", "v")).select(F.posexplode("v.categories").alias("q", "category"), "member", F.col("v.description").alias("description"), F.lit(1).alias("source"), "p")
    none = m.select(F.posexplode("m.uncategorized").alias("p", "member", "description")).select(F.lit("Uncategorized").alias("category"), "member", F.coalesce("description", empty).alias("description"), F.lit(2).alias("source"), "p", F.lit(0).alias("q"))
    every = plain.unionByName(many).unionByName(none).withColumn("pos", F.struct("source", "p", "q"))
    return every.groupBy("category", "member").agg(F.min_by("description", "pos").alias("description"), F.min("pos").alias("pos"))


def memberships(found: DataFrame) -> DataFrame:
    """member, categories (in order), description (the first that isn't empty) and multi, of ``categories``."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "category"))), lambda x: x.category)
    first = F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.col("pos")))
    out = found.groupBy("member").agg(ordered.alias("categories"), first.alias("description"))
    return out.withColumn("multi", F.size("categories") > 1)


def scripts(problems: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Add ``path`` and ``content`` of each problem's ``script`` from the table of files (path, text).

    Tried in turn: below the root without a leading './', as an absolute path, below the root as it is, and by its bare name, the first
    path in order. A script that begins with './' but has no file has an error text; any other script is its own content.
    """
    relative = F.col("script").startswith("./")
    below = F.concat(F.lit(root.rstrip("/") + "/"), F.regexp_replace("script", r"^\./", ""))
    keyed = problems.withColumn("_id", F.monotonically_increasing_id())
    tries = keyed.select("_id", F.posexplode(F.array(below, F.when(F.col("script").startswith("/"), F.col("script")), F.concat(F.lit(root.rstrip("/") + "/"), "script"))).alias("_rank", "path"))
    hit = tries.join(files.select("path"), "path").select("_id", "_rank", "path")
    base = files.select(F.substring_index("path", "/", -1).alias("_base"), "path").groupBy("_base").agg(F.min("path").alias("path"))
    walked = keyed.select("_id", F.substring_index("script", "/", -1).alias("_base")).join(base, "_base").select("_id", F.lit(3).alias("_rank"), "path")
    best = hit.union(walked).groupBy("_id").agg(F.min_by("path", "_rank").alias("path"))
    out = keyed.drop("path", "content").join(best, "_id", "left").join(files.select("path", F.col("text").alias("_text")), "path", "left")
    error = F.concat(F.lit("[Error reading "), "script", F.lit(": no such file]"))
    content = F.when(~relative, F.col("script")).otherwise(F.coalesce("_text", error))
    return out.select(*[c for c in problems.columns if c not in ("path", "content")], "path", content.alias("content"))


def variant_of(file: Column) -> dict[str, Column]:
    """What a suggestion file's name says: its variant without the temperature, and the temperature."""
    from sievework.functions.text import temperature

    return {"variant": F.regexp_replace(F.regexp_replace(file, r"\.json$", ""), r"_?T\d+(?:[p.]\d+)?", ""), "temperature": temperature(file)}


def first_existing(spark: SparkSession, *paths: str | None) -> str | None:
    """The first of several paths that is there, asked of the file system that each path names; null if none is."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path:
            at = jvm.org.apache.hadoop.fs.Path(path)
            if at.getFileSystem(conf).exists(at):
                return path
    return None


def optional_map(spark: SparkSession, *paths: str | None) -> DataFrame | None:
    """The entries (key, value) of the first path that is there; null if none is, or if it holds no JSON object.

    The first path that exists counts even if it can't be read: the others aren't tried.
    """
    if (path := first_existing(spark, *paths)) is None:
        return None
    text = json_files(spark, path)
    valid = text.filter((F.substring(strip(F.col("text")), 1, 1) == "{") & F.try_parse_json("text").isNotNull())
    return flat_map(text) if valid.head(1) else None
