"""A dataset manifest of Merkle trees, with proofs by coordinates.

Every row is a leaf. The leaves of a group, in order, are cut into runs of 16 whose digests make the next level, until one
node is left; the groups' roots, in order, make a tree in the same way. A node's place is (group, level, index), so which
siblings a leaf's proof needs follows from its index and its group's size: those coordinates are exploded, joined to the
table of nodes, ordered and put together. As the leaves of a run share all coordinates above it, these are exploded once
for each run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.shared import Scratch, hot_over, partitions, split_join

#: Nodes that become one node of the next level.
FAN = 16
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def part(c: Column) -> Column:
    """A value as a digest's input: '-' if null, else its bytes in UTF-8, ':' and its text."""
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def tampered(text: Column) -> Column:
    """A text with its A-Z in lower case."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def placed(df: DataFrame, group: str, order: list[Column], scratch: Scratch) -> DataFrame:
    """Add index (from 0, in ``order`` within ``group``) and size (the group's rows).

    Rows are dealt by ranges of group and order and numbered within their partition; a group's rows in earlier partitions,
    one count for each, are added. So a group of any size is numbered by many tasks. ``group`` is never null.
    """
    ranged = df.repartitionByRange(partitions(scratch.spark), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    ranged = scratch.keep(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    every = Window.partitionBy(group)
    before = F.sum("n").over(every.orderBy("_part")) - F.col("n")
    counts = scratch.keep(counts.select(group, "_part", "_first", "n", before.alias("_before"), F.sum("n").over(every).alias("size")), "counts")
    found = split_join(ranged, counts, [group, "_part"], hot_over(ranged.count()))
    return found.withColumn("index", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_before")


@dataclass
class Tree:
    """Trees of all groups: ``nodes`` has a run of nodes a row (group, level, run, size, children, digest), size the group's
    leaves; ``roots`` a row for each group (group, root); ``levels`` is the number of levels of the largest."""

    nodes: DataFrame
    roots: DataFrame
    levels: int


RUN = "group string, level int, run long, size long, children array<string>, digest string"


def grow(leaves: DataFrame, scratch: Scratch) -> Tree:
    """The trees over leaves (group, index, size, digest). A group of one leaf has no run and that leaf as its root.

    A level has a sixteenth of the rows of the one below, and each is written to the shared folder; runs, not groups, are
    dealt to tasks.
    """
    most = leaves.agg(F.max("size")).first()[0] or 0
    here = leaves.select("group", "index", "size", F.col("size").alias("left"), "digest")
    roots, nodes, level = here.filter("left = 1").select("group", F.col("digest").alias("root")), None, 0
    while most > FAN**level:
        runs = here.filter("left > 1").groupBy("group", F.expr(f"index div {FAN}").alias("run")).agg(F.first("size").alias("size"), F.first("left").alias("left"), F.sort_array(F.collect_list(F.struct("index", "digest"))).alias("c"))
        runs = runs.select("group", F.lit(level).alias("level"), "run", "size", "left", F.col("c.digest").alias("children"))
        kept = scratch.keep(runs.withColumn("digest", digest(F.array_join("children", ""))), f"level{level}")
        here = kept.select("group", F.col("run").alias("index"), "size", F.ceil(F.col("left") / FAN).cast("long").alias("left"), "digest")
        roots = roots.union(here.filter("left = 1").select("group", F.col("digest").alias("root")))
        kept = kept.drop("left")
        nodes = kept if nodes is None else nodes.union(kept)
        level += 1
    return Tree(scratch.spark.createDataFrame([], RUN) if nodes is None else nodes, roots, level)


def _siblings(children: Column, place: Column) -> Column:
    """The digests before and after a place, each side in one text."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), place), "").alias("before"), F.array_join(F.slice(children, place + 2, F.lit(FAN)), "").alias("after"))


def paths(leaves: DataFrame, tree: Tree, scratch: Scratch) -> DataFrame:
    """For each run of leaves: (group, run, size, children, above), above the siblings (before, after) of each level over it.

    The coordinates that a run needs above itself are exploded from its number and its group's size. How many runs ask for
    a node is known from the same figures, so nodes that very many ask for, those near a large group's root, are broadcast
    (2,000 at most) and the others joined.
    """
    runs = tree.nodes.filter("level = 0").select("group", "run", "size", "children")
    runs = runs.union(leaves.filter("size = 1").select("group", F.col("index"), "size", F.array("digest")))
    if tree.levels < 2:
        return runs.withColumn("above", F.array().cast("array<struct<before:string,after:string>>"))
    reach = lambda n: F.element_at(F.array(*(F.lit(FAN**k) for k in range(tree.levels + 1))), n + 1)
    above = F.filter(F.sequence(F.lit(1), F.lit(tree.levels - 1)), lambda n: F.col("size") > reach(n))
    asked = runs.select("group", "run", F.explode(above).alias("level"))
    asked = asked.select("group", F.col("run").alias("leaf_run"), "level", F.floor(F.col("run") / reach(F.col("level"))).cast("long").alias("run"), F.pmod(F.floor(F.col("run") / reach(F.col("level") - 1)), F.lit(FAN)).cast("int").alias("place"))
    below = reach(F.col("level"))
    nodes = tree.nodes.filter("level > 0").select("group", "level", "run", "children", F.least(below, F.ceil(F.col("size") / FAN) - F.col("run") * below).alias("n"))
    met = split_join(asked, nodes, ["group", "level", "run"], hot_over(asked.count()))
    met = met.select("group", F.col("leaf_run").alias("run"), F.struct("level", _siblings(F.col("children"), F.col("place")).alias("s")).alias("s"))
    found = met.groupBy("group", "run").agg(F.sort_array(F.collect_list("s")).alias("s")).select("group", "run", F.col("s.s").alias("above"))
    return runs.join(found, ["group", "run"], "left").withColumn("above", F.coalesce("above", F.array().cast("array<struct<before:string,after:string>>")))


def proved(leaves: DataFrame, runs: DataFrame) -> DataFrame:
    """``leaves`` (group, index, ...) with their runs' columns and proof: the siblings (before, after) level by level."""
    place = F.pmod("index", F.lit(FAN)).cast("int")
    own = F.when(F.col("size") > 1, F.array(_siblings(F.col("children"), place))).otherwise(F.array().cast("array<struct<before:string,after:string>>"))
    met = leaves.drop("size").withColumn("run", F.expr(f"index div {FAN}")).join(runs, ["group", "run"])
    return met.withColumn("proof", F.concat(own, "above")).drop("run", "children", "above")


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(proof, leaf, lambda h, s: digest(s.before, h, s.after))


def manifest(docs: DataFrame, scratch: Scratch, fields: list[str] | None = None, key: str = "doc_id", group: str = "source") -> DataFrame:
    """(key, leaf, changed, subroot, root, proof) of every row, proof the siblings (before, after) from leaf to root.

    Leaves hash ``fields`` and ascend by ``key`` within their ``group``; ``changed`` is the leaf after tampering, which
    lower-cases the text of rows whose key's crc32 is a multiple of 5, and otherwise the leaf. Null keys come first and
    are never tampered with; rows of equal key are ordered by their leaves, so equal rows may be told apart by nothing and each
    has a leaf of its own. A null group is a group, before all others; an empty group name is another. Empty tables give no
    rows. Texts of any length are hashed where they lie; only digests are moved. Other columns are ignored.
    """
    fields = fields or FIELDS
    leaf = digest(*(part(F.col(c)) for c in fields))
    hit = F.crc32(F.col(key).cast("string")) % 5 == 0
    other = F.when(hit, digest(*(part(tampered(F.col(c)) if c == "text" else F.col(c)) for c in fields))).otherwise(leaf)
    rows = docs.select(part(F.col(group)).alias("group"), F.col(group).alias("name"), F.col(key).alias("key"), leaf.alias("digest"), F.when(hit, other).alias("changed"))
    leaves = scratch.keep(placed(scratch.keep(rows, "leaves"), "group", [F.asc_nulls_first("key"), F.asc("digest")], scratch), "placed")
    tree = grow(leaves, scratch)
    names = leaves.groupBy("group").agg(F.first("name").alias("name"), F.first("size").alias("size"))
    tops = scratch.keep(tree.roots.join(names, "group").select(F.lit("").alias("all"), "group", "name", "size", F.col("root").alias("digest")), "tops")
    tops = placed(tops.withColumnsRenamed({"group": "of", "size": "n"}).withColumnRenamed("all", "group"), "group", [F.asc_nulls_first("name")], scratch)
    tops = scratch.keep(tops, "tops")
    crown = grow(tops, scratch)
    root = crown.roots.select("group", "root")  # one row
    tops = proved(tops, paths(tops, crown, scratch)).join(F.broadcast(root), "group")
    tops = scratch.keep(tops.select(F.col("of").alias("group"), F.ceil(F.col("n") / FAN).alias("n"), F.col("digest").alias("subroot"), "root", F.col("proof").alias("crown")), "crown")
    runs = scratch.keep(paths(leaves, tree, scratch), "runs")
    runs = split_join(runs, tops, ["group"], hot_over(runs.count()))
    found = proved(leaves, runs)
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), F.coalesce("changed", "digest").alias("changed"), "subroot", "root", F.concat("proof", "crown").alias("proof"))


def verified(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """``manifest``'s rows with a digest of the proof, the root that the (tampered) leaf leads to, and whether it is the root."""
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: F.concat(s.before, s.after)), ""), 256)
    out = found.select(key, "leaf", "subroot", "root", proof.alias("proof_sha256"), folded(F.col("proof"), F.col("changed")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
