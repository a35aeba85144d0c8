"""The driver's tables seen as solver results and suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows that a task sorts and groups: the number of tasks grows with the table, their memory doesn't.
TASK_ROWS = 250_000


def tasks(rows: DataFrame) -> int:
    """So many tasks that each has about TASK_ROWS of the rows, and at least one a core."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """problem, category, instance, solver, status, objective, place: one row for each line item, which has its place in its order.

    The rows are dealt by problem and instance to as many tasks as their number asks for; windows and groups of instances keep that.
    """
    n = tasks(table(spark, sf_dir, "lineitem"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_extendedprice", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("flags"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    problem, flags = F.col("o_orderpriority"), F.col("flags")
    category = F.when(problem == "1-URGENT", "SAT").when(problem == "2-HIGH", "MAX").otherwise("MIN")
    status = F.when(flags == "NO", "S").when(flags == "RF", "SC").when(flags == "RO", "UNK").when(flags == "AF", "ERR").when(flags == "AO", "C").when(flags == "NF", "S")
    joined = lines.repartition(n, "l_orderkey").join(orders, lines.l_orderkey == orders.o_orderkey)
    return joined.select(
        problem.alias("problem"),
        category.alias("category"),
        F.col("o_orderkey").cast("string").alias("instance"),
        F.concat(F.lit("s"), "l_suppkey").alias("solver"),
        status.alias("status"),
        F.when(status.isin("UNK", "ERR"), None).otherwise(F.col("l_extendedprice")).alias("objective"),
        F.col("l_linenumber").alias("place"),
    ).repartition(n, "problem", "instance")


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """provider, model, variant, temperature, problem, instance, top3: an order's three largest suppliers by quantity.

    Orders without line items have an empty list, every 97th order has none.
    """
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_suppkey")
    top = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity").withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    lists = top.groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "l_suppkey"))), lambda x: F.concat(F.lit("s"), x.l_suppkey)).alias("found"))
    key = F.col("o_orderkey")
    top3 = F.when(key % 97 == 0, None).otherwise(F.coalesce("found", F.array().cast("array<string>")))
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .join(lists, key == F.col("l_orderkey"), "left")
        .select(F.col("r_name").alias("provider"), F.col("c_mktsegment").alias("model"), F.concat(F.lit("v"), (key % 4).cast("string")).alias("variant"), (key % 5 / 10).alias("temperature"), F.col("o_orderpriority").alias("problem"), key.cast("string").alias("instance"), top3.alias("top3"))
    )
