"""The driver's tables seen as results: how they are dealt to tasks."""

from pyspark.sql import functions as F

from sievework.operators import adapters
from sievework.operators.scoring import score


def test_tasks_grow_with_the_table_and_keep_instances_whole(spark, tmp_path, monkeypatch):
    """A task sorts and groups a bounded number of rows, whatever the number of shuffle partitions; the scores need no further shuffle."""
    k = F.col("id")
    lines = spark.range(4000).select((k / 4).cast("long").alias("l_orderkey"), (k % 9).alias("l_suppkey"), (k % 7).cast("double").alias("l_extendedprice"), (k % 4).alias("l_linenumber"), F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1000).select(k.alias("o_orderkey"), F.lit("3-MEDIUM").alias("o_orderpriority")).write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(adapters, "TASK_ROWS", 200)
    scored = score(adapters.results(spark, str(tmp_path)))
    per = scored.groupBy(F.spark_partition_id().alias("task"), "instance").count().collect()
    assert sum(r["count"] for r in per) == 4000 and len({r.instance for r in per}) == len(per) == 1000
    tasks = {}
    for r in per:
        tasks[r.task] = tasks.get(r.task, 0) + r["count"]
    assert len(tasks) == 20 and max(tasks.values()) < 2 * 200
