"""Work in rounds: what a round leaves is written to the shared folder, which cuts lineage and survives lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
#: Whether both sides of a join must be partitioned by all of its columns.
ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a local session without that setting gets one of its own, a cluster an error."""
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sievework-")
    return _own[app]


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, which goes when the driver ends: what is returned lazily can be read until then."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def dealt_to(spark: SparkSession) -> int:
    """Partitions, and buckets, that rows are dealt to by a key."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


class Rounds:
    """Tables of one run; ``close`` deletes those that its result doesn't read, the rest goes when the driver ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count, self.paths = spark, new_folder(spark, "rounds"), 0, set()

    def kept(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._kept_path = path
        self.paths.add(path)
        return out

    def kept_by(self, df: DataFrame, key: str, dealt: bool = False) -> DataFrame:
        """Keep ``df`` in buckets of ``key``. While it is made, joins on ``key`` and more columns take the partitions by ``key`` that
        their sides have already, from such buckets, and shuffle nothing. ``dealt`` says that its rows come in partitions by
        ``key`` that Spark doesn't know of, from behind Python. The catalog has the table for a moment only."""
        self.count += 1
        path, n, table = f"{self.root}/{self.count}", dealt_to(self.spark), f"sievework_{uuid.uuid4().hex}"
        writer = (df if dealt else df.repartition(n, key)).write.option("path", path)
        before = self.spark.conf.get(ALL_KEYS)
        self.spark.conf.set(ALL_KEYS, "false")
        try:
            writer.bucketBy(n, key).saveAsTable(table)
        finally:
            self.spark.conf.set(ALL_KEYS, before)
        out = self.spark.table(table)
        self.spark.sql(f"drop table {table}")  # its files stay, and the frame knows where they are
        out._kept_path = path
        self.paths.add(path)
        return out

    def close(self, *needed: DataFrame) -> None:
        stay = {x._kept_path for x in needed}
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths - stay:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
