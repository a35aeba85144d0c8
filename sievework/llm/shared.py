"""What the corpus operators share: input tables, the shared folder, batches of texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.rounds import new_folder
from sievework.shipping import ship

#: Characters that one vectorised step works on at most, but for a single longer text.
CHUNK_CHARS = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables written to the shared folder, which cuts lineage and survives lost executors; they go when the driver ends, or by ``clear``."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.root, self.count = spark, new_folder(spark, name), 0

    def path(self, name: str = "t") -> str:
        self.count += 1
        return f"{self.root}/{self.count}-{name}"

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def keep_by(self, df: DataFrame, key: str, name: str = "t", shuffled: bool = True) -> DataFrame:
        """Keep ``df`` in buckets of ``key``: later joins on it move the other side alone. The catalog has it for a moment only.

        A key that few tasks share needs no shuffle first: each task writes its rows to their buckets."""
        path, n = self.path(name), partitions(self.spark)
        table = f"sievework_{name}_{uuid.uuid4().hex}"
        writer = (df.repartition(n, key) if shuffled else df).write.option("compression", "zstd").option("path", path)
        writer.bucketBy(n, key).saveAsTable(table)
        kept = self.spark.table(table)
        self.spark.sql(f"drop table {table}")  # its files stay, and the frame knows where they are
        kept._scratch_path = path
        return kept

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing will read again."""
        for df in frames:
            self.remove(df._scratch_path)

    def clear(self) -> None:
        """Delete all of this scratch's tables."""
        self.remove(self.root)

    def release(self) -> None:
        """Let Spark remove the shuffle files of finished jobs now: it does so when the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_join(many: DataFrame, one: DataFrame, on: list[str], hot: int) -> DataFrame:
    """``many`` joined to ``one``, which has a row a key and, in ``n``, how many rows of ``many`` have that key.

    The rows of keys with more than ``hot`` rows stay where they are and meet a broadcast of those keys; there are fewer
    of these than the rows of ``many`` divided by ``hot``. The others are shuffled. Both frames are read twice: kept tables.
    """
    often = one.filter(F.col("n") > hot).drop("n")
    rest = one.filter(F.col("n") <= hot).drop("n")
    return many.join(F.broadcast(often), on).unionByName(many.join(F.broadcast(often.select(*on)), on, "left_anti").join(rest, on))


def hot_over(rows: int) -> int:
    """From so many rows on a key is worked on apart: at most 2,000 keys can have more."""
    return max(100, rows // 2000)


def chunks(texts: list[str], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``limit`` characters each; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def pieces(batches, rows: int = 1000):
    """Batches of fewer rows, so that their texts are Python objects for a short time only."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift so that every bit of the input moves every bit of the result."""
    x = x.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x
