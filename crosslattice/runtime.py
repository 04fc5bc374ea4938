"""Session helpers: tables in the shared folder, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A key with at least so many rows on the long side of a lookup is taken out of the shuffle.
HOT_ROWS = 100_000
#: At most so many keys are broadcast by a lookup, whatever the size of the data.
MAX_HOT_KEYS = 2_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's. A folder of our own only on this machine alone, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="crosslattice-")
        spark.sparkContext.setCheckpointDir(at)
    return at


class Scratch:
    """Tables written to the shared folder to cut lineage.

    They outlive lost executors, are read column by column, and have known sizes, so AQE plans
    later joins well. ``drop`` removes a table that nothing reads any more; the others go when
    the process ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._remove, self.root)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may be gone by now
            pass

    def save(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """Write df; give it back as a table, with its row count and the named aggregates."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in figures.items()]).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out, seen.get

    def gather(self, tables: list[DataFrame]) -> DataFrame | None:
        """Saved tables of one schema as one scan, however many they are; none of none."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._scratch_path for t in tables]) if tables else None

    def drop(self, *tables: DataFrame | None) -> None:
        for t in tables:
            if t is not None and getattr(t, "_scratch_path", None):
                self._remove(t._scratch_path)


def tasks(spark: SparkSession) -> int:
    """Partitions of a stage whose work is far greater than its bytes: stated, so that AQE does not fold them into a few by size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def nonblank(c: Column) -> Column:
    """Holds a character that is no white space; null counts as blank."""
    return F.coalesce(c.rlike(r"\S"), F.lit(False))


def lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", rows: int | None = None, hot_rows: int = HOT_ROWS, max_hot: int = MAX_HOT_KEYS) -> DataFrame:
    """Join ``left`` to ``right``, whose ``key`` is unique, without sending a hot key to one task.

    Keys with ``hot_rows`` rows or more (the ``max_hot`` largest of them) are looked up by
    broadcast, which is bounded by ``max_hot`` rows; all other keys go by an ordinary join. Where
    the caller knows that ``left`` has no more than ``hot_rows`` rows, the plain join is used:
    a whole key then fits one task. Null keys match nothing.
    """
    if rows is not None and rows <= hot_rows:
        return left.join(right, key, how)
    hot = left.groupBy(key).count().filter((F.col("count") >= hot_rows) & F.col(key).isNotNull()).orderBy(F.desc("count"), key).limit(max_hot).select(key)
    few = right.join(F.broadcast(hot), key, "left_semi")
    a = left.join(F.broadcast(few), key, "inner")
    cold = left.join(F.broadcast(hot), key, "left_anti") if how == "inner" else left.join(F.broadcast(few.select(key)), key, "left_anti")
    return a.unionByName(cold.join(right, key, how))
