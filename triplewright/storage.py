"""Shared scratch storage: where a plan is cut, and how the cut is cleaned up.

A cut is a Parquet table in the folder that the cluster names in
``spark.checkpoint.dir``. Every executor and the driver can reach it, so a lost
executor costs a re-read and never a recomputation of an iterative lineage.
Tables that a returned plan still reads go when the program ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table, as the optimizer estimates it, for each range partition; estimates over the last bound are no estimates.
BYTES_PER_RANGE, NO_ESTIMATE = 64 << 20, 1 << 60
_roots: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a temporary one serves a local master; a cluster must name its own."""
    told = spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="triplewright-"))
    return context.getCheckpointDir().rstrip("/")


def partitions_for(df: DataFrame) -> int:
    """Range partitions that grow with the table: its estimated size over BYTES_PER_RANGE, the session's shuffle partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, -(-size // BYTES_PER_RANGE)) if size < NO_ESTIMATE else least


class Scratch:
    """Tables written by one operator call; ``drop`` removes those no plan reads any more, the end of the program all."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self.turn = 0
        if not _roots:
            atexit.register(_drop_roots)
        _roots.append((spark, self.root))

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write ``df`` and return a reader of the written table."""
        return self.open(self.put(df, name, **options), df)

    def put(self, df: DataFrame, name: str, **options: str) -> str:
        self.turn += 1
        path = f"{self.root}/{self.turn:03d}-{name}"
        df.write.options(**options).parquet(path)
        return path

    def open(self, path: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(path)

    def drop(self, *paths: str) -> None:
        for path in paths:
            delete(self.spark, path)


class Buckets:
    """Rows with an ``id`` in a folder, dealt by it into buckets: groupings and joins by id read them without an exchange.

    A bucket is one file for each time that rows are added. The folder is registered in the session's catalog under a name of its own.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, buckets: int):
        self.spark, self.path, self.buckets, self.name = spark, path, buckets, f"buckets_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({schema}) USING parquet CLUSTERED BY (id) INTO {buckets} BUCKETS LOCATION '{path}'")

    def add(self, df: DataFrame) -> None:
        df.repartition(self.buckets, "id").write.insertInto(self.name)

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self, drop: bool = True) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        if drop:
            delete(self.spark, self.path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _drop_roots() -> None:
    """Remove what operator calls of this program left; a session that has ended can't, and its cluster's folder is for it to empty."""
    for spark, root in _roots:
        try:
            delete(spark, root)
        except Exception:  # noqa: BLE001 - the gateway to a stopped session raises whatever it was doing
            return
