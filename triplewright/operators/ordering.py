"""Places of rows in the order of a column, without a task that sees all rows.

Rows are dealt by ranges and written with the number of their range; counts of the
written ranges give the place at which each begins. Both are read from that one
table: planned twice, ranges would be sampled and coalesced twice and differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.storage import Scratch, partitions_for


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    """Add __place (from 0) and __all, the number of rows."""
    scratch = Scratch(df.sparkSession, "placed")
    keys = [f"__o{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(keys, order, strict=True)))
    held = scratch.keep(keyed.repartitionByRange(partitions_for(df), *keys).withColumn("__p", F.spark_partition_id()), "ranges")
    sizes = held.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    base = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__base"), F.sum("__n").over(Window.partitionBy(F.lit(0))).alias("__all"))
    row = F.row_number().over(Window.partitionBy("__p").orderBy(*keys))
    out = held.withColumn("__r", row).join(F.broadcast(base), "__p")
    return out.withColumn("__place", (F.col("__base") + F.col("__r") - 1).cast("long")).drop("__p", "__r", "__base", *keys)


def ranked(df: DataFrame, by: str, into: str = "idx") -> DataFrame:
    """Dense ids from 0 in the order of a distinct key; other columns stay as they are."""
    return _placed(df, [F.col(f"`{by}`")]).withColumnRenamed("__place", into).drop("__all")


def chunked(df: DataFrame, order: Column | str, chunks: int) -> DataFrame:
    """Add ``chunk``: contiguous pieces of ceil(n / chunks) rows in the given order, perhaps fewer pieces than asked for.

    Rows of equal order go by a hash of the whole row, so that a common value is dealt
    over ranges too. An empty table gives an empty one.
    """
    col = F.col(f"`{order}`") if isinstance(order, str) else order
    whole = F.xxhash64(*[F.col(f"`{c}`") for c, kind in df.dtypes if "map<" not in kind])
    size = F.ceil(F.col("__all") / chunks)
    return _placed(df, [col, whole]).withColumn("chunk", F.floor(F.col("__place") / size).cast("long")).drop("__place", "__all")
