"""Tab-separated graph files. Lines are stripped of white space before they are
split, tabs inside quotes count, and lines with too few fields fall away.

Where an id occurs more than once the last line wins; ``append=True`` joins the
lists of all its lines instead. A line's place comes from ``line`` if the table
has such a column, else from a monotonic id, which follows file order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions.text import strip
from triplewright.storage import partitions_for


def fields(df: DataFrame) -> DataFrame:
    line = F.col("line") if "line" in df.columns else F.monotonically_increasing_id()
    return df.select(line.alias("line"), F.split(strip(F.col("value")), "\t", -1).alias("parts"))


def parse_triples(df: DataFrame, strict: bool = False) -> DataFrame:
    """(h, r, t), a bag, of the lines with exactly three fields; ``strict`` raises on any other line."""
    parts = F.split(strip(F.col("value")), "\t", -1)
    rows = df.select(parts.alias("p"))
    if strict:
        rows = rows.select(F.when(F.size("p") == 3, F.col("p")).otherwise(F.raise_error(F.lit("a line without three fields"))).alias("p"))
    return rows.where(F.size("p") == 3).select(F.col("p")[0].alias("h"), F.col("p")[1].alias("r"), F.col("p")[2].alias("t"))


def parse_descriptions(df: DataFrame, stop: bool = False) -> DataFrame:
    """(entity_id, text): the second field of the last line of each id. ``stop`` reads up to the first line with too few fields, as an older reader does."""
    rows = fields(df)
    if stop:
        bad = rows.where(F.size("parts") < 2).agg(F.min("line").alias("bad"))  # one row
        rows = rows.crossJoin(F.broadcast(bad)).where(F.col("bad").isNull() | (F.col("line") < F.col("bad")))
    rows = rows.where(F.size("parts") >= 2)
    return rows.groupBy(F.col("parts")[0].alias("entity_id")).agg(F.max_by(F.col("parts")[1], "line").alias("text"))


def parse_lists(df: DataFrame, key: str = "entity_id", append: bool = False) -> DataFrame:
    """(key, aliases): all fields after the first, of the last line of each id or of all its lines."""
    rows = fields(df).where(F.size("parts") >= 2).select(F.col("parts")[0].alias(key), "line", F.slice("parts", 2, F.size("parts")).alias("names"))
    if not append:
        return rows.groupBy(key).agg(F.max_by("names", "line").alias("aliases"))
    in_order = F.array_sort(F.collect_list(F.struct("line", "names")))
    return rows.groupBy(key).agg(F.flatten(F.transform(in_order, lambda x: x["names"])).alias("aliases"))


def line_stats(df: DataFrame) -> DataFrame:
    """(lines, heads): number of lines and of distinct first fields."""
    return fields(df).agg(F.count(F.lit(1)).alias("lines"), F.countDistinct(F.col("parts")[0]).alias("heads"))


def write_table(df: DataFrame, path: str, mode: str = "skip") -> DataFrame:
    """Write ``df`` to ``path`` and read it: ``skip`` leaves a table that is there, ``overwrite`` replaces it, ``error`` raises."""
    if mode not in ("skip", "overwrite", "error"):
        raise ValueError(mode)
    if mode != "skip" or not exists(df.sparkSession, path):
        df.write.mode({"overwrite": "overwrite"}.get(mode, "errorifexists")).parquet(path)
    return df.sparkSession.read.parquet(path)


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path``; ``make()`` is written there first if there is none."""
    return spark.read.parquet(path) if exists(spark, path) else write_table(make(), path)


def read_strict(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path``; an error names the path if there is none."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def write_lines(df: DataFrame, path: str, column: str, *order: str) -> None:
    """A text sink: one column as lines, in ``order`` within and across files."""
    ranged = df.repartitionByRange(partitions_for(df), *order).sortWithinPartitions(*order) if order else df
    ranged.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def vector_table(df: DataFrame, vector: str = "emb") -> DataFrame:
    """The same columns with the vector as array<float>, as tensors are kept on disk."""
    return df.withColumn(vector, F.col(vector).cast("array<float>"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def missing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Preflight: the paths that aren't there."""
    return [p for p in paths if not exists(spark, p)]


def checked_tables(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(name, there, n): preflight of named tables; a missing one has no number of rows."""
    gone, out = set(missing(spark, list(paths.values()))), None
    for name, path in paths.items():
        rows = spark.range(1).select(F.lit(None).cast("long").alias("n")) if path in gone else spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
        one = rows.select(F.lit(name).alias("name"), F.lit(path not in gone).alias("there"), "n")
        out = one if out is None else out.unionAll(one)
    return out


class Graph:
    """The tables of a prepared graph under one folder; ``minimized`` picks the cut-down copies."""

    NAMES = ("triples_train", "triples_valid", "triples_test", "descriptions", "aliases", "relations", "silver_spans")
    PARSERS = {**dict.fromkeys(NAMES[:3], parse_triples), "descriptions": parse_descriptions, "aliases": parse_lists, "relations": lambda df: parse_lists(df, "relation_id")}

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str, minimized: bool = False) -> str:
        if name not in self.NAMES:
            raise KeyError(name)
        return f"{self.folder}/{'minimized' if minimized else 'full'}/{name}"

    def table(self, name: str, minimized: bool = False) -> DataFrame:
        return read_strict(self.spark, self.path(name, minimized))

    def put(self, name: str, df: DataFrame, minimized: bool = False, mode: str = "overwrite") -> DataFrame:
        return write_table(df, self.path(name, minimized), mode)

    def parsed(self, name: str, raw: str) -> DataFrame:
        """The table, parsed from the lines of the file ``raw`` if it isn't there."""
        return read_or_make(self.spark, self.path(name), lambda: self.PARSERS[name](self.spark.read.text(raw)))

    def cache_all(self, raw: dict[str, str]) -> list[str]:
        """Parse and write every table of ``raw`` (name to file) that isn't there; the names written."""
        new = [name for name in raw if not exists(self.spark, self.path(name))]
        for name in new:
            self.parsed(name, raw[name])
        return new

    def missing(self, minimized: bool = False) -> list[str]:
        return missing(self.spark, [self.path(n, minimized) for n in self.NAMES])

    def register(self, minimized: bool = False) -> None:
        """Temporary views of every table there is."""
        for name in self.NAMES:
            if exists(self.spark, self.path(name, minimized)):
                self.table(name, minimized).createOrReplaceTempView(name)
