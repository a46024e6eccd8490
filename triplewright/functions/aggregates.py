"""Groupings, set operations and running sums that the graph operators share."""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triplewright.functions.vectors import double
from triplewright.operators.minimize import seeded_rank


def vector_sum(v: Column) -> Column:
    """Aggregate: the sum of vectors of one length, in one buffer of that length."""
    return vector_to_array(Summarizer.sum(array_to_vector(double(v))))


def vector_mean(v: Column) -> Column:
    """Aggregate: the mean of vectors of one length; null vectors don't count."""
    return vector_to_array(Summarizer.mean(array_to_vector(double(v))))


def mean_by(df: DataFrame, key: str, vector: str = "emb", into: str = "emb") -> DataFrame:
    """(key, into): the mean vector of each key; keys without a vector are left out."""
    return df.where(F.size(vector) > 0).groupBy(key).agg(vector_mean(F.col(vector)).alias(into))


def masked_mean(value: Column, mask: Column) -> Column:
    """Aggregate: the mean over rows where the mask is 1; 0 where there is none."""
    m = mask.cast("double")
    return F.sum(value * m) / F.greatest(F.sum(m), F.lit(1.0))


def any_of(mask: Column) -> Column:
    """Aggregate: whether any row has it."""
    return F.bool_or(mask)


def running_sum(df: DataFrame, key: str, order: str, value: str, into: str) -> DataFrame:
    """Add the sum of all rows of the key up to this one."""
    window = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(into, F.sum(value).over(window))


def listed(df: DataFrame, key: str, order: str, value: str, into: str) -> DataFrame:
    """(key, into): the values of each key as a list in the given order."""
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("x")))).alias("l"))
    return rows.select(key, F.transform("l", lambda e: e["x"]).alias(into))


def sorted_set(values: Column) -> Column:
    return F.array_sort(F.array_distinct(values))


def padded_list(values: Column, size: int, filler: Column) -> Column:
    """The first ``size`` items, filled up at the end."""
    return F.slice(F.concat(values, F.array_repeat(filler, size)), 1, size)


def list_items(df: DataFrame, values: str) -> DataFrame:
    """(items): how many items all lists have together; a null list has none."""
    return df.agg(F.coalesce(F.sum(F.greatest(F.size(values), F.lit(0)).cast("long")), F.lit(0).cast("long")).alias("items"))


def flattened(df: DataFrame, key: str, values: str, into: str) -> DataFrame:
    """(key, pos, into): a row for each item."""
    return df.select(key, F.posexplode(values).alias("pos", into))


def union_of(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct rows of ``a`` whose key ``b`` doesn't have."""
    return a.distinct().join(b.select(key), key, "left_anti")


def evaluation_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """(key): the n rows first by a seeded hash, without replacement. ``n`` is a report's size: the rows come together in one task."""
    return df.select(key).orderBy(seeded_rank([key], seed), key).limit(n)


def stop_words(spark: SparkSession, language: str = "english") -> DataFrame:
    """(word): the library's own list of a language."""
    return spark.createDataFrame([(w,) for w in sorted(set(StopWordsRemover.loadDefaultStopWords(language)))], "word string")


def word_counts(df: DataFrame, text: str, stops: DataFrame) -> DataFrame:
    """(word, n, stop): how often each word stands in all texts, and whether it is in ``stops`` (word), a list that every task can hold."""
    words = df.select(F.explode(F.split(text, " ")).alias("word")).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return words.join(F.broadcast(stops.select("word").distinct().withColumn("stop", F.lit(True))), "word", "left").select("word", "n", F.coalesce("stop", F.lit(False)).alias("stop"))
