"""Training of the span model's linear heads, a checkpoint for each epoch.

The gradient of an epoch is one aggregation over all tokens, a vector sum for each
kind; that is what reaches the driver, where Adam takes a step. The state of each
epoch is written, and a run goes on from the latest it finds.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import vectors as V
from triplewright.functions.aggregates import vector_sum
from triplewright.sources.lines import exists, read_strict
from triplewright.storage import Scratch

STATE = "epoch int, kind string, dim int, weight double, m double, v double"


def epoch_path(folder: str, epoch: int) -> str:
    return f"{folder}/epoch-{epoch:04d}"


def latest_epoch(spark: SparkSession, folder: str) -> int:
    """The last epoch with a whole checkpoint, or -1; earlier ones may be gone. Part files of a broken write don't count: Spark marks a finished one."""
    if not exists(spark, folder):
        return -1
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(where)]  # a run's epochs
    found = [int(n.removeprefix("epoch-")) for n in names if n.startswith("epoch-")]
    return max((n for n in found if exists(spark, f"{epoch_path(folder, n)}/_SUCCESS")), default=-1)


def same_settings(spark: SparkSession, folder: str, settings: dict, **first: int) -> dict:
    """Write the settings of a run into its folder; a folder that a run of other settings made is refused. Of ``first`` the values of the run's first call are returned."""
    path = f"{folder}/settings"
    if exists(spark, f"{path}/_SUCCESS"):
        held = json.loads(spark.read.text(path).first()[0])
        if held["settings"] != settings:
            raise ValueError(f"{folder} was made with {held['settings']}, not {settings}")
        return held["first"]
    text = json.dumps({"settings": settings, "first": first}, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return first


def _token_rows(tokens: DataFrame, labels: DataFrame) -> tuple[DataFrame, int]:
    """(x, kinds): a token's vector with a 1 at its end, and its labels; and how many there are."""
    marks = labels.groupBy("entity_id", "pos").agg(F.collect_set("kind").alias("kinds"))
    rows = tokens.join(marks, ["entity_id", "pos"], "left").select(F.concat(V.double(F.col("emb")), F.array(F.lit(1.0))).alias("x"), F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
    rows = Scratch(tokens.sparkSession, "heads").keep(rows, "tokens")
    return rows, max(rows.count(), 1)


def _token_pulls(rows: DataFrame, state: dict, kinds: list[str], dims: int, pos_weight: float) -> dict:
    pulls = []
    for k in kinds:
        y = F.array_contains("kinds", k).cast("double")
        p = V.sigmoid(V.dot(F.col("x"), F.array(*[F.lit(state[k, d][0]) for d in range(dims + 1)])))
        pulls.append(((1 - y) * p - y * pos_weight * (1 - p)).alias(f"pull_{k}"))
    pulled = rows.select("x", *pulls)
    return pulled.agg(*[vector_sum(V.scale(F.col("x"), F.col(f"`pull_{k}`"))).alias(k) for k in kinds]).first().asDict() if kinds else {}


def _marked(tokens: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(x, marks) of rows (entity_id, x): a description's vectors one after the other, and its labels as (kind, pos)."""
    if labels is None:
        return tokens.select("x", "marks")
    held = labels.groupBy("entity_id").agg(F.collect_list(F.struct("kind", "pos")).alias("marks"))  # a text's tokens and kinds at most
    return tokens.select("entity_id", "x").join(held, "entity_id", "left").select("x", "marks")


def _pulls(rows: DataFrame, weights: np.ndarray, kinds: list[str], pos_weight: float) -> DataFrame:
    """(kind, g): the slopes of every kind's head, summed over the tokens of rows (x, marks) in a batch of them, and then over batches."""
    dims, place = weights.shape[1] - 1, {k: i for i, k in enumerate(kinds)}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ends = np.cumsum([(n or 0) // dims for n in batch.column(0).value_lengths().to_pylist()])
            y = np.zeros((len(x), len(kinds)), bool)
            for end, begin, marks in zip(ends, [0, *ends], batch.column(1).to_pylist(), strict=False):
                for mark in marks or ():
                    if 0 <= mark["pos"] < end - begin and mark["kind"] in place:
                        y[begin + mark["pos"], place[mark["kind"]]] = True
            p = 1 / (1 + np.exp(-(x @ weights[:, :-1].T + weights[:, -1])))
            pull = np.where(y, -pos_weight * (1 - p), p)
            g = np.column_stack([pull.T @ x, pull.sum(axis=0)])
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(g.tolist(), pa.list_(pa.float64()))], ["kind", "g"])

    return rows.mapInArrow(kernel, "kind string, g array<double>").groupBy("kind").agg(vector_sum(F.col("g")).alias("g"))


def train_heads(tokens: DataFrame, labels: DataFrame, dims: int, folder: str, epochs: int = 100, rate: float = 1e-4, pos_weight: float = 1.0) -> DataFrame:
    """(epoch, kind, dim, weight, m, v) after the last epoch; dim = dims is the bias.

    ``tokens``: (entity_id, pos, emb). ``labels``: (entity_id, kind, pos), sparse; tokens without one are negatives of every kind.
    ``tokens`` of a row a description (entity_id, x) need no exchange where they bring their labels as ``marks`` (kind, pos), without ``labels``.
    """
    spark, held = tokens.sparkSession, "x" in tokens.columns
    if held:
        rows = Scratch(spark, "heads").keep(_marked(tokens, labels), "tokens")
        named = rows.select(F.explode("marks").alias("m")).select("m.kind")
        n = max(rows.agg(F.sum(F.greatest(F.size("x"), F.lit(0)) / dims).cast("long")).first()[0] or 0, 1)
    else:
        named = labels.select("kind")
    kinds = sorted(r["kind"] for r in named.distinct().collect())  # a handful of label kinds
    if not held:
        rows, n = _token_rows(tokens, labels)
    last = latest_epoch(spark, folder)
    state = {(k, d): (0.0, 0.0, 0.0) for k in kinds for d in range(dims + 1)}
    if last >= 0:
        saved = read_strict(spark, epoch_path(folder, last))
        state |= {(r["kind"], r["dim"]): (r["weight"], r["m"], r["v"]) for r in saved.collect()}  # the model's own size
    for epoch in range(last + 1, epochs):
        if held:
            weights = np.array([[state[k, i][0] for i in range(dims + 1)] for k in kinds]).reshape(len(kinds), dims + 1)
            got = {r["kind"]: r["g"] for r in _pulls(rows, weights, kinds, pos_weight).collect()}  # the model's own size
        else:
            got = _token_pulls(rows, state, kinds, dims, pos_weight)
        after = []
        for (k, d), (w, m, v) in state.items():
            g = got[k][d] / n if got.get(k) else 0.0
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9 ** (epoch + 1))) / (math.sqrt(v / (1 - 0.999 ** (epoch + 1))) + 1e-8)
            state[k, d] = w, m, v
            after.append((epoch, k, d, w, m, v))
        spark.createDataFrame(after, STATE).coalesce(1).write.mode("overwrite").parquet(epoch_path(folder, epoch))
    return spark.read.schema(STATE).parquet(epoch_path(folder, max(last, epochs - 1)))
