"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators of hashed one- and two-token grams are scaled by the log-count ratio
of the two classes; a linear hinge-loss model is fitted to them by dual
coordinate descent. Fitting takes a sample of labelled rows that is bounded in
rows and characters (``SAMPLE``, ``SAMPLE_CHARS``); every row is scored, whole text.

Null text counts as empty and gets the score of the intercept. Of repeated or
contradicting labels of an id the highest counts; null labels don't count.
Without labels of both classes every score is 0.5. Repeated rows score equally and
teach once. An empty table gives an empty one.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable, text_steps
from triplewright.llm.chunks import ChunkTable, worker_cache

#: Labelled rows that the model is fitted on, about: rows whose hashed id falls below the matching share.
SAMPLE = 5000
#: Characters of those rows, about; a sample with more is thinned out by hash.
SAMPLE_CHARS = 100_000_000
#: Hashed grams; what is sent to executors is one float for each.
DIMS = 1 << 18
#: A row is predicted 1 from this score on.
CUT = 0.3
#: Fitting: smoothing of counts, cost of a violation, most rounds, and what a margin of 1 means as log odds.
SMOOTH, COST, ROUNDS, ODDS = 1.0, 1.0, 30, 3.0
#: One in FOLDS rows, by crc32 of the id as text, is held out.
FOLDS = 5
#: The last dimensions are no grams: shares of two-token grams met before in the text, in tenths.
SHARES = 11

TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def token_table() -> ChunkTable:
    """Stretches between spaces to the hashes of their tokens."""

    def learn(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = [TOKEN.findall(c) for c in chunks]
        return np.array([zlib.crc32(t.encode("utf-8")) for f in found for t in f], np.uint32), np.array([len(f) for f in found], np.int64)

    held = worker_cache()
    if "tokens" not in held:
        held["tokens"] = ChunkTable(learn)
    return held["tokens"]


def indicators(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row of each indicator, its dimension): distinct in a row, rows ascending."""
    tokens, lengths, _ = token_table().encode([(t or "").replace("\n", " ").split(" ") for t in texts])
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), lengths)
    room = DIMS - SHARES
    ones = row * np.uint64(DIMS) + tokens % np.uint32(room)
    pair = (tokens[:-1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tokens[1:]) >> np.uint64(20)
    twos = (row[:-1] * np.uint64(DIMS) + pair % np.uint64(room))[row[:-1] == row[1:]]
    two_keys = distinct(twos, len(texts))
    total = np.maximum(lengths - 1, 0)
    tenths = np.where(total > 0, (total - rows_in(two_keys, len(texts))) * (SHARES - 1) // np.maximum(total, 1), 0)
    shares = np.arange(len(texts), dtype=np.int64) * DIMS + room + tenths
    keys = distinct(np.concatenate([ones, two_keys, shares.astype(np.uint64)]), len(texts)).astype(np.int64)
    return keys // DIMS, keys % DIMS


def distinct(keys: np.ndarray, rows: int) -> np.ndarray:
    """Ascending distinct keys of row * DIMS + dimension; narrow integers sort much faster."""
    keys = np.sort(keys.astype(np.uint32) if rows * DIMS < 1 << 32 else keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def rows_in(keys: np.ndarray, rows: int) -> np.ndarray:
    """How many ascending keys each row has."""
    return np.diff(np.searchsorted(keys, np.arange(rows + 1, dtype=np.uint64) * np.uint64(DIMS)))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """log of smoothed indicator shares, class 1 over class 0; 0 for dimensions that no row has."""
    counts = [np.full(DIMS, SMOOTH), np.full(DIMS, SMOOTH)]
    for x, y in zip(rows, labels.tolist(), strict=True):
        counts[y][x] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    ratio[(counts[0] == SMOOTH) & (counts[1] == SMOOTH)] = 0
    return ratio


def fit(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(weight of each dimension, its squared log-count ratio, intercept) from indicator lists and labels of 0 and 1."""
    weights = np.zeros(DIMS)
    if len(set(labels.tolist())) < 2:
        return weights, weights, 0.0
    ratio = log_count_ratio(rows, labels)
    values = [ratio[x] for x in rows]
    values = [v / max(float(np.linalg.norm(v)), 1e-9) for v in values]
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, len(labels) / (2 * max(int((labels == 1).sum()), 1)), len(labels) / (2 * max(int((labels == 0).sum()), 1)))
    alpha, bias, order = np.zeros(len(rows)), 0.0, np.random.default_rng(7)
    for _ in range(ROUNDS):
        worst = 0.0
        for i in order.permutation(len(rows)).tolist():
            x, v, y, most = rows[i], values[i], sign[i], COST * share[i]
            slope = y * (float(weights[x] @ v) + bias) - 1
            held = min(slope, 0.0) if alpha[i] <= 0 else max(slope, 0.0) if alpha[i] >= most else slope
            if abs(held) > 1e-9:
                worst = max(worst, abs(held))
                new = min(max(alpha[i] - slope / 2.0, 0.0), most)  # each row and its constant have norm 1
                step, alpha[i] = (new - alpha[i]) * y, new
                weights[x] += step * v
                bias += step
        if worst < 1e-3:
            break
    return weights * ratio, ratio**2, bias


def score_texts(texts: list[str | None], weights: np.ndarray, squares: np.ndarray, bias: float) -> np.ndarray:
    row, dim = indicators(texts)
    total = np.bincount(row, weights[dim], len(texts))
    norm = np.sqrt(np.bincount(row, squares[dim], len(texts)))
    return 1 / (1 + np.exp(-ODDS * np.clip(total / np.maximum(norm, 1e-9) + bias, -50, 50)))


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample_of(labels: DataFrame, id_col: str, label_col: str, most: int) -> DataFrame:
    """(id, label) of about ``most`` ids outside the held-out fold, chosen by hash. Bounded, so it can be broadcast."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    per_id = usable.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    there = usable.count()
    share = min(1 << 30, (most << 30) // max(there, 1))
    return per_id.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """(weights, squared log-count ratios, intercept) from a bounded sample of labelled rows."""
    chosen = sample_of(labels, id_col, label_col, sample)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "text")).dropDuplicates(["doc_id", "tie"])
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    if chars > SAMPLE_CHARS:
        rows = rows.where(F.pmod("tie", F.lit(1 << 30)) < (SAMPLE_CHARS << 30) // chars)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches):
            row, dim = indicators(texts)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(dim.astype(np.int32)))], ["doc_id", "label", "dims"])

    found = map_batches(rows.select("doc_id", "text", "label"), kernel, "doc_id long, label int, dims array<int>").toArrow()
    dims = [np.asarray(x.values) for x in found.column("dims")]
    order = sorted(range(len(dims)), key=lambda k: (found.column("doc_id")[k].as_py(), dims[k].tobytes()))
    y = np.array([found.column("label")[k].as_py() for k in order], np.int64)
    weights, squares, bias = fit([dims[k] for k in order], y)
    return weights.astype(np.float32), squares.astype(np.float32), bias


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from CUT on): one row for each input row."""
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col, label_col, sample))  # two floats a dimension

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(texts, *model.value))], ["doc_id", "score"])

    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(source, kernel, "doc_id long, score double").select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted")
    )


def keep_good(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """The rows of ``df``, all columns, that are predicted 1."""
    model = df.sparkSession.sparkContext.broadcast(train(df, labels, id_col, text_col, label_col, sample))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_steps(batches, text_col):
            yield batch.filter(pa.array(score_texts(texts, *model.value) >= CUT))

    return map_batches(df, kernel, df.schema)


portable(__name__)
