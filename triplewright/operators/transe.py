"""Translation embeddings of a graph: ids, negatives, scores, hinge loss, training.

The state of a run is one row an id, in buckets by id, and a log of later versions in
the same buckets: the latest version is found, and met, without an exchange. A step
reads the ids of its own batch and writes them alone. Every other vector still moves
in a dense optimiser, by its moments; what it missed is made up for when a step meets it
next, or at the end, turn by turn in the same arithmetic, so that the result is the dense
one. A log as large as the state is merged into a new one, and an epoch's end always
merges: two states and a log are on disk at most. Spark joins, groups and exchanges the
vectors; their arithmetic is made in Arrow kernels, a matrix for each batch of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import vectors as V
from triplewright.functions.aggregates import vector_sum
from triplewright.operators.minimize import portable_hash
from triplewright.operators.ordering import ranked
from triplewright.operators.training import epoch_path, latest_epoch, same_settings
from triplewright.sources.lines import exists, vector_table, write_table
from triplewright.storage import Buckets, Scratch, delete

#: Batches of an epoch: large ones, as each is a pass of the cluster.
STEPS = 8
DIM, MARGIN, RATE, EPOCHS = 100, 1.0, 1e-3, 90
#: Rows of the state in a bucket, if that makes more buckets than shuffle partitions.
ROWS_PER_BUCKET = 200_000
STATE = "id long, turn int, emb array<double>, m array<double>, v array<double>"


def id_maps(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity_id, idx) and (relation_id, idx): dense ids in sorted order."""
    entities = triples.select(F.col("h").alias("entity_id")).union(triples.select("t")).distinct()
    relations = triples.select(F.col("r").alias("relation_id")).distinct()
    return ranked(entities, "entity_id"), ranked(relations, "relation_id")


def encode(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(h_idx, r_idx, t_idx), a bag."""
    heads = entities.select(F.col("entity_id").alias("h"), F.col("idx").alias("h_idx"))
    tails = entities.select(F.col("entity_id").alias("t"), F.col("idx").alias("t_idx"))
    rels = relations.select(F.col("relation_id").alias("r"), F.col("idx").alias("r_idx"))
    return triples.join(heads, "h").join(tails, "t").join(rels, "r").select("h_idx", "r_idx", "t_idx")


def negatives(encoded: DataFrame, n_entities: int, epoch: int = 0, seed: int = 0) -> DataFrame:
    """Add nh_idx, nr_idx, nt_idx: head or tail, by a hashed coin, replaced by a hashed entity. Repeatable; new for each epoch."""
    key = F.concat_ws("#", "h_idx", "r_idx", "t_idx", F.lit(str(epoch)), F.lit(str(seed)))
    coin, other = portable_hash(F.concat(F.lit("c"), key)) % 2, portable_hash(F.concat(F.lit("e"), key)) % n_entities
    return encoded.withColumns({"nh_idx": F.when(coin == 1, other).otherwise(F.col("h_idx")), "nr_idx": F.col("r_idx"), "nt_idx": F.when(coin == 0, other).otherwise(F.col("t_idx"))})


def dealt(encoded: DataFrame, epoch: int, shards: int) -> DataFrame:
    """Add ``shard``: each epoch deals the triples anew, by hash."""
    return encoded.withColumn("shard", portable_hash(F.concat_ws("#", "h_idx", "r_idx", "t_idx", F.lit(str(epoch)))) % shards)


def initial(ids: DataFrame, n: int, dims: int = DIM, seed: int = 0) -> DataFrame:
    """Add ``emb``: uniform within sqrt(6 / (n + dims)), from hashes of id and position."""
    edge = (6.0 / (n + dims)) ** 0.5
    value = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: (portable_hash(F.concat_ws("#", F.col("idx"), k, F.lit(str(seed)))) / float(1 << 32) * 2 - 1) * edge)
    return ids.withColumn("emb", value)


def distance(h: Column, r: Column, t: Column, p: int = 1) -> Column:
    return V.norm(V.minus(V.plus(h, r), t), p)


def scores(pairs: DataFrame, entities: DataFrame, relations: DataFrame, p: int = 1) -> DataFrame:
    """Add pos and neg distances; ``entities`` and ``relations`` have idx and emb."""
    out = pairs
    for column, table in (("h_idx", entities), ("t_idx", entities), ("nh_idx", entities), ("nt_idx", entities), ("r_idx", relations)):
        out = out.join(table.select(F.col("idx").alias(column), V.double(F.col("emb")).alias(f"v_{column}")), column)
    out = out.withColumns({"pos": distance(F.col("v_h_idx"), F.col("v_r_idx"), F.col("v_t_idx"), p), "neg": distance(F.col("v_nh_idx"), F.col("v_r_idx"), F.col("v_nt_idx"), p)})
    return out.select(*pairs.columns, "pos", "neg")


def hinge(scored: DataFrame, batches: int = 1, margin: float = MARGIN) -> DataFrame:
    """(loss): the sum over hashed batches of each batch's mean hinge."""
    batch = portable_hash(F.concat_ws("#", "h_idx", "r_idx", "t_idx")) % batches
    held = scored.groupBy(batch.alias("batch")).agg(F.avg(F.greatest(F.lit(0.0), margin + F.col("pos") - F.col("neg"))).alias("loss"))
    return held.agg(F.sum("loss").alias("loss"))


def start_state(entities: DataFrame, relations: DataFrame, n_entities: int, n_relations: int, dims: int = DIM, seed: int = 0) -> DataFrame:
    """(id, turn, emb, m, v): initial vectors and Adam's moments. Entities have their index as id, relations -1 less theirs."""
    none = F.array_repeat(F.lit(0.0), dims)
    own = initial(entities.select("idx"), n_entities, dims, seed).select(F.col("idx").cast("long").alias("id"), "emb")
    other = initial(relations.select("idx"), n_relations, dims, seed + 1).select((-1 - F.col("idx")).cast("long").alias("id"), "emb")
    return own.unionByName(other).select("id", F.lit(0).alias("turn"), "emb", none.alias("m"), none.alias("v"))


def named(state: DataFrame) -> DataFrame:
    """The state with kind ("e" or "r") and idx."""
    return state.withColumns({"kind": F.when(F.col("id") < 0, "r").otherwise("e"), "idx": F.when(F.col("id") < 0, -1 - F.col("id")).otherwise(F.col("id"))})


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix; a null is a row of zeros."""
    flat, there = column.flatten().to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
    whole = flat.reshape(int(there.sum()), -1) if len(flat) else np.zeros((0, 0))
    if there.all():
        return whole
    out = np.zeros((len(there), whole.shape[1]))
    out[there] = whole
    return out


def _vectors(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.reshape(-1), pa.float64()))


def _length(rows: np.ndarray, p: int) -> np.ndarray:
    return np.abs(rows).sum(axis=1, keepdims=True) if p == 1 else np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _unit(rows: np.ndarray, p: int) -> np.ndarray:
    return rows / np.maximum(_length(rows, p), 1e-12)


def slopes(pairs: DataFrame, state: DataFrame, margin: float = MARGIN, p: int = 1) -> DataFrame:
    """(kind, idx, g): the summed slopes of the hinge of every pair, by the vectors that it moves.

    Each vector's sum is taken in each batch of pairs, and then in one aggregation buffer,
    merged before the shuffle, so that a relation of all triples costs no more than one of a few.
    """
    out, ends = pairs, [("h_idx", "e"), ("t_idx", "e"), ("nh_idx", "e"), ("nt_idx", "e"), ("r_idx", "r")]
    for column, kind in ends:
        out = out.join(state.where(F.col("kind") == kind).select(F.col("idx").alias(column), F.col("emb").alias(f"v_{column}")), column)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (h, t, nh, nt, r), (vh, vt, vnh, vnt, vr) = ([f(batch.column(k)) for k in places] for f, places in ((lambda x: x.to_numpy(), range(5)), (_matrix, range(5, 10))))
            good, bad = vh + vr - vt, vnh + vr - vnt
            live = (margin + _length(good, p) - _length(bad, p) > 0)[:, 0]
            up, down = (np.sign(x[live]) if p == 1 else _unit(x[live], p) for x in (good, bad))
            for kind, who, g in (("e", (h, t, nh, nt), (up, -up, -down, down)), ("r", (r,), (up - down,))):
                idx, at = np.unique(np.concatenate([x[live] for x in who]), return_inverse=True)
                sums = np.zeros((len(idx), good.shape[1]))
                np.add.at(sums, at, np.concatenate(g))
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(idx), pa.string()), pa.array(idx, pa.int64()), _vectors(sums)], ["kind", "idx", "g"])

    rows = out.select(*[F.col(c).cast("long") for c, _ in ends], *[V.double(F.col(f"v_{c}")).alias(f"v_{c}") for c, _ in ends])
    return rows.mapInArrow(kernel, "kind string, idx long, g array<double>").groupBy("kind", "idx").agg(vector_sum(F.col("g")).alias("g"))


def _moved(ids: np.ndarray, emb: np.ndarray, m: np.ndarray, v: np.ndarray, turn: int, rate: float, unit: dict[str, int]) -> np.ndarray:
    """``emb`` after Adam's step with these moments; vectors of the kinds in ``unit`` get length 1 by that norm."""
    out = emb - rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
    for kind, p in unit.items():
        own = ids < 0 if kind == "r" else ids >= 0
        out[own] = _unit(out[own], p)
    return out


def _stepped(rows: DataFrame, until: int, step: Callable[..., tuple[np.ndarray, np.ndarray, np.ndarray]]) -> DataFrame:
    """The state at turn ``until``, of ``step`` over the columns of ``rows``: ids and turns as numbers, vectors as matrices."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, turns = (batch.column(k).to_numpy() for k in (0, 1))
                after = step(ids, turns, *(_matrix(x) for x in batch.columns[2:]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(ids), until), pa.int32()), *map(_vectors, after)], ["id", "turn", "emb", "m", "v"])

    return rows.mapInArrow(kernel, STATE)


def made_up(state: DataFrame, until: int, rates: list[float], unit: dict[str, int]) -> DataFrame:
    """The state as a dense optimiser has it after turn ``until``: what rows missed since their own turn are steps without a slope."""
    if until == 0:
        return state

    def step(ids: np.ndarray, turns: np.ndarray, emb: np.ndarray, m: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        emb, m, v = emb.copy(), m.copy(), v.copy()
        for turn in range(int(turns.min()) + 1, until + 1):
            late = turns < turn
            m[late], v[late] = m[late] * 0.9, v[late] * 0.999
            emb[late] = _moved(ids[late], emb[late], m[late], v[late], turn, rates[turn - 1], unit)
        return emb, m, v

    return _stepped(state.select("id", "turn", "emb", "m", "v"), until, step)


def adam(met: DataFrame, sums: DataFrame, n: int, turn: int, rate: float, unit: dict[str, int]) -> DataFrame:
    """One step over the rows of ``met`` (made up to the turn before), those without a slope too."""
    joined = named(met).join(sums, ["kind", "idx"], "left")

    def step(ids: np.ndarray, turns: np.ndarray, emb: np.ndarray, m: np.ndarray, v: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g = (g if g.size else np.zeros_like(emb)) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        return _moved(ids, emb, m, v, turn, rate, unit), m, v

    return _stepped(joined.select("id", "turn", "emb", "m", "v", "g"), turn, step)


class _State:
    """One row an id in ``base``, and later versions of some in ``log``."""

    def __init__(self, scratch: Scratch, base: Buckets):
        self.scratch, self.base, self.logged, self.times = scratch, base, 0, 0
        self.size = base.rows().count()
        self._open()

    def _open(self) -> None:
        self.times += 1
        self.log = Buckets(self.base.spark, f"{self.scratch.root}/log-{self.times:05d}", STATE, self.base.buckets)
        self.logged = 0

    def latest(self) -> DataFrame:
        if not self.logged:
            return self.base.rows()
        new = self.log.rows().groupBy("id").agg(F.max_by(F.struct("turn", "emb", "m", "v"), "turn").alias("new"))
        held = self.base.rows().select("id", F.struct("turn", "emb", "m", "v").alias("old")).join(new, "id", "left")
        return held.select("id", F.coalesce("new", "old").alias("x")).select("id", "x.*")

    def add(self, rows: DataFrame, n: int) -> None:
        self.log.add(rows)
        self.logged += n
        if self.logged >= self.size:
            self.merge(f"{self.scratch.root}/state-{self.times:05d}")

    def merge(self, path: str) -> None:
        if exists(self.base.spark, path):
            delete(self.base.spark, path)
        after = Buckets(self.base.spark, path, STATE, self.base.buckets)
        after.add(self.latest())
        self.log.forget()
        self.base.forget()
        self.base = after
        self._open()


def batch_ids(batch: DataFrame) -> DataFrame:
    """(id): what a batch needs of the state."""
    ends = F.array(*[F.col(c).cast("long") for c in ("h_idx", "t_idx", "nh_idx", "nt_idx")], (-1 - F.col("r_idx")).cast("long"))
    return batch.select(F.explode(ends).alias("id")).distinct()


def train(encoded: DataFrame, entities: DataFrame, relations: DataFrame, n_entities: int, n_relations: int, dims: int = DIM, epochs: int = EPOCHS, steps: int = STEPS, rate: float = RATE, margin: float = MARGIN, seed: int = 0, folder: str | None = None, p: int = 1, unit: dict[str, int] | None = None, until: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Embeddings (idx, emb) of entities and relations.

    Each epoch deals the triples anew into ``steps`` batches, with new negatives; each
    batch is one Adam step of its mean hinge over all vectors, the rate annealed by a
    cosine over ``epochs``. Entities are scaled to unit length after each step. The
    state after the last whole epoch, moments included, is under ``folder``; a call with
    the same folder goes on from it and ends as if it had never stopped, and one with
    other settings is refused. ``until`` stops before that epoch.
    """
    spark = encoded.sparkSession
    scratch = Scratch(spark, "transe")
    root = folder or f"{scratch.root}/epochs"
    unit = {"e": 2} if unit is None else unit
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    settings = {"entities": n_entities, "relations": n_relations, "dims": dims, "epochs": epochs, "steps": steps, "rate": rate, "margin": margin, "seed": seed, "p": p, "unit": unit}
    buckets = same_settings(spark, root, settings, buckets=max(least, -(-(n_entities + n_relations) // ROWS_PER_BUCKET)))["buckets"]
    rates = [rate * 0.5 * (1 + math.cos(math.pi * epoch / max(epochs, 1))) for epoch in range(epochs) for _ in range(steps)]
    last = latest_epoch(spark, root)
    base = Buckets(spark, epoch_path(root, last) if last >= 0 else f"{scratch.root}/start", STATE, buckets)
    if last < 0:
        base.add(start_state(entities, relations, n_entities, n_relations, dims, seed))
    state = _State(scratch, base)
    encoded = scratch.keep(encoded, "encoded")
    ends = min(epochs, epochs if until is None else until)
    for epoch in range(last + 1, ends):
        path = f"{scratch.root}/pairs-{epoch:04d}"
        pairs = dealt(negatives(encoded, n_entities, epoch, seed), epoch, steps)
        pairs.repartition("shard", F.pmod(F.xxhash64("h_idx", "r_idx", "t_idx"), F.lit(16))).write.partitionBy("shard").parquet(path)
        pairs = spark.read.schema(pairs.schema).parquet(path)
        sizes = {r["shard"]: r["n"] for r in pairs.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # ``steps`` rows
        for step in range(steps):
            if not sizes.get(step):
                continue
            turn, batch = epoch * steps + step + 1, pairs.where(F.col("shard") == step)
            met_path = scratch.put(made_up(state.latest().join(batch_ids(batch), "id"), turn - 1, rates, unit), "met")
            met = spark.read.parquet(met_path)
            state.add(adam(met, slopes(batch, named(met), margin, p), sizes[step], turn, rates[turn - 1], unit), met.count())
            scratch.drop(met_path)
        state.merge(epoch_path(root, epoch))
        scratch.drop(path)
    state.log.forget()
    whole = named(made_up(spark.read.schema(STATE).parquet(state.base.path), max(ends, last + 1) * steps, rates, unit))
    state.base.forget(drop=False)
    return tuple(whole.where(F.col("kind") == k).select("idx", "emb") for k in ("e", "r"))


def train_legacy(encoded: DataFrame, entities: DataFrame, relations: DataFrame, n_entities: int, n_relations: int, **options) -> tuple[DataFrame, DataFrame]:
    """The older loop: 120 epochs, Euclidean distances, both tables scaled to unit length by their absolute sums."""
    return train(encoded, entities, relations, n_entities, n_relations, **({"epochs": 120, "p": 2, "unit": {"e": 1, "r": 1}} | options))


def save_relations(relations: DataFrame, ids: DataFrame, path: str) -> DataFrame:
    """Write (relation_id, emb) with single-precision vectors, and read it."""
    return write_table(vector_table(ids.join(relations, "idx").select("relation_id", "emb")), path, "overwrite")
