"""Training of the whole span model: entity heads, relation attention, fusion and conditioned heads of both directions.

The forward direction finds heads, then tails under semantic relations; the backward
one tails, then heads under graph relations. Descriptions are written once, one row each
(a model's length of tokens bounds it), dealt by hash into pieces. A step reads its
pieces alone: an Arrow kernel runs the model and its reverse-mode gradients over each
description and adds up one gradient a task; those are summed in a tree, by stretches of
the parameter vector, so that no task sees all gradients. What reaches the driver is
the model's own size; Adam steps there, and the weights go out as one broadcast.

Loss: the mean of eight terms (start and end; entity and conditioned; both
directions), each the mean over real tokens of the weighted cross-entropy. Conditioned
logits are sums of a slot's, a relation's and a token's part, so the largest over slots
and relations is the sum of the largest parts, and only the relation that was largest takes
a gradient. Spans are picked by threshold and take no gradient. A description
without a span has one slot of zeros; of equal parts the first counts, relations by id.

The weights and both moments of every epoch are written; a run goes on from the
last one as if it had not stopped, and refuses a folder that another setting made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplewright.functions import vectors as V
from triplewright.functions.aggregates import vector_sum
from triplewright.operators.extract import MOST_RELATIONS
from triplewright.operators.losses import positive_weights
from triplewright.operators.minimize import portable_hash
from triplewright.operators.training import epoch_path, latest_epoch, same_settings
from triplewright.sources.lines import read_strict
from triplewright.storage import Scratch

#: Kinds of labels that the entity heads and the conditioned heads of each direction learn.
DIRECTIONS = {"forward": ("h_s", "h_e", "t_s", "t_e"), "backward": ("t_s", "t_e", "h_s", "h_e")}
KINDS = DIRECTIONS["forward"]
#: Pieces for each step of an epoch: an epoch deals the pieces anew.
PIECES = 8
#: Parameters in a stretch; numbers of an attention tile (relations, tokens, attention size).
STRETCH, TILE = 65_536, 4_000_000
#: Groups of tasks whose gradients are summed apart, before the groups' sums are.
GROUPS = 32
STATE = "name string, weight array<double>, m array<double>, v array<double>"


def shapes(dims: int, attention: int, semantic: int, graph: int) -> dict[str, tuple[int, ...]]:
    """Every parameter by name; the last column of a matrix and the last number of a head is the bias."""
    out = {}
    for direction, size in (("forward", semantic), ("backward", graph)):
        own = {
            "entity_start": (dims + 1,), "entity_end": (dims + 1,), "attend_x": (attention, dims + 1), "attend_r": (attention, size + 1), "attend_g": (attention, dims + 1), "attend_v": (attention,),
            "fuse_s": (dims, dims + 1), "fuse_x": (dims, dims + 1), "conditioned_start": (dims + 1,), "conditioned_end": (dims + 1,),
        }
        out |= {f"{direction}.{k}": v for k, v in own.items()}
    return out


def initial_weights(form: dict[str, tuple[int, ...]], seed: int = 0) -> dict[str, np.ndarray]:
    """Uniform within one over the root of the inputs, from hashes of name and place: the same on any machine."""
    out = {}
    for name, shape in form.items():
        n, edge = math.prod(shape), 1 / math.sqrt(shape[-1] - (not name.endswith("attend_v")))
        hashed = np.array([int(hashlib.md5(f"{name}#{k}#{seed}".encode()).hexdigest()[:8], 16) for k in range(n)])
        out[name] = ((hashed / float(1 << 32) * 2 - 1) * edge).reshape(shape)
    return out


def _biased(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((*x.shape[:-1], 1))], axis=-1)


def _cross_entropy(z: np.ndarray, y: np.ndarray, weight: float) -> tuple[float, np.ndarray]:
    """Summed loss and its slope for each logit."""
    soft, chance = np.log1p(np.exp(-np.abs(z))), 1 / (1 + np.exp(-z))
    loss = (1 - y) * (np.maximum(z, 0) + soft) + y * weight * (np.maximum(-z, 0) + soft)
    return float(loss.sum()), (1 - y) * chance - y * weight * (1 - chance)


def paired(start: np.ndarray, end: np.ndarray, threshold: float, most: int | None) -> list[tuple[int, int]]:
    """Each start, ascending, with the least unused end from it on."""
    ends, out, used = np.flatnonzero(end >= threshold).tolist(), [], set()
    for s in np.flatnonzero(start >= threshold).tolist():
        e = next((e for e in ends if e >= s and e not in used and (most is None or e < s + most)), None)
        if e is not None:
            used.add(e)
            out.append((s, e))
    return out


def _attention(px: np.ndarray, shift: np.ndarray, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hidden, share of each token, context) of each relation row of ``shift``."""
    hidden = np.tanh(px[None] + shift[:, None])
    score = hidden @ v
    share = np.exp(score - score.max(axis=1, keepdims=True))
    share /= share.sum(axis=1, keepdims=True)
    return hidden, share, share @ x


def direction_slopes(w: dict[str, np.ndarray], x: np.ndarray, mean: np.ndarray, relations: np.ndarray, projected: np.ndarray, labels: list[np.ndarray], weights: list[float], threshold: float, most: int | None) -> tuple[float, dict[str, np.ndarray]]:
    """Summed loss of one direction on one description, and its gradient. ``relations`` are biased, ``projected`` is ``relations @ attend_r.T``."""
    slopes, size = {}, x.shape[1]
    x1, mean1 = _biased(x), _biased(mean)
    loss, chances = 0.0, []
    for k, name in enumerate(("entity_start", "entity_end")):
        z = x1 @ w[name]
        part, pull = _cross_entropy(z, labels[k], weights[k])
        loss, slopes[name] = loss + part, pull @ x1
        chances.append(1 / (1 + np.exp(-z)))
    spans = paired(*chances, threshold, most)
    slots = _biased(np.array([(x[s] + x[e]) / 2 for s, e in spans] or [np.zeros(size)]))
    fused_s, fused_x = slots @ w["fuse_s"].T, x1 @ w["fuse_x"].T + x
    px, shift = x1 @ w["attend_x"].T, projected + mean1 @ w["attend_g"].T
    heads = [w["conditioned_start"], w["conditioned_end"]]
    best: list[tuple[float, int]] = [(-math.inf, -1)] * 2
    step = max(1, TILE // max(px.size, 1))
    for low in range(0, len(shift), step):
        context = _attention(px, shift[low : low + step], w["attend_v"], x)[2]
        for k, u in enumerate(heads):
            value = context @ u[:-1]
            at = int(value.argmax())
            if value[at] > best[k][0]:
                best[k] = float(value[at]), low + at
    d_fused_s, d_fused_x = np.zeros_like(fused_s), np.zeros_like(fused_x)
    for name in ("attend_x", "attend_r", "attend_g", "attend_v"):
        slopes[name] = np.zeros_like(w[name])
    for k, (name, u) in enumerate(zip(("conditioned_start", "conditioned_end"), heads, strict=True)):
        of_slot, (of_relation, r) = fused_s @ u[:-1], best[k]
        slot = int(of_slot.argmax())
        part, pull = _cross_entropy(fused_x @ u[:-1] + of_slot[slot] + of_relation + u[-1], labels[2 + k], weights[2 + k])
        loss, whole = loss + part, pull.sum()
        hidden, share, context = (a[0] for a in _attention(px, shift[r : r + 1], w["attend_v"], x))
        slopes[name] = np.append(pull @ fused_x + whole * (fused_s[slot] + context), whole)
        d_fused_x += pull[:, None] * u[:-1]
        d_fused_s[slot] += whole * u[:-1]
        of_token = x @ (whole * u[:-1])
        d_score = share * (of_token - share @ of_token)
        slopes["attend_v"] += d_score @ hidden
        d_inner = d_score[:, None] * w["attend_v"] * (1 - hidden**2)
        d_shift = d_inner.sum(axis=0)
        slopes["attend_x"] += d_inner.T @ x1
        slopes["attend_r"] += np.outer(d_shift, relations[r])
        slopes["attend_g"] += np.outer(d_shift, mean1)
    slopes["fuse_s"], slopes["fuse_x"] = d_fused_s.T @ slots, d_fused_x.T @ x1
    return loss, slopes


def _kernel(held, relations, form: dict[str, tuple[int, ...]], weights: dict[str, float], threshold: float, most: int | None):
    """Rows (stretch, values) of one task: its summed gradient, and (loss, tokens) as stretch -1."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, dims = held.value, form["forward.entity_start"][0] - 1
        own = {d: {n.split(".")[1]: w[n] for n in form if n.startswith(d)} for d in DIRECTIONS}
        vectors = {d: _biased(relations.value[d]) for d in DIRECTIONS}
        projected = {d: vectors[d] @ own[d]["attend_r"].T for d in DIRECTIONS}
        total, loss, tokens = {n: np.zeros(shape) for n, shape in form.items()}, 0.0, 0
        for batch in batches:
            for at in range(batch.num_rows):
                x = batch.column(0)[at].values.to_numpy(zero_copy_only=False).reshape(-1, dims)
                mean = batch.column(1)[at].values.to_numpy(zero_copy_only=False)
                labels = {k: batch.column(2 + i)[at].values.to_numpy(zero_copy_only=False) for i, k in enumerate(KINDS)}
                tokens += len(x)
                for d, kinds in DIRECTIONS.items():
                    part, slopes = direction_slopes(own[d], x, mean, vectors[d], projected[d], [labels[k] for k in kinds], [weights[k] for k in kinds], threshold, most)
                    loss += part
                    for n, slope in slopes.items():
                        total[f"{d}.{n}"] += slope
        if tokens:
            flat = np.concatenate([total[n].reshape(-1) for n in form])
            stretches = [flat[k : k + STRETCH] for k in range(0, len(flat), STRETCH)]
            for k, values in [(-1, np.array([loss, tokens])), *enumerate(stretches)]:
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([values], pa.list_(pa.float64()))], ["stretch", "values"])

    return kernel


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """The sum of each stretch: first over groups of tasks, then over the groups."""
    some = parts.withColumn("group", F.spark_partition_id() % GROUPS).groupBy("stretch", "group").agg(vector_sum(F.col("values")).alias("values"))
    whole = some.groupBy("stretch").agg(vector_sum(F.col("values")).alias("values"))
    return {r["stretch"]: np.array(r["values"]) for r in whole.collect()}  # the model's own size


def described(tokens: DataFrame, means: DataFrame | None, labels: DataFrame) -> DataFrame:
    """(entity_id, x, mean, and for each kind a 0 or 1 for each token): x holds the tokens' vectors one after the other. ``tokens`` may be such rows (entity_id, x, mean), without ``means``."""
    marks = labels.groupBy("entity_id").agg(*[F.collect_set(F.when(F.col("kind") == k, F.col("pos"))).alias(k) for k in KINDS])
    if "x" in tokens.columns:
        whole = tokens.select("entity_id", "x", "mean").join(marks, "entity_id", "left")
        place = F.sequence(F.lit(0), (F.size("x") / F.size("mean")).cast("int") - 1)
        return whole.select("entity_id", "x", "mean", *[F.transform(place, lambda i: F.coalesce(F.array_contains(F.col(k), i), F.lit(False)).cast("double")).alias(k) for k in KINDS])  # noqa: B023 - called at once
    toks = tokens.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct("pos", V.double(F.col("emb")).alias("emb")))).alias("t"))
    rows = toks.join(means.select("entity_id", V.double(F.col("emb")).alias("mean")), "entity_id").join(marks, "entity_id", "left")

    def hot(kind: str) -> Column:
        return F.transform("t", lambda t: F.coalesce(F.array_contains(F.col(kind), t["pos"]), F.lit(False)).cast("double")).alias(kind)

    return rows.select("entity_id", F.flatten(F.transform("t", lambda t: t["emb"])).alias("x"), "mean", *map(hot, KINDS))


def _vectors(relations: DataFrame) -> np.ndarray:
    """Relation vectors in the order of their ids; they are broadcast, so there must be few."""
    rows = relations.select("relation_id", V.double(F.col("emb")).alias("emb")).orderBy("relation_id").limit(MOST_RELATIONS + 1).collect()
    if not 0 < len(rows) <= MOST_RELATIONS:
        raise ValueError(f"training takes 1 to {MOST_RELATIONS} relations")
    return np.array([r["emb"] for r in rows])


def train_span_model(
    tokens: DataFrame, means: DataFrame | None, labels: DataFrame, semantic: DataFrame, graph: DataFrame, folder: str, attention: int = 256, epochs: int = 100, steps: int = 8,
    rate: float = 1e-4, threshold: float = 0.5, most: int | None = 10, seed: int = 0, until: int | None = None,
) -> DataFrame:
    """(epoch, loss, name, weight, m, v) after the last epoch: flat weights and Adam's moments of each parameter.

    ``tokens``: (entity_id, pos, emb), ``means``: (entity_id, emb), ``labels``: (entity_id, kind, pos), sparse; ``semantic`` and
    ``graph``: (relation_id, emb). An epoch takes ``steps`` Adam steps; its loss is the sum of theirs. ``until`` stops before that epoch.
    """
    spark, scratch = tokens.sparkSession, Scratch(tokens.sparkSession, "spans")
    vectors = {"forward": _vectors(semantic), "backward": _vectors(graph)}
    pieces = PIECES * steps if steps > 1 else 1
    rows = described(tokens, means, labels).withColumn("piece", (portable_hash(F.concat_ws("#", "entity_id", F.lit(str(seed)))) % pieces).cast("int"))
    path = f"{scratch.root}/descriptions"
    rows.repartition("piece", F.pmod(F.xxhash64("entity_id"), F.lit(16))).write.partitionBy("piece").parquet(path) if steps > 1 else rows.write.parquet(path)
    rows = spark.read.parquet(path)
    if (one := rows.select("mean").first()) is None:
        raise ValueError("no description to learn from")
    dims = len(one["mean"])
    counted = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("ys")) for k in KINDS])).alias("x")).select("x.kind", F.explode("x.ys").alias("y"))
    weights = {r["kind"]: float(r["weight"]) for r in positive_weights(counted).collect()}  # one for each kind
    form = shapes(dims, attention, vectors["forward"].shape[1], vectors["backward"].shape[1])
    same_settings(spark, folder, {"dims": dims, "attention": attention, "steps": steps, "rate": rate, "epochs": epochs, "threshold": threshold, "most": most, "seed": seed})
    last = latest_epoch(spark, folder)
    none = {n: np.zeros(shape) for n, shape in form.items()}
    state = {"weight": initial_weights(form, seed), "m": dict(none), "v": dict(none)}
    if last >= 0:
        for r in read_strict(spark, epoch_path(folder, last)).collect():  # the model's own size
            for column, held in state.items():
                held[r["name"]] = np.array(r[column]).reshape(form[r["name"]])
    fixed = spark.sparkContext.broadcast(vectors)
    for epoch in range(last + 1, min(epochs, epochs if until is None else until)):
        order, total = np.random.default_rng([seed, epoch]).permutation(pieces), 0.0
        for step in range(steps):
            mine = rows.where(F.col("piece").isin(order[step::steps].tolist())) if steps > 1 else rows
            held = spark.sparkContext.broadcast(state["weight"])
            got = summed(mine.select("x", "mean", *KINDS).mapInArrow(_kernel(held, fixed, form, weights, threshold, most), "stretch int, values array<double>"))
            held.unpersist()
            if -1 not in got:
                continue  # no description in this step
            loss, n = got.pop(-1)
            slope, at, turn = np.concatenate([got[k] for k in sorted(got)]) / (8 * n), 0, epoch * steps + step + 1
            total += loss / (8 * n)
            for name, shape in form.items():
                g = slope[at : at + math.prod(shape)].reshape(shape)
                at += math.prod(shape)
                state["m"][name] = 0.9 * state["m"][name] + 0.1 * g
                state["v"][name] = 0.999 * state["v"][name] + 0.001 * g * g
                state["weight"][name] = state["weight"][name] - rate * (state["m"][name] / (1 - 0.9**turn)) / (np.sqrt(state["v"][name] / (1 - 0.999**turn)) + 1e-8)
        columns = {"epoch": [epoch] * len(form), "loss": [total] * len(form), "name": list(form)} | {c: [held[n].reshape(-1) for n in form] for c, held in state.items()}
        spark.createDataFrame(pa.table(columns)).coalesce(1).write.mode("overwrite").parquet(epoch_path(folder, epoch))
    scratch.drop(path)
    done = latest_epoch(spark, folder)
    if done < 0:
        raise ValueError("no epoch was asked for")
    return read_strict(spark, epoch_path(folder, done))
