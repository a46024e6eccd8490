"""Exact top-k search by inner product: a ball tree for each shard, searched by branch and bound.

1. Rows are dealt by hash into shards of about SHARD_ROWS; each becomes a ball tree
   (median cuts, centre and radius for every node) and a block of its own queries.
2. Blocks visit shards in waves that grow by FACTOR: their own shard first, then the
   next few, then more. After each wave the k best so far of every query are written,
   and the next wave's blocks carry each query's kth score, so that what one shard
   found prunes all later ones.
3. Inside a shard a block goes down level by level; a node's bound for a query is
   q.c + |q| r. Subtrees that no query needs are left. Leaves are visited in the order of
   their bounds, and the kth score rises meanwhile. A node whose bound equals the kth
   score is left if its least id is no smaller than the id there, so that a vector
   shared by a third of all rows doesn't open every node that holds it.

A task holds one tree and one block. Trees are copied once for BLOCKS_PER_TASK blocks.

Rows without an id, and vectors that are null or hold null or non-finite components,
take no part. Each query row has a list of its own, so repeated query rows repeat it;
rows that repeat an id are candidates one by one, and none of them is one of its own id's.
Ties go to the smaller id. With fewer than k candidates all are returned; an empty
table gives an empty one. Columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplewright.llm.batches import map_batches, portable
from triplewright.llm.whole_vectors import best_of, matrix, narrow, packed, products, unpacked, whole_rows
from triplewright.storage import Scratch

SHARD_ROWS, LEAF_ROWS = 8192, 64
#: How much further each wave reaches than all before it; blocks that one copy of a tree serves.
FACTOR, BLOCKS_PER_TASK = 4, 64
#: Shards that a task meets one after the other, where there are more than shuffle partitions.
SHARDS_PER_TASK = 8
NONE = np.iinfo(np.int64)


def build_tree(ids: np.ndarray, vectors: np.ndarray) -> dict[str, np.ndarray]:
    """Ids and vectors in leaf order; edges, centres, radii and least ids of the nodes, level by level.

    Every node is cut at the median of its widest dimension until leaves have LEAF_ROWS
    at most, so all leaves are on one level and node i's children are 2i and 2i + 1.
    """
    order, depth = np.arange(len(ids)), max(0, int(np.ceil(np.log2(max(len(ids), 1) / LEAF_ROWS))))
    levels = [np.array([0, len(ids)])]
    for _ in range(depth):
        edges = [0]
        for low, high in zip(levels[-1][:-1].tolist(), levels[-1][1:].tolist(), strict=True):
            part, middle = vectors[order[low:high]], (high - low) // 2
            if part.size:
                along = part[:, np.argmax(part.max(axis=0) - part.min(axis=0))]
                order[low:high] = order[low:high][np.argpartition(along, middle)]
            edges += [low + middle, high]
        levels.append(np.array(edges))
    ids, vectors = ids[order], vectors[order]
    plain = vectors.astype(np.float64)
    centres, radii, least = [], [], []
    for edges in levels:
        sizes = np.diff(edges)
        centre = np.add.reduceat(plain, edges[:-1], axis=0) / sizes[:, None]
        far = np.sqrt(np.square(plain - np.repeat(centre, sizes, axis=0)).sum(axis=1))
        centres.append(centre)
        radii.append(np.maximum.reduceat(far, edges[:-1]))
        least.append(np.minimum.reduceat(ids, edges[:-1]))
    return {"ids": ids, "vectors": narrow(vectors), "edges": np.concatenate(levels), "centres": np.concatenate(centres), "radii": np.concatenate(radii), "least": np.concatenate(least)}


def bounds(queries: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of each query with what each ball holds: whole numbers, rounding errors counted in."""
    d = min(queries.shape[1], centres.shape[1])
    length = np.sqrt(np.square(queries).sum(axis=1))[:, None]
    size = length * (np.sqrt(np.square(centres).sum(axis=1)) + radii)
    return np.floor(queries[:, :d] @ centres[:, :d].T + length * radii + size * 1e-12 + 1e-6)


def search(tree: dict[str, np.ndarray], ids: np.ndarray, queries: np.ndarray, kth_score: np.ndarray, kth_id: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, score, id) of at most k candidates a query that come before its kth so far, and how many products that took."""
    plain, n = queries.astype(np.float64), len(ids)
    floor_score, floor_id = kth_score.copy(), kth_id.copy()
    nodes, at, rows = 1, 0, np.arange(n)

    def needed(bound: np.ndarray, who: np.ndarray, least: np.ndarray) -> np.ndarray:
        return (bound > floor_score[who]) | ((bound == floor_score[who]) & (least < floor_id[who]))

    live, above = np.ones((n, 1), bool), np.full((n, 1), np.inf)
    while True:
        columns = np.flatnonzero(live.any(axis=0))
        here = at + columns
        bound = np.full((n, nodes), -np.inf)
        bound[:, columns] = np.minimum(bounds(plain, tree["centres"][here], tree["radii"][here]), above[:, columns])
        live &= needed(bound, rows[:, None], tree["least"][at : at + nodes])
        bound[~live] = -np.inf
        if at + nodes == len(tree["radii"]):
            break
        at, nodes = at + nodes, 2 * nodes
        live, above = np.repeat(live, 2, axis=1), np.repeat(bound, 2, axis=1)
    leaves, least = tree["edges"][-nodes - 1 :], tree["least"][at:]
    order = np.argsort(-bound, axis=1, kind="stable")
    best = [np.empty(0, np.int64)] * 3
    seen, step, tried = 0, 1, 0
    active = rows
    while len(active) and seen < nodes:
        part = order[active, seen : seen + step]
        who, leaf = np.repeat(active, part.shape[1]), part.reshape(-1)
        use = needed(bound[who, leaf], who, least[leaf]) & np.isfinite(bound[who, leaf])
        who, leaf = who[use], leaf[use]
        # Bounds fall along the order: a query whose last one here isn't finite or is below its kth has no more.
        last = bound[active, part[:, -1]]
        active = active[np.isfinite(last) & (last >= floor_score[active])]
        seen, step = seen + step, 2 * step
        found = [best]
        by_leaf = np.argsort(leaf, kind="stable")
        who, leaf = who[by_leaf], leaf[by_leaf]
        edges = [*np.flatnonzero(np.diff(leaf, prepend=-1)).tolist(), len(leaf)]
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            inside = slice(leaves[leaf[low]], leaves[leaf[low] + 1])
            them, members = who[low:high], tree["ids"][inside]
            score = products(queries[them], tree["vectors"][inside])
            tried += score.size
            top, tie = floor_score[them][:, None], floor_id[them][:, None]
            fits = ((score > top) | ((score == top) & (members < tie))) & (members != ids[them][:, None])
            x, y = np.nonzero(fits)
            found.append([them[x], score[x, y], members[y]])
        group, score, ident = (np.concatenate(c) for c in zip(*found, strict=True))
        keep = best_of(group, score, ident, k)
        best = [group[keep], score[keep], ident[keep]]
        full = np.flatnonzero(np.bincount(best[0], minlength=n) == k)
        if len(full):
            end = np.searchsorted(best[0], full, "right") - 1
            better = (best[1][end] > floor_score[full]) | ((best[1][end] == floor_score[full]) & (best[2][end] < floor_id[full]))
            floor_score[full[better]], floor_id[full[better]] = best[1][end[better]], best[2][end[better]]
    return best[0], best[1], best[2], tried


def _built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shard, tree, block) of rows (shard, row, vec_id, asks, vec) that come sorted by shard."""

    def made(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, vectors = table["vec_id"].to_numpy(), matrix(table["vec"].combine_chunks())
        asks = table["asks"].to_numpy(zero_copy_only=False)
        block = packed(rows=table["row"].to_numpy()[asks], ids=ids[asks], queries=narrow(vectors[asks]))
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([packed(**build_tree(ids, vectors))], pa.binary()), pa.array([block], pa.binary()), pa.array([int(asks.sum())], pa.int64())], ["shard", "tree", "block", "asks"])

    held, now = [], None
    for batch in batches:
        shards = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), len(shards)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            if now is not None and shards[low] != now:
                yield made(now, held)
                held = []
            now = int(shards[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield made(now, held)


def _visits(k: int):
    """A kernel over (shard, salt, home, payload, kths) that come sorted with a shard's tree (null home) before the blocks that visit it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            for at in range(batch.num_rows):
                payload = unpacked(batch.column(3)[at].as_py())
                if not batch.column(2)[at].is_valid:
                    tree = payload
                    continue
                rows, n = payload["rows"], len(payload["rows"])
                score, ident = np.full(n, NONE.min), np.full(n, NONE.max)
                place = {r: i for i, r in enumerate(rows.tolist())}
                for x in batch.column(4)[at].as_py() or []:
                    score[place[x["row"]]], ident[place[x["row"]]] = x["score"], x["vec_id"]
                who, scores, found, _ = search(tree, payload["ids"], payload["queries"].astype(np.int64), score, ident, k)
                home = pa.array(np.full(len(who), batch.column(2)[at].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([home, pa.array(rows[who]), pa.array(payload["ids"][who]), pa.array(found), pa.array(scores)], ["home", "row", "query_id", "vec_id", "score"])

    return kernel


def wave_ends(shards: int) -> list[tuple[int, int]]:
    """Distances [low, high) from its own shard that a block goes in each wave."""
    out, low, high = [], 0, 1
    while low < shards:
        out.append((low, min(high, shards)))
        low, high = high, high * FACTOR
    return out


def top_k(df: DataFrame, asks: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k first rows for each row that ``asks``, its own id left out."""
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "top-k")
    held = scratch.keep(whole_rows(df, id_col, vector_col, asks=F.coalesce(asks, F.lit(False))), "rows")
    shards = max(1, -(-held.count() // SHARD_ROWS))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # By row, not by id: an id may repeat without end.
    dealt = held.select(F.pmod(F.xxhash64("row"), F.lit(shards)).alias("shard"), "row", "vec_id", "asks", "vec").repartition(max(least, -(-shards // SHARDS_PER_TASK)), "shard").sortWithinPartitions("shard")
    built = scratch.keep(map_batches(dealt, _built, "shard long, tree binary, block binary, asks long"), "trees")
    none = F.lit(None).cast("array<struct<row:long,score:long,vec_id:long>>")
    best = None
    for low, high in wave_ends(shards):
        salts = -(-(high - low) // BLOCKS_PER_TASK)
        blocks = built.where("asks > 0").select(F.col("shard").alias("home"), F.col("block").alias("payload"))
        if best is None:
            blocks = blocks.withColumn("kths", none)
        else:
            kths = best.where(F.col("rank") == k).groupBy("home").agg(F.collect_list(F.struct("row", "score", "vec_id")).alias("kths"))  # a shard's queries at most
            blocks = blocks.join(kths, "home", "left")
        to = blocks.select("home", "payload", "kths", F.explode(F.sequence(F.lit(low), F.lit(high - 1))).alias("off"))
        to = to.select(((F.col("home") + F.col("off")) % shards).alias("shard"), (F.col("off") % salts).cast("int").alias("salt"), "home", "payload", "kths")
        trees = built.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(None).cast("long").alias("home"), F.col("tree").alias("payload"), none.alias("kths"))
        met = trees.unionByName(to).repartition(max(least, -(-shards * salts // SHARDS_PER_TASK)), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("home").asc_nulls_first())
        found = map_batches(met, _visits(k), "home long, row long, query_id long, vec_id long, score long")
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        order = Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id")
        best = scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    return best.select("query_id", "rank", "vec_id", "score")


portable(__name__)
