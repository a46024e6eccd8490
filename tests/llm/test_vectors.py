"""Exact top-k search and hard negatives against plain loops: odd rows, ties, repeats, ragged and hot vectors."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright.llm import hard_negatives, top_k
from triplewright.llm.whole_vectors import products

SCHEMA = "vec_id long, embedding array<float>, label int, row string, bucket string, shard string"


def moved():
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))


def asks():
    return F.col("vec_id") % 50 == 0


def whole(rows, label=False):
    out = []
    for i, v, y in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (label and y is None):
            continue
        out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], y))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def plain_top_k(rows, k=5):
    held, out = whole(rows), []
    for i, v, _ in held:
        if i % 50 == 0:
            found = sorted((-dot(v, w), j) for j, w, _ in held if j != i)[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(found)]
    return sorted(out)


def plain_negatives(rows):
    held, out = [(i, v, (y + 1) % 10 if i % 7 == 0 else y) for i, v, y in whole(rows, True)], []
    for i, v, y in held:
        if i % 50 == 0:
            for p, j in sorted((-dot(v, w), j) for j, w, z in held if j != i and z == y)[:5]:
                p = -p
                fits = sorted((-dot(v, w), n) for n, w, z in held if z != y and n != i and 50 * p <= 100 * dot(v, w) <= 95 * p)[:3]
                out += [(i, j, r + 1, n, p, -s) for r, (s, n) in enumerate(fits)]
    return sorted(out)


def table(rows, n, dims, seed, hot=0.0, spread=0.2):
    r = np.random.default_rng(seed)
    common = r.normal(0, spread, dims).tolist()
    return rows + [(int(i), common if r.random() < hot else r.normal(0, spread, dims).tolist(), int(r.integers(0, 4))) for i in range(n)]


ODD = [
    (None, [0.5, 0.5], 1), (50, None, 1), (100, [0.1, None], 1), (150, [0.1, float("nan")], 1), (200, [float("inf"), 0.0], 2), (250, [], 1), (300, [0.9], None),
    (350, [0.5, -0.5, 0.25, 3.0, 1.0], 3), (400, [1.0, 1.0], 2), (400, [1.0, 1.0], 2), (401, [1.0, 1.0], 2), (401, [1.0, 1.0], 3), (450, [1.0, -1.0], 2), (450, [-1.0, 1.0], 1), (-50, [2.0], 0), (-7, [0.6], 9), (-1, [2.0, 2.0], 1),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, y, "x", None, "z") for i, v, y in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("rows", [[], ODD[:5], [(0, [1.0], 1)], ODD, table(ODD, 260, 6, 1), table([], 700, 3, 2, hot=0.4), table([], 400, 40, 3, spread=0.01)])
def test_both_equal_plain_loops(spark, monkeypatch, rows):
    monkeypatch.setattr(top_k, "SHARD_ROWS", 90)
    monkeypatch.setattr(top_k, "LEAF_ROWS", 8)
    monkeypatch.setattr(top_k, "BLOCKS_PER_TASK", 2)
    for name, size in (("ROW_BLOCK", 40), ("ANCHOR_BLOCK", 4), ("DIM_CHUNK", 4), ("ANCHORS_PER_TASK", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    df = frame(spark, rows)
    assert sorted(map(tuple, top_k.top_k(df, asks()).collect())) == plain_top_k(rows)
    assert sorted(map(tuple, hard_negatives.mine(df, asks(), moved()).collect())) == plain_negatives(rows)


def test_products_stay_exact_past_doubles():
    a, b = np.array([[1 << 30, 3, 1]]), np.array([[(1 << 31) + 1, 5], [-(1 << 31), 7]])
    assert products(a, b).tolist() == [[(1 << 30) * ((1 << 31) + 1) + 15, -(1 << 61) + 21]]
    with pytest.raises(OverflowError):
        products(np.array([[1 << 40]]), np.array([[1 << 40]]))


def test_a_known_kth_score_prunes():
    """Of clustered vectors few are scored, and fewer if another shard already found better ones."""
    r = np.random.default_rng(5)
    centres = r.integers(-200, 200, (64, 16))
    vectors = np.concatenate([c + r.integers(-5, 6, (64, 16)) for c in centres])
    ids = np.arange(len(vectors)) + 1
    tree = top_k.build_tree(ids, vectors)
    asked = vectors[::64] + 1
    none = np.full(len(asked), top_k.NONE.min), np.full(len(asked), top_k.NONE.max)
    who, score, found, tried = top_k.search(tree, -ids[: len(asked)], asked, *none, 5)
    for q in range(len(asked)):
        want = sorted(zip(-(asked[q] @ vectors.T), ids))[:5]
        assert [(-s, i) for s, i in zip(score[who == q], found[who == q])] == want
    assert tried < 0.3 * len(asked) * len(vectors)
    kth = np.array([score[who == q][-1] for q in range(len(asked))]) * 2, np.zeros(len(asked), np.int64)
    assert top_k.search(tree, -ids[: len(asked)], asked, *kth, 5)[3] < 0.2 * tried


def test_a_shared_vector_opens_few_nodes():
    """A third of all rows hold one vector: ties go by id, so nodes that hold no smaller id are left."""
    r = np.random.default_rng(6)
    common = r.integers(-99, 100, 8)
    vectors = np.concatenate([np.tile(common, (4096, 1)), r.integers(-40, 41, (4096, 8))])
    ids = random.Random(1).sample(range(100_000), len(vectors))
    tree = top_k.build_tree(np.array(ids), vectors)
    who, score, found, tried = top_k.search(tree, np.array([-1]), common[None], np.array([top_k.NONE.min]), np.array([top_k.NONE.max]), 5)
    assert found.tolist() == sorted(ids[:4096])[:5]
    best = score[-1], found[-1]
    assert top_k.search(tree, np.array([-1]), common[None], np.array([best[0]]), np.array([best[1]]), 5)[3] <= 5 * top_k.LEAF_ROWS


def test_waves_reach_every_shard_once():
    for n in range(1, 200):
        assert [o for low, high in top_k.wave_ends(n) for o in range(low, high)] == list(range(n))
