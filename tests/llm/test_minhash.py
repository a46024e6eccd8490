"""Hot buckets, repeated rows and recall of the near-duplicate operator."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.llm import brute
from tests.llm.test_groups import brute_components, shingles
from triplewright.llm import minhash


def pages(n, near):
    """Pages that share a template of 40 words and have 25 of their own; every ``near``-th has a near copy with a greater id."""
    base = " ".join(f"t{k}" for k in range(40))
    own = {i: " ".join(f"p{i}x{k}" for k in range(25)) for i in range(n)}
    return [(i, f"{base} {own[i]}") for i in range(n)] + [(100_000 + i, f"{base} {own[i]} z") for i in range(0, n, near)]


def test_a_hot_bucket_proposes_few_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 300_000)
    rows = pages(20_000, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    run = minhash._Run(df, "doc_id", "text")
    found = {r["doc_id"]: r["comp"] for r in run.labelled().collect()}
    assert found == {i: i % 100_000 for i, _ in rows}
    root = run.scratch.root.removeprefix("file://")
    stars = spark.read.parquet(glob.glob(f"{root}/*-stars")[0])
    assert stars.groupBy("a").count().agg(F.max("count")).first()[0] > 2000  # a hot bucket is there
    assert spark.read.parquet(glob.glob(f"{root}/*-possible")[0]).count() < 1000
    assert spark.read.parquet(glob.glob(f"{root}/*-second-pairs")[0]).count() < 1000


def test_a_hot_bucket_moves_rows_in_proportion(spark, monkeypatch):
    """Strays of one template, of which none is linked: twice as many spread twice the rows and propose next to nothing."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 100_000)
    moved = []
    for n in (4_000, 8_000, 16_000):
        run = minhash._Run(spark.createDataFrame(pages(n, n), "doc_id long, text string").repartition(8), "doc_id", "text")
        run.labelled().count()
        root = run.scratch.root.removeprefix("file://")
        moved.append(spark.read.parquet(glob.glob(f"{root}/*-spread")[0]).count())
        assert spark.read.parquet(glob.glob(f"{root}/*-possible")[0]).count() < 300
    assert moved[0] > 10_000 and moved[2] < 2.6 * moved[1] < 6.8 * moved[0]


@pytest.mark.parametrize("block", [300, 4_000_000])
def test_large_buckets_lose_no_link(spark, monkeypatch, block):
    """Texts around several templates, some linked only with each other, held against all pairs, with lists spread and with lists in blocks."""
    monkeypatch.setattr(minhash, "BLOCK_BYTES", block)
    monkeypatch.setattr(minhash, "MOST_GROUPS", 2)
    r = random.Random(11)
    rows = []
    for t in range(3):
        base = [f"t{t}w{k}" for k in range(60)]
        for i in range(60):
            words = [w if r.random() > 0.06 else f"x{r.randint(0, 400)}" for w in base] + [f"o{i // 3}y{k}" for k in range(12)]
            rows.append((1000 * t + i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows) and 20 < len({c for _, c in got.values()}) < len(rows)


@pytest.mark.parametrize("seed", range(40))
def test_possible_pairs_lose_no_link(seed):
    r = random.Random(seed)
    base = [f"w{k}" for k in range(r.choice([6, 20, 80]))]
    texts = [" ".join(w if r.random() > p else f"x{r.randint(0, 9)}" for w in base[: r.randint(len(base) * 3 // 4, len(base))]) for p in [0, 0.01, 0.02, 0.05, 0.3] * 8]
    sets = [s for s in minhash.shingle_sets(texts)[0] if len(s)]
    counts = np.bincount(np.concatenate(sets) >> np.uint64(64 - minhash.COUNT_BITS), minlength=1 << minhash.COUNT_BITS)
    members = [{"doc_id": k, "comp": k // 3, "size": len(s), "rare": minhash.rarest(s, counts).tobytes()} for k, s in enumerate(sets)]
    u, v = minhash.possible(members[::2], members)
    got = {(min(x), max(x)) for x in zip(u, v)}
    for a in range(0, len(sets), 2):
        for b in range(len(sets)):
            shared = len(np.intersect1d(sets[a], sets[b]))
            if a // 3 != b // 3 and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                assert (min(a, b), max(a, b)) in got
    assert all(a // 3 != b // 3 for a, b in got)


def test_one_row_of_each_group_stays(spark):
    rows = [(5, "a b c d e f", "x"), (5, "a b c d e f", "y"), (5, "A b  c d e f", "x"), (5, "q r s t u v w", "x"), (7, "a b c d e f", "x"), (7, "h i j k l m n", "x"), (3, "q r s t u v w", "x"), (None, "a b c d e f", "x"), (None, None, "x"), (8, None, "x"), (8, "", "x"), (9, " ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, comp string")
    got = sorted(((r["doc_id"], " ".join((r["text"] or "").lower().split())) for r in minhash.keep_one(df).collect()), key=str)
    assert got == sorted([(5, "a b c d e f"), (7, "h i j k l m n"), (3, "q r s t u v w"), (None, "a b c d e f"), (None, ""), (8, ""), (9, "")], key=str)
    assert minhash.keep_one(df.limit(0)).count() == 0 and minhash.keep_one(df).columns == df.columns


def test_recall_of_links(spark):
    """Rows whose id is divisible by 20 against all rows: every true partner is in the same component."""
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("doc_id", "text").collect()
    comp = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")).collect()}
    sets = {r["doc_id"]: shingles(r["text"]) for r in docs}
    hit = miss = 0
    for i in [i for i in sets if i % 20 == 0 and sets[i]]:
        for j, s in sets.items():
            if j != i and (n := len(sets[i] & s)) and 100 * n >= 75 * (len(sets[i]) + len(s) - n):
                hit, miss = hit + (comp[i] == comp[j]), miss + (comp[i] != comp[j])
    assert hit and not miss


def test_very_long_texts(spark):
    long = " ".join(f"w{k % 99_991}" for k in range(400_000))
    df = spark.createDataFrame([(2, long, 1), (1, long + " end", 1), (3, long[::-1], 1), (4, "", 1)] + [(10 + i, t, 1) for i, t in enumerate(brute.EDGE)], "doc_id long, text string, digest int")
    rows = df.select("doc_id", "text").collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components([(r["doc_id"], r["text"]) for r in rows])
