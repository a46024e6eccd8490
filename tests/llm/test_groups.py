"""Near-duplicates, packing and licences against plain restatements; the pipeline stage by stage."""

from collections import Counter, defaultdict

import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import brute
from triplewright.llm import classifier, components, licenses, minhash, packing, quality_rules
from triplewright.storage import Scratch


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for n, _ in Counter(j for g in s for j in inverted[g]).items():
            shared = len(s & sets[n][1])
            if 100 * shared >= 75 * (len(s) + len(sets[n][1]) - shared):
                a, b = sorted((find(sets[k][0]), find(sets[n][0])))
                parent[b] = a
        for g in s:
            inverted[g].append(k)
    return {i: (len(s), find(i)) for i, s in sets}


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, keys int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df).collect()}
    assert got == brute_components(rows)


def test_near_duplicates_equal_brute_force(spark):
    texts = brute.EDGE + pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist()
    check(spark, list(enumerate(texts + [texts[20], texts[25] + " more", "A b C", "a B c"])))


def test_a_large_group_whose_members_miss_its_hub(spark):
    base = [f"w{k}" for k in range(120)]

    def edited(i, n):
        return " ".join(f"x{i}" if (k * 7 + i) % 120 in range(n) else w for k, w in enumerate(base))

    check(spark, [(i, edited(i, n)) for i, n in enumerate([0] * 3 + [1] * 40 + [3] * 30 + [5] * 30)] + [(500 + i, edited(90, 5) + f" tail{i}") for i in range(4)])


def test_near_duplicates_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A B C D E F"), (7, None), (8, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, None, True), (3, 2, False), (3, 2, False), (2, 2, True), (7, 7, True), (8, 8, True)], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_components_of_long_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5)], "u long, v long")
    got = {r["u"]: r["v"] for r in components.components(edges, Scratch(spark, "test")).collect()}
    assert got == {i: 0 for i in range(1, 61)} | {101: 100}


def slow_pack(items, capacity):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b[0], k) for k, b in enumerate(bins) if b[0] >= size and source not in b[1] - {None} and cluster not in b[2] - {None}]
        k = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), set()])
        out.append((k, capacity - bins[k][0]))
        bins[k][0] -= size
        bins[k][1].add(source)
        bins[k][2].add(cluster)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_equals_a_full_search(seed):
    import random

    r = random.Random(seed)
    items = sorted(((r.randint(1, 40), r.choice([None, "a", "a", "a", *"bcdef"]), r.choice([None, *range(30)])) for _ in range(300)), key=lambda x: -x[0])
    assert packing.best_fit(items, 40) == slow_pack(items, 40)


def test_packing_keeps_all_words_and_conflicts(spark):
    df = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    rows = packing.pack(df, shard_rows=300).collect()
    texts = {r["doc_id"]: r for r in df.collect()}
    words = {i: len(brute.WORD.findall(r["text"])) for i, r in texts.items()}
    held = defaultdict(list)
    for r in rows:
        held[r["doc_id"]].append(r)
    assert {i: sum(r["n_words"] for r in x) for i, x in held.items()} == words
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin_id"]].append(r)
    for parts in bins.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["n_words"]
        assert at <= packing.CAPACITY
        assert len({texts[r["doc_id"]]["source"] for r in parts}) == len(parts) == len({texts[r["doc_id"]]["text"] for r in parts})


def test_packing_of_odd_tables(spark):
    df = spark.createDataFrame([(1, None, None), (None, "a " * 5000, None), (2, "", "s"), (3, "b", None), (3, "b", None)], "doc_id long, text string, source string")
    rows = packing.pack(df).collect()
    assert sum(r["n_words"] for r in rows) == 5002 and sum(r["bin_id"] is None for r in rows) == 2
    assert len({r["bin_id"] for r in rows if r["doc_id"] == 3}) == 2
    assert packing.pack(df.limit(0)).count() == 0


def test_licence_rules(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal.\nThe above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND."
    texts = [mit, "Some text.\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0. You may not use this file except in compliance with the License.", "You may not use this file except in compliance with the License.", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["n_unmatched"]) for r in licenses.scan_licenses(df).collect()}
    assert got == {0: ("MIT", 0), 1: ("MIT,Apache-2.0", 0), 2: ("Apache-2.0", 0), 3: ("", 1), 4: ("", 0), 5: ("", 0)}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_pipeline_stage_by_stage(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = corpus_pipeline.labels(spark, d)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "quality rules", "near-dedup", "personal data", "packing"]
    kept = stages["quality classifier"](spark, docs, d)
    want = {r["doc_id"] for r in classifier.classify(docs, labels).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    kept = stages["quality rules"](spark, docs, d)
    want = {r["doc_id"] for r in quality_rules.judge(docs, labels.where("quality = 1").select("doc_id")).where("kept").collect()}
    assert {r["doc_id"] for r in kept.collect()} == want and kept.columns == docs.columns
    kept = stages["near-dedup"](spark, docs, d)
    truth = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"] for r in kept.collect()} == {i for i, (_, c) in truth.items() if i == c} and kept.columns == docs.columns
    marked = stages["personal data"](spark, docs, d)
    assert marked.columns == docs.columns and marked.count() == docs.count()
    for r in marked.collect():
        assert sum(brute.op9(r["text"])[:4]) == 0 and r["n_chars"] == len(r["text"])
    assert corpus_pipeline.run(spark, d).select("doc_id").distinct().count() > 0
