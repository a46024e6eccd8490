"""Near copies from different sources never share a bin."""

from triplewright.llm import packing, queries


def test_near_copies_conflict(spark, tmp_path):
    base = [f"w{k}" for k in range(100)]
    texts = [" ".join(base), "  ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"v{k}" for k in range(100))]
    rows = [(i, t, f"s{i}") for i, t in enumerate(texts)] + [(None, texts[0], "s9")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op2_packing(spark, str(tmp_path)).collect()
    bins = {r["doc_id"]: r["bin_id"] for r in out}
    assert len(out) == 5 and all(r["n_words"] == 100 for r in out)
    assert len({bins[i] for i in (0, 1, 2, None)}) == 4
    assert bins[3] in {bins[i] for i in (0, 1, 2, None)}


def test_clashing_columns(spark):
    rows = [(i, f"w{i} " * (10 + i % 5), f"s{i % 3}", 1, 2, "t", 3, 4) for i in range(40)] + [(None, "", None, 1, 2, "t", 3, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, cluster int, tie string, shard int, comp int")
    plain = df.select("doc_id", "text", "source")
    for near in (False, True):
        a, b = ({tuple(r) for r in packing.pack(x, near=near).collect()} for x in (df, plain))
        assert a == b and len(a) == 41
    assert packing.pack(df.limit(0), near=True).count() == 0
