import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA
from tests.llm import brute
from triplewright.llm import quality_rules


def test_rules_equal_brute_force(spark):
    texts = brute.EDGE + pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist()
    labels = pq.read_table(f"{DATA}/sf0.001/labels.parquet").to_pylist()
    trusted = {r["doc_id"] + len(brute.EDGE) for r in labels if r["quality"] == 1}
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    ids = spark.createDataFrame([(i,) for i in trusted] + [(None,)], "doc_id long")
    rows = {r["doc_id"]: r for r in quality_rules.judge(df, ids).collect()}
    ratios = {i: (w, n) for i, w, n in brute.op3_llr(list(enumerate(texts)), trusted)}
    for i, text in enumerate(texts):
        r, want = rows[i], brute.op3(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, (text or "")[:60]
        weight, n = ratios[i]
        assert r["llr"] == (pytest.approx(weight / 10_000 / n) if n else None)
        assert r["kept"] == (not want[-1] and weight >= quality_rules.THRESHOLD * n)


def test_ties_nulls_and_no_trusted_rows(spark):
    df = spark.createDataFrame([(1, "a b " * 40), (1, "a b " * 40), (None, "c d e " * 20), (2, None)], "doc_id long, text string")
    out = quality_rules.judge(df, spark.createDataFrame([], "doc_id long")).collect()
    assert len(out) == 4 and not any(r["kept"] for r in out) and {r["llr"] for r in out} == {0.0, None}
    assert quality_rules.judge(df.limit(0), df.select("doc_id")).count() == 0


def test_counts_without_a_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i if i % 3 else None, f"w{i} w{i % 7} x " * 30, 0) for i in range(60)], "doc_id long, text string, salt int")
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 2)] * 2 + [(None,)], "doc_id long")
    near = sorted(quality_rules.bucket_counts(df, ids, "doc_id", "text"))
    monkeypatch.setattr(quality_rules, "MOST_BROADCAST", 3)
    assert sorted(quality_rules.bucket_counts(df, ids, "doc_id", "text")) == near and sum(t for _, t, _ in near) > 0


def test_very_long_text(spark):
    text = " ".join(f"w{k % 70_001} #" for k in range(250_000)) + "\nline\nline"
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1,)], "doc_id long")).first()
    assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"], row["base_failed"]) == brute.op3(text)
