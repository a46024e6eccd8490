import pyarrow.parquet as pq
import pytest

from tests.conftest import DATA
from tests.llm import brute
from triplewright.llm import pii


@pytest.fixture(scope="module")
def texts():
    return brute.EDGE + pq.read_table(f"{DATA}/sf0.001/documents.parquet").column("text").to_pylist()


def test_base_spans_equal_brute_force(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, kind int")
    rows = {r["doc_id"]: r for r in pii.pii_digest(df).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        *counts, digest, listed = brute.op9(text)
        got = rows[i]
        assert [got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]] == counts, (text or "")[:80]
        assert got["base_sha256"] == digest, (got["spans"][:200], listed[:200])
        assert [s for s in got["spans"].split(",") if s and s.split(":")[0] not in ("iban", "ssn")] == [s for s in listed.split(",") if s]


def test_checksums_and_context(spark):
    texts = ["IBAN DE89 3704 0044 0532 0130 00.", "DE00 3704 0044 0532 0130 00", "078-05-1120", "my ssn is 078-05-1120"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(df).collect()}
    assert got == {0: [("iban", 5, 32)], 1: [], 2: [], 3: [("ssn", 10, 21)]}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.cd, +1 555 555 5555!", "k"), (2, None, "k"), (3, "", "k"), (3, "plain", "k")], "doc_id long, text string, __pii_spans string")
    out = pii.redact(df)
    assert out.columns == df.columns
    assert [r["text"] for r in out.collect()] == ["to <EMAIL>, <PHONE>!", None, "", "plain"]


def test_empty_table(spark):
    assert pii.pii_digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_repeated_rows_have_equal_digests(spark):
    df = spark.createDataFrame([(1, "a@b.cd 1.2.3.4"), (1, "a@b.cd 1.2.3.4"), (None, "a@b.cd 1.2.3.4")], "doc_id long, text string")
    rows = pii.pii_digest(df).drop("doc_id").distinct().collect()
    assert len(rows) == 1 and rows[0]["spans"] == "email:0:6,ip:7:14"


def test_very_long_texts(spark):
    """Many matches over more than one chunk and block; whole texts of millions of characters."""
    many = " ".join(f"u{k}@h{k}.org ü 10.0.{k % 256}.{k % 256 + 1} +1 555 {k:07}" for k in range(30_000))
    df = spark.createDataFrame([(1, many), (2, "xy " * 1_000_000 + " a@b.cd"), (3, "\U0001f600" * 5000 + "a@b.cd" * 2)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in pii.pii_digest(df).collect()}
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    for i, text in texts.items():
        *counts, digest, _ = brute.op9(text)
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == counts and rows[i]["base_sha256"] == digest
    clean = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert clean[2] == "xy " * 1_000_000 + " <EMAIL>" and clean[3].startswith("\U0001f600" * 5000 + "<EMAIL>")
    assert clean[1].count("<EMAIL>") == 30_000 and sum(brute.op9(clean[1])[:4]) == 0


def test_redaction_by_spans(spark):
    """Every text, marked by hand from its spans."""
    df = spark.createDataFrame(list(enumerate(brute.EDGE)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in pii.find_pii(df).collect()}
    for r in pii.redact(df).collect():
        text, out, at = brute.EDGE[r["doc_id"]], "", 0
        for s in spans[r["doc_id"]]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert r["text"] == (None if text is None else out + text[at:])
