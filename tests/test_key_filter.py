"""Semi-joins by bounded filters: nothing is lost, and little more than what is kept passes."""

import pytest
from pyspark.sql import functions as F

from tests.test_graph import toy  # noqa: F401
from triplewright.operators import minimize
from triplewright.storage import Scratch


@pytest.fixture
def large(spark):
    return spark.range(200_000, numPartitions=4).select((F.col("id") % 50_000).cast("string").alias("k"), "id")


def test_the_filter_loses_nothing_and_passes_little(spark, large, monkeypatch):
    keys = Scratch(spark, "t").keep(spark.range(0, 50_000, 10).select(F.col("id").cast("string").alias("key")).union(spark.createDataFrame([("no such",)], "key string")), "keys")
    want = {i for i in range(200_000) if i % 50_000 % 10 == 0}
    passed = minimize.maybe_in(large, "k", keys, 5001)
    assert {r["id"] for r in passed.select("id").collect()} >= want and passed.count() < 1.15 * len(want) + 0.03 * 200_000
    for most in (100_000, 0):
        monkeypatch.setattr(minimize, "BROADCAST_KEYS", most)
        got = minimize.kept_by(large, "k", keys)
        assert {r["id"] for r in got.collect()} == want and got.columns == ["k", "id"]
    monkeypatch.setattr(minimize, "FILTER_WORDS", 2)  # a filter that is far too small still loses nothing
    assert minimize.kept_by(large, "k", keys).count() == len(want)


def test_the_filter_stands_before_the_exchange(spark, large, monkeypatch):
    monkeypatch.setattr(minimize, "BROADCAST_KEYS", 0)
    keys = Scratch(spark, "t").keep(spark.range(0, 50_000, 10).select(F.col("id").cast("string").alias("key")), "keys")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = minimize.kept_by(large, "k", keys)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.index("LeftSemi") < plan.index("Exchange hashpartitioning") < plan.index("getbit(")


def test_minimised_tables_are_the_same_both_ways(spark, toy, monkeypatch):  # noqa: F811
    triples, descriptions, aliases = toy
    relations = triples.select(F.col("r").alias("relation_id")).distinct()
    heads = spark.createDataFrame([("Q1",), ("Q3",)], "h string")

    def run():
        return {n: sorted(map(str, df.collect())) for n, df in minimize.minimize(triples, aliases, relations, descriptions, heads).items()}

    plain = run()
    monkeypatch.setattr(minimize, "BROADCAST_KEYS", 0)
    assert run() == plain and len(plain["triples"]) == 4 and len(plain["descriptions"]) == 2


def test_no_filter_is_sent_for_more_keys_than_it_tells_apart(spark, large, monkeypatch):
    """What the driver sends with a plan is bounded: 16 MB for each hash and branch of a union were over its memory."""
    assert minimize.FILTER_WORDS * 8 <= 1 << 20
    monkeypatch.setattr(minimize, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(minimize, "FILTER_WORDS", 64)
    keys = Scratch(spark, "t").keep(spark.range(0, 50_000, 10).select(F.col("id").cast("string").alias("key")), "keys")
    got = minimize.kept_by(large, "k", keys)
    assert "getbit(" not in got._jdf.queryExecution().executedPlan().toString()
    assert {r["id"] for r in got.collect()} == {i for i in range(200_000) if i % 50_000 % 10 == 0}


def test_sizes_are_the_same_with_and_without_a_filter(spark, toy, monkeypatch):  # noqa: F811
    triples, descriptions, aliases = toy
    before = {"triples": triples, "aliases": aliases, "relations": triples.select(F.col("r").alias("relation_id")).distinct(), "descriptions": descriptions}
    heads = spark.createDataFrame([("Q1",), ("Q3",)], "h string")

    def run():
        report = minimize.size_report(before, minimize.minimize(*before.values(), heads))
        return "getbit(" in report._jdf.queryExecution().executedPlan().toString(), sorted(map(str, report.collect()))

    plain = run()[1]
    monkeypatch.setattr(minimize, "BROADCAST_KEYS", 0)
    assert run() == (True, plain)
    monkeypatch.setattr(minimize, "FILTER_BITS", 1 << 40)  # any number of keys is too many for a filter
    assert run() == (False, plain)
