"""Clipped texts and spans without an exchange of tokens."""

from pyspark.sql import functions as F

from triplewright.functions.text import normalize
from triplewright.operators import spans as S


def test_an_opening_is_the_clipped_text(spark):
    texts = ["", None, "a b", "é" * 5000, "x" * 3000 + " y", "a-" * 2000 + " b", "Öl & wörd, " * 400, "§ " * 3000 + "end of it " * 200, "ab " * 700 + "cd", "one " * 127 + "z" * 3000 + " q", "w\t" * 1500]
    rows = spark.createDataFrame([(x,) for x in texts], "text string").select(S.opening(F.col("text")).alias("a"), S.clipped(normalize(F.col("text"), lower=True)).alias("b")).collect()
    assert [r["a"] for r in rows] == [r["b"] for r in rows]


def test_a_description_is_exchanged_once(spark):
    """Its tokens were exchanged, a row each, and met by its text again."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        texts = spark.createDataFrame([("a", "new york, new york new york!"), ("b", "york")], "entity_id string, text string")
        names = spark.createDataFrame([("a", ["new york", "york new york"]), ("b", ["york", "yor", " york"])], "entity_id string, aliases array<string>")
        pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b")], "h string, entity string")
        found = S.alias_spans(pairs, texts, names)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = sorted((r["h"], r["entity"], r["alias"], r["start"], r["s"], r["e"]) for r in found.collect())
    assert got == [("a", "a", "new york", 0, 0, 1), ("a", "a", "new york", 10, 3, 4), ("a", "a", "new york", 19, 5, 6), ("a", "a", "york new york", 14, 4, 6), ("a", "b", "york", 4, 1, 1), ("a", "b", "york", 14, 4, 4), ("a", "b", "york", 23, 6, 6), ("b", "b", "york", 0, 0, 0)]
    assert plan.split("Union")[1].count("Join") <= 4
