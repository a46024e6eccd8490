"""Model queries over a row for each description: nothing is exchanged to gather its tokens, and the results are those of tokens in rows of their own."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import DATA
from triplewright.functions.aggregates import mean_by
from triplewright.operators import encode as E
from triplewright.operators import extract as X
from triplewright.operators import losses as L
from triplewright.operators import training as T
from triplewright.plans import model_queries as M

NO_EXCHANGE = ["strongest_conditioned", "span_model_backward", "relation_attention_projected", "span_model_forward", "entity_heads", "relation_attention"]


@pytest.mark.parametrize("name", NO_EXCHANGE)
def test_tokens_are_not_exchanged(spark, name):
    plan = entry.queries()[name](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_tiles_are_exchanged_once(spark):
    plan = entry.queries()["relation_attention_tiled"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "tiles" not in plan


def _same(a, b):
    rows = [sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=lambda r: [x for x in r if not isinstance(x, (float, list))]) for df in (a, b)]
    assert len(rows[0]) == len(rows[1]) > 0
    for x, y in zip(*rows, strict=True):
        for p, q in zip(x, y, strict=True):
            assert p == (pytest.approx(q, abs=1e-9) if isinstance(q, (float, list)) else q)


def test_held_rows_give_what_tokens_give(spark, monkeypatch):
    texts = spark.createDataFrame([(f"D{i}", " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i * 9))) for i in range(12)] + [("none", None)], "entity_id string, text string")
    held, tokens = E.described_tokens(texts, E.hash_encoder(M.DIMS)), E.token_embeddings(texts, E.hash_encoder(M.DIMS))
    relations = spark.createDataFrame([(f"r{k}", [((k + 1) * (j + 3) % 7) / 7 - 0.4 for j in range(M.DIMS)]) for k in range(3)], "relation_id string, emb array<double>")
    means = mean_by(tokens, "entity_id")
    _same(X.tokens_of(held), tokens)
    _same(held.select("entity_id", F.col("mean").alias("emb")), means)
    for few in (True, False):
        if not few:
            monkeypatch.setattr(X, "MOST_RELATIONS", 1)
        one, other = X.one_direction(held, None, relations, M.W, most=3), X.one_direction(tokens, means, relations, M.W, most=3)
        for part in ("entity", "slots", "contexts", "conditioned"):
            _same(one[part], other[part])
        _same(X.held_strongest(held, relations, M.W, most=3), X.strongest_conditioned(tokens, other["contexts"], other["slots"], M.W["fuse"], *M.W["conditioned"]))
        _same(X.relation_attention_tiled(held, relations, None, M.W["attention"], tile=4), other["contexts"])


def test_heads_trained_on_held_rows(spark, tmp_path):
    """Tokens were exchanged, a row each, to meet their labels, and every number of a slope was a fold."""
    texts = spark.createDataFrame([(f"D{i}", " ".join(f"w{(i * 7 + k * k) % 50}" for k in range(i * 9))) for i in range(12)] + [("none", None)], "entity_id string, text string")
    held, tokens = E.described_tokens(texts, E.hash_encoder(M.DIMS)), E.token_embeddings(texts, E.hash_encoder(M.DIMS))
    labels = M._token_labels(tokens)
    marks = M._marked(held).select("entity_id", F.explode("marks").alias("m")).select("entity_id", "m.kind", "m.pos")
    assert sorted(map(tuple, marks.collect())) == sorted(map(tuple, labels.collect()))
    extra = labels.unionByName(spark.createDataFrame([("D3", "h_s", 2), ("D3", "h_s", 900), ("nobody", "t_e", 0)], labels.schema))
    runs = {"plain": (tokens, labels), "marked": (M._marked(held), None), "met": (held, labels), "plain2": (tokens, extra), "met2": (held, extra)}
    got = {k: T.train_heads(*run, M.DIMS, f"file://{tmp_path}/{k}", epochs=2, rate=0.1, pos_weight=3.0) for k, run in runs.items()}
    _same(got["marked"], got["plain"])
    _same(got["met"], got["plain"])
    _same(got["met2"], got["plain2"])
    assert "Exchange" not in T._marked(M._marked(held), None)._jdf.queryExecution().executedPlan().toString()
    empty = T.train_heads(M._marked(held).limit(0), None, M.DIMS, f"file://{tmp_path}/empty", epochs=1)
    assert empty.count() == 0


def test_the_slot_loss_of_lists(spark):
    """Tokens' logits were exchanged eight times, a row each."""
    r = random.Random(5)
    ids = [f"D{i}" for i in range(8)]
    lists = [(h, k, s, *[[r.uniform(-3, 3) for _ in range(3 + i)] for _ in "se"]) for i, h in enumerate(ids[:-1]) for k in ("a", "b") for s in (0, 1)]
    tails = spark.createDataFrame(lists, "entity_id string, relation_id string, slot int, start_logit array<double>, end_logit array<double>")
    heads = tails.where("relation_id = 'a' and slot = 0").drop("relation_id", "slot").unionByName(spark.createDataFrame([("empty", [], [])], "entity_id string, start_logit array<double>, end_logit array<double>"))
    slots = spark.createDataFrame([(h, s, s + i, s + 1) for h in ids for s in (0, 1) for i in (0, 0, 1)], "entity_id string, slot int, s long, e long")
    gold = spark.createDataFrame([(r.choice([*ids, "empty"]), r.choice("abc"), "t", r.randrange(3), r.randrange(1, 3), r.randrange(9), r.choice([-1, 2, 1 << 40])) for _ in range(80)], "h string, r string, t string, hs long, he long, ts long, te long")

    def rows(df):
        keys = [c for c in df.columns if not c.endswith("logit")]
        return df.select(*keys, F.posexplode(F.arrays_zip("start_logit", "end_logit")).alias("pos", "x")).select(*keys, "pos", "x.*")

    want = L.slot_triple_loss(rows(heads), rows(tails), slots, gold).first()["loss"]
    assert L.slot_triple_loss(heads, tails, slots, gold).first()["loss"] == pytest.approx(want, rel=1e-9) and want > 0
    assert L.slot_triple_loss(heads, tails, slots, gold.limit(0)).first()["loss"] == 0
    plan = L.slot_triple_loss(heads, tails, slots, gold)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 3
