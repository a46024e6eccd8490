"""Gradients of the span model against finite differences and against the forward operators; runs that stop and go on."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_graph import toy  # noqa: F401
from triplewright.functions import aggregates as A
from triplewright.operators import encode, extract, losses, spans
from triplewright.operators import span_training as ST

DIMS, ATTENTION = 4, 3


@pytest.fixture(scope="module")
def parts(spark, toy):  # noqa: F811
    triples, descriptions, aliases = toy
    tokens = encode.token_embeddings(descriptions, encode.hash_encoder(DIMS)).cache()
    relations = spark.createDataFrame([(f"R{k}", [f"the {k} name"]) for k in range(1, 6)], "relation_id string, aliases array<string>")
    semantic = encode.relation_embeddings(relations, encode.hash_encoder(DIMS))
    graph = encode.relation_embeddings(relations.select("relation_id", F.array(F.lit("x")).alias("aliases")), encode.hash_encoder(DIMS - 1)).withColumn("emb", F.transform("emb", lambda x: x * F.length("relation_id") + F.substring("relation_id", 2, 1).cast("int") / 3))
    return tokens, A.mean_by(tokens, "entity_id"), spans.silver_labels(triples, descriptions, aliases), semantic, graph


def one_description(seed, tokens=7, relations=6):
    r = np.random.default_rng(seed)
    form = ST.shapes(DIMS, ATTENTION, DIMS, DIMS)
    w = {n.split(".")[1]: v * 2 for n, v in ST.initial_weights(form, seed).items() if n.startswith("forward")}
    x, rel = r.normal(size=(tokens, DIMS)), ST._biased(r.normal(size=(relations, DIMS)))
    labels = [r.integers(0, 2, tokens).astype(float) for _ in range(4)]
    return w, x, x.mean(axis=0), rel, labels, [1.5, 0.5, 3.0, 1.0]


@pytest.mark.parametrize("seed,threshold,tile", [(1, 0.5, 4_000_000), (2, 0.3, 40), (3, 2.0, 4_000_000), (4, 0.0, 1)])
def test_slopes_equal_finite_differences(monkeypatch, seed, threshold, tile):
    monkeypatch.setattr(ST, "TILE", tile)
    w, x, mean, rel, labels, weights = one_description(seed)

    def loss(w):
        return ST.direction_slopes(w, x, mean, rel, rel @ w["attend_r"].T, labels, weights, threshold, 3)

    slopes = loss(w)[1]
    assert set(slopes) == set(w)
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            side = []
            for by in (1e-6, -1e-6):
                moved = value.copy()
                moved[at] += by
                side.append(loss(w | {name: moved})[0])
            assert slopes[name][at] == pytest.approx((side[0] - side[1]) / 2e-6, abs=1e-6), (name, at)


def test_the_loss_is_that_of_the_forward_operators(spark, parts, tmp_path):
    """Every token starts and ends a span here, so that each description has slots."""
    tokens, means, labels, semantic, graph = parts
    got = ST.train_span_model(*parts, str(tmp_path / "run"), attention=ATTENTION, epochs=1, steps=1, threshold=0.0, most=3).first()["loss"]
    form = ST.shapes(DIMS, ATTENTION, DIMS, DIMS - 1)
    w = ST.initial_weights(form)

    def of(d):
        def head(n):
            return w[f"{d}.{n}"][:-1].tolist(), float(w[f"{d}.{n}"][-1])

        def matrix(n):
            return w[f"{d}.{n}"][:, :-1].tolist(), w[f"{d}.{n}"][:, -1].tolist()

        return {
            "entity": (head("entity_start"), head("entity_end")), "conditioned": (head("conditioned_start"), head("conditioned_end")), "fuse": {"s": matrix("fuse_s"), "x": matrix("fuse_x")},
            "attention": {"x": matrix("attend_x"), "r": matrix("attend_r"), "g": matrix("attend_g"), "v": w[f"{d}.attend_v"].tolist()},
        }

    rows, all_labels = None, tokens.select("entity_id", "pos").crossJoin(spark.createDataFrame([(k,) for k in ST.KINDS], "kind string"))
    y = all_labels.join(labels.withColumn("y", F.lit(1)), ["entity_id", "pos", "kind"], "left").fillna(0, ["y"])
    out = extract.both_directions(tokens, means, semantic, graph, of("forward"), of("backward"), threshold=0.0, most=3)
    for d, kinds in ST.DIRECTIONS.items():
        first, second = out[d]["entity"], out[d]["conditioned"]
        logits = [(first, "start_logit", kinds[0]), (first, "end_logit", kinds[1]), (second, "start_logit", kinds[2]), (second, "end_logit", kinds[3])]
        for df, column, kind in logits:
            z = losses.strongest(df.select("entity_id", F.lit(kind).alias("kind"), "pos", F.col(column).alias("z"))).withColumn("direction", F.lit(d))
            rows = z if rows is None else rows.unionByName(z)
    want = losses.weighted_loss(rows.join(y, ["entity_id", "pos", "kind"]), losses.positive_weights(y)).first()["loss"]
    assert got == pytest.approx(want, rel=1e-9)


def test_a_stopped_run_goes_on(spark, parts, tmp_path):
    options = {"attention": ATTENTION, "epochs": 3, "steps": 2, "rate": 0.01, "most": 3}
    whole = ST.train_span_model(*parts, str(tmp_path / "whole"), **options)
    ST.train_span_model(*parts, str(tmp_path / "part"), until=1, **options)
    again = ST.train_span_model(*parts, str(tmp_path / "part"), **options)

    def plain(df):
        return {r["name"]: (r["epoch"], r["weight"], r["m"], r["v"]) for r in df.collect()}

    a, b = plain(whole), plain(again)
    assert set(a) == set(ST.shapes(DIMS, ATTENTION, DIMS, DIMS - 1))
    for name, (epoch, *numbers) in a.items():
        assert epoch == b[name][0] == 2
        assert np.allclose(numbers, b[name][1:], rtol=1e-12, atol=0)
    with pytest.raises(ValueError, match="was made with"):
        ST.train_span_model(*parts, str(tmp_path / "part"), **(options | {"rate": 0.02}))


def test_training_learns_the_labels(spark, parts, tmp_path):
    options = {"attention": ATTENTION, "epochs": 40, "steps": 1, "rate": 0.05}
    last = ST.train_span_model(*parts, str(tmp_path / "learn"), **options).first()["loss"]
    first = spark.read.parquet(str(tmp_path / "learn" / "epoch-0000")).first()["loss"]
    assert math.isfinite(last) and last < 0.6 * first


def test_pairs_are_those_of_the_operator(spark):
    r = np.random.default_rng(9)
    for seed in range(30):
        start, end = r.random(12), r.random(12)
        df = spark.createDataFrame([(0, start.tolist(), end.tolist())], "entity_id int, start_prob array<double>, end_prob array<double>")
        if seed < 3:
            assert [(x["s"], x["e"]) for x in extract.extract_spans(df, threshold=0.5, most=4).orderBy("slot").collect()] == ST.paired(start, end, 0.5, 4)
        assert all(0 <= e - s < 4 for s, e in ST.paired(start, end, 0.5, 4))
