"""The lazy state of embedding training: the dense optimiser's result, no exchange of the state, two states on disk at most."""

import glob
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from triplewright import storage
from triplewright.operators import transe

N, R, DIMS = 60, 4, 5


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(3)
    rows = [(r.randrange(N), 0 if r.random() < 0.5 else r.randrange(R), r.randrange(N)) for _ in range(70)]
    return spark.createDataFrame(rows, "h_idx long, r_idx long, t_idx long"), spark.range(N).withColumnRenamed("id", "idx"), spark.range(R).withColumnRenamed("id", "idx")


def dense(graph, epochs, steps, rate, p, unit):
    """Every vector moved in every step, in plain loops."""
    encoded, entities, relations = graph
    state = {}
    for r in transe.named(transe.start_state(entities, relations, N, R, DIMS)).collect():
        state[r["kind"], r["idx"]] = [np.array(r["emb"]), np.zeros(DIMS), np.zeros(DIMS)]
    for epoch in range(epochs):
        lr = rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))
        pairs = transe.dealt(transe.negatives(encoded, N, epoch), epoch, steps).collect()
        for step in range(steps):
            batch, turn = [x for x in pairs if x["shard"] == step], epoch * steps + step + 1
            if not batch:
                continue
            g = {k: np.zeros(DIMS) for k in state}
            for x in batch:
                h, t, nh, nt, rel = (state[k][0] for k in (("e", x["h_idx"]), ("e", x["t_idx"]), ("e", x["nh_idx"]), ("e", x["nt_idx"]), ("r", x["r_idx"])))
                good, bad = h + rel - t, nh + rel - nt
                size = (lambda v: np.abs(v).sum()) if p == 1 else (lambda v: np.sqrt((v * v).sum()))
                if 1 + size(good) - size(bad) > 0:
                    up, down = (np.sign(v) if p == 1 else v / max(size(v), 1e-12) for v in (good, bad))
                    for k, move in ((("e", x["h_idx"]), up), (("e", x["t_idx"]), -up), (("e", x["nh_idx"]), -down), (("e", x["nt_idx"]), down), (("r", x["r_idx"]), up - down)):
                        g[k] += move
            for k, held in state.items():
                slope = g[k] / len(batch)
                held[1], held[2] = 0.9 * held[1] + 0.1 * slope, 0.999 * held[2] + 0.001 * slope * slope
                held[0] = held[0] - lr * (held[1] / (1 - 0.9**turn)) / (np.sqrt(held[2] / (1 - 0.999**turn)) + 1e-8)
                if k[0] in unit:
                    q = unit[k[0]]
                    held[0] = held[0] / max(np.abs(held[0]).sum() if q == 1 else np.sqrt((held[0] ** 2).sum()), 1e-12)
    return {k: v[0] for k, v in state.items()}


@pytest.mark.parametrize("epochs,steps,p,unit", [(3, 5, 1, {"e": 2}), (2, 3, 2, {"e": 1, "r": 1})])
def test_equals_the_dense_optimiser(graph, epochs, steps, p, unit):
    got = transe.train(*graph, N, R, dims=DIMS, epochs=epochs, steps=steps, rate=0.05, p=p, unit=unit)
    want = dense(graph, epochs, steps, 0.05, p, unit)
    held = {(kind, r["idx"]): r["emb"] for kind, df in zip("er", got, strict=True) for r in df.collect()}
    assert set(held) == set(want)
    for k, v in want.items():
        assert np.allclose(held[k], v, rtol=1e-9, atol=1e-12), k


def test_the_state_is_met_without_an_exchange(spark, graph, tmp_path):
    base = storage.Buckets(spark, f"file://{tmp_path}/base", transe.STATE, 8)
    base.add(transe.start_state(graph[1], graph[2], N, R, DIMS))
    state = transe._State(storage.Scratch(spark, "t"), base)
    state.add(base.rows().where("id < 7").withColumn("turn", F.lit(1)), 7)
    batch = transe.dealt(transe.negatives(graph[0], N), 0, 2).where("shard = 0")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = state.latest().join(transe.batch_ids(batch), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above: list[tuple[int, str]] = []
    scans = 0
    for line in plan.splitlines():
        depth = len(line) - len(line.lstrip(" :+-*(0123456789)"))
        above = [x for x in above if x[0] < depth] + [(depth, line)]
        if "buckets_" in line and "Scan" in line:
            scans += 1
            assert not any(re.search(r"\bExchange\b", x) for _, x in above), plan
    assert scans == 2 and "Exchange" in plan  # base and log; only the batch's ids move
    assert {r["id"]: r["turn"] for r in state.latest().collect()} == {i: int(i < 7) for i in range(-R, N)}
    state.log.forget()
    base.forget()


def test_two_states_on_disk_and_a_manifest(spark, graph, tmp_path, monkeypatch):
    seen = []
    inner = transe._State.add

    def add(self, rows, n):
        inner(self, rows, n)
        root = self.scratch.root.removeprefix("file://")
        seen.append(len(glob.glob(f"{root}/start") + glob.glob(f"{root}/state-*") + glob.glob(f"{tmp_path}/run/epoch-*")) + (len(glob.glob(f"{root}/log-*")) > 1))

    monkeypatch.setattr(transe._State, "add", add)
    options = {"dims": DIMS, "epochs": 3, "steps": 4, "rate": 0.05, "folder": f"file://{tmp_path}/run"}
    first = transe.train(*graph, N, R, until=1, **options)
    assert sorted(r["idx"] for r in first[0].collect()) == list(range(N))
    again = transe.train(*graph, N, R, **options)
    monkeypatch.undo()
    whole = transe.train(*graph, N, R, **{**options, "folder": f"file://{tmp_path}/whole"})
    assert [sorted((r["idx"], r["emb"]) for r in df.collect()) for df in again] == [sorted((r["idx"], r["emb"]) for r in df.collect()) for df in whole]
    assert max(seen) <= 2 and len(glob.glob(f"{tmp_path}/run/epoch-*")) == 1
    for other in ({"dims": 6}, {"steps": 2}, {"seed": 1}):
        with pytest.raises(ValueError, match="was made with"):
            transe.train(*graph, N, R, **(options | other))


def test_nothing_to_learn_from(graph):
    e, r = transe.train(graph[0].limit(0), graph[1], graph[2], N, R, dims=DIMS, epochs=1, steps=2)
    assert e.count() == N and r.count() == R


def test_the_arithmetic_is_not_made_number_by_number(spark, graph):
    """Slopes, steps and what was missed were folds over each number, read anew for each of a turn's powers."""
    state = transe.start_state(graph[1], graph[2], N, R, DIMS)
    sums = transe.slopes(transe.negatives(graph[0], N), transe.named(state))
    for df in (sums, transe.made_up(state, 3, [0.1] * 3, {"e": 2}), transe.adam(state, sums, 70, 1, 0.1, {"e": 2})):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        top = plan[: plan.rindex("MapInArrow")]
        assert "zip_with" not in top and "aggregate(" not in top
    assert {r["turn"] for r in transe.made_up(state, 3, [0.1] * 3, {"e": 2}).collect()} == {3}
