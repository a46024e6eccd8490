"""Held-out accuracy of what is learned, exact Viterbi, and defined results of odd input."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.conftest import DATA
from tests.llm import brute
from triplewright.llm import classifier, language, queries


def fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_classifier_holds_out_and_predicts(spark):
    d = f"{DATA}/sf0.01"
    rows = {r["doc_id"]: r for r in queries.op6_classifier(spark, d).collect()}
    truth = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert all(r["held_out"] == fold(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in rows.items())
    held = [(rows[i]["predicted"], y) for i, y in truth.items() if fold(i)]
    assert sum(p == y for p, y in held) / len(held) > 0.9
    assert all(p == 1 for p, y in held if y == 1)


def test_classifier_on_odd_input(spark):
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(brute.EDGE)] + [(None, "x", 2.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    rows = classifier.classify(df, labels).collect()
    assert len(rows) == len(brute.EDGE) + 1 and {r["score"] for r in rows} == {0.5}
    assert classifier.classify(df.limit(0), labels).count() == 0


def plain_model(rows, labels, sample=None):
    """Indicator dicts, log-count ratios, dual coordinate descent and scores, a feature at a time."""
    c = classifier
    room = c.DIMS - c.SHARES

    def indicators(text):
        tokens = [zlib.crc32(t.encode()) for t in re.findall(r"[^\W_]+|[^\w\s]+|_+", text or "")]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) % 2**64 >> 20) % room for a, b in zip(tokens, tokens[1:])]
        tenths = (len(pairs) - len(set(pairs))) * (c.SHARES - 1) // len(pairs) if pairs else 0
        return {t % room for t in tokens} | set(pairs) | {room + tenths}

    teach = sorted(((i, sorted(indicators(t)), labels[i]) for i, t in rows if i in labels and not fold(i)), key=lambda x: x[0])
    counts = [Counter(), Counter()]
    for _, x, y in teach:
        counts[y].update(x)
    totals = [sum(n.values()) + c.SMOOTH * c.DIMS for n in counts]
    seen = set(counts[0]) | set(counts[1])
    ratio = {d: math.log((counts[1][d] + c.SMOOTH) / totals[1]) - math.log((counts[0][d] + c.SMOOTH) / totals[0]) for d in seen}
    n = [sum(y == k for *_, y in teach) for k in (0, 1)]
    weight, bias, alpha, order = Counter(), 0.0, [0.0] * len(teach), np.random.default_rng(7)
    for _ in range(c.ROUNDS):
        worst = 0.0
        for i in order.permutation(len(teach)).tolist():
            _, x, y = teach[i]
            length = math.sqrt(sum(ratio[d] ** 2 for d in x)) or 1e-9
            sign, most = (1 if y else -1), c.COST * len(teach) / (2 * n[y])
            slope = sign * (sum(weight[d] * ratio[d] / length for d in x) + bias) - 1
            held = min(slope, 0) if alpha[i] <= 0 else max(slope, 0) if alpha[i] >= most else slope
            if abs(held) > 1e-9:
                worst = max(worst, abs(held))
                new = min(max(alpha[i] - slope / 2, 0), most)
                for d in x:
                    weight[d] += (new - alpha[i]) * sign * ratio[d] / length
                bias += (new - alpha[i]) * sign
                alpha[i] = new
        if worst < 1e-3:
            break

    def score(text):
        x = indicators(text)
        length = max(math.sqrt(sum(ratio.get(d, 0) ** 2 for d in x)), 1e-9)
        return 1 / (1 + math.exp(-c.ODDS * min(max(sum(weight[d] * ratio.get(d, 0) for d in x) / length + bias, -50), 50)))

    return score


def test_classifier_equals_a_plain_version(spark):
    d = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(10_000 + i, t) for i, t in enumerate(brute.EDGE)]
    score = plain_model(rows, labels)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in classifier.classify(df, spark.read.parquet(f"{d}/labels.parquet")).collect():
        assert r["score"] == pytest.approx(score(dict(rows)[r["doc_id"]]), abs=2e-5), r


def test_samples_are_bounded_and_repeats_teach_once(spark, monkeypatch):
    rows = [(i, f"good words here {i} " * 5 if i % 2 else f"### bad {i} ### " * 5) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id long, quality int")
    once, twice = classifier.train(df, labels), classifier.train(df.unionAll(df), labels)
    assert all((a == b).all() if hasattr(a, "all") else a == b for a, b in zip(once, twice))
    monkeypatch.setattr(classifier, "SAMPLE_CHARS", 3000)
    assert 0 < (classifier.train(df, labels)[1] > 0).sum() < (once[1] > 0).sum() / 3


def test_classifier_of_very_long_texts(spark):
    df = spark.createDataFrame([(1, "good words " * 300_000, 1), (2, "### bad " * 300_000, 1), (3, None, 1), (6, "good words", 1), (7, "### bad", 1)], "doc_id long, text string, label int")
    rows = {r["doc_id"]: r["score"] for r in classifier.classify(df, spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, 0)], "doc_id long, quality int")).collect()}
    assert rows[1] > 0.5 > rows[2] and len(rows) == 5


def best_path(scores, switch):
    def value(path):
        return sum(s[p] for s, p in zip(scores, path)) - switch * sum(a != b for a, b in zip(path, path[1:]))

    return max(value(p) for p in itertools.product(range(scores.shape[1]), repeat=len(scores))), value


def test_viterbi_is_exact():
    rng = np.random.default_rng(3)
    scores = [-rng.integers(0, 7, (int(rng.integers(1, 8)), 3)).astype(np.float32) for _ in range(60)]
    for s, path in zip(scores, language.viterbi(scores, 4.0)):
        best, value = best_path(s, 4.0)
        assert value(path.tolist()) == best


def test_language(spark):
    rows = queries.op7_language(spark, f"{DATA}/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == fold(r["doc_id"]) for r in rows)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.98
