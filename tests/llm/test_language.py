"""The whole language prediction against a plain restatement, long texts in segments, and defined results of odd input."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from triplewright.llm import language as L

EN, DE = "the cat and the dog sat on the mat ", "der hund und die katze auf dem dach "
RU = "кот и собака сидят на крыше "


def words(text):
    out = [""]
    for c in text.lower():
        if unicodedata.category(c)[0] == "L":
            out[-1] += c
        elif out[-1]:
            out.append("")
    return [w for w in out if w]


def buckets(word):
    marked = [2, *map(ord, word), 3]
    for n in L.LENGTHS:
        for i in range(len(marked) - n + 1):
            h = 0
            for k, c in enumerate(marked[i : i + n], 1):
                h = (h * 0x100000001B3 + c + k) % 2**64
            yield h * 0x9E3779B97F4A7C15 % 2**64 >> 48


def plain_predictions(rows):
    """[(id, text, lang)] -> {id: (lang_pred, score, spans)} with every teaching row in the sample."""
    grams, scripts = defaultdict(Counter), defaultdict(Counter)
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 5:
            grams[lang].update(b for w in words(text) for b in buckets(w))
            scripts[lang].update(L.script_of(w) for w in words(text))
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) + L.SMOOTH * L.BUCKETS for x in langs}

    def scores(word):
        there = [x for x in langs if scripts[x][L.script_of(word)] >= max(sum(scripts[x].values()) * L.LEAST_SHARE, 1)]
        raw = {x: sum(math.log((grams[x][b] + L.SMOOTH) / total[x]) for b in buckets(word)) for x in there}
        return [max(raw[x] - max(raw.values()), -L.MOST) if x in raw else -L.MOST if raw else 0.0 for x in langs]

    out = {}
    for i, text, _ in rows:
        found = words(text or "")
        if not found or not langs:
            out[i] = "und", 0.0, ""
            continue
        s = [scores(w) for w in found]
        best, back = list(s[0]), []
        for now in s[1:]:
            top = max(range(len(langs)), key=lambda k: (best[k], -k))
            come = [top if best[top] - L.SWITCH > best[k] else k for k in range(len(langs))]
            back.append(come)
            best = [max(best[top] - L.SWITCH, best[k]) + now[k] for k in range(len(langs))]
        path = [max(range(len(langs)), key=lambda k: (best[k], -k))]
        for come in reversed(back):
            path.append(come[path[-1]])
        path.reverse()
        runs = []
        for w, k, one in zip(found, path, s):
            if not runs or runs[-1][0] != k:
                runs.append([k, 0, 0, [0.0] * len(langs)])
            runs[-1][1] += 1
            runs[-1][2] += len(w)
            runs[-1][3] = [a + b for a, b in zip(runs[-1][3], one)]
        letters = Counter()
        for k, _, n, _ in runs:
            letters[k] += n
        top = max(letters, key=lambda k: (letters[k], -k))
        sure = sum(n / sum(math.exp(x - z[k]) for x in z) for k, _, n, z in runs if k == top)
        out[i] = langs[top], sure / sum(letters.values()), " ".join(f"{langs[k]}:{n}" for k, n, _, _ in runs)
    return out


ROWS = (
    [(i, EN * (1 + i % 3), "en") for i in range(12)] + [(20 + i, DE * (1 + i % 2), "de") for i in range(12)] + [(40 + i, RU, "ru") for i in range(10)]
    + [(60 + i, "wort ohne namen", "") for i in range(4)] + [(70, None, "xx"), (71, "", "en"), (72, "12 ½ Ⅳ ²", "de")]
    + [(100 + i, t, None) for i, t in enumerate([EN * 4 + DE * 6, EN * 5 + RU * 5 + DE, "漢字", "漢字 the cat and the dog", "²", "½ Ⅳ", None, "", "x", "ªº", "кот the кот", "dog " * 400])]
    + [(100, EN, None), (None, DE, None)]
)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, 1.0, "s") for r in ROWS], "doc_id long, text string, lang string, score double, spans string")


def test_predictions_equal_a_plain_version(table):
    want = plain_predictions([r for r in ROWS if r[0] is not None])
    got = L.identify(table).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r["doc_id"] not in (None, 100):
            lang, score, spans = want[r["doc_id"]]
            assert (r["lang_pred"], r["spans"]) == (lang, spans), r
            assert r["score"] == pytest.approx(score, abs=1e-4), r
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (104, 105, 106, 107)] == ["und"] * 4 and by[102]["score"] == pytest.approx(0.25)
    assert by[101]["spans"].count(":") > 1 and by[60]["lang_pred"] == ""


def test_every_language_is_learned(spark):
    names = [f"l{k:03}" for k in range(230)]
    rows = [(10 * k + j, f"{chr(97 + k % 26)}{chr(97 + k // 26)}q " * 30, x) for k, x in enumerate(names) for j in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(L.train(df).langs) == taught and len(taught) > 220
    pred = {r["doc_id"]: r["lang_pred"] for r in L.identify(df).collect()}
    assert all(pred[i] == x for i, _, x in rows if x in taught)


def test_long_texts_in_segments(table, monkeypatch):
    model = L.train(table)
    text = (EN * 7 + DE * 5 + RU * 4) * 30 + "漢字 " * 40 + DE * 50
    labeller = L.Labeller(model)
    whole = labeller.label([text])[0]
    for size in (1, 7, 100, 10**6):
        part = labeller.label_long(text, size)
        for name in ("lang", "words", "letters"):
            assert getattr(part, name).tolist() == getattr(whole, name).tolist()
        assert np.allclose(part.sure, whole.sure, atol=1e-5)
    monkeypatch.setattr(L, "CELLS", 1000)
    small = L.Labeller(model)
    assert small.step == 1000 // len(model.langs)
    (name, score), (want, exact) = small.language(small.label([text])[0]), labeller.language(whole)
    assert name == want and score == pytest.approx(exact, abs=1e-5)


def test_a_text_of_millions_of_characters(spark, table):
    df = spark.createDataFrame([(1, EN * 150_000), (2, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.identify(df.selectExpr("*", "cast(null as string) lang").unionByName(table.select("doc_id", "text", "lang"))).where("doc_id <= 2 and spans <> ''").collect()}
    assert got[1]["lang_pred"] == "en"


def test_empty_table(spark, table):
    assert L.identify(table.limit(0)).count() == 0
    assert {r["lang_pred"] for r in L.identify(table.where("lang is null")).collect()} == {"und"}
