"""Alias walks against Python's regular expressions; word pieces and offsets against plain loops."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tests.test_graph import GOLD, TEXTS, TRIPLES, toy  # noqa: F401
from triplewright.functions import tokenizers as TK
from triplewright.functions.text import SPACE, strip
from triplewright.operators import raw_spans, spans
from triplewright.plans import raw_queries


def pattern(alias, legacy):
    body = re.escape(alias.strip()).replace(r"\ ", r"\s*" if legacy else r"\s+")
    return re.compile(rf"\b{body}\b" if legacy else rf"(?<!\w){body}(?!\w)", re.IGNORECASE)


@pytest.mark.parametrize("legacy", [False, True])
@pytest.mark.parametrize("letters", ["ab ", "aB .-", "Éé_1 \t\n(", "aab  　c"])
def test_walks_equal_regular_expressions(legacy, letters):
    r = random.Random(letters + str(legacy))
    seen = 0
    for _ in range(400):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 60)))
        aliases = ["".join(r.choice([c for c in letters if c == " " or not c.isspace()]) for _ in range(r.randrange(0, 6))) for _ in range(6)]
        aliases += [aliases[0], "", " ", text[3:8].replace("\t", " ").replace("\n", " ").replace("　", " ")]
        want = sorted((k, m.start(), m.end()) for k, a in enumerate(aliases) if a.strip() for m in pattern(a, legacy).finditer(text))
        assert sorted(raw_spans.matches(text, aliases, legacy)) == want, (text, aliases)
        seen += len(want)
    assert seen > 300


def test_a_place_costs_no_more_with_many_aliases():
    text = " ".join(f"w{i % 50}" for i in range(4000))
    few = [f"w{i} x{i}" for i in range(50)]
    many = [f"w{i % 50} w{(i + 1) % 50} w{i % 47} x{i}" for i in range(50_000)]
    took = []
    for aliases in (few, many):
        walk = raw_spans.Automaton([a.split() for a in aliases])
        stream = text.split()
        took.append(min(_timed(walk, stream) for _ in range(5)))
    assert took[1] < 6 * took[0] + 0.01


def _timed(walk, stream):
    began = time.perf_counter()
    assert not list(walk.hits(stream))
    return time.perf_counter() - began


def test_word_pieces():
    split = TK.word_pieces(["un", "##aff", "##able", "##a", "able", "want", "##ed", ",", "é", "##é", "##"])()
    assert split("unaffable, wanted xyz ééa able") == (
        ["un", "##aff", "##able", ",", "want", "##ed", TK.UNKNOWN, "é", "##é", "##a", "able"],
        [0, 2, 5, 9, 11, 15, 18, 22, 23, 24, 26], [2, 5, 9, 10, 15, 17, 21, 23, 24, 25, 30],
    )
    assert split("") == ([], [], []) == TK.word_tokens()()("")
    assert TK.word_pieces(["un", "##aff", "##able"], most=2)()("unaffable un")[0] == ["un", "##aff"]
    assert TK.word_pieces(["un"], lower=True)()("UN un")[0] == ["un", "un"]
    assert split("a" * 101)[0] == [TK.UNKNOWN]
    with pytest.raises(ValueError):
        TK.word_pieces(map(str, range(TK.MOST_PIECES + 1)))


def test_offsets_by_binary_search():
    r = random.Random(2)
    for _ in range(200):
        text = "".join(r.choice("ab, .") for _ in range(r.randrange(30)))
        _, starts, ends = TK.word_tokens(most=r.choice([3, 128]))()(text)
        for char in range(-1, len(text) + 1):
            want = next((i for i, (a, b) in enumerate(zip(starts, ends)) if a <= char < b), None)
            assert TK.char_to_token(starts, ends, char) == want
            for end in range(char, len(text) + 1):
                hit = [i for i, (a, b) in enumerate(zip(starts, ends)) if a < end and b > char and char < end]
                assert TK.overlapping(starts, ends, char, end) == ((hit[0], hit[-1]) if hit else None)


def test_gold_rows_of_the_toy_graph_under_both_tokenizers(spark, toy):  # noqa: F811
    triples, descriptions, aliases = toy
    assert sorted(map(tuple, spans.gold_triples(triples, descriptions, aliases, find=raw_spans.raw_alias_spans).collect())) == sorted(GOLD)
    # Texts as they are, upper and lower case and double spaces kept: the same places.
    raw = spark.createDataFrame(TEXTS, "entity_id string, text string, aliases array<string>")
    unlike = {("Q1", "R2", "Q5", 2, 3, 12, 12), ("Q1", "R1", "Q4", 2, 3, 5, 5)}  # a comma is a token of its own here as there
    assert unlike <= set(map(tuple, spans.gold_triples(triples, raw, raw, find=raw_spans.raw_alias_spans).collect()))
    pieces = TK.word_pieces([*"abcdefghijklmnopqrstuvwxyz,", *[f"##{c}" for c in "abcdefghijklmnopqrstuvwxyz"], "honolulu", "ital", "john", "##oe", "a"])

    def find(pairs, texts, names):
        return raw_spans.raw_alias_spans(pairs, texts, names, pieces)

    got = set(map(tuple, spans.gold_triples(triples, descriptions, aliases, find=find).collect()))
    # i | a m -> "am" is two pieces; john, d ##oe; f r o m; honolulu
    assert ("Q1", "R1", "Q4", 3, 5, 10, 10) in got and len({x[:3] for x in got}) == len(set(TRIPLES))
    text = descriptions.where("entity_id = 'Q1'").first()["text"]
    held, starts, ends = pieces()(text)
    for h, _, t, hs, he, ts, te in got:
        if h == "Q1":
            assert text[starts[hs] : ends[he]] == "john doe" and text[starts[ts] : ends[te]] in ("honolulu", "italy")
    labels = spans.silver_labels(triples, descriptions, aliases, find=find)
    assert {(r["kind"], r["pos"]) for r in labels.where("entity_id = 'Q1' and kind like 'h%'").collect()} == {("h_s", 3), ("h_e", 5)}


def test_blocks_of_aliases_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(raw_spans, "BLOCK", 3)
    texts = spark.createDataFrame([("A", "one TWO\n\tthree one two"), ("B", None), ("C", "")], "entity_id string, text string")
    names = [f"x{i}" for i in range(20)] + ["two  three", "two three", "One", None, "", "two"]
    aliases = spark.createDataFrame([("A", names), ("B", ["one"]), ("C", ["one"])], "entity_id string, aliases array<string>")
    pairs = spark.createDataFrame([("A", "A"), ("A", "B"), ("B", "A"), ("C", "B"), ("Z", "A")], "h string, entity string")
    got = sorted(map(tuple, raw_spans.raw_alias_spans(pairs, texts, aliases).select("h", "entity", "alias", "start", "end", "s", "e").collect()))
    assert got == [
        ("A", "A", "One", 0, 3, 0, 0), ("A", "A", "One", 15, 18, 3, 3), ("A", "A", "two", 4, 7, 1, 1), ("A", "A", "two", 19, 22, 4, 4), ("A", "A", "two  three", 4, 14, 1, 2),
        ("A", "A", "two three", 4, 14, 1, 2), ("A", "B", "one", 0, 3, 0, 0), ("A", "B", "one", 15, 18, 3, 3),
    ]
    assert TK.token_rows(texts, TK.word_tokens()).where(F.col("entity_id") == "A").count() == 5


def test_first_words_are_those_of_the_stripped_text(spark):
    """They came out of the whole text, stripped by a pattern that met every white space of it, several times."""
    texts = ["", " ", None, "one", "  one", "one ", " one\ttwo three", "one\u3000\u00a0two", "a  b  c ", "\u0085\n", "x" * 9000 + " y z", "x" + " " * 4000, "x" + " " * 4000 + "y z", " " * 4000 + "x\n\ny"]
    kept = spark.createDataFrame([(x,) for x in texts], "text string").select(F.split(raw_queries.first_words(F.col("text")), f"[{SPACE}]+", -1).alias("a"), F.slice(F.split(strip(F.col("text")), f"[{SPACE}]+", 3), 1, 2).alias("b"))
    assert [r["a"] for r in kept.collect()] == [r["b"] for r in kept.collect()]


@pytest.mark.parametrize("query", [raw_queries.raw_alias_spans, raw_queries.raw_alias_spans_legacy])
def test_no_text_is_stripped(spark, query):
    assert "regexp_replace" not in query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("make", [TK.word_tokens(), TK.word_pieces(["un", "##aff", "able", "##able"], 128)])
def test_only_openings_are_exchanged(spark, make):
    """Whole texts were exchanged, of which 128 tokens are looked at."""
    texts = ["one two " * 2000, "unaffable " * 2000, "", None, " \t", "x"]
    rows = spark.createDataFrame([(f"D{i}", t) for i, t in enumerate(texts)], "entity_id string, text string")
    got = {r["entity_id"]: r for r in raw_spans.openings(rows, make).collect()}
    assert sorted(got) == ["D0", "D1", "D5"]
    for k, r in got.items():
        text = texts[int(k[1:])]
        _, starts, ends = make()(text)
        assert (r["text"], r["starts"], r["ends"]) == (text[: ends[-1] + 1], starts, ends) and len(r["text"]) < 2000
    names = rows.select("entity_id", F.array(F.lit("one"), F.lit("affable")).alias("aliases"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = raw_spans.raw_alias_spans(rows.select(F.col("entity_id").alias("h"), F.col("entity_id").alias("entity")), rows, names, make)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    below = plan[plan.rindex("Exchange") :]
    assert "MapInArrow" in below and "text#" in below


@pytest.mark.parametrize("query", [raw_queries.raw_alias_spans, raw_queries.raw_alias_spans_legacy])
def test_first_words_are_found_once_a_scan(spark, query):
    """They were found again for each word, and for filters that Spark infers, in whole texts."""
    plan = query(spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") == plan.count("posexplode(") == 2


@pytest.mark.parametrize("legacy", [False, True])
def test_no_trie_of_aliases_that_a_text_lacks(monkeypatch, legacy):
    """A trie of all aliases was made for each text, and walked letter by letter."""
    made, walk = [], raw_spans.Automaton
    monkeypatch.setattr(raw_spans, "Automaton", lambda patterns: made.append(len(patterns)) or walk(patterns))
    many = [f"some{i} thing{i}" for i in range(200)]
    assert not list(raw_spans.matches("not a thing of theirs", many, legacy)) and not sum(made)
    assert sorted(raw_spans.matches("Some 7 some7  thing7", many, legacy)) == [(7, 7, 20)] and sum(made) < 3
    made.clear()
    assert sorted(raw_spans.matches("A b", ["a", "B", "c"], legacy)) == [(0, 0, 1), (1, 2, 3)] and sum(made) == (0 if legacy else 2)


def test_few_and_many_aliases_give_the_same_matches(monkeypatch):
    r = random.Random(7)
    for _ in range(2000):
        letters = r.choice(["ab ", "aB .-", "ΣσςΑα ", "İiI ıſsKk", "a \u0085　b,"])
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 50)))
        aliases = ["".join(r.choice(letters) for _ in range(r.randrange(6))) for _ in range(6)] + [text[3:9], text[:4]]
        got = []
        for few in (0, 1024):
            monkeypatch.setattr(raw_spans, "FEW", few)
            got.append(sorted(raw_spans.matches(text, aliases, True)))
        assert got[0] == got[1], (text, aliases)
        assert list(raw_spans.letters_of(text)) == [raw_spans.folded(c) for c in text if not c.isspace()]
