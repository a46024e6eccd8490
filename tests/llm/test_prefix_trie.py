"""The conversation trie against a plain version: families, shared starts, odd rows, long chains, many equal conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from triplewright.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string, c long, d string, owner string, place string"


def plain(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + own[h:]
    members, children = defaultdict(list), defaultdict(list)
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(whole[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 7, "x", None, "y") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, P.prefix_trie(df).collect()), key=repr)


def talk(seed, convs, most, words):
    r = random.Random(seed)
    return [(c, t, r.choice(["user", "assistant"]) if words > 2 else "user", f"é{r.randrange(words)}") for c in r.sample(range(-40, 200), convs) for t in range(r.randrange(1, most))]


ODD = [
    (None, 0, "user", "no conversation"), (5, None, None, None), (5, 0, "user", ""), (5, 0, "user", ""), (6, 1, "a", "b"), (6, 1, "ab", ""), (6, None, "", "ab"), (0, 3, "user", "x"),
    (-3, 0, "user", "x"), (3, 0, "user", "x"), (11, 0, "user", "11 alone"), (7, -5, "user", "\U0001f600"), (7, 2**40, "user", "y"), (9, 0, "user", ""),
]


@pytest.mark.parametrize("rows", [[], ODD[:1], ODD, talk(1, 60, 6, 2), talk(2, 80, 12, 3), talk(3, 20, 40, 1)])
def test_equals_the_plain_version(spark, monkeypatch, rows):
    monkeypatch.setattr(P, "BLOCK", 4)
    monkeypatch.setattr(P, "RUN", 5)
    monkeypatch.setattr(P, "PIECE", 3)
    assert trie(spark, rows) == plain(rows)


def test_a_conversation_of_a_third_of_all_rows_and_many_equal_ones(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 64)
    long = [(1000, t, "user", f"t{t % 7}") for t in range(700)]
    equal = [(2000 + 5 * i, t, "user", f"t{t % 7}") for i in range(60) for t in range(9)]
    rows = long + equal + talk(4, 100, 9, 4)
    assert trie(spark, rows, 5) == plain(rows)


def test_sums_of_a_deep_chain(spark):
    """Doubled pointers: a path of 37 links takes six rounds."""
    n = 37
    df = spark.createDataFrame([(i, i - 1 if i else None, 1, i) for i in range(n)] + [(100, 3, 5, 0)], "c long, up long, a long, b long")
    got = {r["c"]: (r["a"], r["b"]) for r in P.subtree_sums(df, ["a", "b"], P.Scratch(spark, "t")).collect()}
    assert got == {i: (n - i + 5 * (i <= 3), sum(range(i, n))) for i in range(n)} | {100: (5, 0)}


def test_running_sums_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(P, "RUN", 8)
    df = spark.range(100).select(F.lit("k").alias("k"), "id", F.col("id").alias("v")).union(spark.range(3).select(F.lit("j"), "id", F.lit(1)))
    got = {(r["k"], r["id"]): r["v"] for r in P.running_sums(df, "k", F.col("id"), ["v"]).collect()}
    assert got == {("k", i): i * (i + 1) // 2 for i in range(100)} | {("j", i): i + 1 for i in range(3)}
