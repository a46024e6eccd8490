"""Queries over texts as they are, and over word pieces."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import tokenizers as TK
from triplewright.functions import vectors as V
from triplewright.functions.text import MAX_TOKENS, SPACE
from triplewright.operators import raw_spans as R
from triplewright.operators import spans as S
from triplewright.plans import graph as G

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: Longest piece that a word of a part's name gives, besides the word itself.
PIECE = 4

_LETTER = r"[\p{L}\p{N}_]"
_WORD = G.sql_text(rf"{_LETTER}+|[^\p{{L}}\p{{N}}_{SPACE}]")
_SPACES = G.sql_text(f"[{SPACE}]")


def _is_word(x: str) -> str:
    return f"regexp_matches({x}, {G.sql_text(f'^{_LETTER}$')})"


#: Texts with their first tokens, the white space before each, and where each begins (from 0).
_TEXTS = f"""WITH triples AS ({G.SQL_TRIPLES}), raw AS (SELECT 'D' || doc_id AS entity_id, coalesce(text, '') AS text FROM documents),
cut AS (SELECT entity_id, text, regexp_extract_all(text, {_WORD})[1:{MAX_TOKENS}] AS t, list_transform(regexp_split_to_array(text, {_WORD})[1:{MAX_TOKENS}], lambda x: length(x)) AS g FROM raw),
texts AS MATERIALIZED (SELECT *, list_transform(range(1, len(t) + 1), lambda k: (list_sum(g[1:k]) + coalesce(list_sum(list_transform(t[1:k - 1], lambda x: length(x))), 0))::BIGINT) AS starts, list_transform(t, lambda x: lower(x)) AS low FROM cut),
words AS (SELECT entity_id, list_filter(string_split_regex(text, '[{SPACE}]+'), lambda x: x <> '')[1:2] AS w FROM raw),
listed AS (SELECT entity_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE [w[1], w[1] || ' ' || w[2]] END AS l FROM words),
aliases AS (SELECT entity_id, unnest(l) AS alias, generate_subscripts(l, 1) - 1 AS pos FROM listed), pairs AS (SELECT h, h AS entity FROM triples UNION SELECT h, t FROM triples)"""
_RAW = f"""{_TEXTS}, named AS (
  SELECT *, list_transform(regexp_extract_all(alias, {_WORD}), lambda x: lower(x)) AS u, list_transform(regexp_split_to_array(alias, {_WORD}), lambda x: length(x)) AS gaps FROM aliases
), hits AS (
  SELECT p.h, p.entity, a.alias, a.pos, d.text, d.t, d.starts, len(u) AS n, list_filter(range(1, len(d.t) - len(u) + 2), lambda i: d.low[i] = u[1] AND d.low[i:i + len(u) - 1] = u
      AND len(list_filter(range(1, len(u)), lambda k: NOT CASE WHEN gaps[k + 1] = 0 THEN d.g[i + k] = 0 ELSE d.g[i + k] >= gaps[k + 1] END)) = 0
      AND NOT (d.starts[i] > 0 AND {_is_word('substr(d.text, d.starts[i], 1)')}) AND NOT {_is_word('substr(d.text, d.starts[i + len(u) - 1] + length(d.t[i + len(u) - 1]) + 1, 1)')}) AS hit
  FROM pairs p JOIN named a ON a.entity_id = p.entity JOIN texts d ON d.entity_id = p.h WHERE len(u) > 0 AND list_contains(d.low, u[1])
), each AS (
  SELECT *, unnest(list_reduce(list_transform(hit, lambda i: [i]), lambda x, y: CASE WHEN y[1] >= x[len(x)] + n THEN list_concat(x, y) ELSE x END)) AS i FROM hits WHERE len(hit) > 0)
SELECT h, entity, alias, pos::INT AS pos, starts[i]::INT AS start, (starts[i + n - 1] + length(t[i + n - 1]))::INT AS "end", (i - 1)::INT AS s, (i + n - 2)::INT AS e FROM each"""
_LEGACY = f"""{_TEXTS}, seen AS (
  SELECT *, starts[-1] + length(t[-1]) AS last, substr(text, 1, (starts[-1] + length(t[-1]) + 1)::BIGINT) AS c FROM texts WHERE len(t) > 0
), spread AS (SELECT *, list_filter(range(1, length(c) + 1), lambda i: NOT regexp_matches(substr(c, i, 1), {_SPACES})) AS p FROM seen
), dense AS MATERIALIZED (SELECT *, lower(array_to_string(list_transform(p, lambda i: substr(c, i, 1)), '')) AS low_c FROM spread
), named AS (
  SELECT *, lower(regexp_replace(alias, {_SPACES}, '', 'g')) AS u, list_filter(range(1, length(alias) + 1), lambda i: NOT regexp_matches(substr(alias, i, 1), {_SPACES})) AS ap FROM aliases
), hits AS (
  SELECT x.h, x.entity, a.alias, a.pos, d.p, d.starts, d.last, length(u) AS n, list_filter(range(1, len(d.p) - length(u) + 2), lambda i: substr(d.low_c, i, length(u)) = u
      AND len(list_filter(range(1, length(u)), lambda k: ap[k + 1] - ap[k] = 1 AND d.p[i + k] - d.p[i + k - 1] > 1)) = 0
      AND (d.p[i] > 1 AND {_is_word('substr(d.c, greatest(d.p[i] - 1, 1), 1)')}) <> {_is_word('substr(d.c, d.p[i], 1)')}
      AND {_is_word('substr(d.c, d.p[i + length(u) - 1] + 1, 1)')} <> {_is_word('substr(d.c, d.p[i + length(u) - 1], 1)')}) AS hit
  FROM pairs x JOIN named a ON a.entity_id = x.entity JOIN dense d ON d.entity_id = x.h WHERE length(u) > 0 AND contains(d.low_c, u)
), each AS (
  SELECT *, unnest(list_reduce(list_transform(hit, lambda i: [i]), lambda x, y: CASE WHEN y[1] >= x[len(x)] + n THEN list_concat(x, y) ELSE x END)) AS i FROM hits WHERE len(hit) > 0)
SELECT h, entity, alias, pos::INT AS pos, (p[i] - 1)::INT AS start, p[i + n - 1]::INT AS "end", (len(list_filter(starts, lambda x: x <= p[i] - 1)) - 1)::INT AS s, (len(list_filter(starts, lambda x: x <= p[i + n - 1] - 1)) - 1)::INT AS e
FROM each WHERE p[i + n - 1] <= last"""


def first_words(text: Column) -> Column:
    """A text's first two words with what is between them; what follows isn't read."""
    return F.regexp_extract(text, f"^[{SPACE}]*+([^{SPACE}]++(?:[{SPACE}]++[^{SPACE}]++)?)", 1)


def raw_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples, texts as they are, and each text's first word and first two words as its aliases."""
    g = G.TextGraph(spark, d)
    texts = g.docs.select(g.ident.alias("entity_id"), F.coalesce("text", F.lit("")).alias("text"))
    w = V.bound(F.split(first_words(F.col("text")), f"[{SPACE}]+", -1), lambda w: F.array(F.get(w, F.lit(0)), F.concat(F.get(w, F.lit(0)), F.lit(" "), F.get(w, F.lit(1)))))
    return g.triples, texts, texts.select("entity_id", F.filter(w, lambda a: a.isNotNull() & (a != "")).alias("aliases"))


def raw_alias_spans(spark: SparkSession, d: str) -> DataFrame:
    triples, texts, aliases = raw_graph(spark, d)
    return R.raw_alias_spans(S.entity_pairs(triples), texts, aliases)


def raw_alias_spans_legacy(spark: SparkSession, d: str) -> DataFrame:
    triples, texts, aliases = raw_graph(spark, d)
    return R.raw_alias_spans(S.entity_pairs(triples), texts, aliases, legacy=True)


# --- word pieces -----------------------------------------------------------------------

_VOCABULARY = f"""part_words AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part),
places AS (SELECT w, unnest(range(1, length(w) + 1)) AS i FROM part_words), sizes AS (SELECT w, i, unnest(range(1, {PIECE + 1})) AS n FROM places),
vocabulary AS (SELECT list(DISTINCT piece) AS v, max(length(piece)) AS longest FROM (SELECT w AS piece FROM part_words UNION ALL SELECT CASE WHEN i > 1 THEN '##' ELSE '' END || substr(w, i, n) FROM sizes WHERE i + n <= length(w) + 1
  UNION ALL SELECT chr(k::INT) FROM range(97, 123) x(k) UNION ALL SELECT '##' || chr(k::INT) FROM range(97, 123) x(k)) WHERE piece <> '')"""
_T = G.sql_text(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]")
_PIECES = f"""toks AS MATERIALIZED (SELECT entity_id, t, list_transform(range(1, len(t) + 1), lambda k: (list_sum(g[1:k]) + coalesce(list_sum(list_transform(t[1:k - 1], lambda x: length(x))), 0))::BIGINT) AS starts FROM (
  SELECT entity_id, regexp_extract_all(text, {_T})[1:{MAX_TOKENS}] AS t, list_transform(regexp_split_to_array(text, {_T})[1:{MAX_TOKENS}], lambda x: length(x)) AS g FROM descriptions)),
cuts(w, here, pieces) AS (SELECT DISTINCT unnest(t), 0, []::VARCHAR[] FROM toks UNION ALL
  SELECT w, CASE WHEN n IS NULL THEN -1 ELSE here + n END, CASE WHEN n IS NULL THEN ['{TK.UNKNOWN}'] ELSE list_append(pieces, CASE WHEN here > 0 THEN '##' ELSE '' END || substr(w, here + 1, n)) END FROM (
    SELECT w, here, pieces, list_filter(list_reverse(range(1, longest + 1)), lambda n: length(w) <= {TK.MOST_LETTERS} AND here + n <= length(w) AND list_contains(v, CASE WHEN here > 0 THEN '##' ELSE '' END || substr(w, here + 1, n)))[1]::INT AS n FROM cuts, vocabulary WHERE here >= 0 AND here < length(w))),
whole_words AS MATERIALIZED (SELECT w, pieces FROM cuts WHERE here = -1 OR here = length(w)),
placed AS (SELECT entity_id, unnest(t) AS w, unnest(starts) AS here, generate_subscripts(t, 1) AS k FROM toks),
spread AS (SELECT entity_id, k, here, p.w, pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS j FROM placed p JOIN whole_words x ON x.w = p.w),
sized AS (SELECT *, CASE WHEN piece = '{TK.UNKNOWN}' THEN length(w) ELSE length(piece) - CASE WHEN j > 1 THEN 2 ELSE 0 END END AS size FROM spread),
begun AS (SELECT *, (here + sum(size) OVER (PARTITION BY entity_id, k ORDER BY j) - size)::INT AS start, (row_number() OVER (PARTITION BY entity_id ORDER BY k, j) - 1)::INT AS pos FROM sized),
pieces_ AS MATERIALIZED (SELECT entity_id, pos, piece, start, (start + size)::INT AS "end" FROM begun WHERE pos < {MAX_TOKENS})"""


def part_vocabulary(spark: SparkSession, d: str) -> list[str]:
    """The letters, and the words and short pieces of parts' names: a few hundred, whatever the number of parts."""
    w = F.explode(F.split("p_name", " "))
    words = sorted(r["w"] for r in G.table(spark, d, "part").select(w.alias("w")).where("w <> ''").distinct().limit(TK.MOST_PIECES).collect())
    letters = [chr(k) for k in range(97, 123)]
    short = [("##" if i else "") + x[i : i + n] for x in words for i in range(len(x)) for n in range(1, PIECE + 1) if i + n <= len(x)]
    return [*letters, *[f"##{c}" for c in letters], *words, *short]


def word_pieces(spark: SparkSession, d: str) -> DataFrame:
    return TK.token_rows(G.TextGraph(spark, d).descriptions, TK.word_pieces(part_vocabulary(spark, d), MAX_TOKENS))


def piece_gold_triples(spark: SparkSession, d: str) -> DataFrame:
    """Gold triples by word pieces in the place of words."""
    g = G.TextGraph(spark, d)
    return S.gold_triples(g.triples, g.descriptions, g.aliases, find=partial(R.raw_alias_spans, make=TK.word_pieces(part_vocabulary(spark, d), MAX_TOKENS)))


def overlap_tokens(spark: SparkSession, d: str) -> DataFrame:
    """The first and the last token of a description that share a letter with a stretch of it."""
    tokens = TK.token_rows(G.TextGraph(spark, d).descriptions, TK.word_tokens(MAX_TOKENS))
    held = tokens.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("i"), F.col("start").alias("s"), F.col("end").alias("e")))).alias("t"))  # a model's length
    ident = F.substring("entity_id", 2, 20).cast("long")
    x = S.overlapping_tokens(F.col("t"), ident % 50, ident % 50 + 1 + ident % 13)
    return held.select("entity_id", x.alias("x")).select("entity_id", F.col("x.first").alias("first_token"), F.col("x.last").alias("last_token"))


_GRAPH = G.SQL_SPANS.replace("WITH ", "WITH RECURSIVE ", 1)
_MADE = {
    "raw_alias_spans": (raw_alias_spans, _RAW),
    "raw_alias_spans_legacy": (raw_alias_spans_legacy, _LEGACY),
    "word_pieces": (word_pieces, f"WITH RECURSIVE descriptions AS MATERIALIZED ({G.SQL_DESCRIPTIONS}), {_VOCABULARY}, {_PIECES} SELECT * FROM pieces_"),
    "piece_gold_triples": (piece_gold_triples, f"""{_GRAPH}, {_VOCABULARY}, {_PIECES}, held AS (
  SELECT DISTINCT h, entity, a.pos AS s, b.pos AS e FROM spans1 x JOIN pieces_ a ON a.entity_id = h AND a.start <= c_start AND c_start < a."end" JOIN pieces_ b ON b.entity_id = h AND b.start < c_end AND c_end <= b."end")
SELECT t.h, t.r, t.t, a.s AS hs, a.e AS he, b.s AS ts, b.e AS te FROM triples t JOIN held a ON a.h = t.h AND a.entity = t.h JOIN held b ON b.h = t.h AND b.entity = t.t"""),
    "overlap_tokens": (overlap_tokens, f"""WITH descriptions AS MATERIALIZED ({G.SQL_DESCRIPTIONS}), toks AS (SELECT entity_id, t, list_transform(range(1, len(t) + 1), lambda k: (list_sum(g[1:k]) + coalesce(list_sum(list_transform(t[1:k - 1], lambda x: length(x))), 0))::BIGINT) AS starts FROM (
  SELECT entity_id, regexp_extract_all(text, {_T})[1:{MAX_TOKENS}] AS t, list_transform(regexp_split_to_array(text, {_T})[1:{MAX_TOKENS}], lambda x: length(x)) AS g FROM descriptions)),
n AS (SELECT *, substr(entity_id, 2)::BIGINT AS i FROM toks WHERE len(t) > 0), f AS (SELECT entity_id, list_filter(range(1, len(t) + 1), lambda k: starts[k] < i % 50 + 1 + i % 13 AND starts[k] + length(t[k]) > i % 50) AS k FROM n)
SELECT entity_id, (k[1] - 1)::INT AS first_token, (k[-1] - 1)::INT AS last_token FROM f"""),
}
for _name, (_query, _sql) in _MADE.items():
    QUERIES[_name], ORACLES[_name] = _query, _sql
