"""Sources, minimisation, normalisation, span and label queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions import aggregates as A
from triplewright.functions import text as T
from triplewright.operators import minimize as M
from triplewright.operators import ordering as O
from triplewright.operators import spans as S
from triplewright.plans import graph as G
from triplewright.sources import lines as L

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
FACTOR, SEED = 0.2, 0
# A few English stop words; a longer list is an argument.
STOP_WORDS = ["the", "of", "is", "and", "a", "in", "to"]


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# --- normalisation -------------------------------------------------------------


@query(f"SELECT doc_id, {G.sql_normalize('text')} AS text FROM documents")
def norm_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


@query(f"SELECT doc_id, {G.sql_normalize('text', True)} AS text FROM documents")
def norm_descriptions_legacy(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "documents").select("doc_id", T.normalize(F.col("text"), legacy=True).alias("text"))


def _raw_aliases(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "part").select("p_partkey", F.array("p_name", "p_brand", "p_type", F.initcap("p_name"), F.lit("the")).alias("aliases"))


_ALIAS_LIST = "[p_name, p_brand, p_type, p_name, 'the']"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform({_ALIAS_LIST}, lambda a: lower({G.sql_normalize('a')})))), '|') AS aliases FROM part")
def norm_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _raw_aliases(spark, d).select("p_partkey", F.array_join(T.normalize_aliases(F.col("aliases")), "|").alias("aliases"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter({_ALIAS_LIST}, lambda a: a <> 'the'), lambda a: lower({G.sql_normalize('a', True)})), lambda a: a <> ''))), '|') AS aliases FROM part")
def norm_aliases_legacy(spark: SparkSession, d: str) -> DataFrame:
    return _raw_aliases(spark, d).select("p_partkey", F.array_join(T.normalize_aliases_legacy(F.col("aliases"), STOP_WORDS), "|").alias("aliases"))


#: A list as an argument; the library's own English one is the default elsewhere.
STOPS = ("the", "of", "and", "to", "in", "a", "is", "der", "die", "und", "zu", "den", "le", "la", "les", "et", "des", "el", "los", "que", "con")


@query(f"SELECT word, count(*)::BIGINT AS n, word IN {STOPS!r} AS stop FROM (SELECT unnest(string_split(text, ' ')) AS word FROM ({G.SQL_DESCRIPTIONS})) WHERE word <> '' GROUP BY word")
def stop_words(spark: SparkSession, d: str) -> DataFrame:
    return A.word_counts(G.TextGraph(spark, d).descriptions, "text", spark.createDataFrame([(w,) for w in STOPS], "word string"))


@query("SELECT sum(CASE WHEN name = '' THEN 0 ELSE len(string_split(name, ' ')) END)::BIGINT AS items FROM (SELECT p_name AS name FROM part)")
def alias_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of all alias lists together."""
    return A.list_items(G.table(spark, d, "part").select(F.split("p_name", " ", -1).alias("aliases")), "aliases")


# --- sources: lines are built from tables and parsed again ---------------------


def _lines(spark: SparkSession, d: str, kind: str) -> DataFrame:
    """Well-formed lines, with blanks and short or long lines among them; ids repeat, so that the last line counts."""
    if kind == "triples":
        return G.structural(spark, d).select(F.concat(F.lit(" "), F.concat_ws("\t", "h", "r", "t"), F.when(F.pmod(F.length("t"), F.lit(5)) == 0, "\textra").otherwise(" ")).alias("value"))
    events = G.table(spark, d, "events")
    fields = [F.concat(F.lit("U"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.concat_ws(" ", "event_type", F.col("event_id").cast("string")))]
    if kind == "lists":
        fields.append(F.concat(F.lit("n"), (F.col("event_id") % 3).cast("string")))
    return events.select(F.col("event_id").alias("line"), F.concat_ws("\t", *fields).alias("value"))


@query(f"SELECT h, r, t FROM ({G.SQL_STRUCTURAL}) WHERE length(t) % 5 <> 0")
def scan_triples(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_triples(_lines(spark, d, "triples"))


@query("SELECT 'U' || user_id AS entity_id, arg_max(event_type || ' ' || event_id, event_id) AS text FROM events WHERE event_id % 7 <> 0 GROUP BY user_id")
def scan_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_descriptions(_lines(spark, d, "descriptions"))


@query("""WITH l AS (SELECT *, event_id % 700 = 0 AND event_id > 0 AS bad FROM events), b AS (SELECT min(event_id) AS first FROM l WHERE bad)
SELECT 'U' || user_id AS entity_id, arg_max(event_type || ' ' || event_id, event_id) AS text FROM l, b WHERE first IS NULL OR event_id < first GROUP BY user_id""")
def scan_descriptions_stop(spark: SparkSession, d: str) -> DataFrame:
    """The older reader: lines up to the first without a text."""
    i = F.col("event_id")
    text = F.when((i % 700 == 0) & (i > 0), F.lit("")).otherwise(F.concat_ws(" ", "event_type", i.cast("string")))
    rows = G.table(spark, d, "events").select(i.alias("line"), F.concat_ws("\t", F.concat(F.lit("U"), F.col("user_id").cast("string")), text).alias("value"))
    return L.parse_descriptions(rows, stop=True)


_NAMES = "CASE WHEN event_id % 7 = 0 THEN '' ELSE event_type || ' ' || event_id END || '|n' || (event_id % 3)"


@query(f"SELECT 'U' || user_id AS entity_id, arg_max({_NAMES}, event_id) AS aliases FROM events GROUP BY user_id")
def scan_aliases(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_lists(_lines(spark, d, "lists")).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT 'U' || user_id AS relation_id, arg_max({_NAMES}, event_id) AS aliases FROM events GROUP BY user_id")
def scan_relations(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_lists(_lines(spark, d, "lists"), "relation_id").select("relation_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT 'U' || user_id AS entity_id, string_agg({_NAMES}, '|' ORDER BY event_id) AS aliases FROM events GROUP BY user_id")
def scan_aliases_append(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_lists(_lines(spark, d, "lists"), append=True).select("entity_id", F.array_join("aliases", "|").alias("aliases"))


@query(f"SELECT count(*)::BIGINT AS lines, count(DISTINCT h)::BIGINT AS heads FROM ({G.SQL_STRUCTURAL})")
def scan_line_stats(spark: SparkSession, d: str) -> DataFrame:
    return L.line_stats(_lines(spark, d, "triples"))


@query("SELECT c_custkey, floor((row_number() OVER (ORDER BY c_custkey) - 1) / ceil(count(*) OVER () / 7.0))::BIGINT AS chunk FROM customer")
def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    return O.chunked(G.table(spark, d, "customer").select("c_custkey"), "c_custkey", 7)


# --- minimisation --------------------------------------------------------------

_HEADS = f"""WITH triples AS MATERIALIZED ({G.SQL_STRUCTURAL}), heads AS (
  SELECT DISTINCT h FROM (SELECT h FROM triples ORDER BY md5(h || '#' || r || '#' || t || '#0'), h, r, t LIMIT (SELECT greatest(1, floor(count(*) * {FACTOR}))::BIGINT FROM triples)))
, kept AS (SELECT * FROM triples WHERE h IN (SELECT h FROM heads)), entities AS (
  SELECT 'C' || c_custkey AS entity_id, c_name AS name FROM customer UNION ALL SELECT 'S' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'P' || p_partkey, p_name FROM part
  UNION ALL SELECT 'N' || n_nationkey, n_name FROM nation UNION ALL SELECT 'G' || r_regionkey, r_name FROM region)"""


def _structural_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    names = None
    for prefix, name, key, label in (("C", "customer", "c_custkey", "c_name"), ("S", "supplier", "s_suppkey", "s_name"), ("P", "part", "p_partkey", "p_name"), ("N", "nation", "n_nationkey", "n_name"), ("G", "region", "r_regionkey", "r_name")):
        one = G.table(spark, d, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("entity_id"), F.col(label).alias("name"))
        names = one if names is None else names.unionAll(one)
    relations = spark.createDataFrame([(r,) for r in ("in_nation", "in_region", "placed_by", "has_part", "unused")], "relation_id string")
    return {"triples": G.structural(spark, d), "aliases": names.select("entity_id", "name"), "relations": relations, "descriptions": names.select("entity_id", F.col("name").alias("text"))}


def _cut(spark: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    full = _structural_tables(spark, d)
    heads = M.sample_heads(full["triples"], FACTOR, SEED)
    return full, M.minimize(full["triples"], full["aliases"], full["relations"], full["descriptions"], heads)


@query(f"{_HEADS} SELECT h FROM heads")
def sample_heads(spark: SparkSession, d: str) -> DataFrame:
    return M.sample_heads(G.structural(spark, d), FACTOR, SEED)


@query(f"{_HEADS} SELECT h, r, t FROM kept")
def minimize_triples(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1]["triples"].select("h", "r", "t")


@query(f"{_HEADS} SELECT 'r' AS kind, r AS id FROM (SELECT DISTINCT r FROM kept) UNION ALL SELECT 't', t FROM (SELECT DISTINCT t FROM kept)")
def minimize_keys(spark: SparkSession, d: str) -> DataFrame:
    kept = _cut(spark, d)[1]["triples"]
    return kept.select(F.lit("r").alias("kind"), F.col("r").alias("id")).distinct().unionAll(kept.select(F.lit("t"), "t").distinct())


@query(f"{_HEADS} SELECT entity_id, name FROM entities WHERE entity_id IN (SELECT h FROM heads UNION SELECT t FROM kept)")
def minimize_aliases(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1]["aliases"]


@query(f"{_HEADS} SELECT DISTINCT r AS relation_id FROM kept")
def minimize_relations(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1]["relations"]


@query(f"{_HEADS} SELECT entity_id, name AS text FROM entities WHERE entity_id IN (SELECT h FROM heads)")
def minimize_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d)[1]["descriptions"]


_TWO = f"""{G.SQL_GRAPH}, eligible AS (SELECT DISTINCT h AS id FROM triples), first AS (
  SELECT id FROM eligible ORDER BY md5(id || '#0'), id LIMIT (SELECT ceil(count(*) * 0.05)::BIGINT FROM eligible)), hop AS (SELECT * FROM triples WHERE h IN (SELECT id FROM first)),
wide AS (SELECT id FROM first UNION SELECT t FROM hop), kept AS (SELECT * FROM triples WHERE h IN (SELECT id FROM wide)), ends AS (SELECT id FROM wide UNION SELECT t FROM kept)"""


@query(f"""{_TWO} SELECT 'aliases' AS name, e.id AS id, array_to_string(list(a.alias ORDER BY a.pos), '|') AS row FROM ends e JOIN descriptions d ON d.entity_id = e.id LEFT JOIN aliases a ON a.entity_id = e.id GROUP BY e.id
UNION ALL SELECT 'descriptions', entity_id, text FROM descriptions WHERE entity_id IN (SELECT id FROM wide)
UNION ALL SELECT 'relations', r, CASE r WHEN 'rel_a' THEN 'is next to|adjoins' ELSE 'points at' END FROM (SELECT DISTINCT r FROM hop)
UNION ALL SELECT 'triples', h, r || '|' || t FROM kept""")
def minimize_two_hops(spark: SparkSession, d: str) -> DataFrame:
    """Every row of the four tables."""
    g = G.TextGraph(spark, d)
    cut = M.minimize_two_hops(g.triples, g.aliases, g.relations, g.descriptions, 0.05)
    parts = {
        "aliases": ("entity_id", F.when(F.size("aliases") > 0, F.array_join("aliases", "|"))), "descriptions": ("entity_id", F.col("text")),
        "relations": ("relation_id", F.array_join("aliases", "|")), "triples": ("h", F.concat_ws("|", "r", "t")),
    }
    out = None
    for name, (key, row) in parts.items():
        one = cut[name].select(F.lit(name).alias("name"), F.col(key).alias("id"), row.alias("row"))
        out = one if out is None else out.unionAll(one)
    return out


@query(f"""{_HEADS}, sizes AS (SELECT 'triples' AS name, (SELECT count(*) FROM triples) AS b, (SELECT count(*) FROM kept) AS a
UNION ALL SELECT 'aliases', (SELECT count(*) FROM entities), (SELECT count(*) FROM entities WHERE entity_id IN (SELECT h FROM heads UNION SELECT t FROM kept))
UNION ALL SELECT 'relations', 5, (SELECT count(DISTINCT r) FROM kept)
UNION ALL SELECT 'descriptions', (SELECT count(*) FROM entities), (SELECT count(*) FROM entities WHERE entity_id IN (SELECT h FROM heads)))
SELECT name, b::BIGINT AS n_before, a::BIGINT AS n_after, round(100.0 * a / greatest(b, 1), 4)::DOUBLE AS percent FROM sizes""")
def size_report(spark: SparkSession, d: str) -> DataFrame:
    return M.size_report(*_cut(spark, d))


@query(f"""{_HEADS} SELECT 'aliases' AS name, count(*)::BIGINT AS n FROM entities UNION ALL SELECT 'descriptions', count(*) FROM entities
UNION ALL SELECT 'relations', 5 UNION ALL SELECT 'triples', count(*) FROM triples""")
def table_sizes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, df in sorted(_structural_tables(spark, d).items()):
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


# --- spans and labels ----------------------------------------------------------


def _spans(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    pairs = g.triples.select("h", F.col("h").alias("entity")).union(g.triples.select("h", F.col("t").alias("entity"))).distinct()
    return S.alias_spans(pairs, g.descriptions, g.aliases)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.gold_triples(g.triples, g.descriptions, g.aliases)


def _silver(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.silver_labels(g.triples, g.descriptions, g.aliases)


@query("SELECT p_partkey, '(?iU)(?<!\\w)\\Q' || replace(p_name, ' ', '\\E\\s+\\Q') || '\\E(?!\\w)' AS pattern FROM part")
def alias_patterns(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "part").select("p_partkey", T.alias_pattern(F.col("p_name")).alias("pattern"))


@query("SELECT p_partkey, '(?iU)\\b\\Q' || replace(p_name, ' ', '\\E\\s*\\Q') || '\\E\\b' AS pattern FROM part")
def alias_patterns_legacy(spark: SparkSession, d: str) -> DataFrame:
    return G.table(spark, d, "part").select("p_partkey", T.alias_pattern_legacy(F.col("p_name")).alias("pattern"))


@query(f"""WITH d AS ({G.SQL_DESCRIPTIONS}), x AS (SELECT entity_id, regexp_extract_all(text, {G.sql_text(T.TOKEN)})[1:128] AS toks FROM d)
SELECT entity_id, len(toks)::INT AS n_tokens, array_to_string(toks, ' ') AS tokens FROM x""")
def tokens(spark: SparkSession, d: str) -> DataFrame:
    toks = G.TextGraph(spark, d).descriptions.select("entity_id", T.tokens(F.col("text")).alias("t"))
    return toks.select("entity_id", F.size("t").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query(f"{G.SQL_SPANS} SELECT h, entity, alias, c_start, c_end, s, e FROM spans")
def alias_spans(spark: SparkSession, d: str) -> DataFrame:
    return _spans(spark, d).select("h", "entity", "alias", F.col("start").alias("c_start"), F.col("end").alias("c_end"), "s", "e")


@query(f"{G.SQL_SPANS} SELECT h, alias, c_start, c_end, s, e FROM spans WHERE entity = h")
def literal_matches(spark: SparkSession, d: str) -> DataFrame:
    """A description's own aliases by splitting its text at each of them, and the tokens that hold their ends."""
    g = G.TextGraph(spark, d)
    names = g.aliases.select("entity_id", F.explode("aliases").alias("alias"))
    rows = g.descriptions.select("entity_id", S.clipped(F.col("text")).alias("text")).join(names, "entity_id")
    rows = rows.select(F.col("entity_id").alias("h"), "alias", "text", F.explode(T.literal_spans(F.col("text"), F.col("alias"))).alias("x"))
    ends = rows.select("h", "alias", F.col("x.start").alias("c_start"), F.col("x.end").alias("c_end"), T.token_at(F.col("text"), F.col("x.start")).alias("s"), T.token_at(F.col("text"), F.col("x.end") - 1).alias("e"))
    return ends.where("s is not null and e is not null")


@query(f"{G.SQL_SPANS} SELECT h, entity, s, e FROM entity_spans")
def entity_spans(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.entity_spans(g.triples, g.descriptions, g.aliases)


@query(f"{G.SQL_SPANS} SELECT h, entity, alias, min(c_start) AS c_start, min(c_end) AS c_end FROM spans GROUP BY h, entity, alias")
def first_match(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    pairs = g.triples.select("h", F.col("h").alias("entity")).union(g.triples.select("h", F.col("t").alias("entity"))).distinct()
    return S.first_match(pairs, g.descriptions, g.aliases).select("h", "entity", "alias", F.col("start").alias("c_start"), F.col("end").alias("c_end"))


@query(f"{G.SQL_GOLD} SELECT * FROM gold")
def gold_triples(spark: SparkSession, d: str) -> DataFrame:
    return _gold(spark, d)


@query(f"{G.SQL_GOLD} SELECT h, string_agg(r || ':' || t || ':' || hs || ':' || he || ':' || ts || ':' || te, ' ' ORDER BY r, t, hs, he, ts, te) AS triples FROM gold GROUP BY h")
def gold_by_head(spark: SparkSession, d: str) -> DataFrame:
    rows = S.gold_by_head(_gold(spark, d))
    return rows.select("h", F.array_join(F.transform("triples", lambda x: F.concat_ws(":", x["r"], x["t"], *[x[k].cast("string") for k in ("hs", "he", "ts", "te")])), " ").alias("triples"))


@query("SELECT 'O' || o_orderkey AS entity_id FROM orders")
def missing_aliases(spark: SparkSession, d: str) -> DataFrame:
    t = _structural_tables(spark, d)
    return S.without_aliases(t["triples"], t["aliases"])


@query(f"""{G.SQL_GRAPH}, a AS (SELECT entity_id, list(alias ORDER BY pos) AS names FROM aliases GROUP BY 1)
SELECT t.h AS entity_id, array_to_string(any_value(x.names), '|') AS head_aliases, coalesce(string_agg(array_to_string(y.names, '|'), '|' ORDER BY y.names), '') AS tail_aliases
FROM triples t JOIN a x ON x.entity_id = t.h LEFT JOIN a y ON y.entity_id = t.t GROUP BY t.h""")
def ends_aliases(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    rows = S.ends_aliases(g.descriptions, g.triples, g.aliases.where(F.size("aliases") > 0))
    return rows.select("entity_id", F.array_join("head_aliases", "|").alias("head_aliases"), F.array_join("tail_aliases", "|").alias("tail_aliases"))


@query(f"""{G.SQL_GRAPH}, a AS (SELECT entity_id, list(alias ORDER BY pos) AS names FROM aliases GROUP BY 1), own AS (SELECT entity_id, CASE WHEN w = '' THEN '' ELSE array_to_string(coalesce(names, []), '|') END AS names FROM (SELECT entity_id, text AS w FROM descriptions) LEFT JOIN a USING (entity_id))
SELECT d.entity_id, '[' || any_value(x.names) || ']' AS head_lists, string_agg('[' || y.names || ']', '' ORDER BY string_split(y.names, '|')) AS tail_lists
FROM descriptions d JOIN own x ON x.entity_id = d.entity_id LEFT JOIN triples t ON t.h = d.entity_id LEFT JOIN own y ON y.entity_id = t.t GROUP BY d.entity_id""")
def ends_alias_lists(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)

    def shown(c: str):
        return F.array_join(F.transform(c, lambda x: F.concat(F.lit("["), F.array_join(x, "|"), F.lit("]"))), "").alias(c)

    return S.ends_alias_lists(g.descriptions, g.triples, g.aliases).select("entity_id", shown("head_lists"), shown("tail_lists"))


@query(f"{G.SQL_LABELS} SELECT entity_id, kind, pos FROM labels_")
def silver_labels(spark: SparkSession, d: str) -> DataFrame:
    return _silver(spark, d)


@query(f"{G.SQL_LABELS} SELECT entity_id, kind, sum(pos)::BIGINT AS pos_sum, count(*)::BIGINT AS ones FROM labels_ GROUP BY 1, 2")
def silver_dense(spark: SparkSession, d: str) -> DataFrame:
    rows = S.dense_labels(_silver(spark, d)).select("entity_id", "kind", F.posexplode("label").alias("pos", "y"))
    return rows.groupBy("entity_id", "kind").agg(F.sum(F.col("pos") * F.col("y")).alias("pos_sum"), F.sum("y").alias("ones"))


@query(f"""{G.SQL_SPANS}, best AS (SELECT h, entity, s, e FROM (SELECT *, row_number() OVER (PARTITION BY h, entity ORDER BY pos, c_start) AS k FROM spans) WHERE k = 1)
SELECT DISTINCT h AS entity_id, kind, pos FROM (SELECT h, 'h_s' AS kind, s AS pos FROM best WHERE entity = h UNION ALL SELECT h, 'h_e', e FROM best WHERE entity = h
UNION ALL SELECT b.h, 't_s', s FROM best b JOIN triples t ON t.h = b.h AND t.t = b.entity UNION ALL SELECT b.h, 't_e', e FROM best b JOIN triples t ON t.h = b.h AND t.t = b.entity)""")
def silver_first_alias(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.first_alias_labels(g.triples, g.descriptions, g.aliases)


@query(f"{G.SQL_LABELS} SELECT DISTINCT entity_id FROM labels_ WHERE kind IN ('t_s', 't_e')")
def silver_any(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.labelled(g.descriptions, S.silver_labels(g.triples, g.descriptions, g.aliases).where(F.col("kind").isin("t_s", "t_e"))).select("entity_id")


@query(f"{G.SQL_LABELS} SELECT entity_id FROM labels_ GROUP BY entity_id HAVING count(DISTINCT kind) = 4")
def silver_all(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.labelled(g.descriptions, S.silver_labels(g.triples, g.descriptions, g.aliases), every_kind=True).select("entity_id")


@query(f"""{G.SQL_LABELS}, h AS (SELECT entity_id, list_sort(list(pos) FILTER (kind = 't_s')) AS st, list_sort(list(pos) FILTER (kind = 't_e')) AS en FROM labels_ WHERE kind IN ('t_s', 't_e') GROUP BY 1),
w AS (SELECT entity_id, list_reduce(list_transform(st, lambda s: [[s, -1]]), lambda a, b: a || b) AS x, en FROM h)
, folded AS (SELECT entity_id, list_reduce(list_concat([[[-1, -1]]], list_transform(x, lambda p: [p])), lambda acc, q: CASE WHEN len(list_filter(en, lambda e: e >= q[1][1] AND NOT list_contains(list_transform(acc, lambda z: z[2]), e))) > 0
  THEN list_concat(acc, [[q[1][1], list_filter(en, lambda e: e >= q[1][1] AND NOT list_contains(list_transform(acc, lambda z: z[2]), e))[1]]]) ELSE acc END) AS pairs FROM w)
SELECT entity_id, p[1]::INT AS s, p[2]::INT AS e FROM (SELECT entity_id, unnest(pairs) AS p FROM folded) WHERE p[1] >= 0""")
def silver_pairs(spark: SparkSession, d: str) -> DataFrame:
    return S.paired_ends(_silver(spark, d), "t_s", "t_e")


@query(f"""{G.SQL_GOLD}, d AS (SELECT entity_id, text, regexp_extract_all(text, {G.sql_text(T.TOKEN)})[1:128] AS toks FROM descriptions),
o AS (SELECT h, count(*) AS n, list('triple: ' || r || ' ' || t ORDER BY r, t) AS l FROM triples GROUP BY h),
g AS (SELECT x.h, list('gold: ' || array_to_string(toks[hs+1:he+1], ' ') || ' | ' || r || ' | ' || array_to_string(toks[ts+1:te+1], ' ') ORDER BY r, t, hs, he, ts, te) AS l FROM gold x JOIN d ON d.entity_id = x.h GROUP BY x.h),
a AS (SELECT d.entity_id, list_concat(['description: ' || text, 'tokens: ' || array_to_string(toks, ' '), 'triples: ' || coalesce(o.n, 0)], coalesce(o.l, []), coalesce(g.l, ['no gold triples'])) AS l FROM d LEFT JOIN o ON o.h = d.entity_id LEFT JOIN g ON g.h = d.entity_id)
SELECT entity_id, (generate_subscripts(l, 1) - 1)::INT AS line_no, unnest(l) AS line FROM a""")
def gold_log(spark: SparkSession, d: str) -> DataFrame:
    g = G.TextGraph(spark, d)
    return S.gold_log(g.descriptions, g.triples, _gold(spark, d))
