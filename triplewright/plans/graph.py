"""A graph made of the bundled tables: text triples over ``documents``, structural triples over the star schema, vectors over ``embeddings``."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.functions.text import DELETED, DELETED_LEGACY, SPACE, TOKEN, WORD_OK, normalize, substitution
from triplewright.storage import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class TextGraph:
    """Each document names two others; its own first word and first two words are its aliases.

    Every part is made when it is first asked for: triples and relations read no text.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.docs = spark, table(spark, sf_dir, "documents")
        self.ident = F.concat(F.lit("D"), F.col("doc_id").cast("string"))

    @cached_property
    def triples(self) -> DataFrame:
        n, ids = self.docs.count(), self.docs.select("doc_id")

        def other(times: int, plus: int):
            return F.concat(F.lit("D"), ((F.col("doc_id") * times + plus) % n).cast("string"))

        return ids.select(self.ident.alias("h"), F.lit("rel_a").alias("r"), other(7, 3).alias("t")).union(ids.select(self.ident.alias("h"), F.lit("rel_b").alias("r"), other(13, 5).alias("t")))

    @cached_property
    def descriptions(self) -> DataFrame:
        # Normalised texts are tables of their own in a prepared graph: written once, read by every use.
        return Scratch(self.spark, "graph").keep(self.docs.select(self.ident.alias("entity_id"), normalize(F.col("text"), lower=True).alias("text")), "descriptions")

    @cached_property
    def aliases(self) -> DataFrame:
        start = self.descriptions.select("entity_id", F.split("text", " ", 3).alias("w"))
        names = F.filter(F.array(F.get("w", F.lit(0)), F.concat_ws(" ", F.get("w", F.lit(0)), F.get("w", F.lit(1)))), lambda a: a.isNotNull() & (a != ""))
        return start.select("entity_id", F.array_distinct(names).alias("aliases"))

    @cached_property
    def relations(self) -> DataFrame:
        return self.spark.createDataFrame([("rel_a", ["is next to", "adjoins"]), ("rel_b", ["points at"]), ("rel_c", ["is unused"]), ("rel_d", [])], "relation_id string, aliases array<string>")


def structural(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(h, r, t) of customers, suppliers, nations, orders and their parts: a bag."""

    def triple(df: DataFrame, a: str, h: str, r: str, b: str, t: str) -> DataFrame:
        return df.select(F.concat(F.lit(a), F.col(h).cast("string")).alias("h"), F.lit(r).alias("r"), F.concat(F.lit(b), F.col(t).cast("string")).alias("t"))

    read = lambda name: table(spark, sf_dir, name)
    parts = [
        triple(read("customer"), "C", "c_custkey", "in_nation", "N", "c_nationkey"),
        triple(read("supplier"), "S", "s_suppkey", "in_nation", "N", "s_nationkey"),
        triple(read("nation"), "N", "n_nationkey", "in_region", "G", "n_regionkey"),
        triple(read("orders"), "O", "o_orderkey", "placed_by", "C", "o_custkey"),
        triple(read("lineitem"), "O", "l_orderkey", "has_part", "P", "l_partkey"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_normalize(c: str, legacy: bool = False) -> str:
    source, target = substitution(legacy)
    plain = f"replace(translate({c}, {sql_text(source)}, {sql_text(target)}), '&', 'and')"
    return f"array_to_string(list_filter(regexp_split_to_array({plain}, {sql_text(f'[{SPACE}]+')}), lambda w: regexp_matches(w, {sql_text(WORD_OK)})), ' ')"


SQL_TRIPLES = """
SELECT 'D' || doc_id AS h, 'rel_a' AS r, 'D' || ((doc_id * 7 + 3) % (SELECT count(*) FROM documents)) AS t FROM documents
UNION ALL SELECT 'D' || doc_id, 'rel_b', 'D' || ((doc_id * 13 + 5) % (SELECT count(*) FROM documents)) FROM documents"""
SQL_DESCRIPTIONS = f"SELECT 'D' || doc_id AS entity_id, lower({sql_normalize('text')}) AS text FROM documents"
SQL_ALIASES = """
SELECT entity_id, pos - 1 AS pos, alias FROM (
  SELECT entity_id, unnest(list) AS alias, generate_subscripts(list, 1) AS pos FROM (
    SELECT entity_id, CASE WHEN w[1] = '' THEN [] WHEN len(w) > 1 THEN [w[1], w[1] || ' ' || w[2]] ELSE [w[1]] END AS list FROM (SELECT entity_id, string_split(text, ' ') AS w FROM descriptions)))"""
SQL_STRUCTURAL = """
SELECT 'C' || c_custkey AS h, 'in_nation' AS r, 'N' || c_nationkey AS t FROM customer
UNION ALL SELECT 'S' || s_suppkey, 'in_nation', 'N' || s_nationkey FROM supplier
UNION ALL SELECT 'N' || n_nationkey, 'in_region', 'G' || n_regionkey FROM nation
UNION ALL SELECT 'O' || o_orderkey, 'placed_by', 'C' || o_custkey FROM orders
UNION ALL SELECT 'O' || l_orderkey, 'has_part', 'P' || l_partkey FROM lineitem"""
_T = sql_text(TOKEN)
SQL_GRAPH = f"""WITH descriptions AS MATERIALIZED ({SQL_DESCRIPTIONS}), triples AS ({SQL_TRIPLES}), aliases AS ({SQL_ALIASES})"""
SQL_SPANS = f"""{SQL_GRAPH}, pairs AS (SELECT h, h AS entity FROM triples UNION SELECT h, t FROM triples
), clipped AS MATERIALIZED (SELECT entity_id, regexp_extract(text, '(?s)^(?:\\s*(?:\\w+|[^\\w\\s])){{0,128}}\\s?.?') AS text FROM descriptions
), rows_ AS (
  SELECT p.h, p.entity, a.pos, a.alias, d.text, length(a.alias) AS n FROM pairs p JOIN aliases a ON a.entity_id = p.entity JOIN clipped d ON d.entity_id = p.h WHERE contains(d.text, a.alias)
), hits AS (
  SELECT *, list_filter(range(1, length(text) - n + 2), lambda i: substr(text, i, n) = alias
    AND (i = 1 OR NOT regexp_matches(substr(text, greatest(i - 1, 1), 1), '\\w')) AND NOT regexp_matches(substr(text, i + n, 1), '^\\w')) AS hit FROM rows_
), spans0 AS (
  SELECT h, entity, pos, alias, text, n, unnest(list_reduce(list_transform(hit, lambda i: [i]), lambda x, y: CASE WHEN y[1] >= x[len(x)] + n THEN list_concat(x, y) ELSE x END)) AS hit FROM hits WHERE len(hit) > 0
), spans1 AS (
  SELECT h, entity, pos, alias, (hit - 1)::INT AS c_start, (hit - 1 + n)::INT AS c_end, (len(regexp_extract_all(substr(text, 1, hit), {_T})) - 1)::INT AS s, (len(regexp_extract_all(substr(text, 1, hit + n - 1), {_T})) - 1)::INT AS e FROM spans0
), spans AS (SELECT * FROM spans1 WHERE s < 128 AND e < 128), entity_spans AS (SELECT DISTINCT h, entity, s, e FROM spans)"""
SQL_GOLD = f"""{SQL_SPANS}, gold AS (
  SELECT t.h, t.r, t.t, a.s AS hs, a.e AS he, b.s AS ts, b.e AS te FROM triples t JOIN entity_spans a ON a.h = t.h AND a.entity = t.h JOIN entity_spans b ON b.h = t.h AND b.entity = t.t)"""
SQL_LABELS = f"""{SQL_SPANS}, labels_ AS (
  SELECT DISTINCT h AS entity_id, kind, pos FROM (
    SELECT h, 'h_s' AS kind, s AS pos FROM entity_spans WHERE entity = h UNION ALL SELECT h, 'h_e', e FROM entity_spans WHERE entity = h
    UNION ALL SELECT x.h, 't_s', s FROM entity_spans x JOIN triples t ON t.h = x.h AND t.t = x.entity UNION ALL SELECT x.h, 't_e', e FROM entity_spans x JOIN triples t ON t.h = x.h AND t.t = x.entity))"""
assert DELETED != DELETED_LEGACY
