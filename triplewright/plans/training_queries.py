"""The span model's training as a query, and the same two steps as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplewright.operators import spans as S
from triplewright.operators import span_training as ST
from triplewright.plans import graph as G
from triplewright.plans import model_queries as M
from triplewright.storage import Scratch

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ATTENTION, EPOCHS, RATE, MOST = 4, 2, 0.01, 3
FORM = ST.shapes(M.DIMS, ATTENTION, M.DIMS, M.DIMS)


def _row(name: str, k: str, width: int = M.DIMS + 1) -> str:
    """Row k (from 0) of a matrix that is kept flat."""
    return f"{name}[{k} * {width} + 1 : ({k} + 1) * {width}]"


def _linear(name: str, rows: int, x: str) -> str:
    return f"list_transform(range(0, {rows}), lambda k: list_dot_product({_row(name, 'k')}, {x}))"


def _pull(z: str, kind: str) -> str:
    return f"((1 - {kind}) / (1 + exp(-({z}))) - {kind} * pw_{kind} * (1 - 1 / (1 + exp(-({z})))))"


def _unnested(rows: int, d: str, x: str, source: str, name: str) -> str:
    """(name, k, g): the sum over ``source`` of the outer products of d (``rows`` numbers) and x."""
    sums = ", ".join(f"sum(({d})[{i + 1}] * xj)" for i in range(rows))
    return f"SELECT '{name}' AS name, (generate_subscripts(s, 1) - 1) * {M.DIMS + 1} + j AS k, unnest(s) AS g FROM (SELECT j, [{sums}] AS s FROM (SELECT *, unnest({x}) AS xj, generate_subscripts({x}, 1) - 1 AS j FROM {source}) GROUP BY j)"


def _direction(n: int, d: str, rel: str) -> tuple[str, list[str]]:
    """CTEs of one direction in step n, and its gradients as SELECTs of (name, k, g)."""
    kinds, h = ST.DIRECTIONS[d], M.DIMS
    t = f"{n}_{d}"

    def w(name: str) -> str:
        return f"w{n}.{d}_{name}"

    pairing = M.PAIRING.format(cmp=">=", cut=0.5, far=f"e < q[1][1] + {MOST}")
    for name in ("arr", "folded", "slots", "heads"):
        pairing = pairing.replace(f"{name} AS", f"{name}{t} AS").replace(f"FROM {name} ", f"FROM {name}{t} ").replace(f"FROM {name})", f"FROM {name}{t})")
    ctes = f"""
heads{t} AS MATERIALIZED (SELECT b.*, list_dot_product(x1, {w('entity_start')}) AS sl, list_dot_product(x1, {w('entity_end')}) AS el, {_linear(w('attend_x'), ATTENTION, 'x1')} AS px,
  list_transform(list_zip(x, {_linear(w('fuse_x'), h, 'x1')}), lambda p: p[1] + p[2]) AS fx FROM base b, w{n}),
{pairing},
reps{t} AS (SELECT l.entity_id, l.slot, list_append(list_transform(list_zip(a.x, b.x), lambda p: (p[1] + p[2]) / 2), 1.0::DOUBLE) AS s1 FROM slots{t} l JOIN tok a ON a.entity_id = l.entity_id AND a.pos = l.s JOIN tok b ON b.entity_id = l.entity_id AND b.pos = l.e
  UNION ALL SELECT entity_id, 0, list_append(list_transform(range(0, {h}), lambda k: 0.0::DOUBLE), 1.0::DOUBLE) FROM means WHERE entity_id NOT IN (SELECT entity_id FROM slots{t})),
fused{t} AS (SELECT entity_id, slot, s1, {_linear(w('fuse_s'), h, 's1')} AS fs FROM reps{t}, w{n}),
slot{t} AS (SELECT entity_id, arg_min({{'s1': s1, 'fs': fs}}, slot) FILTER (vs = ms) AS bs, arg_min({{'s1': s1, 'fs': fs}}, slot) FILTER (ve = me) AS be, any_value(ms) AS vs, any_value(me) AS ve FROM (
  SELECT *, max(vs) OVER (PARTITION BY entity_id) AS ms, max(ve) OVER (PARTITION BY entity_id) AS me FROM (SELECT f.*, list_dot_product(fs, {w('conditioned_start')}[1:{h}]) AS vs, list_dot_product(fs, {w('conditioned_end')}[1:{h}]) AS ve FROM fused{t} f, w{n})) GROUP BY entity_id),
pr{t} AS (SELECT relation_id, list_append(v, 1.0::DOUBLE) AS r1, {_linear(w('attend_r'), ATTENTION, 'list_append(v, 1.0::DOUBLE)')} AS p FROM {rel}, w{n}),
pg{t} AS (SELECT entity_id, g1, {_linear(w('attend_g'), ATTENTION, 'g1')} AS p FROM means, w{n}),
score{t} AS MATERIALIZED (SELECT entity_id, relation_id, pos, x, x1, hidden, list_dot_product(hidden, {w('attend_v')}) AS z FROM (
  SELECT t.entity_id, relation_id, pos, x, x1, list_transform(range(1, {ATTENTION + 1}), lambda k: tanh(t.px[k] + r.p[k] + g.p[k])) AS hidden FROM heads{t} t JOIN pg{t} g ON g.entity_id = t.entity_id CROSS JOIN pr{t} r), w{n}),
share{t} AS MATERIALIZED (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY entity_id, relation_id) AS a FROM score{t}),
context{t} AS (SELECT entity_id, relation_id, [{', '.join(f'sum(a * x[{k}])' for k in range(1, h + 1))}] AS c FROM share{t} GROUP BY 1, 2),
under{t} AS (SELECT entity_id, min(relation_id) FILTER (vs = ms) AS rs, min(relation_id) FILTER (ve = me) AS re, any_value(ms) AS us, any_value(me) AS ue FROM (
  SELECT *, max(vs) OVER (PARTITION BY entity_id) AS ms, max(ve) OVER (PARTITION BY entity_id) AS me FROM (SELECT c.*, list_dot_product(c, {w('conditioned_start')}[1:{h}]) AS vs, list_dot_product(c, {w('conditioned_end')}[1:{h}]) AS ve FROM context{t} c, w{n})) GROUP BY entity_id),
pulls{t} AS MATERIALIZED (SELECT t.entity_id, t.pos, t.x, t.x1, t.fx, {_pull('sl', kinds[0])} AS p0, {_pull('el', kinds[1])} AS p1,
  {_pull(f"list_dot_product(fx, {w('conditioned_start')}[1:{h}]) + s.vs + u.us + {w('conditioned_start')}[{h + 1}]", kinds[2])} AS p2, {_pull(f"list_dot_product(fx, {w('conditioned_end')}[1:{h}]) + s.ve + u.ue + {w('conditioned_end')}[{h + 1}]", kinds[3])} AS p3,
  {w('conditioned_start')} AS cs, {w('conditioned_end')} AS ce FROM heads{t} t JOIN slot{t} s ON s.entity_id = t.entity_id JOIN under{t} u ON u.entity_id = t.entity_id, w{n}, pw),
whole{t} AS MATERIALIZED (SELECT entity_id, sum(p2) AS g2, sum(p3) AS g3 FROM pulls{t} GROUP BY 1),
per{t} AS MATERIALIZED (SELECT q.entity_id, g2, g3, s.bs.s1 AS s1_s, s.be.s1 AS s1_e, s.bs.fs AS fs_s, s.be.fs AS fs_e, cs.c AS c_s, ce.c AS c_e, rs, re, list_transform({w('conditioned_start')}[1:{h}], lambda z: g2 * z) AS ds, list_transform({w('conditioned_end')}[1:{h}], lambda z: g3 * z) AS de
  FROM whole{t} q JOIN slot{t} s ON s.entity_id = q.entity_id JOIN under{t} u ON u.entity_id = q.entity_id JOIN context{t} cs ON cs.entity_id = q.entity_id AND cs.relation_id = u.rs JOIN context{t} ce ON ce.entity_id = q.entity_id AND ce.relation_id = u.re, w{n}),
back{t} AS MATERIALIZED (SELECT z.entity_id, z.relation_id, x1, hidden, a * (o - sum(a * o) OVER (PARTITION BY z.entity_id, side)) AS ds FROM (
  SELECT s.*, 's' AS side, list_dot_product(s.x, p.ds) AS o FROM share{t} s JOIN per{t} p ON p.entity_id = s.entity_id AND p.rs = s.relation_id
  UNION ALL SELECT s.*, 'e', list_dot_product(s.x, p.de) FROM share{t} s JOIN per{t} p ON p.entity_id = s.entity_id AND p.re = s.relation_id) z),
inner{t} AS MATERIALIZED (SELECT b.*, r1, g1, list_transform(range(1, {ATTENTION + 1}), lambda k: ds * {w('attend_v')}[k] * (1 - hidden[k] * hidden[k])) AS di FROM back{t} b JOIN pr{t} r ON r.relation_id = b.relation_id JOIN pg{t} g ON g.entity_id = b.entity_id, w{n})"""

    def head(name: str, pull: str, x: str, source: str) -> str:
        return f"SELECT '{d}.{name}' AS name, generate_subscripts({x}, 1) - 1 AS k, unnest({x}) * {pull} AS g FROM {source}"

    outer = f"(SELECT x1, list_transform(range(1, {h + 1}), lambda k: p2 * cs[k] + p3 * ce[k]) AS d FROM pulls{t})"
    grads = [
        head("entity_start", "p0", "x1", f"pulls{t}"), head("entity_end", "p1", "x1", f"pulls{t}"),
        head("conditioned_start", "p2", "list_append(fx, 1.0::DOUBLE)", f"pulls{t}"), head("conditioned_start", "g2", "list_transform(range(1, 9), lambda k: fs_s[k] + c_s[k])", f"per{t}"),
        head("conditioned_end", "p3", "list_append(fx, 1.0::DOUBLE)", f"pulls{t}"), head("conditioned_end", "g3", "list_transform(range(1, 9), lambda k: fs_e[k] + c_e[k])", f"per{t}"),
        head("attend_v", "ds", "hidden", f"inner{t}"),
        _unnested(h, "d", "x1", outer, f"{d}.fuse_x"), _unnested(h, "ds", "s1_s", f"per{t}", f"{d}.fuse_s"), _unnested(h, "de", "s1_e", f"per{t}", f"{d}.fuse_s"),
        _unnested(ATTENTION, "di", "x1", f"inner{t}", f"{d}.attend_x"), _unnested(ATTENTION, "di", "r1", f"inner{t}", f"{d}.attend_r"), _unnested(ATTENTION, "di", "g1", f"inner{t}", f"{d}.attend_g"),
    ]
    return ctes, grads


def _sql() -> str:
    start = ST.initial_weights(FORM)
    kinds = ", ".join(f"(l_{k}.pos IS NOT NULL)::INT AS {k}" for k in ST.KINDS)
    joins = " ".join(f"LEFT JOIN labels_ l_{k} ON l_{k}.entity_id = t.entity_id AND l_{k}.pos = t.pos AND l_{k}.kind = '{k}'" for k in ST.KINDS)
    tok = M.TOKEN_VECTORS.split("), words AS", 1)[1]
    out = f"""{G.SQL_LABELS}, words AS{tok},
base AS MATERIALIZED (SELECT t.*, list_append(t.x, 1.0::DOUBLE) AS x1, {kinds} FROM tok t {joins}),
pw AS (SELECT {', '.join(f'CASE WHEN sum({k}) > 0 THEN (count(*) - sum({k})) / sum({k})::DOUBLE ELSE 1.0 END AS pw_{k}' for k in ST.KINDS)} FROM base),
means AS MATERIALIZED (SELECT entity_id, [{', '.join(f'avg(x[{k}])' for k in range(1, M.DIMS + 1))}, 1.0::DOUBLE] AS g1 FROM tok GROUP BY 1),
rel_f AS MATERIALIZED ({M.sql_relations(M.DIMS)}), rel_b AS MATERIALIZED ({M.sql_relations(M.DIMS, ids_only=True)}),
s0 AS (SELECT unnest({list(FORM)}) AS name, unnest([{', '.join(str(v.reshape(-1).tolist()) for v in start.values())}]) AS w)"""
    names = [(n, n.replace(".", "_")) for n in FORM]
    out += ", l0 AS (SELECT name, generate_subscripts(w, 1) - 1 AS k, unnest(w) AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM s0)"
    for n in range(EPOCHS):
        parts = [_direction(n, d, rel) for d, rel in (("forward", "rel_f"), ("backward", "rel_b"))]
        out += f", w{n} AS MATERIALIZED (SELECT {', '.join(f"list(w ORDER BY k) FILTER (name = '{a}') AS {b}" for a, b in names)} FROM l{n})"
        out += "," + ",".join(ctes for ctes, _ in parts)
        # The bias of a conditioned head takes the pulls of its tokens alone; slots and relations add to its weights.
        grads = " UNION ALL ".join(g for _, gs in parts for g in gs)
        out += f""",
g{n} AS MATERIALIZED (SELECT name, k, sum(g) / (8 * (SELECT count(*) FROM base)) AS g FROM ({grads}) GROUP BY 1, 2),
n{n} AS (SELECT l.name, l.k, w, 0.9 * m + 0.1 * coalesce(g, 0) AS m, 0.999 * v + 0.001 * coalesce(g, 0) * coalesce(g, 0) AS v FROM l{n} l LEFT JOIN g{n} g ON g.name = l.name AND g.k = l.k),
l{n + 1} AS MATERIALIZED (SELECT name, k, w - {RATE} * (m / (1 - 0.9 ** {n + 1})) / (sqrt(v / (1 - 0.999 ** {n + 1})) + 1e-8) AS w, m, v FROM n{n})"""
    return f"{out} SELECT {EPOCHS - 1} AS epoch, name, k::INT AS k, round(w, 6) AS weight, round(m, 7) AS m FROM l{EPOCHS}"


def train_span_model(spark: SparkSession, d: str) -> DataFrame:
    """All weights after two epochs of one step on silver labels; the production number of epochs is the operator's default."""
    g = G.TextGraph(spark, d)
    labels = S.silver_labels(g.triples, g.descriptions, g.aliases)
    folder = Scratch(spark, "span-model").root
    rows = ST.train_span_model(M.held_tokens(g.docs, g.ident), None, labels, M.semantic_relations(g), M.graph_relations(g), folder, attention=ATTENTION, epochs=EPOCHS, steps=1, rate=RATE, most=MOST)
    rows = rows.select("epoch", "name", F.posexplode(F.arrays_zip("weight", "m")).alias("k", "x"))
    return rows.select(F.col("epoch").cast("int").alias("epoch"), "name", "k", F.round("x.weight", 6).alias("weight"), F.round("x.m", 7).alias("m"))


QUERIES["train_span_model"] = train_span_model
ORACLES["train_span_model"] = M.plain_zero(_sql())
