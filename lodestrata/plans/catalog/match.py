"""Matching between stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import match as M
from ...sources.tables import NOW_MS
from ..registry import query

# a store for each value of k: a fixed, small number of stores, all of them compared
_SETS = """sets AS (SELECT k AS store, list_distinct(list(node_id) FILTER (event_type = 'view')) AS preds, list_distinct(list(node_id % 30) FILTER (event_type = 'click')) AS nodes, list_distinct(list(node_id % 20) FILTER (event_type = 'error')) AS edges,
  list_distinct(list(node_id % 10) FILTER (event_type = 'purchase')) AS forks, list_distinct(list(node_id % 25) FILTER (event_type = 'signup')) AS paths, list_distinct(list(node_id % 8)) AS schemas FROM log GROUP BY k)"""


def _j(c):
    return f"CASE WHEN len(list_distinct(list_concat(coalesce(x.{c}, []), coalesce(y.{c}, [])))) = 0 THEN 0.0 ELSE len(list_intersect(coalesce(x.{c}, []), coalesce(y.{c}, []))) / len(list_distinct(list_concat(coalesce(x.{c}, []), coalesce(y.{c}, [])))) END AS {c}"


_PAIRS = f"""pairs AS (SELECT x.store AS a, y.store AS b, (x.store * 7 + y.store * 3) % 100 / 100 AS minhash, {_j('schemas')}, ((x.store + y.store) % 20 - 10) / 10 AS velocity, {_j('preds')}, {_j('nodes')}, {_j('edges')}, {_j('forks')},
  CASE WHEN x.store % 2 = 0 THEN (x.store % 10) / 10 END AS discourse, {_j('paths')} FROM sets x JOIN sets y ON x.store < y.store)"""
_LAYERS = """layers AS (SELECT *, pow(greatest(0.05, layer2a) * greatest(0.05, layer2b) * greatest(0.05, layer2c), 1 / 3) AS layer2 FROM (SELECT *, CASE WHEN layer2b >= 0.25 THEN paths ELSE 0 END AS layer2c FROM (
  SELECT *, CASE WHEN layer2a >= 0.2 THEN CASE WHEN discourse IS NULL THEN 0.4 * nodes + 0.3 * edges + 0.3 * forks ELSE 0.7 * (0.4 * nodes + 0.3 * edges + 0.3 * forks) + 0.3 * discourse END ELSE 0 END AS layer2b FROM (
  SELECT *, CASE WHEN layer1 >= 0.4 THEN preds ELSE 0 END AS layer2a FROM (SELECT *, 0.6 * minhash + 0.25 * schemas + 0.15 * greatest(0, velocity) AS layer1 FROM pairs)))))"""


def _pairs(t):
    def held(kind, modulo):
        value = F.col("node_id") % modulo if modulo else F.col("node_id")
        return F.collect_set(F.when(F.col("event_type") == kind, value) if kind else value)

    s = t.log.groupBy(F.col("k").alias("store")).agg(held("view", 0).alias("preds"), held("click", 30).alias("nodes"), held("error", 20).alias("edges"), held("purchase", 10).alias("forks"), held("signup", 25).alias("paths"), held(None, 8).alias("schemas"))
    names = ("preds", "nodes", "edges", "forks", "paths", "schemas")
    x = s.select(F.col("store").alias("a"), *[F.col(c).alias(f"x_{c}") for c in names])
    y = s.select(F.col("store").alias("b"), *[F.col(c).alias(f"y_{c}") for c in names])
    p = x.join(y, F.col("a") < F.col("b"))
    scores = [M.set_overlap(F.col(f"x_{c}"), F.col(f"y_{c}")).alias("predicates" if c == "preds" else c) for c in names]
    return p.select("a", "b", ((F.col("a") * 7 + F.col("b") * 3) % 100 / 100).alias("minhash"), (((F.col("a") + F.col("b")) % 20 - 10) / 10).alias("velocity"), F.when(F.col("a") % 2 == 0, (F.col("a") % 10) / 10).alias("discourse"), *scores)


for _name, _col, _extra in (("f01_structural", "layer1", "layer1 >= 0.4 AS open"), ("f02_predicate_overlap", "layer2a", "layer2a >= 0.2 AS open"), ("f03_derivation_graph", "layer2b", "layer2b >= 0.25 AS open"), ("f04_path_overlap", "layer2c", "layer2c >= 0.15 AS open"), ("f05_derivation_layer", "layer2", "layer2 >= 0.3 AS open")):
    _gate = float(_extra.split(">= ")[1].split()[0])
    query(_name, "log", f"SELECT a, b, round({_col} + 1e-9, 6) AS score, round({_col} + 1e-9, 6) >= {_gate} AS open FROM layers", _SETS, _PAIRS, _LAYERS)(
        lambda t, c=_col, g=_gate: M.cascade(_pairs(t)).select("a", "b", F.round(F.col(c) + 1e-9, 6).alias("score"), (F.round(F.col(c) + 1e-9, 6) >= g).alias("open"))
    )


_SEM = "semantic AS (SELECT a.label AS a, b.label AS b, round((max(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))) + 1) / 2, 6) AS semantic FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.label <> b.label GROUP BY 1, 2)"


def _semantic(t):
    v = t.vectors.select(F.col("label").alias("store"), "v")
    return M.best_semantic(t.vectors.where(F.col("vec_id") % 50 == 0).select(F.col("label").alias("store"), "v"), v)


@query("f06_semantic", "vectors", "SELECT * FROM semantic", _SEM)
def _(t):
    return _semantic(t)


@query("f07_substrate_layer", "vectors", "SELECT a, b, round(0.55 * semantic + 0.30 * (a % 5) / 5 + 0.15 * (b % 4) / 4, 6) AS score FROM semantic", _SEM)
def _(t):
    return _semantic(t).select("a", "b", F.round(M.layer3(F.col("semantic"), F.col("a") % 5 / 5, F.col("b") % 4 / 4), 6).alias("score"))


@query("f08_topology", "log", "SELECT a, b, CASE WHEN velocity > 0.6 AND preds < 0.4 THEN 'divergent' WHEN forks > 0.55 THEN 'mentor' WHEN minhash > 0.6 AND forks < 0.3 THEN 'peer' ELSE 'complementary' END AS topology FROM pairs", _SETS, _PAIRS)
def _(t):
    return _pairs(t).select("a", "b", M.topology(F.col("minhash"), F.col("forks"), F.col("predicates"), F.col("velocity")).alias("topology"))


_EMA = f"ema AS (SELECT k AS path, round(sum(value * pow(0.5, ({NOW_MS}.0 - ts_ms) / (30 * 86400000.0))), 6) AS weight, round(sum(value * pow(0.5, ({NOW_MS}.0 - ts_ms) / (30 * 86400000.0))) FILTER (event_type = 'click'), 6) AS base FROM log GROUP BY k)"


@query("f09_path_weights", "log", "SELECT path, weight FROM ema WHERE weight >= 1e-9", _EMA)
def _(t):
    return M.path_weights(t.log.select(F.col("k").alias("path"), "ts_ms", F.col("value").alias("weight")), NOW_MS)


@query("f10_region_uncertainty", "log", "SELECT k AS region, round(least(1.0, count(*) FILTER (event_type = 'error') / count(*) FILTER (event_type <> 'error')), 6) AS uncertainty FROM log GROUP BY k HAVING count(*) FILTER (event_type <> 'error') > 0")
def _(t):
    total = t.log.where("event_type <> 'error'").groupBy(F.col("k").alias("region")).agg(F.count(F.lit(1)).alias("total"))
    return M.region_uncertainty(total, t.log.where("event_type = 'error'").groupBy(F.col("k").alias("region")).agg(F.count(F.lit(1)).alias("refined")))


@query("f11_tunnels", "log", "SELECT path, round(weight / greatest(coalesce(base, 0), 0.1), 6) AS gain FROM ema WHERE round(weight / greatest(coalesce(base, 0), 0.1), 6) >= 3 ORDER BY gain DESC, path", _EMA)
def _(t):
    log = t.log.select(F.col("k").alias("path"), "ts_ms", F.col("value").alias("weight"), "event_type")
    return M.discover_tunnels(M.path_weights(log, NOW_MS), M.path_weights(log.where("event_type = 'click'"), NOW_MS))


_TRUST = """trust AS (SELECT asserter, round(list_reduce(list_prepend(0.5::DOUBLE, d), lambda acc, x: greatest(0.0, least(1.0, acc + x))), 6) AS trust FROM (
  SELECT node_id AS asserter, list(CASE WHEN event_type = 'click' THEN 0.1::DOUBLE ELSE -0.2::DOUBLE END ORDER BY "offset") AS d FROM log WHERE event_type IN ('click', 'error') GROUP BY node_id))"""


def _trust(t):
    return M.trust_scores(t.log.where("event_type in ('click', 'error')").select(F.col("node_id").alias("asserter"), "offset", (F.col("event_type") == "click").alias("confirmed")))


@query("f12_trust", "log", "SELECT * FROM trust", _TRUST)
def _(t):
    return _trust(t)


@query("f12_decorations", "log", f"""SELECT "offset" AS decoration, k AS anchor, node_id AS asserter, round(value / 60 * coalesce(trust, 0.5) * pow(0.5, ({NOW_MS}.0 - ts_ms) / (90 * 86400000.0)), 6) AS weight
  FROM log LEFT JOIN trust ON asserter = node_id WHERE event_type = 'view' AND value / 60 >= 0.4""", _TRUST)
def _(t):
    items = t.log.where("event_type = 'view'").select(F.col("offset").alias("decoration"), F.col("k").alias("anchor"), F.col("node_id").alias("asserter"), (F.col("value") / 60).alias("confidence"), "ts_ms")
    return M.decorations(items, _trust(t), NOW_MS)


@query("f13_manifest", "log", f"""SELECT owner, sha256(string_agg(concat(theme, '=', n), ';' ORDER BY theme)) AS content_hash, count(*) AS themes, {NOW_MS + 7 * 86_400_000} AS expires_ms FROM (SELECT node_id AS owner, event_type AS theme, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY owner""")
def _(t):
    themes = t.log.groupBy(F.col("node_id").alias("owner"), F.col("event_type").alias("theme")).agg(F.count(F.lit(1)).alias("n"))
    return M.manifest(themes, NOW_MS).withColumn("expires_ms", F.col("expires_ms").cast("long"))


@query("f14_slice", "drawers", "SELECT doc_id, wing FROM drawers ORDER BY doc_id LIMIT 256")
def _(t):
    return M.slice_rows(t.drawers, None, "doc_id").select("doc_id", "wing")


@query("f15_first_encounter", "log", """SELECT * FROM (SELECT 'theme' AS section, CAST(k AS VARCHAR) AS id, score FROM (SELECT k, count(*) AS score, max(ts_ms) AS ts FROM log GROUP BY k) ORDER BY score DESC, ts DESC, k LIMIT 12)
  UNION ALL SELECT * FROM (SELECT 'now', CAST(node_id AS VARCHAR), score FROM (SELECT node_id, count(*) FILTER (event_type = 'click') AS score, max(ts_ms) AS ts FROM log GROUP BY node_id) ORDER BY score DESC, ts DESC, node_id LIMIT 6)
  UNION ALL SELECT * FROM (SELECT 'promotion', CAST(node_id AS VARCHAR), score FROM (SELECT node_id, count(*) FILTER (event_type = 'purchase') AS score, max(ts_ms) AS ts FROM log GROUP BY node_id) ORDER BY score DESC, ts DESC, node_id LIMIT 8)""")
def _(t):
    def scored(key, kind=None):
        n = F.sum((F.col("event_type") == kind).cast("long")) if kind else F.count(F.lit(1))
        return t.log.groupBy(F.col(key).alias("id")).agg(n.alias("score"), F.max("ts_ms").alias("ts_ms"))

    return M.first_encounter(scored("k"), scored("node_id", "click"), scored("node_id", "purchase"))


RATE_LIMIT = (
    """r AS MATERIALIZED (SELECT node_id % 5 AS peer, ts_ms, "offset" AS request, row_number() OVER (PARTITION BY node_id % 5 ORDER BY ts_ms, "offset") AS i FROM log)""",
    """bucket AS (SELECT peer, ts_ms, request, i, 0.0::DOUBLE AS level, true AS allowed FROM r WHERE i = 1 UNION ALL SELECT peer, ts_ms, request, i, CASE WHEN x >= 1 THEN x - 1 ELSE x END, x >= 1 FROM (
  SELECT r.*, least(1.0::DOUBLE, b.level + (r.ts_ms - b.ts_ms) * 1.0::DOUBLE / 3600000) AS x FROM bucket b JOIN r ON r.peer = b.peer AND r.i = b.i + 1))""",
)


@query("f16_rate_limit", "log", "SELECT peer, ts_ms, request, allowed FROM bucket", *RATE_LIMIT, recursive=True)
def _(t):
    return M.rate_limit(t.log.select((F.col("node_id") % 5).alias("peer"), "ts_ms", F.col("offset").alias("request")), 1.0)
