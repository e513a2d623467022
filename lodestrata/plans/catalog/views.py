"""Event-log views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import views as V
from ...sources import fixtures as X
from ...sources.tables import NOW_MS
from ..registry import query

_NODE_EVENTS = """node_events AS (SELECT "offset", kind, node_id, field, CASE field WHEN 'importance' THEN concat('0.', lpad(CAST(k AS VARCHAR), 2, '0')) WHEN 'canonical' THEN CASE WHEN k % 4 = 3 THEN '1' WHEN value >= 30 THEN 'true' ELSE 'false' END
  ELSE CASE WHEN k % 5 = 0 THEN '7' ELSE concat('"p', k, '"') END END AS value FROM (SELECT * REPLACE (CASE WHEN kind = 'node_created' THEN 'importance' ELSE field END AS field) FROM log WHERE kind IN ('node_created', 'node_property_set')))"""
_CREATED = """live AS (SELECT * FROM (SELECT *, max(CASE WHEN kind = 'node_created' THEN "offset" END) OVER (PARTITION BY node_id) AS created FROM node_events) WHERE "offset" >= created)"""


@query("v01_current_nodes", "log", """
SELECT node_id, created_offset, modified_offset, canonical, importance, canon_path, n_properties, properties FROM (SELECT node_id, created AS created_offset, max("offset") AS modified_offset,
  coalesce(arg_max(value = 'true', "offset") FILTER (field = 'canonical' AND value IN ('true', 'false')), false) AS canonical,
  arg_max(TRY_CAST(value AS DOUBLE), "offset") FILTER (field = 'importance') AS importance,
  nullif(trim(arg_max(CASE WHEN value LIKE '"%' THEN value ELSE '' END, "offset") FILTER (field = 'canon_path'), '"'), '') AS canon_path FROM live GROUP BY node_id, created)
JOIN (SELECT node_id, count(*) AS n_properties, string_agg(concat(field, '=', value), ';' ORDER BY field) AS properties FROM (SELECT node_id, field, arg_max(value, "offset") AS value FROM live GROUP BY node_id, field) GROUP BY node_id) USING (node_id)""", _NODE_EVENTS, _CREATED)
def _(t):
    entries = F.transform(F.map_entries("properties"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return V.current_nodes(X.node_events(t.log)).withColumn("n_properties", F.size("properties").cast("long")).withColumn("properties", F.array_join(entries, ";"))


_EDGE_EVENTS = """edge_events AS (SELECT "offset", ts_ms, CASE event_type WHEN 'view' THEN 'created' WHEN 'error' THEN 'invalidated' WHEN 'signup' THEN 'revalidated' END AS kind,
  concat('e-', node_id, '-', k % 10) AS edge_id, node_id, k, round(value, 4) AS weight FROM log WHERE event_type IN ('view', 'error', 'signup'))"""
_EDGES_NOW = """edges_now AS (SELECT edge_id, arg_max(node_id, "offset") FILTER (kind = 'created') AS source, arg_max(weight, "offset") FILTER (kind = 'created') AS weight,
  arg_max(ts_ms, "offset") FILTER (kind = 'created') AS recorded_at,
  CASE WHEN arg_max(kind, "offset") FILTER (kind <> 'created') = 'invalidated' THEN arg_max(ts_ms, "offset") FILTER (kind <> 'created') END AS invalidated_at
  FROM (SELECT *, max(CASE WHEN kind = 'created' THEN "offset" END) OVER (PARTITION BY edge_id) AS created FROM edge_events) WHERE "offset" >= created GROUP BY edge_id)"""


@query("v02_current_edges", "log", "SELECT * FROM edges_now", _EDGE_EVENTS, _EDGES_NOW)
def _(t):
    return V.current_edges(X.edge_events(t.log))


@query("v03_current_interpretations", "log", """
SELECT node_id, field, max("offset") AS "offset", arg_max(value, "offset") AS value, arg_max(ts_ms, "offset") AS ts_ms, concat(node_id, '::', field) AS interpretation_id
FROM log WHERE kind = 'node_property_set' GROUP BY node_id, field""")
def _(t):
    return V.current_interpretations(t.log)


_SCHEMAS = """schemas AS (SELECT k AS schema_id, max("offset") AS "offset", arg_max(row(CASE WHEN value > 50 THEN (k * 7) % 100 END), "offset")[1] AS supersedes,
  arg_max(round(value, 4), "offset") AS stability FROM log WHERE event_type = 'purchase' GROUP BY k)"""


@query("v04_current_schemas", "log", "SELECT * FROM schemas", _SCHEMAS)
def _(t):
    return V.current_schemas(X.induced_schemas(t.log))


@query("v04_active_schema_heads", "log", "SELECT * FROM schemas WHERE schema_id NOT IN (SELECT supersedes FROM schemas WHERE supersedes IS NOT NULL)", _SCHEMAS)
def _(t):
    return V.active_schema_heads(V.current_schemas(X.induced_schemas(t.log)))


HEAT = f"""heat AS (
  SELECT node_id, accesses, anchor AS anchor_ms, coalesce(flag AND flagged > begun, false) AS canonical,
    round(CASE WHEN coalesce(flag AND flagged > begun, false) THEN greatest(0.95, decayed) ELSE decayed END, 6) AS heat
  FROM (SELECT *, least(1.0, 0.5 + 0.05 * accesses) * exp(-({NOW_MS} - anchor) / 86400000.0 * ln(2) / 30) AS decayed FROM (
    SELECT node_id, count(*) FILTER (kind = 'node_accessed') AS accesses,
      arg_max(ts_ms, "offset") FILTER (kind IN ('node_created', 'node_accessed')) AS anchor,
      min("offset") FILTER (kind IN ('node_created', 'node_accessed')) AS begun,
      arg_max(value >= 30, "offset") FILTER (kind = 'node_property_set') AS flag,
      max("offset") FILTER (kind = 'node_property_set') AS flagged
    FROM (SELECT *, max(CASE WHEN kind = 'node_created' THEN "offset" END) OVER (PARTITION BY node_id) AS created FROM log
      WHERE kind IN ('node_created', 'node_accessed') OR (kind = 'node_property_set' AND field = 'canonical'))
    WHERE created IS NULL OR "offset" >= created GROUP BY node_id) WHERE begun IS NOT NULL))"""


@query("v05_heat_field", "log", "SELECT * FROM heat", HEAT)
def _(t):
    return V.heat_field(t.log, NOW_MS)


@query("v05_hottest", "log", "SELECT node_id, heat FROM heat ORDER BY heat DESC, node_id LIMIT 10", HEAT)
def _(t):
    return V.heat_field(t.log, NOW_MS).select("node_id", "heat").orderBy(F.desc("heat"), "node_id").limit(10)


_DAY = 86_400_000


@query("v06_velocity_field", "log", f"""
SELECT node_id, c7, p7, c30, c90, round(CASE WHEN p7 = 0 THEN c7 ELSE (c7 - p7) / p7 END, 6) AS velocity_7d,
  round(CASE WHEN p30 = 0 THEN c30 / 30 ELSE (c30 - p30) / p30 END, 6) AS velocity_30d, round(c90 / 90, 6) AS velocity_90d
FROM (SELECT node_id, count(*) FILTER (ts_ms >= {NOW_MS - 7 * _DAY}) AS c7, count(*) FILTER (ts_ms >= {NOW_MS - 14 * _DAY} AND ts_ms < {NOW_MS - 7 * _DAY}) AS p7,
  count(*) FILTER (ts_ms >= {NOW_MS - 30 * _DAY}) AS c30, count(*) FILTER (ts_ms >= {NOW_MS - 60 * _DAY} AND ts_ms < {NOW_MS - 30 * _DAY}) AS p30, count(*) AS c90
  FROM log WHERE kind = 'node_accessed' AND ts_ms <= {NOW_MS} AND ts_ms >= {NOW_MS - 90 * _DAY} GROUP BY node_id)""")
def _(t):
    return V.velocity_field(t.log, NOW_MS)


@query("v07_recurrence_clusters", "log", """
SELECT cluster_id, arg_min(drawer_id, first) AS representative, count(*) AS n_members, min(first) AS first_offset, max(last) AS last_offset,
  string_agg(CAST(drawer_id AS VARCHAR), ',' ORDER BY first, drawer_id) AS members
FROM (SELECT k AS cluster_id, node_id AS drawer_id, min("offset") AS first, max("offset") AS last FROM log WHERE event_type = 'click' GROUP BY 1, 2) GROUP BY cluster_id""")
def _(t):
    return V.recurrence_clusters(t.log.where("event_type = 'click'").select(F.col("k").alias("cluster_id"), F.col("node_id").alias("drawer_id"), "offset"))


_PERIODS = """periods AS (SELECT node_id AS period_id,
  coalesce(arg_max(CASE WHEN value >= 30 THEN 'closed' ELSE 'open' END, "offset") FILTER (event_type = 'purchase' AND k % 3 = 0), 'open') AS state,
  arg_max(ts_ms, "offset") FILTER (event_type = 'purchase' AND k % 3 = 1) AS ended_at,
  coalesce(arg_max(k, "offset") FILTER (event_type = 'purchase' AND k % 3 = 2), arg_max(k, "offset") FILTER (event_type = 'signup')) AS precedence
  FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN "offset" END) OVER (PARTITION BY node_id) AS created FROM log WHERE event_type IN ('signup', 'purchase'))
  WHERE "offset" >= created GROUP BY node_id)"""


@query("v08_active_periods", "log", "SELECT * FROM periods", _PERIODS)
def _(t):
    return V.active_periods(t.log)


@query("v08_open_or_recent_periods", "log", f"SELECT * FROM periods WHERE state = 'open' OR ended_at >= {NOW_MS - 7 * _DAY}", _PERIODS)
def _(t):
    return V.open_or_recent(V.active_periods(t.log), NOW_MS)


@query("v09_active_iams", "log", f"""SELECT edge_id, source_id AS source, target, recorded_at FROM (
  SELECT edge_id, CASE WHEN source % 2 = 0 THEN '{V.SELF_ENTITY}' ELSE concat('u', source) END AS source_id, concat('period', source % 12) AS target, recorded_at
  FROM edges_now WHERE invalidated_at IS NULL AND weight >= 10) WHERE source_id = '{V.SELF_ENTITY}'""", _EDGE_EVENTS, _EDGES_NOW)
def _(t):
    e = V.current_edges(X.edge_events(t.log))
    self_or_user = F.when(F.col("source") % 2 == 0, F.lit(V.SELF_ENTITY)).otherwise(F.concat(F.lit("u"), F.col("source")))
    roles = e.select("edge_id", F.when(F.col("weight") >= 10, "role_in_period").otherwise("mentions").alias("kind"), self_or_user.alias("source"), F.concat(F.lit("period"), F.col("source") % 12).alias("target"), "recorded_at", "invalidated_at")
    return V.active_iams(roles).select("edge_id", "source", "target", "recorded_at")


@query("v10_canon_set", "log", """
SELECT node_id, canon_path, since_offset FROM (
  SELECT s.node_id, arg_max(value >= 30, "offset") FILTER (field = 'canonical') AS canonical, arg_max(concat('p', k), "offset") FILTER (field = 'canon_path') AS canon_path,
    max("offset") FILTER (kind = 'node_created' OR (field = 'canonical' AND value >= 30)) AS since_offset
  FROM sets s JOIN (SELECT node_id, max("offset") FILTER (kind = 'node_created') AS created, min("offset") AS begun FROM sets
    WHERE kind = 'node_created' OR (field = 'canonical' AND value >= 30) GROUP BY node_id) b ON s.node_id = b.node_id
  WHERE "offset" >= coalesce(created, begun) GROUP BY s.node_id) WHERE canonical""",
    "sets AS (SELECT * FROM log WHERE kind = 'node_created' OR (kind = 'node_property_set' AND field IN ('canonical', 'canon_path')))")
def _(t):
    return V.canon_set(t.log)


@query("v11_open_contradictions", "log", """
SELECT edge_id, max("offset") AS asserted_offset, count(*) AS times FROM x WHERE kind = 'asserted' AND edge_id NOT IN (SELECT edge_id FROM x WHERE kind = 'resolved') GROUP BY edge_id""",
    """x AS (SELECT concat('x-', node_id, '-', k % 5) AS edge_id, "offset", CASE WHEN event_type = 'error' THEN 'asserted' ELSE 'resolved' END AS kind FROM log WHERE event_type IN ('error', 'signup'))""")
def _(t):
    return V.open_contradictions(X.contradiction_events(t.log))


@query("v12_pending_review", "log", """
SELECT concat('pri_', category, '_', ref) AS item_id, category, ref, "offset" AS added_offset FROM (
  SELECT category, ref, max("offset") AS "offset", arg_max(added, "offset") AS added FROM (
    SELECT CASE event_type WHEN 'view' THEN 'proposal' WHEN 'click' THEN 'schema' WHEN 'purchase' THEN 'collision' ELSE 'contradiction' END AS category,
      concat(CASE WHEN k % 4 = 0 THEN 'edge' ELSE 'node' END, node_id) AS ref, "offset", event_type <> 'signup' AS added FROM log) GROUP BY category, ref) WHERE added""")
def _(t):
    return V.pending_review(t.log)


_MATCHES = """requests AS (SELECT concat('m-', node_id, '-', k) AS match_id, arg_max(node_id, "offset") AS requester, arg_max(k % 20, "offset") AS target, arg_max(ts_ms, "offset") AS requested_at
  FROM log WHERE event_type = 'view' GROUP BY 1), findings AS (SELECT concat('m-', node_id, '-', k) AS match_id, arg_max(ts_ms, "offset") AS completed_at, arg_max(round(value, 4), "offset") AS strength
  FROM log WHERE event_type = 'click' GROUP BY 1)"""


@query("v13_match_cache", "log", """SELECT *, concat(requester, '|', target, '|', window_key) AS cache_key FROM (
  SELECT *, strftime(make_timestamp(completed_at * 1000), '%G-W%V') AS window_key FROM requests JOIN findings USING (match_id))""", _MATCHES)
def _(t):
    return V.match_cache(*X.match_events(t.log))


@query("v14_matched_against", "log", "SELECT r.*, completed_at FROM requests r LEFT JOIN findings f ON r.match_id = f.match_id", _MATCHES)
def _(t):
    return V.matched_against(*X.match_events(t.log))


@query("v14_count_in_window", "log", f"SELECT requester, count(*) FILTER (requested_at > {NOW_MS - 7 * _DAY} AND requested_at <= {NOW_MS}) AS in_window, count(*) AS requests FROM requests GROUP BY requester", _MATCHES)
def _(t):
    return V.count_in_window(V.matched_against(*X.match_events(t.log)), NOW_MS, 7 * _DAY)


@query("v17_outgoing_edges", "log", "SELECT source, count(*) AS out_degree, round(sum(weight), 4) AS out_weight, max(recorded_at) AS newest FROM edges_now WHERE invalidated_at IS NULL GROUP BY source", _EDGE_EVENTS, _EDGES_NOW)
def _(t):
    active = V.current_edges(X.edge_events(t.log)).where("invalidated_at is null")
    return active.groupBy("source").agg(F.count(F.lit(1)).alias("out_degree"), F.round(F.sum("weight"), 4).alias("out_weight"), F.max("recorded_at").alias("newest"))


@query("v18_invalidation_set", "log", """SELECT node_id, since_offset FROM (SELECT node_id, max("offset") AS since_offset, arg_max(event_type, "offset") AS last FROM log
  WHERE event_type IN ('error', 'signup') GROUP BY node_id) WHERE last = 'error'""")
def _(t):
    return V.invalidation_set(t.log)


_STRIP = "trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"


@query("v19_collisions", "drawers", f"""SELECT doc_id, first_id, content_hash, copies - 1 AS others FROM (
  SELECT doc_id, sha256({_STRIP}) AS content_hash, min(doc_id) OVER (PARTITION BY sha256({_STRIP})) AS first_id, count(*) OVER (PARTITION BY sha256({_STRIP})) AS copies FROM drawers)
  WHERE doc_id <> first_id""")
def _(t):
    return V.collisions(t.drawers)


@query("v20_subscriber_tick", "log", """SELECT consumer_id, count("offset") FILTER (c.kind IS NULL OR log.kind = c.kind) AS handled, coalesce(max("offset"), pos) AS "offset",
  (SELECT max("offset") FROM log) - coalesce(max("offset"), pos) AS lag FROM consumers c LEFT JOIN log ON "offset" > pos AND "offset" <= pos + 256 GROUP BY consumer_id, pos""",
    "consumers AS (SELECT * FROM (VALUES ('miner', NULL, 100), ('heat', 'node_accessed', 500), ('canon', 'node_property_set', 0), ('done', NULL, 1000000000)) v(consumer_id, kind, pos))")
def _(t):
    consumers = t.spark.createDataFrame([("miner", None, 100), ("heat", "node_accessed", 500), ("canon", "node_property_set", 0), ("done", None, 1_000_000_000)], "consumer_id string, kind string, at long")
    return V.subscriber_tick(t.log, consumers)
