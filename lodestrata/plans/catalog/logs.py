"""Log operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import logs as L
from ...operators import views as V
from ...sources.tables import NOW_MS
from ...sources import adapters
from ...streaming import views as S
from ..registry import query
from ..settle import settle, shared_folder

_CODES = """list_filter([CASE WHEN valid_to < valid_from THEN 'invalid_validity_range' END, CASE WHEN weight < 0 THEN 'weight_negative' END,
  CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END], lambda x: x IS NOT NULL)"""
_CHECKED = """checked AS (SELECT edge_id, source, valid_from, valid_to, round(weight - 0.92, 4) AS weight, round((epoch_ms(l_shipdate) % 1100000) / 1000000, 4) AS confidence
  FROM edges JOIN (SELECT concat('e-', l_orderkey, '-', l_linenumber, '-', l_partkey) AS id, l_shipdate FROM lineitem) ON id = edge_id)"""


def _checked(t):
    lines = t.raw("lineitem")
    e = t.edges
    ship = lines.select(F.concat_ws("-", F.lit("e"), "l_orderkey", "l_linenumber", "l_partkey").alias("edge_id"), F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast(l_shipdate as timestamp_ntz))").alias("ship"))
    return e.join(ship, "edge_id").select("edge_id", F.lit("edge_created").alias("kind"), "source", "valid_from", "valid_to", F.round(F.col("weight") - 0.92, 4).alias("weight"), F.round((F.col("ship") % 1_100_000) / 1_000_000, 4).alias("confidence"))


@query("l01_append_validated", "edges", f"SELECT CASE WHEN len({_CODES}) > 0 THEN 'append_rejected' ELSE 'edge_created' END AS kind, count(*) AS n FROM checked GROUP BY 1", _CHECKED)
def _(t):
    return L.append_validated(_checked(t), L.edge_errors()).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("l02_edge_errors", "edges", f"SELECT edge_id, array_to_string({_CODES}, ',') AS codes FROM checked WHERE len({_CODES}) > 0", _CHECKED)
def _(t):
    return _checked(t).withColumn("codes", F.array_join(L.edge_errors(), ",")).where("codes <> ''").select("edge_id", "codes")


@query("l02_node_errors", "log", """SELECT node_id, canonical AND canon_path IS NULL AS without_path, importance > 1 AS out_of_range FROM (SELECT node_id,
  coalesce(arg_max(value >= 30, "offset") FILTER (field = 'canonical'), false) AS canonical, arg_max(k, "offset") FILTER (field = 'canon_path') AS canon_path,
  max(value / 50) AS importance FROM log WHERE kind = 'node_property_set' GROUP BY node_id) WHERE (canonical AND canon_path IS NULL) OR importance > 1""")
def _(t):
    s = t.log.where("kind = 'node_property_set'")
    from ...operators.fold import last_where

    n = s.groupBy("node_id").agg(F.coalesce(last_where(F.col("value") >= 30, F.col("field") == "canonical"), F.lit(False)).alias("canonical"), last_where(F.col("k"), F.col("field") == "canon_path").alias("canon_path"), F.max(F.col("value") / 50).alias("importance"))
    e = n.withColumn("codes", L.node_errors()).where(F.size("codes") > 0)
    return e.select("node_id", F.array_contains("codes", "canonical_node_without_canon_path").alias("without_path"), F.array_contains("codes", "importance_out_of_range").alias("out_of_range"))


_KIND = "CASE x[1] WHEN 'r' THEN 'region' WHEN 'n' THEN 'nation' WHEN 'c' THEN 'customer' ELSE 'supplier' END"


@query("l03_endpoint_violations", "hierarchy", "SELECT source, target, 'supplier' AS target_kind FROM hierarchy WHERE target LIKE 's%'")
def _(t):
    h = t.hierarchy
    ids = h.select(F.col("source").alias("node_id")).unionAll(h.select(F.col("target").alias("node_id"))).distinct()
    kind = F.create_map(*[F.lit(x) for x in ("r", "region", "n", "nation", "c", "customer", "s", "supplier")])[F.substring("node_id", 1, 1)]
    allowed = t.spark.createDataFrame([("contains", "region", "nation"), ("contains", "nation", "customer")], "kind string, source_kind string, target_kind string")
    return L.endpoint_violations(h.withColumn("kind", F.lit("contains")), ids.withColumn("node_kind", kind), allowed).select("source", "target", "target_kind")


@query("l04_read_range", "log", 'SELECT "offset", kind, node_id FROM log WHERE "offset" >= 100 AND "offset" < 400 ORDER BY 1')
def _(t):
    return L.read_range(t.log, 100, 400).select("offset", "kind", "node_id")


@query("l06_snapshot_and_tail", "log", """SELECT node_id, CAST(count(*) AS BIGINT) AS n, max("offset") AS last FROM log WHERE kind = 'node_accessed' GROUP BY node_id""")
def _(t):
    return L.resume(L.snapshot(t.log, 500), t.log, 500)


@query("l07_compaction_due", "log", f"""SELECT count(*) AS events, max(ts_ms) - {NOW_MS - 20 * 86_400_000} AS age_ms, true AS due FROM log WHERE "offset" > 200""")
def _(t):
    return L.should_snapshot(t.log, 200, NOW_MS - 20 * 86_400_000)


_MARKERS = """markers AS (SELECT * FROM (SELECT concat('c', "offset" // 50 % 4) AS consumer, "offset" // 50 AS batch, "offset",
  CASE "offset" % 50 WHEN 0 THEN 'started' WHEN 25 THEN CASE WHEN event_type IN ('view', 'error') THEN 'checkpointed' END
    WHEN 49 THEN CASE event_type WHEN 'error' THEN NULL WHEN 'click' THEN 'aborted' ELSE 'committed' END END AS marker FROM log) WHERE marker IS NOT NULL)"""
_OPEN = """open_ AS (SELECT s.consumer, s.batch, s."offset" AS start, p.checkpoint, coalesce(p.checkpoint, s."offset" - 1) AS safe FROM markers s
  LEFT JOIN (SELECT batch, max("offset") AS checkpoint FROM markers WHERE marker = 'checkpointed' GROUP BY batch) p ON p.batch = s.batch
  WHERE s.marker = 'started' AND s.batch NOT IN (SELECT batch FROM markers WHERE marker IN ('committed', 'aborted')))"""


def markers(t):
    place, kind = F.col("offset") % 50, F.col("event_type")
    marker = F.when(place == 0, "started").when((place == 25) & kind.isin("view", "error"), "checkpointed").when((place == 49) & (kind == "click"), "aborted").when((place == 49) & (kind != "error"), "committed")
    batch = F.floor(F.col("offset") / 50)
    return t.log.select(F.concat(F.lit("c"), batch % 4).alias("consumer"), batch.alias("batch"), "offset", marker.alias("marker")).where("marker is not null")


@query("l08_batch_lifecycle", "log", "SELECT marker, count(*) AS n, count(DISTINCT consumer) AS consumers FROM markers GROUP BY marker", _MARKERS)
def _(t):
    return markers(t).groupBy("marker").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("consumer").alias("consumers"))


@query("l09_torn_batches", "log", "SELECT * FROM open_", _MARKERS, _OPEN)
def _(t):
    return L.open_batches(markers(t))


_FRONTIERS = """frontiers AS (SELECT c.consumer, coalesce(min(safe), (SELECT max("offset") FROM log)) AS frontier FROM (SELECT DISTINCT consumer FROM markers) c LEFT JOIN open_ o ON o.consumer = c.consumer GROUP BY c.consumer)"""


def _frontiers(t):
    return L.committed_frontiers(markers(t), t.log.agg(F.max("offset").alias("head")))


@query("l09_committed_frontiers", "log", "SELECT * FROM frontiers", _MARKERS, _OPEN, _FRONTIERS)
def _(t):
    return _frontiers(t)


@query("l10_recovery_aborts", "log", "SELECT consumer, batch, 'aborted' AS marker, 'torn' AS reason, safe AS partial_to FROM open_", _MARKERS, _OPEN)
def _(t):
    return L.recovery_aborts(markers(t))


@query("l10_quarantine", "log", 'SELECT "offset" // 50 AS batch, count(*) AS n FROM log WHERE "offset" // 50 NOT IN (SELECT batch FROM open_) GROUP BY 1', _MARKERS, _OPEN)
def _(t):
    rows = t.log.withColumn("batch", F.floor(F.col("offset") / 50))
    return L.quarantine(rows, markers(t)).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


@query("l11_consistent_read", "log", 'SELECT kind, count(*) AS n, max("offset") AS last FROM log WHERE "offset" <= (SELECT min(frontier) FROM frontiers) + 400 GROUP BY kind', _MARKERS, _OPEN, _FRONTIERS)
def _(t):
    ahead = _frontiers(t).withColumn("frontier", F.col("frontier") + 400)
    return L.consistent_read(t.log, ahead).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))


@query("l13_erasure", "log", """SELECT "offset", kind, CASE WHEN node_id <> 7 AND k <> 7 THEN concat('n', node_id) END AS node_id, CASE WHEN node_id <> 7 AND k <> 7 THEN concat('n', k) END AS source, node_id = 7 OR k = 7 AS erased FROM log""")
def _(t):
    e = t.log.select("offset", "kind", F.concat(F.lit("n"), "node_id").alias("node_id"), F.concat(F.lit("n"), "k").alias("source"), F.lit(None).cast("string").alias("target"))
    return L.erase(e, "n7").select("offset", "kind", "node_id", "source", "erased")


@query("l14_export_estimate", "drawers", "SELECT count(*) AS drawers, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, CAST(ceil(count(*) / 100) AS BIGINT) AS chunks FROM drawers")
def _(t):
    return L.export_estimate(t.drawers, 100)


@query("l15_topology_page", "hierarchy", "SELECT target AS node_id, source AS parent FROM hierarchy WHERE target > 'c100' ORDER BY target LIMIT 50")
def _(t):
    return L.page(t.hierarchy.select(F.col("target").alias("node_id"), F.col("source").alias("parent")), "node_id", "c100", 50)


@query("l15_topology_stats", "edges", """SELECT kind, count(*) AS "all", count(invalidated_at) AS invalidated, count(*) - count(invalidated_at) AS active FROM edges GROUP BY kind""")
def _(t):
    return L.topology_stats(t.edges.withColumn("gone", F.col("invalidated_at").isNotNull()), "kind", "gone")


@query("l16_missing_vectors", "drawers vectors", "SELECT doc_id, wing FROM drawers WHERE doc_id NOT IN (SELECT vec_id FROM vectors)")
def _(t):
    return L.missing_vectors(t.drawers, t.vectors).select("doc_id", "wing")


@query("l17_converter", None, """SELECT row_number() OVER (ORDER BY phase, id) AS "offset", kind, id FROM (SELECT 0 AS phase, 'theme_created' AS kind, CAST(r_regionkey AS VARCHAR) AS id FROM region
  UNION ALL SELECT 1, 'period_created', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 2, 'drawer_created', CAST(doc_id AS VARCHAR) FROM documents UNION ALL SELECT 3, 'triple_created', CAST(o_orderkey AS VARCHAR) FROM orders)""")
def _(t):
    return L.convert(t.raw("region").withColumnRenamed("r_regionkey", "id"), t.raw("nation").withColumnRenamed("n_nationkey", "id"), t.raw("documents").withColumnRenamed("doc_id", "id"), t.raw("orders").withColumnRenamed("o_orderkey", "id"))


@query("l18_invariants", "triples edges drawers", """SELECT 'drawer_in_period' AS invariant, CAST(doc_id AS VARCHAR) AS subject FROM drawers WHERE doc_id NOT IN (SELECT conv_id FROM conversations)
  UNION ALL SELECT 'assertion_derived_from', object FROM triples WHERE object NOT IN (SELECT source FROM edges WHERE invalidated_at IS NULL)
  UNION ALL SELECT 'period_timing', object FROM triples WHERE valid_to < valid_from
  UNION ALL SELECT 'sealed_implies_closed', object FROM triples WHERE o_orderpriority LIKE '1%' AND valid_to IS NULL
  UNION ALL SELECT 'hash_unique', CAST(doc_id AS VARCHAR) FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) ORDER BY doc_id) AS n FROM drawers) WHERE n > 1""")
def _(t):
    tr, e = t.triples, t.edges
    held = t.raw("conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    parts = [
        L.invariant("drawer_in_period", t.drawers.join(held, "doc_id", "left_anti"), "doc_id"),
        L.invariant("assertion_derived_from", tr.join(e.where("invalidated_at is null").select(F.col("source").alias("object")), "object", "left_anti"), "object"),
        L.invariant("period_timing", tr.where("valid_to < valid_from"), "object"),
        L.invariant("sealed_implies_closed", tr.where("o_orderpriority like '1%' and valid_to is null"), "object"),
        L.invariant("hash_unique", V.collisions(t.drawers), "doc_id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("l20_reconcile_counts", "drawers", "SELECT coalesce(a.room, b.room) AS room, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b, coalesce(n_a, 0) - coalesce(n_b, 0) AS diff FROM (SELECT room, count(*) AS n_a FROM drawers GROUP BY 1) a FULL JOIN (SELECT lang AS room, count(*) AS n_b FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1) b ON a.room = b.room")
def _(t):
    good = t.drawers.join(t.raw("labels").where("quality = 1").select("doc_id"), "doc_id")
    return L.reconcile_counts(t.drawers, good, "room")


@query("l05_durable_log", "log", "SELECT CAST(make_timestamp(ts_ms * 1000) AS DATE) AS day, count(*) AS n FROM log GROUP BY 1")
def _(t):
    """The event stream appended to files, started twice: the checkpoint makes the second start add nothing."""
    at = shared_folder(t.spark, "log")
    for _ in range(2):
        S.append_log(S.read_events(t.spark, t.sf_dir), f"{at}/data", f"{at}/checkpoint").awaitTermination()
    return settle(t.spark.read.parquet(f"{at}/data").groupBy("day").agg(F.count(F.lit(1)).alias("n")))


@query("l12_at_rest_encryption", "log", """SELECT "offset", CAST(CASE WHEN k % 3 > 0 THEN value END AS VARCHAR) AS payload, k % 3 > 0 AS sealed FROM log""")
def _(t):
    rows = t.log.select("offset", F.when(F.col("k") % 3 > 0, F.col("value").cast("string")).alias("payload"))
    sealed = adapters.encrypt_log(rows, "payload", "0000111122223333")
    marked = sealed.withColumn("sealed", F.coalesce(F.col("payload").startswith("enc:"), F.lit(False)))
    return adapters.decrypt_log(marked, "payload", "0000111122223333")


@query("l19_key_values", "log", """SELECT node_id AS id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS "view" FROM log WHERE event_type IN ('view', 'click') GROUP BY 1""")
def _(t):
    at = shared_folder(t.spark, "eav")
    t.log.where("event_type in ('view', 'click')").groupBy(F.col("node_id").alias("id"), F.col("event_type").alias("key")).agg(F.max("value").alias("value")).write.parquet(at)
    return settle(adapters.read_key_values(t.spark, at))
