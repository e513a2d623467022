"""Streaming forms, exploration and functions that need Python."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import udfs as U
from ...operators import explore as P
from ...operators import text as X
from ...streaming import views as S
from ...streaming.views_registry import Bridge
from ...operators.retrieve import stances
from ..registry import query
from .retrieve import _FACTORED as R_FACTORED
from .retrieve import _FEATURES as R_FEATURES
from .retrieve import _NEURAL as R_NEURAL
from .retrieve import _STANCE as R_STANCE
from .match import RATE_LIMIT
from .retrieve import features
from .views import HEAT


def _log(t, per_trigger=1):
    return S.as_log(S.read_events(t.spark, t.sf_dir, per_trigger))


@query("v05_heat_stream", "log", """SELECT node_id, accesses, anchor_ms, CAST(round(least(1.0, 0.5 + 0.05 * accesses), 6) AS DOUBLE) AS heat_at_anchor FROM (SELECT node_id, count(*) FILTER (event_type <> 'signup') AS accesses, max(ts_ms) AS anchor_ms FROM (
  SELECT *, max(CASE WHEN event_type = 'signup' THEN "offset" END) OVER (PARTITION BY node_id) AS created FROM log WHERE event_type IN ('signup', 'view', 'click')) WHERE created IS NULL OR "offset" >= created GROUP BY node_id)""")
def _(t):
    return S.drain(S.heat(_log(t)), "update", ["node_id"])


@query("v06_sliding_stream", None, """SELECT date_trunc('day', ts) - CAST(d AS INT) * INTERVAL 1 DAY AS begun, user_id AS node_id, count(*) AS n FROM events, range(7) r(d) WHERE event_type IN ('view', 'click') GROUP BY 1, 2""")
def _(t):
    return S.drain(S.access_counts(_log(t)), "complete").withColumn("begun", F.col("begun").cast("timestamp_ntz"))


@query("v13_match_stream", None, """SELECT a.user_id || '-' || CAST(json_extract(a.props, '$.k') AS BIGINT) AS match_id, a.event_id AS request, b.event_id AS finding FROM events a JOIN events b
  ON a.user_id = b.user_id AND json_extract(a.props, '$.k') = json_extract(b.props, '$.k') AND a.event_type = 'view' AND b.event_type = 'click' AND b.ts BETWEEN a.ts - INTERVAL 30 DAY AND a.ts + INTERVAL 30 DAY""")
def _(t):
    return S.drain(S.matches(_log(t, None)), "append")


@query("c04_unseen_stream", "log", 'SELECT node_id, count(DISTINCT "offset") AS n FROM log GROUP BY node_id')
def _(t):
    return S.drain(S.unseen(_log(t, None), "offset", "ts").select("node_id"), "append").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))


@query("h09_session_stream", "log", """SELECT CAST(make_timestamp(min(ts_ms) * 1000) AS TIMESTAMP) AS begun, node_id, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY node_id ORDER BY ts_ms, "offset") AS session FROM (
  SELECT *, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY node_id ORDER BY ts_ms, "offset") > 7200000, true)::INT AS new FROM log)) GROUP BY node_id, session""")
def _(t):
    return S.drain(S.sessions(_log(t, None)), "complete").withColumn("begun", F.date_trunc("millisecond", "begun").cast("timestamp_ntz"))


@query("f16_rate_limit_stream", "log", 'SELECT peer, request AS "offset", allowed FROM bucket', *RATE_LIMIT, recursive=True)
def _(t):
    return S.drain(S.rate_limit(_log(t, None), 1.0), "append")


@query("v16_bridge_query", "log", """SELECT node_id, max("offset") AS since_offset FROM log WHERE event_type IN ('error', 'signup') AND "offset" <= 5000 GROUP BY node_id HAVING arg_max(event_type, "offset") = 'error'""")
def _(t):
    bridge = Bridge(t.log)
    bridge.advance_to(5000)
    return bridge.snapshot("invalidation_set")


@query("g08_build_events", None, "SELECT 'node_created' AS kind, 'theme' AS node_kind, CAST(r_regionkey AS VARCHAR) AS node_id, concat('{\"r_name\":\"', r_name, '\"}') AS properties FROM region")
def _(t):
    return P.build_events(t.raw("region"), "theme", "r_regionkey")


@query("g08_assertion_events", "triples", "SELECT concat('asr-', subject, '-', predicate, '-', object) AS assertion, kind, target FROM triples, LATERAL (SELECT unnest(['asserted_subject', 'asserted_object']) AS kind, unnest([subject, object]) AS target)")
def _(t):
    return P.assertion_events(t.triples.select("subject", "predicate", "object", F.lit(None).cast("string").alias("source")))


@query("g13_beam_traverse")
def _(t):
    e = t.hierarchy.select("source", "target", F.lit(1.0).alias("cost"))
    regions = t.hierarchy.select(F.col("target").alias("node"), F.substring("target", 1, 1).alias("region")).distinct()
    return P.beam_traverse(e, t.spark.createDataFrame([("r0",), ("r1",), ("r2",)], "node string"), regions)


@query("r23_walk_audit")
def _(t):
    from ...operators.retrieve import search_policy

    def frames(i: int):
        n = F.col("node_id")
        return t.log.where("node_id = 1").select(n.alias("walk"), F.col("offset").alias("frame"), (F.col("value") / 50).alias("confidence"), F.lit(False).alias("fading"), F.lit(3 - i).alias("remaining"), F.lit(i > 1).alias("dwindling"), F.lit(False).alias("stable"))

    audit = P.walk_driver(frames, search_policy, 8)
    return t.spark.createDataFrame([(a["step"], a["directive"]) for a in audit], "step int, directive string")


@query("x18_full_turns", "turns", "SELECT conv_id, sha256(string_agg(concat(role, ': ', text), chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM turns GROUP BY conv_id")
def _(t):
    return P.full_turns(t.turns, "conv_id", "turn").select("conv_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "turns")


@query("m03_handle_context", "log", """SELECT node_id AS handle, string_agg(CAST(k AS VARCHAR), '>' ORDER BY "offset") AS path, count(DISTINCT event_type) AS frames, count(*) AS hops FROM log GROUP BY node_id""")
def _(t):
    return P.accumulate_handles(t.log.select(F.col("node_id").alias("handle"), F.col("offset").alias("i"), F.col("k").alias("node"), F.col("event_type").alias("frame")))


@query("n18_entities", "drawers", r"""SELECT name, count(*) AS n, CAST(sum(coalesce(after IN ('said', 'told', 'asked', 'thinks', 'wants', 'loves', 'hates', 'knows', 'decided', 'laughed'), false)::INT) AS BIGINT) AS person,
  CAST(sum(coalesce(after IN ('building', 'built', 'shipped', 'launched', 'deployed', 'installed', 'uses', 'version'), false)::INT) AS BIGINT) AS project, CASE WHEN person > project THEN 'person' WHEN project > person THEN 'project' ELSE 'uncertain' END AS kind FROM (
  SELECT regexp_extract(w, '^([A-Z][a-z]{2,15})\W*$', 1) AS name, lower(lead(w) OVER (PARTITION BY doc_id ORDER BY i)) AS after FROM (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (
  SELECT doc_id, regexp_split_to_array(text, '[ \t\n\r\f\v]+') AS p FROM drawers))) WHERE name <> '' GROUP BY name HAVING count(*) >= 3""")
def _(t):
    found = P.detect_entities(t.drawers)
    return found.withColumn("person", F.coalesce("person", F.lit(0))).withColumn("project", F.coalesce("project", F.lit(0)))


#: Beginnings that make the synthetic texts exercise the markers.
_LEADS = ("we decided because of a bug. ", "a crash, now fixed; it fails. ", "i like it, never use it. ", "")
_MARKED = "concat(CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEADS)) + " END, text)"
_KINDS = {k: "(" + " + ".join(f"contains(low, '{w}')::INT" for w in ws) + ")" for k, ws in P.MARKERS.items()}
_MOST = f"greatest({', '.join(_KINDS.values())})"
_KIND = f"CASE WHEN {_MOST} = 0 THEN 'none' " + " ".join(f"WHEN {n} = {_MOST} THEN '{k}'" for k, n in _KINDS.items()) + " END"


@query("n19_memories", "drawers", rf"""SELECT doc_id, chunk, CASE WHEN kind = 'problem' AND ({' OR '.join(f"contains(low, '{w}')" for w in P.RESOLVED)}) THEN 'milestone' ELSE kind END AS kind FROM (SELECT doc_id, chunk, low, {_KIND} AS kind FROM (
  SELECT doc_id, unnest(range(len(p))) AS chunk, unnest(list_transform(p, lambda x: lower(x))) AS low FROM (SELECT doc_id, list_filter(regexp_split_to_array({_MARKED}, '\n+'), lambda x: length(trim(x, ' ')) >= 20) AS p FROM drawers)))""")
def _(t):
    lead = F.get(F.array(*[F.lit(x) for x in _LEADS]), (F.col("doc_id") % 4).cast("int"))
    return P.extract_memories(t.drawers.withColumn("text", F.concat(lead, "text")), "doc_id").withColumn("chunk", F.col("chunk").cast("long"))


@query("x25_locale_patterns", "drawers", r"SELECT doc_id, len(regexp_extract_all(text, '\b(the|and)\b')) AS articles, len(regexp_extract_all(text, '\b(of)\b')) AS links FROM drawers")
def _(t):
    patterns = P.locale_patterns(unicode=False, locales={"en": {"articles": ["the"], "links": ["of"]}, "xx": {"articles": ["and", "the"]}})
    return P.match_patterns(t.drawers, "doc_id", patterns)


_KNOWN, _NAMES = ("there", "other", "ring", "small"), ("Thor",)
_FIX = "coalesce(fixed, w)"


@query("x22_spellcheck", None, rf"""WITH known AS (SELECT unnest([{', '.join(f"'{w}'" for w in _KNOWN)}]) AS k), tokens AS (SELECT doc_id, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), ' ') AS p FROM documents)),
  odd AS (SELECT DISTINCT w FROM tokens WHERE length(w) >= 4 AND regexp_full_match(w, '\p{{L}}+') AND w = lower(w) AND w NOT IN ({', '.join(f"'{w}'" for w in (*_KNOWN, 'thor'))})), fixes AS (SELECT w, min(k) AS fixed FROM odd, known WHERE levenshtein(w, k) <= 1 GROUP BY w)
  SELECT doc_id, md5(string_agg({_FIX}, ' ' ORDER BY i)) AS digest, count(fixed) AS fixed FROM tokens LEFT JOIN fixes USING (w) GROUP BY doc_id""")
def _(t):
    fixed = X.spellcheck(t.drawers, "doc_id", list(_KNOWN), list(_NAMES)).select("doc_id", F.split("text", " ").alias("new"), "text")
    old = t.drawers.select("doc_id", F.split(F.coalesce("text", F.lit("")), " ").alias("old"))
    changed = F.size(F.filter(F.arrays_zip("old", "new"), lambda x: x["old"] != x["new"])).cast("long")
    return fixed.join(old, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), changed.alias("fixed"))


@query("x26_embed")
def _(t):
    return t.queries.select("item_id", U.embed(F.col("text")).alias("v")).select("item_id", F.size("v").alias("dims"), F.round(F.get("v", 0), 6).alias("first"))


@query("x27_compress")
def _(t):
    return t.drawers.select("doc_id", U.compress(F.col("text")).alias("line"))


@query("e30_top_affects", "log", """SELECT node_id, string_agg(event_type, ',' ORDER BY n DESC, event_type) AS top FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, event_type) AS r FROM (SELECT node_id, event_type, count(*) AS n FROM log GROUP BY 1, 2)) WHERE r <= 3 GROUP BY node_id""")
def _(t):
    n = t.log.groupBy("node_id", "event_type").agg(F.count(F.lit(1)).cast("double").alias("p"))
    return n.groupBy("node_id").agg(F.collect_list(F.struct(F.col("event_type").alias("label"), "p")).alias("d")).select("node_id", P.top_affects(F.col("d")).alias("top"))


@query("m19_model_registry", "log", """SELECT model_class, arg_max(model, "offset") AS model, count(*) AS live FROM (SELECT k AS model, k % 6 AS model_class, max("offset") AS "offset", arg_max(event_type, "offset") AS last FROM log GROUP BY 1, 2) WHERE last <> 'error' GROUP BY model_class""")
def _(t):
    return P.latest_models(t.log.select(F.col("k").alias("model"), (F.col("k") % 6).alias("model_class"), "offset", (F.col("event_type") == "error").alias("revoked")))


@query("u01_ranked_by_dispatch", "log", f"SELECT node_id, 'neural' AS ranker, round({R_NEURAL}, 6) AS score FROM scored WHERE consumer = 'matching'", HEAT, R_FEATURES, R_STANCE, R_FACTORED)
def _(t):
    rows = features(t).join(F.broadcast(stances(t.spark).where("consumer = 'matching'")))
    return U.rank(rows, "matching", "node_id").select("node_id", "ranker", F.round("score", 6).alias("score"))


@query("u02_feature_registry", "log", "SELECT node_id, heat, CASE WHEN recency BETWEEN 0 AND 1 THEN round(recency, 6) END AS recency FROM features", HEAT, R_FEATURES)
def _(t):
    return U.compute(features(t), "node_id", ["heat", "recency"]).withColumn("recency", F.round("recency", 6))


@query("k30_briefing", "drawers", """SELECT 1 AS layer, used AS place, concat('[', room, '] ', CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END) AS line FROM (SELECT *, CAST(sum(least(length(text), 203)) OVER (ORDER BY importance DESC, doc_id) AS BIGINT) AS used FROM (
  SELECT doc_id, room, text, n_chars % 97 AS importance FROM drawers ORDER BY importance DESC, doc_id LIMIT 15)) WHERE used <= 3200 UNION ALL SELECT 0, 0, 'engine'""")
def _(t):
    return P.briefing(t.drawers.withColumn("importance", F.col("n_chars") % 97), "engine")
