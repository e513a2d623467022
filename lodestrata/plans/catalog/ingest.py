"""Sources, ingest, derived state and context."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import context as M
from ...operators import derived as H
from ...operators import ingest as C
from ...sources.tables import NOW_MS
from ...operators.retrieve import STANCE_FIELDS, STANCES
from ..registry import query

_DAY = 86_400_000


@query("c01_source_adapter", "turns", "SELECT concat('s', conv_id) AS session_id, count(*) AS messages FROM turns WHERE role IN ('user', 'assistant') GROUP BY 1")
def _(t):
    """Transcripts written as JSON lines and read by the source adapter."""
    from ...sources import adapters
    from ..settle import settle, shared_folder

    at = shared_folder(t.spark, "transcripts")
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat(F.lit("u"), "turn").alias("uuid"), F.struct("role", F.col("text").alias("content")).alias("message")))
    t.turns.select(line.alias("value")).write.text(at)
    adapters.use(t.spark)
    rows = t.spark.read.format("transcripts").option("path", at.removeprefix("file://")).option("suffixes", ".jsonl,.txt").load()
    return settle(rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("messages")))


@query("c02_drawer_id", "drawers", "SELECT doc_id, concat(substring(sha256(concat(wing, '/', room)), 1, 24), '_', doc_id % 10) AS drawer FROM drawers")
def _(t):
    return t.drawers.select("doc_id", C.drawer_id(F.concat_ws("/", "wing", "room"), F.col("doc_id") % 10).alias("drawer"))


@query("c03_parse_transcript", "turns", "SELECT concat('s', conv_id) AS session_id, concat('u', turn) AS uuid, role, text AS content FROM turns WHERE role IN ('user', 'assistant')")
def _(t):
    part = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text")), F.struct(F.lit("image").alias("type"), F.lit("x").alias("text"))))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.concat(F.lit("u"), "turn").alias("uuid"), F.lit("2024-01-01").alias("timestamp"), F.struct("role", F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(part).alias("content")).alias("message")))
    return C.parse_transcript(t.turns.select(line.alias("value"))).select("session_id", "uuid", "role", "content")


_SWEEP = """m AS (SELECT CAST(node_id AS VARCHAR) AS session_id, CAST("offset" AS VARCHAR) AS uuid, "offset" AS ts, "offset" % 3 = 0 AND "offset" < 6000 AS held FROM log),
  cur AS (SELECT session_id, max(ts) AS cursor FROM m WHERE held GROUP BY session_id)"""


def _messages(t):
    return t.log.select(F.col("node_id").cast("string").alias("session_id"), F.col("offset").cast("string").alias("uuid"), F.col("offset").alias("ts"))


@query("c04_sweep", "log", "SELECT m.session_id, count(*) FILTER (NOT coalesce(ts < cursor, false) AND NOT held) AS added, count(*) FILTER (NOT coalesce(ts < cursor, false) AND held) AS present, count(*) FILTER (coalesce(ts < cursor, false)) AS skipped FROM m LEFT JOIN cur ON cur.session_id = m.session_id GROUP BY 1", _SWEEP)
def _(t):
    m = _messages(t)
    return C.sweep(m, m.where("ts % 3 = 0 and ts < 6000"))[1]


@query("c05_split_sessions", "log", """SELECT file, session, count(*) AS lines FROM (SELECT file, n, CAST(sum((head AND NOT restored)::INT) OVER (PARTITION BY file ORDER BY n) AS BIGINT) AS session FROM (SELECT node_id % 10 AS file, "offset" AS n, event_type = 'signup' AS head,
  coalesce(bool_or(k < 5) OVER (PARTITION BY node_id % 10 ORDER BY "offset" ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING), false) AS restored FROM log)) GROUP BY 1, 2""")
def _(t):
    text = F.when(F.col("event_type") == "signup", "Session begins").when(F.col("k") < 5, "x").otherwise("line")
    marked = F.when(F.col("k") < 5, F.concat(text, F.lit(" Ctrl+E to show"))).otherwise(text)
    lines = t.log.select((F.col("node_id") % 10).alias("file"), F.col("offset").alias("n"), marked.alias("text"))
    return C.split_sessions(lines, "file", "n", "text").groupBy("file", "session").agg(F.count(F.lit(1)).alias("lines"))


@query("c06_diary_entries", "turns", "SELECT conv_id, count(*) AS entries FROM turns GROUP BY conv_id")
def _(t):
    d = t.turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: F.concat(F.lit("## "), x["turn"].cast("string"), F.lit("\n"), x["text"])), "\n").alias("text"))
    return d.select("conv_id", F.size(C.split_entries(F.col("text"))).cast("long").alias("entries"))


@query("c07_normalize_chat", "turns", "SELECT conv_id AS file, count(*) AS messages, sum(length(text))::BIGINT AS chars FROM turns GROUP BY conv_id")
def _(t):
    as_list = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))))
    docs = t.turns.groupBy(F.col("conv_id").alias("file")).agg(as_list.alias("value")).withColumn("kind", F.lit("messages"))
    return C.normalize_chat(docs).groupBy("file").agg(F.count(F.lit(1)).alias("messages"), F.sum(F.length("text")).alias("chars"))


@query("c08_exchanges", "turns", "SELECT conv_id, exchange, count(*) AS lines FROM (SELECT conv_id, CAST(sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS exchange FROM turns) GROUP BY 1, 2")
def _(t):
    lines = t.turns.select("conv_id", "turn", F.concat(F.when(F.col("role") == "user", "> ").otherwise(""), F.col("text")).alias("text"))
    return C.exchanges(lines, "conv_id", "turn", "text").select("conv_id", "exchange", "lines")


@query("c09_chunks", "drawers", "SELECT doc_id, i AS chunk, length(substring(text, i * 800 + 1, 800)) AS chars FROM drawers, LATERAL (SELECT unnest(range(greatest(1, CAST(ceil(length(text) / 800) AS BIGINT)))) AS i)")
def _(t):
    return C.chunks(t.drawers, "doc_id").select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.length("text").alias("chars"))


@query("c10_closet_lines", "drawers", r"""SELECT wing, concat(topics, '||→', ids) AS line FROM (SELECT wing, string_agg(w, ';' ORDER BY r) AS topics FROM (SELECT wing, w, row_number() OVER (PARTITION BY wing ORDER BY n DESC, encode(w)) AS r FROM (
  SELECT wing, w, count(*) AS n FROM (SELECT wing, unnest(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+')) AS w FROM drawers) WHERE length(w) >= 6 GROUP BY 1, 2)) WHERE r <= 12 GROUP BY wing)
  JOIN (SELECT wing, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids FROM (SELECT wing, doc_id, row_number() OVER (PARTITION BY wing ORDER BY doc_id) AS r FROM drawers) WHERE r <= 3 GROUP BY wing) USING (wing)""")
def _(t):
    return C.closet_lines(t.drawers, "wing", "doc_id")


@query("c11_capture", "drawers", r"""SELECT doc_id, h AS content_hash, doc_id <> min(doc_id) OVER (PARTITION BY h) AS collides, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words
  FROM (SELECT doc_id, text, sha256(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))) AS h FROM drawers)""")
def _(t):
    return C.capture(t.drawers, "doc_id")


@query("c12_amend", "log", 'SELECT node_id, arg_max(value, "offset") AS value, count(*) AS versions FROM log WHERE event_type = \'purchase\' GROUP BY node_id')
def _(t):
    return C.amend(t.log.where("event_type = 'purchase'"), "node_id", "value")


@query("c13_encryption_round_trip", "drawers", "SELECT doc_id, sha256(text) AS digest FROM drawers WHERE doc_id % 2 = 0 OR doc_id % 2 = 1")
def _(t):
    secret = F.lit("0000111122223333")
    back = C.decrypt(C.encrypt(F.col("text"), secret), secret)
    return t.drawers.select("doc_id", F.sha2(back.cast("binary"), 256).alias("digest"))


_OBS = "obs AS (SELECT k AS key, ts_ms AS ts, value >= 3 AS matched FROM log)"


def _observations(t):
    return t.log.select(F.col("k").alias("key"), F.col("ts_ms").alias("ts"), (F.col("value") >= 3).alias("matched"))


@query("h01_cache_trace", "log", "SELECT k, count(*) AS reads, count(*) FILTER (warm) AS hits FROM (SELECT k, coalesce(ts_ms - lag(ts_ms) OVER (PARTITION BY k ORDER BY ts_ms) <= 3600000, false) AS warm FROM log) GROUP BY k")
def _(t):
    r = H.cache_trace(t.log.select(F.col("k").alias("key"), F.col("ts_ms").alias("ts")), 3_600_000)
    return r.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("reads"), F.sum(F.col("warm").cast("long")).alias("hits"))


@query("h02_promotable", "log", f"""SELECT key, ts, matched, matches, divergences, matches >= 10 AND divergences = 0 AS promote FROM (SELECT *, count(*) FILTER (matched) OVER w AS matches, count(*) FILTER (NOT matched) OVER w AS divergences
  FROM obs WINDOW w AS (PARTITION BY key ORDER BY ts RANGE BETWEEN {7 * _DAY} PRECEDING AND CURRENT ROW))""", _OBS)
def _(t):
    return H.promotable(_observations(t))


@query("h02_projection")
def _(t):
    return H.projection(_observations(t))


@query("h03_coherence", "hierarchy", "SELECT a, b, CAST(CASE WHEN a = b THEN 1.0 WHEN x.source = y.source THEN 0.7 ELSE 0.2 END AS DOUBLE) AS coherence FROM (SELECT concat('c', c_custkey) AS a, concat('c', c_custkey % 40) AS b FROM customer) JOIN hierarchy x ON x.target = a JOIN hierarchy y ON y.target = b")
def _(t):
    pairs = t.raw("customer").select(F.concat(F.lit("c"), "c_custkey").alias("a"), F.concat(F.lit("c"), F.col("c_custkey") % 40).alias("b"))
    return H.coherence(pairs, t.hierarchy.select(F.col("target").alias("child"), F.col("source").alias("parent")))


@query("h03_attribution", "log", "SELECT k AS drawer, count(DISTINCT node_id) AS artifacts, min(node_id) AS first FROM log GROUP BY k")
def _(t):
    return H.attribution(t.log.groupBy(F.col("node_id").alias("artifact")).agg(F.collect_set("k").alias("drawers")))


@query("h05_stale", "log", """SELECT artifact, coalesce(bool_or(name IS NULL OR current IS NULL OR current > version), true) AS stale FROM (SELECT a.node_id AS artifact, d.k AS name, d.version FROM (SELECT DISTINCT node_id FROM log) a
  LEFT JOIN (SELECT node_id, k, max("offset") AS version FROM log WHERE event_type = 'purchase' AND k < 12 GROUP BY 1, 2) d ON d.node_id = a.node_id) LEFT JOIN (SELECT k, max("offset") - 3000 AS current FROM log WHERE k <> 11 GROUP BY k) v ON v.k = name GROUP BY artifact""")
def _(t):
    bought = t.log.where("event_type = 'purchase' and k < 12").groupBy("node_id", "k").agg(F.max("offset").alias("version"))
    deps = bought.groupBy("node_id").agg(F.collect_list(F.struct(F.col("k").alias("name"), "version")).alias("deps"))
    stamps = t.log.select("node_id").distinct().join(deps, "node_id", "left").withColumnRenamed("node_id", "artifact")
    return H.stale(stamps, t.log.where("k <> 11").groupBy(F.col("k").alias("name")).agg((F.max("offset") - 3000).alias("current")))


@query("h06_schedule", "log", 'SELECT "offset" AS job, node_id % 8 AS queue, row_number() OVER (PARTITION BY node_id % 8 ORDER BY k % 12, ts_ms, "offset") AS place FROM log')
def _(t):
    j = t.log.select(F.col("offset").alias("job"), (F.col("node_id") % 8).alias("queue"), (F.col("k") % 12).alias("priority"), F.col("ts_ms").alias("scheduled"))
    return H.schedule(j).select("job", "queue", "place")


@query("h07_job_status", "log", 'SELECT node_id AS job, arg_max(event_type, "offset") AS status, min(ts_ms) AS started, max(ts_ms) - min(ts_ms) AS duration, count(*) AS events FROM log GROUP BY node_id')
def _(t):
    return H.job_status(t.log.select(F.col("node_id").alias("job"), F.col("event_type").alias("status"), "offset", F.col("ts_ms").alias("ts")))


@query("h08_lagging", "log", 'SELECT k AS consumer, greatest(0, (SELECT max("offset") FROM log) - max("offset")) AS lag, greatest(0, (SELECT max("offset") FROM log) - max("offset")) > 100 AS backpressured FROM log GROUP BY k')
def _(t):
    return H.lagging(t.log.groupBy(F.col("k").alias("consumer")).agg(F.max("offset").alias("offset")), t.log.agg(F.max("offset").alias("head")), 100)


@query("h09_heartbeats", "log", f"""SELECT device, max(gap) AS longest, CASE WHEN max(gap) >= 48 * 3600000 THEN 'locked_out' WHEN arg_max(gap, ts) >= 24 * 3600000 THEN 'read_only' ELSE 'online' END AS state FROM (
  SELECT node_id AS device, ts_ms AS ts, coalesce(lead(ts_ms) OVER (PARTITION BY node_id ORDER BY ts_ms), {NOW_MS}) - ts_ms AS gap FROM log) GROUP BY device""")
def _(t):
    return H.heartbeat_state(t.log.select(F.col("node_id").alias("device"), F.col("ts_ms").alias("ts")), NOW_MS, 24, 48)


@query("h09_sessions", "log", """SELECT node_id, session, min(ts_ms) AS begun, max(ts_ms) AS ended, count(*) AS events FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY node_id ORDER BY ts_ms) AS BIGINT) AS session FROM (
  SELECT node_id, ts_ms, CASE WHEN ts_ms - lag(ts_ms) OVER (PARTITION BY node_id ORDER BY ts_ms) <= 7200000 THEN 0 ELSE 1 END AS new FROM log)) GROUP BY 1, 2""")
def _(t):
    return H.sessions(t.log.select("node_id", "ts_ms"), "node_id", "ts_ms", 7_200_000)


@query("h10_failure_runs", "log", """SELECT device, max(n) AS longest, max(n) >= 3 AS tripped FROM (SELECT device, island, count(*) AS n FROM (SELECT node_id AS device, failed, sum((NOT failed)::INT) OVER (PARTITION BY node_id ORDER BY "offset") AS island
  FROM (SELECT node_id, "offset", event_type IN ('error', 'click') AS failed FROM log)) WHERE failed GROUP BY 1, 2) GROUP BY device""")
def _(t):
    return H.failure_runs(t.log.select(F.col("node_id").alias("device"), "offset", F.col("event_type").isin("error", "click").alias("failed")))


@query("h13_save_points", "turns", "SELECT conv_id, count(*) FILTER (role = 'user') AS messages, count(*) FILTER (role = 'user') // 2 AS saves FROM turns GROUP BY conv_id")
def _(t):
    return H.save_points(t.turns, "conv_id", 2)


@query("m02_rate_weights", "log", "SELECT node_id, rate, round(sum(w * x), 6) AS score FROM (SELECT node_id, avg(value) / 50 AS recency, count(*) / 100 AS heat, count(DISTINCT k) / 90 AS canonicality FROM log GROUP BY node_id), (VALUES (1, 1.5, 1.3, 0.7), (2, 1.0, 1.0, 1.0), (3, 0.7, 0.8, 1.5)) r(rate, a, b, c), LATERAL (SELECT unnest([a, b, c]) AS w, unnest([recency, heat, canonicality]) AS x) GROUP BY 1, 2")
def _(t):
    f = t.log.groupBy("node_id").agg((F.avg("value") / 50).alias("recency"), (F.count(F.lit(1)) / 100).alias("heat"), (F.count_distinct("k") / 90).alias("canonicality"))
    return M.weighted_by_rate(f, "node_id", ["recency", "heat", "canonicality"])


@query("m01_stances", None, "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(f'{x}::DOUBLE' for x in v)})" for k, v in STANCES.items()) + f") v(consumer, {', '.join(STANCE_FIELDS)})")
def _(t):
    from ...operators.retrieve import stances

    return stances(t.spark)


@query("m04_identifiers", "log", """SELECT "offset", regexp_full_match(id, '[a-z]{2,6}_[0-9a-z]{1,12}_[0-9a-z]{8}') AS valid, string_split(id, '_')[1] AS prefix FROM (SELECT "offset", concat(CASE WHEN k % 3 = 0 THEN 'drw' WHEN k % 3 = 1 THEN 'x' ELSE 'node' END, '_', lower(to_base(ts_ms, 36)), '_', substring(sha256(CAST("offset" AS VARCHAR)), 1, 8)) AS id FROM log)""")
def _(t):
    prefix = F.when(F.col("k") % 3 == 0, "drw").when(F.col("k") % 3 == 1, "x").otherwise("node")
    i = M.make_id(prefix, F.col("ts_ms"), F.col("offset").cast("string"))
    return t.log.select("offset", M.valid_id(i).alias("valid"), M.id_prefix(i).alias("prefix"))


_TOKENS = """tokens AS (SELECT node_id AS drawer, "offset" AS i, ts_ms AS onset, value AS pitch FROM log WHERE event_type <> 'signup'), spans AS (SELECT node_id AS drawer, "offset" AS ordinal, ts_ms AS begun, ts_ms + 36000000 AS ended, k AS label FROM log WHERE event_type = 'signup')"""


def _tokens(t):
    tokens = t.log.where("event_type <> 'signup'").select(F.col("node_id").alias("drawer"), F.col("offset").alias("i"), F.col("ts_ms").alias("onset"), F.col("value").alias("pitch"))
    spans = t.log.where("event_type = 'signup'").select(F.col("node_id").alias("drawer"), F.col("offset").alias("ordinal"), F.col("ts_ms").alias("begun"), (F.col("ts_ms") + 36_000_000).alias("ended"), F.col("k").alias("label"))
    return tokens, spans


@query("m05_override_join", "log", "SELECT t.drawer, i, coalesce(arg_max(label, ordinal), -1) AS label FROM tokens t LEFT JOIN spans s ON s.drawer = t.drawer AND onset >= begun AND onset < ended GROUP BY 1, 2", _TOKENS)
def _(t):
    return M.overrides(*_tokens(t)).select("drawer", "i", F.coalesce("label", F.lit(-1)).alias("label"))


@query("m06_speakers", "log", "SELECT drawer, count(DISTINCT coalesce(CAST(label AS VARCHAR), 's0')) AS speakers, count(*) AS tokens FROM (SELECT t.drawer, i, arg_max(label, ordinal) AS label FROM tokens t LEFT JOIN spans s ON s.drawer = t.drawer AND onset >= begun AND onset < ended GROUP BY 1, 2) GROUP BY drawer", _TOKENS)
def _(t):
    return M.speakers(M.overrides(*_tokens(t)))


@query("m07_dominant_speaker", "log", "SELECT drawer, arg_min(k, row(-n, k)) AS speaker FROM (SELECT node_id AS drawer, k % 6 AS k, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY drawer")
def _(t):
    return M.dominant(t.log.select(F.col("node_id").alias("drawer"), (F.col("k") % 6).alias("speaker")), "drawer", "speaker")


@query("m08_paralinguistic", "log", "SELECT node_id, count(*) AS events FROM log WHERE event_type IN ('view', 'click') GROUP BY node_id")
def _(t):
    return M.recognised(t.log, "event_type", ("view", "click")).groupBy("node_id").agg(F.count(F.lit(1)).alias("events"))


@query("m12_pending_candidates", "log", "SELECT cluster, members, passes FROM (SELECT k AS cluster, count(*) AS members, count(DISTINCT node_id % 3) AS passes FROM log WHERE event_type = 'view' GROUP BY k) ORDER BY members DESC, cluster LIMIT 20")
def _(t):
    c = t.log.where("event_type = 'view'").groupBy(F.col("k").alias("cluster")).agg(F.count(F.lit(1)).alias("members"), F.count_distinct(F.col("node_id") % 3).alias("passes"))
    return c.orderBy(F.desc("members"), "cluster").limit(20)


@query("m13_findings", "log", "SELECT \"offset\", node_id, k FROM log WHERE event_type = 'click' AND k % 4 = 1 ORDER BY \"offset\" LIMIT 100")
def _(t):
    return t.log.where("event_type = 'click' and k % 4 = 1").select("offset", "node_id", "k").orderBy("offset").limit(100)


@query("m14_signature_hash", "log", """SELECT period, sha256(string_agg(concat(k, ':', n), ',' ORDER BY k)) AS hash FROM (SELECT node_id % 6 AS period, k, count(*) AS n FROM log GROUP BY 1, 2) GROUP BY period""")
def _(t):
    c = t.log.groupBy((F.col("node_id") % 6).alias("period"), "k").agg(F.count(F.lit(1)).alias("n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda x: F.concat_ws(":", x["k"].cast("string"), x["n"].cast("string")))
    return c.groupBy("period").agg(F.sha2(F.array_join(parts, ",").cast("binary"), 256).alias("hash"))


@query("m15_velocity_tool", "log", "SELECT a.node_id, round(coalesce(CASE WHEN isnan(corr(a.n, b.n)) THEN 0 ELSE corr(a.n, b.n) END, 0), 6) AS coupling FROM v a JOIN v b ON a.day = b.day AND b.node_id = a.node_id + 1 GROUP BY a.node_id",
    "v AS (SELECT node_id, ts_ms // 86400000 AS day, CAST(count(*) AS DOUBLE) AS n FROM log GROUP BY 1, 2)")
def _(t):
    v = t.log.groupBy("node_id", F.floor(F.col("ts_ms") / _DAY).alias("day")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return M.velocity_coupling(v)
