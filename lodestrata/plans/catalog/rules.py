"""Formula evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import rules as E
from ...operators.fold import latest_wins
from ..registry import query

_EVIDENCE = """evidence AS (SELECT "offset", node_id, k, CAST(k * 101 AS INT) AS bps, CAST(5000 + node_id % 40 * 100 AS INT) AS min_bps, k / 100 AS ratio, (node_id % 10) / 10 AS min_ratio,
  [k * 101, (k * 37) % 100 * 100, (k * 53) % 100 * 100] AS tags, [2000, 1000 + node_id % 30 * 100, 1500] AS needs, k % 4 AS domain_count, k % 12 AS domain_total, k % 5 AS matches, node_id % 3 AS min_count,
  value / 60 AS score, (node_id % 9) / 10 AS min_value, 0.8 AS max_value, k % 3 = 0 AS flag, k % 5 = 0 AS flag2, CASE WHEN k % 11 > 0 THEN value / 60 END AS measured, [k % 3, k % 4, k % 5, k % 6] AS witnesses,
  node_id % 4 AS need_sessions, k % 6 AS sessions, k % 3 AS devices, node_id % 2 AS need_devices, k % 4 AS trend_window, CASE WHEN k % 2 = 0 THEN 'up' ELSE 'Down' END AS direction FROM log)"""


def evidence(t):
    n, k, v = F.col("node_id"), F.col("k"), F.col("value")
    return t.log.select(
        "offset", "node_id", "k", (k * 101).cast("int").alias("bps"), (5000 + n % 40 * 100).cast("int").alias("min_bps"), (k / 100).alias("ratio"), (n % 10 / 10).alias("min_ratio"),
        F.array(k * 101, (k * 37) % 100 * 100, (k * 53) % 100 * 100).alias("tags"), F.array(F.lit(2000), 1000 + n % 30 * 100, F.lit(1500)).alias("needs"),
        (k % 4).alias("domain_count"), (k % 12).alias("domain_total"), (k * 101).cast("int").alias("domain_bps"), (k % 5).alias("matches"), (n % 3).alias("min_count"),
        (v / 60).alias("visual"), (v / 60).alias("scene"), (v / 60).alias("trait"), (n % 9 / 10).alias("min_value"), F.lit(0.8).alias("max_value"),
        (k % 3 == 0).alias("object"), (k % 3 == 0).alias("document"), (k % 5 == 0).alias("location"), F.when(k % 11 > 0, v / 60).alias("environmental"),
        F.when(k % 11 > 0, v / 60).alias("axis_drift"), F.when(k % 11 > 0, v / 60).alias("contradiction_rate"), F.when(k % 11 > 0, v / 60 * 4 - 2).alias("velocity_sd"), (n % 9 / 10).alias("min_rate"),
        F.array(k % 3, k % 4, k % 5, k % 6).alias("witnesses"), (k % 5).alias("texts"), F.when(k % 3 == 0, "public_llm_only").alias("pipeline"),
        (k % 6).alias("sessions"), (k % 3).alias("devices"), (n % 4).alias("min_sessions"), (n % 2).alias("min_devices"), (k % 4).alias("trend_window"), F.when(k % 2 == 0, "up").otherwise("Down").alias("direction"),
    )


def _sql(yes: str, bps: str, no: str | None = None) -> str:
    """SQL of (outcome, bps) before the confidence floor."""
    b = f"CAST(trunc(CASE WHEN yes THEN {bps} ELSE {no or bps} END) AS INT)"
    return f'SELECT "offset", CASE WHEN yes IS NULL THEN -1 WHEN yes THEN 0 ELSE 1 END AS outcome, CASE WHEN yes IS NULL THEN 0 ELSE {b} END AS bps FROM (SELECT *, {yes} AS yes FROM evidence)'


_RAW = {
    "tag_threshold": _sql("bps >= min_bps", "bps"),
    "tag_ratio": _sql("ratio >= min_ratio", "ratio * 10000"),
    "multi_tag_and": _sql("tags[1] >= needs[1] AND tags[2] >= needs[2] AND tags[3] >= needs[3]", "least(10000, tags[1], tags[2], tags[3])", "CASE WHEN tags[1] < needs[1] THEN tags[1] WHEN tags[2] < needs[2] THEN tags[2] ELSE tags[3] END"),
    "multi_tag_or": _sql("tags[1] >= needs[1] OR tags[2] >= needs[2] OR tags[3] >= needs[3]", "CASE WHEN tags[1] >= needs[1] THEN tags[1] WHEN tags[2] >= needs[2] THEN tags[2] ELSE tags[3] END", "greatest(0, tags[1], tags[2], tags[3])"),
    "domain_threshold": _sql("bps >= min_bps", "bps"),
    "domain_ratio": _sql("CASE WHEN domain_total > 0 THEN domain_count / domain_total >= min_ratio END", "domain_count / domain_total * 10000"),
    "text_contains": _sql("matches >= greatest(1, min_count)", "9000", "0"),
    "visual_threshold": _sql("score >= min_value", "score * 10000"),
    "object_present": _sql("flag", "9500", "500"),
    "scene_match": _sql("score >= min_value", "score * 10000"),
    "document_present": _sql("flag", "9500", "500"),
    "location_confirmed": _sql("flag2", "9500", "500"),
    "environmental_range": _sql("measured >= min_value AND measured <= max_value", "9000", "1000"),
    "witness_threshold": _sql("len(list_filter(witnesses, lambda w: w >= min_count)) >= greatest(1, min_count)", "9000", "0"),
    "trait_score": _sql("score >= min_value", "score * 10000"),
    "modality_consistency": _sql("(score >= 0.5)::INT + (matches > 0)::INT + flag::INT + flag2::INT >= 2", "8500", "1500"),
    "pipeline_match": _sql("CASE WHEN flag THEN true END", "9000"),
    "conversation": _sql("sessions >= need_sessions AND devices >= need_devices", "8000", "0"),
    "trend": _sql("CASE WHEN trend_window > 0 THEN CASE WHEN direction = 'up' THEN bps >= min_bps ELSE bps <= min_bps END END", "bps"),
    "baseline_velocity_sd": _sql("abs(measured * 4 - 2) >= min_value", "9000", "1000"),
    "baseline_drift_axis": _sql("measured >= min_value", "least(1.0, measured) * 10000"),
    "baseline_contradiction_rate": _sql("measured >= min_value", "measured * 10000"),
}

for _i, _kind in enumerate(E.EVALUATORS, 2):
    query(f"e{_i:02d}_{_kind}", "log", _RAW[_kind], _EVIDENCE)(lambda t, kind=_kind: evidence(t).withColumn("r", E.raw(kind)).select("offset", "r.outcome", "r.bps"))

_CHOSEN = list(E.EVALUATORS)[::3]


@query("e01_evaluate_formula", "log", " UNION ALL ".join(
    f"""SELECT "offset", '{k}' AS formula_type, CASE WHEN ratio > 0.9 OR (outcome <> -1 AND bps < 7000) THEN -1 ELSE outcome END AS outcome, CASE WHEN ratio > 0.9 THEN 0 ELSE bps END AS bps FROM ({_RAW[k]}) JOIN (SELECT "offset", ratio, k FROM evidence) USING ("offset") WHERE k % {len(_CHOSEN)} = {i}"""
    for i, k in enumerate(_CHOSEN)), _EVIDENCE)
def _(t):
    kind = F.get(F.array(*[F.lit(k) for k in _CHOSEN]), (F.col("k") % len(_CHOSEN)).cast("int"))
    return E.evaluate(evidence(t).withColumn("formula_type", kind), F.col("ratio") > 0.9).select("offset", "formula_type", "outcome", "bps")


_QUESTION = "concat(['Is free will real? ', 'What is the most beautiful ', 'My plan ', 'Who won '][1 + (conv_id + turn) % 4], text)"


def _any(words):
    return " OR ".join("contains(q, '" + w.replace("'", "''") + "')" for w in words)


@query("e24_resolvability", "turns", f"""SELECT conv_id, turn, CASE WHEN {_any(E.NOT_RESOLVABLE)} THEN 'not_resolvable' WHEN {_any(E.JURY)} THEN 'jury_only' WHEN {_any(E.PRIVATE)} THEN 'privacy_preserving_required' ELSE 'public_llm_resolvable' END AS kind,
  CAST(CASE WHEN {_any(E.NOT_RESOLVABLE)} THEN 0.7 WHEN {_any(E.JURY)} THEN 0.6 WHEN {_any(E.PRIVATE)} THEN 0.7 ELSE 0.6 END AS DOUBLE) AS confidence FROM (SELECT conv_id, turn, lower({_QUESTION}) AS q FROM turns)""")
def _(t):
    lead = F.get(F.array(*[F.lit(x) for x in ("Is free will real? ", "What is the most beautiful ", "My plan ", "Who won ")]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    return t.turns.select("conv_id", "turn", E.resolvability(F.concat(lead, F.col("text"))).alias("r")).select("conv_id", "turn", "r.kind", "r.confidence")


@query("e25_resolution_round_trip", "log", """SELECT "offset", sha256(concat('m', node_id)) AS market_hash, k % 3 - 1 AS outcome, CAST(k * 101 AS INT) AS bps, ts_ms AS at_ms FROM log""")
def _(t):
    encoded = E.encode_resolution(F.concat(F.lit("m"), "node_id"), F.col("k") % 3 - 1, (F.col("k") * 101).cast("long"), F.col("ts_ms"))
    d = t.log.select("offset", E.decode_resolution(encoded).alias("d"))
    return d.select("offset", "d.market_hash", F.col("d.outcome").cast("long").alias("outcome"), "d.bps", "d.at_ms")


@query("e26_market_state", "log", """SELECT market, arg_max(event_type, "offset") AS status, max("offset") AS "offset", count(*) AS transitions FROM (SELECT k AS market, event_type, "offset" FROM log) GROUP BY market HAVING arg_max(event_type, "offset") IN ('view', 'error')""")
def _(t):
    m = t.log.select(F.col("k").alias("market"), F.col("event_type").alias("status"), "offset")
    n = m.groupBy("market").agg(F.count(F.lit(1)).alias("transitions"))
    return latest_wins(m, ["market"]).where(F.col("status").isin("view", "error")).join(n, "market")


@query("e27_pipeline_steps", "log", """SELECT "offset", i - 1 AS place, trim(s[i]) AS step FROM (SELECT "offset", string_split(CASE k % 2 WHEN 0 THEN 'web_search > llm_resolve' ELSE 'slice,match > resolve' END, '>') AS p FROM log), LATERAL (SELECT string_split(replace(array_to_string(p, '>'), ',', '>'), '>') AS s), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i)""")
def _(t):
    spec = F.when(F.col("k") % 2 == 0, "web_search > llm_resolve").otherwise("slice,match > resolve")
    return t.log.select("offset", F.posexplode(E.parse_pipeline(spec)).alias("place", "step")).withColumn("place", F.col("place").cast("long"))
