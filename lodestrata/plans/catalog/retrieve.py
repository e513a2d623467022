"""Features, rankers and retrieval policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import retrieve as R
from ...operators import views as V
from ...sources.tables import NOW_MS
from ..registry import query
from .views import HEAT

_N = f"{NOW_MS}.0"
_FEATURES = f"""features AS (SELECT h.node_id, heat, canonical, importance, pow(0.5, ({_N} - last_ms) / (30 * 86400000.0)) AS recency,
  heat * pow(0.5, ({_N} - bumped) / (15 * 86400000.0)) * 30 AS velocity, CASE WHEN canonical THEN 1.0 ELSE greatest(0, least(0.99, 0.6 * heat + 0.4 * importance)) END AS canonicality,
  0.5 * least(1.0, kinds / 5) + 0.5 * least(1.0, tensions / 3) AS fork, CASE WHEN sources = 0 THEN 0.3 * 0.5 ELSE 1 - pow(0.6, sources) END AS faithfulness
  FROM heat h JOIN (SELECT node_id, max(ts_ms) AS last_ms, max(ts_ms) FILTER (kind = 'node_accessed') AS bumped, avg(value) / 100 AS importance, count(DISTINCT event_type) AS kinds,
    count(*) FILTER (event_type = 'error' AND k < 5) AS tensions, count(*) FILTER (event_type = 'purchase' AND k < 10) AS sources FROM log GROUP BY node_id) s ON h.node_id = s.node_id)"""


def features(t):
    stats = t.log.groupBy("node_id").agg(
        F.max("ts_ms").alias("last_ms"), F.max(F.when(F.col("kind") == "node_accessed", F.col("ts_ms"))).alias("bumped"), (F.avg("value") / 100).alias("importance"), F.count_distinct("event_type").alias("kinds"),
        F.sum(((F.col("event_type") == "error") & (F.col("k") < 5)).cast("long")).alias("tensions"), F.sum(((F.col("event_type") == "purchase") & (F.col("k") < 10)).cast("long")).alias("sources"),
    )
    h = V.heat_field(t.log, NOW_MS).select("node_id", "heat", "canonical")
    return h.join(stats, "node_id").select(
        "node_id", "heat", "canonical", "importance", R.recency(F.col("last_ms"), NOW_MS).alias("recency"), R.velocity_30d(F.col("heat"), F.col("bumped"), NOW_MS).alias("velocity"),
        R.canonicality(F.col("canonical"), F.col("heat"), F.col("importance")).alias("canonicality"), R.fork_significance(F.col("kinds"), F.col("tensions")).alias("fork"),
        R.faithfulness(F.col("sources"), F.lit(None).cast("double")).alias("faithfulness"),
    )


for _name, _column in (("r02_recency", "recency"), ("r03_heat", "heat"), ("r04_velocity_30d", "velocity"), ("r05_canonicality", "canonicality"), ("r06_fork_significance", "fork"), ("r07_faithfulness", "faithfulness")):
    query(_name, "log", f"SELECT node_id, round({_column}, 6) AS value FROM features", HEAT, _FEATURES)(lambda t, c=_column: features(t).select("node_id", F.round(c, 6).alias("value")))


@query("r01_gather", "log", """SELECT f.node_id, round(heat, 6) AS heat, round(canonicality, 6) AS canonicality, out_degree FROM features f LEFT JOIN (SELECT node_id, count(*) AS out_degree FROM log
  WHERE event_type = 'purchase' GROUP BY node_id) e ON e.node_id = f.node_id WHERE f.node_id IN (SELECT node_id FROM log WHERE event_type = 'signup') ORDER BY f.node_id LIMIT 1000""", HEAT, _FEATURES)
def _(t):
    scope = t.log.where("event_type = 'signup'").select("node_id").distinct()
    edges = t.log.where("event_type = 'purchase'").groupBy("node_id").agg(F.count(F.lit(1)).alias("out_degree"))
    f = features(t).join(scope, "node_id", "left_semi").join(edges, "node_id", "left")
    return f.select("node_id", F.round("heat", 6).alias("heat"), F.round("canonicality", 6).alias("canonicality"), "out_degree").orderBy("node_id").limit(1000)


_STANCE = "stances AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {', '.join(map(str, v))})" for k, v in R.STANCES.items()) + f") s(consumer, {', '.join(R.STANCE_FIELDS)}))"


@query("r09_stance_alignment", "log", """SELECT node_id, consumer, round(greatest(0, least(1, 0.5 * (cvc * canonicality + (1 - cvc) * heat) + 0.3 * recency * recency_bias + 0.2 * greatest(canonicality, floor))), 6) AS alignment
  FROM features, stances""", HEAT, _FEATURES, _STANCE)
def _(t):
    both = features(t).join(F.broadcast(R.stances(t.spark)))
    return both.select("node_id", "consumer", F.round(R.stance_alignment(F.col("canonicality"), F.col("heat"), F.col("recency")), 6).alias("alignment"))


@query("r11_feature_store", "log", """SELECT node_id AS subject, arg_max(value, "offset") FILTER (field = 'canonical') AS canonical, arg_max(value, "offset") FILTER (field = 'importance') AS importance,
  arg_max(value, "offset") FILTER (field = 'canon_path') AS canon_path FROM log WHERE kind = 'node_property_set' GROUP BY node_id""")
def _(t):
    return R.latest_features(t.log.where("kind = 'node_property_set'").select(F.col("field").alias("feature"), F.col("node_id").alias("subject"), "offset", "value"))


@query("r12_compute_many", "log", "SELECT node_id, round(recency, 6) AS recency, round(heat, 6) AS heat, round(velocity, 6) AS velocity, round(canonicality, 6) AS canonicality, round(fork, 6) AS fork, round(faithfulness, 6) AS faithfulness FROM features", HEAT, _FEATURES)
def _(t):
    return features(t).select("node_id", *[F.round(c, 6).alias(c) for c in ("recency", "heat", "velocity", "canonicality", "fork", "faithfulness")])


_FACTORED = """scored AS (SELECT *, exp((ln(greatest(0.05, greatest(0.05, pow(recency, recency_bias)))) + ln(greatest(0.05, greatest(0.05, heat) * (1 - cvc) + cvc))
  + ln(greatest(0.05, greatest(0.05, greatest(canonicality, floor)) * cvc + 1 - cvc)) + ln(greatest(0.05, sqrt(least(1.0, velocity / 30)))) + ln(greatest(0.05, faithfulness))
  + ln(least(2.0, 1 + greatest(0.05, sqrt(fork))))) / 6) AS base FROM features, stances)"""


def _scored(t):
    return features(t).join(F.broadcast(R.stances(t.spark))).withColumn("base", R.factored_score())


@query("r13_factored_ranker", "log", "SELECT node_id, consumer, round(base, 6) AS score FROM scored", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    return _scored(t).select("node_id", "consumer", F.round("base", 6).alias("score"))


@query("r13_exploration", "log", f"""SELECT node_id, consumer, round(greatest(0, least(1, base + (('0x' || substr(sha256(concat(node_id, ':', consumer, ':', CAST(round(round(base, 6) * 1000000) AS BIGINT))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551615::DOUBLE * 2 - 1) * entropy * {R.NOISE})), 6) AS score FROM scored""", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    # millionths, since engines write decimals differently
    seed = F.concat_ws(":", "node_id", "consumer", F.round(F.round("base", 6) * 1_000_000).cast("long"))
    noisy = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("base") + R.exploration_noise(seed, F.col("entropy"))))
    return _scored(t).select("node_id", "consumer", F.round(noisy, 6).alias("score"))


_NEURAL = "1 / (1 + exp(1 - base - 0.3 * (0.3 * heat * velocity + 0.5 * canonicality * faithfulness + 0.4 * recency * fork + 0.25 * heat * fork)))"


@query("r14_neural_ranker", "log", f"SELECT node_id, consumer, round({_NEURAL}, 6) AS score FROM scored", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    return _scored(t).select("node_id", "consumer", F.round(R.neural_score(F.col("base")), 6).alias("score"))


@query("r16_normalize_scores", "log", "SELECT node_id, consumer, round(base / max(base) OVER (PARTITION BY consumer), 6) AS score FROM scored", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    return _scored(t).select("node_id", "consumer", F.round(R.normalize("base", ["consumer"]), 6).alias("score"))


@query("r17_behaviour", "log", "SELECT consumer, max(abs(base)) = 0 AS all_zero, count(DISTINCT round(base, 6)) = 1 AS identical, bool_or(base < 0 OR base > 1) AS out_of_range, count(*) AS n, round(avg(base), 6) AS mean FROM scored GROUP BY consumer", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    return R.behaviour_flags(_scored(t), "consumer", "base")


@query("r19_handle_resolve", "log", "SELECT node_id, round(base * CASE WHEN node_id IN (1, 2, 3) THEN 0.1 ELSE 1.0 END * CASE WHEN node_id IN (5, 6) THEN 1.5 ELSE 1.0 END, 6) AS score FROM scored WHERE consumer = 'agent' ORDER BY 2 DESC, 1 LIMIT 50", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    return R.refine(_scored(t).where("consumer = 'agent'"), "node_id", "base", [1, 2, 3], [5, 6])


@query("r20_render", "log", "SELECT node_id, round(base, 6) AS score, round(heat, 6) AS heat, round(canonicality, 6) AS canonicality FROM scored WHERE consumer = 'foyer'", HEAT, _FEATURES, _STANCE, _FACTORED)
def _(t):
    shown = R.render(_scored(t).where("consumer = 'foyer'").withColumn("score", F.col("base")), "standard")
    return shown.select("node_id", *[F.round(c, 6).alias(c) for c in ("score", "heat", "canonicality")])


_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


@query("r21_substrate_verification", None, rf"""WITH pairs AS (SELECT b.item_id AS claim_id, {_SET.format('b.text')} AS a, {_SET.format('d.text')} AS s, d.doc_id % 2 = 0 AS is_span
  FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40), best AS (SELECT claim_id,
  round(max(len(list_intersect(a, s)) / (len(a) + len(s) - len(list_intersect(a, s))) * CASE WHEN is_span THEN 1.0 ELSE 0.7 END), 6) AS faithfulness FROM pairs GROUP BY claim_id)
  SELECT *, CASE WHEN faithfulness < 0.3 THEN 'low' WHEN faithfulness >= 0.7 THEN 'high' ELSE 'middle' END AS level FROM best""")
def _(t):
    claims = t.queries.select(F.col("item_id").alias("claim_id"), "text")
    keyed = t.queries.select(F.col("item_id").alias("claim_id"), (F.col("item_id") % 40).alias("m"))
    docs = t.drawers.select((F.col("doc_id") % 40).alias("m"), "text", (F.col("doc_id") % 2 == 0).alias("is_span"))
    return R.verify_substrate(claims, keyed.join(docs, "m").drop("m"))


@query("r22_search_policy", "log", """SELECT walk, CASE WHEN remaining <= 0 THEN 'terminate:budget' WHEN stable THEN 'terminate:stuck' WHEN top >= 0.7 AND others THEN 'commit_depth' WHEN second IS NOT NULL AND top - second <= 0.1 AND dwindling THEN 'alternate' ELSE 'expand_breadth' END AS step,
  round(spread, 6) AS spread, coalesce(spread >= 0.15, false) AND NOT dwindling AS dispersed FROM (
  SELECT walk, max(confidence) FILTER (rn = 1) AS top, max(confidence) FILTER (rn = 2) AS second, coalesce(bool_and(fading) FILTER (rn > 1), true) AS others, stddev_samp(confidence) AS spread,
    min(remaining) AS remaining, bool_or(dwindling) AS dwindling, bool_or(stable) AS stable FROM (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY confidence DESC, frame DESC) AS rn FROM frames) GROUP BY walk)""",
    """frames AS (SELECT node_id AS walk, max("offset") AS frame, round(avg(value) / 50, 6) AS confidence, event_type IN ('click', 'error') AS fading, node_id % 7 AS remaining, node_id % 3 = 0 AS dwindling, node_id % 11 = 0 AS stable
      FROM log WHERE event_type IN ('view', 'click', 'error') GROUP BY node_id, event_type)""")
def _(t):
    f = t.log.where("event_type in ('view', 'click', 'error')").groupBy("node_id", "event_type").agg(F.max("offset").alias("frame"), F.round(F.avg("value") / 50, 6).alias("confidence"))
    n = F.col("node_id")
    return R.search_policy(f.select(n.alias("walk"), "frame", "confidence", F.col("event_type").isin("click", "error").alias("fading"), (n % 7).alias("remaining"), (n % 3 == 0).alias("dwindling"), (n % 11 == 0).alias("stable")))


@query("r24_cluster_pattern", "log", """SELECT walk, i, sha256(array_to_string(recent, '>')) AS signature, len(recent) >= 4 AND len(list_distinct(recent[-4:])) = 1 AS stable FROM (
  SELECT node_id AS walk, "offset" AS i, list(kind) OVER (PARTITION BY node_id ORDER BY "offset" ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS recent FROM log)""")
def _(t):
    return R.cluster_pattern(t.log.select(F.col("node_id").alias("walk"), F.col("offset").alias("i"), "kind"))


_Q = """questions AS (SELECT conv_id, turn, text, concat(['Will it ', 'How many ', 'Which of ', 'Name all of ', 'Tell me '][1 + (conv_id + turn) % 5], text, '?') AS q, ['high', 'low', 'medium'][1 + conv_id % 3] AS capability FROM conversations)"""


def _questions(t):
    starts = F.array(*[F.lit(x) for x in ("Will it ", "How many ", "Which of ", "Name all of ", "Tell me ")])
    return t.turns.select("conv_id", "turn", F.concat(F.get(starts, ((F.col("conv_id") + F.col("turn")) % 5).cast("int")), F.col("text"), F.lit("?")).alias("q"), F.get(F.array(F.lit("high"), F.lit("low"), F.lit("medium")), (F.col("conv_id") % 3).cast("int")).alias("capability"))


_SHAPE = r"""CASE WHEN regexp_matches(lower(trim(q)), '^(will|has|did|is|are|can|should|would)(\s|$)') AND (lower(trim(q)) LIKE '%?' OR contains(lower(q), 'by ')) THEN 'binary'
  WHEN regexp_matches(lower(q), '\b(price|count|how many|how much|value|amount)\b') THEN 'continuous' WHEN regexp_matches(lower(q), '\bwhich (of|one)\b') THEN 'categorical'
  WHEN regexp_matches(lower(q), '\b(all of|which all)\b') THEN 'set' ELSE 'open_ended' END"""


@query("r25_qualifier", "turns", f"""SELECT conv_id, turn, shape, CASE WHEN capability = 'high' AND shape IN ('binary', 'categorical') THEN 'local_only:0' WHEN capability = 'low' THEN 'remote_only:4000' WHEN shape = 'continuous' THEN 'remote_after_local:3000'
  WHEN shape = 'open_ended' THEN 'parallel_then_merge:4000' ELSE 'remote_after_local:2000' END AS plan FROM (SELECT *, {_SHAPE} AS shape FROM questions)""", _Q)
def _(t):
    q = _questions(t).withColumn("shape", R.question_shape(F.col("q")))
    return q.select("conv_id", "turn", "shape", R.plan_budget(F.col("shape"), F.col("capability")).alias("plan"))


@query("r26_pending_queue", "log", f"""SELECT node_id, "offset" FROM (SELECT node_id, "offset", row_number() OVER (PARTITION BY node_id ORDER BY "offset" DESC) AS n FROM log WHERE ts_ms + 1000000000 > {NOW_MS}) WHERE n <= 20""")
def _(t):
    return R.pending_queue(t.log.select("node_id", "offset", (F.col("ts_ms") + 1_000_000_000).alias("expires")), "node_id", "offset", NOW_MS, "expires", 20).select("node_id", "offset")


@query("r26_blank_position", "turns", "SELECT conv_id, turn, CASE WHEN instr(b, '...') > 0 THEN instr(b, '...') - 1 WHEN instr(b, '___') > 0 THEN instr(b, '___') - 1 ELSE -1 END AS blank FROM (SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN replace(text, '. ', '...') WHEN 1 THEN replace(text, ', ', '___') ELSE text END AS b FROM turns)")
def _(t):
    b = F.when(F.col("conv_id") % 3 == 0, F.replace("text", F.lit(". "), F.lit("..."))).when(F.col("conv_id") % 3 == 1, F.replace("text", F.lit(", "), F.lit("___"))).otherwise(F.col("text"))
    return t.turns.select("conv_id", "turn", b.alias("b")).select("conv_id", "turn", R.blank_position(F.col("b")).alias("blank"))
