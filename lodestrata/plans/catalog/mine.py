"""Mining passes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import mine as N
from ..registry import query


def _q(words):
    return ["'" + w.replace("'", "''") + "'" for w in words]


def _count(words, expr):
    return "(" + " + ".join(f"contains({expr}, {w})::INT" for w in _q(words)) + ")"


def _first_max(counts: dict[str, str], default: str) -> str:
    best = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {best} = 0 THEN '{default}' " + " ".join(f"WHEN {c} = {best} THEN '{k}'" for k, c in counts.items()) + " END"


_KINDS = {k: _count(w, "low") for k, w in N.MEMORY_TYPES.items()}
_VIEWS = {k: _count(w, "low") for k, w in N.SELF_OTHER_WORLD.items()}
_BEST, _SEEN, _TOP = f"greatest({', '.join(_KINDS.values())})", " + ".join(_VIEWS.values()), f"greatest({', '.join(_VIEWS.values())})"
_POS, _NEG = _count(N.POSITIVE, "low"), _count(N.NEGATIVE, "low")
#: Prefixes that make the synthetic texts exercise the keyword classes.
_LEADS = ("I was happy today. ", "In general always good; I know that. ", "When I was sad, back in time, they said no. ", "I will plan: the way to, how I usually. My goal. ", "")
_LED = "CASE doc_id % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_LEADS)) + " END"


def _led(t):
    lead = F.get(F.array(*[F.lit(x) for x in _LEADS]), (F.col("doc_id") % 5).cast("int"))
    return t.drawers.withColumn("text", F.concat(lead, F.col("text")))


@query("n01_enrichment", "drawers", f"""SELECT doc_id, {_first_max(_KINDS, 'episodic')} AS memory_type, CAST(CASE WHEN {_BEST} > 0 THEN round(least(0.9, 0.4 + 0.1 * {_BEST}), 6) ELSE 0.4 END AS DOUBLE) AS memory_confidence,
  {_count(N.INTERACTIONAL, 'low')} > 0 AS interactional, CAST(round(least(0.9, 0.5 + 0.1 * {_count(N.INTERACTIONAL, 'low')}), 6) AS DOUBLE) AS interactional_confidence, {_first_max(_VIEWS, 'unknown')} AS perspective,
  CASE WHEN {_SEEN} = 0 THEN 0.3 ELSE round(least(0.9, 0.4 + 0.5 * {_TOP} / ({_SEEN})), 6) END AS perspective_confidence, {_count(N.GOALS, 'low')} > 0 AS goal,
  CASE WHEN {_POS} + {_NEG} = 0 THEN 0 ELSE round(({_POS} - {_NEG}) / ({_POS} + {_NEG}), 6) END AS valence, least(1.0, ({_POS} + {_NEG}) / 5) AS intensity
  FROM (SELECT doc_id, lower(concat({_LED}, text)) AS low FROM drawers)""")
def _(t):
    return _led(t).select("doc_id", *N.enrich(F.col("text")))


@query("n02_event_boundaries", "drawers", r"""SELECT wing, doc_id, previous, boundary, CAST(sum(boundary::INT) OVER (PARTITION BY wing ORDER BY doc_id) AS BIGINT) AS stretch FROM (SELECT wing, doc_id, previous,
  coalesce(CASE WHEN len(words) + len(before) = 0 THEN 1.0 ELSE len(list_intersect(before, words)) / len(list_distinct(list_concat(before, words))) END < 0.15, false) AS boundary FROM (
  SELECT wing, doc_id, words, lag(words) OVER w AS before, lag(doc_id) OVER w AS previous FROM (SELECT wing, doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: length(x) > 4)) AS words FROM drawers) WINDOW w AS (PARTITION BY wing ORDER BY doc_id)))""")
def _(t):
    return N.boundaries(t.drawers, "wing", "doc_id")


_WORDS = r"list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> ''), lambda x: trim(x, '.,;:!?'))"
_ASSERTED = f"""asserted AS (SELECT doc_id, w[i - 1] AS subject, lower(w[i]) AS predicate, w[i + 1] AS object, i - 1 AS "at" FROM (SELECT doc_id, w, unnest(range(2, len(w))) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM drawers))
  WHERE lower(w[i]) IN ({', '.join(_q(N.PREDICATES))}) AND w[i - 1] <> '' AND w[i + 1] <> '')"""


@query("n03_assertions", "drawers", "SELECT * FROM asserted", _ASSERTED)
def _(t):
    return N.extract_assertions(t.drawers, "doc_id")


@query("n04_contradictions", "drawers", """SELECT DISTINCT a.doc_id, a.subject, a.predicate, a.object, b.object AS known FROM asserted a JOIN drawers x ON x.doc_id = a.doc_id AND x.wing <> 'src0'
  JOIN asserted b ON a.subject = b.subject AND a.predicate = b.predicate AND a.object <> b.object JOIN drawers y ON y.doc_id = b.doc_id AND y.wing = 'src0'""", _ASSERTED)
def _(t):
    old, new = (N.extract_assertions(t.drawers.where(c), "doc_id") for c in ("wing = 'src0'", "wing <> 'src0'"))
    return N.contradictions(new.select("doc_id", "subject", "predicate", "object"), old.select("subject", "predicate", "object"))


@query("n05_theme_velocity", "drawers", "SELECT theme, count(*) AS drawers FROM (SELECT unnest([wing, room, concat(wing, '/', room)]) AS theme FROM drawers) GROUP BY theme")
def _(t):
    return t.drawers.select(F.explode(F.array("wing", "room", F.concat_ws("/", "wing", "room"))).alias("theme")).groupBy("theme").agg(F.count(F.lit(1)).alias("drawers"))


_SPLIT = 4000  # the offset at which the second period begins


@query("n06_schema_induction", "log", f"""SELECT coalesce(a.shape, b.shape) AS shape, coalesce(n, 0) AS n, coalesce(was, 0) AS was, CASE WHEN coalesce(was, 0) = 0 THEN 'new' WHEN coalesce(n, 0) = 0 THEN 'broken' WHEN abs(n - was) / was < 0.5 THEN 'stable' ELSE 'drifting' END AS status
  FROM (SELECT shape, count(*) AS n FROM s WHERE "offset" >= {_SPLIT} GROUP BY shape HAVING count(*) >= 3) a FULL JOIN (SELECT shape, count(*) AS was FROM s WHERE "offset" < {_SPLIT} GROUP BY shape) b ON a.shape = b.shape""",
    """s AS (SELECT concat(node_id % 12, '|', k % 5, '|', event_type) AS shape, "offset" FROM log)""")
def _(t):
    s = t.log.select(F.concat_ws("|", F.col("node_id") % 12, F.col("k") % 5, "event_type").alias("shape"), "offset")
    before = s.where(F.col("offset") < _SPLIT).groupBy("shape").agg(F.count(F.lit(1)).alias("was"))
    return N.induce_schemas(s.where(F.col("offset") >= _SPLIT).select("shape"), before)


@query("n07_auto_promotion", "log", """SELECT node_id AS key, arg_min(value, "offset") / 50 AS confidence, count(*) FILTER (event_type = 'click') AS confirmed, count(*) FILTER (event_type = 'error' AND k < 5) AS rejected,
  count(*) FILTER (event_type = 'error' AND k < 5) = 0 AND count(*) FILTER (event_type = 'click') >= 3 AND arg_min(value, "offset") / 50 >= 0.85 AS ripe FROM log GROUP BY node_id""")
def _(t):
    e, k = F.col("event_type"), F.col("k")
    p = t.log.select(F.col("node_id").alias("key"), "offset", (F.col("value") / 50).alias("confidence"), (e == "click").cast("long").alias("confirmed"), ((e == "error") & (k < 5)).cast("long").alias("rejected"))
    return N.auto_promotion(p)


@query("n08_feedback_loss", "log", """SELECT proposal, round(sum(v * w) / sum(w), 6) AS loss FROM (SELECT k AS proposal, event_type, avg(value / 50 - 1) AS v, CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 2.0 ELSE 0.5 END AS w FROM log GROUP BY 1, 2) GROUP BY proposal""")
def _(t):
    w = t.spark.createDataFrame([("view", 1.0), ("click", 2.0), ("error", 0.5), ("purchase", 0.5), ("signup", 0.5)], "consumer string, weight double")
    return N.feedback_loss(t.log.select(F.col("k").alias("proposal"), F.col("event_type").alias("consumer"), (F.col("value") / 50 - 1).alias("valence")), w)


@query("n09_resolve_canonical", "vectors", """SELECT id, coalesce(exact, CASE WHEN s >= 0.85 THEN near END) AS canonical_id, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN s >= 0.85 THEN 'similar' ELSE 'candidate' END AS how FROM (
  SELECT a.vec_id AS id, CASE WHEN a.vec_id % 7 = 0 THEN a.vec_id % 10 * 50 END AS exact, max(s) AS s, arg_max(c.vec_id, row(s, -c.vec_id)) AS near FROM vectors a, c, LATERAL (SELECT round(list_dot_product(a.v, c.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(c.v, c.v)), 6) AS s) GROUP BY a.vec_id)""",
    "c AS (SELECT vec_id, v FROM vectors WHERE vec_id % 50 = 0)")
def _(t):
    canon = t.vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("canonical_id"), F.concat(F.lit("name"), "vec_id").alias("name"), F.col("v").alias("cv"))
    surface = F.when(F.col("vec_id") % 7 == 0, F.concat(F.lit(" NAME"), F.col("vec_id") % 10 * 50)).otherwise(F.concat(F.lit("other"), "vec_id"))
    return N.resolve_canonical(t.vectors.select(F.col("vec_id").alias("id"), surface.alias("surface"), "v"), canon, N.THRESHOLDS["predicates"])


@query("n10_promotions", "log", """SELECT cluster, members, passes, surface FROM (SELECT k AS cluster, count(*) AS members, count(DISTINCT node_id % 3) AS passes FROM log WHERE event_type = 'view' GROUP BY k)
  JOIN (SELECT cluster, arg_min(surface, row(-n, surface)) AS surface FROM (SELECT k AS cluster, concat('s', node_id % 4) AS surface, count(*) AS n FROM log WHERE event_type = 'view' GROUP BY 1, 2) GROUP BY cluster) USING (cluster) WHERE members >= 3 AND passes >= 2""")
def _(t):
    return N.promotions(t.log.where("event_type = 'view'").select(F.col("k").alias("cluster"), F.concat(F.lit("s"), F.col("node_id") % 4).alias("surface"), (F.col("node_id") % 3).alias("pass_id")))


_MEANS = "means AS (SELECT period, theme, list(x ORDER BY i) AS v FROM (SELECT vec_id % 3 AS period, label AS theme, i, avg(v[i]) AS x FROM vectors, range(1, 65) r(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def _means(t):
    return N.mean_vectors(t.vectors.select((F.col("vec_id") % 3).alias("period"), F.col("label").alias("theme"), "v"), ["period", "theme"])


@query("n11_signature_snapshot", "vectors", "SELECT period, theme, len(v) AS size, round(sqrt(list_dot_product(v, v)), 6) AS norm FROM means", _MEANS)
def _(t):
    from ...functions.columns import norm

    return _means(t).select("period", "theme", F.size("v").cast("long").alias("size"), F.round(norm(F.col("v")), 6).alias("norm"))


_KIND_LIST = ("signup", "view", "click", "purchase", "error")
_PER = "per AS (SELECT node_id % 6 AS period, k % 10 AS theme, [" + ", ".join(f"coalesce(avg(value) FILTER (event_type = '{e}'), 0)" for e in _KIND_LIST) + "] AS position, [" + ", ".join(f"CAST(count(*) FILTER (event_type = '{e}') AS DOUBLE)" for e in _KIND_LIST) + "] AS fork, avg(value) AS velocity, count(*) FILTER (event_type = 'error') AS errors FROM log GROUP BY 1, 2)"
_PRINTS = "prints AS (SELECT node_id % 6 AS period, list_distinct(list(k % 10 * 100 + node_id % 7) FILTER (value > 40)) AS schemas FROM log GROUP BY 1)"


def _cos(c):
    return f"greatest(0, list_dot_product(a.{c}, b.{c}) / sqrt(list_dot_product(a.{c}, a.{c}) * list_dot_product(b.{c}, b.{c})))"


_SIM = f"""sim AS (SELECT a, b, mean_position, velocity, round(len(list_intersect(x.schemas, y.schemas)) / len(list_distinct(list_concat(x.schemas, y.schemas))), 6) AS schema_fingerprint, contradiction_profile, fork_significance FROM (
  SELECT a.period AS a, b.period AS b, round(avg({_cos('position')}), 6) AS mean_position, round(sum(least(a.velocity, b.velocity)) / sum(greatest(a.velocity, b.velocity)), 6) AS velocity,
  round(greatest(0, 1 - avg(least(1, abs(a.errors - b.errors) / greatest(a.errors, b.errors, 1e-9)))), 6) AS contradiction_profile, round(avg({_cos('fork')}), 6) AS fork_significance
  FROM per a JOIN per b ON b.period > a.period AND a.theme = b.theme GROUP BY 1, 2) JOIN prints x ON x.period = a JOIN prints y ON y.period = b)"""


def _similarity(t):
    period = (F.col("node_id") % 6).alias("period")

    def of(kind, f):
        return f(F.when(F.col("event_type") == kind, F.col("value")))

    themes = t.log.groupBy(period, (F.col("k") % 10).alias("theme")).agg(
        F.array(*[F.coalesce(of(e, F.avg), F.lit(0.0)) for e in _KIND_LIST]).alias("position"), F.array(*[of(e, F.count).cast("double") for e in _KIND_LIST]).alias("fork"),
        F.avg("value").alias("velocity"), of("error", F.count).cast("double").alias("errors"),
    )
    prints = t.log.groupBy(period).agg(F.collect_set(F.when(F.col("value") > 40, F.col("k") % 10 * 100 + F.col("node_id") % 7)).alias("schemas"))
    p = prints.select("period")
    return N.signature_similarity(themes, prints, p.select(F.col("period").alias("a")).join(p.select(F.col("period").alias("b")), F.col("a") < F.col("b")))


@query("n12_signature_similarity", "log", "SELECT * FROM sim", _PER, _PRINTS, _SIM)
def _(t):
    return _similarity(t)


_DRIFTS = ", ".join(f"round(1 - {a}, 6) AS {a}" for a in N.TRIAGE)


@query("n13_drift", "log", f"SELECT *, round(({' + '.join(N.TRIAGE)}) / 5, 6) AS overall, greatest({', '.join(N.TRIAGE)}) >= 0.4 AS flagged FROM (SELECT b AS period, {_DRIFTS} FROM sim WHERE a = 0)", _PER, _PRINTS, _SIM)
def _(t):
    return N.drift(_similarity(t).where("a = 0").drop("a").withColumnRenamed("b", "period"))


_AXES = "axes AS (SELECT node_id AS pair, " + ", ".join(f"avg((k * {i + 1}) % 100) / 100 AS {a}" for i, a in enumerate(N.TRIAGE)) + " FROM log GROUP BY node_id)"
_SCORE = " + ".join(f"{w} * {a}" for a, w in N.TRIAGE.items())


@query("n14_triage", "log", f"SELECT pair, round({_SCORE}, 6) AS score, round({_SCORE}, 6) >= 0.4 AS passed FROM axes", _AXES)
def _(t):
    a = t.log.groupBy(F.col("node_id").alias("pair")).agg(*[(F.avg((F.col("k") * (i + 1)) % 100) / 100).alias(x) for i, x in enumerate(N.TRIAGE)])
    return N.triage(a).select("pair", "score", "passed")


_CUT = {a: f"CASE WHEN m.{a} >= 0.5 THEN greatest({w * N.TRIAGE_FLOOR!r}::DOUBLE, w.{a} * {N.TRIAGE_FACTOR}::DOUBLE) ELSE w.{a} END" for a, w in N.TRIAGE.items()}
_CUTS = ", ".join(f"{x} AS {a}" for a, x in _CUT.items())
_SUM = " + ".join(N.TRIAGE)


@query("n14_triage_feedback", "log", f"""SELECT user, {', '.join(f'round(arg_max({a}, i), 6) AS {a}' for a in N.TRIAGE)} FROM w WHERE i > 0 GROUP BY user""",
    "moves AS MATERIALIZED (SELECT node_id AS user, row_number() OVER (PARTITION BY node_id ORDER BY \"offset\") AS i, " + ", ".join(f"((k * {i + 1}) % 100) / 100 AS {a}" for i, a in enumerate(N.TRIAGE)) + " FROM log WHERE event_type = 'error')",
    f"""w AS (SELECT DISTINCT user, 0::BIGINT AS i, {', '.join(f'{x}::DOUBLE AS {a}' for a, x in N.TRIAGE.items())} FROM moves UNION ALL SELECT user, i, {', '.join(f'{a} / ({_SUM})' for a in N.TRIAGE)} FROM (SELECT w.user, m.i, {_CUTS} FROM w JOIN moves m ON m.user = w.user AND m.i = w.i + 1))""",
    recursive=True)
def _(t):
    fp = t.log.where("event_type = 'error'").select(F.col("node_id").alias("user"), "offset", *[(((F.col("k") * (i + 1)) % 100) / 100).alias(x) for i, x in enumerate(N.TRIAGE)])
    return N.triage_feedback(fp)


@query("n15_aggregations", "log", """SELECT node_id, round(arg_min(v, "offset"), 6) AS take_first, round(arg_max(v, "offset"), 6) AS last_writer, round(sum(v), 6) AS sum, round(avg(v), 6) AS average,
  round(exp(sum(ln(greatest(0.05, least(2.0, v))))), 6) AS multiply_clamped, round(exp(avg(ln(greatest(0.05, least(2.0, v))))), 6) AS rank_compose FROM (SELECT node_id, "offset", value / 60 AS v FROM log) GROUP BY node_id""")
def _(t):
    return N.aggregate(t.log.withColumn("v", F.col("value") / 60), "node_id", "v", "offset")


_PUNCT = "'.,;:!?\"''`()[]{}#<>/\\-_=+@$%^&*~'"


@query("n16_themes", "turns", rf"""SELECT conv_id, w, n, rank FROM (SELECT conv_id, w, count(*) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY count(*) DESC, min(row(turn, i))) AS rank FROM (
  SELECT conv_id, turn, i, trim(x, {_PUNCT}) AS w FROM (SELECT conv_id, turn, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM (SELECT conv_id, turn, regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+') AS p FROM turns WHERE role = 'user')))
  WHERE length(w) >= 4 AND w NOT IN ({', '.join(_q(N.THEME_STOP_WORDS))}) AND regexp_full_match(w, '\p{{L}}+') GROUP BY conv_id, w) WHERE rank <= 3""")
def _(t):
    return N.themes(t.turns.where("role = 'user'"), "conv_id", "turn")


_ORIGIN_BRANDS, _ORIGIN_AMBIGUOUS = ("GPT-4", "LLM"), ("Opus",)


@query("n17_origin", "turns", r"""SELECT conv_id, turn, strong OR NOT none AS dialogue, round(CASE WHEN strong THEN least(0.95, 0.6 + 0.1 * (b + t)) WHEN none THEN 0.9 ELSE 0.4 END, 6) AS confidence FROM (
  SELECT *, b >= 0.5 OR t >= 2.0 AS strong, counted = 0 AND turns_ = 0 AND n >= 150 AS none FROM (SELECT *, counted * 1000 / n AS b, turns_ * 1000 / n AS t FROM (SELECT conv_id, turn, length(s) AS n, len(regexp_extract_all(s, '(?i)\b(user|assistant|human|ai)\s*:\s*')) AS turns_,
    len(regexp_extract_all(s, '(?i)\b(GPT-4|LLM)\b')) + CASE WHEN len(regexp_extract_all(s, '(?i)\b(GPT-4|LLM)\b')) + len(regexp_extract_all(s, '(?i)\b(user|assistant|human|ai)\s*:\s*')) > 0 THEN len(regexp_extract_all(s, '(?i)\bOpus\b')) ELSE 0 END AS counted
    FROM (SELECT conv_id, turn, concat(['user: ', 'gpt-4 llm ', 'opus ', ''][1 + (conv_id + turn) % 4], text) AS s FROM turns))))""")
def _(t):
    lead = F.get(F.array(*[F.lit(x) for x in ("user: ", "gpt-4 llm ", "opus ", "")]), ((F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    o = N.origin(F.concat(lead, F.col("text")), _ORIGIN_BRANDS, _ORIGIN_AMBIGUOUS)
    return t.turns.select("conv_id", "turn", o.alias("o")).select("conv_id", "turn", "o.dialogue", "o.confidence")


_HALLS = {k: _count(w, "lower(text)") for k, w in N.HALLS.items()}


@query("n20_hall_detection", "drawers", f"SELECT doc_id, {_first_max(_HALLS, 'general')} AS hall FROM drawers")
def _(t):
    return t.drawers.select("doc_id", N.hall(F.col("text")).alias("hall"))


@query("x17_session_hall", "turns", f"""SELECT conv_id, CASE WHEN {_count(N.PREFERENCE, 'u')} > 0 THEN 'hall_preferences' WHEN {_count(N.ADVICE, 'a')} >= 2 THEN 'hall_assistant_advice' WHEN {_count(N.EVENTS, 'concat(u, a)')} > 0 THEN 'hall_events'
  WHEN {_count(N.FACTS, 'concat(u, a)')} >= 2 THEN 'hall_facts' ELSE 'hall_general' END AS hall FROM (SELECT conv_id, lower(concat(CASE conv_id % 4 WHEN 0 THEN 'i prefer ' WHEN 1 THEN 'moved ' WHEN 2 THEN 'job city ' ELSE '' END,
  coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'user'), ''))) AS u, lower(coalesce(string_agg(text, ' ' ORDER BY turn) FILTER (role = 'assistant'), '')) AS a FROM turns GROUP BY conv_id)""")
def _(t):
    def said(role):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), " ")

    s = t.turns.groupBy("conv_id").agg(said("user").alias("u"), said("assistant").alias("a"))
    lead = F.get(F.array(F.lit("i prefer "), F.lit("moved "), F.lit("job city "), F.lit("")), (F.col("conv_id") % 4).cast("int"))
    return s.select("conv_id", N.session_hall(F.concat(lead, F.col("u")), F.col("a")).alias("hall"))


@query("n21_fact_checker", None, """SELECT id, x, y, relation, known, CASE WHEN known IS NULL THEN 'unknown' WHEN known = x AND ended THEN 'stale' WHEN known = x THEN 'ok' WHEN levenshtein(known, x) <= 2 THEN 'near_name' ELSE 'mismatch' END AS issue FROM (
  SELECT c_custkey AS id, concat('P', c_custkey % 13) AS x, concat('Q', c_custkey % 7) AS y, CASE c_custkey % 3 WHEN 0 THEN 'brother' WHEN 1 THEN 'boss' ELSE 'friend' END AS relation FROM customer)
  LEFT JOIN (SELECT concat('Q', i) AS y, r AS relation, concat('P', i * 2 + length(r)) AS known, i % 2 = 0 AS ended FROM range(7) a(i), (VALUES ('brother'), ('boss')) b(r)) USING (y, relation)""")
def _(t):
    r = F.get(F.array(F.lit("brother"), F.lit("boss"), F.lit("friend")), (F.col("c_custkey") % 3).cast("int"))
    x, y = F.concat(F.lit("P"), F.col("c_custkey") % 13), F.concat(F.lit("Q"), F.col("c_custkey") % 7)
    said = F.when(F.col("c_custkey") % 2 == 0, F.concat(x, F.lit(" is "), y, F.lit("'s "), r)).otherwise(F.concat(y, F.lit("'s "), r, F.lit(" is "), x))
    found = t.raw("customer").select(F.col("c_custkey").alias("id"), N.claims(said).alias("c")).select("id", "c.x", "c.y", "c.relation")
    facts = t.spark.createDataFrame([(f"Q{i}", r, f"P{i * 2 + len(r)}", i % 2 == 0) for i in range(7) for r in ("brother", "boss")], "y string, relation string, known string, ended boolean")
    return N.check_facts(found, facts)


