"""Extension points: event handlers, mining passes, derived tables, stacks, equivalence, registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import udfs as U
from ...operators import extend as X
from ...operators import mine as N
from ...operators import rules as E
from ...operators import text as T
from ...sources import adapters as A
from ...streaming.views_registry import VIEWS, Bridge
from ..registry import query

_MOST = 16


def _accesses() -> X.Handler:
    """Counts accesses, the calls that brought them, and the last offset."""

    def step(state, rows):
        count, calls, _ = state
        return (count + len(rows), calls + 1, int(rows["offset"].max())), None

    return X.Handler(("node_accessed",), "node_id", lambda: (0, 0, -1), step, lambda key, state: (key[0], *state), "node_id long, accesses long, calls long, last_offset long", _MOST)


X.subscribe("access_counter", _accesses())


@query("u07_event_handler", "log", f"""SELECT node_id, count(*) AS accesses, CAST(ceil(count(*) / {_MOST}.0) AS BIGINT) AS calls, max("offset") AS last_offset FROM log WHERE kind = 'node_accessed' AND "offset" > 100 GROUP BY node_id""")
def _(t):
    return X.deliver(t.log, "access_counter", after=100)


def _busy(tables):
    n = tables["log"].where("kind = 'node_accessed'").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.col("node_id").alias("subject"), F.lit("busy").alias("kind"), F.round(F.least(F.lit(1.0), F.col("n") / 100), 6).alias("confidence"))


def _broken(tables):
    share = F.avg((F.col("event_type") == "error").cast("double"))
    return tables["log"].groupBy("k").agg(share.alias("share")).select(F.col("k").alias("subject"), F.lit("broken").alias("kind"), F.round("share", 6).alias("confidence"))


X.register_pass("busy_nodes", ("log",), _busy)
X.register_pass("broken_keys", ("log",), _broken)


@query("u08_miner_passes", "log", """SELECT * FROM (SELECT 'busy_nodes' AS pass, CAST(node_id AS VARCHAR) AS subject, 'busy' AS kind, round(least(1.0::DOUBLE, count(*) / 100), 6) AS confidence FROM log WHERE kind = 'node_accessed' GROUP BY node_id
  UNION ALL SELECT 'broken_keys', CAST(k AS VARCHAR), 'broken', round(avg((event_type = 'error')::INT::DOUBLE), 6) FROM log GROUP BY k) WHERE confidence >= 0.2""")
def _(t):
    return X.run_passes({"log": t.log}, ["busy_nodes", "broken_keys"], 0.2)


@query("u11_equivalence", "log", """SELECT a.node_id AS a, b.node_id AS b, a.ks = b.ks AS deep, list_slice(a.ks, 1, least(5, len(a.ks), len(b.ks))) = list_slice(b.ks, 1, least(5, len(a.ks), len(b.ks))) AS top_5
  FROM l a JOIN l b ON b.node_id = a.node_id + 1""", """l AS (SELECT node_id, list(k % 2 ORDER BY "offset") AS ks FROM log WHERE event_type = 'click' GROUP BY node_id)""")
def _(t):
    lists = t.log.where("event_type = 'click'").groupBy("node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("offset", (F.col("k") % 2).alias("v")))), lambda x: x["v"]).alias("ks"))
    a, b = lists.select(F.col("node_id").alias("a"), F.col("ks").alias("x")), lists.select((F.col("node_id") - 1).alias("a"), F.col("node_id").alias("b"), F.col("ks").alias("y"))
    return a.join(b, "a").select("a", "b", *[test(F.col("x"), F.col("y")).alias(name) for name, test in X.EQUIVALENCE.items()])


def _registry(t) -> X.DerivedRegistry:
    registry = X.DerivedRegistry(t.log)
    registry.register("heat", X.Derived("views", ("node_created", "node_accessed"), lambda log: log.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"))))
    registry.register("schemas", X.Derived("views", ("node_property_set",), lambda log: log.groupBy("k").agg(F.max("offset").alias("offset"))))
    registry.register("report", X.Derived("cli", ("node_invalidated",), lambda log: log.groupBy("node_id").agg(F.min("offset").alias("first")), X.ON_REQUEST))
    return registry


def _ticked(name: str, policy: str, kinds: str) -> str:
    span = """"offset" <= 3000""", """"offset" <= 7000""" + ("" if policy == "on_request" else """ AND "offset" > 3000""")
    return " UNION ALL ".join(
        f"SELECT {i + 1} AS tick, '{name}' AS name, '{policy}' AS policy, count(*) AS events, {-1 if policy == 'on_request' else (3000, 7000)[i]} AS frontier, {'count(*) > 0' if policy == 'on_request' else 'false'} AS stale FROM log WHERE kind IN ({kinds}) AND {s}"
        for i, s in enumerate(span)
    )


@query("h04_derived_registry", "log", " UNION ALL ".join([_ticked("heat", "on_event", "'node_created', 'node_accessed'"), _ticked("schemas", "on_event", "'node_property_set'"), _ticked("report", "on_request", "'node_invalidated'")]))
def _(t):
    registry = _registry(t)
    first = registry.tick_all(3000)
    return first.select(F.lit(1).alias("tick"), "*").unionByName(registry.tick_all(7000).select(F.lit(2).alias("tick"), "*"))


@query("h04_derived_table", "log", """SELECT node_id, min("offset") AS first FROM log WHERE kind = 'node_invalidated' AND "offset" <= 5000 GROUP BY node_id""")
def _(t):
    return _registry(t).table("report", 5000)


_PLAN = [
    X.Step("measure", ("text",), ("size",), lambda df: df.withColumn("size", F.length(F.coalesce("text", F.lit(""))))),
    X.Step("grade", ("size",), ("grade",), lambda df: df.withColumn("grade", F.when(F.col("size") > 1000, "long").otherwise("short"))),
]


@query("e29_stack_execute", "drawers", """SELECT doc_id, size, grade, sha256(concat(sha256(concat('|measure|', size)), '|grade|', grade)) AS attested FROM (SELECT *, CASE WHEN size > 1000 THEN 'long' ELSE 'short' END AS grade FROM (SELECT doc_id, length(coalesce(text, '')) AS size FROM drawers))""")
def _(t):
    return X.execute(_PLAN, t.drawers.select("doc_id", "text")).select("doc_id", "size", "grade", "attested")


@query("e29_stack_validate", None, "SELECT * FROM (VALUES ('grade', 'lacks size'), ('grade', 'repeated'), ('ask', 'lacks answer'), ('ask', 'asks for external')) v(step, problem)")
def _(t):
    plan = [_PLAN[1], _PLAN[0], _PLAN[1], X.Step("ask", ("answer", "size"), (), lambda df: df, X.EXTERNAL)]
    return t.spark.createDataFrame(X.validate(plan, ["text"]), "step string, problem string")


@query("r08_period_velocity_coupling", "log", """SELECT period, round(coalesce(CASE WHEN isnan(corr(views, clicks)) THEN 0 ELSE corr(views, clicks) END, 0), 6) AS coupling FROM (
  SELECT node_id AS period, ts_ms // 86400000 AS day, CAST(count(*) FILTER (event_type = 'view') AS DOUBLE) AS views, CAST(count(*) FILTER (event_type = 'click') AS DOUBLE) AS clicks FROM log GROUP BY 1, 2) GROUP BY period""")
def _(t):
    daily = t.log.groupBy(F.col("node_id").alias("period"), F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(*[F.sum((F.col("event_type") == e).cast("double")).alias(f"{e}s") for e in ("view", "click")])
    return daily.groupBy("period").agg(F.round(U.coupling(F.col("views"), F.col("clicks")), 6).alias("coupling"))


@query("r10_feature_validation", "log", """SELECT node_id, CASE WHEN m BETWEEN 0 AND 1 THEN round(m, 6) END AS as_unit, CASE WHEN m BETWEEN -1 AND 1 THEN round(m, 6) END AS as_signed, round(m, 6) AS as_float, CASE WHEN n = floor(n) THEN n END AS as_int FROM (
  SELECT node_id, avg(value) / 50 AS m, CAST(count(*) AS DOUBLE) / 2 AS n FROM log GROUP BY node_id)""")
def _(t):
    f = t.log.groupBy("node_id").agg((F.avg("value") / 50).alias("m"), (F.count(F.lit(1)).cast("double") / 2).alias("n"))
    for kind in ("unit", "signed", "float"):
        U.register_feature(f"as_{kind}", "node", kind, lambda: F.col("m"))
    U.register_feature("as_int", "node", "int", lambda: F.col("n"))
    return U.compute(f, "node_id", ["as_unit", "as_signed", "as_float", "as_int"]).select("node_id", *[F.round(c, 6).alias(c) for c in ("as_unit", "as_signed", "as_float")], "as_int")


@query("r15_ranker_dispatch", None, "SELECT * FROM (VALUES ('matching', 'neural'), ('montage', 'neural'), ('agent', 'factored'), ('unheard of', 'factored')) v(consumer, ranker)")
def _(t):
    asked = t.spark.createDataFrame([("matching",), ("montage",), ("agent",), ("unheard of",)], "consumer string")
    return asked.select("consumer", U.ranker_of(F.col("consumer")).alias("ranker"))


_CONTAINED = "CASE WHEN len(wa) = 0 THEN 0 ELSE len(list_intersect(wa, wb)) / len(wa) END"
_SET = r"list_distinct(list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f\v]+'), lambda x: x <> ''))"


@query("u03_text_similarity", None, f"SELECT a, b, round({_CONTAINED}, 6) AS similarity FROM (SELECT x.doc_id AS a, y.doc_id AS b, {_SET.format('x.text')} AS wa, {_SET.format('y.text')} AS wb FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 1)")
def _(t):
    a = t.drawers.select(F.col("doc_id").alias("a"), F.col("text").alias("x"))
    b = t.drawers.select((F.col("doc_id") - 1).alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(U.SIMILARITIES["contained"](F.col("x"), F.col("y")), 6).alias("similarity"))


@query("u03_rendered_verification", "log", """SELECT "offset" AS assertion, r AS rendered, CASE WHEN r = e THEN 1.0 ELSE 0.5 END::DOUBLE AS similarity, r = e AS supported FROM (SELECT "offset", concat(event_type, ' of ', k % 3) AS r, concat(event_type, ' of ', node_id % 3) AS e FROM log)""")
def _(t):
    rows = t.log.select(F.col("offset").alias("assertion"), F.col("event_type").alias("predicate"), (F.col("k") % 3).alias("object"), F.concat("event_type", F.lit(" of "), F.col("node_id") % 3).alias("evidence"))
    return U.verify(rows, lambda: F.concat("predicate", F.lit(" of "), "object"), "jaccard", 0.9).select("assertion", "rendered", F.round("similarity", 6).alias("similarity"), "supported")


@query("u04_embedder", None, "SELECT item_id, 32 AS dims, round(CAST(('0x' || substr(sha256(text), 1, 2))::INT AS DOUBLE) / 127.5 - 1, 6) AS first, round(CAST(('0x' || substr(sha256(text), 63, 2))::INT AS DOUBLE) / 127.5 - 1, 6) AS last FROM benchmark")
def _(t):
    v = t.queries.select("item_id", U.EMBEDDERS["sha256"](F.col("text")).alias("v"))
    return v.select("item_id", F.size("v").alias("dims"), F.round(F.get("v", 0), 6).alias("first"), F.round(F.get("v", 31), 6).alias("last"))


@query("u05_formula_evaluator", "log", "SELECT node_id, CASE WHEN count(*) % 2 = 0 THEN 0 ELSE 1 END AS outcome FROM log GROUP BY node_id")
def _(t):
    E.register("even_count", lambda: E.outcome(F.col("n") % 2 == 0, F.lit(9000)))
    return t.log.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")).select("node_id", E.raw("even_count")["outcome"].alias("outcome"))


@query("u06_steps", "log", "SELECT node_id, count(*) AS n, count(*) > 60 AS busy FROM log WHERE event_type <> 'error' GROUP BY node_id")
def _(t):
    U.register_step("no_errors", lambda df: df.where("event_type <> 'error'"))
    U.register_step("by_node", lambda df: df.groupBy("node_id").agg(F.count(F.lit(1)).alias("n")))
    U.register_step("busy", lambda df: df.withColumn("busy", F.col("n") > 60))
    return U.run_steps(t.log, ["no_errors", "by_node", "busy"])


@query("u09_adapters", None, "SELECT * FROM (VALUES " + ", ".join(f"('{n}')" for n in sorted(A.ADAPTERS)) + ") v(adapter)")
def _(t):
    return t.spark.createDataFrame([(n,) for n in A.use(t.spark)], "adapter string")


@query("u09_transforms", "drawers", r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')) AS digest FROM drawers")
def _(t):
    U.register_transform("lower", F.lower)
    U.register_transform("one_space", lambda c: F.btrim(F.regexp_replace(c, "[ \\t\\n\\r\\f\\x0B]+", " "), F.lit(" ")))
    return t.drawers.select("doc_id", F.md5(U.transformed(F.col("text"), "lower", "one_space").cast("binary")).alias("digest"))


@query("v15_view_specs", "log", "SELECT * FROM (VALUES " + ", ".join(f"('{v.name}', '{v.key}', {len(v.kinds)}, {str(v.stream is not None).lower()})" for v in VIEWS.values()) + ") v(name, key, kinds, streams)")
def _(t):
    return t.spark.createDataFrame([(v.name, v.key, len(v.kinds), v.stream is not None) for v in VIEWS.values()], "name string, key string, kinds int, streams boolean")


@query("v15_view_key", "log", """SELECT node_id, max("offset") AS since_offset FROM log WHERE event_type IN ('error', 'signup') AND "offset" <= 6000 AND node_id = (SELECT min(node_id) FROM (SELECT node_id FROM log WHERE event_type IN ('error', 'signup') AND "offset" <= 6000 GROUP BY node_id HAVING arg_max(event_type, "offset") = 'error')) GROUP BY node_id""")
def _(t):
    bridge = Bridge(t.log)
    bridge.advance_to(6000)
    key = bridge.snapshot("invalidation_set").agg(F.min("node_id")).first()[0]
    return bridge.query("invalidation_set", key)


_COMMITS = """commits AS (SELECT o_orderkey AS id, concat('repo', o_custkey % 20) AS repo, CASE WHEN o_custkey % 17 = 0 THEN 'Release Bot' WHEN o_custkey % 19 = 0 THEN concat('dependabot-', o_custkey) ELSE concat('Author N', o_custkey % 300) END AS name,
  CASE WHEN o_custkey % 23 = 0 THEN 'ci-bot@example.com' ELSE concat('a', o_custkey % 450, '@example.com') END AS email FROM orders)"""
_HUMAN = "human AS (SELECT * FROM commits WHERE NOT (regexp_matches(lower(name), '" + "|".join(N.BOT_NAMES) + "') OR regexp_matches(lower(email), '" + "|".join(N.BOT_EMAILS) + "')))"


def _commits(t):
    c = F.col("o_custkey")
    name = F.when(c % 17 == 0, "Release Bot").when(c % 19 == 0, F.concat(F.lit("dependabot-"), c)).otherwise(F.concat(F.lit("Author N"), c % 300))
    email = F.when(c % 23 == 0, "ci-bot@example.com").otherwise(F.concat(F.lit("a"), c % 450, F.lit("@example.com")))
    return t.raw("orders").select(F.concat(F.lit("repo"), c % 20).alias("repo"), name.alias("name"), email.alias("email"))


@query("n22_projects", None, f"""WITH {_COMMITS}, {_HUMAN}, by_author AS (SELECT repo, name, count(*) AS n, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, name) AS place FROM human GROUP BY repo, name)
  SELECT repo, total, mine, mine > 0 AND (coalesce(place <= 5, false) OR mine / total >= 0.1 OR mine >= 20) AS is_mine FROM (SELECT repo, count(*) AS total, count(*) FILTER (name = 'Author N7' OR email = 'a7@example.com') AS mine FROM human GROUP BY repo) LEFT JOIN (SELECT repo, place FROM by_author WHERE name = 'Author N7') USING (repo)""")
def _(t):
    return N.scan_projects(_commits(t), "Author N7", "a7@example.com")


@query("n22_people", None, f"""WITH RECURSIVE {_COMMITS}, {_HUMAN}, e AS (SELECT DISTINCT concat('n:', name) AS x, concat('e:', email) AS y FROM human), b AS (SELECT x, y FROM e UNION SELECT y, x FROM e), cc AS (SELECT x AS node, x AS comp FROM b UNION SELECT y, comp FROM cc JOIN b ON node = x),
  part AS (SELECT node, min(comp) AS person FROM cc GROUP BY node), named AS (SELECT person, name, count(*) AS n FROM human JOIN part ON node = concat('n:', name) GROUP BY person, name)
  SELECT person, sum(n)::BIGINT AS commits, count(*) AS names, arg_min(name, row(-n, name)) AS name FROM named GROUP BY person""")
def _(t):
    return N.merge_people(_commits(t))


@query("x04_near_duplicates_by_time", None, """WITH t AS (SELECT event_id AS id, CAST(epoch_us(ts) // 1000 AS BIGINT) AS ts, list_distinct([event_type, concat('u', user_id % 3), concat('k', CAST(json_extract(props, '$.k') AS BIGINT) % 2)]) AS words FROM events)
  SELECT x.id AS a, y.id AS b, 1.0::DOUBLE AS similarity FROM t x JOIN t y ON x.id < y.id AND y.ts - x.ts <= 300000 AND x.ts - y.ts <= 300000 AND x.words = y.words""")
def _(t):
    words = F.transform(F.array_distinct(F.array("event_type", F.concat(F.lit("u"), F.col("node_id") % 3), F.concat(F.lit("k"), F.col("k") % 2))), lambda w: F.xxhash64(w))
    return T.near_duplicates(t.log.select(F.col("offset").alias("id"), words.alias("words"), F.col("ts_ms").alias("ts")))
