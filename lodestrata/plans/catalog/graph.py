"""Graph queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import graph as G
from ..registry import query

T = 883_612_800_000  # 1998-01-01
_VALID = f"invalidated_at IS NULL AND (valid_from IS NULL OR valid_from <= {T}) AND (valid_to IS NULL OR {T} < valid_to)"


@query("g01_edges_valid_at", "edges", f"SELECT edge_id, source, target, weight FROM edges WHERE {_VALID}")
def _(t):
    return G.edges_valid_at(t.edges, T).select("edge_id", "source", "target", "weight")


@query("g02_edges_believed_at", "edges", f"SELECT edge_id, source, target, recorded_at FROM edges WHERE recorded_at <= {T} AND (invalidated_at IS NULL OR invalidated_at > {T})")
def _(t):
    return G.edges_believed_at(t.edges, T).select("edge_id", "source", "target", "recorded_at")


@query("g03_assertion_validity_at", "edges", f"""SELECT source, count(*) FILTER (invalidated_at IS NULL) AS active_edges,
  coalesce(bool_and({_VALID}) FILTER (invalidated_at IS NULL), false) AS valid FROM edges GROUP BY source""")
def _(t):
    return G.assertion_validity_at(t.edges, T)


_STEPS = """steps AS (SELECT source, target, max(weight) AS weight FROM (SELECT source, target, weight FROM edges WHERE weight > 0 AND invalidated_at IS NULL
  UNION ALL SELECT subject, object, 0.9 FROM triples) GROUP BY 1, 2)"""


def _steps(t):
    return t.edges.where("invalidated_at is null").select("source", "target", "weight").unionAll(t.triples.select(F.col("subject").alias("source"), F.col("object").alias("target"), F.lit(0.9).alias("weight")))


@query("g04_walk_outgoing", "edges triples", "SELECT start, node, round(max(weight), 6) AS weight FROM w WHERE node <> start GROUP BY start, node", _STEPS,
    """w AS (SELECT concat('c', c_custkey) AS start, concat('c', c_custkey) AS node, 1.0::DOUBLE AS weight, 0 AS hops FROM customer UNION ALL
    SELECT w.start, s.target, w.weight * s.weight * 0.7, hops + 1 FROM w JOIN steps s ON w.node = s.source WHERE hops < 3)""", recursive=True)
def _(t):
    starts = t.raw("customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return G.walk(_steps(t), starts).withColumn("weight", F.round("weight", 6))


@query("g04_walk_incoming", "edges triples", "SELECT start, node, round(max(weight), 6) AS weight FROM w WHERE node <> start GROUP BY start, node", _STEPS,
    """w AS (SELECT concat('p', p_partkey) AS start, concat('p', p_partkey) AS node, 1.0::DOUBLE AS weight, 0 AS hops FROM part UNION ALL
    SELECT w.start, s.source, w.weight * s.weight * 0.7, hops + 1 FROM w JOIN steps s ON w.node = s.target WHERE hops < 3)""", recursive=True)
def _(t):
    starts = t.raw("part").select(F.concat(F.lit("p"), "p_partkey").alias("start"))
    return G.walk(_steps(t), starts, reverse=True).withColumn("weight", F.round("weight", 6))


_PULL = {"provenance": ("A",), "abstraction": ("N",), "tension": ("R",)}


@query("g05_per_dimension_pull", None, """SELECT concat('p', l_partkey) AS target, round(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END), 4) AS provenance,
  round(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END), 4) AS abstraction, round(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END), 4) AS tension
  FROM lineitem GROUP BY l_partkey""")
def _(t):
    e = t.raw("lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("target"), F.col("l_returnflag").alias("kind"), F.col("l_quantity").alias("weight"), F.lit(None).cast("long").alias("invalidated_at"))
    return G.per_dimension_pull(e, _PULL)


_REACH = """reach AS (SELECT concat('r', r_regionkey) AS start, concat('r', r_regionkey) AS node, 0 AS depth FROM region
  UNION ALL SELECT start, target, depth + 1 FROM reach JOIN hierarchy ON node = source)"""


@query("g06_contains_closure", "hierarchy", "SELECT start, node, min(depth) AS depth FROM reach WHERE depth > 0 GROUP BY start, node", _REACH, recursive=True)
def _(t):
    return G.closure(t.hierarchy, t.raw("region").select(F.concat(F.lit("r"), "r_regionkey").alias("start")))


@query("g07_scope_expand", "hierarchy", "SELECT DISTINCT node AS node_id, 'customer' AS node_kind FROM reach WHERE start IN ('r1', 'r2') AND node LIKE 'c%' AND node IN (SELECT concat('c', c_custkey) FROM customer WHERE c_acctbal > 1000) ORDER BY 1 LIMIT 1000", _REACH, recursive=True)
def _(t):
    reach = G.closure(t.hierarchy, t.spark.createDataFrame([("r1",), ("r2",)], "start string")).select(F.col("node").alias("node_id"))
    rich = t.raw("customer").where("c_acctbal > 1000").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"))
    nodes = reach.distinct().withColumn("node_kind", F.when(F.col("node_id").startswith("c"), "customer").otherwise("other"))
    return G.scope_expand(nodes, [rich], ["customer"])


@query("g09_assertions_about", "triples", "SELECT subject, object, valid_from, o_orderpriority LIKE '1%' AS self_asserted FROM triples WHERE o_orderpriority LIKE '1%'")
def _(t):
    about = t.triples.withColumn("self_asserted", F.col("o_orderpriority").startswith("1"))
    return about.where("self_asserted").select("subject", "object", "valid_from", "self_asserted")


@query("g10_iam_roles", None, "SELECT c_mktsegment AS role, count(*) AS bindings, min(c_custkey) AS first_target FROM customer GROUP BY 1")
def _(t):
    return t.raw("customer").groupBy(F.col("c_mktsegment").alias("role")).agg(F.count(F.lit(1)).alias("bindings"), F.min("c_custkey").alias("first_target"))


@query("g11_drawer_span", "drawers", """SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')[3:7], ' ') AS span FROM drawers""")
def _(t):
    return t.drawers.select("doc_id", G.drawer_span(F.col("text"), F.lit(2), F.lit(7)).alias("span"))


@query("g12_forward_walk", "log", "SELECT start, node, min(depth) AS depth FROM f WHERE depth > 0 GROUP BY start, node",
    """nxt AS (SELECT DISTINCT node_id AS source, after AS target FROM (SELECT node_id, lead(node_id) OVER (ORDER BY "offset") AS after, event_type FROM log) WHERE after IS NOT NULL AND event_type = 'signup')""",
    """f AS (SELECT node_id AS start, node_id AS node, 0 AS depth FROM log UNION SELECT start, target, depth + 1 FROM f JOIN nxt ON node = source WHERE depth < 2)""", recursive=True)
def _(t):
    from pyspark.sql.window import Window

    after = t.raw("events").select(F.col("event_id").alias("offset"), F.col("user_id").alias("source"), "event_type")
    # the next event by dense offset is an equi-join, so no global window is needed
    nxt = after.where("event_type = 'signup'").join(after.select((F.col("offset") - 1).alias("offset"), F.col("source").alias("target")), "offset").select("source", "target").distinct()
    starts = t.log.select(F.col("node_id").alias("start")).distinct()
    return G.closure(nxt, starts, 2)


@query("g14_path_coherence", "log", """SELECT node_id, hops, dag_hops, round(dag_hops / hops * CASE WHEN full_triple THEN 1.0 ELSE 0.5 END * greatest(0.3, 1 - 0.05 * hops), 6) AS coherence FROM (
  SELECT node_id, count(*) AS hops, count(*) FILTER (event_type <> 'error') AS dag_hops, count(DISTINCT kind) = 4 AS full_triple FROM log GROUP BY node_id)""")
def _(t):
    p = t.log.groupBy("node_id").agg(F.count(F.lit(1)).alias("hops"), F.sum((F.col("event_type") != "error").cast("long")).alias("dag_hops"), (F.count_distinct("kind") == 4).alias("full"))
    return p.select("node_id", "hops", "dag_hops", F.round(G.path_coherence(F.col("dag_hops"), F.col("hops"), F.col("full")), 6).alias("coherence"))


_PREDICATES = ("placed", "pursues", "was_planned", "plans_to", "returned")


@query("g15_future_intent", "triples", "SELECT * FROM (SELECT subject, object, ['placed', 'pursues', 'was_planned', 'plans_to', 'returned'][CAST(o_orderpriority[1] AS INT)] AS predicate FROM triples) WHERE regexp_matches(lower(predicate), '" + "|".join(G.FUTURE_WORDS) + "')")
def _(t):
    predicate = F.get(F.array(*[F.lit(p) for p in _PREDICATES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    return G.future_intent(t.triples.select("subject", "object", predicate.alias("predicate")))


_DISCOURSE = """p AS (SELECT node_id AS node, count(*) FILTER (event_type = 'view') AS refines, count(*) FILTER (event_type = 'error') AS contradicts,
  round(count(*) FILTER (event_type = 'signup') / count(*), 6) AS supersedes_ratio,
  round(coalesce((count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'purchase')) / nullif(count(*) FILTER (event_type IN ('click', 'purchase')), 0), 0), 6) AS balance
  FROM log GROUP BY node_id)"""


def _patterns(t):
    kinds = F.create_map(*[F.lit(x) for p in {"view": "refines", "error": "contradicts", "signup": "supersedes", "click": "supports", "purchase": "inhibits"}.items() for x in p])
    return G.discourse_pattern(t.log.select(kinds[F.col("event_type")].alias("kind"), F.col("node_id").alias("source"), F.col("k").alias("target")))


@query("g16_discourse_pattern", "log", "SELECT * FROM p", _DISCOURSE)
def _(t):
    return _patterns(t)


@query("g16_refinement_chains", "log", "SELECT node, max(len) AS length FROM c GROUP BY node", "nxt AS (SELECT node_id AS node, min(k) AS next FROM log WHERE event_type = 'view' AND node_id <> k GROUP BY node_id)",
    "c AS (SELECT node, next, 1 AS len FROM nxt UNION ALL SELECT c.node, n.next, len + 1 FROM c JOIN nxt n ON n.node = c.next WHERE len < 16)", recursive=True)
def _(t):
    return G.refinement_chains(t.log.where("event_type = 'view'").select(F.col("node_id").alias("source"), F.col("k").alias("target")))


@query("g17_discourse_compare", "log", """SELECT a.node AS a, b.node AS b, round(1e-9 + (least(a.refines, b.refines) / greatest(a.refines, b.refines)
  + 0.5 * least(a.contradicts, b.contradicts) / greatest(a.contradicts, b.contradicts) + 0.5 * (1 - abs(a.supersedes_ratio - b.supersedes_ratio))
  + 1 - abs(a.balance - b.balance) / 2) / 3, 6) AS similarity FROM p a JOIN p b ON b.node = a.node + 1""", _DISCOURSE)
def _(t):
    p = _patterns(t)
    a = p.select(F.col("node").alias("a"), F.struct("*").alias("x"))
    b = p.select((F.col("node") - 1).alias("a"), F.col("node").alias("b"), F.struct("*").alias("y"))
    return a.join(b, "a").select("a", "b", F.round(G.compare_discourse("x", "y") + 1e-9, 6).alias("similarity"))


@query("g18_dependency_closure", "hierarchy", "SELECT DISTINCT node AS artifact FROM reach WHERE start IN ('r0', 'r3') AND depth > 0", _REACH, recursive=True)
def _(t):
    changed = t.spark.createDataFrame([("r0",), ("r3",)], "key string")
    return G.invalidated_keys(changed, t.hierarchy.select(F.col("target").alias("artifact"), F.col("source").alias("depends_on")))


@query("g19_invalidation_bridge", "edges", "SELECT DISTINCT target AS artifact FROM edges WHERE source IN (SELECT source FROM edges WHERE invalidated_at IS NOT NULL)")
def _(t):
    changed = t.edges.where("invalidated_at is not null").select(F.col("source").alias("key")).distinct()
    return G.invalidated_keys(changed, t.edges.select(F.col("target").alias("artifact"), F.col("source").alias("depends_on")))


@query("g20_identities", None, """WITH RECURSIVE c AS (SELECT s_name AS name, concat('m', s_nationkey % 7, '@x') AS email, s_suppkey % 5 AS repo FROM supplier),
  l AS (SELECT DISTINCT concat('e:', email) AS a, concat('n:', name) AS b FROM c),
  both_ AS (SELECT a, b FROM l UNION SELECT b, a FROM l), cc AS (SELECT a AS node, a AS comp FROM both_ UNION SELECT b, comp FROM cc JOIN both_ ON node = a),
  part AS (SELECT node, min(comp) AS component FROM cc GROUP BY node),
  owned AS (SELECT c.*, component FROM c JOIN part ON node = concat('n:', name)),
  best AS (SELECT component, arg_min(name, row(-n, name)) AS display FROM (SELECT component, name, count(*) AS n FROM owned GROUP BY 1, 2) GROUP BY component)
  SELECT display, CAST(sum(commits) AS BIGINT) AS commits, CAST(sum(emails) AS BIGINT) AS emails, max(repos) AS repos
  FROM (SELECT component, count(*) AS commits, count(DISTINCT email) AS emails, count(DISTINCT repo) AS repos FROM owned GROUP BY component) JOIN best USING (component) GROUP BY display""")
def _(t):
    s = t.raw("supplier")
    return G.identities(s.select(F.col("s_name").alias("name"), F.concat(F.lit("m"), F.col("s_nationkey") % 7, F.lit("@x")).alias("email"), (F.col("s_suppkey") % 5).alias("repo")))
