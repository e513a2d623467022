"""Bitemporal edges, bounded walks, closures and components, as joins over frontiers.

Iterations hold only (node, state) rows, are checkpointed each round, and stop when nothing new is reached.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settle import settle

# Words that point a predicate at a future state.
FUTURE_WORDS = ("pursues", "aimed_at", "intends", "wants", "plans", "goal", "aspires_to", "will", "expects")


def valid_at(t: int) -> Column:
    """Half-open world-time validity; an invalidated edge is never valid."""
    return F.col("invalidated_at").isNull() & (F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t))


def edges_valid_at(edges: DataFrame, t: int) -> DataFrame:
    return edges.where(valid_at(t))


def edges_believed_at(edges: DataFrame, s: int) -> DataFrame:
    return edges.where((F.col("recorded_at") <= s) & (F.col("invalidated_at").isNull() | (F.col("invalidated_at") > s)))


def assertion_validity_at(edges: DataFrame, t: int) -> DataFrame:
    """Per source: whether it has active edges and all of them are valid at t."""
    active = F.col("invalidated_at").isNull()
    ok = F.bool_and(F.when(active, valid_at(t)))
    return edges.groupBy("source").agg(F.sum(active.cast("long")).alias("active_edges"), F.coalesce(ok, F.lit(False)).alias("valid"))


def walk(edges: DataFrame, starts: DataFrame, max_hops: int = 3, decay: float = 0.7, reverse: bool = False) -> DataFrame:
    """Best product of weights times decay**hops over walks of at most ``max_hops`` edges.

    edges: source, target, weight; starts: start.  Result: start, node, weight, without the starts themselves.
    """
    here, there = ("target", "source") if reverse else ("source", "target")
    step = edges.where("weight > 0").groupBy(F.col(here).alias("at"), F.col(there).alias("to")).agg(F.max("weight").alias("w"))
    frontier = starts.select("start", F.col("start").alias("node"), F.lit(1.0).alias("weight"))
    reached = None
    for _ in range(max_hops):
        # the best walk of each length; only the frontier is kept between hops
        pushed = frontier.join(step, F.col("node") == F.col("at")).groupBy("start", F.col("to").alias("node")).agg(F.max(F.col("weight") * F.col("w") * decay).alias("weight"))
        frontier = settle(pushed)
        reached = frontier if reached is None else reached.unionByName(frontier)
    best = (frontier if reached is None else reached).groupBy("start", "node").agg(F.max("weight").alias("weight"))
    return best.where("node <> start")


def closure(edges: DataFrame, starts: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) of all nodes reachable over source -> target; the start only if reached again."""
    step = edges.select(F.col("source").alias("at"), F.col("target").alias("to")).distinct()
    seen = settle(starts.select("start", F.col("start").alias("at")).join(step, "at").select("start", F.col("to").alias("node"), F.lit(1).alias("depth")).distinct())
    frontier, depth = seen, 1
    while (max_depth is None or depth < max_depth) and not frontier.isEmpty():
        depth += 1
        nxt = frontier.join(step, F.col("node") == F.col("at")).select("start", F.col("to").alias("node")).distinct()
        frontier = settle(nxt.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        seen = settle(seen.unionByName(frontier))
    return seen


def per_dimension_pull(edges: DataFrame, kinds: dict[str, tuple[str, ...]]) -> DataFrame:
    """Inbound active weight of each target by dimension."""
    sums = [F.round(F.sum(F.when(F.col("kind").isin(*ks), F.col("weight")).otherwise(0.0)), 4).alias(name) for name, ks in kinds.items()]
    return edges.where("invalidated_at is null").groupBy("target").agg(*sums)


def scope_expand(nodes: DataFrame, reaches: list[DataFrame], kinds: list[str] | None = None, limit: int = 1000) -> DataFrame:
    """Nodes within every reach (none: all), of the given kinds; in order of id and capped only beyond ``limit``, as the feature is defined."""
    out = nodes
    for r in reaches:
        out = out.join(r.select("node_id").distinct(), "node_id", "left_semi")
    if kinds:
        out = out.where(F.col("node_kind").isin(*kinds))
    return out.orderBy("node_id").limit(limit)


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node of each connected component of (a, b) links."""
    both = settle(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = settle(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("component")))
    while True:
        near = both.join(state, both["a"] == state["node"]).groupBy(F.col("b").alias("n")).agg(F.min("component").alias("near"))
        step = state.join(near, state["node"] == near["n"], "left").select("node", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        over = state.select(F.col("node").alias("j"), F.col("component").alias("over"))
        new = settle(step.join(over, step["next"] == over["j"], "left").select("node", F.least("next", "over").alias("component"), "was"))
        state = new.select("node", "component")
        if new.where("component < was").isEmpty():
            return state


def identities(commits: DataFrame) -> DataFrame:
    """commits: name, email, repo.  People as components of names and emails; the most frequent full name stands for each."""
    links = commits.select(F.concat(F.lit("e:"), "email").alias("a"), F.concat(F.lit("n:"), "name").alias("b")).distinct()
    part = components(links)
    owned = commits.join(part.select(F.col("node").alias("key"), "component"), F.concat(F.lit("n:"), "name") == F.col("key"))
    names = owned.groupBy("component", "name").agg(F.count(F.lit(1)).alias("n")).where(F.col("name").rlike("^[A-Z][A-Za-z#0-9]+"))
    best = names.groupBy("component").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("display"))
    stats = owned.groupBy("component").agg(F.count(F.lit(1)).alias("commits"), F.count_distinct("email").alias("emails"), F.count_distinct("repo").alias("repos"))
    return stats.join(best, "component").groupBy("display").agg(F.sum("commits").alias("commits"), F.sum("emails").alias("emails"), F.max("repos").alias("repos"))


def path_coherence(dag_hops: Column, hops: Column, full: Column) -> Column:
    """dag share x (1 if the full triple was touched, else 0.5) x max(0.3, 1 - 0.05 hops); 0 without hops."""
    return F.when(hops == 0, F.lit(0.0)).otherwise(dag_hops / hops * F.when(full, 1.0).otherwise(0.5) * F.greatest(F.lit(0.3), 1 - 0.05 * hops))


def future_intent(assertions: DataFrame) -> DataFrame:
    return assertions.where(F.lower("predicate").rlike("|".join(FUTURE_WORDS)))


def drawer_span(text: Column, start: Column, end: Column) -> Column:
    """Words [start, end) of a text."""
    from ..functions.columns import SPACE

    return F.array_join(F.slice(F.array_remove(F.split(text, SPACE), ""), start + 1, end - start), " ")


def discourse_pattern(edges: DataFrame) -> DataFrame:
    """edges: kind, source, target (refines, contradicts, supersedes, supports, inhibits).  Balance per source node."""
    out = edges.groupBy(F.col("source").alias("node"))

    def n(kind):
        return F.sum((F.col("kind") == kind).cast("long"))

    return out.agg(n("refines").alias("refines"), n("contradicts").alias("contradicts"), n("supersedes").alias("supersedes"), n("supports").alias("supports"), n("inhibits").alias("inhibits"), F.count(F.lit(1)).alias("total")).select(
        "node", "refines", "contradicts",
        F.round(F.col("supersedes") / F.col("total"), 6).alias("supersedes_ratio"),
        F.round(F.when(F.col("supports") + F.col("inhibits") == 0, 0.0).otherwise((F.col("supports") - F.col("inhibits")) / (F.col("supports") + F.col("inhibits"))), 6).alias("balance"),
    )


def refinement_chains(edges: DataFrame, doublings: int = 4) -> DataFrame:
    """edges: source, target, of refinements.  Steps from each node along its first refinements, at most 2 ** doublings, by pointer doubling."""
    state = settle(edges.where("source <> target").groupBy(F.col("source").alias("node")).agg(F.min("target").alias("next"), F.lit(1).alias("length")))
    for _ in range(doublings):
        onward = state.select(F.col("node").alias("via"), F.col("next").alias("beyond"), F.col("length").alias("more"))
        joined = state.join(onward, F.col("next") == F.col("via"), "left")
        state = settle(joined.select("node", F.when(F.col("via").isNull(), F.col("next")).otherwise(F.col("beyond")).alias("next"), (F.col("length") + F.coalesce("more", F.lit(0))).alias("length")))
    return state.select("node", "length")


def compare_discourse(a: str, b: str) -> Column:
    """Mean of count closeness, ratio closeness and balance closeness of two patterns (struct columns)."""
    x, y = F.col(a), F.col(b)
    lo, hi = F.least(x["contradicts"], y["contradicts"]), F.greatest(x["contradicts"], y["contradicts"])
    counts = F.when(hi == 0, F.lit(1.0)).otherwise(lo / hi)
    c = 0.5 * counts + 0.5 * (1 - F.abs(x["supersedes_ratio"] - y["supersedes_ratio"]))
    refine_lo, refine_hi = F.least(x["refines"], y["refines"]), F.greatest(x["refines"], y["refines"])
    r = F.when(refine_hi == 0, F.lit(1.0)).otherwise(refine_lo / refine_hi)
    return (r + c + (1 - F.abs(x["balance"] - y["balance"]) / 2)) / 3


def invalidated_keys(changed: DataFrame, dependencies: DataFrame) -> DataFrame:
    """dependencies: artifact, depends_on.  Everything that transitively depends on a changed key."""
    edges = dependencies.select(F.col("depends_on").alias("source"), F.col("artifact").alias("target"))
    return closure(edges, changed.select(F.col("key").alias("start"))).select(F.col("node").alias("artifact")).distinct()
