"""Operators that need a loop on the driver over distributed frontiers, and extraction passes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SPACE, contains_any, count_contained, first_max, preview
from ..plans.settle import settle


def build_events(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """Node creations as log rows: kind, node_id and the other columns as properties."""
    rest = [c for c in rows.columns if c != key]
    return rows.select(F.lit("node_created").alias("kind"), F.lit(kind).alias("node_kind"), F.col(key).cast("string").alias("node_id"), F.to_json(F.struct(*rest)).alias("properties"))


def assertion_events(triples: DataFrame) -> DataFrame:
    """Each triple as a node and its subject, object and source edges."""
    node = F.concat_ws("-", F.lit("asr"), "subject", "predicate", "object")
    edges = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("target")) for k, c in (("asserted_subject", "subject"), ("asserted_object", "object"), ("derived_from", "source"))])
    return triples.select(node.alias("assertion"), F.inline(F.filter(edges, lambda e: e["target"].isNotNull())))


def beam_traverse(edges: DataFrame, seeds: DataFrame, regions: DataFrame, beam: int = 8, max_hops: int = 4) -> DataFrame:
    """edges: source, target, cost; seeds: node; regions: node, region (past, present, future).

    Cheapest paths by a beam of frontiers; a path is whole when it has touched three regions.  Each round holds at most
    ``beam`` paths a seed, which is the operator's definition.
    """
    touched = regions.groupBy("node").agg(F.collect_set("region").alias("here"))
    paths = seeds.select(F.col("node").alias("seed"), F.col("node"), F.array("node").alias("path"), F.lit(0.0).alias("cost")).join(touched, "node", "left")
    paths = settle(paths.withColumn("seen", F.coalesce("here", F.array().cast("array<string>"))).drop("here"))
    done = paths
    for _ in range(max_hops):
        step = paths.join(edges.select(F.col("source").alias("node"), "target", F.col("cost").alias("hop")), "node").where(~F.array_contains("path", F.col("target")))
        grown = step.select("seed", F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"), (F.col("cost") + F.col("hop")).alias("cost"), "seen").join(touched, "node", "left")
        grown = grown.withColumn("seen", F.array_union("seen", F.coalesce("here", F.array().cast("array<string>")))).drop("here")
        w = Window.partitionBy("seed").orderBy("cost", F.array_join("path", ">"))
        paths = settle(grown.withColumn("r", F.row_number().over(w)).where(F.col("r") <= beam).drop("r"))
        done = done.unionByName(paths)
    return done.select("seed", F.array_join("path", ">").alias("path"), F.round("cost", 6).alias("cost"), (F.size("seen") >= 3).alias("whole"), (F.size("path") - 1).alias("hops"))


def walk_driver(frames: Callable[[int], DataFrame], policy: Callable[[DataFrame], DataFrame], max_steps: int = 256) -> list[dict]:
    """Runs a policy step by step until it ends the walk; one audit entry a step."""
    audit = []
    for i in range(max_steps):
        row = policy(frames(i)).first()
        if row is None:
            break
        audit.append({"step": i, "directive": row["step"]})
        if row["step"].startswith("terminate"):
            break
    return audit


def full_turns(turns: DataFrame, by: str, order: str) -> DataFrame:
    """Whole conversations as one document each, both roles in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct(order, "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"]))
    return turns.groupBy(by).agg(F.array_join(line, "\n").alias("text"), F.count(F.lit(1)).alias("turns"))


def accumulate_handles(hops: DataFrame) -> DataFrame:
    """hops: handle, i, node, frame.  The audit snapshot of each handle."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "node"))), lambda x: x["node"].cast("string"))
    return hops.groupBy("handle").agg(F.array_join(ordered, ">").alias("path"), F.count_distinct("frame").alias("frames"), F.count(F.lit(1)).alias("hops"))


# Words around names of persons and of projects.
PERSON_VERBS = ("said", "told", "asked", "thinks", "wants", "loves", "hates", "knows", "decided", "laughed")
PROJECT_VERBS = ("building", "built", "shipped", "launched", "deployed", "installed", "uses", "version")


def detect_entities(docs: DataFrame, least: int = 3) -> DataFrame:
    """Frequent capitalised words, by whether verbs of persons or of projects follow them more often."""
    words = docs.select(F.posexplode(F.split("text", SPACE)).alias("i", "w"), "doc_id")
    w = Window.partitionBy("doc_id").orderBy("i")
    near = words.withColumn("after", F.lower(F.lead("w").over(w))).withColumn("name", F.regexp_extract("w", r"^([A-Z][a-z]{2,15})\W*$", 1)).where("name <> ''")
    s = near.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("after").isin(*PERSON_VERBS).cast("long")).alias("person"), F.sum(F.col("after").isin(*PROJECT_VERBS).cast("long")).alias("project"))
    kind = F.when(F.col("person") > F.col("project"), "person").when(F.col("project") > F.col("person"), "project").otherwise("uncertain")
    return s.where(F.col("n") >= least).withColumn("kind", kind)


# Markers of memory types.
MARKERS = {
    "decision": ("decided", "chose", "went with", "instead of", "because"), "preference": ("prefer", "always use", "never use", "i like", "i hate"), "milestone": ("works now", "shipped", "finally", "launched", "it works"),
    "problem": ("bug", "error", "broken", "crash", "fails"), "emotional": ("feel", "scared", "proud", "love", "hurt"),
}
RESOLVED = ("fixed", "solved", "resolved", "works now")


def extract_memories(docs: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Paragraphs with the memory type whose markers they hold most; a resolved problem is a milestone."""
    parts = docs.select(key, F.posexplode(F.filter(F.split("text", "\n+"), lambda p: F.length(F.trim(p)) >= least)).alias("chunk", "text"))
    low = F.lower("text")
    kind = first_max([(k, count_contained(low, w)) for k, w in MARKERS.items()], "none")
    return parts.select(key, "chunk", F.when((kind == "problem") & contains_any(low, RESOLVED), "milestone").otherwise(kind).alias("kind"))


def locale_patterns(locales: dict[str, dict[str, list[str]]], unicode: bool = True) -> dict[str, str]:
    """One alternation a kind over all locales, each pattern once, with word boundaries where its ends are word characters."""
    merged: dict[str, list[str]] = {}
    for kinds in locales.values():
        for kind, words in kinds.items():
            merged.setdefault(kind, []).extend(w for w in words if w not in merged.get(kind, []))
    edge = lambda w: ("\\b" if w[:1].isalnum() else "") + w + ("\\b" if w[-1:].isalnum() else "")
    return {k: ("(?U)(" if unicode else "(") + "|".join(edge(w) for w in ws) + ")" for k, ws in merged.items()}


def match_patterns(docs: DataFrame, key: str, patterns: dict[str, str]) -> DataFrame:
    return docs.select(key, *[F.regexp_count("text", F.lit(p)).cast("long").alias(k) for k, p in patterns.items()])


def top_affects(distribution: Column, k: int = 3) -> Column:
    """distribution: array of (label, p).  The k most likely labels."""
    ordered = F.array_sort(F.transform(distribution, lambda x: F.struct((-x["p"]).alias("o"), x["label"].alias("label"))))
    return F.array_join(F.transform(F.slice(ordered, 1, k), lambda x: x["label"]), ",")


def latest_models(registry: DataFrame) -> DataFrame:
    """registry: model, model_class, offset, revoked.  The last live model of each class."""
    last = registry.groupBy("model", "model_class").agg(F.max_by("revoked", "offset").alias("revoked"), F.max("offset").alias("offset"))
    return last.where(~F.col("revoked")).groupBy("model_class").agg(F.max_by("model", "offset").alias("model"), F.count(F.lit(1)).alias("live"))


def briefing(drawers: DataFrame, identity: str) -> DataFrame:
    """The identity line and the essential drawers as text, in order."""
    from .store import essential_layer

    best = essential_layer(drawers).join(drawers.select("doc_id", "text"), "doc_id")
    lines = best.select(F.lit(1).alias("layer"), F.col("used").alias("place"), F.concat(F.lit("["), "room", F.lit("] "), preview(F.col("text"))).alias("line"))
    first = drawers.sparkSession.createDataFrame([(0, 0, identity)], "layer int, place long, line string")
    return first.unionByName(lines)
