"""Log operations: validation, replay, batches and recovery, frontiers, erasure, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fold import dense_numbers

CHUNK_DRAWERS, CHUNK_BYTES = 1000, 50_000_000


def codes(*rules: tuple[str, Column]) -> Column:
    """Names of the rules that a row breaks; a null condition is no breach."""
    return F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())


def edge_errors() -> Column:
    """Breaches of an edge with valid_from, valid_to, weight and confidence."""
    return codes(
        ("invalid_validity_range", F.col("valid_to") < F.col("valid_from")),
        ("weight_negative", F.col("weight") < 0),
        ("confidence_out_of_range", (F.col("confidence") < 0) | (F.col("confidence") > 1)),
        ("missing_source", F.coalesce(F.col("source"), F.lit("")) == ""),
    )


def drawer_errors() -> Column:
    return codes(
        ("bad_content_hash", F.length("content_hash") != 64),
        ("negative_duration", F.col("duration_ms") < 0),
        ("bad_enum_value", ~F.col("self_other_world").isin("self", "other", "world")),
    )


def node_errors() -> Column:
    return codes(
        ("canonical_node_without_canon_path", F.col("canonical") & F.col("canon_path").isNull()),
        ("importance_out_of_range", (F.col("importance") < 0) | (F.col("importance") > 1)),
    )


def append_validated(events: DataFrame, errors: Column) -> DataFrame:
    """The log after an append: invalid events are stored as rejections in place of themselves."""
    checked = events.withColumn("errors", errors)
    bad = F.size("errors") > 0
    return checked.withColumn("kind", F.when(bad, F.lit("append_rejected")).otherwise(F.col("kind")))


def endpoint_violations(edges: DataFrame, nodes: DataFrame, allowed: DataFrame) -> DataFrame:
    """edges: kind, source, target; nodes: node_id, node_kind; allowed: kind, source_kind, target_kind (a fixed, small table)."""
    named = edges.join(nodes.select(F.col("node_id").alias("source"), F.col("node_kind").alias("source_kind")), "source").join(nodes.select(F.col("node_id").alias("target"), F.col("node_kind").alias("target_kind")), "target")
    return named.join(F.broadcast(allowed), ["kind", "source_kind", "target_kind"], "left_anti")


def read_range(log: DataFrame, start: int, end: int) -> DataFrame:
    return log.where((F.col("offset") >= start) & (F.col("offset") < end)).orderBy("offset")


def snapshot(log: DataFrame, at: int) -> DataFrame:
    """Per node: how often it was accessed, and when last, up to an offset."""
    return log.where(F.col("offset") <= at).where("kind = 'node_accessed'").groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))


def resume(base: DataFrame, log: DataFrame, at: int) -> DataFrame:
    """A snapshot folded with the tail of the log after it."""
    tail = log.where((F.col("offset") > at) & (F.col("kind") == "node_accessed")).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("last"))
    return base.unionByName(tail).groupBy("node_id").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


def should_snapshot(log: DataFrame, last: int, last_ms: int, max_events: int = 10_000, max_ms: int = 86_400_000, min_ms: int = 3_600_000, trigger: str | None = None) -> DataFrame:
    since = log.where(F.col("offset") > last)
    a = since.agg(F.count(F.lit(1)).alias("events"), F.max("ts_ms").alias("now"), F.sum((F.col("kind") == F.lit(trigger)).cast("long")).alias("triggers"))
    age = F.col("now") - last_ms
    due = (age >= max_ms) | ((age >= min_ms) & ((F.col("events") >= max_events) | (F.coalesce("triggers", F.lit(0)) > 0)))
    return a.select("events", age.alias("age_ms"), F.coalesce(due, F.lit(False)).alias("due"))


def open_batches(markers: DataFrame) -> DataFrame:
    """markers: consumer, batch, marker (started, committed, aborted, checkpointed), offset.  Batches begun and neither committed nor aborted."""
    started = markers.where("marker = 'started'").select("consumer", "batch", F.col("offset").alias("start"))
    closed = markers.where("marker in ('committed', 'aborted')").select("consumer", "batch")
    points = markers.where("marker = 'checkpointed'").groupBy("consumer", "batch").agg(F.max("offset").alias("checkpoint"))
    torn = started.join(closed, ["consumer", "batch"], "left_anti").join(points, ["consumer", "batch"], "left")
    return torn.withColumn("safe", F.coalesce("checkpoint", F.col("start") - 1))


def committed_frontiers(markers: DataFrame, head: DataFrame) -> DataFrame:
    """Per consumer: the head, or the least safe offset of its open batches.  head: one row, ``head``."""
    least = open_batches(markers).groupBy("consumer").agg(F.min("safe").alias("safe"))
    all_ = markers.select("consumer").distinct().join(least, "consumer", "left")
    return all_.join(F.broadcast(head)).select("consumer", F.coalesce("safe", "head").alias("frontier"))


def recovery_aborts(markers: DataFrame) -> DataFrame:
    return open_batches(markers).select("consumer", "batch", F.lit("aborted").alias("marker"), F.lit("torn").alias("reason"), F.col("safe").alias("partial_to"))


def quarantine(rows: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows of torn batches dropped."""
    return rows.join(open_batches(markers).select("batch"), "batch", "left_anti")


def consistent_read(log: DataFrame, frontiers: DataFrame) -> DataFrame:
    """Events up to the meet of all frontiers."""
    meet = frontiers.agg(F.min("frontier").alias("meet"))
    return log.join(F.broadcast(meet), F.col("offset") <= F.col("meet")).drop("meet")


def erase(events: DataFrame, target: str) -> DataFrame:
    """events: offset, kind, node_id, source, target.  Payloads that refer to the target become tombstones."""
    hit = F.coalesce(F.col("node_id") == target, F.lit(False)) | F.coalesce(F.col("source") == target, F.lit(False)) | F.coalesce(F.col("target") == target, F.lit(False))
    gone = [F.when(hit, F.lit(None)).otherwise(F.col(c)).alias(c) for c in ("node_id", "source", "target")]
    return events.select("offset", "kind", *gone, hit.alias("erased"))


def export_estimate(drawers: DataFrame, per_chunk: int = CHUNK_DRAWERS) -> DataFrame:
    return drawers.agg(F.count(F.lit(1)).alias("drawers"), F.sum(F.octet_length("text")).alias("bytes"), F.ceil(F.count(F.lit(1)) / per_chunk).alias("chunks"))


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """One page after a cursor, by key."""
    return df.where(F.col(key) > after).orderBy(key).limit(min(size, 1000))


def topology_stats(nodes: DataFrame, kind: str, invalid: str) -> DataFrame:
    return nodes.groupBy(kind).agg(F.count(F.lit(1)).alias("all"), F.sum(F.col(invalid).cast("long")).alias("invalidated"), F.sum((~F.col(invalid)).cast("long")).alias("active"))


def missing_vectors(drawers: DataFrame, vectors: DataFrame) -> DataFrame:
    return drawers.join(vectors.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def convert(themes: DataFrame, periods: DataFrame, drawers: DataFrame, triples: DataFrame) -> DataFrame:
    """Tables of a legacy store as events in one stable order: themes, periods, drawers, triples; within each by id."""
    parts = [(themes, "theme"), (periods, "period"), (drawers, "drawer"), (triples, "triple")]
    out = None
    for rank, (df, kind) in enumerate(parts):
        rows = df.select(F.lit(rank).alias("phase"), F.lit(f"{kind}_created").alias("kind"), F.col("id").cast("string").alias("id"))
        out = rows if out is None else out.unionByName(rows)
    return dense_numbers(out, ["phase", "id"], "offset").select("offset", "kind", "id")


def invariant(name: str, rows: DataFrame, subject: str) -> DataFrame:
    return rows.select(F.lit(name).alias("invariant"), F.col(subject).cast("string").alias("subject"))


def reconcile_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Row counts of two stores by key, side by side."""
    x = a.groupBy(key).agg(F.count(F.lit(1)).alias("n_a"))
    y = b.groupBy(key).agg(F.count(F.lit(1)).alias("n_b"))
    both = x.join(y, key, "full_outer").na.fill(0, ["n_a", "n_b"])
    return both.withColumn("diff", F.col("n_a") - F.col("n_b"))
