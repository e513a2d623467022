"""Incremental keyed views over the event log (batch form; the streaming forms fold the same way)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import DAY_MS, SPACE
from .fold import last_where, latest_wins, since_create

DEFAULT_HEAT, BUMP, HEAT_CAP, CANON_FLOOR, HEAT_HALF_LIFE = 0.5, 0.05, 1.0, 0.95, 30.0
NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"
SELF_ENTITY = "ent_self_self0000"


def current_nodes(events: DataFrame) -> DataFrame:
    """events: offset, kind, node_id, field, value (JSON text).  The state of each node since its last creation.

    Every set lands in ``properties`` (field to JSON text, the latest); a creation may set a field as well.  canonical and
    importance are lifted only from a boolean and a number; a canon_path that is no string is null.
    """
    live = since_create(events.where(F.col("kind").isin("node_created", "node_property_set")), "node_id", F.col("kind") == "node_created")
    last = live.groupBy("node_id", F.col("created").alias("created_offset"), "field").agg(
        F.max("offset").alias("modified"), last_where(F.col("value"), F.lit(True)).alias("value"),
        last_where(F.col("value"), F.col("value").isin("true", "false")).alias("flag"), last_where(F.col("value"), F.col("value").rlike(NUMBER)).alias("number"),
    )

    def of(name: str, value: Column) -> Column:
        return F.max(F.when(F.col("field") == name, value))

    return last.groupBy("node_id", "created_offset").agg(
        F.max("modified").alias("modified_offset"),
        F.coalesce(of("canonical", F.col("flag") == "true"), F.lit(False)).alias("canonical"),
        of("importance", F.col("number").cast("double")).alias("importance"),
        of("canon_path", F.when(F.col("value").startswith('"'), F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"])).alias("canon_path"),
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "value"))))).alias("properties"),
    )


def current_edges(events: DataFrame) -> DataFrame:
    """The state of each edge since its last creation; the last (in)validation after it decides."""
    live = since_create(events, "edge_id", F.col("kind") == "created")
    creates, changes = F.col("kind") == "created", F.col("kind") != "created"
    folded = live.groupBy("edge_id").agg(
        last_where(F.col("node_id"), creates).alias("source"), last_where(F.col("weight"), creates).alias("weight"),
        last_where(F.col("ts_ms"), creates).alias("recorded_at"), last_where(F.col("kind"), changes).alias("change"), last_where(F.col("ts_ms"), changes).alias("changed_at"),
    )
    return folded.select("edge_id", "source", "weight", "recorded_at", F.when(F.col("change") == "invalidated", F.col("changed_at")).alias("invalidated_at"))


def current_interpretations(log: DataFrame) -> DataFrame:
    sets = log.where("kind = 'node_property_set'").select("node_id", "field", "offset", "value", "ts_ms")
    return latest_wins(sets, ["node_id", "field"]).withColumn("interpretation_id", F.concat_ws("::", "node_id", "field"))


def current_schemas(induced: DataFrame) -> DataFrame:
    """induced: schema_id, offset, supersedes and more.  The latest induction of each schema."""
    return latest_wins(induced, ["schema_id"])


def active_schema_heads(schemas: DataFrame) -> DataFrame:
    """Schemas that no schema supersedes."""
    gone = schemas.where("supersedes is not null").select(F.col("supersedes").alias("schema_id")).distinct()
    return schemas.join(gone, "schema_id", "left_anti")


def heat_field(log: DataFrame, now_ms: int) -> DataFrame:
    """Heat per node: bumps since its last creation, decayed to now, floored while canonical."""
    kinds = F.col("kind").isin("node_created", "node_accessed") | ((F.col("kind") == "node_property_set") & (F.col("field") == "canonical"))
    touched = log.where(kinds)
    live = touched.join(touched.where("kind = 'node_created'").groupBy("node_id").agg(F.max("offset").alias("created")), "node_id", "left").where("created is null or offset >= created")
    first = F.col("kind").isin("node_created", "node_accessed")
    folded = live.groupBy("node_id").agg(
        F.sum(F.when(F.col("kind") == "node_accessed", 1).otherwise(0)).alias("accesses"),
        last_where(F.col("ts_ms"), first).alias("anchor"),
        F.min(F.when(first, F.col("offset"))).alias("begun"),
        last_where(F.col("value") >= 30, F.col("kind") == "node_property_set").alias("flag"),
        F.max(F.when(F.col("kind") == "node_property_set", F.col("offset"))).alias("flagged"),
    ).where("begun is not null")
    at_anchor = F.least(F.lit(HEAT_CAP), F.lit(DEFAULT_HEAT) + F.lit(BUMP) * F.col("accesses"))
    decayed = at_anchor * F.exp(-(F.lit(float(now_ms)) - F.col("anchor")) / DAY_MS * F.log(F.lit(2.0)) / HEAT_HALF_LIFE)
    canonical = F.coalesce(F.col("flag") & (F.col("flagged") > F.col("begun")), F.lit(False))
    heat = F.when(canonical, F.greatest(F.lit(CANON_FLOOR), decayed)).otherwise(decayed)
    return folded.select("node_id", "accesses", F.col("anchor").alias("anchor_ms"), canonical.alias("canonical"), F.round(heat, 6).alias("heat"))


def velocity_field(log: DataFrame, now_ms: int) -> DataFrame:
    """Access counts in trailing windows and their change against the window before."""
    t, day = F.col("ts_ms"), DAY_MS
    accesses = log.where("kind = 'node_accessed'").where((t <= now_ms) & (t >= now_ms - 90 * day))

    def count(lo: int, hi: int, closed: bool) -> Column:
        inside = (t >= now_ms - lo * day) & ((t <= now_ms - hi * day) if closed else (t < now_ms - hi * day))
        return F.sum(inside.cast("long"))

    c = accesses.groupBy("node_id").agg(count(7, 0, True).alias("c7"), count(14, 7, False).alias("p7"), count(30, 0, True).alias("c30"), count(60, 30, False).alias("p30"), count(90, 0, True).alias("c90"))
    v7 = F.when(F.col("p7") == 0, F.col("c7").cast("double")).otherwise((F.col("c7") - F.col("p7")) / F.col("p7"))
    v30 = F.when(F.col("p30") == 0, F.col("c30") / 30).otherwise((F.col("c30") - F.col("p30")) / F.col("p30"))
    return c.select("node_id", "c7", "p7", "c30", "c90", F.round(v7, 6).alias("velocity_7d"), F.round(v30, 6).alias("velocity_30d"), F.round(F.col("c90") / 90, 6).alias("velocity_90d"))


def recurrence_clusters(members: DataFrame) -> DataFrame:
    """members: cluster_id, drawer_id, offset.  Distinct members in order of first sight."""
    first = members.groupBy("cluster_id", "drawer_id").agg(F.min("offset").alias("first"), F.max("offset").alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("first", "drawer_id")))
    return first.groupBy("cluster_id").agg(
        F.min_by("drawer_id", "first").alias("representative"), F.count(F.lit(1)).alias("n_members"), F.min("first").alias("first_offset"), F.max("last").alias("last_offset"),
        F.array_join(F.transform(ordered, lambda x: x["drawer_id"].cast("string")), ",").alias("members"),
    )


def active_periods(log: DataFrame) -> DataFrame:
    """Periods opened by sign-ups; purchases set state, ended_at or precedence."""
    live = since_create(log.where("event_type in ('signup', 'purchase')"), "node_id", F.col("event_type") == "signup")
    is_set, slot = F.col("event_type") == "purchase", F.col("k") % 3
    return live.groupBy(F.col("node_id").alias("period_id")).agg(
        F.coalesce(last_where(F.when(F.col("value") >= 30, "closed").otherwise("open"), is_set & (slot == 0)), F.lit("open")).alias("state"),
        last_where(F.col("ts_ms"), is_set & (slot == 1)).alias("ended_at"),
        F.coalesce(last_where(F.col("k"), is_set & (slot == 2)), last_where(F.col("k"), ~is_set)).alias("precedence"),
    )


def open_or_recent(periods: DataFrame, now_ms: int, days: int = 7) -> DataFrame:
    return periods.where((F.col("state") == "open") | (F.col("ended_at") >= now_ms - days * DAY_MS))


def active_iams(edges: DataFrame) -> DataFrame:
    """edges: edge_id, kind, source, target, invalidated_at.  Live role bindings of the self entity."""
    return edges.where((F.col("kind") == "role_in_period") & (F.col("source") == SELF_ENTITY) & F.col("invalidated_at").isNull())


def canon_set(log: DataFrame) -> DataFrame:
    """Nodes whose last canonical flag is true, with their last path; paths before the first creation or flag are dropped."""
    kinds = (F.col("kind") == "node_created") | ((F.col("kind") == "node_property_set") & F.col("field").isin("canonical", "canon_path"))
    flagged = (F.col("kind") == "node_property_set") & (F.col("field") == "canonical")
    created = F.col("kind") == "node_created"
    sets = log.where(kinds)
    begun = sets.where(created | (flagged & (F.col("value") >= 30))).groupBy("node_id").agg(F.max(F.when(created, F.col("offset"))).alias("created"), F.min("offset").alias("begun"))
    live = sets.join(begun, "node_id").where("offset >= coalesce(created, begun)")
    path = (F.col("kind") == "node_property_set") & (F.col("field") == "canon_path")
    folded = live.groupBy("node_id").agg(
        last_where(F.col("value") >= 30, flagged).alias("canonical"),
        last_where(F.concat(F.lit("p"), F.col("k")), path).alias("canon_path"),
        F.max(F.when(created | (flagged & (F.col("value") >= 30)), F.col("offset"))).alias("since_offset"),
    )
    return folded.where("canonical").select("node_id", "canon_path", "since_offset")


def open_contradictions(events: DataFrame) -> DataFrame:
    """Asserted edges that were never resolved."""
    asserted = events.where("kind = 'asserted'").groupBy("edge_id").agg(F.max("offset").alias("asserted_offset"), F.count(F.lit(1)).alias("times"))
    return asserted.join(events.where("kind = 'resolved'").select("edge_id").distinct(), "edge_id", "left_anti")


REVIEW = {"view": "proposal", "click": "schema", "purchase": "collision", "error": "contradiction"}


def pending_review(log: DataFrame) -> DataFrame:
    """Items by category and reference; a resolution (sign-up) removes the contradiction of the same reference."""
    category = F.create_map(*[F.lit(x) for p in REVIEW.items() for x in p])[F.col("event_type")]
    ref = F.when(F.col("k") % 4 == 0, F.concat(F.lit("edge"), F.col("node_id"))).otherwise(F.concat(F.lit("node"), F.col("node_id")))
    ops = log.select(F.coalesce(category, F.lit("contradiction")).alias("category"), ref.alias("ref"), "offset", (F.col("event_type") != "signup").alias("added"))
    last = latest_wins(ops, ["category", "ref"]).where("added")
    return last.select(F.concat_ws("_", F.lit("pri"), "category", "ref").alias("item_id"), "category", "ref", F.col("offset").alias("added_offset"))


def iso_week(ms: Column) -> Column:
    at = F.timestamp_millis(ms)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), at).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(at).cast("string"), 2, "0"))


def match_cache(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Completed matches, keyed for look-up by requester, target and ISO week."""
    done = requests.join(findings, "match_id").withColumn("window_key", iso_week(F.col("completed_at")))
    return done.withColumn("cache_key", F.concat_ws("|", "requester", "target", "window_key"))


def matched_against(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Every request, with its completion if there is one."""
    return requests.join(findings.select("match_id", "completed_at"), "match_id", "left")


def count_in_window(ledger: DataFrame, now_ms: int, window_ms: int) -> DataFrame:
    return ledger.groupBy("requester").agg(F.sum(((F.col("requested_at") > now_ms - window_ms) & (F.col("requested_at") <= now_ms)).cast("long")).alias("in_window"), F.count(F.lit(1)).alias("requests"))


def invalidation_set(log: DataFrame) -> DataFrame:
    """Nodes whose last (in)validation event invalidates; sign-ups revalidate."""
    events = log.where("event_type in ('error', 'signup')").select("node_id", "offset", "event_type", "ts_ms")
    return latest_wins(events, ["node_id"]).where("event_type = 'error'").select("node_id", F.col("offset").alias("since_offset"))


def content_hash(text: Column) -> Column:
    return F.sha2(F.btrim(text, F.lit(" \t\n\r\f\x0b")).cast("binary"), 256)


def collisions(drawers: DataFrame) -> DataFrame:
    """One row for each later drawer and the first with its content: star pairs, so copies give no all-pairs join."""
    hashed = drawers.select("doc_id", content_hash(F.col("text")).alias("content_hash"))
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    return hashed.join(first, "content_hash").where("doc_id <> first_id").select("doc_id", "first_id", "content_hash", (F.col("copies") - 1).alias("others"))


def subscriber_tick(log: DataFrame, consumers: DataFrame, batch: int = 256) -> DataFrame:
    """consumers: consumer_id, kind (null: all), at.  After one tick: events handled, the new offset, and the lag."""
    head = log.agg(F.max("offset").alias("head"))
    matched = log.select("offset", F.col("kind").alias("event_kind")).join(F.broadcast(consumers), (F.col("offset") > F.col("at")) & (F.col("offset") <= F.col("at") + batch))
    done = matched.groupBy("consumer_id").agg(F.sum((F.col("kind").isNull() | (F.col("event_kind") == F.col("kind"))).cast("long")).alias("handled"), F.max("offset").alias("new_at"))
    out = consumers.join(done, "consumer_id", "left").join(F.broadcast(head))
    new_at = F.coalesce("new_at", "at")
    return out.select("consumer_id", F.coalesce("handled", F.lit(0)).alias("handled"), new_at.alias("offset"), (F.col("head") - new_at).alias("lag"))


def words_of(text: Column) -> Column:
    return F.split(text, SPACE)
