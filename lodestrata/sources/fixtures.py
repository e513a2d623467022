"""Events of the driver's log read as events of the engine: which type means what, and where its fields come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.fold import latest_wins


def node_events(log: DataFrame) -> DataFrame:
    """Creations with an importance, and sets of three fields, as JSON text; some have the wrong type."""
    k = F.col("k")
    number = F.concat(F.lit("0."), F.lpad(k.cast("string"), 2, "0"))
    flag = F.when(k % 4 == 3, "1").when(F.col("value") >= 30, "true").otherwise("false")
    path = F.when(k % 5 == 0, "7").otherwise(F.concat(F.lit('"p'), k, F.lit('"')))
    created = F.col("kind") == "node_created"
    field = F.when(created, "importance").otherwise(F.col("field"))
    value = F.when(field == "importance", number).when(field == "canonical", flag).otherwise(path)
    return log.where(F.col("kind").isin("node_created", "node_property_set")).select("offset", "kind", "node_id", field.alias("field"), value.alias("value"))


def induced_schemas(log: DataFrame) -> DataFrame:
    """Schema inductions read off purchases: schema k, superseding 7 k mod 100 when the value is above 50."""
    supersedes = F.when(F.col("value") > 50, (F.col("k") * 7) % 100)
    return log.where("event_type = 'purchase'").select(F.col("k").alias("schema_id"), "offset", supersedes.alias("supersedes"), F.round("value", 4).alias("stability"))


def edge_events(log: DataFrame) -> DataFrame:
    """Edge lifecycle events read off the log: views create, errors invalidate, sign-ups revalidate."""
    kind = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "error", "invalidated").when(F.col("event_type") == "signup", "revalidated")
    edge = F.concat_ws("-", F.lit("e"), F.col("node_id"), F.col("k") % 10)
    return log.select("offset", "ts_ms", kind.alias("kind"), edge.alias("edge_id"), "node_id", "k", F.round("value", 4).alias("weight")).where("kind is not null")


def contradiction_events(log: DataFrame) -> DataFrame:
    edge = F.concat_ws("-", F.lit("x"), F.col("node_id"), F.col("k") % 5)
    return log.where("event_type in ('error', 'signup')").select(edge.alias("edge_id"), "offset", F.when(F.col("event_type") == "error", "asserted").otherwise("resolved").alias("kind"))


def match_events(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (views) and findings (clicks) by match id."""
    match = F.concat_ws("-", F.lit("m"), F.col("node_id"), F.col("k"))
    request = log.where("event_type = 'view'").select(match.alias("match_id"), "offset", F.col("node_id").alias("requester"), (F.col("k") % 20).alias("target"), F.col("ts_ms").alias("requested_at"))
    finding = log.where("event_type = 'click'").select(match.alias("match_id"), "offset", F.col("ts_ms").alias("completed_at"), F.round("value", 4).alias("strength"))
    return latest_wins(request, ["match_id"]).drop("offset"), latest_wins(finding, ["match_id"]).drop("offset")
