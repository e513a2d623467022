"""Formula evaluation: typed evaluators over evidence, a veto, and a confidence floor."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YES, NO, INDETERMINATE = 0, 1, -1
MIN_CONFIDENCE_BPS = 7_000

Evaluator = Callable[[], Column]


def outcome(yes: Column, bps_yes, bps_no=None) -> Column:
    """(outcome, bps) of a test; a null test is no evidence."""
    as_int = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("int")
    return F.when(yes.isNull(), F.struct(F.lit(INDETERMINATE).alias("outcome"), F.lit(0).alias("bps"))).otherwise(
        F.struct(F.when(yes, YES).otherwise(NO).alias("outcome"), F.when(yes, as_int(bps_yes)).otherwise(as_int(bps_yes if bps_no is None else bps_no)).alias("bps"))
    )


def _bps(ratio: Column) -> Column:
    return (ratio * 10_000).cast("int")


def _c(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


#: Evaluators by formula type.  Evidence columns: tags (array of bps) and their minima (needs), ratio, domain_bps, domain_count, domain_total,
#: matches, visual, object, scene, document, location, environmental, witnesses (array), trait, texts, pipeline, sessions, devices, velocity_sd, axis_drift, contradiction_rate;
#: formula columns: min_bps, min_ratio, min_count, min_value, max_value, min_sessions, min_devices, trend_window, direction.
EVALUATORS: dict[str, Evaluator] = {
    "tag_threshold": lambda: outcome(_c("bps") >= F.col("min_bps"), _c("bps")),
    "tag_ratio": lambda: outcome(_c("ratio") >= F.col("min_ratio"), _bps(_c("ratio"))),
    "multi_tag_and": lambda: outcome(
        ~F.exists(F.zip_with("tags", "needs", lambda b, m: b < m), lambda x: x),
        F.least(F.lit(10_000), F.array_min("tags")),
        F.get(F.filter("tags", lambda b, i: b < F.get("needs", i)), 0),
    ),
    "multi_tag_or": lambda: outcome(
        F.exists(F.zip_with("tags", "needs", lambda b, m: b >= m), lambda x: x),
        F.get(F.filter("tags", lambda b, i: b >= F.get("needs", i)), 0),
        F.greatest(F.lit(0), F.array_max("tags")),
    ),
    "domain_threshold": lambda: outcome(_c("domain_bps") >= F.col("min_bps"), _c("domain_bps")),
    "domain_ratio": lambda: outcome(F.when(F.col("domain_total") > 0, _c("domain_count") / F.col("domain_total") >= F.col("min_ratio")), _bps(_c("domain_count") / F.nullif("domain_total", F.lit(0)))),
    "text_contains": lambda: outcome(_c("matches") >= F.greatest(F.lit(1), F.col("min_count")), 9_000, 0),
    "visual_threshold": lambda: outcome(_c("visual") >= F.col("min_value"), _bps(_c("visual"))),
    "object_present": lambda: outcome(F.coalesce("object", F.lit(False)), 9_500, 500),
    "scene_match": lambda: outcome(_c("scene") >= F.col("min_value"), _bps(_c("scene"))),
    "document_present": lambda: outcome(F.coalesce("document", F.lit(False)), 9_500, 500),
    "location_confirmed": lambda: outcome(F.coalesce("location", F.lit(False)), 9_500, 500),
    "environmental_range": lambda: outcome((F.col("environmental") >= F.col("min_value")) & (F.col("environmental") <= F.col("max_value")), 9_000, 1_000),
    "witness_threshold": lambda: outcome(F.size(F.filter("witnesses", lambda w: w >= F.col("min_count"))) >= F.greatest(F.lit(1), F.col("min_count")), 9_000, 0),
    "trait_score": lambda: outcome(_c("trait") >= F.col("min_value"), _bps(_c("trait"))),
    "modality_consistency": lambda: outcome(
        (_c("visual") >= 0.5).cast("int") + (_c("texts") > 0).cast("int") + F.coalesce("document", F.lit(False)).cast("int") + F.coalesce("location", F.lit(False)).cast("int") >= 2, 8_500, 1_500
    ),
    "pipeline_match": lambda: outcome(F.when(F.coalesce("pipeline", F.lit("")) != "", F.lit(True)), 9_000),
    "conversation": lambda: outcome((_c("sessions") >= F.col("min_sessions")) & (_c("devices") >= F.col("min_devices")), 8_000, 0),
    "trend": lambda: outcome(
        F.when(F.col("trend_window") > 0, F.when(F.lower("direction") == "up", _c("bps") >= F.col("min_bps")).when(F.lower("direction") == "down", _c("bps") <= F.col("min_bps")).otherwise(F.lit(False))), _c("bps")
    ),
    "baseline_velocity_sd": lambda: outcome(F.abs("velocity_sd") >= F.coalesce("min_value", F.lit(2.0)), 9_000, 1_000),
    "baseline_drift_axis": lambda: outcome(F.col("axis_drift") >= F.col("min_value"), _bps(F.least(F.lit(1.0), F.col("axis_drift")))),
    "baseline_contradiction_rate": lambda: outcome(F.col("contradiction_rate") >= F.coalesce("min_rate", F.lit(0.5)), _bps(F.col("contradiction_rate"))),
}


def register(name: str, evaluator: Evaluator) -> None:
    """Adds a formula type."""
    EVALUATORS[name] = evaluator


def raw(kind: str) -> Column:
    return EVALUATORS[kind]()


def _readable(cases: DataFrame, kind: str) -> bool:
    """Whether the cases have all columns that a type reads; a type added later says so by being resolved against them."""
    if kind in READS:
        return READS[kind] <= set(cases.columns)
    try:
        cases.select(EVALUATORS[kind]()).schema
    except AnalysisException as unresolved:
        if not (unresolved.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
            raise
        return False
    return True


def evaluate(cases: DataFrame, veto: Column | None = None) -> DataFrame:
    """cases: formula_type and the evidence and formula columns that its type reads.  outcome and bps after veto and confidence floor.

    A type whose columns the cases lack is no evidence.
    """
    r = F.struct(F.lit(INDETERMINATE).alias("outcome"), F.lit(0).alias("bps"))
    for kind, build in EVALUATORS.items():
        if _readable(cases, kind):
            r = F.when(F.col("formula_type") == kind, build()).otherwise(r)
    vetoed = F.coalesce(veto, F.lit(False)) if veto is not None else F.lit(False)
    low = (F.col("r.outcome") != INDETERMINATE) & (F.col("r.bps") < MIN_CONFIDENCE_BPS)
    out = cases.withColumn("r", r)
    return out.withColumn("outcome", F.when(vetoed | low, INDETERMINATE).otherwise(F.col("r.outcome"))).withColumn("bps", F.when(vetoed, 0).otherwise(F.col("r.bps"))).drop("r")


#: The columns that each type reads.
READS = {
    "tag_threshold": {"bps", "min_bps"}, "tag_ratio": {"ratio", "min_ratio"}, "multi_tag_and": {"tags", "needs"}, "multi_tag_or": {"tags", "needs"}, "domain_threshold": {"domain_bps", "min_bps"},
    "domain_ratio": {"domain_count", "domain_total", "min_ratio"}, "text_contains": {"matches", "min_count"}, "visual_threshold": {"visual", "min_value"}, "object_present": {"object"},
    "scene_match": {"scene", "min_value"}, "document_present": {"document"}, "location_confirmed": {"location"}, "environmental_range": {"environmental", "min_value", "max_value"},
    "witness_threshold": {"witnesses", "min_count"}, "trait_score": {"trait", "min_value"}, "modality_consistency": {"visual", "texts", "document", "location"}, "pipeline_match": {"pipeline"},
    "conversation": {"sessions", "devices", "min_sessions", "min_devices"}, "trend": {"trend_window", "direction", "bps", "min_bps"}, "baseline_velocity_sd": {"velocity_sd", "min_value"},
    "baseline_drift_axis": {"axis_drift", "min_value"}, "baseline_contradiction_rate": {"contradiction_rate", "min_rate"},
}

# Words that tell how a question can be resolved, in order of rank.
NOT_RESOLVABLE = ("consciousness", "soul", "free will", "metaphysical", "in essence", "objectively true", "the truth about")
JURY = ("creative interpretation", "subjective preference", "best film", "most beautiful", "most important", "should they", "ought to", "morally")
PRIVATE = ("i ", "my ", "me ", "subject's", "user's", "their drawer", "their period", "their schema", "their montage", "their feed")


def resolvability(question: Column) -> Column:
    """(class, confidence, pipelines) of a question."""
    from ..functions.columns import contains_any

    q = F.lower(question)

    def row(kind: str, confidence: float, pipelines: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(confidence).alias("confidence"), F.lit(pipelines).alias("pipelines"))

    return (
        F.when(contains_any(q, NOT_RESOLVABLE), row("not_resolvable", 0.7, "")).when(contains_any(q, JURY), row("jury_only", 0.6, "jury"))
        .when(contains_any(q, PRIVATE), row("privacy_preserving_required", 0.7, "local_only,sandbox")).otherwise(row("public_llm_resolvable", 0.6, "public_llm_only"))
    )


def encode_resolution(market: Column, result: Column, bps: Column, at_ms: Column) -> Column:
    """Fixed-width hex of a resolution: SHA-256 of the market, outcome byte, confidence and time, big-endian."""
    return F.concat(F.sha2(market.cast("binary"), 256), F.lpad(F.hex(F.pmod(result, F.lit(256))), 2, "0"), F.lpad(F.hex(bps), 4, "0"), F.lpad(F.hex(at_ms), 16, "0"))


def decode_resolution(encoded: Column) -> Column:
    at = F.conv(F.substring(encoded, 71, 16), 16, 10).cast("long")
    code = F.conv(F.substring(encoded, 65, 2), 16, 10).cast("int")
    return F.struct(F.substring(encoded, 1, 64).alias("market_hash"), F.when(code == 255, INDETERMINATE).otherwise(code).alias("outcome"), F.conv(F.substring(encoded, 67, 4), 16, 10).cast("int").alias("bps"), at.alias("at_ms"))


def parse_pipeline(spec: Column) -> Column:
    """Ordered steps of a specification such as "web_search > llm_resolve"."""
    return F.filter(F.transform(F.split(spec, "[>,]"), lambda x: F.trim(x)), lambda x: x != "")
