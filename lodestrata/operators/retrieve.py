"""Staged retrieval: features, rankers, rendering, policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import clamp, geometric_mean, half_life, jaccard, token_set

# The stance weights of each consumer
# (correspondence_vs_coherence, temporal_sensitivity, contradiction_weight, recency_bias, canonicality_floor, exploration_entropy).
STANCES = {
    "claude_thread": (0.5, 0.0, 0.5, 0.5, 0.5, 0.3),
    "montage": (0.3, 0.0, 0.5, 0.3, 0.3, 0.7),
    "matching": (0.7, 0.0, 0.5, 0.5, 0.4, 0.8),
    "foyer": (0.4, 0.0, 0.5, 0.2, 0.95, 0.05),
    "agent": (0.6, 0.0, 0.5, 0.5, 0.5, 0.4),
    "review_mode": (0.85, 0.0, 0.85, 0.3, 0.5, 0.2),
    "resolve": (0.95, 0.5, 0.7, 0.3, 0.5, 0.05),
}
STANCE_FIELDS = ("cvc", "temporal", "contradiction", "recency_bias", "floor", "entropy")
# Bilinear weights of the second ranker.
CROSS_TERMS = {("heat", "velocity"): 0.3, ("canonicality", "faithfulness"): 0.5, ("recency", "fork"): 0.4, ("heat", "fork"): 0.25}
# Feature multipliers by consolidation rate.
RATE_WEIGHTS = {
    1: {"recency": 1.5, "heat": 1.3, "velocity": 1.1, "canonicality": 0.7},
    2: {"recency": 1.0, "heat": 1.0, "velocity": 1.0, "canonicality": 1.0, "fork": 1.2, "coupling": 1.1},
    3: {"recency": 0.7, "heat": 0.8, "canonicality": 1.5, "faithfulness": 1.3, "coupling": 1.2},
}
FLOOR, NOISE = 0.05, 0.2


def stances(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in STANCES.items()], "consumer string, " + ", ".join(f"{f} double" for f in STANCE_FIELDS))


def recency(then: Column, now_ms: int) -> Column:
    """0.5 per 30 days of age; 1 without a time."""
    return F.coalesce(half_life(F.lit(float(now_ms)) - then, 30), F.lit(1.0))


def velocity_30d(heat: Column, bumped: Column, now_ms: int) -> Column:
    return F.coalesce(heat * half_life(F.lit(float(now_ms)) - bumped, 15) * 30, F.lit(0.0))


def canonicality(canonical: Column, heat: Column, importance: Column) -> Column:
    return F.when(canonical, F.lit(1.0)).otherwise(clamp(0.6 * heat + 0.4 * importance, 0, 0.99))


def fork_significance(out_kinds: Column, tensions: Column, marker: Column | None = None) -> Column:
    score = 0.5 * F.least(F.lit(1.0), out_kinds / 5) + 0.5 * F.least(F.lit(1.0), tensions / 3)
    return F.greatest(score, F.coalesce(marker, F.lit(0.0))) if marker is not None else score


def faithfulness(sources: Column, confidence: Column) -> Column:
    """0.3 x confidence without sources, else 1 - 0.6 ** sources."""
    return F.when(sources == 0, 0.3 * F.coalesce(confidence, F.lit(0.5))).otherwise(1 - F.pow(F.lit(0.6), sources))


def stance_alignment(canon: Column, heat: Column, recent: Column) -> Column:
    """With the stance columns beside the features."""
    cvc = F.col("cvc")
    return clamp(0.5 * (cvc * canon + (1 - cvc) * heat) + 0.3 * recent * F.col("recency_bias") + 0.2 * F.greatest(canon, F.col("floor")))


def factored_score() -> Column:
    """Geometric mean of floored axis factors, by the columns recency, heat, canonicality, velocity, faithfulness, fork and a stance."""
    c, cvc = F.col, F.col("cvc")
    canon = F.greatest(c("canonicality"), c("floor"))
    factors = [
        F.greatest(F.lit(FLOOR), F.pow(c("recency"), c("recency_bias"))),
        F.greatest(F.lit(FLOOR), F.greatest(F.lit(FLOOR), c("heat")) * (1 - cvc) + cvc),
        F.greatest(F.lit(FLOOR), F.greatest(F.lit(FLOOR), canon) * cvc + 1 - cvc),
        F.greatest(F.lit(FLOOR), F.sqrt(F.least(F.lit(1.0), c("velocity") / 30))),
        F.greatest(F.lit(FLOOR), c("faithfulness")),
        F.least(F.lit(2.0), 1 + F.greatest(F.lit(FLOOR), F.sqrt(c("fork")))),
    ]
    return geometric_mean(factors, FLOOR)


def exploration_noise(seed: Column, entropy: Column) -> Column:
    """Reproducible noise within +-0.2 entropy, from the first eight bytes of a SHA-256."""
    n = F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 16), 16, 10).cast("double")
    return (n / F.lit(float(2**64 - 1)) * 2 - 1) * entropy * NOISE


def neural_score(base: Column, weight: float = 0.3) -> Column:
    cross = F.lit(0.0)
    for (a, b), w in CROSS_TERMS.items():
        cross = cross + w * F.coalesce(F.col(a), F.lit(0.0)) * F.coalesce(F.col(b), F.lit(0.0))
    return 1 / (1 + F.exp(1 - base - weight * cross))


def normalize(score: str, by: list[str]) -> Column:
    return F.col(score) / F.max(score).over(Window.partitionBy(*by))


def behaviour_flags(scored: DataFrame, by: str, score: str) -> DataFrame:
    """Per invocation: all zero, all the same (6 digits), out of range."""
    s = F.col(score)
    return scored.groupBy(by).agg((F.max(F.abs(s)) == 0).alias("all_zero"), (F.count_distinct(F.round(s, 6)) == 1).alias("identical"), F.bool_or((s < 0) | (s > 1)).alias("out_of_range"), F.count(F.lit(1)).alias("n"), F.round(F.avg(s), 6).alias("mean"))


def refine(scored: DataFrame, key: str, score: str, less: list, more: list, limit: int = 50) -> DataFrame:
    """Less-like scores x 0.1, more-like x 1.5; the best 50."""
    s = F.col(score) * F.when(F.col(key).isin(*less), 0.1).otherwise(1.0) * F.when(F.col(key).isin(*more), 1.5).otherwise(1.0)
    return scored.withColumn("score", F.round(s, 6)).orderBy(F.desc("score"), key).limit(limit).select(key, "score")


FIDELITY = {"lite": ["node_id", "score"], "standard": ["node_id", "score", "heat", "canonicality"], "full": ["node_id", "score", "heat", "canonicality", "recency", "velocity", "faithfulness", "fork"]}


def render(scored: DataFrame, fidelity: str) -> DataFrame:
    return scored.select(*FIDELITY[fidelity])


def verify_substrate(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """claims: claim_id, text; sources: claim_id, text, is_span.  Best token overlap with a source, x 0.7 for whole drawers; 0 without one."""
    j = claims.join(sources.select("claim_id", F.col("text").alias("source"), "is_span"), "claim_id", "left")
    sim = jaccard(token_set(F.col("text")), token_set(F.col("source")), 1.0) * F.when(F.col("is_span"), 1.0).otherwise(0.7)
    best = j.groupBy("claim_id").agg(F.round(F.coalesce(F.max(sim), F.lit(0.0)), 6).alias("faithfulness"))
    return best.withColumn("level", F.when(F.col("faithfulness") < 0.3, "low").when(F.col("faithfulness") >= 0.7, "high").otherwise("middle"))


def search_policy(frames: DataFrame, dominant: float = 0.7, close: float = 0.1, dispersion: float = 0.15) -> DataFrame:
    """frames: walk, frame, confidence, fading, remaining, dwindling, stable.  The next step of each walk by the first rule that applies."""
    w = frames.groupBy("walk").agg(
        F.sort_array(F.collect_list(F.struct("confidence", "frame")), asc=False).alias("f"),
        F.stddev_samp("confidence").alias("spread"), F.min("remaining").alias("remaining"), F.bool_or("dwindling").alias("dwindling"), F.bool_or("stable").alias("stable"),
        F.sort_array(F.collect_list(F.struct("confidence", "frame", "fading")), asc=False).alias("g"),
    )
    top, second = F.get("f", 0), F.get("f", 1)
    others = F.forall(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), lambda x: x["fading"])
    step = (
        F.when(F.col("remaining") <= 0, "terminate:budget").when(F.col("stable"), "terminate:stuck").when(top["confidence"].isNull(), "expand_breadth")
        .when((top["confidence"] >= dominant) & others, "commit_depth")
        .when(second.isNotNull() & (top["confidence"] - second["confidence"] <= close) & F.col("dwindling"), "alternate")
        .otherwise("expand_breadth")
    )
    return w.select("walk", step.alias("step"), F.round("spread", 6).alias("spread"), (F.coalesce(F.col("spread") >= dispersion, F.lit(False)) & ~F.col("dwindling")).alias("dispersed"))


def cluster_pattern(hops: DataFrame, last: int = 8, stable: int = 4) -> DataFrame:
    """hops: walk, i, kind.  At each hop the kinds of the last eight, their signature, and whether the last four are the same."""
    w = Window.partitionBy("walk").orderBy("i").rowsBetween(-(last - 1), 0)
    recent = F.collect_list("kind").over(w)
    h = hops.withColumn("recent", recent)
    tail = F.slice("recent", -stable, stable)
    same = F.when(F.size("recent") >= stable, F.size(F.array_distinct(tail)) == 1).otherwise(False)
    return h.select("walk", "i", F.sha2(F.array_join("recent", ">").cast("binary"), 256).alias("signature"), same.alias("stable"))


# Words that tell the shape of a question.
AUXILIARIES = "will|has|did|is|are|can|should|would"
SHAPES = (("continuous", r"\b(price|count|how many|how much|value|amount)\b"), ("categorical", r"\bwhich (of|one)\b"), ("set", r"\b(all of|which all)\b"))


def question_shape(question: Column) -> Column:
    q = F.lower(F.trim(question))
    out = F.lit("open_ended")
    for name, pattern in reversed(SHAPES):
        out = F.when(q.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(q.rlike(rf"^({AUXILIARIES})(\s|$)") & (q.endswith("?") | q.contains("by ")), F.lit("binary")).otherwise(out)


def plan_budget(shape: Column, capability: Column) -> Column:
    """Mixing rule and token budget, joined by a colon."""
    return (
        F.when((capability == "high") & shape.isin("binary", "categorical"), "local_only:0").when(capability == "low", "remote_only:4000")
        .when(shape == "continuous", "remote_after_local:3000").when(shape == "open_ended", "parallel_then_merge:4000").otherwise("remote_after_local:2000")
    )


BLANKS = ("...", "…", "___", "<blank>")


def blank_position(text: Column) -> Column:
    """0-based place of the first blank, by preference of marks; -1 without one."""
    out = F.lit(-1)
    for mark in reversed(BLANKS):
        at = F.instr(text, mark)
        out = F.when(at > 0, at - 1).otherwise(out)
    return out


def pending_queue(questions: DataFrame, by: str, order: str, now_ms: int, expires: str, size: int = 50) -> DataFrame:
    """The newest unexpired questions of each queue, 50 at most, oldest first."""
    live = questions.where(F.col(expires) > now_ms)
    return live.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).where(F.col("n") <= size).drop("n")


def latest_features(computed: DataFrame) -> DataFrame:
    """computed: feature, subject, offset, value.  The last value of each, a column per feature."""
    last = computed.groupBy("subject", "feature").agg(F.max_by("value", "offset").alias("value"))
    return last.groupBy("subject").pivot("feature", ["canonical", "importance", "canon_path"]).agg(F.first("value"))
