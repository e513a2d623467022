"""Query context, identifiers, token time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieve import RATE_WEIGHTS

ID = r"^[a-z]{2,6}_[0-9a-z]{1,12}_[0-9a-z]{8}$"


def weighted_by_rate(features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """A score per consolidation rate: the sum of features times the rate's weights."""
    scores = [F.struct(F.lit(rate).alias("rate"), F.round(sum((F.col(n) * w.get(n, 1.0) for n in names), F.lit(0.0)), 6).alias("score")) for rate, w in RATE_WEIGHTS.items()]
    return features.select(key, F.inline(F.array(*scores)))


def make_id(prefix: Column, ms: Column, seed: Column) -> Column:
    """prefix_time_random: time in base 36, eight characters of a hash."""
    return F.concat_ws("_", prefix, F.lower(F.conv(ms.cast("string"), 10, 36)), F.substring(F.sha2(seed.cast("binary"), 256), 1, 8))


def valid_id(value: Column) -> Column:
    return value.rlike(ID)


def id_prefix(value: Column) -> Column:
    return F.get(F.split(value, "_"), 0)


def overrides(tokens: DataFrame, spans: DataFrame, bucket_ms: int = 36_000_000) -> DataFrame:
    """tokens: drawer, i, onset; spans: drawer, ordinal, begun, ended, label.  The last span that covers each token.

    A point-in-interval join: spans are dealt to the time buckets they touch, so tokens meet only spans near them.
    """
    touched = F.sequence(F.floor(F.col("begun") / bucket_ms), F.floor((F.col("ended") - 1) / bucket_ms))
    near = spans.select("drawer", F.explode(touched).alias("bucket"), "ordinal", "begun", "ended", F.col("label").alias("new"))
    hits = tokens.withColumn("bucket", F.floor(F.col("onset") / bucket_ms)).join(near, ["drawer", "bucket"]).where("onset >= begun and onset < ended")
    best = hits.groupBy("drawer", "i").agg(F.max_by("new", "ordinal").alias("label"))
    return tokens.join(best, ["drawer", "i"], "left")


def speakers(labelled: DataFrame, default: str = "s0") -> DataFrame:
    return labelled.groupBy("drawer").agg(F.count_distinct(F.coalesce(F.col("label").cast("string"), F.lit(default))).alias("speakers"), F.count(F.lit(1)).alias("tokens"))


def dominant(labels: DataFrame, by: str, label: str) -> DataFrame:
    n = labels.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def recognised(events: DataFrame, kind: str, known: tuple[str, ...], pass_id: str = "p1") -> DataFrame:
    return events.where(F.col(kind).isin(*known)).withColumn("pass_id", F.lit(pass_id))


def velocity_coupling(series: DataFrame) -> DataFrame:
    """series: node_id, day, n.  Correlation of neighbouring nodes' daily counts over shared days."""
    b = series.select((F.col("node_id") - 1).alias("node_id"), "day", F.col("n").alias("m"))
    r = F.corr("n", "m")
    return series.join(b, ["node_id", "day"]).groupBy("node_id").agg(F.round(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 6).alias("coupling"))
