"""Matching between stores as a cascade of layers, and what is published of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import DAY_MS, cosine, jaccard
from .fold import fold_events, with_blocks

GATE_1, GATE_2A, GATE_2B, GATE_2C, GATE_2 = 0.4, 0.2, 0.25, 0.15, 0.3


def layer1(minhash: Column, schemas: Column, velocity: Column) -> Column:
    return 0.6 * minhash + 0.25 * schemas + 0.15 * F.greatest(F.lit(0.0), velocity)


def set_overlap(a: Column, b: Column) -> Column:
    return jaccard(a, b, 0.0)


def layer2b(nodes: Column, edges: Column, forks: Column, discourse: Column | None = None) -> Column:
    score = 0.4 * nodes + 0.3 * edges + 0.3 * forks
    return score if discourse is None else F.when(discourse.isNull(), score).otherwise(0.7 * score + 0.3 * discourse)


def layer2(a: Column, b: Column, c: Column) -> Column:
    return F.pow(F.greatest(F.lit(0.05), a) * F.greatest(F.lit(0.05), b) * F.greatest(F.lit(0.05), c), F.lit(1 / 3))


def layer3(semantic: Column, verbatim: Column, paralinguistic: Column) -> Column:
    return 0.55 * semantic + 0.30 * verbatim + 0.15 * paralinguistic


def cascade(pairs: DataFrame) -> DataFrame:
    """pairs with the parts of every layer; a layer is scored only where the gate before it opens."""
    one = layer1(F.col("minhash"), F.col("schemas"), F.col("velocity"))
    p = pairs.withColumn("layer1", one).withColumn("open1", F.col("layer1") >= GATE_1)
    a = F.when(F.col("open1"), F.col("predicates")).otherwise(0.0)
    p = p.withColumn("layer2a", a).withColumn("open2a", F.col("layer2a") >= GATE_2A)
    b = F.when(F.col("open2a"), layer2b(F.col("nodes"), F.col("edges"), F.col("forks"), F.col("discourse"))).otherwise(0.0)
    p = p.withColumn("layer2b", b).withColumn("open2b", F.col("layer2b") >= GATE_2B)
    p = p.withColumn("layer2c", F.when(F.col("open2b"), F.col("paths")).otherwise(0.0))
    return p.withColumn("layer2", layer2(F.col("layer2a"), F.col("layer2b"), F.col("layer2c"))).withColumn("open2", F.col("layer2") >= GATE_2)


def best_semantic(a: DataFrame, b: DataFrame) -> DataFrame:
    """a: store, v, a stated query set (broadcast by blocks); b: store, v.  (max cosine + 1) / 2 between the vectors of two stores."""
    x = a.select(F.col("store").alias("a"), F.col("v").alias("va"))
    y = b.select(F.col("store").alias("b"), F.col("v").alias("vb"))
    part = with_blocks(y, x, lambda rows, block: rows.join(block, F.col("a") != F.col("b")).groupBy("a", "b").agg(F.max(cosine(F.col("va"), F.col("vb"))).alias("c")))
    c = part.groupBy("a", "b").agg(F.max("c").alias("c"))
    return c.select("a", "b", F.round((F.col("c") + 1) / 2, 6).alias("semantic"))


def topology(peer: Column, asymmetry: Column, overlap: Column, divergence: Column) -> Column:
    return F.when((divergence > 0.6) & (overlap < 0.4), "divergent").when(asymmetry > 0.55, "mentor").when((peer > 0.6) & (asymmetry < 0.3), "peer").otherwise("complementary")


def path_weights(traversals: DataFrame, now_ms: int, half_life_days: float = 30.0) -> DataFrame:
    """traversals: path, ts_ms, weight.  The moving average in closed form: every step's weight halved per half life."""
    w = F.sum(F.col("weight") * F.pow(F.lit(0.5), (F.lit(float(now_ms)) - F.col("ts_ms")) / (half_life_days * DAY_MS)))
    return traversals.groupBy("path").agg(F.round(w, 6).alias("weight")).where(F.col("weight") >= 1e-9)


def region_uncertainty(totals: DataFrame, refinements: DataFrame) -> DataFrame:
    j = totals.join(refinements, "region", "left")
    return j.select("region", F.round(F.least(F.lit(1.0), F.coalesce("refined", F.lit(0)) / F.col("total")), 6).alias("uncertainty"))


def discover_tunnels(current: DataFrame, baseline: DataFrame, min_gain: float = 3.0, min_baseline: float = 0.1) -> DataFrame:
    j = current.join(baseline.select("path", F.col("weight").alias("base")), "path", "left")
    gain = F.col("weight") / F.greatest(F.coalesce("base", F.lit(0.0)), F.lit(min_baseline))
    return j.select("path", F.round(gain, 6).alias("gain")).where(F.col("gain") >= min_gain).orderBy(F.desc("gain"), "path")


def trust_scores(verdicts: DataFrame) -> DataFrame:
    """verdicts: asserter, offset, confirmed.  0.5, +0.1 a confirmation, -0.2 a rejection, kept within [0, 1] in order."""
    moves = F.array_sort(F.collect_list(F.struct("offset", F.when(F.col("confirmed"), 0.1).otherwise(-0.2).alias("d"))))
    fold = F.aggregate("m", F.lit(0.5), lambda acc, x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), acc + x["d"])))
    return verdicts.groupBy("asserter").agg(moves.alias("m")).select("asserter", F.round(fold, 6).alias("trust"))


def decorations(items: DataFrame, trust: DataFrame, now_ms: int, least: float = 0.4, half_life_days: float = 90.0) -> DataFrame:
    """items: decoration, anchor, asserter, confidence, ts_ms.  Weighted by trust (0.5 unknown) and age."""
    j = items.where(F.col("confidence") >= least).join(trust, "asserter", "left")
    weight = F.col("confidence") * F.coalesce("trust", F.lit(0.5)) * F.pow(F.lit(0.5), (F.lit(float(now_ms)) - F.col("ts_ms")) / (half_life_days * DAY_MS))
    return j.select("decoration", "anchor", "asserter", F.round(weight, 6).alias("weight"))


def manifest(themes: DataFrame, now_ms: int, ttl_days: int = 7) -> DataFrame:
    """themes: owner, theme, n.  Content hash of each owner's themes in order, and when it expires."""
    content = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("theme", "n"))), lambda x: F.concat_ws("=", x["theme"], x["n"].cast("string"))), ";")
    return themes.groupBy("owner").agg(F.sha2(content.cast("binary"), 256).alias("content_hash"), F.count(F.lit(1)).alias("themes")).withColumn("expires_ms", F.lit(now_ms + ttl_days * DAY_MS))


def slice_rows(drawers: DataFrame, ids: list[int] | None, order: str, limit: int = 256) -> DataFrame:
    rows = drawers.where(F.col(order).isin(*ids)) if ids else drawers
    return rows.orderBy(order).limit(limit)


def first_encounter(themes: DataFrame, now: DataFrame, promotions: DataFrame, sizes: tuple[int, int, int] = (12, 6, 8)) -> DataFrame:
    """Canonical themes, current items and recent promotions; each: id, score, ts_ms."""
    out = None
    for (name, df), n in zip((("theme", themes), ("now", now), ("promotion", promotions)), sizes):
        best = df.orderBy(F.desc("score"), F.desc("ts_ms"), "id").limit(n).select(F.lit(name).alias("section"), F.col("id").cast("string").alias("id"), "score")
        out = best if out is None else out.unionByName(best)
    return out


def rate_limit(requests: DataFrame, per_hour: float) -> DataFrame:
    """requests: peer, ts_ms, request.  Token bucket per peer: at most ``per_hour`` at once, refilled steadily; decided in order of time."""

    def step(state, rows):
        (level, last), allowed = state, []
        for ts in rows["ts_ms"].tolist():
            if last is not None:
                level = min(per_hour, level + (ts - last) * per_hour / 3_600_000)
            last = ts
            ok = level >= 1
            level -= ok
            allowed.append(ok)
        return (level, last), rows.assign(allowed=allowed)

    return fold_events(requests.select("peer", "ts_ms", "request"), ["peer"], ["ts_ms", "request"], lambda: (per_hour, None), step, "peer long, ts_ms long, request long, allowed boolean")


def window_rank(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
