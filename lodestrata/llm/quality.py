"""Operator 1: quality rules by a hashed n-gram log-likelihood ratio (DataFrame functions only).

Words and word pairs of every text are hashed into ``BUCKETS`` buckets.  Two
smoothed multinomials over the buckets are counted in one map-side combined
pass: one of the trusted target (documents labelled quality 1), one of the raw
corpus (all documents).  A document's score is the mean over its n-grams of
``ln p_target - ln p_raw``; every document is kept or rejected by the fixed
``THRESHOLD``, so the verdict never depends on a random draw.

The table of bucket weights has ``BUCKETS`` doubles whatever the corpus size, so
it is broadcast; the trusted ids are a documented sample of at most
``TARGET_ROWS`` ids (the smallest by hash) and are broadcast as well.  All raw
counts are over all documents.

Defined cases: a null or empty text has no words, fails the base rules and is
not kept; an unlabelled corpus gives score 0 for every document; a document
labelled twice counts as trusted if any label says so, once for each row of it;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, strip, words

BUCKETS = 1 << 14
TARGET_ROWS = 200_000
SMOOTHING = 0.5
#: Mean log-likelihood ratio below which a document is rejected; clean text scatters around 0.
THRESHOLD = -0.12
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = "[#*$%&|<>]"


def buckets(ws: Column) -> Column:
    """Bucket numbers of the words and of the pairs of neighbouring words."""
    one = F.transform(ws, lambda w: F.crc32(w))

    def both(h):
        pairs = F.transform(F.slice(h, 2, F.greatest(F.size(h) - 1, F.lit(0))), lambda x, i: F.pmod(F.get(h, i) * 31 + x, F.lit(BUCKETS)))
        return F.concat(F.transform(h, lambda x: F.pmod(x, F.lit(BUCKETS))), pairs)

    return let(one, both)


def repeated_words(ws: Column) -> Column:
    """How many words lie in a five-word window that the text holds twice or more."""

    def windows(h):
        n = F.size(h) - (WINDOW - 1)
        return F.transform(F.slice(h, 1, F.greatest(n, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)]))

    def covered(w):
        by_hash = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s):
            same = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"]) & (k > 0)) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def total(p):
            steps = F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(let(by_hash, twice), total))

    return let(let(F.transform(ws, lambda w: F.xxhash64(w)), windows), covered)


def base_rules(docs: DataFrame, whole: bool = False) -> DataFrame:
    """doc_id (or row: the whole row as a struct), ws (words) and the base columns."""
    text = F.coalesce(F.col("text"), F.lit(""))
    carried = F.struct("*").alias("row") if whole else F.col("doc_id")
    with_words = docs.select(carried, text.alias("t"), words(F.col("text")).alias("ws"))
    lines = F.filter(F.split("t", "\n"), lambda x: strip(x) != "")
    return with_words.select(
        "row" if whole else "doc_id",
        "ws",
        F.size("ws").cast("long").alias("n_words"),
        F.length(F.array_join("ws", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("ws")).cast("long").alias("n_repeat_words"),
    )


def trusted_ids(labels: DataFrame, limit: int = TARGET_ROWS) -> DataFrame:
    """Ids of documents labelled quality 1: all, or the ``limit`` smallest by hash."""
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("trusted")).distinct()
    return good.orderBy(F.xxhash64("trusted"), "trusted").limit(limit)


def ngram_weights(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: ``w``, the array of log-likelihood ratios by bucket."""
    spark = docs.sparkSession
    marked = docs.join(F.broadcast(trusted_ids(labels)), F.col("doc_id") == F.col("trusted"), "left")
    grams = marked.select(F.col("trusted").isNotNull().cast("long").alias("is_target"), F.explode(buckets(words(F.col("text")))).alias("b"))
    counts = grams.groupBy("b").agg(F.count(F.lit(1)).alias("raw"), F.sum("is_target").alias("target"))
    dense = spark.range(0, BUCKETS, 1, 1).join(counts, F.col("id") == F.col("b"), "left").na.fill(0, ["raw", "target"])
    one = dense.agg(F.sum("raw").alias("n"), F.sum("target").alias("m"), F.sort_array(F.collect_list(F.struct("id", "raw", "target"))).alias("c"))
    a = F.lit(SMOOTHING)

    def weight(x):
        return F.log((x["target"] + a) / (F.col("m") + a * BUCKETS)) - F.log((x["raw"] + a) / (F.col("n") + a * BUCKETS))

    flat = F.transform("c", lambda x: F.when(F.col("m") == 0, F.lit(0.0)).otherwise(weight(x)))
    return one.select(F.lit(1).alias("wk"), flat.alias("w"))


def _judged(docs: DataFrame, labels: DataFrame, threshold: float, whole: bool) -> DataFrame:
    weights = ngram_weights(docs.select("doc_id", "text"), labels)
    based = base_rules(docs, whole).withColumn("one", F.lit(1))
    scored = based.join(F.broadcast(weights), F.col("one") == F.col("wk"), "left")
    w = F.col("w")
    total = let(buckets(F.col("ws")), lambda b: F.aggregate(b, F.lit(0.0), lambda acc, x: acc + F.get(w, x.cast("int"))) / F.size(b))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = scored.withColumn("score", F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.round(total, 6))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept."""
    judged = _judged(docs, labels, threshold, whole=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the rules keep, unchanged."""
    return _judged(docs, labels, threshold, whole=True).where("kept").select("row.*")
