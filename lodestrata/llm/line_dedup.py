"""Operator 9: corpus-wide line deduplication (DataFrame functions only).

A line's key is its text stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased.
Keys of at least ``min_chars`` code points found in at least ``min_docs``
documents lose all their lines except in the largest ``doc_id`` holding them.

Plan: every eligible line becomes (128-bit key hash, doc_id, position), without
its text.  These rows are range-partitioned by hash and sorted within each
partition by hash, document and position; one streaming pass over the sorted
rows tells first occurrences from the rest.  (They are written once to the
shared folder, so texts are split once.)  A key that holds an outsized share
of all rows would land in one range, so an (at most ``HOT_KEYS`` entries)
frequent-items sketch finds such keys first; they are resolved by a map-side
combined aggregate instead and broadcast, their rows never being sorted at all.
The result is one row per document with a run-length bitmap of its lines.

Defined cases: a null text counts as the empty text, which is one empty line; a
null doc_id is a document of its own that sorts before all others; rows that
repeat a doc_id count as one document, each row keeping its own bitmap; other
columns are ignored, whatever they are called; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACES, UPPER, cut, let, strip

MIN_CHARS, MIN_DOCS = 20, 3
#: The sketch reports so many keys at most; only those with more than this share of all rows are set apart.
HOT_KEYS, HOT_TRACKED, HOT_SHARE = 1000, 10_000, 1e-4


def _source(docs: DataFrame, whole: bool = False) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select(F.col("doc_id").alias("d"), text.alias("t"), F.xxhash64(text).alias("r"), *row)


def _stripped(line: Column) -> Column:
    """``strip``, tried only where the line begins or ends with white space."""
    bare = ~F.lit(False)
    for c in SPACES:
        bare = bare & ~line.startswith(F.lit(c)) & ~line.endswith(F.lit(c))
    return F.when(bare, line).otherwise(strip(line))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(d, r, p, h, g): document, hash of its text, line number from 0, 128-bit hash of an eligible line's key.

    Two keys are equal just if their lower-case forms are and so are their characters beyond ASCII, unless a
    character beyond ASCII has a lower case in ASCII (only U+0130 and U+212A do); so the slow character-wise
    lower-casing of A-Z is left to lines with those two.
    """
    lines = _source(docs).select("d", "r", F.posexplode(F.split("t", "\n")).alias("p", "line"))
    keys = lines.where(F.length("line") >= min_chars).select("d", "r", "p", _stripped(F.col("line")).alias("k"))
    k = F.col("k")
    odd = k.contains("\u0130") | k.contains("\u212a")
    low = F.when(odd, F.translate(k, UPPER, UPPER.lower())).otherwise(F.lower(k))
    beyond = F.when(F.octet_length(k) == F.length(k), F.lit("")).otherwise(F.regexp_replace(k, "[\\x00-\\x7F]+", ""))
    parts = keys.where(F.length("k") >= min_chars).select("d", "r", "p", low.alias("low"), beyond.alias("beyond"))
    return parts.select("d", "r", "p", F.xxhash64("low", "beyond").alias("h"), F.xxhash64(F.lit(9), "beyond", "low").alias("g"))


def hot_hashes(occ: DataFrame) -> list[int]:
    """Hashes that hold more than ``HOT_SHARE`` of the rows, by a bounded sketch; only how rows are dealt depends on it."""
    row = occ.agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(h, {HOT_KEYS}, {HOT_TRACKED})").alias("top")).first()
    return [x["item"] for x in (row["top"] or []) if x["item"] is not None and x["count"] > max(1000, HOT_SHARE * row["n"])]


def repeats(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(d, r, p): the lines to drop."""
    occ = cut(occurrences(docs, min_chars))
    hot = hot_hashes(occ)
    is_hot = F.col("h").isin(hot) if hot else F.lit(False)

    group = Window.partitionBy("h", "g")
    # the row order within a group is by document, the largest first, then by position: the first document keeps its lines
    ranked = (
        occ.where(~is_hot)
        .repartitionByRange(F.col("h"))
        .sortWithinPartitions("h", "g", F.col("d").desc_nulls_last(), "p")
        .withColumn("seen", F.dense_rank().over(group.orderBy(F.col("d").desc_nulls_last())))
        .withColumn("docs", F.max("seen").over(group))
    )
    drop = ranked.where((F.col("docs") >= min_docs) & (F.col("seen") > 1)).select("d", "r", "p")
    if not hot:
        return drop
    rows = occ.where(is_hot)
    one = rows.groupBy("h", "g", "d").agg(F.lit(1).alias("one"))
    keep = one.groupBy("h", "g").agg(F.max("d").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select(F.col("h").alias("kh"), F.col("g").alias("kg"), "last")
    late = rows.join(F.broadcast(keep), (F.col("h") == F.col("kh")) & (F.col("g") == F.col("kg"))).where(~F.col("d").eqNullSafe(F.col("last")))
    return drop.unionByName(late.select("d", "r", "p"))


def _runs(dropped: Column, n_lines: Column) -> Column:
    """Sorted positions to alternating run lengths: kept, dropped, kept, ..."""

    def body(p):
        first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
        last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))

        def pairs(e):
            return F.transform(first, lambda s, i: F.array(F.when(i == 0, s).otherwise(s - F.get(e, i - 1) - 1), F.get(e, i) - s + 1))

        return let(last, lambda e: F.concat(F.flatten(pairs(e)), F.array(n_lines - 1 - F.get(e, F.size(e) - 1))))

    return F.when(dropped.isNull(), F.array(n_lines)).otherwise(let(dropped, body))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep_runs (array of ints: lines kept, dropped, kept, ... from the top)."""
    return _with_bitmaps(docs, min_chars, min_docs).select(
        F.col("d").alias("doc_id"), F.col("r").alias("text_hash"), "n_lines", "n_dropped", "keep_runs"
    )


def _with_bitmaps(docs: DataFrame, min_chars: int, min_docs: int, whole: bool = False) -> DataFrame:
    drop = repeats(docs, min_chars, min_docs).groupBy(F.col("d").alias("dd"), F.col("r").alias("rr")).agg(F.array_sort(F.collect_set("p")).alias("at"))
    src = _source(docs, whole)
    return (
        src.join(drop, F.col("d").eqNullSafe(F.col("dd")) & (F.col("r") == F.col("rr")), "left")
        .withColumn("n_lines", (F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1).cast("int"))
        .withColumn("n_dropped", F.when(F.col("at").isNull(), 0).otherwise(F.size("at")))
        .withColumn("keep_runs", _runs(F.col("at"), F.col("n_lines")))
    )


def apply_runs(text: Column, runs: Column) -> Column:
    """The lines of ``text`` that the bitmap keeps, joined by \\n; linear in the text."""
    mask = F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))
    return F.when(F.size(runs) == 1, text).otherwise(
        let(mask, lambda m: F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.get(m, i)), "\n"))
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, text (the kept lines)."""
    out = _with_bitmaps(docs, min_chars, min_docs)
    return out.select(F.col("d").alias("doc_id"), F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), apply_runs(F.col("t"), F.col("keep_runs")).alias("text"))


def rewrite(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the dropped lines gone from ``text``, and ``n_chars``, where there is one, counted anew."""
    out = _with_bitmaps(docs, min_chars, min_docs, whole=True)
    text = F.when(F.col("n_dropped") == 0, F.col("row.text")).otherwise(apply_runs(F.col("t"), F.col("keep_runs")))
    out = out.withColumn("new", text)
    new = {"text": F.col("new")} | ({"n_chars": F.length("new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return out.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])
