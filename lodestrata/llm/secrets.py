r"""Operator 2: secret scan with multipart credential linking (DataFrame functions only).

Strong findings stand alone: keyword assignments with a value of 12 or more
characters (``assign``), access identifiers (``access``) and hexadecimal runs
(``hex``).  Weak candidates - user names (``user``), endpoints (``endpoint``)
and opaque tokens or keyword assignments with a value of 4 or more characters
(``opaque``) - mean nothing alone; they are reported only when the complementary
parts of a credential occur within ``SCOPE`` code points in the same document: an
``opaque`` needs an identifier, a ``user`` needs a secret, an ``endpoint`` needs
both.

Plan: one scan per text turns matches into (document, kind, lengths) rows
without text.  ``\G`` ties each match to the end of the previous one, so running
sums of lengths give exact positions.  The interval join of parts within a scope
is a sort-sweep: over a document's parts in order of start, running aggregates
from the left and from the right tell the nearest complementary part, so the
work is linear in the parts and no pairs are emitted.  Rows are spread by
document; a hot source makes no hot key.

Defined cases: a null text counts as empty; rows equal in doc_id and text are
one document, each row getting its result; rows equal in doc_id but not in text
are kept apart; a null doc_id is a document; extra columns are ignored; an empty
table gives no rows.  Positions are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCOPE = 200
_ASSIGN = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group of the value inside it (0: whole match), least length of that.
KINDS = [
    ("assign", rf"((?i:password|passwd|secret|token|api_?key)){_ASSIGN}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("user", rf"((?i:username|user|login|client_id)){_ASSIGN}([A-Za-z0-9._@-]+)", 2, 3),
    ("endpoint", r"https?://[A-Za-z0-9._~:/?#@!$&'()*+,;=%-]+|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", 0, 7),
    ("opaque", rf"(?i:password|passwd|secret|token|api_?key|pass|pwd|key|auth){_ASSIGN}[A-Za-z0-9+/_.=-]{{4,}}|[A-Za-z]{{0,12}}[0-9][A-Za-z0-9+/_-]{{15,}}", 0, 1),
]
BASE = 3  # the first kinds are reported wherever they are


def _matches(text: Column, number: int) -> Column:
    """Array of (kind, all: length since the last match, own: length of the match, ok)."""
    kind, pattern, value, least = KINDS[number]
    tied = F.lit(rf"(?s)\G(.*?)({pattern})")

    def group(n):
        return F.regexp_extract_all(text, tied, F.lit(n))

    lengths = F.zip_with(F.transform(group(0), F.length), F.transform(group(2), F.length), lambda a, o: F.struct(a.alias("a"), o.alias("o")))
    valued = F.transform(group(2 + value), F.length) if value else F.transform(group(2), F.length)
    rows = F.zip_with(lengths, valued, lambda x, v: F.struct(F.lit(number).alias("kind"), x["a"].alias("a"), x["o"].alias("o"), (v >= least).alias("ok")))
    return F.when(text.rlike(pattern), F.transform(rows, lambda x, i: F.struct(x["kind"], i.alias("i"), x["a"], x["o"], x["ok"])))


def find_parts(docs: DataFrame) -> DataFrame:
    """(d, r, kind, s, e): every part of a credential, strong or weak; kind is a number in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    src = docs.select(F.col("doc_id").alias("d"), F.xxhash64(text).alias("r"), F.monotonically_increasing_id().alias("u"), text.alias("t"))
    # one explode a kind, so that no kind's matches hold up another's
    found = src.select("d", "r", "u", F.explode(F.filter(F.array(*[_matches(F.col("t"), k) for k in range(len(KINDS))]), lambda x: x.isNotNull())).alias("m"))
    rows = found.select("d", "r", "u", F.inline("m"))
    order = Window.partitionBy("d", "r", "u", "kind").orderBy("i")
    ends = rows.repartition("d", "r").withColumn("e", F.sum("a").over(order)).where("ok")
    return ends.select("d", "r", "kind", (F.col("e") - F.col("o")).alias("s"), "e").distinct()


def link_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The base parts and the weak ones whose complement lies within the scope."""
    k = F.col("kind")
    is_base, is_id, is_secret = k < BASE, k.isin(1, 3), k.isin(0, 2, 5)
    doc = Window.partitionBy("d", "r")
    left = doc.orderBy("s", "kind", "e").rowsBetween(Window.unboundedPreceding, -1)
    right = doc.orderBy(F.desc("s"), F.desc("kind"), F.desc("e")).rowsBetween(Window.unboundedPreceding, -1)
    for name, which in (("base", is_base), ("id", is_id), ("secret", is_secret)):
        parts = parts.withColumn(f"{name}_before", F.max(F.when(which, F.col("e"))).over(left))
    for name, which in (("base", is_base), ("id", is_id), ("secret", is_secret)):
        parts = parts.withColumn(f"{name}_after", F.min(F.when(which, F.col("s"))).over(right))

    def near(name):
        before = F.col("s") - F.col(f"{name}_before") <= scope
        after = F.col(f"{name}_after") - F.col("e") <= scope
        return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

    apart = F.coalesce(F.col("base_before") <= F.col("s"), F.lit(True)) & F.coalesce(F.col("base_after") >= F.col("e"), F.lit(True))
    linked = ((k == 5) & near("id")) | ((k == 3) & near("secret")) | ((k == 4) & near("id") & near("secret"))
    return parts.where(is_base | (apart & linked)).select("d", "r", "kind", "s", "e")


def scan_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, spans: array of (start, kind number, end), by start, then kind."""
    found = link_parts(find_parts(docs), scope)
    by_doc = found.groupBy(F.col("d").alias("fd"), F.col("r").alias("fr")).agg(F.sort_array(F.collect_list(F.struct("s", "kind", "e"))).alias("spans"))
    ids = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("r"))
    joined = ids.join(by_doc, F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("r") == F.col("fr")), "left")
    return joined.select("doc_id", F.coalesce("spans", F.expr("array()").cast("array<struct<s:bigint,kind:int,e:bigint>>")).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text)."""
    names = F.array(*[F.lit(x[0]) for x in KINDS])

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"].cast("string"), x["e"].cast("string"))), ",")

    def count(number):
        return F.size(F.filter("spans", lambda x: x["kind"] == number)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] < BASE)
    return scanned.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )
