"""Similarity scalars, fusion and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions.columns import cosine, hashed_set, rhyme
from ...operators import text as X
from ...operators.fold import with_blocks
from ..registry import query

W = r"list_filter(regexp_split_to_array(lower({0}), '[ \t\n\r\f\v]+'), lambda x: x <> '')"
S = "list_distinct(" + W + ")"
JAC = "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN {e} ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END"
_PAIRS = """asked AS MATERIALIZED (SELECT item_id AS a, text AS ta FROM benchmark), texts AS MATERIALIZED (SELECT doc_id AS b, text AS tb FROM documents), pairs AS (SELECT * FROM asked, texts)"""


def pairs(t):
    """Every benchmark item, a stated query set, with every document; what belongs to one side is computed before they meet."""
    text = F.col("text")
    b = t.queries.select(F.col("item_id").alias("a"), X.person_names(text).alias("names"))
    docs = t.drawers.select(F.col("doc_id").alias("b"), F.lower(text).alias("low"))
    return with_blocks(docs, b, lambda rows, block: rows.join(block))


def _against(t):
    return X.against_queries(t.drawers.select(F.col("doc_id").alias("b"), "text"), t.queries.select(F.col("item_id").alias("a"), "text"))


def _overlaps(t):
    return X.term_overlaps(t.queries.select(F.col("item_id").alias("a"), "text"), t.drawers.select(F.col("doc_id").alias("b"), "text"))


_J = JAC.format(a="wa", b="wb", e="1.0")
_TERMS = f"""ta AS (SELECT item_id AS a, t, count(*) AS n FROM (SELECT item_id, unnest({W.format('text')}) AS t FROM benchmark) GROUP BY ALL), tb AS (SELECT doc_id AS b, t, count(*) AS n FROM (SELECT doc_id, unnest({W.format('text')}) AS t FROM documents) GROUP BY ALL),
  la AS (SELECT a, sum(n) AS len, count(*) AS kinds FROM ta GROUP BY a), lb AS (SELECT b, sum(n) AS len, count(*) AS kinds FROM tb GROUP BY b),
  shared AS (SELECT a, b, sum(least(ta.n, tb.n)) AS s, count(*) AS k FROM ta JOIN tb USING (t) GROUP BY a, b), full_ AS (SELECT a, b, s, k, la.len AS na, lb.len AS nb, la.kinds AS ka, lb.kinds AS kb FROM shared JOIN la USING (a) JOIN lb USING (b))"""


@query("x01_jaccard", None, f"WITH {_TERMS} SELECT a, b, round(k / (ka + kb - k), 6) AS similarity FROM full_")
def _(t):
    return _overlaps(t).select("a", "b", F.round(F.col("kinds") / (F.col("ka") + F.col("kb") - F.col("kinds")), 6).alias("similarity"))


@query("x02_rhyme", None, f"WITH {_TERMS} SELECT a, b, round(4 * j * (1 - j * j) / (8 / (3 * sqrt(3))), 6) AS resonance FROM (SELECT a, b, k / (ka + kb - k) AS j FROM full_)")
def _(t):
    return _overlaps(t).select("a", "b", F.round(rhyme(F.col("kinds") / (F.col("ka") + F.col("kb") - F.col("kinds"))), 6).alias("resonance"))


@query("x05_term_overlap", None, f"WITH {_TERMS} SELECT a, b, round(s / greatest(na, nb), 6) AS overlap FROM full_")
def _(t):
    return _overlaps(t).select("a", "b", F.round(F.col("shared") / F.greatest("na", "nb"), 6).alias("overlap"))


@query("x20_token_f1", None, f"WITH {_TERMS} SELECT a, b, round(2 * s / (na + nb), 6) AS f1 FROM full_")
def _(t):
    return _overlaps(t).select("a", "b", F.round(2 * F.col("shared") / (F.col("na") + F.col("nb")), 6).alias("f1"))


@query("x03_rhyme_clusters", None, f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, unnest({S.format('text')}) AS word FROM documents), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
  shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS s FROM w x JOIN w y ON x.word = y.word AND x.doc_id < y.doc_id GROUP BY ALL),
  l AS MATERIALIZED (SELECT a, b, r FROM (SELECT a, b, s / (x.n + y.n - s) AS j, 4 * j * (1 - j * j) / (8 / (3 * sqrt(3))) AS r FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b) WHERE round(r, 6) >= 0.3),
  e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), cc AS (SELECT a AS node, a AS comp FROM e UNION SELECT b, comp FROM cc JOIN e ON node = a), part AS (SELECT node, min(comp) AS component FROM cc GROUP BY node)
  SELECT component, size, resonance FROM (SELECT component, count(*) AS size FROM part GROUP BY component) JOIN (SELECT component, round(sum(CAST(round(r * 1000000) AS BIGINT)) / count(*)) / 1000000 AS resonance FROM l JOIN part ON node = a GROUP BY component) USING (component)""")
def _(t):
    return X.cluster_by_rhyme(t.raw("documents").select(F.col("doc_id").alias("id"), "text"), 0.3)


@query("x04_near_duplicates", None, f"""WITH i AS MATERIALIZED (SELECT *, len(words) AS n FROM (SELECT doc_id AS id, {S.format('text')} AS words FROM documents)),
  p AS (SELECT x.id AS a, y.id AS b, x.n + y.n AS total, len(list_intersect(x.words, y.words)) AS shared FROM i x JOIN i y ON y.id BETWEEN x.id + 1 AND x.id + 150 AND least(x.n, y.n) >= 0.85 * greatest(x.n, y.n))
  SELECT a, b, similarity FROM (SELECT a, b, round(CASE WHEN total = 0 THEN 1.0 ELSE shared / (total - shared) END, 6) AS similarity FROM p) WHERE similarity >= 0.85""")
def _(t):
    return X.near_duplicates(t.drawers.select(F.col("doc_id").alias("id"), hashed_set(F.col("text")).alias("words"), (F.col("doc_id") * 2000).alias("ts")))


@query("x06_cosine", "vectors", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v)), 6) AS similarity FROM vectors a JOIN vectors b ON b.vec_id = a.vec_id + 1")
def _(t):
    a = t.vectors.select(F.col("vec_id").alias("a"), F.col("v").alias("va"))
    b = t.vectors.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, "a").select("a", "b", F.round(cosine(F.col("va"), F.col("vb")), 6).alias("similarity"))


def _sketches(t):
    e = t.log.select(F.col("node_id").alias("owner"), (F.col("k") % 8).cast("string").alias("source_kind"), F.when(F.col("event_type") == "view", "derived_from").otherwise(F.col("event_type")).alias("kind"), F.floor(F.col("value") / 10).cast("string").alias("target_kind"))
    return X.graph_sketch(e)


_EDGE_W = "CASE kind " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in X.EDGE_WEIGHTS.items()) + " ELSE 2 END"
_SKETCH = f"""steps AS (SELECT DISTINCT node_id AS owner, concat(k % 8, '|', kind, '|', CAST(floor(value / 10) AS BIGINT)) AS step, {_EDGE_W} AS w FROM (SELECT node_id, k, value, CASE WHEN event_type = 'view' THEN 'derived_from' ELSE event_type END AS kind FROM log)),
  minima AS (SELECT step, s, min(('0x' || substr(md5(concat(s, '|', step, '|', copy)), 1, 15))::BIGINT) AS h FROM (SELECT DISTINCT step, w FROM steps), range(128) r(s), range(1, 9) c(copy) WHERE copy <= w GROUP BY step, s),
  sketch AS (SELECT owner, s, min(h) AS h FROM steps JOIN minima USING (step) GROUP BY owner, s)"""


@query("x07_graph_sketch", "log", "SELECT owner, string_agg(CAST(h AS VARCHAR), ',' ORDER BY s) AS head FROM sketch WHERE s < 8 GROUP BY owner", _SKETCH)
def _(t):
    return _sketches(t).select("owner", F.array_join(F.transform(F.slice("sketch", 1, 8), lambda x: x.cast("string")), ",").alias("head"))


@query("x08_sketch_jaccard", "log", "SELECT a.owner AS a, b.owner AS b, round(avg((a.h = b.h)::INT::DOUBLE), 6) AS similarity FROM sketch a JOIN sketch b ON b.owner = a.owner + 1 AND a.s = b.s GROUP BY 1, 2", _SKETCH)
def _(t):
    s = _sketches(t)
    a, b = s.select(F.col("owner").alias("a"), F.col("sketch").alias("sa")), s.select((F.col("owner") - 1).alias("a"), F.col("owner").alias("b"), F.col("sketch").alias("sb"))
    return a.join(b, "a").select("a", "b", F.round(X.sketch_jaccard(F.col("sa"), F.col("sb")), 6).alias("similarity"))


@query("x09_schema_fingerprint", None, "SELECT p_partkey, substring(sha256(concat(p_partkey, '|', p_type, '|', p_size)), 1, 16) AS fingerprint FROM part")
def _(t):
    return t.raw("part").select("p_partkey", X.schema_fingerprint(F.col("p_partkey"), F.col("p_type"), F.col("p_size")).alias("fingerprint"))


@query("x10_velocity_correlation", "log", """SELECT a.node_id AS a, b.node_id AS b, round(coalesce(CASE WHEN isnan(corr(a.n, b.n)) THEN 0 ELSE corr(a.n, b.n) END, 0), 6) AS correlation FROM c a JOIN c b ON b.node_id = a.node_id + 1 AND a.bin = b.bin GROUP BY 1, 2""",
    "c AS (SELECT node_id, k % 10 AS bin, CAST(count(*) AS DOUBLE) AS n FROM log GROUP BY 1, 2)")
def _(t):
    c = t.log.groupBy("node_id", (F.col("k") % 10).alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    a, b = c.select(F.col("node_id").alias("a"), "bin", F.col("n").alias("x")), c.select((F.col("node_id") - 1).alias("a"), F.col("node_id").alias("b"), "bin", F.col("n").alias("y"))
    r = F.corr("x", "y")
    return a.join(b, ["a", "bin"]).groupBy("a", "b").agg(F.round(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), 6).alias("correlation"))


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_NOT = ", ".join(f"'{w}'" for w in X.NOT_NAMES)
# a word between word boundaries is a whole run of letters, digits and _
_RUNS = r"regexp_split_to_array({0}, '[^\p{{L}}\p{{N}}_]+')"
_KW = f"list_filter({_RUNS.format('lower(ta)')}, lambda w: regexp_full_match(w, '[a-z]{{3,}}') AND w NOT IN ({_STOP}))"
_OVER = f"CASE WHEN len(kw) = 0 THEN 0 ELSE len(list_filter(kw, lambda w: contains(lower(tb), w))) / len(kw) END"
_KEYED = f"keyed AS (SELECT a, b, ta, tb, {_KW} AS kw FROM pairs)"


@query("x11_keyword_overlap", None, f"WITH {_PAIRS}, {_KEYED} SELECT a, b, round({_OVER}, 6) AS overlap FROM keyed")
def _(t):
    return _against(t).select("a", "b", F.round("overlap", 6).alias("overlap"))


@query("x12_name_boost", None, rf"""WITH {_PAIRS}, {_KEYED} SELECT a, b, round(CASE WHEN len(n) = 0 THEN 0 ELSE len(list_filter(n, lambda w: contains(lower(tb), lower(w)))) / len(n) END, 6) AS boost
  FROM (SELECT a, b, tb, list_filter(list_distinct({_RUNS.format('ta')}), lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,15}}') AND w NOT IN ({_NOT})) AS n FROM keyed)""")
def _(t):
    return pairs(t).select("a", "b", F.round(X.contained_share(F.col("names"), F.col("low")), 6).alias("boost"))


@query("x13_fused_distance", None, f"""WITH {_TERMS}, {_PAIRS}, {_KEYED} SELECT a, b, round((1 - coalesce(j, 0)) * (1 - 0.3 * {_OVER}), 6) AS distance FROM keyed LEFT JOIN (SELECT a, b, k / (ka + kb - k) AS j FROM full_) USING (a, b)""")
def _(t):
    return _against(t).select("a", "b", F.round(X.fuse(1 - F.col("similarity"), F.col("overlap")), 6).alias("distance"))


@query("x14_temporal_boost", "log", """SELECT "offset", days, round(CASE WHEN abs(apart - days) <= tol THEN 0.4 WHEN abs(apart - days) >= 3 * tol THEN 0 ELSE 0.4 * (3 * tol - abs(apart - days)) / (2 * tol) END, 6) AS boost FROM (
  SELECT "offset", node_id % 40 AS apart, CASE k % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 14 ELSE 30 END AS days, CASE k % 4 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 5 ELSE 7 END AS tol FROM log)""")
def _(t):
    phrase = F.get(F.array(*[F.lit(x) for x in ("we met 3 days ago", "Yesterday", "about 2 weeks ago", "last month")]), (F.col("k") % 4).cast("int"))
    d = X.relative_days(phrase)
    return t.log.select("offset", d["days"].alias("days"), F.round(X.temporal_boost(F.col("node_id") % 40 - d["days"], d["tolerance"]), 6).alias("boost"))


@query("x15_best_per_corpus", "vectors", """SELECT qid, corpus, vec_id, distance, row_number() OVER (PARTITION BY qid ORDER BY distance, vec_id) AS rank FROM (SELECT qid, label AS corpus, arg_min(vec_id, row(distance, vec_id)) AS vec_id, min(distance) AS distance FROM (
  SELECT qid, label, v.vec_id, round(1 - list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS distance FROM vectors v, (SELECT vec_id AS qid, v AS q FROM vectors WHERE vec_id % 50 = 0)) GROUP BY qid, label)""")
def _(t):
    asked = t.vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))
    n = with_blocks(t.vectors, asked, lambda rows, block: rows.join(block)).select("qid", "vec_id", F.col("label").alias("corpus"), F.round(1 - cosine(F.col("q"), F.col("v")), 6).alias("distance"))
    best = n.groupBy("qid", "corpus").agg(F.min_by("vec_id", F.struct("distance", "vec_id")).alias("vec_id"), F.min("distance").alias("distance"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "vec_id")))


_ROOMS = {"alpha": ("th", "he", "qu"), "beta": ("au", "oi", "ie"), "gamma": ("sch", "ung", "ei")}


def _count(words, expr):
    return " + ".join(f"contains({expr}, '{w}')::INT" for w in words)


@query("x16_room_class", "drawers", f"""SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'general' WHEN a = greatest(a, b, c) THEN 'alpha' WHEN b = greatest(a, b, c) THEN 'beta' ELSE 'gamma' END AS class
  FROM (SELECT doc_id, {_count(_ROOMS['alpha'], 's')} AS a, {_count(_ROOMS['beta'], 's')} AS b, {_count(_ROOMS['gamma'], 's')} AS c FROM (SELECT doc_id, lower(substring(text, 1, 3000)) AS s FROM drawers))""")
def _(t):
    return t.drawers.select("doc_id", X.keyword_class(F.col("text"), _ROOMS, "general", 3000).alias("class"))


_RANKED = """ranked AS (SELECT node_id AS qid, row_number() OVER (PARTITION BY node_id ORDER BY value DESC, "offset") AS rank, CAST(k < 10 AS BIGINT) AS relevant, sum(CAST(k < 10 AS BIGINT)) OVER (PARTITION BY node_id) AS answers FROM log)"""


@query("x19_retrieval_scores", "log", """SELECT qid, round(CASE WHEN found = 0 THEN 0 ELSE dcg / list_sum(list_transform(range(1, greatest(1, least(found, 10))::BIGINT + 1), lambda i: 1 / log2(i + 1))) END, 6) AS ndcg, hits > 0 AS recall_any, hits >= answers AS recall_all FROM (
  SELECT qid, sum(relevant / log2(rank + 1)) FILTER (rank <= 10) AS dcg, sum(relevant) FILTER (rank <= 10) AS hits, sum(relevant) AS found, max(answers) AS answers FROM ranked GROUP BY qid)""", _RANKED)
def _(t):
    w = Window.partitionBy("qid")
    r = t.log.select(F.col("node_id").alias("qid"), "value", "offset", (F.col("k") < 10).cast("long").alias("relevant"))
    return X.retrieval_scores(r.withColumn("rank", F.row_number().over(w.orderBy(F.desc("value"), "offset"))).withColumn("answers", F.sum("relevant").over(w)), 10)


@query("x21_edit_distance", None, "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name) AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def _(t):
    p = t.raw("part")
    b = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(b, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


@query("x23_transforms", "drawers", r"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)), lambda s: trim(s, ' ' || chr(9) || chr(13) || chr(12) || chr(11))), lambda s: s <> ''), ' ')) AS digest FROM drawers""")
def _(t):
    x = X.transform(F.col("text"), "newline_normalize", "whitespace_collapse_internal", "line_join_spaces")
    return t.drawers.select("doc_id", F.sha2(x.cast("binary"), 256).alias("digest"))


@query("x24_names", None, "SELECT c_custkey, replace(replace(lower(concat(c_name, ' ', c_mktsegment)), ' ', '_'), '-', '_') AS wing, regexp_matches(c_name, '^[A-Za-z0-9_][A-Za-z0-9_ .''-]*$') AS valid FROM customer")
def _(t):
    c = t.raw("customer")
    return c.select("c_custkey", X.wing_name(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("wing"), X.valid_name(F.col("c_name")).alias("valid"))
