"""Drawer store, search and triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.columns import tokens
from ...operators import store as K
from ..registry import query

AS_OF = 883_612_800_000
_COS = "list_dot_product(q, v) / sqrt(list_dot_product(q, q) * list_dot_product(v, v))"
_ASK = "ask AS (SELECT vec_id AS qid, v AS q FROM vectors WHERE vec_id % 50 = 0)"
_TOP = f"""top AS (SELECT * FROM (SELECT qid, vec_id, round(1 - {_COS}, 6) AS distance, row_number() OVER (PARTITION BY qid ORDER BY round(1 - {_COS}, 6), vec_id) AS rank FROM vectors, ask) WHERE rank <= 10)"""


def _asked(t):
    """Every fiftieth vector as a stated query set against all."""
    return t.vectors.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("v").alias("q"))


@query("k01_vector_top_k", "vectors", "SELECT * FROM top", _ASK, _TOP)
def _(t):
    return K.nearest(t.vectors, _asked(t), 10)


@query("k02_collection_get", "drawers", "SELECT doc_id, wing, room FROM drawers WHERE wing = 'src1' ORDER BY doc_id LIMIT 10 OFFSET 5")
def _(t):
    return K.get(t.drawers, {"wing": "src1"}, "doc_id", 10, 5).select("doc_id", "wing", "room")


@query("k03_where_grammar", "drawers", """SELECT doc_id FROM drawers WHERE (wing IN ('src1', 'src2') OR n_chars > 5000) AND room <> 'en' AND n_chars >= 100 AND contains(text, 'a') AND wing NOT IN ('src2')""")
def _(t):
    condition = {"$and": [{"$or": [{"wing": {"$in": ["src1", "src2"]}}, {"n_chars": {"$gt": 5000}}]}, {"room": {"$ne": "en"}, "n_chars": {"$gte": 100}, "text": {"$contains": "a"}, "wing": {"$nin": ["src2"]}}]}
    return t.drawers.where(K.where(condition)).select("doc_id")


@query("k04_upsert", "drawers", "SELECT room, count(*) AS n FROM (SELECT CASE WHEN wing = 'src3' THEN 'moved' ELSE room END AS room FROM drawers) GROUP BY room")
def _(t):
    base = t.drawers.select("doc_id", "wing", "room")
    new = base.where("wing = 'src3'").withColumn("room", F.lit("moved"))
    return K.upsert(base, new, "doc_id").groupBy("room").agg(F.count(F.lit(1)).alias("n"))


@query("k04_update", "drawers", "SELECT doc_id, wing, CASE WHEN wing = 'src3' THEN 'moved' ELSE room END AS room FROM drawers UNION ALL SELECT -1, NULL, 'new'")
def _(t):
    base = t.drawers.select("doc_id", "wing", "room")
    patch = base.where("wing = 'src3'").select("doc_id", F.lit("moved").alias("room")).unionByName(t.spark.createDataFrame([(-1, "new")], "doc_id long, room string"))
    return K.update(base, patch, "doc_id")


@query("k05_all_vectors_best", "vectors", f"SELECT qid, arg_max(vec_id, row(s, -vec_id)) AS best FROM (SELECT qid, vec_id, round({_COS}, 6) AS s FROM vectors, ask WHERE vec_id <> qid) GROUP BY qid", "ask AS (SELECT vec_id AS qid, v AS q FROM vectors WHERE vec_id % 50 = 0)")
def _(t):
    near = K.nearest(t.vectors, _asked(t), 2).where("vec_id <> qid")
    return near.groupBy("qid").agg(F.min_by("vec_id", F.struct("distance", "vec_id")).alias("best"))


@query("k06_list_wings", "drawers", "SELECT coalesce(wing, 'unknown') AS wing, count(*) AS n FROM drawers GROUP BY 1")
def _(t):
    return K.counts(t.drawers, "wing")


@query("k07_list_rooms", "drawers", "SELECT room, count(*) AS n FROM drawers WHERE wing = 'src5' GROUP BY room")
def _(t):
    return K.counts(t.drawers.where("wing = 'src5'"), "room")


@query("k08_taxonomy", "drawers", "SELECT wing, room, count(*) AS n FROM drawers GROUP BY ROLLUP (wing, room)")
def _(t):
    return K.taxonomy(t.drawers)


@query("k09_status", "drawers", "SELECT count(*) AS total, count(DISTINCT wing) AS wings, count(DISTINCT room) AS rooms FROM drawers")
def _(t):
    return K.status(t.drawers)


_BM25 = r"""asked AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS term FROM benchmark),
  words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS term FROM drawers),
  lengths AS (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS len FROM drawers),
  tf AS (SELECT term, doc_id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
  idf AS (SELECT term, ln(1 + ((SELECT count(*) FROM lengths) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY term),
  scored AS (SELECT qid, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / (SELECT avg(len) FROM lengths)))), 6) AS score
    FROM asked JOIN tf USING (term) JOIN idf USING (term) JOIN lengths USING (doc_id) GROUP BY 1, 2)"""


def _bm25(t):
    asked = t.queries.select(F.col("item_id").alias("qid"), F.array_distinct(tokens(F.col("text"))).alias("terms"))
    return K.bm25(t.drawers, asked)


@query("k10_search", "drawers", "SELECT qid, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scored) WHERE rank <= 10", _BM25)
def _(t):
    from ...operators.fold import keep_top

    return keep_top(_bm25(t), ["qid"], [F.desc("score"), F.col("doc_id")], 10)


@query("k12_bm25", "drawers", "SELECT qid, count(*) AS n, max(score) AS best, round(avg(score), 4) AS mean FROM scored GROUP BY qid", _BM25)
def _(t):
    return _bm25(t).groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.round(F.avg("score"), 4).alias("mean"))


_CLOSETS = """closets AS (SELECT qid, label AS source_file, rank AS closet_rank FROM (SELECT qid, label, row_number() OVER (PARTITION BY qid ORDER BY min(distance), label) AS rank
  FROM top JOIN vectors USING (vec_id) GROUP BY qid, label) WHERE rank <= 3)"""


@query("k11_closet_boost", "vectors", """SELECT t.qid, t.vec_id AS doc_id, v.label AS source_file, round(distance - coalesce([0.15, 0.10, 0.05][closet_rank], 0), 6) AS effective,
  CAST(coalesce([0.15, 0.10, 0.05][closet_rank], 0) AS DOUBLE) AS closet_boost, CASE WHEN closet_rank IS NOT NULL THEN 'drawer+closet' ELSE 'drawer' END AS matched_via
  FROM top t JOIN vectors v ON v.vec_id = t.vec_id LEFT JOIN closets c ON c.qid = t.qid AND c.source_file = v.label""", _ASK, _TOP, _CLOSETS)
def _(t):
    from pyspark.sql.window import Window

    hits = K.nearest(t.vectors, _asked(t), 10).join(t.vectors.select("vec_id", F.col("label").alias("source_file")), "vec_id").withColumnRenamed("vec_id", "doc_id")
    groups = hits.groupBy("qid", "source_file").agg(F.min("distance").alias("d"))
    closets = groups.withColumn("closet_rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "source_file"))).where("closet_rank <= 3").drop("d")
    return K.closet_boost(hits, closets)


@query("k12_hybrid", "drawers vectors", """SELECT t.qid, t.vec_id AS doc_id, distance, score AS bm25, round(0.6 * greatest(0, 1 - distance) + 0.4 * coalesce(score, 0) / (1 + coalesce(score, 0)), 6) AS hybrid
  FROM top t LEFT JOIN scored s ON s.qid = t.qid AND s.doc_id = t.vec_id""", _ASK, _TOP, _BM25)
def _(t):
    near = K.nearest(t.vectors, _asked(t), 10).withColumnRenamed("vec_id", "doc_id").drop("rank")
    return K.hybrid(near, _bm25(t))


@query("k13_check_duplicate", "vectors", "SELECT qid, vec_id, round(1 - distance, 3) AS similarity FROM top WHERE rank <= 5 AND round(1 - distance, 3) >= 0.9", _ASK, _TOP)
def _(t):
    return K.duplicates_of(t.vectors, _asked(t))


@query("k14_list_drawers", "drawers", "SELECT doc_id, wing, room, CASE WHEN length(text) > 200 THEN concat(substring(text, 1, 200), '...') ELSE text END AS preview FROM drawers ORDER BY doc_id LIMIT 20 OFFSET 40")
def _(t):
    return K.list_drawers(t.drawers, 20, 40)


@query("k15_source_dedup")
def _(t):
    return K.source_dedup(t.vectors.select(F.col("label").cast("long").alias("group"), "vec_id", "v"), 0.15)


@query("k16_add_triples", "triples", "SELECT subject, count(*) AS n FROM (SELECT subject, predicate, object FROM triples UNION ALL SELECT subject, predicate, object FROM triples WHERE valid_to IS NOT NULL) GROUP BY subject")
def _(t):
    base = t.triples.select("subject", "predicate", "object", "valid_from", "valid_to")
    again = base.withColumn("valid_to", F.lit(None).cast("long"))
    return K.add_triples(base, again).groupBy("subject").agg(F.count(F.lit(1)).alias("n"))


@query("k17_query_entity", "triples", f"""SELECT entity, subject, object, valid_from, valid_to, direction, valid_to IS NULL AS current FROM (
  SELECT *, subject AS entity, 'outgoing' AS direction FROM triples UNION ALL SELECT *, object, 'incoming' FROM triples) WHERE valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to >= {AS_OF})""")
def _(t):
    return K.query_entity(t.triples.select("subject", "predicate", "object", "valid_from", "valid_to"), None, AS_OF).drop("predicate")


@query("k18_query_relationship", "triples", f"SELECT subject, object FROM triples WHERE predicate = 'placed' AND valid_from <= {AS_OF} AND (valid_to IS NULL OR valid_to >= {AS_OF})")
def _(t):
    return t.triples.where("predicate = 'placed'").where(K.in_force(AS_OF)).select("subject", "object")


@query("k19_timeline", "triples", "SELECT subject, object, valid_from FROM triples ORDER BY valid_from NULLS LAST, subject, object LIMIT 100")
def _(t):
    return K.timeline(t.triples).select("subject", "object", "valid_from")


@query("k20_triple_stats", "triples", """SELECT (SELECT count(DISTINCT e) FROM (SELECT subject AS e FROM triples UNION ALL SELECT object FROM triples)) AS entities, count(*) AS triples,
  count(*) FILTER (valid_to IS NULL) AS current, count(valid_to) AS expired, count(DISTINCT predicate) AS predicates FROM triples""")
def _(t):
    return K.triple_stats(t.triples)


@query("k21_room_nodes", "drawers", "SELECT room, string_agg(DISTINCT wing, ',' ORDER BY wing) AS wings, count(*) AS n FROM drawers WHERE room <> 'general' AND coalesce(wing, '') <> '' GROUP BY room")
def _(t):
    return K.room_nodes(t.drawers)


@query("k21_room_edges", "drawers", "SELECT DISTINCT a.room, a.wing AS wing_a, b.wing AS wing_b FROM drawers a JOIN drawers b ON a.room = b.room AND a.wing < b.wing")
def _(t):
    return K.room_edges(t.drawers)


@query("k22_traverse_rooms", "drawers", "SELECT room, CASE WHEN room = 'en' THEN 0 ELSE 1 END AS hop FROM drawers WHERE wing IN (SELECT wing FROM drawers WHERE room = 'en') GROUP BY room")
def _(t):
    return K.traverse_rooms(t.drawers, "en")


@query("k23_find_tunnels", "drawers", "SELECT room, count(DISTINCT wing) AS n_wings, count(*) AS n FROM drawers GROUP BY room HAVING count(DISTINCT wing) >= 2 AND bool_or(wing = 'src1') AND bool_or(wing = 'src2')")
def _(t):
    return K.find_tunnels(t.drawers, "src1", "src2")


@query("k24_graph_stats", "drawers", "SELECT count(*) AS rooms, count(*) FILTER (w >= 2) AS tunnel_rooms, CAST(sum(w * (w - 1) // 2) AS BIGINT) AS edges FROM (SELECT room, count(DISTINCT wing) AS w FROM drawers GROUP BY room)")
def _(t):
    w = t.drawers.groupBy("room").agg(F.count_distinct("wing").alias("w"))
    return w.agg(F.count(F.lit(1)).alias("rooms"), F.sum((F.col("w") >= 2).cast("long")).alias("tunnel_rooms"), F.sum(F.floor(F.col("w") * (F.col("w") - 1) / 2)).alias("edges"))


@query("k25_fuzzy_rooms", "drawers", "SELECT DISTINCT wing AS room, 0 AS rank FROM drawers WHERE contains(wing, 'src1') ORDER BY wing LIMIT 5")
def _(t):
    return K.fuzzy_rooms(t.drawers.select(F.col("wing").alias("room")), "src1")


@query("k26_explicit_tunnels", "log", """SELECT least(node_id, k) AS a, greatest(node_id, k) AS b, max("offset") AS "offset", arg_max(event_type, "offset") AS label FROM log GROUP BY 1, 2""")
def _(t):
    return K.explicit_tunnels(t.log.select(F.col("node_id").alias("a"), F.col("k").alias("b"), "offset", F.col("event_type").alias("label")))


@query("k27_topic_tunnels", "log", """SELECT * FROM (SELECT topic, a.wing AS wing_a, b.wing AS wing_b, count(*) OVER (PARTITION BY a.wing, b.wing) AS shared, concat('topic:', topic) AS room
  FROM tp a JOIN tp b USING (topic) WHERE a.wing < b.wing) WHERE shared >= 8""", "tp AS (SELECT DISTINCT node_id AS wing, concat('t', k) AS topic FROM log WHERE event_type = 'view')")
def _(t):
    return K.topic_tunnels(t.log.where("event_type = 'view'").select(F.col("node_id").alias("wing"), F.concat(F.lit("T"), "k").alias("topic")), 8)


@query("k28_diary", "log", """SELECT agent, entry_id, filed_at, rank, total FROM (SELECT node_id AS agent, "offset" AS entry_id, ts_ms AS filed_at, row_number() OVER (PARTITION BY node_id ORDER BY ts_ms DESC, "offset" DESC) AS rank, count(*) OVER (PARTITION BY node_id) AS total FROM log) WHERE rank <= 10""")
def _(t):
    return K.diary(t.log.select(F.col("offset").alias("entry_id"), F.col("node_id").alias("agent"), F.col("ts_ms").alias("filed_at")), None, 10)


@query("k29_essential_layer", "drawers", """SELECT doc_id, room, importance, used FROM (SELECT *, CAST(sum(least(length(text), 203)) OVER (ORDER BY importance DESC, doc_id) AS BIGINT) AS used FROM (
  SELECT doc_id, room, text, n_chars % 97 AS importance FROM drawers ORDER BY importance DESC, doc_id LIMIT 15)) WHERE used <= 3200""")
def _(t):
    return K.essential_layer(t.drawers.withColumn("importance", F.col("n_chars") % 97))


@query("k32_sanitize_query", None, """SELECT item_id, CASE WHEN length(text) <= 200 THEN trim(text, ' ') ELSE coalesce(last_part, substring(text, length(text) - 249, 250)) END AS query FROM (
  SELECT item_id, text, list_filter(list_transform(string_split(replace(replace(text, '. ', '.' || chr(1)), chr(10), chr(10) || chr(1)), chr(1)), lambda x: trim(x, ' ' || chr(10))), lambda x: length(x) >= 10)[-1] AS last_part FROM benchmark)""")
def _(t):
    return t.queries.select("item_id", K.sanitize_query(F.col("text")).alias("query"))


@query("k31_export_markdown", "drawers", "SELECT wing, room, count(*) AS entries FROM drawers GROUP BY 1, 2")
def _(t):
    """Drawers written as markdown by wing and room, and read back."""
    from ...sources.adapters import export_markdown
    from ..settle import settle, shared_folder

    at = shared_folder(t.spark, "export")
    export_markdown(t.drawers.withColumn("text", F.lit("x")), at)
    lines = t.spark.read.text(at).where(F.col("value").startswith("## "))
    return settle(lines.groupBy("wing", "room").agg(F.count(F.lit(1)).alias("entries")))
