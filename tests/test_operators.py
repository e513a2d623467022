"""Micro fixtures: semantics that the driver's tables don't exercise."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import columns as c
from lodestrata.functions import udfs
from lodestrata.operators import fold, graph, ingest, logs, match, mine, retrieve, rules, store, text, views
from lodestrata.plans import registry
from lodestrata.sources import adapters, fixtures
from lodestrata.sources.tables import NOW_MS, Tables
from lodestrata.streaming import views as streams
from lodestrata.streaming.views_registry import VIEWS, Bridge

from . import oracle

SF = "/root/testdata/sf0.001"
LOG = "offset long, ts_ms long, event_type string, kind string, node_id long, k long, value double, field string"


def log(spark, *rows):
    kinds = {"signup": "node_created", "view": "node_accessed", "click": "node_accessed", "purchase": "node_property_set", "error": "node_invalidated"}
    fields = ("canonical", "importance", "canon_path")
    return spark.createDataFrame([(o, NOW_MS - 1000 + o, e, kinds[e], n, k, v, fields[k % 3] if e == "purchase" else None) for o, e, n, k, v in rows], LOG)


def test_node_fold_resets_and_drops_orphans(spark):
    rows = log(spark, (1, "purchase", 1, 0, 50.0), (2, "signup", 1, 9, 10.0), (3, "purchase", 1, 0, 50.0), (4, "signup", 2, 9, 20.0), (5, "purchase", 2, 0, 50.0), (6, "signup", 2, 9, 30.0), (7, "purchase", 3, 1, 5.0))
    got = {r["node_id"]: r for r in views.current_nodes(fixtures.node_events(rows)).collect()}
    assert set(got) == {1, 2}  # a set without a creation makes no node
    assert got[1]["canonical"] and got[1]["modified_offset"] == 3
    assert not got[2]["canonical"] and got[2]["created_offset"] == 6 and got[2]["properties"] == {"importance": "0.09"}  # created again
    raw = [(1, "node_created", 1, None, None), (2, "node_property_set", 1, "canonical", "true"), (3, "node_property_set", 1, "canonical", "3"), (4, "node_property_set", 1, "importance", "\"high\""), (5, "node_property_set", 1, "canon_path", "\"a\\\"b\""), (6, "node_property_set", 1, "mood", "{}"), (7, "node_property_set", 1, "importance", "2.5e-1")]
    events = spark.createDataFrame(raw, "offset long, kind string, node_id long, field string, value string")
    one = views.current_nodes(events).first()
    assert (one["canonical"], one["importance"], one["canon_path"]) == (True, 0.25, 'a"b') and one["properties"] == {"canonical": "3", "importance": "2.5e-1", "canon_path": '"a\\"b"', "mood": "{}"}
    assert views.current_nodes(events.unionByName(events.limit(0)).where("offset < 2")).first()["properties"] == {}


def test_heat_is_capped_decays_and_is_floored(spark):
    rows = log(spark, *[(i, "view", 1, 5, 1.0) for i in range(1, 21)], (30, "signup", 2, 5, 1.0), (31, "purchase", 2, 0, 99.0))
    got = {r["node_id"]: r["heat"] for r in views.heat_field(rows, NOW_MS).collect()}
    assert got[1] == pytest.approx(1.0, abs=1e-4) and got[2] == 0.95
    later = {r["node_id"]: r["heat"] for r in views.heat_field(rows, NOW_MS + 30 * c.DAY_MS).collect()}
    assert later[1] == pytest.approx(0.5, abs=1e-4) and later[2] == 0.95


def test_triples_as_of(spark):
    t = spark.createDataFrame([("alice", "works_at", "acme", 100, 200), ("alice", "works_at", "newco", 201, None)], "subject string, predicate string, object string, valid_from long, valid_to long")
    assert [r["object"] for r in store.query_entity(t, "alice", 150).collect()] == ["acme"]
    assert [r["object"] for r in store.query_entity(t, "alice", 300).collect()] == ["newco"]
    again = store.add_triples(t, t.withColumn("valid_to", F.lit(None).cast("long")))
    assert again.count() == 3  # the open one is not added twice
    stats = store.triple_stats(t).first()
    assert (stats["triples"], stats["current"], stats["expired"]) == (2, 1, 1)


def test_unknown_filter_operator_raises():
    with pytest.raises(store.UnknownOperator):
        store.where({"wing": {"$regex": "a"}})
    with pytest.raises(store.UnknownOperator):
        store.where({"$not": [{"wing": "a"}]})


def test_closets_only_boost(spark):
    hits = spark.createDataFrame([(1, 10, "a", 0.2), (1, 11, "b", 0.3)], "qid long, doc_id long, source_file string, distance double")
    closets = spark.createDataFrame([(1, "b", 1), (1, "zzz", 2)], "qid long, source_file string, closet_rank int")
    got = {r["doc_id"]: (r["effective"], r["matched_via"]) for r in store.closet_boost(hits, closets).collect()}
    assert got == {10: (0.2, "drawer"), 11: (0.15, "drawer+closet")}


def test_bm25_is_zero_without_overlap_and_favours_rare_terms(spark):
    docs = spark.createDataFrame([(1, "common rare"), (2, "common common"), (3, "common")], "doc_id long, text string")
    q = spark.createDataFrame([(1, ["rare"]), (2, ["common"]), (3, ["absent"])], "qid long, terms array<string>")
    got = {(r["qid"], r["doc_id"]): r["score"] for r in store.bm25(docs, q).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (2, 3)} and got[(1, 1)] > got[(2, 1)]


def test_walk_takes_the_best_path_within_hops(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 0.1), ("c", "d", 1.0), ("d", "e", 1.0), ("x", "y", 0.0)], "source string, target string, weight double")
    got = {r["node"]: round(r["weight"], 6) for r in graph.walk(e, spark.createDataFrame([("a",), ("x",)], "start string")).collect()}
    assert got == {"b": 0.7, "c": 0.49, "d": 0.343, "e": 0.0343}  # e only by the dear edge, weight 0 is never walked


def test_closure_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "source string, target string")
    got = {(r["node"], r["depth"]) for r in graph.closure(e, spark.createDataFrame([("a",)], "start string")).collect()}
    assert got == {("b", 1), ("c", 2), ("a", 3), ("d", 3)}


def test_validity_is_half_open(spark):
    e = spark.createDataFrame([(1, 10, 20, None), (2, 20, 30, None), (3, 10, None, 15), (4, None, None, None)], "edge_id long, valid_from long, valid_to long, invalidated_at long")
    assert {r["edge_id"] for r in graph.edges_valid_at(e, 20).collect()} == {2, 4}


def test_torn_batches_and_frontiers(spark):
    m = spark.createDataFrame([("a", 1, "started", 10), ("a", 1, "committed", 19), ("a", 2, "started", 20), ("b", 3, "started", 30), ("b", 3, "checkpointed", 35)], "consumer string, batch long, marker string, offset long")
    head = spark.createDataFrame([(40,)], "head long")
    assert {(r["consumer"], r["frontier"]) for r in logs.committed_frontiers(m, head).collect()} == {("a", 19), ("b", 35)}


def test_dense_numbers(spark):
    got = fold.dense_numbers(spark.range(1000).withColumn("x", F.col("id") % 7), ["x", "id"]).orderBy("x", "id").collect()
    assert [r["number"] for r in got] == list(range(1, 1001))


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 10), ("b", 1)], "k string, at long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 9, "y"), ("b", 2, "z")], "k string, t long, v string")
    got = {(r["k"], r["at"]): r["v"] for r in fold.asof(left, right, "k", "at", "t", ["v"]).collect()}
    assert got == {("a", 5): "x", ("a", 10): "y", ("b", 1): None}


def test_rhyme_curve(spark):
    row = spark.range(1).select(*[F.round(c.rhyme(F.lit(s)), 6).alias(n) for n, s in (("zero", 0.0), ("peak", 3**-0.5), ("one", 1.0))]).first()
    assert (row["zero"], row["peak"], row["one"]) == (0.0, 1.0, 0.0)


def test_rhymes_of_unlike_length_and_language(spark):
    common = " ".join(f"w{i}" for i in range(20))
    rows = [(5, common + " five"), (7, common + " " + " ".join(f"x{i}" for i in range(20))), (8, common + " FIVE"), (9, " ".join(f"y{i}" for i in range(30))), (10, ""), (11, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in text.cluster_by_rhyme(df, 0.3).collect()]
    one = 20 / 41  # 20 words shared of 21 and 40; documents 5 and 8 have one word set and resonate 0
    assert got == [(5, 3, round(4 * one * (1 - one * one) / (8 / (3 * 3**0.5)), 6))]
    many = [tuple(r) for r in text.rhyme_links(df.select("id", c.hashed_set(F.col("text")).alias("words")), 0.3, block=2).select("a", "b").collect()]
    assert sorted(many) == [(5, 7), (7, 8)]


def test_rhymes_are_counted_by_rows_of_bits_and_by_lists(spark, monkeypatch):
    from lodestrata.operators import resonance

    monkeypatch.setattr(resonance, "ROWS", 12)
    monkeypatch.setattr(resonance, "SPAN", 1)
    monkeypatch.setattr(resonance, "TOGETHER", 5)
    draw = random.Random(3)
    sets = {i * 7 % 1009: {int(40 * draw.random() ** 2) for _ in range(draw.randint(0, 30))} | {1000 + i} for i in range(300)}
    sets |= {2000 + i: {i * 50 + x for x in range(200, 240)} | {9000 + j for j in range(30 * (i % 2))} for i in range(8)} | {3000: set()}
    df = spark.createDataFrame([(i, sorted(x)) for i, x in sets.items()], "id long, words array<long>")
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            s = len(x & y) / max(1, len(x | y))
            if a < b and (r := round(4 * s * (1 - s * s) / (8 / (3 * 3**0.5)), 6)) >= 0.3:
                want[a, b] = r
    for block in (40, 65_536):
        assert {(r["a"], r["b"]): r["resonance"] for r in text.rhyme_links(df, 0.3, block=block).collect()} == want
    # clusters: the links of all copies, summed where they are found; no link of a set is listed by itself
    docs = [(i, " ".join(f"w{x}" for x in sorted(w))) for i, w in sets.items()] + [(i + 5000, " ".join(f"w{x}" for x in sorted(w))) for i, w in sets.items() if i % 3 == 0]
    df = spark.createDataFrame(docs, "id long, text string")
    pairs = {(a + x, b + y): r for (a, b), r in want.items() for x in (0, 5000)[: 1 + (a % 3 == 0)] for y in (0, 5000)[: 1 + (b % 3 == 0)]}
    part = {x: x for p in pairs for x in p}
    while any(part[a] != part[b] for a, b in pairs):
        for a, b in pairs:
            part[a] = part[b] = min(part[a], part[b])
    inside = {n: [round(r * 1_000_000) for (a, _), r in pairs.items() if part[a] == n] for n in set(part.values())}
    expected = {(n, sum(x == n for x in part.values()), round(sum(rs) / len(rs)) / 1_000_000) for n, rs in inside.items()}
    assert {tuple(r) for r in text.cluster_by_rhyme(df, 0.3).collect()} == expected


@pytest.mark.parametrize("name", ["x11_keyword_overlap", "x13_fused_distance"])
def test_keywords_are_looked_up_in_words_once(spark, tmp_path, monkeypatch, name):
    monkeypatch.setattr(text, "REMEMBERED", 3)
    asked = [(1, "Shared shared word, and other-things; who KEPT it?"), (2, ""), (3, "to the"), (4, "naïve café word x2yz"), (5, "\x0b\ttabs\nhere  ")]
    docs = [(1, "swordfish shareddom; KEPTother"), (2, None), (3, ""), (4, "word word caf\u00e9 NA\u00cfVE tabs"), (5, "the to"), (6, "ta bs wo\nrd"), (7, asked[0][1])]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(*d, "en", "src0", 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    duck = oracle.connect(SF)
    for t in ("benchmark", "documents"):
        duck.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    registry.load()
    got = registry.QUERIES[name](spark, str(tmp_path))
    oracle.check(got, duck.sql(registry.ORACLES[name]))
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()  # texts are not paired with queries
    split = text.against_queries(spark.createDataFrame(docs, "b long, text string"), spark.createDataFrame(asked, "a long, text string"), 2)
    assert split.count() == len(docs) * len(asked)


def test_relative_dates(spark):
    phrases = {"3 days ago": (3, 2), "a couple of days ago": (2, 2), "2 weeks ago": (14, 5), "last week": (7, 3), "5 months ago": (150, 10), "nothing": None}
    df = spark.createDataFrame([(p,) for p in phrases], "p string").select("p", text.relative_days(F.col("p")).alias("d"))
    assert {r["p"]: tuple(r["d"]) if r["d"] else None for r in df.collect()} == phrases


def test_transforms(spark):
    raw = "a \r\n\r\n\r\n\r\n b\t\n"
    row = spark.createDataFrame([(raw,)], "t string").select(text.transform(F.col("t"), "newline_normalize", "whitespace_trim", "whitespace_collapse_internal", "line_trim").alias("x")).first()
    assert row["x"] == "a\n\nb"


def test_formula_confidence_masks_weak_answers(spark):
    cases = spark.createDataFrame([(1, "tag_threshold", 9000, 6000), (2, "tag_threshold", 6500, 6000), (3, "tag_threshold", 100, 6000), (4, "nothing", 1, 1)], "id long, formula_type string, bps int, min_bps int")
    got = {r["id"]: (r["outcome"], r["bps"]) for r in rules.evaluate(cases).collect()}
    assert got == {1: (rules.YES, 9000), 2: (rules.INDETERMINATE, 6500), 3: (rules.INDETERMINATE, 100), 4: (rules.INDETERMINATE, 0)}


def test_added_formulas_of_other_columns_leave_the_rest_alone(spark, monkeypatch):
    monkeypatch.setattr(rules, "EVALUATORS", dict(rules.EVALUATORS))
    rules.register("not_here", lambda: rules.outcome(F.col("no_such_column") > 0, 9000))
    rules.register("here", lambda: rules.outcome(F.col("bps") > 8000, 9000))
    cases = spark.createDataFrame([("tag_threshold", 9000, 5000), ("here", 9000, 0), ("not_here", 9000, 0)], "formula_type string, bps int, min_bps int")
    assert {r["formula_type"]: (r["outcome"], r["bps"]) for r in rules.evaluate(cases).collect()} == {"tag_threshold": (0, 9000), "here": (0, 9000), "not_here": (-1, 0)}
    registry.load()
    registry.QUERIES["u05_formula_evaluator"](spark, SF)
    assert registry.QUERIES["e01_evaluate_formula"](spark, SF).count() == Tables(spark, SF).log.count()


def test_contradictions_are_distinct_before_they_meet(spark):
    said = "Bo, is Red. Bo is red! Bo IS blue; ann was here, is Bo is red"
    docs = spark.createDataFrame([(1, said), (1, said), (2, None), (3, "is"), (4, "Bo is ?? is green")], "doc_id long, text string")
    found = mine.extract_assertions(docs, "doc_id")
    assert sorted({(r["doc_id"], r["subject"], r["predicate"], r["object"], r["at"]) for r in found.collect()}) == [
        (1, "Bo", "is", "Red", 1), (1, "Bo", "is", "blue", 7), (1, "Bo", "is", "red", 4), (1, "Bo", "is", "red", 14), (1, "ann", "was", "here", 10), (1, "here", "is", "Bo", 12)
    ]
    known = spark.createDataFrame([("Bo", "is", "red"), ("Bo", "is", "red"), ("Bo", "is", "tall"), ("Bo", "was", "x"), (None, "is", "y")], "subject string, predicate string, object string")
    got = mine.contradictions(found.select("doc_id", "subject", "predicate", "object"), known)
    assert sorted((r["object"], r["known"]) for r in got.collect()) == [("Red", "red"), ("Red", "tall"), ("blue", "red"), ("blue", "tall"), ("red", "tall")]
    assert "Aggregate" not in got._jdf.queryExecution().executedPlan().toString() and "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()  # the product is not shuffled


def test_claims(spark):
    df = spark.createDataFrame([("Bob is Alice's brother",), ("Alice's brother is Bob",), ("nothing",)], "t string").select(mine.claims(F.col("t")).alias("c"))
    assert [tuple(r["c"]) if r["c"] else None for r in df.collect()] == [("Bob", "Alice", "brother"), ("Bob", "Alice", "brother"), None]


def test_sweep_is_idempotent_and_retries_the_cursor(spark):
    m = spark.createDataFrame([("s", "1", 10), ("s", "2", 20), ("s", "3", 20), ("s", "4", 30)], "session_id string, uuid string, ts long")
    new, counts = ingest.sweep(m, m.where("uuid in ('1', '2')"))
    assert sorted(r["uuid"] for r in new.collect()) == ["3", "4"]  # 3 shares the cursor's time and was missed before
    assert tuple(counts.first()[x] for x in ("added", "present", "skipped")) == (2, 1, 1)
    assert ingest.sweep(m, m)[0].count() == 0


def test_fork_marker_and_stance(spark):
    row = spark.range(1).select(retrieve.fork_significance(F.lit(5), F.lit(0), F.lit(0.9)).alias("x"), retrieve.faithfulness(F.lit(0), F.lit(None).cast("double")).alias("y")).first()
    assert (row["x"], round(row["y"], 6)) == (0.9, 0.15)
    assert len(retrieve.STANCES) == 7


def test_cascade_gates(spark):
    p = spark.createDataFrame([(0.1, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0, None, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None, 1.0)], "minhash double, schemas double, velocity double, predicates double, nodes double, edges double, forks double, discourse double, paths double")
    got = [(r["layer2a"], r["layer2b"], r["layer2c"]) for r in match.cascade(p).collect()]
    assert got == [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]


def test_stream_equals_batch(spark):
    t = Tables(spark, SF)
    stream = streams.drain(streams.heat(streams.as_log(streams.read_events(spark, SF))), "update", ["node_id"])
    batch = views.heat_field(t.log, NOW_MS).where("not canonical")
    joined = stream.join(batch.select("node_id", F.col("accesses").alias("n")), "node_id")
    assert joined.count() == batch.count() and joined.where("accesses <> n").count() == 0


def test_drained_streams_stay_off_the_driver(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    for i, part in enumerate(("event_id >= 500", "event_id < 500")):  # two files, the later one first
        events.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    duck = oracle.connect(SF)
    duck.sql(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    registry.load()
    for name in ("c04_unseen_stream", "h09_session_stream", "f16_rate_limit_stream", "v13_match_stream"):
        got = registry.QUERIES[name](spark, str(tmp_path))
        oracle.check(got, duck.sql(registry.ORACLES[name]))
        assert "MemoryPlan" not in got._jdf.queryExecution().logical().toString() and got.inputFiles()  # rows are in files


def test_bridge_reads_at_its_frontier(spark):
    t = Tables(spark, SF)
    b = Bridge(t.log)
    b.advance_to(200)
    assert b.snapshot("current_nodes").agg(F.max("modified_offset")).first()[0] <= 200
    with pytest.raises(ValueError):
        b.advance_to(100)
    assert set(b.register()) == set(VIEWS)


def test_log_sink_and_upsert(spark, tmp_path):
    t = Tables(spark, SF)
    q = streams.append_log(streams.read_events(spark, SF), str(tmp_path / "log"), str(tmp_path / "ck"))
    q.awaitTermination()
    again = streams.append_log(streams.read_events(spark, SF), str(tmp_path / "log"), str(tmp_path / "ck"))
    again.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == t.log.count()  # exactly once
    adapters.write_log(t.log.limit(10), str(tmp_path / "plain"))
    assert spark.read.parquet(str(tmp_path / "plain")).count() == 10
    streams.upsert_sink(streams.heat(streams.as_log(streams.read_events(spark, SF))), str(tmp_path / "up"), "node_id", str(tmp_path / "ck2")).awaitTermination()
    kept = spark.read.parquet(str(tmp_path / "up" / "v0"))
    assert kept.count() == kept.select("node_id").distinct().count()


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "t.jsonl").write_text("\n".join([json.dumps({"type": "user", "sessionId": "s", "uuid": "1", "message": {"role": "user", "content": [{"type": "text", "text": "hi"}]}}), "broken", json.dumps({"type": "summary"})]))
    (tmp_path / "a" / "n.md").write_text("one\n\n" + "two " * 300 + "\n\nthree")
    assert adapters.use(spark) == ["notes", "transcripts"]
    got = spark.read.format("transcripts").option("path", str(tmp_path)).load().collect()
    assert [(r["session_id"], r["role"], r["content"]) for r in got] == [("s", "user", "hi")]
    notes = spark.read.format("notes").option("path", str(tmp_path)).load().orderBy("chunk_index").collect()
    assert [r["room"] for r in notes] == ["a", "a", "a"] and "\n\n".join(r["text"] for r in notes) == (tmp_path / "a" / "n.md").read_text()


def test_sinks_and_encryption(spark, tmp_path):
    t = Tables(spark, SF)
    adapters.export_markdown(t.drawers.limit(20), str(tmp_path / "md"))
    assert spark.read.text(str(tmp_path / "md")).count() > 0
    eav = spark.createDataFrame([(1, "wing", "a"), (1, "room", "b"), (2, "wing", "c")], "id long, key string, value string")
    eav.write.parquet(str(tmp_path / "eav"))
    assert {(r["id"], r["room"], r["wing"]) for r in adapters.read_key_values(spark, str(tmp_path / "eav")).collect()} == {(1, "b", "a"), (2, None, "c")}
    rows = spark.createDataFrame([(1, "x"), (2, None)], "offset long, payload string")
    sealed = adapters.encrypt_log(rows, "payload", "0000111122223333")
    assert sealed.where("payload = 'x'").count() == 0
    assert adapters.decrypt_log(sealed, "payload", "0000111122223333").collect() == rows.collect()


def test_extension_points(spark):
    udfs.register_feature("twice", "node", "float", lambda: F.col("id") * 2.0)
    assert [r["twice"] for r in udfs.compute(spark.range(2), "id", ["twice"]).collect()] == [0.0, 2.0]
    with pytest.raises(ValueError):
        udfs.register_feature("bad", "node", "no type", lambda: F.lit(1))
    udfs.register_step("double", lambda df: df.unionAll(df))
    assert udfs.run_steps(spark.range(2), ["double", "double"]).count() == 8
    rules.register("always", lambda: rules.outcome(F.lit(True), 8000))
    got = rules.evaluate(spark.createDataFrame([("always",)], "formula_type string")).first()
    assert (got["outcome"], got["bps"]) == (rules.YES, 8000)
    assert len(udfs.cold_start_vector("x")) == 256 and (udfs.cold_start_vector("x") == udfs.cold_start_vector("x")).all()
