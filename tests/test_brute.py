"""Queries without SQL, over whole tables, against plain Python."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest

from lodestrata.functions import udfs
from lodestrata.operators import extend, fold, store
from lodestrata.operators.derived import COOLDOWN_DAYS, CYCLES, DEMOTE_DAYS, PROMOTE_AFTER, PROMOTE_DAYS
from lodestrata.plans import registry
from lodestrata.sources.tables import Tables

SF = "/root/testdata/sf0.001"
DAY = 86_400_000
registry.load()


def run(spark, name):
    return registry.QUERIES[name](spark, SF).collect()


def test_source_dedup(spark):
    rows = sorted((r["label"], r["vec_id"], np.array(r["v"])) for r in Tables(spark, SF).vectors.collect())
    want, kept = {}, {}
    for group, i, v in sorted(rows, key=lambda r: r[:2]):
        v = v / np.linalg.norm(v)
        among = kept.setdefault(group, [])
        want[group, i] = not any(1 - w @ v < 0.15 for w in among)
        if want[group, i]:
            among.append(v)
    for group in {g for g, _ in want}:
        if sum(g == group for g, _ in want) < 2:
            want |= {k: True for k in want if k[0] == group}
    assert {(r["group"], r["vec_id"]): r["kept"] for r in run(spark, "k15_source_dedup")} == want


def test_source_dedup_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 8))
    rows = [(g, i, (base[i % 12] + rng.normal(size=8) * 0.05).tolist()) for g in range(2) for i in range(2500)] + [(9, 1, base[0].tolist())]
    got = store.source_dedup(spark.createDataFrame(rows, "group long, vec_id long, v array<double>"), 0.15)
    kept = {}
    for g, i, v in rows:
        v = np.array(v) / np.linalg.norm(v)
        if not any(1 - w @ v < 0.15 for _, w in kept.setdefault(g, [])):
            kept[g].append((i, v))
    assert {(r["group"], r["vec_id"]) for r in got.where("kept").collect()} == {(g, i) for g, x in kept.items() for i, _ in x}


@pytest.mark.parametrize("kind", ["long", "string"])
def test_topic_tunnels_over_many_blocks(spark, kind):
    rng = np.random.default_rng(5)
    rows = [(int(w) if kind == "long" else f"w{w}", f"{'T' if w % 2 else 't'}{k}") for w, k in rng.integers(0, (70, 25), (900, 2))]
    held = {}
    for w, k in rows:
        held.setdefault(w, set()).add(k.lower())
    pairs = {(a, b): held[a] & held[b] for a in held for b in held if a < b}
    df = spark.createDataFrame([*rows, (None, "t1"), (rows[0][0], None)], f"wing {kind}, topic string")
    for least in (1, 6):
        want = sorted((k, a, b, len(x), f"topic:{k}") for (a, b), x in pairs.items() if len(x) >= least for k in x)
        for block in (100, 2_000_000):
            got = store.topic_tunnels(df, least, block)
            assert sorted(map(tuple, got.collect())) == want
            assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # pairs that share too little are not shuffled
    assert store.topic_tunnels(df.limit(0), 2).count() == 0


def test_projection_automaton(spark):
    keys = {}
    for r in Tables(spark, SF).log.collect():
        keys.setdefault(r["k"], []).append((r["ts_ms"], r["value"] >= 3))
    want = []
    for key, events in keys.items():
        state, streak, since, cool, cycles = "not_promoted", [], 0, -1, []
        for ts, ok in sorted(events):
            if state == "promoted":
                if not ok and ts - since <= DEMOTE_DAYS * DAY:
                    cycles = [c for c in cycles if ts - c <= 365 * DAY] + [ts]
                    state = "unstable" if len(cycles) >= CYCLES else "not_promoted"
                    cool, streak = ts + COOLDOWN_DAYS * DAY, []
            elif state == "not_promoted":
                streak = [t for t in streak if ts - t <= PROMOTE_DAYS * DAY] + [ts] if ok else []
                if len(streak) >= PROMOTE_AFTER and ts >= cool:
                    state, since = "promoted", ts
            want.append((key, ts, state))
    assert sorted(tuple(r) for r in run(spark, "h02_projection")) == sorted(want)


def test_beam_traversal(spark):
    edges, regions = {}, {}
    for r in Tables(spark, SF).hierarchy.collect():
        edges.setdefault(r["source"], set()).add(r["target"])
        regions.setdefault(r["target"], set()).add(r["target"][0])
    want = []
    for seed in ("r0", "r1", "r2"):
        front = [((seed,), 0.0)]
        want += [(seed, p, c) for p, c in front]
        for _ in range(4):
            grown = [(p + (t,), c + 1) for p, c in front for t in edges.get(p[-1], ()) if t not in p]
            front = sorted(grown, key=lambda x: (x[1], ">".join(x[0])))[:8]
            want += [(seed, p, c) for p, c in front]
    expected = sorted((s, ">".join(p), c, len(set().union(*(regions.get(x, set()) for x in p))) >= 3, len(p) - 1) for s, p, c in want)
    assert sorted(tuple(r) for r in run(spark, "g13_beam_traverse")) == expected


def test_walk_audit_ends_once(spark):
    got = sorted(tuple(r) for r in run(spark, "r23_walk_audit"))
    assert [s for s, _ in got] == list(range(len(got))) and 0 < len(got) <= 8
    assert all(not d.startswith("terminate") for _, d in got[:-1])


def test_cold_start_embedding(spark):
    texts = {r["item_id"]: r["text"] for r in Tables(spark, SF).queries.collect()}
    for r in run(spark, "x26_embed"):
        seed = hashlib.sha512(texts[r["item_id"]].encode()).digest()
        assert r["dims"] == 256 and r["first"] == pytest.approx(seed[0] / 127.5 - 1, abs=1e-6)
    assert udfs.cold_start_vector("a", 100)[64] == hashlib.sha512(hashlib.sha512(b"a").digest()).digest()[0] / 127.5 - 1


def test_compressed_lines(spark):
    def first(xs, n):
        return list(dict.fromkeys(xs))[:n]

    texts = {r["doc_id"]: r["text"] for r in Tables(spark, SF).drawers.collect()}
    for r in run(spark, "x27_compress"):
        text = texts[r["doc_id"]]
        low = text.lower()
        codes = "+".join(n[:3].upper() for n in first(re.findall(r"\b([A-Z][a-z]{2,15})\b", text), 3))
        topics = "_".join(first(re.findall(r"\b([a-z]{5,})\b", low), 3))
        sentences = [s for s in re.split(r"[.!?\n]+\s*", text, flags=re.A) if len(s) >= 10]
        told = lambda table: "+".join([k for k, ws in table.items() if any(w in low for w in ws)][:3])
        assert r["line"] == "|".join([codes, topics, sentences[0][:55] if sentences else "", told(udfs.FEELINGS), told(udfs.FLAGS)])


def test_events_are_folded_in_order_whatever_the_batches(spark):
    rng = np.random.default_rng(1)
    rows = [(int(k), i, float(v)) for i, (k, v) in enumerate(zip(rng.integers(0, 7, 5000) ** 2 % 5, rng.normal(size=5000)))]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(5)
    calls = lambda: (0, 0, 0.0)

    def step(state, part):
        n, most, total = state
        assert part["i"].is_monotonic_increasing
        return (n + 1, max(most, len(part)), total + part["v"].sum()), part[["k", "i"]].assign(n=n)

    got = fold.fold_events(df, ["k"], ["i"], calls, step, "k long, i long, n long", most=64).toPandas()
    for k, part in got.groupby("k"):
        order = part.sort_values("i")["n"].tolist()
        assert order == [i // 64 for i in range(len(part))]
    assert len(got) == 5000
    last = fold.fold_events(df, ["k"], ["i"], calls, lambda s, p: (step(s, p)[0], None), "k long, n long, most long", finish=lambda key, s: (key[0], s[0], s[1]), most=64)
    assert {tuple(r) for r in last.collect()} == {(k, -(-n // 64), min(n, 64)) for k, n in pd.Series([r[0] for r in rows]).value_counts().items()}
    assert fold.fold_events(df.where("false"), ["k"], ["i"], calls, step, "k long, i long, n long").count() == 0


def test_nearest_over_many_blocks(spark, monkeypatch):
    whole = fold.blocks_of
    monkeypatch.setattr(store, "blocks_of", lambda q: whole(q, 3))
    rng = np.random.default_rng(2)
    vectors = [(i, [1.0, 0.0] if i % 10 == 0 else rng.normal(size=2).tolist()) for i in range(300)] + [(400, [0.0, 0.0]), (401, [1.0]), (402, None)]
    queries = [(i, v) for i, v in vectors if i % 30 == 0] + [(400, [0.0, 0.0])]
    got = store.nearest(spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(4), spark.createDataFrame(queries, "qid long, q array<double>"), 7)

    def distance(a, b):
        if not a or not b or len(a) != len(b) or not np.any(a) or not np.any(b):
            return 1.0
        return round(1 - float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))), 6)

    want = {(q, i) for q, a in queries for i in [i for _, i in sorted((distance(a, v), i) for i, v in vectors)[:7]]}
    assert {(r["qid"], r["vec_id"]) for r in got.collect()} == want


def test_stacks_are_checked_before_they_run(spark):
    df = spark.createDataFrame([(1, "x")], "id long, text string")
    step = extend.Step("a", ("text",), ("size",), lambda d: d.selectExpr("*", "length(text) AS size"))
    assert extend.execute([step], df).first()["attested"] == hashlib.sha256(b"|a|1").hexdigest()
    with pytest.raises(extend.InvalidStack):
        extend.execute([extend.Step("b", ("size",), (), lambda d: d)], df)
    with pytest.raises(extend.InvalidStack):
        extend.execute([extend.Step("c", (), ("gone",), lambda d: d)], df)
    with pytest.raises(KeyError):
        extend.run_passes({}, ["busy_nodes"])


def test_top_k_equivalence(spark):
    rows = [([], []), ([1], []), ([1, 2, 3], [1, 2]), ([1, 2, 3], [1, 2, 4]), ([1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7]), (None, [1]), (None, None)]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    assert [tuple(r) for r in df.select(extend.top_k_match(5)(df.a, df.b), extend.deep_equality(df.a, df.b)).collect()] == [(True, True), (False, False), (True, False), (False, False), (True, False), (False, False), (False, True)]


def test_key_value_tables_keep_all_keys(spark, tmp_path):
    from lodestrata.sources import adapters

    spark.range(3000).selectExpr("id % 2 AS id", "concat('k', id) AS key", "id AS value").write.parquet(f"{tmp_path}/eav")
    assert len(adapters.read_key_values(spark, f"{tmp_path}/eav").columns) == 3001
    assert sorted(len(r["entries"]) for r in adapters.read_key_maps(spark, f"{tmp_path}/eav").collect()) == [1500, 1500]
