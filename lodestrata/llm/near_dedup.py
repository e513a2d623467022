"""Operator 3: near-duplicate documents by one-permutation MinHash.

A document's set holds its distinct five-word shingles (see ``hashing``).
Documents with ``100 * intersection >= 75 * union`` are linked, and a
component is what links reach.

Plan
1. One Python pass per text makes the set's size, a 128-bit hash of the whole
   set, and a one-permutation MinHash signature of ``BANDS * ROWS`` bins.  Empty
   bins are densified optimally: each takes the value of the first occupied bin
   in a random order of its own.
2. Equal sets collapse to their smallest document by a map-side combined
   aggregate, so thousands of exact copies go on as one row.
3. Bands are buckets.  Each bucket emits a star: its smallest document paired
   with every other member, so the number of pairs is linear.  Buckets with many
   members are told apart by a count first and never meet in one task.
4. Pairs are confirmed on the full sets.  The sets of documents that share a bucket
   are made once and dealt by document; every pair ships the set of its end with
   fewer partners to the other end, whose partners are dealt to tasks ``CHUNK`` at
   a time, so neither a popular centre nor its set gathers in one task.
5. Components of at most ``BROADCAST_IDS`` links (counted) are found by arrays on
   the driver, in one job; of more, they come from hash-to-min rounds with pointer
   jumping on DataFrames, by joins whose skewed keys adaptive execution splits.
6. A star misses a link between two members that its centre is not linked to.
   So buckets that still span several components go on: their members are dealt by
   bucket (large buckets as pairs of blocks), many buckets a task, with bottom-``KEPT``
   sketches.  There a pair across components is judged once, in the first bucket
   that it shares, by array operations over all buckets of the task.  Only pairs
   that may be linked leave the task: sketches of up to KEPT shingles are whole sets
   and tell exactly, larger ones leave a margin of five standard errors.  These
   pairs are confirmed on the full sets.  Nothing is capped, and neither pairs
   within a component nor pairs that cannot be linked are ever emitted.

A link at similarity 0.75 is missed only if all 40 bands of 4 rows differ, with
probability about 2.5e-7; at 0.8 it is 5e-10.

Defined cases: a null text, or one without words, has an empty set, is its own
component and is kept; rows that repeat a doc_id are one document, linked by any
of its texts, each row getting a result; a null doc_id is linked with nothing,
has a null component_id and is kept; extra columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded, cut, meet, own_name, release, small_batches
from .hashing import mix, shingle_sets

BANDS, ROWS = 40, 4
BINS = BANDS * ROWS
PERCENT = 75
#: Hashes in a bottom sketch, and the similarity that it must show.
KEPT, MARGIN = 256, 0.61
#: Members of a block, rows dealt to a task, and pairs judged at a time.
MEMBERS, DEALT, AT_ONCE = 8192, 16384, 8192
FILLED = np.uint32(0xFFFFFFFF)
#: Partners of a document that meet it in one task.
CHUNK = 256

_ORDER = mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(77)).reshape(BINS, BINS) >> np.uint64(32)
_BAND = mix(np.arange(BINS, dtype=np.uint64) + np.uint64(991)) | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One minimum a bin of a sorted, non-empty set; empty bins densified."""
    bins = ((shingles >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.diff(bins, prepend=-1))  # sorted by value, hence by bin: the first is the minimum
    occupied = bins[first]
    out = np.zeros(BINS, np.uint64)
    out[occupied] = shingles[first]
    empty = np.ones(BINS, bool)
    empty[occupied] = False
    if empty.any():
        out[empty] = shingles[first[_ORDER[empty][:, occupied].argmin(axis=1)]]
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    band = mix((sig * _BAND).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64))
    return band.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys, bands, bottoms = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            sizes.append(len(s))
            keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
            bands.append(band_hashes(signature(s)) if len(s) else np.zeros(0, np.int64))
            bottoms.append(np.minimum((s[:KEPT] >> np.uint64(32)).astype("<u4"), FILLED - np.uint32(1)).tobytes())
        offsets = np.zeros(len(bands) + 1, np.int32)
        np.cumsum([len(b) for b in bands], out=offsets[1:])
        flat = np.concatenate(bands) if bands else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), pa.array(bottoms, pa.binary())],
            names=["d", "n", "key", "bands", "bottom"],
        )


def sketches(docs: DataFrame) -> DataFrame:
    """(d, n, key, bands, bottom): set size, hash of the set, band hashes, bottom sketch."""
    small_batches(docs.sparkSession)
    ids = docs.select(F.col("doc_id").cast("long").alias("d"), "text")
    return ids.mapInArrow(_sketch, "d long, n long, key binary, bands array<long>, bottom binary")


def _ends(start: np.ndarray, stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) with start[i] <= j < stop[i], about AT_ONCE at a time."""
    n = np.maximum(stop - start, 0)
    done = np.cumsum(n)
    i, total = 0, len(n)
    while i < total:
        j = max(i + 1, int(np.searchsorted(done, (done[i - 1] if i else 0) + AT_ONCE, "right")))
        own = np.arange(i, j)
        for at in range(0, int(n[i]) if j == i + 1 else 1, AT_ONCE):  # a row may have more partners than that
            lo = start[i:j] + at
            size = np.minimum(n[i:j] - at, AT_ONCE) if j == i + 1 else n[i:j]
            first = np.repeat(own, size)
            yield first, np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
        i = j


def _alike(n: np.ndarray, sketch: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of bottom sketches (rows filled up with FILLED) may belong to linked sets."""
    x, y = sketch[i], sketch[j]
    both = np.sort(np.concatenate([x, y], axis=1), axis=1)
    common = ((both[:, 1:] == both[:, :-1]) & (both[:, 1:] < FILLED)).sum(axis=1)
    whole = (n[i] <= KEPT) & (n[j] <= KEPT)
    # the union's smallest hashes, as far as both sketches reach
    reach = np.minimum(np.minimum(x[:, -1], y[:, -1]), FILLED - np.uint32(1))[:, None]
    union = (x <= reach).sum(axis=1) + (y <= reach).sum(axis=1) - common
    return np.where(whole, 100 * common >= PERCENT * (n[i] + n[j] - common), common >= MARGIN * union)


def _judge(table: pa.Table) -> pa.Table:
    """Pairs of the buckets dealt to this task, or of two blocks (``i``, ``j``) of one, that may be linked."""
    columns = {c: table[c].to_numpy() for c in ("k", "i", "j", "side", "d", "n", "comp", "band")}
    order = np.lexsort([columns[c] for c in ("d", "side", "j", "i", "k")])
    k, bi, bj, side, d, n, comp, band = (columns[c][order] for c in ("k", "i", "j", "side", "d", "n", "comp", "band"))
    taken = pa.array(order)
    bands = table["bands"].combine_chunks().take(taken).flatten().to_numpy().reshape(-1, BANDS)
    sketch = np.full((len(d), KEPT), FILLED, np.uint32)
    for row, raw in enumerate(table["bottom"].take(taken).to_pylist()):
        own = np.frombuffer(raw, "<u4")
        sketch[row, : len(own)] = own
    new = np.ones(len(d), bool)
    new[1:] = (k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(d)))
    stop = np.repeat(first + size, size)
    right = np.repeat(first + np.add.reduceat((side == 0).astype(np.int64), first), size)  # where the other block begins
    start = np.where(bi == bj, np.arange(len(d)) + 1, np.where(side == 0, right, stop))
    a, b = [d[:0]], [d[:0]]
    for x, y in _ends(start, stop):
        near = (comp[x] != comp[y]) & (100 * np.minimum(n[x], n[y]) >= PERCENT * np.maximum(n[x], n[y]))
        x, y = x[near], y[near]
        mine = (bands[x] == bands[y]).argmax(axis=1) == band[x]
        x, y = x[mine], y[mine]
        linked = _alike(n, sketch, x, y)
        a.append(d[x[linked]])
        b.append(d[y[linked]])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _make_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cells = [s.astype("<u8").tobytes() for s in shingle_sets(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hashlib.blake2b(c, digest_size=16).digest() for c in cells], pa.binary()), pa.array(cells, pa.binary())], names=["d", "key", "set"])


def make_sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(d, set): the shingle sets of the documents ``ids`` (d), each distinct one once; dealt by d.  texts: (d, t)."""
    # counted ids go to the scan, so that other texts are not shuffled
    used = texts.join(bounded(ids), "d", "left_semi")
    return cut(used.mapInArrow(_make_sets, "d long, key binary, set binary").repartition("d").dropDuplicates(["d", "key"]).select("d", "set"))


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, hubs = None, []
    for batch in batches:
        a, b = [], []
        for hub, chunk, leaf, raw in zip(*(batch.column(i).to_pylist() for i in range(4))):
            own = np.frombuffer(raw, "<u8")
            if (hub, chunk) != at:
                at, hubs = (hub, chunk), []
            if leaf is None:
                hubs.append(own)
                continue
            for of in hubs:
                if 100 * min(len(of), len(own)) >= PERCENT * max(len(of), len(own)):
                    shared = len(np.intersect1d(of, own, assume_unique=True))
                    if shared and 100 * shared >= PERCENT * (len(of) + len(own) - shared):
                        a.append(min(hub, leaf))
                        b.append(max(hub, leaf))
                        break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The distinct (a, b) whose full sets are similar enough.  sets: (d, set)."""
    partners = bounded(cut(pairs.select(F.explode(F.array("a", "b")).alias("d")).groupBy("d").agg(F.count(F.lit(1)).alias("m"))))
    both = pairs.join(partners.select(F.col("d").alias("a"), F.col("m").alias("ma")), "a").join(partners.select(F.col("d").alias("b"), F.col("m").alias("mb")), "b")
    more = F.col("ma") >= F.col("mb")
    chunk = F.pmod(F.xxhash64("leaf"), F.ceil(F.greatest("ma", "mb") / CHUNK)).cast("int")
    dealt = cut(both.select(F.when(more, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(more, F.col("b")).otherwise(F.col("a")).alias("leaf"), "ma", "mb").select("hub", "leaf", chunk.alias("chunk")))
    hubs = dealt.select("hub", "chunk").distinct().join(sets, F.col("hub") == F.col("d")).select("hub", "chunk", F.lit(None).cast("long").alias("leaf"), "set")
    leaves = dealt.join(sets, F.col("leaf") == F.col("d")).select("hub", "chunk", "leaf", "set")
    met = hubs.unionAll(leaves).repartition("hub", "chunk").sortWithinPartitions("hub", "chunk", F.col("leaf").asc_nulls_first())
    return met.mapInArrow(_confirm, "a long, b long").distinct()


def smallest_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ends of links (a, b), and the smallest one that each reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while (root[i] != root[j]).any():
        low, was = np.minimum(root[i], root[j]), root
        root = root.copy()
        np.minimum.at(root, was[i], low)
        np.minimum.at(root, was[j], low)
        while (root[root] != root).any():
            root = root[root]
    return ids, ids[root]


def components(links: DataFrame, here: int | None = None) -> DataFrame:
    """(d, comp) for every end of a link: the smallest id that links reach.  links: (a, b), cut.

    Up to ``here`` links (BROADCAST_IDS by default, 16 bytes each) are joined on the driver: the rounds for more are some
    seven shuffles each, whose tasks are far more for the driver to keep track of than so few links.
    """
    if links.count() > (BROADCAST_IDS if here is None else here):
        return _components_by_rounds(links)
    table = links.select("a", "b").toArrow()
    d, comp = smallest_reached(table["a"].to_numpy(), table["b"].to_numpy())
    return cut(links.sparkSession.createDataFrame(pa.table({"d": d, "comp": comp}), "d long, comp long"))


def _components_by_rounds(links: DataFrame) -> DataFrame:
    """``components`` by rounds.

    Joins take ``d + 0``, so that checkpointed sides are dealt anew and Spark can split the rows of a document with very
    many links, or of a component that very many documents ask for.
    """
    both = cut(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = cut(both.groupBy(F.col("a").alias("d")).agg(F.least(F.min("b"), F.col("d")).alias("comp")))
    while True:
        told = state.select((F.col("d") + 0).alias("t"), F.col("comp").alias("near"))
        seen = both.join(told, F.col("a") == F.col("t")).groupBy(F.col("b").alias("e")).agg(F.min("near").alias("near"))
        step = state.join(seen, F.col("d") == F.col("e"), "left").select("d", F.least("comp", "near").alias("next"), F.col("comp").alias("was"))
        jump = state.select((F.col("d") + 0).alias("j"), F.col("comp").alias("over"))
        new = cut(step.join(jump, F.col("next") == F.col("j"), "left").select("d", F.least("next", "over").alias("comp"), "was"))
        changed = new.where(F.col("comp") < F.col("was")).limit(1).count()
        state = new.select("d", "comp")
        if not changed:
            return state


def _across(shared: DataFrame, comps: DataFrame, sketched: DataFrame) -> DataFrame:
    """(a, b): pairs that share a bucket, lie in different components and may be linked."""
    marked = cut(shared.join(bounded(comps), "d", "left").withColumn("comp", F.coalesce("comp", "d")))
    mixed = cut(marked.groupBy("k").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("m")).where("lo < hi").select("k", "m", F.ceil(F.col("m") / MEMBERS).cast("int").alias("g")))
    tasks = 1 + (mixed.agg(F.sum(F.col("m") * F.col("g"))).first()[0] or 0) // DEALT
    alive = cut(meet(marked, mixed, "k"))
    # only the sketches of these documents are shuffled
    wanted = sketched.join(bounded(alive.select("d").distinct()), "d", "left_semi").repartition("d").dropDuplicates(["d", "key"])
    alive = alive.join(wanted.select("d", "bands", "bottom"), "d")
    # a bucket of g blocks meets as g * (g + 1) / 2 pairs of blocks; for g = 1 as itself
    mine = F.pmod(F.xxhash64("d", "k"), F.col("g")).cast("int")
    split = alive.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    ends = split.withColumn("i", F.least("mine", "other")).withColumn("j", F.greatest("mine", "other"))
    side = F.when(F.col("mine") == F.col("i"), 0).otherwise(1).alias("side")
    ready = ends.select("k", "i", "j", side, "d", "n", "comp", "band", "bands", "bottom", F.pmod(F.xxhash64("k", "i", "j"), F.lit(tasks)).alias("task"))
    return ready.groupBy("task").applyInArrow(_judge, "a long, b long").distinct()


def _fits(a: str, b: str):
    return 100 * F.least(F.col(a), F.col(b)) >= PERCENT * F.greatest(F.col(a), F.col(b))


def link(chosen: DataFrame, sketched: DataFrame, texts: DataFrame, known: DataFrame) -> DataFrame:
    """(d, comp) of the documents that some link reaches.

    chosen: (d, n, bands), a row for each distinct set; sketched: (d, key, bands, bottom); texts: (d, t); known: (a, b), links to start from.
    """
    buckets = chosen.select("d", "n", F.posexplode("bands").alias("band", "k"))
    centres = buckets.groupBy("k").agg(F.min(F.struct("d", "n")).alias("c"), F.count(F.lit(1)).alias("m")).where("m > 1")
    centres = cut(centres.select("k", F.col("c.d").alias("a"), F.col("c.n").alias("na"), "m"))
    shared = cut(meet(buckets, centres, "k").select("k", "band", "d", "n", "a", "na"))
    sets = make_sets(shared.select("d").distinct(), texts)
    release(sets.sparkSession)
    tested = cut(shared.where("d <> a").where(_fits("na", "n")).select("a", F.col("d").alias("b")).distinct())
    links = cut(confirm(tested, sets).unionAll(known))
    comps = components(links)
    release(links.sparkSession)

    fresh = cut(_across(shared.select("k", "band", "d", "n"), comps, sketched).join(tested, ["a", "b"], "left_anti"))
    if fresh.isEmpty():
        return comps
    return components(cut(links.unionAll(confirm(fresh, sets))))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    sketched = cut(sketches(docs))
    some = sketched.where("n > 0 and d is not null")
    reps = cut(some.groupBy("key").agg(F.min("d").alias("rep"), F.count(F.lit(1)).alias("m")))
    lone = sketched.where("n = 0 or d is null").select("d", "n", "key", F.lit(None).cast("long").alias("rep"))
    members = meet(some.select("d", "n", "key"), reps, "key").select("d", "n", "key", "rep").unionAll(lone)

    # a doc_id with several texts ties their sets together
    twice = members.where("rep is not null").groupBy("d").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a < z").select("d", "a")
    ties = members.join(twice, "d").where("rep > a").select("a", F.col("rep").alias("b")).distinct()

    chosen = meet(some.drop("bottom"), reps, "key").where("d = rep").dropDuplicates(["key"]).select("d", "n", "bands")
    chosen = cut(chosen)
    release(docs.sparkSession)
    comps = link(chosen, some, docs.select(F.col("doc_id").cast("long").alias("d"), F.col("text").alias("t")), ties)
    out = meet(members, cut(reps.groupBy("rep").agg(F.sum("m").alias("m")).join(bounded(comps).select(F.col("d").alias("rep"), "comp"), "rep", "left")), "rep").unionByName(members.where("rep is null").withColumn("comp", F.lit(None).cast("long")))
    component = F.when(F.col("d").isNotNull(), F.coalesce("comp", "rep", "d"))
    return out.select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("d"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays: one of each group, once."""
    found = cut(near_duplicates(docs).select("doc_id", "kept"))
    release(docs.sparkSession)
    mark = own_name(docs, "gone")
    gone = cut(found.where("not kept").select(F.col("doc_id").alias(mark)).distinct())
    out = docs.join(bounded(gone), docs["doc_id"].cast("long") == F.col(mark), "left_anti")
    if found.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(out.where("doc_id is null"))
