"""Operator 4: removal of repeated byte strings by blockwise difference-cover suffix sorting.

Every byte covered by a ``SPAN``-byte string that starts anywhere else too, in
the same or another document, is removed; strings never cross documents and are
judged on the input.

Suffixes of a whole corpus cannot be sorted in place, so buckets are made first:

1. Each SPAN-byte string is assigned the least-hashed GRAM-byte substring in it
   (its anchor).  Equal strings have equal anchors, so strings are compared only
   within the class of their anchor.  An anchor serves a contiguous range of
   starts; the bytes these strings cover are its context.
2. Anchors are dealt by class, as packed arrays.  A class of one member holds
   nothing repeated.  Members with identical contexts repeat each other wholly:
   they are marked and collapse to one member, so copies of documents and
   passages cost one row.  What is left are the edges of repeats.
3. The contexts of these edges are dealt by class and sorted one block of suffix
   buckets at a time: suffixes are bucketed by their first ``V`` bytes; the ranks
   of a difference-cover sample (positions whose remainder modulo V is in
   ``COVER``) are computed once a block; suffixes that tie are then told apart by
   the ranks of the sample positions at the one offset below V that puts both
   into the cover.  Ties of all buckets are resolved together by partitioning
   around pivots.  Memory is bounded by the block.

A class of an outsized number of documents (found in a sample of them; only how rows
are dealt depends on it) is dealt by context.  Its edges, and those of any class with
more contexts than a block holds, are compared by 128-bit fingerprints of their
strings, dealt by fingerprint, since one bucket of it may exceed a task.  Contexts are
taken for identical by 64-bit hashes of anchor and context, 128 bits together.

Marks go into sorted arrays in the shared folder, keyed by a hash of id and text,
and are memory-mapped by the tasks that read the documents again, so texts are
never shuffled.

Defined cases: a null text is empty; texts shorter than SPAN keep everything;
rows equal in doc_id and text are documents of their own and so repeat each other;
a null doc_id is allowed; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lazily, cut, map_shared, open_shared, remove_shared, shared_dir, small_batches
from .hashing import buffers, mix

SPAN, GRAM = 200, 56
STARTS = SPAN - GRAM + 1
V = 32
_R = 6
#: {0..5} and the multiples of 6 below 32: every difference modulo 32 occurs between two of them.
COVER = np.array(sorted({*range(_R), *range(0, V, _R)}))
DEPTH = SPAN - V  # bytes that the sample's ranks compare
#: Bytes of documents hashed together, and of contexts sorted together.
PIECE, BLOCK = 2 << 20, 2 << 20
#: Documents sampled to find outsized classes, at least and as a share, and in how many of them such a class occurs: others have about a million at most.
HOT_SAMPLE, HOT_SHARE, HOT_COUNT = 20_000, 4e-4, 400

_P = 0x9E3779B97F4A7C13
_BYTE = np.random.Generator(np.random.PCG64(4)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_OFFSET = np.zeros((V, V), np.int64)  # the offset that puts positions of two remainders into the cover
for _i in range(V):
    for _j in range(V):
        _OFFSET[_i, _j] = next(o for o in range(V) if (_i + o) % V in COVER and (_j + o) % V in COVER)


class Prefix:
    """Prefix sums that give the hash of any substring."""

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        size = 1 << max(16, n.bit_length())
        if size not in _powers:
            _powers.clear()
            tables = []
            for base in (_P, pow(_P, -1, 1 << 64)):
                table = np.full(size, base, np.uint64)
                table[0] = 1
                tables.append(np.multiply.accumulate(table))
            _powers[size] = tuple(tables)
        up, self.down = _powers[size]
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(_BYTE[raw] * up[: n - 1], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def pieces(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]]:
    """(bytes, offsets of the texts, row keys, prefix hashes) of runs of documents of at most PIECE bytes, or one document."""
    raw, at = buffers(texts)
    doc = np.array(ids.fill_null(-1).to_numpy(zero_copy_only=False), np.int64).view(np.uint64)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, "right")) - 1)
        own, offsets = raw[at[i] : at[j]], at[i : j + 1] - at[i]
        prefix = Prefix(own)
        keys = mix(mix(doc[i:j]) + prefix.hash(offsets[:-1], offsets[1:]))
        yield own, offsets, keys, prefix
        i = j


def _window_minima(values: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every ``size`` consecutive values."""
    n = len(values)
    rows = -(-n // size)
    padded = np.full(rows * size, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(rows, size)
    ahead = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(table, axis=1).ravel()
    return np.minimum(ahead[: n - size + 1], behind[size - 1 : n])


def anchors(offsets: np.ndarray, prefix: Prefix) -> tuple[np.ndarray, ...]:
    """For each anchor: document number, class, context hash, first and last start (in the piece), and its own position."""
    total = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if total < SPAN:
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    at = np.arange(total - GRAM + 1)
    grams = prefix.hash(at, at + GRAM)
    # ties go to the rightmost, which depends on the string alone
    order = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - at.astype(np.uint64))
    least = np.uint64(0xFFFFFFFF) - (_window_minima(order, STARTS) & np.uint64(0xFFFFFFFF))
    chosen = least.astype(np.int64)
    starts = np.arange(len(chosen))
    doc = np.searchsorted(offsets, starts, "right") - 1
    inside = starts + SPAN <= offsets[doc + 1]
    starts, chosen, doc = starts[inside], chosen[inside], doc[inside]
    if not len(starts):
        return none, none.view(np.uint64), none.view(np.uint64), none, none, none
    new = np.flatnonzero((np.diff(chosen, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0))
    lo, p = starts[new], chosen[new]
    hi = starts[np.append(new[1:], len(starts)) - 1]
    context = mix(prefix.hash(lo, hi + SPAN) + mix(((p - lo) * SPAN + (hi - lo)).astype(np.uint64)))
    return doc[new], grams[p], context, lo, hi, p


# -- packed rows: arrays of fixed-width records, dealt by shard ------------------------------

ANCHOR = np.dtype([("cls", "<u8"), ("ctx", "<u8"), ("key", "<u8"), ("lo", "<u4"), ("reach", "u1"), ("hot", "u1")])
MARK = np.dtype([("key", "<u8"), ("lo", "<u4"), ("hi", "<u4"), ("cls", "<u8"), ("kind", "u1")])
PRINT = np.dtype([("f", "<u8"), ("g", "<u8"), ("key", "<u8"), ("at", "<u4"), ("asks", "u1")])
COVERED, EDGE, EXAMPLE, HOT_EDGE, HOT_EXAMPLE = range(5)
_PACKED = "shard int, rows binary"


def _deal(records: np.ndarray, by: np.ndarray, shards: int) -> pa.RecordBatch:
    shard = (mix(by) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(shards + 1))
    records = records[order]
    some = np.flatnonzero(np.diff(cuts))
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([records[cuts[s] : cuts[s + 1]].tobytes() for s in some], pa.binary())], names=["shard", "rows"])


def _records(table: pa.Table, kind: np.dtype) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in table["rows"].to_pylist()])


def _group_starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _find_anchors(shards: int, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            for _, offsets, keys, prefix in pieces(batch.column(0), batch.column(1)):
                doc, cls, ctx, lo, hi, _ = anchors(offsets, prefix)
                out = np.zeros(len(doc), ANCHOR)
                out["cls"], out["ctx"], out["key"], out["lo"], out["reach"] = cls, ctx, keys[doc], lo - offsets[doc], hi - lo
                out["hot"] = np.isin(cls, hot)
                kept.append(out)
                size += len(out)
            if size > 1_000_000:
                every = np.concatenate(kept)
                yield _deal(every, np.where(every["hot"] == 1, every["ctx"], every["cls"]), shards)
                kept, size = [], 0
        if size:
            every = np.concatenate(kept)
            yield _deal(every, np.where(every["hot"] == 1, every["ctx"], every["cls"]), shards)

    return run


def _sort_classes(shards: int):
    """Marks of a shard of anchors: covered ranges, edges to compare, and one example of each repeated context."""

    def run(table: pa.Table) -> pa.Table:
        a = _records(table, ANCHOR)
        a = a[np.lexsort((a["lo"], a["key"], a["ctx"], a["cls"]))]
        contexts = _group_starts(a["cls"], a["ctx"])
        members = np.diff(np.append(contexts, len(a)))
        of_class = np.searchsorted(_group_starts(a["cls"]), contexts, "right") - 1
        distinct = np.bincount(of_class)[of_class]
        mixed = (distinct > 1) | (a["hot"][contexts] == 1)
        large = np.repeat((a["hot"][contexts] == 1) | (distinct > BLOCK // SPAN), members)
        repeated = np.repeat(members > 1, members)
        first = np.zeros(len(a), bool)
        first[contexts] = True
        compare = np.repeat(mixed, members) & first
        out = np.zeros(0, MARK)
        for which, kind in ((repeated, COVERED), (compare & ~repeated, EDGE), (compare & repeated, EXAMPLE)):
            some = a[which]
            marks = np.zeros(len(some), MARK)
            marks["key"], marks["lo"], marks["hi"], marks["cls"] = some["key"], some["lo"], some["lo"] + some["reach"], some["cls"]
            marks["kind"] = np.where(large[which] & (kind != COVERED), kind + 2, kind)
            out = np.concatenate([out, marks])
        return pa.Table.from_batches([_deal(out, out["key"], shards)])

    return run


def _store(folder: str, name: str):
    """Writes a shard of marks, sorted by key, and tells its name."""

    def run(table: pa.Table) -> pa.Table:
        marks = _records(table, MARK)
        marks = marks[np.lexsort((marks["lo"], marks["key"]))]
        shard = table["shard"][0].as_py()
        path = f"{folder}/{name}-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        with open_shared(path, "wb") as f:
            f.write(marks.tobytes())
        return pa.table({"shard": pa.array([shard], pa.int32()), "path": [path]})

    return run


class Marks:
    """Look-ups in stored marks."""

    def __init__(self, shards: int, paths: dict[int, str]):
        self.shards, self.paths = shards, paths

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Marks of the keys, with the number of the key in ``cls_row``: (row, mark) sorted by row."""
        if not hasattr(self, "_maps"):
            self._maps = Lazily(lambda path: map_shared(path, MARK), self.paths)
        shard = (mix(keys) % np.uint64(self.shards)).astype(np.int64)
        rows, marks = [], []
        for s in np.unique(shard).tolist():
            if s in self._maps:
                of = np.flatnonzero(shard == s)
                table = self._maps[s]
                lo, hi = np.searchsorted(table["key"], keys[of], "left"), np.searchsorted(table["key"], keys[of], "right")
                for r, a, b in zip(of[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist()):
                    rows.append(np.full(b - a, r))
                    marks.append(table[a:b])
        return (np.concatenate(rows), np.concatenate(marks)) if rows else (np.zeros(0, np.int64), np.zeros(0, MARK))


def _contexts(marks: Marks, shards: int):
    """The contexts of the edges, and the fingerprints of those in hot classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw, offsets, keys, prefix in pieces(batch.column(0), batch.column(1)):
                distinct, of = np.unique(keys, return_index=True)  # rows equal in id and text have equal marks
                row, m = marks.of(distinct)
                row, start = of[row], offsets[of[row]] if len(row) else row
                cold = np.flatnonzero((m["kind"] == EDGE) | (m["kind"] == EXAMPLE))
                if len(cold):
                    a, b = start[cold] + m["lo"][cold], start[cold] + m["hi"][cold] + SPAN
                    shard = (mix(m["cls"][cold].copy()) % np.uint64(shards)).astype(np.int32)
                    text = raw.tobytes()
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(shard), pa.array([m[i : i + 1].tobytes() for i in cold], pa.binary()), pa.array([text[x:y] for x, y in zip(a.tolist(), b.tolist())], pa.binary())],
                        names=["shard", "rows", "context"],
                    )
                hot = np.flatnonzero(m["kind"] >= HOT_EDGE)
                if len(hot):
                    n = (m["hi"][hot] - m["lo"][hot] + 1).astype(np.int64)
                    own = np.repeat(hot, n)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + m["lo"][own]
                    out = np.zeros(len(own), PRINT)
                    x = start[own] + at
                    out["f"], out["key"], out["at"], out["asks"] = prefix.hash(x, x + SPAN), m["key"][own], at, m["kind"][own] == HOT_EDGE
                    out["g"] = prefix.hash(x, x + GRAM) + prefix.hash(x + GRAM, x + SPAN) * np.uint64(3)
                    dealt = _deal(out, out["f"], shards)
                    yield pa.RecordBatch.from_arrays([pa.array(-1 - dealt.column(0).to_numpy(), pa.int32()), dealt.column(1), pa.nulls(len(dealt), pa.binary())], names=["shard", "rows", "context"])

    return run


# -- difference-cover sorting ---------------------------------------------------------------


def _ranks(*parts: np.ndarray) -> np.ndarray:
    """Dense ranks of tuples of ranks below 2**32."""
    rank = parts[0].astype(np.uint64)
    for p in parts[1:]:
        rank = np.unique(rank << np.uint64(32) | p.astype(np.uint64), return_inverse=True)[1].astype(np.uint64)
    return rank


def repeated_starts(block: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of ``starts`` begin a SPAN-byte string that another of them begins too.

    block: bytes of contexts, one after another; ends[x]: the end of the context that byte x lies in.
    """
    n = len(block)
    padded = np.zeros(n + SPAN, np.uint64)
    padded[:n] = block
    word = np.zeros(n + SPAN - 8, np.uint64)
    for k in range(8):
        word = word << np.uint64(8) | padded[k : k + len(word)]
    r8 = np.unique(word, return_inverse=True)[1].astype(np.uint64)
    r8 = np.concatenate([r8, np.zeros(8, np.uint64)])
    shifted = lambda r, k: np.concatenate([r[k:], np.zeros(k, np.uint64)])
    r16 = _ranks(r8, shifted(r8, 8))
    r32 = _ranks(r16, shifted(r16, 16))  # ranks of the first V bytes: the buckets

    # ranks of the cover sample by its first DEPTH = 168 = 128 + 32 + 8 bytes; remainders stay in the cover at steps of V
    sample = np.flatnonzero(np.isin(np.arange(n) % V, COVER) & (np.arange(n) + DEPTH <= ends))
    r64 = np.zeros(n + SPAN, np.uint64)
    near = np.flatnonzero(np.isin(np.arange(n) % V, COVER))
    r64[near] = _ranks(r32[near], r32[near + V])
    at = sample
    rank = np.zeros(n + SPAN, np.uint64)
    rank[at] = _ranks(r64[at], r64[at + 64], r32[at + 128], r8[at + 160])

    # buckets: equal first and last V bytes; lone suffixes are done
    out = np.zeros(len(starts), bool)
    group = _ranks(r32[starts], r32[starts + DEPTH])
    order = np.argsort(group, kind="stable")
    rng = np.random.default_rng(0)
    group = group[order]
    while len(order):
        first = _group_starts(group)
        size = np.diff(np.append(first, len(group)))
        many = np.repeat(size > 1, size)
        order, group = order[many], group[many]
        if not len(order):
            break
        first = _group_starts(group)
        size = np.diff(np.append(first, len(group)))
        pivot = np.repeat(order[first + (rng.random(len(first)) * size).astype(np.int64)], size)
        x, y = starts[order], starts[pivot]
        offset = _OFFSET[x % V, y % V]
        a, b = rank[x + offset], rank[y + offset]
        same = a == b
        sums = np.add.reduceat(same.astype(np.int64), first)
        out[order[same & np.repeat(sums > 1, size)]] = True
        rest = ~same
        group = _ranks(np.repeat(np.arange(len(first)), size)[rest], (a > b)[rest])
        order = order[rest]
        by = np.argsort(group, kind="stable")
        order, group = order[by], group[by]
    return out


def _runs(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """COVERED marks for sorted (key, start)."""
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    out = np.zeros(len(first), MARK)
    out["key"], out["lo"] = keys[first], at[first]
    out["hi"] = at[np.append(first[1:], len(keys)) - 1] if len(first) else 0
    return out


def _sort_edges(shards: int):
    def contexts(marks: np.ndarray, texts: list[bytes]) -> Iterator[np.ndarray]:
        order = np.argsort(marks["cls"], kind="stable")
        cls = marks["cls"][order]
        limits = [*_group_starts(cls).tolist(), len(cls)]
        i = 0
        while i < len(limits) - 1:
            j, size = i, 0
            while j < len(limits) - 1 and (j == i or size < BLOCK):
                size += sum(len(texts[k]) for k in order[limits[j] : limits[j + 1]])
                j += 1
            own = order[limits[i] : limits[j]]
            block = np.frombuffer(b"".join(texts[k] for k in own), np.uint8)
            lengths = np.array([len(texts[k]) for k in own])
            stop = np.cumsum(lengths)
            m = marks[own]
            n = (m["hi"] - m["lo"] + 1).astype(np.int64)
            row = np.repeat(np.arange(len(own)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            hit = repeated_starts(block, np.repeat(stop, lengths), (stop - lengths)[row] + step)
            hit &= m["kind"][row] == EDGE
            keys, at = m["key"][row][hit], (m["lo"][row] + step)[hit]
            by = np.lexsort((at, keys))
            yield _runs(keys[by], at[by])
            i = j

    def prints(p: np.ndarray) -> np.ndarray:
        p = p[np.lexsort((p["at"], p["key"], p["g"], p["f"]))]
        first = _group_starts(p["f"], p["g"])
        size = np.diff(np.append(first, len(p)))
        p = p[np.repeat(size > 1, size) & (p["asks"] == 1)]
        p = p[np.lexsort((p["at"], p["key"]))]
        return _runs(p["key"], p["at"])

    def run(table: pa.Table) -> pa.Table:
        if table["shard"][0].as_py() < 0:
            out = prints(_records(table, PRINT))
        else:
            marks = _records(table, MARK)
            out = np.concatenate([np.zeros(0, MARK), *contexts(marks, table["context"].to_pylist())])
        return pa.Table.from_batches([_deal(out, out["key"], shards)])

    return run


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _apply(stores: list[Marks], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_row = 0
            for raw, offsets, keys, _ in pieces(batch.column(0), batch.column(1)):
                change = np.zeros(len(raw) + 1, np.int64)
                distinct, of = np.unique(keys, return_inverse=True)
                copies = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1])
                for store in stores:
                    row, m = store.of(distinct)
                    own = m["kind"] == COVERED
                    for r, lo, hi in zip(row[own].tolist(), m["lo"][own].tolist(), m["hi"][own].tolist()):
                        for c in copies[r]:
                            change[offsets[c] + lo] += 1
                            change[offsets[c] + hi + SPAN] -= 1
                gone = np.cumsum(change[:-1]) > 0
                bounds = offsets[:-1]
                sums = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                begins[bounds[bounds < len(raw)]] = gone[bounds[bounds < len(raw)]]
                spans = np.concatenate([[0], np.cumsum(begins)])
                kept = raw[~gone].tobytes()
                ends = (offsets - sums[offsets]).tolist()
                cells = [kept[a:b] if with_text else hashlib.sha256(kept[a:b]).hexdigest().encode() for a, b in zip(ends[:-1], ends[1:])]
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at_row, n), pa.array(np.diff(offsets)), pa.array(np.diff(sums[offsets])), pa.array(np.diff(spans[offsets])), pa.array(cells, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
                )
                at_row += n

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, offsets, _, prefix in pieces(batch.column(0), batch.column(1)):
            doc, cls, *_ = anchors(offsets, prefix)
            distinct = np.unique(np.stack([cls, doc.astype(np.uint64)]), axis=1)[0] if len(cls) else cls
            found, n = np.unique(distinct, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["cls", "n"])


def hot_classes(src: DataFrame) -> np.ndarray:
    """Classes that occur in more than HOT_COUNT documents of a sample of HOT_SAMPLE or HOT_SHARE of them."""
    share = min(1.0, max(HOT_SHARE, HOT_SAMPLE / max(1, src.count())))
    counts = src.sample(share, 4).mapInArrow(_classes, "cls long, n long").groupBy("cls").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") > HOT_COUNT).select("cls").collect()  # at most the sample's anchors / HOT_COUNT
    return np.sort(np.array([r["cls"] for r in rows], np.int64)).view(np.uint64)


def remove_repeats(docs: DataFrame, folder: str, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes, or else the hex of their SHA-256)."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = max(16, 2 * src.rdd.getNumPartitions())
    hot = hot_classes(src)

    def store(dealt: DataFrame, name: str) -> Marks:
        rows = cut(dealt.groupBy("shard").applyInArrow(_store(folder, name), "shard int, path string")).collect()
        return Marks(shards, {r["shard"]: r["path"] for r in rows})

    found = src.mapInArrow(_find_anchors(shards, hot), _PACKED).groupBy("shard").applyInArrow(_sort_classes(shards), _PACKED)
    marks = store(found, "marks")
    edges = src.mapInArrow(_contexts(marks, shards), f"{_PACKED}, context binary").groupBy("shard").applyInArrow(_sort_edges(shards), _PACKED)
    stores = [marks, store(edges, "edges")]
    return src.mapInArrow(_apply(stores, with_text), _RESULT)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/repeats-{uuid.uuid4().hex}"
    out = remove_repeats(docs, folder, with_text=False)
    out = cut(out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.decode("kept", "utf-8").alias("kept_sha256")))
    remove_shared(spark, folder)
    return out
