"""Resonance of all pairs of word sets: shared words are counted 64 sets at a time in bit-sliced counters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import hashed_set
from ..plans.settle import settle
from .graph import components

#: At most so many frequent words have a row of bits in a block's index; all other words are looked up in lists.
ROWS = 6_144
#: Words of 64 bits in a span of an index, and sets that are counted against a span at once.
SPAN, TOGETHER = 256, 64
#: Rare words that a task looks up at once, and sets found by them that it holds at once (a set's own are not divided).
WORDS, MEETINGS = 1_000_000, 2_000_000
#: A set of so many words weighs as two sets without, where sets are dealt to blocks.
HEAVY = 256
#: Parts of a block, which go to the driver one at a time.
PIECES = 4
#: Sets whose words are counted to choose the frequent ones. Only the cost depends on that choice.
COUNTED = 20_000
#: Links that one task joins to stars before they go to rounds of joins.
STARS = 8_000_000
_SCALE = 8 / (3 * 3**0.5)
_LINK, _FOLD = "a long, b long, resonance double", "a long, b long, times long, total long"


def _least_similarity(resonance: float) -> float:
    """A bound just below the least similarity whose rhyme, rounded to 6 places, reaches ``resonance``."""
    low, high = 0.0, 3**-0.5
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if 4 * mid * (1 - mid * mid) / _SCALE >= resonance - 1e-6 else (mid, high)
    return low


def _lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column of lists, and where each list begins and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[at[0] : at[-1]], at - at[0]


def _split(frequent):
    """id, copies, n, piece, common (places in ``frequent``, which is sorted), rare (other words)."""

    def run(batches):
        known = frequent.value
        for batch in batches:
            words, at = _lists(batch.column("words"))
            place = np.searchsorted(known, words)
            common = np.append(known, 0)[place] == words if len(known) else np.zeros(len(words), bool)
            common &= place < len(known)
            ends = np.concatenate([[0], np.cumsum(common)])[at]
            lists = (pa.ListArray.from_arrays(pa.array(e.astype(np.int32)), pa.array(v)) for e, v in ((ends, place[common].astype(np.int16)), (at - ends, words[~common])))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "copies", "n", "piece")), *lists], names=["id", "copies", "n", "piece", "common", "rare"])

    return run


def _piece(table: pa.Table, words: int) -> tuple:
    """ids, sizes, copies in order of size and id; places by frequent word and where each begins; rare words, where each begins, places."""
    ids, sizes, copies = (table[c].to_numpy() for c in ("id", "n", "copies"))
    order = np.lexsort((ids, sizes))
    rank = np.empty(len(order), np.min_scalar_type(max(len(order) - 1, 0)))
    rank[order] = np.arange(len(order))
    common, at = _lists(table["common"])
    by = np.argsort(common, kind="stable")
    owners = np.repeat(rank, np.diff(at))[by]
    starts = np.concatenate([[0], np.cumsum(np.bincount(common, minlength=words))])
    rare, at = _lists(table["rare"])
    by = np.argsort(rare, kind="stable")
    rare, places = rare[by], np.repeat(rank, np.diff(at))[by]
    first = np.flatnonzero(np.append(True, rare[1:] != rare[:-1])[: len(rare)])
    return ids[order], sizes[order].astype(np.int64), copies[order], owners, starts, rare[first], np.append(first, len(rare)), places


def _bits(pieces: list[tuple], base: np.ndarray, words: int, most: int) -> np.ndarray:
    """By span of sets, a row of bits a frequent word: the sets that have it. The last row is empty."""
    width = min(most, -(-int(base[-1]) // 64))
    spans = -(-int(base[-1]) // (64 * width))
    bits = np.zeros((spans, words + 1, width), np.uint64)
    for lo in range(0, words, 64):
        hi = min(words, lo + 64)
        cells = np.zeros((hi - lo, spans * width * 64), np.uint8)
        for p, (_, _, _, owners, starts, *_) in enumerate(pieces):
            cells[np.repeat(np.arange(hi - lo), np.diff(starts[lo : hi + 1])), base[p] + owners[starts[lo] : starts[hi]].astype(np.int64)] = 1
        bits[:, lo:hi] = np.packbits(cells, axis=1, bitorder="little").view(np.uint64).reshape(hi - lo, spans, width).transpose(1, 0, 2)
    return bits


class _Counters:
    """Bit-sliced counters of a span for some sets at once: plane l holds bit l of each count."""

    def __init__(self, sets: int, width: int):
        self.shape, self.planes = (sets, width), []
        self.t, self.u = self.some(2)

    def some(self, n: int) -> list[np.ndarray]:
        return [np.empty(self.shape, np.uint64) for _ in range(n)]

    def run(self, bits: np.ndarray, rows: np.ndarray, start: np.ndarray, top: int) -> list[np.ndarray]:
        """Planes up to 2^top of start + the bits of ``rows`` (fewer than 2^top), a column of rows a set."""
        m = rows.shape[1]
        while len(self.planes) < top + 1:
            self.planes.append(self.some(4))
        sums = [p[0][:m] for p in self.planes[: top + 1]]
        spare = [[x[:m] for x in p[1:3]] for p in self.planes[: top + 1]]
        rows_of = [self.planes[0][3][:m], self.planes[1][3][:m]]
        for level, plane in enumerate(sums):
            np.negative((start >> level & 1).astype(np.uint64), plane)
        t, u, waits = self.t[:m], self.u[:m], [None] * (top + 1)
        xor, and_, or_ = np.bitwise_xor, np.bitwise_and, np.bitwise_or
        for row in rows:
            carry, level = rows_of[0], 0
            rows_of.reverse()
            bits.take(row, 0, carry, "clip")
            while (other := waits[level]) is not None:  # full adder: sum, other, carry
                waits[level] = None
                two = spare[level]
                out = two[0]
                two.reverse()
                plane = sums[level]
                xor(other, carry, t)
                and_(other, carry, u)
                and_(plane, t, out)
                or_(out, u, out)
                xor(plane, t, plane)
                carry, level = out, level + 1
            waits[level] = carry
        for level in range(top + 1):
            if waits[level] is not None:
                carry = waits[level]
                for plane, out in zip(sums[level:], (t, u) * (top + 1)):
                    and_(plane, carry, out)
                    xor(plane, carry, plane)
                    carry = out
        return sums


def _set_bits(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of each bit that is set."""
    flat = plane.reshape(-1)
    some = np.flatnonzero(flat)
    word, bit = np.nonzero(np.unpackbits(flat[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    row, word = np.divmod(some[word], plane.shape[1])
    return row, word * 64 + bit


def _once(ordered: np.ndarray) -> np.ndarray:
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)]]


class _Folded:
    """Of each set a, as a link to itself: its links' number and millionths, both times copies. Other links only where they join what the task has not joined."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.copies, self.label, self.root = ids, copies, np.full(len(ids), -1, np.int64), np.zeros(0, np.int64)
        self.out = []

    def add(self, own: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray, millionths: np.ndarray) -> None:
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1]))
        sets, c = a[first], self.copies[b]
        sums = times[sets] * np.add.reduceat(c, first), times[sets] * np.add.reduceat(c * millionths, first)
        group = np.searchsorted(sets, a) + len(self.root)  # a component for each set, until it is joined
        self.root = np.concatenate([self.root, np.arange(len(self.root), len(self.root) + len(sets))])
        fresh = np.flatnonzero(self.label[b] < 0)
        fresh = fresh[np.unique(b[fresh], return_index=True)[1]]
        self.label[b[fresh]] = group[fresh]
        other = self.root[self.label[b]]
        keep = []
        apart = np.flatnonzero(other != group)
        for one in apart[np.unique(group[apart] * len(self.root) + other[apart], return_index=True)[1]].tolist():
            x, y = int(group[one]), int(other[one])
            while self.root[x] != x:
                x = int(self.root[x])
            while self.root[y] != y:
                y = int(self.root[y])
            if x != y:
                self.root[max(x, y)] = min(x, y)
                keep.append(one)
        while not np.array_equal(self.root, near := self.root[self.root]):
            self.root = near
        joins = np.concatenate([fresh, np.array(keep, np.int64)])
        none = np.zeros(len(joins), np.int64)
        self.out.append((own[sets], own[sets], *sums))
        self.out.append((own[a[joins]], self.ids[b[joins]], none, none))

    def batch(self) -> pa.RecordBatch:
        rows = [np.concatenate(x) for x in zip((np.zeros(0, np.int64),) * 4, *self.out)]
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["a", "b", "times", "total"])


class _Listed:
    """Every link by itself."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray):
        self.ids, self.out = ids, []

    def add(self, own: np.ndarray, times: np.ndarray, a: np.ndarray, b: np.ndarray, millionths: np.ndarray) -> None:
        a, b = own[a], self.ids[b]
        self.out.append((np.minimum(a, b), np.maximum(a, b), millionths / 1_000_000))

    def batch(self) -> pa.RecordBatch:
        a, b, resonance = (np.concatenate(x) for x in zip((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), *self.out))
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(resonance)], names=["a", "b", "resonance"])


def _groups(pieces: list[tuple], rare: np.ndarray, ra: np.ndarray, together: int):
    """Sets i to stop, and by piece where the list of each of their rare words begins, its length, and all lists. Few enough sets for ``WORDS`` and ``MEETINGS``."""
    i = end = off = 0
    while i < len(ra) - 1:
        if i == end:
            off, end = i, min(max(int(np.searchsorted(ra, ra[i] + WORDS, "right")) - 1, i + together), len(ra) - 1)
            words, found = rare[ra[off] : ra[end]], []
            for *_, known, starts, places in pieces:
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                begin = starts[at] if len(known) else np.zeros(len(words), np.int64)
                found.append((begin, np.where(known[at] == words, starts[at + 1] - begin, 0) if len(known) else begin, places))
            met = np.append(0, np.cumsum(sum(k for _, k, _ in found)))[ra[off : end + 1] - ra[off]]
        stop = max(i + 1, min(int(np.searchsorted(met, met[i - off] + MEETINGS, "right")) - 1 + off, i + together, end))
        own = slice(ra[i] - ra[off], ra[stop] - ra[off])
        yield i, stop, [(begin[own], k[own], places) for begin, k, places in found]
        i = stop


def _against(index, first: int, threshold: float, words: int, kind: type, most: int, together: int):
    """Links of sets to those of a block, which begins with piece ``first``: to all of later pieces, to later ones of a set's own."""
    least = _least_similarity(threshold)
    share = least / (1 + least)  # of both sizes, what must be shared

    def run(batches):
        pieces = index.value
        base = np.concatenate([[0], np.cumsum([len(p[0]) for p in pieces])])
        ids, sizes, copies = (np.concatenate([p[i] for p in pieces]) for i in range(3))
        bits, links, every = _bits(pieces, base, words, most), kind(ids, copies), len(ids)
        width = bits.shape[2]
        counters, span = _Counters(together, width), width * 64
        smallest = np.full(len(bits) * width, sizes[-1])
        smallest[: -(-every // 64)] = sizes[::64]
        for batch in batches:
            # sets of like size and like number of frequent words go together
            n, has = batch.column("n").to_numpy(), np.diff(batch.column("common").offsets.to_numpy())
            batch = batch.take(pa.array(np.lexsort((has, np.argsort(np.argsort(n, kind="stable")) // (8 * together)))))
            own, times, n, piece = (batch.column(c).to_numpy() for c in ("id", "copies", "n", "piece"))
            (common, ca), (rare, ra), n = _lists(batch.column("common")), _lists(batch.column("rare")), n.astype(np.int64)
            within = np.maximum(piece.astype(np.int64) - first, -1)
            lo = np.zeros(len(n), np.int64)
            for p in range(len(pieces)):
                lo[within == p] = base[p] + np.searchsorted(pieces[p][1], n[within == p])
            hi = np.searchsorted(sizes, n / least, "right")
            after = np.where(within >= 0, base[within + 1], 0)
            for i, stop, found in _groups(pieces, rare, ra, together):
                g = slice(i, stop)
                low, high, size, m = int(lo[g].min()), int(hi[g].max()), n[g], g.stop - i
                if low >= high:
                    continue
                has = np.diff(ca[i : g.stop + 1])
                longest = int(has.max())
                few = int(max(np.ceil(share * (size.min() + sizes[low]) - 1e-6), 1)) >> 4  # sets that share more rare words than these are looked at by themselves
                near = [np.zeros(0, np.int64)]
                of = np.repeat(np.arange(m) * every, np.diff(ra[i : g.stop + 1]))
                for q, (begin, k, places) in enumerate(found):
                    if base[q + 1] > low and base[q] < high:
                        near.append(places[np.repeat(begin - np.cumsum(k) + k, k) + np.arange(k.sum())] + np.repeat(of + base[q], k))
                near = np.sort(np.concatenate(near))
                more = near[few:]
                more = _once(more[more == near[: len(more)]])
                a, b = np.divmod(more, every)
                shared = np.searchsorted(near, more, "right") - np.searchsorted(near, more)
                more = more[(shared + has[a] >= share * (size[a] + sizes[b]) - 1e-6) & (b >= lo[g][a]) & (b < hi[g][a])]
                more_a, more_b = np.divmod(more, every)
                top = max(longest.bit_length(), 1)
                rows = np.full((longest, m), words)
                rows[np.arange(ca[i], ca[g.stop]) - np.repeat(ca[i : g.stop], has), np.repeat(np.arange(m), has)] = common[ca[i] : ca[g.stop]]
                pairs = []
                for s in range(low // span, -(-high // span)):
                    need = np.maximum(np.ceil(share * (size[:, None] + smallest[s * width : (s + 1) * width]) - 1e-6).astype(np.int64), 1) - few
                    here = (more_b >= s * span) & (more_b < (s + 1) * span)
                    if not here.any() and not (need[:, 0] <= has).any():
                        continue
                    start = np.maximum((1 << top) - np.maximum(need, 1), 0)
                    planes = counters.run(bits[s], rows, start, top)
                    a, b = _set_bits(planes[top])
                    key = _once(np.sort(np.concatenate([a * span + b, more_a[here] * span + more_b[here] - s * span])))
                    a, b = np.divmod(key, span)
                    w, bit = b >> 6, (b & 63).astype(np.uint64)
                    value = -start[a, w]
                    for level, plane in enumerate(planes):
                        value += (plane[a, w] >> bit & np.uint64(1)).astype(np.int64) << level
                    pairs.append((a, b + s * span, value))
                if not pairs:
                    continue
                a, b, shared = (np.concatenate(x) for x in zip(*pairs))
                ok = (b >= lo[g][a]) & (b < hi[g][a])
                a, b, shared = a[ok], b[ok], shared[ok]
                ok = (b >= after[g][a]) | (sizes[b] > size[a]) | (ids[b] > own[g][a])
                a, b, shared = a[ok], b[ok], shared[ok]
                key = a * every + b
                shared = shared + np.searchsorted(near, key, "right") - np.searchsorted(near, key)
                similar = shared / (size[a] + sizes[b] - shared)
                millionths = np.floor(4 * similar * (1 - similar * similar) / _SCALE * 1_000_000 + 0.5).astype(np.int64)
                ok = np.flatnonzero(millionths / 1_000_000 >= threshold)
                if len(ok):
                    ok = ok[np.argsort(a[ok], kind="stable")]
                    links.add(own[g], times[g], a[ok], b[ok], millionths[ok])
            yield links.batch()

    return run


def _pieces(some: DataFrame, most: int) -> tuple[DataFrame, int]:
    """With the number of a set's piece: pieces that weigh about ``most`` (less than twice that but for chance), in order of size."""
    counted = some.groupBy("n").count().toArrow()
    n, count = counted["n"].to_numpy(), counted["count"].to_numpy()
    order = np.argsort(n)
    n, count = n[order], count[order]
    weight = count * (HEAVY + n.astype(np.int64))
    last, most = np.cumsum(weight) - 1, most * HEAVY
    first = (last - weight + 1) // most
    table = pa.table({"n": pa.array(n), "first": pa.array(first), "over": pa.array(last // most - first + 1)})
    dealt = some.join(F.broadcast(some.sparkSession.createDataFrame(table)), "n")
    return dealt.withColumn("piece", (F.col("first") + F.pmod(F.xxhash64("id"), F.col("over"))).cast("int")), int(last[-1] // most + 1)


def _meet(sets: DataFrame, threshold: float, block: int, kind: type, schema: str) -> DataFrame:
    """sets: id, words (hashes, distinct), copies.  What ``kind`` makes of all pairs that resonate enough."""
    if threshold <= 0:
        raise ValueError("the threshold must be over 0")
    spark = sets.sparkSession
    some = sets.where(F.size("words") > 0).select("id", "words", "copies", F.size("words").alias("n"))
    total = some.count()
    if not total:
        return spark.createDataFrame([], schema)
    counted = some.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(max(1, total // COUNTED))) == 0)
    often = counted.select(F.explode("words").alias("word")).groupBy("word").count().where("count > 1").orderBy(F.desc("count"), "word").limit(ROWS)
    known = np.sort(often.select("word").toArrow()["word"].to_numpy())
    dealt, pieces = _pieces(some, max(1, block // PIECES))
    frequent = spark.sparkContext.broadcast(known)
    dealt = settle(dealt.select("id", "copies", "n", "piece", "words").mapInArrow(_split(frequent), "id long, copies long, n int, piece int, common array<short>, rare array<long>"))
    found = None
    for first in range(0, pieces, PIECES):
        block_ = []
        for p in range(first, min(first + PIECES, pieces)):
            block_.append(_piece(dealt.where(F.col("piece") == p).toArrow(), len(known)))
            spark.sparkContext._jvm.System.gc()  # what was collected is left on the driver's heap
        index = spark.sparkContext.broadcast(block_)
        del block_
        # each task makes the rows of bits from the index, so there are no more tasks than cores
        asking = dealt.where(F.col("piece") < first + PIECES).coalesce(max(1, spark.sparkContext.defaultParallelism))
        near = settle(asking.mapInArrow(_against(index, first, threshold, len(known), kind, SPAN, TOGETHER), schema))
        index.destroy()
        found = near if found is None else found.unionAll(near)
    frequent.destroy()
    return found


def rhyme_links(sets: DataFrame, threshold: float, block: int = 98_304) -> DataFrame:
    """sets: id, words (hashes, distinct).  a, b, resonance of every pair that resonates enough (threshold over 0).

    All pairs are compared. Sets are dealt by size to blocks that weigh about ``block``, a set 1 and its words 1/256 each, and each block is broadcast as an index of
    its words; sets of this and earlier blocks meet it, the smaller set of a pair asking. The index has a row of bits for each
    of ``ROWS`` frequent words, and lists for all others: a set's rows are added in bit-sliced counters, which count 64 sets in
    an operation of the processor, its lists are sorted, and both counts are added where their sum can be enough. So sets are never shuffled, no
    word is a hot key and only links leave a task; the work grows with the square of the sets. Empty sets resonate with nothing.
    """
    return _meet(sets.withColumn("copies", F.lit(1).cast("long")), threshold, block, _Listed, _LINK)


def _stars(batches):
    """(a, b) links as (node, least node) of each component of the task's links."""
    tables = [b for b in batches]
    x, y = (np.concatenate([np.zeros(0, np.int64), *(b.column(i).to_numpy() for b in tables)]) for i in range(2))
    nodes, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    label, x, y = np.arange(len(nodes)), at[: len(x)], at[len(x) :]
    while len(x):
        x, y = label[x], label[y]
        open_ = x != y
        x, y = np.maximum(x[open_], y[open_]), np.minimum(x[open_], y[open_])
        np.minimum.at(label, x, y)
        while not np.array_equal(label, near := label[label]):
            label = near
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["a", "b"])


def cluster_by_rhyme(docs: DataFrame, threshold: float = 0.45) -> DataFrame:
    """docs: id (distinct), text.  component, size, resonance of the clusters among all pairs of documents.

    Documents of one word set resonate 0 with each other and alike with all others, so a set is compared once and
    counts as often as it has documents. Links are summed where they are found: only a set's sums leave a task, and the
    links that join what the task has not joined.
    """
    words = F.array_sort(hashed_set(F.col("text")))
    sets = settle(docs.select("id", words.alias("words")).groupBy("words").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    links = _meet(sets, threshold, 98_304, _Folded, _FOLD)
    tasks = max(1, links.count() // STARS)
    comp = components(links.select("a", "b").coalesce(tasks).mapInArrow(_stars, "a long, b long"))
    sizes = comp.join(sets.select(F.col("id").alias("node"), "copies"), "node").groupBy("component").agg(F.sum("copies").alias("size"))
    sums = links.groupBy("a").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
    inside = comp.join(sums, comp["node"] == sums["a"]).groupBy("component").agg(F.sum("times").alias("times"), F.sum("total").alias("total"))
    # whole numbers until here, so that the mean does not depend on their order
    return sizes.join(inside, "component").select("component", "size", (F.round(F.col("total") / F.col("times")) / 1_000_000).alias("resonance"))
