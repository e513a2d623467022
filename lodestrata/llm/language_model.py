"""Operator 7: interpolated modified Kneser-Ney language model, counted in Spark, scored from memory-mapped hash arrays.

Tokens are the words of a text (A-Z lower-cased) and one end token.  The model is
of order 2: on these corpora most word triples occur once, and a table of them
would outgrow the texts themselves; see the README for figures.

Counting takes three passes, each pre-aggregated in the mapping tasks, which send
sorted arrays rather than rows, and a shard is combined while its arrays arrive:
1. words: 64-bit hashes and counts, in shards by the hash's top bits.  A word's
   number is its place in the global sorted order of hashes;
2. pairs: ``context number << 32 | word number`` and counts, in key ranges that
   hold about equal numbers of tokens, SHARD_TOKENS at most however few partitions
   the table has.  A context that outweighs a range is split
   by word number, so no word makes a hot shard;
3. continuations: for each word the number of distinct contexts before it.

Every shard is a file of one sorted array (and one of counts) in the shared
folder.  Workers memory-map the shards and score batches by sorted look-ups;
nothing of the model's size is ever in one process's heap or on the driver.  All
of the corpus counts: there is no vocabulary cut, pruning or sample.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)
    p(w)     = max(k(w) - D'(k(w)), 0) / K + g' / (V + 1)

with k(w) the distinct contexts of w, K their sum and V the vocabulary, so unknown
words share one part of the uniform term.  Discounts are Chen and Goodman's; where
counts of counts are too sparse for them, 0.75 of the largest legal discount.

Defined cases: a null or empty text is the end token alone; a null doc_id is
hashed as the empty text and so trains; rows that repeat a doc_id count each;
without any training row every token is unknown and p is uniform over one word;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Lazily, cut, map_shared, open_shared, shared_dir, small_batches
from .hashing import slices, word_hashes

FOLDS, HELD_OUT = 5, 1
END = np.uint64(0x5EED0F7E57E4D000)  # the hash that stands for the end token
#: Keys gathered in a mapping task before they are combined.
BUFFER = 2_000_000
#: Training tokens of a shard of pairs, about.
SHARD_TOKENS = 1_000_000
LOW = np.uint64(0xFFFFFFFF)
W32 = np.uint64(32)
#: Counts that 32 bits cannot hold, and the statistics of a context: c, n1, n2, n3+.
MANY, STATS = np.dtype([("key", "<u8"), ("n", "<i8")]), np.dtype([("n", "<i8", 4)])


def is_held_out() -> Column:
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(name.cast("binary")) % FOLDS == HELD_OUT


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each ended by END, and n+1 offsets."""
    words, at = word_hashes(texts)
    n = len(at) - 1
    out = np.full(len(words) + n, END, np.uint64)
    shift = np.repeat(np.arange(n), np.diff(at))
    out[np.arange(len(words)) + shift] = words
    return out, at + np.arange(n + 1)


def combine(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.diff(keys, prepend=keys[0] ^ np.uint64(1)))
    return keys[first], np.add.reduceat(counts[order], first)


class Gather:
    """Counts keys a bounded buffer at a time."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> bool:
        """Whether the buffer is full."""
        self.parts.append(keys)
        self.pending += len(keys)
        return self.pending >= BUFFER

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate(self.parts) if self.parts else np.zeros(0, np.uint64)
        self.parts, self.pending = [], 0
        keys.sort()
        first = np.flatnonzero(np.diff(keys, prepend=keys[:1] ^ np.uint64(1))) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.append(first, len(keys)))


def _chunks(keys: np.ndarray, counts: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch:
    """A row for each shard that has keys; keys are sent in halves, which compress better sorted."""
    cuts = np.concatenate([[0], np.searchsorted(keys, bounds), [len(keys)]])
    shards = np.flatnonzero(np.diff(cuts))
    high, low, n = (keys >> W32).astype("<u4"), (keys & LOW).astype("<u4"), np.minimum(counts, 0xFFFFFFFF).astype("<u4")
    cells = [[x[cuts[s] : cuts[s + 1]].tobytes() for s in shards] for x in (high, low, n)]
    return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), *(pa.array(c, pa.binary()) for c in cells)], names=["shard", "high", "low", "n"])


_CHUNKS = "shard int, high binary, low binary, n binary"


def _joined(batches: Iterator[pa.RecordBatch]) -> tuple[int, np.ndarray, np.ndarray]:
    """A shard and its distinct keys with their counts; beside these, only about as many keys wait to be combined."""
    shard, keys, counts = 0, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    new: list[tuple[np.ndarray, np.ndarray]] = []
    pending = 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return combine(np.concatenate([keys, *(k for k, _ in new)]), np.concatenate([counts, *(n for _, n in new)]))

    for batch in batches:
        shard = batch.column("shard")[0].as_py()
        for high, low, n in zip(*(batch.column(c) for c in ("high", "low", "n"))):
            high, low, n = (np.frombuffer(x.as_buffer(), "<u4") for x in (high, low, n))
            key = high.astype(np.uint64)
            key <<= W32
            key |= low
            new.append((key, n.astype(np.int64)))
            pending += len(key)
            if pending >= max(BUFFER // 4, len(keys)):
                keys, counts = merged()
                new, pending = [], 0
    keys, counts = merged()
    return shard, keys, counts


def _write(name: str, array: np.ndarray) -> None:
    with open_shared(name, "wb") as f:
        f.write(array.tobytes())


def _count_words(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Gather()
        for batch in batches:
            for part in slices(batch, 0):
                if seen.add(tokens(part.column(0))[0]):
                    yield _chunks(*seen.take(), bounds)
        yield _chunks(*seen.take(), bounds)

    return run


_WORD_SHARD = "shard int, name string, n long, total long"


def _store_words(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, hashes, counts = _joined(batches)
        name = f"{folder}/words-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        _write(f"{name}.hash", hashes)
        _write(f"{name}.count", counts)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "name": [name], "n": [len(hashes)], "total": [int(counts.sum())]})

    return run


@dataclass
class Model:
    """Names and sums of a stored model; the arrays stay in the shared folder."""

    folder: str
    word_bits: int
    words: list[tuple[int, str, int]]  # shard, name, number of words
    total: int = 0
    pair_bounds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    pairs: dict[int, str] = field(default_factory=dict)
    split: dict[int, list[int]] = field(default_factory=dict)  # statistics of contexts that lie in several shards
    discounts: list[float] = field(default_factory=lambda: [0.75, 1.5, 2.25])
    uni_discounts: list[float] = field(default_factory=lambda: [0.75, 1.5, 2.25])
    spread: int = 0  # distinct pairs
    uni_left: float = 1.0  # g'
    tails: dict[int, str] = field(default_factory=dict)
    tail_size: int = 1

    @property
    def size(self) -> int:
        return sum(n for _, _, n in self.words)

    # -- look-ups in a worker ----------------------------------------------------------

    def open(self) -> Model:
        starts = np.cumsum([0] + [n for _, _, n in self.words]).tolist()
        self._words = Lazily(lambda x: (map_shared(f"{x[0]}.hash", "<u8"), map_shared(f"{x[0]}.count", "<i8"), x[1]), {s: (name, at) for (s, name, _), at in zip(self.words, starts)})
        self._pairs = Lazily(lambda name: (map_shared(f"{name}.key", "<u8"), map_shared(f"{name}.count", "<u4"), map_shared(f"{name}.many", MANY)), self.pairs)
        self._contexts = Lazily(lambda name: (map_shared(f"{name}.context", "<u4"), map_shared(f"{name}.stats", STATS)), self.pairs)
        self._tails = Lazily(lambda name: map_shared(name, "<i8"), self.tails)
        return self

    @staticmethod
    def _find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(array, keys)
        at[at == len(array)] = 0
        return at, (array[at] == keys) if len(array) else np.zeros(len(keys), bool)

    def numbers(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers (-1: unknown) and training counts of sorted distinct hashes."""
        number, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        shard = (hashes >> np.uint64(64 - self.word_bits)).astype(np.int64) if self.word_bits else np.zeros(len(hashes), np.int64)
        for s in np.unique(shard).tolist():
            if s in self._words:
                i, j = np.searchsorted(shard, [s, s + 1])
                array, counts, start = self._words[s]
                at, hit = self._find(array, hashes[i:j])
                number[i:j][hit] = at[hit] + start
                count[i:j][hit] = counts[at[hit]]
        return number, count

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Training counts of sorted distinct pair keys."""
        out = np.zeros(len(keys), np.int64)
        cuts = np.concatenate([[0], np.searchsorted(keys, self.pair_bounds), [len(keys)]])
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            if s in self._pairs:
                i, j = cuts[s], cuts[s + 1]
                table, counts, many = self._pairs[s]
                at, hit = self._find(table, keys[i:j])
                found = counts[at[hit]].astype(np.int64)
                if len(many) and (more := found == LOW).any():
                    found[more] = many["n"][np.searchsorted(many["key"], keys[i:j][hit][more])]
                out[i:j][hit] = found
        return out

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """Rows (c, n1, n2, n3+) of sorted distinct context numbers."""
        out = np.zeros((len(numbers), 4), np.int64)
        keys = numbers.astype(np.uint64) << W32
        shard = np.searchsorted(self.pair_bounds, keys, "right")
        for s in np.unique(shard).tolist():
            if s in self._contexts:
                i, j = np.searchsorted(shard, [s, s + 1])
                array, stats = self._contexts[s]
                at, hit = self._find(array, numbers[i:j].astype(np.uint32))
                out[i:j][hit] = stats[at[hit]]["n"]
        for k in np.flatnonzero(np.isin(numbers, list(self.split))).tolist() if self.split else ():
            out[k] = self.split[int(numbers[k])]
        return out

    def tail_counts(self, numbers: np.ndarray) -> np.ndarray:
        """Distinct contexts of sorted distinct word numbers."""
        out = np.zeros(len(numbers), np.int64)
        shard = numbers // self.tail_size
        for s in np.unique(shard).tolist():
            if s in self._tails:
                i, j = np.searchsorted(shard, [s, s + 1])
                out[i:j] = self._tails[s][numbers[i:j] - s * self.tail_size]
        return out

    def log10(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 p of every token, given word numbers (-1: unknown) and the texts' offsets."""
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[at[:-1]] = self.size  # the beginning of a text is a context of its own
        words, word_of = np.unique(np.maximum(ids, 0), return_inverse=True)
        k = np.where(ids >= 0, self.tail_counts(words)[word_of], 0)
        uni = np.maximum(k - np.array([0.0, *self.uni_discounts])[np.minimum(k, 3)], 0) / max(self.spread, 1) + self.uni_left / (self.size + 1)
        known = (ids >= 0) & (before >= 0)
        keys = np.where(known, before.astype(np.uint64) << W32 | np.maximum(ids, 0).astype(np.uint64), np.uint64(0xFFFFFFFFFFFFFFFF))
        distinct, key_of = np.unique(keys, return_inverse=True)
        c = np.where(known, self.pair_counts(distinct)[key_of], 0)
        heads, head_of = np.unique(np.maximum(before, 0), return_inverse=True)
        stats = np.where((before >= 0)[:, None], self.contexts(heads)[head_of], 0)
        d = np.array([0.0, *self.discounts])
        total = stats[:, 0]
        left = stats[:, 1:] @ d[1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            two = (np.maximum(c - d[np.minimum(c, 3)], 0) + left * uni) / total
        return np.log10(np.where(total > 0, two, uni))


def _count_pairs(model: Model, bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, seen = model.open(), Gather()
        for batch in batches:
            for part in slices(batch, 0):
                hashes, at = tokens(part.column(0))
                distinct, of = np.unique(hashes, return_inverse=True)
                ids = opened.numbers(distinct)[0][of]
                before = np.empty_like(ids)
                before[1:] = ids[:-1]
                before[at[:-1]] = model.size
                if seen.add(before.astype(np.uint64) << W32 | ids.astype(np.uint64)):
                    yield _chunks(*seen.take(), bounds)
        yield _chunks(*seen.take(), bounds)

    return run


_PAIR_SHARD = "shard int, name string, n1 long, n2 long, n3 long, n4 long, n long, first long, first_stats array<long>, last long, last_stats array<long>"


def _store_pairs(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, counts = _joined(batches)
        heads = (keys >> W32).astype("<u4")
        starts = np.append(0, np.flatnonzero(heads[1:] != heads[:-1]) + 1)
        stats = np.empty((len(starts), 4), "<i8")
        for i, test in enumerate((None, lambda n: n == 1, lambda n: n == 2, lambda n: n >= 3)):
            stats[:, i] = np.add.reduceat(test(counts).astype("<i8") if test else counts, starts)
        name = f"{folder}/pairs-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        more = np.flatnonzero(counts >= int(LOW))
        many = np.zeros(len(more), MANY)
        many["key"], many["n"] = keys[more], counts[more]
        for end, array in ((".key", keys), (".count", np.minimum(counts, int(LOW)).astype("<u4")), (".many", many), (".context", heads[starts]), (".stats", stats)):
            _write(name + end, array)
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        values = [shard, name, *of, len(keys), int(heads[0]), stats[0].tolist(), int(heads[-1]), stats[-1].tolist()]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        names = [c.split()[0] for c in _PAIR_SHARD.split(", ")]
        yield pa.RecordBatch.from_pydict({n: pa.array([v], k) for n, v, k in zip(names, values, kinds)})

    return run


def _count_tails(size: int, shards: int):
    """For each word of a pair shard the number of its contexts there, dealt by word number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = (np.arange(1, shards, dtype=np.uint64)) * np.uint64(size)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                keys = np.asarray(map_shared(f"{name}.key", "<u8"))
                words, n = np.unique(keys & LOW, return_counts=True)
                yield _chunks(words, n, bounds)

    return run


_TAIL_SHARD = "shard int, name string, n1 long, n2 long, n3 long, n4 long, more long"


def _store_tails(folder: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, words, counts = _joined(batches)
        dense = np.zeros(size, "<i8")
        dense[words.astype(np.int64) - shard * size] = counts
        name = f"{folder}/tails-{shard:06d}-{TaskContext.get().taskAttemptId()}"
        _write(name, dense)
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        values = [shard, name, *of, int((counts >= 3).sum())]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_pydict({c.split()[0]: pa.array([v], k) for c, v, k in zip(_TAIL_SHARD.split(", "), values, kinds)})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """D1, D2 and D3+ from counts of counts."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    pairs = ((n1, n2), (n2, n3), (n3, n4))
    out = [k - (k + 1) * y * b / a if a and y else 0.75 * k for k, (a, b) in enumerate(pairs, 1)]
    return [d if 0 < d < k else 0.75 * k for k, d in enumerate(out, 1)]


def train(docs: DataFrame, folder: str) -> Model:
    """Counts ``docs`` (doc_id, text) and stores the model in ``folder``."""
    small_batches(docs.sparkSession)
    texts = docs.select("text")
    parts = max(8, 2 * texts.rdd.getNumPartitions())
    bits = (parts - 1).bit_length()
    word_bounds = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    words = cut(texts.mapInArrow(_count_words(word_bounds), _CHUNKS).groupBy("shard").applyInArrow(_store_words(folder), _WORD_SHARD)).orderBy("shard").collect()
    model = Model(folder, bits, [(r["shard"], r["name"], r["n"]) for r in words], sum(r["total"] for r in words))
    if not model.size:
        return model
    if model.size >= 0xFFFFFFFF:
        raise ValueError("word numbers of 32 bits are used up")

    parts = max(parts, -(-model.total // SHARD_TOKENS))
    model.pair_bounds = _pair_bounds(model, texts, parts)
    pairs = cut(texts.mapInArrow(_count_pairs(model, model.pair_bounds), _CHUNKS).groupBy("shard").applyInArrow(_store_pairs(folder), _PAIR_SHARD))
    rows = pairs.orderBy("shard").collect()
    model.pairs = {r["shard"]: r["name"] for r in rows}
    model.spread = sum(r["n"] for r in rows)
    model.discounts = discounts(*(sum(r[c] for r in rows) for c in ("n1", "n2", "n3", "n4")))
    # a context that is not, or not only, in the shard where look-ups expect it is the first or last one of its shards
    ends: dict[int, dict[int, list[int]]] = {}
    for r in rows:
        ends.setdefault(r["first"], {})[r["shard"]] = r["first_stats"]
        ends.setdefault(r["last"], {})[r["shard"]] = r["last_stats"]
    home = {v: int(np.searchsorted(model.pair_bounds, np.uint64(v << 32), "right")) for v in ends}
    model.split = {v: np.sum(list(x.values()), axis=0).tolist() for v, x in ends.items() if list(x) != [home[v]]}

    model.tail_size = -(-model.size // parts)
    names = pairs.select("name").repartition(max(1, len(rows)), "name")
    tails = cut(names.mapInArrow(_count_tails(model.tail_size, parts), _CHUNKS).groupBy("shard").applyInArrow(_store_tails(folder, model.tail_size), _TAIL_SHARD)).collect()
    model.tails = {r["shard"]: r["name"] for r in tails}
    sums = [sum(r[c] for r in tails) for c in ("n1", "n2", "n3", "n4", "more")]
    model.uni_discounts = discounts(*sums[:4])
    model.uni_left = float(np.dot(model.uni_discounts, [sums[0], sums[1], sums[4]]) / model.spread)
    return model


_MASS = "name string, at long, heavy array<struct<number:long,n:long>>, bounds array<long>"


def _masses(shards: list[tuple[int, str, int]], goal: int):
    """Per word shard: its heavy words, and after which word numbers another ``goal`` tokens are full."""
    starts = dict(zip([n for _, n, _ in shards], np.cumsum([0] + [k for _, _, k in shards]).tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                counts = np.asarray(map_shared(f"{name}.count", "<i8"))
                heavy = np.flatnonzero(counts > goal)
                full = np.cumsum(counts) // goal
                bounds = np.flatnonzero(np.diff(full, prepend=0)) + 1 + starts[name]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([starts[name]]), pa.array([[{"number": int(i) + starts[name], "n": int(counts[i])} for i in heavy]], pa.list_(pa.struct([("number", pa.int64()), ("n", pa.int64())]))), pa.array([bounds.tolist()], pa.list_(pa.int64()))],
                    names=["name", "at", "heavy", "bounds"],
                )

    return run


def _pair_bounds(model: Model, texts: DataFrame, parts: int) -> np.ndarray:
    """Sorted keys that divide pairs into ranges of about ``total / parts`` tokens."""
    goal = max(1, model.total // parts)
    spark = texts.sparkSession
    names = spark.createDataFrame([(n,) for _, n, _ in model.words], "name string").repartition(len(model.words), "name")
    rows = names.mapInArrow(_masses(model.words, goal), _MASS).collect()
    bounds = {int(b) << 32 for r in rows for b in r["bounds"]} | {model.size << 32}
    for r in rows:
        for x in r["heavy"]:
            pieces = -(-x["n"] // goal)
            bounds |= {(x["number"] << 32) | (model.size * i // pieces) for i in range(pieces)}
    return np.array(sorted(bounds), np.uint64)


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = model.open()
        floor = model.total + 0.5 * (model.size + 1)
        for whole in batches:
            for batch in slices(whole, 2):
                hashes, at = tokens(batch.column(2))
                distinct, of = np.unique(hashes, return_inverse=True)
                number, count = opened.numbers(distinct)
                ids, c = number[of], count[of]
                sums = [np.add.reduceat(x, at[:-1]) if len(x) else np.zeros(0) for x in (c > 0, np.log10((c + 0.5) / floor), opened.log10(ids, at) if len(ids) else ids)]
                n = len(at) - 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.diff(at), pa.int64()), pa.array(sums[0].astype(np.int64)), pa.array(np.full(n, model.total)), pa.array(sums[1].astype(float)), pa.array(sums[2].astype(float))],
                    names=[c.split()[0] for c in _SCORES.split(", ")],
                )

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), is_held_out().alias("held_out"), "text")
    out = src.mapInArrow(_score(model), _SCORES)
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


def train_and_score(docs: DataFrame) -> tuple[DataFrame, str]:
    """Scores of all documents by a model of those that are not held out, and the model's folder."""
    folder = f"{shared_dir(docs.sparkSession)}/lm-{uuid.uuid4().hex}"
    model = train(docs.where(~is_held_out()), folder)
    return score(docs, model), folder
