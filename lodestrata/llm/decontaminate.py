"""Operator 6: benchmark decontamination by size-partitioned MinHash containment search.

An item is inside a document when at least 75 % of the item's distinct five-word
shingles are among the document's.  Jaccard bands cannot see a 30-shingle item
in a 5,000-shingle document (similarity 0.006), so items are searched by
containment: items are partitioned by size, and every item of a partition whose
sizes reach up to ``u`` is represented by its bottom ``u // 4 + 1`` hashes, a
MinHash sketch.  A document that holds 75 % of an item lacks at most a quarter of
its hashes, hence holds at least one of any such sketch: no leak is missed, and
documents without a sketch hash are done.  Candidates are verified by exact
containment on the full sets.

The benchmark is a stated query set.  It is run in blocks of at most
``BLOCK_HASHES`` hashes (checked), each one broadcast and one pass over the
documents, which are never shuffled.

Defined cases: null texts and texts without words have no shingles and match
nothing; an item of one to four words is one shingle, searched in every document
by the word n-grams of its own length; rows that repeat a doc_id or item_id count as one, with the largest
overlap of any of them; a null id is an id; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, cut, own_name, small_batches
from .hashing import SHINGLE, shingle_sets, short_gram_sets, word_hashes

PERCENT = 75
BLOCK_HASHES = 1 << 20
_PAIRS = "doc_id long, item_id long, n_shared long, n_item long"


def _item_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [s.view(np.int64) for s in shingle_sets(batch.column(1))]
        words = np.diff(word_hashes(batch.column(1))[1])
        short = pa.array(np.where(words < SHINGLE, words, 0), pa.int64())  # the length of an item of too few words
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64())), short], names=["item", "n", "hashes", "short"])


class Index:
    """Sketches and full sets of a block of items, as arrays."""

    def __init__(self, ids: list[int | None], sets: list[np.ndarray], short: list[int] = ()):
        #: Lengths of the items of under five words, and their hashes.
        self.lengths = sorted({n for n in short if n})
        self.short = np.unique(np.concatenate([s for s, n in zip(sets, short) if n])) if self.lengths else np.zeros(0, np.uint64)
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], np.int64)
        sketches = []
        for s in sets:
            upper = (1 << int(len(s)).bit_length()) - 1  # the partition's largest size: n lies in (upper // 2, upper]
            sketches.append(s[: upper // 4 + 1])
        self.sketch, self.sketch_items = self._flat(sketches)
        self.full, self.full_items = self._flat(sets)

    @staticmethod
    def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        return hashes[order], owner[order]

    @staticmethod
    def _owners(table: np.ndarray, items: np.ndarray, found: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(table, found, "left"), np.searchsorted(table, found, "right")
        hit = hi > lo
        if not hit.any():
            return items[:0]
        return np.concatenate([items[a:b] for a, b in zip(lo[hit], hi[hit])])

    def search(self, s: np.ndarray) -> list[tuple[int, int]]:
        """(item number, shared shingles) of the items contained in the sorted set ``s``."""
        candidates = np.unique(self._owners(self.sketch, self.sketch_items, s))
        if not len(candidates):
            return []
        shared = np.bincount(self._owners(self.full, self.full_items, s), minlength=len(self.ids))
        return [(i, int(shared[i])) for i in candidates.tolist() if 100 * shared[i] >= PERCENT * self.sizes[i]]


def _search(index) -> "callable":
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Index = index.value
        for batch in batches:
            docs = batch.column(0).to_pylist()
            sets = shingle_sets(batch.column(1))
            if block.lengths:
                sets = (np.union1d(s, x) for s, x in zip(sets, short_gram_sets(batch.column(1), block.lengths, block.short)))
            rows = [(docs[k], block.ids[i], n, int(block.sizes[i])) for k, s in enumerate(sets) if len(s) for i, n in block.search(s)]
            columns = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_shared", "n_item"])

    return run


def contained_items(docs: DataFrame, benchmark: DataFrame, block_hashes: int = BLOCK_HASHES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: every item that a document holds."""
    spark = docs.sparkSession
    small_batches(spark)
    sets = cut(benchmark.select(F.col("item_id").cast("long").alias("item"), "text").mapInArrow(_item_sets, "item long, n long, hashes array<long>, short long").where("n > 0"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_hashes)) if total > block_hashes else 1
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for b in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("item", "hashes"), F.lit(blocks)) == b).collect()  # about half of block_hashes
        index = Index([r["item"] for r in rows], [np.sort(np.array(r["hashes"], np.int64).view(np.uint64)) for r in rows], [r["short"] for r in rows])
        part = texts.mapInArrow(_search(spark.sparkContext.broadcast(index)), _PAIRS)
        found = part if found is None else found.unionAll(part)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("c"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_item", F.round("x.c", 6).alias("containment"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    mark = own_name(docs, "bad")
    bad = cut(contained_items(docs, benchmark).select(F.col("doc_id").alias(mark)).distinct())
    return docs.join(bounded(bad), docs["doc_id"].cast("long").eqNullSafe(F.col(mark)), "left_anti")
