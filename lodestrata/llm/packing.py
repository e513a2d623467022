"""Operator 10: hierarchical best-fit packing of tokenised documents into sequences.

Every document becomes its token ids and the end id 1.  Only documents longer
than a sequence are cut.  Each input partition tokenises its texts and packs its
pieces by best-fit decreasing; nearly full bins are final.  Underfull bins then
rise through a tree as items: each node best-fits the bins of its children again.

What a node must hold is bounded without dropping anything: two bins can merge
only if one is at most half full, and a best-fit node keeps at most one such bin,
so a level of ``n`` nodes has at most ``n`` bins left to place, and each node need
only pass on its ``n`` emptiest bins; the rest are final.

Token ids are those of the given ``tokenizers`` file.  Its pre-tokenizer never
joins text across white space, so words are encoded once a worker and remembered
in a bounded table.

Defined cases: a null or empty text is the end id alone; rows that repeat a
doc_id are packed each; a null doc_id is packed like any other; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_batches
from .hashing import slices

LENGTH, END_ID = 4096, 1
#: Pieces packed together at most; a larger partition is packed in several windows.
WINDOW = 200_000
#: Free tokens that no longer make a bin worth passing on.
SLACK = 8
FAN_IN = 16
REMEMBERED = 500_000

_CONTROLS = re.compile("[\x1c-\x1f]")  # Python splits at these, the tokenizer's \s doesn't
_ASCII_SPACE = re.compile("[ \t\n\x0b\x0c\r]+")
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, ids binary"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in shown else next(rest)) for b in range(256)]


#: Words of printable ASCII and letters of Latin-1 alone: lower-casing and composing them is plain, and so is their cutting.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@[-`{-~]+")
_encoders: dict[str, Encoder] = {}


class Encoder(dict):
    """Little-endian 32-bit token ids of texts, word by word: ``encoder[word]`` is made on first use and remembered.

    Plain new words are cut as the file's pre-tokenizer cuts them, and each part, itself a word to remember, goes
    straight to the BPE model; all other words go through the whole tokenizer.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.remembered = Tokenizer.from_file(path), remembered
        self.model = self.tokenizer.model
        letters = _byte_letters()
        self.table = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}  # printable ASCII stands for itself
        self.raw = [i.to_bytes(4, "little") for i in range(1 + max(self.tokenizer.get_vocab().values(), default=0))]

    @classmethod
    def of_worker(cls, path: str) -> Encoder:
        """One encoder for all tasks of a Python worker."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def __missing__(self, word: str) -> bytes:
        raw = self.raw
        if word.isascii() and word.isalpha():
            parts = [word.lower()]
        elif _PLAIN.fullmatch(word) and "<|" not in word:
            parts = _PARTS.findall(word.lower())
        else:
            ids = self[word] = b"".join([raw[i] for i in self.tokenizer.encode(word, add_special_tokens=False).ids])
            return ids
        if parts == [word]:
            ids = b"".join([raw[t.id] for t in self.model.tokenize(word if word.isascii() else word.translate(self.table))])
        else:
            ids = b"".join([self[p] for p in parts])
        self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        if len(self) > self.remembered:
            self.clear()
        ids = self.__getitem__
        for text in texts:
            yield b"".join(map(ids, _ASCII_SPACE.split(text) if _CONTROLS.search(text) else text.split()))


def best_fit(sizes: list[int], capacity: int = LENGTH) -> tuple[list[int], list[int], list[int]]:
    """Best-fit decreasing: bin and offset of each item, and the bins' fills."""
    order = sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True)
    where, offset, fills = [0] * len(sizes), [0] * len(sizes), []
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by free space
    levels = 0  # bit f is set when some bin has f free
    for i in order:
        size = sizes[i]
        fitting = levels >> size
        if size < capacity and fitting:
            f = size + (fitting & -fitting).bit_length() - 1
            b = free[f].pop()
            if not free[f]:
                levels &= ~(1 << f)
        else:
            b, f = len(fills), capacity
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        f -= size
        free[f].append(b)
        levels |= 1 << f
    return where, offset, fills


def _tokenise_and_pack(path: str, length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(path)
        task = TaskContext.get().partitionId() if TaskContext.get() else 0
        end, step, bins = np.array([END_ID], "<u4").tobytes(), 4 * length, 0
        rows: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal bins
            where, offset, fills = best_fit([r[3] for r in rows], length)
            doc, piece, start, size, crc, raw = zip(*rows)
            numbers = np.array(where, np.int64) + ((task << 32) + bins)
            bins += len(fills)
            rows.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64()), pa.array(numbers), pa.array(offset, pa.int64()), pa.array(raw, pa.binary())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "ids"],
            )

        for batch in (part for whole in batches for part in slices(whole, 1)):
            docs = batch.column(0).to_pylist()
            for doc, ids in zip(docs, encoder.encode(batch.column(1).fill_null("").to_pylist())):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    rows.append((doc, k, k * length, len(own) // 4, zlib.crc32(own), own if with_ids else None))
            if len(rows) >= WINDOW:
                yield packed()
        if rows:
            yield packed()

    return run


def _merge(length: int, keep: int):
    def run(children: pd.DataFrame) -> pd.DataFrame:
        where, offset, fills = best_fit(children["fill"].tolist(), length)
        children = children.assign(group=where, shift=offset, fill=[fills[b] for b in where])
        # the bin is named after the item at its bottom
        names = children.loc[children["shift"] == 0].set_index("group")["bin"]
        children["into"] = children["group"].map(names)
        free = (length - children["fill"]).where((children["bin"] == children["into"]) & (children["fill"] <= length - SLACK), -1)
        last = free.nlargest(min(keep, len(free))).index
        children["rises"] = children.index.isin(last) & (free >= 0)
        return children[["bin", "into", "shift", "fill", "rises"]]

    return run


def pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids: little-endian 32-bit, if asked for)."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(texts.mapInArrow(_tokenise_and_pack(path or tokenizer_path(), length, with_ids), _PIECES))
    bins = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") <= length - SLACK)
    nodes = pieces.rdd.getNumPartitions()
    rising = cut(bins.withColumn("node", F.shiftright("bin", 32)))
    moved = None
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        at = rising.withColumn("node", (F.col("node") / FAN_IN).cast("long"))
        placed = cut(at.groupBy("node").applyInPandas(_merge_node(length, nodes), "node long, bin long, into long, shift long, fill long, rises boolean"))
        step = placed.where("bin <> into").select(F.col("bin").alias("was"), F.col("into").alias("now"), F.col("shift").alias("by"))
        if moved is None:
            moved = step.select(F.col("was").alias("first"), "now", "by")
        else:  # what lies in a moved bin moves along
            along = moved.withColumnRenamed("now", "mid").withColumnRenamed("by", "before").join(step, F.col("mid") == F.col("was"), "left")
            moved = along.select("first", F.coalesce("now", "mid").alias("now"), (F.col("before") + F.coalesce("by", F.lit(0))).alias("by")).unionAll(step.select(F.col("was").alias("first"), "now", "by"))
        moved = cut(moved)
        rising = placed.where("rises").select("node", "bin", "fill")
    out = pieces
    if moved is not None:
        out = pieces.join(moved, pieces["bin"] == moved["first"], "left").withColumn("bin", F.coalesce("now", "bin")).withColumn("offset", F.col("offset") + F.coalesce("by", F.lit(0)))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset"]
    return out.select(*columns, *(["ids"] if with_ids else []))


def _merge_node(length: int, keep: int):
    merge = _merge(length, keep)

    def run(key: tuple, children: pd.DataFrame) -> pd.DataFrame:
        out = merge(children.sort_values("bin", ignore_index=True))
        out.insert(0, "node", key[0])
        return out

    return run


def sequences(docs: DataFrame, path: str | None = None, length: int = LENGTH) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, as little-endian 32-bit ids."""
    packed = pack(docs, path, length, with_ids=True)
    parts = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return parts.select("sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
