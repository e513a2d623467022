"""Pieces shared by the operators: white space, in-row binding, checkpoints."""

from __future__ import annotations

import itertools
import mmap
import os
import sys
import tempfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ``[\x20\x09-\x0D]``, the only characters that separate words or are stripped from lines.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = "[\\x20\\x09-\\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row (a lambda variable is never inlined)."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS + "+"), "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts of ASCII only take the fast built-in."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def strip(text: Column) -> Column:
    """The text without ``[\\x20\\x09-\\x0D]`` at both ends."""
    return F.btrim(text, F.lit(SPACES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``), with its file system's scheme; a temporary one only where that is unset and all runs in one process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not at and context.getCheckpointDir().isDefined():
        at = context.getCheckpointDir().get()
    if not at:
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(at)
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a reliable checkpoint in the shared folder: survives lost executors, and is computed once."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Have the driver's JVM collect its garbage now, between the phases of a long operator.

    Only then does Spark let go of the broadcasts, shuffles and checkpoints of frames that are gone; left alone, the heap
    grows to all it may take first, at a task's bookkeeping for each of tens of thousands of tasks.
    """
    spark.sparkContext._jvm.System.gc()


#: Document ids broadcast at most (8 bytes each).
BROADCAST_IDS = 1_000_000


def bounded(ids: DataFrame) -> DataFrame:
    """Computed ids, broadcast to the scan they filter if there are at most BROADCAST_IDS of them; else they meet it in a shuffle."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


#: Members of a group that make it a hot key.
HOT = 4096


def meet(rows: DataFrame, groups: DataFrame, key: str, at: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with their ``groups`` (unique ``key``; ``m``, the rows of the group).

    Groups of more than ``at`` rows (HOT by default) are sent to the rows if they are at most BROADCAST_IDS, so no group gathers in a task.
    """
    at = HOT if at is None else at
    hot = groups.where(F.col("m") > at).drop("m")
    if not (count := hot.count()):
        return rows.join(groups.drop("m"), key)
    hot = F.broadcast(hot) if count <= BROADCAST_IDS else hot
    cold = rows.join(hot.select(key), key, "left_anti").join(groups.where(F.col("m") <= at).drop("m"), key)
    return cold.unionByName(rows.join(hot, key))


def own_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{table}.parquet"))


def open_shared(uri: str, mode: str):
    """A file of the shared folder: local and mounted paths directly, other stores through Arrow's file systems."""
    scheme, _, rest = uri.partition("://")
    if not rest or scheme == "file":
        path = rest or uri.removeprefix("file:")
        if "w" in mode:
            os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, mode)
    import io

    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if "w" in mode:
        store.create_dir(os.path.dirname(path), recursive=True)
        return store.open_output_stream(path)
    return io.BufferedReader(store.open_input_file(path), 1 << 16)


class StoreArray:
    """An array in a file that can't be memory-mapped: blocks are read as they are needed, and the last few of all such arrays kept in memory.

    Takes sorted keys in ``searchsorted``, and indices, slices and field names like a NumPy array.
    """

    BLOCK, KEPT = 1 << 20, 64
    _blocks: dict[tuple[int, int], np.ndarray] = {}  # of all arrays of the process
    _numbers = itertools.count()

    def __init__(self, source, dtype, field: str | None = None):
        self._source, self.dtype, self._field = source, np.dtype(dtype), field
        self._n = source.seek(0, 2) // self.dtype.itemsize
        self._step = max(1, self.BLOCK // self.dtype.itemsize)
        self._number = next(self._numbers)

    def __len__(self) -> int:
        return self._n

    def _block(self, i: int) -> np.ndarray:
        block = self._blocks.pop((self._number, i), None)
        if block is None:
            self._source.seek(i * self._step * self.dtype.itemsize)
            block = np.frombuffer(self._source.read(min(self._step, self._n - i * self._step) * self.dtype.itemsize), self.dtype)
            while len(self._blocks) >= self.KEPT:
                del self._blocks[next(iter(self._blocks))]
        self._blocks[self._number, i] = block
        return block if self._field is None else block[self._field]

    def __getitem__(self, index):
        if isinstance(index, str):
            other = StoreArray(self._source, self.dtype, index)
            other._number = self._number
            return other
        if isinstance(index, slice):
            index = np.arange(*index.indices(self._n))
        index = np.asarray(index)
        out = np.zeros(index.shape, self.dtype if self._field is None else self.dtype[self._field])
        of = index // self._step
        for i in np.unique(of).tolist():
            own = of == i
            out[own] = self._block(i)[index[own] - i * self._step]
        return out

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        whole = self[:]
        return whole if dtype is None else whole.astype(dtype)

    def searchsorted(self, keys, side: str = "left", sorter=None) -> np.ndarray:
        keys = np.asarray(keys)
        out = np.zeros(len(keys), np.int64)
        todo = [(0, len(keys), 0, -(-self._n // self._step))] if self._n else []
        while todo:
            i, j, lo, hi = todo.pop()
            if i == j:
                continue
            if hi - lo == 1:
                out[i:j] = np.searchsorted(self._block(lo), keys[i:j], side) + lo * self._step
                continue
            middle = (lo + hi) // 2
            # keys up to the block's first element may end before it
            cut = i + int(np.searchsorted(keys[i:j], self._block(middle)[0], "right" if side == "left" else "left"))
            todo += [(i, cut, lo, middle), (cut, j, middle, hi)]
        return out


class Lazily(dict):
    """``make(names[key])``, made on first use."""

    def __init__(self, make, names: dict):
        super().__init__()
        self._make, self._names = make, names

    def __contains__(self, key) -> bool:
        return key in self._names

    def __missing__(self, key):
        value = self[key] = self._make(self._names[key])
        return value


def map_shared(uri: str, dtype):
    """A memory-mapped array of a shared file; of stores that can't be mapped, a ``StoreArray``."""
    scheme, _, rest = uri.partition("://")
    if not rest or scheme == "file":
        path = rest or uri.removeprefix("file:")
        if not os.path.getsize(path):
            return np.zeros(0, dtype)
        with open(path, "rb") as f:  # a map holds no file open where that can be avoided: a model has thousands
            return np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {})), dtype)
    return StoreArray(open_shared(uri, "rb"), dtype)


def remove_shared(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 1000, mb: int = 16) -> None:
    """Bound what one Arrow batch holds in a Python worker, for very long texts; stricter bounds of the session stay."""
    for key, value, name in (("maxRecordsPerBatch", rows, str(rows)), ("maxBytesPerBatch", mb << 20, f"{mb << 20}")):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if not (now and now.isdigit() and 0 < int(now) <= value):
            spark.conf.set(key, name)
