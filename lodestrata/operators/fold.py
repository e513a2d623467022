"""Folds of an event log in offset order, as map-side combined aggregates instead of ordered lists."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.settle import settle


def latest_wins(events: DataFrame, keys: list[str], order: str = "offset") -> DataFrame:
    """The last row of each key, whole; one aggregate, no sort."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, *[F.col("_last")[c].alias(c) for c in rest])


def last_where(value: Column, condition: Column, order: str = "offset") -> Column:
    """The value of the last row that meets the condition."""
    return F.max_by(F.when(condition, F.struct(value.alias("v"))), F.when(condition, F.col(order)))["v"]


def since_create(events: DataFrame, key: str, create: Column) -> DataFrame:
    """Events from the last create of their key on (``created``: its offset); a create resets, what has none is dropped."""
    created = F.max(F.when(create, F.col("offset"))).over(Window.partitionBy(key))
    return events.withColumn("created", created).where(F.col("offset") >= F.col("created"))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, when: str, values: list[str]) -> DataFrame:
    """Left rows with the right values in force at their time: the last with ``when`` <= ``at``.

    Both sides meet in one sort by key and time, so no pairs are made.
    """
    l = left.select("*", F.col(at).alias("_t"), F.lit(1).alias("_side"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    blank = [F.lit(None).cast(left.schema[c].dataType).alias(c) if c != by else F.col(by) for c in left.columns]
    r = right.select(*blank, F.col(when).alias("_t"), F.lit(0).alias("_side"), *[F.col(v).alias(f"_{v}") for v in values])
    w = Window.partitionBy(by).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(w)
    both = l.unionByName(r).withColumn("_hit", hit).where("_side = 1")
    return both.select(*left.columns, *[F.col("_hit")[f"_{v}"].alias(v) for v in values])


def fold_events(events: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable, schema: str, finish: Callable | None = None, most: int = 1000) -> DataFrame:
    """Streams each key's events, in order, through a state: ``step(state, rows) -> (state, rows out or None)``.

    A task goes through sorted partitions batch by batch and calls ``step`` with at most ``most`` events, so it holds a
    state and a chunk, never a key's history; chunks do not depend on batches.  ``finish(key, state)`` gives a last row.
    """
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, held = None, None, []

        def flush(last: bool) -> Iterator[pd.DataFrame]:
            nonlocal state, held
            rows = pd.concat(held) if held else None
            at, total = 0, 0 if rows is None else len(rows)
            while total - at >= most or (last and at < total):
                state, out = step(state, rows.iloc[at : at + most])
                at += most
                if out is not None and len(out):
                    yield out[names]
            held = [rows.iloc[at:]] if at < total else []

        def end() -> Iterator[pd.DataFrame]:
            if now is not None:
                yield from flush(True)
                if finish and (row := finish(now, state)) is not None:
                    yield pd.DataFrame([row], columns=names)

        for batch in batches:
            if not len(batch):
                continue
            values = list(zip(*(batch[k] for k in keys)))
            cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
            for i, j in zip(cuts[:-1], cuts[1:]):
                if values[i] != now:
                    yield from end()
                    now, state, held = values[i], start(), []
                held.append(batch.iloc[i:j])
                yield from flush(False)
        yield from end()

    return events.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def blocks_of(rows: DataFrame, most: int = 10_000) -> list[DataFrame]:
    """A stated query set as blocks of about ``most`` rows (counted), each of which may be broadcast."""
    blocks = max(1, -(-rows.count() // most))
    return [rows] if blocks == 1 else [rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)) == b) for b in range(blocks)]


def with_blocks(rows: DataFrame, queries: DataFrame, join: Callable[[DataFrame, DataFrame], DataFrame], most: int = 10_000) -> DataFrame:
    """``join(rows, block)`` over all blocks of the query set, each broadcast by itself."""
    out = None
    for block in blocks_of(queries, most):
        part = join(rows, F.broadcast(block))
        out = part if out is None else out.unionByName(part)
    return out


def keep_top(df: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= n)


def dense_numbers(df: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """Rows numbered from 1 in a global order, without gathering them in one task.

    Rows are range-partitioned and sorted; a row's number is its place in its partition after the sizes of the partitions before.
    """
    placed = settle(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    sizes = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_before")
