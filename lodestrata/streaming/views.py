"""Structured Streaming forms of the log views.

Each function turns a streaming log into a streaming DataFrame; ``drain`` runs one to the end of its input and
gives the table that its sink holds in the shared folder.  A stream and the batch fold over the same log give the same rows (see the tests).
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.fold import latest_wins
from ..plans.settle import settle, shared_folder  # noqa: F401  (settle: re-exported for sinks that settle their batches)


def read_events(spark: SparkSession, sf_dir: str, per_trigger: int | None = 1) -> DataFrame:
    """The event table as a stream of files; with None, all that are there in one trigger.

    A table's files are in no order of time: taken one by one, rows of a later file can be behind the watermark of an
    earlier one.  Streams that drop late rows, or decide in order, read a finished table in one trigger.
    """
    schema = spark.read.parquet(os.path.join(sf_dir, "events.parquet")).schema
    stream = spark.readStream.schema(schema)
    stream = stream if per_trigger is None else stream.option("maxFilesPerTrigger", per_trigger)
    # a pattern, so that the table may be one file or a folder of files
    return stream.parquet(os.path.join(sf_dir, "events.parque[t]"))


def as_log(events: DataFrame) -> DataFrame:
    """offset, ts, event_type, node_id, k, value with an event-time column."""
    k = F.get_json_object("props", "$.k").cast("long")
    return events.select(F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("user_id").alias("node_id"), k.alias("k"), "value")


def access_counts(log: DataFrame, window: str = "7 days", slide: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sliding-window access counts per node."""
    accesses = log.where(F.col("event_type").isin("view", "click")).withWatermark("ts", late)
    w = accesses.groupBy(F.window("ts", window, slide), "node_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").alias("begun"), "node_id", "n")


def sessions(log: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    s = log.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "node_id").agg(F.count(F.lit(1)).alias("events"))
    return s.select(F.col("session_window.start").alias("begun"), "node_id", "events")


def matches(log: DataFrame, within: str = "30 days") -> DataFrame:
    """Requests joined to their findings, both as streams with a bounded wait."""
    key = F.concat_ws("-", "node_id", "k")
    r = log.where("event_type = 'view'").select(key.alias("match_id"), F.col("ts").alias("asked"), F.col("offset").alias("request")).withWatermark("asked", "1 day")
    f = log.where("event_type = 'click'").select(key.alias("found_id"), F.col("ts").alias("found"), F.col("offset").alias("finding")).withWatermark("found", "1 day")
    near = (F.col("match_id") == F.col("found_id")) & (F.col("found") >= F.col("asked") - F.expr(f"interval {within}")) & (F.col("found") <= F.col("asked") + F.expr(f"interval {within}"))
    return r.join(f, near).select("match_id", "request", "finding")


def unseen(messages: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """Each message once: repeats within the watermark are dropped, so a rerun of a source adds nothing."""
    return messages.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


HEAT_STATE = "accesses long, anchor long, heat double"
HEAT_OUT = "node_id long, accesses long, anchor_ms long, heat_at_anchor double"


def heat(log: DataFrame) -> DataFrame:
    """The heat fold as per-key state: a creation resets, an access adds 0.05 up to 1."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        accesses, anchor, value = state.get if state.exists else (0, 0, 0.5)
        for row in pd.concat(batches).sort_values("offset").itertuples():
            if row.event_type == "signup":
                accesses, value = 0, 0.5
            else:
                accesses, value = accesses + 1, min(1.0, value + 0.05)
            anchor = int(row.ms)
        state.update((accesses, anchor, value))
        yield pd.DataFrame({"node_id": [key[0]], "accesses": [accesses], "anchor_ms": [anchor], "heat_at_anchor": [round(value, 6)]})

    touched = log.where(F.col("event_type").isin("signup", "view", "click")).select("node_id", "offset", "event_type", F.unix_millis("ts").alias("ms"))
    return touched.groupBy("node_id").applyInPandasWithState(fold, HEAT_OUT, HEAT_STATE, "update", GroupStateTimeout.NoTimeout)


LIMIT_OUT = "peer long, offset long, allowed boolean"
#: Rows that a fold gives at once.
CHUNK = 100_000


def rate_limit(log: DataFrame, per_hour: float) -> DataFrame:
    """Token bucket per peer as keyed state."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        level, last = state.get if state.exists else (per_hour, -1)
        held = [b[["ms", "offset"]].to_numpy(np.int64) for b in batches]  # of one trigger; 16 bytes a request
        rows = np.concatenate(held)
        held.clear()
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        for i in range(0, len(rows), CHUNK):
            part, allowed = rows[i : i + CHUNK], []
            for ms in part[:, 0].tolist():
                level = per_hour if last < 0 else min(per_hour, level + (ms - last) * per_hour / 3_600_000)
                last, ok = ms, level >= 1
                level -= ok
                allowed.append(ok)
            yield pd.DataFrame({"peer": key[0], "offset": part[:, 1], "allowed": allowed})
        state.update((float(level), last))

    keyed = log.select((F.col("node_id") % 5).alias("peer"), "offset", F.unix_millis("ts").alias("ms"))
    return keyed.groupBy("peer").applyInPandasWithState(fold, LIMIT_OUT, "level double, last long", "append", GroupStateTimeout.NoTimeout)


def drain(df: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream over all that its source holds and gives the sink's table; with keys, the last row of each.

    Every micro-batch goes to files of the shared folder, none to the driver: in append and update mode all batches stay,
    in complete mode the last replaces the one before.
    """
    spark = df.sparkSession
    at = shared_folder(spark, "drained")
    written: list[int] = []

    def remove(folder: str) -> None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/{number}")
        if mode == "complete":
            while written:
                remove(f"{at}/{written.pop()}")
        written.append(number)

    query = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    remove(f"{at}/state")
    if not written:
        return spark.createDataFrame([], df.schema)
    if not keys:
        return spark.read.schema(df.schema).parquet(*(f"{at}/{n}" for n in written))
    parts = [spark.read.schema(df.schema).parquet(f"{at}/{n}").withColumn("_batch", F.lit(n)) for n in written]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return latest_wins(out, keys, "_batch").drop("_batch")


def append_log(events: DataFrame, path: str, checkpoint: str):
    """An append-only log on files, exactly once per input through the checkpoint; partitioned by day."""
    dated = events.withColumn("day", F.to_date("ts"))
    return dated.writeStream.partitionBy("day").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet", outputMode="append")


def upsert_sink(df: DataFrame, path: str, key: str, checkpoint: str):
    """Keeps the latest row per key in a parquet table: each micro-batch writes a new version and then points to it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        versions = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = versions.getFileSystem(spark._jsc.hadoopConfiguration())
        old = f"{path}/v{number - 1}"
        base = spark.read.parquet(old) if number and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(old)) else None
        new = batch if base is None else base.join(batch.select(key), key, "left_anti").unionByName(batch)
        new.write.mode("overwrite").parquet(f"{path}/v{number}")

    return df.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
