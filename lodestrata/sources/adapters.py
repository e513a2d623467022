"""Source adapters as Python data sources, a registry of them, and file sinks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

ADAPTERS: dict[str, type[DataSource]] = {}


def register(cls: type[DataSource]) -> type[DataSource]:
    """Makes a source readable by name on sessions that ``use`` it."""
    ADAPTERS[cls.name()] = cls
    return cls


def use(spark: SparkSession) -> list[str]:
    for cls in ADAPTERS.values():
        spark.dataSource.register(cls)
    return sorted(ADAPTERS)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict, suffixes: tuple[str, ...], rows):
        self.root, self.suffixes, self.rows = options["path"], suffixes, rows

    def partitions(self) -> list[InputPartition]:
        found = [os.path.join(d, f) for d, _, files in os.walk(self.root) for f in sorted(files) if f.endswith(self.suffixes)] if os.path.isdir(self.root) else [self.root]
        return [_File(p) for p in sorted(found)]

    def read(self, partition: _File) -> Iterator[tuple]:
        yield from self.rows(partition.path)


@register
class TranscriptSource(DataSource):
    """JSON-lines transcripts: one row a user or assistant message; broken lines are dropped."""

    @classmethod
    def name(cls) -> str:
        return "transcripts"

    def schema(self) -> str:
        return "source_file string, session_id string, uuid string, timestamp string, role string, content string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options, tuple(self.options.get("suffixes", ".jsonl").split(",")), _transcript_rows)


def _transcript_rows(path: str) -> Iterator[tuple]:
    with open(path, encoding="utf-8", errors="replace") as f:
        for line in f:
            try:
                row = json.loads(line)
            except ValueError:
                continue
            if not isinstance(row, dict) or row.get("type") not in ("user", "assistant"):
                continue
            message = row.get("message") or {}
            content = message.get("content", "")
            if isinstance(content, list):
                content = "\n".join(p.get("text") or json.dumps(p, sort_keys=True) for p in content if isinstance(p, dict))
            yield path, row.get("sessionId"), row.get("uuid"), row.get("timestamp"), message.get("role", row["type"]), content


@register
class NotesSource(DataSource):
    """Markdown and text files in pieces of about ``chunk_size`` characters, cut at paragraphs; rooms by folder."""

    @classmethod
    def name(cls) -> str:
        return "notes"

    def schema(self) -> str:
        return "source_file string, room string, chunk_index int, text string"

    def reader(self, schema) -> DataSourceReader:
        size, root = int(self.options.get("chunk_size", 800)), self.options["path"]

        def rows(path: str) -> Iterator[tuple]:
            with open(path, encoding="utf-8", errors="replace") as f:
                text = f.read()
            room = os.path.relpath(os.path.dirname(path), root).split(os.sep)[0]
            pieces, held = [], ""
            for paragraph in text.split("\n\n"):
                if held and len(held) + len(paragraph) > size:
                    pieces.append(held)
                    held = ""
                held = f"{held}\n\n{paragraph}" if held else paragraph
            for i, piece in enumerate([*pieces, held] if held.strip() or pieces else []):
                yield path, "general" if room == "." else room, i, piece

        return _Reader(self.options, (".md", ".txt"), rows)


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """An entity-attribute-value table (id, key, value) as one row an id, a column each key.

    More keys than ``spark.sql.pivotMaxValues`` are an error; ``read_key_maps`` has no such limit.
    """
    return spark.read.parquet(path).groupBy("id").pivot("key").agg(F.first("value"))


def read_key_maps(spark: SparkSession, path: str) -> DataFrame:
    """An entity-attribute-value table as (id, entries), a map of all its keys; of a repeated key the smallest value."""
    pairs = spark.read.parquet(path).where("key is not null").groupBy("id", "key").agg(F.min("value").alias("value"))
    return pairs.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("entries"))


def export_markdown(drawers: DataFrame, path: str) -> None:
    """A folder per wing and room with one entry a drawer."""
    entry = F.concat(F.lit("## "), F.col("doc_id").cast("string"), F.lit("\n\n"), F.col("text"), F.lit("\n"))
    drawers.select("wing", "room", entry.alias("value")).repartition("wing", "room").write.mode("overwrite").partitionBy("wing", "room").text(path)


def write_log(events: DataFrame, path: str) -> None:
    """Appends to a log on files, by day."""
    events.withColumn("day", F.to_date(F.timestamp_millis("ts_ms"))).write.mode("append").partitionBy("day").parquet(path)


def encrypt_log(events: DataFrame, column: str, secret: str) -> DataFrame:
    """Payloads wrapped by AES-GCM and marked; rows without a payload pass."""
    sealed = F.concat(F.lit("enc:"), F.base64(F.aes_encrypt(F.col(column).cast("string"), F.lit(secret), F.lit("GCM"))))
    return events.withColumn(column, F.when(F.col(column).isNotNull(), sealed))


def decrypt_log(events: DataFrame, column: str, secret: str) -> DataFrame:
    """Sealed payloads opened; plain ones pass."""
    opened = F.aes_decrypt(F.unbase64(F.substring(column, 5, F.length(column))), F.lit(secret), F.lit("GCM")).cast("string")
    return events.withColumn(column, F.when(F.col(column).startswith("enc:"), opened).otherwise(F.col(column)))
