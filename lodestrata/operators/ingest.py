"""Sources and ingest: ids, cursors, transcripts, chunking, capture, encryption."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import SPACE
from .views import content_hash

HEADER = r"^(>{0,3} ?)?(Session|Conversation|# )"
RESTORE_MARKERS = ("Previous Conversation Compacted", "Ctrl+E to show")


def drawer_id(source_file: Column, chunk: Column) -> Column:
    return F.concat_ws("_", F.substring(F.sha2(source_file.cast("binary"), 256), 1, 24), chunk.cast("string"))


TURN_SCHEMA = "type string, sessionId string, uuid string, timestamp string, message struct<role:string,content:string>"


def parse_transcript(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON lines of a transcript as messages; other kinds and broken lines are dropped, list content is flattened to its texts."""
    v = F.from_json(column, TURN_SCHEMA)
    parts = F.from_json(F.col("m.message.content"), "array<struct<type:string,text:string>>")
    flat = F.array_join(F.transform(F.filter(parts, lambda p: p["type"] == "text"), lambda p: p["text"]), "\n")
    rows = lines.select(v.alias("m")).where(F.col("m.type").isin("user", "assistant"))
    content = F.when(F.col("m.message.content").startswith("["), flat).otherwise(F.col("m.message.content"))
    return rows.select(F.col("m.sessionId").alias("session_id"), F.col("m.uuid").alias("uuid"), F.col("m.timestamp").alias("timestamp"), F.col("m.message.role").alias("role"), content.alias("content"))


def message_id(session: Column, uuid: Column) -> Column:
    return F.concat(F.lit("sweep_"), F.substring(F.sha2(F.concat_ws(":", session, uuid).cast("binary"), 256), 1, 24))


def sweep(messages: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """messages and stored: session_id, uuid, ts.  What to add, and per session how many were added, present or skipped.

    A session's newest stored time is its cursor: strictly earlier messages are skipped, equal ones tried again.
    """
    cursor = stored.groupBy("session_id").agg(F.max("ts").alias("cursor"))
    m = messages.withColumn("id", message_id(F.col("session_id"), F.col("uuid"))).join(cursor, "session_id", "left")
    known = stored.select(message_id(F.col("session_id"), F.col("uuid")).alias("known")).distinct()
    j = m.join(known, F.col("id") == F.col("known"), "left")
    early = F.coalesce(F.col("ts") < F.col("cursor"), F.lit(False))
    state = F.when(early, "skipped").when(F.col("known").isNotNull(), "present").otherwise("added")
    j = j.withColumn("state", state)

    def n(which):
        return F.sum((F.col("state") == which).cast("long")).alias(which)

    return j.where("state = 'added'").select(*messages.columns, "id"), j.groupBy("session_id").agg(n("added"), n("present"), n("skipped"))


def split_sessions(lines: DataFrame, file: str, number: str, text: str, header: str = HEADER, context: int = 5) -> DataFrame:
    """Sessions of concatenated transcripts: a header line begins one unless it or the next lines restore an earlier context."""
    w = Window.partitionBy(file).orderBy(number)
    ahead = F.array_join(F.collect_list(text).over(w.rowsBetween(0, context)), "\n")
    restored = F.lit(False)
    for marker in RESTORE_MARKERS:
        restored = restored | F.contains(ahead, F.lit(marker))
    start = F.col(text).rlike(header) & ~restored
    return lines.withColumn("start", start).withColumn("session", F.sum(F.col("start").cast("long")).over(w))


def split_entries(text: Column) -> Column:
    """Entries of a diary: what follows each "## " header."""
    return F.filter(F.transform(F.split(F.concat(F.lit("\n"), text), "\n## "), lambda x: F.trim(x)), lambda x: x != "")


def exchanges(lines: DataFrame, by: str, number: str, text: str) -> DataFrame:
    """Lines grouped into exchanges, each begun by a line that starts with ">"."""
    w = Window.partitionBy(by).orderBy(number)
    g = lines.withColumn("exchange", F.sum(F.col(text).startswith(">").cast("long")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(number, text))), lambda x: x[text]), "\n")
    return g.groupBy(by, "exchange").agg(joined.alias("text"), F.count(F.lit(1)).alias("lines"))


def chunks(drawers: DataFrame, key: str, size: int = 800) -> DataFrame:
    """Every text in pieces of ``size`` characters; nothing is cut off."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    return drawers.select(key, "text", F.posexplode(starts).alias("chunk", "start")).select(key, "chunk", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def capture(drawers: DataFrame, key: str) -> DataFrame:
    """Captured drawers as rows of the log: content hash, whether it collides with an earlier one, word count."""
    h = drawers.withColumn("content_hash", content_hash(F.col("text")))
    first = h.groupBy("content_hash").agg(F.min(key).alias("first"))
    return h.join(first, "content_hash").select(key, "content_hash", (F.col(key) != F.col("first")).alias("collides"), F.size(F.array_remove(F.split("text", SPACE), "")).alias("words"))


def amend(versions: DataFrame, key: str, field: str) -> DataFrame:
    """The text in force of amended drawers: the last version by offset, and how many there are."""
    return versions.groupBy(key).agg(F.max_by(field, "offset").alias(field), F.count(F.lit(1)).alias("versions"))


def encrypt(payload: Column, secret: Column) -> Column:
    return F.base64(F.aes_encrypt(payload, secret, F.lit("GCM")))


def decrypt(payload: Column, secret: Column) -> Column:
    return F.aes_decrypt(F.unbase64(payload), secret, F.lit("GCM")).cast("string")


def normalize_chat(rows: DataFrame) -> DataFrame:
    """rows: file, kind, value (one JSON document).  Messages of the known export formats in one shape; an unknown kind is plain text."""
    mapping = F.from_json("value", "struct<mapping:map<string,struct<id:string,parent:string,message:struct<author:struct<role:string>,create_time:double,content:struct<parts:array<string>>>>>>")
    nodes = F.map_values(mapping["mapping"])
    tree = F.transform(F.filter(nodes, lambda n: n["message"].isNotNull()), lambda n: F.struct(n["message"]["create_time"].alias("at"), n["message"]["author"]["role"].alias("role"), F.array_join(n["message"]["content"]["parts"], "\n").alias("text")))
    slack = F.transform(F.from_json("value", "array<struct<ts:double,user:string,text:string>>"), lambda m: F.struct(m["ts"].alias("at"), m["user"].alias("role"), m["text"].alias("text")))
    flat = F.transform(F.from_json("value", "array<struct<role:string,content:string>>"), lambda m, i: F.struct(i.cast("double").alias("at"), m["role"].alias("role"), m["content"].alias("text")))
    plain = F.array(F.struct(F.lit(0.0).alias("at"), F.lit("user").alias("role"), F.col("value").alias("text")))
    found = F.when(F.col("kind") == "tree", F.array_sort(tree)).when(F.col("kind") == "channel", slack).when(F.col("kind") == "messages", flat).otherwise(plain)
    return rows.select("file", F.posexplode(found).alias("i", "m")).select("file", "i", "m.role", "m.text")


def closet_lines(drawers: DataFrame, by: str, key: str, top: int = 12) -> DataFrame:
    """One index line a group: its most frequent long words, and its first three drawers."""
    words = drawers.select(by, F.explode(F.split(F.lower("text"), SPACE)).alias("w")).where(F.length("w") >= 6).groupBy(by, "w").agg(F.count(F.lit(1)).alias("n"))
    best = words.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "w"))).where(F.col("r") <= top)
    topics = best.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "w"))), lambda x: x["w"]), ";").alias("topics"))
    first = drawers.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(key))).where("r <= 3").groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("ids"))
    return topics.join(first, by).select(by, F.concat(F.col("topics"), F.lit("||→"), F.col("ids")).alias("line"))
