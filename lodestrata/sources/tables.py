"""The driver's tables in the shapes the operators read: event log, graph edges, triples, drawers, transcripts.

Every table is a lazy projection of a parquet scan; nothing is cached or collected.
``ORACLE`` has the same shapes as DuckDB common table expressions.
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms

#: The fixed "now" of all queries: 2024-01-31T00:00Z.
NOW_MS = 1_706_659_200_000
KINDS = {"signup": "node_created", "view": "node_accessed", "click": "node_accessed", "purchase": "node_property_set", "error": "node_invalidated"}
FIELDS = ("canonical", "importance", "canon_path")


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet"))

    @cached_property
    def log(self) -> DataFrame:
        """offset, ts_ms, event_type, kind, node_id, k, value, field: the append-only event log."""
        kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("event_type")]
        k = F.get_json_object("props", "$.k").cast("long")
        log = self.raw("events").select(F.col("event_id").alias("offset"), epoch_ms("ts").alias("ts_ms"), "event_type", kind.alias("kind"), F.col("user_id").alias("node_id"), k.alias("k"), "value")
        field = F.get(F.array(*[F.lit(f) for f in FIELDS]), (F.col("k") % 3).cast("int"))
        return log.withColumn("field", F.when(F.col("kind") == "node_property_set", field))

    @cached_property
    def edges(self) -> DataFrame:
        """Bitemporal edges order -contains-> part, one for each order line."""
        lines, orders = self.raw("lineitem"), self.raw("orders")
        joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
        return joined.select(
            F.concat_ws("-", F.lit("e"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")).alias("edge_id"),
            F.lit("contains").alias("kind"), F.concat(F.lit("o"), F.col("l_orderkey")).alias("source"), F.concat(F.lit("p"), F.col("l_partkey")).alias("target"),
            epoch_ms("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", epoch_ms("l_shipdate")).alias("valid_to"),
            epoch_ms("o_orderdate").alias("recorded_at"), F.when(F.col("l_returnflag") == "R", epoch_ms("l_shipdate")).alias("invalidated_at"),
            F.round(1 - F.col("l_discount"), 4).alias("weight"),
        )

    @cached_property
    def triples(self) -> DataFrame:
        """customer -placed-> order with a validity interval."""
        last = self.raw("lineitem").groupBy("l_orderkey").agg(F.max(epoch_ms("l_shipdate")).alias("shipped"))
        orders = self.raw("orders")
        joined = orders.join(last, orders["o_orderkey"] == last["l_orderkey"], "left")
        return joined.select(
            F.concat(F.lit("c"), F.col("o_custkey")).alias("subject"), F.lit("placed").alias("predicate"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("object"),
            epoch_ms("o_orderdate").alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.col("shipped")).alias("valid_to"),
            "o_orderstatus", "o_orderpriority", "o_totalprice",
        )

    @cached_property
    def hierarchy(self) -> DataFrame:
        """region -contains-> nation -contains-> customer and supplier."""
        nation, customer, supplier = self.raw("nation"), self.raw("customer"), self.raw("supplier")

        def edge(df, a, x, b, y):
            return df.select(F.concat(F.lit(a), F.col(x)).alias("source"), F.concat(F.lit(b), F.col(y)).alias("target"), F.lit(1.0).alias("weight"))

        return edge(nation, "r", "n_regionkey", "n", "n_nationkey").unionAll(edge(customer, "n", "c_nationkey", "c", "c_custkey")).unionAll(edge(supplier, "n", "s_nationkey", "s", "s_suppkey"))

    @cached_property
    def drawers(self) -> DataFrame:
        """Verbatim documents filed by wing and room."""
        return self.raw("documents").select("doc_id", "text", F.col("source").alias("wing"), F.col("lang").alias("room"), "n_chars")

    @cached_property
    def turns(self) -> DataFrame:
        return self.raw("conversations")

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")

    @cached_property
    def queries(self) -> DataFrame:
        return self.raw("benchmark")


ORACLE = {
    "log": """SELECT event_id AS "offset", epoch_us(ts) // 1000 AS ts_ms, event_type,
      CASE event_type WHEN 'signup' THEN 'node_created' WHEN 'view' THEN 'node_accessed' WHEN 'click' THEN 'node_accessed'
        WHEN 'purchase' THEN 'node_property_set' WHEN 'error' THEN 'node_invalidated' END AS kind,
      user_id AS node_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
      CASE WHEN event_type = 'purchase' THEN CASE CAST(json_extract(props, '$.k') AS BIGINT) % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'importance' ELSE 'canon_path' END END AS field
    FROM events""",
    "edges": """SELECT concat('e-', l_orderkey, '-', l_linenumber, '-', l_partkey) AS edge_id, 'contains' AS kind, concat('o', l_orderkey) AS source,
      concat('p', l_partkey) AS target, epoch_ms(o_orderdate) AS valid_from, CASE WHEN o_orderstatus <> 'O' THEN epoch_ms(l_shipdate) END AS valid_to,
      epoch_ms(o_orderdate) AS recorded_at, CASE WHEN l_returnflag = 'R' THEN epoch_ms(l_shipdate) END AS invalidated_at, round(1 - l_discount, 4) AS weight
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "triples": """SELECT concat('c', o_custkey) AS subject, 'placed' AS predicate, concat('o', o_orderkey) AS object, epoch_ms(o_orderdate) AS valid_from,
      CASE WHEN o_orderstatus <> 'O' THEN (SELECT max(epoch_ms(l_shipdate)) FROM lineitem WHERE l_orderkey = o_orderkey) END AS valid_to,
      o_orderstatus, o_orderpriority, o_totalprice
    FROM orders""",
    "hierarchy": """SELECT concat('r', n_regionkey) AS source, concat('n', n_nationkey) AS target, 1.0::DOUBLE AS weight FROM nation
      UNION ALL SELECT concat('n', c_nationkey), concat('c', c_custkey), 1.0 FROM customer
      UNION ALL SELECT concat('n', s_nationkey), concat('s', s_suppkey), 1.0 FROM supplier""",
    "drawers": "SELECT doc_id, text, source AS wing, lang AS room, n_chars FROM documents",
    "turns": "SELECT * FROM conversations",
    "vectors": "SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings",
}


def oracle(tables: str, body: str, *ctes: str, recursive: bool = False) -> str:
    """SQL over the named shapes (space-separated) and further expressions (``name AS (...)``)."""
    parts = [f"{name} AS ({ORACLE[name]})" for name in tables.split()] + list(ctes)
    return (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} " if parts else "") + body
