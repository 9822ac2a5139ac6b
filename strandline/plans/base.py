"""Registration of queries with their oracle SQL, and the domain views over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- Domain views: the ledger's tables and the score tables, laid over the test tables -------------------------------

VIDEOS_SQL = """
videos AS (SELECT o_orderkey AS video_id, o_custkey AS input_id, o_orderstatus AS status, o_orderpriority AS reason,
  o_totalprice / 100 AS duration_s, o_totalprice / 1000 AS size_mb, strftime(o_orderdate, '%Y%m%d') AS upload_date,
  o_custkey % 23 AS batch FROM orders)"""

CLIPS_SQL = """
clips AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS clip_id, l_orderkey AS video_id, l_suppkey AS speaker_id,
  l_quantity AS start_s, l_quantity + 4 + l_discount * 30 AS end_s, 4 + l_discount * 30 AS duration_s,
  CASE WHEN l_returnflag = 'R' THEN 'reject' WHEN l_returnflag = 'A' THEN 'pending' ELSE 'keep' END AS decision,
  l_partkey AS source_id, l_extendedprice / 1e5 AS consistency FROM lineitem)"""

SCORES_SQL = """
scores AS (SELECT ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS sample_id,
  CASE WHEN l_orderkey % 10 < 5 THEN 'train' WHEN l_orderkey % 10 < 7 THEN 'validation' ELSE 'test' END AS split,
  l_suppkey AS speaker_id, l_partkey AS source_clip_id, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS label,
  CASE WHEN l_returnflag = 'N' AND l_linenumber <= 5 THEN 'real' WHEN l_returnflag = 'N' THEN 'sham'
       WHEN l_returnflag = 'R' THEN 'audio' ELSE 'video' END AS cell,
  l_linestatus AS kind, 'g' || CAST(l_partkey % 7 AS VARCHAR) AS generator,
  CASE WHEN l_suppkey % 2 = 0 THEN 'f' ELSE 'm' END AS gender,
  l_discount * 5 + l_tax AS score, l_quantity / 50 AS score2, l_extendedprice / 1e5 AS score3 FROM lineitem)"""

FRAMES_SQL = """
frames AS (SELECT user_id AS sample_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  value, value / 100 AS score, event_type <> 'error' AND event_id % 11 <> 0 AS valid, event_type, event_id FROM events)"""


def videos(spark, d) -> DataFrame:
    return t(spark, d, "orders").select(
        F.col("o_orderkey").alias("video_id"), F.col("o_custkey").alias("input_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("reason"),
        (F.col("o_totalprice") / 100).alias("duration_s"), (F.col("o_totalprice") / 1000).alias("size_mb"), F.date_format("o_orderdate", "yyyyMMdd").alias("upload_date"), (F.col("o_custkey") % 23).alias("batch"),
    )


def clips(spark, d) -> DataFrame:
    decision = F.when(F.col("l_returnflag") == "R", "reject").when(F.col("l_returnflag") == "A", "pending").otherwise("keep")
    return t(spark, d, "lineitem").select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("clip_id"), F.col("l_orderkey").alias("video_id"), F.col("l_suppkey").alias("speaker_id"),
        F.col("l_quantity").alias("start_s"), (F.col("l_quantity") + 4 + F.col("l_discount") * 30).alias("end_s"), (F.lit(4) + F.col("l_discount") * 30).alias("duration_s"),
        decision.alias("decision"), F.col("l_partkey").alias("source_id"), (F.col("l_extendedprice") / 1e5).alias("consistency"),
    )


def scores(spark, d) -> DataFrame:
    real = F.col("l_returnflag") == "N"
    part = F.col("l_orderkey") % 10
    return t(spark, d, "lineitem").select(
        (((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")).alias("sample_id"), F.when(part < 5, "train").when(part < 7, "validation").otherwise("test").alias("split"),
        F.col("l_suppkey").alias("speaker_id"), F.col("l_partkey").alias("source_clip_id"), F.when(real, 0).otherwise(1).alias("label"),
        F.when(real & (F.col("l_linenumber") <= 5), "real").when(real, "sham").when(F.col("l_returnflag") == "R", "audio").otherwise("video").alias("cell"),
        F.col("l_linestatus").alias("kind"), F.concat(F.lit("g"), (F.col("l_partkey") % 7).cast("string")).alias("generator"),
        F.when(F.col("l_suppkey") % 2 == 0, "f").otherwise("m").alias("gender"),
        (F.col("l_discount") * 5 + F.col("l_tax")).alias("score"), (F.col("l_quantity") / 50).alias("score2"), (F.col("l_extendedprice") / 1e5).alias("score3"),
    )


def frames(spark, d) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t(spark, d, "events").select(
        F.col("user_id").alias("sample_id"), (F.row_number().over(order) - 1).cast("long").alias("frame"), "value", (F.col("value") / 100).alias("score"),
        ((F.col("event_type") != "error") & (F.col("event_id") % 11 != 0)).alias("valid"), "event_type", "event_id",
    )
