"""How the tables of a data folder are seen as packets, flows, feature matrices and predictions.

The folder has no captures, so each user's events serve as one flow: five captures, one hour of
event time as one second, sizes from values. Every definition has a twin in ANSI SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds of idle time that end a session; other thresholds in the same model seconds.
GAP, IDLE, BURST = 24, 10, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        (F.col("user_id") % 5).alias("capture_id"),
        F.col("user_id").alias("flow"),
        F.col("event_id").alias("pkt_idx"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 3600).alias("ts"),
        F.when(F.col("event_type").isin("click", "purchase", "signup"), 1).otherwise(-1).alias("direction"),
        (40 + F.floor(F.col("value") * 4)).alias("length"),
        F.floor(F.col("value") * 4).alias("payload_length"),
        F.expr("CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'view' THEN 24 WHEN 'error' THEN 4 ELSE 17 END").alias("flags"),
        (F.col("event_id") * 37 % 65536).alias("window"),
    )


PKT = """pkt AS (SELECT user_id % 5 AS capture_id, user_id AS flow, event_id AS pkt_idx, epoch_us(ts) / 1e6 / 3600 AS ts,
    CASE WHEN event_type IN ('click', 'purchase', 'signup') THEN 1 ELSE -1 END AS direction,
    40 + CAST(floor(value * 4) AS BIGINT) AS length, CAST(floor(value * 4) AS BIGINT) AS payload_length,
    CASE event_type WHEN 'signup' THEN 2 WHEN 'click' THEN 16 WHEN 'view' THEN 24 WHEN 'error' THEN 4 ELSE 17 END AS flags,
    event_id * 37 % 65536 AS window_size FROM events)"""

SES = f"""{PKT}, cut AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY capture_id, flow ORDER BY pkt_idx) > {GAP} THEN 1 ELSE 0 END AS fresh FROM pkt),
ses AS (SELECT * EXCLUDE (fresh), CAST(sum(fresh) OVER (PARTITION BY capture_id, flow ORDER BY pkt_idx) AS BIGINT) AS sid FROM cut)"""

CTX = f"""{SES}, adm AS (SELECT * FROM ses QUALIFY count(*) OVER (PARTITION BY capture_id, flow, sid) >= 3 AND sum(length) OVER (PARTITION BY capture_id, flow, sid) >= 100),
ctx AS (SELECT *, row_number() OVER w AS pos, first_value(ts) OVER w AS t0, ts - lag(ts) OVER w AS iat, lag(direction) OVER w AS prev_dir,
    lead(direction) OVER w AS next_dir, ts - lag(ts) OVER (PARTITION BY capture_id, flow, sid, direction ORDER BY pkt_idx) AS diat, greatest(length - payload_length, 0) AS header
    FROM adm WINDOW w AS (PARTITION BY capture_id, flow, sid ORDER BY pkt_idx))"""


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators.sessions import sessionize

    return sessionize(packets(spark, sf_dir), GAP)


def ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    from netloom.operators.sessions import admitted, context

    return context(admitted(sessions(spark, sf_dir)))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix in long form: id, label, feature (0..63), x."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", F.posexplode("embedding").alias("feature", "x")).withColumn("x", F.col("x").cast("double"))


MAT = """mat AS (SELECT vec_id AS id, label, CAST(unnest(range(64)) AS INTEGER) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"""


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature matrix in wide form: id, label, f0..f63."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)])


WIDE = "wide AS (SELECT vec_id AS id, label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings)"
