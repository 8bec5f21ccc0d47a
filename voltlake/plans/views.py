"""The engine's views of the driver tables, as DataFrames and as the SQL that the checks use.

points: one measurement per user of ``events``; segments are runs of one event type; the current's sign follows the type.
blocks: the same points in segments of sixteen, long enough for fits.
spectra: one spectrum per row of ``embeddings``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltlake.operators import segments

BLOCK = 16
#: Charging states, by event type; the factor of the current.
SIGNS = {"purchase": 1, "signup": 1, "error": 0, "click": -1, "view": -1}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meas_id, pt, t (seconds since the first point), raw (unsigned), u, state."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type", "value")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        F.col("user_id").alias("meas_id"), (F.row_number().over(order) - 1).cast("long").alias("pt"),
        ((micros - F.min(micros).over(Window.partitionBy("user_id"))) / 1e6).alias("t"),
        F.col("value").alias("raw"), F.col("value").alias("u"), F.col("event_type").alias("state"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meas_id, seg_pos, seg_label, pt, t, i, u, state."""
    signed = segments.state_sign(raw_points(spark, sf_dir), SIGNS, "state", "raw").withColumnRenamed("raw", "i")
    return segments.segment_by_change(signed, "state").withColumn("seg_label", F.col("state"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points in segments of BLOCK points, with pt counted in the segment."""
    signed = segments.state_sign(raw_points(spark, sf_dir), SIGNS, "state", "raw").withColumnRenamed("raw", "i")
    return signed.withColumn("seg_pos", F.floor(F.col("pt") / BLOCK).cast("int")).withColumn("pt", F.col("pt") % BLOCK)


def spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """meas_id, pt, f, re, im."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("meas_id"), "embedding")
    value = lambda k: F.abs(F.element_at("embedding", (k % F.size("embedding") + 1).cast("int")).cast("double"))
    long = e.select("meas_id", "embedding", F.explode(F.sequence(F.lit(0), F.size("embedding") - 1)).alias("pt"))
    return long.select("meas_id", "pt", F.pow(F.lit(10.0), -3 + 5 * F.col("pt") / 63).alias("f"), (value(F.col("pt")) + 0.1).alias("re"), (-value(F.col("pt") + 1) - 0.01).alias("im"))


RAW_SQL = """raw AS (SELECT user_id AS meas_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pt,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, event_type AS state, value AS u,
  CASE WHEN event_type IN ('purchase', 'signup') THEN value WHEN event_type = 'error' THEN 0 * value ELSE -value END AS i FROM events)"""
POINTS_SQL = f"""{RAW_SQL}, chg AS (SELECT *, CASE WHEN lag(state) OVER (PARTITION BY meas_id ORDER BY pt) = state THEN 0 ELSE 1 END AS c FROM raw),
points AS (SELECT meas_id, CAST(sum(c) OVER (PARTITION BY meas_id ORDER BY pt ROWS UNBOUNDED PRECEDING) - 1 AS INTEGER) AS seg_pos, state AS seg_label, pt, t, i, u, state FROM chg)"""
BLOCKS_SQL = f"{RAW_SQL}, blocks AS (SELECT meas_id, CAST(pt // {BLOCK} AS INTEGER) AS seg_pos, pt % {BLOCK} AS pt, t, i, u, state FROM raw)"
SPECTRA_SQL = """spectra AS (SELECT vec_id AS meas_id, k AS pt, pow(10.0, -3 + 5 * k / 63) AS f,
  abs(CAST(embedding[k + 1] AS DOUBLE)) + 0.1 AS re, -abs(CAST(embedding[(k + 1) % len(embedding) + 1] AS DOUBLE)) - 0.01 AS im
  FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding))) AS k FROM embeddings))"""


def r(expression: str, digits: int = 6) -> str:
    """SQL for a rounded value without negative zero."""
    return f"(round({expression}, {digits}) + 0)"
