"""Derived input views over the driver tables: detections, track clock, identity probes, motion, audio ranges.

Each view is a DataFrame here and, for the comparison queries, the same rows as DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_W, FRAME_H = 640, 480


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 16 boxes per frame of 640 x 480, with class and score; boxes may leave the frame."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "(l_orderkey div 4) % 4 AS video_id", "l_orderkey div 4 AS frame_index",
        "cast((l_partkey*37) % 560 AS int) AS x", "cast((l_suppkey*53 + l_partkey*11) % 400 AS int) AS y",
        "cast(l_quantity AS int)*2+20 AS w", "cast((cast(l_quantity AS int)*2+20)*(l_linenumber+3) div 4 AS int) AS h",
        "CASE l_linenumber % 7 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 7 WHEN 5 THEN 62 WHEN 6 THEN 63 ELSE 16 END AS class_id",
        "cast(cast(round(l_extendedprice*100) AS bigint) % 10000 AS double)/10000 AS score",
    )


DETECTIONS_SQL = """det AS (
  SELECT (l_orderkey // 4) % 4 AS video_id, l_orderkey // 4 AS frame_index,
         cast((l_partkey*37) % 560 AS int) AS x, cast((l_suppkey*53 + l_partkey*11) % 400 AS int) AS y,
         cast(l_quantity AS int)*2+20 AS w, cast((cast(l_quantity AS int)*2+20)*(l_linenumber+3) // 4 AS int) AS h,
         CASE l_linenumber % 7 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 2 WHEN 4 THEN 7 WHEN 5 THEN 62 WHEN 6 THEN 63 ELSE 16 END AS class_id,
         cast(cast(round(l_extendedprice*100) AS bigint) % 10000 AS double)/10000 AS score
  FROM lineitem)"""


def track_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track per user on a clock of 5-minute frames, with gaps on both sides of 90 frames."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS track_id", "event_id", "timestampdiff(MINUTE, timestamp_ntz'2024-01-01 00:00:00', ts) div 5 AS frame_index")


TRACK_CLOCK_SQL = "clock AS (SELECT user_id AS track_id, event_id, date_diff('minute', timestamp '2024-01-01 00:00:00', ts) // 5 AS frame_index FROM events)"


def gallery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An identity per label: the vector with the smallest id, in double."""
    first = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return first.select(F.col("label").alias("identity_id"), F.col("e").cast("array<double>").alias("embedding"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors blended with their label's identity, so that all three tiers occur; not normalised."""
    e = table(spark, sf_dir, "embeddings")
    a = (F.col("vec_id") % 11) / 10.0
    blend = F.zip_with("g", F.col("embedding").cast("array<double>"), lambda g, x: a * g + (1 - a) * x)
    return e.join(F.broadcast(gallery(spark, sf_dir).select(F.col("identity_id").alias("label"), F.col("embedding").alias("g"))), "label").select("vec_id", "label", blend.alias("embedding"))


GALLERY_SQL = "gallery AS (SELECT label AS identity_id, list_transform(arg_min(embedding, vec_id), lambda v: v::DOUBLE) AS g FROM embeddings GROUP BY label)"
PROBES_SQL = f"""{GALLERY_SQL},
raw_probe AS (SELECT vec_id, label, list_transform(list_zip(g, embedding), lambda p: (vec_id % 11)/10.0::DOUBLE * p[1] + (1 - (vec_id % 11)/10.0::DOUBLE) * p[2]::DOUBLE) AS e
              FROM embeddings JOIN gallery ON label = identity_id),
probe AS (SELECT vec_id, label, list_transform(e, lambda v: v / sqrt(greatest(list_sum(list_transform(e, lambda u: u*u)), 1e-12))) AS e FROM raw_probe)"""


def motion(spark: SparkSession) -> DataFrame:
    """Five moving objects over 300 frames, with short drop-outs, low scores and one long absence. ``obj`` is the truth, never an input."""
    return spark.sql("""
        SELECT k.id AS obj, f.id AS frame_index, cast(20+k.id*120+((f.id*(k.id+1)) div 3)%60 AS int) AS x, cast(40+k.id*30+(f.id div 4)%50 AS int) AS y,
               cast(40+k.id*4 AS int) AS w, cast(48+k.id*4 AS int) AS h, CASE WHEN (f.id*7+k.id*13)%5=0 THEN 0.18D ELSE 0.5D+k.id*0.05D END AS score
        FROM range(5) k CROSS JOIN range(300) f
        WHERE NOT ((f.id+k.id*11)%40 IN (20,21,22)) AND NOT (k.id=4 AND f.id BETWEEN 100 AND 195)""")


def audio_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").selectExpr("user_id % 50 AS video_id", "event_id AS range_id", "cast(event_id % 600 AS double) AS start_sec", "cast(event_id % 600 + 1 + cast(floor(value/50) AS bigint) AS double) AS end_sec", "cast(event_id % 2 AS int) AS effect")


def audio_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'view'").selectExpr("user_id % 50 AS video_id", "event_id AS sample_id", "cast(event_id % 600 AS double) AS t")


AUDIO_SQL = """ranges AS (SELECT user_id % 50 AS video_id, event_id AS range_id, (event_id % 600)::DOUBLE AS start_sec, (event_id % 600 + 1 + floor(value/50)::BIGINT)::DOUBLE AS end_sec, (event_id % 2)::INT AS effect FROM events WHERE event_type = 'purchase'),
samples AS (SELECT user_id % 50 AS video_id, event_id AS sample_id, (event_id % 600)::DOUBLE AS t FROM events WHERE event_type = 'view')"""
