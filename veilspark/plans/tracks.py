"""Queries over tracking: an ordered fold, so they have no SQL; tests hold them against scenarios and the streaming form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import tracking
from ..sources import views as v


def _detected(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Faces (with the moving objects), objects and heads of every video."""
    moving = v.motion(spark).selectExpr("'motion' AS video_id", "frame_index", "x", "y", "w", "h", "score")
    dets = v.detections(spark, sf).where("score >= 0.35")
    faces = dets.where("class_id = 16").selectExpr("cast(video_id AS string) AS video_id", "frame_index div 4 AS frame_index", "x", "y", "w", "h", "score")
    objects = dets.where("class_id IN (62, 63)").selectExpr("cast(video_id AS string) AS video_id", "frame_index div 4 AS frame_index", "x", "y", "w", "h", "score", "'screen' AS label")
    heads = dets.where("class_id = 0").selectExpr("cast(video_id AS string) AS video_id", "frame_index div 4 AS frame_index", "x", "y", "w", "h", "score")
    return faces.unionByName(moving), objects, heads


def track_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks of the moving objects, and of the detections of every video."""
    return tracking.track(tracking.frames(*_detected(spark, sf)))


def _faces_with_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The faces of every video, each with the vector of one identity of the whole gallery. One frame before its first, every identity shows its face once in each video."""
    e = v.gallery(spark, sf).select((F.row_number().over(Window.orderBy("identity_id")) - 1).alias("k"), F.col("embedding").alias("e"))
    faces = v.detections(spark, sf).where("class_id = 16 AND score >= 0.35").selectExpr("cast(video_id AS string) AS video_id", "frame_index div 4 AS frame_index", "x", "y", "w", "h", "score")
    size = e.agg(F.count("*").alias("size"))
    shown = faces.join(F.broadcast(size)).withColumn("k", F.pmod(F.xxhash64("video_id", "frame_index", "x", "y"), "size")).join(F.broadcast(e), "k")
    first = faces.groupBy("video_id").agg((F.min("frame_index") - 1).alias("frame_index"))
    introduced = first.join(F.broadcast(e)).selectExpr("video_id", "frame_index", "cast(k * 80 AS int) AS x", "0 AS y", "60 AS w", "60 AS h", "0.9D AS score", "e")
    return shown.select("video_id", "frame_index", "x", "y", "w", "h", "score", "e").unionByName(introduced)


def keep_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Keep mode over all faces: every identity of the gallery is enrolled in each video as it is introduced."""
    faces = _faces_with_vectors(spark, sf)
    start = faces.groupBy("video_id").agg(F.min("frame_index").alias("frame_index"))
    n = v.gallery(spark, sf).agg(F.count("*").alias("size"))
    policy = start.selectExpr("video_id", "frame_index", "0L AS seq", "'policy' AS op", """'{"policy":"keep"}' AS args""")
    enrol = start.join(F.broadcast(n)).withColumn("seq", F.explode(F.sequence(F.lit(1).cast("long"), F.col("size")))).selectExpr("video_id", "frame_index + 1 AS frame_index", "seq", "'enrol' AS op", """concat('{"id":', seq, '}') AS args""")
    return tracking.track(tracking.frames(faces, commands=policy.unionByName(enrol)))


def track_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Per video: frames, tracks, rows that are masked, and rows that newly appear."""
    return tracking.summary(*_detected(spark, sf))


QUERIES = {f.__name__: f for f in (track_batch, keep_policy, track_summary)}
ORACLE: dict[str, str] = {}
