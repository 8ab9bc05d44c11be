"""The export flow: what is masked on every frame, boxes of new objects on the frames before them too, and the masked frames.

Frames wait until those behind them have been seen, since an object that appears is masked on up to
``LOOKAHEAD`` earlier frames. In batch that is a bounded look-ahead by frame numbers and an equality
join, so no video is held in one task; ``streaming.export`` does the same with frames in state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pixels
from .timeline import LOOKAHEAD, active_at

# The order in which a frame's boxes are masked.
AUTO, MANUAL, STATIC = 0, 1, 2
VIDEO_FRAME = ("video_id", "frame_index")
BOX = ("x", "y", "w", "h")
RECTS = "array<struct<x:int,y:int,w:int,h:int>>"


def to_redact(frames: DataFrame, tracks: DataFrame, manual: DataFrame, static: DataFrame) -> DataFrame:
    """video_id, frame_index, ord, id, x, y, w, h of all boxes to mask: enabled tracks, manual boxes from their start on, static boxes while they are active.

    tracks: by frame, with id and enabled. manual: id, enabled, start and by frame where the box is (frame_index). static: id, enabled, start, end (negative: open).
    Static boxes are written out on frames by chunks of frame numbers, so they meet frames by equality.
    """
    auto = tracks.where("enabled").select(*VIDEO_FRAME, F.lit(AUTO).alias("ord"), F.col("id").cast("long").alias("id"), *BOX)
    drawn = manual.where("enabled AND frame_index >= start").select(*VIDEO_FRAME, F.lit(MANUAL).alias("ord"), F.col("id").cast("long").alias("id"), *BOX)
    return reduce(DataFrame.unionByName, (auto, drawn, _while_active(frames, static)))


CHUNK = 1024  # frames that a static box meets by one key


def _while_active(frames: DataFrame, static: DataFrame) -> DataFrame:
    chunk = lambda c: F.floor(c / CHUNK)
    spans = frames.groupBy("video_id").agg(F.max("frame_index").alias("last"))
    s = static.where("enabled").join(spans, "video_id").withColumn("upto", F.when(F.col("end") < 0, F.col("last")).otherwise(F.least("end", "last")))
    s = s.where("upto >= start").withColumn("chunk", F.explode(F.sequence(chunk(F.col("start")), chunk(F.col("upto"))))).drop("last", "upto")
    met = frames.select(*VIDEO_FRAME).withColumn("chunk", chunk(F.col("frame_index"))).join(s, ["video_id", "chunk"])
    return met.where(active_at(F.col("start"), F.col("end"), F.col("frame_index"))).select(*VIDEO_FRAME, F.lit(STATIC).alias("ord"), F.col("id").cast("long").alias("id"), *BOX)


def appeared(tracks: DataFrame) -> DataFrame:
    """Of tracks by frame (id, box) those that were not there one frame before."""
    before = tracks.select("video_id", (F.col("frame_index") + 1).alias("frame_index"), "id").distinct()
    return tracks.join(before, ["video_id", "frame_index", "id"], "left_anti")


def frame_rects(frames: DataFrame, boxes: DataFrame, new: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """frames with ``rects`` in the order of masking and ``n_late``: a frame's own boxes, then those that appear on the next ``ahead`` frames, earlier ones first."""
    entry = lambda late, by: F.struct(F.lit(late).alias("late"), by.cast("long").alias("by"), "ord", "id", *(F.col(c).cast("int").alias(c) for c in BOX)).alias("r")
    own = boxes.select(*VIDEO_FRAME, entry(0, F.col("frame_index")))
    there = frames.select(*VIDEO_FRAME).distinct()
    late = new.withColumn("shown", F.explode(F.sequence(F.col("frame_index") - ahead, F.col("frame_index") - 1)))
    late = late.select("video_id", F.col("shown").alias("frame_index"), entry(1, F.col("frame_index"))).join(there, list(VIDEO_FRAME), "left_semi")
    listed = own.unionByName(late).groupBy(*VIDEO_FRAME).agg(F.sort_array(F.collect_list("r")).alias("r"), F.sum("r.late").alias("n_late"))
    rects = F.transform(F.coalesce("r", F.array().cast(listed.schema["r"].dataType)), lambda r: F.struct(*(r[c].alias(c) for c in BOX)))
    return frames.join(listed, list(VIDEO_FRAME), "left").withColumn("rects", rects).withColumn("n_late", F.coalesce("n_late", F.lit(0)).cast("int")).drop("r")


def export_frames(frames: DataFrame, boxes: DataFrame, new: DataFrame, mode: str = "mosaic", ahead: int = LOOKAHEAD) -> DataFrame:
    """The frames (pixels) with all that is to be masked masked."""
    return pixels.mask_frames(frame_rects(frames, boxes, new, ahead).drop("n_late"), mode)


def export(frames: DataFrame, tracks: DataFrame, manual: DataFrame, static: DataFrame, mode: str = "mosaic") -> DataFrame:
    """From visible tracks (of ``tracking.track``: track_id, enabled, appeared) to masked frames: one plan."""
    named = tracks.withColumn("id", F.col("track_id").cast("long"))
    boxes = to_redact(frames, named, manual, static)
    new = named.where("appeared").select(*VIDEO_FRAME, F.lit(AUTO).alias("ord"), "id", *BOX)
    return export_frames(frames, boxes, new, mode)


def rects_text(rects: Column) -> Column:
    return F.array_join(F.transform(rects, lambda r: F.concat_ws(",", *(r[c] for c in BOX))), ";")



