"""Readers and writers of media-side files, through Spark's own file sources, so any store that Spark reads will do."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import media as m
from ..operators import detect as d
from .raw_media import FRAMES as FRAMES
from .raw_media import read_pcm, read_video



def file_list(spark: SparkSession, folder: str) -> DataFrame:
    """path, name and size of the video files of a folder, one level deep, whatever the case of their ending."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", F.col("length").alias("bytes"))
    return found.where(m.is_video(F.col("path"))).withColumn("name", m.file_name(F.col("path")))


def raw_frames(spark: SparkSession, path: str, width: int, height: int, fps: float, pattern: str = "*.rgb24") -> DataFrame:
    """Frames of raw video files (three bytes a pixel, frame after frame). A short last frame ends the stream. fps at or below 0.001 counts as 25."""
    return read_video(spark, path, width=width, height=height, fps=fps, pattern=pattern)


def seek(frames: DataFrame, frame: int) -> DataFrame:
    """The frame of each video at a position that is brought into its range."""
    ends = frames.groupBy("video_id").agg((F.max("frame_index")).alias("last"))
    return frames.join(ends, "video_id").where(F.col("frame_index") == F.greatest(F.lit(0), F.least(F.lit(frame), F.col("last")))).drop("last")


def pcm(spark: SparkSession, path: str, pattern: str = "*.s16") -> DataFrame:
    """video_id, sample_ix, value of mono little-endian 16-bit files; a half sample at the end is left out."""
    return read_pcm(spark, path, pattern=pattern)


def settings(spark: SparkSession, path: str) -> DataFrame:
    """One row of settings from a JSON text, with a default for what is missing or no number."""
    t = spark.read.text(path, wholetext=True)
    j = F.col("value")
    return t.select(m.setting(j, "language", "en").alias("language"), m.setting(j, "redactionMode", "mosaic").alias("mode"), m.setting_number(j, "scoreThreshold", 0.5).alias("threshold"), (m.setting(j, "hardwareAccel", "true") == "true").alias("hardware"))


def write_settings(rows: DataFrame, path: str) -> None:
    """Settings rows as JSON text, over what was there; nulls are left out."""
    rows.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def write_redactions(redact: DataFrame, path: str) -> None:
    """The boxes to mask, one folder per video, in frame order within files."""
    redact.repartition("video_id").sortWithinPartitions("video_id", "frame_index").write.mode("overwrite").partitionBy("video_id").parquet(path)


def audio_edit_plan(ranges: DataFrame) -> DataFrame:
    """Per video what a remux has to do: copy, mute, or mute and beep, with the conditions of both."""
    from ..operators.timeline import edit_text

    videos = ranges.select("video_id").distinct()
    mute, beep = edit_text(ranges, False).withColumnRenamed("condition", "mute"), edit_text(ranges, True).withColumnRenamed("condition", "beep")
    out = videos.join(mute, "video_id", "left").join(beep, "video_id", "left")
    return out.withColumn("shape", F.when(F.col("mute").isNull(), "copy").when(F.col("beep").isNull(), "mute").otherwise("mute+beep"))


def first_ranges(ranges: DataFrame, n: int) -> DataFrame:
    """The first n ranges in list order."""
    return ranges.orderBy("range_id").limit(n)


DEBUG_LOW = 0.12  # fixed value: the threshold of the second look


def debug_report(objects: DataFrame, rows: DataFrame, tracks: DataFrame, threshold: float, width: int, height: int) -> DataFrame:
    """What was seen on each frame and what was nearly seen: section, name and line (x,y,w,h) of persons, zooms, faces at the threshold and at ``DEBUG_LOW``, and tracks (id first).

    rows: what the face model said, before any threshold. Both looks take them from there, so a model
    is run once where its rows have been written.
    """
    box = F.concat_ws(",", *d.BOX)

    def faces(least: float) -> DataFrame:
        gated = rows.where(d.face_gate(F.col("w"), F.col("h"), F.col("score"), least))
        return d.finalise(d.suppress(gated, d.FACE_NMS_MIN, d.FACE_NMS_IOU, top=d.FACE_TOP), width, height)

    zooms = d.zoom_budget(objects, objects.limit(0), width, height)
    told = (("persons", objects.where(F.col("class_id") == d.PERSON), box), ("zooms", zooms, box), ("faces", faces(threshold), box), ("low faces", faces(DEBUG_LOW), box), ("tracks", tracks, F.concat_ws(":", "id", box)))
    return reduce(DataFrame.unionByName, (part.select(*d.FRAME, F.lit(k).alias("section"), F.lit(name).alias("name"), line.alias("line")) for k, (name, part, line) in enumerate(told)))


def write_report(report: DataFrame, path: str) -> None:
    """A report as text files, one folder per video, in order of frame, section and line."""
    text = report.select("video_id", "frame_index", "section", F.concat_ws("\t", "frame_index", "name", "line").alias("value"), "line")
    ordered = text.repartitionByRange("video_id", "frame_index").sortWithinPartitions("video_id", "frame_index", "section", "line")
    ordered.select("video_id", "value").write.mode("overwrite").partitionBy("video_id").text(path)


def log_rows(dets: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per frame how many faces were found and shown, and why others were not."""
    seen = dets.groupBy("video_id", "frame_index").agg(F.count("*").alias("found"))
    why: Column = F.when(~F.col("enabled"), "kept").when(F.col("miss") > 0, "coasting").otherwise("masked")
    shown = tracks.groupBy("video_id", "frame_index", why.alias("why")).agg(F.count("*").alias("n"))
    return seen.join(shown.groupBy("video_id", "frame_index").pivot("why", ["masked", "coasting", "kept"]).agg(F.sum("n")), ["video_id", "frame_index"], "left").na.fill(0)
