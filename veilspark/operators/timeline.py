"""Operators over frame order and intervals: edges, jumps, streaks, look-ahead, audio ranges, peaks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A track lives through 90 missed frames; a face is masked through 2.
LIFE, MASKED_MISSES, LOOKAHEAD = 90, 2, 4


def active_at(start: Column, end: Column, frame: Column) -> Column:
    """Closed interval; a negative end is open."""
    return (frame >= start) & ((end < 0) | (frame <= end))


def visible(kind: Column, lost: Column, miss: Column) -> Column:
    """Whether a track is masked: faces (kind 0) end after a few misses, others when lost."""
    return ~lost & ((kind != 0) | (miss <= MASKED_MISSES))


def shown_on_repaint(lost: Column, start: Column, end: Column, frame: Column) -> Column:
    """What a repaint of a paused frame shows: tracks that are not lost, however many frames they have missed."""
    return ~lost & active_at(start, end, frame)


def newly_visible(seen: DataFrame) -> DataFrame:
    """Rows (track_id, frame_index) that were not visible one frame before."""
    w = Window.partitionBy("track_id").orderBy("frame_index")
    frames = seen.select("track_id", "frame_index").distinct()
    return frames.withColumn("before", F.lag("frame_index").over(w)).where("before IS NULL OR before < frame_index - 1").drop("before")


def jumps(frames: DataFrame) -> DataFrame:
    """By order of processing (seq): whether a frame does not follow the last one of its stream (a repeat follows)."""
    last = F.lag("frame_index").over(Window.partitionBy("stream").orderBy("seq"))
    return frames.withColumn("jump", F.coalesce((F.col("frame_index") > last + 1) | (F.col("frame_index") < last), F.lit(False)))


def lives(seen: DataFrame, gap: int = LIFE) -> DataFrame:
    """Stretches of a track's frames without a gap of more than ``gap`` missed frames: life number, ends, hits, longest miss."""
    w = Window.partitionBy("track_id").orderBy("frame_index")
    frames = seen.select("track_id", "frame_index").distinct().withColumn("miss", F.coalesce(F.col("frame_index") - F.lag("frame_index").over(w) - 1, F.lit(0)))
    frames = frames.withColumn("life", F.sum((F.col("miss") > gap).cast("int")).over(w))
    return frames.groupBy("track_id", "life").agg(F.min("frame_index").alias("first_frame"), F.max("frame_index").alias("last_frame"), F.count("*").alias("hits"), F.max(F.when(F.col("miss") <= gap, F.col("miss")).otherwise(0)).alias("longest_miss"))


def backfill(appeared: DataFrame, frames: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """A new box stands on the frames before it too: each appearance on up to ``ahead`` earlier frames that exist.

    Frames are written out per appearance, so the join is by equality and never by range.
    """
    wanted = appeared.withColumn("shown", F.explode(F.sequence(F.col("frame_index") - ahead, F.col("frame_index") - 1)))
    return wanted.join(frames.select(F.col("frame_index").alias("shown")).distinct(), "shown", "left_semi")


def held(frames: DataFrame, ahead: int = LOOKAHEAD) -> DataFrame:
    """The frame that lets each frame go: the one ``ahead`` later, or none, when the end of the stream does."""
    w = Window.partitionBy("stream").orderBy("frame_index")
    return frames.withColumn("released_by", F.lead("frame_index", ahead).over(w))


def audio_at(samples: DataFrame, ranges: DataFrame, width: float = 16.0) -> DataFrame:
    """What is heard at each sample's time: the first range (by range_id) with start <= t < end.

    Ranges are written out by time bucket, so samples meet them by video and bucket.
    """
    r = ranges.where("end_sec > start_sec AND start_sec >= 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))))
    s = samples.withColumn("bucket", F.floor(F.col("t") / width))
    hit = s.join(r, ["video_id", "bucket"]).where("start_sec <= t AND t < end_sec")
    first = hit.groupBy("sample_id").agg(F.min("range_id").alias("range_id"), F.min_by("effect", "range_id").alias("effect"), F.count("*").alias("n_ranges"))
    return samples.join(first, "sample_id", "left").select("video_id", "sample_id", "t", F.col("range_id").isNotNull().alias("silenced"), F.coalesce(F.col("effect") == 1, F.lit(False)).alias("beep"), F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"))


def audio_edit(samples: DataFrame, ranges: DataFrame, width: float = 16.0) -> DataFrame:
    """What the written file does at each sample's time: closed intervals; any range silences, beeps sound where a beep range is."""
    r = ranges.where("end_sec > start_sec AND start_sec >= 0").withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start_sec") / width), F.floor(F.col("end_sec") / width))))
    s = samples.withColumn("bucket", F.floor(F.col("t") / width))
    hit = s.join(r, ["video_id", "bucket"]).where("t BETWEEN start_sec AND end_sec")
    got = hit.groupBy("sample_id").agg(F.count("*").alias("n_ranges"), F.max("effect").alias("effect"))
    return samples.join(got, "sample_id", "left").select("video_id", "sample_id", "t", F.col("n_ranges").isNotNull().alias("silenced"), F.coalesce(F.col("effect") == 1, F.lit(False)).alias("beep"), F.coalesce("n_ranges", F.lit(0)).alias("n_ranges"))


BEEP_HZ, BEEP_LEVEL, FULL_SCALE = 1000, 0.25, 32767  # fixed values: the tone that replaces sound


def _merged(ranges: DataFrame, name: str) -> DataFrame:
    """Per video and bucket the stretches that some range covers, as a list of (start, end) without overlaps."""
    w = Window.partitionBy("video_id", "bucket").orderBy("start_sec", "end_sec")
    before = F.max("end_sec").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_sec") <= F.col("before"), 0).otherwise(1)).over(w)
    joined = ranges.withColumn("before", before).withColumn("island", island).groupBy("video_id", "bucket", "island").agg(F.min("start_sec").alias("start"), F.max("end_sec").alias("end"))
    return joined.groupBy("video_id", "bucket").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(name))


def render_audio(samples: DataFrame, ranges: DataFrame, rate: int, width: float = 16.0) -> DataFrame:
    """The samples (video_id, sample_ix, value) as they are written: 0 inside any range (ends included), a tone inside a beep range, else unchanged.

    Ranges are cut to buckets of time and merged there, so each sample meets one row by video and
    bucket and is never counted out again. The tone's phase comes from the sample's number, so it
    does not depend on how samples are dealt out.
    """
    r = ranges.where("end_sec > start_sec AND start_sec >= 0")
    bucket = lambda c: F.floor(c / width)
    r = r.withColumn("bucket", F.explode(F.sequence(bucket(F.col("start_sec")), bucket(F.col("end_sec")))))
    cut = r.select("video_id", "bucket", "effect", F.greatest("start_sec", F.col("bucket") * width).alias("start_sec"), F.least("end_sec", (F.col("bucket") + 1) * width).alias("end_sec"))
    spans = _merged(cut, "mute").join(_merged(cut.where("effect = 1"), "beep"), ["video_id", "bucket"], "left")
    t = F.col("sample_ix") / F.lit(float(rate))
    met = samples.withColumn("t", t).withColumn("bucket", bucket(F.col("t"))).join(spans, ["video_id", "bucket"], "left")
    inside = lambda c: F.coalesce(F.exists(c, lambda x: (F.col("t") >= x["start"]) & (F.col("t") <= x["end"])), F.lit(False))
    tone = F.round(F.sin(F.col("sample_ix") * (2 * math.pi * BEEP_HZ) / rate) * (BEEP_LEVEL * FULL_SCALE)).cast("int")
    return met.select("video_id", "sample_ix", F.when(inside(F.col("beep")), tone).when(inside(F.col("mute")), 0).otherwise(F.col("value")).alias("value"))


def seconds_text(sec: Column) -> Column:
    """Seconds with a point and three decimals, whatever the locale."""
    return F.format_string("%.3f", sec)


def edit_text(ranges: DataFrame, beeps_only: bool) -> DataFrame:
    """Per video the condition under which an audio filter acts, as the sum of its ranges."""
    r = ranges.where("end_sec > start_sec AND start_sec >= 0")
    r = r.where("effect = 1") if beeps_only else r
    one = F.concat(F.lit("between(t,"), seconds_text(F.col("start_sec")), F.lit(","), seconds_text(F.col("end_sec")), F.lit(")"))
    return r.groupBy("video_id").agg(F.concat_ws("+", F.transform(F.sort_array(F.collect_list(F.struct("range_id", one.alias("s")))), lambda x: x["s"])).alias("condition"))


def clean_range(start: Column, end: Column) -> Column:
    """A range as it is stored: ends in order, from 0, at least 0.05 s long."""
    lo = F.greatest(F.lit(0.0), F.least(start, end))
    return F.struct(lo.alias("start_sec"), F.greatest(F.greatest(start, end), lo + 0.05).alias("end_sec"))


def peaks(samples: DataFrame, per_bucket: int | None, buckets: int) -> DataFrame:
    """Per video and bucket the largest share of full scale; a last, short bucket without sound and all after it hold 0.15 of the last peak.

    Without ``per_bucket`` each video's length sets it, so that the buckets cover the whole audio; a given one leaves out what lies behind the last bucket.
    """
    if per_bucket is None:
        length = samples.groupBy("video_id").agg(F.expr(f"(max(sample_ix) + {buckets}) div {buckets}").alias("per"))
        s = samples.join(length, "video_id")
    else:
        s = samples.withColumn("per", F.lit(per_bucket))
    b = s.groupBy("video_id", "per", F.expr("cast(sample_ix div per AS int)").alias("bucket")).agg(F.max(F.abs(F.col("value") / 32768.0)).alias("peak"), F.count("*").alias("n")).where(F.col("bucket") < buckets)
    real = b.where("n = per OR peak > 0").select("video_id", "bucket", "peak")
    last = real.groupBy("video_id").agg(F.max("bucket").alias("last"), F.max_by("peak", "bucket").alias("tail"))
    every = last.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return every.join(real, ["video_id", "bucket"], "left").select("video_id", "bucket", F.when(F.col("bucket") > F.col("last"), F.col("tail") * 0.15).otherwise(F.coalesce("peak", F.lit(0.0))).alias("peak"))


def soft_normalise(rows: DataFrame) -> DataFrame:
    """Peaks with the largest of each video at 0.92; near-silent videos stay as they are."""
    top = rows.groupBy("video_id").agg(F.max("peak").alias("top"))
    scaled = F.when(F.col("top") < 1e-4, F.col("peak")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("peak") * (0.92 / F.col("top")))))
    return rows.join(top, "video_id").select("video_id", "bucket", scaled.alias("peak"))


def peak_between(values: Column, t: Column) -> Column:
    """The envelope at a share t of its length, by linear interpolation; 0 without values."""
    n = F.size(values)
    at = t * (n - 1)
    i = F.floor(at).cast("int")
    mixed = F.get(values, i) * (1 - (at - i)) + F.get(values, i + 1) * (at - i)
    return F.when(n == 0, 0.0).when((n == 1) | (i < 0), F.get(values, F.lit(0))).when(i >= n - 1, F.get(values, n - 1)).otherwise(mixed)


def miss_motion(vx: Column, vw: Column, miss: Column) -> Column:
    """Velocity and growth after ``miss`` missed frames."""
    return F.struct((vx * F.pow(F.lit(0.55), miss)).alias("vx"), (vw * F.pow(F.lit(0.35), miss)).alias("vw"))
