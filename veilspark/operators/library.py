"""Relational operators around files, logs and lists: names, statuses, merges, totals, bests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media as m

# The stages of a run in the order that settles ties.
STAGES = ("decode", "objects", "faces", "track", "encode")


def first_per_path(files: DataFrame) -> DataFrame:
    """Files (ord, path) without later ones whose path differs in case alone."""
    nth = F.row_number().over(Window.partitionBy(F.lower("path")).orderBy("ord"))
    return files.withColumn("nth", nth).where("nth = 1").drop("nth")


def free_names(sources: DataFrame, taken: DataFrame) -> DataFrame:
    """For each source (path) the first free output name: plain, then _2, _3 and so on, without an end; taken holds the folder's names, whose case does not count.

    The numbers taken of a stem are ranked; as long as they equal their ranks there is no gap.
    """
    stem = F.coalesce(F.nullif(m.stem(F.col("path")), F.lit("")), F.lit("redacted"))
    named = sources.select("path", stem.alias("stem"), F.lower(stem).alias("low")).distinct()
    part = lambda g: F.regexp_extract(F.lower("name"), r"(?s)^(.*)_redacted(?:_([1-9]\d*))?\.mp4$", g)
    used = taken.where(F.lower("name").rlike(r"(?s)^.*_redacted(?:_[1-9]\d*)?\.mp4$")).select(part(1).alias("low"), F.when(part(2) == "", 1).otherwise(F.nullif(part(2).try_cast("long"), F.lit(1))).alias("i"))
    ranked = used.where("i IS NOT NULL").distinct().withColumn("nth", F.row_number().over(Window.partitionBy("low").orderBy("i")))
    gaps = ranked.groupBy("low").agg((F.count_if(F.col("i") == F.col("nth")) + 1).alias("free"))
    number = F.when(F.col("free") > 1, F.concat(F.lit("_"), F.col("free").cast("string"))).otherwise("")
    return named.join(gaps, "low", "left").select("path", F.concat(F.col("stem"), F.lit("_redacted"), number, F.lit(".mp4")).alias("name"))


def status_counts(files: DataFrame) -> DataFrame:
    one = lambda s: F.count_if(F.col("status") == s)
    return files.groupBy().agg(F.count("*").alias("total"), one("Waiting").alias("waiting"), one("Done").alias("done"), one("Failed").alias("failed"), F.bool_or(F.col("status") == "Failed").alias("any_failed"))


def batch_run(files: DataFrame) -> DataFrame:
    """Statuses after a run over each batch (batch, ord, outcome, minutes, max_minutes): too long files are passed by, failures do not stop it, a cancel does."""
    w = Window.partitionBy("batch").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    long = (F.col("max_minutes") > 0) & (F.col("minutes") > F.col("max_minutes"))
    cancels = F.sum(F.when(~long & (F.col("outcome") == "cancel"), 1).otherwise(0)).over(w)
    here = ~long & (F.col("outcome") == "cancel") & (cancels == 1)
    status = F.when(here, "Cancelled").when(cancels > 0, "Waiting").when(long, "Too long").when(F.col("outcome") == "ok", "Done").otherwise("Failed")
    return files.withColumn("status", status)


def upsert_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """What a merge of new rows into old ones (key, val) does by key."""
    o, n = old.select("key", F.col("val").alias("old_val")), new.select("key", F.col("val").alias("new_val"))
    act = F.when(F.col("old_val").isNull(), "insert").when(F.col("new_val").isNull(), "delete").when(F.col("old_val") == F.col("new_val"), "keep").otherwise("update")
    return o.join(n, "key", "full_outer").withColumn("action", act)


def stage_totals(times: DataFrame, seconds: int = 5) -> DataFrame:
    """Per window of so many seconds the stages' total ms (ts, stage, ms), the bottleneck and whether faces bind."""
    s = times.groupBy(F.window("ts", f"{seconds} seconds")["start"].alias("start")).pivot("stage", list(STAGES)).agg(F.sum("ms")).na.fill(0.0)
    total = sum((F.col(c) for c in STAGES), F.lit(0.0))
    best = F.array_max(F.array(*(F.struct(F.col(c).alias("ms"), F.lit(-i).alias("o"), F.lit(c).alias("name")) for i, c in enumerate(STAGES))))
    return s.withColumns({"total": total, "bottleneck": best["name"], "face_bound": (best["name"] == "faces") | ((total > 1) & (F.col("faces") > 0.55 * total))})


def utilisation(samples: DataFrame) -> DataFrame:
    """Busy share between samples (machine, seq, idle, kernel, user); kernel time holds idle time; the first sample has 0."""
    w = Window.partitionBy("machine").orderBy("seq")
    d = lambda c: F.col(c) - F.lag(c).over(w)
    total = d("kernel") + d("user")
    busy = F.when(total > 0, (total - F.least(total, d("idle"))) * 100.0 / total)
    return samples.withColumn("percent", F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), busy)), F.lit(0.0)))


def best_adapter(adapters: DataFrame) -> DataFrame:
    """Per machine the adapter of the highest worth, the first of equals; none if all are virtual."""
    a = adapters.withColumn("worth", m.adapter_score(F.col("vendor"), F.col("memory"), F.col("name"))).where("worth >= 0")
    return a.groupBy("machine").agg(F.max_by("ix", F.struct("worth", (-F.col("ix")).alias("o"))).alias("ix"), F.max("worth").alias("worth"))


def codec_choice(candidates: DataFrame) -> DataFrame:
    """Per machine the first candidate that is listed and passes its probe (ord, codec, listed, probe_ok), else the fallback."""
    ok = candidates.groupBy("machine").agg(F.min_by("codec", F.when(F.col("listed") & F.col("probe_ok"), F.col("ord"))).alias("codec"), F.bool_or(F.col("listed") & F.col("probe_ok")).alias("found"))
    return ok.select("machine", F.when(F.col("found"), F.col("codec")).otherwise("mp4v").alias("codec"))


def throttle(updates: DataFrame, millis: int = 200) -> DataFrame:
    """Of a stream's updates (stream, seq, ms, forced) the first in each interval, and all forced ones."""
    first = F.row_number().over(Window.partitionBy("stream", F.floor(F.col("ms") / millis)).orderBy("seq"))
    return updates.withColumn("first", first).where("forced OR first = 1").drop("first")


def face_marks(faces: DataFrame, every: int = 15) -> DataFrame:
    """Frames with a face (video_id, frame_index) and whether the list is published there."""
    f = faces.select("video_id", "frame_index").distinct()
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index"))
    return f.withColumn("size", n).withColumn("publish", F.col("size") % every == 0)


def latest_request(requests: DataFrame) -> DataFrame:
    """Per generation the request that counts: the last ticket."""
    return requests.groupBy("generation").agg(F.max_by("span", "ticket").alias("span"), F.max("ticket").alias("ticket"))


def mask_sync(boxes: DataFrame, marks: DataFrame, gate: float = 80.0) -> DataFrame:
    """Each box's mark: by id, else the nearest mark of the same kind (scene, kind) nearer than the gate that no id binds; ties to the smaller mark."""
    bound = boxes.join(marks.select(F.col("mark_id").alias("box_id"), "scene", "kind"), ["scene", "kind", "box_id"], "left_semi").withColumn("mark_id", F.col("box_id"))
    rest = boxes.join(bound, ["scene", "kind", "box_id"], "left_anti")
    free = marks.join(bound.select("scene", "kind", F.col("box_id").alias("mark_id")), ["scene", "kind", "mark_id"], "left_anti").select("scene", "kind", "mark_id", F.col("x").alias("mx"), F.col("y").alias("my"))
    d = F.sqrt(F.pow(F.col("x") - F.col("mx"), 2) + F.pow(F.col("y") - F.col("my"), 2))
    near = rest.join(free, ["scene", "kind"]).withColumn("d", d).where(F.col("d") < gate).groupBy("scene", "kind", "box_id").agg(F.min_by("mark_id", F.struct("d", "mark_id")).alias("mark_id"))
    return bound.select("scene", "kind", "box_id", "mark_id").unionByName(near)


def handle_hit(points: DataFrame, ranges: DataFrame, px: float = 6.0, width: float = 64.0) -> DataFrame:
    """Which range a point (track, point_id, x) of the audio lane hits: the first whose edge is near, else the last whose body holds it.

    Ranges are written out by stretches of ``width`` pixels, so points meet them by track and stretch.
    """
    stretch = lambda c: F.floor(c / width)
    near = ranges.where("x1 + 2 >= x0 - 2").withColumn("stretch", F.explode(F.sequence(stretch(F.col("x0") - 2), stretch(F.col("x1") + 2))))
    hit = points.withColumn("stretch", stretch(F.col("x"))).join(near, ["track", "stretch"]).where("x >= x0 - 2 AND x <= x1 + 2")
    edge = F.when(F.abs(F.col("x") - F.col("x0")) <= px, -1).when(F.abs(F.col("x") - F.col("x1")) <= px, 1).otherwise(0)
    order = F.when(edge != 0, F.struct(F.lit(0).alias("k"), F.col("ord").alias("o"))).otherwise(F.struct(F.lit(1).alias("k"), (-F.col("ord")).alias("o")))
    return hit.groupBy("point_id").agg(F.min_by("range_id", order).alias("range_id"), F.min_by(edge, order).alias("edge"))


def localised(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """Texts of keys (code, key): the locale's, else English, else the key itself. Texts per locale are a short fixed list of the program."""
    own = texts.select("code", "key", F.col("text").alias("own"))
    english = texts.where("code = 'en'").select("key", F.col("text").alias("english"))
    return keys.join(own, ["code", "key"], "left").join(english, "key", "left").select("code", "key", F.coalesce("own", "english", "key").alias("text"))


def first_existing(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """Of each name's candidate paths (name, ord, path) the first that exists; null if none does."""
    there = candidates.join(existing.select("path").distinct(), "path", "left_semi").groupBy("name").agg(F.min_by("path", "ord").alias("found"))
    return candidates.select("name").distinct().join(there, "name", "left")


def status_texts(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Files (status, code) with the locale's text for their status; an unknown status stays as it is."""
    keyed = files.withColumn("key", m.status_key(F.col("status")))
    found = localised(keyed.where("key IS NOT NULL").select("code", "key").distinct(), texts)
    return keyed.join(found, ["code", "key"], "left").withColumn("text", F.coalesce("text", "status")).drop("key")


def coarse_spans(videos: DataFrame, thumbs: DataFrame) -> DataFrame:
    """Per video the least span of its coarse pictures (video_id, span); 0 without any."""
    least = thumbs.groupBy("video_id").agg(F.min("span").alias("coarse_span"))
    return videos.select("video_id").distinct().join(least, "video_id", "left").na.fill(0, ["coarse_span"])


def peak_utilisation(counters: DataFrame) -> DataFrame:
    """Per machine the largest of its counters (percent, known) within 0 to 100; unknown ones do not count."""
    peak = F.coalesce(F.max(F.when(F.col("known"), F.col("percent"))), F.lit(0.0))
    return counters.groupBy("machine").agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), peak)).alias("percent"))


def written_frames(frames: DataFrame) -> DataFrame:
    """Per run how many frames were written (run, written)."""
    return frames.groupBy("run").agg(F.count_if("written").alias("frames"))


def import_snapshot(tracks: DataFrame, next_ids: DataFrame, with_faces: bool) -> DataFrame:
    """Tracks of a snapshot as a start: detected ones (kind 0 or 1), faces only if asked, all lost and without misses; next_id stands behind them and behind what was given (video_id, next_id)."""
    taken = tracks.where(F.col("kind").isin(0, 1) if with_faces else F.col("kind") == 1).withColumns({"lost": F.lit(True), "miss": F.lit(0)})
    ends = taken.groupBy("video_id").agg((F.max("id") + 1).alias("behind"))
    known = ends.join(next_ids, "video_id", "left").select("video_id", F.greatest("behind", F.coalesce("next_id", F.lit(1))).alias("next_id"))
    return taken.join(known, "video_id")
