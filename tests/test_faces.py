"""Names without a bound, zooms wider than the input, odd rows of models, formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.functions import media as m
from veilspark.operators import faces as fc
from veilspark.operators import library as lib


def test_names_beyond_fifty(spark):
    taken = [("Clip_redacted.mp4",), *((f"clip_redacted_{i}.mp4",) for i in range(2, 71)), ("gap_redacted.mp4",), ("gap_redacted_3.mp4",), ("late_redacted_2.mp4",), ("redacted_redacted.mp4",), ("one_redacted.mp4",), ("one_redacted_1.mp4",), ("one_redacted_02.mp4",)]
    sources = [(p,) for p in ("/v/clip.mov", "/v/gap.mov", "/v/late.mov", "/v/.mov", "/v/one.avi", "/v/new.mkv")]
    got = {r.path: r.name for r in lib.free_names(spark.createDataFrame(sources, "path string"), spark.createDataFrame(taken, "name string")).collect()}
    assert got == {"/v/clip.mov": "clip_redacted_71.mp4", "/v/gap.mov": "gap_redacted_2.mp4", "/v/late.mov": "late_redacted.mp4", "/v/.mov": "redacted_redacted_2.mp4", "/v/one.avi": "one_redacted_2.mp4", "/v/new.mkv": "new_redacted.mp4"}


def test_regions_of_kinds(spark):
    frames = spark.createDataFrame([(1, 1, 640, 480), (1, 2, 300, 200)], "video_id long, frame_index long, width int, height int")
    zooms = spark.createDataFrame([(1, 1, 100, -20, 500, 400), (1, 1, 630, 0, 40, 40), (1, 2, 10, 10, 50, 60)], "video_id long, frame_index long, x int, y int, w int, h int")
    look = lambda kind: sorted(tuple(r) for r in fc.regions(frames, zooms, kind, 320).select("frame_index", "part", "rx", "ry", "rw", "rh", "enlarge").collect())
    yolo = [(1, "full", 0, 0, 640, 480, False), (1, "zoom", 190, 0, 320, 320, True), (2, "full", 0, 0, 300, 200, True), (2, "zoom", 10, 10, 50, 60, True)]
    tiles = [(1, "tile", x, y, 320, 320, False) for x in (0, 256, 320) for y in (0, 160)]
    assert look("yolo-face") == yolo and look("grid") == sorted(yolo + tiles)


def test_rows_of_unknown_shape(spark):
    rows = spark.createDataFrame([("ssd", [0.0, 1.0, 0.9]), ("ssd", None), ("yolo-face", [1.0] * 6), ("grid", [8.0]), ("x", [1.0] * 5), (None, [1.0] * 5), ("yolo-face", [50.0, 50.0, 20.0, 20.0, 0.3])], "kind string, values array<double>")
    fit = F.struct(F.lit(1.0).alias("scale"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y"))
    assert [tuple(r) for r in fc.decode(rows.withColumn("fit", fit), 0.5, 320, 320).collect()] == [("yolo-face", 40.0, 40.0, 20.0, 20.0, 0.3)]


def test_formats(spark):
    cases = [("{0}-{0}", ["a"], "a-a"), ("{0} {1}", ["{1}", "b"], "{1} b"), ("}", ["a"], "}"), ("", [], ""), ("{}", ["a"], "{}"), ("{{0}}", ["a"], "{0}"), (None, ["a"], None)]
    rows = spark.createDataFrame(cases, "t string, a array<string>, want string").select(m.formatted(F.col("t"), F.col("a")).alias("got"), "want").collect()
    assert [r.got for r in rows] == [r.want for r in rows]
