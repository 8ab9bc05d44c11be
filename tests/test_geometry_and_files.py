"""Edge rows of the scalar functions, pixel filters, readers and writers."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilspark.functions import geometry as g
from veilspark.functions import media as m
from veilspark.operators import detect, identity, pixels, tracking
from veilspark.sources import media_files as mf


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def r(x, y, w, h):
    return g.rect(F.lit(x), F.lit(y), F.lit(w), F.lit(h))


def test_iou_edges(spark):
    got = one(spark, g.iou(r(0, 0, 10, 10), r(0, 0, 10, 10)), g.iou(r(0, 0, 10, 10), r(10, 0, 10, 10)), g.iou(r(0, 0, 0, 0), r(0, 0, 0, 0)), g.iou(r(0, 0, 10, 10), r(5, 0, 10, 10)))
    assert list(got) == [1.0, 0.0, 0.0, pytest.approx(1 / 3)]


def test_truncation_and_rounding(spark):
    got = one(spark, g.idiv(F.lit(-7), 2), g.trunc(F.lit(2.7)), g.trunc(F.lit(-2.7)), F.round(F.lit(2.5)).cast("int"), m.hold_frames(F.lit(0.5)), m.hold_frames(F.lit(60.0)), m.even(F.lit(1)), m.even(F.lit(33)))
    assert list(got) == [-3, 2, -2, 3, 10, 12, 2, 32]


def test_gate_thresholds(spark):
    cases = [(0, 0.15, True), (0, 0.1499, False), (2, 0.35, True), (2, 0.34, False), (16, 0.9, False)]
    rows = spark.createDataFrame(cases, "c int, s double, want boolean")
    assert rows.where(detect.object_gate(F.col("c"), F.col("s")) != F.col("want")).count() == 0
    sizes = spark.createDataFrame([(47, 48, 0.22, True), (48, 48, 0.34, False), (48, 48, 0.35, True)], "w int, h int, s double, want boolean")
    assert sizes.where(detect.face_gate(F.col("w"), F.col("h"), F.col("s"), 0.35) != F.col("want")).count() == 0


def test_face_shape_limits(spark):
    cases = [(100, 42, True), (100, 41, False), (100, 185, True), (100, 186, False), (2, 2, False), (160, 202, True), (149, 202, False)]
    rows = spark.createDataFrame(cases, "w int, h int, want boolean").withColumns({"x": F.lit(0), "y": F.lit(0)})
    assert rows.where(g.plausible_face(detect.box(), 480) != F.col("want")).count() == 0


def test_suppression_keeps_the_best_and_is_idempotent(spark):
    rows = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 0, 0.9), (1, 1, 1, 0, 10, 10, 0, 0.8), (1, 1, 50, 0, 10, 10, 0, 0.5), (1, 2, 0, 0, 10, 10, 0, 0.1)], "video_id long, frame_index long, x int, y int, w int, h int, class_id int, score double")
    kept = detect.suppress(rows, 0.2, 0.45)
    assert {(k["x"], k["score"]) for k in kept.collect()} == {(0, 0.9), (50, 0.5)}
    assert detect.suppress(kept, 0.2, 0.45).count() == 2


def test_identity_edges(spark):
    gallery = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.6, 0.8])], "identity_id int, embedding array<double>")
    probes = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, -1.0]), (3, []), (4, [1.0, 0.0, 0.0]), (5, [0.5, 1.0])], "vec_id int, embedding array<double>")
    for size, rows in ((1 << 20, 100), (1, 2)):  # at once, and by blocks and tiles
        got = {x["vec_id"]: (x["identity_id"], x["tier"]) for x in identity.nearest(probes, gallery, block_bytes=size, tile_rows=rows).collect()}
        assert got == {1: (1, 2), 2: (-1, 0), 3: (-1, 0), 4: (-1, 0), 5: (3, 2)}


def test_centroid_resets_on_another_length(spark):
    s = spark.createDataFrame([(1, 7, [1.0, 0.0]), (2, 7, [0.0, 3.0, 4.0]), (3, 7, [0.0, 3.0, 4.0])], "vec_id int, label int, embedding array<double>")
    got = identity.centroids(s).first()
    assert got["n"] == 2 and got["e"] == pytest.approx([0.0, 0.6, 0.8])


def test_timecode_and_labels(spark):
    got = one(spark, m.timecode(F.lit(-5), F.lit(25.0)), m.timecode(F.lit(3723 * 25 + 7), F.lit(24.5)), m.timecode(F.lit(101), F.lit(100.0)), m.clock_text(F.lit(59.999)), m.clock_text(F.lit(-1.0)))
    assert list(got) == ["00:00:00:00", "01:04:38:10", "00:00:01:001", "00:01:00.00", "00:00:00.00"]


def test_timecode_at_large_frames(spark, tmp_path):
    """Near a tie the last digit of pts was not the SQL's; hours have all their digits, as in the reference."""
    import duckdb

    from veilspark.plans import media

    spark.createDataFrame([(130347, 3), (284648, 3), (0, 3)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    got = media.timecode(spark, str(tmp_path)).orderBy("p_partkey").collect()
    assert [r["pts"] for r in got] == [r[0] for r in duck.execute(f"SELECT pts FROM ({media.ORACLE['timecode']}) ORDER BY p_partkey").fetchall()]
    assert [r["code"] for r in got] == ["00:00:00:00", "1179:09:10:19", "2575:00:19:26"]


@settings(max_examples=30, deadline=None)
@given(st.integers(2, 40), st.integers(2, 40), st.sampled_from(list(pixels.FILTERS)))
def test_filters_touch_only_their_box(h, w, mode):
    picture = np.random.default_rng(h * 41 + w).integers(1, 255, (h, w, 3), dtype=np.uint8)
    out = pixels.mask(picture, [{"x": 1, "y": 1, "w": w, "h": h}], mode)
    assert out.shape == picture.shape and (out[0] == picture[0]).all() and (out[:, 0] == picture[:, 0]).all()
    assert mode != "solid" or min(h, w) < 3 or not out[1:, 1:].any()


@settings(max_examples=50, deadline=None)
@given(st.lists(st.floats(0, 500), min_size=8, max_size=8))
def test_iou_is_symmetric_and_bounded(v):
    a, b = v[:4], v[4:]
    assert tracking._iou(a, b) == pytest.approx(tracking._iou(b, a)) and 0 <= tracking._iou(a, b) <= 1 + 1e-9


def test_blur_keeps_flat_areas():
    assert (pixels.blur(np.full((20, 9, 3), 77, np.uint8)) == 77).all() and (pixels.mosaic(np.full((20, 9, 3), 77, np.uint8)) == 77).all()


def test_anchor_layouts():
    a = np.arange(84 * 5).reshape(1, 84, 5)
    with pytest.raises(ValueError, match="unknown output shape"):
        pixels.anchors(a.reshape(1, 42, 10), 80)
    assert (pixels.anchors(a, 80) == pixels.anchors(a.transpose(0, 2, 1), 80)).all()


def test_detector_rows(spark):
    frames = spark.createDataFrame([("v", i, 4, 2, bytes(24)) for i in range(5)], mf.FRAMES.replace("pts_sec double, ", ""))
    got = pixels.detect_frames(frames, lambda pictures: [[(1, 1.0, 2.0, 3.0, 4.0, 0.5, 1.0, 0, 0)] for _ in pictures], chunk=2)
    assert got.count() == 5 and got.columns[:4] == ["video_id", "frame_index", "class_id", "cx"]


def test_readers(spark, tmp_path):
    (tmp_path / "a.rgb24").write_bytes(bytes(range(24)) * 3 + b"xx")
    (tmp_path / "a.s16").write_bytes(np.array([1, -2, 32767], "<i2").tobytes() + b"x")
    for n in ("A.MP4", "b.txt", "c.mkv"):
        (tmp_path / n).write_bytes(b"1")
    frames = mf.raw_frames(spark, str(tmp_path), 4, 2, 0.0)
    assert [(f["frame_index"], f["pts_sec"]) for f in frames.orderBy("frame_index").collect()] == [(0, 0.0), (1, 0.04), (2, 0.08)]
    assert [mf.seek(frames, n).first()["frame_index"] for n in (-1, 1, 9)] == [0, 1, 2]
    assert [s["value"] for s in mf.pcm(spark, str(tmp_path)).orderBy("sample_ix").collect()] == [1, -2, 32767]
    assert {f["name"] for f in mf.file_list(spark, str(tmp_path)).collect()} == {"A.MP4", "c.mkv"}


def test_settings_round_trip(spark, tmp_path):
    mf.write_settings(spark.createDataFrame([("blur", 0.4)], "redactionMode string, scoreThreshold double"), str(tmp_path / "s"))
    assert tuple(mf.settings(spark, str(tmp_path / "s")).first()) == ("en", "blur", 0.4, True)


def test_redactions_are_written_by_video(spark, tmp_path):
    mf.write_redactions(spark.createDataFrame([("a", 2, 1), ("a", 1, 1), ("b", 1, 1)], "video_id string, frame_index long, x int"), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).where("video_id = 'a'").count() == 2


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
