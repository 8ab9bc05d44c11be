"""Detection from pixels to boxes, failures that stay with their picture, rendered audio, identities by blocks, folds with one vector in memory."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, faces, identity, pixels, resample
from veilspark.operators import timeline as tl

FRAMES = "video_id string, frame_index long, width int, height int, pixels binary"


def pictures(spark, n, w=8, h=6, parts=2):
    return spark.createDataFrame([("v", i, w, h, bytes([i]) * (w * h * 3)) for i in range(n)], FRAMES).coalesce(1).repartitionByRange(parts, "frame_index")


ROW = (2, 320.0, 320.0, 100.0, 60.0, 0.9, 0.5, 0, 140)


def test_a_failed_picture_keeps_its_failure_to_itself(spark):
    def detector(batch):
        if any(p[0, 0, 0] in (3, 7) for p in batch):
            raise RuntimeError("bad picture")
        return [[ROW] for _ in batch]

    got = pixels.detect_frames(pictures(spark, 12), detector, chunk=4).collect()
    assert {r["frame_index"]: r["error"] for r in got} == {i: "RuntimeError: bad picture" if i in (3, 7) else None for i in range(12)}
    assert all(r["class_id"] == 2 for r in got if not r["error"])


def test_a_failed_batch_is_remembered_in_its_task(spark, tmp_path):
    log = str(tmp_path / "calls")

    def detector(batch):
        with open(log, "a") as f:
            f.write(f"{len(batch)} ")
        if len(batch) > 1:
            raise MemoryError
        return [[ROW]]

    assert pixels.detect_frames(pictures(spark, 10, parts=1), detector, chunk=4).count() == 10
    assert open(log).read().split() == ["4", *["1"] * 10]  # one batch fails, and no other is tried


def test_rows_of_another_shape_are_errors(spark):
    got = pixels.detect_frames(pictures(spark, 3), lambda batch: [[ROW, (1, 2.0)] for _ in batch]).collect()
    assert sorted((r["error"] or "") for r in got) == ["", "", "", *["a row of 2 numbers"] * 3]
    short = pixels.detect_frames(pictures(spark, 3), lambda batch: [[ROW]]).collect()  # one answer for all: no batches, then
    assert [r["error"] for r in short] == [None] * 3


def test_objects_from_pixels(spark):
    """Letterbox, rows, gate, way back, suppression; boxes under 4 pixels and rows with errors go."""
    frames = pictures(spark, 4, 1280, 720)

    def detector(batch):
        out = []
        for p in batch:
            _, scale, px, py = pixels.letterboxed(p, 640)
            fit = (scale, px, py)
            out.append([(2, 320.0, 320.0, 100.0, 60.0, 0.9, *fit), (2, 321.0, 320.0, 100.0, 60.0, 0.8, *fit), (2, 100.0, 300.0, 1.9, 50.0, 0.9, *fit), (0, 20.0, 200.0, 60.0, 80.0, 0.19, *fit), (16, 400.0, 300.0, 50.0, 50.0, 0.99, *fit)])
        if batch[0][0, 0, 0] == 3:
            raise ValueError
        return out

    raw = pixels.detect_frames(frames, detector, keep=("video_id", "frame_index", "width", "height"), chunk=1)
    got = {tuple(r) for r in detect.object_boxes(raw).select("frame_index", "class_id", "x", "y", "w", "h", "score").collect()}
    assert got == {(i, *b) for i in range(3) for b in ((2, 540, 300, 200, 120, 0.9), (0, 0, 40, 100, 160, 0.19))}


def white_square(at, size, w=400, h=300):
    p = np.zeros((h, w, 3), np.uint8)
    x, y = at
    p[y : y + size, x : x + size] = 255
    return p.tobytes()


def finder(log):
    def run(batch):
        with open(log, "a") as f:
            f.write(f"{len(batch)} ")
        out = []
        for p in batch:
            ys, xs = np.nonzero(p[..., 0] > 128)
            out.append([[0.0, 1.0, 0.9, xs.min() / 128, ys.min() / 128, (xs.max() + 1) / 128, (ys.max() + 1) / 128]] if len(xs) else [])
        return out

    return run


def test_faces_from_pixels_in_one_plan(spark, tmp_path):
    """Each region is cut once, in chunks of 48; tiles and zooms find the same face once; a person without one gets a fallback."""
    places = {i: (40 + 7 * i, 60) for i in range(20)}
    frames = spark.createDataFrame([("v", i, 400, 300, white_square(xy, 40)) for i, xy in places.items()], FRAMES).coalesce(1)
    zooms = spark.createDataFrame([("v", i, x - 20, y - 20, 80, 80) for i, (x, y) in places.items()], "video_id string, frame_index long, x int, y int, w int, h int")
    persons = spark.createDataFrame([("v", 3, 300, 100, 60, 180), ("v", 4, places[4][0] - 30, 55, 100, 200)], "video_id string, frame_index long, x int, y int, w int, h int")
    log = str(tmp_path / "calls")
    frames_only = frames.select("video_id", "frame_index", "width", "height")
    planned = faces.regions(frames_only, zooms, "ssd", 128)
    found = faces.detect(frames, zooms, persons, finder(log), "ssd", 128, 0.5, 400, 300).cache()
    rows = found.collect()
    calls = [int(x) for x in open(log).read().split()]
    assert sum(calls) == planned.count() and calls[:-1] == [48] * (len(calls) - 1)
    for i, (x, y) in places.items():
        mine = [r for r in rows if r["frame_index"] == i and r["score"] > 0.5]
        assert len(mine) >= 1
        assert any(r["x"] <= x and r["y"] <= y and r["x"] + r["w"] >= x + 40 and r["y"] + r["h"] >= y + 40 and r["w"] < 90 for r in mine)
    assert {r["frame_index"] for r in rows if r["score"] == detect.FALLBACK_SCORE} == {3}
    assert found.columns == ["video_id", "frame_index", "x", "y", "w", "h", "score"]


def test_region_pictures():
    p = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    whole = {"rx": 0, "ry": 0, "rw": 30, "rh": 20, "enlarge": False}
    assert (pixels.region_picture(p, whole, 40, False)[10:30, 5:35] == p).all() and (pixels.region_picture(p, whole, 40, True)[:20, :30] == p).all()
    zoom = {"rx": 5, "ry": 5, "rw": 10, "rh": 10, "enlarge": True}
    assert (pixels.region_picture(p, zoom, 40, False) == resample.bilinear(p[5:15, 5:15], 40, 40)).all()
    assert not pixels.region_picture(p, {"rx": 50, "ry": 50, "rw": 10, "rh": 10, "enlarge": True}, 16, False).any()


def rendered(samples, ranges, rate):
    out = {}
    for v, i, x in samples:
        hits = [e for rv, _, a, b, e in ranges if rv == v and b > a >= 0 and a <= i / rate <= b]
        out[v, i] = round(0.25 * 32767 * math.sin(2 * math.pi * 1000 * i / rate)) if 1 in hits else 0 if hits else x
    return out


@pytest.mark.parametrize("width", [0.1, 0.7, 16.0])
def test_rendered_audio(spark, width):
    rng = np.random.default_rng(3)
    samples = [(v, i, int(rng.integers(-32768, 32768))) for v in range(3) for i in range(3000)]
    ranges = [(int(rng.integers(0, 2)), k, float(a), float(a + rng.choice([0.0, 0.01, 0.3, -0.2])), int(rng.integers(0, 2))) for k, a in enumerate(rng.integers(-10, 60, 25) / 20)]
    s, r = spark.createDataFrame(samples, "video_id int, sample_ix long, value int").repartition(5), spark.createDataFrame(ranges, "video_id int, range_id int, start_sec double, end_sec double, effect int")
    got = {(x["video_id"], x["sample_ix"]): x["value"] for x in tl.render_audio(s, r, 997, width).collect()}
    assert got == rendered(samples, ranges, 997) and len(got) == len(samples)
    assert {x["value"] for x in tl.render_audio(s, r.limit(0), 997).collect()} == {x for *_, x in samples}


def test_nearest_by_blocks_and_tiles(spark):
    """200,000 identities in blocks of 400 kB, against one multiplication."""
    rng = np.random.default_rng(5)
    g = rng.normal(size=(200_000, 4))
    g[150_000] = g[10]  # a tie: the smaller id wins
    p = np.r_[rng.normal(size=(300, 4)), g[[10]]]
    gallery = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(g)], "identity_id long, embedding array<double>").repartition(8)
    probes = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(p)], "vec_id long, embedding array<double>")
    got = identity.nearest(probes, gallery, block_bytes=400_000, tile_rows=100)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "CartesianProduct" not in plan
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(p) @ unit(g).T
    rows = {r["vec_id"]: r for r in got.collect()}
    assert len(rows) == len(p) and rows[300]["identity_id"] == 10
    assert all(rows[i]["identity_id"] == int(s[i].argmax()) and rows[i]["score"] == pytest.approx(s[i].max()) for i in range(300))


def test_centroids_hold_one_vector(spark):
    """A label with 100,000 samples beside small ones, in any order of rows, against the fold done at once."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("label"), F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (k + 1)) + 0.5 for k in range(3))).alias("embedding"))
    few = spark.createDataFrame([(2, 5, [0.0, 3.0]), (2, 4, [1.0, 0.0]), (3, 1, [1.0]), (None, 2, [1.0]), (4, 1, None)], "label int, vec_id long, embedding array<double>")
    got = {r["label"]: r for r in identity.centroids(rows.unionByName(few).repartition(6)).collect()}
    unit = lambda v: v / np.sqrt(max((v * v).sum(), 1e-12))
    e, c = np.stack([np.sin(np.arange(n) * (k + 1)) + 0.5 for k in range(3)], axis=1), None
    for i in range(n):
        c = unit(e[i]) if c is None else unit((c * i + unit(e[i])) / (i + 1))
    assert got[1]["n"] == n and got[1]["e"] == pytest.approx(c.tolist(), abs=1e-9)
    assert got[2]["n"] == 2 and got[2]["e"] == pytest.approx([math.sqrt(0.5)] * 2) and got[3]["e"] == [1.0] and set(got) == {1, 2, 3}


def test_class_names_are_the_known_ones():
    """Some of the names, written out."""
    assert {i: detect.CLASS_NAMES[i] for i in (0, 2, 7, 16, 24, 39, 56, 62, 63, 67, 79)} == {0: "person", 2: "car", 7: "truck", 16: "dog", 24: "backpack", 39: "bottle", 56: "chair", 62: "tv", 63: "laptop", 67: "cell phone", 79: "toothbrush"}
    assert len(detect.CLASS_NAMES) == 80


def test_masks_against_plain_loops():
    """A second form of the filters: pixel by pixel."""
    rng = np.random.default_rng(6)
    for w, h in ((37, 31), (16, 45), (3, 2), (90, 17)):
        p = rng.integers(0, 256, (h, w, 3), dtype=np.uint8)
        sw, sh = max(1, w // 15), max(1, h // 15)
        want = np.zeros_like(p)
        for y in range(h):
            for x in range(w):
                at = [min(max((k + 0.5) * n / s - 0.5, 0), n - 1) for k, n, s in ((x * sw // w, w, sw), (y * sh // h, h, sh))]
                (x0, y0), (fx, fy) = map(int, at), (at[0] % 1, at[1] % 1)
                x1, y1 = min(x0 + 1, w - 1), min(y0 + 1, h - 1)
                corner = lambda yy, xx: p[yy, xx].astype(float)  # noqa: B023, E731
                want[y, x] = np.rint((corner(y0, x0) * (1 - fx) + corner(y0, x1) * fx) * (1 - fy) + (corner(y1, x0) * (1 - fx) + corner(y1, x1) * fx) * fy)
        assert (pixels.mosaic(p) == want).all()
        solid = pixels.mask(p, [{"x": 2, "y": -1, "w": w, "h": 5}], "solid")
        assert all(tuple(solid[y, x]) == ((0, 0, 0) if 2 <= x < w and y < 4 and w >= 4 and h >= 2 else tuple(p[y, x])) for y in range(h) for x in range(w))


def test_each_frame_has_its_mode(spark):
    frames = spark.createDataFrame([(m, 40, 30, bytes(range(240)) * 15, [(4, 4, 20, 20)]) for m in ("mosaic", "blur", "solid", "other")], "mode string, width int, height int, pixels binary, rects array<struct<x:int,y:int,w:int,h:int>>")
    got = {r["mode"]: bytes(r["pixels"]) for r in pixels.mask_frames(frames, None).collect()}
    for mode in ("mosaic", "blur", "solid"):
        assert {bytes(r["pixels"]) for r in pixels.mask_frames(frames, mode).collect()} == {got[mode]}
    assert got["other"] == got["mosaic"] and len(set(got.values())) == 3


def test_report_files(spark, tmp_path):
    from veilspark.sources import media_files as mf

    rows = spark.createDataFrame([(1, f, 10, 20, 60, 80, c, s) for f in range(3) for c, s in ((0, 0.9), (16, 0.2), (16, 0.5))], "video_id long, frame_index long, x int, y int, w int, h int, class_id int, score double")
    tracks = rows.where("class_id = 0").selectExpr("video_id", "frame_index", "7 AS id", "x", "y", "w", "h")
    report = mf.debug_report(rows, rows.where("class_id = 16"), tracks, 0.35, 640, 480)
    names = {(r["frame_index"], r["name"]) for r in report.collect()}
    assert names == {(f, n) for f in range(3) for n in ("persons", "zooms", "faces", "low faces", "tracks")}
    mf.write_report(report, str(tmp_path / "r"))
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "r")).coalesce(1).collect()]
    assert len(lines) == report.count() and "0\tpersons\t10,20,60,80" in lines and "2\ttracks\t7:10,20,60,80" in lines
    assert mf.debug_report(rows.limit(0), rows.limit(0), tracks.limit(0), 0.35, 640, 480).count() == 0


def test_aligned_faces(spark):
    """The first three points land on their places; what a face shows goes with them."""
    from veilspark.functions import geometry as g
    from veilspark.operators import crops

    w, h = 300, 200
    p = np.zeros((h, w, 3), np.uint8)
    points = [(100.0, 80.0), (140.0, 84.0), (118.0, 110.0)]
    for x, y in points:
        p[int(y) - 2 : int(y) + 3, int(x) - 2 : int(x) + 3] = 200
    frames = spark.createDataFrame([("v", 0, w, h, p.tobytes()), ("v", 1, w, h, p.tobytes())], FRAMES)
    as_rows = [dict(x=x, y=y) for x, y in points]
    faces_ = spark.createDataFrame([("v", 0, 1, as_rows), ("v", 0, 2, [as_rows[0]] * 3), ("v", 0, 3, as_rows[:2]), ("v", 1, 4, as_rows)], "video_id string, frame_index long, face_id int, points array<struct<x:double,y:double>>")
    for size in (128, 64):
        got = crops.aligned_faces(frames, faces_, size).collect()
        assert {(r["frame_index"], r["face_id"]) for r in got} == {(0, 1), (1, 4)}
        for r in got:
            face = np.frombuffer(r["pixels"], np.uint8).reshape(size, size, 3)
            assert all(face[round(y * size / 128), round(x * size / 128), 0] == 200 for x, y in g.ALIGNED)
            assert not face[-3:, :3].any()


def test_thumbnails(spark):
    from veilspark.operators import crops

    frames = pictures(spark, 5, 80, 40)
    spans = spark.createDataFrame([("v", 0, 2), ("v", 3, 2), ("v", 9, 1)], "video_id string, first long, span long")
    got = {r["frame_index"]: r for r in crops.filmstrip(frames, spans, 20, 20).collect()}
    assert set(got) == {0, 3} and all((r["width"], r["height"], r["span"]) == (20, 10, 2) for r in got.values())
    assert all(bytes(r["pixels"]) == bytes([i]) * 600 for i, r in got.items())
    assert {(r["width"], r["height"]) for r in crops.thumbnails(frames, 500, 3).collect()} == {(6, 3)}


def _plan(spark, sf, name):
    from veilspark.plans import registry

    return registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_debug_report_tells_a_head_region_once(spark, sf):
    """Sizes by shape were written out wherever the region's numbers are used, 32 times for a person."""
    assert _plan(spark, sf, "debug_report").count("0.82") == 1


def test_det_finalize_rounds_a_margin_once(spark, sf):
    """Across and down, and the score of the made detections; it was 49 times."""
    assert _plan(spark, sf, "det_finalize").lower().count("round(") <= 3


def test_redact_counts_rounds_a_margin_once_and_suppression_asks_first_who_meets(spark, sf):
    plan = _plan(spark, sf, "redact_counts")
    assert plan.lower().count("round(") <= 6  # it was 52
    boxes = spark.createDataFrame([(1, 1, 0, 0, 10, 10, 1, 0.9), (1, 1, 10, 0, 10, 10, 1, 0.8), (1, 1, 4, 0, 10, 10, 1, 0.7), (1, 1, 0, 0, 0, 5, 1, 0.6)], "video_id int, frame_index int, x int, y int, w int, h int, class_id int, score double")
    assert [(r.x, r.w) for r in detect.suppress(boxes, 0.1, 0.4).orderBy("x", "w").collect()] == [(0, 0), (0, 10), (10, 10)]


def test_masks_go_in_stacks_and_equal_single_ones(monkeypatch):
    """90 pictures of two sizes with rectangles that overlap, leave the picture or are empty: each mode and size of part is filtered once."""
    rng = np.random.default_rng(3)
    pictures = [rng.integers(0, 256, (36, 48 + i % 2, 3), dtype=np.uint8) for i in range(90)]
    box = lambda x, y, w=17, h=16: {"x": x, "y": y, "w": w, "h": h}
    rects = [[box(i % 3 * 16, 0), box(i % 3 * 16 + 4, 5)] + ([box(-9, 30), box(60, 60)] if i % 5 else []) for i in range(90)]
    modes = [list(pixels.FILTERS)[i % 3] for i in range(90)]
    want = [pixels.mask(p, r, m) for p, r, m in zip(pictures, rects, modes, strict=True)]
    calls, old = [], dict(pixels.FILTERS)
    for m, f in old.items():
        monkeypatch.setitem(pixels.FILTERS, m, lambda part, f=f: calls.append(part.shape) or f(part))
    assert all((a == b).all() for a, b in zip(pixels.masks(pictures, rects, modes), want, strict=True))
    assert len(calls) <= 24 and sum(c[0] for c in calls) == 90 * 2 + 72
    k = pixels._spread(16, pixels.BLUR_SIZE)
    assert np.allclose(k.sum(axis=1), 1) and all((old["blur"](np.full((2, 16, 17, 3), c, np.uint8)) == c).all() for c in (0, 128, 255))


def test_pixel_masks_deals_its_frames_out(spark, sf):
    from veilspark.plans import redaction

    assert redaction.pixel_masks(spark, sf).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_redact_union_neither_sorts_nor_shuffles_boxes(spark, sf):
    """Boxes of orders were written out for 21 frames each, then shuffled by some 320 frames and sorted."""
    from veilspark.plans import redaction

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = redaction.redact_union(spark, sf)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_redact_union_keeps_manual_boxes_to_the_last_frame(spark, tmp_path):
    """They ended 20 frames after their start, which is where static boxes end; copies of a box stay apart."""
    from veilspark.plans import redaction

    frames = [5, 6, 25, 26, 40, 1023, 1024, 5000]
    lines = [(f * 4, 1, 1, 1, 1.0, 1.0) for f in frames]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(0, 5), (1200, 1505), (1, 5), (2, 5), (3, 26)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in redaction.redact_union(spark, str(tmp_path)).collect())
    manual = 2 * [(f, 5, 0, 40, 40, "manual") for f in frames] + [(f, 26, 3, 40, 40, "manual") for f in frames if f >= 26]
    assert got == sorted(manual + [(f, 5, 1, 60, 30, "static") for f in (5, 6, 25)])


def test_redact_union_holds_a_piece_of_a_box_at_a_time(spark, sf):
    """Two explodes in one fused stage held the rows of a box on all frames at once."""
    from veilspark.plans import redaction

    df = redaction.redact_union(spark, sf)
    df.collect()
    steps = [x.strip() for x in df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines() if "Generate explode" in x]
    assert len(steps) == 2 and sum("*(" in x for x in steps) == 1
