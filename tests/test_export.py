"""The export flow: batch equals brute force, the stream equals the batch, from tracks to masked frames."""

from __future__ import annotations

import time
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from veilspark.operators import export, pixels, tracking
from veilspark.streaming import export as streamed
from veilspark.streaming.tracks import with_store

W, H = 40, 30
BOXES = "video_id string, frame_index long, ord int, id long, x int, y int, w int, h int"


def made_up(videos=2, frames=60, seed=1):
    """Frames, boxes and boxes of what appears, some on frames that are not there."""
    rnd = np.random.default_rng(seed)
    pictures, boxes, new = [], [], []
    for v in range(videos):
        for f in range(frames):
            if rnd.random() < 0.9:
                pictures.append((f"v{v}", f, W, H, rnd.integers(1, 256, W * H * 3, dtype=np.uint8).tobytes()))
            for i in range(rnd.integers(0, 4)):
                box = (f"v{v}", f, int(rnd.integers(0, 3)), int(rnd.integers(0, 50)), *(int(x) for x in rnd.integers(-3, 30, 2)), *(int(x) for x in rnd.integers(0, 16, 2)))
                boxes.append(box)
                if i == 0 and rnd.random() < 0.4:
                    new.append(box)
    return pictures, boxes, new


def brute(pictures, boxes, new, ahead=4):
    there = {p[:2] for p in pictures}
    rects = defaultdict(list)
    for v, f, ordinal, i, *b in sorted(boxes):
        rects[v, f].append(tuple(b))
    late = defaultdict(list)
    for v, f, ordinal, i, *b in sorted(new, key=lambda n: (n[0], n[1], n[2:])):
        for k in range(f - ahead, f):
            late[v, k].append(tuple(b))
    return {k: (rects[k] + late[k], len(late[k])) for k in there}


def frames_and_boxes(spark, pictures, boxes, new):
    return spark.createDataFrame(pictures, "video_id string, frame_index long, width int, height int, pixels binary"), spark.createDataFrame(boxes, BOXES), spark.createDataFrame(new, BOXES)


def test_rects_against_brute_force(spark):
    data = made_up()
    got = export.frame_rects(*frames_and_boxes(spark, *data)).collect()
    assert {(r["video_id"], r["frame_index"]): ([tuple(x) for x in r["rects"]], r["n_late"]) for r in got} == brute(*data)
    frames, boxes, _ = frames_and_boxes(spark, *data)
    assert {r["n_late"] for r in export.frame_rects(frames, boxes, boxes.limit(0)).collect()} == {0}
    assert export.frame_rects(frames.limit(0), boxes, boxes).count() == 0


def test_no_window_and_no_nested_loop(spark):
    plan = export.frame_rects(*frames_and_boxes(spark, *made_up()))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_batch_masks(spark):
    pictures, boxes, new = made_up()
    want = brute(pictures, boxes, new)
    got = export.export_frames(*frames_and_boxes(spark, pictures, boxes, new), mode="solid").collect()
    by_key = {p[:2]: np.frombuffer(p[4], np.uint8).reshape(H, W, 3) for p in pictures}
    assert len(got) == len(pictures)
    for r in got:
        k = (r["video_id"], r["frame_index"])
        rects = [dict(zip("xywh", b, strict=True)) for b in want[k][0]]
        assert bytes(r["pixels"]) == pixels.mask(by_key[k], rects, "solid").tobytes()


def _rows(pictures, boxes, new, ends):
    rects, news = defaultdict(list), defaultdict(list)
    for v, f, _, _, *b in sorted(boxes):
        rects[v, f] += b
    for v, f, _, _, *b in sorted(new):
        news[v, f] += b
    as_bytes = lambda x: np.array(x, "<i4").tobytes()
    last = {v: max(p[1] for p in pictures if p[0] == v) for v in {p[0] for p in pictures}}
    return [(*p, as_bytes(rects[p[:2]]), as_bytes(news[p[:2]]), ends and p[1] == last[p[0]]) for p in pictures]


def _streamed(spark, tmp_path, batches, **options):
    with_store(spark)
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        pd_rows = pd.DataFrame(rows, columns=[c.split()[0] for c in streamed.INPUT.split(", ")])
        spark.createDataFrame(pd_rows, streamed.INPUT).coalesce(1).write.mode("append").parquet(str(source / f"b{i}"))
    stream = spark.readStream.schema(streamed.INPUT).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(source))
    return streamed.export_stream(stream, **options)


def test_stream_equals_batch(spark, tmp_path):
    """All frames come, in micro-batches, and the last ones are let go by the end mark."""
    pictures, boxes, new = made_up(frames=25, seed=4)
    there = {p[:2] for p in pictures}
    new = [n for n in new if n[:2] in there]  # a box appears on a frame that is there
    boxes = [b for b in boxes if b[:2] in there]
    rows = _rows(pictures, boxes, new, True)
    q = _streamed(spark, tmp_path, [[r for r in rows if r[1] // 7 == k] for k in range(4)], mode="solid", hold=4, idle_ms=-1).writeStream.format("memory").queryName("masked").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    want = {(r["video_id"], r["frame_index"]): bytes(r["pixels"]) for r in export.export_frames(*frames_and_boxes(spark, pictures, boxes, new), mode="solid").collect()}
    got = spark.table("masked").collect()
    assert len(got) == len(want) and {(r["video_id"], r["frame_index"]): bytes(r["pixels"]) for r in got} == want


def test_held_frames_go_when_nothing_more_comes(spark, tmp_path):
    pictures, boxes, new = made_up(videos=1, frames=10, seed=5)
    rows = _rows(pictures, boxes, new, False)
    q = _streamed(spark, tmp_path, [rows], mode="solid", hold=6, idle_ms=1).writeStream.format("memory").queryName("flushed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="1 second").start()
    try:
        until = time.monotonic() + 60
        while spark.table("flushed").count() < len(pictures) and q.isActive and time.monotonic() < until:
            time.sleep(1)
    finally:
        q.stop()
    assert spark.table("flushed").count() == len(pictures)


def test_from_tracks_to_masked_frames(spark):
    """Track, hold, back-fill and mask in one plan."""
    n = 24
    rnd = np.random.default_rng(8)
    frames = spark.createDataFrame([("a", f, 640, 480, rnd.integers(1, 256, 640 * 480 * 3, dtype=np.uint8).tobytes()) for f in range(n)], "video_id string, frame_index long, width int, height int, pixels binary").repartition(3)
    dets = spark.createDataFrame([("a", f, 100 + f, 80, 60, 70, 0.9) for f in range(8, n)], "video_id string, frame_index long, x int, y int, w int, h int, score double")
    tracks = tracking.track(tracking.frames(dets))
    manual = spark.createDataFrame([("a", f, 5, True, 10, 300, 300, 20, 20) for f in range(n)], "video_id string, frame_index long, id int, enabled boolean, start long, x int, y int, w int, h int")
    static = spark.createDataFrame([("a", 6, True, 3, 5, 10, 10, 8, 8), ("a", 7, True, 20, -1, 500, 20, 8, 8), ("a", 8, False, 0, -1, 0, 0, 640, 480)], "video_id string, id int, enabled boolean, start long, end long, x int, y int, w int, h int")
    got = {r["frame_index"]: np.frombuffer(r["pixels"], np.uint8).reshape(480, 640, 3) for r in export.export(frames, tracks, manual, static, "solid").collect()}
    assert sorted(got) == list(range(n))
    seen = [f for f in got if not got[f][100:120, 120:140].any()]
    first = min(r["frame_index"] for r in tracks.where("appeared").collect())
    assert set(range(first - 4, first)) <= set(seen) and first - 5 not in seen
    assert [f for f in got if not got[f][305:315, 305:315].any()] == [f for f in got if f >= 10]
    assert sorted(f for f in got if not got[f][11:17, 11:17].any()) == [3, 4, 5] and sorted(f for f in got if not got[f][21:27, 501:507].any()) == [20, 21, 22, 23]
    assert all(got[f][470:, 600:].all() for f in got)


def test_appeared(spark):
    t = spark.createDataFrame([("a", f, i, 0, 0, 1, 1) for f, i in ((0, 1), (1, 1), (3, 1), (1, 2), (2, 2))], "video_id string, frame_index long, id int, x int, y int, w int, h int")
    assert sorted((r["frame_index"], r["id"]) for r in export.appeared(t).collect()) == [(0, 1), (1, 2), (3, 1)]
    assert export.appeared(t).where(F.col("w") > 1).count() == 0
