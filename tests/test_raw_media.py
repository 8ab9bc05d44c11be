"""Raw video and audio: every partition size gives the same rows, conditions choose what is read, a failed write leaves nothing."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

from veilspark.operators import resample
from veilspark.sources import raw_media as rm

W, H, N = 6, 4, 23
SIZE = W * H * 3


@pytest.fixture
def folder(tmp_path):
    rnd = np.random.default_rng(1)
    for name, frames in (("a", N), ("b", 2)):
        (tmp_path / f"{name}.rgb24").write_bytes(rnd.integers(0, 256, frames * SIZE, dtype=np.uint8).tobytes() + b"short")
    (tmp_path / "c.rgb24").write_bytes(bytes(100))
    (tmp_path / "c.json").write_text(json.dumps({"width": 0, "height": 4}))
    (tmp_path / "b.json").write_text(json.dumps({"width": W, "height": H, "fps": 50, "bitrate_kbps": -4}))
    return tmp_path


def rows(df):
    return sorted((r["video_id"], r["frame_index"], r["pts_sec"], bytes(r["pixels"])) for r in df.collect())


def test_video_at_every_partition_size(spark, folder):
    raw = (folder / "a.rgb24").read_bytes()
    want = [("a", i, i / 25.0, raw[i * SIZE : (i + 1) * SIZE]) for i in range(N)]
    for size in (1, SIZE, SIZE + 1, 2 * SIZE, 5 * SIZE, 7 * SIZE - 1, 10**9):
        got = rm.read_video(spark, str(folder), width=W, height=H, fps=0.0, partition_bytes=size)
        assert got.rdd.getNumPartitions() == sum(-(-n // max(1, size // SIZE)) for n in (N, 2))
        assert [r for r in rows(got) if r[0] == "a"] == want
        assert [r[2] for r in rows(got) if r[0] == "b"] == [0.0, 0.02]


def test_props_without_frames(spark, folder):
    got = {r["video_id"]: tuple(r)[2:] for r in rm.read_props(spark, str(folder), width=W, height=H).collect()}
    assert got == {"a": (True, W, H, 25.0, N, 0.0), "b": (True, W, H, 50.0, 2, 0.0), "c": (False, 0, 4, 25.0, 0, 0.0)}


def test_conditions_choose_partitions(spark, folder):
    video = rm.read_video(spark, str(folder), width=W, height=H, partition_bytes=SIZE)
    assert [r["frame_index"] for r in video.where("video_id = 'a' AND frame_index > 3 AND frame_index <= 6").orderBy("frame_index").collect()] == [4, 5, 6]
    assert video.where("frame_index IN (1, 22, 99)").count() == 3 and video.where("frame_index IN (1, 22) AND frame_index < 20 AND video_id IN ('b', 'x')").count() == 1
    assert video.where("frame_index = 22 AND video_id = 'b'").count() == 0

    def planned(*filters, **options):
        reader = rm.VideoReader({"path": str(folder), "width": W, "height": H, "partition_bytes": SIZE, **options})
        assert list(reader.pushFilters(filters)) == []
        return [(p.video.video_id, p.first, p.n) for p in reader.partitions() if p.n]

    assert planned(EqualTo(("video_id",), "a"), GreaterThan(("frame_index",), 3), LessThanOrEqual(("frame_index",), 6)) == [("a", i, 1) for i in (4, 5, 6)]
    assert planned(In(("frame_index",), (1, 22))) == [("a", 1, 1), ("a", 22, 1), ("b", 1, 1)]
    assert planned(GreaterThan(("frame_index",), 20), partition_bytes=4 * SIZE) == [("a", 21, 2)]


@pytest.mark.parametrize("at,want", [(-5, {"a": 0, "b": 0}), (1, {"a": 1, "b": 1}), (7, {"a": 7, "b": 1}), (999, {"a": N - 1, "b": 1})])
def test_seek_reads_one_frame(spark, folder, at, want):
    found = rm.read_video(spark, str(folder), width=W, height=H, seek=at)
    assert found.rdd.getNumPartitions() == 2 and {r["video_id"]: r["frame_index"] for r in found.collect()} == want


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """10 GB of holes: nothing but what is asked for is read."""
    w, h = 1920, 1080
    with (tmp_path / "long.rgb24").open("wb") as f:
        f.truncate(10 * 10**9)
    video = rm.read_video(spark, str(tmp_path), width=w, height=h)
    assert video.rdd.getNumPartitions() > 140
    one = video.where("frame_index = 1500")
    assert one.rdd.getNumPartitions() == 1 and one.select(F.length("pixels")).first()[0] == w * h * 3


def test_pcm_at_every_partition_size(spark, tmp_path):
    v = np.random.default_rng(2).integers(-(2**15), 2**15, 1001).astype("<i2")
    (tmp_path / "a.s16").write_bytes(v.tobytes() + b"x")
    for size in (1, 2, 3, 200, 501, 10**6):
        got = rm.read_pcm(spark, str(tmp_path), partition_bytes=size).orderBy("sample_ix").collect()
        assert [(r["video_id"], r["sample_ix"], r["value"]) for r in got] == [("a", i, int(x)) for i, x in enumerate(v)]
        if size == 1:
            assert rm.read_pcm(spark, str(tmp_path), partition_bytes=200).where("sample_ix >= 990").rdd.getNumPartitions() == 2
    assert rm.read_pcm(spark, str(tmp_path), duration=0.05, buckets=7).count() == 58 * 7  # ceil(8000 * 0.05 / 7) samples a bucket
    assert rm.read_pcm(spark, str(tmp_path), duration=99, buckets=7).count() == 1001


def frames_of(spark, sizes, parts=3):
    rnd = np.random.default_rng(3)
    made = [(v, i, w, h, rnd.integers(0, 256, w * h * 3, dtype=np.uint8).tobytes()) for v, many in sizes.items() for i, (w, h) in many]
    return spark.createDataFrame(made, "video_id string, frame_index long, width int, height int, pixels binary").repartition(parts)


def test_written_frames_are_read_back(spark, tmp_path):
    frames = frames_of(spark, {"a": [(i, (W, H)) for i in range(40)], "b/ü": [(i * 2, (W, H)) for i in range(5)]})
    path = str(tmp_path / "out")
    rm.write_video(frames, path, fps=12.5)
    got = rm.read_video(spark, path, partition_bytes=3 * SIZE)
    want = sorted((r["video_id"], r["frame_index"], bytes(r["pixels"])) for r in frames.collect())
    place = {k: i for v in ("a", "b/ü") for i, k in enumerate(x[:2] for x in want if x[0] == v)}  # frames are numbered anew
    assert [(v, i, p) for v, i, _, p in rows(got)] == [(v, place[v, i], p) for v, i, p in want]
    assert {r["video_id"]: (r["fps"], r["frame_count"]) for r in rm.read_props(spark, path).collect()} == {"a": (12.5, 40), "b/ü": (12.5, 5)}
    assert not list((tmp_path / "out").glob("_staging*"))
    with pytest.raises(Exception, match="FileExistsError"):
        rm.write_video(frames, path)
    assert not list((tmp_path / "out").glob("_staging*")) and rm.read_video(spark, path).count() == 45
    rm.write_video(frames.where("frame_index < 3"), path, overwrite=True)
    assert rm.read_video(spark, path).count() == 5


def test_sizes_are_even_and_of_the_first_frame(spark, tmp_path):
    frames = frames_of(spark, {"a": [(0, (7, 5)), (1, (7, 5)), (2, (12, 8))]})
    rm.write_video(frames, str(tmp_path / "o"))
    got = {r["frame_index"]: (r["width"], r["height"], bytes(r["pixels"])) for r in rm.read_video(spark, str(tmp_path / "o")).collect()}
    by_ix = {r["frame_index"]: np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in frames.collect()}
    assert got == {i: (6, 4, resample.bilinear(p, 6, 4).tobytes()) for i, p in by_ix.items()}


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    frames = frames_of(spark, {"a": [(i, (W, H)) for i in range(20)]})
    bad = frames.withColumn("width", F.when(F.col("frame_index") == 13, F.raise_error("lost").cast("int")).otherwise(F.col("width")))
    with pytest.raises(Exception, match="lost"):
        rm.write_video(bad, str(tmp_path / "o"))
    shrunk = frames.withColumn("pixels", F.when(F.col("frame_index") == 13, F.expr("substring(pixels, 1, 7)")).otherwise(F.col("pixels")))
    with pytest.raises(Exception, match="reshape"):
        rm.write_video(shrunk, str(tmp_path / "o"))
    assert [p for p in (tmp_path / "o").rglob("*") if p.is_file()] == []


def test_killed_attempts_are_not_committed(tmp_path):
    """Two attempts of a task have written; the commit knows one of them."""
    w = rm.VideoWriter({"path": str(tmp_path), "fps": "25"}, False)

    def batch(ids):
        return pa.RecordBatch.from_pylist([{"video_id": "a", "frame_index": i, "width": 2, "height": 2, "to_width": 2, "to_height": 2, "pixels": bytes([i] * 12)} for i in ids])

    w.write(iter([batch([0, 1])]))  # its executor was lost
    late, early = w.write(iter([batch([2]), batch([5])])), w.write(iter([batch([0, 1])]))
    assert rm.videos(str(tmp_path), {}) == []
    w.commit([late, None, early])
    assert sorted(p.name for p in tmp_path.rglob("*") if p.is_file()) == ["_props.json", "part-000000", "part-000001"]
    assert [p[1:] for p in rm.videos(str(tmp_path), {})[0].parts] == [(0, 2), (2, 2)]
    again = rm.VideoWriter({"path": str(tmp_path)}, True)
    with pytest.raises(ValueError, match="overlap"):
        again.commit([again.write(iter([batch([0, 3])])), again.write(iter([batch([2])]))])
    with pytest.raises(ValueError, match="comes after"):
        again.write(iter([batch([3, 1])]))
    again.abort([])
    assert not list(tmp_path.glob("_staging*"))


def test_resampling_of_hand_made_pictures():
    p = np.array([[0, 100], [200, 40]], np.uint8)[..., None]
    assert resample.bilinear(p, 1, 1)[0, 0, 0] == 85 and resample.area(p, 1, 1)[0, 0, 0] == 85
    assert resample.bilinear(p, 4, 2)[..., 0].tolist() == [[0, 25, 75, 100], [200, 160, 80, 40]]
    assert resample.nearest(p, 4, 4)[..., 0].tolist() == [[0, 0, 100, 100]] * 2 + [[200, 200, 40, 40]] * 2
    q = np.arange(9, dtype=np.uint8).reshape(3, 3, 1) * 10
    assert resample.area(q, 1, 3)[..., 0].tolist() == [[10], [40], [70]] and resample.area(q, 2, 1)[0, :, 0].tolist() == [33, 47]
    assert (resample.warped(q, (1, 0, 0, 0, 1, 0), 3, 3) == q).all() and resample.warped(q, (1, 0, 1, 0, 1, 0), 3, 3)[..., 0].tolist() == [[0, 0, 10], [0, 30, 40], [0, 60, 70]]
    assert resample.warped(q, (2, 0, 0, 0, 2, 0), 3, 3)[1, 1, 0] == 20 and not resample.warped(q, (0, 0, 0, 0, 0, 0), 2, 2).any()
