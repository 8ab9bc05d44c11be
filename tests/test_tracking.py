"""The tracker and the keep policy by scenario; batch and streaming give the same rows."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.operators import tracking as tr


def det(x, y=50, w=60, h=60, score=0.9, e=None, label=None):
    return {"box": [float(x), float(y), float(w), float(h)], "score": score, "e": e, "label": label}


def run(frames, video=None, commands=()):
    """frames: faces by frame index. Returns the state and the rows by frame."""
    v, out = video or tr.Video(), {}
    for i, faces in frames:
        out[i] = v.frame(i, faces, [], [], [{"seq": k, "op": op, "args": json.dumps(a)} for k, (at, op, a) in enumerate(commands) if at == i])
    return v, out


def ids(rows):
    return [r[1] for r in rows]


def test_walk_keeps_the_id_and_short_gaps_coast():
    _, out = run([(i, [] if i in (5, 6) else [det(10 + 8 * i)]) for i in range(12)])
    assert all(ids(r) == [1] for r in out.values())
    assert [r[0][9] for r in (out[4], out[5], out[6], out[7])] == [0, 1, 2, 0]  # misses


def test_third_miss_hides_and_return_is_newly_visible():
    _, out = run([(i, [] if 3 <= i <= 5 else [det(10)]) for i in range(8)])
    assert out[5] == [] and out[6][0][1] == 1 and out[6][0][-1] and not out[7][0][-1]


@pytest.mark.parametrize("gap,same", [(90, True), (91, False)])
def test_life_ends_after_ninety_misses(gap, same):
    _, out = run([(0, [det(10)]), *((i, []) for i in range(1, gap + 1)), (gap + 1, [det(10)])])
    assert (ids(out[gap + 1]) == [1]) == same


def test_low_scores_only_continue():
    _, out = run([(0, [det(10, score=0.18)]), (1, [det(10)]), (2, [det(12, score=0.18)]), (3, [det(400, score=0.21)])])
    assert out[0] == [] and ids(out[1]) == [1] and out[2][0][9] == 0 and ids(out[3]) == [1]


def test_two_faces_do_not_swap_and_ids_are_not_reused():
    _, out = run([(i, [det(10 + 4 * i), det(400 - 4 * i)]) for i in range(10)])
    assert all(sorted(ids(r)) == [1, 2] for r in out.values())
    v, _ = run([(0, [det(10)]), *((i, []) for i in range(1, 93)), (93, [det(10)])])
    assert v.next_id == 3


def test_missed_face_snaps_to_the_head():
    v = tr.Video()
    v.frame(0, [det(100)], [], [], [])
    row = v.frame(1, [], [], [det(110, 60, 50, 50)], [])[0]
    assert row[3:7] == (105, 55, 60, 60)


def test_objects_soft_match_and_inherit():
    v = tr.Video()
    v.frame(0, [], [det(100, 100, 80, 80, label="screen")], [], [])
    v.command("enable", {"id": 1, "enabled": False})
    rows = v.frame(1, [], [det(150, 100, 80, 80, label="screen")], [], [])
    assert ids(rows) == [1] and not rows[0][8] and rows[0][12] == "screen #1"
    rows = v.frame(2, [], [det(150, 100, 80, 80), det(220, 100, 80, 80)], [], [])
    assert ids(rows) == [1, 2] and not rows[1][8]  # a new object near a kept one is kept


def test_large_boxes_far_apart_do_not_match_in_spite_of_overlap():
    v = tr.Video()
    v.frame(0, [], [det(0, 0, 2000, 2000)], [], [])
    assert ids(v.frame(1, [], [det(1200, 0, 2000, 2000)], [], [])) == [1, 2]


A, B = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]


def test_keep_policy_decisions():
    mid = [0.55, (1 - 0.55**2) ** 0.5, 0.0]
    cmds = [(0, "policy", {"policy": "keep"}), (1, "enrol", {"id": 1})]
    v, out = run([(i, [det(10, e=A), det(400, e=mid)]) for i in range(17)], commands=cmds)
    one, two = ({r[1]: r for r in out[16]}[k] for k in (1, 2))
    assert (one[8], one[10], one[12]) == (False, tr.ENROLLED, "Keep #1")
    assert (two[8], two[10]) == (True, tr.SUGGESTED)
    _, out = run([(i, [det(10, e=mid), det(400, e=mid)]) for i in range(17, 33)], v)
    assert {r[1]: r[8] for r in out[32]} == {1: False, 2: True}  # hysteresis for the linked one
    _, out = run([(i, [det(10, e=B), det(400, e=A)]) for i in range(33, 41)], v)
    assert {r[1]: (r[8], r[10]) for r in out[40]} == {1: (True, tr.NONE), 2: (False, tr.LINKED)}


def test_reject_small_and_leaving_keep_mode():
    cmds = [(0, "policy", {"policy": "keep"}), (1, "enrol", {"id": 1}), (2, "reject", {"id": 2}), (20, "policy", {"policy": "full"})]
    v, out = run([(i, [det(10, e=A), det(400, e=A), det(700, w=20, h=20, e=A)]) for i in range(21)], commands=cmds)
    assert {r[1]: r[8] for r in out[16]} == {1: False, 2: True, 3: True}
    assert all(r[8] for r in out[20]) and v.gallery == []


def test_jump_breaks_faces_in_keep_mode_only():
    for keep, want in ((True, [2]), (False, [1])):
        _, out = run([(0, [det(10)]), (5, [det(10)])], commands=[(0, "policy", {"policy": "keep"})] if keep else [])
        assert ids(out[5]) == want


def test_state_as_text_round_trips():
    v, _ = run([(i, [det(10 + i, e=A)]) for i in range(5)])
    assert tr.Video.load(v.dump()) == v


def test_batch_equals_streaming(spark, tmp_path):
    from veilspark.sources.views import motion
    from veilspark.streaming import tracks

    frames = tr.frames(motion(spark).selectExpr("cast(obj % 2 AS string) AS video_id", "frame_index", "x", "y", "w", "h", "score").where("frame_index < 60")).cache()
    batch = {tuple(r) for r in tr.track(frames).collect()}
    for k in range(3):
        frames.where(f"frame_index >= {20 * k} AND frame_index < {20 * k + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    tracks.with_store(spark)
    stream = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracks.track_stream(stream).writeStream.format("memory").queryName("tracked").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("tracked").collect()} == batch and batch


def test_keep_policy_meets_all_faces_and_identities(spark, sf):
    from pyspark.sql import functions as F

    from veilspark.plans import tracks
    from veilspark.sources import views as v

    got = tracks.keep_policy(spark, sf).cache()
    faces = v.detections(spark, sf).where("class_id = 16 AND score >= 0.6").selectExpr("cast(video_id AS string) AS video_id", "frame_index div 4 AS frame_index").distinct()
    assert faces.count() > 0 and faces.join(got, ["video_id", "frame_index"], "left_anti").count() == 0
    n = v.gallery(spark, sf).count()
    first = got.groupBy("video_id").agg(F.min("frame_index").alias("f"))
    assert first.count() == v.detections(spark, sf).where("class_id = 16").select("video_id").distinct().count()
    enrolled = got.join(first, "video_id").where(F.col("frame_index") == F.col("f") + 1).where(F.col("tier") == tr.ENROLLED)
    assert [r.n for r in enrolled.groupBy("video_id").agg(F.count_distinct("identity_id").alias("n")).collect()] == [n] * first.count()
    assert got.where(F.col("tier") == tr.LINKED).count() > 0


def test_keep_policy_scenario(spark):
    """Five moving objects with vectors: enrolled, rejected and switched off by command, then the gallery is cleared."""
    from pyspark.sql import functions as F

    from veilspark.sources import views as v

    axis = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.when(i == F.col("obj"), 1.0).otherwise(0.0))
    faces = v.motion(spark).selectExpr("'keep' AS video_id", "*").withColumn("e", axis)
    commands = spark.createDataFrame(
        [("keep", 0, 1, "policy", '{"policy":"keep"}'), ("keep", 3, 2, "enrol", '{"id":1}'), ("keep", 20, 3, "reject", '{"id":2}'), ("keep", 150, 4, "enable", '{"id":3,"enabled":false,"forced":true}'), ("keep", 200, 5, "clear_gallery", "{}")],
        "video_id string, frame_index long, seq long, op string, args string",
    )
    got = tr.track(tr.frames(faces, commands=commands))
    assert got.where("NOT enabled").count() > 0 and got.where(f"tier = {tr.ENROLLED}").count() > 0 and got.where("track_id = 2 AND NOT enabled").count() == 0


def test_lost_faces_are_let_go_after_the_last_command():
    faces = lambda i: [det(10, e=A), det(200, e=B)]
    v, w = tr.Video(keep=True), tr.Video(keep=True)
    w.no_more_commands()
    for i in range(0, 600, 2):  # every frame is a jump, so all faces are new
        assert v.frame(i, faces(i), [], [], []) == w.frame(i, faces(i), [], [], [])
    assert len(v.tracks) == 600 and len(w.tracks) == 2


def test_a_late_command_still_meets_a_lost_face(spark):
    faces = spark.createDataFrame([("a", i, 10, 50, 60, 60, 0.9, A) for i in (0, 1, 20, 21, 22)], "video_id string, frame_index long, x int, y int, w int, h int, score double, e array<double>")
    commands = spark.createDataFrame([("a", 0, 1, "policy", '{"policy":"keep"}'), ("a", 21, 2, "enable", '{"id":1,"enabled":false}')], "video_id string, frame_index long, seq long, op string, args string")
    rows = tr.frames(faces, commands=commands)
    assert [r.until for r in rows.select("until").distinct().collect()] == [21]
    got = {(r.frame_index, r.track_id): (r.tier, r.identity_id) for r in tr.track(rows).collect()}
    assert got[21, 2] == (tr.NONE, -1) and (24 % tr.CHECK_EVERY) == 0
    more = faces.unionByName(spark.createDataFrame([("a", 24, 10, 50, 60, 60, 0.9, A)], faces.schema))
    got = {(r.frame_index, r.track_id): (r.tier, r.identity_id) for r in tr.track(tr.frames(more, commands=commands)).collect()}
    assert got[24, 3] == (tr.LINKED, 1)


def test_lost_objects_cost_no_look_each(monkeypatch):
    """300 lost objects apart from where things happen: a frame tells the overlap of what meets only."""
    v = tr.Video()
    v.frame(0, [], [det(1000 + 100 * k, 900, label="screen") for k in range(300)], [], [])
    for i in range(1, tr.LIFE + 2):
        v.frame(i, [], [], [], [])
    seen, iou = [], tr._iou
    monkeypatch.setattr(tr, "_iou", lambda a, b: seen.append(1) or iou(a, b))
    for i in range(200, 210):
        assert ids(v.frame(i, [], [det(10), det(200)], [], [])) == [301, 302]
    assert len(seen) <= 40
    assert ids(v.frame(210, [], [det(1000, 900)], [], []))[0] == 1  # and a lost one comes back
    assert tr.Video.load(v.dump()) == v and v.tracks[5].miss == tr.LIFE + 12


def test_summary_counts_what_the_fold_gives_frame_by_frame(spark, sf, monkeypatch):
    """The rows of the batch, cut into many pieces of output, are those of the fold row by row; the fold holds no lost face."""
    from veilspark.plans import tracks

    monkeypatch.setattr(tr, "PART_ROWS", 100)
    given = []
    monkeypatch.setattr(tr, "track", lambda rows: given.append(rows) or rows)
    tracks.track_batch(spark, sf)
    rows = given[0].where("video_id = '1'").orderBy("frame_index")
    assert "until" in rows.columns
    video, want = tr.Video(), []
    for r in rows.collect():
        want += [("1", *x) for x in tr.run_frame(video, r)]
    got = [tuple(x.values()) for b in tr._run(iter(rows.toArrow().to_batches())) for x in b.to_pylist()]
    assert got == want and want


def test_without_commands_kinds_are_folds_of_their_own_and_rows_stay(spark):
    """Objects coast, are lost, come back and meet again; faces come and go: the rows are those of the whole fold, an object's stay is one row until then."""
    kind = "video_id string, frame_index long, x int, y int, w int, h int, score double, label string"
    at = [i for i in range(400) if not 150 <= i < 160]
    faces = [(v, i, (7 * i) % 500, 40 + i % 30, 50, 60, 0.9, None) for v in ("a", "b") for i in at if i % 7 != 3]
    objects = [(v, i, 90 * (i % 5), 200, 80, 80, 0.4 + i / 1000, "screen" if i % 2 else None) for v in ("a", "b") for i in at if i % 100 < 3 or i in (92, 93, 193, 295)]
    rows = tr.frames(spark.createDataFrame(faces, kind), spark.createDataFrame(objects, kind), spark.createDataFrame(faces[::3], kind)).cache()
    want = []
    for v in ("a", "b"):
        video = tr.Video()
        for r in rows.where(f"video_id = '{v}'").orderBy("frame_index").collect():
            want += [(v, *x) for x in tr.run_frame(video, r)]
    got = tr.track(rows)
    assert got.columns == tr.COLUMNS and sorted(map(tuple, got.collect())) == sorted(want)
    assert {r[3] for r in want} == {tr.FACE, tr.OBJECT} and max(r[10] for r in want) == tr.LIFE
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" in plan and "_run_apart" in plan  # a kind has a task of its own
    still = tr._Spans("a", tr.OBJECT, [])
    for i in range(5000):
        still.objects(i, [det(10)] if i % 60 == 0 else [])
    still.close()
    assert len(still.out) == 84 and sum(len(r[4]) for r in still.out) == 5000 and len(still.times) <= 20 * tr.LIFE


def test_summary_counts_in_the_fold(spark, sf):
    """The counts are those of the rows of the whole fold, with frames of heads only, lost and returning tracks; no video's rows are told apart or numbered in one task."""
    from veilspark.plans import tracks

    kind = "video_id string, frame_index long, x int, y int, w int, h int, score double, label string"
    at = [i for i in range(400) if not 150 <= i < 160]
    faces = [(v, i, (7 * i) % 500, 40 + i % 30, 50, 60, 0.9, None) for v in ("a", "b") for i in at if i % 7 != 3]
    objects = [(v, i, 90 * (i % 5), 200, 80, 80, 0.4 + i / 1000, "screen" if i % 2 else None) for v in ("a", "b") for i in at if i % 100 < 3 or i in (92, 93, 193, 295)]
    heads = [("a", i, 5, 5, 40, 40, 0.9, None) for i in range(150, 160)] + [("c", 3, 5, 5, 40, 40, 0.9, None)]
    flat = [spark.createDataFrame(d, kind) for d in (faces, objects, heads)]
    want = []
    for v in ("a", "b"):
        video, rows = tr.Video(), []
        for r in tr.frames(*flat).where(f"video_id = '{v}'").orderBy("frame_index").collect():
            rows += tr.run_frame(video, r)
        want.append((v, len({r[0] for r in rows}), len({r[1] for r in rows}), len(rows), sum(r[-1] for r in rows)))
    assert sorted(map(tuple, tr.summary(*flat).collect())) == want and want[0] != want[1]
    got = tracks.track_summary(spark, sf)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "dense_rank" not in plan and "posexplode" not in plan
    t = tracks.track_batch(spark, sf)
    same = t.groupBy("video_id").agg(*(F.expr(e) for e in ("count(DISTINCT frame_index)", "count(DISTINCT track_id)", "count_if(enabled)", "count_if(appeared)")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, same.collect()))


def test_overlaps_of_many_frames_are_told_at_once(monkeypatch):
    """A stretch of frames gives what its frames give one by one, also with boxes without sides; overlaps are told a few times, not once a frame."""
    rng = np.random.default_rng(3)
    box = lambda: {**det(0, score=0.9, label="screen"), "box": [float(x) for x in (rng.integers(-40, 400) + rng.choice([0, 0.5]), rng.integers(0, 300), rng.choice([0, 0.4, 30, 60, 90]), rng.choice([0, 40, 80]))]}
    frames = [(i, [box() for _ in range(rng.integers(0, 5))] if i % 300 < 150 else []) for i in range(900)]
    one, many, told, shares = tr.Video(), tr.Video(), [], tr._shares
    want = [[(t.id, t.shown, t.label, t.miss) for t in one._objects(dets, i)] + [t.id for t in one.present] for i, dets in frames]
    assert any(t.lost for t in one.objects)
    monkeypatch.setattr(tr, "_shares", lambda *a: told.append(1) or shares(*a))
    many.placed, got = False, []
    for k in range(0, 900, 50):
        for now in many.objects_ahead(frames[k : k + 50]):
            got.append([(t.id, t.shown, t.label, t.miss) for t in now] + [t.id for t in many.present])
    assert got == want and len(told) <= 18
