"""Queries over the face detection chain, and over small lists: statuses, counters, spans, snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import media as m
from ..operators import detect as d
from ..operators import faces as fc
from ..operators import library as lib
from ..sources import views as v
from .detections import _finalised, _nms_sql

W, H = v.FRAME_W, v.FRAME_H
SIZE = 320
KINDS = ("ssd", "yolo-face", "grid")


def face_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of three kinds of models, one kind per video and an unknown one, decoded at the fit of their frame."""
    rows = v.detections(spark, sf).withColumn("kind", F.element_at(F.array(*map(F.lit, (*KINDS, "other"))), (F.col("video_id") + 1).cast("int")))
    ssd = "array(CASE WHEN x % 9 = 0 THEN -1D ELSE 0D END, 1D, score, x/640D, y/480D, (x+w)/640D, (y+h)/480D)"
    grid = "array(cast(8 * pow(2, x % 3) AS double), cast(y % 40 AS double), cast(x % 40 AS double), score, 1.1D - score, x % 10 / 10D, y % 10 / 10D, w % 20 / 10D - 1, h % 20 / 10D - 1)"
    rows = rows.withColumn("values", F.expr(f"CASE kind WHEN 'ssd' THEN {ssd} WHEN 'grid' THEN {grid} ELSE array(x + 0D, y + 0D, w + 0D, h + 0D, score) END"))
    rows = rows.selectExpr(*d.FRAME, "x AS at_x", "y AS at_y", "w AS of_w", "h AS of_h", "kind", "values", "0 AS rx", "0 AS ry", "1280 AS rw", "720 AS rh", "false AS enlarge")
    fit = F.when(F.col("kind") == "grid", F.struct(F.lit(0.5).alias("scale"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y"))).otherwise(g.letterbox(F.col("rw"), F.col("rh"), 640, upscale=False))
    got = fc.decode(rows.withColumn("fit", fit).drop("rx", "ry", "rw", "rh", "enlarge"), 0.5, 640, 640)
    return got.select(*d.FRAME, "at_x", "at_y", "of_w", "of_h", "kind", *(F.round(c, 4).alias(c) for c in (*d.BOX, "score")))


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    frames = rows.select(*d.FRAME).distinct().withColumns({"width": F.lit(W), "height": F.lit(H)})
    return fc.regions(frames, rows.where("class_id = 62"), "grid", SIZE)


def face_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Where a grid model looks, with the scale of each region."""
    return fc.fitted(_regions(spark, sf), SIZE, "grid").select(*d.FRAME, "part", "rx", "ry", "rw", "rh", "enlarge", F.round("fit.scale", 6).alias("scale"))


def face_grouped(spark: SparkSession, sf: str) -> DataFrame:
    """Faces of all frames from all their regions. In place of a model, each region finds the boxes whose centre it holds."""
    boxes = v.detections(spark, sf).where("class_id = 16").select(*d.FRAME, *d.BOX, "score")
    hit = _regions(spark, sf).join(boxes, list(d.FRAME)).where("x + w*0.5D >= rx AND x + w*0.5D < rx + rw AND y + h*0.5D >= ry AND y + h*0.5D < ry + rh")
    found = hit.withColumns({"x": F.col("x") - F.col("rx"), "y": F.col("y") - F.col("ry")})
    return fc.faces(found, W, H)


def status_texts(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders").selectExpr("element_at(array('en','de'), cast(o_orderkey % 2 AS int)+1) AS code", "element_at(array('Waiting','Too long','Done','Odd'), cast(o_custkey % 4 AS int)+1) AS status")
    texts = spark.sql("SELECT * FROM VALUES ('en','statusWaiting','Waiting…'), ('de','statusWaiting','Wartet'), ('en','statusTooLong','Over the limit') AS t(code, key, text)")
    return lib.status_texts(o, texts).groupBy("code", "status", "text").agg(F.count("*").alias("n"))


def text_format(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer").selectExpr("c_custkey", "element_at(array('{0} of {1}', '{{x}} {0}', 'broken {', '{2} missing', 'plain', '{1}{0}'), cast(c_custkey % 6 AS int)+1) AS t", "array(c_name, '{0}') AS a")
    return c.select("c_custkey", m.formatted(F.col("t"), F.col("a")).alias("text"))


def coarse_span(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events")
    return lib.coarse_spans(e.selectExpr("user_id AS video_id"), e.where("event_type = 'purchase'").selectExpr("user_id AS video_id", "event_id % 97 + 3 AS span"))


def peak_utilisation(spark: SparkSession, sf: str) -> DataFrame:
    return lib.peak_utilisation(v.table(spark, sf, "events").selectExpr("user_id AS machine", "value AS percent", "event_id % 3 > 0 AS known")).select("machine", F.round("percent", 4).alias("percent"))


def written_frames(spark: SparkSession, sf: str) -> DataFrame:
    return lib.written_frames(v.detections(spark, sf).selectExpr("video_id AS run", "score >= 0.1 AS written"))


def snapshot_import(spark: SparkSession, sf: str) -> DataFrame:
    t = v.table(spark, sf, "orders").selectExpr("o_custkey AS video_id", "o_orderkey AS id", "cast(o_orderkey % 4 AS int) AS kind", "false AS lost", "cast(o_orderkey % 9 AS int) AS miss")
    ends = v.table(spark, sf, "customer").where("c_custkey % 2 = 0").selectExpr("c_custkey AS video_id", "c_custkey * 40 AS next_id")
    return lib.import_snapshot(t, ends, False).unionByName(lib.import_snapshot(t, ends, True))


def list_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Which rows the mask list shows, and which rectangles count as drawn, as dragged."""
    o = v.table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderkey % 4 AS kind", "o_custkey % 7 AS w", "o_orderkey % 6 AS h")
    return o.select("o_orderkey", m.in_mask_list(F.col("kind")).alias("in_mask_list"), g.drawn(F.col("w"), F.col("h")).alias("drawn"), g.dragged(F.col("w"), F.col("h")).alias("dragged"))


QUERIES = {f.__name__: f for f in (face_decode, face_regions, face_grouped, status_texts, text_format, coarse_span, peak_utilisation, written_frames, snapshot_import, list_gates)}
_REGIONS = f"""fr AS (SELECT DISTINCT video_id, frame_index FROM det), zz AS (SELECT *, least(w, {W}-x) AS zw, least(h, {H}-y) AS zh FROM det WHERE class_id=62),
reg AS (SELECT video_id, frame_index, 'full' AS part, 0 AS rx, 0 AS ry, {W} AS rw, {H} AS rh, false AS enlarge FROM fr
 UNION ALL SELECT video_id, frame_index, 'tile', tx, ty, {SIZE}, {SIZE}, false FROM fr, (SELECT unnest([0,256,320]) AS tx), (SELECT unnest([0,160]) AS ty)
 UNION ALL SELECT video_id, frame_index, 'zoom', x, y, zw, least(zh, {SIZE}), true FROM zz WHERE zw>=12 AND zh>=12)"""
_SHARE = lambda t, s: f"score >= CASE WHEN least(w,h) < 48 THEN greatest(0.22, {t}*{s}) ELSE {t} END"
ORACLE = {
    "face_decode": f"""WITH {v.DETECTIONS_SQL}, k AS (SELECT video_id, frame_index, x AS at_x, y AS at_y, w AS of_w, h AS of_h, score FROM det),
 ssd AS (SELECT * EXCLUDE (score), 'ssd' AS kind, at_x/640.0::DOUBLE*640/0.5 AS x, (at_y/480.0::DOUBLE*640-140)/0.5 AS y, ((at_x+of_w)/640.0::DOUBLE-at_x/640.0::DOUBLE)*640/0.5 AS w, ((at_y+of_h)/480.0::DOUBLE-at_y/480.0::DOUBLE)*640/0.5 AS h, score FROM k WHERE video_id=0 AND at_x%9<>0),
 yolo AS (SELECT * EXCLUDE (score), 'yolo-face' AS kind, (at_x-of_w*0.5::DOUBLE)/0.5 AS x, (at_y-of_h*0.5::DOUBLE-140)/0.5 AS y, of_w/0.5::DOUBLE AS w, of_h/0.5::DOUBLE AS h, score FROM k WHERE video_id=1),
 g1 AS (SELECT *, (8*pow(2,at_x%3))::DOUBLE AS st, exp(of_w%20/10.0::DOUBLE-1) AS ew, exp(of_h%20/10.0::DOUBLE-1) AS eh, sqrt(greatest(0,least(1,score))*greatest(0,least(1,1.1::DOUBLE-score))) AS sc FROM k WHERE video_id=2),
 grid AS (SELECT video_id, frame_index, at_x, at_y, of_w, of_h, 'grid' AS kind, ((at_x%40+at_x%10/10.0::DOUBLE)*st-ew*st/2)/0.5 AS x, ((at_y%40+at_y%10/10.0::DOUBLE)*st-eh*st/2)/0.5 AS y, ew*st/0.5 AS w, eh*st/0.5 AS h, sc AS score FROM g1),
 u AS (SELECT * FROM ssd WHERE {_SHARE(0.5, 0.62)} UNION ALL SELECT * FROM yolo WHERE {_SHARE(0.35, 0.55)} UNION ALL SELECT * FROM grid WHERE score >= 0.22)
 SELECT video_id, frame_index, at_x, at_y, of_w, of_h, kind, round(x,4) AS x, round(y,4) AS y, round(w,4) AS w, round(h,4) AS h, round(score,4) AS score FROM u""",
    "face_regions": f"WITH {v.DETECTIONS_SQL}, {_REGIONS} SELECT *, round(CASE WHEN enlarge THEN least({SIZE}::DOUBLE/rw, {SIZE}::DOUBLE/rh) ELSE least(1.0, {SIZE}::DOUBLE/rw, {SIZE}::DOUBLE/rh) END, 6) AS scale FROM reg",
    "face_grouped": f"""WITH RECURSIVE {v.DETECTIONS_SQL}, {_REGIONS}, hit AS (SELECT b.video_id, b.frame_index, b.x, b.y, b.w, b.h, 0 AS class_id, b.score FROM reg r JOIN det b USING (video_id, frame_index)
  WHERE b.class_id=16 AND x+w*0.5::DOUBLE>=rx AND x+w*0.5::DOUBLE<rx+rw AND y+h*0.5::DOUBLE>=ry AND y+h*0.5::DOUBLE<ry+rh AND NOT (part='zoom' AND rh>trunc(rw*1.28::DOUBLE) AND rh>=80 AND w*h>rw*rh*0.5::DOUBLE)),
 {_nms_sql('score >= 0.22', 0.42, 80, 'hit')}, {_finalised('nms', 'video_id, frame_index, score')} SELECT video_id, frame_index, score, rx AS x, ry AS y, rw AS w, rh AS h FROM f4""",
    "status_texts": "WITH o AS (SELECT CASE o_orderkey%2 WHEN 0 THEN 'en' ELSE 'de' END AS code, CASE o_custkey%4 WHEN 0 THEN 'Waiting' WHEN 1 THEN 'Too long' WHEN 2 THEN 'Done' ELSE 'Odd' END AS status FROM orders) SELECT code, status, CASE status WHEN 'Waiting' THEN CASE code WHEN 'de' THEN 'Wartet' ELSE 'Waiting…' END WHEN 'Too long' THEN 'Over the limit' WHEN 'Done' THEN 'statusDone' ELSE status END AS text, count(*) AS n FROM o GROUP BY ALL",
    "text_format": "SELECT c_custkey, CASE c_custkey%6 WHEN 0 THEN c_name || ' of {0}' WHEN 1 THEN '{x} ' || c_name WHEN 2 THEN 'broken {' WHEN 3 THEN '{2} missing' WHEN 4 THEN 'plain' ELSE '{0}' || c_name END AS text FROM customer",
    "coarse_span": "SELECT user_id AS video_id, coalesce(min(event_id%97+3) FILTER (event_type='purchase'), 0) AS coarse_span FROM events GROUP BY 1",
    "peak_utilisation": "SELECT user_id AS machine, round(greatest(0, least(100.0, coalesce(max(value) FILTER (event_id%3>0), 0))), 4) AS percent FROM events GROUP BY 1",
    "written_frames": f"WITH {v.DETECTIONS_SQL} SELECT video_id AS run, count(*) FILTER (score >= 0.1) AS frames FROM det GROUP BY 1",
    "snapshot_import": """WITH t AS (SELECT o_custkey AS video_id, o_orderkey AS id, (o_orderkey%4)::INT AS kind FROM orders), e AS (SELECT c_custkey AS video_id, c_custkey*40 AS nid FROM customer WHERE c_custkey%2=0),
 a AS (SELECT *, greatest(max(id) OVER (PARTITION BY video_id)+1, coalesce(nid, 1)) AS next_id FROM t LEFT JOIN e USING (video_id) WHERE kind=1), b AS (SELECT *, greatest(max(id) OVER (PARTITION BY video_id)+1, coalesce(nid, 1)) AS next_id FROM t LEFT JOIN e USING (video_id) WHERE kind IN (0,1))
 SELECT video_id, id, kind, true AS lost, 0 AS miss, next_id FROM a UNION ALL SELECT video_id, id, kind, true, 0, next_id FROM b""",
    "list_gates": "SELECT o_orderkey, o_orderkey%4 IN (2,3) AS in_mask_list, o_custkey%7>=2 AND o_orderkey%6>=2 AS drawn, o_custkey%7>4 AND o_orderkey%6>4 AS dragged FROM orders",
}
