"""Queries over detections: gates, geometry, suppression, look-where plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import detect as d
from ..sources import media_files as mf
from ..sources import views as v

W, H = v.FRAME_W, v.FRAME_H
DET = v.DETECTIONS_SQL


def _r(name: str, *cols: str) -> list:
    return [F.col(f"{name}.{c}").alias(c) for c in (cols or d.BOX)]


def det_gate(spark: SparkSession, sf: str) -> DataFrame:
    t = d.model_threshold(0.5, "yolo-face")
    rows = v.detections(spark, sf)
    return rows.withColumns({"object_ok": d.object_gate(F.col("class_id"), F.col("score")), "face_ok": d.face_gate(F.col("w"), F.col("h"), F.col("score"), t)})


def det_finalize(spark: SparkSession, sf: str) -> DataFrame:
    return d.finalise(v.detections(spark, sf), W, H)


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    a = rows.where("class_id = 0").select(*d.FRAME, d.box().alias("a"))
    b = rows.where("class_id = 62").select(*d.FRAME, d.box().alias("b"))
    p = a.join(b, list(d.FRAME))
    return p.select(
        *d.FRAME, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.col("a.w").alias("aw"), F.col("b.w").alias("bw"),
        F.round(g.iou(F.col("a"), F.col("b")), 6).alias("iou"), F.round(g.centre_distance(F.col("a"), F.col("b")), 4).alias("dist"), F.round(g.association_score(F.col("a"), F.col("b"), 0.16), 6).alias("assoc"),
    )


def nms_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return d.suppress(v.detections(spark, sf), d.OBJECT_NMS_MIN, d.OBJECT_NMS_IOU)


def nms_faces_topk(spark: SparkSession, sf: str) -> DataFrame:
    return d.suppress(v.detections(spark, sf), d.FACE_NMS_MIN, d.FACE_NMS_IOU, top=d.FACE_TOP)


def nms_prior_topk(spark: SparkSession, sf: str) -> DataFrame:
    return d.suppress(v.detections(spark, sf), 0.12, 0.45, top=200)


def containment_drop(spark: SparkSession, sf: str) -> DataFrame:
    return d.drop_containers(v.detections(spark, sf).where("class_id IN (0, 16)"))


def _people_and_faces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = v.detections(spark, sf)
    return rows.where("class_id = 0"), rows.where("class_id = 16")


def head_fallback(spark: SparkSession, sf: str) -> DataFrame:
    people, faces = _people_and_faces(spark, sf)
    return d.head_fallbacks(people, faces, W, H)


def head_fallback_first(spark: SparkSession, sf: str) -> DataFrame:
    """Persons that no detected face covers: an anti-join, before fallbacks cover each other."""
    people, faces = _people_and_faces(spark, sf)
    heads = d.regions(people.select(*d.FRAME, *d.BOX), "f", g.face_size, g.face_around, W, H).where("f.w >= 12 AND f.h >= 12")
    f = faces.select(*d.FRAME, d.box().alias("face"))
    return heads.join(f, (heads.video_id == f.video_id) & (heads.frame_index == f.frame_index) & d._covered(F.col("f"), F.col("face")), "left_anti").select(*d.FRAME, *d.BOX, F.col("f.x").alias("fx"), F.col("f.y").alias("fy"))


def _roi(spark: SparkSession, sf: str, made) -> DataFrame:
    people = v.detections(spark, sf).where("class_id = 0")
    return people.select(*d.FRAME, *d.BOX, made(d.box()).alias("r")).select(*d.FRAME, *d.BOX, *(F.col(f"r.{c}").alias(f"r{c}") for c in d.BOX))


def person_head_roi(spark: SparkSession, sf: str) -> DataFrame:
    return _roi(spark, sf, lambda b: g.head_roi(b, W, H))


def person_face_roi(spark: SparkSession, sf: str) -> DataFrame:
    return _roi(spark, sf, lambda b: g.face_roi(b, W, H))


def zoom_roi(spark: SparkSession, sf: str) -> DataFrame:
    return _roi(spark, sf, lambda b: g.zoom_around(b, W, H))


def pad_variants(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id = 0").select(*d.FRAME, d.box().alias("b"))
    return rows.select(*d.FRAME, *(F.col(f"b.{c}").alias(c) for c in d.BOX), g.pad_lookahead(F.col("b")).alias("p"), g.expand_fraction(F.col("b"), 0.18, W, H).alias("e")).select(
        *d.FRAME, *d.BOX, F.col("p.x").alias("px"), F.col("p.w").alias("pw"), F.col("p.h").alias("ph"), F.col("e.x").alias("ex"), F.col("e.y").alias("ey"), F.col("e.w").alias("ew"), F.col("e.h").alias("eh"))


def plate_zone(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id IN (2, 3, 5, 7)")
    return rows.select(*d.FRAME, *d.BOX, g.plate_zone(d.box()).alias("z")).select(*d.FRAME, *d.BOX, F.col("z.y").alias("zy"), F.col("z.h").alias("zh"))


def smallest_k_people(spark: SparkSession, sf: str) -> DataFrame:
    return d.zoom_persons(v.detections(spark, sf), W, H, most=3)


def roi_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    return d.zoom_budget(rows, rows.where("class_id = 16 AND w < 96").select(*d.FRAME, *d.BOX), W, H, most=6)


def class_route_union(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    return d.route(rows.where(d.object_gate(F.col("class_id"), F.col("score"))))


def class_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Names over all 80 classes and one number beyond them."""
    rows = v.detections(spark, sf).withColumn("class_id", (F.col("x") % 81).cast("int"))
    return d.with_label(rows).groupBy("class_id", "label").agg(F.count("*").alias("n"))


def class_argmax(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    scores = F.transform(F.sequence(F.lit(0), F.lit(79)), lambda k: ((F.col("x") * (k + 3) + F.col("y") * 7 + k * k) % 97) / 97.0)
    return d.placed(d.placed(rows, "scores", scores), "c", d.class_argmax(F.col("scores"))).select(*d.FRAME, *d.BOX, "score", F.col("c.class_id").alias("best_class"), F.round("c.score", 6).alias("best_score"))


def letterbox_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A centred box of each part-sized picture goes into the square and back."""
    parts = v.table(spark, sf, "part").selectExpr("p_partkey", "cast(320 + p_size*31 AS int) AS w", "cast(240 + (p_partkey*17) % 700 AS int) AS h")
    p = parts.withColumn("b", g.letterbox(F.col("w"), F.col("h"), 640))
    s = F.col("b.scale")
    back = g.unletterbox(F.col("w") * 0.5 * s + F.col("b.pad_x"), F.col("h") * 0.5 * s + F.col("b.pad_y"), F.col("w") * 0.25 * s, F.col("h") * 0.25 * s, F.col("b"), F.col("w"), F.col("h"))
    p = p.withColumn("r", back)
    return p.select("p_partkey", "w", "h", F.round("b.scale", 6).alias("scale"), "b.pad_x", "b.pad_y", *(F.col(f"r.{c}").alias(f"{c}_back") for c in d.BOX))


def tile_grid(spark: SparkSession, sf: str) -> DataFrame:
    sizes = v.table(spark, sf, "part").selectExpr("p_partkey AS key", "cast(320 + p_size*71 AS int) AS w", "cast(240 + (p_partkey*17) % 1900 AS int) AS h")
    return d.tiles(sizes, 640)


def tile_subsample(spark: SparkSession, sf: str) -> DataFrame:
    return d.spread(tile_grid(spark, sf), 6).select("key", "row", "col", "x", "y", "i")


def point_in_smallest_rect(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    tracks = rows.where("class_id = 0").groupBy(*d.FRAME, *d.BOX).agg(F.min(F.col("x") * 1000 + F.col("y")).alias("id"))
    points = rows.where("class_id = 62").groupBy(*d.FRAME).agg(F.min("x").alias("px"), F.min("y").alias("py")).withColumn("point_id", F.col("frame_index"))
    return d.smallest_at(tracks, points)


def greedy_match(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    a = rows.where("class_id = 0").select(*d.FRAME, d.box().alias("a"), (F.col("x") * 1000 + F.col("y")).alias("t")).distinct()
    b = rows.where("class_id = 62").select(*d.FRAME, d.box().alias("b"), (F.col("x") * 1000 + F.col("y")).alias("d")).distinct()
    pairs = a.join(b, list(d.FRAME)).select(*d.FRAME, "t", "d", F.round(g.association_score(F.col("a"), F.col("b"), 0.16), 6).alias("score"))
    return d.match_greedily(pairs)


def coast_boxes(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id = 16").withColumn("miss", F.col("x") % 4)
    r = g.coast(d.box(), (F.col("y") % 11) - 5.0, (F.col("w") % 7) - 3.0, F.col("miss"))
    return rows.select(*d.FRAME, *d.BOX, "miss", r.alias("r")).select(*d.FRAME, *d.BOX, "miss", *(F.col(f"r.{c}").alias(f"c{c}") for c in d.BOX))


def coast_snap(spark: SparkSession, sf: str) -> DataFrame:
    """Missed boxes snap to the nearest head of their frame."""
    rows = v.detections(spark, sf)
    heads = rows.where("class_id = 0").groupBy(*d.FRAME).agg(F.sort_array(F.collect_set(d.box())).alias("heads"))
    boxes = rows.where("class_id = 16").join(heads, list(d.FRAME)).withColumn("near", g.snap_to_head(d.box(), F.col("heads")))
    out = boxes.where("near IS NOT NULL").withColumn("r", g.recentre(d.box(), F.col("near")))
    return out.select(*d.FRAME, *d.BOX, *(F.col(f"r.{c}").alias(f"s{c}") for c in d.BOX))


def crop_ownership(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf)
    crops = rows.where("class_id = 0").groupBy("frame_index").agg(F.min("x").alias("crop_x"), F.min("y").alias("crop_y"), F.max("w").alias("crop_w"), F.max("h").alias("crop_h")).withColumns({"crop_id": F.col("frame_index"), "owner": F.col("frame_index")})
    dets = rows.where("class_id = 62").select(F.col("frame_index").alias("crop_id"), *d.BOX, "score")
    return d.crop_to_frame(dets, crops)


def grid_decode(spark: SparkSession, sf: str) -> DataFrame:
    cells = v.detections(spark, sf).where("class_id IN (0, 2)").selectExpr(
        "frame_index", "8 * cast(pow(2, x % 3) AS int) AS stride", "y % 40 AS row", "x % 40 AS col", "score AS cls", "1.1 - score AS obj",
        "cast((x % 10) AS double)/10 AS dx", "cast((y % 10) AS double)/10 AS dy", "cast((w % 20) AS double)/10 - 1 AS dw", "cast((h % 20) AS double)/10 - 1 AS dh")
    return d.grid_decode(cells.withColumns({c: F.col(c).cast("double") for c in ("cls", "obj")})).select("frame_index", "stride", "row", "col", *(F.round(c, 5).alias(c) for c in ("score", "bx", "by", "bw", "bh")))


def prior_decode(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id = 7").selectExpr(
        "frame_index", "x", "y", "score AS conf", "x/640.0D AS x0", "y/480.0D AS y0", "(x+w)/640.0D AS x1", "(y+h)/480.0D AS y1", "0.1D AS v0", "0.1D AS v1", "0.2D AS v2", "0.2D AS v3",
        "cast((x % 10) AS double)/10 - 0.5 AS l0", "cast((y % 10) AS double)/10 - 0.5 AS l1", "cast((w % 10) AS double)/10 - 0.5 AS l2", "cast((h % 10) AS double)/10 - 0.5 AS l3")
    return d.prior_decode(rows, 0.5).select("frame_index", "x", "y", *(F.round(c, 6).alias(c) for c in ("conf", "bx", "by", "bw", "bh")))


def landmark_points(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id = 0")
    values = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("x") + i * 7) % 10) / 10.0)
    p = rows.select(*d.FRAME, *d.BOX, F.posexplode(d.landmarks(values, d.box())).alias("k", "p"))
    return p.select(*d.FRAME, *d.BOX, "k", F.round("p.x", 4).alias("lx"), F.round("p.y", 4).alias("ly"))


def viewport_mapping(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.detections(spark, sf).where("class_id = 63").select(*d.FRAME, *d.BOX, g.viewport_box(900.0, 500.0, W, H).alias("b"))
    r = F.struct(*(F.col(c).cast("double").alias(c) for c in d.BOX))
    rows = rows.withColumns({"seen": g.video_to_view(r, F.col("b"), F.lit(W), F.lit(H)), "drawn": g.view_to_video(r, F.col("b"), F.lit(W), F.lit(H))})
    return rows.where("drawn IS NOT NULL").select(*d.FRAME, *d.BOX, *(F.round(f"seen.{c}", 4).alias(f"v{c}") for c in d.BOX), *(F.col(f"drawn.{c}").alias(f"d{c}") for c in d.BOX))


def redact_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: gate, suppress, finalise, count per frame."""
    rows = v.detections(spark, sf)
    gated = rows.where(d.face_gate(F.col("w"), F.col("h"), F.col("score"), 0.35))
    faces = d.finalise(d.suppress(gated, d.FACE_NMS_MIN, d.FACE_NMS_IOU, top=d.FACE_TOP), W, H)
    return faces.groupBy(*d.FRAME).agg(F.count("*").alias("n_boxes"), F.sum(F.col("w") * F.col("h")).alias("area"), F.round(F.max("score"), 4).alias("best"))


# ---- the same in DuckDB ----
CLIP = lambda x, y, w, h: f"greatest({x},0) AS cx, greatest({y},0) AS cy, least({x}+{w},{W})-greatest({x},0) AS cw, least({y}+{h},{H})-greatest({y},0) AS ch"


def _clipped(src: str, x: str, y: str, w: str, h: str, keep: str) -> str:
    """A CTE body: the box expressions of src clipped to the frame as rx, ry, rw, rh (zeros outside)."""
    return (f"SELECT {keep}, CASE WHEN cw>0 AND ch>0 THEN cx ELSE 0 END AS rx, CASE WHEN cw>0 AND ch>0 THEN cy ELSE 0 END AS ry, CASE WHEN cw>0 AND ch>0 THEN cw ELSE 0 END AS rw, CASE WHEN cw>0 AND ch>0 THEN ch ELSE 0 END AS rh "
            f"FROM (SELECT *, {CLIP(x, y, w, h)} FROM {src})")  # fmt: skip


def _finalised(src: str, keep: str) -> str:
    """CTEs f1..f4: src's boxes finalised as rx, ry, rw, rh."""
    return f"""f1 AS ({_clipped(src, 'x', 'y', 'w', 'h', keep)}),
f2 AS (SELECT *, CASE WHEN rw<64 OR rh<64 THEN 0.32::DOUBLE ELSE 0.16::DOUBLE END AS pad FROM f1 WHERE rw>2 AND rh>2 AND rh::DOUBLE/greatest(rw,1) BETWEEN 0.42 AND 1.85 AND NOT (rh > {H}*42//100 AND rh::DOUBLE/greatest(rw,1) > 1.35)),
f3 AS (SELECT *, greatest(3, round(rw*pad)::INT) AS dx, greatest(4, round(rh*pad)::INT) AS dy, greatest(2, greatest(4, round(rh*pad)::INT)//3) AS ey FROM f2),
f3b AS (SELECT {keep}, rx-dx AS x, ry-dy-ey//2 AS y, rw+2*dx AS w, rh+2*dy+ey AS h FROM f3),
f4 AS (SELECT * FROM ({_clipped('f3b', 'x', 'y', 'w', 'h', keep)}) WHERE rw>2 AND rh>2)"""


def _iou_sql(a: str, b: str) -> str:
    i = f"(greatest(0, least({a}.x+{a}.w, {b}.x+{b}.w)-greatest({a}.x,{b}.x)) * greatest(0, least({a}.y+{a}.h, {b}.y+{b}.h)-greatest({a}.y,{b}.y)))"
    return f"({i}::DOUBLE / ({a}.w*{a}.h + {b}.w*{b}.h - {i}))"


def _nms_sql(where: str, most: float, top: int | None, src: str = "det") -> str:
    """CTEs ranked, step, kept: greedy suppression one rank at a time."""
    return f"""cand AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY score DESC, x, y, w, h, class_id) AS rk FROM {src} WHERE {where}),
ranked AS (SELECT video_id, frame_index, list({{'x':x,'y':y,'w':w,'h':h,'class_id':class_id,'score':score}} ORDER BY rk) AS boxes FROM cand {f'WHERE rk <= {top}' if top else ''} GROUP BY ALL),
step AS (SELECT video_id, frame_index, boxes, 2 AS i, [boxes[1]] AS kept FROM ranked
  UNION ALL SELECT video_id, frame_index, boxes, i+1, CASE WHEN len(list_filter(kept, lambda k: {_iou_sql('k', 'boxes[i]')} > {most})) > 0 THEN kept ELSE list_append(kept, boxes[i]) END FROM step WHERE i <= len(boxes)),
kept AS (SELECT video_id, frame_index, unnest(kept) AS b FROM step WHERE i = len(boxes)+1),
nms AS (SELECT video_id, frame_index, b.x AS x, b.y AS y, b.w AS w, b.h AS h, b.class_id AS class_id, b.score AS score FROM kept)"""


def _banded(n: float, m: float, w: float) -> str:
    return f"(CASE WHEN h::DOUBLE/greatest(w,1) < 1.15 THEN {n} WHEN h::DOUBLE/greatest(w,1) < 1.55 THEN {m} ELSE {w} END)::DOUBLE"


_HEAD = f"""heads0 AS (SELECT *, greatest(16, trunc(h*{_banded(0.40, 0.30, 0.26)})::INT) AS hh, greatest(16, trunc(w*{_banded(0.62, 0.82, 1.0)})::INT) AS hw FROM people),
heads1 AS (SELECT *, x + w//2 - hw//2 - greatest(8, hw//5) AS bx, y - greatest(8, hh//5) AS b_y, hw + 2*greatest(8, hw//5) AS bw, hh + 2*greatest(8, hh//5) AS bh FROM heads0),
heads AS ({_clipped('heads1', 'bx', 'b_y', 'bw', 'bh', 'video_id, frame_index, x, y, w, h, score')})"""
_FACE = f"""faces0 AS (SELECT *, greatest(14, trunc(h*{_banded(0.28, 0.20, 0.16)})::INT) AS fh, greatest(14, trunc(w*{_banded(0.48, 0.52, 0.55)})::INT) AS fw FROM people),
faces1 AS (SELECT *, x + w//2 - fw//2 - greatest(2, fw//10) AS bx, y + h//40 - greatest(2, fw//10)//2 AS b_y, fw + 2*greatest(2, fw//10) AS bw, fh + greatest(2, fw//10) AS bh FROM faces0),
froi AS ({_clipped('faces1', 'bx', 'b_y', 'bw', 'bh', 'video_id, frame_index, x, y, w, h, score')})"""
_PEOPLE = "people AS (SELECT * FROM det WHERE class_id = 0)"
_COVER = """greatest(0, least(hx+hw, fx+fw)-greatest(hx,fx))*greatest(0, least(hy+hh, fy+fh)-greatest(hy,fy)) > 0 AND (
  (hw*hh+fw*fh-greatest(0, least(hx+hw, fx+fw)-greatest(hx,fx))*greatest(0, least(hy+hh, fy+fh)-greatest(hy,fy)) > 1 AND
   (greatest(0, least(hx+hw, fx+fw)-greatest(hx,fx))*greatest(0, least(hy+hh, fy+fh)-greatest(hy,fy)))::DOUBLE / (hw*hh+fw*fh-greatest(0, least(hx+hw, fx+fw)-greatest(hx,fx))*greatest(0, least(hy+hh, fy+fh)-greatest(hy,fy))) >= 0.12)
  OR (hx+hw*0.5 BETWEEN fx AND fx+fw AND hy+hh*0.5 BETWEEN fy AND fy+fh))"""


def _cover(h: str, f: str) -> str:
    out = _COVER
    for k in "xywh":
        out = out.replace(f"h{k}", f"\x00{k}").replace(f"f{k}", f"\x01{k}")
    return out.replace("\x00", f"{h}.").replace("\x01", f"{f}.")


_ASSOC = f"""pairs AS (SELECT a.video_id, a.frame_index, a AS a, b AS b, {_iou_sql('a', 'b')} AS iou,
  sqrt(pow(a.x+a.w*0.5-b.x-b.w*0.5,2)+pow(a.y+a.h*0.5-b.y-b.h*0.5,2)) AS dist, 0.70*greatest(sqrt(a.w*a.w+a.h*a.h), sqrt(b.w*b.w+b.h*b.h)) AS gate,
  (b.w::DOUBLE/greatest(a.w,4) > 0.28 AND b.w::DOUBLE/greatest(a.w,4) < 4.5 AND b.h::DOUBLE/greatest(a.h,4) > 0.28 AND b.h::DOUBLE/greatest(a.h,4) < 4.5) AS fits FROM pa a JOIN pb b USING (video_id, frame_index)),
scored AS (SELECT *, CASE WHEN iou >= 0.45 THEN iou+0.20 WHEN iou >= 0.16 AND fits THEN iou+0.15 WHEN NOT fits OR dist > gate THEN 0.0 ELSE 0.12+0.35*(1-dist/greatest(gate,1.0)) END::DOUBLE AS assoc FROM pairs)"""
_STARTS = lambda size: f"(CASE WHEN {size} <= 640 THEN [0] ELSE list_sort(list_distinct(list_concat(list_filter(generate_series(0, {size}, greatest(1, round(least(640,{size})*(1-0.2::DOUBLE))::INT)), lambda p: p < {size}-640), [{size}-640]))) END)"
_TILES = f"""sizes AS (SELECT p_partkey AS key, (320+p_size*71)::INT AS w, (240+(p_partkey*17)%1900)::INT AS h FROM part),
ys AS (SELECT key, w, h, unnest({_STARTS('h')}) AS y, generate_subscripts({_STARTS('h')}, 1)-1 AS row FROM sizes),
grid AS (SELECT key, row::INT AS row, (generate_subscripts({_STARTS('w')}, 1)-1)::INT AS col, unnest({_STARTS('w')})::INT AS x, y::INT AS y, least(640,w)::INT AS tw, least(640,h)::INT AS th FROM ys)"""
_GATE = "CASE WHEN class_id = 0 THEN score >= 0.15 ELSE score >= 0.35 AND class_id IN (2,3,5,7,62,63,66,67) END"
_FACEGATE = lambda t: f"score >= CASE WHEN least(w,h) < 48 THEN greatest(0.22, {t}*0.55) ELSE {t} END"

def debug_report(spark: SparkSession, sf: str) -> DataFrame:
    """Persons, zooms, faces, faces at a low threshold and tracks of every frame, as lines."""
    rows = v.detections(spark, sf)
    tracks = rows.where("class_id = 63").selectExpr(*d.FRAME, "x * 1000L + y AS id", *d.BOX).distinct()
    return mf.debug_report(rows, rows, tracks, 0.35, W, H)


def detect_chain(spark: SparkSession, sf: str) -> DataFrame:
    """From raw rows in the input of a detector to the objects of frames of two sizes, some too small."""
    rows = v.detections(spark, sf).withColumns({"width": F.expr("cast(640 + video_id % 2 * 640 AS int)"), "height": F.expr("cast(480 + video_id div 2 * 240 AS int)")})
    fit = g.letterbox(F.col("width"), F.col("height"), 640)
    raw = d.placed(rows, "f", fit).selectExpr(*d.FRAME, "width", "height", "class_id", "score", "x + w * 0.5D AS cx", "y + h * 0.5D AS cy", "CASE WHEN x % 5 = 0 THEN 3.75D ELSE w + 0D END AS bw", "h + 0.25D AS bh", "f.scale", "f.pad_x", "f.pad_y")
    return d.object_boxes(raw)


QUERIES = {
    f.__name__: f
    for f in (
        redact_counts, det_gate, det_finalize, iou_pairs, nms_boxes, nms_faces_topk, nms_prior_topk, containment_drop, head_fallback, head_fallback_first, person_head_roi, person_face_roi, zoom_roi, pad_variants,
        plate_zone, smallest_k_people, roi_budget, class_route_union, class_labels, class_argmax, letterbox_roundtrip, tile_grid, tile_subsample, point_in_smallest_rect, greedy_match, coast_boxes, coast_snap,
        crop_ownership, grid_decode, prior_decode, landmark_points, viewport_mapping, detect_chain, debug_report,
    )
}
_RECT = "rx AS x, ry AS y, rw AS w, rh AS h"
_BACK = lambda c, n, pad: f"trunc(({c} - {n}*0.5 - {pad})/s)::INT"
_RETURNED = ", ".join((f"greatest(0, {_BACK('w*0.5*s + (640-round(w*s)::INT)//2', 'w*0.25*s', '(640-round(w*s)::INT)//2')}) AS x_back", f"greatest(0, {_BACK('h*0.5*s + (640-round(h*s)::INT)//2', 'h*0.25*s', '(640-round(h*s)::INT)//2')}) AS y_back", "trunc(w*0.25*s/s)::INT AS w_back", "trunc(h*0.25*s/s)::INT AS h_back"))
_CHAIN = f"""sized AS (SELECT *, (640+video_id%2*640)::INT AS fw, (480+video_id//2*240)::INT AS fh FROM det WHERE {_GATE}), scaled AS (SELECT *, least(640::DOUBLE/fw, 640::DOUBLE/fh) AS s FROM sized),
padded AS (SELECT *, (640-round(fw*s)::INT)//2 AS px, (640-round(fh*s)::INT)//2 AS py, CASE WHEN x%5=0 THEN 3.75::DOUBLE ELSE w END AS bw, h+0.25::DOUBLE AS bh FROM scaled),
back AS (SELECT video_id, frame_index, class_id, score, fw, fh, trunc((x+w*0.5::DOUBLE-bw*0.5-px)/s)::INT AS x1, trunc((y+h*0.5::DOUBLE-bh*0.5-py)/s)::INT AS y1, trunc(bw/s)::INT AS w1, trunc(bh/s)::INT AS h1 FROM padded),
chain AS (SELECT video_id, frame_index, class_id, score, greatest(x1,0) AS x, greatest(y1,0) AS y, least(x1+w1,fw)-greatest(x1,0) AS w, least(y1+h1,fh)-greatest(y1,0) AS h FROM back WHERE least(x1+w1,fw)-greatest(x1,0) >= 4 AND least(y1+h1,fh)-greatest(y1,0) >= 4)"""
def _found_sql(low: float) -> str:
    return f"(WITH RECURSIVE {DET}, g AS (SELECT * FROM det WHERE {_FACEGATE(low)}), {_nms_sql('score >= 0.22', 0.42, 80, 'g')}, {_finalised('nms', 'video_id, frame_index, score')} SELECT video_id, frame_index, rx AS x, ry AS y, rw AS w, rh AS h FROM f4)"


_LINE = "x||','||y||','||w||','||h AS line"
_DEBUG = f"""SELECT video_id, frame_index, 0 AS section, 'persons' AS name, {_LINE} FROM (WITH {DET} SELECT * FROM det WHERE class_id = 0)
 UNION ALL SELECT video_id, frame_index, 1, 'zooms', rx||','||ry||','||rw||','||rh FROM (WITH {DET}, people AS (SELECT * FROM det WHERE class_id=0 AND NOT (h::DOUBLE/greatest(w,1) > 1.4 AND h >= {max(200, H * 50 // 100)})), {_HEAD}
  SELECT * FROM heads WHERE rw>=12 AND rh>=12 QUALIFY row_number() OVER (PARTITION BY video_id, frame_index ORDER BY h, x, y, w, h, score) <= 8)
 UNION ALL SELECT video_id, frame_index, 2, 'faces', {_LINE} FROM {_found_sql(0.35)} UNION ALL SELECT video_id, frame_index, 3, 'low faces', {_LINE} FROM {_found_sql(0.12)}
 UNION ALL SELECT video_id, frame_index, 4, 'tracks', id||':'||{_LINE} FROM (WITH {DET} SELECT DISTINCT video_id, frame_index, x*1000::BIGINT+y AS id, x, y, w, h FROM det WHERE class_id=63)"""
ORACLE = {
    "redact_counts": f"WITH RECURSIVE {DET}, g AS (SELECT * FROM det WHERE {_FACEGATE(0.35)}), {_nms_sql('score >= 0.22', 0.42, 80, 'g')}, {_finalised('nms', 'video_id, frame_index, score')} SELECT video_id, frame_index, count(*) AS n_boxes, sum(rw*rh)::BIGINT AS area, round(max(score),4) AS best FROM f4 GROUP BY ALL",
    "det_gate": f"WITH {DET} SELECT *, {_GATE} AS object_ok, {_FACEGATE(0.35)} AS face_ok FROM det",
    "det_finalize": f"WITH {DET}, {_finalised('det', 'video_id, frame_index, class_id, score')} SELECT video_id, frame_index, class_id, score, {_RECT} FROM f4",
    "iou_pairs": f"WITH {DET}, pa AS (SELECT * FROM det WHERE class_id=0), pb AS (SELECT * FROM det WHERE class_id=62), {_ASSOC} SELECT video_id, frame_index, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by, a.w AS aw, b.w AS bw, round(iou,6) AS iou, round(dist,4) AS dist, round(assoc,6) AS assoc FROM scored",
    "detect_chain": f"WITH RECURSIVE {DET}, {_CHAIN}, {_nms_sql('score >= 0.18', 0.45, None, 'chain')} SELECT * FROM nms",
    "debug_report": _DEBUG,
    "nms_boxes": f"WITH RECURSIVE {DET}, {_nms_sql('score >= 0.18', 0.45, None)} SELECT * FROM nms",
    "nms_faces_topk": f"WITH RECURSIVE {DET}, {_nms_sql('score >= 0.22', 0.42, 80)} SELECT * FROM nms",
    "nms_prior_topk": f"WITH RECURSIVE {DET}, {_nms_sql('score >= 0.12', 0.45, 200)} SELECT * FROM nms",
    "containment_drop": f"""WITH {DET}, c AS (SELECT *, row_number() OVER () AS id FROM det WHERE class_id IN (0,16)),
 bad AS (SELECT DISTINCT i.id FROM c i JOIN c j ON i.video_id=j.video_id AND i.frame_index=j.frame_index AND i.id<>j.id AND greatest(1,i.w*i.h) >= greatest(1,j.w*j.h)*2.2::DOUBLE AND j.x+j.w*0.5 BETWEEN i.x AND i.x+i.w AND j.y+j.h*0.5 BETWEEN i.y AND i.y+i.h),
 m AS (SELECT c.*, bad.id IS NOT NULL AS gone, bool_and(bad.id IS NOT NULL) OVER (PARTITION BY video_id, frame_index) AS all_gone FROM c LEFT JOIN bad USING (id))
 SELECT video_id, frame_index, x, y, w, h, class_id, score FROM m WHERE NOT gone OR all_gone""",
    "head_fallback": f"""WITH RECURSIVE {DET}, {_PEOPLE}, {_FACE},
 hs AS (SELECT video_id, frame_index, list({{'x':rx,'y':ry,'w':rw,'h':rh}} ORDER BY x,y,w,h,rx,ry,rw,rh) AS heads FROM froi WHERE rw>=12 AND rh>=12 GROUP BY ALL),
 fs AS (SELECT video_id, frame_index, list({{'x':x,'y':y,'w':w,'h':h}}) AS faces FROM det WHERE class_id=16 GROUP BY ALL),
 s AS (SELECT hs.video_id, hs.frame_index, heads, 1 AS i, coalesce(faces, []) AS known, list_filter(heads, lambda z: false) AS made FROM hs LEFT JOIN fs USING (video_id, frame_index)
  UNION ALL SELECT video_id, frame_index, heads, i+1, known, CASE WHEN len(list_filter(list_concat(known, made), lambda f: {_cover('heads[i]', 'f')})) > 0 THEN made ELSE list_append(made, heads[i]) END FROM s WHERE i <= len(heads)),
 o AS (SELECT video_id, frame_index, unnest(made) AS b FROM s WHERE i = len(heads)+1)
 SELECT video_id, frame_index, b.x AS x, b.y AS y, b.w AS w, b.h AS h, 0.18::DOUBLE AS score FROM o""",
    "head_fallback_first": f"""WITH {DET}, {_PEOPLE}, {_FACE}, p AS (SELECT *, {{'x':rx,'y':ry,'w':rw,'h':rh}} AS hd FROM froi WHERE rw>=12 AND rh>=12)
 SELECT video_id, frame_index, x, y, w, h, rx AS fx, ry AS fy FROM p WHERE NOT EXISTS (SELECT 1 FROM det f WHERE f.class_id=16 AND f.video_id=p.video_id AND f.frame_index=p.frame_index AND {_cover('p.hd', 'f')})""",
    "person_head_roi": f"WITH {DET}, {_PEOPLE}, {_HEAD} SELECT video_id, frame_index, x, y, w, h, rx, ry, rw, rh FROM heads",
    "person_face_roi": f"WITH {DET}, {_PEOPLE}, {_FACE} SELECT video_id, frame_index, x, y, w, h, rx, ry, rw, rh FROM froi",
    "zoom_roi": f"WITH {DET}, {_PEOPLE}, z AS (SELECT *, x-greatest(20,w*3//4) AS bx, y-greatest(20,h*3//4) AS b_y, w+2*greatest(20,w*3//4) AS bw, h+2*greatest(20,h*3//4) AS bh FROM people), zz AS ({_clipped('z', 'bx', 'b_y', 'bw', 'bh', 'video_id, frame_index, x, y, w, h')}) SELECT * FROM zz",
    "pad_variants": f"WITH {DET}, {_PEOPLE}, z AS (SELECT *, greatest(4,round(w*0.18::DOUBLE)::INT) AS ax, greatest(4,round(h*0.18::DOUBLE)::INT) AS ay FROM people), z2 AS (SELECT *, x-ax AS bx, y-ay AS b_y, w+2*ax AS bw, h+2*ay AS bh FROM z), e AS ({_clipped('z2', 'bx', 'b_y', 'bw', 'bh', 'video_id, frame_index, x, y, w, h')}) SELECT video_id, frame_index, x, y, w, h, x-greatest(6,w//5) AS px, w+2*greatest(6,w//5) AS pw, h+2*greatest(6,h//5) AS ph, rx AS ex, ry AS ey, rw AS ew, rh AS eh FROM e",
    "plate_zone": f"WITH {DET} SELECT video_id, frame_index, x, y, w, h, y+h-greatest(4,trunc(h*0.35::DOUBLE)::INT) AS zy, greatest(4,trunc(h*0.35::DOUBLE)::INT) AS zh FROM det WHERE class_id IN (2,3,5,7)",
    "smallest_k_people": f"WITH {DET}, {_PEOPLE}, {_HEAD}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY h, x, y, w, h, score)::INT AS rank FROM heads WHERE rw>=12 AND rh>=12 AND NOT (h::DOUBLE/greatest(w,1) > 1.4 AND h >= 240)) SELECT video_id, frame_index, {_RECT}, rank FROM k WHERE rank <= 3",
    "roi_budget": f"""WITH {DET}, {_PEOPLE}, {_HEAD}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY h, x, y, w, h, score) AS ord FROM heads WHERE rw>=12 AND rh>=12 AND NOT (h::DOUBLE/greatest(w,1) > 1.4 AND h >= 240)),
 fo AS (SELECT *, x-greatest(20,w*3//4) AS bx, y-greatest(20,h*3//4) AS b_y, w+2*greatest(20,w*3//4) AS bw, h+2*greatest(20,h*3//4) AS bh FROM det WHERE class_id=16 AND w<96), fz AS ({_clipped('fo', 'bx', 'b_y', 'bw', 'bh', 'video_id, frame_index, x, y, w, h')}),
 u AS (SELECT video_id, frame_index, rx, ry, rw, rh, 0 AS kind, ord FROM k WHERE ord <= 4 UNION ALL SELECT video_id, frame_index, rx, ry, rw, rh, 1, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY x,y,w,h) FROM fz WHERE rw>=12 AND rh>=12),
 p AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_index ORDER BY kind, ord)::INT AS place FROM u) SELECT video_id, frame_index, {_RECT}, kind, place FROM p WHERE place <= 6""",
    "class_route_union": f"WITH {DET}, k AS (SELECT * FROM det WHERE {_GATE}) SELECT video_id, frame_index, x, y, w, h, score, 'screen' AS target FROM k WHERE class_id IN (62,63,66,67) UNION ALL SELECT video_id, frame_index, x, y+h-greatest(4,trunc(h*0.35::DOUBLE)::INT), w, greatest(4,trunc(h*0.35::DOUBLE)::INT), score, 'plate-zone' FROM k WHERE class_id IN (2,3,5,7)",
    "class_labels": f"WITH {DET} SELECT (x % 81)::INT AS class_id, coalesce({d.CLASS_NAMES!r}[x % 81 + 1], 'object') AS label, count(*) AS n FROM det GROUP BY ALL",
    "class_argmax": f"WITH {DET}, s AS (SELECT *, list_transform(generate_series(0,79), lambda k: ((x*(k+3)+y*7+k*k)%97)/97.0::DOUBLE) AS sc FROM det) SELECT video_id, frame_index, x, y, w, h, score, (list_position(sc, list_max(sc))-1)::INT AS best_class, round(list_max(sc),6) AS best_score FROM s",
    "letterbox_roundtrip": f"WITH p AS (SELECT p_partkey, (320+p_size*31)::INT AS w, (240+(p_partkey*17)%700)::INT AS h FROM part), b AS (SELECT *, least(640.0::DOUBLE/w, 640.0::DOUBLE/h) AS s FROM p) SELECT p_partkey, w, h, round(s,6) AS scale, (640-round(w*s)::INT)//2 AS pad_x, (640-round(h*s)::INT)//2 AS pad_y, {_RETURNED} FROM b",
    "tile_grid": f"WITH {_TILES} SELECT * FROM grid",
    "tile_subsample": f"WITH {_TILES}, o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row, col)-1 AS i, count(*) OVER (PARTITION BY key) AS n FROM grid) SELECT key, row, col, x, y, i::INT AS i FROM o WHERE n <= 6 OR list_contains(list_transform(generate_series(0,5), lambda k: k*(n-1)//5), i)",
    "point_in_smallest_rect": f"WITH {DET}, t AS (SELECT video_id, frame_index, x, y, w, h, min(x*1000+y) AS id FROM det WHERE class_id=0 GROUP BY ALL), p AS (SELECT video_id, frame_index, min(x) AS px, min(y) AS py FROM det WHERE class_id=62 GROUP BY ALL) SELECT frame_index AS point_id, arg_min(id, w*h*1000000::BIGINT+id) AS id, min(w*h) AS area FROM p JOIN t USING (video_id, frame_index) WHERE px>=x AND px<x+w AND py>=y AND py<y+h GROUP BY frame_index, video_id",
    "greedy_match": f"""WITH RECURSIVE {DET}, pa AS (SELECT DISTINCT video_id, frame_index, x, y, w, h FROM det WHERE class_id=0), pb AS (SELECT DISTINCT video_id, frame_index, x, y, w, h FROM det WHERE class_id=62), {_ASSOC},
 l AS (SELECT video_id, frame_index, list({{'t':a.x*1000+a.y,'d':b.x*1000+b.y,'s':round(assoc,6)}} ORDER BY round(assoc,6) DESC, a.x*1000+a.y, b.x*1000+b.y) AS p FROM scored WHERE round(assoc,6) > 1e-6 GROUP BY ALL),
 s AS (SELECT video_id, frame_index, p, 2 AS i, [p[1]] AS m FROM l UNION ALL SELECT video_id, frame_index, p, i+1, CASE WHEN len(list_filter(m, lambda o: o.t=p[i].t OR o.d=p[i].d)) > 0 THEN m ELSE list_append(m, p[i]) END FROM s WHERE i <= len(p)),
 o AS (SELECT video_id, frame_index, unnest(m) AS b FROM s WHERE i = len(p)+1) SELECT video_id, frame_index, b.t AS t, b.d AS d, b.s AS score FROM o""",
    "coast_boxes": f"WITH {DET}, c AS (SELECT *, x%4 AS miss, greatest(3, least(w,h)//8) AS pad FROM det WHERE class_id=16) SELECT video_id, frame_index, x, y, w, h, miss, CASE WHEN miss>0 THEN x+round((y%11-5.0)*miss)::INT-pad ELSE x END AS cx, CASE WHEN miss>0 THEN y+round((w%7-3.0)*miss)::INT-pad ELSE y END AS cy, CASE WHEN miss>0 THEN w+2*pad ELSE w END AS cw, CASE WHEN miss>0 THEN h+2*pad ELSE h END AS ch FROM c",
    "coast_snap": f"""WITH {DET}, hd AS (SELECT DISTINCT video_id, frame_index, x, y, w, h FROM det WHERE class_id=0), bx AS (SELECT *, row_number() OVER () AS id FROM det WHERE class_id=16),
 n AS (SELECT b.*, hh AS hd, sqrt(pow(b.x+b.w*0.5-hh.x-hh.w*0.5,2)+pow(b.y+b.h*0.5-hh.y-hh.h*0.5,2)) AS dist FROM bx b JOIN hd hh USING (video_id, frame_index)),
 k AS (SELECT * FROM n WHERE dist <= greatest(w, hd.w)*0.85::DOUBLE+28 QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, hd.x, hd.y, hd.w, hd.h)=1)
 SELECT video_id, frame_index, x, y, w, h, CASE WHEN keep THEN hd.x+hd.w//2-w//2 ELSE hd.x END AS sx, CASE WHEN keep THEN hd.y+hd.h//2-h//2 ELSE hd.y END AS sy, CASE WHEN keep THEN w ELSE hd.w END AS sw, CASE WHEN keep THEN h ELSE hd.h END AS sh FROM (SELECT *, w>8 AND h>8 AND w*h < hd.w*hd.h*2 AS keep FROM k)""",
    "crop_ownership": f"WITH {DET}, c AS (SELECT frame_index, min(x) AS cx, min(y) AS cy, max(w) AS cw, max(h) AS ch FROM det WHERE class_id=0 GROUP BY ALL) SELECT frame_index AS owner, x+cx AS x, y+cy AS y, w, h, score FROM det JOIN c USING (frame_index) WHERE class_id=62 AND NOT (ch > cw*1.28::DOUBLE AND ch>=80 AND w*h > 0.5*cw*ch)",
    "grid_decode": f"WITH {DET}, c AS (SELECT frame_index, (8*pow(2,x%3))::INT AS stride, y%40 AS row, x%40 AS col, score AS cls, (1.1-score)::DOUBLE AS obj, (x%10)::DOUBLE/10 AS dx, (y%10)::DOUBLE/10 AS dy, (w%20)::DOUBLE/10-1 AS dw, (h%20)::DOUBLE/10-1 AS dh FROM det WHERE class_id IN (0,2)), o AS (SELECT *, sqrt(greatest(0,least(1,cls))*greatest(0,least(1,obj))) AS sc, exp(dw)*stride AS ww, exp(dh)*stride AS hh FROM c) SELECT frame_index, stride, row, col, round(sc,5) AS score, round((col+dx)*stride-ww/2,5) AS bx, round((row+dy)*stride-hh/2,5) AS by, round(ww,5) AS bw, round(hh,5) AS bh FROM o WHERE sc >= 0.22",
    "prior_decode": f"WITH {DET}, c AS (SELECT *, x/640.0::DOUBLE AS x0, y/480.0::DOUBLE AS y0, (x+w)/640.0::DOUBLE AS x1, (y+h)/480.0::DOUBLE AS y1, (x%10)::DOUBLE/10-0.5 AS l0, (y%10)::DOUBLE/10-0.5 AS l1, (w%10)::DOUBLE/10-0.5 AS l2, (h%10)::DOUBLE/10-0.5 AS l3 FROM det WHERE class_id=7 AND score >= 0.12), o AS (SELECT *, exp(0.2::DOUBLE*l2)*(x1-x0) AS ww, exp(0.2::DOUBLE*l3)*(y1-y0) AS hh FROM c) SELECT frame_index, x, y, round(score,6) AS conf, round(0.1::DOUBLE*l0*(x1-x0)+(x0+x1)/2-ww/2,6) AS bx, round(0.1::DOUBLE*l1*(y1-y0)+(y0+y1)/2-hh/2,6) AS by, round(ww,6) AS bw, round(hh,6) AS bh FROM o",
    "landmark_points": f"WITH {DET} SELECT video_id, frame_index, x, y, w, h, k::INT AS k, round(x+((x+2*k*7)%10)/10.0::DOUBLE*w,4) AS lx, round(y+((x+(2*k+1)*7)%10)/10.0::DOUBLE*h,4) AS ly FROM det, (SELECT unnest(generate_series(0,4)) AS k) WHERE class_id=0",
    "viewport_mapping": f"""WITH {DET}, b AS (SELECT *, 500.0::DOUBLE*(640.0::DOUBLE/480) AS dw, 500.0::DOUBLE AS dh, (900-500.0::DOUBLE*(640.0::DOUBLE/480))/2 AS ox FROM det WHERE class_id=63),
 c AS (SELECT *, greatest(x,ox) AS x1, greatest(y,0) AS y1, least(x+w,ox+dw) AS x2, least(y+h,dh) AS y2 FROM b)
 SELECT video_id, frame_index, x, y, w, h, round(ox+x*(dw/640),4) AS vx, round(y*(dh/480),4) AS vy, round(greatest(2.0,w*(dw/640)),4) AS vw, round(greatest(2.0,h*(dh/480)),4) AS vh,
 CASE WHEN x2>=x1 AND y2>=y1 THEN trunc((x1-ox)*(640/dw))::INT END AS dx, CASE WHEN x2>=x1 AND y2>=y1 THEN trunc(y1*(480/dh))::INT END AS dy, CASE WHEN x2>=x1 AND y2>=y1 THEN greatest(1,trunc((x2-x1)*(640/dw))::INT) END AS dw, CASE WHEN x2>=x1 AND y2>=y1 THEN greatest(1,trunc((y2-y1)*(480/dh))::INT) END AS dh FROM c WHERE x2>=x1 AND y2>=y1""",
}
