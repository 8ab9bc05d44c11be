"""Detection operators: gates, class routing, suppression, fallbacks, look-where plans. All as Column expressions and joins.

Detections are flat rows (video_id, frame_index, x, y, w, h, class_id, score). Orders that the
result depends on are total: score first, then position, size and class.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g

FRAME = ("video_id", "frame_index")
BOX = ("x", "y", "w", "h")

# Classes by role and the thresholds of the gates.
PERSON, VEHICLES, SCREENS = 0, (2, 3, 5, 7), (62, 63, 66, 67)
PERSON_MIN, OBJECT_MIN, OBJECT_NMS_MIN, OBJECT_NMS_IOU = 0.15, 0.35, 0.18, 0.45
FACE_NMS_MIN, FACE_NMS_IOU, FACE_TOP, FALLBACK_SCORE = 0.22, 0.42, 80, 0.18
# The 80 class names of the COCO data set, in the order of their numbers.
CLASS_NAMES = (
    "person, bicycle, car, motorcycle, airplane, bus, train, truck, boat, traffic light, fire hydrant, stop sign, parking meter, bench, bird, cat, dog, "
    "horse, sheep, cow, elephant, bear, zebra, giraffe, backpack, umbrella, handbag, tie, suitcase, frisbee, skis, snowboard, sports ball, kite, "
    "baseball bat, baseball glove, skateboard, surfboard, tennis racket, bottle, wine glass, cup, fork, knife, spoon, bowl, banana, apple, sandwich, "
    "orange, broccoli, carrot, hot dog, pizza, donut, cake, chair, couch, potted plant, bed, dining table, toilet, tv, laptop, mouse, remote, keyboard, "
    "cell phone, microwave, oven, toaster, sink, refrigerator, book, clock, vase, scissors, teddy bear, hair drier, toothbrush"
).split(", ")
LABELS = dict(enumerate(CLASS_NAMES))

OBJECT_LEAST = 4  # fixed value: sides of an object, in pixels


def box() -> Column:
    return F.struct(*BOX)


def placed(rows: DataFrame, name: str, r: Column) -> DataFrame:
    """rows with a column more. A generator of one row keeps the optimizer from writing r out wherever it is used."""
    return rows.select("*", F.explode(F.array(r)).alias(name))


def reboxed(rows: DataFrame, r: Column) -> DataFrame:
    """rows with their box replaced, in the same way."""
    return rows.select(*(c for c in rows.columns if c not in BOX), F.inline(F.array(r)))


def regions(rows: DataFrame, name: str, size: Callable[[Column], Column], around: Callable[[Column, Column], Column], width: int, height: int) -> DataFrame:
    """rows with the region of their box inside the frame, step by step: size, place, clip."""
    sized = placed(rows, "size", size(box()))
    at = placed(sized, "around", around(box(), F.col("size")))
    return placed(at, name, g.clip(F.col("around"), width, height)).drop("size", "around")


def object_gate(class_id: Column, score: Column, threshold: float = OBJECT_MIN, allow: tuple[int, ...] = (*VEHICLES, *SCREENS)) -> Column:
    """Persons pass from a low score, others from the threshold if their class is allowed."""
    return F.when(class_id == PERSON, score >= PERSON_MIN).otherwise((score >= threshold) & class_id.isin(*allow))


def face_threshold(w: Column, h: Column, threshold: float, small_share: float = 0.55) -> Column:
    """The score a face needs: less if it is small."""
    return F.when(F.least(w, h) < 48, F.greatest(F.lit(0.22), F.lit(threshold * small_share))).otherwise(F.lit(threshold))


def face_gate(w: Column, h: Column, score: Column, threshold: float, small_share: float = 0.55) -> Column:
    return score >= face_threshold(w, h, threshold, small_share)


def model_threshold(threshold: float, model: str) -> float:
    """The threshold that holds for a face model; one kind never asks more than 0.35."""
    return min(threshold, 0.35) if model == "yolo-face" else threshold


def class_argmax(scores: Column) -> Column:
    """class_id and score of the highest score; the lowest class wins ties."""
    best = F.array_max(scores)
    return F.struct((F.array_position(scores, best) - 1).cast("int").alias("class_id"), best.alias("score"))


def with_label(dets: DataFrame, labels: dict[int, str] | None = None) -> DataFrame:
    """Adds the class's name, ``object`` for an unknown one. The names are a fixed short list, hence the broadcast."""
    names = dets.sparkSession.createDataFrame(sorted((labels or LABELS).items()), "class_id int, label string")
    return dets.join(F.broadcast(names), "class_id", "left").withColumn("label", F.coalesce("label", F.lit("object")))


def route(dets: DataFrame) -> DataFrame:
    """Screens as they are and the plate zones of vehicles, with what each is."""
    screens = dets.where(F.col("class_id").isin(*SCREENS)).select(*FRAME, *BOX, "score", F.lit("screen").alias("target"))
    zone = g.plate_zone(box())
    plates = dets.where(F.col("class_id").isin(*VEHICLES)).select(*FRAME, zone.alias("z"), "score").select(*FRAME, *(F.col(f"z.{c}").alias(c) for c in BOX), "score", F.lit("plate-zone").alias("target"))
    return screens.unionByName(plates)


def _ranked(dets: DataFrame, extra: tuple[str, ...]) -> DataFrame:
    entry = F.struct((-F.col("score")).alias("s"), *BOX, *extra)
    return dets.groupBy(*FRAME).agg(F.sort_array(F.collect_list(entry)).alias("boxes"))


def _greedy(boxes: Column, most: float) -> Column:
    """The boxes in their order, less those that overlap a kept one by more than ``most``."""
    none = F.filter(boxes, lambda _: F.lit(False))
    over = lambda k, b: g.meets(k, b) & (g.iou(k, b) > most)  # noqa: E731  most boxes of a frame do not meet, which is cheaper to tell
    return F.aggregate(boxes, none, lambda kept, b: F.when(F.exists(kept, lambda k: over(k, b)), kept).otherwise(F.concat(kept, F.array(b))))


def suppress(dets: DataFrame, least_score: float, most_iou: float, top: int | None = None, extra: tuple[str, ...] = ("class_id",)) -> DataFrame:
    """Non-maximum suppression per frame, over all classes. ``top`` cuts a frame's list before suppression, as the detector library does."""
    ranked = _ranked(dets.where(F.col("score") >= least_score), extra)
    boxes = F.slice("boxes", 1, top) if top else F.col("boxes")
    kept = ranked.select(*FRAME, F.explode(_greedy(boxes, most_iou)).alias("b"))
    return kept.select(*FRAME, *(F.col(f"b.{c}").alias(c) for c in (*BOX, *extra)), (-F.col("b.s")).alias("score"))


def object_boxes(raw: DataFrame, threshold: float = OBJECT_MIN) -> DataFrame:
    """From a detector's raw rows (class_id, cx, cy, bw, bh, score in its input; scale, pad_x, pad_y; width and height of the frame) to its objects.

    Gated by class and score, brought back into the frame in whole pixels and clipped, less those under
    ``OBJECT_LEAST`` pixels, and suppressed. Rows with an ``error`` give nothing.
    """
    rows = raw.where(F.col("error").isNull()) if "error" in raw.columns else raw
    rows = rows.where(object_gate(F.col("class_id"), F.col("score"), threshold))
    fit = F.struct("scale", "pad_x", "pad_y")
    back = g.unletterbox(F.col("cx"), F.col("cy"), F.col("bw"), F.col("bh"), fit, F.col("width"), F.col("height"))
    made = placed(rows, "b", back).where(f"b.w >= {OBJECT_LEAST} AND b.h >= {OBJECT_LEAST}")
    return suppress(made.select(*FRAME, "b.*", "class_id", "score"), OBJECT_NMS_MIN, OBJECT_NMS_IOU)


def drop_containers(dets: DataFrame, ratio: float = 2.2) -> DataFrame:
    """Boxes less those over ``ratio`` times as large as one whose centre they hold; a frame that would lose all keeps all."""
    d = dets.groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct(*BOX, *(c for c in dets.columns if c not in (*FRAME, *BOX))))).alias("boxes"))
    size = lambda b: F.greatest(F.lit(1), g.area(b))

    def holds(b: Column, i: Column) -> Column:
        def inside(o: Column, j: Column) -> Column:
            cx, cy = g.centre(o)
            return (i != j) & (size(b) >= size(o) * ratio) & (cx >= b["x"]) & (cx <= b["x"] + b["w"]) & (cy >= b["y"]) & (cy <= b["y"] + b["h"])

        return F.exists(F.transform("boxes", inside), lambda x: x)

    left = F.filter("boxes", lambda b, i: ~holds(b, i))
    return d.select(*FRAME, F.inline(F.when(F.size(left) > 0, left).otherwise(F.col("boxes"))))


def finalise(dets: DataFrame, width: int, height: int) -> DataFrame:
    """Clipped, plausible faces with their margin (``geometry.padded_face``), step by step: written out in one expression, a face's margin is rounded dozens of times."""
    clipped = reboxed(dets, g.clip(box(), width, height)).where(g.plausible_face(box(), height))
    grown = reboxed(placed(clipped, "margin", g.face_margin(box())), g.with_margin(box(), F.col("margin"))).drop("margin")
    return reboxed(grown, g.clip(box(), width, height)).where("w > 2 AND h > 2")


def _covered(head: Column, face: Column) -> Column:
    both = g.overlap(head, face)
    union = g.area(head) + g.area(face) - both
    cx, cy = g.centre(head)
    inside = (cx >= face["x"]) & (cx <= face["x"] + face["w"]) & (cy >= face["y"]) & (cy <= face["y"] + face["h"])
    return (both > 0) & (((union > 1) & (both / union >= 0.12)) | inside)


def _heads_and_faces(persons: DataFrame, faces: DataFrame, width: int, height: int, how: str, extra: tuple[str, ...] = ()) -> tuple[DataFrame, Column]:
    """Per frame the head regions of persons, by position, and its faces; and those heads that no face covers, fallbacks before it included."""
    heads = regions(persons.select(*FRAME, *BOX), "f", g.face_size, g.face_around, width, height).where("f.w >= 12 AND f.h >= 12")
    heads = heads.groupBy(*FRAME).agg(F.transform(F.sort_array(F.collect_list(F.struct(*BOX, "f"))), lambda p: p["f"]).alias("heads"))
    known = faces.groupBy(*FRAME).agg(F.collect_list(F.struct(*BOX, *extra)).alias("faces"))
    both = heads.join(known, list(FRAME), how)
    none = F.filter("heads", lambda _: F.lit(False))
    covered = lambda h: F.coalesce(F.exists("faces", lambda f: _covered(h, f)), F.lit(False))

    def step(out: Column, h: Column) -> Column:
        hit = covered(h) | F.exists(out, lambda f: _covered(h, f))
        return F.when(hit, out).otherwise(F.concat(out, F.array(h)))

    return both, F.aggregate("heads", none, step)


def head_fallbacks(persons: DataFrame, faces: DataFrame, width: int, height: int) -> DataFrame:
    """A low-score face for each person whose face region no face covers, fallbacks before it included. Persons go by position."""
    both, made = _heads_and_faces(persons, faces, width, height, "left")
    return both.select(*FRAME, F.inline(made)).withColumn("score", F.lit(FALLBACK_SCORE))


def with_fallbacks(persons: DataFrame, faces: DataFrame, width: int, height: int) -> DataFrame:
    """The faces and their fallbacks; faces are read once, so what finds them runs once."""
    both, made = _heads_and_faces(persons, faces, width, height, "full_outer", ("score",))
    entry = both.select("faces").schema["faces"].dataType
    low = F.transform(made, lambda h: F.struct(*(h[c].alias(c) for c in BOX), F.lit(FALLBACK_SCORE).alias("score"))).cast(entry)
    nothing = F.array().cast(entry)
    return both.select(*FRAME, F.inline(F.concat(F.coalesce("faces", nothing), F.coalesce(low, nothing))))


def zoom_persons(dets: DataFrame, width: int, height: int, most: int = 10) -> DataFrame:
    """Head regions of the smallest persons of each frame, with their rank; standing close-ups are left out."""
    aspect = F.col("h") / F.greatest("w", F.lit(1))
    close = max(200, height * 50 // 100)
    people = dets.where((F.col("class_id") == PERSON) & ~((aspect > 1.4) & (F.col("h") >= close)))
    people = regions(people, "r", g.head_size, g.head_around, width, height).where("r.w >= 12 AND r.h >= 12")
    nth = F.row_number().over(Window.partitionBy(*FRAME).orderBy("h", *BOX, "score"))
    return people.withColumn("rank", nth).where(F.col("rank") <= most).select(*FRAME, *(F.col(f"r.{c}").alias(c) for c in BOX), "rank")


def zoom_budget(dets: DataFrame, follow: DataFrame, width: int, height: int, most: int = 12) -> DataFrame:
    """Regions to look at again: the smallest persons, then followed boxes while there is room."""
    budget = min(4, max(0, most // 3))
    people = zoom_persons(dets, width, height, max(1, most - budget)).select(*FRAME, *BOX, F.col("rank").cast("long").alias("ord"), F.lit(0).alias("kind"))
    near = placed(follow, "r", g.zoom_around(box(), width, height)).where("r.w >= 12 AND r.h >= 12")
    nth = F.row_number().over(Window.partitionBy(*FRAME).orderBy(*BOX))
    near = near.select(*FRAME, *(F.col(f"r.{c}").alias(c) for c in BOX), nth.cast("long").alias("ord"), F.lit(1).alias("kind"))
    place = F.row_number().over(Window.partitionBy(*FRAME).orderBy("kind", "ord"))
    return people.unionByName(near).withColumn("place", place).where(F.col("place") <= most).drop("ord")


def tiles(sizes: DataFrame, tile: int, share: float = 0.2) -> DataFrame:
    """Overlapping tiles of each w x h picture (column key), row by row; the last one ends at the edge."""

    def starts(size: Column) -> Column:
        t = F.least(F.lit(tile), size)
        step = F.greatest(F.lit(1), F.round(t * (1 - share)).cast("int"))
        last = size - t
        return F.when(last <= 0, F.array(F.lit(0))).otherwise(F.array_sort(F.array_distinct(F.concat(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0)), step), F.array(last)))))

    grid = sizes.select("key", "w", "h", F.posexplode(starts(F.col("h"))).alias("row", "y"))
    grid = grid.select("key", "w", "h", "row", "y", F.posexplode(starts(F.col("w"))).alias("col", "x"))
    return grid.select("key", "row", "col", "x", "y", F.least(F.lit(tile), "w").alias("tw"), F.least(F.lit(tile), "h").alias("th"))


def spread(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` tiles of each picture, evenly spread over their order."""
    w = Window.partitionBy("key")
    placed = rows.withColumn("i", F.row_number().over(w.orderBy("row", "col")) - 1).withColumn("n", F.count("*").over(w))
    step = F.floor(F.col("k") * (F.col("n") - 1) / max(1, most - 1)).cast("int")
    picks = placed.select("key", "n").distinct().where(F.col("n") > most).select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("k")).select("key", step.alias("i")).distinct()
    return placed.where(F.col("n") <= most).drop("n").unionByName(placed.where(F.col("n") > most).drop("n").join(picks, ["key", "i"], "left_semi"))


def grid_decode(cells: DataFrame) -> DataFrame:
    """Boxes from a grid head: rows (stride, row, col, cls, obj, dx, dy, dw, dh)."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    w, h = F.exp("dw") * F.col("stride"), F.exp("dh") * F.col("stride")
    out = cells.withColumns({"score": F.sqrt(unit("cls") * unit("obj")), "bw": w, "bh": h, "bx": (F.col("col") + F.col("dx")) * F.col("stride") - w / 2, "by": (F.col("row") + F.col("dy")) * F.col("stride") - h / 2})
    return out.where(F.col("score") >= 0.22)


def prior_decode(rows: DataFrame, threshold: float) -> DataFrame:
    """Boxes from prior boxes: rows (conf, x0, y0, x1, y1, v0..v3, l0..l3), relative units."""
    pw, ph = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    w, h = F.exp(F.col("v2") * F.col("l2")) * pw, F.exp(F.col("v3") * F.col("l3")) * ph
    cx, cy = F.col("v0") * F.col("l0") * pw + (F.col("x0") + F.col("x1")) / 2, F.col("v1") * F.col("l1") * ph + (F.col("y0") + F.col("y1")) / 2
    return rows.where(F.col("conf") >= min(0.12, threshold)).withColumns({"bx": cx - w / 2, "by": cy - h / 2, "bw": w, "bh": h})


def crop_to_frame(dets: DataFrame, crops: DataFrame) -> DataFrame:
    """Detections of crops in their frame: torso crops let go of boxes over half their area, the others move by the crop's corner."""
    torso = (F.col("crop_h") > F.col("crop_w") * 1.28) & (F.col("crop_h") >= 80)
    joined = dets.join(crops, "crop_id").where(~(torso & (F.col("w") * F.col("h") > 0.5 * F.col("crop_w") * F.col("crop_h"))))
    return joined.select("owner", (F.col("x") + F.col("crop_x")).alias("x"), (F.col("y") + F.col("crop_y")).alias("y"), "w", "h", "score")


def match_greedily(pairs: DataFrame, key: tuple[str, ...] = FRAME) -> DataFrame:
    """One-to-one matches per key from scored pairs (t, d, score): best score first, then t, then d."""
    ranked = pairs.where("score > 1e-6").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "t", "d"))).alias("p"))
    none = F.filter("p", lambda _: F.lit(False))
    taken = F.aggregate("p", none, lambda out, p: F.when(F.exists(out, lambda o: (o["t"] == p["t"]) | (o["d"] == p["d"])), out).otherwise(F.concat(out, F.array(p))))
    return ranked.select(*key, F.explode(taken).alias("m")).select(*key, "m.t", "m.d", (-F.col("m.s")).alias("score"))


def smallest_at(tracks: DataFrame, points: DataFrame, key: tuple[str, ...] = FRAME) -> DataFrame:
    """For each point (point_id, px, py) of a frame the smallest box that holds it; ties go to the smaller id."""
    hit = points.join(tracks, list(key)).where(g.contains(box(), F.col("px"), F.col("py")))
    return hit.groupBy("point_id").agg(F.min_by("id", F.struct((F.col("w") * F.col("h")).alias("a"), "id")).alias("id"), F.min(F.col("w") * F.col("h")).alias("area"))


def landmarks(values: Column, roi: Column) -> Column:
    """Five points in the picture from ten numbers relative to a region; null for fewer."""
    point = lambda i: F.struct((roi["x"] + F.get(values, 2 * i) * roi["w"]).alias("x"), (roi["y"] + F.get(values, 2 * i + 1) * roi["h"]).alias("y"))
    return F.when(F.size(values) >= 10, F.transform(F.sequence(F.lit(0), F.lit(4)), point))
