"""From model rows to the faces of a frame: decoding by kind of model, regions to look at, regions put together again.

A model answers per region with rows of numbers (``values``); what they mean depends on its kind:

* ``ssd``: picture, label, score, two corners as shares of the input; the picture is centred in the input;
* ``yolo-face``: centre, size and score in input pixels; the picture is centred in the input;
* ``grid``: stride, row, column, class and object score, offsets and log sizes; the picture stands top left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from . import detect as d
from . import pixels

# Share of the threshold that a small face needs, and least sides of regions.
SSD_SMALL, YOLO_SMALL = 0.62, 0.55
ZOOM_LEAST, TILE_LEAST = 12, 16


def _found(x: Column, y: Column, w: Column, h: Column, score: Column) -> Column:
    return F.struct(*(v.cast("double").alias(n) for v, n in ((x, "x"), (y, "y"), (w, "w"), (h, "h"), (score, "score"))))


def ssd_box(values: Column, fit: Column, width: int, height: int) -> Column:
    """A row of two corners in pixels of the picture; null for fewer than 7 numbers or a picture number below 0. fit: scale, pad_x, pad_y."""
    at = lambda i: F.get(values, F.lit(i))
    scale = F.when(fit["scale"] > 1e-6, fit["scale"]).otherwise(1.0)
    box = _found((at(3) * width - fit["pad_x"]) / scale, (at(4) * height - fit["pad_y"]) / scale, (at(5) - at(3)) * width / scale, (at(6) - at(4)) * height / scale, at(2))
    return F.when((F.size(values) >= 7) & (at(0) >= 0), box)


def anchor_box(values: Column, fit: Column) -> Column:
    """A row of centre and size in pixels of the picture; null if there are not five numbers."""
    at = lambda i: F.get(values, F.lit(i))
    box = _found((at(0) - at(2) * 0.5 - fit["pad_x"]) / fit["scale"], (at(1) - at(3) * 0.5 - fit["pad_y"]) / fit["scale"], at(2) / fit["scale"], at(3) / fit["scale"], at(4))
    return F.when(F.size(values) == 5, box)


def grid_box(values: Column, fit: Column) -> Column:
    """A row of a grid head in pixels of the picture; null if there are not nine numbers."""
    stride, row, col, cls, obj, dx, dy, dw, dh = (F.get(values, F.lit(i)) for i in range(9))
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    w, h = F.exp(dw) * stride, F.exp(dh) * stride
    box = _found(((col + dx) * stride - w / 2) / fit["scale"], ((row + dy) * stride - h / 2) / fit["scale"], w / fit["scale"], h / fit["scale"], F.sqrt(unit(cls) * unit(obj)))
    return F.when(F.size(values) == 9, box)


def decode(rows: DataFrame, threshold: float, width: int, height: int) -> DataFrame:
    """x, y, w, h, score of the rows (kind, values, fit) that pass their kind's gate; rows of an unknown kind or shape give nothing."""
    kind, values, fit = F.col("kind"), F.col("values"), F.col("fit")
    box = F.when(kind == "ssd", ssd_box(values, fit, width, height)).when(kind == "yolo-face", anchor_box(values, fit)).when(kind == "grid", grid_box(values, fit))
    made = d.placed(rows, "b", box).where("b IS NOT NULL")
    w, h, score = F.col("b.w"), F.col("b.h"), F.col("b.score")
    passes = F.when(kind == "ssd", d.face_gate(w, h, score, threshold, SSD_SMALL)).when(kind == "yolo-face", d.face_gate(w, h, score, d.model_threshold(threshold, "yolo-face"), YOLO_SMALL)).otherwise(score >= d.FACE_NMS_MIN)
    return made.where(passes).select(*(c for c in rows.columns if c not in ("values", "fit")), "b.*")


def regions(frames: DataFrame, zooms: DataFrame, kind: str, size: int, with_tiles: bool = True, most_tiles: int = 12) -> DataFrame:
    """Where a model of this kind and input size looks in each frame (width, height): part, rx, ry, rw, rh and whether the region may be enlarged.

    The whole frame; its tiles if it is larger than the input, unless the model is ``yolo-face``; the
    zooms (x, y, w, h) cut to the frame and the input, less those under 12 pixels.
    """
    larger = (F.col("width") > size) | (F.col("height") > size)
    full = frames.select(*d.FRAME, F.lit("full").alias("part"), F.lit(0).alias("rx"), F.lit(0).alias("ry"), F.col("width").alias("rw"), F.col("height").alias("rh"), (~larger).alias("enlarge"))
    parts = [full]
    if with_tiles and kind != "yolo-face":
        key = F.struct(*d.FRAME).alias("key")
        cut = d.spread(d.tiles(frames.where(larger).select(key, F.col("width").alias("w"), F.col("height").alias("h")), size), most_tiles)
        parts.append(cut.where((F.col("tw") >= TILE_LEAST) & (F.col("th") >= TILE_LEAST)).select("key.*", F.lit("tile").alias("part"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("tw").alias("rw"), F.col("th").alias("rh"), F.lit(False).alias("enlarge")))
    inside = lambda r: d.placed(r, "r", g.clip(d.box(), F.col("width"), F.col("height"))).where(f"r.w >= {ZOOM_LEAST} AND r.h >= {ZOOM_LEAST}").select(*d.FRAME, "width", "height", "r.*")
    zoomed = inside(zooms.select(*d.FRAME, *d.BOX).join(frames, list(d.FRAME)))
    over = F.greatest(F.col("w") - size, F.lit(0))
    zoomed = inside(zoomed.withColumns({"x": F.col("x") + g.idiv(over, 2), "w": F.col("w") - over, "h": F.least("h", F.lit(size))}))
    parts.append(zoomed.select(*d.FRAME, F.lit("zoom").alias("part"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("w").alias("rw"), F.col("h").alias("rh"), F.lit(True).alias("enlarge")))
    return reduce(DataFrame.unionByName, parts)


def fitted(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Regions with ``fit``: how they stand in the square input of a model of this kind."""
    fit = F.when(F.col("enlarge"), g.letterbox(F.col("rw"), F.col("rh"), size)).otherwise(g.letterbox(F.col("rw"), F.col("rh"), size, upscale=False))
    return rows.withColumn("fit", F.struct(fit["scale"].alias("scale"), F.lit(0).alias("pad_x"), F.lit(0).alias("pad_y")) if kind == "grid" else fit)


def together(found: DataFrame) -> DataFrame:
    """Faces of regions (part, rx, ry, rw, rh with x, y, w, h, score) in their frame: a zoom on a torso lets go of boxes over half its area."""
    torso = (F.col("part") == "zoom") & (F.col("rh") > (F.col("rw") * 1.28).cast("int")) & (F.col("rh") >= 80)
    kept = found.where(~(torso & (F.col("w") * F.col("h") > F.greatest(F.lit(1), F.col("rw") * F.col("rh")) * 0.5)))
    return kept.select(*d.FRAME, g.trunc(F.col("x") + F.col("rx")).alias("x"), g.trunc(F.col("y") + F.col("ry")).alias("y"), g.trunc(F.col("w")).alias("w"), g.trunc(F.col("h")).alias("h"), "score")


def faces(found: DataFrame, width: int, height: int) -> DataFrame:
    """The faces of each frame from those of its regions, many frames at once: put together, suppressed, finalised."""
    return d.finalise(d.suppress(together(found), d.FACE_NMS_MIN, d.FACE_NMS_IOU, top=d.FACE_TOP, extra=()), width, height)


def detect(frames: DataFrame, zooms: DataFrame, persons: DataFrame, detector, kind: str, size: int, threshold: float, width: int, height: int, with_tiles: bool = True) -> DataFrame:
    """Faces of frames (width, height, pixels), from pixels to boxes in one plan.

    Regions are planned, cut and resized once each and run in chunks; what the model says is decoded by
    its kind, brought back into the frame (a zoom on a torso lets go of boxes over half of it),
    suppressed and finalised; persons without a face get a fallback from their head's region.
    """
    planned = fitted(regions(frames.select(*d.FRAME, "width", "height"), zooms, kind, size, with_tiles), size, kind)
    rows = pixels.detect_regions(frames, planned, detector, kind, size).where("error IS NULL").drop("error")
    found = faces(decode(rows, threshold, size, size), width, height)
    return d.with_fallbacks(persons, found, width, height)
