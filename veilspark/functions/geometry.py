"""Rectangle arithmetic as Column expressions: no Python runs per row.

A rectangle is a struct of x, y, w, h (half-open). Integer steps truncate toward zero as casts do.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | int | float


def rect(x: Num, y: Num, w: Num, h: Num) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(as_col(x).alias("x"), as_col(y).alias("y"), as_col(w).alias("w"), as_col(h).alias("h"))


def trunc(v: Column) -> Column:
    return v.cast("int")


def idiv(a: Column, b: int) -> Column:
    """Integer division that truncates toward zero."""
    return (a / F.lit(b)).cast("int")


def area(r: Column) -> Column:
    return r["w"] * r["h"]


def overlap(a: Column, b: Column) -> Column:
    w = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    h = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def meets(a: Column, b: Column) -> Column:
    """Whether two rectangles may share pixels; where this is false their overlap is 0."""
    return (a["x"] < b["x"] + b["w"]) & (b["x"] < a["x"] + a["w"]) & (a["y"] < b["y"] + b["h"]) & (b["y"] < a["y"] + a["h"])


def iou(a: Column, b: Column, least_union: float = 0.0) -> Column:
    """Intersection over union; 0 where the union is no larger than least_union."""
    both = overlap(a, b)
    union = area(a) + area(b) - both
    return F.when(union > least_union, both.cast("double") / union).otherwise(F.lit(0.0))


def centre(r: Column) -> tuple[Column, Column]:
    return r["x"] + r["w"] * 0.5, r["y"] + r["h"] * 0.5


def centre_distance(a: Column, b: Column) -> Column:
    (ax, ay), (bx, by) = centre(a), centre(b)
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def contains(r: Column, x: Num, y: Num) -> Column:
    """Half-open, as for whole pixels."""
    return (x >= r["x"]) & (x < r["x"] + r["w"]) & (y >= r["y"]) & (y < r["y"] + r["h"])


def clip(r: Column, width: Num, height: Num) -> Column:
    """The part inside the frame; all zeros if there is none."""
    w_, h_ = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))
    x, y = F.greatest(r["x"], F.lit(0)), F.greatest(r["y"], F.lit(0))
    w, h = F.least(r["x"] + r["w"], w_) - x, F.least(r["y"] + r["h"], h_) - y
    some = (w > 0) & (h > 0)
    return rect(*(F.when(some, v).otherwise(F.lit(0)) for v in (x, y, w, h)))


def grow(r: Column, dx: Column, dy: Column) -> Column:
    return rect(r["x"] - dx, r["y"] - dy, r["w"] + 2 * dx, r["h"] + 2 * dy)


def pad_lookahead(r: Column) -> Column:
    return grow(r, F.greatest(F.lit(6), idiv(r["w"], 5)), F.greatest(F.lit(6), idiv(r["h"], 5)))


def expand_fraction(r: Column, share: float, width: Num, height: Num) -> Column:
    return clip(grow(r, F.greatest(F.lit(4), trunc(F.round(r["w"] * share))), F.greatest(F.lit(4), trunc(F.round(r["h"] * share)))), width, height)


def zoom_around(r: Column, width: Num, height: Num) -> Column:
    return clip(grow(r, F.greatest(F.lit(20), idiv(r["w"] * 3, 4)), F.greatest(F.lit(20), idiv(r["h"] * 3, 4))), width, height)


def coast(r: Column, vx: Column, vy: Column, miss: Column) -> Column:
    """A box that coasts: moved along its motion and padded a little; as it is without a miss."""
    pad = F.greatest(F.lit(3), idiv(F.least(r["w"], r["h"]), 8))
    moved = rect(r["x"] + trunc(F.round(vx * miss)) - pad, r["y"] + trunc(F.round(vy * miss)) - pad, r["w"] + 2 * pad, r["h"] + 2 * pad)
    return F.when(miss > 0, moved).otherwise(rect(r["x"], r["y"], r["w"], r["h"]))


def snap_to_head(box: Column, heads: Column) -> Column:
    """The head nearest to the box within its gate, or null; ties go to the first."""
    placed = F.transform(heads, lambda h, i: F.struct(centre_distance(box, h).alias("d"), i.alias("i"), h.alias("h")))
    near = F.filter(placed, lambda p: p["d"] <= F.greatest(box["w"], p["h"]["w"]) * 0.85 + 28)
    return F.array_min(near)["h"]


def recentre(box: Column, head: Column) -> Column:
    """The box moved onto the head with its size kept, where it is a box (over 8 px) under twice the head's area; else the head."""
    keep = (box["w"] > 8) & (box["h"] > 8) & (area(box) < area(head) * 2)
    cx, cy = head["x"] + idiv(head["w"], 2), head["y"] + idiv(head["h"], 2)
    return F.when(keep, rect(cx - idiv(box["w"], 2), cy - idiv(box["h"], 2), box["w"], box["h"])).otherwise(head)


def letterbox(w: Num, h: Num, size: int, upscale: bool = True) -> Column:
    """scale, pad_x, pad_y of a w x h picture centred in a square."""
    w_, h_ = (v if isinstance(v, Column) else F.lit(v) for v in (w, h))
    r = F.least(F.lit(float(size)) / w_, F.lit(float(size)) / h_)
    r = r if upscale else F.least(r, F.lit(1.0))
    return F.struct(r.alias("scale"), idiv(size - trunc(F.round(w_ * r)), 2).alias("pad_x"), idiv(size - trunc(F.round(h_ * r)), 2).alias("pad_y"))


def unletterbox(cx: Column, cy: Column, w: Column, h: Column, box: Column, width: Num, height: Num) -> Column:
    """A centre box in the square back in the picture: whole pixels, clipped."""
    x, y = (cx - w * 0.5 - box["pad_x"]) / box["scale"], (cy - h * 0.5 - box["pad_y"]) / box["scale"]
    return clip(rect(trunc(x), trunc(y), trunc(w / box["scale"]), trunc(h / box["scale"])), width, height)


def _banded(person: Column, narrow: float, middle: float, wide: float) -> Column:
    aspect = person["h"].cast("double") / F.greatest(person["w"], F.lit(1))
    return F.when(aspect < 1.15, narrow).when(aspect < 1.55, middle).otherwise(wide)


def head_size(person: Column) -> Column:
    """w, h of where to look for a person's head: three bands of shape."""
    h = F.greatest(F.lit(16), trunc(person["h"] * _banded(person, 0.40, 0.30, 0.26)))
    w = F.greatest(F.lit(16), trunc(person["w"] * _banded(person, 0.62, 0.82, 1.0)))
    return F.struct(w.alias("w"), h.alias("h"))


def head_around(person: Column, size: Column) -> Column:
    """The region of that size at a person's head, with its pad; it may leave the frame."""
    w, h = size["w"], size["h"]
    px, py = F.greatest(F.lit(8), idiv(w, 5)), F.greatest(F.lit(8), idiv(h, 5))
    return rect(person["x"] + idiv(person["w"], 2) - idiv(w, 2) - px, person["y"] - py, w + 2 * px, h + 2 * py)


def head_roi(person: Column, width: Num, height: Num) -> Column:
    """Where to look for a person's head."""
    return clip(head_around(person, head_size(person)), width, height)


def face_size(person: Column) -> Column:
    """w, h of where a person's face should be: three bands of shape."""
    h = F.greatest(F.lit(14), trunc(person["h"] * _banded(person, 0.28, 0.20, 0.16)))
    w = F.greatest(F.lit(14), trunc(person["w"] * _banded(person, 0.48, 0.52, 0.55)))
    return F.struct(w.alias("w"), h.alias("h"))


def face_around(person: Column, size: Column) -> Column:
    """The region of that size at a person's face, with its pad; it may leave the frame."""
    w, h = size["w"], size["h"]
    pad = F.greatest(F.lit(2), idiv(w, 10))
    top = person["y"] + idiv(person["h"], 40)
    return rect(person["x"] + idiv(person["w"], 2) - idiv(w, 2) - pad, top - idiv(pad, 2), w + 2 * pad, h + pad)


def face_roi(person: Column, width: Num, height: Num) -> Column:
    """Where a person's face should be."""
    return clip(face_around(person, face_size(person)), width, height)


def plate_zone(vehicle: Column, share: float = 0.35) -> Column:
    """The lower part of a vehicle."""
    h = F.greatest(F.lit(4), trunc(vehicle["h"] * share))
    return rect(vehicle["x"], vehicle["y"] + vehicle["h"] - h, vehicle["w"], h)


def plausible_face(r: Column, height: Num) -> Column:
    """Whether a clipped box has the shape of a face."""
    h_ = height if isinstance(height, Column) else F.lit(height)
    aspect = r["h"].cast("double") / F.greatest(r["w"], F.lit(1))
    return (r["w"] > 2) & (r["h"] > 2) & (aspect >= 0.42) & (aspect <= 1.85) & ~((r["h"] > idiv(h_ * 42, 100)) & (aspect > 1.35))


def face_margin(r: Column) -> Column:
    """dx, dy that redaction needs around a clipped face, more for small ones."""
    share = F.when((r["w"] < 64) | (r["h"] < 64), 0.32).otherwise(0.16)
    dx, dy = F.greatest(F.lit(3), trunc(F.round(r["w"] * share))), F.greatest(F.lit(4), trunc(F.round(r["h"] * share)))
    return F.struct(dx.alias("dx"), dy.alias("dy"))


def with_margin(r: Column, margin: Column) -> Column:
    """A face grown by its margin, and by a little more in height."""
    dx, dy = margin["dx"], margin["dy"]
    extra = F.greatest(F.lit(2), idiv(dy, 3))
    return rect(r["x"] - dx, r["y"] - dy - idiv(extra, 2), r["w"] + 2 * dx, r["h"] + 2 * dy + extra)


def padded_face(r: Column, width: Num, height: Num) -> Column:
    """A clipped face with its margin, inside the frame."""
    return clip(with_margin(r, face_margin(r)), width, height)


def association_score(track: Column, det: Column, least_iou: float) -> Column:
    """How well a detection continues a track; 0 if it cannot."""
    v, d = iou(track, det, 1e-6), centre_distance(track, det)
    diag = lambda r: F.sqrt((r["w"] * r["w"] + r["h"] * r["h"]).cast("double"))
    gate = F.greatest(diag(track), diag(det)) * 0.70
    ratio = lambda k: det[k].cast("double") / F.greatest(track[k], F.lit(4))
    fits = (ratio("w") > 0.28) & (ratio("w") < 4.5) & (ratio("h") > 0.28) & (ratio("h") < 4.5)
    near = 0.12 + 0.35 * (1 - d / F.greatest(gate, F.lit(1.0)))
    return F.when(v >= 0.45, v + 0.20).when((v >= least_iou) & fits, v + 0.15).when(~fits | (d > gate), 0.0).otherwise(near)


def viewport_box(view_w: Num, view_h: Num, w: Num, h: Num) -> Column:
    """dx, dy, dw, dh of a w x h video shown whole in a viewport."""
    vw, vh, w_, h_ = (v.cast("double") if isinstance(v, Column) else F.lit(float(v)) for v in (view_w, view_h, w, h))
    wide = vw / vh > w_ / h_
    dw, dh = F.when(wide, vh * (w_ / h_)).otherwise(vw), F.when(wide, vh).otherwise(vw / (w_ / h_))
    return F.struct(((vw - dw) / 2).alias("dx"), ((vh - dh) / 2).alias("dy"), dw.alias("dw"), dh.alias("dh"))


def view_to_video(r: Column, box: Column, w: Num, h: Num) -> Column:
    """A rectangle drawn in the viewport in pixels of the video (at least one); null outside the picture."""
    x1, y1 = F.greatest(r["x"], box["dx"]), F.greatest(r["y"], box["dy"])
    x2, y2 = F.least(r["x"] + r["w"], box["dx"] + box["dw"]), F.least(r["y"] + r["h"], box["dy"] + box["dh"])
    sx, sy = w / box["dw"], h / box["dh"]
    got = rect(trunc((x1 - box["dx"]) * sx), trunc((y1 - box["dy"]) * sy), F.greatest(F.lit(1), trunc((x2 - x1) * sx)), F.greatest(F.lit(1), trunc((y2 - y1) * sy)))
    return F.when((x2 >= x1) & (y2 >= y1), got)


def video_to_view(r: Column, box: Column, w: Num, h: Num) -> Column:
    sx, sy = box["dw"] / w, box["dh"] / h
    return rect(box["dx"] + r["x"] * sx, box["dy"] + r["y"] * sy, F.greatest(F.lit(2.0), r["w"] * sx), F.greatest(F.lit(2.0), r["h"] * sy))


# Where both eyes and the nose belong in an aligned face of 128 x 128.
ALIGNED = ((34.6224, 59.0815), (74.8935, 58.8587), (54.8860, 81.9847))


def alignment(points: Column, width: int = 128, height: int = 128) -> Column:
    """The affine map (a, b, c, d, e, f: x' = a x + b y + c, y' = d x + e y + f) of the first three points onto their places; null if they are on a line."""
    p = [F.get(points, F.lit(i)) for i in range(3)]
    x, y = [q["x"].cast("double") for q in p], [q["y"].cast("double") for q in p]
    det = (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])

    def row(t: list[float]) -> tuple[Column, Column, Column]:
        a = ((t[1] - t[0]) * (y[2] - y[0]) - (t[2] - t[0]) * (y[1] - y[0])) / det
        b = ((t[2] - t[0]) * (x[1] - x[0]) - (t[1] - t[0]) * (x[2] - x[0])) / det
        return a, b, t[0] - a * x[0] - b * y[0]

    across, down = row([q[0] * width / 128 for q in ALIGNED]), row([q[1] * height / 128 for q in ALIGNED])
    return F.when(F.abs(det) > 1e-9, F.struct(*(c.alias(n) for n, c in zip("abcdef", (*across, *down), strict=True))))


def drawn(w: Column, h: Column) -> Column:
    """Whether a drawn rectangle, or one to be masked, is large enough."""
    return (w >= 2) & (h >= 2)


def dragged(w: Column, h: Column) -> Column:
    """Whether a rubber band on screen is a drawn rectangle; a smaller one is a click."""
    return (w > 4) & (h > 4)
