"""Pictures cut out of frames: aligned faces and thumbnails."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as g
from . import resample

FACE = 128  # fixed value: side of an aligned face
FRAME = ("video_id", "frame_index")
MAP = "abcdef"


def aligned_faces(frames: DataFrame, faces: DataFrame, size: int = FACE) -> DataFrame:
    """video_id, frame_index, face_id, width, height, pixels: each face (face_id, points) brought onto the places of its first three points.

    A frame meets the list of its faces once, so its pixels are not written out per face. Faces whose
    points lie on a line have no map and are left out.
    """
    m = g.alignment(F.col("points"), size, size)
    listed = faces.select(*FRAME, F.col("face_id").cast("long").alias("face_id"), m.alias("m")).where("m IS NOT NULL").groupBy(*FRAME).agg(F.sort_array(F.collect_list(F.struct("face_id", "m"))).alias("faces"))
    rows = frames.select(*FRAME, "width", "height", "pixels").join(listed, list(FRAME))
    schema = T.StructType([*(frames.schema[c] for c in FRAME), *T._parse_datatype_string("face_id long, width int, height int, pixels binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w, h, data, found = (b.column(c)[i].as_py() for c in ("width", "height", "pixels", "faces"))
                picture = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                crops = [resample.warped(picture, tuple(f["m"][k] for k in MAP), size, size).tobytes() for f in found]
                n = len(crops)
                same = [pa.array([b.column(c)[i].as_py()] * n, b.column(c).type) for c in FRAME]
                yield pa.RecordBatch.from_arrays([*same, pa.array([f["face_id"] for f in found], pa.int64()), pa.array([size] * n, pa.int32()), pa.array([size] * n, pa.int32()), pa.array(crops, pa.binary())], names=[*FRAME, "face_id", "width", "height", "pixels"])

    return rows.mapInArrow(run, schema)


def thumbnails(frames: DataFrame, width: int, height: int) -> DataFrame:
    """The frames, as large as fits into width x height with their shape kept, at least a pixel each way; by area."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.columns, strict=True))
            ws, hs, out = [], [], []
            for w, h, data in zip(*(cols[c].to_pylist() for c in ("width", "height", "pixels")), strict=True):
                r = min(width / w, height / h)
                ws.append(max(1, int(w * r + 0.5)))
                hs.append(max(1, int(h * r + 0.5)))
                out.append(resample.area(np.frombuffer(data, np.uint8).reshape(h, w, 3), ws[-1], hs[-1]).tobytes())
            cols |= {"width": pa.array(ws, pa.int32()), "height": pa.array(hs, pa.int32()), "pixels": pa.array(out, pa.binary())}
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return frames.mapInArrow(run, frames.schema)


def filmstrip(frames: DataFrame, spans: DataFrame, width: int, height: int) -> DataFrame:
    """The thumbnail of each span (video_id, first, span): its first frame, with span. Where frames come from ``read_video``, only the asked ones are met by number."""
    first = spans.select("video_id", F.col("first").alias("frame_index"), "span")
    return thumbnails(frames.join(first, list(FRAME)), width, height)
