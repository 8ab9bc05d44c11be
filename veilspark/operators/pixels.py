"""Pixel filters and inference as Arrow functions over frames: the leaves of the graph.

A frame row has ``pixels`` (height x width x 3 bytes, row-major) and ``rects``, applied one after
another. Inference is a function from a batch of pictures to boxes; ``onnx_boxes`` makes one from
a model file, one session per Python worker.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import resample

MOSAIC_STEP, BLUR_SIZE, LETTERBOX_FILL = 15, 31, 114


def _clip(r: dict, w: int, h: int) -> tuple[int, int, int, int]:
    x1, y1 = max(0, r["x"]), max(0, r["y"])
    return x1, y1, min(w, r["x"] + r["w"]), min(h, r["y"] + r["h"])


def mosaic(part: np.ndarray) -> np.ndarray:
    """About size / 15 samples each way, taken bilinearly and shown as blocks."""
    h, w = part.shape[-3:-1]
    return resample.nearest(resample.bilinear(part, max(1, w // MOSAIC_STEP), max(1, h // MOSAIC_STEP)), w, h)


@lru_cache(maxsize=1024)
def _spread(n: int, size: int) -> np.ndarray:
    """n x n: the share of each pixel of an axis with mirrored ends in each blurred one; sigma follows from the kernel's size."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    at = np.abs(np.arange(n)[:, None] + np.arange(size)[None, :] - size // 2)
    period = max(1, 2 * (n - 1))
    at = at % period
    at = np.where(at >= n, period - at, at) if n > 1 else np.zeros_like(at)
    out = np.zeros((n, n))
    np.add.at(out, (np.arange(n)[:, None], at), k)
    return out


def blur(part: np.ndarray, size: int = BLUR_SIZE) -> np.ndarray:
    """Separable Gaussian with mirrored edges."""
    out = part.astype(np.float64)
    for axis in (-3, -2):
        moved = np.moveaxis(out, axis, 0)
        spread = _spread(moved.shape[0], size) @ moved.reshape(moved.shape[0], -1)
        out = np.moveaxis(spread.reshape(moved.shape), 0, axis)
    return np.rint(out).astype(np.uint8)


# Each takes a part of a picture, or a stack of parts of one size.
FILTERS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"mosaic": mosaic, "blur": blur, "solid": np.zeros_like}
STACK_BYTES = 2 << 20  # fixed value: parts that are filtered together


def masks(pictures: list[np.ndarray], rects: list[list[dict]], modes: list[str]) -> list[np.ndarray]:
    """The pictures with their rectangles masked, a picture's one after another; parts of one size and mode are filtered in stacks."""
    out = [p.copy() for p in pictures]
    for k in range(max(map(len, rects), default=0)):
        alike: dict[tuple, list[tuple]] = {}
        for p, r, m in zip(out, rects, modes, strict=True):
            if k < len(r):
                x1, y1, x2, y2 = _clip(r[k], p.shape[1], p.shape[0])
                if x2 - x1 >= 2 and y2 - y1 >= 2:
                    alike.setdefault((m, y2 - y1, x2 - x1), []).append(p[y1:y2, x1:x2])
        for (m, h, w), parts in alike.items():
            most = max(1, STACK_BYTES // (h * w * 3))
            for at in range(0, len(parts), most):
                some = parts[at : at + most]
                for part, done in zip(some, FILTERS[m](np.stack(some)), strict=True):
                    part[...] = done
    return out


def mask(picture: np.ndarray, rects: list[dict], mode: str) -> np.ndarray:
    return masks([picture], [rects], [mode])[0]


def mask_frames(frames: DataFrame, mode: str | None = "mosaic") -> DataFrame:
    """frames (width, height, pixels, rects and more) with their rectangles masked. An unknown mode is mosaic; None takes each frame's ``mode``."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = dict(zip(names, b.columns, strict=True))
            modes = cols["mode"].to_pylist() if mode is None else [mode] * b.num_rows
            shapes = zip(*(cols[c].to_pylist() for c in ("pixels", "width", "height")), strict=True)
            pictures = [np.frombuffer(p, np.uint8).reshape(h, w, 3) for p, w, h in shapes]
            done = [p.tobytes() for p in masks(pictures, [r or [] for r in cols["rects"].to_pylist()], [m if m in FILTERS else "mosaic" for m in modes])]
            cols["pixels"] = pa.array(done, pa.binary())
            yield pa.RecordBatch.from_arrays([cols[c] for c in names], names=names)

    return frames.mapInArrow(run, frames.schema)


def letterboxed(picture: np.ndarray, size: int) -> tuple[np.ndarray, float, int, int]:
    """The picture in a square tensor (1, 3, size, size) from 0 to 1 with its scale and pads."""
    h, w = picture.shape[:2]
    r = min(size / w, size / h)
    nw, nh = int(w * r + 0.5), int(h * r + 0.5)
    px, py = (size - nw) // 2, (size - nh) // 2
    out = np.full((size, size, 3), LETTERBOX_FILL, np.uint8)
    out[py : py + nh, px : px + nw] = resample.bilinear(picture, nw, nh)
    return (out[..., ::-1].astype(np.float32) / 255).transpose(2, 0, 1)[None], r, px, py


def anchors(output: np.ndarray, classes: int) -> np.ndarray:
    """A detector's output as rows of cx, cy, w, h and class scores, whichever way round it came; any other shape is an error."""
    shape = output.shape[-2:]
    if output.ndim != 3 or 4 + classes not in shape:
        raise ValueError(f"unknown output shape {output.shape}")
    o = output.reshape(shape)
    return o.T if shape[0] == 4 + classes and shape[1] != 4 + classes else o


def onnx_boxes(model: bytes, size: int, classes: int) -> Callable[[list[np.ndarray]], list[list[tuple]]]:
    """Boxes (class, cx, cy, w, h, score, scale, pad_x, pad_y) per picture from an ONNX detector, all pictures in one run."""
    state: dict = {}

    def run(pictures: list[np.ndarray]) -> list[list[tuple]]:
        if "session" not in state:
            import onnxruntime

            state["session"] = onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"])
        name, out = state["session"].get_inputs()[0].name, []
        fitted = [letterboxed(p, size) for p in pictures]
        outputs = state["session"].run(None, {name: np.concatenate([f[0] for f in fitted])})[0]
        for i, (_, r, px, py) in enumerate(fitted):
            rows = anchors(outputs[i : i + 1], classes)
            best = rows[:, 4:].argmax(axis=1)
            out.append([(int(k), *map(float, a[:4]), float(a[4 + k]), r, px, py) for a, k in zip(rows, best, strict=True)])
        return out

    return run


class Isolated:
    """A detector whose failures stay with the pictures that cause them.

    A batch that fails is done again picture by picture, and so are all later ones of the task: what
    fails once as a batch will again. A picture that fails by itself has an error in place of rows.
    """

    def __init__(self, detector: Callable[[list[np.ndarray]], list]) -> None:
        self.detector, self.alone = detector, False

    def __call__(self, pictures: list[np.ndarray]) -> list[tuple[list | None, str | None]]:
        if not self.alone:
            try:
                found = self.detector(pictures)
                if len(found) == len(pictures):
                    return [(x, None) for x in found]
            except Exception:  # noqa: BLE001  whatever the model raises
                pass
            self.alone = True
        out: list[tuple[list | None, str | None]] = []
        for p in pictures:
            try:
                out.append((self.detector([p])[0], None))
            except Exception as e:  # noqa: BLE001
                out.append((None, f"{type(e).__name__}: {e}"[:200]))
        return out


CHUNK = 48  # fixed value: pictures of one run
RAW = "class_id int, cx double, cy double, bw double, bh double, score double, scale double, pad_x int, pad_y int, error string"


def detect_frames(frames: DataFrame, detector: Callable[[list[np.ndarray]], list[list[tuple]]], keep: tuple[str, ...] = ("video_id", "frame_index"), chunk: int = CHUNK) -> DataFrame:
    """One row per raw box of every frame; pictures go to the detector in chunks. A picture that fails, or a row of another length, is one row with ``error``."""
    from pyspark.sql.types import _parse_datatype_string

    raw = _parse_datatype_string(RAW)
    schema = T.StructType([*(frames.schema[c] for c in keep), *raw.fields])
    names = [n for n in raw.names if n != "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isolated = Isolated(detector)
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk).to_pylist()
                rows = []
                for r, (boxes, error) in zip(part, isolated([np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3) for r in part]), strict=True):
                    kept = {c: r[c] for c in keep}
                    rows += [{**kept, "error": error}] if error else []
                    for x in boxes or []:
                        rows.append({**kept, **dict(zip(names, x, strict=True))} if len(x) == len(names) else {**kept, "error": f"a row of {len(x)} numbers"})
                if rows:
                    yield from pa.Table.from_pylist(rows, schema=_arrow(schema)).to_batches()

    return frames.mapInArrow(run, schema)


def region_picture(picture: np.ndarray, region: dict, size: int, top_left: bool) -> np.ndarray:
    """A region of the picture as a square input: made as large as fits if it may be enlarged, else never more than it is; in the middle or at the top left."""
    x1, y1, x2, y2 = _clip({"x": region["rx"], "y": region["ry"], "w": region["rw"], "h": region["rh"]}, picture.shape[1], picture.shape[0])
    cut = picture[y1:y2, x1:x2]
    out = np.zeros((size, size, 3), np.uint8)
    if not cut.size:
        return out
    r = min(size / region["rw"], size / region["rh"])
    r = r if region["enlarge"] else min(r, 1.0)
    w, h = max(1, int(region["rw"] * r + 0.5)), max(1, int(region["rh"] * r + 0.5))
    px, py = (0, 0) if top_left else ((size - w) // 2, (size - h) // 2)
    out[py : py + h, px : px + w] = resample.bilinear(cut, w, h)
    return out


REGION = "part string, rx int, ry int, rw int, rh int, fit struct<scale:double,pad_x:int,pad_y:int>, kind string, values array<double>, error string"


def detect_regions(frames: DataFrame, planned: DataFrame, detector: Callable[[list[np.ndarray]], list[list[list[float]]]], kind: str, size: int, chunk: int = CHUNK) -> DataFrame:
    """Rows of numbers that a model gives for each planned region (part, rx, ry, rw, rh, enlarge, fit) of its frame.

    A frame meets the list of its regions once, so its pixels are not written out per region; each
    region is cut and resized once, and regions of many frames fill a chunk.
    """
    key = ["video_id", "frame_index"]
    listed = planned.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("part", "rx", "ry", "rw", "rh", "enlarge", F.col("fit").cast("struct<scale:double,pad_x:int,pad_y:int>").alias("fit")))).alias("regions"))
    rows = frames.select(*key, "width", "height", "pixels").join(listed, key)
    schema = T.StructType([*(frames.schema[c] for c in key), *T._parse_datatype_string(REGION).fields])
    kinds = pa.schema([*rows.select(*key).limit(0).toArrow().schema, ("part", pa.string()), *((c, pa.int32()) for c in ("rx", "ry", "rw", "rh")), ("fit", pa.struct([("scale", pa.float64()), ("pad_x", pa.int32()), ("pad_y", pa.int32())])), ("kind", pa.string()), ("values", pa.list_(pa.float64())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        isolated, waiting, pictures = Isolated(detector), [], []

        def told() -> Iterator[pa.RecordBatch]:
            out = []
            for about, (found, error) in zip(waiting, isolated(pictures), strict=True):
                out += [{**about, "error": error}] if error else [{**about, "values": [float(v) for v in x]} for x in found]
            waiting.clear(), pictures.clear()
            if out:
                yield from pa.Table.from_pylist(out, schema=kinds).to_batches()

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                picture = np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], 3)
                for region in r["regions"]:
                    pictures.append(region_picture(picture, region, size, kind == "grid"))
                    waiting.append({**{c: r[c] for c in key}, **{c: region[c] for c in ("part", "rx", "ry", "rw", "rh", "fit")}, "kind": kind})
                    if len(pictures) == chunk:
                        yield from told()
        if pictures:
            yield from told()

    return rows.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(f.name, kinds[f.dataType.simpleString()]) for f in schema.fields])
