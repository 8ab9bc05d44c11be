"""Raw video and audio as Spark data sources: read by ranges of bytes, written in parts and committed as a whole.

A video is a file of frames (three bytes a pixel, frame after frame), or a folder of such parts with
``_props.json``, which names them in order and is written last: a folder without it is no video. Beside
a file, ``<name>.json`` may tell width, height, fps and bitrate_kbps; options hold for files without.

``read_video`` plans partitions of at most ``partition_bytes`` that begin at a frame, so a file of any
size is read by many tasks and none holds more than a batch of frames; conditions on ``frame_index``
and ``video_id`` choose partitions before anything is read. Stores are reached through pyarrow, by
path or URI.
"""

from __future__ import annotations

import fnmatch
import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

from ..operators import resample

FRAMES = "video_id string, frame_index long, pts_sec double, width int, height int, pixels binary"
PROPS = "video_id string, path string, opened boolean, width int, height int, fps double, frame_count long, bitrate_kbps double"
SAMPLES = "video_id string, sample_ix long, value int"
PARTITION_BYTES, BATCH_BYTES, NAMED = 64 << 20, 8 << 20, "_props.json"
NO_FPS, LEAST_FPS = 25.0, 1e-3  # fixed values: what a missing rate counts as


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _listed(store: pafs.FileSystem, path: str, pattern: str) -> list[pafs.FileInfo]:
    """The files and folders at a path, by name: the path itself if it is a file or a written video."""
    info = store.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File or store.get_file_info(f"{path}/{NAMED}").type == pafs.FileType.File:
        return [info]
    return sorted((x for x in store.get_file_info(pafs.FileSelector(path)) if fnmatch.fnmatch(x.base_name, pattern)), key=lambda x: x.path)


def _told(store: pafs.FileSystem, path: str) -> dict:
    """The JSON at a path, or nothing."""
    if store.get_file_info(path).type != pafs.FileType.File:
        return {}
    with store.open_input_stream(path) as f:
        return json.loads(f.read())


@dataclass(frozen=True)
class Video:
    """What is known of a video before a frame is read. parts: (path, first frame, frames)."""

    video_id: str
    path: str
    width: int
    height: int
    fps: float
    bitrate_kbps: float
    parts: tuple[tuple[str, int, int], ...]

    @property
    def frame_bytes(self) -> int:
        return self.width * self.height * 3

    @property
    def frame_count(self) -> int:
        return sum(n for _, _, n in self.parts)


def videos(path: str, options: dict) -> list[Video]:
    """The videos at a path. A short last frame is none; a video without a size has no frames."""
    store, root = located(path)
    found = []
    for x in _listed(store, root, options.get("pattern", "*.rgb24")):
        folder = x.type == pafs.FileType.Directory
        props = _told(store, f"{x.path}/{NAMED}" if folder else f"{x.path.rsplit('.', 1)[0]}.json")
        if folder and not props:
            continue
        width, height = (int(props.get(k, options.get(k, 0))) for k in ("width", "height"))
        fps, rate = (float(props.get(k, options.get(k, 0))) for k in ("fps", "bitrate_kbps"))
        parts, first = [], 0
        for name, n in [(f"{x.path}/{p['file']}", p["frames"]) for p in props["parts"]] if folder else [(x.path, x.size // (width * height * 3) if width > 0 and height > 0 else 0)]:
            parts.append((name, first, n))
            first += n
        name = x.base_name.rsplit(".", 1)[0]
        found.append(Video(unquote(name) if folder else name, x.path, width, height, fps if fps > LEAST_FPS else NO_FPS, max(rate, 0.0), tuple(parts)))
    return found


@dataclass
class Range:
    """What conditions leave of a number, and of names."""

    low: int = 0
    high: int = (1 << 62) - 1
    names: set[str] | None = None
    only: set[int] | None = None

    def take(self, f: Filter, number: str, name: str) -> bool:
        """Whether the condition is one that is met here."""
        if getattr(f, "attribute", None) == (number,):
            if isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value)
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                self.high = min(self.high, f.value - isinstance(f, LessThan))
            elif isinstance(f, In):
                values = {x for x in f.value if x is not None}
                self.only = values if self.only is None else self.only & values
            else:
                return False
            return True
        if getattr(f, "attribute", None) == (name,) and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            self.names = values if self.names is None else self.names & values
            return True
        return False

    def stretches(self, first: int, n: int, step: int) -> Iterator[tuple[int, int]]:
        """(from, to) inside first .. first + n, cut at multiples of step from first on, whatever is left of them."""
        if self.only is not None:
            for i in sorted(self.only):
                if max(first, self.low) <= i <= min(first + n - 1, self.high):
                    yield i, i + 1
            return
        low, high = max(first, self.low), min(first + n, self.high + 1)
        at = first + (low - first) // step * step
        while at < high:
            yield max(at, low), min(at + step, high)
            at += step


@dataclass
class Stretch(InputPartition):
    """Frames or samples from ``first`` on, at a place in a file."""

    path: str = ""
    offset: int = 0
    first: int = 0
    n: int = 0
    video: Video | None = field(default=None)
    name: str = ""


def _blocks(part: Stretch, size: int) -> Iterator[tuple[int, bytes]]:
    """(first, bytes) of a stretch, in whole items of ``size`` bytes."""
    if not part.n:
        return
    store, path = located(part.path)
    step = max(1, BATCH_BYTES // size)
    with store.open_input_file(path) as f:
        f.seek(part.offset)
        for at in range(0, part.n, step):
            n = min(step, part.n - at)
            data = f.read(n * size)
            if len(data) < n * size:
                raise EOFError(f"{part.path} has become shorter")
            yield part.first + at, data


class VideoReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.options, self.wanted = dict(options), Range()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return (f for f in list(filters) if not self.wanted.take(f, "frame_index", "video_id"))

    def partitions(self) -> list[Stretch]:
        most, seek = int(self.options.get("partition_bytes", PARTITION_BYTES)), self.options.get("seek")
        base = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
        found = []
        for v in videos(self.options["path"], self.options):
            if not v.frame_count or self.wanted.names is not None and v.video_id not in self.wanted.names:
                continue
            asked = self.wanted
            if seek is not None:
                at = min(max(int(seek), 0), v.frame_count - 1)
                asked = Range(max(at, asked.low), min(at, asked.high), only=asked.only)
            for path, first, n in v.parts:
                for low, high in asked.stretches(first, n, max(1, most // v.frame_bytes)):
                    found.append(Stretch(base + path if base and not base.startswith("file") else path, (low - first) * v.frame_bytes, low, high - low, Video(v.video_id, "", v.width, v.height, v.fps, 0.0, ())))
        return found or [Stretch()]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        v = partition.video
        for first, data in _blocks(partition, v.frame_bytes if v else 1):
            ix = np.arange(first, first + len(data) // v.frame_bytes)
            n, size = len(ix), v.frame_bytes
            pixels = pa.array([data[i * size : (i + 1) * size] for i in range(n)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([v.video_id] * n), pa.array(ix), pa.array(ix / v.fps), pa.array([v.width] * n, pa.int32()), pa.array([v.height] * n, pa.int32()), pixels], names=["video_id", "frame_index", "pts_sec", "width", "height", "pixels"])


@dataclass
class Written(WriterCommitMessage):
    """parts: (video_id, first frame, last frame, frames, staged file, width, height)."""

    parts: list[tuple[str, int, int, int, str, int, int]] = field(default_factory=list)


def even(n: int) -> int:
    return max(2, n - (n & 1))


class VideoWriter(DataSourceArrowWriter):
    """Frames, ordered by video and index within a task, as parts in a staging folder; the commit names them in order, an abort drops the folder."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.options, self.overwrite = dict(options), overwrite
        self.staging = f"{options['path'].rstrip('/')}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, staging = located(self.staging)
        store.create_dir(staging, recursive=True)
        parts: list[tuple] = []
        out, now = None, None
        try:
            for b in iterator:
                cols = [b.column(b.schema.get_field_index(c)) for c in ("video_id", "frame_index", "width", "height", "to_width", "to_height", "pixels")]
                for name, ix, w, h, to_w, to_h, data in zip(*(c.to_pylist() for c in cols), strict=True):
                    if not data:
                        continue
                    if now is None or now[0] != name:
                        if out:
                            out.close()
                            parts.append(tuple(now))
                        file = f"{staging}/{uuid.uuid4().hex}"
                        out, now = store.open_output_stream(file), [name, ix, ix, 0, file, even(to_w), even(to_h)]
                    if ix < now[2]:
                        raise ValueError(f"frame {ix} of {name} comes after {now[2]}")
                    picture = np.frombuffer(data, np.uint8).reshape(h, w, 3)
                    if (w, h) != (now[5], now[6]):
                        picture = resample.bilinear(picture, now[5], now[6])
                    out.write(picture.tobytes())
                    now[2], now[3] = ix, now[3] + 1
            if out:
                out.close()
                parts.append(tuple(now))
        except BaseException:
            if out:
                out.close()
            for p in [*parts, *([now] if now else [])]:
                if store.get_file_info(p[4]).type == pafs.FileType.File:
                    store.delete_file(p[4])
            raise
        return Written(parts)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.options["path"].rstrip("/"))
        by_video: dict[str, list[tuple]] = {}
        for m in messages:
            for p in m.parts if m else []:
                by_video.setdefault(p[0], []).append(p)
        for name, parts in by_video.items():
            parts.sort(key=lambda p: p[1])
            if any(a[2] > b[1] for a, b in zip(parts, parts[1:], strict=False)):
                raise ValueError(f"parts of {name} overlap")
            if len({p[5:] for p in parts}) > 1:
                raise ValueError(f"parts of {name} differ in size")
            if not self.overwrite and store.get_file_info(f"{root}/{quote(name, safe='')}.rgb24").type != pafs.FileType.NotFound:
                raise FileExistsError(f"{root}/{name}")
        for name, parts in by_video.items():
            folder = f"{root}/{quote(name, safe='')}.rgb24"
            if store.get_file_info(f"{folder}/{NAMED}").type == pafs.FileType.File:
                store.delete_file(f"{folder}/{NAMED}")  # from here on it is no video, until all of it is there
            if store.get_file_info(folder).type == pafs.FileType.Directory:
                store.delete_dir(folder)
            store.create_dir(folder)
            told = []
            for i, p in enumerate(parts):
                store.move(p[4], f"{folder}/part-{i:06d}")
                told.append({"file": f"part-{i:06d}", "frames": p[3]})
            fps = float(self.options.get("fps", 0))
            props = {"width": parts[0][5], "height": parts[0][6], "fps": fps if fps > LEAST_FPS else NO_FPS, "bitrate_kbps": float(self.options.get("bitrate_kbps", 0)), "parts": told}
            with store.open_output_stream(f"{folder}/{NAMED}") as f:
                f.write(json.dumps(props).encode())
        self._drop()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        store, staging = located(self.staging)
        if store.get_file_info(staging).type == pafs.FileType.Directory:
            store.delete_dir(staging)


class VideoSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_video"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> VideoReader:
        return VideoReader(self.options)

    def writer(self, schema, overwrite: bool) -> VideoWriter:
        return VideoWriter(self.options, overwrite)


class PropsReader(DataSourceReader):
    """One row for each video; nothing of its frames is read."""

    def __init__(self, options: dict) -> None:
        self.options = dict(options)

    def read(self, partition) -> Iterator[tuple]:
        for v in videos(self.options["path"], self.options):
            yield v.video_id, v.path, v.width > 0 and v.height > 0, v.width, v.height, v.fps, v.frame_count, v.bitrate_kbps


class PropsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_video_props"

    def schema(self) -> str:
        return PROPS

    def reader(self, schema) -> PropsReader:
        return PropsReader(self.options)


class PcmReader(DataSourceReader):
    """Mono little-endian 16-bit samples; half a sample at the end is left out, and so is what lies beyond ``duration`` seconds."""

    def __init__(self, options: dict) -> None:
        self.options, self.wanted = dict(options), Range()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        return (f for f in list(filters) if not self.wanted.take(f, "sample_ix", "video_id"))

    def partitions(self) -> list[Stretch]:
        store, root = located(self.options["path"])
        base = self.options["path"].split("://")[0] + "://" if "://" in self.options["path"] else ""
        step = max(1, int(self.options.get("partition_bytes", PARTITION_BYTES)) // 2)
        most = 1 << 62
        if (seconds := self.options.get("duration")) is not None:
            buckets = int(self.options.get("buckets", 1))
            most = max(1, math.ceil(float(self.options.get("rate", 8000)) * float(seconds) / buckets)) * buckets
        found = []
        for x in _listed(store, root, self.options.get("pattern", "*.s16")):
            name = x.base_name.rsplit(".", 1)[0]
            if self.wanted.names is None or name in self.wanted.names:
                path = base + x.path if base and not base.startswith("file") else x.path
                found += [Stretch(path, 2 * low, low, high - low, name=name) for low, high in self.wanted.stretches(0, min(x.size // 2, most), step)]
        return found or [Stretch()]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for first, data in _blocks(partition, 2):
            v = np.frombuffer(data, "<i2").astype(np.int32)
            for at in range(0, len(v), 1 << 16):
                part = v[at : at + (1 << 16)]
                ix = np.arange(first + at, first + at + len(part))
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * len(part)), pa.array(ix), pa.array(part)], names=["video_id", "sample_ix", "value"])


class PcmSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "raw_pcm"

    def schema(self) -> str:
        return SAMPLES

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)


def _read(spark: SparkSession, source: type[DataSource], path: str, options: dict) -> DataFrame:
    spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(source.name()).options(**{k: str(v) for k, v in options.items() if v is not None}).load(path)


def read_video(spark: SparkSession, path: str, **options) -> DataFrame:
    """Frames of the videos at a path. Options: width, height, fps, pattern, partition_bytes, seek (one frame of each video, brought into its range)."""
    return _read(spark, VideoSource, path, options)


def read_props(spark: SparkSession, path: str, **options) -> DataFrame:
    return _read(spark, PropsSource, path, options)


def read_pcm(spark: SparkSession, path: str, **options) -> DataFrame:
    """Samples of the files at a path. Options: pattern, partition_bytes; duration in seconds with rate and buckets, which read so many samples that the buckets cover it."""
    return _read(spark, PcmSource, path, options)


def write_video(frames: DataFrame, path: str, fps: float = NO_FPS, bitrate_kbps: float = 0.0, overwrite: bool = False) -> None:
    """A video per video_id, its frames in order; of the size of its first frame, made even, to which others are brought."""
    spark = frames.sparkSession
    spark.dataSource.register(VideoSource)
    first = frames.groupBy("video_id").agg(F.min_by(F.struct("width", "height"), "frame_index").alias("to"))
    sized = frames.join(first, "video_id").select("video_id", "frame_index", "width", "height", F.col("to.width").alias("to_width"), F.col("to.height").alias("to_height"), "pixels")
    ordered = sized.repartitionByRange("video_id", "frame_index").sortWithinPartitions("video_id", "frame_index")
    ordered.write.format("raw_video").mode("overwrite" if overwrite else "append").options(fps=str(fps), bitrate_kbps=str(bitrate_kbps)).save(path)
