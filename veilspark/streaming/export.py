"""The export flow as a streaming query: frames held in state until what appears behind them is known."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.media import HOLD_LEAST
from ..operators import pixels
from ..operators.timeline import LOOKAHEAD

#: rects and new: 32-bit x, y, w, h one after another; last: whether the video ends here.
INPUT = "video_id string, frame_index long, width int, height int, pixels binary, rects binary, new binary, last boolean"
OUTPUT = "video_id string, frame_index long, width int, height int, pixels binary, rects binary"
HELD = "frame_index long, width int, height int, pixels binary, rects binary"


class HoldProcessor(StatefulProcessor):
    """Frames of a video in order within and across micro-batches, let go ``hold`` frames later, at the last frame, or when none has come for ``idle_ms``.

    State is the frames that are held and the last frame's number, both typed. A frame at or before
    the last one is late and is dropped.
    """

    def __init__(self, mode: str, hold: int, ahead: int, idle_ms: int) -> None:
        self.mode, self.hold, self.ahead, self.idle_ms = mode, hold, ahead, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", HELD)
        self.seen = handle.getValueState("seen", "frame_index long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [list(x) for x in self.held.get()] if self.held.exists() else []
        seen = self.seen.get()[0] if self.seen.exists() else None
        out: list[list] = []
        for row in pd.concat(list(rows)).sort_values("frame_index", kind="stable").itertuples(index=False):
            if seen is not None and row.frame_index <= seen:
                continue
            seen = int(row.frame_index)
            if row.new:
                for h in held:
                    if h[0] >= seen - self.ahead:
                        h[4] = bytes(h[4]) + bytes(row.new)
            held.append([seen, int(row.width), int(row.height), bytes(row.pixels), bytes(row.rects or b"")])
            while held and (row.last or len(held) > self.hold):
                out.append(held.pop(0))
        self._kept(held, seen)
        if self.idle_ms >= 0:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield self._masked(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = [list(x) for x in self.held.get()] if self.held.exists() else []
        self._kept([], self.seen.get()[0] if self.seen.exists() else None)
        yield self._masked(key, held)

    def _kept(self, held: list[list], seen: int | None) -> None:
        if held:
            self.held.put([tuple(h) for h in held])
        else:
            self.held.clear()
        if seen is not None:
            self.seen.update((seen,))

    def _masked(self, key, out: list[list]) -> pd.DataFrame:
        rows = []
        for frame, w, h, data, rects in out:
            boxes = [dict(zip("xywh", map(int, r), strict=True)) for r in np.frombuffer(rects, "<i4").reshape(-1, 4)]
            done = pixels.mask(np.frombuffer(data, np.uint8).reshape(h, w, 3), boxes, self.mode).tobytes()
            rows.append((key[0], frame, w, h, done, bytes(rects)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def export_stream(frames: DataFrame, mode: str = "mosaic", hold: int = HOLD_LEAST, ahead: int = LOOKAHEAD, idle_ms: int = 10_000) -> DataFrame:
    """Masked frames of a stream of INPUT rows. Needs the RocksDB state store (``streaming.tracks.with_store``).

    With a negative ``idle_ms`` only the end mark lets the last frames go, and a query over what is available ends by itself.
    """
    if hold < ahead:
        raise ValueError("frames must be held for as long as is looked ahead")
    return frames.groupBy("video_id").transformWithStateInPandas(HoldProcessor(mode, hold, ahead, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime" if idle_ms >= 0 else "None")
