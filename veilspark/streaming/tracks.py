"""Tracking as a streaming query: the batch step over state kept by video."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import tracking


class TrackProcessor(StatefulProcessor):
    """Frames of a video in order within and across micro-batches; a frame at or before the last one is late and is dropped."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("video", "state string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        video = tracking.Video.load(self.state.get()[0]) if self.state.exists() else tracking.Video()
        out: list[tuple] = []
        for row in pd.concat(list(rows)).sort_values("frame_index", kind="stable").itertuples(index=False):
            if video.last is None or row.frame_index > video.last:
                out += [(key[0], *r) for r in tracking.run_frame(video, row)]
        self.state.update((video.dump(),))
        yield pd.DataFrame(out, columns=tracking.COLUMNS)

    def close(self) -> None:
        pass


def track_stream(frames: DataFrame) -> DataFrame:
    """The visible tracks of a stream of frame rows (tracking.FRAMES). Needs the RocksDB state store."""
    return frames.groupBy("video_id").transformWithStateInPandas(TrackProcessor(), outputStructType=tracking.OUT, outputMode="Append", timeMode="None")


def with_store(spark) -> None:
    """The state store that keyed processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
