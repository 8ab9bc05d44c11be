"""Peaks cover the whole audio when its length sets the samples per bucket."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilspark.operators import timeline as tl


def test_peaks_cover_videos_of_any_length(spark):
    s = spark.createDataFrame([(v, i, 16384 if i == n - 1 else 328) for v, n in ((1, 1000), (2, 7), (3, 25)) for i in range(n)], "video_id long, sample_ix long, value int")
    got = {(r.video_id, r.bucket): r.peak for r in tl.peaks(s, None, 10).collect()}
    assert len(got) == 30
    assert got[1, 9] == 0.5 and got[2, 6] == 0.5 and got[3, 8] == 0.5  # the loudest sample is the last one
    assert got[2, 7] == got[3, 9] == 0.5 * 0.15 and got[1, 8] == 328 / 32768
    top = tl.soft_normalise(tl.peaks(s, None, 10)).groupBy("video_id").agg(F.max("peak").alias("top")).collect()
    assert all(abs(r.top - 0.92) < 1e-12 for r in top)
