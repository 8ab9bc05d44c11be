"""Identity matching: unit vectors, nearest identity, tiers, running-mean centroids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# From where a match keeps a face clear, and from where it is suggested.
KEEP, SUGGEST = 0.62, 0.48


def dot(a: Column, b: Column) -> Column:
    """0 for empty vectors or vectors of different length."""
    s = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), s).otherwise(0.0)


def l2(v: Column) -> Column:
    """The vector at length one; the squared length counts as 1e-12 at least."""
    n = F.sqrt(F.greatest(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x), F.lit(1e-12)))
    return F.transform(v, lambda x: x / n)


def tier(score: Column) -> Column:
    """2: linked by itself, 3: suggested, 0: none."""
    return F.when(score >= KEEP, 2).when(score >= SUGGEST, 3).otherwise(0)


GALLERY_BYTES, TILE_ROWS, AT_ONCE = 16 << 20, 20_000, 256
_BEST = "vec_id long, score double, identity_id long"


def _best(gallery: pa.Table, probes: pa.Table) -> pa.Table:
    """The nearest of a gallery block for each probe of a tile; vectors of other lengths do not meet. Equal scores go to the smaller id."""
    ids = np.zeros(probes.num_rows, np.int64) - 1
    scores = np.zeros(probes.num_rows)
    sides = []
    for t, name in ((gallery, "identity_id"), (probes, "vec_id")):
        lists = t["e"].combine_chunks()
        n = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        sides.append((t[name].to_numpy(), n, np.r_[0, np.cumsum(n)], lists.flatten().to_numpy(zero_copy_only=False)))
    (g_ids, g_n, g_at, g_v), (p_ids, p_n, p_at, p_v) = sides
    for dim in np.unique(p_n[p_n > 0]):
        mine = np.flatnonzero(g_n == dim)
        if not len(mine):
            continue
        mine = mine[np.argsort(g_ids[mine], kind="stable")]
        g = g_v[g_at[mine][:, None] + np.arange(dim)]
        rows = np.flatnonzero(p_n == dim)
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at : at + AT_ONCE]
            s = p_v[p_at[some][:, None] + np.arange(dim)] @ g.T
            top = s.max(axis=1)
            first = (s >= top[:, None] - 1e-12).argmax(axis=1)  # equal vectors may differ in the last bit
            scores[some], ids[some] = np.where(top > 0, top, 0), np.where(top > 0, g_ids[mine][first], -1)
    return pa.table({"vec_id": p_ids, "score": scores, "identity_id": ids})


def nearest(probes: DataFrame, gallery: DataFrame, exclude: int = -1, block_bytes: int = GALLERY_BYTES, tile_rows: int = TILE_ROWS) -> DataFrame:
    """The nearest identity of each probe (vec_id, embedding), its score and tier.

    Only scores above 0 count, the smaller id wins ties. Below the suggestion threshold the identity is
    -1 but the score is reported. Every probe meets every identity: the gallery is cut into blocks of
    about ``block_bytes``, by its measured size, and probes into tiles of about ``tile_rows``; a block and a tile are
    multiplied in one task, and the best of all blocks is kept. Nothing is broadcast or collected.
    """
    g = gallery.where(F.col("identity_id") != exclude).select(F.col("identity_id").cast("long").alias("identity_id"), l2(F.col("embedding").cast("array<double>")).alias("e"))
    p = probes.select(F.col("vec_id").cast("long").alias("vec_id"), l2(F.col("embedding").cast("array<double>")).alias("e"))
    size = gallery.agg(F.sum(F.size("embedding") * F.lit(8).cast("long"))).first()[0] or 0
    blocks, tiles = int(1 + size // block_bytes), int(1 + probes.count() // tile_rows)
    parts = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = g.select("*", deal("identity_id", blocks).alias("block"), parts(tiles).alias("tile"))
    right = p.select("*", deal("vec_id", tiles).alias("tile"), parts(blocks).alias("block"))
    met = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile")).applyInArrow(_best, _BEST)
    order = F.struct("score", -F.col("identity_id"))
    found = met.groupBy("vec_id").agg(F.max_by(F.struct("score", "identity_id"), order).alias("b"))
    t = F.when(F.col("b.identity_id") < 0, 0).otherwise(tier(F.col("b.score")))
    return found.select("vec_id", F.when(t == 0, F.lit(-1).cast("long")).otherwise(F.col("b.identity_id")).alias("identity_id"), F.col("b.score").alias("score"), t.alias("tier"))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by label, then vec_id: one running vector and count are held, whatever a label's number of samples."""
    label, mean, n = None, None, 0

    def told(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.list_(pa.float64())), pa.array([r[2] for r in rows], pa.int32())], names=["label", "e", "n"])

    kind = None
    for b in batches:
        kind = b.column("label").type
        done = []
        for at, name in enumerate(b.column("label").to_pylist()):
            x = np.asarray(b.column("e")[at].values, dtype=np.float64)
            x = x / np.sqrt(max(float(np.dot(x, x)), 1e-12))
            if name != label or n == 0:
                if n:
                    done.append((label, mean.tolist(), n))
                label, mean, n = name, x, 1
            elif len(x) != len(mean):
                mean, n = x, 1
            else:
                mean = (mean * n + x) / (n + 1)
                mean, n = mean / np.sqrt(max(float(np.dot(mean, mean)), 1e-12)), n + 1
        if done:
            yield told(done)
    if n:
        yield told([(label, mean.tolist(), n)])


def centroids(samples: DataFrame) -> DataFrame:
    """An identity per label from its samples in order of vec_id: the running mean, at length one after every sample. A sample of another length starts anew.

    The order decides, so this is a fold over a label's samples as they come sorted, not an average.
    """
    rows = samples.where("label IS NOT NULL AND embedding IS NOT NULL").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("e"))
    out = T.StructType([samples.schema["label"], T.StructField("e", T.ArrayType(T.DoubleType())), T.StructField("n", T.IntegerType())])
    return rows.repartition("label").sortWithinPartitions("label", "vec_id").select("label", "e").mapInArrow(_folded, out)
