"""Exact top-k search in binary codes by incremental multi-index hashing (operator 6).

A 64-bit code is cut into m segments of about log2(n) bits for n codes, so that a segment's value
leads to about one code at any size. Two codes at distance at most m * (r + 1) - 1 agree in some
segment up to r bits. So every segment is looked up with radius 0, 1, 2 ..; every code found is
verified by its whole distance; and a query is done as soon as its k-th best distance is within
what the radius covers. No query stops before that and none is answered another way, so the result
is exact. The radius ends at the width of a segment, where everything is covered.

The index of a segment is dealt out by the high bits of its values, ``block`` codes to a bucket.
A query goes to the buckets whose high bits differ in up to r bits, and the flips that are left are
looked up there in a table over the low bits. A bucket gives a query at most its k + 1 nearest new
codes, none farther than the k-th known so far. Buckets (or sides of queries) that hold more than a
block, as where many codes share a segment's value, are cut into blocks that meet two at a time in
tasks of their own.

Both sides are distinct codes: a code that many rows share is looked up once and found once, with
its ``k + 1`` smallest ids (no result can hold more of one code; they are limited inside each task
before rows are shuffled).

Defined results: order is by distance, then id, so ties are settled; a query row is not its own
neighbour, but its copies are; a null or empty vector has no code: such a row is neither found nor
answered; a vector of more than 64 components is an error; rows repeated with their id count once;
fewer than k rows give all of them; no rows give no rows. Texts play no part, and further columns
are ignored.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join

BITS = 64
K = 10
BLOCK = 2048
PAIRS = 1 << 20  # verified at a time in a task
FOUND = "q long, code long, least long, n int, dist int"


def sign_code(vector: Column) -> Column:
    """64 bits: bit i is set if the i-th component is positive; null without components, an error beyond 64."""
    bits = F.transform(vector, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    return F.when(F.size(vector) > BITS, F.raise_error(F.lit(f"a code has {BITS} bits: longer vectors must be projected first")).cast("long")).when(F.size(vector) > 0, code)


def segments(n: int) -> list[tuple[int, int]]:
    """(shift, width) of the segments for n codes: 2 to 8 of them, as even as can be."""
    m = min(8, max(2, round(BITS / log2(max(4, n)))))
    ends = [BITS * i // m for i in range(m + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _flips(width: int, bits: int) -> list[int]:
    """All masks of so many bits."""
    return [sum(1 << b for b in c) for c in combinations(range(width), bits)]


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def _look_up(q: np.ndarray, limit: np.ndarray, turns: np.ndarray, code: np.ndarray, least: np.ndarray, n: np.ndarray, shift: int, low: int, need: int) -> list[np.ndarray]:
    """What one bucket gives its queries: turns says how many low bits each query still flips."""
    mask = np.uint64((1 << low) - 1)
    value = ((code.view(np.uint64) >> np.uint64(shift)) & mask).astype(np.int64)
    order = np.argsort(value, kind="stable")
    code, least, n = code[order], least[order], n[order]
    starts = np.searchsorted(value[order], np.arange((1 << low) + 1))
    at = ((q.view(np.uint64) >> np.uint64(shift)) & mask).astype(np.int64)
    found: list[list[np.ndarray]] = [[], [], [], [], []]
    for turn in np.unique(turns):
        flips = np.array(_flips(low, int(turn)), dtype=np.int64)
        mine = np.flatnonzero(turns == turn)
        if not len(flips):
            continue
        step = max(1, PAIRS // max(len(flips), len(code)))
        for part in (mine[i : i + step] for i in range(0, len(mine), step)):
            v = at[part][:, None] ^ flips[None, :]
            per = (starts[v + 1] - starts[v]).ravel()
            row = np.repeat(np.repeat(part, len(flips)), per)
            c = np.repeat(starts[v].ravel() - (np.cumsum(per) - per), per) + np.arange(per.sum())
            dist = np.bitwise_count(code[c].view(np.uint64) ^ q[row].view(np.uint64)).astype(np.int32)
            near = np.flatnonzero(dist <= limit[row])
            row, c, dist = row[near], c[near], dist[near]
            best = np.lexsort((least[c], dist, row))
            row, c, dist = row[best], c[best], dist[best]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, int)
            nth = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            top = nth < need
            for into, x in zip(found, (q[row[top]], code[c[top]], least[c[top]], n[c[top]], dist[top]), strict=True):
                into.append(x)
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in found]


def _searcher(parts: list[tuple[int, int]], high: list[int], need: int):
    def run(key: tuple, asked: pa.Table, kept: pa.Table) -> pa.Table:
        s = int(key[0].as_py())
        shift, width = parts[s]
        col = lambda t, c: t.column(c).to_numpy()
        got = _look_up(col(asked, "q"), col(asked, "upto"), col(asked, "turns"), col(kept, "code"), col(kept, "least"), col(kept, "n"), shift, width - high[s], need) if asked.num_rows and kept.num_rows else [np.zeros(0, np.int64)] * 5
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("q", "code", "least", "n", "dist"), got, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    return run


def _in_buckets(code: str, parts: list[tuple[int, int]], high: list[int]) -> Column:
    """By segment: s and b, the high bits of its value."""
    return F.array(*(F.struct(F.lit(s).alias("s"), _segment(F.col(code), shift + width - high[s], high[s]).alias("b")) for s, (shift, width) in enumerate(parts)))


def _probes(left: DataFrame, radius: int, parts: list[tuple[int, int]], high: list[int]) -> DataFrame:
    """q, upto, s, b, turns: the buckets that a query looks into at this radius, and the flips left for their low bits."""
    tables = []
    for s, (_, width) in enumerate(parts):
        low = width - high[s]
        flips = [(m, radius - j) for j in range(min(radius, high[s]) + 1) if radius - j <= low for m in _flips(high[s], j)]
        tables.append(",".join(f"{m}:{t}" for m, t in flips))
    listed = F.array(*(F.filter(F.split(F.lit(x), ","), lambda e: e != "") for x in tables))
    out = left.select("q", "upto", F.explode(_in_buckets("q", parts, high)).alias("e")).select("q", "upto", "e.s", "e.b", F.explode(F.get(listed, F.col("e.s"))).alias("f"))
    f = F.split("f", ":")
    return out.select("q", "upto", "s", F.col("b").bitwiseXOR(F.get(f, F.lit(0)).cast("long")).alias("b"), F.get(f, F.lit(1)).cast("int").alias("turns"))


def _blocks(df: DataFrame, sizes: DataFrame, mine: str, other: str, by: str) -> DataFrame:
    """df's rows with i and j: their own block by hash, and each block of the other side."""
    of = df.join(sizes, ["s", "b"])
    of = of.withColumn("own", F.pmod(F.xxhash64(by), F.col(mine)).cast("int")).withColumn("met", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    i, j = ("own", "met") if mine == "nq" else ("met", "own")
    return of.withColumns({"i": F.col(i), "j": F.col(j)}).drop("own", "met", "nq", "nc")


def search(queries: DataFrame, rows: DataFrame, k: int = K, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), neighbour_id, distance, radius (at which the query was covered). queries and rows have ``id`` and ``code``; queries are rows too."""
    need = k + 1  # a query finds itself
    rows = rows.where("code is not null and id is not null").select("id", "code").distinct()
    nth = F.row_number().over(Window.partitionBy("code").orderBy("id"))
    ids = rows.withColumn("nth", nth).where(F.col("nth") <= need).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    codes = cut(ids.select("code", "ids", F.col("ids")[0].alias("least"), F.size("ids").alias("n")))
    n_codes, n_rows = codes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = queries.where("code is not null and id is not null").select("id", "code").distinct()
    parts = segments(n_codes)
    high = [min(width - 1, max(0, ceil(log2(max(1, n_codes) / block)))) for _, width in parts]
    index = cut(codes.select("code", "least", "n", F.explode(_in_buckets("code", parts, high)).alias("e")).select("e.s", "e.b", "code", "least", "n"))
    held = index.groupBy("s", "b").agg(F.ceil(F.count("*") / block).cast("int").alias("nc"))
    entry = F.struct("dist", "least", "code", "n")
    nothing = F.from_json(F.lit("[]"), "array<struct<dist:int,least:bigint,code:bigint,n:int>>")
    state = cut(asked.select(F.col("code").alias("q")).distinct().select("q", nothing.alias("best"), F.lit(BITS).alias("kth"), F.lit(-1).alias("radius")))
    covered, done = -1, []
    enough = min(need, n_rows)
    for radius in range(max(w for _, w in parts) + 1):
        left = state.where(F.col("kth") > covered)
        if radius and not left.limit(1).count():
            break
        probes = _probes(left.select("q", F.col("kth").alias("upto")), radius, parts, high)
        sizes = probes.groupBy("s", "b").agg(F.ceil(F.count("*") / block).cast("int").alias("nq")).join(held, ["s", "b"])
        met = _blocks(probes, sizes, "nq", "nc", "q").groupBy("s", "b", "i", "j").cogroup(_blocks(index, sizes, "nc", "nq", "code").groupBy("s", "b", "i", "j"))
        found = met.applyInArrow(_searcher(parts, high, need), FOUND)
        known = left.select("q", F.explode_outer("best").alias("e")).select("q", "e.code", "e.least", "e.n", "e.dist")
        each = found.unionByName(known).distinct()
        best = each.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.col("dist").asc_nulls_last(), "least"))).where(F.col("nth") <= need)
        listed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.when(F.col("code").isNotNull(), entry))).alias("best"))
        reach = F.aggregate("best", F.struct(F.lit(0).alias("rows"), F.lit(BITS).alias("kth")), lambda acc, e: F.struct((acc["rows"] + e["n"]).alias("rows"), F.when((acc["rows"] < enough) & (acc["rows"] + e["n"] >= enough), e["dist"]).otherwise(acc["kth"]).alias("kth")), lambda acc: acc["kth"])
        covered = len(parts) * (radius + 1) - 1
        done.append(state.where(F.col("kth") <= covered - len(parts)))
        state = cut(listed.select("q", "best", reach.alias("kth"), F.lit(radius).alias("radius")))
    answered = state
    for d in done:
        answered = answered.unionByName(d)
    per_code = answered.select("q", "radius", F.explode("best").alias("e")).select("q", "radius", "e.dist", F.col("e.code").alias("code"))
    named = spread_join(per_code, codes.select("code", "ids"), ["code"]).select("q", "radius", F.explode(F.transform("ids", lambda i: F.struct(F.col("dist").alias("dist"), i.alias("id")))).alias("e"))
    lists = cut(named.groupBy("q", "radius").agg(F.slice(F.array_sort(F.collect_list("e")), 1, need).alias("nearest")))
    out = spread_join(asked.select(F.col("id").alias("query_id"), F.col("code").alias("q")), lists, ["q"])
    others = F.slice(F.filter("nearest", lambda e: e["id"] != F.col("query_id")), 1, k)
    return out.select("query_id", "radius", F.posexplode(others).alias("at", "e")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("e.id").alias("neighbour_id"), F.col("e.dist").alias("distance"), "radius")
