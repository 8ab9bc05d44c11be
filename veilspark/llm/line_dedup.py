"""Line dedup by a suffix array over line-ID sequences (operator 10).

Every line that has a word is a symbol; a document is a sequence of them. Suffixes are ranked by
distributed prefix doubling: at depth 1 a suffix stands at the place of its line in the order of
line hashes, and at depth 2h at the place of its pair (rank at i, rank at i + h). A rank is the
place of the first suffix of its class, so ranks of all depths compare. Places are given to distinct
pairs and their counts, so a very common line costs one row, and counts by stretches of the order
make them global. A suffix whose class is itself alone, or whose class has come
to the ends of its documents, is settled; the doubling ends when all suffixes are.

Settled classes are the entries of the suffix array. The longest common prefix of neighbouring
entries is found from the ranks of every depth, greatest depth first: where both have one rank at
depth h, they share h lines and are compared h lines on. Longest stretches of neighbours whose
common prefixes have ``min_lines`` lines are the intervals: the earliest suffix of an interval (by
document, then position) is the original, and at each other one a later copy stands. A line of at
least ``min_words`` words is deleted by itself, too: there the interval is the class at depth 1.
Copies that overlap or touch make a maximal run; the lines of runs go, the originals stay.

Defined results: a null or empty text has no lines and stays as it is; a line without a word is
no symbol and stays, but a text that loses all its other lines becomes empty; a text of any length
is handled whole, its lines one row each; rows that share a ``doc_id`` are documents of their own,
ordered by text; a row without ``doc_id`` stays as it is and is no original; no rows give no rows.
Further columns pass through, whatever their names; one that is named like a result column gives
way to it.

Intermediate tables are written as files in the shared folder: a checkpoint would compute its last
stage twice and carry the constraints of all joins before it into every later plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACES, spread_join, words, write_table

MIN_LINES, MIN_WORDS = 2, 8
RESULTS = ("n_lines", "n_deleted", "n_runs")
LAST = 2**63 - 1  # stands behind every rank
BEFORE = (Window.unboundedPreceding, -1)


def numbered(docs: DataFrame) -> DataFrame:
    """row (the whole row) and d: a key of its own for each row that has a doc_id, null for the others."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    twice = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    doc = F.col("row.doc_id").cast("long")
    if not twice:
        return rows.withColumn("d", doc)
    nth = F.row_number().over(Window.partitionBy("row.doc_id").orderBy("row.text"))
    return rows.withColumn("nth", nth).select("row", F.when(F.col("row.doc_id").isNotNull(), F.struct(doc.alias("doc"), F.col("nth"))).alias("d"))


def line_table(keyed: DataFrame, min_words: int) -> DataFrame:
    """d, i (position among the lines with a word), left (lines from there to the end), a, b (128 bits of line hash), heavy (whether it has min_words words)."""
    lines = F.filter(F.split("row.text", "\n", -1), lambda x: F.rtrim(x, F.lit(SPACES)) != "")
    rows = keyed.where("d is not null and row.text is not null").select("d", lines.alias("lines"))
    rows = rows.select("d", F.size("lines").alias("all"), F.posexplode("lines").alias("i", "t"))
    return rows.select("d", "i", (F.col("all") - F.col("i")).alias("left"), F.xxhash64("t").alias("a"), F.xxhash64(F.lit(1), "t").alias("b"), (F.size(words(F.col("t"))) >= min_words).alias("heavy"))


def _buckets(total: int) -> int:
    """How many stretches the places of so many suffixes are cut into."""
    return max(64, total // 200_000)


def _stretch(place: Column, buckets: int, total: int) -> Column:
    return F.floor(place.cast("double") * buckets / (total + 1)).cast("int")


def _before(kinds: DataFrame, within: list[str], by: list[str]) -> DataFrame:
    """kinds with ``before``: how many suffixes (n) come before each kind, of its class (within) or of all.

    They are counted inside the kind's ``bucket``, a stretch of the order, and over the buckets before
    it; so a class of any size is counted in many tasks, and what is ordered at once is a bucket or a
    row per bucket.
    """
    inside = F.sum("n").over(Window.partitionBy(*within, "bucket").orderBy(*by).rowsBetween(*BEFORE))
    dealt = kinds.withColumn("inside", F.coalesce(inside, F.lit(0)))
    ahead = F.sum("held").over(Window.partitionBy(*within).orderBy("bucket").rowsBetween(*BEFORE))
    per = dealt.groupBy(*within, "bucket").agg(F.sum("n").alias("held")).select(*within, "bucket", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return dealt.join(per, [*within, "bucket"]).withColumn("before", F.col("inside") + F.col("ahead")).drop("bucket", "inside", "ahead")


ORDERED = 100_000  # rows of a class that one task sorts
AT_ONCE = 8  # how many times as deep a pass goes where all classes are that small


def _told_apart(active: DataFrame, then: list[str]) -> DataFrame:
    """Suffixes with the rank and n of their tuple, where each class has at most ORDERED rows: a class is sorted at once."""
    place = F.rank().over(Window.partitionBy("rank").orderBy(*then))
    same = Window.partitionBy("rank", *then)
    return active.select("*", place.alias("place"), F.count("*").over(same).alias("n"), F.max("left").over(same).alias("longest")).withColumn("rank", F.col("rank") + F.col("place") - 1)


def _told_apart_by_stretches(active: DataFrame, then: list[str], buckets: int, total: int) -> DataFrame:
    """The same for pairs in classes of any size: distinct pairs are counted and placed, then joined back."""
    alone = F.pmod(F.xxhash64("own_d", "own_i"), F.lit(buckets)) + buckets
    bucket = F.when(F.col("own_i") < 0, _stretch(F.col("t1"), buckets, total)).otherwise(alone).cast("int")
    kinds = active.groupBy("rank", *then).agg(F.count("*").alias("n"), F.max("left").alias("longest")).withColumn("bucket", bucket)
    told = _before(kinds, ["rank"], then)
    return spread_join(active, told, ["rank", *then], counts=told).withColumn("rank", F.col("rank") + F.col("before"))


def suffix_levels(lines: DataFrame) -> list[tuple[int, DataFrame]]:
    """Depth 1, 2 and on, each with d, i, left, top (rank at depth 1), rank, n (of the class), heavy, later (of depth 1), open; until no suffix is open.

    A level has the suffixes that share their first lines with others at the depth before; open are
    those whose class has to be told apart further. A window over each document gives the rank so
    many lines on; where all classes are small, one pass takes three doublings: it goes by the ranks
    1, 2 .. 7 depths on.
    """
    total = lines.count()
    buckets = _buckets(total)
    kinds = lines.groupBy("a", "b").agg(F.count("*").alias("n"), F.max("left").alias("longest"), F.min(F.struct("d", "i")).alias("first")).where("n > 1")
    high = F.floor((F.col("a").cast("double") + 2.0**63) * (buckets / 2.0**64)).cast("int")
    kinds = write_table(_before(kinds.withColumn("bucket", high), [], ["a", "b"]).select("a", "b", "n", "first", (F.col("before") + 1).alias("rank"), (F.col("longest") > 1).alias("open")), "kinds")
    now = spread_join(lines, kinds, ["a", "b"], counts=kinds)
    later = (F.col("first.d") != F.col("d")) | (F.col("first.i") != F.col("i"))
    keep = ["d", "i", "left", "top", "heavy", "later"]
    levels = [(1, write_table(now.select("d", "i", "left", F.col("rank").alias("top"), "heavy", later.alias("later"), "rank", "n", "open"), "depth-1"))]
    while most := [r["n"] for r in levels[-1][1].where("open").select("n").orderBy(F.desc("n")).limit(1).collect()]:
        h, now = levels[-1]
        ranks = now.select(*keep, "rank", "open")
        for _, x in levels[:-1]:
            ranks = ranks.union(x.where("not open").select(*keep, "rank", "open"))
        small = most[0] <= ORDERED
        steps = AT_ONCE if small and h > 1 else 2
        names = [f"t{k}" for k in range(1, steps)]
        # at a document's end nothing follows (0 stands before every rank); a line that occurs once makes the suffix one of its own
        there = {n: F.max("rank").over(Window.partitionBy("d").orderBy("i").rangeBetween(k * h, k * h)) for k, n in enumerate(names, 1)}
        asked = ranks.withColumns(there).where("open")
        asked = asked.withColumns({n: F.when(F.col("left") <= k * h, F.lit(0)).otherwise(F.coalesce(n, F.lit(LAST))) for k, n in enumerate(names, 1)})
        alone = F.greatest(*names, F.lit(0)) == LAST
        asked = asked.withColumns({"own_d": F.when(alone, F.col("d").cast("string")).otherwise(""), "own_i": F.when(alone, F.col("i")).otherwise(-1)})
        then = [*names, "own_d", "own_i"]
        told = _told_apart(asked, then) if small else _told_apart_by_stretches(write_table(asked.select(*keep, "rank", *then), "asked"), then, buckets, total)
        told = told.select(*keep, "rank", "n", ((F.col("n") > 1) & (F.col("longest") > steps * h)).alias("open"))
        levels.append((steps * h, write_table(told, f"depth-{steps * h}")))
    return levels


def suffix_array(levels: list[tuple[int, DataFrame]], most: int | None = None) -> DataFrame:
    """Entries in the order of rank: rank, n (equal suffixes), first (the earliest, by d and i), lcp (lines shared with the entry before).

    most: up to how many lines common prefixes are told; what is longer counts as so long. A prefix of
    so many lines asks for the greatest depth within it only, so few ranks are looked up.
    """
    settled = None
    for k, (_, x) in enumerate(levels):
        part = x.where("not open").select("rank", "top", "d", "i", F.lit(k).alias("level"))
        settled = part if settled is None else settled.union(part)
    entries = write_table(settled.groupBy("rank", "top").agg(F.count("*").alias("n"), F.min(F.struct("d", "i")).alias("first"), F.max("level").alias("level")), "entries")
    before = entries.select((F.col("rank") + F.col("n")).alias("rank"), "top", F.col("first").alias("p"), F.col("level").alias("p_level"))
    ends = [F.col(f"{x}.{c}").alias(f"{y}{c}") for x, y in (("p", "p"), ("first", "q")) for c in ("d", "i")]
    depths = [h for h, _ in levels]
    upto = max(0, len(depths) - 2 if most is None else min(len(depths) - 2, max(k for k, h in enumerate(depths) if h <= most)))
    # what settles at a level has not so many lines in common with anything else; with one rank at depth 1, one line is shared
    depth = F.least("level", "p_level", F.lit(upto + 1)) - 1
    pairs = write_table(entries.join(before, ["rank", "top"]).select("rank", *ends, depth.alias("depth"), F.when(depth == 0, 1).otherwise(0).alias("lcp")), "pairs")
    going = pairs.where("false").drop("depth")
    for k in range(upto, 0, -1):
        times = depths[k + 1] // depths[k] - 1
        times = times if most is None or k < upto else min(times, most // depths[k])
        going = pairs.where(F.col("depth") == k).drop("depth").union(going)
        for _ in range(times):
            going = _compared(going, levels[k][1], "rank", depths[k])
        going = write_table(going, f"shared-{depths[k]}") if k > 1 else going
    told = pairs.where("depth = 0").drop("depth")
    told = told.union(_compared(going, levels[0][1], "top", 1)) if upto else told
    return entries.drop("level", "top").join(told.select("rank", "lcp"), "rank", "left").withColumn("lcp", F.coalesce("lcp", F.lit(0)))


def _compared(going: DataFrame, level: DataFrame, rank: str, depth: int) -> DataFrame:
    """Pairs that share lcp lines: whether they share so many more."""
    cols = going.columns
    for side in ("p", "q"):
        there = level.select(F.col("d").alias(f"{side}d"), F.col("i").alias("at"), F.col(rank).alias(f"{side}r"))
        going = going.withColumn("at", F.col(f"{side}i") + F.col("lcp")).join(there, [f"{side}d", "at"], "left").drop("at")
    more = F.when(F.col("pr") == F.col("qr"), depth).otherwise(0)
    return going.withColumn("lcp", F.col("lcp") + more).select(*cols)


def intervals(array: DataFrame, min_lines: int, total: int) -> DataFrame:
    """rank, n, first (of the whole interval) of every entry, with the interval it lies in: neighbours that share min_lines lines.

    An interval goes on from where it last began, in the entry's own stretch of places or, where none
    began there, in the stretches before.
    """
    buckets = _buckets(total)
    dealt = array.withColumn("bucket", _stretch(F.col("rank"), buckets, total)).withColumn("begins", F.when(F.col("lcp") < min_lines, F.col("rank")))
    inside = F.last("begins", ignorenulls=True).over(Window.partitionBy("bucket").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    over = F.last("begun", ignorenulls=True).over(Window.orderBy("bucket").rowsBetween(*BEFORE))
    per = dealt.groupBy("bucket").agg(F.max("begins").alias("begun")).select("bucket", over.alias("over"))
    named = write_table(dealt.withColumn("inside", inside).join(per, "bucket").select("rank", "n", "first", F.coalesce("inside", "over").alias("interval")), "intervals")
    whole = named.groupBy("interval").agg(F.min("first").alias("whole"), F.count("*").alias("n"))
    return spread_join(named, whole.select("interval", "whole"), ["interval"], counts=whole).select("rank", "n", F.col("whole").alias("first"))


def repeated_lines(keyed: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """d, i of each line that lies in a later copy."""
    if min_lines < 1:
        raise ValueError("min_lines must be at least 1")
    levels = suffix_levels(write_table(line_table(keyed, min_words), "lines"))
    single = levels[0][1].where("later" if min_lines == 1 else "later and heavy").select("d", "i")
    if min_lines == 1:
        return single
    found = write_table(intervals(suffix_array(levels, min_lines), min_lines, levels[0][1].count()), "found")
    suffixes = None
    for _, x in levels:
        part = x.where(f"not open and left >= {min_lines}").select("rank", "d", "i")
        suffixes = part if suffixes is None else suffixes.union(part)
    suffixes = spread_join(suffixes, found, ["rank"], counts=found)
    copies = suffixes.where((F.col("first.d") != F.col("d")) | (F.col("first.i") != F.col("i")))
    runs = copies.select("d", F.explode(F.sequence(F.col("i"), F.col("i") + (min_lines - 1))).alias("i"))
    return single.union(runs).distinct()


def maximal_runs(lines: DataFrame) -> DataFrame:
    """d, start, n_lines of the maximal runs of consecutive positions."""
    island = F.col("i") - F.row_number().over(Window.partitionBy("d").orderBy("i"))
    return lines.withColumn("island", island).groupBy("d", "island").agg(F.min("i").alias("start"), F.count("*").alias("n_lines")).drop("island")


def _without(text: str, gone: np.ndarray) -> tuple[str, int, int, int]:
    """The text that is left; lines with a word; deleted ones; runs of these."""
    lines = text.split("\n")
    symbols = [j for j, x in enumerate(lines) if x.rstrip(SPACES)]
    at = set(gone)
    out = {symbols[i] for i in at}
    left = "\n".join(x for j, x in enumerate(lines) if j not in out) if len(out) < len(symbols) else ""
    return left, len(symbols), len(out), sum(i - 1 not in at for i in at)


def delete_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs with their text less the later copies, and ``n_lines``, ``n_deleted`` and ``n_runs``."""
    docs = docs.drop(*RESULTS)
    keyed = numbered(docs)
    gone = repeated_lines(keyed, min_lines, min_words).groupBy("d").agg(F.collect_list("i").alias("gone"))
    joined = keyed.join(gone, "d", "left").select("row", "gone")
    names = [*docs.columns, *RESULTS]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.IntegerType()) for c in RESULTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column("row")
            cols = dict(zip((f.name for f in row.type), row.flatten(), strict=True))
            texts, told = [], []
            for text, gone in zip(cols["text"].to_pylist(), b.column("gone").to_pylist(), strict=True):
                got = _without(text or "", gone or [])
                texts.append(got[0] if gone else text)
                told.append(got[1:])
            cols["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols.values(), *(pa.array([t[k] for t in told], pa.int32()) for k in range(len(RESULTS)))], names=names)

    return joined.mapInArrow(run, schema)


def clean_documents(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs without later copies of lines; n_chars follows the text; what has lost every line goes."""
    asked = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS), F.struct(*(F.col(f"`{c}`") for c in RESULTS if c in docs.columns), F.lit(0).alias("_")).alias("n_lines_kept_aside")) if set(RESULTS) & set(docs.columns) else docs
    out = delete_lines(asked, min_lines, min_words).where("n_deleted = 0 or text != ''")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"n_lines_kept_aside.{c}").alias(c) if c in RESULTS else F.col(f"`{c}`") for c in docs.columns))
