"""Mixing sources to target weights by iterative proportional fitting (operator 4). DataFrame functions only.

Documents fall into cells of source, language and topic (here the form of a text). Starting from
the tokens of each cell, weights are raked in turn to the source, language and topic marginals of
the tokens to be drawn, ``fraction`` of the corpus, until all three hold; no cell can give more than
all its tokens. Then every document is drawn with its cell's probability, weight over tokens, by a
hash of its id, so the draw is the same every time and holds the marginals in expectation.

Marginals come as a mapping or as an exponent (shares proportional to tokens to that power, which
lifts what is small). A value whose target is beyond its tokens is drawn whole, and the other targets
are scaled up. Where targets still cannot be met together, ``gap`` tells how far off the worst is.
Cells are counted over all documents. There are as many cells as there are combinations of source,
language and topic, however many documents; cells are joined back by broadcast, and raked in one
task, only up to ``FEW_CELLS`` of them.

Defined results: a null text has no tokens; a text of any length is read whole; a document without
tokens has the probability of its cell; a cell without tokens is drawn whole; null source, language
or topic is a value of its own; a target for a value that no token has is left out and the others
are scaled up; a value without a target gets weight zero; repeated rows are drawn alike; no rows give
no rows. Further columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

DIMENSIONS = ("source", "lang", "topic")
ROUNDS, TOLERANCE, FRACTION, SEED = 120, 1e-5, 0.6, 11
ROUNDS_PER_CUT = 6
FEW_CELLS = 20_000
#: By default small sources and languages are lifted, and so are rare topics.
TARGETS: dict[str, float | Mapping[str, float]] = {"source": 0.5, "lang": 0.7, "topic": 0.8}


def n_tokens(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def topic(text: Column) -> Column:
    """The form of a text as its topic: markup, shouting, table, short or prose."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(t.rlike(r"[#*$%&]{3}"), "markup")
        .when(F.contains(t, F.lit("!! ")), "shout")
        .when(F.contains(t, F.lit(" | ")), "table")
        .when(F.length(t) < 400, "short")
        .otherwise("prose")
    )


def with_cells(docs: DataFrame) -> DataFrame:
    """row (the whole row), ``_source``, ``_lang``, ``_topic`` (never null) and ``_tokens``."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = {f"_{c}": F.coalesce(F.col(f"row.{c}").cast("string"), F.lit("")) for c in ("source", "lang")}
    return rows.withColumns(named | {"_topic": topic(F.col("row.text")), "_tokens": n_tokens(F.col("row.text"))})


def _wanted(cells: DataFrame, dim: str, target: float | Mapping[str, float], fraction: float) -> DataFrame:
    """By value of one dimension the share of the drawn tokens it should have; the shares add up to 1.

    A value cannot have more than all its tokens. Where its target asks for that, it gets these, and
    the others' targets are scaled up by one factor: the greatest of those that come out if the first
    0, 1, 2 .. values are full, by how soon they are. One row per value.
    """
    by = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("t"))
    if isinstance(target, Mapping):
        given = cells.sparkSession.createDataFrame([(str(k), float(v)) for k, v in target.items()], f"{dim} string, want double")
        raw = by.join(given, dim, "left").select(dim, "t", F.coalesce("want", F.lit(0.0)).alias("want"))
    else:
        raw = by.select(dim, "t", F.pow("t", F.lit(float(target))).alias("want"))
    every = Window.partitionBy(F.lit(0))
    raw = raw.coalesce(1).withColumn("most", F.col("t") / (F.sum("t").over(every) * fraction))
    soonest = Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("want") / F.col("most")), dim)
    full = F.coalesce(F.sum("most").over(soonest.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("want").over(soonest.rowsBetween(0, Window.unboundedFollowing))
    scaled = raw.withColumn("by", F.when(rest > 0, (1 - full) / rest))
    return scaled.select(dim, F.least("most", F.col("want") * F.max("by").over(every)).alias(f"want_{dim}"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, fraction: float = FRACTION, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (the dimensions, tokens) with ``weight``, their share of the drawn tokens, and ``gap``.

    A step scales every cell by wanted over present weight of its value, but never beyond all its
    tokens; what full cells cannot take goes to the others in the next rounds. gap is the greatest
    share of tokens by which a marginal is off in the end: 0 where the targets can be met together.
    Up to FEW_CELLS cells are worked on in one task; lineage is cut every few rounds.
    """
    dims = list(targets)
    now = cells.where("tokens > 0")
    wanted = {d: _wanted(now.select(d, "tokens"), d, targets[d], fraction) for d in dims}
    for d in dims:
        now = now.join(wanted[d], d)
    now = cut(now.withColumn("weight", F.col("tokens").cast("double")))
    n, drawn_tokens = now.agg(F.count("*"), F.sum("tokens").cast("double") * fraction).first()
    few = n <= FEW_CELLS
    most = F.col("tokens") / F.lit(drawn_tokens)
    for _ in range(0, rounds, ROUNDS_PER_CUT):
        now = now.coalesce(1) if few else now
        for _ in range(ROUNDS_PER_CUT):
            for d in dims:
                have = F.sum("weight").over(Window.partitionBy(d))
                now = now.withColumn("weight", F.when(have > 0, F.least(most, F.col("weight") * F.col(f"want_{d}") / have)).otherwise(0.0))
        off = [F.abs(F.sum("weight").over(Window.partitionBy(d)) - F.col(f"want_{d}")) for d in dims]
        now = cut(now.withColumn("_off", F.greatest(*off, F.lit(0.0))))
        gap = now.agg(F.max("_off")).first()[0]
        if gap is None or gap < tolerance:
            break
    return now.select(*cells.columns, "weight", F.lit(gap or 0.0).alias("gap"))


def probabilities(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, fraction: float = FRACTION) -> DataFrame:
    """By cell: tokens, weight, gap and probability p. docs has _source, _lang, _topic and _tokens."""
    counted = docs.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").alias("tokens"))
    cells = cut(counted.select(F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "tokens"))
    raked = rake(cells, targets, fraction)
    every = raked.agg(F.sum("tokens").cast("double")).first()[0] or 0.0
    p = F.least(F.lit(1.0), F.lit(fraction * every) * F.col("weight") / F.col("tokens"))
    return cut(raked.select("source", "lang", "topic", "tokens", "weight", "gap", p.alias("p")))


def drawn(doc_id: Column, text: Column, p: Column, seed: int = SEED) -> Column:
    """Whether a document is drawn: its hash, as a number from 0 to 1, is below p. Documents without an id go by their text."""
    key = F.when(doc_id.isNotNull(), F.xxhash64(F.lit(seed), doc_id)).otherwise(F.xxhash64(F.lit(seed), text))
    return F.shiftrightunsigned(key, 11) * F.lit(2.0**-53) < p


def _joined(docs: DataFrame, p: DataFrame) -> DataFrame:
    cells = p.select(F.col("source").alias("_source"), F.col("lang").alias("_lang"), F.col("topic").alias("_topic"), F.col("p").alias("_p"), F.col("weight").alias("_weight"), F.col("gap").alias("_gap"))
    few = cells.count() <= FEW_CELLS
    return docs.join(F.broadcast(cells) if few else cells, ["_source", "_lang", "_topic"], "left").withColumn("_p", F.coalesce("_p", F.lit(1.0)))


def mix_report(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, fraction: float = FRACTION) -> DataFrame:
    """One row per document: its cell, tokens, weight of the cell, probability, whether it is drawn, and how far the targets are missed."""
    narrow = with_cells(docs).select(F.col("row.doc_id").alias("doc_id"), "_source", "_lang", "_topic", "_tokens", F.xxhash64("row.text").alias("_h"))
    narrow = cut(narrow)
    out = _joined(narrow, probabilities(narrow, targets, fraction))
    return out.select("doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"), F.col("_weight").alias("weight"), F.col("_p").alias("p"), drawn(F.col("doc_id"), F.col("_h"), F.col("_p")).alias("drawn"), F.col("_gap").alias("gap"))


def mix(docs: DataFrame, targets: Mapping[str, float | Mapping[str, float]] = TARGETS, fraction: float = FRACTION) -> DataFrame:
    """The rows of docs that are drawn."""
    celled = with_cells(docs)
    p = probabilities(celled.select("_source", "_lang", "_topic", "_tokens"), targets, fraction)
    return _joined(celled, p).where(drawn(F.col("row.doc_id"), F.xxhash64("row.text"), F.col("_p"))).select("row.*")
