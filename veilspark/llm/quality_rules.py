"""Quality rules (operator 8): base rules and a hashed n-gram likelihood ratio. DataFrame functions only.

Word unigrams and bigrams are hashed into a fixed number of buckets. Bucket counts over the whole
corpus and over trusted documents give two smoothed multinomials; a document's score is the mean,
over its n-grams, of the log ratio of trusted to raw probability. A document is kept if no base
rule fails and its score is at least a fixed threshold: equal texts always get equal verdicts.

The log ratios are one number per bucket, so what goes through the driver has a fixed size. The
trusted documents are a bounded sample of the rows labelled good (``max_trusted``), chosen by
hash; the raw counts cover every document.

Defined results: a null, empty or blank text has no words, zero counts, a score of 0 and fails
the base rules; repeated rows are judged each for itself; without trusted rows every ratio is 0,
and only the base rules decide; no rows give no rows. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

SYMBOLS = "#*$%&|<>"  # fixed value: the characters that count as symbols
BUCKETS = 1 << 14
THRESHOLD = -0.12
MAX_TRUSTED = 20_000
WINDOW = 5


def _paired(a: Column, b: Column, shift: int) -> Column:
    """Hashes of a's items with b's items ``shift`` places on, as many as there are."""
    n = F.greatest(F.size(b) - shift, F.lit(0))
    return F.zip_with(F.slice(a, 1, n), F.slice(b, shift + 1, n), lambda x, y: F.xxhash64(x, y))


def word_hashes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``w`` (words), ``h`` (their hashes) and ``h2`` (hashes of neighbours)."""
    out = docs.withColumn("w", words(F.col(text)))
    out = out.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    return out.withColumn("h2", _paired(F.col("h"), F.col("h"), 1))


def base_rules(hashed: DataFrame, text: str = "text") -> DataFrame:
    """Adds the base counts and ``base_failed`` to rows with word hashes.

    Windows of five words are compared by a hash made up of neighbours' hashes. Only texts that
    repeat a window sort theirs: equal hashes become neighbours, and each repeated start covers
    the words up to the next one.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    out = hashed.withColumn("h4", _paired(F.col("h2"), F.col("h2"), 2))
    out = out.withColumn("windows", _paired(F.col("h4"), F.col("h"), 4)).drop("h4")
    out = out.withColumn("twice", F.size(F.array_distinct("windows")) < F.size("windows"))
    out = out.withColumn("ordered", F.when(F.col("twice"), F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    n = F.size("ordered")
    after = F.concat(F.slice("ordered", 2, n), F.array(F.lit(None)))
    before = F.concat(F.array(F.lit(None)), F.slice("ordered", 1, n - 1))
    same = F.zip_with("ordered", after, lambda x, y: F.struct(x.alias("x"), F.coalesce(x["h"] == y["h"], F.lit(False)).alias("again")))
    same = F.zip_with(same, before, lambda s, y: F.struct(s["x"]["i"].alias("i"), (s["again"] | F.coalesce(s["x"]["h"] == y["h"], F.lit(False))).alias("again")))
    out = out.withColumn("starts", F.when(F.col("twice"), F.sort_array(F.transform(F.filter(same, lambda s: s["again"]), lambda s: s["i"]))))
    nexts = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.lit(2**31 - 1)))
    covered = F.aggregate(F.zip_with("starts", nexts, lambda a, b: F.least(b - a, F.lit(WINDOW))), F.lit(0), lambda acc, x: acc + x)
    out = out.withColumn("lines", F.filter(F.split(t, "\n", -1), lambda x: F.rtrim(x, F.lit(SPACES)) != ""))
    out = out.select(
        "*",
        F.size("h").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("twice"), covered).otherwise(0).cast("long").alias("n_repeat_words"),
    ).drop("windows", "twice", "ordered", "starts", "lines")
    return out.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets).cast("long")).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """At most ``max_trusted`` ids labelled good, by hash."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_trusted)


def fit_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """Log of trusted over raw probability by bucket. ``trusted`` is bounded (see trusted_ids), so it is broadcast."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.select("doc_id", F.lit(1).alias("good"))), "doc_id", "left")
    grams = word_hashes(marked.select(F.coalesce("good", F.lit(0)).alias("good"), "text")).select("good", F.explode(F.concat("h", "h2")).alias("gram"))
    counts = grams.select("good", _bucket(F.col("gram"), buckets).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("good").alias("good")).collect()  # one row per bucket at most
    raw, good = [1.0] * buckets, [1.0] * buckets
    for r in counts:
        raw[r["b"]] += r["raw"]
        good[r["b"]] += r["good"]
    import math

    n_raw, n_good = sum(raw), sum(good)
    if n_good <= buckets:  # nothing trusted
        return [0.0] * buckets
    return [math.log(g / n_good) - math.log(r / n_raw) for g, r in zip(good, raw, strict=True)]


def score(h: Column, h2: Column, ratios: list[float]) -> Column:
    """Mean log ratio of the n-grams; 0 without words."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded to one literal
    total = lambda grams: F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(table, _bucket(g, len(ratios))))
    return F.when(F.size(h) > 0, (total(h) + total(h2)) / (F.size(h) + F.size(h2))).otherwise(0.0)


def apply_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, threshold: float = THRESHOLD, max_trusted: int = MAX_TRUSTED) -> DataFrame:
    """One row per document: counts, ``base_failed``, the likelihood-ratio ``score`` and ``kept``."""
    ratios = fit_ratios(docs, trusted_ids(labels, max_trusted), buckets)
    ruled = base_rules(word_hashes(docs.select("doc_id", "text")))
    out = ruled.withColumn("score", F.round(score(F.col("h"), F.col("h2"), ratios), 6))
    kept = ~F.col("base_failed") & (F.col("score") >= threshold)
    told = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score")
    return out.select("doc_id", F.inline(F.array(told)))  # a later filter on these columns stays above, so nothing is computed twice
