"""Secret scan with corpus-wide ownership frequency (operator 2). DataFrame functions only.

Candidates are spans found by pattern. Every candidate value is hashed, and the hashes are
counted over the whole corpus by distinct repositories and distinct owners: a value that many
owners carry is a copied example, a value that one owner carries looks live. The three base
kinds are always reported; a fourth, looser kind (``token``: long strings that mix letters and
digits) is reported only where the frequency says that the value belongs to few owners.

Defined results: a null text counts as empty; a text without spans gets an empty list, zero
counts and the digest of the empty string; repeated rows are scanned each for itself and get
the same result; a null ``doc_id``, owner or repository is a value like any other; no table
rows give no rows; a text of any length is scanned whole, and its matches are rows, so their number
is not bound by a task's arrays but where a row's list is written out. Further columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join

# The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run of [A-Z0-9] after AKIA that is too short holds no longer one
HEX = r"[0-9a-f]{32,}"
# The kind that the ownership frequency adds.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"

KINDS = ("assign", "access", "hex", "token")
LOOSE = 3  # the first kind that is not a base one
ROW = ("key", "text_key")


def _matches(text: Column, pattern: str, kind: int, value=None) -> Column:
    """Leftmost non-overlapping matches in their order: kind, what stands before (gap), length and value.

    ``split`` gives what stands between the matches and ``regexp_extract_all`` the matches. Texts
    without a match skip both.
    """
    value = value or (lambda m: m)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    one = lambda gap, m: F.struct(F.lit(kind).alias("kind"), gap.alias("gap"), F.length(m).alias("length"), value(m).alias("value"))
    got = F.zip_with(F.slice(gaps, 1, F.size(found)), found, one)
    return F.when(text.rlike(pattern), got).otherwise(F.array().cast("array<struct<kind:int,gap:int,length:int,value:string>>"))


def candidates(rows: DataFrame) -> DataFrame:
    """key, text_key, kind, start, stop, value of every span of rows (key, text_key, text): the base kinds, and further candidates outside them.

    A match is a row. Where it starts is a running sum over the matches of its text and kind, and
    whether a loose one touches a base one is told by the farthest end before and the nearest
    start behind: so the work grows with the matches, however many a text holds.
    """
    t = F.col("text")
    kinds = (_matches(t, ASSIGN, 0, lambda m: F.regexp_extract(m, ASSIGN, 1)), _matches(t, ACCESS, 1), _matches(t, HEX, 2), _matches(t, TOKEN, LOOSE))
    found = rows.select(*ROW, F.array(*kinds).alias("kinds")).select(*ROW, F.explode("kinds").alias("of")).select(*ROW, F.posexplode("of").alias("i", "m"))
    # dealt out by text once, which all that follows can use; repeated rows of one text are one from here on
    found = found.select(*ROW, "i", "m.*").repartition(*ROW).dropDuplicates([*ROW, "kind", "i"])
    so_far = Window.partitionBy(*ROW, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("length")).over(so_far)
    placed = found.select(*ROW, "kind", (stop - F.col("length")).cast("int").alias("start"), stop.cast("int").alias("stop"), "value")
    long_enough = F.when(F.col("kind") == 0, F.length("value") >= 8).when(F.col("kind") == LOOSE, F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]")).otherwise(True)
    kept = placed.where(long_enough)
    base, before = F.col("kind") < LOOSE, (Window.unboundedPreceding, -1)
    one = Window.partitionBy(*ROW)
    order = ("start", "kind")
    reach = F.max(F.when(base, F.col("stop"))).over(one.orderBy(*order).rowsBetween(*before))
    ahead = F.min(F.when(base, F.col("start"))).over(one.orderBy(*(F.desc(c) for c in order)).rowsBetween(*before))
    told = kept.withColumn("reach", reach).withColumn("ahead", ahead)
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("ahead", F.col("stop")) >= F.col("stop"))
    return told.where(base | free).drop("reach", "ahead")


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None, max_owners: int = 1, example_owners: int = 3) -> DataFrame:
    """One row per document: base counts and digest, all spans, and how many candidates look live or copied.

    max_owners: a loose candidate is a finding if at most so many owners carry its value.
    example_owners: a value that so many owners carry counts as a copied example.
    """
    owner = F.col("source") if owner is None else owner
    repository = F.concat_ws("/", F.col("source"), F.col("lang")) if repository is None else repository
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(-(2**63))).alias("key"), F.xxhash64(text).alias("text_key"), F.coalesce(owner, F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repo"), text.alias("text"))
    suspect = F.col("text").rlike("|".join((ASSIGN, ACCESS, HEX, TOKEN)))
    spans = cut(candidates(rows.where(suspect)).withColumn("hash", F.sha2("value", 256)).drop("value"))

    owners = rows.where(suspect).select(*ROW, "owner", "repo").distinct()
    carried = spans.select(*ROW, "hash").distinct().join(owners, list(ROW)).select("hash", "owner", "repo").distinct()
    carried = carried.groupBy("hash", "owner").agg(F.count("*").alias("repos")).groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"))
    known = spread_join(spans, carried, ["hash"])  # a value that many documents carry is dealt out
    span, base = F.struct("start", "kind", "stop"), F.col("kind") < LOOSE
    count = lambda k: F.count_if(F.col("kind") == k)
    per_doc = known.groupBy(*ROW).agg(
        count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_listed(F.collect_list(F.when(base, span))), 256).alias("base_sha256"),
        _listed(F.collect_list(F.when(base | (F.col("n_owners") <= max_owners), span))).alias("spans"),
        F.count_if(F.col("n_owners") < example_owners).alias("n_live"),
        F.count_if(F.col("n_owners") >= example_owners).alias("n_example"),
        F.max("n_repos").alias("most_repos"),
    )
    numbers = ("n_assign", "n_access", "n_hex", "n_live", "n_example", "most_repos")
    out = rows.select("doc_id", *ROW).join(per_doc, list(ROW), "left").na.fill(0, list(numbers)).na.fill({"spans": ""})
    return out.select("doc_id", *numbers[:3], F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"), "spans", *numbers[3:])
