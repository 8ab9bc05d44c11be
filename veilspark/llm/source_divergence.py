"""Source divergence audit: which sources of a language differ, and by which terms (operator 11).

Sort-based streaming in two scans. Terms are runs of ASCII letters and other characters beyond
ASCII, A-Z lower-cased. A task sorts the words of some documents at a time by (group of lang and
source, term, document) and tells run lengths: how many documents and occurrences a term has there.
These partial runs, not words, are dealt out by (lang, term) and sorted by (lang, term, source)
within their partitions, where the first scan adds them up in one pass, with one term's counts in
memory: a term of at least ``least_docs`` documents of its language is kept, with its counts by source.
The second scan meets the kept terms with the totals of all groups of their language, in buckets
of a bounded number of cells, and emits for each bucket its part of each pair's sum and its highest
terms of each group; the parts are added and the highest of the highest are ranked.

Shares are 1 + floor(10^9 (count + 1) / (all + kept terms)), and a difference of share p from q is
floor((p - q)^2 / q); both are exact in 64 bits, as the shares of a group add up to about 10^9.

Defined results: null text, lang and source are ''; an empty text has no terms but its group is
there; each row is a document, so repeated rows count each; a text of any length is read in
stretches; ties go by item, bytes ascending; a language of one source has no pairs; a row without
``doc_id`` counts like others; no rows give no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import write_table

LEAST_DOCS, TOP_TERMS = 3, 200
SCALE_STEPS = (1000, 1000, 1000)  # their product is the scale of shares
TERM = re.compile(rb"[a-z\x80-\xff]+")
AFTER_TERM = re.compile(rb"[^a-z\x80-\xff]")
STRETCH, ENCODED, WORDS, CELLS = 1 << 20, 500_000, 4_000_000, 1_000_000
PARTIAL = "lang string, source string, term string, docs long, n long"
KEPT = "lang string, term string, sources array<string>, counts array<long>"
FOUND = "lang string, source string, part string, item string, value long"


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, stretch by stretch."""
    raw, at = text.encode().lower(), 0  # of bytes, only A-Z have a lower case
    while at < len(raw):
        end = AFTER_TERM.search(raw, at + STRETCH) if len(raw) - at > STRETCH else None
        to = end.start() if end else len(raw)
        yield TERM.findall(raw, at, to)
        at = to


def _runs(codes: np.ndarray, n_terms: int, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, ...]:
    """group, term, documents and occurrences of each run of (group, term); group: of each document."""
    key = (group[doc].astype(np.int64) * n_terms + codes) * len(group) + doc
    key.sort()
    by_doc = np.flatnonzero(np.diff(key, prepend=-1))
    run = key[by_doc] // len(group)
    by_term = np.flatnonzero(np.diff(run, prepend=-1))
    n = np.diff(np.append(by_doc[by_term], len(key)))
    return run[by_term] // n_terms, run[by_term] % n_terms, np.diff(np.append(by_term, len(by_doc))), n


def _partial_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "source", "term", "docs", "n"]

    def told() -> Iterator[pa.RecordBatch]:
        encode()
        if not held:
            return
        words = pa.chunked_array([w for w, _ in held]).unify_dictionaries().combine_chunks()
        words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
        g, t, docs, n = _runs(words.indices.to_numpy(zero_copy_only=False), len(words.dictionary), np.concatenate([d for _, d in held]), np.array(of))
        lang, source = (pa.array([k[i] for k in groups], pa.string()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([lang.take(pa.array(g)), source.take(pa.array(g)), words.dictionary.take(pa.array(t)).cast(pa.string()), pa.array(docs, pa.int64()), pa.array(n, pa.int64())], names=names)

    def encode() -> None:
        if fresh:
            held.append((pa.array(fresh, pa.binary()).dictionary_encode(), np.repeat(np.array(whose, np.int64), many)))
            fresh.clear(), whose.clear(), many.clear()

    for b in batches:
        groups: dict[tuple[str, str], int] = {}
        of, held, fresh, whose, many, n_words = [], [], [], [], [], 0
        for text, lang, source in zip(b.column("text"), b.column("lang").to_pylist(), b.column("source").to_pylist(), strict=True):
            of.append(groups.setdefault((lang, source), len(groups)))
            for found in terms(text.as_py()):
                fresh += found
                whose.append(len(of) - 1)
                many.append(len(found))
                n_words += len(found)
                if len(fresh) > ENCODED:
                    encode()
            if n_words > WORDS:
                yield from told()
                groups, of, held, n_words = {}, [], [], 0
        yield from told()


def _kept_terms(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """One pass over sorted partial runs."""
    key, docs, counts = None, 0, {}
    names = ["lang", "term", "sources", "counts"]
    for b in batches:
        out: list[tuple] = []
        for lang, term, source, d, n in zip(*(b.column(c).to_pylist() for c in ("lang", "term", "source", "docs", "n")), strict=True):
            if (lang, term) != key:
                if docs >= least:
                    out.append((*key, list(counts), list(counts.values())))
                key, docs, counts = (lang, term), 0, {}
            docs += d
            counts[source] = counts.get(source, 0) + n
        if out:
            yield _rows(out, names)
    if docs >= least:
        yield _rows([(*key, list(counts), list(counts.values()))], names)


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def shares(counts: np.ndarray, total: np.ndarray | int, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 1) / (total + kept)), digit group by digit group, so that no product leaves 64 bits."""
    whole, rest = np.divmod(counts + 1, total + kept)
    for step in SCALE_STEPS:
        more, rest = np.divmod(rest * step, total + kept)
        whole = whole * step + more
    return 1 + whole


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _compared(kept: pa.Table, profile: pa.Table, top: int) -> pa.Table:
    """A bucket's part of each pair's sum, and its highest terms of each group."""
    profile = profile.sort_by("source")
    names = profile["source"].combine_chunks()
    sources, lang = names.to_pylist(), profile["lang"][0].as_py()
    total = profile["total"].to_numpy()
    n_kept, in_lang = profile["kept"][0].as_py(), profile["in_lang"][0].as_py()
    kept = kept.sort_by("term")
    n, k = kept.num_rows, len(sources)
    counts = np.zeros((n, k), np.int64)
    pairs = np.zeros((k, k), np.int64)
    found: list[tuple[str, str, str, int]] = []
    if n:
        lists = kept["sources"].combine_chunks()
        at = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        counts[at, pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False)] = kept["counts"].combine_chunks().flatten().to_numpy()
        p, q = shares(counts, total, n_kept), shares(counts.sum(axis=1), in_lang, n_kept)
        for i in range(k):
            pairs[i] = difference(p[:, i : i + 1], p).sum(axis=0)
            up = np.flatnonzero((counts[:, i] > 0) & (p[:, i] > q))
            value = difference(p[up, i], q[up])
            best = np.argsort(-value, kind="stable")[:top]  # terms are in order
            found += [(sources[i], "term", x, v) for x, v in zip(kept["term"].take(pa.array(up[best])).to_pylist(), value[best].tolist(), strict=True)]
    found += [(sources[i], "pair", sources[j], int(pairs[i, j])) for i in range(k) for j in range(k) if i != j]
    cols = list(zip(*found, strict=True)) or [[], [], [], []]
    return pa.table([pa.array([lang] * len(found), pa.string()), *(pa.array(x, kind) for x, kind in zip(cols, (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True))], names=["lang", "source", "part", "item", "value"])


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (pair or term), item, value, rank: by how much each source differs from the others of its language, and its most typical terms."""
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    runs = rows.mapInArrow(_partial_runs, PARTIAL).repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    kept = write_table(runs.mapInArrow(partial(_kept_terms, least=least_docs), KEPT), "kept-terms")

    spread = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    totals = spread.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("in_lang"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "in_lang"])
    profile = write_table(groups, "profile")

    widest = profile.groupBy("lang").agg((F.count("*") * F.max("kept")).alias("cells")).agg(F.max("cells")).first()[0] or 0
    buckets = 1 + widest // CELLS
    dealt = kept.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)))
    asked = profile.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(buckets - 1).cast("long"))))
    parts = dealt.groupBy("lang", "bucket").cogroup(asked.groupBy("lang", "bucket")).applyInArrow(lambda a, b: _compared(a, b, top_terms), FOUND)
    parts = write_table(parts, "divergence")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", rank)
    highest = parts.where("part = 'term'").select("*", rank).where(F.col("rank") <= top_terms)
    return pairs.unionByName(highest)
