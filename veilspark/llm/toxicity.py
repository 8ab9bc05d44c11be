"""Toxicity by a factorization machine over hashed terms (operator 9).

Terms are the words of a text (lower case, without punctuation at their ends) and their first 4,
5 and 6 letters, hashed into ``2**HASH_BITS`` numbers; a text has each term once or not at all.
A second-order factorization machine over them gives the score: linear weights plus the inner
products of the factors of every pair of terms that occur together.

It is fitted on a bounded sample of labelled rows (``max_toxic`` and ``max_clean``, by hash), with
weights that restore the share of toxic rows. Of the hashed terms the ``max_terms`` that tell the
labels apart most (by likelihood ratio, counted in Spark) get weights; the other weights are zero.
Scoring covers every row and the whole text.

Defined results: a null or empty text has no terms and scores the machine's bias; a text of any
length is read whole; repeated rows score alike; without labelled rows of both kinds every score is 0; a null ``doc_id`` is never held
out; no rows give no rows. Further columns pass through.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

HASH_BITS = 20
EDGE = ".,;:!?\"'()[]{}<>|-#*$%&"
PREFIXES = (4, 5, 6)
MAX_TOXIC, MAX_CLEAN, MAX_TERMS, FACTORS = 4000, 8000, 2048, 4
THRESHOLD = 0.7


def _number(term: str) -> int:
    return zlib.crc32(term.encode()) & ((1 << HASH_BITS) - 1)


def _terms_of(word: str) -> tuple[int, ...]:
    w = word.strip(EDGE)
    return (_number(w), *(_number(f"{w[:n]}*") for n in PREFIXES if len(w) > n)) if w else ()


def _words(text: str | None) -> set[str]:
    return set((text or "").lower().split())


@dataclass
class Machine:
    """bias, and by hashed term a weight and factors."""

    bias: float
    terms: dict[int, int]
    weight: np.ndarray
    factors: np.ndarray

    def score(self, texts: list[str | None], seen: dict[str, tuple[int, ...]]) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts):
            rows: set[int] = set()
            for w in _words(text):
                got = seen.get(w)
                if got is None:
                    got = tuple(self.terms[t] for t in _terms_of(w) if t in self.terms)
                    if len(seen) < 500_000:
                        seen[w] = got
                rows.update(got)
            k = sorted(rows)
            v = self.factors[k]
            out[i] = self.bias + self.weight[k].sum() + 0.5 * (v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def fit_machine(rows: list[list[int]], y: np.ndarray, sample_weight: np.ndarray, n_terms: int, factors: int = FACTORS, rounds: int = 300, rate: float = 0.05, shrink: float = 1e-5) -> tuple[float, np.ndarray, np.ndarray]:
    """bias, weights and factors by full-batch Adam on the weighted logistic loss. rows: the terms of each text, from 0 to n_terms - 1."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    term = np.array([t for r in rows for t in r], dtype=np.int64)
    by_term = np.argsort(term, kind="stable")
    row_at, term_at = np.searchsorted(row, np.arange(len(rows) + 1)), np.searchsorted(term[by_term], np.arange(n_terms + 1))

    def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sums of consecutive stretches, some of them empty."""
        out = np.add.reduceat(np.concatenate([values, np.zeros((1, *values.shape[1:]))]), at[:-1], axis=0)
        out[at[:-1] == at[1:]] = 0
        return out

    rng = np.random.default_rng(7)
    share = float(np.average(y, weights=sample_weight))
    params = [np.array([np.log(share / (1 - share))]), np.zeros(n_terms), rng.normal(0, 0.01, (n_terms, factors))]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = sample_weight / sample_weight.sum()
    for t in range(1, rounds + 1):
        b, w, v = params
        vt = v[term]
        xv = sums(vt, row_at)
        z = b + sums(w[term], row_at) + 0.5 * (xv**2 - sums(vt**2, row_at)).sum(axis=1)
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        per = g[row][by_term]
        xg = sums(per, term_at)
        grads = [np.array([g.sum()]), xg + shrink * w, sums(per[:, None] * xv[row][by_term], term_at) - v * xg[:, None] + shrink * v]
        for p, gr, mm, ss in zip(params, grads, m, s, strict=True):
            mm += 0.1 * (gr - mm)
            ss += 0.001 * (gr**2 - ss)
            p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(ss / (1 - 0.999**t)) + 1e-8)
    return float(params[0][0]), params[1], params[2]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        terms = [sorted({t for w in _words(x) for t in _terms_of(w)}) for x in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("key"), b.column("toxic"), pa.array(terms, pa.list_(pa.int32()))], names=["key", "toxic", "terms"])


def held_out(doc_id: Column) -> Column:
    """Rows that never serve to learn: crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN, max_terms: int = MAX_TERMS) -> Machine:
    """The machine, from a bounded sample of the labelled rows that are not held out."""
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")  # labels without a document take no place
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = known.where("toxic = 1").orderBy(*order).limit(max_toxic).union(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select(F.col("doc_id").cast("long").alias("key"), "text", F.col("toxic").cast("int")))
    terms = sample.mapInArrow(_hashed, "key long, toxic int, terms array<int>")
    there = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nothing = Machine(-30.0, {}, np.zeros(0), np.zeros((0, FACTORS)))
    if len(there) < 2:
        return nothing
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    counts = terms.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("toxic").cast("double").alias("a"), F.sum(1 - F.col("toxic")).cast("double").alias("b")).where("a + b >= 3")
    n1, n0 = float(there[1]), float(there[0])
    part = lambda k, n, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    p = (F.col("a") + F.col("b")) / (n1 + n0)
    g2 = part(F.col("a"), n1, p) + part(F.col("b"), n0, p) + part(n1 - F.col("a"), n1, 1 - p) + part(n0 - F.col("b"), n0, 1 - p)
    best = [r["t"] for r in counts.where(f"a + b < {n1 + n0}").select("t", F.round(g2, 6).alias("g")).orderBy(F.desc("g"), "t").limit(max_terms).collect()]
    if not best:
        return nothing
    rows = terms.select("key", "toxic", F.array_intersect("terms", F.split(F.lit(",".join(map(str, best))), ",").cast("array<int>")).alias("terms")).orderBy("key").collect()
    at = {t: i for i, t in enumerate(best)}
    y = np.array([r["toxic"] for r in rows], dtype=np.float32)
    weight = np.where(y == 1, total[1] / n1, total[0] / n0)
    bias, w, v = fit_machine([[at[t] for t in r["terms"]] for r in rows], y, weight, len(best))
    return Machine(bias, at, w, v)


def with_score(docs: DataFrame, machine: Machine, name: str = "score") -> DataFrame:
    """The rows of docs with the machine's score (0 to 1) of their whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # column names of any kind pass through inside

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[int, ...]] = {}
        for b in batches:
            scores = shared.value.score(b.column("text").to_pylist(), seen)
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(scores)], names=["row", name])

    scored = docs.select(row, "text").mapInArrow(run, T.StructType([T.StructField("row", docs.schema), T.StructField(name, T.DoubleType())]))
    return scored.select("row.*", name)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic."""
    name = "toxicity"
    while name in docs.columns:
        name += "_"
    return with_score(docs, fit(docs, labels), name).where(F.col(name) < THRESHOLD).drop(name)
