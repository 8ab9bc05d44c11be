"""Quality classifier by co-training (operator 1).

Two logistic classifiers see a document from different sides: one its text content (hashed words
and character classes), the other its page metadata (source, language, length). Both start from
the labelled rows. In each round each classifier labels the unlabelled pool, and the rows that it
is most sure of, in the labelled rows' proportion of good and bad, join what the *other* one
learns from: a round's quota is a share of the whole pool, its cut comes from a histogram of all
scores. Every fifth labelled row is set aside. A view labels only where its labels have at least
``PRECISION`` on these rows and a quarter of the errors that one label for all rows would have, so one without skill for a class gives no label of it; and the rounds
end when the joint loss on them no longer falls, with the classifiers from before. Both are
calibrated on these rows, and all documents are scored with the sum of the two calibrated log odds,
less the prior that both hold.

Labelled rows are a bounded sample by hash (``max_labelled``). The pool is every row without a
label. Every document's features are written once, those that scores come from, too; each round reads all of the pool's for the histogram, writes out
the rows that have got a label so far, and moves both classifiers by gradients summed over all of
those. Together these weigh at most as much as the labelled rows, so that sizes do not tell.

Defined results: a null or empty text has no words, only the metadata speak besides the text's
bias; null source or language is a value of its own; a missing length is taken from the text;
a text of any length is read whole; repeated rows score alike; without labels of both kinds every score is the prior (0.5 without any
label); no rows give no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import string
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shared_dir

TEXT_BUCKETS, META_BUCKETS = 1 << 12, 1 << 9
MAX_LABELLED, ROUNDS, GROW = 4000, 4, 0.1
STEPS, SHRINK = 4, 1e-5  # of the summed gradients, in a round
BINS, REACH = 8192, 32  # of the histogram
PRECISION = 0.95  # at least, on rows set aside, of the labels that a view gives
THRESHOLD = 0.5
DENSE = 6  # numbers by character class that stand before the hashed words
UPPER, DIGITS, NOT_ASCII = string.ascii_uppercase.encode(), string.digits.encode(), re.compile("[^\x00-\x7f]+")


def text_features(text: str | None, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column numbers, values: shares of character classes and repetition, then hashed words by their root share."""
    t = text or ""
    words = t.split()
    n, chars = len(words), max(1, len(t))
    said = Counter(words)
    counts: dict[int, int] = {}
    for w, k in said.items():
        b = seen.get(w)
        if b is None:
            b = DENSE + zlib.crc32(w.lower().strip(".,;:!?").encode()) % TEXT_BUCKETS
            if len(seen) < 500_000:
                seen[w] = b
        counts[b] = counts.get(b, 0) + k
    symbols = sum(t.count(c) for c in "#*$%&|<>")
    lines = [x for x in t.split("\n") if x.strip()]
    flat = t.encode()
    rest = "" if t.isascii() else "".join(NOT_ASCII.findall(t))
    upper, digits = (len(flat) - len(flat.translate(None, of)) + sum(map(also, rest)) for of, also in ((UPPER, str.isupper), (DIGITS, str.isdigit)))
    dense = [
        symbols / chars, upper / chars, digits / chars, t.count("!") / chars,
        1 - len(set(lines)) / len(lines) if lines else 0.0, 1 - len(said) / n if n else 0.0,
    ]
    cols = np.array([*range(DENSE), *counts], dtype=np.int32)
    vals = np.array([*(4 * x for x in dense), *(np.sqrt(c / n) for c in counts.values())], dtype=np.float32)
    return cols, vals


def meta_features(source: str | None, lang: str | None, n_chars: int | None, text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Column numbers of source, language, their pair and length class; each counts 1."""
    size = int(np.log2(1 + (len(text or "") if n_chars is None else max(0, n_chars))) * 2)
    terms = (f"s={source}", f"l={lang}", f"n={size}", f"l={lang},n={size}")
    cols = sorted({zlib.crc32(x.encode()) % META_BUCKETS for x in terms})
    return np.array(cols, dtype=np.int32), np.ones(len(cols), dtype=np.float32)


Side = tuple[np.ndarray, np.ndarray, np.ndarray, int]  # row, column, value of each entry; rows


@dataclass
class Logistic:
    """bias and weights of one view; slope and shift of its calibration."""

    bias: float
    weight: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.array([self.bias + float(self.weight[c] @ v) for c, v in rows])

    def log_odds(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.clip(self.slope * self.raw(rows) + self.shift, -12, 12)


def fit_logistic(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_cols: int, rounds: int = 120, rate: float = 0.1, shrink: float = 1e-5) -> Logistic:
    """Full-batch Adam on the logistic loss."""
    row = np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows])
    col, val = np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows])
    share = min(max(float(y.mean()), 0.01), 0.99)
    b, w = np.array([np.log(share / (1 - share))]), np.zeros(n_cols)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (b, w)]
    for t in range(1, rounds + 1):
        z = b[0] + np.bincount(row, weights=w[col] * val, minlength=len(rows))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(rows)
        grads = (np.array([g.sum()]), np.bincount(col, weights=g[row] * val, minlength=n_cols) + shrink * w)
        for p, gr, (m, s) in zip((b, w), grads, state, strict=True):
            m += 0.1 * (gr - m)
            s += 0.001 * (gr**2 - s)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Logistic(float(b[0]), w)


def _calibrate(model: Logistic, rows: list, y: np.ndarray) -> None:
    """Slope and shift by Newton steps on rows that the model has not learnt from, with targets drawn in from 0 and 1."""
    x = model.raw(rows)
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, c = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -30, 30)))
        r, w = p - target, p * (1 - p) + 1e-9
        h = np.array([[w @ x**2 + 1e-3, w @ x], [w @ x, w.sum() + 1e-3]])
        d = np.linalg.solve(h, np.array([r @ x + 1e-3 * (a - 1), r.sum()]))
        a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -2, 2)
    model.slope, model.shift = max(a, 0.0), c


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    prior: float

    def score(self, texts: list, metas: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = self.text.log_odds(texts), self.meta.log_odds(metas)
        odds = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return odds(a), odds(b), odds(a + b - self.prior)

    def loss(self, texts: list, metas: list, y: np.ndarray, at: np.ndarray) -> float:
        """Mean logistic loss of the joint score on these rows."""
        z = self.text.log_odds([texts[i] for i in at]) + self.meta.log_odds([metas[i] for i in at]) - self.prior
        return float(np.mean(np.logaddexp(0, z) - y[at] * z))


def _side(rows: list[tuple[np.ndarray, np.ndarray]]) -> Side:
    return np.repeat(np.arange(len(rows)), [len(c) for c, _ in rows]), np.concatenate([c for c, _ in rows]), np.concatenate([v for _, v in rows]), len(rows)


def _flat(arr: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a binary column of packed numbers: all of them, and how many each row has."""
    parts = [x or b"" for x in arr.to_pylist()]
    width = np.dtype(kind).itemsize
    return np.frombuffer(b"".join(parts), dtype=kind), np.fromiter((len(x) // width for x in parts), dtype=np.int64, count=len(parts))


def _sides(b: pa.RecordBatch) -> tuple[Side, Side]:
    tc, n = _flat(b.column("tc"), "<i2")
    tv, _ = _flat(b.column("tv"), "<f4")
    mc, m = _flat(b.column("mc"), "<i2")
    at = np.arange(b.num_rows)
    return (np.repeat(at, n), tc, tv, b.num_rows), (np.repeat(at, m), mc, np.ones(len(mc), dtype=np.float32), b.num_rows)


def _raw(side: Side, bias: float, weight: np.ndarray) -> np.ndarray:
    row, col, val, n = side
    return bias + np.bincount(row, weights=weight[col] * val, minlength=n)


def _loss(side: Side, y: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Summed logistic loss, then its gradient by bias and weights; rows with y < 0 do not count."""
    row, col, val, _ = side
    z = _raw(side, theta[0], theta[1:])
    used = y >= 0
    g = np.where(used, 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y, 0.0)
    return np.r_[np.where(used, np.logaddexp(0, z) - y * z, 0.0).sum(), g.sum(), np.bincount(col, weights=g[row] * val, minlength=len(theta) - 1)]


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((z + REACH) * (BINS / (2 * REACH))), 0, BINS - 1).astype(np.int64)


def _quota(counts: np.ndarray, want: int) -> tuple[int, float]:
    """The bin at which so many rows, counted from the first bin, are reached, and the share of it that still belongs to them."""
    sums = np.cumsum(counts)
    k = int(np.searchsorted(sums, want))
    return (len(counts), 0.0) if k == len(counts) else (k, float((want - (sums[k] - counts[k])) / max(counts[k], 1)))


Cut = tuple[int, float, int, float]


def trusted_edges(z: np.ndarray, y: np.ndarray, precision: float = PRECISION) -> tuple[int, int]:
    """Bins up to which a view's labels bad, and from which its labels good, are right often enough on rows set aside (by the rule of succession); 0 and BINS where they are nowhere."""

    def reach(order: np.ndarray, label: int) -> int:
        # to say the commoner label of every row is no skill: a quarter of the errors of that is asked for
        precision_of = max(precision, 1 - (1 - float(np.mean(y == label))) / 4)
        right = np.cumsum(y[order] == label)
        good = np.flatnonzero((right + 1) / (np.arange(1, len(order) + 1) + 2) >= precision_of)
        return int(good[-1]) if len(good) else -1

    up, down = np.argsort(z, kind="stable"), np.argsort(-z, kind="stable")
    lo, hi = reach(up, 0), reach(down, 1)
    low, high = (int(_bin(z[up[lo : lo + 1]])[0]) if lo >= 0 else 0), (int(_bin(z[down[hi : hi + 1]])[0]) + 1 if hi >= 0 else BINS)
    return min(low, BINS // 2), max(high, BINS // 2)  # and each on its own side of the boundary


def confident_cut(counts: np.ndarray, bad: int, good: int, edges: tuple[int, int] = (BINS // 2, BINS // 2)) -> Cut:
    """Last bin of the bad rows and its share, first bin of the good ones and its share; rows between the edges stay out."""
    lo, lo_share = _quota(counts[: edges[0]], bad)
    hi, hi_share = _quota(counts[: edges[1] - 1 if edges[1] else None : -1], good)
    return lo, lo_share, BINS - 1 - hi, hi_share


def _share_of(ids: np.ndarray, turn: int) -> np.ndarray:
    """A number from 0 to 1 by a row's id, another one each turn: which rows of a cut bin are taken."""
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(32))).astype(np.float64) / 2.0**64


def _given(sides: tuple[Side, Side], ids: np.ndarray, past: list[tuple[list[np.ndarray], list[Cut]]]) -> list[np.ndarray]:
    """By side, the labels that the other side has given the rows in past rounds; -1 without."""
    out = [np.full(len(ids), -1, dtype=np.int8) for _ in sides]
    for turn, (thetas, cuts) in enumerate(past):
        u = _share_of(ids, turn << 48)
        for k, (lo, lo_share, hi, hi_share) in enumerate(cuts):
            at, free = _bin(_raw(sides[k], thetas[k][0], thetas[k][1:])), out[1 - k] < 0
            out[1 - k][free & ((at < lo) | ((at == lo) & (u < lo_share)))] = 0
            out[1 - k][free & ((at > hi) | ((at == hi) & (u < hi_share)))] = 1
    return out


def _summed(df: DataFrame, of, size: int) -> np.ndarray:
    """The sum of of(batch) over all rows of df; each partition sends one vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(b)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["v"])

    return np.sum([np.zeros(size), *(np.frombuffer(bytes(r.v)) for r in df.mapInArrow(run, "v binary").collect())], axis=0)


def _descend(at: np.ndarray, objective, scale: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS in scaled coordinates; a step that does not lower the objective is shortened."""
    x, pairs = at / scale, []
    f, g = objective(x * scale)
    g = g * scale
    for _ in range(steps):
        d, alphas = -g, []
        for s, y in reversed(pairs):
            alphas.append(s @ d / (s @ y))
            d = d - alphas[-1] * y
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1] / (pairs[-1][1] @ pairs[-1][1]))
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        for size in (1.0, 0.25, 0.0625):
            fn, gn = objective((x + size * d) * scale)
            if fn <= f + 1e-4 * size * (g @ d):
                break
        else:
            break
        gn = gn * scale
        if size * d @ (gn - g) > 1e-12:
            pairs.append((size * d, gn - g))
        x, f, g = x + size * d, fn, gn
    return x * scale


def co_train(texts: list, metas: list, y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS, grow: float = GROW) -> CoTrained:
    """Rounds of exchange between the views. y: 1 good, 0 bad; every fifth labelled row is kept for calibration. pool: rows of FEATURES."""
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(y), dtype=bool)
    base = np.flatnonzero(~held)
    share, n_pool = float(y.mean()), pool.count()
    known, thetas, scale, widths = [], [], [], (1 + DENSE + TEXT_BUCKETS, 1 + META_BUCKETS)
    for x, n in ((texts, widths[0]), (metas, widths[1])):
        rows = [x[i] for i in base]
        m = fit_logistic(rows, y[base].astype(np.float64), n - 1)
        thetas.append(np.r_[m.bias, m.weight])
        known.append(_side(rows))
        scale.append(1 / np.sqrt(0.25 * np.r_[1.0, np.bincount(known[-1][1], weights=known[-1][2].astype(np.float64) ** 2, minlength=n - 1) / len(rows)] + 1e-3))
    split, past = widths[0], []
    aside = np.flatnonzero(held) if held.any() else base
    checked = [_side([x[i] for i in aside]) for x in (texts, metas)]
    best = _calibrated(thetas, texts, metas, y, aside, share)
    least = best.loss(texts, metas, y, aside)
    quota = int(grow * n_pool / 2)
    bad, good = round(quota * (1 - share)), round(quota * share)
    for _ in range(rounds if n_pool else 0):

        def spread(b: pa.RecordBatch, past=past, now=thetas) -> np.ndarray:
            sides = _sides(b)
            got = _given(sides, b.column("doc_id").to_numpy(), past)
            return np.concatenate([np.bincount(_bin(_raw(sides[k], now[k][0], now[k][1:]))[got[1 - k] < 0], minlength=BINS) for k in (0, 1)]).astype(np.float64)

        counts = _summed(pool, spread, 2 * BINS)
        edges = [trusted_edges(_raw(side, theta[0], theta[1:]), y[aside]) for side, theta in zip(checked, thetas, strict=True)]
        past = [*past, (thetas, [confident_cut(c, bad, good, e) for c, e in zip((counts[:BINS], counts[BINS:]), edges, strict=True)])]

        def labelled(batches: Iterator[pa.RecordBatch], past=past) -> Iterator[pa.RecordBatch]:
            for b in batches:
                got = _given(_sides(b), b.column("doc_id").to_numpy(), past)
                names = ["tc", "tv", "mc"]
                out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(got[0].astype(np.int32)), pa.array(got[1].astype(np.int32))], names=[*names, "y0", "y1"])
                yield out.filter(pa.array((got[0] >= 0) | (got[1] >= 0)))

        chosen = _stored(pool.mapInArrow(labelled, "tc binary, tv binary, mc binary, y0 int, y1 int"))
        n_extra = chosen.selectExpr("count_if(y0 >= 0)", "count_if(y1 >= 0)").first()
        weigh = [min(1.0, len(base) / n) if n else 0.0 for n in n_extra]

        def objective(theta: np.ndarray, chosen=chosen, n_extra=n_extra, weigh=weigh) -> tuple[float, np.ndarray]:
            both = (theta[:split], theta[split:])
            of = lambda b: np.concatenate([_loss(s, b.column(f"y{k}").to_numpy(), both[k]) for k, s in enumerate(_sides(b))])
            far = _summed(chosen, of, len(theta) + 2)
            total, grads = 0.0, []
            for k, part in enumerate((far[: split + 1], far[split + 1 :])):
                got = (_loss(known[k], y[base], both[k]) + weigh[k] * part) / (len(base) + weigh[k] * n_extra[k])
                w = np.r_[0.0, both[k][1:]]
                total += got[0] + SHRINK / 2 * (w @ w)
                grads.append(got[1:] + SHRINK * w)
            return total, np.concatenate(grads)

        moved = _descend(np.concatenate(thetas), objective, np.concatenate(scale), STEPS)
        thetas = [moved[:split], moved[split:]]
        after = _calibrated(thetas, texts, metas, y, aside, share)
        if (told := after.loss(texts, metas, y, aside)) > least:
            break  # on rows set aside, what the views have learnt from each other does not help any more
        best, least = after, told
    return best


def _calibrated(thetas: list[np.ndarray], texts: list, metas: list, y: np.ndarray, aside: np.ndarray, share: float) -> CoTrained:
    models = [Logistic(float(t[0]), t[1:]) for t in thetas]
    for m, x in zip(models, (texts, metas), strict=True):
        _calibrate(m, [x[i] for i in aside], y[aside])
    return CoTrained(models[0], models[1], float(np.log(share / (1 - share))))


def _views(batch: pa.RecordBatch, seen: dict[str, int]) -> tuple[list, list]:
    t, s, g, n = (batch.column(c).to_pylist() for c in ("text", "source", "lang", "n_chars"))
    return [text_features(x, seen) for x in t], [meta_features(a, b, c, x) for a, b, c, x in zip(s, g, n, t, strict=True)]


FEATURES = "doc_id long, tc binary, tv binary, mc binary"


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, int] = {}
    for b in batches:
        texts, metas = _views(b, seen)
        packed = [pa.array([x.astype(kind).tobytes() for x in col], pa.binary()) for col, kind in (([c for c, _ in texts], "<i2"), ([v for _, v in texts], "<f4"), ([c for c, _ in metas], "<i2"))]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *packed], names=["doc_id", "tc", "tv", "mc"])


def _stored(df: DataFrame) -> DataFrame:
    """The same rows, written tightly in the shared folder and read again."""
    path = f"{shared_dir(df.sparkSession)}/cotraining-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FEATURES of every document, and its label's quality or null: made once and written.

    Labels meet the features by a shuffle at every size, so that disk grows with the input; rows without an id have no label and stay where they are.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    asked = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("long"))
    named, other = (asked.where(c).mapInArrow(_featured, FEATURES) for c in ("doc_id is not null", "doc_id is null"))
    return _stored(named.join(known.hint("shuffle_hash"), "doc_id", "left").unionByName(other.withColumn("quality", F.lit(None).cast("int"))))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """The co-trained pair of classifiers, from a sample of labelled rows and all others; None without labels of both kinds."""
    return fit_features(features(docs, labels), max_labelled, rounds)


def fit_features(made: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """The same from the rows of ``features``."""
    there = made.where("quality is not null").select("doc_id", "quality").distinct()
    picked = cut(there.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id"))  # max_labelled rows at most
    rows = made.join(F.broadcast(picked), "doc_id", "left_semi").toArrow().sort_by("doc_id").to_pylist()
    y = np.array([r["quality"] for r in rows])
    if len(set(y)) < 2:
        return None
    texts, metas = _unpacked(rows)
    return co_train(texts, metas, y, made.where("doc_id is not null and quality is null").drop("quality"), rounds)


def _unpacked(rows: list[dict]) -> tuple[list, list]:
    texts = [(np.frombuffer(r["tc"], dtype="<i2").astype(np.int32), np.frombuffer(r["tv"], dtype="<f4")) for r in rows]
    return texts, [(m := np.frombuffer(r["mc"], dtype="<i2").astype(np.int32), np.ones(len(m), dtype=np.float32)) for r in rows]


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, text_score, meta_score, score (0 to 1, higher: better) and kept for every row."""
    made = features(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(fit_features(made))
    names = ["doc_id", "text_score", "meta_score", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if shared.value is None:
                got = [np.full(b.num_rows, 0.5)] * 3
            else:
                got = shared.value.score(*_unpacked(b.select(["tc", "tv", "mc"]).to_pylist()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *map(pa.array, got)], names=names)

    return made.mapInArrow(run, "doc_id long, text_score double, meta_score double, score double").withColumn("kept", F.col("score") >= threshold)
