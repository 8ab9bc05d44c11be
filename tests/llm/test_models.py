"""Classifiers by held-out accuracy, packing by round trip, mixing by its marginals, the pipeline end to end."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspark.llm import cotraining, packing, queries, source_mix, toxicity

BIG = "/root/testdata/sf0.1"


def test_toxicity_on_held_out_rows(spark):
    got = queries.op9_toxicity_fm(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").toPandas()
    assert [(zlib.crc32(str(d).encode()) % 3 == 1) for d in got.doc_id] == list(got.held_out)
    held = got[got.held_out]
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert held[held.toxic == 1].predicted.mean() > 0.75 and held[held.toxic == 0].predicted.mean() < 0.01


def test_toxicity_odd_rows(spark, odd, labels, no_labels, none):
    for known in (labels, no_labels):
        assert toxicity.score_documents(odd, known).count() == odd.count()
    assert toxicity.score_documents(none, labels).count() == 0
    assert toxicity.drop_toxic(odd, no_labels).columns == odd.columns


def test_machine_learns_pairs():
    """Neither term alone is toxic, both together are."""
    rows = [[0], [1], [0, 1], [2], [0, 2], [1, 2], [0, 1, 2], []] * 20
    y = np.array([float(0 in r and 1 in r) for r in rows])
    bias, w, v = toxicity.fit_machine(rows, y, np.ones(len(y)), 3, shrink=0.0, rounds=600)
    m = toxicity.Machine(bias, {10: 0, 11: 1, 12: 2}, w, v)
    z = lambda k: bias + w[k].sum() + 0.5 * (v[k].sum(axis=0) ** 2 - (v[k] ** 2).sum(axis=0)).sum()
    assert z([0, 1]) > 0 > max(z([0]), z([1]), z([0, 2])) and m.factors.shape == (3, toxicity.FACTORS)


def test_cotraining(spark, odd, labels, no_labels, none):
    got = queries.op1_cotraining(spark, BIG).join(spark.read.parquet(f"{BIG}/labels.parquet"), "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.1
    assert set(cotraining.score_documents(odd, no_labels).select("score").distinct().toPandas().score) == {0.5}
    assert cotraining.score_documents(odd, labels).count() == odd.count() and cotraining.score_documents(none, labels).count() == 0


def check_packed(rows, got, max_len=1024):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, have = Counter(), defaultdict(list)
    for r in rows:
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want.update((r["doc_id"], s, len(ids[s : s + max_len]), zlib.crc32(ids[s : s + max_len].tobytes()), len(ids)) for s in range(0, len(ids), max_len))
    assert Counter((g["doc_id"], g["start"], g["length"], g["ids_crc32"], g["doc_tokens"]) for g in got) == want
    for g in got:
        have[g["sequence_id"]].append((g["offset"], g["length"]))
    for pieces in have.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= max_len
    return sum(g["length"] for g in got) / (max_len * len(have)) if have else 1.0


def test_packing_round_trip(spark, sf, odd, clashing, none):
    assert check_packed(spark.read.parquet(f"{sf}/documents.parquet").collect(), queries.op5_pack_histogram(spark, sf).collect()) > 0.97
    check_packed(odd.collect(), packing.pack(clashing, salt_rows=3).collect())
    assert packing.pack(none).count() == 0


@pytest.mark.parametrize("text", ["", " ", "  a  b ", "\n a\n\nb   c", "it's  we'll ' s", "a <|endoftext|> b", "<|endoftext|>", "x  y  z", "é 中文 😀 a", "a\r\n b\tc", "1 22 333  4!"])
def test_chunked_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert packing.token_bytes(text) == np.array([*t.encode(text, add_special_tokens=False).ids, 0], dtype="<u4").tobytes()


def test_histogram_packing_places_everything():
    rng = np.random.default_rng(1)
    counts = {int(x): int(rng.integers(1, 50)) for x in rng.integers(1, 65, size=40)}
    placed = Counter()
    for n, lengths in packing.pack_histogram(counts, 64):
        assert sum(lengths) <= 64
        for x in lengths:
            placed[x] += n
    assert placed == Counter(counts)


def test_mixing_holds_marginals(spark, odd, none):
    """The marginals of what is drawn, in expectation and in the draw itself, on targets that may be beyond a value's tokens."""
    got = queries.op4_source_mix(spark, BIG).toPandas()
    assert got.p.between(0, 1).all() and got.gap.max() < 0.002
    drawn, share = got[got.drawn], source_mix.FRACTION
    for dim, power in source_mix.TARGETS.items():
        t = got.groupby(dim).n_tokens.sum().astype(float)
        most, want = t / t.sum() / share, t**power / (t**power).sum()
        for _ in range(len(t)):  # full values one by one
            full = want >= most - 1e-15
            want = most.where(full, want * (1 - most[full].sum()) / want[~full].sum()) if (~full).any() else most
        want = np.minimum(want, most)
        expected = (got.p * got.n_tokens).groupby(got[dim]).sum()
        assert np.allclose(expected / (share * t.sum()), want, atol=0.002)
        assert np.allclose(drawn.groupby(dim).n_tokens.sum().reindex(t.index, fill_value=0) / drawn.n_tokens.sum(), want, atol=0.02)
    assert source_mix.mix_report(odd).count() == odd.count() and source_mix.mix_report(none).count() == 0
    taken = odd.withColumns({c: F.lit(c) for c in ("row", "_source", "_p", "_topic", "p", "gap", "tokens")})
    assert source_mix.mix(odd).columns == odd.columns and source_mix.mix(taken).columns == taken.columns and source_mix.mix(taken).count() == source_mix.mix(odd).count()


def test_mixing_to_given_weights(spark):
    cells = spark.createDataFrame([(s, g, "prose", n) for s, g, n in (("a", "en", 90), ("a", "de", 10), ("b", "en", 40), ("b", "de", 60))], "source string, lang string, topic string, tokens long")
    got = source_mix.rake(cells, {"source": {"a": 1.0, "b": 3.0, "gone": 5.0}, "lang": {"en": 0.4, "de": 0.6}}, 0.3).toPandas()
    assert np.allclose(got.groupby("source").weight.sum(), [0.25, 0.75], atol=1e-4) and np.allclose(got.groupby("lang").weight.sum(), [0.6, 0.4], atol=1e-4) and got.gap.max() < 1e-4
    ratio = got.set_index(["source", "lang"]).weight / got.set_index(["source", "lang"]).tokens
    assert np.isclose(ratio["a", "en"] * ratio["b", "de"], ratio["a", "de"] * ratio["b", "en"], rtol=1e-3)  # raking keeps the odds ratios
    far = source_mix.rake(cells, {"source": {"a": 1.0, "b": 1.0}, "lang": {"en": 0.01, "de": 0.99}}, 0.3).toPandas()
    assert far.gap.max() > 0.1  # a has too little German for that: it is told


def test_pipeline(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "source_mix", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_table(stage(spark, docs, sf), name)
        assert docs.columns == names
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0
    kept = docs.collect()
    got = corpus_pipeline.run(spark, sf).collect()
    assert check_packed(kept, got) > 0.9
    assert docs.select(F.count_distinct("doc_id")).first()[0] == len(kept)


def test_cotraining_labels_the_whole_pool(spark, monkeypatch):
    """Every unlabelled row is scored and the quota follows the pool, whatever its size."""
    n = 9000
    docs = spark.range(n).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN concat('calm plain words about rivers and towns number ', id) ELSE '### $$$ !!! WIN WIN WIN ||| %%%' END AS text", "'en' AS lang", "CASE WHEN id % 2 = 0 THEN 'book' ELSE 'spam' END AS source", "60L AS n_chars")
    labels = spark.range(200).selectExpr("id AS doc_id", "cast((id + 1) % 2 AS int) AS quality")
    seen, BINS = [], cotraining.BINS
    real = cotraining.confident_cut
    monkeypatch.setattr(cotraining.CoTrained, "loss", lambda self, *_: -len(seen))  # no round is the last
    monkeypatch.setattr(cotraining, "confident_cut", lambda c, bad, good, edges: seen.append((c.sum(), bad + good)) or real(c, bad, good, (BINS // 2, BINS // 2)))
    model = cotraining.fit(docs, labels)
    assert seen[:2] == [(n - 200, int(cotraining.GROW * (n - 200) / 2))] * 2 and len(seen) == 2 * cotraining.ROUNDS
    assert seen[-1][0] <= n - 200 - 3 * 0.9 * seen[-1][1]  # rows that have a label leave the pool
    assert model.text.bias != 0


@pytest.mark.parametrize("half", [0, 1])
def test_exchange_is_no_worse_than_none(spark, half):
    """Fitted on one half of the labels, judged on the other: with the rounds and without them."""
    docs, known = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    mine, other = (known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == k) for k in (half, 1 - half))
    judged = docs.join(other.select("doc_id", "quality"), "doc_id").limit(100_000).select("text", "source", "lang", "n_chars", "quality").collect()
    texts, metas = [cotraining.text_features(r["text"], {}) for r in judged], [cotraining.meta_features(r["source"], r["lang"], r["n_chars"], r["text"]) for r in judged]
    y = np.array([r["quality"] for r in judged])
    right = {}
    for rounds in (0, cotraining.ROUNDS):
        score = cotraining.fit(docs, mine, rounds=rounds).score(texts, metas)[2] >= cotraining.THRESHOLD
        right[rounds] = (score == y).mean()
        assert score[y == 1].mean() > 0.97 and score[y == 0].mean() < 0.1
    assert right[cotraining.ROUNDS] >= right[0] - 0.001


def test_a_view_without_skill_gives_no_labels():
    rng = np.random.default_rng(2)
    y = (rng.random(800) < 0.9).astype(int)
    assert cotraining.trusted_edges(rng.normal(size=800), y)[0] == 0  # bad rows are nowhere told from good ones
    lo, hi = cotraining.trusted_edges(np.where(y == 1, 2.0, -2.0) + rng.normal(size=800) / 9, y)
    assert 0 < lo <= cotraining.BINS // 2 <= hi < cotraining.BINS


def test_cotraining_makes_features_once(spark, odd, labels):
    """Scores come from the features that were written for the rounds: texts are not read again. Character classes are those of all code points."""
    plan = cotraining.score_documents(odd, labels)._jdf.queryExecution().optimizedPlan().toString()
    assert "tc#" in plan and "text#" not in plan.replace("_text#", "")
    t = "ÀÉß Ⅷ ١٢٣ AbC 12 a a\n\u00b2 ǅ \U0001d400 Z9!"
    assert [round(float(x), 6) for x in cotraining.text_features(t, {})[1][1:3]] == [round(4 * sum(map(f, t)) / len(t), 6) for f in (str.isupper, str.isdigit)]
