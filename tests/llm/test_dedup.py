"""SimHash components, line dedup and Hamming search against brute force."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F

from veilspark.llm import common, hamming_search, line_dedup, queries, simhash_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [fingerprint(r["text"]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    arr = np.array(fps, dtype=np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr[i + 1 :] ^ arr[i]) <= 3) + i + 1:
            root[find(int(j))] = find(i)
    least = {}
    for i, r in enumerate(rows):
        if r["doc_id"] is not None:
            least[find(i)] = min(least.get(find(i), r["doc_id"]), r["doc_id"])
    return Counter((r["doc_id"], f"{fp:016x}", least.get(find(i))) for i, (r, fp) in enumerate(zip(rows, fps, strict=True)))


def told(df):
    return Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect())


def test_components_match_brute_force(spark, sf, odd, clashing, none):
    assert told(queries.op3_simhash_components(spark, sf)) == brute_components(spark.read.parquet(f"{sf}/documents.parquet").collect())
    assert told(simhash_dedup.components(clashing)) == brute_components(odd.collect())
    assert simhash_dedup.components(none).count() == 0


def test_position_sets_cover():
    from itertools import combinations

    assert all(any(set(s) <= set(c) for s in simhash_dedup.POSITION_SETS) for c in combinations(range(8), 5))


def test_edges_connect_what_links_connect(spark):
    """A dense ball of fingerprints, with blocks far smaller than its postings, against plain components."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    fps = {centre ^ sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 7), replace=False)) for _ in range(900)} | {int(x) for x in rng.integers(1 << 62, size=400)}
    fps = sorted(fps)
    edges = simhash_dedup.star_edges(spark.createDataFrame([(x,) for x in fps], "fp long"), block=64)
    roots = {r["node"]: r["root"] for r in simhash_dedup.connect(edges).collect()}
    arr, want = np.array(fps, dtype=np.uint64), {}
    left = set(range(len(fps)))
    while left:
        queue, comp = [min(left)], []
        left.discard(queue[0])
        while queue:
            i = queue.pop()
            comp.append(i)
            near = [j for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 3) if j in left]
            left -= set(near)
            queue += near
        want |= {fps[i]: fps[min(comp)] for i in comp}
    assert {f: roots.get(f, f) for f in fps} == want


def test_keep_one(spark, odd):
    kept = simhash_dedup.keep_one(odd).collect()
    comps = {(r["doc_id"], r["component_id"]) for r in simhash_dedup.components(odd).collect() if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(d for d, c in comps if d == c)
    assert sum(r["doc_id"] is None for r in kept) == 2 and kept[0].asDict().keys() == odd.first().asDict().keys()


def brute_lines(rows, m=2, w=8):
    docs = sorted((r["doc_id"], i, r["text"]) for i, r in enumerate(sorted((r for r in rows if r["doc_id"] is not None), key=lambda r: (r["doc_id"], r["text"] is not None, r["text"] or ""))))
    seq = {(d, i): [x for x in (t or "").split("\n") if WORD.search(x)] for d, i, t in docs}
    gone = defaultdict(set)
    for depth in {1, m}:
        seen = set()
        for k, s in seq.items():
            for i in range(len(s) - depth + 1):
                run = tuple(s[i : i + depth])
                if run in seen and (depth == m or len(WORD.findall(s[i])) >= w):
                    gone[k].update(range(i, i + depth))
                seen.add(run)
    out = Counter()
    for d, i, t in docs:
        lines = (t or "").split("\n")
        symbols = [j for j, x in enumerate(lines) if WORD.search(x)]
        cut = {symbols[i2] for i2 in gone[(d, i)]}
        text = t if not cut else "" if len(cut) == len(symbols) else "\n".join(x for j, x in enumerate(lines) if j not in cut)
        out[(d, text, len(symbols), len(cut), sum(x - 1 not in gone[(d, i)] for x in gone[(d, i)]))] += 1
    return out


@pytest.mark.parametrize("m", [1, 2, 3, 7])
def test_lines_match_brute_force(spark, sf, odd, clashing, m):
    for df in (spark.read.parquet(f"{sf}/documents.parquet"), clashing):
        got = Counter((r["doc_id"], r["text"], *(r[c] for c in line_dedup.RESULTS)) for r in line_dedup.delete_lines(df, m, 8).where("doc_id is not null").collect())
        assert got == brute_lines(df.collect(), m)


@pytest.mark.parametrize("hot", [1, 10_000])
def test_suffix_array_against_sorted_suffixes(spark, monkeypatch, hot):
    """Few kinds of lines, so that runs are long; every key counts as hot. Order, ties and common prefixes against plain Python."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    monkeypatch.setattr(line_dedup, "ORDERED", hot)
    rng = np.random.default_rng(11)
    base = [f"line {x}" for x in rng.integers(0, 3, 40)]
    docs = [(k, "\n".join([*base[s : s + n], *(f"line {x}" for x in rng.integers(0, 4, 3))])) for k, (s, n) in enumerate(zip(rng.integers(0, 30, 12), rng.integers(0, 30, 12), strict=True))]
    docs += [(90, docs[0][1]), (91, docs[3][1]), (92, "line 1\nonly here\nline 1"), (93, "line 1")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    levels = line_dedup.suffix_levels(line_dedup.line_table(line_dedup.numbered(df), 8))
    entries = line_dedup.suffix_array(levels).orderBy("rank").collect()
    seq = {k: t.split("\n") for k, t in docs}
    common_lines = Counter(x for s in seq.values() for x in s)
    suffix = {(d, i): tuple(s[i:]) for d, s in seq.items() for i in range(len(s)) if common_lines[s[i]] > 1}
    equal = defaultdict(list)
    for at, s in suffix.items():
        equal[s].append(at)
    got = [(suffix[tuple(e["first"])], e["n"], tuple(e["first"])) for e in entries]
    assert sorted(got) == sorted((s, len(a), min(a)) for s, a in equal.items()) and levels[-1][0] > 16
    ranks = [e["rank"] for e in entries]
    assert ranks == [1 + sum(e["n"] for e in entries[:k]) for k in range(len(entries))]
    shared = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y, strict=False)) if a != b), min(len(x), len(y)))
    lcp = [e["lcp"] for e in entries]
    assert lcp == [0, *(shared(a, b) for (a, *_), (b, *_) in zip(got, got[1:], strict=False))]
    for most in (1, 2, 3, 5):
        upto = [min(e["lcp"], most) for e in line_dedup.suffix_array(levels, most).orderBy("rank").collect()]
        assert upto == [min(x, most) for x in lcp]
    for a in range(0, len(got), 7):  # in a sorted list what two entries share is the least that neighbours share between them
        for b in range(a + 1, len(got), 5):
            assert shared(got[a][0], got[b][0]) == min(lcp[a + 1 : b + 1])


def test_lines_of_odd_tables(spark, odd, none):
    assert line_dedup.delete_lines(none).count() == 0 and line_dedup.clean_documents(none).columns == none.columns
    out = line_dedup.clean_documents(odd).collect()
    assert sum(r["doc_id"] is None for r in out) == 2
    assert all(r["text"] is None or r["n_chars"] is None or r["doc_id"] not in (9, 11) or r["n_chars"] == len(r["text"]) for r in out)
    taken = odd.withColumns({c: F.lit(c) for c in (*line_dedup.RESULTS, "row", "d", "i", "gone", "a.b")})
    kept = line_dedup.clean_documents(taken)
    assert kept.columns == taken.columns and sorted(map(str, kept.select("doc_id", "text", "n_lines", "row").collect())) == sorted(str(Row(doc_id=r["doc_id"], text=r["text"], n_lines="n_lines", row="row")) for r in out)
    with pytest.raises(ValueError):
        line_dedup.repeated_lines(line_dedup.numbered(odd), 0)


def test_maximal_runs(spark):
    lines = spark.createDataFrame([(1, 0), (1, 1), (1, 4), (2, 3)], "d long, i int")
    assert {tuple(r) for r in line_dedup.maximal_runs(lines).select("d", "start", "n_lines").collect()} == {(1, 0, 2), (1, 4, 1), (2, 3, 1)}


def brute_search(rows, k):
    out = {}
    known = [(i, c) for i, c in rows if i is not None and c is not None]
    for q, c in set(known):
        if q % 20 == 0:
            near = sorted((bin((c ^ d) & (2**64 - 1)).count("1"), i) for i, d in set(known) if i != q)[:k]
            out[q] = [(i, dist) for dist, i in near]
    return out


@pytest.mark.parametrize("block", [8, 64, 2048])
def test_search_is_exact(spark, monkeypatch, block):
    """Buckets far smaller than what shares a segment's value; every key counts as hot."""
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    rng = np.random.default_rng(5)
    codes = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, size=60)]
    near = [codes[i % 20] ^ (1 << int(rng.integers(60))) ^ (1 << int(rng.integers(60))) for i in range(300)]
    same = [(int(x) << 20) + 77 for x in rng.integers(0, 1 << 43, size=150)]  # these share their low segments
    rows = [*enumerate(codes + near + [codes[0]] * 90 + same), (None, 5), (1000, None), (1020, codes[0])]
    df = spark.createDataFrame(rows, "id long, code long")
    found = hamming_search.search(df.where("id % 20 = 0"), df, k=7, block=block).collect()
    got = defaultdict(list)
    for r in found:
        got[r["query_id"]].append((r["rank"], r["neighbour_id"], r["distance"]))
    want = brute_search([tuple(r) for r in df.collect()], 7)
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == {q: v for q, v in want.items() if v}
    m = len(hamming_search.segments(len({c for _, c in rows if c is not None})))
    for r in found:  # covered, and not by one radius less than needed
        assert r["distance"] <= m * (r["radius"] + 1) - 1
    assert len({r["radius"] for r in found}) > 1


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, 5), (20, 5), (7, None)], "id long, code long")
    assert {tuple(r)[:4] for r in hamming_search.search(df.where("id % 20 = 0"), df).collect()} == {(0, 1, 20, 0), (20, 1, 0, 0)}
    assert hamming_search.search(df.limit(0), df.limit(0)).count() == 0


def test_sign_code(spark):
    df = spark.createDataFrame([([1.0] + [-1.0] * 62 + [2.0],), ([],), (None,)], "v array<float>")
    with pytest.raises(Exception, match="64 bits"):
        df.select(hamming_search.sign_code(F.array_repeat(F.lit(1.0), 65))).collect()
    assert [r[0] for r in df.select(hamming_search.sign_code(F.col("v"))).collect()] == [1 - 2**63, None, None]


def shingles(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_similar(rows):
    """The smallest doc_id of each group of texts with a similarity of 0.8, linked directly or through others."""
    rows = sorted(rows)
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    having = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s or {None}:
            having[g].append(i)
    for i, s in enumerate(sets):
        shared = Counter(j for g in s or {None} for j in having[g] if j < i)
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s | sets[j]) if s else 1):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {rows[i][0] for i in range(len(rows)) if find(i) == i}


def test_keep_one_similar(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rng, planted = np.random.default_rng(5), []
    for k, (_, t) in enumerate(r for r in rows[:400] if r[1] and len(r[1].split()) > 80):
        w = t.split()
        for at in rng.choice(len(w), len(w) // 60, replace=False):
            w[at] = f"swap{k}"
        planted.append((1_000_000 + k, " ".join(w)))
    kept = {r["doc_id"] for r in simhash_dedup.keep_one_similar(spark.createDataFrame(rows + planted, "doc_id long, text string"), block=16).collect()}
    want = brute_similar(rows + planted)
    everything = {d for d, _ in rows + planted}
    assert want <= kept  # no text goes that is not similar to one that stays in its group
    assert len(everything - kept) >= 0.95 * len(everything - want)


def test_a_large_group_of_near_copies_makes_few_pairs(spark):
    """600 texts that differ from one base, and from each other by more than the limit, in the midst of others: one stays."""
    rng = np.random.default_rng(9)
    base = [f"word{i}" for i in range(300)]
    rows = [(1, " ".join(base))]
    for k in range(2, 601):
        w = list(base)
        for at in rng.choice(60, 4, replace=False):  # up to 20 shingles of 296
            w[5 * at] = f"swap{k}"
        rows.append((k, " ".join(w)))
    rows += [(1000 + k, " ".join(f"own{k}x{i}" for i in range(100))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_dedup.keep_one_similar(docs, block=64).collect()} == brute_similar(rows)
    prints = docs.mapInArrow(simhash_dedup._wide_prints, "node long, s0 long, s1 long, f0 long, f1 long, f2 long, f3 long")
    families = simhash_dedup.similar_families(prints.select("node", "f0", "f1", "f2", "f3"), block=64)
    assert families.where("node <= 600").count() >= 590 and families.where("node > 600").count() == 0
    members, roots = simhash_dedup.similar_groups(docs, block=64, most_shingles=5000)
    assert members.count() == len(rows) and {r["root"] for r in roots.collect()} == {1}


def test_keep_one_similar_odd(spark, odd, clashing, none):
    kept = simhash_dedup.keep_one_similar(odd).collect()
    rows = {r["doc_id"]: r["text"] for r in odd.collect() if r["doc_id"] is not None}
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted(brute_similar(rows.items()))
    assert sum(r["doc_id"] is None for r in kept) == 2
    more = clashing.withColumns({c: F.lit(1) for c in ("row", "node", "gone", "nth", "a", "b", "f0", "s0")})
    got = simhash_dedup.keep_one_similar(more)
    assert got.columns == more.columns and got.count() == len(kept)
    assert simhash_dedup.keep_one_similar(none).count() == 0


@pytest.mark.parametrize("n", range(9))
def test_shingle_sets(n):
    """Equal sets of 5-word shingles have equal hashes, others have not."""
    some = [" ".join(f"w{(i * step) % 4}" for i in range(n)) for step in (1, 2, 3, 5)]
    got = [tuple(simhash_dedup._shingle_set(simhash_dedup._grams(t))) for t in some]
    assert [[a == b for b in got] for a in got] == [[shingles(a) == shingles(b) for b in some] for a in some]
    assert [len(g) for g in got] == [len(shingles(t)) for t in some]
    assert all(int(simhash_dedup._wide_print(simhash_dedup._grams(t))[0]) == simhash_dedup.simhash(t) for t in some)
