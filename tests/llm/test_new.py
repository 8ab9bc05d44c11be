"""Source divergence, byte-level BPE and conversation repair, against SQL, tiktoken and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import groupby
from pathlib import Path

import duckdb
import numpy as np
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import public_tokenizers
from veilspark.llm import bpe_transducer, conversation_repair, queries, source_divergence


@pytest.mark.parametrize("name,table", [("op11_source_divergence", "documents"), ("op13_conversation_repair", "conversations")])
def test_matches_sql(spark, sf, name, table):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    cur = c.execute(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, sf)
    assert sorted(x[0] for x in cur.description) == sorted(got.columns)
    assert sorted(map(tuple, got.select(*(x[0] for x in cur.description)).collect())) == sorted(cur.fetchall())


# ------------------------------------------------------------------ op11

WORDS = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def divergence(rows, least=3, top=200):
    by_lang = defaultdict(list)
    for r in rows:
        by_lang[r["lang"] or ""].append((r["source"] or "", WORDS.findall((r["text"] or "").translate(LOWER))))
    out = []
    for lang, docs in by_lang.items():
        seen = Counter(w for _, words in docs for w in set(words))
        kept = sorted((w for w in seen if seen[w] >= least), key=lambda w: w.encode())
        count = {s: Counter() for s, _ in docs}
        for s, words in docs:
            count[s].update(w for w in words if seen[w] >= least)
        share = lambda n, total: 1 + 10**9 * (n + 1) // (total + len(kept))
        p = {s: [share(c[w], sum(c.values())) for w in kept] for s, c in count.items()}
        whole = sum(count.values(), Counter())
        q = [share(whole[w], sum(whole.values())) for w in kept]
        for s in count:
            pairs = [(sum((a - b) ** 2 // b for a, b in zip(p[s], p[o], strict=True)), o) for o in count if o != s]
            terms = [((a - b) ** 2 // b, w) for a, b, w in zip(p[s], q, kept, strict=True) if count[s][w] and a > b]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def audited(df, **more):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in source_divergence.audit(df, **more).collect())


def test_divergence_odd_rows(spark, odd, none, clashing):
    want = divergence(odd.collect())
    assert audited(odd) == want and audited(clashing.drop("d")) == want
    assert audited(odd, least_docs=1, top_terms=3) == divergence(odd.collect(), 1, 3)
    assert audited(none) == []
    texts = spark.createDataFrame([("xx", "s", "Ünï ÄB äb K ﬀ a_b"), ("xx", "t", "ünï äb x"), ("xx", "t", "ünï b"), ("xx", "u", None), ("yy", None, "one"), (None, None, "a a a")], "lang string, source string, text string")
    assert audited(texts, least_docs=2) == divergence(texts.collect(), 2)


def test_divergence_by_buckets_and_stretches(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = audited(docs)
    monkeypatch.setattr(source_divergence, "CELLS", 500)
    assert audited(docs) == one == divergence(docs.collect())
    text = "Wort ö " * 400_000
    found = list(source_divergence.terms(text))
    assert len(found) > 2 and [w for f in found for w in f] == ["wort".encode(), "ö".encode()] * 400_000
    long = spark.createDataFrame([("en", "a", text), ("en", "b", text), ("en", "b", "wort"), ("en", "c", "wort x")], "lang string, source string, text string")
    assert audited(long) == divergence(long.collect())


def test_shares_are_exact():
    rnd = random.Random(3)
    for _ in range(2000):
        n, total, kept = rnd.randrange(10**13), rnd.randrange(10**13, 10**15), rnd.randrange(1, 10**9)
        assert source_divergence.shares(np.array([n]), total, kept)[0] == 1 + 10**9 * (n + 1) // (total + kept)


# ------------------------------------------------------------------ op12


@pytest.fixture(scope="module")
def known():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(bpe_transducer.VOCABULARY)).read_bytes().splitlines())}
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(text):
    return [i for block in bpe_transducer.encode_text(text) for i in block]


def check_digests(rows, got, known):
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    want = Counter()
    for r in rows:
        ids = known.encode_ordinary(r["text"] or "")
        want[(r["doc_id"], len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha((r["text"] or "").encode()))] += 1
    assert Counter((g["doc_id"], g["n_tokens"], g["ids_sha256"], g["decoded_sha256"]) for g in got) == want


def test_bpe_matches_tiktoken(spark, sf, odd, clashing, none, known):
    check_digests(spark.read.parquet(f"{sf}/documents.parquet").collect(), queries.op12_bpe_transducer(spark, sf).collect(), known)
    check_digests(odd.collect(), bpe_transducer.digests(odd).collect(), known)
    check_digests(odd.collect(), bpe_transducer.digests(clashing).collect(), known)
    assert bpe_transducer.digests(none).count() == 0


def test_bpe_round_trip_of_columns(spark, odd, clashing):
    from pyspark.sql import functions as F

    named = clashing.withColumn("ids", F.lit("x")).withColumn("a.b", F.lit(1))
    there = bpe_transducer.encode(named)
    assert sorted(there.columns) == sorted(named.columns) and there.schema["ids"].dataType.simpleString() == "array<int>"
    back = bpe_transducer.decode(there).select("doc_id", "text", "decoded").collect()
    assert len(back) == odd.count() and all((r["text"] or "") == r["decoded"] for r in back)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n", max_size=60), st.text("theinongor'st0 ", max_size=80), st.text("のにはをたがでてаеиоу", max_size=40)))
def test_bpe_of_any_text(known, text):
    assert ids_of(text) == known.encode_ordinary(text)


def test_bpe_of_tokens_put_together(known):
    rnd = random.Random(5)
    tokens = [b.decode() for b in bpe_transducer.loaded(bpe_transducer.VOCABULARY)[0].merges.ranks if b.isascii()]
    for _ in range(3000):
        text = "".join(rnd.choice(tokens) for _ in range(rnd.randint(1, 6)))
        assert ids_of(text) == known.encode_ordinary(text)


def test_bpe_of_every_kind_of_character(known):
    for c in (*range(0x3100), *range(0x3100, 0xD800, 97), *range(0xE000, 0x110000, 991)):
        text = f"a{chr(c)}b {chr(c)}1 {chr(c)} {chr(c)}{chr(c)}\n"
        assert ids_of(text) == known.encode_ordinary(text)


def test_bpe_of_long_texts(spark, known):
    """Several MB, one piece of 129,000 letters, stretches cut between words only."""
    rnd = random.Random(7)
    text = "abc" * 40_000 + "é" * 9000 + " " + " ".join("".join(rnd.choice("etaoin") for _ in range(rnd.randint(1, 9))) for _ in range(600_000))
    assert len(list(bpe_transducer.stretches(text))) > 2 and "".join(bpe_transducer.stretches(text)) == text
    rows = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    check_digests(rows.collect(), bpe_transducer.digests(rows).collect(), known)


def test_bpe_forgets_and_goes_on(known):
    merges = bpe_transducer.loaded(bpe_transducer.VOCABULARY)[0].merges
    small = bpe_transducer.Transducer(merges)
    small.MOST, small.LOOK = 50, 16
    text = "Some words, and otherwise longer ones: internationalisation hippopotamus " * 5 + "z" * 500
    pieces = regex.findall(public_tokenizers.PATTERN, text)
    assert [i for block in small.encode(pieces) for i in block] == known.encode_ordinary(text)
    assert len(small.states) < 200


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 255), st.sampled_from(list("é€😀퟿".encode() + b"\xed\xa0\xf4\x90\xc0"))), max_size=16), st.integers(0, 16))
def test_decoding_any_bytes_in_parts(known, raw, at):
    """Equal to the strict reading with replacement, wherever the blocks are cut."""
    ids = [known.encode_single_token(bytes([x])) for x in raw]
    assert "".join(bpe_transducer.decode_ids([ids[:at], ids[at:]])) == bytes(raw).decode("utf-8", "replace")


# ------------------------------------------------------------------ op13

BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
KEEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
GIVEN = {"": "u", "s": "u", "u": "a", "a": "u"}


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def cheapest(rows):
    """(cost, audit, lines) by a forward search over all states that keeps the least of each; rows: (role, text, must go, truncated)."""
    best = {"": (0, "", ())}

    def put_in(best):
        for _ in range(2):
            for state, (cost, audit, lines) in list(best.items()):
                role = {"u": "user", "a": "assistant"}[GIVEN[state]]
                new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                if new[:2] < best.get(GIVEN[state], (10**9,))[:2]:
                    best[GIVEN[state]] = new
        return best

    for role, text, must, late in rows:
        nxt = {}
        for state, (cost, audit, lines) in put_in(best).items():
            ways = [(state, cost + 2, "D", lines)]
            if not must:
                given = GIVEN[state]
                ways.append((given, cost + 1 + 5 * late, "R", (*lines, f"{ {'u': 'user', 'a': 'assistant'}[given]}:{text}")))
                if (to := KEEPS.get((state, role[:1]))) is not None:
                    ways.append((to, cost + 5 * late, "K", (*lines, f"{role}:{text}")))
            for to, c, letter, told in ways:
                if (c, audit + letter) < nxt.get(to, (10**9,))[:2]:
                    nxt[to] = (c, audit + letter, told)
        best = nxt
    return min(v for k, v in put_in(best).items() if k in ("", "a"))


def reports(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))
    out = {}
    for conv, group in groupby(rows, key=lambda r: r[0]):
        group, seen, judged, faults = list(group), set(), [], Counter()
        for _, _, role, text in group:
            body = text.strip(BLANKS)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            judged.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        turns = [r[1] for r in group if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = cheapest(judged)
        out[conv] = (conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
CONV = "conv_id long, turn long, role string, text string"


def made_up(n=400, seed=11):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rnd.choice((0, 1, 2, 5, 9, 14))):
            role = rnd.choice(("system", "user", "assistant", "user", "assistant", None, "", "tool", "avatar"))
            rows.append((None if conv == 0 else conv, rnd.choice((turn, turn * 2, None, 3)), role, rnd.choice(("Yes.", "No!", "ok", "", " \t\n", None, f"Why {turn}?", "cut off,", "two\nlines. "))))
    return rows


def test_repair_against_brute_force(spark, sf):
    for rows in (made_up(), [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]):
        df = spark.createDataFrame(rows, CONV)
        hurt = damaged(rows)
        assert Counter(map(tuple, conversation_repair.damage(df).collect())) == Counter(hurt)
        want = reports(hurt)
        nothing = (0,) * 6 + ("", hashlib.sha256().hexdigest())
        got = {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in conversation_repair.report(conversation_repair.damage(df), df).collect()}
        assert got == {c: want.get(c, (c, *nothing)) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("block", [1, 3, 7])
def test_repair_by_small_blocks(spark, block):
    """A conversation in many blocks, over several partitions, is repaired as if it were one."""
    rnd = random.Random(block)
    long = [(7, i, rnd.choice(("user", "assistant", "user", "assistant", "system", "tool")), rnd.choice(("Yes.", "cut", "", f"n {i}.", f"m {i}"))) for i in range(300)]
    rows = [*long, *((c + 100 if c is not None else None, *more) for c, *more in made_up(60, block))]
    want = reports([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])
    got = conversation_repair.report(spark.createDataFrame(rows, CONV).repartition(5), block=block).collect()
    assert {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want


def test_repaired_rows_are_what_the_report_tells(spark, none):
    rows = spark.createDataFrame([(c, t, r, x) for c, t, r, x in made_up(80, 2) if c], CONV).withColumn("k", F.lit(1)).withColumn("j", F.lit("x")).withColumn("a.b", F.lit(0))
    fixed = conversation_repair.repair(rows).collect()
    told = {r["conv_id"]: r for r in conversation_repair.report(rows).collect()}
    by_conv = defaultdict(list)
    for r in sorted(fixed, key=lambda r: (r["conv_id"], r["position"])):
        by_conv[r["conv_id"]].append(r)
    for conv, r in told.items():
        lines = by_conv[conv]
        assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in lines))
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in lines).encode()).hexdigest() == r["repaired_sha256"]
        assert [x["edit"] for x in lines] == [x for x in r["audit"] if x != "D"]
    empty = spark.createDataFrame([], CONV)
    assert conversation_repair.repair(empty).count() == 0 and conversation_repair.report(empty).count() == 0


def test_repair_of_a_very_long_text(spark):
    rows = [(1, 0, "user", "word " * 1_000_000 + "?"), (1, 1, "assistant", "word " * 1_000_000), (1, 2, "user", "word " * 1_000_000 + "?")]
    got = conversation_repair.report(spark.createDataFrame(rows, CONV)).first()
    assert tuple(got) == reports(rows)[1] or tuple(got[c] for c in COLUMNS) == reports(rows)[1]


def test_bucket_queue_finds_the_least_distances():
    """Against relaxation until nothing changes."""
    rnd = random.Random(1)
    for _ in range(200):
        codes = "".join(rnd.choice("sua?SUA!BD") for _ in range(rnd.randint(0, 12)))
        ends = [rnd.choice((0, 3, 7, 11, conversation_repair.NEVER)) for _ in range(3)] + [rnd.randrange(20)]
        n = len(codes)
        want = [conversation_repair.NEVER] * (4 * n) + ends
        for _ in range(4 * n + 4):
            for i in range(n):
                for s in range(4):
                    put = conversation_repair.NEXT[s, conversation_repair.WANTED[s]]
                    want[4 * i + s] = min([want[4 * i + s], 5 + want[4 * i + put], *(w + want[4 * i + 4 + to] for _, w, to in conversation_repair.ROW_ARCS[codes[i]][s])])
        assert [min(x, conversation_repair.NEVER) for x in conversation_repair.distances(codes, ends)] == [min(x, conversation_repair.NEVER) for x in want]
