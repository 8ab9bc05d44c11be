"""SimHash near-duplicate components (operator 3).

Fingerprints are 64-bit SimHashes of the 3-word shingles. Candidate pairs come from an inverted
index over byte positions with count filtering: two fingerprints that differ in at most 3 bits
differ in at most 3 of their 8 bytes, so they share at least 5 positional bytes. A pair that
shares 5 positions shares one of a fixed family of 4-position sets (``POSITION_SETS``), so the
postings are keyed by such a set and its 4 bytes; that keeps them short at any size. Within a
posting the shared positional bytes of every pair are tallied, pairs below 5 are let go, and the
rest are verified by their differing bits.

Copies are one index entry (an entry is a distinct fingerprint). A posting never gives out its
pairs: it gives each fingerprint an edge to the smallest fingerprint it is connected with there,
so what leaves is no more than what came in. Postings above ``block`` entries are cut into blocks
that are compared two at a time in separate tasks. Edges are joined up by alternating large-star
and small-star steps.

Defined results: a null, empty or blank text has fingerprint zero, linked like any other; a text
with one or two words has one shingle, all its words; a text of any length is read whole; repeated rows keep their rows and share a
component; rows whose ``doc_id`` is null get a fingerprint and the component of the others
linked to them (null if there is none); no rows give no rows. Further columns are ignored.

``keep_one_similar`` links by similarity instead: texts whose sets of 5-word shingles have a Jaccard
similarity of at least 0.8. Such texts differ in too many of 64 bits for the guarantee above, so the
fingerprint has 256 bits (32 positional bytes; the first 8 are those above), postings are keyed by 3
positions out of a fixed family, the shared bytes of a pair are tallied inside a posting, and what
reaches the least number and is near enough in bits is a candidate. Texts connected by candidates are
a family, inside which candidates are verified on the whole shingle sets. The links
are exact, so no text goes that is not that similar; the index finds most links, not all (README).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join, write_table

BITS, MAX_BITS, SEED = 64, 3, 42
BYTES, LEAST_SHARED = 8, 5
BLOCK = 512


def _position_sets() -> tuple[tuple[int, ...], ...]:
    """4-position sets such that every 5 positions hold one of them, found greedily."""
    left, every, found = set(combinations(range(BYTES), LEAST_SHARED)), list(combinations(range(BYTES), LEAST_SHARED - 1)), []
    while left:
        best = max(every, key=lambda s: (sum(set(s) <= set(x) for x in left), [-i for i in s]))
        found.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return tuple(found)


POSITION_SETS = _position_sets()
_LOWER = {c: c + 32 for c in range(65, 91)}
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_TO_SPACE = {ord(c): " " for c in _WHITE} | _LOWER


def _words(text: str | None) -> list[str]:
    return [x for x in (text or "").translate(_TO_SPACE).split(" ") if x]


def simhash(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    from xxhash import xxh64_intdigest

    w = _words(text)
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < 3 else list(map(" ".join, zip(w, w[1:], w[2:], strict=False)))
    ones, n = np.zeros(BITS, dtype=np.int64), len(grams)
    for at in range(0, n, 1 << 15):
        h = np.fromiter((xxh64_intdigest(g, SEED) for g in grams[at : at + (1 << 15)]), dtype=np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = np.fromiter((simhash(t) for t in b.column("text").to_pylist()), dtype=np.uint64, count=b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp)], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_fingerprints, "doc_id long, fp long")


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For items 0..n-1 linked by a-b: the smallest item that each is connected with."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if np.array_equal(low, before):
            return low


def _pairs(group: np.ndarray, fp: np.ndarray, side: np.ndarray, both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows with the same group; rows are ordered by group. Where both is set, only rows of different sides are compared."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    out_a, out_b = [], []
    rest = np.repeat(starts + sizes, sizes) - np.arange(len(group)) - 1  # rows that follow in the group
    rows = np.flatnonzero(rest > 0)
    for shift in range(1, int(sizes.max(initial=1))):
        rows = rows[rest[rows] >= shift]
        if not len(rows):
            break
        x = fp[rows] ^ fp[rows + shift]
        shared = (x.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)  # the tally of positional bytes
        ok = (shared >= LEAST_SHARED) & (~both[rows] | (side[rows] != side[rows + shift]))
        ok[ok] = np.bitwise_count(x[ok]) <= MAX_BITS
        out_a.append(rows[ok])
        out_b.append(rows[ok] + shift)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (np.zeros(0, int), np.zeros(0, int))


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by group (k, v, i, j). A group that is not over at the end of a batch waits for the next one."""

    def link(t: pa.Table) -> pa.RecordBatch:
        cols = [t.column(c).to_numpy() for c in ("k", "v", "i", "j")]
        new = np.zeros(t.num_rows, dtype=bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        group, fp, side = np.cumsum(new), t.column("fp").to_numpy().view(np.uint64), t.column("chunk").to_numpy()
        a, b = _pairs(group, fp, side, cols[2] != cols[3])
        low = _roots(len(fp), a, b)
        has = np.flatnonzero(low != np.arange(len(fp)))
        return pa.RecordBatch.from_arrays([pa.array(fp[has].view(np.int64)), pa.array(fp[low[has]].view(np.int64))], names=["a", "b"])

    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        last = [t.column(c)[-1].as_py() for c in ("k", "v", "i", "j")]
        same = np.all([t.column(c).to_numpy() == x for c, x in zip(("k", "v", "i", "j"), last, strict=True)], axis=0)
        first = int(np.argmax(same))  # rows of the last group are at the end
        if first:
            yield link(t.slice(0, first).combine_chunks())
        held = t.slice(first).combine_chunks()
    if held is not None and held.num_rows:
        yield link(held)


def star_edges(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges a-b between distinct fingerprints (column fp) that connect just what links of at most 3 bits connect."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    value = lambda s: sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(0).cast("long"))
    keys = F.array(*(F.struct(F.lit(k).alias("k"), value(s).alias("v")) for k, s in enumerate(POSITION_SETS)))
    postings = entries.select("fp", F.explode(keys).alias("key")).select("key.k", "key.v", "fp")
    sizes = postings.groupBy("k", "v").agg(F.count("*").alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / block).cast("int")
    parted = postings.join(sizes, ["k", "v"]).withColumn("chunk", F.pmod(F.xxhash64("fp"), chunks).cast("int"))
    partners = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    blocks = parted.select("k", "v", "fp", "chunk", F.explode(partners).alias("p")).select("k", "v", "p.i", "p.j", "chunk", "fp")
    return blocks.repartition("k", "v", "i", "j").sortWithinPartitions("k", "v", "i", "j", "fp").mapInArrow(_edges, "a long, b long").distinct()


def connect(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node it is connected with) for every node of the edges, by large-star and small-star steps until nothing changes."""
    now, before = cut(edges.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi != lo").distinct()), None
    while True:
        told = now.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if told == before or told[0] == 0:
            break
        before = told
        ways = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = ways.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        down = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(down, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e"))
        now = cut(small.select("e.hi", "e.lo").where("hi != lo").distinct())
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def components(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable) for every row."""
    prints = cut(fingerprints(docs))
    entries = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connect(star_edges(entries.select("fp"), block))
    named = entries.join(roots, entries.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.select("fp", "root").join(ids, "root").select("fp", "component_id")
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs of which each component keeps one: the row of its smallest doc_id, once. Rows without a doc_id stay."""
    kept = components(docs.select("doc_id", "text"), block).where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    named = rows.where("doc_id is not null").join(kept, "doc_id", "left_semi")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text"), "row.text")
    named = named.withColumn("nth", F.row_number().over(one)).where("nth = 1")
    return named.select("row.*").unionByName(docs.where("doc_id is null"))


SIMILAR, WORDS, WIDE = 80, 5, 256  # per cent of shingles shared; words of a shingle; bits of the wide fingerprint
WIDE_BYTES, WIDE_SHARED, WIDE_BITS = WIDE // 8, 4, 48  # candidates share so many positional bytes and differ in at most so many bits
STEPS = ((1, 3), (5, 14))
#: 3-position sets of the 32 bytes; all distances are different, so two sets have at most one position in common.
WIDE_SETS = tuple((i, (i + a) % WIDE_BYTES, (i + b) % WIDE_BYTES) for a, b in STEPS for i in range(WIDE_BYTES))
_PRINT = ("f0", "f1", "f2", "f3")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """A further hash of each hash."""
    x = (h + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _grams(text: str | None) -> np.ndarray:
    """Hashes of the 3-word shingles, or of the whole sequence if it is shorter."""
    from xxhash import xxh64_intdigest

    w = _words(text)
    if len(w) < 3:
        return np.array([xxh64_intdigest(" ".join(w), SEED)] if w else [], dtype=np.uint64)
    return np.fromiter((xxh64_intdigest(" ".join(g), SEED) for g in zip(w, w[1:], w[2:], strict=False)), dtype=np.uint64, count=len(w) - 2)


def _shingle_set(h: np.ndarray) -> np.ndarray:
    """Hashes of the distinct 5-word shingles (of the whole sequence if it is shorter): words i to i+4 are the 3-word shingles at i and i+2."""
    if len(h) < WORDS - 2:  # the whole sequence, if there is one
        return (_mixed(h, len(h)) * np.array([1, 3], dtype=np.uint64)[: len(h)]).sum(keepdims=True, dtype=np.uint64)[: len(h)]
    return np.unique(_mixed(h[:-2] ^ _mixed(h[2:], 3), 4))


def _wide_print(h: np.ndarray) -> np.ndarray:
    """The 256 bits as four words; the first one is the fingerprint of the operator."""
    ones = np.zeros((len(_PRINT), BITS), dtype=np.int64)
    for at in range(0, len(h), 1 << 15):
        part = h[at : at + (1 << 15)]
        for k in range(len(_PRINT)):
            bits = _mixed(part, 10 + k) if k else part
            ones[k] += np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h), axis=1, bitorder="little").reshape(-1).view(np.uint64)


def _wide_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from xxhash import xxh3_128_digest

    names = ["doc_id", "s0", "s1", *_PRINT]
    for b in batches:
        out = np.zeros((b.num_rows, 2 + len(_PRINT)), dtype=np.int64)
        for i, t in enumerate(b.column("text")):
            h = _grams(t.as_py())
            out[i, :2] = np.frombuffer(xxh3_128_digest(_shingle_set(h).tobytes()), dtype=np.int64)
            out[i, 2:] = _wide_print(h).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(out[:, k]) for k in range(out.shape[1]))], names=names)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [_shingle_set(_grams(t.as_py())).view(np.int64) for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])


def _near(fp: np.ndarray, at: np.ndarray, shift: int) -> np.ndarray:
    """Which of the rows share enough positional bytes (the tally) with the row so many further on, and are near in bits."""
    x = fp[at] ^ fp[at + shift]
    shares = (x.view(np.uint8).reshape(-1, WIDE_BYTES) == 0).sum(axis=1) >= WIDE_SHARED
    shares[shares] = np.bitwise_count(x[shares]).sum(axis=1) <= WIDE_BITS
    return shares


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come ordered by key, i, j, in tables of whole groups: a group that is not over at the end of a batch waits for the next one."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
        same = np.all([(c := t.column(n).to_numpy()) == c[-1] for n in ("key", "i", "j")], axis=0)
        first = int(np.argmax(same))  # rows of the last group are at the end
        if first:
            yield t.slice(0, first).combine_chunks()
        held = t.slice(first).combine_chunks()
    if held is not None and held.num_rows:
        yield held


def _shifts(t: pa.Table) -> Iterator[tuple[int, np.ndarray]]:
    """(shift, rows): every row with a partner so many rows further on in its group; where a group is two chunks, partners are of the other one."""
    cols = [t.column(c).to_numpy() for c in ("key", "i", "j")]
    new = np.ones(t.num_rows, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, t.num_rows])
    rest = np.repeat(starts + sizes, sizes) - np.arange(t.num_rows) - 1  # rows that follow in the group
    side, both, rows = t.column("chunk").to_numpy(), cols[1] != cols[2], np.flatnonzero(rest > 0)
    for shift in range(1, int(sizes.max(initial=1))):
        rows = rows[rest[rows] >= shift]
        if not len(rows):
            return
        yield shift, rows[~both[rows] | (side[rows] != side[rows + shift])]


def _prints_of(t: pa.Table) -> np.ndarray:
    return np.stack([t.column(c).to_numpy() for c in _PRINT], axis=1).view(np.uint64)


def _candidate_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node with the smallest one that it is connected with in its posting by candidate pairs; rows come ordered by node within groups."""
    for t in _groups(batches):
        fp, node = _prints_of(t), t.column("node").to_numpy()
        found = [(at[near], shift) for shift, at in _shifts(t) if (near := _near(fp, at, shift)).any()]
        if not found:
            continue
        u = np.concatenate([at for at, _ in found])
        v = np.concatenate([at + shift for at, shift in found])
        least, before = np.arange(t.num_rows), None
        while before is None or (least != before).any():
            before = least.copy()
            low = np.minimum(least[u], least[v])
            np.minimum.at(least, u, low)
            np.minimum.at(least, v, low)
            least = least[least]
        moved = np.flatnonzero(node[least] != node)
        yield pa.RecordBatch.from_arrays([pa.array(node[least[moved]]), pa.array(node[moved])], names=["a", "b"])


def _similar_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that join up what is similar in each group: candidates are held against each other's whole shingle sets (in order as unsigned numbers) unless other links join them already."""
    for t in _groups(batches):
        fp, node = _prints_of(t), t.column("node").to_numpy()
        lists = t.column("shingles").combine_chunks()
        values, ends = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
        root, a, b = list(range(t.num_rows)), [], []

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for shift, at in _shifts(t):
            for i in at[_near(fp, at, shift)].tolist():
                k = i + shift
                if (x := top(i)) == (y := top(k)):
                    continue
                p, q = values[ends[i] : ends[i + 1]], values[ends[k] : ends[k + 1]]
                if 100 * min(len(p), len(q)) < SIMILAR * max(len(p), len(q)):
                    continue
                where = np.searchsorted(p, q)
                n = int((p[np.minimum(where, len(p) - 1)] == q).sum()) if len(p) else 0
                if 100 * n >= SIMILAR * (len(p) + len(q) - n):
                    root[max(x, y)] = min(x, y)
                    a.append(node[i]), b.append(node[k])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _in_blocks(rows: DataFrame, sizes: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """rows (key, node) of each key cut into as many chunks as sizes (key, chunks) says, one if nothing; every two chunks are a group (key, i, j), in one partition and in order."""
    parted = rows.join(sizes, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    partners = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.least("chunk", o).alias("i"), F.greatest("chunk", o).alias("j")))
    blocks = parted.select("key", F.explode(partners).alias("p"), "chunk", "node", *columns).select("key", "p.i", "p.j", "chunk", "node", *columns)
    return blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")


def similar_families(entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """node, root of the entries (node, f0 to f3) that have candidates: those connected by pairs that meet in a posting, share enough positional bytes and are near in bits."""
    byte = lambda p: F.shiftrightunsigned(_PRINT[p // 8], 8 * (p % 8)).bitwiseAND(F.lit(255))
    key = lambda k, s: sum((F.shiftleft(byte(p), 8 * i) for i, p in enumerate(s)), F.lit(k << 24).cast("long"))
    postings = entries.select("node", *_PRINT, F.explode(F.array(*(key(k, s) for k, s in enumerate(WIDE_SETS)))).alias("key"))
    # only postings above a block are cut; the table of these is read from files, so its size is known and decides how it is joined
    large = write_table(postings.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {block}").select("key", F.ceil(F.col("n") / block).cast("int").alias("chunks")), "large-postings")
    return connect(_in_blocks(postings, large, _PRINT).mapInArrow(_candidate_stars, "a long, b long").distinct())


def similar_groups(docs: DataFrame, block: int = BLOCK, most_shingles: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(members, roots): node of every row's text (doc_id, node), and the root of each node but the smallest of its group.

    A node is the smallest doc_id of the rows with one shingle set; doc_id must be unique and not null.
    Candidates make families; a family is cut into blocks of at most ``block`` texts and about
    ``most_shingles`` shingles, and every two blocks are compared on whole sets in a task of their own, which gives out only the
    links that join them up. So no pairs are written out, however many copies a family has.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = cut(docs.mapInArrow(_wide_prints, "doc_id long, s0 long, s1 long, f0 long, f1 long, f2 long, f3 long"))
    entries = cut(prints.groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), *(F.min(c).alias(c) for c in _PRINT)))
    members = prints.join(entries.select("s0", "s1", "node"), ["s0", "s1"]).select("doc_id", "node")
    families = similar_families(entries.select("node", *_PRINT), block)
    families = cut(families.select("node", F.col("root").alias("key")).union(families.select("root", "root").distinct()))
    texts = docs.withColumnRenamed("doc_id", "node").join(families.select("node"), "node", "left_semi")
    sets = write_table(texts.mapInArrow(_shingles, "node long, shingles array<long>"), "shingles")
    known = entries.select("node", *_PRINT).join(families, "node").join(sets, "node")
    held = sets.select("node", F.size("shingles").cast("long").alias("n")).join(families, "node").groupBy("key").agg(F.count("*").alias("rows"), F.sum("n").alias("n"))
    chunks = F.ceil(F.greatest(F.col("rows") / block, F.col("n") / most_shingles)).cast("int")
    large = write_table(held.select("key", chunks.alias("chunks")).where("chunks > 1"), "large-families")
    links = _in_blocks(known, large, (*_PRINT, "shingles")).mapInArrow(_similar_stars, "a long, b long").distinct()
    return members, connect(links)


def keep_one_similar(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The rows of docs of which each group of similar texts, linked directly or through others, keeps one: that of its smallest doc_id.

    Null, empty and blank texts have no shingles and are one group; a text with fewer than five words
    has one shingle, all its words; a text of any length is compared whole; rows without a doc_id
    stay. Rows that share a doc_id are one document: one of them stands for it, by the hash of its
    text, and equal rows stay once. No rows give no rows; further columns pass through, whatever
    their names.
    """
    rows = docs.where("doc_id is not null").select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    if rows.groupBy("doc_id").count().where("count > 1").limit(1).count():
        one = Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text"), "row.text")
        rows = cut(rows.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth"))
    members, roots = similar_groups(rows.select("doc_id", "row.text"), block)
    copies = members.where("doc_id != node").select("doc_id")
    joined = roots.select(F.col("node").alias("doc_id"))  # every node but the smallest of its group
    kept = rows.join(copies.union(joined).withColumnRenamed("doc_id", "gone"), F.col("doc_id") == F.col("gone"), "left_anti")
    return kept.select("row.*").unionByName(docs.where("doc_id is null"))
