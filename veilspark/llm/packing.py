"""Packing by shortest-pack-first over the length histogram (operator 5).

Every document becomes its token ids and an end id. It is cut into full pieces of ``max_len``
ids and one rest. The histogram of piece lengths, at most ``max_len`` numbers, is packed longest
length first: all pieces of a length go onto the open packing pattern that is shortest so far and
still has room, and the counts of patterns are updated, whole counts at a time. Patterns name
lengths only; pieces join them by their rank among the pieces of their length. Ranks come from
counts by (length, salt): a length has 8 salts and one more for every ``salt_rows`` pieces, so no length, however
common, is numbered in one task, and how many stand before a salt is joined to its pieces.

What the driver holds is the histogram, ``max_len`` numbers, and the slots of the patterns; neither
grows with the number of documents.

Defined results: a null or empty text is the end id alone; repeated rows are packed each for
itself; a text of any length is encoded whole; a null ``doc_id`` is kept; no rows give no rows. Further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

MAX_LEN, END_ID = 1024, 0
VOCABULARY = "byte_bpe_50k.json"
SALT_ROWS = 250_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class _Ids(dict):
    """Little-endian 32-bit ids of a chunk of text, remembered up to a bound.

    Byte-level BPE never merges across a space that a non-space follows, so a text may be cut
    before every such space and the chunks encoded on their own.
    """

    MOST = 400_000

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = np.asarray(self.encode(chunk), dtype="<u4").tobytes()
        if len(self) < self.MOST and len(chunk) < 64:
            self[chunk] = ids
        return ids


_LOADED: dict[str, _Ids] = {}


def _ids(vocabulary: str) -> _Ids:
    """The chunk encoder of this Python worker.

    The same ranks in tiktoken encode a short chunk several times as fast; the tests hold the ids
    against those of tokenizers. Chunks with a special token's string go to tokenizers itself.
    """
    if vocabulary not in _LOADED:
        import base64
        from pathlib import Path

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        special = [x.content for x in t.get_added_tokens_decoder().values()]
        if not (ranks_file := Path(public_tokenizers.path(vocabulary)).with_suffix(".tiktoken")).exists():
            _LOADED[vocabulary] = _Ids(lambda chunk: t.encode(chunk, add_special_tokens=False).ids)
            return _LOADED[vocabulary]
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.read_bytes().splitlines())}
        fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _LOADED[vocabulary] = _Ids(lambda chunk: t.encode(chunk, add_special_tokens=False).ids if any(x in chunk for x in special) else fast.encode_ordinary(chunk))
    return _LOADED[vocabulary]


def _chunks(text: str) -> list[str]:
    """The text cut before every space that a non-space follows."""
    parts = text.split(" ")
    out = [parts[0]]
    for p in parts[1:]:
        if p and not p[0].isspace():
            out.append(" " + p)
        else:
            out[-1] += " " + p
    return out


def token_bytes(text: str | None, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> bytes:
    """The ids of a text and the end id, four little-endian bytes each."""
    known = _ids(vocabulary)
    return b"".join([known[c] for c in _chunks(text)] if text else []) + int(end_id).to_bytes(4, "little")


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, max_len: int, end_id: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for b in batches:
        rows: list[list] = [[], [], [], [], []]
        for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            ids = token_bytes(text.as_py(), vocabulary, end_id)
            n = len(ids) // 4
            for start in range(0, n, max_len):
                piece = ids[4 * start : 4 * (start + max_len)]
                for into, x in zip(rows, (doc, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                    into.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], names=names)


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, max_len: int = MAX_LEN, end_id: int = END_ID) -> DataFrame:
    """One row per piece of a document: start, length and checksum of its ids."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(partial(_pieces, vocabulary=vocabulary, max_len=max_len, end_id=end_id), PIECES)


def pack_histogram(counts: dict[int, int], max_len: int = MAX_LEN) -> list[tuple[int, list[int]]]:
    """Patterns (how often, lengths) that place every piece: longest length first, each onto the shortest pattern with room."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by tokens held
    done: list[tuple[int, list[int]]] = []
    held = [0] * (max_len + 1)  # open patterns by tokens held, for the search of the shortest
    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left = counts[length]
        fresh: list[tuple[int, int, list[int]]] = []
        used = 0
        while left:
            while used <= max_len and not held[used]:
                used += 1
            if used + length > max_len:
                fresh.append((length, left, [length]))
                break
            n, lengths = open_[used].pop()
            held[used] -= 1
            take = min(n, left)
            if n > take:
                open_[used].append((n - take, lengths))
                held[used] += 1
            left -= take
            total = used + length
            if total == max_len:
                done.append((take, [*lengths, length]))
            else:
                open_.setdefault(total, []).append((take, [*lengths, length]))
                held[total] += 1
                used = min(used, total)
        for total, n, lengths in fresh:
            if total == max_len:
                done.append((n, lengths))
            else:
                open_.setdefault(total, []).append((n, lengths))
                held[total] += 1
    return done + [x for total in sorted(open_) for x in open_[total]]


def slots(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first sequence, offset), by first rank. A slot holds as many ranks as its pattern has sequences."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    given: dict[int, int] = {}
    sequence = 0
    for n, lengths in patterns:
        offset = 0
        for x in lengths:
            found.setdefault(x, []).append((given.get(x, 0), sequence, offset))
            given[x] = given.get(x, 0) + n
            offset += x
        sequence += n
    return {k: np.array(v, dtype=np.int64) for k, v in found.items()}


def _place(batches: Iterator[pa.RecordBatch], table) -> Iterator[pa.RecordBatch]:
    by_length = table.value
    keep = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    for b in batches:
        length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for x in np.unique(length):
            at = np.flatnonzero(length == x)
            s = by_length[int(x)]
            k = np.searchsorted(s[:, 0], rank[at], side="right") - 1
            sequence[at], offset[at] = s[k, 1] + rank[at] - s[k, 0], s[k, 2]
        yield pa.RecordBatch.from_arrays([*map(b.column, keep), pa.array(sequence), pa.array(offset)], names=[*keep, "sequence_id", "offset"])


def pack(docs: DataFrame, vocabulary: str = VOCABULARY, max_len: int = MAX_LEN, end_id: int = END_ID, salt_rows: int = SALT_ROWS) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut_up = cut(pieces(docs, vocabulary, max_len, end_id))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    table = docs.sparkSession.sparkContext.broadcast(slots(pack_histogram(counts, max_len)))
    salts = F.split(F.lit(",".join(str(8 + counts.get(x, 0) // salt_rows) for x in range(max_len + 1))), ",").cast("array<int>")
    salt = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.get(salts, F.col("length").cast("int"))).cast("int")
    salted = cut_up.withColumn("salt", salt)
    ahead = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    first = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(ahead, F.lit(0)).alias("first"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32"))
    ranked = salted.withColumn("nth", nth).join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1)
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(partial(_place, table=table), f"{PIECES}, sequence_id long, offset long")
