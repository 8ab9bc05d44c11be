"""Byte-level BPE as a finite-state transducer, and streaming decoding (operator 12).

Encoding. A tokenization is the one that BPE gives if and only if each two neighbours in it stand
side by side, that is, if no merge would have crossed between them; ``Merges`` compiles the ranks
into a trie of the tokens' bytes and into that relation. So a piece of text is read by an automaton
whose hypotheses are (the token before, place in the trie): where the last token may have ended and
what of the next one has been read. A set of hypotheses is a ``State`` of the determinised
automaton; a state and its arcs are built when first met. Exactly one token ends at each byte of an
encoding's way there, and the state names it; a hypothesis dies when the trie does not go on, so
which tokens stay is known at most the length of the longest token, in bytes, later. Tokens that all
hypotheses agree on are emitted every 4,096 bytes and the others at the end of the piece. What a
short piece gave is remembered, so that a common word is run once.

Decoding. ``Utf8State`` is the incremental UTF-8 automaton, known by the bytes of a code point that
is not complete yet (three at most); its arcs by single bytes are composed to arcs by tokens when
first met. What can no longer become a code point gives U+FFFD, once for each longest part that
could have.

States of both are remembered up to a bound; beyond it all are dropped and built anew. A text of any
length is read piece by piece, its ids handled in blocks.

Defined results: a null text is empty and has no ids, whose digests are those of nothing; rows are
handled one by one, so repeated rows, ties and a null ``doc_id`` stay; strings that name special
tokens are ordinary text; no rows give no rows. Further columns are ignored by ``digests`` and pass
through ``encode`` and ``decode``, where one that is named like a result column gives way to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
BLOCK = 65_536  # ids handled at once
ROOT, NEVER = 0, 1 << 60
BETWEEN = re.compile(r"\S (?=\S)")


class Merges:
    """The ranks, compiled: a trie of the tokens' bytes, and which tokens may be neighbours."""

    MOST = 500_000

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.bytes_of = {t: b for b, t in ranks.items()}
        self.arcs: dict[int, int] = {}  # node * 256 + byte: node
        self.token_at = [-1]
        self.inner = [True]  # nodes that go on
        self.depth = [0]
        for b, t in ranks.items():
            node = ROOT
            for x in b:
                if (to := self.arcs.get(node << 8 | x)) is None:
                    to = self.arcs[node << 8 | x] = len(self.token_at)
                    self.token_at.append(-1)
                    self.inner.append(False)
                    self.depth.append(self.depth[node] + 1)
                    self.inner[node] = True
                node = to
            self.token_at[node] = t
        self._edges: dict[tuple[int, int], tuple[int, ...]] = {}
        self._stands: dict[int, bool] = {}

    def parts(self, token: int) -> tuple[int, ...]:
        """The two tokens whose merge makes this one: the merges of lower rank, done on its bytes. A byte is itself."""
        found = [self.bytes_of[token][i : i + 1] for i in range(len(self.bytes_of[token]))]
        while len(found) > 2:
            r, i = min((self.ranks.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(found, found[1:], strict=False)))
            if r >= token:
                raise ValueError(f"no merge makes token {token}")
            found[i : i + 2] = [found[i] + found[i + 1]]
        return tuple(self.ranks[x] for x in found)

    def edge(self, token: int, side: int) -> tuple[int, ...]:
        """The tokens at the left (0) or right (1) edge of a token while it grows, from its byte to itself."""
        if (got := self._edges.get((token, side))) is None:
            parts = self.parts(token)
            got = self._edges[token, side] = (*self.edge(parts[side], side), token) if len(parts) == 2 else (token,)
        return got

    def stands(self, a: int, b: int) -> bool:
        """Whether BPE leaves a and b as they are where they are neighbours. a = -1 is the start of a piece.

        Both grow by merges in the order of rank; the leftmost goes first among equal ranks. A merge
        of what stands at the two edges at some time would cross.
        """
        if a < 0:
            return True
        if (got := self._stands.get(a << 32 | b)) is None:
            if len(self._stands) > self.MOST:
                self._stands.clear()
            got = self._stands[a << 32 | b] = self._never_crossed(self.edge(a, 1), self.edge(b, 0))
        return got

    def _never_crossed(self, left: tuple[int, ...], right: tuple[int, ...]) -> bool:
        i = j = 0
        while True:
            across = self.ranks.get(self.bytes_of[left[i]] + self.bytes_of[right[j]], NEVER)
            grow_left = left[i + 1] if i + 1 < len(left) else NEVER
            grow_right = right[j + 1] if j + 1 < len(right) else NEVER
            if across < grow_left and across <= grow_right:
                return False
            if grow_left == grow_right == NEVER:
                return True
            if grow_left <= grow_right:
                i += 1
            else:
                j += 1


Hypothesis = tuple[int, int]  # the token before, and the node of the trie that has been read since it ended


class State(dict):
    """A state of the determinised transducer; state[byte] is the next one. ended: the token that ends here, if what has been read is encoded by itself."""

    __slots__ = ("machine", "hypotheses", "ended")

    def __init__(self, machine: Transducer, hypotheses: tuple[Hypothesis, ...]) -> None:
        self.machine, self.hypotheses, self.ended = machine, hypotheses, hypotheses[-1][0]

    def __missing__(self, byte: int) -> State:
        to = self[byte] = self.machine.after(self.hypotheses, byte)
        return to


class Transducer(dict):
    """Bytes of a piece in, ids out. transducer[piece] is what a short piece gave, remembered up to a bound."""

    MOST = 300_000
    SHORT, LOOK = 64, 4096  # bytes of a piece that is remembered; bytes between two settlements

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges
        self.lengths = {t: len(b) for t, b in merges.bytes_of.items()}
        self.forget()

    def forget(self) -> None:
        self.states: dict[tuple[Hypothesis, ...], State] = {}
        self.start = self._state(((-1, ROOT),))

    def _state(self, hypotheses: tuple[Hypothesis, ...]) -> State:
        if (got := self.states.get(hypotheses)) is None:
            got = self.states[hypotheses] = State(self, hypotheses)
        return got

    def after(self, hypotheses: tuple[Hypothesis, ...], byte: int) -> State:
        m, alive, ended = self.merges, [], -1
        for before, node in hypotheses:
            if (node := m.arcs.get(node << 8 | byte)) is None:
                continue
            if ended < 0 and (token := m.token_at[node]) >= 0 and m.stands(before, token):
                ended = token
            if m.inner[node]:
                alive.append((before, node))
        if ended < 0:
            raise ValueError("the ranks hold no token for a byte, or one that no merge makes")
        return self._state((*alive, (ended, ROOT)))

    def _read_back(self, ended: list[int], upto: int) -> list[int]:
        """The tokens of the first bytes, from the token that ends at each."""
        ids = []
        while upto:
            ids.append(token := ended[upto - 1])
            upto -= self.lengths[token]
        ids.reverse()
        return ids

    def _agreed(self, ended: list[int], hypotheses: tuple[Hypothesis, ...]) -> int:
        """The last place at which a token ends by all hypotheses."""
        at = {len(ended) - self.merges.depth[node] for _, node in hypotheses}
        while len(at) > 1:
            at.remove(last := max(at))
            at.add(last - self.lengths[ended[last - 1]])
        return at.pop()

    def run(self, piece: bytes) -> Iterator[list[int]]:
        """The ids of one piece of any length: those that all hypotheses agree on after every LOOK bytes, and the others at its end."""
        if len(self.states) > self.MOST:
            self.forget()
        s, ended = self.start, []
        for i in range(0, len(piece), self.LOOK):
            for byte in piece[i : i + self.LOOK]:
                s = s[byte]
                ended.append(s.ended)
            if i + self.LOOK < len(piece):
                yield self._read_back(ended, n := self._agreed(ended, s.hypotheses))
                del ended[:n]
        yield self._read_back(ended, len(ended))

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = [t for block in self.run(raw) for t in block]
        if len(raw) <= self.SHORT:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids

    def encode(self, pieces: Iterable[str]) -> Iterator[list[int]]:
        """The ids of the pieces, in blocks."""
        ids: list[int] = []
        for piece in pieces:
            if len(piece) <= self.LOOK:
                ids += self[piece]
            else:
                for block in self.run(piece.encode()):
                    ids += block
                    if len(ids) >= BLOCK:
                        yield ids
                        ids = []
            if len(ids) >= BLOCK:
                yield ids
                ids = []
        if ids:
            yield ids


# How many bytes follow a lead byte, and the least and greatest second byte.
FOLLOW = {**dict.fromkeys(range(0xC2, 0xE0), 1), **dict.fromkeys(range(0xE0, 0xF0), 2), **dict.fromkeys(range(0xF0, 0xF5), 3)}
SECOND = {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}


def utf8_step(pending: bytes, byte: int) -> tuple[str, bytes]:
    """One arc of the UTF-8 automaton: what is complete now, and what is pending."""
    if pending:
        least, most = SECOND.get(pending[0], (0x80, 0xBF)) if len(pending) == 1 else (0x80, 0xBF)
        if not least <= byte <= most:
            text, rest = utf8_step(b"", byte)
            return "�" + text, rest
        whole = pending + bytes((byte,))
        return (whole.decode(), b"") if len(whole) == FOLLOW[pending[0]] + 1 else ("", whole)
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes((byte,))) if byte in FOLLOW else ("�", b"")


class Utf8State(dict):
    """The UTF-8 automaton with some bytes pending; state[token] is (text that is complete now, next state)."""

    __slots__ = ("decoder", "pending")

    def __init__(self, decoder: Decoder, pending: bytes) -> None:
        self.decoder, self.pending = decoder, pending

    def __missing__(self, token: int) -> tuple[str, Utf8State]:
        texts, pending = [], self.pending
        for byte in self.decoder.bytes_of[token]:
            text, pending = utf8_step(pending, byte)
            texts.append(text)
        self.decoder.arcs += 1
        to = self[token] = "".join(texts), self.decoder.state(pending)
        return to


class Decoder:
    """Ids in, text out, as soon as its code points are complete."""

    MOST = 400_000

    def __init__(self, bytes_of: dict[int, bytes]) -> None:
        self.bytes_of = bytes_of
        self.forget()

    def forget(self) -> None:
        self.states: dict[bytes, Utf8State] = {}
        self.arcs = 0

    def state(self, pending: bytes) -> Utf8State:
        if (got := self.states.get(pending)) is None:
            got = self.states[pending] = Utf8State(self, pending)
        return got

    def decode(self, blocks: Iterable[Iterable[int]]) -> Iterator[str]:
        """The text of the ids, one string a block; a code point that the end cuts off is U+FFFD."""
        s = self.state(b"")
        for block in blocks:
            texts = []
            for token in block:
                text, s = s[token]
                texts.append(text)
            yield "".join(texts)
            if self.arcs > self.MOST:
                pending = s.pending
                self.forget()
                s = self.state(pending)
        if s.pending:
            yield "�"


_LOADED: dict[str, tuple[Transducer, Decoder, object]] = {}


def loaded(vocabulary: str) -> tuple[Transducer, Decoder, object]:
    """Encoder, decoder and the pattern of pieces, of this Python worker."""
    if vocabulary not in _LOADED:
        import base64
        from pathlib import Path

        import public_tokenizers
        import regex

        merges = Merges({base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(public_tokenizers.path(vocabulary)).read_bytes().splitlines())})
        _LOADED[vocabulary] = Transducer(merges), Decoder(merges.bytes_of), regex.compile(public_tokenizers.PATTERN)
    return _LOADED[vocabulary]


def stretches(text: str, size: int = 1 << 20) -> Iterator[str]:
    """The text in stretches; each but the last ends where a space comes between two others: a piece begins there, too."""
    at = 0
    while len(text) - at > size:
        to = next((m.start() + 1 for m in BETWEEN.finditer(text, at + size)), len(text))
        yield text[at:to]
        at = to
    yield text[at:]


def encode_text(text: str | None, vocabulary: str = VOCABULARY) -> Iterator[list[int]]:
    """The ids of a text, in blocks."""
    encoder, _, pattern = loaded(vocabulary)
    return encoder.encode(p for part in stretches(text or "") for p in pattern.findall(part))


def decode_ids(blocks: Iterable[Iterable[int]], vocabulary: str = VOCABULARY) -> Iterator[str]:
    return loaded(vocabulary)[1].decode(blocks)


def _encoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [[i for block in encode_text(x.as_py(), vocabulary) for i in block] for x in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(lists, pa.list_(pa.int32()))], names=["row", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [None if ids is None else "".join(decode_ids([ids], vocabulary)) for ids in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], names=["row", "decoded"])


def _beside(df: DataFrame, asked: str, made: str, kind: T.DataType, run) -> DataFrame:
    kept = df.drop(made)
    row = F.struct(*(F.col(f"`{c}`") for c in kept.columns))
    rows = df.select(row.alias("row"), F.col(asked)).mapInArrow(run, T.StructType([T.StructField("row", kept.schema), T.StructField(made, kind)]))
    return rows.select(*(F.col(f"row.`{c}`").alias(c) for c in kept.columns), made)


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows of docs with ``ids``, the tokens of ``text``."""
    return _beside(docs, "text", "ids", T.ArrayType(T.IntegerType()), partial(_encoded, vocabulary=vocabulary))


def decode(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The rows with ``decoded``, the text of ``ids``; null for null."""
    return _beside(rows, "ids", "decoded", T.StringType(), partial(_decoded, vocabulary=vocabulary))


def _digests(batches: Iterator[pa.RecordBatch], vocabulary: str) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts, given, back = [], [], []
        for text in b.column("text"):
            n, ids_hash, text_hash = 0, hashlib.sha256(), hashlib.sha256()

            def seen(blocks: Iterator[list[int]]) -> Iterator[list[int]]:
                nonlocal n
                for block in blocks:
                    n += len(block)
                    ids_hash.update(np.asarray(block, dtype="<u4").tobytes())
                    yield block

            for part in decode_ids(seen(encode_text(text.as_py(), vocabulary)), vocabulary):
                text_hash.update(part.encode())
            counts.append(n)
            given.append(ids_hash.hexdigest())
            back.append(text_hash.hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(given), pa.array(back)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text that they decode to; neither is ever held whole."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(partial(_digests, vocabulary=vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
