"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece there is exactly one token that can end its encoding: the encoding of
a prefix is the encoding of a shorter prefix plus that last token, and the last token is the one
whose boundary to the token before it survives merging. The table of last tokens is all that is
stored: a byte appended costs one more entry and changes none, so appends are exact, and after
an edit only the entries from the edit on are made again.

A boundary between two tokens survives if no byte pair merge would cross it. A token grows from
bytes by merges of rising rank, so at its right (left) edge stand, one after another, the tokens
of its right (left) spine. A merge across the boundary happens if two spine tokens stand there
at the same time and form a token of lower rank than the merges that would replace them.

Scale: one pass over the rows, no shuffle; the vocabulary (under 1 MB) is broadcast as bytes, a
piece cache of bounded size is kept in each Python worker. A text is never split among tasks.

Defined cases: a null text counts as empty and has no tokens; any string is encoded, whatever its
length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches

#: White space as Unicode's White_Space property has it.
_WS = r"\t-\r \x85\xa0  -     　"
#: Letters of Latin scripts, all of the Unicode categories L.
_LATIN = r"A-Za-zÀ-ÖØ-öø-ɏ"
#: Stretches that end where a match of a pattern of the usual kind ends: a run of Latin letters that an
#: ASCII character or the end follows, with the space before it; or else all up to white space; or white space.
_CHUNK = re.compile(rf" ?[{_LATIN}]++(?![^\x00-\x7f])| ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
#: The pattern for which these stretches hold; any other is applied to the whole text.
_USUAL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of the cache of a Python worker; it starts anew when full.
CACHE = 700_000
#: Pairs of neighbours whose fit a Python worker remembers.
PAIRS = 1_000_000
_NONE = 1 << 62


class Vocabulary:
    """Tokens by rank, and their merge trees' spines."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._split: dict[int, tuple[int, int] | None] = {}
        self._spines: tuple[dict, dict] = ({}, {})
        self.known: dict[int, bool] = {}
        self._automaton = ahocorasick.Automaton()
        for data, token in ranks.items():
            if self.reachable(token):
                self._automaton.add_word(data.decode("latin-1"), (len(data), token))
        self._automaton.make_automaton()

    @classmethod
    def from_bytes(cls, data: bytes) -> Vocabulary:
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a})

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a byte. A token that merging can't make splits into (-1, -1)."""
        if token not in self._split:
            data = self.tokens[token]
            self._split[token] = self._last_merge(data, token) if len(data) > 1 else None
        return self._split[token]

    def _last_merge(self, data: bytes, rank: int) -> tuple[int, int]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 2:
            best, at = _NONE, -1
            for i in range(len(parts) - 1):
                r = self.ranks.get(parts[i] + parts[i + 1], _NONE)
                if r < best and r != rank:
                    best, at = r, i
            if at < 0 or best > rank:
                return (-1, -1)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]])

    def reachable(self, token: int) -> bool:
        return self.split(token) != (-1, -1)

    def _spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """(bytes, rank of the merge that replaces it) along one side, from the whole token down to a byte."""
        known = self._spines[side].get(token)
        if known is None:
            known, until, at = [], _NONE, token
            while True:
                known.append((self.tokens[at], until))
                parts = self.split(at)
                if parts is None:
                    break
                until, at = at, parts[side]
            self._spines[side][token] = known
        return known

    def fits(self, pair: int) -> bool:
        """Whether the boundary between two neighbours, left << 32 | right, survives merging."""
        get, rights = self.ranks.get, self._spine(pair & 0xFFFFFFFF, 0)
        if len(self.known) >= PAIRS:
            self.known.clear()
        for a, a_until in self._spine(pair >> 32, 1):
            for b, b_until in rights:
                merged = get(a + b, _NONE)
                # equal ranks merge from the left: the left token's own merge comes first, the right one's later
                if merged < a_until and merged <= b_until and merged != _NONE:
                    self.known[pair] = False
                    return False
        self.known[pair] = True
        return True

    def ending(self, data: bytes):
        """(end - 1, (length, token)) of all tokens inside data, by end, longest first."""
        return self._automaton.iter(data.decode("latin-1"))


class Prefixes:
    """The table of one piece: last[i] is the last token of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self._length = vocabulary, b"", [], []
        self.append(data)

    def append(self, more: bytes) -> None:
        last, lengths, fits, n = self.last, self._length, self.vocabulary.fits, len(self.last)
        known = self.vocabulary.known
        self.data += more
        # a token that ends in the new bytes starts at most its own length before them
        skip = max(0, n - self.vocabulary.longest)
        for at, (length, token) in self.vocabulary.ending(self.data[skip:]):
            if at + skip == n:
                if n >= length:
                    pair = last[n - length] << 32 | token
                    if (fit := known.get(pair)) is None:
                        fit = fits(pair)
                    if not fit:
                        continue
                last.append(token)
                lengths.append(length)
                n += 1
        if n != len(self.data):
            raise ValueError("the vocabulary lacks a byte")

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace data[start:stop]; the entries before it stay."""
        tail = self.data[stop:]
        del self.last[start:], self._length[start:]
        self.data = self.data[:start]
        self.append(new + tail)

    def tokens(self) -> list[int]:
        out, at = [], len(self.last)
        while at:
            out.append(self.last[at - 1])
            at -= self._length[at - 1]
        return out[::-1]


class _Cache(dict):
    """Packed ids by stretch of text, made where they are missing."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, stretch: str) -> bytes:
        packed = self.make(stretch)
        if len(stretch) < 64:
            if len(self) >= CACHE:
                self.clear()
            self[stretch] = packed
        return packed


class Codec:
    """Texts to token ids and back, each match of the pattern separately."""

    def __init__(self, vocabulary: bytes, pattern: str):
        import regex

        self.vocabulary = Vocabulary.from_bytes(vocabulary)
        self.pattern = regex.compile(pattern)
        self._cache = _Cache(self._chunk)

    def piece(self, data: bytes) -> list[int]:
        whole = self.vocabulary.ranks.get(data)
        return [whole] if whole is not None else Prefixes(self.vocabulary, data).tokens()

    def _chunk(self, chunk: str) -> bytes:
        ids = [i for m in self.pattern.finditer(chunk) for i in self.piece(m.group().encode())]
        return np.array(ids, "<u4").tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        chunks = _CHUNK.findall(text) if self.pattern.pattern == _USUAL else [text]
        return b"".join(map(self._cache.__getitem__, chunks))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_packed(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def _codec(vocabulary: bytes, pattern: str) -> Codec:
    """One codec for each vocabulary in a Python worker."""
    key = (hashlib.sha256(vocabulary).hexdigest(), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary, pattern)
    return _codecs[key]


def encode(docs: DataFrame, vocabulary_path: str, pattern: str, keep_ids: bool = True) -> DataFrame:
    """Return (doc_id, n_tokens, ids_sha256, decoded_sha256), and with ``keep_ids`` the ids as array<int>."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with open(vocabulary_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    kind = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, pattern)
        for batch in batches:
            n, ids, a, b = [], [], [], []
            for text in batch.column(1):
                packed = codec.encode_packed(text.as_py() or "")
                n.append(len(packed) // 4)
                a.append(hashlib.sha256(packed).hexdigest())
                b.append(hashlib.sha256(codec.decode_packed(packed)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<i4"))
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns, names = [*columns, pa.array(ids, kind)], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, vocabulary_path: str) -> DataFrame:
    """Return (doc_id, text) of rows (doc_id, ids); bytes that aren't UTF-8 become U+FFFD."""
    spark = tokens.sparkSession
    with open(vocabulary_path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value, "")
        for batch in batches:
            texts = [codec.decode(ids.as_py() or []).decode("utf-8", "replace") for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    id_type = tokens.schema["doc_id"].dataType.simpleString()
    return tokens.select("doc_id", "ids").mapInArrow(run, f"doc_id {id_type}, text string")
