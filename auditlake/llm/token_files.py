"""Token ids of a corpus in compressed shards, read back whole or by position.

Encoding: white space always parts tokens in a vocabulary that drops it, so the tokenizers library
encodes each distinct piece between white space once, and a text's ids are gathered from its
pieces'. Each document ends with the end id.

Compression is Re-Pair, one grammar for each shard: the frequent pairs of neighbouring ids become
nonterminals, again and again, until no pair is frequent. A round counts all pairs and replaces,
from the most frequent on, those with at least 1/``SPREAD`` of the highest count that can't overlap
one taken before (no id is the right member of one and the left member of another). A shard holds
its symbols, its rules (two symbols for each nonterminal), the number of ids that each nonterminal
stands for, and its documents' ids and lengths. With those numbers any range of ids is decoded
from the symbols that cover it, without the rest.

Layout: a table of shards in Parquet, one row each, in ascending order of doc_id by task of the
writer (``part``) and place in it (``seq``); numbers are little-endian, of 16 bits where all
symbols fit and of 32 bits otherwise. Documents reach the writers by one range exchange; a shard
closes before the document that would carry it over ``SHARD_IDS``, so memory is bounded by that
and by the longest document. Where a shard begins in the whole corpus follows from one row for
each writing task.

Defined cases: a null text counts as empty and is the end id alone; null ids come first; rows of
equal doc_id are ordered by a hash of their text, then by the text; repeated rows each count; an
empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import bounded_batches, materialize, no_nulls

#: Ids of a shard, unless one document has more.
SHARD_IDS = 1 << 20
#: Occurrences from which a pair is worth a rule.
FREQUENT = 8
#: A round takes pairs with at least one in so many of the occurrences of its most frequent one.
SPREAD = 64
#: Characters that are cut into pieces at a time.
PIECE_CHARS = 1 << 22
#: Distinct pieces and their characters that a task remembers.
KNOWN_PIECES, KNOWN_CHARS = 800_000, 1 << 25
#: Words inside pieces that it remembers beside them.
KNOWN_WORDS = 400_000
#: New pieces of one call of the tokenizer.
TOGETHER = 2000
#: Symbols that fit 16 bits.
_SMALL = 1 << 16
_SPACE = re.compile(r"[ \t\n\v\f\r]")


#: Encoders by the path of their file, kept by a worker for its next tasks.
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class _Table(dict):
    """Text -> number, given when the text first comes up, and the ids of each number."""

    def __init__(self, make):
        """make: texts -> (their ids one after another, how many each has)."""
        super().__init__()
        self.make, self.new, self.chars = make, [], 0
        self.flat, self.offset, self.length = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def __missing__(self, text: str) -> int:
        self[text] = n = len(self)
        self.new.append(text)
        return n

    def numbers(self, texts: list[str]) -> np.ndarray:
        found = np.fromiter(map(self.__getitem__, texts), np.int64, len(texts))
        new, self.new = self.new, []
        if new:
            flat, length = self.make(new)
            self.offset = np.r_[self.offset, len(self.flat) + np.cumsum(length) - length]
            self.length, self.flat = np.r_[self.length, length], np.r_[self.flat, flat]
            self.chars += sum(map(len, new))
        return found

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the ids of all numbers, how many each has)."""
        length = self.length[numbers]
        return _gathered(self.flat, self.offset[numbers], length), length


class Encoder:
    """Ids of texts by a tokenizers file whose vocabulary drops white space."""

    def __init__(self, path: str):
        # a task has one core; the library's threads would spin on all of them
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.pattern = Tokenizer.from_file(path), _ascii_words(path)
        self.pieces, self.words = _Table(self._pieces), _Table(self._words)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Each text's ids; stretches of bounded length, cut at white space, are looked up together."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        for stretch in _stretches(texts):
            if len(self.pieces) > KNOWN_PIECES or self.pieces.chars > KNOWN_CHARS:
                self.pieces = _Table(self._pieces)
            if len(self.words) > KNOWN_WORDS:
                self.words = _Table(self._words)
            pieces = pc.ascii_split_whitespace(pa.array([text for _, text in stretch], pa.string()))
            several = pieces.flatten().dictionary_encode()
            number = self.pieces.numbers(several.dictionary.to_numpy(zero_copy_only=False).tolist())
            ids, length = self.pieces.ids(number[several.indices.to_numpy()])
            ends = np.r_[0, np.cumsum(length)][np.cumsum(pieces.value_lengths().to_numpy())]
            for (k, _), start, end in zip(stretch, np.r_[0, ends[:-1]].tolist(), ends.tolist()):
                parts[k].append(ids[start:end])
        return [np.concatenate(p) if len(p) != 1 else p[0] for p in parts]

    def _pieces(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Printable ASCII by its words, of which the model gets each once; other pieces by the whole tokenizer."""
        plain = np.fromiter((self.pattern is not None and x.isascii() and x.isprintable() and "<|" not in x for x in new), bool,
            len(new))
        found = [self._by_words([x for x, ok in zip(new, plain.tolist()) if ok]),
            self._by_library([x for x, ok in zip(new, plain.tolist()) if not ok])]
        length = np.empty(len(new), np.int64)
        length[plain], length[~plain] = found[0][1], found[1][1]
        offset = np.empty(len(new), np.int64)
        offset[plain] = np.cumsum(found[0][1]) - found[0][1]
        offset[~plain] = len(found[0][0]) + np.cumsum(found[1][1]) - found[1][1]
        return _gathered(np.r_[found[0][0], found[1][0]], offset, length), length

    def _by_words(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not pieces:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        # a line for each piece; its end is a word without ids
        number = self.words.numbers(["\n", *self.pattern.findall("\n".join(pieces).lower()), "\n"])
        ids, length = self.words.ids(number)
        ends = np.cumsum(length)[np.flatnonzero(number == number[0])]
        return ids, np.diff(ends)

    def _words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        tokens = [[] if word == "\n" else [t.id for t in self.tokenizer.model.tokenize(word)] for word in new]
        length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        return np.fromiter(chain.from_iterable(tokens), np.int32, int(length.sum())), length

    def _by_library(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces to a call, told apart by where their tokens lie."""
        ids, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(pieces), TOGETHER):
            own = pieces[at : at + TOGETHER]
            ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1)
            found = self.tokenizer.encode(" ".join(own), add_special_tokens=False)
            starts = np.fromiter((a for a, _ in found.offsets), np.int64, len(found))
            ids.append(np.array(found.ids, np.int32))
            lengths.append(np.bincount(np.searchsorted(ends, starts, side="right"), minlength=len(own)))
        return np.concatenate(ids), np.concatenate(lengths)


def _ascii_words(path: str):
    """The pattern that cuts lower-cased printable ASCII into the words that the model gets, None where the file says more than that.

    On such text composing does nothing, and bytes stand for themselves.
    """
    with open(path) as file:
        said = json.load(file)
    kinds = [x.get("type") for x in (said.get("normalizer") or {}).get("normalizers", [])]
    steps = (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
    split = dict(steps[0], pattern="") if steps else {}
    plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    if kinds != ["NFC", "Replace", "Lowercase"] or split != {"type": "Split", "pattern": "", "behavior": "Removed",
            "invert": True} or steps[1:] != [plain] or said.get("post_processor") or not all(
            x["content"].startswith("<|") for x in said.get("added_tokens", [])):
        return None
    # letters and digits by their ASCII ranges, which the standard module knows
    pattern = steps[0]["pattern"].get("Regex", "")
    return re.compile(pattern.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9") + r"|\n") if pattern else None


def _stretches(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(number of the text, a part of it that ends at white space or with it), together by ``PIECE_CHARS``."""
    held, chars = [], 0
    for k, text in enumerate(texts):
        at = 0
        while True:
            m = _SPACE.search(text, at + PIECE_CHARS) if len(text) - at > PIECE_CHARS else None
            end = m.start() if m else len(text)
            held.append((k, text[at:end]))
            chars += end - at
            at = end
            if chars >= PIECE_CHARS:
                yield held
                held, chars = [], 0
            if at >= len(text):
                break
    if held:
        yield held


def _gathered(flat: np.ndarray, offset: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The stretches of flat, one after another."""
    before = np.cumsum(length) - length
    return flat[np.repeat(offset - before, length) + np.arange(int(length.sum()))]


def compressed(ids: np.ndarray, first: int, most: int = _SMALL) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, rules): nonterminal ``first + k`` stands for the two symbols rules[k]; no more rules than symbols under ``most`` allow."""
    seq, rules, n = ids.astype(np.uint32), [], 0
    while len(seq) > 1 and first + n < most:
        key = seq[:-1].astype(np.uint64) << 32 | seq[1:] if most > _SMALL else seq[:-1] << 16 | seq[1:]
        pairs, count = _counted(key)
        # a run of one id holds half as many pairs as it seems
        half = pairs >> (32 if most > _SMALL else 16) == pairs & (0xFFFFFFFF if most > _SMALL else 0xFFFF)
        count = np.where(half, count // 2, count)
        if not len(count) or count.max() < FREQUENT:
            break
        chosen = np.flatnonzero(count >= max(FREQUENT, int(count.max()) // SPREAD))
        chosen = chosen[np.lexsort((pairs[chosen], -count[chosen]))]
        left = (pairs[chosen] >> (32 if most > _SMALL else 16)).astype(np.int64)
        right = (pairs[chosen] & (0xFFFFFFFF if most > _SMALL else 0xFFFF)).astype(np.int64)
        role = bytearray(first + n)  # 1: left member, 2: right member, 3: both, of a pair of itself
        taken = _taken(left, right, role, most - first - n)
        made = np.c_[left[taken], right[taken]].astype(np.uint32)
        by_key = np.sort(pairs[chosen[taken]])
        number = np.empty(len(taken), np.uint32)
        number[np.searchsorted(by_key, pairs[chosen[taken]])] = first + n + np.arange(len(taken), dtype=np.uint32)
        of = np.take(np.frombuffer(role, np.uint8), seq)
        at = np.flatnonzero((of[:-1] & 1 == 1) & (of[1:] & 2 == 2))
        place = np.searchsorted(by_key, key[at])
        hit = by_key[np.minimum(place, len(by_key) - 1)] == key[at]
        at, place = at[hit], place[hit]
        at, place = _apart(at, place, seq)
        seq[at] = number[place]
        keep = np.ones(len(seq), bool)
        keep[at + 1] = False
        seq = seq[keep]
        rules.append(made)
        n += len(made)
    return seq, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def _counted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(key)
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    return ordered[starts], np.diff(np.r_[starts, len(ordered)])


def _taken(left: np.ndarray, right: np.ndarray, role: bytearray, most: int) -> np.ndarray:
    """Places of the pairs that can be replaced together, from the first on; role gets each id's part in them."""
    found = []
    for k, (a, b) in enumerate(zip(left.tolist(), right.tolist())):
        if len(found) >= most:
            break
        if a == b:
            if role[a]:
                continue
            role[a] = 3
        elif role[a] & 2 or role[b] & 1:
            continue
        else:
            role[a], role[b] = 1, 2
        found.append(k)
    return np.array(found, np.int64)


def _apart(at: np.ndarray, place: np.ndarray, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of places next to each other, which only runs of one id have, every second one from the first."""
    if len(at) < 2:
        return at, place
    starts = np.flatnonzero(np.r_[True, np.diff(at) != 1])
    offset = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return at[offset % 2 == 0], place[offset % 2 == 0]


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """The number of ids that each nonterminal stands for."""
    length = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        length[first + k] = length[a] + length[b]
    return length[first:]


class Shard:
    """A shard's ids, by position."""

    def __init__(self, first: int, symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray):
        self.first, self.symbols, self.rules, self.lengths = first, symbols.astype(np.int64), rules.astype(np.int64), lengths

    def _length(self, symbols: np.ndarray) -> np.ndarray:
        if not len(self.rules):
            return np.ones(len(symbols), np.int64)
        return np.where(symbols < self.first, 1, self.lengths[np.maximum(symbols - self.first, 0)])

    def _expanded(self, symbols: np.ndarray) -> np.ndarray:
        """All ids of the symbols: each round, nonterminals become their two symbols."""
        while len(self.rules) and (deep := symbols >= self.first).any():
            wide = np.where(deep, 2, 1)
            end = np.cumsum(wide)
            out = np.empty(int(end[-1]), np.int64)
            out[end - wide] = symbols
            pairs = self.rules[symbols[deep] - self.first]
            out[end[deep] - 2], out[end[deep] - 1] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols

    def all(self) -> np.ndarray:
        """Every id: the rules' expansions first, then the symbols', gathered from them."""
        if not len(self.rules):
            return self.symbols
        flat = self._expanded(np.arange(self.first, self.first + len(self.rules)))
        before = np.cumsum(self.lengths) - self.lengths
        # ids stand for themselves, nonterminals for a stretch after them
        offset = np.concatenate([np.arange(self.first), self.first + before])
        length = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        return _gathered(np.concatenate([np.arange(self.first), flat]), offset[self.symbols], length[self.symbols])

    def span(self, start: int, stop: int) -> np.ndarray:
        """The ids at start <= position < stop, from the symbols that cover them; nonterminals cut by an end are followed down by their lengths."""
        ends = np.cumsum(self._length(self.symbols))
        total = int(ends[-1]) if len(ends) else 0
        start, stop = max(0, start), min(stop, total)
        if start >= stop:
            return np.empty(0, np.int64)
        low, high = np.searchsorted(ends, [start, stop - 1], side="right")
        cover = self.symbols[low : high + 1]
        skip = start - (int(ends[low - 1]) if low else 0)
        left = stop - start
        # narrow both ends to what they need before anything is expanded
        while len(self.rules) and cover[0] >= self.first and skip:
            a, b = self.rules[cover[0] - self.first]
            n = int(self._length(np.array([a]))[0])
            if skip >= n:
                skip, cover = skip - n, np.r_[b, cover[1:]]
            else:
                cover = np.r_[a, b, cover[1:]]
        while len(self.rules) and cover[-1] >= self.first:
            extra = int(self._length(cover).sum()) - skip - left
            if extra <= 0:
                break
            a, b = self.rules[cover[-1] - self.first]
            n = int(self._length(np.array([b]))[0])
            cover = np.r_[cover[:-1], a] if extra >= n else np.r_[cover[:-1], a, b]
        return self._expanded(cover)[skip : skip + left]


_SHARDS = "part int, seq int, before long, n_ids long, first_symbol long, doc_ids array<{}>, doc_lengths array<long>, symbols binary, rules binary, lengths binary"


def _bytes(numbers: np.ndarray, top: int) -> bytes:
    return numbers.astype("<u2" if top <= _SMALL else "<u4").tobytes()


def _shard(row: dict) -> Shard:
    """row: a shard's columns; lengths have 32 bits, symbols and rules 16 where all symbols fit."""
    lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
    kind = "<u2" if row["first_symbol"] + len(lengths) <= _SMALL else "<u4"
    return Shard(row["first_symbol"], np.frombuffer(row["symbols"], kind), np.frombuffer(row["rules"], kind).reshape(-1, 2),
        lengths)


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards of docs (doc_id, text), written to the shared folder and read again."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = _SHARDS.format(kind)
    rows = docs.select("doc_id", no_nulls().alias("text")).withColumn("__hash", F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "__hash").sortWithinPartitions("doc_id", "__hash", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(tokenizer)
        first = max(words.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        names, waiting, held = [], [], 0

        def closed() -> pa.RecordBatch:
            nonlocal seq, before, names, waiting, held
            ids = np.concatenate(waiting)
            symbols, rules = compressed(ids, first, _SMALL if first <= _SMALL else 1 << 32)
            top = first + len(rules)
            lengths = expansion_lengths(rules, first).astype("<u4").tobytes()
            row = {"part": part, "seq": seq, "before": before, "n_ids": len(ids), "first_symbol": first, "doc_ids": names,
                "doc_lengths": [len(x) for x in waiting], "symbols": _bytes(symbols, top),
                "rules": _bytes(rules.ravel(), top), "lengths": lengths}
            seq, before, names, waiting, held = seq + 1, before + len(ids), [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        arrow = None
        for batch in batches:
            arrow = arrow or _arrow(batch.schema.field("doc_id").type)
            for name, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text").to_pylist())):
                ids = np.r_[ids, np.int32(end_id)]
                if held and held + len(ids) > shard_ids:
                    yield closed()
                names.append(name)
                waiting.append(ids)
                held += len(ids)
        if held:
            yield closed()

    return materialize(rows.select("doc_id", "text").mapInArrow(write, schema), "token-shards")


def _arrow(name: pa.DataType) -> pa.Schema:
    whole, raw = pa.int64(), pa.binary()
    return pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", whole), ("n_ids", whole), ("first_symbol", whole),
        ("doc_ids", pa.list_(name)), ("doc_lengths", pa.list_(whole)), ("symbols", raw), ("rules", raw), ("lengths", raw)])


def placed(shards: DataFrame) -> DataFrame:
    """shards with start, the number of ids in all shards before."""
    # one row of two numbers for each task that wrote: bounded, so broadcast, which leaves the shards where they lie
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(earlier, F.lit(0)).alias("__parts_before"))
    return shards.join(F.broadcast(parts), "part").withColumn("start", F.col("__parts_before") + F.col("before")).drop("__parts_before")


def read_documents(shards: DataFrame, keep_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, and ids) of each document, decoded from the shards."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("start", "first_symbol", "doc_lengths", "symbols", "rules",
                    "lengths")}
                ids = _shard(row).all().astype("<u4")
                length = np.array(row["doc_lengths"], np.int64)
                end = np.cumsum(length)
                crc = [zlib.crc32(ids[b - n : b]) for b, n in zip(end.tolist(), length.tolist())]
                columns = [batch.column("doc_ids")[k].values, pa.array(row["start"] + end - length), pa.array(length),
                    pa.array(crc, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, end], pa.int32()), pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    columns = ["start", "first_symbol", "doc_ids", "doc_lengths", "symbols", "rules", "lengths"]
    return placed(shards).select(*columns).mapInArrow(read, schema)


def read_span(shards: DataFrame, start: int, stop: int) -> DataFrame:
    """(position, id) for start <= position < stop in the whole corpus: only shards that hold some are read, only symbols that cover them expanded."""
    cover = placed(shards).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = _shard(row).span(start - row["start"], stop - row["start"])
                at = max(start, row["start"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(ids))), pa.array(ids)],
                    names=["position", "id"])

    columns = ["start", "first_symbol", "symbols", "rules", "lengths"]
    return cover.select(*columns).mapInArrow(read, "position long, id long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int, keep_ids: bool = True) -> DataFrame:
    """docs (doc_id, text), encoded and written as shards, and read back from them: (doc_id, start, n_tokens, ids_crc32, and ids)."""
    return read_documents(write_shards(docs, tokenizer, end_id), keep_ids)

