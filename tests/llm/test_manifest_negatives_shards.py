"""Merkle manifests, hard negatives and token shards against brute force, over odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from auditlake.llm import hard_negatives, merkle, queries, token_files
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def _leaf(r, text):
    fields = [r[0], r[3], r[2], r[4], text]
    return _sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def _siblings(levels, at):
    """For each level below the root the hashes to the left and to the right in the node's run."""
    for nodes in levels[:-1]:
        start = at // 8 * 8
        run = nodes[start : start + 8]
        yield run[: at - start], run[at - start + 1 :]
        at //= 8


def _merkle(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r, _leaf(r, r[1])))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[lang] = _levels([h for _, h in groups[lang]])
    top = _levels([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, (r, leaf) in enumerate(groups[lang]):
            path = [*_siblings(trees[lang], at), *_siblings(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]) if tampered else r[1]
            node = _leaf(r, lower)
            for left, right in path:
                node = _sha("".join([*left, node, *right]))
            proof = _sha("".join(h for left, right in path for h in [*left, *right]))
            out.append((r[0], leaf, trees[lang][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return sorted(out, key=str)


def _manifest(spark, rows):
    got = merkle.merkle_manifest(spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as g", "2 as h", "3 as i", "4 as n",
        "'x' as path", "'y' as members", "0 as level", "7 as root", "'z' as __row"))
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"])
        for r in got.collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9, None: 1}, {"en": 70, "de": 64, "": 3, None: 2},
    {f"l{i:02d}": 1 + i % 3 for i in range(20)}, {"en": 600}])
def test_merkle_manifest(spark, sizes):
    r, rows = random.Random(8), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = r.choice([None, "", "Ünï TEXT", "lower only", "A" * r.randint(0, 50) + str(r.random())])
            rows.append((len(rows) * 7 - 3, text, lang, r.choice([None, "", "web:1", "ß"]), r.choice([None, 5, -1])))
    r.shuffle(rows)
    assert _manifest(spark, rows) == _merkle(rows)


def test_merkle_manifest_of_repeated_rows_and_null_ids(spark):
    rows = [(1, "Same", "en", "s", 4)] * 11 + [(None, "No id", "en", None, None)] * 3 + [(2, "Same", None, "s", 4)] * 9
    rows += [(5, "x" * 200_000 + "Y", "en", "s", 200_001)]
    assert _manifest(spark, rows) == _merkle(rows)


def test_merkle_manifest_of_no_rows(spark):
    assert _manifest(spark, []) == []


def test_merkle_levels_shrink_by_eight(spark):
    rows = spark.range(1000).selectExpr("'' as g", "sha2(cast(id as string), 256) as h", "id")
    tree = merkle.tree(rows, ["id"])
    assert [level.count() for level in tree.levels] == [125, 16, 2, 1]
    assert tree.roots().count() == 1


def test_merkle_sql(spark, duck):
    got = queries.queries()["op12_merkle_manifest"](spark, SMALL).toPandas()
    want = duck.execute(queries.oracle_sql()["op12_merkle_manifest"]).df()
    columns = sorted(want.columns)
    key = lambda x: sorted(map(str, x[columns].itertuples(index=False)))
    assert sorted(got.columns) == columns and key(got) == key(want)


VECTORS = "vec_id long, embedding array<float>, label int"


def _usable(rows):
    out = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        if sum(x * x for x in v) <= 1 << 52:
            out.append((i, v, label))
    return out


def _negatives(rows, k=5):
    use, out = _usable(rows), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, v, label in use:
        if i % 100:
            continue
        scored = [(-dot(v, w), j, other == label) for j, w, other in use if j != i]
        same = sorted((s, j) for s, j, x in scored if x)[:k]
        for p, j in same:
            window = sorted((s, n) for s, n, x in scored + [(-dot(v, w), n, False) for n, w, o in use if n == i and o != label]
                if not x and 80 * -p <= 100 * -s <= 100 * -p)
            out += [(i, j, r, n, -p, -s) for r, (s, n) in enumerate(window[:k], 1)]
    return sorted(out)


def _mined(spark, rows, **options):
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 as id", "2 as row", "3 as cell", "'a' as v", "0 as low")
    got = hard_negatives.hard_negatives(frame, **options).collect()
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def _vectors(seed, n, dim, spread, labels=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(6, dim))
    v = centres[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))
    return [(int(i), [float(x) for x in row], int(label)) for i, row, label in zip(r.permutation(n) * 4, v, r.integers(0, labels, n))]


@pytest.mark.parametrize("dim, spread", [(2, 0.05), (8, 0.2), (64, 1.0)])
def test_hard_negatives(spark, dim, spread):
    rows = _vectors(dim, 600, dim, spread)
    got = _mined(spark, rows)
    assert got == _negatives(rows) and got


def test_hard_negatives_over_many_cells_blocks_and_batches(spark, monkeypatch):
    for name, value in (("SAMPLE_ROWS", 200), ("CELL_ROWS", 100), ("BLOCK_ROWS", 40), ("BATCH_ANCHORS", 3)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = _vectors(3, 1500, 6, 0.1)
    # a third of all rows are one vector
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    assert _mined(spark, rows) == _negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [0.5, -0.25, 0.125]
    rows = [(0, v, 1), (100, v, None), (200, None, 1), (300, [0.1, nan, 0.2], 1), (400, [0.1, None, 0.2], 1), (500, [inf, 0.0, 0.0], 1),
        (None, v, 1), (600, [], 1), (700, [0.5], 2), (800, [1e30, 0.0, 0.0], 1), (900, [0.0, 0.0, 0.0], 2), (1, v, 2), (2, v, 1),
        (3, [0.5, -0.25], 1), (4, [0.49, -0.25, 0.1], 2), (5, [-x for x in v], 2), (6, [-x for x in v], 1), (7, v, 2), (8, v, 3)]
    got = _mined(spark, rows)
    assert got == _negatives(rows) and {r[0] for r in got} >= {0}


def test_hard_negatives_of_repeated_rows(spark):
    v, w = [0.5, 0.5], [0.5, 0.4]
    rows = [(0, v, 1)] * 2 + [(1, v, 1)] * 3 + [(2, w, 2)] * 2 + [(3, v, 2)]
    got = _mined(spark, rows)
    assert got == _negatives(rows) and len(got) == 2 * 3 * 3


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(0, None, None)]])
def test_hard_negatives_of_hardly_any_rows(spark, rows):
    assert _mined(spark, rows) == []


def test_blocks_find_what_a_scan_finds(monkeypatch):
    monkeypatch.setattr(hard_negatives, "LEAF_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "SCORES", 64)
    r = np.random.default_rng(1)
    for dim, scale in ((2, 50), (16, 256), (3, 30_000_000)):
        rows = np.floor(r.normal(size=(500, dim)) * scale)
        rows[100:200] = rows[100]
        ids, labels = r.permutation(500), r.integers(0, 3, 500)
        most = float((rows * rows).sum(axis=1).max())
        block = hard_negatives.Block(ids, labels, rows, most)
        q = rows[:40]
        own, kinds = ids[:40], labels[:40]
        low, high = np.full(40, -(1 << 62)), np.full(40, 1 << 62)
        top = (q * q).sum(axis=1).astype(np.int64)
        for same, lo, hi in ((True, low, high), (False, top * 8 // 10, top), (False, top, top), (False, top + 1, top)):
            found = block.nearest(own, kinds, same, q, lo, hi, 5, most)
            got = [(int(a), int(b), int(c)) for a, b, c in zip(*found)]
            want = []
            for a in range(40):
                s = (rows @ q[a]).astype(np.int64)
                ok = (s >= lo[a]) & (s <= hi[a]) & ((labels == kinds[a]) & (ids != own[a]) if same else labels != kinds[a])
                want += [(a, int(ids[j]), int(s[j])) for j in sorted(np.flatnonzero(ok), key=lambda j: (-s[j], ids[j]))[:5]]
            assert got == want


def test_hard_negatives_sql(spark, duck):
    got = queries.queries()["op11_hard_negatives"](spark, SMALL).toPandas()
    want = duck.execute(queries.oracle_sql()["op11_hard_negatives"]).df()
    columns = sorted(want.columns)
    key = lambda x: sorted(map(tuple, x[columns].to_numpy().tolist()))
    assert sorted(got.columns) == columns and key(got) == key(want) and len(want)


ODD = [None, "", " \t\n", "Plain words, plain words.", "x", "<|endoftext|> inside <|startoftext|>a<|endoftext|>", "it's we'll I'd THEY'RE o'clock 's",
    "a b c d\x1ce\x85f\x00g\x7f", "é ́x İstanbul ſtraße ǅ Σίσυφος ΟΔΟΣ", "한국어 한 日本語 ไทย \U0001f468‍\U0001f469‍\U0001f467 \U0001f1e9\U0001f1ea",
    "123 4567.89 ½ ² ⅷ x2y3", "&&& !!! --- ... …", "ab" * 3000, "tab\tnew\nline\r\nvertical\x0bform\x0cend", " lead and trail ", "a  b   c",
    "​﻿ zero ‍ width", "#" * 40]


def _tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(queries.WORD_TOKENIZER)
    return path, Tokenizer.from_file(path)


def _expected(rows):
    _, tokenizer = _tokenizer()
    key = lambda r: (r[0] is not None, r[0] or 0)
    start, out = 0, []
    for i, text in sorted(rows, key=key):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    return out


def test_encoder_equals_the_library(monkeypatch):
    path, tokenizer = _tokenizer()
    r = random.Random(6)
    signs = "abcXYZäöüßéÉ'.,-!?<|>#&1 2 \t\n ́̈\x1c한日🙂" + "  "
    texts = [t or "" for t in ODD] + ["".join(r.choice(signs) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(map(chr, (r.choice((r.randint(1, 0x2FF), r.randint(0x300, 0xD7FF))) for _ in range(30)))) for _ in range(1500)]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for chars, known, words in ((1 << 22, 10**6, 10**6), (50, 200, 30)):
        for name, value in (("PIECE_CHARS", chars), ("KNOWN_PIECES", known), ("KNOWN_WORDS", words)):
            monkeypatch.setattr(token_files, name, value)
        got = [x.tolist() for x in token_files.Encoder(path).encode(texts)]
        assert got == want
    plain = token_files.Encoder(path)
    plain.pattern = None
    assert [x.tolist() for x in plain.encode(texts)] == want


@pytest.mark.parametrize("most", [1 << 16, 1 << 32])
@pytest.mark.parametrize("kind", ["text", "runs", "random", "one", "empty", "copies"])
def test_grammars_expand_to_what_they_were_made_of(kind, most):
    r = np.random.default_rng(4)
    ids = {"text": lambda: r.zipf(1.3, 20_000) % 3000, "runs": lambda: np.repeat(r.integers(0, 5, 300), r.integers(1, 60, 300)),
        "random": lambda: r.integers(0, 50_000, 5000), "one": lambda: np.array([7]), "empty": lambda: np.array([], int),
        "copies": lambda: np.tile(r.integers(0, 400, 150), 40)}[kind]().astype(np.int32)
    symbols, rules = token_files.compressed(ids, 50_000, most)
    shard = token_files.Shard(50_000, symbols, rules, token_files.expansion_lengths(rules, 50_000))
    assert shard.all().tolist() == ids.tolist()
    for _ in range(200):
        a, b = sorted(r.integers(-2, len(ids) + 3, 2).tolist())
        assert shard.span(a, b).tolist() == ids[max(0, a) : max(0, b)].tolist()
    if kind in ("runs", "copies"):
        assert len(symbols) + 2 * len(rules) < len(ids) / 3
    # no pair is left that is frequent
    pairs = list(zip(symbols[:-1].tolist(), symbols[1:].tolist()))
    unlike = [p for p in pairs if p[0] != p[1]]
    assert not unlike or max(map(unlike.count, set(unlike[:500]))) < token_files.FREQUENT


def test_token_files(spark):
    path, _ = _tokenizer()
    r = random.Random(1)
    rows = [(i * 3 - 5, t) for i, t in enumerate(ODD)] + [(1000 + i, " ".join(r.choice(("the", "Cat", "sat,", "über", f"n{i % 9}"))
        for _ in range(r.randint(0, 200)))) for i in range(150)] + [(50, "again")] * 3 + [(None, "no id")]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as part", "2 as seq", "'q' as __hash", "0 as start")
    shards = token_files.write_shards(frame, path, 2, shard_ids=2000)
    assert shards.count() > 8 and shards.agg({"n_ids": "max"}).first()[0] < 13_000
    got = [(x["doc_id"], x["start"], x["n_tokens"], x["ids_crc32"], x["ids"]) for x in token_files.read_documents(shards).orderBy(
        "start").collect()]
    want = _expected(rows)
    assert got == want
    whole = [i for *_, ids in want for i in ids]
    for start, stop in ((0, 1), (100, 5000), (len(whole) - 3, len(whole) + 9), (7, 7)):
        span = [x["id"] for x in token_files.read_span(shards, start, stop).orderBy("position").collect()]
        assert span == whole[start:stop]


def test_token_files_of_no_rows(spark):
    path, _ = _tokenizer()
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(empty, path, 2).count() == 0


def test_token_files_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = queries.queries()["op13_token_files"](spark, SMALL).orderBy("start").collect()
    assert [tuple(r) for r in got] == [x[:4] for x in _expected(rows)]
