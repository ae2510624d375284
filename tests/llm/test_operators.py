"""The operators against brute force, over small tables with all kinds of odd rows."""

import base64
import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from auditlake.llm import bpe, embedding_dedup, exact_dedup, html_text, licenses, mixing, pii, quality, simhash, substring_dedup
from auditlake.llm.components import components
from tests.conftest import SMALL

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def _docs(spark, rows):
    """rows: (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, None, s, len(t or "")) for i, t, s in rows], DOCS)


def _words(r, n, vocabulary=None):
    return " ".join(r.choice(vocabulary) if vocabulary else "".join(r.choice("abcdeö") for _ in range(r.randint(1, 6)))
        for _ in range(n))


@pytest.fixture(scope="module")
def odd_rows():
    r = random.Random(4)
    long = _words(r, 3000)
    rows = [(0, None, "a"), (1, "", "a"), (2, " \t\n", None), (3, "one", "b"), (4, "one ", "b"), (5, long, "a"),
        (6, long + " tail", "a"), (7, long.replace(" ", "\n"), "a"), (None, "no id here", "c"),
        (9, "ünïcode — 中文 😀 text", "c")]
    base = _words(r, 120)
    for i in range(10, 60):
        words = base.split()
        for _ in range(i % 4):
            words[r.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), "a" if i % 3 else None))
    rows += [(i, _words(r, r.randint(1, 200)), f"s{i % 5}") for i in range(60, 120)]
    return rows


def _space(text):
    out = []
    for c in text or "":
        c = " " if c in " \t\n\x0b\x0c\r" else c
        if c != " " or not out or out[-1] != " ":
            out.append(c)
    return "".join(out)


def _split(text):
    return [w for w in _space(text).split(" ") if w]


def _by_id(rows, key="doc_id"):
    return {r[key]: r for r in rows}


def _groups(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_dedup(spark, odd_rows):
    got = exact_dedup.exact_dedup(_docs(spark, odd_rows), blocks=4).collect()
    groups = defaultdict(list)
    for i, t, _ in odd_rows:
        groups[_space(t)].append(i)
    want = set()
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        want |= {(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids}
    assert {tuple(r) for r in got} == want and len(got) == len(odd_rows)
    kept = exact_dedup.filter_exact(_docs(spark, odd_rows), blocks=4)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(w[0]) for w in want if w[3])


def test_counting_filters_merge_without_loss():
    import pyarrow as pa

    r = np.random.default_rng(1)
    values = r.integers(-(2**63), 2**63 - 1, 5000)
    values = np.concatenate([values, values[:700], values[:50], values[:9].repeat(1000), [0, -1, -1, 2**63 - 1]])
    parts = np.array_split(r.permutation(values), 7)
    blocks = [b for part in parts for out in exact_dedup._build(64,
            at_once=300)(iter([pa.RecordBatch.from_arrays([pa.array(x)], ["fp"]) for x in np.array_split(part, 5)]))
            for b in out.to_pylist()]
    blocks.sort(key=lambda b: b["block"])
    batch = pa.RecordBatch.from_pylist(blocks, pa.schema([("block", pa.int32()), ("quotient_bits", pa.int32()),
                *((c, pa.binary()) for c in ("occupied", "run_ends", "slots"))]))
    got = {(x["fp"], x["n"]) for out in exact_dedup._merge_blocks(64)(iter([batch])) for x in out.to_pylist()}
    unique, n = np.unique(values, return_counts=True)
    assert got == {(int(v), int(c)) for v, c in zip(unique, n) if c > 1}


@pytest.mark.parametrize("bits", [44, 58, 63])
def test_quotient_filter_holds_fingerprints_and_counts(bits):
    r = np.random.default_rng(bits)
    top = (1 << bits) - 1
    for n in (0, 1, 7, 300):
        for few in range(11):
            # small and zero remainders, and dense runs that push others from their homes
            odd = np.array([0, 1, 2, 3, top, top - 1, 1 << 40, (1 << 40) + 1, 5, 6], np.uint64)[:few]
            v = r.integers(0, top, n, dtype=np.uint64, endpoint=True)
            v = np.unique(np.concatenate([v, odd, v[: n // 4] & ~np.uint64((1 << 39) - 1),
                        v[: n // 4] + r.integers(0, 4, n // 4).astype(np.uint64)]))
            v = v[v <= np.uint64(top)]
            c = r.choice([1, 1, 2, 3, 4, 5, 6, 7, 1000, 10**9], len(v)).astype(np.int64)
            values, counts = exact_dedup.QuotientFilter.unpacked(bits,
                *exact_dedup.QuotientFilter.of(v, c, bits).packed()).items()
            assert values.tolist() == v.tolist() and counts.tolist() == c.tolist()


def test_blocks_follow_the_number_of_rows():
    assert exact_dedup.blocks_for(0) == exact_dedup.FEWEST and exact_dedup.blocks_for(
        10**11) * exact_dedup.PER_BLOCK >= 10**11
    with pytest.raises(ValueError, match="power of two"):
        exact_dedup._low_bits(6)


def _fingerprint(text):
    words = _split("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark, odd_rows):
    got = _by_id(simhash.simhash_dedup(_docs(spark, odd_rows)).collect())
    fps = {i: _fingerprint(t) for i, t, _ in odd_rows}
    values = sorted(set(fps.values()))
    group = _groups(values, [(a, b) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for i, fp in fps.items():
        if i is not None:
            least[group[fp]] = min(least.get(group[fp], i), i)
    want = {i: (f"{fp:016x}", least.get(group[fp])) for i, fp in fps.items()}
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == want
    assert len({c for _, c in want.values()}) < len(fps) - 20
    kept = sorted(str(r["doc_id"]) for r in simhash.filter_near(_docs(spark, odd_rows)).collect())
    assert kept == sorted(str(i) for i, (_, c) in want.items() if i == c)


def test_fingerprint_bits_of_exactly_half_are_unset():
    words = "alpha beta gamma delta epsilon".split()
    first, second = (xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in (0, 1))
    assert simhash.fingerprint(" ".join(words)) == first & second
    # over half of the shingles, repeats included
    assert simhash.fingerprint("a b c d " * 2) == _fingerprint("a b c d " * 2)


def test_very_long_texts(spark, tokenizer):
    """One text of 60,000 words, and one of a single word of 300,000 characters, beside short ones."""
    r = random.Random(41)
    vocabulary = ["".join(r.choice("abcdeö") for _ in range(r.randint(1, 7))) for _ in range(3000)]
    long, word = _words(r, 60_000, vocabulary), "ab" * 150_000
    rows = [(0, "short one", "s"), (1, long, "s"), (2, word, "t"), (3, long + " tail", "s"), (4, long.replace(" ", "\n", 5), "t")]
    docs = _docs(spark, rows)
    texts = {i: t for i, t, _ in rows}
    exact = _by_id(exact_dedup.exact_dedup(docs).collect())
    assert [exact[i]["keep_id"] for i in range(5)] == [0, 1, 2, 3, 1]
    near = _by_id(simhash.simhash_dedup(docs).collect())
    ones = np.zeros(64, np.int64)
    w = long.split()
    h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 4]).encode(), 42) for k in range(len(w) - 3)], np.uint64)
    for bit in range(64):
        ones[bit] = int(((h >> np.uint64(bit)) & np.uint64(1)).sum())
    assert near[1]["fingerprint"] == f"{sum(1 << b for b in range(64) if ones[b] * 2 > len(h)):016x}" == near[4]["fingerprint"]
    cut = _by_id(substring_dedup.substring_dedup(docs).collect())
    assert [cut[i]["n_removed"] for i in range(5)] == [0, 0, 0, 60_000, 60_000] and cut[3]["kept"] == "tail"
    sizes = {x["doc_id"]: x["size"] for x in mixing.allocation(docs).collect()}
    assert sizes == {0: 2, 1: 60_000, 2: 1, 3: 60_001, 4: 60_000}
    path, _, pattern, reference = tokenizer
    for x in bpe.encode(docs, path, pattern).collect():
        assert x["ids"] == reference.encode_ordinary(texts[x["doc_id"]])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(5)], "doc_id long, quality int, toxic int")
    assert all(np.isfinite(x["score"]) for x in quality.quality(docs, labels).collect())
    scan = _by_id(licenses.license_scan(docs).collect())
    assert scan[1]["n_words"] == 60_000 and scan[2]["n_words"] == 1


def test_equal_levels_of_water(spark):
    """Sources that fill at one level, by their order: sizes in proportion to the weights 3, 1, 2."""
    rows = [(i, _words(random.Random(i), n, ["w"]), s) for i, (s, n) in enumerate([("a", 30), ("b", 10), ("c", 20), ("a", 30), ("b", 10), ("c", 20)])]
    got = mixing.allocation(_docs(spark, rows), share=1.5).collect()
    assert {(x["source"], x["target"]) for x in got} == {("a", 90.0), ("b", 30.0), ("c", 60.0)}
    full = mixing.allocation(_docs(spark, rows), share=2.0).collect()
    assert {(x["source"], x["target"]) for x in full} == {("a", 120.0), ("b", 40.0), ("c", 80.0)} and all(x["times"] == 2 for x in full)


@pytest.mark.parametrize("large", [16, 32_768])
def test_simhash_links_of_dense_and_sparse_buckets(spark, large):
    r = np.random.default_rng(2)
    seeds = r.integers(0, 2**63, 60, dtype=np.uint64)
    near = [s ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) for s in seeds[:8]
        for _ in range(40)]
    values = np.unique(np.concatenate([seeds, np.array(near, np.uint64)]))
    distinct = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [tuple(x) for x in simhash.links(distinct, large=large).collect()]
    signed = [int(v) for v in values.view(np.int64)]
    assert all((a & (2**64 - 1) ^ b & (2**64 - 1)).bit_count() <= 4 for a, b in edges)
    want = [(a, b) for a, b in itertools.combinations(signed, 2)
        if (a & (2**64 - 1) ^ b & (2**64 - 1)).bit_count() <= 4]
    assert _groups(signed, edges) == _groups(signed, want)


def test_hot_groups_are_looked_up_like_others(spark):
    """Half of all rows in one group: the same results, and no task gets all of the group's rows."""
    r = random.Random(31)
    hot = _words(r, 60)
    rows = [(i, hot if i % 2 else _words(r, 40), "s") for i in range(600)] + [(1000 + i, _words(r, 30), "s")
        for i in range(5)] * 2
    docs = _docs(spark, rows)
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[_space(t)].append(i)
    want = {(i, min(ids), len(ids)) for ids in groups.values() for i in ids}
    assert {(x["doc_id"], x["keep_id"], x["group_size"]) for x in exact_dedup.exact_dedup(docs).collect()} == want
    assert sorted(x["doc_id"] for x in exact_dedup.filter_exact(docs).collect()) == sorted(i for ids in groups.values()
        for i in ids if i == min(ids))
    near = _by_id(simhash.simhash_dedup(docs).collect())
    assert {near[i]["component_id"] for i in range(1, 600, 2)} == {1}


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (5, 5), (200, 300), (300, 200)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    # a star with many ends, a comb on it, and thousands of pairs beside
    r = random.Random(3)
    pairs = [(5, i) for i in range(1000, 4000)] + [(i, i + 10_000) for i in range(1000, 4000, 7)]
    pairs += [(i, i + 1) for i in range(50_000, 58_000, 2)]
    r.shuffle(pairs)
    nodes = {x for p in pairs for x in p}
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == _groups(nodes, pairs)


def test_substring_dedup(spark, odd_rows):
    r = random.Random(8)
    passage, pieces = _words(r, 70), [_words(r, 49), _words(r, 50)]
    rows = [*odd_rows, *((i, f"{_words(r, i % 37)} {passage} {_words(r, 20)}", None) for i in range(200, 230)),
        *((i, f"{_words(r, 5)} {pieces[i % 2]} {_words(r, 3)}", None) for i in range(300, 306)),
        (400, f"{passage} {passage}", None)]
    got = _by_id(substring_dedup.substring_dedup(_docs(spark, rows)).collect())
    starts = {}
    for i, t, _ in sorted((x for x in rows if x[0] is not None), key=lambda x: x[0]):
        w = _split(t)
        for k in range(len(w) - 49):
            starts.setdefault(tuple(w[k : k + 50]), i)
    for i, t, _ in rows:
        w = _split(t)
        gone = set()
        for k in range(len(w) - 49 if i is not None else 0):
            if starts[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"], got[i]["kept"]) == (len(w), len(gone),
            hashlib.sha256(kept.encode()).hexdigest(), kept)
    assert got[301]["n_removed"] == 0 and got[303]["n_removed"] == 50 and got[302]["n_removed"] == 0
    with pytest.raises(ValueError, match="cover"):
        substring_dedup.substring_dedup(_docs(spark, rows), cover=(0, 1, 2))


def test_substring_dedup_of_shared_ids_and_hot_passages(spark, monkeypatch):
    from auditlake.llm import packed

    r = random.Random(18)
    passage, other = _words(r, 80), _words(r, 60)
    rows = [(5, f"{_words(r, 10)} {passage}"), (5, other), (5, f"{_words(r, 60)}"), (3, other), (8, passage),
        (8, f"{other} {passage} {_words(r, 9)}"), (9, "a " * 3000), (10, "a " * 3000)]
    rows += [(i, f"{_words(r, 3)} {passage} {_words(r, i % 5)}") for i in range(20, 220)]
    docs = _docs(spark, [(i, t, None) for i, t in rows]).repartition(6)
    starts = {}
    for i, t in sorted(rows, key=lambda x: x[0]):
        w = _split(t)
        for k in range(len(w) - 49):
            starts.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, t in rows:
        w = _split(t)
        gone = {x for k in range(len(w) - 49) if starts[tuple(w[k : k + 50])] < i for x in range(k, k + 50)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(x[c] for c in ("doc_id", "n_words", "n_removed", "kept"))
        for x in substring_dedup.substring_dedup(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 10_000
    # a task sends few rows of a hash that most of its documents share
    h, docs_ = np.full(1000, 7, np.uint64), np.arange(1000)
    for settle in (packed.settle_later, packed.settle_shared):
        assert (~settle(h, np.zeros(1000, np.uint32), docs_)).sum() <= 2


def _vectors(n=300, d=16, seed=3):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    near = x[:40].repeat(3, axis=0) + r.normal(scale=0.05, size=(120, d))
    middle = x[40:80] + r.normal(scale=0.42, size=(40, d))
    v = np.concatenate([x, near, middle, x[:10]]).astype(np.float32)
    return [(i, [float(c) for c in v[i]], i % 2 if i >= n + 160 else (int(i % 3 == 0))) for i in range(len(v))]


@pytest.mark.parametrize("large", [8, 4096])
def test_embedding_dedup(spark, large):
    rows = _vectors()
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1),
        (904, [1.0] * 16, None), (905, [1.0] * 16, None), (906, [1.0] * 3, 1), (907, [1.0] * 3, 1), (908, [], 1),
        (909, [float("inf")] * 16, 0)]
    got = _by_id(embedding_dedup.embedding_dedup(spark.createDataFrame(rows + odd,
                "vec_id long, embedding array<float>, label int"), large=large).collect(), "vec_id")
    good = [r for r in rows] + [odd[6], odd[7]]
    links = []
    for (i, a, la), (j, b, lb) in itertools.combinations(good, 2):
        if la == lb and len(a) == len(b):
            a_, b_ = np.array(a, float), np.array(b, float)
            if a_ @ b_ / np.sqrt(a_ @ a_) / np.sqrt(b_ @ b_) >= 0.93:
                links.append((i, j))
    groups = _groups([i for i, *_ in rows + odd], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 60
    assert {i: (r["n_links"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (n[i], c, c == i) for i,
        c in groups.items()}


@pytest.mark.parametrize(("dim", "n"), [(64, 500), (64, 51_000), (64, 10**6), (64, 10**8), (64, 10**10), (4, 10**6),
        (16, 10**5), (384, 10**9), (1024, 10**9)])
def test_planned_recall_holds_for_each_number_of_turns(dim, n):
    """Pairs at the threshold, other ones than the plan measures, are found as often as RECALL says at every size."""
    k, tables = embedding_dedup.plan(dim, n)
    r = np.random.default_rng([5, dim])
    m = 1500 if dim <= 64 else 400
    x = r.normal(size=(m, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = r.normal(size=x.shape)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    labels = np.zeros(m, np.int64)
    met = embedding_dedup._together(*embedding_dedup.buckets(x, labels, k, tables),
        *embedding_dedup.buckets(y, labels, k, tables))
    assert met.any(axis=1).mean() > 0.97, (k, tables)


def test_embedding_ties_nulls_and_clashing_names(spark):
    import pyspark.sql.functions as F

    # cosine exactly at a threshold that doubles hold: 0.5 links, a hair less does not
    rows = [(1, [1.0, 0.0, 0.0, 0.0], 1), (2, [0.5, 0.5, 0.5, 0.5], 1), (3, [0.5, 0.5, 0.5, 0.5000001], 1),
        (None, [0.0, 0.0, 1.0, 0.0], 2), (None, [0.0, 0.0, 2.0, 0.0], 2), (7, [0.0, 0.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").select("*",
        *[F.lit("x").alias(c) for c in ("class", "key", "home", "probes", "dim", "weight", "__label", "least_id")])
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"])
        for r in embedding_dedup.embedding_dedup(df, cosine=0.5, recall=0.999999).collect())
    assert got == [("1", 1, "1", True), ("2", 2, "1", False), ("3", 1, "1", False), ("7", 0, "7", True),
        ("None", 1, "None", True), ("None", 1, "None", True)]


def test_hadamard_is_orthogonal():
    h = embedding_dedup.hadamard(np.eye(32))
    assert np.allclose(h @ h.T, 32 * np.eye(32))


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        data = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    return path, data, p.PATTERN, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_tiktoken(spark, odd_rows, tokenizer):
    path, data, pattern, reference = tokenizer
    r = random.Random(6)
    codec = bpe.Codec(data, pattern)
    for alphabet in ("ab", "aaab ", "abc'sdtrevml 12", "éèaß \n\t\x1c\x85　x", "the ing,.!  \n", "١中文힣😀a ", "ɐʰaé "):
        for _ in range(400):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 40)))
            assert codec.encode(text) == reference.encode_ordinary(text), text
            assert codec.decode(codec.encode(text)) == text.encode()
    got = _by_id(bpe.encode(_docs(spark, odd_rows), path, pattern).collect())
    for i, text, _ in odd_rows:
        ids = reference.encode_ordinary(text or "")
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    back = _by_id(bpe.decode(bpe.encode(_docs(spark, odd_rows), path, pattern), path).collect())
    assert {i: r["text"] for i, r in back.items()} == {i: t or "" for i, t, _ in odd_rows}


def test_prefix_tables_append_and_edit(tokenizer):
    vocabulary = bpe.Vocabulary.from_bytes(tokenizer[1])
    r = random.Random(7)
    for _ in range(200):
        a, b, c = ("".join(r.choice("aeinrst er") for _ in range(r.randint(0, 15))).encode() for _ in range(3))
        p = bpe.Prefixes(vocabulary, a)
        p.append(b)
        assert p.tokens() == bpe.Prefixes(vocabulary, a + b).tokens()
        at = r.randint(0, len(a + b))
        to = r.randint(at, len(a + b))
        p.edit(at, to, c)
        assert p.tokens() == bpe.Prefixes(vocabulary, (a + b)[:at] + c + (a + b)[to:]).tokens()


def test_html_text(spark):
    page = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>t</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">buy this now and here</div><article><h1>Head &amp; line</h1><p><b>First bold.<br><p>Second   part &lt;x&gt;.</p><div class="ad">an advert in the middle that goes on and on and on</div><p>Third with <i>in</i>line.</p></article><div id="comments"><p>a reader says so</p></div><footer>&copy; foot</footer>'
    assert html_text.extract(page) == "Head & line First bold. Second part <x>. Third with inline."
    assert html_text.extract("") == "" and html_text.extract("just words") == "just words" and html_text.extract(
        "<nav>only</nav>") == ""
    assert html_text.extract("<article>open <b>end <!-- never closed") == "open end"
    assert html_text.extract("<p>" + "word " * 50_000) == ("word " * 50_000).strip()
    rows = [(1, "u", page), (2, None, None), (1, "u", page), (None, "u", "<p>text</p>")]
    got = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r["page_id"]), r["n_chars"]) for r in got) == [("1", 59), ("1", 59), ("2", 0), ("None", 4)]
    right = 0
    for _, parts in html_text.labelled_pages(200, seed=77):
        truth = re.sub(r"<[^>]*>", " ", re.sub(r"</?[ab]\b[^>]*>", "",
                " ".join(p for p, main in parts if main))).split()
        right += html_text.extract("".join(p for p, _ in parts)).split() == truth
    assert right >= 185


#: Written by hand: a page's head, its text with what must go in brackets, and its foot.
_HAND = [
    ('<body><div id="header"><a href="/">Site</a> The best of news</div><ul class="nav"><li><a href="/1">One</a></li></ul><div id="content">', '<h1>Rain in May</h1><p>It rained for a week and the river rose.</p><p>See <a href="/x">the map</a></p>', '</div><div id="footer">About us and terms</div></body>'),
    ('<body><nav><a href="/a">A</a><a href="/b">B</a><article>',
        '<h1>Unclosed menu</h1><p>The menu before this text was never closed by the page.</p>', "</article></body>"),
    ('<body><form action="/s"><input><main>',
        '<h2>Unclosed form</h2><p>A search box that stays open must not swallow the whole page.</p>', "</main>"),
    ('<body><nav><ul><li><a href="/a">A</a></li></ul>',
        '<h1>No article at all</h1><p>Text that follows an open menu on a page without an article, long enough to be one.</p><p>And a second paragraph of it.</p>', ""),
    ('<article><div class="post-header">', "<h1>Head of the post</h1>",
        '</div><p>Short text follows here.</p><div class="share-price"><p>The price of a share rose by two percent.</p></div><div class="share"><a href="/t">Tell a friend</a></div><div class="notice">We use your data.</div><div class="notice-board"><p>The board of notices in the hall was full.</p></div></article>'),
    ('<main><div class="search-results"><p>', "The search found three more wrecks in the bay this year.",
        '</p></div><div class="search"><input> Search this site</div><section class="comments"><p>First!</p></section></main>'),
    ('<div class="wrapper has-sidebar"><div class="entry"><p>',
        "One paragraph of some twenty words that stands in a wrapper with a telling name, as many blogs have it today.",
        '</p></div><div class="sidebar"><p>Popular posts</p></div></div>'),
    ("<article><p>", 'Words before. <a href="/only">A last line that is a link</a>',
        "</p></article><footer>foot</footer>"),
    ('<article><h1>T</h1><p>', "Long enough a text for the scan to find it here.",
        '</p><p><a href="/next">Source of the quote</a></p></article>'),
]
_HAND_TEXT = [
    "Rain in May It rained for a week and the river rose. See the map",
    "Unclosed menu The menu before this text was never closed by the page.",
    "Unclosed form A search box that stays open must not swallow the whole page.",
    "No article at all Text that follows an open menu on a page without an article, long enough to be one. And a second paragraph of it.",
    "Head of the post Short text follows here. The price of a share rose by two percent. The board of notices in the hall was full.",
    "The search found three more wrecks in the bay this year.",
    "One paragraph of some twenty words that stands in a wrapper with a telling name, as many blogs have it today.",
    "Words before. A last line that is a link",
    "T Long enough a text for the scan to find it here. Source of the quote",
]


@pytest.mark.parametrize("name", ["relative", "sharp", "relative flex navy", "commentary", "headline", "notable", "adapt", "footnote", "searchlight"])
def test_html_text_keeps_blocks_of_telling_beginnings(name):
    assert html_text.extract(f'<article><h1>T</h1><div class="{name}"><p>Some words of the text.</p></div></article>') == "T Some words of the text."


@pytest.mark.parametrize("i", range(len(_HAND)))
def test_html_text_of_hand_written_pages(i):
    assert html_text.extract("".join(_HAND[i])) == _HAND_TEXT[i]


def test_html_text_keeps_articles_in_marked_wrappers():
    story = "<p>The first words of a story that is long enough.</p><p>More words of it follow here.</p>"
    text = "The first words of a story that is long enough. More words of it follow here."
    whole = lambda start, end="": html_text.extract(
        f"<html><head><title>t</title></head><body>{start}{story}{end}</body></html>")
    wrappers = ('<div class="content-sidebar-wrap"><article>', '<div class="layout has-sidebar"><main>',
        '<div class="layout has-sidebar"><div>', '<div style="overflow:hidden"><article>',
        '<article style="overflow-x: hidden">', '<main class="md:hidden">', '<form id="aspnetForm"><div>',
        '<svg viewBox="0 0 1 1"/><article>', "<div><select>")
    assert {w: whole(w) for w in wrappers} == dict.fromkeys(wrappers, text)
    assert html_text.extract(f'<body style="overflow-x:hidden">{story}') == text
    assert whole('<article><div class="entry-header"><h1>Head</h1></div>') == "Head " + text
    assert whole("<article>", '<h2 id="related-work">Related work</h2><p>Some <span class="share">of</span> it.</p></article>') == text + " Related work Some of it."
    # what is hidden or marked stays out
    for part in ('<div hidden>', '<div style="color:red; DISPLAY : none !important">',
            '<div style="visibility:hidden">', '<div class="sidebar">',
            '<div id="comments"><article class="comment-body">', '<div class="related-posts">'):
        assert whole("<article>", f"</article>{part}<p>{'other words ' * 30}</p></div>") == text, part
        assert whole("<article>", f"{part}<p>other words</p></div></article>") == text, part


def test_html_text_of_the_test_pages(spark):
    import html
    import re

    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    got = _by_id(html_text.main_text(pages).collect(), "page_id")
    for p in pages.collect():
        article = re.search(r"<article>(.*?)</article>", p["html"], re.S)[1]
        text = html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", article)))
        assert got[p["page_id"]]["text"] == " ".join(text.split())


def test_licenses(spark):
    texts = {
        0: None,
        1: "Released under the MIT License. mit-license, MIT\nLICENSE",
        2: "GNU General Public License; Apache License, Version 2.0",
        3: "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\nrest",
        4: "SPDX-License-Identifier: MIT OR",
        5: "summit license permit licenses",
        6: "under CC BY-NC 4.0. É mit license",
    }
    got = _by_id(licenses.license_scan(_docs(spark, [(i, t, None) for i, t in texts.items()])).collect())
    show = lambda i: tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels"))
    assert show(0) == (0, 0, None, None, "", "") and got[0]["score"] == 0
    assert show(1) == (9, 3, 3, 7, "mit", "mit")
    assert show(2) == (9, 2, 1, 4, "apache,gpl", "apache,gpl")
    assert got[3]["labels"] == "apache,classpath-exception-2.0,gpl,mit"
    assert got[3]["freedom"] == 1.0 and got[3]["n_base"] == 0
    assert got[4]["labels"] == "" and got[5]["labels"] == ""
    assert show(6) == (9, 1, 7, 7, "mit", "cc-by-nc,mit")
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_license_expressions():
    post = licenses.to_postfix
    assert post("MIT or Apache-2.0 and BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert post("(MIT or X) and Y */") == ["mit", "x", "or", "y", "and"]
    assert post("GPL-2.0 WITH E AND MIT") == ["gpl-2.0", "e", "with", "mit", "and"]
    assert [post(x) for x in ("", "and", "(MIT", "MIT and", "()")] == [None] * 5
    assert licenses.evaluate(post("GPL-3.0 and MIT")) == ({"gpl", "mit"}, 0.0)
    assert licenses.evaluate(post("GPL-2.0-only WITH Classpath-exception-2.0")) == ({"gpl", "classpath-exception-2.0"},
        0.5)
    assert licenses.evaluate(post("GPL-3.0-or-later WITH Unknown-exception AND Apache-2.0")) == ({"gpl",
            "unknown-exception", "apache"}, 0.0)
    assert licenses.evaluate(post("LGPL-2.1+ OR AGPL-3.0")) == ({"lgpl", "agpl"}, 0.5)
    # one label for a licence, whether a tag or a notice names it
    for tag, notice in (("CC-BY-4.0", "under CC BY 4.0"), ("CC0-1.0", "CC0 1.0"), ("BSL-1.0", "Boost Software License"),
            ("CC-BY-NC-SA-3.0", "Creative Commons Attribution-NonCommercial-ShareAlike 3.0"),
            ("MPL-2.0", "Mozilla Public License"), ("Zlib", "zlib license"), ("0BSD", "BSD license")):
        scan = licenses.Scanner().scan
        assert scan(f"SPDX-License-Identifier: {tag}")[5] == scan(notice)[5] != "", tag


def test_licence_places_take_linear_time():
    import time

    scanner, seconds = licenses.Scanner(), []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        assert scanner.scan("mit license " * n)[:4] == (2 * n, n, 0, 2 * n - 2)
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 3


def test_licences_of_odd_rows(spark, odd_rows):
    got = licenses.license_scan(_docs(spark, [*odd_rows, (None, "mit license", None), (None, None, None)])).collect()
    assert len(got) == len(odd_rows) + 2 and sum(r["n_base"] for r in got) == 1


def test_base_licences_against_brute_force(spark, odd_rows):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = _by_id(licenses.license_scan(docs).collect())
    import re

    for d in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+",
            "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in d["text"]))
        places = [(k, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()]
            for k in range(len(words)) if words[k : k + len(p)] == p]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places),
            min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert set(r["labels"].split(",")) >= {label for _, label in places}


@pytest.fixture(scope="module")
def weights(spark):
    return pii.trained(spark)


def test_pii_base(spark, weights):
    text = "mail a.b@c-d.example.com, ip 10.0.0.256 and 1.2.3.4, card 4111 1111 1111 1111 or 4111-1111-1111-1112, tel +1 (504) 555-2652 é +49 30 12"
    found = pii.base_spans(text)
    assert [(text[a:b], k) for a, b, k in found] == [("a.b@c-d.example.com", "email"), ("1.2.3.4", "ip"),
        ("4111 1111 1111 1111", "card"), ("+1 (504) 555-2652", "phone")]
    got = pii.find_pii(_docs(spark, [(1, text, None), (2, None, None), (1, text, None), (3, "é" * 5000 + text, None)]),
        weights).collect()
    assert [r["n_email"] for r in got] == [1, 0, 1, 1]
    joined = ",".join(f"{k}:{a}:{b}" for a, b, k in found)
    assert got[0]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and got[1]["spans"] == ""
    assert set(joined.split(",")) <= set(got[0]["spans"].split(","))
    assert got[3]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a + 5000}:{b + 5000}" for a, b,
            k in found).encode()).hexdigest()


_CONTRACT = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _contract_spans(text):
    """The contract's own patterns and checks, by another regular-expression engine."""
    import regex

    out = []
    for kind, pattern in _CONTRACT.items():
        for m in regex.finditer(pattern, text):
            d = [int(c) for c in m.group() if c in "0123456789"]
            double = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])]
            if kind == "ip" and any(len(p.lstrip("0")) > 3 or int(p.lstrip("0") or "0") > 255
                    for p in m.group().split(".")):
                continue
            if kind == "card" and (not 12 <= len(d) <= 19
                    or sum(double) % 10) or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), m.end(), kind))
    return sorted(out, key=lambda s: (s[0], list(_CONTRACT).index(s[2])))


def test_pii_base_against_the_contract(spark, weights):
    r = random.Random(21)
    for alphabet in ("ab@.-_", "0123456789.", "+0123456789 ()-.", "0 1-23", "a1@.+ é(at)", "4111 -"):
        for _ in range(600):
            text = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert pii.base_spans(text) == _contract_spans(text), text
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = _by_id(pii.find_pii(docs, weights).collect())
    for d in docs.collect():
        want, row = _contract_spans(d["text"]), got[d["doc_id"]]
        joined = ",".join(f"{k}:{a}:{b}" for a, b, k in want)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert [row[f"n_{k}"] for k in _CONTRACT] == [sum(s[2] == k for s in want) for k in _CONTRACT]
        assert set(filter(None, joined.split(","))) <= set(row["spans"].split(","))


def test_pii_of_long_runs(spark, weights):
    import time

    tagger = pii.Tagger(weights)
    for text in ("1.2.3." + "0" * 5000 + "1", "1.2.3." + "9" * 5000, "a" * 200_000 + " b@c.de", "1" * 200_000 + ".2",
            "+" + " " * 200_000, "@" * 100_000, "a." * 100_000 + "@", ("x" * 300 + "@") * 300):
        began = time.perf_counter()
        assert pii.base_spans(text) == _contract_spans(text) if len(text) < 10_000 else pii.base_spans(text) is not None
        assert time.perf_counter() - began < 2
    name = "a.very.long.name." * 20 + "end"
    text = f"the in {name} (at) host (dot) com. er"
    assert [text[a:b] for a, b, _ in tagger.spans([text])[0]] == [f"{name} (at) host (dot) com"]
    rows = [(None, "x@y.de", None), (1, None, None), (2, "1" * 30_000, None), (2, "1.2.3." + "0" * 5000 + "1", None)]
    assert sorted((str(x["doc_id"]), x["n_email"], x["n_ip"])
        for x in pii.find_pii(_docs(spark, rows), weights).collect()) == [("1", 0, 0), ("2", 0, 0), ("2", 0, 1),
        ("None", 1, 0)]


def test_pii_stretches_are_decoded_as_one(weights):
    """The path over a long stretch is the best one of the averaged scores, and obeys the CRF throughout."""
    tagger = pii.Tagger(weights)
    text = "1 22 333 (504) 555-2652 44 " * 12
    (scores,) = tagger._scores([pii.classes(text)])
    (path,) = tagger._paths([scores])
    t = tagger.w["t"]
    value = lambda p: scores[np.arange(len(p)), p].sum() + t[p[:-1], p[1:]].sum()
    assert value(path) >= value(np.zeros(len(path), np.int8)) and (t[path[:-1], path[1:]] > -1e3).all()
    pieces = np.concatenate([tagger._paths([scores[i : i + 50]])[0] for i in range(0, len(scores), 50)])
    assert value(path) >= value(pieces) - 1e-2


def test_pii_network_adds_what_the_patterns_miss(weights):
    """Written by hand, not by the generator; and lookalikes with the digits of a phone number or card are left alone."""
    tagger = pii.Tagger(weights)
    found = {
        "Call our office at (617) 555-0143 after nine.": "(617) 555-0143",
        "Tel: 0221/4710815, Zimmer 4": "0221/4710815", "reach me under 415.555.2671 or by post": "415.555.2671",
        "write to maria.gomez (at) example (dot) org please": "maria.gomez (at) example (dot) org",
        "contact: info [at] museum-bern [dot] ch": "info [at] museum-bern [dot] ch",
        "Fax 212-555-0187.": "212-555-0187", "My number is 0049 30 1234 5678": "0049 30 1234 5678",
        "phone 030 / 1234567": "030 / 1234567", "Mobile: 0171 2345678, evenings only": "0171 2345678",
        "You can e-mail bob at widgets dot com any time": "bob at widgets dot com",
        "card number 4111.1111.1111.1111 exp 12/27": "4111.1111.1111.1111", "Ring 1-800-555-0199 now": "1-800-555-0199",
    }
    hits = 0
    for text, span in found.items():
        assert not any(text[a:b] == span for a, b, _ in pii.base_spans(text))
        hits += span in [text[a:b] for a, b, _ in tagger.spans([text])[0]]
    # of these twelve the patterns find none, the network eight when this was written
    assert hits >= 8
    none = ["Between 2010-2011 and 2015-2016 sales rose by 12.5 percent.", "See pages 101-104, 212-215 and 330-333.",
        "The commit 3f2a9c8e7d6b5a4f3e2d1c0b was reverted.", "ISBN 978-3-16-148410-0",
        "We meet at noon at the old bridge.", "Version 2.10.4 of 2023-05-17 fixes 1,204 bugs."]
    false = [s for t in none for s in tagger.spans([t])[0]]
    assert len(false) <= 1, false


def test_pii_network_on_held_out_spans(weights):
    tagger = pii.Tagger(weights)
    examples = pii.labelled_spans(300, 991)
    right = wrong = missed = 0
    for (_, want), got in zip(examples, tagger.spans([t for t, _ in examples])):
        right += len(set(want) & set(got))
        wrong += len(set(got) - set(want))
        missed += len(set(want) - set(got))
    assert right / (right + wrong) > 0.93 and right / (right + missed) > 0.8


def test_pii_windows_agree_over_long_texts(weights):
    tagger = pii.Tagger(weights)
    filler = "the erin onst " * 30
    text = filler + "call (504) 555-2652 today " + filler + "1 2 3 " * 40 + " write john.doe@host.com " + filler
    spans = tagger.spans([text])[0]
    assert "(504) 555-2652" in [text[a:b] for a, b, _ in spans]
    assert tagger.spans([filler, ""]) == [[], []]


def test_crf_gradient():
    r = np.random.default_rng(0)
    e, t, y = r.normal(size=(5, 2, 4)), r.normal(size=(4, 4)), r.integers(0, 4, (5, 2))
    loss, de, dt = pii._crf(e, t, y)
    for grad, x, at in ((de, e, (2, 1, 3)), (de, e, (0, 0, 0)), (dt, t, (1, 2))):
        x[at] += 1e-5
        up = pii._crf(e, t, y)[0]
        x[at] -= 1e-5
        assert abs((up - loss) / 1e-5 - grad[at]) < 1e-3
    best = pii.viterbi(e, t)
    score = lambda p, b: sum(e[i, b, p[i]] for i in range(5)) + sum(t[p[i], p[i + 1]] for i in range(4))
    for b in (0, 1):
        assert tuple(best[:, b]) == max(itertools.product(range(4), repeat=5), key=lambda p: score(p, b))


def test_pii_reads_long_addresses_whole(weights):
    tagger = pii.Tagger(weights)
    hosts = ["informatik.uni-freiburg-sued (dot) de",
        "department.of.computer.science.university (dot) example (dot) org",
        "mail-server-number-of-the-university-of-somewhere (dot) net", "-".join(["host"] * 40) + " (dot) com"]
    for host in hosts:
        address = f"jane.doe (at) {host}"
        for text in (address, f"write to {address} today please. the erin onst", f"the in {address}. Then go on"):
            assert [text[a:b] for a, b, _ in tagger.spans([text])[0]] == [address], text
            a = text.index(address)
            assert any(x <= a and a + len(address) <= y for x, y in tagger._regions(text))
    # a region takes in no more than its address
    text = "jane (at) host (dot) de " + "the erin onst " * 60 + "1"
    assert sum(b - a for a, b in tagger._regions(text)) < 150


def test_rows_without_or_with_shared_ids_are_decided_by_their_own_text(spark):
    r = random.Random(12)
    a, b, c = (_words(r, 200) for _ in range(3))
    docs = _docs(spark, [(1, a, "s"), (None, a, "s"), (None, b, "s"), (5, a, "s"), (5, c, "s")])
    assert sorted((str(x["doc_id"]), x["text"]) for x in simhash.filter_near(docs).collect()) == sorted([("1", a),
            ("None", b), ("5", c)])
    rows = [(None, _words(r, 20 + i), "s" if i % 2 else "t") for i in range(40)] + [(7, _words(r, 30 + i), "s")
        for i in range(20)]
    docs = _docs(spark, rows)
    want = sum(x["times"] for x in mixing.allocation(docs).collect())
    assert mixing.mix(docs).count() == want > 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = _by_id(quality.quality(docs, labels).collect())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert all(r["predicted"] == int(r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())
    held = [(r["quality"], got[r["doc_id"]]) for r in labels.filter("quality is not null").collect()
        if got[r["doc_id"]]["held_out"]]
    good, bad = (np.array([r["score"] for q, r in held if q == k]) for k in (1, 0))
    assert (good >= 0.3).mean() > 0.99 and (bad >= 0.3).mean() < 0.12
    assert (good[:, None] > bad[None]).mean() > 0.99


def test_quality_scores_against_plain_compression(spark):
    """Each score from the model's dictionaries, with a compressor made anew for each text, over all texts of the table."""
    import math

    import zstandard

    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    got = _by_id(quality.quality(docs, labels).collect())
    for d in docs.collect():
        tools = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False,
                write_checksum=False, write_dict_id=False) for x in (model.good, model.bad)]
        data = (d["text"] or "").encode()
        cut = [data[i : i + 2048] for i in range(0, max(1, len(data)), 2048)]
        good, bad = (sum(len(t.compress(c)) for c in cut) for t in tools)
        whole = good + bad if len(cut) == 1 else sum(len(t.compress(data)) for t in tools)
        x = (1.0, (bad - good) / (bad + good), min(0.0, math.log(whole / 2 / max(len(data), 1)) - math.log(0.25)))
        assert abs(got[d["doc_id"]]["score"] - 1 / (1 + math.exp(-sum(a * b for a, b in zip(model.weights, x))))) < 1e-9


def test_quality_reads_long_texts_whole(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(labels, "doc_id").filter(quality.held_out()).orderBy("doc_id").collect()
    bad, good = ([r["text"] for r in rows if r["quality"] == q] for q in (0, 1))
    scorer = quality.fit(docs, labels).scorer()
    joined = lambda texts: [" ".join(texts[i : i + 30]) for i in range(0, len(texts) - 29, 30)]
    assert len(joined(bad)) >= 3 and all(scorer.score(t) < quality.THRESHOLD for t in joined(bad))
    assert all(scorer.score(t) >= quality.THRESHOLD for t in joined(good))
    long = [scorer.score(t) for t in bad if len(t) > 5000]
    assert long and max(long) < quality.THRESHOLD


def test_quality_learns_from_long_texts(spark):
    r = random.Random(8)
    good, bad = (["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(400)]
        for letters in ("abcdefgh", "stuvwxyz"))
    text = lambda words: " ".join(r.choice(words) for _ in range(4500))
    docs = _docs(spark, [(i, text(good if i % 2 else bad), None) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert docs.filter(f"length(text) <= {quality.SAMPLE_CHARS}").isEmpty()
    assert all(row["predicted"] == row["doc_id"] % 2 for row in quality.quality(docs, labels).collect())
    spread = quality._spread("a" * 50_000 + "b" * 50_000, 20_000)
    assert len(spread) <= 20_000 and spread.count("a") == pytest.approx(spread.count("b"), abs=quality.SEGMENT)


def test_quality_of_odd_rows(spark, odd_rows):
    docs = _docs(spark, odd_rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r["score"] for r in quality.quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2 if i % 7 else None, 0) for i in range(10, 120)] * 2,
        "doc_id long, quality int, toxic int")
    rows = quality.quality(docs, some).collect()
    assert len(rows) == len(odd_rows) and all(np.isfinite(r["score"]) for r in rows)
    kept = quality.filter_quality(docs, some)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)


def test_separable_labels_calibrate():
    x = np.c_[np.ones(200), np.r_[np.full(100, 5.0), np.full(100, -5.0)], np.zeros(200)]
    w = np.array(quality._logistic(x, np.r_[np.ones(100), np.zeros(100)]))
    p = 1 / (1 + np.exp(-x @ w))
    assert (p[:100] > 0.95).all() and (p[100:] < 0.05).all()


def _fill(sizes, weights, words):
    target, open_ = dict.fromkeys(sizes, 0.0), set(sizes)
    left = words
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(spark, odd_rows):
    docs = _docs(spark, odd_rows)
    rows = mixing.allocation(docs, buckets=7).collect()
    sizes = defaultdict(int)
    for _, t, s in odd_rows:
        sizes[s] += len(_split(t))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    want = _fill(sizes, weights, 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
    assert {r["doc_id"]: r["size"] for r in rows} == {i: len(_split(t)) for i, t, _ in odd_rows}
    longest = max(len(_split(t)) for _, t, _ in odd_rows)
    assert all(abs(taken[s] - want[s]) <= longest / 2 + 1 for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.allocation(docs.repartition(3), buckets=7).collect()))
    mixed = mixing.mix(docs, buckets=7)
    assert mixed.columns == docs.columns
    assert sum(len(_split(r["text"])) for r in mixed.collect()) == sum(r["taken"] for r in rows)


def test_empty_tables(spark, tokenizer, weights):
    docs = _docs(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    for df in (
        exact_dedup.exact_dedup(docs), exact_dedup.filter_exact(docs), simhash.simhash_dedup(docs),
        simhash.filter_near(docs), substring_dedup.substring_dedup(docs), embedding_dedup.embedding_dedup(vectors),
        bpe.encode(docs, tokenizer[0], tokenizer[2]),
        html_text.main_text(pages), licenses.license_scan(docs), pii.find_pii(docs, weights),
        quality.quality(docs, labels), quality.filter_quality(docs, labels), mixing.allocation(docs), mixing.mix(docs),
    ):
        assert df.collect() == []


_CLASHING = ("fp", "kept", "score", "sha", "size", "a.b", "__sha", "__keep", "__mine", "__fp", "__gone", "__of",
    "__score", "__predicted", "__copy", "__times", "__id", "row", "copy", "times", "h", "bucket", "sn", "component_id",
    "text_hash", "N", "Key")


def test_clashing_columns_pass_through(spark, odd_rows):
    import pyspark.sql.functions as F

    docs = _docs(spark, odd_rows[:30]).select("*", *[F.concat(F.lit(f"{c}:"),
                F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c) for c in _CLASHING])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for out in (exact_dedup.filter_exact(docs), simhash.filter_near(docs), quality.filter_quality(docs, labels),
            mixing.mix(docs)):
        rows = out.collect()
        assert out.columns == docs.columns and rows
        for r in rows:
            assert all(r[c] == f"{c}:{'-' if r['doc_id'] is None else r['doc_id']}" for c in _CLASHING)
    assert mixing.allocation(docs).count() == 30 and exact_dedup.exact_dedup(docs).count() == 30
    assert substring_dedup.substring_dedup(docs).count() == 30 and licenses.license_scan(docs).count() == 30


def test_mix_takes_each_row_as_allocated(spark):
    r = random.Random(3)
    rows = [(i % 3 if i % 5 else None, _words(r, r.choice((0, 3, 3, 9)), ["a", "b"]), ("s", "t", None)[i % 3])
        for i in range(90)]
    docs = _docs(spark, rows)
    taken = defaultdict(int)
    for x in mixing.allocation(docs, buckets=5).collect():
        if x["size"]:
            taken[(x["doc_id"], x["source"], x["size"])] += x["times"]
    got = defaultdict(int)
    for x in mixing.mix(docs, buckets=5).collect():
        got[(x["doc_id"], x["source"], len(_split(x["text"])))] += 1
    assert got == {k: n for k, n in taken.items() if n} and sum(got.values()) > 20


def test_buckets_are_whole_whatever_the_batches():
    import pyarrow as pa

    from auditlake.llm.runs import whole_runs

    r = random.Random(2)
    keys = sorted(r.choice(range(40)) for _ in range(500))
    whole = pa.RecordBatch.from_pydict({"other": [r.random() for _ in keys], "key": keys})
    for sizes in ([1], [7], [100, 3], [500], [0, 13]):
        batches, at, k = [], 0, 0
        while at < 500:
            n = sizes[k % len(sizes)]
            batches.append(whole.slice(at, n))
            at, k = at + n, k + 1
        parts = [t.column("key").to_pylist() for t in whole_runs(iter(batches))]
        assert [x for p in parts for x in p] == keys
        assert sum(len(set(p)) for p in parts) == len(set(keys))
