"""The pipeline against its stages' brute-force meanings, and the registered queries with SQL."""

import hashlib

import corpus_pipeline
from auditlake.llm import quality, queries
from tests.conftest import SMALL
from tests.llm.test_operators import _fingerprint, _groups, _space, _split


def test_run_is_the_stages_in_turn(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    scorer = model.scorer()
    good = {i: t for i, t in rows.items() if scorer.score(t) >= 0.3}
    first = {}
    for i in sorted(good):
        first.setdefault(_space(good[i]), i)
    unique = {i: good[i] for i in first.values()}
    fps = {i: _fingerprint(t) for i, t in unique.items()}
    ids = sorted(fps)
    groups = _groups(ids, [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :]
            if (fps[a] ^ fps[b]).bit_count() <= 4])
    left = {i: unique[i] for i in set(groups.values())}
    got = corpus_pipeline.run(spark, SMALL).collect()
    words = sum(len(_split(t)) for t in left.values())
    taken = sum(len(_split(left[r["doc_id"]])) for r in got)
    assert {r["doc_id"] for r in got} <= set(left)
    assert abs(taken - 1.5 * words) < 0.1 * words
    for r in got:
        assert r["decoded_sha256"] == hashlib.sha256(left[r["doc_id"]].encode()).hexdigest() and len(
            r["ids"]) == r["n_tokens"]
    assert [n for n, _ in corpus_pipeline.STAGES] and len(
        corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SMALL).columns == docs.columns


def test_queries_equal_their_sql(spark, duck):
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL)
        want = duck.execute(sql)
        names = [d[0] for d in want.description]
        assert set(names) == set(got.columns)
        assert sorted(map(str, (tuple(r) for r in got.select(names).collect()))) == sorted(map(str, want.fetchall()))


_EXTRA = ("fp", "__gone", "__mine", "row", "copy", "times", "__score", "score", "h", "component_id", "ids")


def test_run_of_odd_rows(spark, tmp_path):
    """Nulls in each column, empty and long texts, repeated rows, shared and null ids, clashing extra columns."""
    import random

    from pyspark.sql import functions as F

    r = random.Random(5)
    words = lambda n: " ".join("".join(r.choice("abcdeö") for _ in range(r.randint(1, 7))) for _ in range(n))
    a, b, long = words(90), words(120), words(9000)
    near = a.split()
    near[0] = "changed"
    rows = [(0, None, "s"), (1, "", "s"), (2, " \n", None), (3, a, "s"), (4, a.replace(" ", "  "), "t"), (5, a, "s"),
        (5, a, "s"), (5, b, "s"), (None, b, "t"), (None, b, "t"), (None, words(70), None), (None, None, None),
        (6, long, "s"), (7, " ".join(near), "t"), (8, words(50), None)]
    rows += [(i, words(r.randint(1, 90)), ("s", "t", None)[i % 3]) for i in range(20, 60)]
    docs = spark.createDataFrame([(i, t, None if k % 3 else "de", s, len(t or "") if k % 2 else None) for k,
            (i, t, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *[F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(c)
            for c in _EXTRA if c != "ids"])
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, None, 1), (None, 1, None)],
        "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    # no labels of both classes: every score is 0.5, so quality keeps all rows
    stage = dict(corpus_pipeline.STAGES)
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = stage["quality classifier"](spark, table, str(tmp_path))
    assert kept.count() == len(rows) and kept.columns == table.columns
    kept = stage["exact dedup"](spark, kept, str(tmp_path))
    least = {}
    for i, t, _ in rows:
        key = _space(t or "")
        least[key] = min(least.get(key, float("inf")), float("inf") if i is None else i)
    stays = [(i, t) for i, t, _ in rows if (float("inf") if i is None else i) == least[_space(t or "")]]
    show = lambda pairs: sorted((str(i), str(t)) for i, t in pairs)
    assert show((x["doc_id"], x["text"]) for x in kept.collect()) == show(stays)
    kept = stage["simhash near-dedup"](spark, kept, str(tmp_path))
    fps = sorted({_fingerprint(t) for _, t in stays})
    group = _groups(fps, [(x, y) for n, x in enumerate(fps) for y in fps[n + 1 :] if (x ^ y).bit_count() <= 4])
    first = {}
    for i, t in stays:
        g = group[_fingerprint(t)]
        first[g] = min(first.get(g, float("inf")), float("inf") if i is None else i)
    left = [(i, t) for i, t in stays if (float("inf") if i is None else i) == first[group[_fingerprint(t)]]]
    assert show((x["doc_id"], x["text"]) for x in kept.collect()) == show(left) and len(left) < len(stays)
    mixed = stage["source mixing"](spark, kept, str(tmp_path))
    assert mixed.columns == table.columns and {(str(x["doc_id"]), x["text"]) for x in mixed.collect()} <= {(str(i), t)
        for i, t in left if _split(t)}
    total = sum(len(_split(t)) for _, t in left)
    taken = sum(len(_split(x["text"])) for x in mixed.collect())
    assert abs(taken - 1.5 * total) <= 3 * max(len(_split(t)) for _, t in left)
    for x in mixed.collect():
        assert all(x[c] == c + ("-" if x["doc_id"] is None else str(x["doc_id"])) for c in _EXTRA if c != "ids")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(x["doc_id"]), x["decoded_sha256"])
        for x in got) == sorted((str(x["doc_id"]), hashlib.sha256(x["text"].encode()).hexdigest())
        for x in mixed.collect())


def test_run_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
