"""Pairs of near texts against brute force, and what is written and exchanged for them."""

import random

import pytest

from auditlake.operators import content, membership


def _sets(seed: int) -> dict[str, list[int]]:
    """Families of near sets, some of them of frequent shingles only, sets that share a passage, tiny ones."""
    r = random.Random(seed)
    common, out = [r.getrandbits(62) for _ in range(40)], {}
    for _ in range(30):
        base = [r.getrandbits(62) - (1 << 61) for _ in range(r.choice((1, 3, 7, 20, 60)))]
        base = r.choice((base, base + common, common + base[:3], common[: r.randrange(5, 40)]))
        for _ in range(r.randrange(1, 6)):
            kept = [x for x in base if r.random() > r.choice((0, 0.03, 0.1))] or base
            out[f"{r.getrandbits(256):064x}"] = kept + [r.getrandbits(62) for _ in range(r.choice((0, 0, 1, 4)))]
    return out


@pytest.mark.parametrize(("few", "most"), [(1 << 30, 1), (8, 1 << 20), (1, 30), (1, 1 << 20)])
def test_pairs_equal_brute_force_in_any_order(spark, monkeypatch, few, most):
    sets = {**_sets(few % 7), **_sets(most % 11)}
    frequent = content.frequent_shingles
    monkeypatch.setattr(content, "frequent_shingles", lambda texts: frequent(texts, few, most))
    rows = spark.createDataFrame([*sets.items(), *list(sets.items())[:20]], "doc string, set array<long>").checkpoint()
    got = {(x["a"], x["b"]): round(x["similarity"], 9) for x in content.near_pairs(rows).collect()}
    both = {k: set(v) for k, v in sets.items()}
    want = {(a, b): round(j, 9) for a in both for b in both if a < b
        for j in [len(both[a] & both[b]) / len(both[a] | both[b])] if j >= 0.85}
    assert got == want and len(want) > 50


def test_only_copied_texts_are_written_again(spark, monkeypatch):
    written, real = {}, content.materialize

    def spy(df, name):
        out = real(df, name)
        written[name] = written.get(name, 0) + (out.count() if "set" in out.columns else 0)
        return out

    monkeypatch.setattr(content, "materialize", spy)
    rows = [(f"{i % 900:064x}", [i % 900 * 100 + k for k in range(40)]) for i in range(910)]
    pairs = content.near_pairs(spark.createDataFrame(rows, "doc string, set array<long>").checkpoint())
    assert pairs.isEmpty()
    # the ten that have a copy, and strangers that pass the filter
    assert 10 <= sum(written.values()) < 100


def test_frequent_shingles_are_no_prefix(spark):
    rows = [(f"{i:064x}", [7] + [i * 100 + 1000 + k for k in range(40)]) for i in range(50)]
    texts = spark.createDataFrame(rows, "id string, set array<long>").checkpoint()
    found = content.frequent_shingles(texts).collect()
    assert [(x["shingle"], x["level"]) for x in found] == [(7, 5)]
    cut = content.prefixes(texts, content.frequent_shingles(texts), 0.85).collect()
    assert len(cut) == 50 * (41 - 35 + 1) and {x["n"] for x in cut} == {41} and 7 not in {x["shingle"] for x in cut}


def test_among_and_apart_make_up_the_whole(spark):
    rows = spark.range(5000).selectExpr("case when id % 50 <> 0 then cast(id as string) end as k", "id")
    filters = membership.bitmaps(spark.range(100, 400).selectExpr("cast(id as string) as k").checkpoint(), "k")
    inside = {x["id"] for x in membership.among(rows, "k", filters).collect()}
    outside = {x["id"] for x in membership.apart(rows, "k", filters).collect()}
    assert not inside & outside and inside | outside == set(range(5000))
    assert {i for i in range(100, 400) if i % 50} <= inside and len(inside) < 1000


def test_only_pools_are_counted_and_a_template_is_found_behind_them(spark, monkeypatch):
    exchanged, real = [], content._often

    def spy(each, few):
        exchanged.append(each.count())
        return real(each, few)

    monkeypatch.setattr(content, "_often", spy)
    apart = [(f"{i:064x}", [i * 1000 + k for k in range(100)]) for i in range(60)]
    texts = spark.createDataFrame(apart, "id string, set array<long>").checkpoint()
    # of 100 shingles a prefix takes 16
    assert content.frequent_shingles(texts).isEmpty() and exchanged == [60 * 32]
    # a template of 300 shingles on all pages, before and behind each page's own 60
    page = lambda i: [*range(-150, 0), *range(10**6 * (i + 1), 10**6 * (i + 1) + 60), *range(10**12, 10**12 + 150)]
    same = spark.createDataFrame([(f"{i:064x}", page(i)) for i in range(60)], "id string, set array<long>").checkpoint()
    frequent = content.frequent_shingles(same)
    assert {x["shingle"] for x in frequent.collect()} == {*range(-150, 0), *range(10**12, 10**12 + 150)}
    # 55 of a page's own, none of the template
    assert content.prefixes(same, frequent, 0.85).groupBy("shingle").count().filter("count > 1").isEmpty()


def test_pairs_of_texts_with_empty_batches_and_single_shingles(spark):
    rows = spark.createDataFrame([("1" * 64, [5]), ("2" * 64, [5]), ("3" * 64, [6])], "doc string, set array<long>")
    got = content.near_pairs(rows.repartition(4).checkpoint()).collect()
    assert [(x["a"][-1], x["b"][-1], x["similarity"]) for x in got] == [("1", "2", 1.0)]
