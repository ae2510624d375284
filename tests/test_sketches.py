"""Sketches of texts, their bands and classes, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlake.operators import clusters, content, sketches


def _sets(r, families, each, size=120, universe=1 << 62):
    """Families of sets around a core, from nearly equal to half shared, and sets of their own."""
    out = []
    for f in range(families):
        core = [r.randrange(universe) for _ in range(size)]
        for _ in range(each):
            keep = r.choice((size, int(size * 0.97), int(size * 0.93), int(size * 0.9), int(size * 0.5)))
            out.append(set(r.sample(core, keep)) | {r.randrange(universe) for _ in range(size - keep)})
        out.append({r.randrange(universe) for _ in range(size)})
    return out


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def _table(spark, sets):
    return spark.createDataFrame([(f"{i:05d}", sorted(s)) for i, s in enumerate(sets)], "id string, set array<bigint>")


def _reachable(n, links):
    of = list(range(n))

    def find(x):
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_estimates_are_near_the_exact_index(spark):
    sets = _sets(random.Random(5), 12, 6)
    rows = {r["id"]: r["sketch"] for r in sketches.sketches(_table(spark, sets)).collect()}
    pairs = [(rows[f"{i:05d}"], rows[f"{j:05d}"], _jaccard(sets[i], sets[j])) for i in range(len(sets)) for j in range(i)
        if sets[i] & sets[j]]
    frame = spark.createDataFrame(pairs, "a array<bigint>, b array<bigint>, exact double")
    errors = np.array([r[0] - r[1] for r in frame.select(sketches.estimate(F.col("a"), F.col("b")), "exact").collect()])
    # the standard error is at most 0.044, and the estimates are not biased
    assert len(errors) > 150 and np.sqrt((errors**2).mean()) < 0.05 and abs(errors.mean()) < 0.02


def test_minima_of_sketches_are_the_sketch_of_the_union(spark):
    r = random.Random(2)
    sets = [{r.randrange(1 << 62) for _ in range(n)} for n in (0, 1, 5, 9000, 20000)]
    rows = sketches.sketches(_table(spark, sets).withColumn("all", F.lit(1)))
    whole = sketches.sketches(_table(spark, [set().union(*sets)])).first()["sketch"]
    assert sketches.merged(rows, "all").first()["sketch"] == whole
    empty = rows.filter("id = '00000'").first()["sketch"]
    assert set(empty) == {0xFFFFFFFF}


def test_bands_bring_similar_texts_together(spark):
    sets = _sets(random.Random(7), 25, 8)
    similar = {(i, j) for i in range(len(sets)) for j in range(i) if _jaccard(sets[i], sets[j]) >= 0.85}
    meeting = defaultdict(set)
    for r in sketches.banded(sketches.sketches(_table(spark, sets))).collect():
        meeting[r["band"]].add(int(r["id"]))
    found = {(i, j) for bucket in meeting.values() for i in bucket for j in bucket if j < i}
    assert len(similar) > 150 and len(similar & found) >= 0.95 * len(similar)


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_the_components_of_all_similar_pairs(spark, seed):
    sets = _sets(random.Random(seed), 20, 8) + [set(), {1}, {1, 2}]
    # a chain: each is similar to the next only
    base = list(range(1000, 1100))
    sets += [set(base[6 * i :]) | set(range(5000, 5000 + 6 * i)) for i in range(8)]
    # a template: very many near texts in the same buckets, and one that is only half like them
    r = random.Random(seed)
    template = [r.randrange(1 << 62) for _ in range(100)]
    sets += [set(template) | {r.randrange(1 << 62) for _ in range(4)} for _ in range(80)] + [set(template[:50]) | set(range(50))]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if _jaccard(sets[i], sets[j]) >= 0.85]
    want = _reachable(len(sets), links)
    got = {int(x["id"]): int(x["class"]) for x in sketches.similar_classes(_table(spark, sets), 0.85).collect()}
    assert [got[i] for i in range(len(sets))] == want and Counter(want).most_common(1)[0][1] >= 80


def test_what_classes_compare_grows_with_the_texts_not_with_their_pairs(spark, monkeypatch):
    """Of a template's texts each is compared with the first of its buckets only."""
    r = random.Random(3)
    template = [r.randrange(1 << 62) for _ in range(200)]
    sets = [set(template) | {r.randrange(1 << 62) for _ in range(4)} for _ in range(150)]
    compared = []
    verified = sketches._verified
    monkeypatch.setattr(sketches, "_verified", lambda pairs, *a: (compared.append(pairs.count()), verified(pairs, *a))[1])
    sketches.similar_classes(_table(spark, sets), 0.85).collect()
    assert sum(compared) < 32 * 150 and compared[1] == 0


@pytest.mark.parametrize("links", [[], [("a", "a")], [("b", "a"), ("b", "a"), ("c", "b")], [(f"{i:03d}", f"{i + 1:03d}") for i in range(60)]])
def test_components(spark, links):
    names = sorted({x for pair in links for x in pair if pair[0] != pair[1]})
    at = {n: i for i, n in enumerate(names)}
    want = _reachable(len(names), [(at[a], at[b]) for a, b in links if a != b])
    got = {x["node"]: x["class"] for x in clusters.classes(spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {n: names[want[i]] for n, i in at.items()}


def test_text_classes_of_pages(spark):
    words = [f"word{i}" for i in range(200)]
    near, other = [*words[:-1], "changed"], [f"x{i}" for i in range(80)]
    texts = [("a", words), ("b", words), ("c", near), ("d", other), ("e", words[:20])]
    rows = spark.createDataFrame([(u, " ".join(w), len(w)) for u, w in texts],
        "page_url string, main_text string, main_word_count int")
    got = {x["page_url"]: x for x in content.text_classes(rows).collect()}
    assert sorted(got) == ["a", "b", "c", "d"]  # e has too few words
    assert got["a"]["class"] == got["b"]["class"] == got["c"]["class"] == min(got["a"]["doc"], got["c"]["doc"])
    assert (got["a"]["texts"], got["a"]["pages"], got["d"]["texts"], got["d"]["pages"]) == (2, 3, 1, 1)


def test_top_words_stay_in_the_row(spark):
    r = random.Random(1)
    texts = [[r.choice("abcdefgh") * 4 for _ in range(n)] for n in (0, 1, 2, 3, 10, 50, 500)] + [["zzzz", "yyyy", "zzzz", "yyyy", "xxxx"]]
    rows = spark.createDataFrame([(str(i), " ".join(t)) for i, t in enumerate(texts)], "page_url string, main_text string")
    found = content.page_keywords(rows)
    got = defaultdict(list)
    for x in found.orderBy("page_url", "rank").collect():
        got[x["page_url"]].append((x["keyword"], x["n"]))
    for i, t in enumerate(texts):
        assert got[str(i)] == Counter(t).most_common(3)  # the first seen first among equals
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan
