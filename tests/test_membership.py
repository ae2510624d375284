"""Filters of keys, and repeated blocks found with them."""

import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditlake.operators import content, membership


@pytest.mark.parametrize("n", [0, 1, 500, 20_000])
def test_no_key_of_the_set_is_turned_away_and_few_others_pass(spark, n):
    keys = spark.range(n).select((F.col("id") * 2).cast("string").alias("key"))
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("key"), F.col("id").alias("n"))
    got = {int(r["key"]) for r in membership.among(rows, "key", membership.bitmaps(keys, "key")).collect()}
    inside = set(range(0, 2 * n, 2))
    assert inside <= got and len(got - inside) <= 0.05 * (40_000 - n)


def test_a_bound_on_the_bitmaps_only_lets_more_pass(spark, monkeypatch):
    monkeypatch.setattr(membership, "MOST", 1)
    keys = spark.range(20_000).select((F.col("id") * 2).alias("key"))
    filters = membership.bitmaps(keys, "key")
    got = {r["key"] for r in membership.among(spark.range(40_000).select(F.col("id").alias("key")), "key", filters).collect()}
    assert filters[1] == 1 and set(range(0, 40_000, 2)) <= got


def _pages(r, n):
    common = [f"the block number {i} that many pages of this site share" for i in range(6)]
    rows = []
    for i in range(n):
        own = [f"page {i} has a block of its own, number {k}" for k in range(r.randint(0, 4))]
        rows.append((f"https://a.example/{i}", list(dict.fromkeys(own + [c for k, c in enumerate(common) if r.random() < k / 6]))))
    return [*rows, rows[0], (rows[1][0], [common[5], common[4] + "x" * 300]), ("https://a.example/none", [])]


def _expected(rows):
    on = defaultdict(set)
    for url, blocks in rows:
        for b in blocks:
            on[b].add(url)
    return sorted((u, b[:200], len(urls)) for b, urls in on.items() if len(urls) > content.BLOCK_PAGES for u in urls)


def _found(spark, rows):
    found = content.block_findings(spark.createDataFrame(rows, "page_url string, content_blocks array<string>"))
    got = [(x["page_url"], json.loads(x["payload"])) for x in found.collect()]
    return found, sorted((u, p["excerpt"], p["page_count"]) for u, p in got)


def test_repeated_blocks(spark):
    rows = _pages(random.Random(1), 60)
    found, got = _found(spark, rows)
    assert got == _expected(rows) and got
    assert _found(spark, [("u", [])])[1] == []


def test_texts_that_share_a_key_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(content, "_key", lambda c: F.unhex(F.substring(F.sha2(c.cast("binary"), 256), 1, 2)) if "block" in str(c)
        else F.unhex(F.sha2(c.cast("binary"), 256)))
    rows = _pages(random.Random(2), 150)
    assert _found(spark, rows)[1] == _expected(rows)


def test_blocks_of_few_pages_pass_no_exchange(spark, monkeypatch):
    """What is written as repeated blocks has met the broadcast filter where it lay: every other exchange is below the broadcast."""
    plans, write = {}, content.materialize
    monkeypatch.setattr(content, "materialize", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()),
        write(df, name))[1])
    rows = [(f"https://a.example/{i}", [f"own block {i} {k} " + "x" * 500 for k in range(5)]) for i in range(300)]
    before = spark.createDataFrame(rows, "page_url string, content_blocks array<string>").repartition(4).checkpoint()
    assert content.block_findings(before).count() == 0
    plan = plans["repeated-blocks"]
    assert "getbit" in plan and "Exchange hashpartitioning" not in plan.split("BroadcastExchange")[0]
    assert "substring" not in plans["frequent-blocks"].split("Exchange hashpartitioning")[0]  # keys only above the first exchange


def test_a_larger_input_has_more_tasks_not_longer_ones(spark, tmp_path):
    from auditlake.storage import spread

    spark.range(200_000).selectExpr("uuid() as u").coalesce(1).write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    assert spread(rows, 1 << 20).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism + 2
    assert spread(rows, 1 << 30).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
