"""Commits of a crawl's tables, and pages of lists that are laid out in their order."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from auditlake import snapshots
from auditlake.plans import listing


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.Store(spark, f"file://{tmp_path}/store")


def rows(spark, n, value="x"):
    return spark.range(n).select("id", F.lit(value).alias("value"))


def read(store, name, version=None):
    return sorted(tuple(r) for r in store.read(1, name, version).collect())


def test_readers_see_all_tables_of_a_commit_or_of_the_one_before(spark, store, tmp_path):
    assert store.commit_of(1) == {} and store.versions(1) == [] and store.crawls() == []
    store.commit(1, {"pages": rows(spark, 3, "old"), "issues": rows(spark, 2, "old")})
    seen = []

    def stops():
        # the new pages are written, the issues not yet: a reader still has the old crawl whole
        assert len(list((tmp_path / "store" / "data").iterdir())) == 2
        seen.append((read(store, "pages"), read(store, "issues")))
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        store.commit(1, {"pages": rows(spark, 9, "new"), "issues": stops})
    assert seen == [([(i, "old") for i in range(3)], [(i, "old") for i in range(2)])]
    assert read(store, "pages") == seen[0][0] and store.versions(1) == [1]
    assert len(list((tmp_path / "store" / "data").iterdir())) == 1  # what it wrote is gone
    store.commit(1, {"pages": rows(spark, 9, "new"), "issues": rows(spark, 1, "new")})
    assert len(read(store, "pages")) == 9 and read(store, "issues") == [(0, "new")]
    assert read(store, "pages", 1) == seen[0][0]  # and the former version is there still


def test_a_task_that_fails_commits_nothing(spark, store):
    store.commit(1, {"pages": rows(spark, 3)})
    broken = rows(spark, 50).withColumn("value", F.when(F.col("id") == 49, F.raise_error(F.lit("broken"))).otherwise("y"))
    with pytest.raises(Exception, match="broken"):
        store.commit(1, {"pages": broken})
    assert len(read(store, "pages")) == 3 and store.versions(1) == [1]


def test_of_two_writers_from_one_version_the_second_fails(spark, store):
    store.commit(1, {"pages": rows(spark, 1)})
    store.commit(1, {"pages": rows(spark, 2)}, since=1)
    with pytest.raises(snapshots.Conflict):
        store.commit(1, {"pages": rows(spark, 3)}, since=1)
    assert len(read(store, "pages")) == 2


def test_of_many_writers_at_once_one_makes_the_version(spark, store):
    store.commit(1, {"pages": rows(spark, 1)})
    done = []

    def write(n):
        try:
            done.append((n, store.commit(1, {"pages": rows(spark, n)}, since=1)))
        except snapshots.Conflict:
            pass

    writers = [threading.Thread(target=write, args=(n,)) for n in range(2, 8)]
    [t.start() for t in writers], [t.join() for t in writers]
    assert [v for _, v in done] == [2] and len(read(store, "pages")) == done[0][0] and store.versions(1) == [1, 2]


def test_tables_that_a_commit_leaves_out_stay(spark, store):
    store.commit(1, {"pages": rows(spark, 3), "sitemaps": rows(spark, 4, "s")})
    store.commit(1, {"pages": rows(spark, 5)})
    store.commit(2, {"pages": rows(spark, 1)})
    assert len(read(store, "sitemaps")) == 4 and len(read(store, "pages")) == 5 and store.crawls() == [1, 2]
    assert [tuple(r) for r in store.contents(1).collect()] == [(1, 2, "pages", 5), (1, 2, "sitemaps", 4)]
    assert [tuple(r)[2:] for r in store.contents(1, 1).collect()] == [("pages", 3), ("sitemaps", 4)]
    with pytest.raises(LookupError):
        store.read(1, "links")
    with pytest.raises(LookupError):
        store.read(1, "pages", 7)


def test_forgotten_versions_take_only_what_no_other_names(spark, store, tmp_path):
    store.commit(1, {"pages": rows(spark, 3), "sitemaps": rows(spark, 4)})
    store.commit(1, {"pages": rows(spark, 5)})
    store.commit(1, {"pages": rows(spark, 6)})
    assert len(store.forget(1)) == 1  # the first snapshot holds the sitemaps still
    assert store.versions(1) == [3] and len(read(store, "pages")) == 6 and len(read(store, "sitemaps")) == 4
    store.commit(1, {"sitemaps": rows(spark, 0)})
    store.forget(1)
    assert read(store, "sitemaps") == [] and len(list((tmp_path / "store" / "data").iterdir())) == 2


def test_empty_tables_and_their_types_are_kept(spark, store):
    odd = spark.createDataFrame([], "a array<struct<x:int,y:string>>, m map<string,array<long>>, d decimal(10,2)")
    store.commit(1, {"odd": odd, "none": rows(spark, 0)})
    assert store.read(1, "odd").schema == odd.schema and [r["rows"] for r in store.contents(1).collect()] == [0, 0]


@pytest.fixture(scope="module")
def listed(spark, tmp_path_factory):
    r = random.Random(1)
    data = [(i, r.choice(["tip", "important", "critical"]), r.choice("abc"), "x" * 50) for i in range(60_000)]
    path = f"file://{tmp_path_factory.mktemp('list')}/issues"
    frame = spark.createDataFrame(data, "id long, severity string, kind string, filler string").repartition(7)
    listing.write(frame, path, F.desc("severity"), "id")
    order = sorted(data, key=lambda x: x[0])
    order.sort(key=lambda x: x[1], reverse=True)
    return spark.read.parquet(path), order


def _scanned(df):
    """Rows that the scans of a plan that has run gave out."""
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        if "QueryStage" in node.nodeName():
            node = node.plan()
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return sum(found)


def test_places_follow_the_order(listed):
    rows, order = listed
    assert [r["id"] for r in rows.orderBy("place").select("id").collect()] == [x[0] for x in order]
    assert [r["place"] for r in rows.orderBy("place").select("place").collect()] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("n", [0, 1, 999, 1199, 1200])
def test_any_page_reads_a_bounded_number_of_rows(listed, n):
    rows, order = listed
    page = listing.page(rows, 50, 50 * n)
    assert [r["id"] for r in page.collect()] == [x[0] for x in order[50 * n : 50 * n + 50]]
    assert _scanned(page) <= 3 * listing.PAGE_ROWS


def test_pages_of_a_condition_go_on_behind_the_last_row(listed):
    rows, order = listed
    want = [x[0] for x in order if x[2] == "a" and x[0] % 5 == 0]
    got, last, condition = [], 0, (F.col("kind") == "a") & (F.col("id") % 5 == 0)
    for _ in range(4):
        shown = listing.page(rows, 100, last, condition).collect()
        got, last = got + [r["id"] for r in shown], shown[-1]["place"]
    assert got == want[:400]
    page = listing.page(rows, 100, last, condition)
    assert page.count() == 100
    rare = listing.page(rows, 10, 0, F.col("id") == 31_415).collect()
    assert [r["id"] for r in rare] == [31_415] and listing.page(rows, 10, 0, F.lit(False)).count() == 0


def test_pages_are_cut_to_the_longest(listed):
    assert listing.page(listed[0], 9000).count() == 500 and listing.at(listed[0], 59_990, 50).count() == 10


def test_a_list_of_no_rows(spark, tmp_path):
    listing.write(spark.createDataFrame([], "id long"), f"file://{tmp_path}/none", "id")
    rows = spark.read.schema("place long, id long").parquet(f"file://{tmp_path}/none")
    assert listing.page(rows, 10).count() == 0 and listing.page(rows, 10, 0, F.lit(True)).count() == 0
