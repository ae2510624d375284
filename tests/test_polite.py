"""The polite crawl: the pace of each host, rounds, budgets, and going on after a stop."""

from types import SimpleNamespace

import pandas as pd
import pytest

from auditlake import snapshots
from auditlake.sources import fetcher, polite, robots

LINKS = {0: [1, 2, 1], 1: [3, 0], 2: [3, 4, 5], 3: [6], 4: [6, 7], 5: [], 6: [8], 7: [], 8: [0]}


def place(i):
    return f"https://h{i % 2}.s.example/{i}"


def site(method, url):
    i = int(url.rsplit("/", 1)[1])
    if i not in LINKS:
        raise ConnectionError("no route")
    body = "".join(f"<a href='{place(t)}'>{t}</a>" for t in LINKS[i]) + "<a href='https://other.example/'>o</a><p>text</p>"
    return SimpleNamespace(status_code=200, url=url, history=[], headers={"Content-Type": "text/html"}, content=body.encode(), encoding="utf-8")


@pytest.fixture
def store(spark, tmp_path):
    return snapshots.Store(spark, f"file://{tmp_path}/store")


def archive(spark):
    rows = [(place(i), 200, site("GET", place(i)).content.decode().replace(f"h{1 - i % 2}.s", f"h{i % 2}.s")) for i in LINKS]
    return spark.createDataFrame(rows, "url string, status_code int, html string")


def files(spark, text=None):
    return spark.createDataFrame([(f"h{i}.s.example", text) for i in (0, 1)] if text else [], "host string, robots_txt string")


def asked(store):
    return sorted((r["requested_url"], r["depth"], r["discovered_from"], r["status_code"], r["fetch_error"])
        for r in polite.pages(store, 1).collect())


def crawl(spark, store, **options):
    seeds = spark.createDataFrame([(place(0),), (place(1),), (None,), (place(0),)], "url string")
    given = {"fetch": polite.archived(archive(spark)), "robots": files(spark), "agent": "bot", "per_host": 2, "max_depth": 9} | options
    return polite.crawl(store, 1, seeds, **given)


def test_a_stopped_crawl_goes_on_to_the_same_end(spark, store, tmp_path):
    whole = snapshots.Store(spark, f"file://{tmp_path}/whole")
    assert crawl(spark, whole)
    stops = 0
    while not crawl(spark, store, rounds=1):
        stops += 1
        assert stops < 30
    assert stops >= 4 and asked(store) == asked(whole)
    urls = [x[0] for x in asked(store)]
    assert len(urls) == len(set(urls)) and {place(0), place(2), place(4), place(6), place(8)} <= set(urls)


def test_a_driver_that_is_lost_in_a_round_costs_that_round(spark, store):
    crawl(spark, store, rounds=1)
    before = asked(store)

    def lost(wave):
        raise SystemError("driver lost")

    with pytest.raises(SystemError):
        crawl(spark, store, fetch=lost)
    assert asked(store) == before
    assert crawl(spark, store) and set(asked(store)) >= set(before)


def test_no_round_asks_a_host_for_more_than_its_share(spark, store):
    seeds = spark.createDataFrame([(f"https://h{0 if i % 3 else i}.example/{i}",) for i in range(60)], "url string")
    none = spark.createDataFrame([], "url string, status_code int, html string")
    polite.crawl(store, 1, seeds, polite.archived(none), files(spark), "bot", per_host=7, max_depth=0)
    rows = polite.pages(store, 1).selectExpr("split(url, '/')[2] as host", "round", "asked_ms", "url").toPandas()
    assert rows.groupby(["host", "round"]).size().max() == 7 and len(rows) == 60 and rows["url"].is_unique
    for _, own in rows.sort_values("asked_ms").groupby("host"):
        assert (own["asked_ms"].diff().dropna() >= 1000).all()  # also from one round to the next


def test_slow_hosts_are_asked_for_less_in_a_round(spark, store):
    seeds = spark.createDataFrame([(f"https://h{i % 2}.s.example/{i}",) for i in range(20)], "url string")
    slow = spark.createDataFrame([("h0.s.example", "User-agent: *\nCrawl-delay: 25"), ("h1.s.example", "User-agent: x\nCrawl-delay: 25")],
        "host string, robots_txt string")
    none = spark.createDataFrame([], "url string, status_code int, html string")
    polite.crawl(store, 1, seeds, polite.archived(none), slow, "bot", per_host=50, max_depth=0, rounds=1)
    got = polite.pages(store, 1).groupBy(polite.host_of(polite.F.col("url")).alias("host")).count().collect()
    assert {r["host"]: r["count"] for r in got} == {"h0.s.example": 2, "h1.s.example": 10}


def test_budget_and_depth(spark, store, tmp_path):
    assert crawl(spark, store, max_pages=4)
    assert len(asked(store)) == 4
    other = snapshots.Store(spark, f"file://{tmp_path}/other")
    assert crawl(spark, other, max_depth=1)
    assert {x[1] for x in asked(other)} == {0, 1}


def test_forbidden_urls_are_not_asked_for(spark, store):
    crawl(spark, store, robots=files(spark, "User-agent: *\nDisallow: /2$\nAllow: /"))
    by = {x[0]: x for x in asked(store)}
    assert by[place(2)][3:] == (None, fetcher.BLOCKED) and place(4) not in by


def test_a_client_is_asked_at_the_pace_of_each_host():
    now, calls = [100.0], []

    def client(method, url):
        calls.append((now[0], url))
        now[0] += 0.1
        return site(method, url)

    rows = pd.DataFrame([(f"https://h{h}.s.example/{k}", f"h{h}.s.example", 0, None, k + 1, 1000, 99_500 if h else 0, k != 1)
        for k in range(4) for h in (0, 1)], columns=["url", "host", "depth", "discovered_from", "n", "delay_ms", "last_ms", "allowed"])
    captured = {}

    class Wave:
        def repartition(self, *a):
            return self

        sortWithinPartitions = repartition

        def mapInPandas(self, run, schema):
            captured["run"] = run

    polite.live(client, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))(Wave())
    out = pd.concat(captured["run"](iter([rows])))
    assert len(out) == 8 and (out["fetch_error"] == fetcher.BLOCKED).sum() == 2
    for h in (0, 1):
        times = [t for t, u in calls if f"//h{h}." in u]
        assert len(times) == 3 and all(b - a >= 1 - 1e-9 for a, b in zip(times, times[1:]))
    assert min(t for t, u in calls if "//h1." in u) >= 100.5  # a second after the host's last request of the round before
    assert max(t for t, _ in calls) < 103.5  # hosts are served in turn, not one after the other


def test_a_live_crawl(spark, store):
    assert crawl(spark, store, fetch=polite.live(site), delay_ms=1, max_depth=2)
    by = {x[0]: x for x in asked(store)}
    assert by[place(0)][1] == 0 and all(x[3] == 200 for x in by.values())


@pytest.mark.parametrize("text, agent, want", [(None, "bot", None), ("User-agent: *\nCrawl-delay: 3", "bot", 3.0),
    ("User-agent: *\nCrawl-delay: 3\n\nUser-agent: a\nUser-agent: Bot\nDisallow: /\nCrawl-delay: 0.5 # s", "mybot/1", 0.5),
    ("User-agent: other\nCrawl-delay: 9", "bot", None), ("User-agent: *\nCrawl-delay: soon", "bot", None)])
def test_delays_of_robots_files(text, agent, want):
    assert robots.delay(text, agent) == want


def test_an_archive_answers_all_rounds_of_a_level_in_one_commit(spark, store):
    seeds = spark.createDataFrame([(f"https://h{0 if i % 3 else i}.example/{i:02d}",) for i in range(60)], "url string")
    none = spark.createDataFrame([], "url string, status_code int, html string")
    for rounds in (2, None):
        polite.crawl(store, 1, seeds, polite.archived(none), files(spark), "bot", per_host=7, max_depth=0, rounds=rounds)
    assert len(store.versions(1)) == 3  # the seeds, two rounds, and the rest
    own = sorted((r["url"], r["round"]) for r in polite.pages(store, 1).collect() if "/h0." in r["url"])
    assert [r for _, r in own] == [i // 7 for i in range(len(own))] and len(own) > 35
