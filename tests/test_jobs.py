"""Jobs, stored tables, lists and projects: hand-made cases, and the queries against their SQL."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from auditlake.functions import text
from auditlake.plans import issues, jobs, projects
from auditlake.sources import fetcher, sitemaps, spelling
from tests.conftest import SMALL


@pytest.mark.parametrize("name", jobs.SQL)
def test_queries_equal_their_sql(spark, duck, name):
    got = jobs.queries()[name](spark, SMALL)
    want = duck.execute(jobs.oracle_sql()[name])
    names = [d[0] for d in want.description]
    show = lambda rows: sorted("|".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r)
        for r in rows)
    assert set(names) == set(got.columns) and show(got.select(names).collect()) == show(want.fetchall())


def test_every_job_has_sql():
    assert set(jobs.queries()) == set(jobs.oracle_sql())


def _answer(body=b"<title>x</title>", status=200, kind="text/html", encoding="utf-8", **more):
    return SimpleNamespace(**{"status_code": status, "url": "https://a.example/", "history": [],
            "headers": {"content-type": kind}, "content": body, "encoding": encoding} | more)


def test_fetched_pages_become_rows_whatever_happens(spark):
    def client(method, url):
        kind = url.rsplit("/", 1)[1]
        answers = {
            "ok": _answer(url=url), "latin": _answer("<title>für</title>".encode("latin-1"), encoding="ISO-8859-1",
                url=url), "wrong": _answer("<title>für</title>".encode("latin-1"), url=url),
                "empty": _answer(b"", url=url),
            "pdf": _answer(kind="application/pdf", url=url),
            "xhtml": _answer(kind="application/xhtml+xml; q=1", url=url), "error": _answer(status=500, url=url),
            "none": _answer(kind=None, url=url), "moved": _answer(url="https://b.example/new",
                history=[url, "https://a.example/2"]),
        }
        return answers[kind]

    kinds = ("ok", "latin", "wrong", "empty", "pdf", "xhtml", "error", "none", "moved", "raises", "barred")
    found = spark.createDataFrame([(f"https://a.example/{k}", i, None) for i, k in enumerate(kinds)],
        "url string, depth int, discovered_from string")
    robots = spark.createDataFrame([("a.example", "User-agent: *\nDisallow: /barred")],
        "host string, robots_txt string")
    got = {r["requested_url"].rsplit("/", 1)[1]: r for r in fetcher.process(found, robots, client, "bot").collect()}
    assert {k: r["is_html"] for k, r in got.items()} == {k: k in ("ok", "latin", "wrong", "xhtml", "moved")
        for k in kinds}
    assert got["latin"]["title"] == got["wrong"]["title"] == "für" and got["ok"]["title"] == "x"
    assert got["moved"]["url"] == "https://b.example/new" and got["moved"]["redirect_chain"] == ["https://a.example/moved", "https://a.example/2"]
    assert got["raises"]["fetch_error"].startswith(
        "KeyError") and got["barred"]["fetch_error"] == "blocked_by_robots" and got["barred"]["blocked_by_robots"]
    free = fetcher.process(found, robots, client, "bot", respect=False).filter("blocked_by_robots").count()
    assert free == 0


def test_site_crawl_ends_with_its_budget(spark):
    none = spark.createDataFrame([], "host string, robots_txt string")
    got = {int(r["url"].rsplit("/", 1)[1]): r["depth"]
        for r in fetcher.crawl_site(spark, "https://s.example/0", none, jobs._made_site, "bot", max_pages=10,
            max_depth=9).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3, 9: 3}


def test_sitemaps_come_first_come_first_served(spark):
    xml = lambda *u: "<sitemapindex>" + "".join(f"<loc>{x}</loc>" for x in u) + "</sitemapindex>"
    rows = [("https://s.example/i.xml", xml("/z.xml", "/gone.xml", "/a.xml", "/z.xml")),
        ("https://s.example/z.xml", "<loc>/1</loc>"), ("https://s.example/a.xml", "<loc>/2</loc>")]
    found = spark.createDataFrame(rows, "url string, xml string")
    seeds = spark.createDataFrame([("https://s.example/i.xml",)], "url string")
    order = lambda n: sorted(r["url"].rsplit("/", 1)[1] for r in sitemaps.walk(seeds, found, max_sitemaps=n).collect())
    assert order(2) == ["i.xml", "z.xml"] and order(3) == ["gone.xml", "i.xml", "z.xml"] and order(50) == ["a.xml",
        "gone.xml", "i.xml", "z.xml"]


def test_spelling_answers_become_rows(spark):
    def client(text, language):
        if text.startswith("bad"):
            return SimpleNamespace(status_code=200, text="", json=lambda: (_ for _ in ()).throw(ValueError("no json")))
        assert len(text) <= spelling.INPUT
        return SimpleNamespace(status_code=200, text="",
            json=lambda: {"matches": [{"offset": 25, "length": 3, "message": language}, {}]})

    rows = spark.createDataFrame([("u", "x" * 9000, "pt_BR"), ("v", "bad", None), ("w", " \n", "de"),
            ("x", None, "de")], "url string, main_text string, language string")
    got = {r["url"]: r for r in spelling.check(rows, client).collect()}
    assert set(got) == {"u", "v"} and got["v"]["error"] == "invalid JSON: no json" and got["v"]["matches"] == []
    first, second = got["u"]["matches"]
    assert first["excerpt"] == "x" * 43 and first["message"] == "pt-br" and second["rule_id"] == "unknown" and second["excerpt"] == "x" * 20


def test_projects_change_as_asked(spark):
    now = datetime(2024, 1, 1)
    schema = "id long, name string, domain string, schedule_interval_minutes int, next_scheduled_at timestamp"
    old = spark.createDataFrame([(1, "a", "a.example", 60, datetime(2023, 1, 1)), (2, "b", "b.example", None, None)],
        schema)
    patches = spark.createDataFrame([(1, ["name"], "n", None), (2, ["schedule_interval_minutes"], None, 30)],
        "id long, sent array<string>, name string, schedule_interval_minutes int")
    got = [tuple(r) for r in projects.patched(old, patches, now).orderBy("id").collect()]
    assert got == [(1, "n", "a.example", 60, datetime(2023, 1, 1)),
        (2, "b", "b.example", 30, datetime(2024, 1, 1, 0, 30))]
    new = spark.createDataFrame([("c", "c.example", 15), ("d", "a.example", None), ("", "e.example", None),
            ("f", "c.example", None), ("g", "g.example", 14), ("h", "h.example", None)],
            "name string, domain string, schedule_interval_minutes int")
    got = {r["name"]: (r["id"], r["problem"]) for r in projects.created(old, new, now).collect()}
    assert got == {"c": (3, None), "d": (None, "domain is taken"), "": (None, "name"), "f": (None, "domain is taken"),
        "g": (None, "schedule_interval_minutes"), "h": (4, None)}
    crawls = spark.createDataFrame([(5, 1), (6, 2)], "id long, project_id long")
    pages = spark.createDataFrame([(7, 5), (8, 6)], "id long, crawl_id long")
    images = spark.createDataFrame([(7,), (8,)], "page_id long")
    left = projects.deleted({"projects": old, "crawls": crawls, "pages": pages, "images": images}, old.filter("id = 1"))
    assert {k: x.count() for k, x in left.items()} == {"projects": 1, "crawls": 1, "pages": 1,
        "images": 1} and left["images"].first()[0] == 8
    with pytest.raises(LookupError, match="Project"):
        projects.list_crawls(old, crawls, 9)
    with pytest.raises(LookupError, match="Crawl"):
        projects.get_crawl(old, crawls, 1, 6)


def test_json_keeps_nulls(spark):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert issues.as_json(rows).first()["body"] == '{"a":1,"b":null}'


def test_formats(spark):
    sizes = spark.createDataFrame([(None,), (1023,), (1024,), (1048575,), (1048576,)], "n long")
    assert [r[0] for r in sizes.select(text.format_bytes(F.col("n"))).collect()] == ["—", "1023 B", "1.0 KB",
        "1024.0 KB", "1.0 MB"]


def test_sitemaps_are_inflated_up_to_a_bound(spark):
    import gzip
    import tracemalloc

    from auditlake.sources import sitemaps

    bomb = gzip.compress(bytes(200_000_000))
    tracemalloc.start()
    with pytest.raises(OSError, match="more than"):
        sitemaps.inflated(bomb, 1_000_000)
    assert tracemalloc.get_traced_memory()[1] < 20_000_000  # what it holds is not made
    tracemalloc.stop()
    members = gzip.compress(b"<urlset><loc>/a</loc>") + gzip.compress(b"</urlset>") + b"\0\0"
    rows = [("https://s.example/bomb.xml.gz", bomb), ("https://s.example/two.xml.gz", members), ("https://s.example/cut.xml.gz", members[:20]),
        ("https://s.example/none.xml.gz", b""), ("https://s.example/no.xml.gz", b"plain")]
    got = {r["url"].split("/")[-1].split(".")[0]: r for r in sitemaps.decoded(spark.createDataFrame(rows, "url string, body binary")).collect()}
    assert got["two"]["xml"] == "<urlset><loc>/a</loc></urlset>" and got["none"]["xml"] == ""
    assert all(got[k]["xml"] is None and got[k]["error"] for k in ("bomb", "cut", "no"))


def test_odd_sitemaps_are_parsed_in_linear_time():
    import time

    from auditlake.sources import sitemaps

    assert sitemaps._html_locs("<loc a=1>x</loc><loc>y<b></loc>z</b><loc>w") == ["x", "y", "w"]
    began = time.process_time()
    sitemaps._html_locs("<b>" * 50_000 + "</i>" * 50_000 + "</b>" * 50_000)
    assert time.process_time() - began < 10
