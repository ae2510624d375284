"""Truth tables of rules on hand-made pages, and queries against their SQL on the small tables."""

import json

import pytest
from pyspark.sql import functions as F

from auditlake.functions import html, text, urls
from auditlake.operators import content, scoring, structure, tech
from auditlake.operators.registry import RULES, Rule, register
from auditlake.plans import catalog, compare, issues, projects, report, store
from auditlake.plans.audit import audit, scores
from auditlake.sources import frontier, probes, robots, sitemaps
from tests.conftest import SMALL

_FACTS = f"page_id long, url string, status_code int, fetch_error string, response_time_ms int, content_encoding string, depth int, redirect_chain array<string>, is_html boolean, content_hash string, html_size int, {html.PAGE}"
_CLEAN = {
    "page_id": 1, "url": "https://a.example/", "status_code": 200, "fetch_error": None, "response_time_ms": 100,
    "content_encoding": "gzip", "depth": 0, "redirect_chain": [], "is_html": True, "content_hash": "x",
    "html_size": 5000, "title": "t" * 50,
    "meta_description": "d" * 100, "meta_robots": None, "canonical_url": None, "language": "de", "h1": "Head",
    "headings": {"h1": ["Head"]}, "h1_count": 1, "strong_count": 0, "bold_count": 0, "word_count": 10,
    "text_excerpt": "", "charset": "utf-8",
    "main_text": None, "main_word_count": 0, "content_blocks": [], "images": [], "links": [], "resources": [],
}


def pages(spark, *rows):
    return spark.createDataFrame([{**_CLEAN, **r} for r in rows], _FACTS)


def ids(findings):
    return sorted(r["rule_id"] for r in findings.collect())


def link(target, anchor="Anchor", internal=True):
    return {"target_url": target, "anchor_text": anchor, "rel": None, "is_internal": internal, "is_followed": True}


def test_single_page_rules(spark):
    cases = [
        ({}, []),
        ({"title": None}, ["meta.title.missing"]),
        ({"title": "  "}, ["meta.title.empty"]),
        ({"title": "t" * 29}, ["meta.title.too_short"]),
        ({"title": "t" * 30}, []),
        ({"title": "ü" * 65}, []),
        ({"title": "t" * 66}, ["meta.title.too_long"]),
        ({"meta_description": "\t"}, ["meta.description.missing"]),
        ({"meta_description": "d" * 69}, ["meta.description.too_short"]),
        ({"meta_description": "d" * 161}, ["meta.description.too_long"]),
        ({"h1_count": 0, "headings": {}}, ["heading.h1.missing"]),
        ({"h1_count": 2}, ["heading.h1.multiple"]),
        ({"response_time_ms": 500}, []),
        ({"response_time_ms": 501}, ["tech.response_time.medium"]),
        ({"response_time_ms": 1500}, ["tech.response_time.medium"]),
        ({"response_time_ms": 1501}, ["tech.response_time.slow"]),
        ({"language": " "}, ["tech.language.missing"]),
        ({"html_size": 1_000_001}, ["tech.html.too_large"]),
        ({"charset": ""}, ["tech.charset.missing"]),
        ({"content_encoding": None}, ["tech.compression.missing"]),
        ({"content_encoding": "identity"}, ["tech.compression.missing"]),
        ({"content_encoding": "foo, BR"}, []),
        ({"headings": {"h1": ["a"], "h3": ["b"], "h6": ["c"]}}, ["heading.hierarchy.skipped"]),
        ({"headings": {"h2": ["a"], "h3": ["b"]}}, []),
        ({"meta_robots": "Index, NONE"}, ["meta.robots.noindex"]),
        ({"images": [{"src": "a", "alt": " ", "has_alt": False}]}, ["content.image.alt_missing"]),
        ({"fetch_error": "timeout", "title": None}, ["tech.fetch.failed"]),
        ({"status_code": 404, "is_html": False, "title": None}, ["tech.fetch.http_error"]),
        ({"url": "https://a.example/1/2/3/4/5?SID=1&x"}, ["url.session_id", "url.too_deep"]),
        ({"url": "https://a.example/?x=1"}, ["url.dynamic_params"]),
        ({"url": "https://a.example/" + "x" * 98}, ["url.too_long"]),
    ]
    rows = pages(spark, *({"url": f"https://a.example/{i}", **c} for i, (c, _) in enumerate(cases)))
    got = {}
    for r in tech.page_findings(rows).collect():
        got.setdefault(r["page_url"], []).append(r["rule_id"])
    for i, (c, want) in enumerate(cases):
        assert sorted(got.get(c.get("url", f"https://a.example/{i}"), [])) == want, c


def test_duplicates_keep_rows_and_ignore_case_of_none(spark):
    rows = pages(spark, {"url": "https://a.example/1"}, {"url": "https://a.example/1"},
        {"url": "https://a.example/2", "title": "T" * 50, "meta_description": None})
    got = tech.duplicate_findings(rows).filter("rule_id = 'meta.title.duplicate'").collect()
    assert len(got) == 2 and all('"count":2,"other_urls":[]' in r["payload"] for r in got)


def test_structure(spark):
    a, b, c = (f"https://a.example/{x}" for x in "abc")
    rows = pages(
        spark, {"url": a, "links": [link(b, " Hier "), link(b, "Text"), link("https://x.example/", "Text", False)]},
        {"url": b, "depth": 3, "redirect_chain": [a, c, a + "1"], "canonical_url": "https://www.a.example/z"},
        {"url": c, "depth": 5, "links": [link(c)] * 101, "redirect_chain": [c], "canonical_url": "https://b.example/"},
    )
    assert ids(structure.depth_findings(rows)) == ["structure.depth.deep", "structure.depth.very_deep"]
    assert structure.orphan_findings(rows).count() == 0
    assert ids(structure.outlink_findings(rows)) == ["structure.outlinks.many", "structure.outlinks.none"]
    assert ids(structure.anchor_findings(rows)) == ["structure.anchor.ambiguous", "structure.anchor.generic"]
    assert ids(structure.canonical_findings(rows, "https://a.example")) == ["structure.canonical.cross_domain",
        "structure.canonical.mismatch"]
    assert ids(structure.redirect_findings(rows)) == ["structure.redirect.long_chain", "structure.redirect.loop"]
    known = spark.createDataFrame([("https://x.example/", None), (b, 500)], "url string, status_code int")
    assert ids(structure.external_findings(rows,
            known)) == ["structure.external_link.broken"] * 2 + ["structure.external_link.unreachable"]
    named = spark.createDataFrame([(a,), ("https://a.example/only",), ("https://other.example/",)], "url string")
    assert ids(structure.sitemap_findings(rows, named,
            "https://www.a.example/")) == ["structure.sitemap.in_crawl_only"] * 2 + ["structure.sitemap.in_sitemap_only"]


def test_content(spark):
    words = [f"wort{i}" for i in range(120)]
    base = " ".join(words)
    near = " ".join([*words[:118], "anders", "noch"])
    block = "one two three four five"
    rows = pages(
        spark, *({"url": f"https://a.example/{i}", "main_text": t, "main_word_count": len(t.split()), "title": title,
                "h1": h1, "content_blocks": [block]} for i,
                (t, title, h1) in enumerate([(base, "Angebot und Wort1", "Wort1"),
                        (base.upper(), "wort2", "Fehlt hier"), (near, "für", None), ("kurz", "kurz", None)]))
    )
    texts = content.with_text(rows)
    assert ids(content.thin_findings(texts)) == ["content.thin"]
    assert content.duplicate_findings(texts).count() == 2
    got = content.near_findings(texts).collect()
    assert len(got) == 4 and all('"similarity":0.9' in r["payload"] for r in got)
    assert content.block_findings(texts).count() == 4
    assert ids(content.keyword_findings(texts)) == ["content.keyword.h1_not_in_body",
        "content.keyword.title_not_in_body"]
    assert content.cannibalization_findings(texts).filter("payload like '%wort0%'").count() == 3


def test_near_pairs_equal_brute_force(spark):
    import re

    texts = content.with_text(catalog.document_pages(spark, SMALL))
    got = {(r["a"], r["b"]): round(r["similarity"], 9)
        for r in content.near_pairs(content.shingled(texts).checkpoint()).collect()}
    sets = {}
    for r in texts.filter("main_word_count >= 50").select(content._digest().alias("d"), "main_text").collect():
        words = re.findall(r"\w+", r["main_text"].lower())
        sets[r["d"]] = {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))}
    want = {(a, b): round(j, 9) for a in sets for b in sets if a < b
        for j in [len(sets[a] & sets[b]) / len(sets[a] | sets[b])] if j >= 0.85}
    assert got == want and want


def test_long_texts_are_shingled_in_linear_time(spark):
    import time

    def seconds(n):
        rows = pages(spark, {"main_text": " ".join(f"w{i % 999}" for i in range(n)), "main_word_count": n})
        content.shingled(content.with_text(rows)).collect()
        began = time.perf_counter()
        content.shingled(content.with_text(rows)).collect()
        return time.perf_counter() - began

    assert seconds(400_000) < 12


@pytest.mark.parametrize("text", ["", "eins", "wort haus wort haus", "haus wort wort haus auch", "Abend Haus abend",
        "b" * 3])
def test_top_keyword(spark, text):
    import re
    from collections import Counter

    words = [w for w in re.findall(r"\w+", text.lower()) if len(w) >= 4 and w not in content.STOPWORDS]
    want = next((w for w, _ in Counter(words).most_common(1)), None)
    assert spark.createDataFrame([(text,)], "t string").select(content.top_keyword(F.col("t"))).first()[0] == want


@pytest.mark.parametrize("partitions", [1, 3, 17])
def test_issue_ids_do_not_depend_on_partitions(spark, partitions):
    rows = [(f"r{i % 5}", f"https://a.example/{i * 7919 % 400}", f"{i}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = issues.numbered(spark.createDataFrame(rows,
                "rule_id string, page_url string, payload string").repartition(partitions)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert [(r["rule_id"], r["page_url"], r["payload"]) for r in sorted(got, key=lambda r: r["id"])] == sorted(rows)
    assert sorted(r["id"] for r in got) == list(range(1, 401))


def test_scores_are_monotone_and_clamped(spark):
    def score(*rules, n=1):
        rows = spark.createDataFrame([(r,) for r in rules], "rule_id string")
        return {r["category"]: r["score"] for r in scoring.category_scores(rows, spark.range(n)).collect()}

    assert score() == {"tech_meta": 100.0, "structure": 100.0, "content": 100.0} == score("x", n=0)
    one, tip = score("meta.title.missing")["tech_meta"], score("url.dynamic_params")["tech_meta"]
    assert one == round(100 * (1 - 9 / 60.45), 2) and tip > one and score("meta.title.missing",
        "meta.title.missing")["tech_meta"] < one
    assert score(*["meta.title.missing"] * 50)["tech_meta"] == 0.0 and score("meta.title.missing",
        "unknown")["content"] == 100.0


def test_registry():
    assert len(RULES) == 52
    with pytest.raises(ValueError, match="already"):
        register(Rule("meta.title.missing", "tech_meta", "tip", 1.0, ""))


@pytest.mark.parametrize(
    ("url", "base", "want"),
    [("a/b?q=1#f", "https://A.Example/x/y", "https://a.example/x/a/b?q=1"),
        ("HTTP://A.example:80", None, "http://a.example/"), ("https://a.example:443/x", None, "https://a.example/x"),
        ("https://a.example:8443/x", None, "https://a.example:8443/x"), ("mailto:x@y", None, None),
        ("//b.example/p", "https://a.example/", "https://b.example/p"), ("", None, None), ("http://[", None, None),
        (None, None, None)],
)
def test_normalize(url, base, want):
    assert urls.normalize(url, base) == want


def test_url_columns_equal_python(spark):
    found = [r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()] + ["HTTP://A.example:80#x",
        "https://a.example:443?q", "ftp://x/", "no url", "https://www.A.example/a//b/"]
    rows = spark.createDataFrame([(u,) for u in found], "url string").select("url",
        urls.normalized(F.col("url")).alias("n"), urls.host_of(F.col("url")).alias("h"),
        urls.is_same_site(F.col("url"), F.lit("http://a.example/")).alias("s")).collect()
    for r in rows:
        assert r["n"] == urls.normalize(r["url"]) and r["s"] == urls.same_site(r["url"], "http://a.example/")


def test_scan():
    page = """<html LANG="de"><head><title> A &amp; <b>B</b></title><meta name="Description" content=" d "><meta name=robots content='NoIndex'><link rel="x canonical" href="/c"><link rel=stylesheet href="s.css"><meta http-equiv="Content-Type" content="text/html; charset=ISO-8859-1"><script src="a.js">var x="<a href=/no>";</script></head>
    <body><nav><a href="/nav">Nav</a></nav><h1>Head</h1><h1> </h1><h2>Sub</h2><img src=" i.png " alt="x"><img src="data:image/png;base64,x"><p>eins zwei drei vier fünf</p><a href="http://other.example/" rel="nofollow noopener">O</a><a href="javascript:x">J</a><a href="#top">T</a><footer>Fuß</footer></body></html>"""
    f = html.scan("https://a.example/dir/", page)
    assert (f["title"], f["meta_description"], f["meta_robots"], f["canonical_url"], f["language"],
        f["charset"]) == ("A & B", "d", "NoIndex", "https://a.example/c", "de", "iso-8859-1")
    assert f["headings"] == [("h1", ["Head"]), ("h2", ["Sub"])] and f["h1_count"] == 1 and f["h1"] == "Head"
    assert [(x["target_url"], x["is_internal"], x["is_followed"])
        for x in f["links"]] == [("https://a.example/nav", True, True), ("http://other.example/", False, False),
        ("https://a.example/dir/", True, True)]
    assert [(x["url"], x["resource_type"]) for x in f["resources"]] == [("https://a.example/dir/s.css", "stylesheet"),
        ("https://a.example/dir/a.js", "script"), ("https://a.example/dir/i.png", "image")]
    assert f["content_blocks"] == ["eins zwei drei vier fünf"] and "Fuß" not in f["main_text"] and "Nav" not in f["main_text"]
    assert html.scan(None, None)["title"] is None


def test_robots_rules():
    rules = robots.parse("User-agent: *\nDisallow: /\n\nUser-agent: Bot\nUser-agent: other\nDisallow: /a*b$\nAllow: /a/x\nDisallow:", "mybot/1.0")
    assert [robots.allowed(rules, f"https://h.example{p}") for p in ("/", "/a/b", "/a/bc", "/a/x/b")] == [True, False,
        True, False]
    assert not robots.allowed(robots.parse("user-agent: *\ndisallow: /", "x"),
        "https://h.example/") and robots.allowed(robots.parse(None, "x"), "https://h.example/")


def test_sitemaps(spark):
    import gzip

    rows = [("https://s.example/a.xml.gz", gzip.compress(b"<urlset><loc> /x </loc></urlset>")),
        ("https://s.example/b.xml", None), ("https://s.example/c.xml", gzip.compress(b"abc")[:12])]
    got = {r["url"]: r for r in sitemaps.decoded(spark.createDataFrame(rows, "url string, body binary")).collect()}
    assert got["https://s.example/b.xml"]["error"] == "no response" and got["https://s.example/c.xml"]["error"]
    seeds = robots.sitemap_seeds(spark.createDataFrame([("h.example", "SITEMAP: https://h.example/m.xml\nx"),
                ("i.example", "")], "host string, robots_txt string"))
    assert sorted(r["sitemap_url"] for r in seeds.collect()) == ["https://h.example/m.xml",
        "https://i.example/sitemap.xml"]


def test_frontier_budget_and_loops(spark):
    place = lambda i: f"https://s.example/{i}"
    edges = spark.createDataFrame([(place(a), place(b), p) for a, b,
            p in [(0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 3, 1), (2, 3, 0), (3, 4, 0)]] + [(place(0),
                "https://other.example/", 9)], "source_url string, target_url string, position int")
    got = {r["url"]: (r["depth"], r["discovered_from"])
        for r in frontier.crawl_order(edges, place(0), max_pages=4).collect()}
    assert got == {place(0): (0, None), place(1): (1, place(0)), place(2): (1, place(0)), place(3): (2, place(1))}


class _Client:
    def __call__(self, method, url):
        if "down" in url:
            raise ConnectionError("no route")
        self.status_code = 405 if method == "HEAD" else 200
        return self


def test_probe(spark):
    got = {r["url"]: r for r in probes.probe(spark.createDataFrame([("http://a",), ("http://a",), ("http://down",)],
                "url string"), _Client()).collect()}
    assert got["http://a"]["status_code"] == 200 and got["http://down"]["status_code"] is None and got["http://down"]["error"] == "ConnectionError: no route" and len(got) == 2


def test_report_and_csv(spark):
    rows = spark.createDataFrame([(i, "meta.title.missing", "tech_meta", "critical", f"https://a.example/{i}" if i
                else None, i or None, '{"a":1}' if i else "{}") for i in range(7)],
                "id long, rule_id string, category string, severity string, page_url string, page_id long, payload string").withColumn("created_at", F.lit(catalog.NOW))
    page = report.render(report.context(rows, 3, {"tech_meta": 61.0}), "T <x>")
    assert "… und 2 weitere" in page and "T &lt;x&gt;" in page and "score-mid" in page and "content.thin" in page
    lines = b"".join(issues.stream_csv(rows)).decode().splitlines()
    assert lines[0].startswith("﻿issue_id,") and len(lines) == 8 and '"{""a"": 1}"' in lines[2] and lines[1].startswith(
        "0,meta.title.missing,tech_meta,critical,,,,2024-01-01T00:00:00")
    assert "Neu (0)" in report.render_comparison(compare.compare(rows, rows), "C")
    with pytest.raises(ValueError, match="different"):
        compare.ordered(1, 1)


def test_projects(spark):
    rows = spark.createDataFrame([(1, "n", "d", 15), (2, "", "d", 14), (3, "n", None, None)],
        "id long, name string, domain string, schedule_interval_minutes int")
    assert sorted((r["id"], r["problem"]) for r in projects.invalid(rows).collect()) == [(1, "domain is taken"),
        (2, "domain is taken"), (2, "name"), (2, "schedule_interval_minutes"), (3, "domain")]


def test_store_and_whole_audit(spark, tmp_path):
    crawled = catalog.crawl(spark, SMALL).checkpoint()
    store.write(store.pages_table(crawled), str(tmp_path), "pages", 7)
    store.write(store.pages_table(crawled), str(tmp_path), "pages", 7)
    assert store.read(spark, str(tmp_path), "pages", 7).count() == crawled.count()
    assert store.links_table(crawled).count() == structure.edges(crawled).count() and store.blocks_table(
        crawled).count() > 0 and store.resources_table(crawled).count() > 0
    found = audit(crawled, catalog.BASE_URL)
    assert {r["rule_id"] for r in found.select("rule_id").distinct().collect()} >= {"meta.title.missing",
        "structure.inlinks.none"}
    assert all(0 <= r["score"] <= 100 for r in scores(found, crawled).collect())


def test_streaming_audit_equals_batch(spark, tmp_path):
    from auditlake.sources.fixtures import fetched
    from auditlake.streaming.incremental import audit_stream, start

    fetched(spark, SMALL).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(fetched(spark, SMALL).schema).parquet(str(tmp_path / "in"))
    got = []
    start(audit_stream(stream), lambda df, _: got.extend(df.collect()), str(tmp_path / "c")).awaitTermination(120)
    x = fetched(spark, SMALL).withColumn("is_html", F.expr("fetch_error is null and status_code < 400"))
    want = tech.page_findings(html.extract(x.withColumn("html", F.expr("if(is_html, html, '')")))).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and got


_SOME = ["rule_meta_title_duplicate", "rule_structure_anchor_ambiguous", "rule_content_duplicate_page",
    "rule_content_keyword_cannibalization", "rule_structure_external_link_broken", "url_parts", "page_facts",
    "crawl_compare", "dashboard_latest_two", "scheduler_tick", "crawl_bfs", "robots_allowed"]


@pytest.mark.parametrize("name", _SOME)
def test_queries_equal_their_sql(spark, duck, name):
    got = catalog.queries()[name](spark, SMALL)
    want = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    show = lambda rows: sorted("|".join("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r)
        for r in rows)
    assert set(names) == set(got.columns) and show(got.select(names).collect()) == show(want.fetchall())


def test_stored_issues_hold_the_whole_audit(spark, duck):
    from auditlake.operators.registry import RULES
    from auditlake.plans.oracles import _ISSUES, RULE_SQL

    pages, rows = catalog._issues(spark, SMALL)
    got = rows.select("id", "rule_id", "category", "severity", "page_url", "payload").collect()
    assert sorted(r["id"] for r in got) == list(range(1, len(got) + 1))
    show = lambda rows: sorted("|".join(map(str, r)) for r in rows)
    for rule_id in RULES:
        if rule_id in RULE_SQL and RULES[rule_id].category != "content":
            want = duck.execute(f"SELECT rule_id, page_url, payload FROM ({RULE_SQL[rule_id]})").fetchall()
            assert show((r["rule_id"], r["page_url"], r["payload"]) for r in got
                if r["rule_id"] == rule_id) == show(want), rule_id
    want = duck.execute(f"WITH {_ISSUES} SELECT id, rule_id, category, severity, page_url, payload FROM issues").fetchall()
    assert show(tuple(r) for r in got) == show(want)
    assert {r["rule_id"] for r in got} >= {i for i in RULES if i.startswith("content.")} - {"content.duplicate.near",
        "content.duplicate.page", "content.keyword.h1_not_in_body"}
    thin = {r["page_url"] for r in got if r["rule_id"] == "content.thin"}
    assert thin == {p["url"] for p in pages.filter("is_html and main_text <> '' and main_word_count < 100").select(
            "url").collect()} and thin
    passing = {r["rule_id"] for r in catalog.rules_passing(spark, SMALL).collect()}
    assert passing == set(RULES) - {r["rule_id"] for r in got}
    score = {r["category"]: r["score"] for r in catalog.category_scores(spark, SMALL).collect()}
    assert score["content"] < 100


def test_sitemaps_of_all_pages_and_of_odd_texts(spark, duck):
    got = sorted((r["page_id"], r["url"]) for r in catalog.sitemap_parse(spark, SMALL).collect())
    want = duck.execute("SELECT page_id, regexp_replace(url, '#.*$', '') FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || '/rel/' || page_id FROM pages").fetchall()
    assert got == sorted(want) and {i % 2 for i, _ in got} == {0, 1}
    texts = {
        "<urlset><url><loc >/a?x=1&amp;y=2</loc ></url><url><LOC lang='de'> /b </LOC></url></urlset>": ["https://s.example/a?x=1&y=2", "https://s.example/b"],
        "<sitemapindex><loc\n>/m.xml</loc></sitemapindex>": ["https://s.example/m.xml"],
        "<url><loc x>/open</url><url><loc x></loc></url>": ["https://s.example/open"],
        "<loc>/first</loc><loc x>/not read where the pattern finds some</loc>": ["https://s.example/first"],
        "<!-- <loc x>/no</loc> --><lock>/no</lock>": [], "no places": [],
    }
    rows = spark.createDataFrame([(f"https://s.example/{i}.xml", t) for i,
            t in enumerate(texts)] + [("https://s.example/none", None)], "url string, xml string")
    read = {r["url"]: r for r in sitemaps.parsed(rows).collect()}
    assert [list(read[f"https://s.example/{i}.xml"]["locs"])
        for i in range(len(texts))] == list(texts.values()) and read["https://s.example/none"]["locs"] == []
    assert [i for i in range(len(texts)) if read[f"https://s.example/{i}.xml"]["is_index"]] == [1]


def test_text_functions(spark):
    row = spark.createDataFrame([("  für\tüber \n",)], "t string").select(text.strip(F.col("t")).alias("s"),
        text.collapse(F.col("t")).alias("c"), text.tokens(F.col("t")).alias("w"),
        text.word_count(F.col("t")).alias("n"), text.blank(F.lit("\t ")).alias("b")).first()
    assert tuple(row) == ("für\tüber", "für über", ["für", "über"], 2, True)


def test_queries_are_listed_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c",
            "import __spark_entry__ as e; print(len(e.queries()) - len(set(e.oracle_sql()) - set(e.queries())))"],
            cwd=root, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[-1]) > 80


def test_pages_of_one_url_each_have_their_findings(spark):
    schema = ("page_id long, url string, is_html boolean, depth int, title string, meta_description string, links array<struct<target_url:string,"
        "anchor_text:string,rel:string,is_internal:boolean,is_followed:boolean>>, resources array<string>")
    page = lambda i, u, depth=1: (i, f"https://a.example/{u}", True, depth, "Same", None, [], ["r"])
    pages = spark.createDataFrame([page(1, "x"), page(2, "x"), page(3, "y"), page(4, "z", 0), page(5, "z")], schema)
    count = lambda found, rule: sorted(r["page_url"][-1] for r in found.filter(F.col("rule_id") == rule).collect())
    assert count(structure.orphan_findings(pages), "structure.inlinks.none") == ["x", "x", "y", "z"]
    assert count(structure.outlink_findings(pages), "structure.outlinks.none") == ["x", "x", "y", "z", "z"]
    named = spark.createDataFrame([("https://a.example/y",)], "url string")
    found = structure.sitemap_findings(pages, named, "https://a.example/")
    assert count(found, "structure.sitemap.in_crawl_only") == ["x", "x", "z", "z"]
    shown = {r["page_url"][-1]: json.loads(r["payload"]) for r in tech.duplicate_findings(pages).collect()}
    assert shown["y"]["count"] == 5 and [u[-1] for u in shown["y"]["other_urls"]] == ["x", "x", "z", "z"]
    alone = catalog.no_others(tech.duplicate_findings(pages.filter("page_id < 3"))).collect()
    assert [json.loads(r["payload"])["other_urls"] for r in alone] == [None, None]
    found = issues.with_page_ids(structure.orphan_findings(pages), pages)
    assert sorted((r["page_url"][-1], r["page_id"]) for r in found.collect()) == [("x", 1), ("x", 1), ("x", 2), ("x", 2), ("y", 3), ("z", 4), ("z", 5)]
    numbers = {r["page_id"]: (r["n_resources"], r["n_issues"]) for r in issues.page_counts(pages, found).collect()}
    assert numbers == {1: (2, 2), 2: (2, 2), 3: (1, 1), 4: (2, 1), 5: (2, 1)}


def test_texts_of_one_url_have_one_keyword(spark):
    rows = [("u", "alpha beta", "h", "alpha gamma gamma"), ("u", "beta", "h", "delta delta delta"), ("v", "omega", None, "none here")]
    texts = spark.createDataFrame([(*r, 60) for r in rows], "page_url string, title string, h1 string, main_text string, main_word_count int")
    facts = content.text_facts(texts).checkpoint()
    got = sorted((r["page_url"], r["title_key"], r["title_found"], [k["word"] for k in r["keywords"]])
        for r in content.keyword_facts(facts, texts).collect())
    assert got == [("u", "beta", False, ["delta", "gamma", "alpha"])] * 2 + [("v", "omega", False, ["none", "here"])]


def test_sitemaps_of_one_url_are_parsed_each(spark):
    rows = spark.createDataFrame([(i, "https://a.example/s.xml", f"<urlset><loc>/{i}</loc></urlset>") for i in (1, 2)],
        "k long, url string, xml string")
    assert sorted((r["k"], r["locs"]) for r in sitemaps.parsed(rows).collect()) == [(1, ["https://a.example/1"]), (2, ["https://a.example/2"])]


def test_members_of_texts_need_no_shingles(spark):
    rows = [("u", "same words here", 60), ("v", "same  words here", 60), ("w", "few", 3)]
    texts = spark.createDataFrame(rows, "page_url string, main_text string, main_word_count int")
    got = content.text_members(texts)
    assert sorted(r["page_url"] for r in got.collect()) == ["u", "v"] and got.select("doc").distinct().count() == 1
