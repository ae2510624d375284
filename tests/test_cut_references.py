"""Queries against their SQL on pages whose title and heading are cut inside a character reference, as some test pages' are."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from auditlake.functions.html import scan
from tests.conftest import SMALL

NAMES = [
    "page_titles", "main_content", "main_content_untagged", "page_text_stats", "pages_stored", "blocks_stored",
    "rule_meta_title_too_long", "rule_meta_title_duplicate", "pages_committed", "incremental_audit",
    "crawl_compare", "issue_list", "report_examples", "issues_json",
]


@pytest.fixture(scope="module")
def cut(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("cut-references"))
    for f in os.listdir(SMALL):
        if f != "pages.parquet":
            os.symlink(f"{SMALL}/{f}", f"{path}/{f}")
    # pages of one title end alike
    ends = r"(case ascii(regexp_extract(html, '<title>(.*?)</title>', 1)) % 4 when 1 then '&amp' when 3 then '&quo' else '&quot' end)"
    duckdb.sql(f"""copy (select page_id, url, replace(replace(html, '</title>', {ends} || '</title>'), '</h1>', {ends} || '</h1>') as html
        from '{SMALL}/pages.parquet' order by 1) to '{path}/pages.parquet' (format parquet)""")
    return path


@pytest.mark.parametrize("name", NAMES)
def test_cut_references_stay_as_in_the_sql(spark, cut, name):
    c = duckdb.connect()
    for f in os.listdir(cut):
        c.execute(f"create view {f.split('.')[0]} as select * from '{cut}/{f}'")
    want = c.execute(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, cut).select(*[x[0] for x in want.description])
    assert Counter(map(repr, map(tuple, got.collect()))) == Counter(map(repr, want.fetchall()))


def test_cut_references_are_decoded_unless_told_otherwise():
    page = "<title>a &lt;b&gt; &#39;c&#39; &quot</title><article>x &copy; y &ampz &copy</article>"
    assert (scan("https://a.example/", page)["title"], scan("https://a.example/", page)["main_text"]) == ("a <b> 'c' \"", "x © y &z ©")
    kept = scan("https://a.example/", page, cut_off=False)
    assert (kept["title"], kept["main_text"]) == ("a <b> 'c' &quot", "x © y &z &copy")
