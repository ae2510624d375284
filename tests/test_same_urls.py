"""Queries against their SQL on pages of which several have one URL."""

import os

import duckdb
import pytest

import __spark_entry__
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("same-urls"))
    for f in os.listdir(SMALL):
        if f != "pages.parquet":
            os.symlink(f"{SMALL}/{f}", f"{path}/{f}")
    # pages of the crawl's odd URLs, of failed and of fetched ones, get the URL of another
    duckdb.sql(f"""copy (select page_id, case when page_id % 5 = 4 then (select url from '{SMALL}/pages.parquet' p where p.page_id = q.page_id - 3) else url end as url, html
        from '{SMALL}/pages.parquet' q order by page_id) to '{path}/pages.parquet' (format parquet)""")
    return path


@pytest.mark.parametrize("name", [
    "rule_meta_title_duplicate", "rule_structure_inlinks_none", "rule_structure_sitemap_in_crawl_only", "resources_stored",
    "sitemap_parse", "incremental_audit", "page_list_total", "issue_list_total"])
def test_pages_of_one_url_count_as_in_the_sql(spark, folder, name):
    c = duckdb.connect()
    for f in os.listdir(folder):
        c.execute(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    got = __spark_entry__.queries()[name](spark, folder)
    want = c.execute(__spark_entry__.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    key = lambda rows: sorted(map(repr, map(tuple, rows)))
    assert key(got.select(*columns).collect()) == key(want.fetchall())
