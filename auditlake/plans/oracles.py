"""SQL, for DuckDB, that states the same results over the same tables."""

from __future__ import annotations

from auditlake.operators.content import STOPWORDS
from auditlake.operators.registry import MULTIPLIER, RULES
from auditlake.operators.structure import GENERIC

_RULES = "rules(ord, rule_id, category, severity, weight) AS (VALUES " + ", ".join(
    f"({i}, '{r.rule_id}', '{r.category}', '{r.severity}', {r.weight}::DOUBLE)" for i,
    r in enumerate(RULES.values())) + ")"

#: pages with the tags and fetch facts that follow page_id, and what their tags tell.
_CRAWL = r"""
u0 AS (SELECT page_id AS p, page_id, html, CASE page_id % 16 WHEN 3 THEN regexp_replace(url, '[?#].*$', '') || '/a/b/c/d/e/' || repeat('x', 90) WHEN 5 THEN regexp_replace(url, '[?#].*$', '') || '?PHPSESSID=1&a=2' ELSE url END AS raw FROM pages),
u AS (SELECT *, regexp_replace(raw, '#.*$', '') AS url FROM u0),
h1 AS (SELECT *, CASE WHEN p % 19 = 0 THEN replace(html, 'title>', 'xtitle>') ELSE html END AS h FROM u),
h1b AS (SELECT * REPLACE (CASE WHEN p % 18 = 1 THEN replace(h, '<title>', '<title>A title that goes on for a while: ') ELSE h END AS h) FROM h1),
h2 AS (SELECT * REPLACE (CASE WHEN p % 17 = 0 THEN replace(h, 'h1>', 'h6>') ELSE h END AS h) FROM h1b),
h3 AS (SELECT * REPLACE (CASE WHEN p % 12 = 0 THEN replace(h, '<html lang=', '<html data-lang=') ELSE h END AS h) FROM h2),
h4 AS (SELECT * REPLACE (CASE WHEN p % 14 = 0 THEN replace(h, '<meta charset=', '<meta data-charset=') ELSE h END AS h) FROM h3),
h5 AS (SELECT * REPLACE (replace(replace(h, '</head>',
    CASE p % 5 WHEN 1 THEN '<meta name="description" content="Short ' || (p % 50) || '">' WHEN 2 THEN '<meta name="Description" content="' || repeat('Long words here ', 12) || '">'
      WHEN 3 THEN '<meta name="description" content="' || repeat('Fitting ', 12) || p || '">' WHEN 4 THEN '<meta name="description" content="">' ELSE '' END
    || CASE p % 9 WHEN 0 THEN '<meta name="robots" content="NoIndex, nofollow">' WHEN 1 THEN '<meta name="robots" content="index,follow">' ELSE '' END
    || CASE p % 6 WHEN 0 THEN '<link rel="canonical" href="' || raw || '">' WHEN 1 THEN '<link rel="canonical" href="https://other.example.org/c">' WHEN 2 THEN '<link rel="canonical" href="https://audit.example/c/' || p || '">' ELSE '' END
    || '<link rel="stylesheet" href="/s' || (p % 3) || '.css">' || '<script src="http://cdn.example.net/a' || (p % 4) || '.js"></script>' || '</head>'),
    '<article>', '<article>'
    || CASE p % 8 WHEN 0 THEN '<img src="/i/1.png" alt="one"><img src="/i/2.png">' WHEN 1 THEN '<img src="https://cdn.example.net/p.png" alt=" ">' ELSE '' END
    || CASE p % 10 WHEN 0 THEN '<h3>Part</h3>' WHEN 1 THEN '<h2>Part</h2><h3>Detail</h3>' WHEN 2 THEN '<h1>Second</h1>' ELSE '' END
    || CASE WHEN p % 7 = 0 THEN '<a href="/w/' || p || '"> Weiter </a>' ELSE '' END
    || CASE WHEN p % 3 = 0 THEN '<a href="' || raw || '">self</a>' ELSE '' END
    || '<a rel="nofollow" href="https://extern.example.org/' || repeat('e', (p % 5)::INT) || (p % 30) || '">Partner</a>'
    || CASE WHEN p % 25 = 0 THEN repeat('<a href="/many">many</a>', 101) ELSE '' END) AS h) FROM h4),
h5b AS (SELECT * REPLACE (CASE WHEN p % 97 = 3 THEN h || '<!--' || repeat('x', 1000000) || '-->' ELSE h END AS h) FROM h5),
h6 AS (SELECT * REPLACE (CASE WHEN p % 21 = 0 THEN replace(h, '<a ', '<i ') ELSE h END AS h) FROM h5b),
facts AS (SELECT *,
    CASE p % 20 WHEN 5 THEN 404 WHEN 6 THEN 500 ELSE 200 END AS status_code, CASE WHEN p % 23 = 0 THEN 'timeout' END AS fetch_error, (p * 37 % 2000)::INT AS ms,
    CASE p % 4 WHEN 1 THEN 'gzip' WHEN 2 THEN 'identity' WHEN 3 THEN 'br, GZIP' END AS encoding, (p % 7)::INT AS depth,
    CASE WHEN p % 11 = 0 THEN [url || '?a', url || '?b', url || '?c'] WHEN p % 13 = 0 THEN [url, url || '?x'] ELSE []::VARCHAR[] END AS chain,
    regexp_extract(url, '^(https?://[^/]*)', 1) AS origin FROM h6),
crawl AS (SELECT *, fetch_error IS NULL AND status_code < 400 AS is_html,
    CASE WHEN p % 29 = 2 THEN '  ' ELSE nullif(trim(replace(replace(replace(regexp_extract(h, '<title>(.*?)</title>', 1), '&quot;', '"'), '&amp;', '&'), '&amp', '&')), '') END AS title,
    CASE p % 5 WHEN 1 THEN 'Short ' || (p % 50) WHEN 2 THEN trim(repeat('Long words here ', 12)) WHEN 3 THEN repeat('Fitting ', 12) || p WHEN 4 THEN '' END AS description,
    CASE p % 9 WHEN 0 THEN 'NoIndex, nofollow' WHEN 1 THEN 'index,follow' END AS robots,
    CASE p % 6 WHEN 0 THEN url WHEN 1 THEN 'https://other.example.org/c' WHEN 2 THEN 'https://audit.example/c/' || p END AS canonical,
    nullif(regexp_extract(h, '<html lang="([^"]*)"', 1), '') AS lang, nullif(regexp_extract(h, '<meta charset="([^"]*)"', 1), '') AS charset,
    len(regexp_extract_all(h, '<h1>')) AS h1_count, list_sort(list_distinct(regexp_extract_all(h, '<h([1-6])>', 1)))::INT[] AS levels,
    CASE p % 8 WHEN 0 THEN ['/i/2.png'] WHEN 1 THEN ['https://cdn.example.net/p.png'] ELSE []::VARCHAR[] END AS no_alt,
    octet_length(encode(h)) AS bytes FROM facts)"""



def _plain(c: str) -> str:
    """The text c without references."""
    for name, sign in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&amp", "&")):
        c = f"replace({c}, '{name}', '{sign}')"
    return c


_INLINE_TAG, _BREAK_TAG = "</?(b|i|a|strong|em|span|code)( [^>]*)?>", "</?(p|br|div|li|ul|ol|h[1-6]|tr|table|section|blockquote|pre|hr|dt|dd)( [^>]*)?>"


def _main_text(h: str) -> str:
    """Lines of the article of a test page, white space collapsed."""
    text = _plain(f"regexp_replace(regexp_replace(regexp_extract({h}, '<article>(.*?)</article>', 1, 's'), '{_BREAK_TAG}', chr(10), 'g'), '<[^>]*>', '', 'g')")
    return rf"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"


def _visible(h: str) -> str:
    """What a test page shows, white space collapsed."""
    text = f"regexp_extract({h}, '</head>(.*)$', 1, 's')"
    for pattern, by in (("<(script|style)[^>]*>.*?</(script|style)>", " "), ("<!--.*?-->", ""), (_INLINE_TAG, ""),
            ("<[^>]*>", " ")):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'gs')"
    return rf"trim(regexp_replace({_plain(text)}, '\s+', ' ', 'g'))"


def _n_words(c: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''))"


_EDGES = r"""
links AS (SELECT p, url, origin, unnest(regexp_extract_all(h, '<a ([^>]*)>(.*?)</a>', 1)) AS attributes, unnest(regexp_extract_all(h, '<a ([^>]*)>(.*?)</a>', 2)) AS inner_text FROM crawl WHERE is_html),
refs AS (SELECT *, regexp_extract(attributes, 'href="([^"]*)"', 1) AS href FROM links),
edges AS (SELECT p, url AS source_url, regexp_replace(CASE WHEN href LIKE '/%' THEN origin || href ELSE href END, '#.*$', '') AS target_url, trim(inner_text) AS anchor_text,
    attributes NOT LIKE '%nofollow%' AS is_followed, href LIKE '/%' OR regexp_replace(regexp_extract(href, '^https?://([^/]*)', 1), '^www\.', '') = regexp_replace(regexp_extract(url, '^https?://([^/]*)', 1), '^www\.', '') AS is_internal FROM refs)"""

_RESOURCES = r"""
res AS (
    SELECT url AS page_url, origin || '/s' || (p % 3) || '.css' AS url, 'stylesheet' AS kind FROM crawl WHERE is_html
    UNION ALL SELECT url, 'http://cdn.example.net/a' || (p % 4) || '.js', 'script' FROM crawl WHERE is_html
    UNION ALL SELECT url, origin || unnest(['/i/1.png', '/i/2.png']), 'image' FROM crawl WHERE is_html AND p % 8 = 0
    UNION ALL SELECT url, 'https://cdn.example.net/p.png', 'image' FROM crawl WHERE is_html AND p % 8 = 1)"""


def _url(part: int) -> str:
    return rf"regexp_extract(url, '^https?://([^/?]*)([^?]*)(?:\?(.*))?$', {part})"


_SESSION = f"len(list_intersect(list_transform(string_split({_url(3)}, '&'), lambda x: lower(split_part(x, '=', 1))), ['sid', 'sessid', 'sessionid', 'session_id', 'phpsessid', 'jsessionid', 'aspsessionid', 'cfid', 'cftoken'])) > 0"
_DEPTH = f"len(list_filter(string_split({_url(2)}, '/'), lambda x: x <> ''))"
_PAGE = "fetch_error IS NULL AND is_html"
_GAP = "list_filter(list_zip(levels[1:len(levels) - 1], levels[2:len(levels)]), lambda x: x[2] - x[1] > 1)[1]"
_ROBOTS = "list_sort(list_distinct(list_transform(string_split(robots, ','), lambda x: lower(trim(x)))))"
#: rule_id: (condition, payload) over crawl.
PAGE_RULES = {
    "tech.fetch.failed": ("fetch_error IS NOT NULL", "{'error': fetch_error}"),
    "tech.fetch.http_error": ("fetch_error IS NULL AND status_code >= 400", "{'status_code': status_code}"),
    "url.too_long": ("fetch_error IS NULL AND length(url) > 115", "{'length': length(url), 'max': 115}"),
    "url.too_deep": (f"fetch_error IS NULL AND {_DEPTH} > 4", f"{{'depth': {_DEPTH}, 'max': 4}}"),
    "url.session_id": (f"fetch_error IS NULL AND {_SESSION}", None),
    "url.dynamic_params": (f"fetch_error IS NULL AND {_url(3)} <> '' AND NOT {_SESSION}", None),
    "tech.response_time.slow": ("fetch_error IS NULL AND ms > 1500", "{'ms': ms, 'threshold': 1500}"),
    "tech.response_time.medium": ("fetch_error IS NULL AND ms > 500 AND ms <= 1500", "{'ms': ms, 'threshold': 500}"),
    "meta.title.missing": (f"{_PAGE} AND title IS NULL", None),
    "meta.title.empty": (f"{_PAGE} AND trim(title) = ''", None),
    "meta.title.too_short": (f"{_PAGE} AND trim(title) <> '' AND length(title) < 30",
        "{'length': length(title), 'min': 30}"),
    "meta.title.too_long": (f"{_PAGE} AND length(title) > 65", "{'length': length(title), 'max': 65}"),
    "meta.description.missing": (f"{_PAGE} AND coalesce(description, '') = ''", None),
    "meta.description.too_short": (f"{_PAGE} AND description <> '' AND length(description) < 70",
        "{'length': length(description), 'min': 70}"),
    "meta.description.too_long": (f"{_PAGE} AND length(description) > 160",
        "{'length': length(description), 'max': 160}"),
    "heading.h1.missing": (f"{_PAGE} AND h1_count = 0", None),
    "heading.h1.multiple": (f"{_PAGE} AND h1_count > 1", "{'count': h1_count}"),
    "content.image.alt_missing": (f"{_PAGE} AND len(no_alt) > 0", "{'count': len(no_alt), 'examples': no_alt}"),
    "tech.language.missing": (f"{_PAGE} AND lang IS NULL", None),
    "tech.html.too_large": (f"{_PAGE} AND bytes > 1000000", "{'bytes': bytes, 'max': 1000000}"),
    "tech.charset.missing": (f"{_PAGE} AND charset IS NULL", None),
    "tech.compression.missing": (f"{_PAGE} AND coalesce(encoding, 'identity') = 'identity'",
        "CASE WHEN encoding IS NULL THEN '{}' ELSE to_json({'content_encoding': encoding})::VARCHAR END"),
    "heading.hierarchy.skipped": (f"{_PAGE} AND {_GAP} IS NOT NULL",
        f"{{'before': 'h' || {_GAP}[1], 'after': 'h' || {_GAP}[2], 'skipped': list_transform(range({_GAP}[1] + 1, {_GAP}[2]), lambda x: 'h' || x)}}"),
    "meta.robots.noindex": (f"{_PAGE} AND list_has_any({_ROBOTS}, ['noindex', 'none'])",
        f"{{'directives': {_ROBOTS}}}"),
}


def _row(rule_id: str, url: str, payload: str | None, rest: str) -> str:
    r = RULES[rule_id]
    data = "'{}'" if payload is None else payload if payload.startswith("CASE") else f"to_json({payload})::VARCHAR"
    return f"SELECT {url} AS page_url, '{rule_id}' AS rule_id, '{r.category}' AS category, '{r.severity}' AS severity, {data} AS payload {rest}"


PAGE_FINDINGS = " UNION ALL ".join(_row(i, "url", data, f"FROM crawl WHERE {when}") for i,
    (when, data) in PAGE_RULES.items())


def _shared(column: str, shown: str, name: str, rule_id: str) -> str:
    few = f"(SELECT list(x.url ORDER BY x.url)[1:5] FROM v x WHERE x.value = v.value AND x.url <> v.url)"
    return f"""WITH {{crawl}}, v AS (SELECT url, trim({column}) AS value FROM crawl WHERE is_html AND {column} <> ''), n AS (SELECT value, count(*) AS n FROM v GROUP BY value HAVING count(*) > 1)
{_row(rule_id, "v.url", f"{{'{name}': {shown}, 'count': n.n, 'other_urls': {few}}}", "FROM v JOIN n ON v.value = n.value")}""".replace("{crawl}", _CRAWL)


def page_rule(rule_id: str) -> str:
    when, data = PAGE_RULES[rule_id]
    return f"WITH {_CRAWL} " + _row(rule_id, "url", data, f"FROM crawl WHERE {when}")


_STATUS = "status AS (SELECT DISTINCT url, CASE length(url) % 5 WHEN 0 THEN 404 WHEN 1 THEN NULL ELSE 200 END AS status_code FROM ({src}) WHERE length(url) % 5 <> 2)"
_RES_STATUS = _STATUS.format(src="SELECT url FROM res")
_LINK_STATUS = _STATUS.format(src="SELECT target_url AS url FROM edges WHERE NOT is_internal")
_GENERIC = "(" + ", ".join(f"'{g}'" for g in GENERIC) + ")"
_SITE = r"regexp_replace(regexp_extract({0}, '^https?://([^/:]*)', 1), '^www\.', '') = 'audit.example'"
_SITEMAP = "named AS (SELECT url FROM crawl WHERE p % 2 = 0 UNION ALL SELECT 'https://www.audit.example/only/' || p FROM crawl WHERE p % 10 = 0)"

_PAGE_SETS = {
    "meta.title.duplicate": _shared("title", "v.value", "title", "meta.title.duplicate"),
    "meta.description.duplicate": _shared("description", "substr(v.value, 1, 200)", "description",
        "meta.description.duplicate"),
    "tech.resource.mixed_content": f"WITH {_CRAWL}, {_RESOURCES} " + _row("tech.resource.mixed_content", "page_url",
        "{'resource': url, 'type': kind}", "FROM res WHERE page_url LIKE 'https://%' AND url LIKE 'http://%'"),
    "tech.resource.broken": f"WITH {_CRAWL}, {_RESOURCES}, {_RES_STATUS} " + _row("tech.resource.broken", "page_url",
        "{'resource': res.url, 'type': kind, 'status_code': status_code}",
        "FROM res JOIN status USING (url) WHERE status_code >= 400"),
    "tech.resource.unreachable": f"WITH {_CRAWL}, {_RESOURCES}, {_RES_STATUS} " + _row("tech.resource.unreachable",
        "page_url", "{'resource': res.url, 'type': kind}",
        "FROM res JOIN status USING (url) WHERE status_code IS NULL"),
    "structure.depth.deep": f"WITH {_CRAWL} " + _row("structure.depth.deep", "url", "{'depth': depth, 'threshold': 3}",
        "FROM crawl WHERE is_html AND depth IN (3, 4)"),
    "structure.depth.very_deep": f"WITH {_CRAWL} " + _row("structure.depth.very_deep", "url",
        "{'depth': depth, 'threshold': 5}", "FROM crawl WHERE is_html AND depth >= 5"),
    "structure.inlinks.none": f"WITH {_CRAWL}, {_EDGES} " + _row("structure.inlinks.none", "url", None,
        "FROM crawl WHERE is_html AND depth <> 0 AND url NOT IN (SELECT target_url FROM edges WHERE is_internal)"),
    "structure.outlinks.none": f"WITH {_CRAWL}, {_EDGES} " + _row("structure.outlinks.none", "url", None,
        "FROM crawl WHERE is_html AND url NOT IN (SELECT source_url FROM edges)"),
    "structure.outlinks.many": f"WITH {_CRAWL}, {_EDGES} " + _row("structure.outlinks.many", "source_url",
        "{'count': count(*), 'threshold': 100}", "FROM edges GROUP BY source_url HAVING count(*) > 100"),
    "structure.anchor.generic": f"WITH {_CRAWL}, {_EDGES} " + _row("structure.anchor.generic", "source_url",
        "{'anchor': anchor_text, 'target': target_url}", f"FROM edges WHERE lower(anchor_text) IN {_GENERIC}"),
    "structure.anchor.ambiguous": f"WITH {_CRAWL}, {_EDGES}, a AS (SELECT lower(anchor_text) AS anchor, list_sort(list(DISTINCT target_url)) AS targets, list(DISTINCT source_url) AS sources FROM edges WHERE anchor_text <> '' GROUP BY 1 HAVING count(DISTINCT target_url) > 1) "
    + _row("structure.anchor.ambiguous", "unnest(sources)", "{'anchor': anchor, 'targets': targets[1:5]}", "FROM a"),
    "structure.canonical.cross_domain": f"WITH {_CRAWL} " + _row("structure.canonical.cross_domain", "url",
        "{'canonical': canonical, 'canonical_host': regexp_extract(canonical, '^https?://([^/:]*)', 1)}",
        f"FROM crawl WHERE is_html AND canonical <> url AND NOT ({_SITE.format('canonical')})"),
    "structure.canonical.mismatch": f"WITH {_CRAWL} " + _row("structure.canonical.mismatch", "url",
        "{'canonical': canonical}", f"FROM crawl WHERE is_html AND canonical <> url AND {_SITE.format('canonical')}"),
    "structure.redirect.loop": f"WITH {_CRAWL} " + _row("structure.redirect.loop", "url",
        "{'chain': list_append(chain, url)}",
        "FROM crawl WHERE len(chain) > 0 AND len(list_distinct(list_append(chain, url))) < len(chain) + 1"),
    "structure.redirect.long_chain": f"WITH {_CRAWL} " + _row("structure.redirect.long_chain", "url",
        "{'hops': len(chain), 'chain': chain}",
        "FROM crawl WHERE len(chain) > 2 AND len(list_distinct(list_append(chain, url))) = len(chain) + 1"),
    "structure.external_link.broken": f"WITH {_CRAWL}, {_EDGES}, {_LINK_STATUS} " + _row(
        "structure.external_link.broken", "source_url", "{'target': url, 'status_code': status_code}",
        "FROM edges JOIN status ON target_url = url WHERE status_code >= 400"),
    "structure.external_link.unreachable": f"WITH {_CRAWL}, {_EDGES}, {_LINK_STATUS} " + _row(
        "structure.external_link.unreachable", "source_url", "{'target': url}",
        "FROM edges JOIN status ON target_url = url WHERE status_code IS NULL"),
    "structure.sitemap.in_sitemap_only": f"WITH {_CRAWL}, {_SITEMAP} " + _row("structure.sitemap.in_sitemap_only",
        "url", None, f"FROM (SELECT DISTINCT url FROM named WHERE {_SITE.format('url')} AND url NOT IN (SELECT url FROM crawl WHERE is_html))"),
    "structure.sitemap.in_crawl_only": f"WITH {_CRAWL}, {_SITEMAP} " + _row("structure.sitemap.in_crawl_only", "url",
        None, f"FROM crawl WHERE is_html AND url NOT IN (SELECT url FROM named WHERE {_SITE.format('url')})"),
}

_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"
_DOCS = r"""docs AS (SELECT 'https://' || source || '.example.com/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'Angebot für Angebot ' ELSE '' END || substr(split_part(text, chr(10), 1), 1, 80) AS title, CASE WHEN doc_id % 4 = 0 THEN 'Rabatt, Rabatt ' ELSE '' END || substr(split_part(text, chr(10), -1), 1, 80) AS h1, text,
    len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS words, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM documents)"""
_TOP = f"""t AS (SELECT url, w, min(i) AS place, count(*) AS n FROM (SELECT url, unnest({_WORDS.format("{c}")}) AS w, generate_subscripts({_WORDS.format("{c}")}, 1) AS i FROM docs) WHERE length(w) >= 4 AND w NOT IN {_STOP} GROUP BY url, w),
k AS (SELECT url, w FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, place) = 1)"""
_TOP_H1 = _TOP.replace("t AS", "t2 AS", 1).replace("k AS", "k2 AS", 1).replace("FROM t ", "FROM t2 ")

#: The crawled pages in the shape of _DOCS.
_CRAWL_DOCS = rf"""main AS (SELECT url, coalesce(title, '') AS title, trim({_plain("regexp_extract(h, '<h1>(.*?)</h1>', 1)")}) AS h1, {_main_text("h")} AS text FROM crawl WHERE is_html),
docs AS (SELECT *, {_n_words("text")} AS words, sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) AS digest FROM main WHERE text <> '')"""

_CONTENT = {
    "content.thin": f"WITH {_DOCS} " + _row("content.thin", "url", "{'word_count': words, 'min': 100}",
        "FROM docs WHERE words < 100 AND text <> ''"),
    "content.duplicate.page": f"WITH {_DOCS}, e AS (SELECT * FROM docs WHERE words >= 50), g AS (SELECT digest, count(*) AS n, list_sort(list(url)) AS urls FROM e GROUP BY digest HAVING count(*) > 1) "
    + _row("content.duplicate.page", "e.url",
        "{'duplicate_of': list_filter(urls, lambda x: x <> e.url)[1:5], 'count': n}", "FROM e JOIN g USING (digest)"),
    "content.duplicate.near": f"""WITH {_DOCS}, e AS (SELECT DISTINCT ON (digest) digest, {_WORDS.format("text")} AS w FROM docs WHERE words >= 50),
s AS (SELECT DISTINCT digest, unnest(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM e),
c AS (SELECT digest, count(*) AS n FROM s GROUP BY digest), o AS (SELECT a.digest AS a, b.digest AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.digest <> b.digest GROUP BY 1, 2),
j AS (SELECT a, b, common / (x.n + y.n - common) AS similarity FROM o JOIN c x ON x.digest = a JOIN c y ON y.digest = b WHERE common >= 0.85::DOUBLE * (x.n + y.n - common)) """
    + _row("content.duplicate.near", "d.url", "{'similar_to': f.url, 'similarity': round(similarity, 3)}",
        "FROM j JOIN docs d ON d.digest = a JOIN docs f ON f.digest = b WHERE d.words >= 50 AND f.words >= 50"),
    "content.block.repeated": f"""WITH {_DOCS}, b AS (SELECT DISTINCT url, trim(regexp_replace(unnest(string_split(text, chr(10))), '\\s+', ' ', 'g')) AS block FROM docs), g AS (SELECT block, count(*) AS n FROM b WHERE len(string_split(block, ' ')) >= 5 GROUP BY block HAVING count(*) > 3) """
    + _row("content.block.repeated", "url", "{'excerpt': substr(block, 1, 200), 'page_count': n, 'threshold': 3}",
        "FROM b JOIN g USING (block)"),
    "content.keyword.title_not_in_body": f"WITH {_DOCS}, {_TOP.replace('{c}', 'title')} " + _row(
        "content.keyword.title_not_in_body", "url", "{'keyword': w, 'source': 'title'}",
        f"FROM k JOIN docs USING (url) WHERE NOT list_contains({_WORDS.format('text')}, w)"),
    "content.keyword.h1_not_in_body": f"WITH {_DOCS}, {_TOP.replace('{c}', 'title')}, {_TOP_H1.replace('{c}', 'h1')} "
    + _row("content.keyword.h1_not_in_body", "docs.url", "{'keyword': k2.w, 'source': 'h1'}",
        f"FROM k2 JOIN docs USING (url) LEFT JOIN k USING (url) WHERE k2.w IS DISTINCT FROM k.w AND NOT list_contains({_WORDS.format('text')}, k2.w)"),
    "content.keyword.cannibalization": f"""WITH {_DOCS}, {_TOP.replace("{c}", "text")}, top AS (SELECT url, w FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, place) <= 3), g AS (SELECT w, list_sort(list(url)) AS urls FROM top GROUP BY w HAVING count(*) > 1) """
    + _row("content.keyword.cannibalization", "top.url",
        "{'keyword': w, 'competing_with': list_filter(urls, lambda x: x <> top.url)[1:5]}",
        "FROM top JOIN g USING (w)"),
    "content.spelling.errors": "WITH s AS (SELECT 'https://x.example/' || doc_id AS url, doc_id, doc_id % 9 AS n FROM documents WHERE doc_id % 13 <> 0) "
    + _row("content.spelling.errors", "url",
        "{'count': n, 'min_errors': 5, 'top_rules': ['R0', 'R1', 'R2'], 'examples': list_transform(range(5), lambda i: {'rule_id': 'R' || (i % 3), 'message': 'm' || i, 'excerpt': 'e' || doc_id, 'suggestions': ['a', 'b', 'c']})}", "FROM s WHERE n >= 5"),
}

RULE_SQL = {i: page_rule(i) for i in PAGE_RULES} | _PAGE_SETS | _CONTENT

def _inner(sql: str) -> str:
    """The statement inside another that has crawl; rules on documents read the crawled pages there."""
    return "(" + sql.replace(f"WITH {_CRAWL} ", "").replace(f"WITH {_CRAWL}, ", "WITH ").replace(_DOCS,
        _CRAWL_DOCS) + ")"


#: Spelling results of the crawled pages, made as those of documents are.
_PAGE_SPELLING = _CONTENT["content.spelling.errors"].replace(
    "'https://x.example/' || doc_id AS url, doc_id, doc_id % 9 AS n FROM documents WHERE doc_id % 13 <> 0",
    "url, p AS doc_id, p % 9 AS n FROM crawl WHERE is_html AND p % 13 <> 0")
_FOUND = [PAGE_FINDINGS, *(_inner(q) for q in _PAGE_SETS.values()),
    *(_inner(_PAGE_SPELLING if i == "content.spelling.errors" else q) for i, q in _CONTENT.items())]
#: Stored issues: the findings of all rules, numbered.
_ISSUES = f"""{_CRAWL}, found AS ({" UNION ALL ".join(f"SELECT page_url, rule_id, category, severity, payload FROM {q}" if q.startswith("(") else q for q in _FOUND)}),
issues AS (SELECT row_number() OVER (ORDER BY rule_id, found.page_url, payload) AS id, found.*, crawl.page_id FROM found LEFT JOIN crawl ON crawl.url = found.page_url)"""
_RANK = "CASE severity WHEN 'critical' THEN 1 WHEN 'important' THEN 2 ELSE 3 END"
_MULTIPLIER = "CASE severity " + " ".join(f"WHEN '{s}' THEN {m}::DOUBLE" for s, m in MULTIPLIER.items()) + " END"
_SCORES = f"""{_RULES}, loads AS (SELECT category, sum(coalesce(n, 0) * weight * {_MULTIPLIER}) AS load, sum(weight) * 1.5::DOUBLE * (SELECT count(*) FROM crawl WHERE is_html) AS capacity FROM rules LEFT JOIN (SELECT rule_id, count(*) AS n FROM issues GROUP BY rule_id) USING (rule_id) GROUP BY category),
scores AS (SELECT category, round(greatest(0::DOUBLE, least(100::DOUBLE, 100 * (1 - load / capacity))), 2) AS score FROM loads)"""


def _crawls_of(rest: str) -> str:
    return f"SELECT * FROM issues WHERE page_id % 3 <> {rest}"


SQL = {
    "page_titles": f"WITH {_CRAWL} SELECT url, title, length(title) AS n FROM crawl WHERE is_html",
    "page_headings": f"WITH {_CRAWL} SELECT url, h1_count::INT AS h1_count, array_to_string(list_transform(levels, lambda x: 'h' || x), ',') AS levels FROM crawl WHERE is_html",
    "page_facts": f"WITH {_CRAWL} SELECT url, lang AS language, charset, description AS meta_description, robots AS meta_robots, canonical AS canonical_url, sha256(h) AS content_hash, bytes AS html_size, coalesce(NOT list_has_any({_ROBOTS}, ['noindex', 'none']), true) AS is_indexable FROM crawl WHERE is_html",
    "page_links": f"WITH {_CRAWL}, {_EDGES} SELECT source_url, target_url, anchor_text, is_internal, is_followed FROM edges",
    "page_images": f"WITH {_CRAWL} SELECT page_id, unnest(CASE p % 8 WHEN 0 THEN ['/i/1.png', '/i/2.png'] ELSE ['https://cdn.example.net/p.png'] END) AS src, unnest(CASE p % 8 WHEN 0 THEN [true, false] ELSE [false] END) AS has_alt FROM crawl WHERE is_html AND p % 8 IN (0, 1)",
    "page_resources": f"WITH {_CRAWL}, {_RESOURCES} SELECT page_url, url, kind AS resource_type FROM res",
    "page_text_stats": rf"WITH {_CRAWL}, t AS (SELECT *, {_visible('h')} AS seen, {_main_text('h')} AS main FROM crawl WHERE is_html) SELECT page_id, len(regexp_extract_all(seen, '[\p{{L}}\p{{N}}_]+'))::INT AS word_count, substr(seen, 1, 500) AS text_excerpt, {_n_words('main')}::INT AS main_word_count, len(regexp_extract_all(h, '<strong>'))::INT AS strong_count, len(regexp_extract_all(h, '<b>'))::INT AS bold_count FROM t",
    "main_content": f"SELECT page_id, main AS main_text, {_n_words('main')}::INT AS main_word_count FROM (SELECT page_id, {_main_text('html')} AS main FROM pages)",
    "content_blocks": r"SELECT DISTINCT doc_id, block FROM (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, chr(10))), '\s+', ' ', 'g')) AS block FROM documents) WHERE len(string_split(block, ' ')) >= 5",
    "url_parts": rf"SELECT page_id, regexp_replace(url, '#.*$', '') AS normalized, regexp_extract(url, '^https?://([^/?#]*)', 1) AS host, regexp_replace(regexp_extract(url, '^https?://([^/?#]*)', 1), '^www\.', '') = 'audit.example' AS same_site, {_DEPTH.replace('url', 'u')} AS depth, {_SESSION.replace('(url,', '(u,')} AS has_session_id, {_url(3).replace('(url', '(u')} <> '' AS has_params FROM (SELECT *, regexp_replace(url, '#.*$', '') AS u FROM pages)",
    "rule_catalog": f"WITH {_RULES} SELECT ord, rule_id, category, severity, weight FROM rules",
    "category_scores": f"WITH {_ISSUES}, {_SCORES} SELECT category, score FROM scores",
    "overall_score": f"WITH {_ISSUES}, {_SCORES} SELECT round(avg(score), 2) AS score FROM scores",
    "crawl_summary": f"WITH {_ISSUES} SELECT CASE grouping(rule_id, category, severity) WHEN 0 THEN 'rule' WHEN 5 THEN 'category' WHEN 6 THEN 'severity' ELSE 'total' END AS level, rule_id, category, severity, count(*) AS count FROM issues GROUP BY GROUPING SETS ((rule_id, category, severity), (category), (severity), ())",
    "severity_histogram": f"WITH {_ISSUES} SELECT s.severity, count(issues.id) AS count FROM (VALUES ('critical'), ('important'), ('tip')) s(severity) LEFT JOIN issues USING (severity) GROUP BY s.severity",
    "rule_summary": f"WITH {_ISSUES}, {_RULES} SELECT rule_id, rules.category, rules.severity, count(*) AS count, array_to_string(list_sort(list(id))[1:5], ',') AS example_ids FROM issues JOIN rules USING (rule_id) GROUP BY ALL",
    "rules_passing": f"WITH {_ISSUES}, {_RULES} SELECT rule_id, category FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM issues)",
    "issue_list": f"WITH {_ISSUES} SELECT id, rule_id, severity, page_url FROM issues WHERE category = 'tech_meta' AND lower(rule_id) LIKE '%title%' ORDER BY severity DESC, id LIMIT 50 OFFSET 10",
    "page_list_with_issues": f"WITH {_ISSUES} SELECT page_id, url, depth FROM crawl WHERE page_id IN (SELECT page_id FROM issues) ORDER BY depth, page_id LIMIT 100",
    "page_list_without_issues": f"WITH {_ISSUES} SELECT page_id, url, depth FROM crawl WHERE page_id NOT IN (SELECT page_id FROM issues WHERE severity = 'critical') ORDER BY depth, page_id LIMIT 100",
    "page_list_not_in_nulls": f"WITH {_ISSUES} SELECT page_id, url, depth FROM crawl WHERE page_id NOT IN (SELECT page_id FROM issues) ORDER BY depth, page_id LIMIT 100",
    "page_detail": f"WITH {_ISSUES}, {_EDGES}, {_RESOURCES} SELECT page_id, url, (SELECT count(*) FROM edges WHERE edges.p = crawl.p) AS n_links, (SELECT count(*) FROM res WHERE res.page_url = crawl.url) AS n_resources, (SELECT count(*) FROM issues WHERE issues.page_id = crawl.page_id) AS n_issues FROM crawl",
    "crawl_compare": f"WITH {_ISSUES}, a AS ({_crawls_of('0')} UNION ALL SELECT * FROM issues WHERE page_id IS NULL AND id % 2 = 0), b AS ({_crawls_of('1')} UNION ALL SELECT * FROM issues WHERE page_id IS NULL AND id % 2 = 1), x AS (SELECT rule_id, CASE WHEN page_id IS NOT NULL THEN page_url END AS page_url, severity, payload FROM a QUALIFY row_number() OVER (PARTITION BY rule_id, CASE WHEN page_id IS NOT NULL THEN page_url END ORDER BY id) = 1), y AS (SELECT rule_id, CASE WHEN page_id IS NOT NULL THEN page_url END AS page_url, severity, payload FROM b QUALIFY row_number() OVER (PARTITION BY rule_id, CASE WHEN page_id IS NOT NULL THEN page_url END ORDER BY id) = 1) "
    "SELECT CASE WHEN x.rule_id IS NULL THEN 'new' WHEN y.rule_id IS NULL THEN 'resolved' ELSE 'persistent' END AS bucket, coalesce(y.rule_id, x.rule_id) AS rule_id, CASE WHEN y.rule_id IS NULL THEN x.page_url ELSE y.page_url END AS page_url, coalesce(y.severity, x.severity) AS severity, coalesce(y.payload, x.payload) AS payload FROM x FULL JOIN y ON x.rule_id = y.rule_id AND x.page_url IS NOT DISTINCT FROM y.page_url",
    "dashboard_latest_two": "WITH c AS (SELECT o_custkey, o_orderkey, (floor(o_totalprice)::BIGINT % 1000) / 10.0::DOUBLE AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS n FROM orders WHERE o_orderstatus = 'F'), two AS (SELECT o_custkey, max(CASE WHEN n = 1 THEN o_orderkey END) AS latest_id, max(CASE WHEN n = 1 THEN score END) AS latest_score, max(CASE WHEN n = 2 THEN o_orderkey END) AS previous_id, max(CASE WHEN n = 2 THEN score END) AS previous_score FROM c WHERE n <= 2 GROUP BY o_custkey) SELECT c_custkey AS project_id, latest_id, latest_score, previous_id, previous_score, floor((latest_score - previous_score) * 10 + 0.5::DOUBLE) / 10 AS delta FROM customer LEFT JOIN two ON c_custkey = o_custkey",
    "scheduler_due": "WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 60 * (c_custkey % 5 + 1) END AS every, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 48 - 24)::INT END AS next FROM customer) SELECT id FROM p WHERE every IS NOT NULL AND next <= TIMESTAMP '2024-01-01'",
    "scheduler_tick": "WITH p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 4 <> 0 THEN 60 * (c_custkey % 5 + 1) END AS every, CASE WHEN c_custkey % 7 <> 0 THEN TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (c_custkey % 48 - 24)::INT END AS next FROM customer), d AS (SELECT id, every, id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS busy FROM p WHERE every IS NOT NULL AND next <= TIMESTAMP '2024-01-01') SELECT id AS project_id, CASE WHEN busy THEN 'skip' ELSE 'enqueue' END AS action, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 MINUTE * every::INT, '%Y-%m-%d %H:%M:%S') AS next_at FROM d",
    "scheduler_tick_counts": "WITH p AS (SELECT c_custkey AS id FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 48 <= 24), d AS (SELECT id IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS busy FROM p) SELECT count(*) FILTER (NOT busy) AS enqueued, count(*) FILTER (busy) AS skipped_in_flight, count(*) AS advanced FROM d",
    "compare_candidates": "SELECT o_custkey AS project_id, o_orderkey AS id FROM (SELECT *, max(o_orderkey) OVER (PARTITION BY o_custkey) AS latest FROM orders) WHERE o_orderstatus = 'F' AND o_orderkey <> latest",
    "sitemap_parse": r"SELECT page_id, regexp_replace(url, '#.*$', '') AS url FROM pages UNION ALL SELECT page_id, regexp_extract(url, '^(https?://[^/]*)', 1) || '/rel/' || page_id FROM pages",
    "sitemap_walk": "SELECT 'https://s.example/' || (page_id % 10) || '/' || page_id AS url FROM pages WHERE page_id % 10 < 5",
    "robots_allowed": "SELECT page_id, NOT (page_id % 2 = 0 AND regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) LIKE '/fr/%' AND regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) NOT LIKE '/fr/1%') AS allowed FROM pages",
    "crawl_bfs": "WITH RECURSIVE n AS (SELECT count(*) AS n FROM pages), e AS (SELECT page_id AS a, unnest([page_id * 2 + 1, page_id * 2 + 2, page_id * 7]) % n AS b FROM pages, n WHERE page_id < n), r AS (SELECT 0::BIGINT AS id, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN e ON a = id WHERE depth < (SELECT 2 + ceil(log2(n + 1)) FROM n)) SELECT 'https://s.example/' || id AS url, min(depth)::INT AS depth FROM r GROUP BY id",
    "crawl_totals": f"WITH {_CRAWL} SELECT count(*) AS pages_seen, count(*) FILTER (fetch_error IS NULL AND status_code BETWEEN 200 AND 399) AS pages_fetched FROM crawl",
    "spelling_languages": "SELECT doc_id, CASE lang WHEN 'de' THEN 'de-DE' WHEN 'en' THEN 'en-US' WHEN 'fr' THEN 'fr' WHEN 'es' THEN 'es' ELSE 'auto' END AS language FROM documents",
    "score_formats": "WITH s AS (SELECT c_custkey, CASE WHEN c_custkey % 11 <> 0 THEN (c_custkey % 101)::DOUBLE END AS score, (c_custkey % 21 - 10)::DOUBLE AS delta FROM customer) SELECT c_custkey, CASE WHEN score IS NULL THEN '—' ELSE score::INT || '%' END AS score, CASE WHEN score IS NULL THEN 'score-na' WHEN score >= 80 THEN 'score-good' WHEN score >= 60 THEN 'score-mid' ELSE 'score-bad' END AS class, CASE WHEN delta = 0 THEN '±0' WHEN delta > 0 THEN '+' || delta::INT ELSE (delta::INT)::VARCHAR END AS delta FROM s",
    "issues_csv": f"WITH {_ISSUES} SELECT id AS issue_id, rule_id, category, severity, CASE WHEN page_id IS NULL THEN '' ELSE page_url END AS page_url, coalesce(page_id::VARCHAR, '') AS page_id, CASE WHEN payload = '{{}}' THEN '' ELSE payload END AS payload, '2024-01-01T00:00:00Z' AS created_at FROM issues",
}
