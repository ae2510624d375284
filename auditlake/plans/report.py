"""HTML reports of a crawl and of a comparison.

What a crawl's report collects is bounded by the number of rules; a comparison is streamed.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.operators.registry import CATEGORIES, SEVERITIES
from auditlake.plans.issues import examples, rule_summary, rules_passing, severity_histogram

LABELS = {"tech_meta": "Technik & Meta", "structure": "Struktur", "content": "Inhalt"}
SHOWN, PERSISTENT_SHOWN = 5, 20


def context(issues: DataFrame, pages: int, scores: dict[str, float | None]) -> dict:
    """What a report tells: pages, counts by severity, and by category its rules with up to five examples."""
    rules = rule_summary(issues, SHOWN)
    found = {r["id"]: r for r in examples(issues, SHOWN).collect()}  # at most five for each rule
    rows, passing = rules.collect(), rules_passing(issues).collect()
    return {
        "pages": pages,
        "by_severity": {r["severity"]: r["count"] for r in severity_histogram(issues).collect()},
        "categories": [
            {
                "category": c,
                "label": LABELS[c],
                "score": scores.get(c),
                "rules": [{"rule_id": r["rule_id"], "severity": r["severity"], "count": r["count"],
                        "examples": [found[i] for i in r["example_ids"]]} for r in rows if r["category"] == c],
                "passing": [r["rule_id"] for r in passing if r["category"] == c],
            }
            for c in CATEGORIES
        ],
    }


def score_text(score: float | None) -> tuple[str, str]:
    """(text, class) of a score."""
    if score is None:
        return "—", "score-na"
    return f"{score:.0f}%", "score-good" if score >= 80 else "score-mid" if score >= 60 else "score-bad"


def _page(title: str, body: str) -> str:
    return f'<!DOCTYPE html>\n<html lang="de"><head><meta charset="utf-8"><title>{escape(title)}</title></head>\n<body>\n<h1>{escape(title)}</h1>\n{body}</body></html>\n'


def render(data: dict, title: str) -> str:
    out = [f"<p>{data['pages']} Seiten</p>\n<ul>", *(f"<li>{s}: {data['by_severity'].get(s, 0)}</li>"
            for s in SEVERITIES), "</ul>\n"]
    for c in data["categories"]:
        text, kind = score_text(c["score"])
        out.append(f'<section><h2>{escape(c["label"])} <span class="{kind}">{text}</span></h2>\n')
        for r in c["rules"]:
            out.append(f'<h3 class="{r["severity"]}">{escape(r["rule_id"])} ({r["count"]})</h3><ul>')
            out += [f"<li>{escape(e['page_url'] or '—')}</li>" for e in r["examples"]]
            if r["count"] > len(r["examples"]):
                out.append(f"<li>… und {r['count'] - len(r['examples'])} weitere</li>")
            out.append("</ul>\n")
        out.append(f"<p>Ohne Befund: {escape(', '.join(c['passing']) or '—')}</p></section>\n")
    return _page(title, "".join(out))


def comparison_parts(compared: DataFrame, title: str) -> Iterator[str]:
    """The comparison page in pieces: all new and resolved issues, the first of the persistent ones.

    Rows are streamed one partition at a time, so a page of any length can be written to a file.
    """
    counts = {r["bucket"]: r["count"] for r in compared.groupBy("bucket").count().collect()}  # three rows at most
    head, tail = _page(title, "\0").split("\0")
    yield head
    for bucket, label, limit in (("new", "Neu", None), ("resolved", "Behoben", None),
            ("persistent", "Unverändert", PERSISTENT_SHOWN)):
        rows, n = compared.filter(F.col("bucket") == bucket), counts.get(bucket, 0)
        yield f"<section><h2>{label} ({n})</h2><ul>"
        for r in (rows if limit is None else rows.limit(limit)).toLocalIterator():
            yield f"<li>{escape(r['rule_id'])}: {escape(r['page_url'] or '—')}</li>"
        if limit is not None and n > limit:
            yield f"<li>… und {n - limit} weitere</li>"
        yield "</ul></section>\n"
    yield tail


def render_comparison(compared: DataFrame, title: str) -> str:
    return "".join(comparison_parts(compared, title))


def render_pdf(html: str, renderer) -> bytes:
    """PDF by a renderer that the caller provides, a function from HTML to bytes."""
    return renderer(html)
