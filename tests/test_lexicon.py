"""Spelling errors by the crawl's own words, against brute force."""

import json
import random
import re
from collections import Counter, defaultdict

import pytest

from auditlake.operators import content, lexicon
from auditlake.sources import spelling


def _slip(a, b):
    if len(a) == len(b):
        wrong = [i for i in range(len(a)) if a[i] != b[i]]
        return len(wrong) == 1 or len(wrong) == 2 and wrong[1] == wrong[0] + 1 and a[wrong[0]] == b[wrong[1]] and a[wrong[1]] == b[wrong[0]]
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def _errors(pages, known=10, rare=2, letters=5):
    count = Counter()
    for _, text, lang in pages:
        if text is not None:
            count.update((lang or "", w) for w in set(re.findall(r"[^\W\d_]+", text.lower())))
    out = {}
    for (lang, word), n in count.items():
        if n <= rare and len(word) >= letters:
            near = sorted((-m, k) for (g, k), m in count.items() if g == lang and m >= known and k != word and _slip(word, k))
            if near:
                out[lang, word] = [k for _, k in near[:5]]
    return out


def _slipped(r, word):
    i = r.randrange(len(word) - 1)
    return r.choice([word[:i] + word[i + 1 :], word[:i] + r.choice("aeöx") + word[i:], word[:i] + r.choice("aeöx") + word[i + 1 :],
        word[:i] + word[i + 1] + word[i] + word[i + 2 :], word + "q"])


@pytest.fixture(scope="module")
def pages():
    r = random.Random(5)
    words = {g: ["".join(r.choice("abcdeöß") for _ in range(r.randint(3, 9))) for _ in range(40)] for g in ("de", "en", None)}
    out = []
    for i in range(120):
        lang = r.choice(("de", "en", None))
        text = [r.choice(words[lang]) for _ in range(60)]
        for _ in range(r.randint(0, 4)):
            text.insert(r.randrange(len(text)), _slipped(r, r.choice(words[lang]) + "abc"[: r.randint(0, 3)]).title())
        out.append((f"u{i}", r.choice((" ", ", ", " - ")).join(text) + ".", lang))
    return [*out, ("none", None, "de"), ("empty", "", "de"), ("signs", "!!! 123 ...", "en"), ("again", out[0][1], out[0][2])]


def test_errors_equal_brute_force(spark, pages):
    frame = spark.createDataFrame(pages, "url string, main_text string, language string")
    got = {(r["language"], r["word"]): r["suggestions"] for r in lexicon.errors(frame).collect()}
    assert got == _errors(pages) and len(got) > 40


def test_matches_are_those_of_a_service(spark, pages):
    frame = spark.createDataFrame(pages, "url string, main_text string, language string")
    wrong, want = _errors(pages), defaultdict(list)
    for url, text, lang in pages:
        if text is not None:
            found = list(re.finditer(r"[^\W\d_]+", text))
            want[url] = [(text[max(0, m.start() - 20) : m.end() + 20].strip(), wrong[lang or "", m[0].lower()]) for m in found
                if (lang or "", m[0].lower()) in wrong]
    got = {r["url"]: [(" ".join(m["excerpt"].split()), m["suggestions"]) for m in r["matches"]] for r in lexicon.check(frame).collect()}
    assert got == {u: [(" ".join(e.split()), s) for e, s in found] for u, found in want.items()}
    findings = content.spelling_findings(lexicon.check(frame), least=2).collect()
    assert {f["page_url"] for f in findings} == {u for u, found in want.items() if len(found) >= 2} and findings
    assert all(json.loads(f["payload"])["top_rules"] == [lexicon.RULE_ID] for f in findings)


def test_words_of_texts_pass_no_exchange_before_the_filter(spark, pages, monkeypatch):
    plans, write = {}, lexicon.materialize
    monkeypatch.setattr(lexicon, "materialize", lambda df, name: (plans.__setitem__(name, df._jdf.queryExecution().executedPlan().toString()),
        write(df, name))[1])
    frame = spark.createDataFrame(pages, "url string, main_text string, language string").repartition(3).checkpoint()
    lexicon.check(frame)
    plan = plans["places"]
    between = plan[plan.index("getbit") : plan.index("Generate")]  # from the filter down to the texts' words
    assert "Exchange" not in between.replace("BroadcastExchange", "").split("BroadcastQueryStage")[0]


@pytest.mark.parametrize("rows", [[], [("u", "one two three", "en")]])
def test_texts_without_a_lexicon_have_no_errors(spark, rows):
    got = lexicon.check(spark.createDataFrame(rows, "url string, main_text string, language string")).collect()
    assert [(r["url"], r["matches"]) for r in got] == [(u, []) for u, *_ in rows]


def test_answers_of_odd_services(spark):
    from types import SimpleNamespace

    answers = {"a": {"matches": None}, "b": {}, "c": {"matches": [{"offset": 2, "length": 1, "rule": {"id": ""}, "replacements": None}]},
        "d": {"matches": [{"rule": None, "message": "m" * 400, "shortMessage": "s" * 90, "replacements": [{"value": v} for v in
            ("", None, *"123456")]}]}}

    def client(text, language):
        return SimpleNamespace(status_code=200, text="", json=lambda: answers[text[0]])

    rows = spark.createDataFrame([("a", "a text", "en"), ("b", "b text", "en"), ("c", "c text", "en"), ("d", "d text", "en")],
        "url string, main_text string, language string")
    got = {r["url"]: r["matches"] for r in spelling.check(rows, client).collect()}
    assert got["a"] == got["b"] == [] and got["c"][0]["rule_id"] == "unknown" and got["c"][0]["suggestions"] == []
    assert len(got["d"][0]["message"]) == 300 and len(got["d"][0]["short_message"]) == 80 and got["d"][0]["suggestions"] == list("12345")
