"""What near_text_classes makes of a text: shingles without keywords, sketches by the plain formula."""

import numpy as np
import pytest

from auditlake.operators import content, sketches
from auditlake.plans import catalog, jobs
from tests.conftest import SMALL


def test_classes_need_no_keywords(spark, monkeypatch):
    monkeypatch.setattr(catalog, "_facts", lambda *a: pytest.fail("facts were made"))
    monkeypatch.setattr(catalog, "made", lambda *a: False, raising=False)
    found = jobs.near_text_classes(spark, SMALL)
    assert found.count() == content.text_members(catalog._texts(spark, SMALL)).count() > 0


def test_classes_by_sets_and_by_facts_are_the_same(spark):
    texts = catalog._texts(spark, SMALL)
    rows = lambda x: sorted(map(tuple, content.text_classes(x).collect()))
    assert rows(content.text_sets(texts).checkpoint()) == rows(content.text_facts(texts).checkpoint()) == rows(texts)


def test_a_sketch_has_the_least_value_of_each_function(monkeypatch):
    monkeypatch.setattr(sketches, "_AT_A_TIME", 7)
    rng = np.random.default_rng(1)
    shingles, starts = rng.integers(-(1 << 63), (1 << 63) - 1, 50, dtype=np.int64), np.array([0, 3, 3, 20, 50])
    factors, terms = sketches.hash_functions()
    values = (shingles.astype(np.uint64)[:, None] * factors + terms) >> np.uint64(32)
    got = sketches.sketch(shingles, starts)
    for i, (a, b) in enumerate(zip(starts, [*starts[1:], 50])):
        assert (got[i] == (values[a:b].min(0) if b > a else np.uint64(0xFFFFFFFF))).all()
