import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listenloom.llm import mixing as M

DOCS = "doc_id bigint, source string, text string, n_tokens string, place int, pass int"


def _docs(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS)


def _targets(spark, rows):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def _text(n):
    return " ".join(["harbour"] * n)


def test_shares_repeats_and_names(spark):
    rows = [(i, "Big ", _text(20)) for i in range(600)] + [(1000 + i, "small-one", _text(20)) for i in range(50)] + [(2000, "loose", _text(9)), (2001, None, _text(9)), (2002, "big", None), (2003, "big", "")]
    draws, report = M.mix_sources(_docs(spark, rows), _targets(spark, [("BIG", 0.6, 1), ("small_one", 0.3, 4), ("absent", 0.1, 2), (None, 0.5, 1)]), block_docs=10)
    r = {x.source: x for x in report.collect()}
    assert r["big"].actual_share == pytest.approx(0.6 / 0.9, abs=0.01) and r["small_one"].actual_share == pytest.approx(0.3 / 0.9, abs=0.01)
    assert r["absent"].drawn_tokens == r["loose"].drawn_tokens == r[None].drawn_tokens == 0
    uses = Counter((d.source, d.doc_id) for d in draws.collect())
    assert max(n for (s, _), n in uses.items() if s == "small_one") <= 4 and max(n for (s, _), n in uses.items() if s == "big") == 1
    assert r["small_one"].passes == pytest.approx(4)


def test_budget_beyond_the_repeats_gives_way(spark):
    rows = [(i, "a", _text(10)) for i in range(300)] + [(1000 + i, "b", _text(10)) for i in range(30)]
    _, report = M.mix_sources(_docs(spark, rows), _targets(spark, [("a", 0.5, 3), ("b", 0.5, 2)]), budget=3300)
    r = {x.source: x for x in report.collect()}
    assert r["b"].passes == pytest.approx(2, abs=0.1) and r["a"].actual_share > 0.5
    assert r["a"].drawn_tokens + r["b"].drawn_tokens == pytest.approx(3300, rel=0.02)


def test_limits_temper_the_shares_of_whole_epochs(spark):
    rows = [(i, "a", _text(10)) for i in range(300)] + [(1000 + i, "b", _text(10)) for i in range(30)]
    targets = _targets(spark, [("a", 0.5, 3), ("b", 0.5, 2)])
    kept, report = M.mix_sources(_docs(spark, rows), targets, epochs=1.0, block_docs=3, stretch_blocks=4)
    r = {x.source: x for x in report.collect()}
    assert 0 < r["b"].exponent < 1 and r["b"].passes == pytest.approx(2, abs=0.1)
    assert r["a"].drawn_tokens + r["b"].drawn_tokens == pytest.approx(r["a"].tokens + r["b"].tokens, rel=0.02)
    assert {x.exponent for x in M.mix_sources(_docs(spark, rows), targets)[1].collect()} == {0.0}
    flat = {x.source: x for x in M.mix_sources(_docs(spark, rows), None, flatness=0.9, repeats=4)[1].collect()}
    shares = {s: x.planned_share for s, x in flat.items()}
    assert M.entropy(shares) == pytest.approx(0.9 * math.log(2), abs=1e-6) and 0 < flat["a"].exponent < 1
    assert flat["b"].passes == pytest.approx(4, abs=0.1) and flat["a"].actual_share == pytest.approx(shares["a"], abs=0.02)


@pytest.mark.parametrize(("docs", "targets"), [([], [("a", 0.5, 1)]), ([(1, "a", "x")], []), ([(1, None, "x")], [("a", 1.0, 1)]), ([(1, "a", "x")], [("a", None, None)]), ([(1, "a", "x")], [("a", -1.0, 2)])])
def test_nothing_to_draw(spark, docs, targets):
    draws, report = M.mix_sources(_docs(spark, docs), _targets(spark, targets))
    assert draws.count() == 0 and all(x.actual_share == 0 for x in report.collect())


def test_hot_source_repeated_rows_and_long_text(spark):
    rows = [(1, "hot", _text(3))] * 500 + [(2, "cold", _text(30_000))]
    draws, report = M.mix_sources(_docs(spark, rows), _targets(spark, [("hot", 0.5, 1), ("cold", 0.5, 1)]))
    r = {x.source: x for x in report.collect()}
    assert r["hot"].passes == pytest.approx(1) and r["cold"].drawn_tokens in (0, r["cold"].tokens)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**6), st.floats(0.01, 1), st.integers(1, 5)), min_size=1, max_size=6), st.one_of(st.none(), st.floats(1, 10**7)))
def test_weights_respect_repeats(sources, budget):
    tokens = {f"s{i}": t for i, (t, _, _) in enumerate(sources)}
    repeats = {f"s{i}": m for i, (*_, m) in enumerate(sources)}
    shares, total, exponent = M.mixing_weights(tokens, {f"s{i}": p for i, (_, p, _) in enumerate(sources)}, repeats, budget)
    assert sum(shares.values()) == pytest.approx(1) and 0 <= exponent <= 1
    assert all(total * p <= repeats[s] * tokens[s] * (1 + 1e-6) for s, p in shares.items())


def test_entropy_and_path():
    own = {"a": 0.9, "b": 0.1}
    wanted = 0.5
    assert M.entropy(M.temper_to_entropy(own, wanted)) == pytest.approx(wanted, abs=1e-6)
    assert M.entropy(M.temper_to_entropy(own, 9)) == pytest.approx(math.log(2))
    assert M.tempered({"a": 0.5, "b": 0.5}, own, 0) == pytest.approx({"a": 0.5, "b": 0.5})
    assert M.tempered({"a": 0.5, "b": 0.5}, own, 1) == pytest.approx(own)
    assert M.mixing_weights({}, {}, {}) == ({}, 0.0, 0.0)
