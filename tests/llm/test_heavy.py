import random
from collections import Counter

import pytest

from listenloom.llm.heavy import SpaceSaving, frequent_values, heavy_summaries


def _plays(spark, values, parts=4):
    return spark.createDataFrame([(v, w, 1) for v, w in values], "artist string, track string, n_rows int").repartition(parts)


def test_against_exact_counts(spark):
    r = random.Random(1)
    rows = [(f"a{min(int(r.paretovariate(0.7)), 5000)}", None if r.random() < 0.3 else r.choice(["", "  ", " x", "x", "None"])) for _ in range(20_000)]
    got = {(x.field_name, x.field_value): x for x in frequent_values(_plays(spark, rows, 9), ["artist", "track"], 1 / 50, capacity=60).collect()}
    want = {}
    for k, field in enumerate(("artist", "track")):
        c = Counter(x[k] for x in rows if x[k] is not None and x[k].strip())
        want |= {(field, v): n for v, n in c.items() if n * 50 >= sum(c.values())}
    assert {k: x.n_rows for k, x in got.items()} == want
    assert all(x.lower_bound <= x.n_rows <= x.upper_bound for x in got.values())


def test_bounds_hold_through_a_merge_tree(spark):
    r = random.Random(2)
    rows = [(f"v{int(r.paretovariate(0.5)) % 3000}", None) for _ in range(15_000)]
    s = heavy_summaries(_plays(spark, rows, 40), ["artist"], capacity=30, fan_in=3).collect()
    c = Counter(x[0] for x in rows)
    assert len(s) == 1 and s[0].n_rows == 15_000 and s[0].floor <= 15_000 / 30
    held = dict(zip(s[0].value, zip(s[0].upper, s[0].error)))
    assert all(u - e <= c[v] <= u for v, (u, e) in held.items())
    assert all(n <= s[0].floor for v, n in c.items() if v not in held)


def test_one_value_third_of_rows_and_ties(spark):
    rows = [("hot", "x")] * 300 + [(f"a{i}", "x") for i in range(600)]
    got = {x.field_value for x in frequent_values(_plays(spark, rows), ["artist"], 1 / 900, capacity=1000).collect()}
    assert len(got) == 601


@pytest.mark.parametrize("rows", [[], [(None, None)], [("", "  "), ("\t", " ")]])
def test_nothing_to_count(spark, rows):
    assert frequent_values(_plays(spark, rows), ["artist", "track"], 0.1).count() == 0


def test_long_values_and_too_small_capacity(spark):
    long = "x" * 200_000
    assert [len(x.field_value) for x in frequent_values(_plays(spark, [(long, None)] * 3), ["artist"], 0.5).collect()] == [200_000]
    with pytest.raises(ValueError):
        frequent_values(_plays(spark, []), ["artist"], 0.01, capacity=50)


def test_summary_alone():
    s = SpaceSaving(2)
    s.add_counts(["a", "b", "c"], [5, 3, 1])
    s.shrink()
    assert s.floor == 1 and set(s.upper) == {"a", "b"}
    s.add_counts(["c"], [4])
    assert s.upper["c"] == 5 and s.error["c"] == 1
