import random
from collections import Counter
from itertools import combinations

import pytest

from listenloom.llm.cooccur import baskets_of, cooccurring_pairs

SCHEMA = "session_id bigint, items array<bigint>, item_a string, n_both int, basket string, salt int"


def _table(spark, rows):
    return spark.createDataFrame([(s, i, "clash", 1, "b", 2) for s, i in rows], SCHEMA).repartition(5)


def _brute(rows, min_count, lift):
    baskets = {}
    for s, items in rows:
        if s is not None and items:
            baskets.setdefault(s, set()).update(x for x in items if x is not None and x >= 2)
    baskets = {s: b for s, b in baskets.items() if b}
    single = Counter(x for b in baskets.values() for x in b)
    both = Counter(p for b in baskets.values() for p in combinations(sorted(b), 2))
    return {p: c for p, c in both.items() if c >= min_count and c * len(baskets) >= lift * single[p[0]] * single[p[1]]}


@pytest.mark.parametrize("how", [{}, {"buffer": 50, "block": 4, "salts": 1}, {"block": 3, "salts": 9}])
def test_against_brute_force(spark, how):
    r = random.Random(3)
    rows = []
    for s in range(500):
        g = r.randrange(40)
        items = [2 if r.random() < 0.4 else None, 0, 1] + [10 * g + r.randrange(6) + 5 for _ in range(r.randint(0, 6))] + [r.randrange(600) for _ in range(2)]
        rows.append((s, items))
        if s % 9 == 0:
            rows.append((s, items[::-1] + items[:2]))
    rows += [(None, [5, 6]), (900, None), (901, []), (902, [None, 1, 0])]
    got = {(x.item_a, x.item_b): x for x in cooccurring_pairs(_table(spark, rows), min_count=3, min_lift=5, **how).collect()}
    want = _brute(rows, 3, 5)
    assert {k: v.n_both for k, v in got.items()} == want and len(want) > 20
    assert all(v.lift >= 5 and v.llr > 0 for v in got.values())


def test_hot_item_is_left_out_without_loss(spark):
    rows = [(s, [7, 8 if s % 3 else 9, 100 + s % 50]) for s in range(300)]
    got = {(x.item_a, x.item_b) for x in cooccurring_pairs(_table(spark, rows), min_count=3, min_lift=1.4).collect()}
    assert got == set(_brute(rows, 3, 1.4))


def test_one_very_long_basket(spark):
    rows = [(s, list(range(2, 802)) if s == 0 else [2, 3]) for s in range(40)]
    assert {(x.item_a, x.item_b): x.n_both for x in cooccurring_pairs(_table(spark, rows), min_count=1, min_lift=39, block=100).collect()} == _brute(rows, 1, 39)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, [2, 3])], [(1, [2])]])
def test_no_pairs(spark, rows):
    assert cooccurring_pairs(_table(spark, rows), min_count=1, min_lift=0.5).count() == 0


def test_baskets_unite_deliveries(spark):
    got = baskets_of(_table(spark, [(1, [5, 6, 6]), (1, [7, None]), (2, [0, 1])]), "session_id", "items").collect()
    assert [(b.basket, sorted(b["items"])) for b in got] == [(1, [5, 6, 7])]
