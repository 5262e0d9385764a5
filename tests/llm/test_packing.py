import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from listenloom.llm.packing import fill_report, pack_documents, plan_containers
from listenloom.llm.tokens import token_count, with_token_counts

SCHEMA = "doc_id bigint, text string, container_id string, tokens int, salt string, length string"


def _docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, "s", "l") for i, t in rows], SCHEMA)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=20))
def test_plan_holds_every_item_once_and_nothing_overflows(histogram):
    plan, made = plan_containers(histogram, 50)
    used, seen = {}, {}
    for length, a, b, first, each in plan:
        for rank in range(a, b):
            c = first + (rank - a) // each
            used[c] = used.get(c, 0) + length
            assert (length, rank) not in seen
            seen[length, rank] = c
    assert len(seen) == sum(histogram.values()) and all(n <= 50 for n in used.values()) and set(used) == set(range(made))
    total = sum(k * n for k, n in histogram.items())
    assert made <= 2 * total / 50 + 1  # no two containers would fit into one


def test_documents_round_trip(spark):
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(["harbour", "a", "lantern", "no"]) for _ in range(r.choice([0, 1, 5, 40, 300])))) for i in range(200)]
    rows += [(7, "same"), (7, "same"), (None, "nobody's text"), (900, None), (901, ""), (902, "word " * 3000)]
    packed = pack_documents(_docs(spark, rows), capacity=128).collect()
    fill, parts = {}, {}
    for p in packed:
        fill[p.container_id] = fill.get(p.container_id, 0) + p.n_tokens
        parts.setdefault(p.doc_id, []).append((p.piece, p.start_token, p.n_tokens))
    assert max(fill.values()) <= 128
    want = {}
    for i, t in rows:
        want[i] = want.get(i, 0) + token_count(t)
    assert {i: sum(n for *_, n in x) for i, x in parts.items()} == {i: n for i, n in want.items() if n}
    assert all(s == k * 128 for x in parts.values() for k, s, _ in x)
    assert all(len(x) == 1 for i, x in parts.items() if 0 < want[i] <= 128 and i != 7)
    report = fill_report(spark.createDataFrame(packed), 128).first()
    assert report.containers == len(fill) and report.fill > 0.97


def test_one_length_in_most_rows(spark):
    packed = pack_documents(_docs(spark, [(i, "harbour lantern") for i in range(3000)] + [(9999, "x")]), capacity=64)
    sizes = [r.t for r in packed.groupBy("container_id").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()]
    assert max(sizes) <= 64 and packed.count() == 3001


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "")]])
def test_nothing_to_pack(spark, rows):
    packed = pack_documents(_docs(spark, rows))
    assert packed.count() == 0
    assert tuple(fill_report(packed).first()) == (0, 0, 0, None)


def test_token_counts(spark):
    assert token_count(None) == token_count("") == 0
    assert token_count("<|endoftext|>") > 1
    assert token_count(" " * 300_000 + "x") > 0 and token_count("a" * 100_000) > 0
    space = "ab" + " " * 5000 + "cd"
    assert abs(token_count(space) - token_count("ab" + " " * 3000 + "cd")) < 2500
    got = with_token_counts(_docs(spark, [(1, "one two"), (2, None)]), name="tokens")
    assert "text" not in got.columns and {r.doc_id: r.tokens for r in got.collect()} == {1: token_count("one two"), 2: 0}
    with pytest.raises(ValueError):
        pack_documents(_docs(spark, []), capacity=0)
