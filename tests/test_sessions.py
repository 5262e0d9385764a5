import random

import pytest

from listenloom.operators.intervals import merge_intervals
from listenloom.operators.ordered import exact_quantile, global_rank, grouped_quantiles, histories, lagged_pairs, sessionized
from listenloom.operators import session_table
from listenloom.operators.session_table import SessionTable
from listenloom.runtime import fresh_path, hadoop_fs, shared_dir
from pyspark.sql import functions as F

EVENTS = "play_id bigint, user_id string, ts bigint, owner string, start string, n string"


def _events(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], EVENTS)


def _brute(rows, gap=1800):
    out = []
    seen = {i: (u, t) for i, u, t in rows if i is not None and u is not None and t is not None}
    for u, t in sorted(seen.values()):
        if out and out[-1][0] == u and t - out[-1][2] <= gap:
            out[-1][2:] = [t, out[-1][3] + 1]
        else:
            out.append([u, t, t, 1])
    return sorted(map(tuple, out))


def _table(df):
    return sorted((r.owner, r.start, r.stop, r.n) for r in df.collect())


def test_gap_of_1800_stays_inside(spark):
    df = _events(spark, [(i, "u", t) for i, t in enumerate([0, 1800, 3601, 9000])])
    got = merge_intervals(df, "user_id", "ts", "ts", None, 1800)
    assert _table(got) == [("u", 0, 1800, 2), ("u", 3601, 3601, 1), ("u", 9000, 9000, 1)]


@pytest.mark.parametrize("width", [2000, 5000, 10**9])
def test_intervals_over_slices(spark, width):
    r = random.Random(4)
    rows = []
    for _ in range(300):
        s = r.randrange(200_000)
        rows.append((r.choice("ab"), s, s + r.choice([0, 10, 3000, 9000]), 1))
    rows += [(None, 1, 2, 1), ("a", None, 2, 1), ("a", 1, None, 1)]
    df = spark.createDataFrame(rows, "o string, s bigint, e bigint, k bigint")
    want = []
    for o, s, e, _ in sorted(x for x in rows if None not in x):
        if want and want[-1][0] == o and s - want[-1][2] <= 100:
            want[-1][2:] = [max(want[-1][2], e), want[-1][3] + 1]
        else:
            want.append([o, s, e, 1])
    assert _table(merge_intervals(df, "o", "s", "e", "k", 100, width)) == sorted(map(tuple, want))


@pytest.mark.parametrize("batches", [1, 4])
def test_batches_in_any_order_give_the_same_table(spark, batches):
    r = random.Random(batches)
    rows = [(i, r.choice(["hot", "hot", "u1", "u2", None]), r.randrange(400_000)) for i in range(400)]
    rows += r.sample(rows, 80) + [(None, "u1", 5), (9999, "u1", None)]
    r.shuffle(rows)
    table = SessionTable(spark, fresh_path(spark, "t"), buckets=4, slice_seconds=10_000)
    for k in range(batches):
        table.apply(_events(spark, rows[k::batches]))
    assert _table(table.sessions()) == _brute(rows)


def test_empty_batches_and_bridges(spark):
    table = SessionTable(spark, fresh_path(spark, "t"), buckets=2)
    assert table.sessions().count() == 0
    table.apply(_events(spark, []))
    table.apply(_events(spark, [(1, "u", 1000), (2, "u", 4600), (3, "v", 1)]))
    assert _table(table.sessions()) == [("u", 1000, 1000, 1), ("u", 4600, 4600, 1), ("v", 1, 1, 1)]
    before = table._manifest()
    table.apply(_events(spark, [(4, "u", 2800)]))
    assert _table(table.sessions()) == [("u", 1000, 4600, 3), ("v", 1, 1, 1)]
    after = table._manifest()["parts"]
    assert sum(after.get(k) == p for k, p in before["parts"].items()) >= len(before["parts"]) - 1


def test_a_batch_rewrites_only_the_parts_it_reaches(spark):
    year, rows = 365 * 86_400, []
    for i in range(600):
        rows.append((i, f"u{i % 40}", (i * 52_561) % year))
    table = SessionTable(spark, fresh_path(spark, "t"), buckets=4)
    table.apply(_events(spark, rows))
    before = table._manifest()["parts"]
    assert len(before) > 12
    late = [(1000, "u1", 100 * 86_400), (1001, "u1", 100 * 86_400 + 60), (1002, "u2", 300 * 86_400)]
    table.apply(_events(spark, late))
    after = table._manifest()["parts"]
    assert sum(after[k] != p for k, p in before.items()) <= 2
    assert _table(table.sessions()) == _brute(rows + late)
    # a session that runs on over the end of an era is met from the era after it
    edge = 91 * 86_400
    more = [(2000, "u3", edge - 900), (2001, "u3", edge + 500)]
    table.apply(_events(spark, more))
    table.apply(_events(spark, [(2002, "u3", edge + 2000), (2001, "u3", edge + 500)]))
    assert _table(table.sessions()) == _brute(rows + late + more + [(2002, "u3", edge + 2000)])


def test_old_parts_are_deleted_and_the_ledger_is_merged(spark, monkeypatch):
    monkeypatch.setattr(session_table, "FANOUT", 3)
    table, rows = SessionTable(spark, fresh_path(spark, "t"), buckets=1, keep=1), []
    for k in range(4):
        rows.append((k, "u", 1000 * k))
        table.apply(_events(spark, rows[-1:] + rows[:1]))
    m = table._manifest()
    assert [x["level"] for x in m["ledger"]] == [1, 0] and list(table._versions()) == [4]
    fs, p = hadoop_fs(spark, f"{table.path}/parts")
    assert len(fs.listStatus(p)) == 1 and _table(table.sessions()) == _brute(rows)
    assert all(fs.exists(hadoop_fs(spark, x["path"])[1]) for x in [*m["parts"].values(), *m["ledger"]])
    assert len(fs.listStatus(hadoop_fs(spark, f"{table.path}/ledger")[1])) == 2


def test_an_unfinished_batch_is_invisible_and_can_be_repeated(spark, monkeypatch):
    table = SessionTable(spark, fresh_path(spark, "t"), buckets=2)
    table.apply(_events(spark, [(1, "u", 1000)]))
    with monkeypatch.context() as m:
        m.setattr(SessionTable, "_commit", lambda *_: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.apply(_events(spark, [(2, "u", 1500)]))
    assert _table(table.sessions()) == [("u", 1000, 1000, 1)]
    table.apply(_events(spark, [(2, "u", 1500)]))
    assert _table(table.sessions()) == [("u", 1000, 1500, 2)]
    stale = SessionTable(spark, table.path)
    monkeypatch.setattr(stale, "_manifest", lambda: {"version": 1, "parts": {}, "ledger": []})
    with pytest.raises(RuntimeError):
        stale.apply(_events(spark, [(3, "u", 9)]))
    with pytest.raises(ValueError):
        SessionTable(spark, "x", gap=10, slice_seconds=10)


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_sequence_numbers(spark):
    r = random.Random(8)
    rows = [(r.choice("abc"), r.randrange(3_000_000), i, r.randrange(5)) for i in range(300)]
    df = spark.createDataFrame(rows, "user_id string, ts bigint, seq bigint, item_id bigint")
    got = {x.seq: x for x in sessionized(df).collect()}
    session, before = 0, None
    pos = {}
    for u, t, s, _ in sorted(rows):
        p = pos[u] = pos.get(u, -1) + 1
        gap = None if before is None or before[0] != u else t - before[1]
        session += gap is None or gap > 1800
        assert (got[s].pos, got[s].gap_s, got[s].session_id) == (p, gap, session)
        before = (u, t)


def test_lags_and_histories_over_blocks(spark):
    rows = [("u", p, p * 10) for p in range(40)] + [("v", p, p) for p in range(3)]
    df = spark.createDataFrame(rows, "user_id string, pos bigint, item_id bigint")
    got = {(r.user_id, r.pos, r.lag) for r in lagged_pairs(df, 3, ["item_id"], block=7).where("next_item_id is not null").collect()}
    assert got == {(u, p, k) for u, n in (("u", 40), ("v", 3)) for p in range(n) for k in (1, 2, 3) if p + k < n}
    asked = spark.createDataFrame([("a", "u", 33), ("b", "u", 0), ("c", "v", 2), ("d", "u", 4)], "instance_id string, user_id string, pos bigint")
    past = {}
    for r in histories(asked, df, 8, ["item_id"]).collect():
        past.setdefault(r.instance_id, set()).add(r.pos)
    assert past == {"a": set(range(25, 33)), "c": {0, 1}, "d": {0, 1, 2, 3}}


def test_ranks_and_quantiles(spark):
    r = random.Random(1)
    values = [r.randrange(500) for _ in range(3000)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v bigint, i bigint")
    ranked = sorted((x.k, x.v, x.i) for x in global_rank(df, [F.col("v"), F.col("i")], "k").collect())
    assert [x[0] for x in ranked] == list(range(3000)) and [x[1:] for x in ranked] == sorted((v, i) for i, v in enumerate(values))
    import numpy as np

    for q in (0.0, 0.1, 0.85, 1.0):
        assert exact_quantile(df, "v", q, few=20) == pytest.approx(np.quantile(values, q))
    assert exact_quantile(df.where("false"), "v", 0.5) is None
    groups = df.withColumn("g", F.col("i") % 3).withColumn("v", F.when(F.col("i") % 7 > 0, F.col("v")))
    got = {(x.g, x.q): x.value for x in grouped_quantiles(groups, "g", "v", [0.0, 0.5, 0.9, 1.0]).collect()}
    for g in range(3):
        own = [v for i, v in enumerate(values) if i % 3 == g and i % 7]
        for q in (0.0, 0.5, 0.9, 1.0):
            assert got[g, q] == pytest.approx(np.quantile(own, q))
