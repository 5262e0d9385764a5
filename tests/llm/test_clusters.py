import numpy as np
import pytest

from listenloom.llm import clusters as C

SCHEMA = "session_id bigint, vectors array<float>, cluster int, reach string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash") for i, v in rows], SCHEMA)


def _groups(seed=0, sizes=(40, 25, 12), noise=6, dims=16, spread=0.12):
    r = np.random.default_rng(seed)
    centres = np.linalg.qr(r.normal(size=(dims, dims)))[0][: len(sizes)]
    rows, truth = [], {}
    for g, n in enumerate(sizes):
        for _ in range(n):
            v = centres[g] + spread * r.normal(size=dims)
            truth[len(rows)] = g
            rows.append((len(rows), (v * r.uniform(0.5, 20)).tolist()))
    odd = np.linalg.qr(r.normal(size=(dims, dims)))[0]
    for k in range(noise):
        rows.append((len(rows), odd[k].tolist()))
    return rows, truth


def _found(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.cluster, set()).add(r.id)
    return sorted(map(frozenset, by.values()), key=len)


@pytest.mark.parametrize("how", [{}, {"finish_at": 10}, {"exact_at": 20}, {"finish_at": 5, "exact_at": 10, "block": 32}])
def test_groups_are_found_whatever_the_layout(spark, how):
    rows, truth = _groups()
    found = _found(C.similarity_clusters(_table(spark, rows), min_size=6, **how))
    wanted = sorted((frozenset(i for i, g in truth.items() if g == k) for k in range(3)), key=len)
    assert [len(a & b) for a, b in zip(found, wanted)] == [len(b) for b in wanted]
    assert sum(map(len, found)) - sum(map(len, wanted)) <= 2


def test_dirt_is_left_out_and_copies_are_kept(spark):
    rows, truth = _groups(noise=0)
    copies = [(1000 + i, rows[0][1]) for i in range(3)]
    dirt = [(500, None), (501, [0.0] * 16), (502, [float("nan")] * 16), (503, [1.0, 2.0]), (None, rows[0][1])]
    twice = rows + rows[:10]
    found = _found(C.similarity_clusters(_table(spark, twice + copies + dirt), min_size=6))
    ids = set().union(*found)
    assert not ids & {500, 501, 502, 503}
    assert {1000, 1001, 1002} | {0} <= next(f for f in found if 0 in f)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 0.0])], [(1, None)], [(i, [1.0, 0.0]) for i in range(4)]])
def test_too_little_for_a_group(spark, rows):
    assert C.similarity_clusters(_table(spark, rows)).count() == 0


def test_spanning_forest_matches_kruskal(spark):
    r = np.random.default_rng(3)
    edges = {(min(a, b), max(a, b)): float(round(w, 2)) for a, b, w in zip(r.integers(0, 60, 300), r.integers(0, 60, 300), r.random(300)) if a != b}
    parent = list(range(60))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = 0.0
    for (a, b), w in sorted(edges.items(), key=lambda e: (e[1], e[0])):
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want += w
    df = spark.createDataFrame([(int(a), int(b), w) for (a, b), w in edges.items()], "u bigint, v bigint, w double")
    for finish in (0, 10, 1000):
        tree = C.spanning_forest(df, finish_at=finish).collect()
        assert len({(t.u, t.v) for t in tree}) == len(tree)
        assert sum(t.w for t in tree) == pytest.approx(want)


def test_neighbours_recall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    got = {g.id: set(g.nbrs) for g in C.neighbour_graph(vectors, 600, 8, neighbours=5, rounds=6, block=200).collect()}
    best = np.argsort(-(x @ x.T) + 10 * np.eye(600), axis=1)[:, :5]
    assert np.mean([len(got[i] & set(best[i].tolist())) / 5 for i in range(600)]) >= 0.9


def test_neighbours_recall_in_overfull_cells(spark):
    r = np.random.default_rng(5)
    x = np.r_[0.05 * r.normal(size=(6000, 12)) + np.eye(12)[0], np.repeat(r.normal(size=(30, 12)), 20, axis=0)]
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, vec array<float>")
    got = {g.id: set(g.nbrs) for g in C.neighbour_graph(vectors, len(x), 12, block=64).collect()}
    asked = r.choice(6000, 300, replace=False)
    near = x[asked] @ x.T
    near[np.arange(300), asked] = -9
    best = np.argsort(-near, axis=1)[:, :10]
    assert np.mean([len(got[i] & set(b)) / 10 for i, b in zip(asked.tolist(), best.tolist())]) >= 0.9


def test_nested_dense_groups_are_the_same_on_both_paths(spark):
    r = np.random.default_rng(8)
    edges, at = [], 0
    for k in range(4):  # four dense groups, the first two and the last two near each other
        edges += [(at + i, at + i + 1, 0.002 + 0.0001 * float(r.random())) for i in range(29)]
        edges += [(at + 29, at + 30, (0.02, 0.5, 0.02, 0.5)[k])]
        at += 30
    edges += [(at + i, at + i + 1, 0.3 + 0.1 * float(r.random())) for i in range(300)]  # diffuse
    tree = spark.createDataFrame(edges, "u bigint, v bigint, w double")
    nodes = spark.range(at + 301).selectExpr("id", "1L AS copies")
    got = []
    for exact_at in (1000, 100, 30):
        by = {}
        for x in C.select_clusters(tree, nodes, at + 301, 5, exact_at, few=0 if exact_at == 30 else 1000).collect():
            by.setdefault(x.label, set()).add(x.id)
        got.append(sorted(map(sorted, by.values())))
    assert got[0] == got[1] == got[2]
    assert got[0][:4] == [list(range(30 * k, 30 * k + 30)) for k in range(4)]


def test_a_group_that_is_mostly_copies_stays_whole(spark):
    rows, truth = _groups(seed=2, sizes=(60, 40), noise=5)
    first = next(i for i, g in truth.items() if g == 0)
    copies = [(1000 + i, rows[first][1]) for i in range(80)]
    found = _found(C.similarity_clusters(_table(spark, rows + copies), min_size=6))
    wanted = {i for i, g in truth.items() if g == 0} | {i for i, _ in copies}
    assert max(len(f & wanted) for f in found) == len(wanted)
    assert not {i for i, _ in rows[-5:]} & set().union(*found)


def test_many_small_groups_are_found_in_a_large_table(spark):
    rows, truth = _groups(seed=6, sizes=(8,) * 150, noise=0, dims=200, spread=0.01)
    rows += [(5000 + i, v) for i, v in enumerate((np.eye(200)[199] + 0.02 * np.random.default_rng(7).normal(size=(1500, 200))).tolist())]
    found = set(_found(C.similarity_clusters(_table(spark, rows))))
    wanted = {frozenset(i for i, g in truth.items() if g == k) for k in range(150)}
    assert len(found & wanted) >= 145


def test_description_and_probes(spark):
    members = spark.createDataFrame([(1, 4, 0.1), (2, 4, 0.2), (3, 4, 0.05), (4, 9, 0.3)], "id bigint, cluster bigint, reach double")
    sessions = spark.createDataFrame([(1, [5, 5, 6, None, 0, 1]), (1, [5, 5, 6]), (2, [5, 5, 5]), (3, None), (4, [6, 6, 6, 6, 6, 6])], "session_id bigint, items array<bigint>")
    catalog = spark.createDataFrame([(3, "A", "x"), (3, "A", "x"), (4, None, None)], "item_index bigint, artist string, track string")
    a, b = C.describe_clusters(members, sessions, catalog).collect()
    assert (a.cluster_no, a.n_sessions, a.share, a.exemplars) == (0, 3, 0.75, [3, 1, 2])
    assert [(t.label, t["count"]) for t in a.top_items] == [("A - x", 5)] and [t.label for t in b.top_items] == ["6"]
    probes = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, 4), (2, 2), (2, 1), (None, 3), (1, 77)], "probe_set bigint, session_id bigint")
    assert [tuple(r) for r in C.probed_pairs(members, probes).collect()] == [(1, 2)]


def test_the_outermost_cluster_that_holds(spark):
    r = np.random.default_rng(4)
    rows = [(0, None, False)] + [(c, int(r.integers(max(0, c - 3), c)), bool(r.random() < 0.3)) for c in range(1, 60)]
    up, own, want = {c: p for c, p, _ in rows}, {c for c, _, o in rows if o}, {}
    for c in up:
        x = c
        while x is not None:
            want[c] = x if x in own else want.get(c)
            x = up[x]
    df = spark.createDataFrame(rows, "c bigint, p bigint, own boolean")
    for few in (0, 1000):
        assert {x.id: x.label for x in C._held_by(df, few).collect()} == {c: x for c, x in want.items() if x is not None}
