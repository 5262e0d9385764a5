import numpy as np
import pytest
from pyspark.sql import functions as F

from listenloom.model import encoder as M
from listenloom.model import scoring, train
from listenloom.model.autograd import Var

TEXT = np.vstack([np.zeros((2, 6)), np.random.default_rng(0).normal(size=(10, 6))])


def _shape(**kw):
    return M.Shape(**({"n_items": 12, "dim": 8, "heads": 2, "blocks": 2, "max_len": 6} | kw))


def _rows(seed=0, n=3):
    r = np.random.default_rng(seed)
    return [(r.integers(1, 12, 5), r.integers(1, 12, 5), np.cumsum(r.integers(1, 9000, 5))) for _ in range(n)]


@pytest.mark.parametrize("loss", train.LOSSES)
@pytest.mark.parametrize("items", M.REPRESENTATIONS)
def test_gradients_match_differences(items, loss):
    shape = _shape(items=items, text_dim=0 if items == "id" else 6)
    w = M.new_weights(shape, TEXT)
    w = {k: v + 0.1 * np.random.default_rng(1).normal(size=v.shape) for k, v in w.items()}
    negatives = np.array([2, 5, 9])

    def value(weights):
        return float(train.batch_loss(M.Encoder(shape, weights), _rows(), negatives, loss).data)

    model = M.Encoder(shape, w)
    train.batch_loss(model, _rows(), negatives, loss).backward()
    r = np.random.default_rng(2)
    for k, v in w.items():
        g = model.w[k].grad
        if g is None:
            continue
        for _ in range(3):
            at = tuple(r.integers(0, n) for n in v.shape)
            up, down = {**w, k: v.copy()}, {**w, k: v.copy()}
            up[k][at] += 1e-5
            down[k][at] -= 1e-5
            assert g[at] == pytest.approx((value(up) - value(down)) / 2e-5, rel=2e-3, abs=1e-7), k


def test_causal_and_indifferent_to_padding():
    shape = _shape()
    model = M.Encoder(shape, M.new_weights(shape))
    items, gaps = np.array([[2, 3, 4, 5]]), np.array([[0, 10, 20, 30]])
    a = model.encode(items, gaps)[0].data
    later = items.copy()
    later[0, 3] = 9
    assert np.allclose(a[:, :3], model.encode(later, gaps)[0].data[:, :3])
    wide = model.encode(np.array([[0, 0, 2, 3, 4, 5]]), np.array([[0, 7, 99, 10, 20, 30]]))[0].data
    assert np.allclose(wide[:, 2:], a) and not wide[:, :2].any()
    weights = model.encode(np.array([[0, 0, 2, 3]]), None)[1]
    assert all(np.allclose(x.sum(-1), 1) and np.isfinite(x).all() for x in weights)
    with pytest.raises(ValueError):
        model.encode(np.ones((1, 7), dtype=int), None)


def test_scores_do_not_depend_on_the_batch():
    shape = _shape(items="hybrid", text_dim=6)
    model = M.Encoder(shape, M.new_weights(shape, TEXT))
    h, t = [np.array([2, 3, 1, 4, 5, 6, 7, 8]), np.array([5]), np.array([], dtype=int)], [np.arange(8) * 100, np.array([3]), np.array([], dtype=int)]
    both = model.scores(h, t)
    assert np.allclose(both[0], model.scores(h[:1], t[:1])[0]) and np.allclose(both[1], model.scores(h[1:2], t[1:2])[0])
    assert np.isinf(both[:, :2]).all()
    assert np.allclose(model.table()[[3, 4]], model.vectors(np.array([3, 4])).data) and not model.table()[:2].any()


def test_training_learns_a_cycle_and_a_file_keeps_it(tmp_path):
    shape = _shape(max_len=8)
    cycle = [(np.array([2 + (i + s) % 10 for i in range(30)]), np.arange(30) * 60) for s in range(10)]
    w, state = train.fit(shape, M.new_weights(shape), cycle, train.Config(epochs=25, negatives=8, rate=2e-2, patience=25))
    assert state.history[-1]["loss"] < 0.5 * state.history[0]["loss"]
    model = M.Encoder(shape, w)
    hits = [int(np.argmax(model.scores([np.array([2 + (i + s) % 10 for i in range(8)])], [np.arange(8) * 60])[0])) == 2 + (8 + s) % 10 for s in range(10)]
    assert sum(hits) >= 9
    M.save(str(tmp_path / "m.npz"), shape, w, ["a"], {"x": 1})
    again, loaded, keys, metrics = M.load(str(tmp_path / "m.npz"))
    assert again == shape and keys == ["a"] and metrics == {"x": 1} and all(np.array_equal(w[k], loaded[k]) for k in w)


def test_nothing_to_learn_from_and_frozen_parts():
    shape = _shape(items="text_frozen", text_dim=6)
    w = M.new_weights(shape, TEXT)
    same, _ = train.fit(shape, w, [(np.array([2, 3]), np.array([1, 2]))])
    assert all(np.array_equal(same[k], w[k]) for k in w)
    moved, _ = train.fit(shape, w, [(np.arange(2, 12), np.arange(10))], train.Config(epochs=1))
    assert np.array_equal(moved["text"], w["text"]) and not np.array_equal(moved["project"], w["project"])
    assert float(train.batch_loss(M.Encoder(shape, w), [(np.array([2]), np.array([1]), np.array([5]))], np.array([3]), "bpr").data) == 0.0
    assert train.learning_rate(0, 100, train.Config()) < train.learning_rate(19, 100, train.Config()) > train.learning_rate(99, 100, train.Config())
    assert set(train.negative_sampler(12, np.array([5, 5, 0, 0, 3] + [0] * 7), 0)(50)) == {4}


def test_transfer():
    shape = _shape(items="hybrid", text_dim=6)
    w = M.new_weights(shape, TEXT)
    w["residual"] += 1
    w["bias"] += 1
    other = np.vstack([TEXT, TEXT[5:8]])
    target, moved = M.transfer(shape, w, 15, other)
    assert target.n_items == 15 and np.array_equal(moved["project"], w["project"]) and not moved["residual"].any() and not moved["bias"].any()
    with pytest.raises(ValueError):
        M.transfer(_shape(), M.new_weights(_shape()), 15, other)
    for bad in ({"dim": 7}, {"items": "x"}, {"items": "hybrid"}):
        with pytest.raises(ValueError):
            _shape(**bad)


def test_over_tables(spark):
    shape = _shape()
    w = M.new_weights(shape)
    past = spark.createDataFrame([("a", p, 2 + p % 3, 100 * p) for p in range(9)] + [("b", 0, 5, 7)], "instance_id string, pos bigint, item_id bigint, ts bigint")
    instances = spark.createDataFrame([("a", 4), ("b", 11)], "instance_id string, target bigint")
    model = M.Encoder(shape, w)
    scores = model.scores([np.array([2 + p % 3 for p in range(9)]), np.array([5])], [np.arange(9) * 100, np.array([7])])
    want = {n: int((s >= s[t]).sum() - 1) for n, s, t in zip("ab", scores, (4, 11))}
    assert {r.instance_id: r["rank"] for r in scoring.dense_ranks(instances, past, shape, w).collect()} == want
    top = scoring.dense_recommend(past, shape, w, 20, discover=True).where("instance_id = 'a'").orderBy("place").collect()
    assert len(top) == 7 and not {2, 3, 4} & {r.item_id for r in top}
    traces = scoring.attention_traces(past, shape, w, 3)
    t = traces.where("instance_id = 'a' and block = 0").first()
    assert t.history_len == 6 and len(t.top) == 3 and t.repeat_item_mass == pytest.approx(1.0) and 0 < t.top_mass <= 1
    assert scoring.attention_summary(traces).count() == 2


def test_embedder(spark):
    df = spark.createDataFrame([(0, ""), (2, "Kettle by Ana"), (3, "Kettles by Ana"), (4, "Something else")], "item_id bigint, s string")
    out = scoring.embed_texts(df, "s", 64)
    r = scoring.embedding_report(out).first()
    assert (r.rows, r.dim, r.zero_rows) == (4, 64, 1)
    m = scoring.text_matrix(out, 5, 64)
    assert m[2] @ m[3] > 0.7 > m[2] @ m[4]
    assert scoring.embedding_key(df, "s") == scoring.embedding_key(df.repartition(3), "s") != scoring.embedding_key(df.where("item_id > 2"), "s")
    assert Var(2.0).data == 2.0 and F is not None
