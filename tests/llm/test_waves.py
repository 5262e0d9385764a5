import numpy as np

from listenloom.llm import clusters as C


def test_waves_find_what_one_wave_finds(spark):
    x = np.random.default_rng(5).normal(size=(600, 8)).astype(np.float32)
    rows = [(i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "id bigint, vec array<float>")
    one, many = ({r.id: set(r.nbrs) for r in C.neighbour_graph(vectors, 600, 8, block=64, at_once=k).collect()} for k in (10**9, 500))
    assert len(one) == 600 and one == many
