"""Groups of records whose vectors point in similar directions, of any number and density.

Hierarchical density clustering in five steps, each distributed or of bounded size:

1. Neighbour graph. Every vector lives in the cell of its nearest pivot and is compared
   with all vectors of its nearest cells, in blocks of bounded size. How many cells it
   takes is measured against brute force. Each vector keeps its nearest ``neighbours``.
   An edge weighs the mutual reachability of its ends: the largest of their distance
   and core distances.
2. Minimum spanning tree by Boruvka's rounds. Every component picks its least edge
   and components hang on to each other; this ends on one task once at most
   ``finish_at`` components are left, whose edges are streamed past it in order.
3. Hierarchy. The merges of tree edges are followed one by one in order of weight; above
   ``exact_at`` edges component by component, lightest edges first, each going on as a
   node that carries its cluster. A component counts as a cluster while it holds at
   least ``min_size`` records, whatever share of them that is.
4. Selection by stability: a cluster's stability is its size integrated over the
   densities at which it exists; a parent holds against its parts if it is stabler.
5. The members that join at the highest density are the exemplars.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenloom.runtime import discard, materialize

_GRAPH = pa.schema([("id", pa.int64()), ("core", pa.float64()), ("nbrs", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64()))])
_FOUND = pa.schema([("id", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("dists", pa.list_(pa.float32()))])
_UNIT = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32()))])
_CELLED = pa.schema([("id", pa.int64()), ("vec", pa.list_(pa.float32())), ("cells", pa.list_(pa.int32()))])
_TRUTH = pa.schema([("q", pa.int32()), ("id", pa.int64()), ("cell", pa.int32()), ("d", pa.float64())])
_TREE = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("w", pa.float64())])
_STEP = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("size", pa.int64()), ("own", pa.int64()), ("since", pa.float64()), ("stability", pa.float64()), ("inner", pa.float64()), ("members", pa.list_(pa.int64()))])
_LABEL = pa.schema([("id", pa.int64()), ("label", pa.int64())])
#: Nearest distance told apart, so that copies don't make a density infinite.
_NEAR = 1e-3
#: The distance of opposite vectors; trees of a forest count as joined there.
_FAR = 2.0
#: Bytes of pivots sent to every executor at most; where that is too few for the table, cells grow and are compared part by part.
_PIVOT_BYTES = 256 << 20
#: Clusters whose labels one task looks up; more are looked up by joins.
_FEW_CLUSTERS = 1_000_000


# 1. neighbour graph ---------------------------------------------------------------
def unit_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``id, vec``: one vector of length one per key. Null keys, null, zero, ragged and non-finite vectors are left out."""
    v = F.col(f"`{vector}`")
    if df.select(v.alias("v")).schema["v"].dataType.elementType.simpleString() not in ("float", "double"):
        v = v.cast("array<double>")
    one = df.where(F.col(f"`{key}`").isNotNull() & v.isNotNull()).groupBy(F.col(f"`{key}`").cast("bigint").alias("id")).agg(F.max(v).alias("v"))
    return one.mapInArrow(_unit, "id bigint, vec array<float>")


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, vec`` of ``id, v``, width by width."""
    for b in batches:
        widths = np.asarray(pc.list_value_length(b.column("v")))
        for w in np.unique(widths[widths > 0]):
            rows = np.flatnonzero(widths == w)
            part = b.take(pa.array(rows))
            x = np.asarray(pc.fill_null(part.column("v").flatten().cast(pa.float64()), float("nan"))).reshape(len(rows), w)
            with np.errstate(over="ignore"):
                norm = np.sqrt((x * x).sum(axis=1))
            good = (norm > 0) & np.isfinite(norm)
            unit = (x[good] / norm[good, None]).astype(np.float32)
            if len(unit):
                yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(good)), pa.ListArray.from_arrays(pa.array(np.arange(0, unit.size + 1, w, dtype=np.int32)), pa.array(unit.ravel()))], schema=_UNIT)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    return np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, width)


def _assign(pivots, probes: int):
    """The ``probes`` cells of the nearest pivots, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pivots.value
        for b in batches:
            for s in range(0, b.num_rows, 2048):
                part = b.slice(s, 2048)
                near = _matrix(part, "vec", p.shape[1]) @ p.T
                cells = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
                cells = np.take_along_axis(cells, np.argsort(-np.take_along_axis(near, cells, axis=1), axis=1), axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("vec"), pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, probes, dtype=np.int32)), pa.array(cells.ravel()))], schema=_CELLED)

    return run


def _least(d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` least of each row."""
    at = np.argpartition(d, k - 1, axis=1)[:, :k] if k < d.shape[1] else np.argsort(d, axis=1)
    return at, np.take_along_axis(d, at, axis=1)


def _truth(asked, k: int):
    """The ``k`` nearest of each asked vector in a partition, with the cell they live in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = asked.value
        best, who, where = np.full((len(ids), k), np.inf, dtype=np.float32), np.zeros((len(ids), k), dtype=np.int64), np.zeros((len(ids), k), dtype=np.int32)
        for b in batches:
            if b.num_rows:
                own, cell = np.asarray(b.column("id")), np.asarray(b.column("cell"))
                d = 1.0 - x @ _matrix(b, "vec", x.shape[1]).T
                d[ids[:, None] == own[None, :]] = np.inf
                at, near = _least(d, min(k, len(own)))
                to, best = _least(np.concatenate([best, near], axis=1), k)
                who, where = np.take_along_axis(np.concatenate([who, own[at]], axis=1), to, axis=1), np.take_along_axis(np.concatenate([where, cell[at]], axis=1), to, axis=1)
        real = np.isfinite(best)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.nonzero(real)[0].astype(np.int32), who[real], where[real], best[real].astype(np.float64))], schema=_TRUTH)

    return run


def _neighbours(k: int, width: int):
    """Nearest of a block's own vectors (``role`` 0, which come first) to each that asks (``role`` 1)."""

    def search(base: tuple[np.ndarray, np.ndarray], ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch | None:
        own, y = base
        kk = min(k, len(own))
        d = 1.0 - x @ y.T
        d[ids[:, None] == own[None, :]] = np.inf
        at, near = _least(d, kk)
        real = np.isfinite(near)
        offsets = pa.array(np.r_[0, np.cumsum(real.sum(axis=1))].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(offsets, pa.array(own[at][real])), pa.ListArray.from_arrays(offsets, pa.array(np.maximum(near[real], 0).astype(np.float32)))], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, ids, xs, base = None, [], [], None
        for b in batches:
            if not b.num_rows:
                continue
            key, role = np.asarray(b.column("block")), np.asarray(b.column("role"))
            x, own = _matrix(b, "vec", width), np.asarray(b.column("id"))
            cut = np.r_[0, np.flatnonzero((key[1:] != key[:-1]) | (role[1:] != role[:-1])) + 1, len(key)]
            for s, e in zip(cut[:-1], cut[1:]):
                if key[s] != held_key:
                    held_key, ids, xs, base = key[s], [], [], None
                if role[s] == 0:
                    ids.append(own[s:e])
                    xs.append(x[s:e])
                elif ids:
                    base = base or (np.concatenate(ids), np.concatenate(xs))
                    for f in range(s, e, 512):
                        yield search(base, own[f : min(e, f + 512)], x[f : min(e, f + 512)])

    return run


def _nearest(k: int, core: int):
    """Of each id's finds from all rounds the ``k`` nearest. Sorted by id."""

    def merge(batches: list[pa.RecordBatch], last: bool):
        table = pa.Table.from_batches(batches).combine_chunks()
        ids = np.asarray(table.column("id").chunk(0))
        upto = len(ids) if last else int(np.searchsorted(ids, ids[-1], side="left"))
        rest = [] if last else table.slice(upto).to_batches()
        if not upto:
            return None, rest
        table = table.slice(0, upto).combine_chunks()
        lists = table.column("nbrs").chunk(0)
        owner = np.repeat(ids[:upto], np.diff(np.asarray(lists.offsets)))
        nbr, dist = np.asarray(lists.flatten()), np.asarray(table.column("dists").chunk(0).flatten()).astype(np.float64)
        order = np.lexsort((nbr, owner))
        owner, nbr, dist = owner[order], nbr[order], dist[order]
        once = np.r_[True, (owner[1:] != owner[:-1]) | (nbr[1:] != nbr[:-1])]
        owner, nbr, dist = owner[once], nbr[once], dist[once]
        order = np.lexsort((nbr, dist, owner))
        owner, nbr, dist = owner[order], nbr[order], dist[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rank = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        keep = rank < k
        owner, nbr, dist, rank = owner[keep], nbr[keep], dist[keep], rank[keep]
        first = np.flatnonzero(rank == 0)
        size = np.diff(np.r_[first, len(owner)])
        offsets = pa.array(np.r_[first, len(owner)].astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(owner[first]), pa.array(dist[first + np.minimum(core, size) - 1]), pa.ListArray.from_arrays(offsets, pa.array(nbr)), pa.ListArray.from_arrays(offsets, pa.array(dist))], schema=_GRAPH), rest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                out, held = merge([*held, b], False)
                if out is not None:
                    yield out
        if held:
            out, _ = merge(held, True)
            if out is not None:
                yield out

    return run


def probes_needed(celled: DataFrame, pivots: np.ndarray, neighbours: int, recall: float, asked: int = 512) -> int:
    """How many of the nearest cells hold the share ``recall`` of the true neighbours.

    Measured against brute force: ``asked`` vectors are compared with all of ``id, vec,
    cell``, and the cells of what they should find are looked up among their own.
    """
    drawn = celled.orderBy(F.xxhash64("id", F.lit(-1)), "id").limit(asked).select("id", "vec").collect()
    ids, x = np.array([r[0] for r in drawn], dtype=np.int64), np.array([r[1] for r in drawn], dtype=np.float32)
    near = celled.mapInArrow(_truth(celled.sparkSession.sparkContext.broadcast((ids, x)), neighbours), "q int, id bigint, cell int, d double")
    best = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id", "cell"))), 1, neighbours).alias("best")).select("q", F.col("best.cell").alias("cells")).collect()
    rank = np.argsort(np.argsort(-(x @ pivots.T), axis=1, kind="stable"), axis=1)
    at = np.sort(np.concatenate([rank[r.q, r.cells] for r in best]))
    return int(at[max(0, math.ceil(recall * len(at)) - 1)]) + 1


def neighbour_graph(vectors: DataFrame, n: int, width: int, neighbours: int = 10, core: int = 4, rounds: int = 4, block: int = 4096, recall: float = 0.95, at_once: int = 1_000_000, spent: tuple[DataFrame, ...] = ()) -> DataFrame:
    """``id, core, nbrs, dists`` of ``id, vec``: nearest neighbours and core distance of every vector.

    Pivots, about one for ``block / 2`` vectors, are drawn by a hash of the id and lay
    out the comparison. Every vector lives in the cell of its nearest pivot and is
    compared with all that live in its nearest cells: at least ``rounds``, and as many
    as hold the share ``recall`` of the true neighbours (:func:`probes_needed`). A cell
    above ``block`` is compared part by part, so that none of it is passed over.

    Vectors ask in up to 8 waves, about ``at_once`` times a wave, whose shuffle files are
    gone before the next: pivots are numbered along their widest direction, so that the
    cells of a wave ask in few others. ``spent`` are deleted once ``vectors`` have been read.
    """
    spark = vectors.sparkSession
    count = max(1, min(round(n / (block * 0.6)), _PIVOT_BYTES // (4 * width)))
    picked = np.array([r[0] for r in vectors.orderBy(F.xxhash64(F.col("id"), F.lit(0)), "id").limit(count).select("vec").collect()], dtype=np.float32)
    if len(picked) > 1:
        picked = picked[np.argsort(picked @ np.linalg.eigh(np.atleast_2d(np.cov(picked.T)))[1][:, -1], kind="stable")]
    pivots = spark.sparkContext.broadcast(picked)
    schema = "id bigint, vec array<float>, cells array<int>"
    celled = materialize(vectors.mapInArrow(_assign(pivots, 1), schema).select("id", "vec", F.col("cells")[0].alias("cell")), "cells")
    probes = min(len(picked), max(rounds, probes_needed(celled, picked, neighbours, recall)))
    placed = materialize(celled.select("id", "vec").mapInArrow(_assign(pivots, probes), schema), "asking")
    parts = materialize(celled.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(block)).alias("parts")), "parts")
    discard(celled, *spent)
    waves = max(1, min(8, len(picked), math.ceil(n * probes / at_once)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * probes / waves / 250_000))
    graph = None
    for wave in range(waves):
        asking = placed.where(F.floor(F.col("cells")[0] * waves / len(picked)) == wave).select("id", "vec", F.explode("cells").alias("cell"))
        sizes = F.broadcast(parts.join(asking.groupBy("cell").agg(F.ceil(F.count("*") / F.lit(16 * block)).alias("turns")), "cell"))  # a row per pivot, of which there are at most _PIVOT_BYTES / 4 / width
        part, turn = F.pmod(F.xxhash64("id"), F.col("parts")), F.pmod(F.xxhash64("id", F.lit(1)), F.col("turns"))
        living = placed.select("id", "vec", F.col("cells")[0].alias("cell")).join(sizes, "cell").withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("turns") - 1)))
        asking = asking.join(sizes, "cell").withColumn("turn", turn).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)))
        rows = living.withColumn("role", F.lit(0)).unionByName(asking.withColumn("role", F.lit(1))).select("id", "vec", "role", F.xxhash64("cell", "part", "turn").alias("block"))
        found = rows.repartition(tasks, "block").sortWithinPartitions("block", "role").mapInArrow(_neighbours(neighbours, width), "id bigint, nbrs array<bigint>, dists array<float>")
        nearest = found.where(F.size("nbrs") > 0).repartition("id").sortWithinPartitions("id").mapInArrow(_nearest(neighbours, core), "id bigint, core double, nbrs array<bigint>, dists array<double>")
        graph = materialize(nearest, "graph", onto=graph)
    discard(placed, parts)
    return graph


def counted_cores(graph: DataFrame, firsts: DataFrame, core: int) -> DataFrame:
    """``graph`` of distinct vectors ``id, copies`` with core distances in which every copy counts."""
    arcs = graph.select("id", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select("id", F.col("e.nbrs").alias("to"), F.col("e.dists").alias("d"))
    arcs = arcs.join(firsts.select(F.col("id").alias("to"), "copies"), "to").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("d", "copies"))).alias("near"))
    start = F.struct((F.lit(core) - F.col("copies") + 1).cast("bigint").alias("wanted"), F.lit(0.0).alias("core"))
    within = F.aggregate("near", start, lambda s, x: F.when(s["wanted"] > 0, F.struct((s["wanted"] - x["copies"]).alias("wanted"), x["d"].alias("core"))).otherwise(s))
    return graph.drop("core").join(arcs, "id").join(firsts.select("id", "copies"), "id").select("id", within["core"].alias("core"), "nbrs", "dists")


def mutual_reachability(graph: DataFrame) -> DataFrame:
    """``u, v, w`` with u < v, each pair once."""
    arcs = graph.select("id", "core", F.explode(F.arrays_zip("nbrs", "dists")).alias("e")).select("id", "core", F.col("e.nbrs").alias("to"), F.col("e.dists").alias("d"))
    other = graph.select(F.col("id").alias("to"), F.col("core").alias("core_to"))
    return arcs.join(other, "to").select(F.least("id", "to").alias("u"), F.greatest("id", "to").alias("v"), F.greatest("d", "core", "core_to", F.lit(_NEAR)).alias("w")).groupBy("u", "v").agg(F.min("w").alias("w"))


# 2. spanning tree -----------------------------------------------------------------
def _roots(hang: DataFrame, label: str) -> DataFrame:
    """``c, p``: the root of each component of ``c, p`` pointers without cycles but of a root to itself."""
    jumped = last = hang
    while True:
        for _ in range(3):
            up = jumped.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = jumped.join(up, "p").select("c", F.col("pp").alias("p"))
        before, jumped = last, materialize(jumped, label)
        last = jumped
        discard(before)
        up = jumped.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        if jumped.join(up, "p").where("p <> pp").isEmpty():
            return jumped


def _kruskal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tree edges among edges ``a, b, w, u, v`` that come in order; memory grows with the components only."""
    parent: dict[int, int] = {}

    def root(x):
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x], x = r, p
        return r

    for batch in batches:
        cols = [batch.column(c).to_pylist() for c in ("a", "b", "w", "u", "v")]
        out = []
        for a, b, w, u, v in zip(*cols):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((u, v, w))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], schema=_TREE)


def spanning_forest(edges: DataFrame, finish_at: int = 50_000) -> DataFrame:
    """``u, v, w`` of a minimum spanning forest of ``u, v, w``; ties are broken by u, then v."""
    open_ = materialize(edges.select(F.col("u").alias("a"), F.col("v").alias("b"), "w", "u", "v"), "edges")
    trees: list[DataFrame] = []
    spent: list[DataFrame] = []
    while True:
        ends = open_.select(F.explode(F.array("a", "b")).alias("c")).distinct().count()
        if not ends or ends <= finish_at and open_.count() <= 40 * finish_at:
            break
        both = open_.select(F.col("a").alias("c"), F.col("b").alias("p"), "w", "u", "v").unionByName(open_.select(F.col("b").alias("c"), F.col("a").alias("p"), "w", "u", "v"))
        least = materialize(both.groupBy("c").agg(F.min(F.struct("w", "u", "v", "p")).alias("m")).select("c", "m.*"), "least")
        spent.append(least)
        trees.append(least.select("u", "v", "w").distinct())
        back = least.select(F.col("c").alias("p"), F.col("p").alias("pp"))
        hang = least.select("c", "p").join(back, "p").select("c", F.when((F.col("pp") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        top = _roots(materialize(hang, "hang"), "roots")
        moved = open_.join(top.select(F.col("c").alias("a"), F.col("p").alias("ra")), "a").join(top.select(F.col("c").alias("b"), F.col("p").alias("rb")), "b").where("ra <> rb")
        pairs = moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), F.struct("w", "u", "v").alias("e")).groupBy("a", "b").agg(F.min("e").alias("e"))
        next_ = materialize(pairs.select("a", "b", "e.*"), "edges")
        discard(open_, top)
        open_ = next_
    trees.append(open_.repartition(1).sortWithinPartitions("w", "u", "v").mapInArrow(_kruskal, "u bigint, v bigint, w double"))
    out = trees[0]
    for t in trees[1:]:
        out = out.unionByName(t)
    tree = materialize(out, "tree")
    discard(open_, *spent)
    return tree


# 3. and 4. hierarchy and selection ------------------------------------------------
def _follow(least: int, last: bool, n: int):
    """Merges of each block, followed one by one in order of weight.

    Rows of a block are states of its components (``kind`` 0: ``a`` the component, ``b``
    its cluster, ``since`` the density up to which its ``stability`` is counted, and its
    ``members`` while it has no cluster) and tree edges (``kind`` 1, numbered ``e``); a
    component without a state is one record. Gives the state of each block (0), the
    cluster ``b`` that node ``a`` first belongs to (1), and clusters that ended, ``a``,
    with the one they became part of, ``b`` (2), ``since`` 1 if it holds against its
    parts. A cluster's stability grows by the distinct vectors in it times the fall of
    density while it exists; it holds if it is stabler than the best of its parts
    together (``inner``), and one of all ``n`` records with parts never does. The
    ``last`` call ends what is left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        parent: dict[int, int] = {}
        state: dict[int, list] = {}  # of a root: size, distinct, cluster, since, stability, inner, members

        def root(x: int) -> int:
            r = x
            while (p := parent.get(r, r)) != r:
                r = p
            while (p := parent.get(x, x)) != r:
                parent[x], x = r, p
            return r

        def joins(c: int, members: list[int]) -> None:
            rows.extend((1, m, c, 0, 0, 0.0, 0.0, None, None) for m in members)

        def ends(s: list, density: float, into: int | None) -> float:
            """The best stability found in the cluster that ends."""
            own, inner = s[4] + s[1] * (s[3] - density), s[5]
            holds = inner is None or not (inner > own or s[0] >= n)
            rows.append((2, s[2], into, s[0], s[1], float(holds), own, inner, None))
            return own if holds else inner

        def merge(e: int, w: float, a: int, b: int) -> None:
            x, y = root(a), root(b)
            if x == y:
                return
            density = 1 / max(w, _NEAR)
            both = [state.pop(x, None) or [1, 1, None, 0.0, 0.0, None, [x]], state.pop(y, None) or [1, 1, None, 0.0, 0.0, None, [y]]]
            for k, s in enumerate(both):
                if s[2] is None and s[0] >= least:  # copies of one vector: no density of their own
                    s[2], s[3] = 4 * e + k, density
                    joins(s[2], s[6])
            one, two = both
            made = [one[0] + two[0], one[1] + two[1], None, density, 0.0, None, []]
            if one[2] is not None and two[2] is not None:
                made[2] = 4 * e + 2
                made[5] = ends(one, density, made[2]) + ends(two, density, made[2])
            elif one[2] is not None or two[2] is not None:
                old, new = (one, two) if one[2] is not None else (two, one)
                made[2], made[4], made[5] = old[2], old[4] + old[1] * (old[3] - density), old[5]
                joins(made[2], new[6])
            elif made[0] >= least:
                made[2] = 4 * e + 2
                joins(made[2], one[6] + two[6])
            else:
                made[6] = one[6] + two[6]
            parent[y] = x
            state[x] = made

        def close(block: int) -> None:
            for s in state.values():
                if not last:
                    rows.append((0, block, *s[2:3], *s[:2], *s[3:]))
                elif s[2] is not None:
                    ends(s, 1 / _FAR, None)
            parent.clear()
            state.clear()

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _STEP)], schema=_STEP)
            rows.clear()
            return out

        held = None
        for batch in batches:
            cols = [batch.column(f).to_pylist() for f in ("block", "kind", "w", "e", "a", "b", "size", "own", "since", "stability", "inner", "members")]
            for block, kind, w, e, a, b, size, own, since, stability, inner, members in zip(*cols):
                if held is not None and block != held:
                    close(held)
                held = block
                if kind == 0:
                    state[a] = [size, own, b, since, stability, inner, members]
                else:
                    merge(e, w, a, b)
                if len(rows) >= 50_000:
                    yield given()
        if held is not None:
            close(held)
        if rows:
            yield given()

    return run


def _topmost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``id, label`` of clusters ``c, p, own``: the outermost cluster around each that holds, for those that have one."""
    up: dict[int, int | None] = {}
    own: set[int] = set()
    for b in batches:
        for c, p, holds in zip(*(b.column(x).to_pylist() for x in ("c", "p", "own"))):
            up[c] = p
            if holds:
                own.add(c)
    label: dict[int, int] = {}
    for c in up:
        path = []
        while c is not None and c not in label:
            path.append(c)
            c = up[c]
        found = label[c] if c is not None else -1
        for x in reversed(path):
            found = label[x] = found if found >= 0 else x if x in own else -1
    rows = [(c, x) for c, x in label.items() if x >= 0]
    for s in range(0, len(rows), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[s : s + 50_000])], schema=_LABEL)


def _held_by(ended: DataFrame, few: int) -> DataFrame:
    """``id, label`` of clusters ``c, p, own`` as in :func:`_topmost`; above ``few`` by joins in which every step doubles the way looked up."""
    ended = materialize(ended, "clusters")
    if ended.count() <= few:
        return ended.repartition(1).mapInArrow(_topmost, "id bigint, label bigint")
    seen = ended.select("c", "p", F.when(F.col("own"), F.col("c")).alias("label"))
    while True:
        above = seen.select(F.col("c").alias("p"), F.col("p").alias("pp"), F.col("label").alias("higher"))
        before, seen = seen, materialize(seen.join(above, "p", "left").select("c", F.col("pp").alias("p"), F.coalesce("higher", "label").alias("label")), "labels")
        discard(before)
        if seen.where("p is not null").isEmpty():
            return seen.where("label is not null").select(F.col("c").alias("id"), "label")


def _contract(edges: DataFrame) -> DataFrame:
    """``c, p``: the component (its least member) of every end of ``a, b``."""
    total = None
    while True:
        both = edges.select(F.col("a").alias("c"), F.col("b").alias("p")).unionByName(edges.select(F.col("b").alias("c"), F.col("a").alias("p")))
        hang = both.groupBy("c").agg(F.min("p").alias("p")).select("c", F.least("c", "p").alias("p"))
        top = _roots(materialize(hang, "hang"), "roots")
        if total is None:
            total = top
        else:
            moved = total.join(top.select(F.col("c").alias("p"), F.col("p").alias("q")), "p", "left")
            total = materialize(moved.select("c", F.coalesce("q", "p").alias("p")), "components")
        edges = edges.join(top.select(F.col("c").alias("a"), F.col("p").alias("ra")), "a").join(top.select(F.col("c").alias("b"), F.col("p").alias("rb")), "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct()
        edges = materialize(edges, "edges")
        if edges.isEmpty():
            return total


_STEP_COLUMNS = "kind int, a bigint, b bigint, size bigint, own bigint, since double, stability double, inner double, members array<bigint>"


def select_clusters(tree: DataFrame, nodes: DataFrame, n: int, least: int, exact_at: int = 500_000, few: int = _FEW_CLUSTERS) -> DataFrame:
    """``id, label`` of the nodes ``id, copies`` that belong to a selected cluster of the forest ``u, v, w``.

    Up to ``exact_at`` edges one task follows the merges. Above it, the lightest edges go
    first: each component they make is followed by itself, with at most about
    ``exact_at`` edges, and goes on as one node that carries its size, cluster and
    stability. Order and result are those of one task. Whether a cluster holds is known
    where it ends; the outermost one that does is looked up by :func:`_held_by`.
    """
    edges = materialize(tree.select(F.monotonically_increasing_id().alias("e"), F.col("u").alias("a"), F.col("v").alias("b"), "u", "v", "w"), "edges")
    left = edges.count()
    none = [F.lit(None).cast(t).alias(c) for c, t in (("size", "bigint"), ("own", "bigint"), ("since", "double"), ("stability", "double"), ("inner", "double"), ("members", "array<bigint>"))]
    states = nodes.where("copies > 1").select(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(None).cast("bigint").alias("b"), F.col("copies").alias("size"), F.lit(1).cast("bigint").alias("own"), F.lit(0.0).alias("since"), F.lit(0.0).alias("stability"), F.lit(None).cast("double").alias("inner"), F.array("id").alias("members"))

    def step(low: DataFrame, held: DataFrame, last: bool) -> DataFrame:
        """``low`` and ``held`` have a ``block``."""
        lines = low.select("block", F.lit(1).alias("kind"), "w", "e", "a", "b", "u", "v", *none)
        blank = [F.lit(None).cast(t).alias(c) for c, t in (("w", "double"), ("e", "bigint"), ("u", "bigint"), ("v", "bigint"))]
        lines = lines.unionByName(held.select("block", "kind", "a", "b", "size", "own", "since", "stability", "inner", "members", *blank))
        lines = lines.repartition(1) if last else lines.repartition("block")
        return materialize(lines.sortWithinPartitions("block", "kind", "w", "u", "v").mapInArrow(_follow(least, last, n), _STEP_COLUMNS), "merges")

    done: list[DataFrame] = []
    while left > exact_at:
        share = min(0.5, max(0.05, 1 - 0.9 * exact_at / left))
        while True:
            weight = edges.select(F.percentile_approx("w", share, 10_000)).first()[0]
            low = edges.where(F.col("w") <= weight)
            top = _contract(low.select("a", "b"))
            low = low.join(top.select(F.col("c").alias("a"), F.col("p").alias("block")), "a")
            if share < 0.01 or low.groupBy("block").count().agg(F.max("count")).first()[0] <= exact_at:
                break
            share /= 2
        made = step(low, states.join(top.select(F.col("c").alias("a"), F.col("p").alias("block")), "a"), False)
        states = materialize(states.join(top.select(F.col("c").alias("a")), "a", "left_anti").unionByName(made.where("kind = 0")), "states")
        done.append(made.where("kind > 0"))
        high = edges.where(F.col("w") > weight)
        for end in ("a", "b"):
            high = high.join(top.select(F.col("c").alias(end), F.col("p").alias("q")), end, "left").withColumn(end, F.coalesce("q", end)).drop("q")
        before, edges = edges, materialize(high, "edges")
        discard(before, top)
        left = edges.count()
    block = F.lit(0).cast("bigint").alias("block")
    done.append(step(edges.select("*", block), states.select("*", block), True))
    merges = done[0]
    for d in done[1:]:
        merges = merges.unionByName(d)
    chosen = _held_by(merges.where("kind = 2").select(F.col("a").alias("c"), F.col("b").alias("p"), (F.col("since") > 0).alias("own")), few)
    return merges.where("kind = 1").select(F.col("a").alias("id"), F.col("b").alias("c")).join(chosen.withColumnRenamed("id", "c"), "c").select("id", "label")


def similarity_clusters(df: DataFrame, key: str = "session_id", vector: str = "vectors", min_size: int = 5, neighbours: int = 10, core: int = 4, rounds: int = 4, block: int = 4096, finish_at: int = 50_000, exact_at: int = 500_000, fence: float = 3.0, strength: float = 100.0) -> DataFrame:
    """``id, cluster, reach``: the records that belong to a cluster.

    ``reach`` is the distance at which a record joins its cluster; the smaller, the more
    typical. Copies of a vector are laid out as one and count as records in sizes and
    core distances, but once in densities. A record is judged by its reach against the
    median reach of its nearest distinct neighbours in the cluster: one whose (log) ratio
    lies beyond the outer fence of the cluster, and above two, belongs to none, unless its
    copies make a group by themselves. The fence is ``fence`` interquartile ranges above
    the upper quartile, both mirrored from the lower half; a cluster's is mixed with that
    of all records at the weight of ``strength`` records. Records without a usable vector (null, zero, of another length, not finite)
    and those that fit no cluster have no row. Deliveries of one key count once (the
    greatest vector holds); equal vectors under other keys are records of their own.
    A cluster has at least ``min_size`` records, whatever share of the table that is.
    Empty input gives no rows. Cluster numbers are arbitrary, the grouping is not.
    """
    vectors = vectors_ = materialize(unit_vectors(df, key, vector), "vectors")
    lengths = vectors.groupBy(F.size("vec").alias("k")).count().orderBy(F.desc("count"), "k").first()
    empty = df.sparkSession.createDataFrame([], "id bigint, cluster bigint, reach double")
    if lengths is None or lengths["count"] < 2:
        return empty
    width, n = lengths["k"], lengths["count"]
    vectors = vectors.where(F.size("vec") == width)
    firsts = materialize(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "vec", "copies"), "firsts")
    distinct = firsts.count()
    if distinct < 2:
        return vectors.select("id", F.lit(0).cast("bigint").alias("cluster"), F.lit(_NEAR).alias("reach")) if n >= min_size else empty
    copied = materialize(vectors.join(firsts.where("copies > 1").select("vec", F.col("id").alias("first")), "vec").select("id", "first"), "copied") if distinct < n else None
    whole, firsts = firsts, materialize(firsts.select("id", "copies"), "firsts")
    discard(vectors_)
    graph = neighbour_graph(whole.select("id", "vec"), distinct, width, neighbours, min(core, n - 1), rounds, block, spent=(whole,))
    if distinct < n:
        whole, graph = graph, materialize(counted_cores(graph, firsts, min(core, n - 1)), "cores")
        discard(whole)
    tree = spanning_forest(mutual_reachability(graph), finish_at)
    labels = materialize(select_clusters(tree, firsts.select("id", "copies"), n, min_size, exact_at), "labels")
    apart = tree.select(F.explode(F.array("u", "v")).alias("id"), "w").groupBy("id").agg(F.min("w").alias("reach"))
    members = materialize(labels.join(apart, "id").join(firsts.select("id", "copies"), "id").select("id", F.col("label").alias("cluster"), "reach", "copies"), "members")
    near = graph.select("id", F.explode("nbrs").alias("to")).join(members.select(F.col("id").alias("to"), "cluster", F.col("reach").alias("r")), "to")
    scale = near.groupBy("id", "cluster").agg(F.median("r").alias("scale"))  # at most ``neighbours`` values each
    rated = materialize(members.join(scale, ["id", "cluster"], "left").withColumn("far", F.ln(F.col("reach") / F.col("scale"))), "rated")
    # quartiles of the lower half, which no stray reaches; in small clusters mostly those of all records
    low = F.percentile_approx("far", [0.25, 0.5], 1000).alias("q")
    fence_of = lambda q: q[1] + (2 * fence + 1) * (q[1] - q[0])
    pooled = rated.select(low).first()[0]
    pooled = fence_of(pooled) if pooled else 0.0
    fences = rated.groupBy("cluster").agg(low, F.count("far").alias("k"))
    fences = fences.select("cluster", F.greatest((F.col("k") * F.coalesce(fence_of(F.col("q")), F.lit(0.0)) + strength * pooled) / (F.col("k") + strength), F.lit(math.log(2))).alias("most"))
    kept = rated.join(fences, "cluster").where(F.col("far").isNull() | (F.col("copies") >= min_size) | (F.col("far") <= F.col("most"))).select("id", "cluster", "reach", "copies")
    spent = [graph, tree, labels, members, rated]
    members = materialize(kept, "kept")
    if distinct == n:
        discard(firsts, *spent)
        return members.select("id", "cluster", "reach")
    others = copied.join(members.withColumnRenamed("id", "first"), "first").select("id", "cluster", F.lit(_NEAR).alias("reach"))
    out = materialize(members.where("copies = 1").select("id", "cluster", "reach").unionByName(others), "members")
    discard(firsts, copied, members, *spent)
    return out


def describe_clusters(members: DataFrame, sessions: DataFrame, catalog: DataFrame | None = None, key: str = "session_id", items: str = "items", top: int = 5, exemplars: int = 5, support: int = 5, salts: int = 32) -> DataFrame:
    """``cluster_no, n_sessions, share, exemplars, top_items`` of each cluster, largest first.

    ``top_items`` are structs ``label, lift, share, count``: the items that make up more
    of a cluster's plays than of all clusters' plays, in at least ``support`` plays, by
    lift, count and label; the label is artist and track where ``catalog`` knows item
    ``i`` as ``item_index = i - 2``, else the id. Null, padding (0) and unknown (1) items
    don't count; null item arrays add nothing. ``exemplars`` are the records of least reach.
    """
    total = members.count()
    sizes = members.groupBy("cluster").agg(F.count("*").alias("n_sessions"))
    w = Window.partitionBy("cluster", "salt").orderBy("reach", "id")
    few = members.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts))).withColumn("k", F.row_number().over(w)).where(F.col("k") <= exemplars)
    typical = few.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct("reach", "id"))), 1, exemplars).alias("x")).select("cluster", F.transform("x", lambda r: r["id"]).alias("exemplars"))
    once = sessions.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{items}`").isNotNull()).groupBy(F.col(f"`{key}`").cast("bigint").alias("id")).agg(F.max(F.col(f"`{items}`")).alias("items"))
    counts = once.join(members.select("id", "cluster"), "id").select("cluster", F.explode("items").alias("item")).where("item >= 2").groupBy("cluster", "item").agg(F.count("*").alias("count"))
    counts = materialize(counts, "cluster-items")
    every = counts.groupBy("item").agg(F.sum("count").alias("everywhere"))
    plays = counts.groupBy("cluster").agg(F.sum("count").alias("plays"))
    all_plays = counts.agg(F.sum("count")).first()[0] or 1
    scored = counts.where(F.col("count") >= support).join(every, "item").join(plays, "cluster")
    scored = scored.select("cluster", "item", "count", F.round(F.col("count") / F.col("plays"), 4).alias("share"), F.round(F.col("count") / F.col("plays") / (F.col("everywhere") / F.lit(all_plays)), 3).alias("lift"))
    # a cluster may have as many items as the catalog: ranked in salted steps
    first = Window.partitionBy("cluster", "salt").orderBy(F.desc("lift"), F.desc("count"), "item")
    scored = scored.withColumn("salt", F.pmod(F.xxhash64("item"), F.lit(salts))).withColumn("k", F.row_number().over(first)).where(F.col("k") <= top)
    if catalog is not None:
        names = catalog.where("item_index is not null").groupBy((F.col("item_index") + 2).alias("item")).agg(F.min(F.concat_ws(" - ", "artist", "track")).alias("name"))
        scored = scored.join(names, "item", "left")
    else:
        scored = scored.withColumn("name", F.lit(None).cast("string"))
    label = F.coalesce(F.when(F.col("name") != "", F.col("name")), F.col("item").cast("string"))
    best = scored.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("lift")).alias("l"), (-F.col("count")).alias("c"), label.alias("label"), "lift", "share", "count"))), 1, top).alias("x"))
    best = best.select("cluster", F.transform("x", lambda r: F.struct(r["label"].alias("label"), r["lift"].alias("lift"), r["share"].alias("share"), r["count"].alias("count"))).alias("top_items"))
    numbered = sizes.withColumn("cluster_no", (F.row_number().over(Window.orderBy(F.desc("n_sessions"), "cluster")) - 1).cast("int"))  # a row per cluster
    return numbered.join(typical, "cluster", "left").join(best, "cluster", "left").select("cluster_no", "n_sessions", F.round(F.col("n_sessions") / F.lit(max(1, total)), 4).alias("share"), "exemplars", "top_items")


def probed_pairs(members: DataFrame, probes: DataFrame, probe_set: str = "probe_set", key: str = "session_id") -> DataFrame:
    """``session_id_a < session_id_b``, distinct: records that share a probe set and a cluster.

    Sets are small, stated questions; a record may stand in several. Null sets, null ids
    and records that belong to no cluster make no pair.
    """
    asked = probes.where(F.col(f"`{probe_set}`").isNotNull() & F.col(f"`{key}`").isNotNull()).select(F.col(f"`{probe_set}`").alias("s"), F.col(f"`{key}`").cast("bigint").alias("id")).distinct()
    known = asked.join(members.select("id", "cluster"), "id")
    a, b = known.select("s", "cluster", F.col("id").alias("session_id_a")), known.select("s", "cluster", F.col("id").alias("session_id_b"))
    return a.join(b, ["s", "cluster"]).where("session_id_a < session_id_b").select("session_id_a", "session_id_b").distinct()
