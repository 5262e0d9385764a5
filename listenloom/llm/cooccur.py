"""Pairs of items that appear together far more often than chance.

Stripes: each task keeps, per item, an array of the items seen beside it with
counts, and emits it when its buffer is full; stripes of one item are merged by
key. Two facts prune without loss before any pair is formed: a pair can't reach
``min_count`` if one of its items doesn't, nor ``min_lift`` if one of its items
is in more than ``n / min_lift`` baskets, since then c <= c_small gives
c * n / (c_a * c_b) <= n / c_large < min_lift.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.runtime import broadcast_small, materialize

_STRIPE = pa.schema([("item_a", pa.int64()), ("salt", pa.int32()), ("neighbours", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
_PAIR = pa.schema([("item_a", pa.int64()), ("item_b", pa.int64()), ("n_both", pa.int64())])


def _summed(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts added up per (a, b), sorted by both."""
    if not len(a):
        return a, b, c
    order = np.lexsort((b, a))
    a, b, c = a[order], b[order], c[order]
    first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    return a[first], b[first], np.add.reduceat(c, first)


def _stripes(salts: int, buffer: int, block: int):
    def emit(parts):
        a, b, c = _summed(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
        salt = (b % salts).astype(np.int32)
        order = np.lexsort((b, salt, a))
        a, b, c, salt = a[order], b[order], c[order], salt[order]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (salt[1:] != salt[:-1])])
        offsets = pa.array(np.r_[first, len(a)].astype(np.int32))
        for s in range(0, len(first), 20_000):
            cut = slice(s, min(s + 20_000, len(first)))
            o = offsets.slice(s, cut.stop - s + 1)
            yield pa.RecordBatch.from_arrays([pa.array(a[first[cut]]), pa.array(salt[first[cut]]), pa.ListArray.from_arrays(o, pa.array(b)), pa.ListArray.from_arrays(o, pa.array(c))], schema=_STRIPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            lists = batch.column("items")
            flat, at = np.asarray(lists.flatten()), np.asarray(lists.offsets)
            for lo, hi in zip(at[:-1] - at[0], at[1:] - at[0]):
                basket = np.sort(flat[lo:hi])
                for i in range(0, len(basket), block):  # a long basket goes block by block
                    for j in range(i, len(basket), block):
                        x, y = basket[i : i + block], basket[j : j + block]
                        k, m = np.triu_indices(len(x), 1) if i == j else (np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x)))
                        parts.append((x[k], y[m], np.ones(len(k), dtype=np.int64)))
                        held += len(k)
                        if held >= buffer:
                            merged = _summed(*(np.concatenate([p[q] for p in parts]) for q in range(3)))
                            parts, held = [merged], len(merged[0])
                            if held >= buffer // 2:
                                yield from emit(parts)
                                parts, held = [], 0
        if held:
            yield from emit(parts)

    return run


def _merge_stripes(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = (np.zeros(0, np.int64),) * 3

        def out(a, b, c):
            ok = c >= min_count
            for s in range(0, int(ok.sum()), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(v[ok][s : s + 50_000]) for v in (a, b, c)], schema=_PAIR)

        for batch in batches:  # sorted by item_a: all but the last item of a batch is complete
            lists = batch.column("neighbours")
            a = np.repeat(np.asarray(batch.column("item_a")), np.diff(np.asarray(lists.offsets)))
            new = (a, np.asarray(lists.flatten()), np.asarray(batch.column("counts").flatten()))
            a, b, c = _summed(*(np.concatenate([x, y]) for x, y in zip(keep, new)))
            if len(a):
                done = a < a[-1]
                yield from out(a[done], b[done], c[done])
                keep = (a[~done], b[~done], c[~done])
        yield from out(*keep)

    return run


def baskets_of(df: DataFrame, basket: str, items: str, reserved: tuple[int, ...] = (0, 1)) -> DataFrame:
    """``basket, items``: one row per basket with its distinct items, nulls and reserved ids left out.

    Deliveries of one basket are united, so their order and number don't matter;
    a null basket id is no basket, and a basket without items is left out.
    """
    kept = F.filter(F.col(f"`{items}`"), lambda x: x.isNotNull() & ~x.isin(*reserved)) if reserved else F.filter(F.col(f"`{items}`"), lambda x: x.isNotNull())
    return (
        df.where(F.col(f"`{basket}`").isNotNull() & F.col(f"`{items}`").isNotNull())
        .groupBy(F.col(f"`{basket}`").alias("basket"))
        .agg(F.array_distinct(F.flatten(F.collect_set(F.array_distinct(kept)))).alias("items"))
        .where(F.size("items") > 0)
    )


def cooccurring_pairs(df: DataFrame, basket: str = "session_id", items: str = "items", min_count: int = 6, min_lift: float = 10.0, reserved: tuple[int, ...] = (0, 1), salts: int = 4, buffer: int = 2_000_000, block: int = 2048) -> DataFrame:
    """``item_a < item_b`` with ``n_both, n_a, n_b, n_baskets, lift, llr``.

    Pairs in at least ``min_count`` baskets with lift ``n_both * n / (n_a * n_b)`` of at
    least ``min_lift``; ``llr`` is the log-likelihood ratio of the 2x2 table. Each basket
    and each item in it count once. Empty input gives no pairs. Null baskets, null item
    arrays, null and reserved items are ignored.
    """
    baskets = materialize(baskets_of(df, basket, items, reserved), "baskets")
    n = baskets.count()
    single = materialize(baskets.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("n_item")), "items")
    # at most min_lift times the mean basket length of these exist
    hot = single.where(F.col("n_item") * F.lit(min_lift) > F.lit(n)).select("item")
    usable = (
        baskets.select("basket", F.explode("items").alias("item"))
        .join(broadcast_small(hot), "item", "left_anti")
        .join(single.where(F.col("n_item") >= min_count).select("item"), "item", "left_semi")
    )
    short = usable.groupBy("basket").agg(F.collect_list("item").alias("items")).where(F.size("items") > 1).select("items")
    stripes = short.mapInArrow(_stripes(salts, buffer, block), "item_a bigint, salt int, neighbours array<bigint>, counts array<bigint>")
    pairs = stripes.repartition("item_a", "salt").sortWithinPartitions("item_a").mapInArrow(_merge_stripes(min_count), "item_a bigint, item_b bigint, n_both bigint")
    a = single.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = single.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    found = pairs.join(a, "item_a").join(b, "item_b").withColumn("n_baskets", F.lit(n).cast("bigint")).where(F.col("n_both") * F.col("n_baskets") >= F.lit(min_lift) * F.col("n_a") * F.col("n_b"))

    def xlogx(c):
        return F.when(c > 0, c * F.log(c)).otherwise(0.0)

    k11, k12, k21 = F.col("n_both").cast("double"), (F.col("n_a") - F.col("n_both")).cast("double"), (F.col("n_b") - F.col("n_both")).cast("double")
    k22 = (F.col("n_baskets") - F.col("n_a") - F.col("n_b") + F.col("n_both")).cast("double")
    llr = 2 * (xlogx(k11) + xlogx(k12) + xlogx(k21) + xlogx(k22) + xlogx(F.col("n_baskets").cast("double")) - xlogx(k11 + k12) - xlogx(k21 + k22) - xlogx(k11 + k21) - xlogx(k12 + k22))
    return found.select("item_a", "item_b", "n_both", "n_a", "n_b", "n_baskets", (k11 * F.col("n_baskets") / F.col("n_a") / F.col("n_b")).alias("lift"), F.greatest(llr, F.lit(0.0)).alias("llr"))
