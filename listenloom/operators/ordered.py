"""Numbers in an order, without a task that sees all rows or all rows of one user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenloom.operators.intervals import DAY, slice_of
from listenloom.runtime import materialize

GAP = 1800


def running_total(df: DataFrame, order: list[Column], value: Column, name: str, label: str = "ordered") -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over all rows before this one in ``order``.

    Rows are laid out by range; only one sum per partition is put in order in one place.
    ``order`` has to tell all rows apart.
    """
    laid = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()).withColumn("__value", value), label)
    parts = laid.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offset = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))  # a row per partition
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return laid.join(F.broadcast(offset), "__part").withColumn(name, (F.coalesce(F.sum("__value").over(inside), F.lit(0)) + F.col("__offset")).cast("bigint")).drop("__part", "__value", "__offset")


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order``, which has to tell all rows apart."""
    return running_total(df, order, F.lit(1), name, "ranked")


def exact_quantile(df: DataFrame, column: str, q: float, few: int = 50_000) -> float | None:
    """Linear-interpolated quantile of a numeric column, exactly, null for no values.

    The bracket that holds the wanted ranks is narrowed by approximate quantiles until
    few distinct values are left in it; only those come to the driver.
    """
    values = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    total = values.agg(F.sum("n")).first()[0]
    if not total:
        return None
    at = (total - 1) * q
    low_rank, high_rank = int(at), min(int(at) + 1, total - 1)
    inside, below = values, 0
    while inside.count() > few:
        lo, hi = inside.agg(F.min("v"), F.max("v")).first()
        marks = sorted({lo, hi, *inside.select(F.percentile_approx("v", [i / 20 for i in range(1, 20)], 10_000)).first()[0]})
        sums = {r.k: r.n for r in inside.select(F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m < F.col("v"))).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        keep, seen = [], below
        for k in range(len(marks) + 1):
            upto = seen + sums.get(k, 0)
            if seen <= high_rank and upto > low_rank:
                keep.append(k)
            elif not keep:
                below = upto
            seen = upto
        a, b = keep[0], keep[-1]
        narrowed = inside
        if a > 0:
            narrowed = narrowed.where(F.col("v") > marks[a - 1])
        if b < len(marks):
            narrowed = narrowed.where(F.col("v") <= marks[b])
        if a == 0 and b == len(marks):
            break
        inside = materialize(narrowed, "bracket")
    seen, found = below, []
    for v, n in sorted((r.v, r.n) for r in inside.collect()):
        found += [v] * (seen <= low_rank < seen + n) + [v] * (seen <= high_rank < seen + n)
        seen += n
    return found[0] + (found[-1] - found[0]) * (at - low_rank)


def grouped_quantiles(df: DataFrame, group: str, column: str, qs: list[float]) -> DataFrame:
    """``group, q, value``: linear-interpolated quantiles of each group, exactly; nulls don't count.

    Values are counted and put in order over all groups at once, so no task holds a group's values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(group, F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = materialize(running_total(counts, [F.col(group), F.col("v")], F.col("n"), "before"), "quantiles")
    whole = placed.groupBy(group).agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    rows = placed.join(whole, group).withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs])))
    at = (F.col("total") - 1) * F.col("q")
    lo, hi = F.col("before") - F.col("start"), F.col("before") - F.col("start") + F.col("n")
    rows = rows.withColumn("at", at).withColumn("low", F.floor("at")).withColumn("high", F.least(F.col("low") + 1, F.col("total") - 1))
    covers = lambda r: (lo <= F.col(r)) & (F.col(r) < hi)
    ends = rows.where(covers("low") | covers("high")).groupBy(group, "q", "at", "low").agg(F.max(F.when(covers("low"), F.col("v"))).alias("a"), F.max(F.when(covers("high"), F.col("v"))).alias("b"))
    return ends.select(group, "q", (F.col("a") + (F.col("b") - F.col("a")) * (F.col("at") - F.col("low"))).alias("value"))


def in_sequence(events: DataFrame, gap: int = GAP, slice_seconds: int = 7 * DAY) -> DataFrame:
    """``events`` (``user_id, ts, seq, ...``) with ``pos, gap_s, session_no, slice``.

    ``pos`` counts a user's events from 0 in the order of ``ts``, then ``seq``; ``gap_s`` is
    the time since the event before (null for the first); a gap above ``gap`` opens a new
    ``session_no`` (from 0). Rows are ordered within slices of the calendar; one row per
    user and slice carries numbers and times over.
    """
    rows = events.withColumn("slice", slice_of(F.col("ts"), slice_seconds))
    w = Window.partitionBy("user_id", "slice").orderBy("ts", "seq")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = F.col("ts") - F.lag("ts").over(w)
    local = rows.withColumn("__inner", inner).withColumn("__k", F.row_number().over(w) - 1).withColumn("__new", F.sum(F.when(F.col("__inner") > gap, 1).otherwise(0)).over(upto))
    slices = local.groupBy("user_id", "slice").agg(F.min("ts").alias("__first"), F.max("ts").alias("__last"), F.count("*").alias("__n"), F.max("__new").alias("__news"))
    by = Window.partitionBy("user_id").orderBy("slice")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.withColumn("__reach", F.lag("__last").over(by))
    carried = carried.withColumn("__opens", F.when(F.col("__first") - F.col("__reach") > gap, 1).otherwise(0))
    carried = carried.withColumn("__pos", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__sessions", F.coalesce(F.sum("__news").over(before), F.lit(0)) + F.sum("__opens").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = local.join(carried.select("user_id", "slice", "__reach", "__pos", "__sessions"), ["user_id", "slice"])
    return (
        out.withColumn("pos", (F.col("__pos") + F.col("__k")).cast("bigint"))
        .withColumn("gap_s", F.when(F.col("__k") == 0, F.col("ts") - F.col("__reach")).otherwise(F.col("__inner")))
        .withColumn("session_no", (F.col("__sessions") + F.col("__new")).cast("bigint"))
        .drop("__inner", "__k", "__new", "__reach", "__pos", "__sessions")
    )


def sessionized(events: DataFrame, gap: int = GAP) -> DataFrame:
    """:func:`in_sequence` with ``session_id``, one running number from 1 over all users in their order."""
    rows = materialize(in_sequence(events, gap), "in-sequence")
    users = rows.groupBy("user_id").agg((F.max("session_no") + 1).alias("__n"))
    offsets = running_total(users, [F.col("user_id")], F.col("__n"), "__before", "users").select("user_id", "__before")
    return rows.join(offsets, "user_id").withColumn("session_id", (F.col("__before") + F.col("session_no") + 1).cast("bigint")).drop("__before")


def lagged_pairs(seqs: DataFrame, lags: int, columns: list[str], block: int = 512) -> DataFrame:
    """Rows with those up to ``lags`` positions later of the same user: ``lag``, ``columns`` and ``next_`` columns.

    Users are cut into blocks of positions that overlap by ``lags``, so a long history is many partitions.
    """
    b = F.floor(F.col("pos") / block).cast("bigint")
    home = F.struct(b.alias("b"), F.lit(True).alias("own"))
    guest = F.struct((b - 1).alias("b"), F.lit(False).alias("own"))
    rows = seqs.select("user_id", "pos", *columns, F.explode(F.when((F.col("pos") % block < lags) & (b > 0), F.array(home, guest)).otherwise(F.array(home))).alias("__p"))
    w = Window.partitionBy("user_id", "__p.b").orderBy("pos")
    nexts = [F.struct(F.lit(k).alias("lag"), *[F.lead(c, k).over(w).alias(f"next_{c}") for c in columns], F.lead("pos", k).over(w).alias("next_pos")) for k in range(1, lags + 1)]
    return rows.withColumn("__n", F.array(*nexts)).where("__p.own").select("user_id", "pos", *columns, F.explode("__n").alias("__x")).select("user_id", "pos", *columns, "__x.*").where("next_pos is not null").drop("next_pos")


def histories(targets: DataFrame, seqs: DataFrame, length: int, columns: list[str], key: str = "instance_id") -> DataFrame:
    """For each target (``key, user_id, pos``) the up to ``length`` events before it.

    Returns ``key, user_id, target_pos, pos`` and ``columns``. Both sides meet on blocks of
    positions, so neither a long history nor a user with many targets is one group.
    """
    blocks = F.sequence(F.greatest(F.floor((F.col("pos") - length) / length), F.lit(0)).cast("bigint"), F.floor((F.col("pos") - 1) / length).cast("bigint"))
    asked = targets.where("pos > 0").select(key, "user_id", F.col("pos").alias("target_pos"), F.explode(blocks).alias("block"))
    had = seqs.select("user_id", "pos", *columns, F.floor(F.col("pos") / length).cast("bigint").alias("block"))
    return asked.join(had, ["user_id", "block"]).where((F.col("pos") < F.col("target_pos")) & (F.col("pos") >= F.col("target_pos") - length)).drop("block")
