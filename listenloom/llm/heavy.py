"""Most frequent values of columns with billions of rows, in bounded memory.

Pass one keeps, per input partition and column, a space-saving summary of at
most ``capacity`` counters. Summaries are merged in a tree of fixed fan-in; the
merged summary bounds each value's count from both sides and says how often a
value it doesn't hold can occur at most. Pass two counts the few values that can
still reach the wanted share exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.functions.text import has_text
from listenloom.runtime import broadcast_small, materialize

_SUMMARY = "field_name string, part int, n_rows bigint, floor bigint, value array<string>, upper array<bigint>, error array<bigint>"


class SpaceSaving:
    """At most ``capacity`` counters after :meth:`shrink`; four times as many in between.

    ``upper[v]`` never undercounts and ``upper[v] - error[v]`` never overcounts.
    A value that isn't held occurred at most ``floor`` times.
    """

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.floor = capacity, 0, 0
        self.upper: dict[str, int] = {}
        self.error: dict[str, int] = {}

    def add_counts(self, values: list[str], counts: list[int]) -> None:
        """Exact counts of one more batch."""
        upper, floor = self.upper, self.floor
        for v, c in zip(values, counts):
            if v in upper:
                upper[v] += c
            else:
                upper[v] = c + floor
                if floor:
                    self.error[v] = floor
        self.rows += sum(counts)
        if len(upper) > 4 * self.capacity:
            self.shrink()

    def add_summary(self, values, upper, error, floor: int, rows: int) -> None:
        """Another summary; what either lacks may have occurred up to its floor there."""
        theirs = dict(zip(values, zip(upper, error)))
        for v in self.upper:
            if v not in theirs:
                self.upper[v] += floor
                self.error[v] = self.error.get(v, 0) + floor
        for v, (u, e) in theirs.items():
            if v in self.upper:
                self.upper[v] += int(u)
                self.error[v] = self.error.get(v, 0) + int(e)
            else:
                self.upper[v] = int(u) + self.floor
                self.error[v] = int(e) + self.floor
        self.floor += int(floor)
        self.rows += int(rows)
        if len(self.upper) > 4 * self.capacity:
            self.shrink()

    def shrink(self) -> None:
        """Keep the ``capacity`` largest counters; the largest one let go raises the floor."""
        if len(self.upper) <= self.capacity:
            return
        names = list(self.upper)
        counts = np.fromiter(self.upper.values(), dtype=np.int64, count=len(names))
        order = np.argpartition(-counts, self.capacity)
        self.floor = max(self.floor, int(counts[order[self.capacity :]].max()))
        self.upper = {names[i]: int(counts[i]) for i in order[: self.capacity]}
        self.error = {v: e for v, e in self.error.items() if v in self.upper}

    def row(self, field: str, part: int) -> dict:
        self.shrink()
        return {"field_name": field, "part": part, "n_rows": self.rows, "floor": self.floor, "value": list(self.upper), "upper": list(self.upper.values()), "error": [self.error.get(v, 0) for v in self.upper]}


def _summarise(fields: list[str], capacity: int):
    arrow = pa.schema([("field_name", pa.string()), ("part", pa.int32()), ("n_rows", pa.int64()), ("floor", pa.int64()), ("value", pa.list_(pa.string())), ("upper", pa.list_(pa.int64())), ("error", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = {f: SpaceSaving(capacity) for f in fields}, 0
        for batch in batches:
            part = batch.column("__part")[0].as_py() if batch.num_rows else part
            for f in fields:
                counted = pc.value_counts(batch.column(f).drop_null())
                values, counts = counted.field(0), counted.field(1)
                kept = pc.not_equal(pc.utf8_trim_whitespace(values), "")
                own[f].add_counts(values.filter(kept).to_pylist(), counts.filter(kept).to_pylist())
        rows = [s.row(f, part) for f, s in own.items() if s.rows]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return run


def _merge(capacity: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = SpaceSaving(capacity)
        for r in pdf.sort_values("part").itertuples():
            total.add_summary(r.value, r.upper, r.error, r.floor, r.n_rows)
        return pd.DataFrame([total.row(key[0], int(key[1]))])

    return run


def heavy_summaries(df: DataFrame, fields: list[str], capacity: int = 4000, fan_in: int = 16) -> DataFrame:
    """One merged summary per field: ``field_name, part, n_rows, floor, value, upper, error``.

    Nulls and blank values don't count. ``floor <= n_rows / capacity`` always holds.
    Memory per task is a batch and ``4 * capacity`` counters, whatever the input.
    """
    picked = df.select(*[F.col(f"`{f}`").cast("string").alias(f) for f in fields])
    out = materialize(picked.withColumn("__part", F.spark_partition_id()).mapInArrow(_summarise(fields, capacity), _SUMMARY), "summaries")
    width = (out.agg(F.max("part")).first()[0] or 0) + 1
    while width > 1:
        width = -(-width // fan_in)
        out = out.groupBy("field_name", F.pmod("part", F.lit(width)).cast("int").alias("__g")).applyInPandas(_merge(capacity), _SUMMARY)
    return out


def frequent_values(df: DataFrame, fields: list[str], share: float, capacity: int = 4000) -> DataFrame:
    """Values that make up at least ``share`` of a field's rows, exactly counted.

    Returns ``field_name, field_value, n_rows, lower_bound, upper_bound, total_rows``:
    the exact count, the summary's bounds and the rows of the field that are neither
    null nor blank. Values are compared as stored. A field without any value, and an
    empty table, give no row. Values of one count are all kept, as it is no top-k.

    ``capacity`` has to be above ``1 / share``; then no frequent value is missed.
    What is broadcast for pass two is at most about ``2 / share`` values a field.
    """
    if capacity * share <= 1:
        raise ValueError("capacity must be above 1 / share")
    merged = materialize(heavy_summaries(df, fields, capacity), "merged")
    survivors = (
        merged.select("field_name", F.col("n_rows").alias("total_rows"), F.explode(F.arrays_zip("value", "upper", "error")).alias("c"))
        .select("field_name", F.col("c.value").alias("field_value"), (F.col("c.upper") - F.col("c.error")).alias("lower_bound"), F.col("c.upper").alias("upper_bound"), "total_rows")
        .where(F.col("upper_bound") >= F.ceil(F.col("total_rows") * F.lit(share) - 1e-9))
    )
    survivors = broadcast_small(survivors)
    pairs = ", ".join(f"'{f}', cast(`{f}` as string)" for f in fields)
    long = df.selectExpr(f"stack({len(fields)}, {pairs}) as (field_name, field_value)").where(has_text(F.col("field_value")))
    counted = long.join(survivors.select("field_name", "field_value"), ["field_name", "field_value"], "left_semi").groupBy("field_name", "field_value").agg(F.count("*").alias("n_rows"))
    return counted.join(survivors, ["field_name", "field_value"]).where(F.col("n_rows") >= F.ceil(F.col("total_rows") * F.lit(share) - 1e-9)).select("field_name", "field_value", "n_rows", "lower_bound", "upper_bound", "total_rows")
