"""Results of several models side by side."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listenloom.operators.evaluation import SLICES


def result_frame(results: list[DataFrame]) -> DataFrame:
    """All rows, by slice in their usual order, then by model."""
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.orderBy(F.array_position(F.array(*[F.lit(s) for s in SLICES]), F.col("slice")), "model")


def chance_level(k: int, n_items: int) -> float:
    return k / n_items if n_items else 0.0


def markdown(results: DataFrame, metric: str = "hr_10", n_items: int | None = None) -> str:
    """A table of one metric, a row per slice; the best of a row is bold unless all are alike or zero."""
    rows = results.select("slice", "model", "n", metric).collect()  # models times slices
    models = sorted({r.model for r in rows})
    lines = [f"| slice | n | {' | '.join(models)} |", "|" + "---|" * (len(models) + 2)]
    for s in SLICES:
        cells = {r.model: r[metric] for r in rows if r.slice == s}
        if not cells:
            continue
        top = max(cells.values())
        mark = top > 0 and len(set(cells.values())) > 1
        shown = [f"**{cells[m]:.4f}**" if mark and cells.get(m) == top else f"{cells[m]:.4f}" if m in cells else "-" for m in models]
        lines.append(f"| {s} | {max(r.n for r in rows if r.slice == s)} | {' | '.join(shown)} |")
    if n_items:
        lines.append(f"\nChance level of HR@10: {chance_level(10, n_items):.6f}")
    return "\n".join(lines)


def write(results: DataFrame, folder: str, context: dict) -> None:
    """CSV, JSON with the context, and Markdown of a result table."""
    out = Path(folder)
    out.mkdir(parents=True, exist_ok=True)
    table = results.toPandas()  # models times slices
    table.to_csv(out / "results.csv", index=False)
    (out / "results.json").write_text(json.dumps({"context": context, "rows": table.to_dict("records")}, indent=1, default=str))
    (out / "results.md").write_text(markdown(results) + "\n")


def notes(n_users: int, max_per_user: int) -> list[str]:
    """What a reader must know of an evaluation with one user."""
    if n_users != 1:
        return []
    return [f"One user: the cap of {max_per_user} targets a user caps the whole evaluation.", "One user: nobody can be held out, so there is no cold_user slice."]


def write_insights(folder: str, drift: DataFrame, profile: DataFrame, labels: DataFrame, attention: DataFrame | None = None, drift_path: str | None = None) -> None:
    """Drift as JSON lines written by the executors; the few rows of the rest as JSON and Markdown.

    ``folder`` is the driver's. ``drift_path`` is where all machines write, and has to be given
    on a cluster; on one machine it is a part of ``folder``.
    """
    out = Path(folder)
    if drift_path is None:
        if not drift.sparkSession.sparkContext.master.startswith("local"):
            raise ValueError("drift_path has to name a folder that all machines share")
        drift_path = f"file://{out.resolve()}/drift"
    out.mkdir(parents=True, exist_ok=True)
    drift.write.mode("overwrite").json(drift_path)
    parts = {"profile": profile, "labels": labels} | ({"attention": attention} if attention is not None else {})
    lines = ["# Insights"]
    for name, df in parts.items():  # a row per cluster, label or block
        rows = [r.asDict(recursive=True) for r in df.collect()]
        (out / f"{name}.json").write_text(json.dumps(rows, indent=1, default=str))
        if rows:
            lines += ["", f"## {name.title()}", "", f"| {' | '.join(rows[0])} |", "|" + "---|" * len(rows[0]), *[f"| {' | '.join(str(v) for v in r.values())} |" for r in rows]]
    (out / "insights.md").write_text("\n".join(lines) + "\n")
