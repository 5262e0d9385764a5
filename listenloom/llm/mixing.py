"""Draws from several sources so that each has its share of the tokens drawn.

Shares are tempered: between the targets (exponent 0) and the sources' own shares
(exponent 1) lie ``target * (own / target) ** exponent``, normalised. The exponent is
bisected to the least at which no source is used more often than it may be, so that
targets hold wherever the budget allows it, and small sources give way evenly where
it doesn't. Without targets the own shares are tempered to a wanted entropy: raised to
the power, found by bisection, at which they have it.

A source's budget is drawn as whole passes over its documents and a part of another:
documents lie in blocks in the order of a hash, blocks are taken whole while the
budget lasts, and only the last one is cut, by a running sum inside it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenloom.functions.text import strip
from listenloom.llm.tokens import TOKENIZER, with_token_counts
from listenloom.runtime import materialize


def source_key(c: Column) -> Column:
    """A source's name with case, outer white space and the kind of separator set aside; null if blank."""
    return F.nullif(F.regexp_replace(F.lower(strip(c)), r"[\s_-]+", "_"), F.lit(""))


def tempered(target: dict[str, float], own: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares at an exponent between the targets (0) and the own shares (1)."""
    w = {s: t * (own[s] / t) ** exponent for s, t in target.items() if t > 0 and own.get(s, 0) > 0}
    total = sum(w.values())
    return {s: x / total for s, x in w.items()} if total else {}


def _bisect(holds, low: float, high: float, steps: int = 60) -> float:
    """Least value at which ``holds``, which is so from some value on up to ``high``."""
    if holds(low):
        return low
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if holds(mid) else (mid, high)
    return high


def entropy(shares: dict[str, float]) -> float:
    return -sum(p * math.log(p) for p in shares.values() if p > 0)


def power_for_entropy(own: dict[str, float], wanted: float) -> tuple[dict[str, float], float]:
    """Own shares to the power that gives the wanted entropy (nats), and that power; equal shares if it is out of reach."""
    def at(power):
        w = {s: x**power for s, x in own.items() if x > 0}
        total = sum(w.values())
        return {s: x / total for s, x in w.items()} if total else {}

    # a higher power concentrates the shares, so entropy falls with it
    power = -_bisect(lambda minus: entropy(at(-minus)) >= wanted, -16.0, 0.0)
    return at(power), power


def temper_to_entropy(own: dict[str, float], wanted: float) -> dict[str, float]:
    """The shares of :func:`power_for_entropy`."""
    return power_for_entropy(own, wanted)[0]


def mixing_weights(tokens: dict[str, int], target: dict[str, float], repeats: dict[str, float], budget: float | None = None) -> tuple[dict[str, float], float, float]:
    """``(shares, budget, exponent)`` by source.

    Without a budget it is the largest at which every source reaches its target.
    A budget above what all sources give together is brought down to that.
    """
    own = {s: float(t) for s, t in tokens.items() if t > 0 and target.get(s, 0) > 0 and repeats.get(s, 1) > 0}
    total = sum(own.values())
    if not total:
        return {}, 0.0, 0.0
    own = {s: t / total for s, t in own.items()}
    goal = tempered({s: target[s] for s in own}, own, 0.0)
    most = {s: repeats.get(s, 1) * tokens[s] for s in own}
    if budget is None:
        return goal, min(most[s] / p for s, p in goal.items()), 0.0
    budget = min(float(budget), float(sum(most.values())))

    def fits(e: float) -> bool:
        return all(budget * p <= most[s] * (1 + 1e-12) for s, p in tempered(goal, own, e).items())

    if fits(1.0):
        e = _bisect(fits, 0.0, 1.0)
        return tempered(goal, own, e), budget, e
    # even the own shares ask too much of some source: those give all they may, the rest follow their shares
    left, shares, open_ = budget, {}, dict(own)
    while open_:
        scale = left / sum(open_.values())
        over = [s for s, p in open_.items() if p * scale >= most[s]]
        for s in over or list(open_):
            amount = min(most[s], open_.pop(s) * scale)
            shares[s] = amount / budget
            left -= amount
    return shares, budget, 1.0


def mix_sources(documents: DataFrame, targets: DataFrame | None, budget: float | None = None, epochs: float | None = None, flatness: float = 1.0, repeats: int = 1, doc_id: str = "doc_id", source: str = "source", text: str = "text", tokenizer: str = TOKENIZER, seed: int = 0, block_docs: int = 2000, stretch_blocks: int = 2000) -> tuple[DataFrame, DataFrame]:
    """``(draws, report)``.

    ``draws``: ``source, doc_id, n_tokens, pass, block``, one row per use of a document. A
    document is used once in each of its source's whole passes and at most once more.
    ``report``: ``source, n_docs, tokens, target_share, planned_share, drawn_tokens,
    actual_share, passes, max_repeats, exponent``, one row per source of either table.

    ``budget`` is in tokens, ``epochs`` the budget in times of what the sources with a
    target hold; without either it is the largest at which every target is reached, so
    that the exponent is 0. Without ``targets`` the sources' own shares are tempered until
    their entropy is the part ``flatness`` of the most there can be, each document may be
    used ``repeats`` times, and the exponent reported is the power.

    Names of sources are matched without regard to case, outer white space and separators.
    A source without a target (or without a name) isn't drawn, a target without documents
    can't be reached: both stand in the report and the other targets keep their ratios.
    Of several targets for one source the largest holds; a null or negative share is 0, a
    null ``max_repeats`` 1. Documents without tokens are never drawn; rows under one id are
    documents of their own. Empty tables give no draws. The number of sources is what the
    driver holds; documents are not.
    """
    spark = documents.sparkSession
    named = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), source_key(F.col(f"`{source}`").cast("string")).alias("source"), F.col(f"`{text}`").alias("text"))
    sized = materialize(with_token_counts(named, "text", "n_tokens", tokenizer).where("n_tokens > 0").withColumn("place", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.monotonically_increasing_id(), F.lit(seed))), "sized")
    have = {r.source: (r.docs, r.tokens) for r in sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")).collect()}
    tokens = {s: t for s, (_, t) in have.items() if s is not None}
    power = None
    if targets is None:
        whole = sum(tokens.values())
        flat, power = power_for_entropy({s: t / whole for s, t in tokens.items()}, flatness * math.log(len(tokens))) if tokens else ({}, 0.0)
        goals = {s: (p, repeats) for s, p in flat.items()}
    else:
        goals = {r.source: (max(0.0, r.share or 0.0), r.most) for r in targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.coalesce(F.col("max_repeats").cast("int"), F.lit(1)).alias("most")).groupBy("source").agg(F.max("share").alias("share"), F.max("most").alias("most")).collect() if r.source is not None}
    if epochs is not None:
        budget = epochs * sum(t for s, t in tokens.items() if goals.get(s, (0.0, 0))[0] > 0)
    shares, total, exponent = mixing_weights(tokens, {s: g for s, (g, _) in goals.items()}, {s: max(0, m) for s, (_, m) in goals.items()}, budget)
    exponent = exponent if power is None else power

    plan = []
    for s, p in shares.items():
        docs, t = have[s]
        wanted = p * total
        whole = min(int(wanted / t + 1e-9), goals[s][1])
        rest = max(0.0, wanted - whole * t) if whole < goals[s][1] else 0.0
        plan.append((s, whole, rest, max(1, docs // block_docs)))
    schema = "source string, whole int, rest double, blocks bigint"
    planned = F.broadcast(spark.createDataFrame(plan, schema))  # a row per source
    drawn = sized.join(planned, "source").withColumn("block", F.pmod("place", F.col("blocks")))
    full = drawn.where("whole > 0").select("source", "doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("pass"), "place", "blocks")
    # another order in every pass
    full = full.select("source", "doc_id", "n_tokens", "pass", F.pmod(F.xxhash64("place", "pass"), F.col("blocks")).alias("block"))
    part = drawn.where("rest > 0")
    # running sums over stretches of blocks, then inside each, so that no task sees all blocks of a source
    earlier = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    sums = part.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).withColumn("stretch", F.floor(F.col("block") / stretch_blocks))
    far = sums.groupBy("source", "stretch").agg(F.sum("t").alias("all")).withColumn("far", F.coalesce(F.sum("all").over(earlier("source", "stretch")), F.lit(0))).drop("all")
    taken = sums.join(far, ["source", "stretch"]).withColumn("before", F.col("far") + F.coalesce(F.sum("t").over(earlier("source", "stretch", "block")), F.lit(0)))
    part = part.join(taken.select("source", "block", "before", "t"), ["source", "block"]).where("before < rest")
    inner = Window.partitionBy("source", "block").orderBy("place", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole_blocks = part.where("before + t <= rest").select("source", "doc_id", "n_tokens", F.col("whole").alias("pass"), "block")
    # of the block in which the budget ends, documents up to the one that comes nearest to it
    cut = part.where("before + t > rest").withColumn("upto", F.col("before") + F.sum("n_tokens").over(inner)).where("upto - n_tokens / 2.0 <= rest").select("source", "doc_id", "n_tokens", F.col("whole").alias("pass"), "block")
    draws = materialize(full.unionByName(whole_blocks).unionByName(cut), "draws")

    got = {r.source: r.t for r in draws.groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    everything = sum(got.values())
    rows = []
    for s in sorted({*have, *goals}, key=lambda x: (x is None, x or "")):
        docs, t = have.get(s, (0, 0))
        goal, most = goals.get(s, (0.0, 0))
        rows.append((s, docs, t, goal, shares.get(s, 0.0), got.get(s, 0), got.get(s, 0) / everything if everything else 0.0, got.get(s, 0) / t if t else 0.0, most, exponent))
    report = spark.createDataFrame(rows, "source string, n_docs bigint, tokens bigint, target_share double, planned_share double, drawn_tokens bigint, actual_share double, passes double, max_repeats int, exponent double")
    return draws, report
