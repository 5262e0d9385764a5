"""Documents into containers of fixed capacity, little of it left empty.

The plan is made on the histogram of lengths, at most ``capacity`` numbers however
many documents there are: best fit in falling order of length, on counts. It says
that the documents of one length from one rank to another go, so many each, to the
containers from some number on. Documents then find their container by their rank
among those of their length. Only documents longer than a container are split, into
full containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenloom.llm.tokens import TOKENIZER, with_token_counts
from listenloom.runtime import materialize

_PLAN = "length int, rank_from bigint, rank_to bigint, container_from bigint, per_container bigint"


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best fit, longest first, on counts: ``(length, rank from, rank to, container from, items a container)`` and the number of containers.

    Containers that were filled alike stay together, as a span of numbers, until an
    item goes to only some of them, so the plan grows with the lengths, not the items.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # space left -> spans of containers
    spaces: list[int] = []  # the keys of room in order
    plan: list[tuple[int, int, int, int, int]] = []
    made = 0

    def put(space: int, start: int, stop: int) -> None:
        if space > 0 and start < stop:
            if space not in room:
                room[space] = []
                insort(spaces, space)
            room[space].append((start, stop))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            tightest = bisect_left(spaces, length)
            if tightest == len(spaces):
                each = capacity // length
                full, over = divmod(left, each)
                if full:
                    plan.append((length, rank, rank + full * each, made, each))
                    put(capacity - each * length, made, made + full)
                    made, rank = made + full, rank + full * each
                if over:
                    plan.append((length, rank, rank + over, made, over))
                    put(capacity - over * length, made, made + 1)
                    made += 1
                break
            space = spaces[tightest]
            start, stop = room[space].pop()
            if not room[space]:
                del room[space], spaces[tightest]
            each = space // length
            use = min(stop - start, left // each)
            if use:
                plan.append((length, rank, rank + use * each, start, each))
                put(space - each * length, start, start + use)
                rank, left, start = rank + use * each, left - use * each, start + use
            if left and start < stop:  # fewer items than this container takes
                plan.append((length, rank, rank + left, start, left))
                put(space - left * length, start, start + 1)
                start, left = start + 1, 0
            put(space, start, stop)
    return plan, made


def pack_documents(documents: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, salts: int = 64, plan_rows: int = 200_000) -> DataFrame:
    """``container_id, doc_id, piece, start_token, n_tokens``: where each document goes.

    A document of up to ``capacity`` tokens is one piece (0); a longer one has full pieces
    and a rest. Every token of every row of ``documents`` is in exactly one container and
    none holds more than ``capacity``. Rows with null or empty text have nothing to place
    and no row; rows under one id, and equal texts, are placed one by one; a null id stays
    null. Other columns are ignored. An empty table gives no containers.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    spark = documents.sparkSession
    sized = with_token_counts(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text", "tokens", tokenizer)
    whole = materialize(sized.where("tokens > 0").withColumn("salt", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.monotonically_increasing_id()), F.lit(salts)).cast("int")), "sized")
    pieces = whole.select("doc_id", "tokens", "salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.ceil(F.col("tokens") / F.lit(capacity)) - 1)).alias("piece"))
    pieces = pieces.select("doc_id", "salt", "piece", (F.col("piece") * capacity).alias("start_token"), F.least(F.lit(capacity).cast("bigint"), F.col("tokens") - F.col("piece") * capacity).cast("int").alias("length"))
    counts = materialize(pieces.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # capacity * salts rows at most
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    plan, _ = plan_containers(histogram, capacity)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.withColumn("before", before).select("length", "salt", "before")
    ranked = pieces.withColumn("k", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1).join(F.broadcast(offsets), ["length", "salt"]).withColumn("rank", F.col("before") + F.col("k"))
    planned = spark.createDataFrame(plan, _PLAN)
    spans = planned.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("rank_from", "rank_to", "container_from", "per_container"))).alias("spans"))
    spans = F.broadcast(spans) if len(plan) <= plan_rows else spans
    span = F.filter("spans", lambda s: (s["rank_from"] <= F.col("rank")) & (F.col("rank") < s["rank_to"]))[0]
    placed = ranked.join(spans, "length").withColumn("span", span)
    container = F.col("span.container_from") + F.floor((F.col("rank") - F.col("span.rank_from")) / F.col("span.per_container"))
    return placed.select(container.cast("bigint").alias("container_id"), "doc_id", "piece", "start_token", F.col("length").cast("bigint").alias("n_tokens"))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: ``containers, tokens, fewest_possible, fill``. All zero, and a null fill, where nothing was packed."""
    used = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("t"))
    total = F.coalesce(F.sum("t"), F.lit(0))
    return used.agg(F.count("*").alias("containers"), total.alias("tokens"), F.ceil(total / F.lit(capacity)).alias("fewest_possible"), F.try_divide(total, F.count("*") * F.lit(capacity)).alias("fill"))
