"""The model over tables: ranks, recommendations, attention, item vectors.

Weights travel to the executors once, as a broadcast variable; a batch of histories
is scored against the whole catalogue and reduced to ranks before it leaves.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from listenloom.model.encoder import FIRST, PAD, Encoder, Shape, left_padded
from listenloom.operators.ordered import histories
from listenloom.runtime import hadoop_fs


def gathered(past: DataFrame) -> DataFrame:
    """``instance_id, items, times`` of ``instance_id, pos, item_id, ts``; a history is at most a few hundred rows."""
    by = past.groupBy("instance_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "ts"))).alias("h"))
    return by.select("instance_id", F.transform("h", lambda x: x["item_id"]).alias("items"), F.transform("h", lambda x: x["ts"]).alias("times"))


#: Bytes of a model sent to every executor at most.
MOST_SENT = 1 << 30


def _broadcast(df: DataFrame, shape: Shape, weights: dict[str, np.ndarray]):
    size = sum(w.nbytes for w in weights.values())
    if size > MOST_SENT:
        raise ValueError(f"a model of {size >> 20} MB is too large to send; score its catalogue part by part")
    return df.sparkSession.sparkContext.broadcast((shape, weights))


def dense_ranks(instances: DataFrame, past: DataFrame, shape: Shape, weights: dict[str, np.ndarray], batch: int = 64) -> DataFrame:
    """``instances`` with ``rank``: items that score at least as high as the target, less one."""
    sent = _broadcast(past, shape, weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Encoder(*sent.value)
        table = model.table()
        for pdf in frames:
            ranks = []
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                scores = model.scores([np.array(x) for x in part["items"]], [np.array(x) for x in part["times"]], table)
                own = scores[np.arange(len(part)), part["target"].to_numpy()]
                ranks += ((scores >= own[:, None]).sum(1) - 1).tolist()
            yield pd.DataFrame({"instance_id": pdf["instance_id"], "rank": ranks})

    asked = instances.select("instance_id", "target").join(gathered(past), "instance_id")
    return instances.join(asked.mapInPandas(run, "instance_id string, rank bigint"), "instance_id")


@dataclass
class Dense:
    """The sequence model as a scorer of ``listenloom.operators.harness``."""

    shape: Shape
    weights: dict[str, np.ndarray]
    name: str = "encoder"

    def ranks(self, instances: DataFrame, seqs: DataFrame, n_items: int) -> DataFrame:
        return dense_ranks(instances, histories(instances, seqs, self.shape.max_len, ["item_id", "ts"]), self.shape, self.weights)


def dense_recommend(past: DataFrame, shape: Shape, weights: dict[str, np.ndarray], k: int = 20, discover: bool = False, batch: int = 64) -> DataFrame:
    """``instance_id, place, item_id, score``: the best ``k``; with ``discover`` none of the history."""
    sent = _broadcast(past, shape, weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Encoder(*sent.value)
        table = model.table()
        for pdf in frames:
            out = []
            for s in range(0, len(pdf), batch):
                part = pdf.iloc[s : s + batch]
                scores = model.scores([np.array(x) for x in part["items"]], [np.array(x) for x in part["times"]], table)
                for i, (name, items) in enumerate(zip(part["instance_id"], part["items"])):
                    if discover:
                        scores[i, np.array(items)] = -np.inf
                    top = np.lexsort((np.arange(scores.shape[1]), -scores[i]))[:k]
                    out += [(name, n + 1, int(j), float(scores[i, j])) for n, j in enumerate(top) if np.isfinite(scores[i, j])]
            yield pd.DataFrame(out, columns=["instance_id", "place", "item_id", "score"])

    return gathered(past).mapInPandas(run, "instance_id string, place int, item_id bigint, score double")


_TRACE = "instance_id string, block int, history_len int, recency_mass double, repeat_item_mass double, top_mass double, concentration double, expected_recency array<double>, top array<struct<recency int, item_id bigint, gap_s bigint, weight double, per_head array<double>>>"


def attention_traces(past: DataFrame, shape: Shape, weights: dict[str, np.ndarray], top: int = 10) -> DataFrame:
    """What the newest position of each history looks at, per block."""
    sent = _broadcast(past, shape, weights)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Encoder(*sent.value)
        for pdf in frames:
            out = []
            for name, items, times in zip(pdf["instance_id"], pdf["items"], pdf["times"]):
                ids, gaps = left_padded([np.array(items)], [np.array(times)], model.shape.max_len)
                real = ids[0] != PAD
                seen, length = ids[0][real], int(real.sum())
                if not length:
                    continue
                at = np.array(times)[-length:]
                recency = np.arange(length - 1, -1, -1)
                kinds, n = np.unique(seen, return_counts=True)
                for block, a in enumerate(model.encode(ids, gaps if model.shape.use_time else None)[1]):
                    heads = a[0, :, -1, real].T
                    heads = heads / np.maximum(heads.sum(1, keepdims=True), 1e-12)
                    mean = heads.mean(0)
                    best = np.argsort(-mean, kind="stable")[:top]
                    mass = float(mean[best].sum())
                    out.append((name, block, length, float(mean[-1]), float(mean[np.isin(seen, kinds[n > 1])].sum()), mass, mass / (len(best) / length), (heads @ recency).tolist(), [(int(recency[i]), int(seen[i]), int(at[-1] - at[i]), float(mean[i]), heads[:, i].tolist()) for i in best]))
            yield pd.DataFrame(out, columns=["instance_id", "block", "history_len", "recency_mass", "repeat_item_mass", "top_mass", "concentration", "expected_recency", "top"])

    return gathered(past).mapInPandas(run, _TRACE)


def attention_summary(traces: DataFrame) -> DataFrame:
    """Means per block."""
    return traces.groupBy("block").agg(F.count("*").alias("traces"), *[F.round(F.avg(c), 9).alias(f"mean_{c}") for c in ("history_len", "recency_mass", "repeat_item_mass", "top_mass", "concentration")])


# item texts as vectors -----------------------------------------------------------------
def text_vector(text: str, dim: int = 384) -> np.ndarray:
    """Hashed character trigrams with signs, at length one; zeros for no text."""
    out = np.zeros(dim, dtype=np.float32)
    padded = f"  {text.lower()} "
    for i in range(len(padded) - 2) if text else ():
        h = int.from_bytes(hashlib.blake2b(padded[i : i + 3].encode(), digest_size=8).digest(), "little")
        out[h % dim] += 1.0 if h >> 63 else -1.0
    n = np.linalg.norm(out)
    return out / n if n else out


def embed_texts(items: DataFrame, text: str, dim: int = 384) -> DataFrame:
    """``items`` with ``vec``."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(s: pd.Series) -> pd.Series:
        return s.fillna("").map(lambda t: text_vector(t, dim))

    return items.withColumn("vec", run(F.col(text)))


def embedding_key(items: DataFrame, text: str, dim: int = 384) -> str:
    """A digest of what the vectors would be made of; equal digests, equal vectors."""
    rows = items.select(F.sha2(F.concat_ws("\x1f", F.col("item_id").cast("string"), text), 256).alias("h"))
    total = rows.agg(F.count("*").alias("n"), F.sum(F.conv(F.substring("h", 1, 14), 16, 10).cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(re.sub(r"\s", "", f"trigram-1:{dim}:{total.n}:{total.s}").encode()).hexdigest()[:16]


def cached_embeddings(items: DataFrame, text: str, folder: str, dim: int = 384) -> DataFrame:
    """``item_id, vec`` of ``item_id, text``, stored under a digest of what they are made of and read from there the next time."""
    spark, path = items.sparkSession, f"{folder.rstrip('/')}/{embedding_key(items, text, dim)}"
    fs, done = hadoop_fs(spark, f"{path}/_SUCCESS")
    if not fs.exists(done):
        embed_texts(items, text, dim).select("item_id", "vec").write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def embedding_report(items: DataFrame) -> DataFrame:
    """One row: ``rows, dim, zero_rows, mean_norm``."""
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return items.select(F.size("vec").alias("d"), norm.alias("n")).agg(F.count("*").alias("rows"), F.max("d").alias("dim"), F.count_if(F.col("n") < 1e-12).alias("zero_rows"), F.round(F.avg("n"), 6).alias("mean_norm"))


def text_matrix(items: DataFrame, n_items: int, dim: int) -> np.ndarray:
    """Vectors of ``item_id, vec`` as the model's text table; for catalogues that fit a machine."""
    out = np.zeros((n_items, dim))
    for r in items.where(F.col("item_id") >= FIRST).select("item_id", "vec").toLocalIterator():
        out[r.item_id] = r.vec
    return out


def trace_points(instances: DataFrame, users: int = 50, per_user: int = 4, seed: int = 0) -> DataFrame:
    """Instances to look into: up to ``per_user`` of up to ``users`` users, in the order of a digest."""
    some = instances.select("user_id").distinct().orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "user_id")), "user_id").limit(users)
    kept = instances.join(F.broadcast(some), "user_id", "left_semi")
    w = Window.partitionBy("user_id").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "instance_id")), "instance_id")
    return kept.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_user).drop("__k")
