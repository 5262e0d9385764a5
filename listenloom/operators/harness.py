"""One protocol for every scorer: instances in, ranks out, metrics by slice."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame

from listenloom.operators.evaluation import KS, knn_ranks, popularity_ranks, repeat_ranks, sliced_metrics


@runtime_checkable
class Scorer(Protocol):
    """Whatever ranks the target of each instance among all ``n_items`` items, 0 being the best place."""

    name: str

    def ranks(self, instances: DataFrame, seqs: DataFrame, n_items: int) -> DataFrame:
        """``instances`` with ``rank``."""


@dataclass
class Popularity:
    counts: DataFrame
    optimistic: bool = False
    name: str = "popularity"

    def ranks(self, instances: DataFrame, seqs: DataFrame, n_items: int) -> DataFrame:
        return popularity_ranks(instances, self.counts, n_items, self.optimistic)


@dataclass
class Repeat:
    counts: DataFrame
    optimistic: bool = False
    name: str = "repeat"

    def ranks(self, instances: DataFrame, seqs: DataFrame, n_items: int) -> DataFrame:
        return repeat_ranks(instances, seqs, self.counts, n_items, self.optimistic)


@dataclass
class ItemKnn:
    similar: DataFrame
    optimistic: bool = False
    name: str = "itemknn"

    def ranks(self, instances: DataFrame, seqs: DataFrame, n_items: int) -> DataFrame:
        return knn_ranks(instances, seqs, self.similar, n_items, self.optimistic)


def evaluate(scorers: list[Scorer], instances: DataFrame, seqs: DataFrame, n_items: int, ks: tuple[int, ...] = KS) -> DataFrame:
    """Metrics of every scorer by slice, one below the other."""
    out = None
    for s in scorers:
        if not isinstance(s, Scorer):
            raise TypeError(f"{type(s).__name__} has no name or no ranks")
        part = sliced_metrics(s.ranks(instances, seqs, n_items), s.name, ks)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no scorer given")
    return out
