"""Dealing rows to parts that follow the order of their ids, without sampling the rows themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOWEST = -(1 << 63)


def parts_by_id(df: DataFrame, doc_id: str, parts: int, ties: str | None = None) -> tuple[DataFrame, int]:
    """``df`` with ``key`` (the id as long, null lowest), ``tie`` and ``part``, and the number of parts: they hold about as
    many ids each and ascend with (key, tie).

    Bounds come from quantiles of the ids alone; ids as doubles stay in order. They are broadcast, eight bytes a part, and
    searched in Arrow batches of the keys, so the plan is of one size for any number of parts. tie is 0; where some id is that
    of several quantiles and ``ties`` names a column, it is a hash of that column for such ids, which are spread over parts of
    their own by ranges of it.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(LOWEST))
    found = df.select(key.cast("double").alias("x")).approxQuantile("x", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    df = df.withColumn("key", key)
    if not found:
        return df.withColumns({"tie": F.lit(0).cast("long"), "part": F.lit(0)}), 1
    bounds, times = np.unique(np.array(found), return_counts=True)
    # of each bound: the parts of its id alone, where it is the bound of several quantiles, before the part of what follows
    own = np.where((times > 1) & (ties is not None), times, 0)
    first = np.r_[0, 1 + np.arange(len(bounds)) + np.cumsum(np.r_[0, own[:-1]])]
    shared = df.sparkSession.sparkContext.broadcast((bounds, own, first))

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        bounds, own, first = shared.value
        for key, tie in batches:
            x = key.to_numpy().astype(np.float64)
            at = np.searchsorted(bounds, x, side="right")  # 0: below all bounds
            low = np.maximum(at - 1, 0)
            spare = np.where(at > 0, own[low], 0)
            # ranges of the tie's upper half, so that parts ascend with it
            range_of = ((tie.to_numpy() >> 32) + (1 << 31)) * np.maximum(spare, 1) >> 32
            yield pd.Series(first[at] + np.where((spare > 0) & (bounds[low] == x), range_of, spare)).astype("int32")

    hot = bounds[own > 0]
    tie = F.lit(0).cast("long")
    if len(hot):
        hot_ids = df.sparkSession.sparkContext.broadcast(hot)

        @F.pandas_udf("boolean")
        def is_hot(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for key in batches:
                yield pd.Series(np.isin(key.to_numpy().astype(np.float64), hot_ids.value))

        tie = F.when(is_hot("key"), F.xxhash64(ties)).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("tie", tie)
    return df.withColumn("part", place("key", "tie")), int(len(bounds) + 1 + own.sum())


def dealt_by(df: DataFrame, parts: int, part: str = "part") -> DataFrame:
    """``df`` in ``parts`` partitions, each holding the part of its number: a hash of dense numbers would leave a third of
    the partitions empty and give others several parts."""
    return df.repartitionById(max(1, parts), F.col(part).cast("int"))


def parts_for(df: DataFrame) -> int:
    """As many parts as the table's scan has partitions."""
    return max(1, df.rdd.getNumPartitions())
