"""Exact quantiles that spill: values are counted first, and a running sum finds the ranks, so no task holds a key's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str | Column, at: dict[str, float]) -> DataFrame:
    """(keys, one column per name in ``at``): linear quantiles of the non-null values; keys without any have nulls.

    A quantile q of n values lies between the values of rank floor(q * (n - 1)) and the next. Equal values are summed up map-side;
    then a sorted running sum per key, which Spark spills, tells which value holds a rank.
    """
    v = F.col(value) if isinstance(value, str) else value
    counted = df.select(*keys, v.cast("double").alias("__v")).groupBy(*keys, "__v").agg(F.count("__v").alias("__n"))
    w = Window.partitionBy(*keys).orderBy("__v")
    ranked = counted.withColumn("__upto", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ranked = ranked.withColumn("__all", F.sum("__n").over(Window.partitionBy(*keys)))
    made = []
    for q in at.values():
        place = F.lit(float(q)) * (F.col("__all") - 1)
        low, high = F.floor(place), F.ceil(place)
        holds = lambda r: (F.col("__upto") > r) & (F.col("__upto") - F.col("__n") <= r)
        made.append((F.max(F.when(holds(low), F.col("__v"))), F.max(F.when(holds(high), F.col("__v"))), F.max(place - low)))
    flat = [x.alias(f"__{i}_{j}") for i, parts in enumerate(made) for j, x in enumerate(parts)]
    found = ranked.groupBy(*keys).agg(*flat)
    between = [(F.col(f"__{i}_0") * (1 - F.col(f"__{i}_2")) + F.col(f"__{i}_1") * F.col(f"__{i}_2")).alias(name) for i, name in enumerate(at)]
    return found.select(*keys, *between)


def exact_median(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "median") -> DataFrame:
    return exact_quantiles(df, keys, value, {name: 0.5})
