"""Windows over very long recordings: slices of time are walked by tasks of their own, from a state that is carried in.

A scan has two passes. Each slice of a recording is summed up first (its last value, its count, its sum); a window over these summaries,
a row per slice, gives what comes before each slice; and the rows of a slice are walked from there. So one recording of any length is as many
tasks as it has slices, and none holds more than a slice. Rows without a time are a slice before all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "__slice"


def sliced(rows: DataFrame, width: float, t: str = "t") -> DataFrame:
    """``rows`` with the number of their slice of ``width`` seconds."""
    return rows.withColumn(SLICE, F.floor(F.col(t) / F.lit(float(width))).cast("long"))


def _with_carried(rows: DataFrame, keys: Sequence[str], carried: DataFrame) -> DataFrame:
    """The rows beside what is carried into their slice; null keys are equal."""
    own = [*keys, SLICE]
    there = carried.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(own)], "__carried")
    same = F.lit(True)
    for i, c in enumerate(own):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{i}"))
    return rows.join(there, same).drop(*[f"__k{i}" for i in range(len(own))])


def last_known(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str, rank: Sequence[Column], backward: bool = False,
    itself: bool = True
) -> DataFrame:
    """``rows`` with ``out``, the last value that isn't null up to each row, the row's own included if ``itself``.

    ``order`` is that of the walk; ``rank`` are columns by which the rows with a value ascend in time, so that the last of a slice is
    their greatest, or with ``backward``, where the walk goes back in time, their least.
    """
    walk = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if itself else -1)
    pick = F.min if backward else F.max
    found = F.when(value.isNotNull(), F.struct(*[c.alias(f"r{i}") for i, c in enumerate(rank)], value.alias("v")))
    ends = rows.groupBy(*keys, SLICE).agg(pick(found).alias("__end"))
    number = F.col(SLICE).desc_nulls_last() if backward else F.col(SLICE).asc_nulls_first()
    before = Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*keys, SLICE, F.last("__end.v", True).over(before).alias("__carried"))
    return _with_carried(rows.withColumn("__own", F.last(value, True).over(walk)), keys, carried).withColumn(out, F.coalesce("__own", "__carried")).drop("__own", "__carried")


def running_sum(rows: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``, the sum of a whole number up to each row, its own included."""
    walk = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, SLICE).agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(*keys).orderBy(F.col(SLICE).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, SLICE, F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__carried"))
    return _with_carried(rows.withColumn("__own", F.sum(value).over(walk)), keys, carried).withColumn(out, (F.col("__own") + F.col("__carried")).cast("long")).drop("__own", "__carried")
