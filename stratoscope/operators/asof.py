"""As-of joins: nearest alignment, previous-sample hold, linear remapping, gap filling.

Both sides are put under each other and walked once forwards and once backwards per recording, so an as-of join costs one shuffle by
recording and two sorts, whatever the number of rows; nothing is compared in pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, before_and_now, everything, finite
from .slices import last_known, sliced


def with_neighbours(
    reference: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS, values: Sequence[str] = ("y",), order: str = "sample",
    exact_next: bool = True, slice_s: float | None = None
) -> DataFrame:
    """``reference`` with structs prev and next of (t, values): the last source row at or before t, and the first at or after t.

    Of source rows with equal times, prev is the last and next the first by ``order``. Rows without a time are left out on both sides.
    With ``slice_s``, recordings are walked in slices of so many seconds, each with the neighbours carried in from the others, so that one very
    long recording is many tasks; the rows are the same.
    """
    held = F.struct(*[F.col(k) for k in reference.columns])
    ref = reference.where(F.col("t").isNotNull()).select(
        *keys, F.col("t").alias("__t"), F.lit(1).alias("__side"), F.lit(0).cast("long").alias("__o"), held.alias("__ref")
    )
    got = source.where(F.col("t").isNotNull()).select(
        *keys, F.col("t").alias("__t"), F.lit(0).alias("__side"), F.col(order).cast("long").alias("__o"), F.struct("t", *values).alias("__src")
    )
    both = ref.unionByName(got, allowMissingColumns=True)
    forward = before_and_now(keys, "__t", "__side", "__o")
    backward = before_and_now(keys, F.desc("__t"), F.asc("__side") if exact_next else F.desc("__side"), F.desc("__o"))
    if slice_s is not None:
        by, rank = F.col("__src"), [F.col("__t"), F.col("__o")]
        both = last_known(sliced(both, slice_s, "__t"), keys, [F.col("__t"), F.col("__side"), F.col("__o")], by, "prev", rank)
        turned = [F.desc("__t"), F.asc("__side") if exact_next else F.desc("__side"), F.desc("__o")]
        found = last_known(both, keys, turned, by, "next", rank, backward=True)
        return found.where("__side = 1").select("__ref.*", "prev", "next")
    found = both.withColumn("prev", F.last("__src", True).over(forward)).withColumn("next", F.last("__src", True).over(backward))
    return found.where("__side = 1").select("__ref.*", "prev", "next")


def align_nearest(
    reference: DataFrame, source: DataFrame, tolerance: float = 0.25, keys: Sequence[str] = KEYS, values: Sequence[str] = ("y",),
    order: str = "sample", prefix: str = "", slice_s: float | None = None
) -> DataFrame:
    """All reference rows with the values of the nearest source row within ``tolerance`` (inclusive); of equal distances the earlier row."""
    near = with_neighbours(reference, source, keys, values, order, slice_s=slice_s)
    back, ahead = F.col("t") - F.col("prev.t"), F.col("next.t") - F.col("t")
    use_back = back.isNotNull() & (ahead.isNull() | (back <= ahead))
    chosen = F.when(use_back, F.col("prev")).otherwise(F.col("next"))
    hit = F.when(F.abs(chosen["t"] - F.col("t")) <= tolerance, chosen)
    near = near.withColumn("__hit", hit)
    return near.select(
        *reference.columns, F.col("__hit.t").alias(f"{prefix}source_t"),
        *[F.col(f"__hit.{v}").alias(f"{prefix}{v}" if prefix else (v if v not in reference.columns else f"source_{v}")) for v in values]
    )


def align_sources(samples: DataFrame, reference: str, tolerance: float = 0.25, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every recording's sources on the reference source's rows, in one job over all recordings; a source's values become a column of its name.

    The signals of a source are cut to their shortest common length first.
    """
    cut = truncate_common(samples, keys)
    names = [r["source"] for r in cut.select("source").distinct().orderBy("source").collect()]  # a handful of source names
    out = cut.where(F.col("source") == reference).select(*keys, "sample", "t", F.col("y").alias(reference))
    for name in names:
        if name != reference:
            got = cut.where(F.col("source") == name).select(*keys, "sample", "t", F.col("y").alias(name))
            out = align_nearest(out, got, tolerance, keys, (name,)).drop("source_t")
    return out


def truncate_common(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Cuts the channels of each recording's source to the shortest of them."""
    sizes = samples.groupBy(*keys, "source", "channel").agg(F.count("*").alias("__n"))
    shortest = sizes.groupBy(*keys, "source").agg(F.min("__n").alias("__n"))
    return samples.join(shortest, [*keys, "source"]).where(F.col("sample") < F.col("__n")).drop("__n")


def distinct_times(source: DataFrame, keys: Sequence[str] = KEYS, order: str = "sample") -> DataFrame:
    """Finite source rows, of equal times the first by ``order``."""
    return source.where(finite("t").isNotNull() & finite("y").isNotNull()).groupBy(*keys, "t").agg(F.min_by("y", order).alias("y"), F.min(order).alias(order))


def hold_previous(reference: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS, order: str = "sample", out: str = "y", slice_s: float | None = None) -> DataFrame:
    """The last source value at or before each reference time; before the first, the first; without any source value, 0."""
    near = with_neighbours(reference, distinct_times(source, keys, order), keys, ("y",), order, slice_s=slice_s)
    return near.select(*reference.columns, F.coalesce("prev.y", "next.y", F.lit(0.0)).alias(out))


def _blend(t: Column) -> Column:
    inside = F.when(F.col("next.t") == F.col("prev.t"), F.col("prev.y")).otherwise(
        F.col("prev.y") + (F.col("next.y") - F.col("prev.y")) * (t - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t"))
    )
    return inside


def remap_linear(
    reference: DataFrame, source: DataFrame, keys: Sequence[str] = KEYS, order: str = "sample", gap_s: float | None = None,
    fill: float | None = None, clamp: bool = True, out: str = "y", slice_s: float | None = None
) -> DataFrame:
    """Linear interpolation at the reference times, held flat outside of the source (or null there, without ``clamp``); 0 without any source value.

    With ``gap_s``, the value is ``fill`` where the nearest source sample is further away than that.
    """
    near = with_neighbours(reference, distinct_times(source, keys, order), keys, ("y",), order, slice_s=slice_s)
    t = F.col("t")
    value = F.coalesce(_blend(t), *([F.col("prev.y"), F.col("next.y"), F.lit(0.0)] if clamp else []))
    if gap_s is not None:
        distance = F.least(t - F.col("prev.t"), F.col("next.t") - t)
        value = F.when(distance > gap_s, F.lit(fill).cast("double")).otherwise(value)
    return near.select(*reference.columns, value.alias(out))


def sparse_trace(aligned: DataFrame, gap_s: float, fill: float | None = 0.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """A trace with nulls on its own times: interpolated, and ``fill`` further than ``gap_s`` from any value; ``fill`` where all is null."""
    found = remap_linear(aligned.drop("y"), aligned, keys, gap_s=gap_s, fill=fill)
    some = F.count("y").over(everything(keys))
    counted = aligned.withColumn("__some", some).select(*keys, "sample", "__some")
    return found.join(counted, [*keys, "sample"]).withColumn("y", F.when(F.col("__some") == 0, F.lit(fill).cast("double")).otherwise(F.col("y"))).drop("__some")


def interpolate_own(samples: DataFrame, at: str = "t", keys: Sequence[str] = KEYS) -> DataFrame:
    """``samples`` with ``filled``: its own gaps interpolated over the column ``at`` (time or position), flat at the ends."""
    point = F.when(F.col("y").isNotNull(), F.struct(F.col(at).cast("double").alias("t"), "y"))
    rows = samples.withColumn("__p", point)
    rows = rows.withColumn("prev", F.last("__p", True).over(before_and_now(keys, at))).withColumn(
        "next", F.last("__p", True).over(before_and_now(keys, F.desc(at)))
    )
    return rows.withColumn("filled", F.coalesce("y", _blend(F.col(at).cast("double")), "prev.y", "next.y")).drop("__p", "prev", "next")


def choose_time(candidates: DataFrame, signals: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Per recording and source, the time vector of the lowest rank that isn't over twice as long as the source's longest signal.

    candidates: (keys, source, rank, name, n); signals: (keys, source, n).
    """
    longest = signals.groupBy(*keys, "source").agg(F.max("n").alias("__longest"))
    fit = candidates.join(longest, [*keys, "source"]).where(F.col("n") <= 2 * F.col("__longest"))
    return fit.groupBy(*keys, "source").agg(F.min_by("name", F.struct("rank", "name")).alias("time_column"))


def zeroed(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Times less the recording's first."""
    first = F.first("t").over(Window.partitionBy(*keys).orderBy("sample").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return samples.withColumn("t", F.col("t") - first)
