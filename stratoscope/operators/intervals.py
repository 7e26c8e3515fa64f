"""Joins of samples and intervals by a sweep over their times.

Starts, ends and samples are put under each other and walked once per recording: how many intervals are open, how long they have been open
and how many samples have passed are running sums, so an interval is a row at its start and one at its end, however long it is.
Pairs are formed only where they are the result, and then by places among the samples instead of by time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..model import KEYS, ordered

#: Samples of a block in which samples and intervals meet.
BLOCK = 4096
#: Order of marks at one time: ends before samples for half-open intervals, and after them for closed ones.
EARLY, SAMPLE, LATE = range(3)


def _marks(intervals: DataFrame, keys: Sequence[str], closed: bool, more: Sequence[str] = ()) -> DataFrame:
    """(keys, __t, __side, __step, more): +1 at each interval's start and -1 at its end; without those that end before they start, or lack a key."""
    sound = F.col("start_s") <= F.col("end_s")
    for k in keys:
        sound = sound & F.col(k).isNotNull()
    ends = F.array(
        F.struct(F.col("start_s").cast("double").alias("t"), F.lit(EARLY).alias("side"), F.lit(1).alias("step")),
        F.struct(F.col("end_s").cast("double").alias("t"), F.lit(LATE if closed else EARLY).alias("side"), F.lit(-1).alias("step")),
    )
    return intervals.where(sound).select(*keys, *more, F.explode(ends).alias("__m")).select(
        *keys, F.col("__m.t").alias("__t"), F.col("__m.side").alias("__side"), F.col("__m.step").alias("__step"), *more
    )


def _upto(keys: Sequence[str]) -> WindowSpec:
    return ordered(keys, "__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def samples_in(
    samples: DataFrame, intervals: DataFrame, keys: Sequence[str] = KEYS, closed: bool = False, how: str = "inner", keep: Sequence[str] = (), t: str = "t",
    block: int = BLOCK
) -> DataFrame:
    """Samples joined to the intervals that hold them; half-open [start, end), or closed. how: inner, left_semi or left_anti.

    For left_semi and left_anti the number of open intervals decides. For inner, an interval becomes a range of places among its
    recording's samples and meets them block by block of ``block`` samples: it is written once, and once more for each whole block of its own
    samples, whatever its length in time. Samples without a time or a key are in no interval.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in samples.columns])
    own = samples.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(SAMPLE).alias("__side"), row.alias("__row"))
    if how != "inner":
        both = own.unionByName(_marks(intervals, keys, closed), allowMissingColumns=True)
        inside = F.coalesce(F.sum("__step").over(_upto(keys)), F.lit(0)) > 0
        found = both.withColumn("__in", inside).where(F.col("__row").isNotNull())
        return found.where(F.col("__in") if how == "left_semi" else ~F.col("__in")).select("__row.*")
    placed = own.where(F.col("__t").isNotNull()).withColumn("__i", (F.row_number().over(ordered(keys, "__t")) - 1).cast("long"))
    ranges = places(intervals, samples, keys, closed, keep, t).where("__hi > __lo")
    spread = ranges.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / block), F.floor((F.col("__hi") - 1) / block))))
    met = placed.withColumn("__b", F.floor(F.col("__i") / block)).join(spread, [*keys, "__b"]).where("__lo <= __i AND __i < __hi")
    return met.select("__row.*", *[f"__keep.{c}" for c in keep])


def places(
    intervals: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS, closed: bool = False, keep: Sequence[str] = (), t: str = "t"
) -> DataFrame:
    """(keys, __keep, __lo, __hi) per interval: it holds the samples from place __lo to before __hi in the order of time."""
    own = samples.where(F.col(t).isNotNull()).select(*keys, F.col(t).cast("double").alias("__t"), F.lit(SAMPLE).alias("__side"), F.lit(1).alias("__one"))
    held = intervals.withColumn("__keep", F.struct(F.monotonically_increasing_id().alias("__id"), *[F.col(c) for c in keep]))
    both = own.unionByName(_marks(held, keys, closed, ["__keep"]), allowMissingColumns=True)
    passed = both.withColumn("__n", F.coalesce(F.sum("__one").over(_upto(keys)), F.lit(0))).where(F.col("__one").isNull())
    at = lambda step: F.max(F.when(F.col("__step") == step, F.col("__n")))
    return passed.groupBy(*keys, F.col("__keep.__id").alias("__id")).agg(F.first("__keep").alias("__keep"), at(1).alias("__lo"), at(-1).alias("__hi")).drop("__id")


#: Order of marks at one time, for overlaps: an interval's end, epochs, a point interval's start, epochs that are points, an interval's start.
ENDS, EPOCHS, POINT, POINTS, STARTS = range(5)


def epoch_overlap(intervals: DataFrame, epochs: DataFrame, keys: Sequence[str] = KEYS, interval_id: str = "interval_id") -> DataFrame:
    """Per interval [a0, a1): the epochs that overlap it, the seconds shared, whether one is open at its start, the first that starts inside.

    Seconds shared are summed over epochs; a first start counts if it is strictly inside. All are differences of running sums between
    the interval's ends: of epochs started and ended, and of the time that epochs have been open. No pairs are formed.
    """
    mark = lambda t, order, **more: F.struct(F.col(t).cast("double").alias("t"), order.alias("side"), *[F.lit(v).alias(k) for k, v in more.items()])
    point = F.col("start_s") == F.col("end_s")
    kind = F.when(point, POINTS).otherwise(EPOCHS)
    told = epochs.where("start_s <= end_s").select(*keys, F.explode(F.array(mark("start_s", kind, up=1, down=0, at=0), mark("end_s", kind, up=0, down=1, at=0))).alias("m"))
    first, last = F.when(point, POINT).otherwise(STARTS), F.lit(ENDS)
    asked = intervals.where("start_s <= end_s").select(
        *keys, interval_id, F.explode(F.array(mark("start_s", first, up=0, down=0, at=1), mark("end_s", last, up=0, down=0, at=2))).alias("m")
    )
    both = told.unionByName(asked, allowMissingColumns=True).select(*keys, interval_id, "m.*")
    w = ordered(keys, "t", "side")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("started", F.sum("up").over(upto)).withColumn("ended", F.sum("down").over(upto))
    since = (F.lag(F.col("started") - F.col("ended")).over(w)) * (F.col("t") - F.lag("t").over(w))
    both = both.withColumn("__since", F.coalesce(since, F.lit(0.0))).withColumn("open_s", F.sum("__since").over(upto))
    later = ordered(keys, F.desc("t"), F.desc("side")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("next_s", F.last(F.when(F.col("up") == 1, F.col("t")), True).over(later)).where("at > 0")
    at = lambda k, c: F.max(F.when(F.col("at") == k, F.col(c)))
    found = both.groupBy(*keys, interval_id).agg(
        (at(2, "started") - at(1, "ended")).alias("n_overlapping"), (at(2, "open_s") - at(1, "open_s")).alias("overlap_s"),
        (at(1, "started") > at(1, "ended")).alias("open_at_start"), F.when(at(1, "next_s") < at(2, "t"), at(1, "next_s")).alias("first_start_s")
    )
    return intervals.join(found, [*keys, interval_id], "left").select(
        *intervals.columns,
        F.coalesce("n_overlapping", F.lit(0)).cast("long").alias("n_overlapping"),
        F.coalesce(F.greatest("overlap_s", F.lit(0.0)), F.lit(0.0)).alias("overlap_s"),
        F.coalesce("open_at_start", F.lit(False)).alias("open_at_start"),
        "first_start_s",
    )


def epoch_latency(intervals: DataFrame, epochs: DataFrame, keys: Sequence[str] = KEYS, interval_id: str = "interval_id") -> DataFrame:
    """epoch_overlap and latency_s: 0 if an epoch is open at the start, else the seconds to the first start, else null."""
    found = epoch_overlap(intervals, epochs, keys, interval_id)
    return found.withColumn("latency_s", F.when(F.col("open_at_start"), 0.0).otherwise(F.col("first_start_s") - F.col("start_s")))
