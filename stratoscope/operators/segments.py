"""Runs of a mask and epochs: gaps and islands per recording."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, before_and_now, ordered
from .quantiles import exact_median
from .slices import SLICE, last_known, running_sum, sliced


def median_step(samples: DataFrame, keys: Sequence[str] = KEYS, slice_s: float | None = None) -> DataFrame:
    """(keys, step): the median difference of consecutive times; 0 for a single sample."""
    if slice_s is not None:
        order = [F.col("t"), F.col("sample")]
        before = last_known(sliced(samples, slice_s), keys, order, F.struct("t"), "__prev", order, itself=False)
        return exact_median(before, keys, F.col("t") - F.col("__prev.t"), "step").withColumn("step", F.coalesce("step", F.lit(0.0)))
    steps = samples.withColumn("__d", F.col("t") - F.lag("t").over(ordered(keys, "t", "sample")))
    return exact_median(steps, keys, "__d", "step").withColumn("step", F.coalesce("step", F.lit(0.0)))


def masked_samples(
    samples: DataFrame, mask: Column, keys: Sequence[str] = KEYS, max_gap_s: float | None = None, slice_s: float | None = None
) -> DataFrame:
    """The samples under the mask with their position ``idx`` and run number 0, 1, ...; a run ends where the mask does or, if given,
    where consecutive samples are more than ``max_gap_s`` apart. With ``slice_s``, a recording is walked in slices of so many seconds."""
    if slice_s is not None:
        return _masked_in_slices(samples, mask, keys, max_gap_s, slice_s)
    w = ordered(keys, "t", "sample")
    placed = samples.withColumn("idx", (F.row_number().over(w) - 1).cast("long")).withColumn("__gap", F.col("t") - F.lag("t").over(w))
    kept = placed.where(F.coalesce(mask, F.lit(False)))
    starts = (F.col("idx") - F.lag("idx", 1, -2).over(ordered(keys, "idx"))) > 1
    if max_gap_s is not None:
        starts = starts | (F.coalesce("__gap", F.lit(0.0)) > max_gap_s)
    kept = kept.withColumn("__new", starts.cast("int"))
    return kept.withColumn("run", (F.sum("__new").over(before_and_now(keys, "idx")) - 1).cast("long")).drop("__new", "__gap")


def _masked_in_slices(samples: DataFrame, mask: Column, keys: Sequence[str], max_gap_s: float | None, slice_s: float) -> DataFrame:
    """Positions, the sample and the masked sample before each, and run numbers, each by a scan over slices."""
    order = [F.col("t"), F.col("sample")]
    placed = running_sum(sliced(samples, slice_s), keys, order, F.lit(1), "idx").withColumn("idx", F.col("idx") - 1)
    placed = last_known(placed, keys, order, F.struct("t"), "__prev", order, itself=False)
    kept = placed.where(F.coalesce(mask, F.lit(False)))
    kept = last_known(kept, keys, [F.col("idx")], F.col("idx"), "__last", [F.col("idx")], itself=False)
    starts = (F.col("idx") - F.coalesce("__last", F.lit(-2))) > 1
    if max_gap_s is not None:
        starts = starts | (F.coalesce(F.col("t") - F.col("__prev.t"), F.lit(0.0)) > max_gap_s)
    runs = running_sum(kept.withColumn("__new", starts.cast("int")), keys, [F.col("idx")], F.col("__new"), "run")
    return runs.withColumn("run", F.col("run") - 1).drop("__new", "__prev", "__last", SLICE)


def mask_runs(
    samples: DataFrame, mask: Column, keys: Sequence[str] = KEYS, max_gap_s: float | None = None, slice_s: float | None = None
) -> DataFrame:
    """(keys, run, start_idx, end_idx, start_s, end_s), ends inclusive."""
    return masked_samples(samples, mask, keys, max_gap_s, slice_s).groupBy(*keys, "run").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.min("t").alias("start_s"), F.max("t").alias("end_s")
    )


def merge_runs(found: DataFrame, keys: Sequence[str] = KEYS, gap_s: float | None = None, gap_samples: int | None = None) -> DataFrame:
    """Joins runs whose gap to the one before is at most so many seconds, or samples between them."""
    w = ordered(keys, "start_idx")
    gap = (F.col("start_s") - F.lag("end_s").over(w)) <= gap_s if gap_s is not None else (
        F.col("start_idx") - F.lag("end_idx").over(w) - 1
    ) <= (gap_samples or 0)
    flagged = found.withColumn("__new", F.when(F.coalesce(gap, F.lit(False)), 0).otherwise(1))
    return (
        flagged.withColumn("run", (F.sum("__new").over(before_and_now(keys, "start_idx")) - 1).cast("long"))
        .groupBy(*keys, "run")
        .agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"))
    )


def long_runs(found: DataFrame, least: int) -> DataFrame:
    """Runs of at least so many samples."""
    return found.where(F.col("end_idx") - F.col("start_idx") + 1 >= least)


def detect_epochs(
    samples: DataFrame, mask: Column, event_type: str = "epoch", min_duration_s: float = 0.0, merge_gap_s: float = 0.0, max_sample_gap_s: float | None = None, keys: Sequence[str] = KEYS,
    slice_s: float | None = None
) -> DataFrame:
    """Epochs of all recordings: runs of the mask, split at sample gaps, joined over short pauses, without short ones.

    duration_s holds one median step more than end_s - start_s; so does the test of the least duration, but not the pause.
    With ``slice_s``, recordings are walked in slices of so many seconds, each a task's work; the epochs are the same.
    """
    runs = mask_runs(samples, mask, keys, max_sample_gap_s, slice_s)
    found = merge_runs(runs, keys, gap_s=merge_gap_s) if merge_gap_s > 0 else runs
    timed = found.join(median_step(samples, keys, slice_s), list(keys)).withColumn("duration_s", F.col("end_s") - F.col("start_s") + F.col("step"))
    kept = timed.where(F.col("duration_s") >= min_duration_s)
    return kept.select(
        *keys, (
            F.row_number().over(ordered(keys, "start_idx")) - 1
        ).cast("long").alias("epoch_id"), "start_s", "end_s", "duration_s", F.lit(event_type).alias("event_type"), "start_idx", "end_idx"
    )


def epochs_around(
    events: DataFrame, pre: float, post: float, samples: DataFrame | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Epochs [event_time + pre, event_time + post]; with ``samples``, also the positions of the first and last sample inside."""
    made = events.withColumn("epoch_id", (F.row_number().over(ordered(keys, "event_time", "event_type")) - 1).cast("long"))
    made = made.select(
        *keys, "epoch_id", (F.col("event_time") + pre).alias("start_s"), (F.col("event_time") + post).alias("end_s"),
        F.lit(float(post - pre)).alias("duration_s"), "event_type"
    )
    if samples is None:
        return made
    return window_bounds(made, samples, keys)


def window_bounds(epochs: DataFrame, samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Epochs with start_idx, the position of the first sample at or after the start, and end_idx, of the last at or before the end."""
    from .intervals import places

    found = places(epochs, samples, keys, True, ["epoch_id"]).where("__hi > __lo")
    bounds = found.select(*keys, "__keep.epoch_id", F.col("__lo").alias("start_idx"), (F.col("__hi") - 1).alias("end_idx"))
    return epochs.join(bounds, [*keys, "epoch_id"], "left")


def break_at_gaps(samples: DataFrame, threshold_s: float, keys: Sequence[str] = KEYS) -> DataFrame:
    """One row with null time and value before each sample that is more than ``threshold_s`` after the last one; ``part`` orders them."""
    gap = F.col("t") - F.lag("t").over(ordered(keys, "t", "sample"))
    rows = samples.withColumn("__cut", F.coalesce(gap > threshold_s, F.lit(False)))
    full, empty = F.struct(F.lit(1).alias("part"), F.col("t").alias("t"), F.col("y").alias("y")), F.struct(
        F.lit(0).alias("part"), F.lit(None).cast("double").alias("t"), F.lit(None).cast("double").alias("y")
    )
    rows = rows.withColumn("__r", F.explode(F.when(F.col("__cut"), F.array(empty, full)).otherwise(F.array(full))))
    return rows.select(*keys, "sample", F.col("__r.part").alias("part"), F.col("__r.t").alias("t"), F.col("__r.y").alias("y"))
