"""Event-triggered averages."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS, ordered
from .asof import distinct_times, with_neighbours
from .intervals import samples_in

TRACE = ("event_type", "event_id", "roi")


def epoch_traces(samples: DataFrame, events: DataFrame, window: tuple[float, float], dt: float, keys: Sequence[str] = KEYS, roi: str = "channel") -> DataFrame:
    """Each event's samples, per channel, interpolated on the grid window[0], window[0] + dt, ... around its time.

    Grid points outside of the channel's finite samples are null; channels with fewer than two give no rows. ``rel_idx`` is the grid's
    integer step, so that no later grouping rests on a float.
    """
    steps = int((window[1] - window[0]) / dt + 1e-9)
    source = samples.withColumnRenamed(roi, "roi") if roi != "roi" else samples
    clean = distinct_times(source, [*keys, "roi"])
    channels = clean.groupBy(*keys, "roi").agg(F.count("*").alias("__n")).where("__n >= 2").drop("__n")
    grid = events.join(channels, list(keys)).withColumn("rel_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(steps).cast("long"))))
    grid = grid.withColumn(
        "rel_time", F.round(F.lit(float(window[0])) + F.col("rel_idx") * F.lit(float(dt)), 9)
    ).withColumn("t", F.col("event_time") + F.col("rel_time"))
    near = with_neighbours(grid, clean, [*keys, "roi"])
    value = F.when(F.col("prev").isNull() | F.col("next").isNull(), None).otherwise(
        F.when(F.col("prev.t") == F.col("next.t"), F.col("prev.y")).otherwise(
            F.col("prev.y") + (F.col("next.y") - F.col("prev.y")) * (F.col("t") - F.col("prev.t")) / (F.col("next.t") - F.col("prev.t"))
        )
    )
    return near.withColumn("value", value).drop("prev", "next")


def number_events(events: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """event_id 0, 1, ... per recording and event type, in the order of time."""
    return events.withColumn("event_id", (F.row_number().over(ordered([*keys, "event_type"], "event_time")) - 1).cast("long"))


def subtract_baseline(
    traces: DataFrame, baseline: tuple[float, float] | None, keys: Sequence[str] = KEYS, clean: Column | None = None, least_clean: int = 1
) -> DataFrame:
    """Traces less the mean over the closed baseline window; null where it holds no value; unchanged without a window.

    With ``clean``, a flag of the grid rows, only flagged rows count, unless fewer than ``least_clean`` of them have a value.
    """
    if baseline is None:
        return traces
    w = Window.partitionBy(*keys, *TRACE)
    inside = F.when(F.col("rel_time").between(baseline[0] - 1e-12, baseline[1] + 1e-12), F.col("value"))
    mean = F.avg(inside).over(w)
    if clean is not None:
        good = F.when(clean, inside)
        mean = F.when(F.count(good).over(w) >= least_clean, F.avg(good).over(w)).otherwise(mean)
    return traces.withColumn("value", F.col("value") - mean)


def flag_outside_bouts(traces: DataFrame, bouts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Grid rows with ``clean``: whether their time is outside of every closed bout."""
    names = [*keys, *TRACE, "rel_idx"]
    inside = samples_in(traces.select(*names, "t"), bouts, keys, closed=True, how="left_semi").select(*names).distinct().withColumn("__in", F.lit(True))
    return traces.join(inside, names, "left").withColumn("clean", F.col("__in").isNull()).drop("__in")


def drop_events_in_bouts(events: DataFrame, bouts: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Events outside of every closed bout."""
    return samples_in(events, bouts, keys, closed=True, how="left_anti", t="event_time")


def paired_baseline(
    traces: DataFrame, samples: DataFrame, pairs: DataFrame, baseline: tuple[float, float], dt: float, keys: Sequence[str] = KEYS,
    roi: str = "channel"
) -> DataFrame:
    """Traces less the mean around another event paired with each (``pairs``: keys, event_type, event_id, event_time)."""
    other = epoch_traces(samples, pairs, baseline, dt, keys, roi)
    means = other.groupBy(*keys, *TRACE).agg(F.avg("value").alias("__b"))
    return traces.join(means, [*keys, *TRACE], "left").withColumn("value", F.col("value") - F.col("__b")).drop("__b")


def subject_means(traces: DataFrame, subject: str = "subject") -> DataFrame:
    """Mean per subject, condition, event type, ROI and time, pooled over its sessions."""
    return traces.groupBy(subject, "condition", "event_type", "roi", "rel_idx", "rel_time").agg(F.avg("value").alias("mean"))


def sem_or_zero(x: str) -> Column:
    """Standard error of the mean; 0 for a single value."""
    return F.when(F.count(x) > 1, F.stddev_samp(x) / F.sqrt(F.count(x))).otherwise(0.0)


def group_means(means: DataFrame) -> DataFrame:
    """Mean and standard error over subjects."""
    return means.groupBy("condition", "event_type", "roi", "rel_idx", "rel_time").agg(F.avg("mean").alias("mean"), sem_or_zero("mean").alias("sem"))


def select_traces(traces: DataFrame, **levels: str) -> DataFrame:
    """Traces of an event type, condition, task or ROI."""
    for name, value in levels.items():
        traces = traces.where(F.col(name) == value)
    return traces


def window_mean(traces: DataFrame, window: tuple[float, float], name: str = "window_mean", keys: Sequence[str] = KEYS) -> DataFrame:
    """Mean over a closed window of rel_time per event and ROI."""
    held = traces.where(F.col("rel_time").between(window[0] - 1e-12, window[1] + 1e-12))
    return held.groupBy(*keys, "condition", *TRACE).agg(F.avg("value").alias(name))


@dataclass(frozen=True)
class EtaAnalysis:
    """Events, traces, baseline and the two means, as one lazy plan over all recordings."""

    window: tuple[float, float] = (-2.0, 5.0)
    dt: float = 0.05
    baseline: tuple[float, float] | None = (-2.0, 0.0)
    condition_map: tuple[tuple[str, str], ...] = ()
    keys: Sequence[str] = KEYS

    def run(self, samples: DataFrame, events: DataFrame) -> dict[str, DataFrame]:
        """Tables events, subject and group. Events need the keys, event_type and event_time; a missing condition comes from
        the map (by 'subject,session,task', then by task) and is 'all' otherwise; that of a recording and event type is its first event's."""
        if missing := [c for c in (*self.keys, "event_type", "event_time") if c not in events.columns]:
            raise ValueError(f"events lack {missing}")
        named = events if "condition" in events.columns else events.withColumn("condition", F.lit(None).cast("string"))
        pairs = [F.lit(x) for pair in self.condition_map for x in pair]
        mapped = [F.try_element_at(F.create_map(*pairs), k) for k in (F.concat_ws(",", *self.keys), F.col(self.keys[-1]))] if pairs else []
        named = named.withColumn("condition", F.coalesce("condition", *mapped, F.lit("all")))
        first = F.first("condition").over(ordered([*self.keys, "event_type"], "event_time").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        traces = epoch_traces(samples, number_events(named.withColumn("condition", first), self.keys), self.window, self.dt, self.keys)
        traces = subtract_baseline(traces, self.baseline, self.keys)
        by_subject = subject_means(traces, self.keys[0])
        return {"events": traces, "subject": by_subject, "group": group_means(by_subject)}
