"""Pupil traces: peaks, smoothing, dilations and per-subject baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS, ordered
from .asof import align_nearest, interpolate_own
from .intervals import samples_in
from .locomotion import bout_events, quiescent_runs
from .peaks import prominence_events
from .preproc import fit_polynomials, smooth_median
from .quantiles import exact_median

def smooth_pupil(samples: DataFrame, median_size: int = 5, window: int = 11, order: int = 3, series: Sequence[str] = KEYS) -> DataFrame:
    """``smoothed``: gaps interpolated in time, median, Savitzky-Golay, gaps put back."""
    filled = interpolate_own(samples, "t", series)
    smooth = fit_polynomials(smooth_median(filled, median_size, series, "filled"), window, order, series, "filled")
    return smooth.withColumn("smoothed", F.when(F.col("y").isNotNull(), F.col("filled"))).drop("filled")


def dilation_events(samples: DataFrame, prominence: float, min_separation_s: float, series: Sequence[str] = KEYS) -> DataFrame:
    """Peaks of the smoothed trace."""
    return prominence_events(samples.withColumn("y", F.col("smoothed")), prominence, min_separation_s, series)


def quiescent_samples(
    pupil: DataFrame, treadmill: DataFrame, least_speed: float = 2.0, tolerance: float = 0.25, min_bout_s: float = 1.0, merge_gap_s: float = 0.5,
    min_quiet_s: float = 0.0, keys: Sequence[str] = KEYS
) -> tuple[DataFrame, DataFrame]:
    """(samples of the pupil on the treadmill's clock while it is still, the quiet stretches)."""
    own = treadmill.where(F.col("y").isNotNull())
    aligned = align_nearest(own, pupil.select(*keys, "sample", "t", F.col("y").alias("pupil")), tolerance, keys, ("pupil",))
    bouts = bout_events(own, least_speed, "forward", min_bout_s, merge_gap_s, keys=keys)
    quiet = quiescent_runs(own, bouts, min_quiet_s, keys).withColumn("quiet_id", F.row_number().over(ordered(keys, "start_idx")))
    inside = samples_in(aligned.where(F.col("pupil").isNotNull()), quiet, keys, closed=True, keep=["quiet_id"])
    return inside, quiet


def session_baselines(inside: DataFrame, quiet: DataFrame, baseline_session: str, least_samples: int = 100, least_epochs: int = 3) -> DataFrame:
    """(subject, baseline_pupil, n_samples, n_quiescent_epochs_used, few): the median over quiet samples of the baseline session."""
    used = inside.where(F.col("session") == baseline_session)
    made = exact_median(used, ["subject"], "pupil", "baseline_pupil").join(used.groupBy("subject").agg(F.count("*").alias("n_samples")), "subject")
    epochs = quiet.where(F.col("session") == baseline_session).groupBy("subject").agg(F.count("*").alias("n_quiescent_epochs_used"))
    return made.join(epochs, "subject").withColumn("few", (F.col("n_samples") < least_samples) | (F.col("n_quiescent_epochs_used") < least_epochs))


def lacking_session(recordings: DataFrame, session: str) -> DataFrame:
    """Subjects without the session."""
    return recordings.select("subject").distinct().join(recordings.where(F.col("session") == session).select("subject"), "subject", "left_anti")


def require_session(recordings: DataFrame, session: str) -> None:
    """Fails, naming the first twenty subjects that lack the session."""
    if found := [r["subject"] for r in lacking_session(recordings, session).orderBy("subject").limit(20).collect()]:
        raise ValueError(f"no session {session} for {found}")


def normalise_pupil(pupil: DataFrame, baselines: DataFrame) -> DataFrame:
    """pupil_norm: the raw value over its subject's baseline; subjects without a positive baseline are left out."""
    good = baselines.where(F.col("baseline_pupil") > 0).select("subject", "baseline_pupil")
    return pupil.join(good, "subject").select(
        "subject", "session", "task", F.col("t").alias("time_elapsed_s"), F.col("y").alias("pupil_raw"),
        (F.col("y") / F.col("baseline_pupil")).alias("pupil_norm")
    )
