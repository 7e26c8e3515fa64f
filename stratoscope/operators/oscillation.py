"""Band-pass filtering, envelopes, bursts and oscillatory episodes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import analytic, butter_bandpass, settle_samples, zero_phase
from ..model import KEYS, ordered
from ..shipping import ship, staged
from .events import onsets_and_offsets
from .fourier import with_hilbert
from .quantiles import exact_median
from .segments import detect_epochs, median_step
from .spectral import morlet_power


def bandpass(
    samples: DataFrame, fs: float, band: tuple[float, float], order: int = 4, chunk: int | None = 1 << 16, envelope: bool = True,
    series: Sequence[str] = KEYS
) -> DataFrame:
    """(series, sample, t, filtered, envelope, phase): zero-phase Butterworth band-pass; samples numbered 0, 1, ... without gaps or nulls.

    With ``chunk``, time is cut into chunks with a halo in which the filter forgets its start to 1e-12, so that one long series is many
    tasks; only its first and last chunk use the odd extension of the ends. The envelope and phase are those of the whole series: a series
    of one chunk is transformed where it is filtered, a longer one by ``with_hilbert``, whose tasks hold no series either; then what was
    filtered is staged. Neither depends on the chunk but for rounding. With ``chunk`` None a series is one group. Series too short to
    filter give no rows; without ``envelope``, envelope and phase are null.
    """
    ship(samples.sparkSession)
    sos = butter_bandpass(order, band[0], band[1], fs)
    least = 3 * (2 * len(sos) + 1) + 1
    halo = max(settle_samples(sos), least)
    counted = samples.withColumn("__n", F.count("*").over(Window.partitionBy(*series))).where(F.col("__n") >= least)
    if chunk:
        last = F.floor((F.col("__n") - 1) / chunk)
        lo, hi = F.greatest(F.lit(0), F.floor((F.col("sample") - halo) / chunk)), F.least(last, F.floor((F.col("sample") + halo) / chunk))
        cut = counted.withColumn("__chunk", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    else:
        cut = counted.withColumn("__chunk", F.lit(0).cast("long"))
    names = list(series)
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in names)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample")
        y = zero_phase(sos, part["y"].to_numpy(float))
        whole = envelope and (not chunk or part["__n"].iloc[0] <= chunk)
        z = analytic(y) if whole else y
        out = part[[*names, "sample", "t"]].assign(filtered=y, envelope=np.abs(z) if whole else np.nan, phase=np.angle(z) if whole else np.nan)
        if chunk:
            out = out[part["sample"].to_numpy() // chunk == part["__chunk"].to_numpy()]
        return out

    made = cut.select(*names, "__chunk", "__n", "sample", "t", "y").groupBy(*names, "__chunk").applyInPandas(
        run, f"{kinds}, sample long, t double, filtered double, envelope double, phase double"
    )
    if not (chunk and envelope):
        return made
    made = staged(made)
    long = made.where(F.col("envelope").isNull() | F.isnan("envelope"))
    if long.isEmpty():
        return made
    whole = with_hilbert(long.select(*names, "sample", "t", "filtered"), "filtered", series).select(
        *names, "sample", "t", "filtered", F.hypot("filtered", "hilbert").alias("envelope"), F.atan2("hilbert", "filtered").alias("phase")
    )
    return staged(made.where(F.col("envelope").isNotNull() & ~F.isnan("envelope")).unionByName(whole))


def robust_threshold(filtered: DataFrame, k: float = 4.0, series: Sequence[str] = KEYS, value: str = "envelope") -> DataFrame:
    """(series, threshold, median, robust_std): median + k * 1.4826 * median absolute deviation."""
    med = exact_median(filtered, series, value)
    mad = exact_median(filtered.join(med, list(series)), series, F.abs(F.col(value) - F.col("median")), "__mad").join(med, list(series))
    return mad.select(*series, (F.col("median") + k * 1.4826 * F.col("__mad")).alias("threshold"), "median", (1.4826 * F.col("__mad")).alias("robust_std"))


def instantaneous_frequency(filtered: DataFrame, fs: float, series: Sequence[str] = KEYS) -> DataFrame:
    """``frequency`` at each sample: the phase step to the next one, wrapped into (-pi, pi], in Hz."""
    d = F.lead("phase").over(ordered(series, "sample")) - F.col("phase")
    wrapped = d - 2 * math.pi * F.ceil((d - math.pi) / (2 * math.pi))
    return filtered.withColumn("frequency", wrapped * fs / (2 * math.pi))


def burst_events(
    filtered: DataFrame, thresholds: DataFrame, fs: float, min_duration_s: float = 0.5, merge_gap_s: float = 0.25, series: Sequence[str] = KEYS
) -> DataFrame:
    """Epochs with the envelope above the threshold, with peak_env, frequency_hz (median inside) and confirmed_s: the first sample above
    the threshold by which the burst had lasted long enough, else its end."""
    rows = instantaneous_frequency(filtered, fs, series).join(thresholds.select(*series, "threshold"), list(series))
    above = F.col("envelope") > F.col("threshold")
    epochs = detect_epochs(rows, above, "oscillation_burst", min_duration_s, merge_gap_s, None, series)
    placed = rows.withColumn("idx", (F.row_number().over(ordered(series, "t", "sample")) - 1).cast("long")).join(median_step(rows, series), list(series))
    w = ordered(series, "idx", "__side").rowsBetween(Window.unboundedPreceding, 0)
    marks = epochs.select(*series, F.col("start_idx").alias("idx"), F.lit(0).alias("__side"), F.struct("epoch_id", "start_s", "end_idx").alias("__e"))
    both = placed.select(
        *series, "idx", "t", "envelope", "frequency", "threshold", "step"
    ).withColumn("__side", F.lit(1)).unionByName(marks, allowMissingColumns=True)
    inside = both.withColumn("__e", F.last("__e", True).over(w)).where("__side = 1 and idx <= __e.end_idx")
    late = above & (F.col("t") - F.col("__e.start_s") + F.col("step") >= min_duration_s)
    inside = inside.withColumn("epoch_id", F.col("__e.epoch_id"))
    stats = inside.groupBy(*series, "epoch_id").agg(F.max("envelope").alias("peak_env"), F.min(F.when(late, F.col("t"))).alias("__c"))
    middle = exact_median(inside, [*series, "epoch_id"], F.when(F.col("idx") < F.col("__e.end_idx"), F.col("frequency")), "frequency_hz")
    return epochs.join(stats, [*series, "epoch_id"]).join(middle, [*series, "epoch_id"]).withColumn("confirmed_s", F.coalesce("__c", "end_s")).drop("__c")


@dataclass(frozen=True)
class OscillationDetector:
    """Band-limited bursts of all recordings as one plan; recordings too short to filter have none."""

    fs: float = 50.0
    band_hz: tuple[float, float] = (3.1, 4.3)
    order: int = 4
    threshold: float | None = None
    threshold_k: float = 4.0
    min_duration_s: float = 0.5
    merge_gap_s: float = 0.25
    chunk: int | None = 1 << 16

    def __post_init__(self) -> None:
        if not 0 < self.band_hz[0] < self.band_hz[1] < self.fs / 2:
            raise ValueError(f"band {self.band_hz} must lie within 0 and {self.fs / 2}")
        if self.order < 1 or self.min_duration_s < 0 or self.merge_gap_s < 0 or self.fs <= 0:
            raise ValueError("order, durations and sampling rate must be positive")

    def run(self, samples: DataFrame, series: Sequence[str] = KEYS) -> DataFrame:
        made = bandpass(samples, self.fs, self.band_hz, self.order, self.chunk, True, series)
        made = made if self.chunk else staged(made)  # thresholds, epochs and statistics read it
        levels = robust_threshold(made, self.threshold_k, series) if self.threshold is None else made.select(*series).distinct().withColumn(
            "threshold", F.lit(float(self.threshold))
        )
        return burst_events(made, levels, self.fs, self.min_duration_s, self.merge_gap_s, series)

    def events(self, samples: DataFrame, series: Sequence[str] = KEYS) -> DataFrame:
        return onsets_and_offsets(self.run(samples, series), "burst_onset", "burst_offset", series)


def top_bursts(bursts: DataFrame, k: int, pad_s: float = 1.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """The k longest bursts of each recording, by samples, with a padded window."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.col("end_idx") - F.col("start_idx")), "start_idx"))
    return bursts.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("window_lo", F.col("start_s") - pad_s).withColumn("window_hi", F.col("end_s") + pad_s)


def bosc_frequencies(fit_hz: tuple[float, float] = (1.0, 12.0), per_octave: int = 8) -> list[float]:
    return [fit_hz[0] * 2.0 ** (i / per_octave) for i in range(round(math.log2(fit_hz[1] / fit_hz[0]) * per_octave) + 1)]


def bosc_episodes(
    samples: DataFrame, fs: float, band_hz: tuple[float, float], fit_hz: tuple[float, float] = (1.0, 12.0), per_octave: int = 8, percentile: float = 0.95, min_cycles: float = 3.0, width: float = 6.0, background: DataFrame | None = None, reference: str | None = None, chunk: int = 4096, series: Sequence[str] = KEYS
) -> dict[str, DataFrame]:
    """Tables levels (series, freq_idx, freq, mean_power, background, threshold) and episodes.

    Wavelet power over a power-law background by a chi-squared bound, held for ``min_cycles`` cycles; a sample oscillates if any frequency
    of the band does. ``reference`` names a boolean column of the samples that the mean is taken over; ``background`` (freq_idx,
    background) replaces the fit.
    """
    freqs = bosc_frequencies(fit_hz, per_octave)
    timed = staged(morlet_power(samples, fs, freqs, width, chunk, series, ["t", *([reference] if reference else [])]))
    mean = timed.groupBy(*series, "freq_idx", "freq").agg(
        (F.coalesce(F.avg(F.when(F.col(reference), F.col("power"))), F.avg("power")) if reference else F.avg("power")).alias("mean_power")
    )
    in_band = F.col("freq").between(*band_hz)
    if background is None:
        x, y = F.when(~in_band, F.ln("freq")), F.when(~in_band, F.ln("mean_power"))
        fit = mean.groupBy(*series).agg(F.regr_slope(y, x).alias("__a"), F.regr_intercept(y, x).alias("__b"))
        levels = mean.join(fit, list(series)).withColumn("background", F.exp(F.col("__b") + F.col("__a") * F.ln("freq"))).drop("__a", "__b")
    else:
        levels = mean.join(background.select("freq_idx", "background"), "freq_idx")
    levels = levels.withColumn("threshold", F.col("background") * (-math.log(1 - percentile)))
    rows = timed.where(in_band).join(levels.select(*series, "freq_idx", "background", "threshold"), [*series, "freq_idx"])
    own = [*series, "freq_idx"]
    runs = detect_epochs(
        rows, F.col("power") > F.col("threshold"), "cycle_run", keys=own
    ).join(levels.select(*own, "freq"), own).where(F.col("duration_s") >= min_cycles / F.col("freq"))
    w = ordered(own, "idx", "__side").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("idx", (F.row_number().over(ordered(own, "t", "sample")) - 1).cast("long")).withColumn("__side", F.lit(1))
    marks = runs.select(*own, F.col("start_idx").alias("idx"), F.lit(0).alias("__side"), F.col("end_idx").alias("__end"))
    held = placed.unionByName(marks, allowMissingColumns=True).withColumn("__end", F.last("__end", True).over(w)).where("__side = 1").withColumn(
        "detected", F.coalesce(F.col("idx") <= F.col("__end"), F.lit(False))
    )
    flat = held.groupBy(*series, "sample", "t").agg(F.bool_or("detected").alias("oscillating"))
    episodes = detect_epochs(flat, F.col("oscillating"), "oscillation_episode", keys=series)
    e = ordered(series, "idx", "__side").rowsBetween(Window.unboundedPreceding, 0)
    starts = episodes.select(*series, F.col("start_idx").alias("idx"), F.lit(0).alias("__side"), F.struct("epoch_id", "end_idx").alias("__e"))
    inside = held.drop("__end").unionByName(starts, allowMissingColumns=True).withColumn("__e", F.last("__e", True).over(e)).where("__side = 1 and idx <= __e.end_idx")
    weight = inside.groupBy(*series, F.col("__e.epoch_id").alias("epoch_id"), "freq").agg(
        F.sum(F.when(F.col("detected"), F.col("power") / F.col("background")).otherwise(0.0)).alias("__w")
    )
    best = weight.groupBy(*series, "epoch_id").agg(F.max_by("freq", F.struct("__w", -F.col("freq"))).alias("frequency_hz"))
    episodes = episodes.join(best, [*series, "epoch_id"]).withColumn(
        "confirmed_s", F.least(F.col("start_s") + min_cycles / F.col("frequency_hz"), F.col("end_s"))
    )
    return {"levels": levels, "episodes": episodes}
