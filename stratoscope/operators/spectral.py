"""Spectra: frames are rows, a Python worker sees one frame at a time, all averaging is by aggregates."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import generalized_eigh, hann, morlet
from ..model import KEYS, ordered
from ..shipping import ship
from .intervals import samples_in


def frames(
    samples: DataFrame, epochs: DataFrame | None, nperseg: int, overlap: float = 0.5, keys: Sequence[str] = KEYS,
    series: Sequence[str] = ("channel",), value: str = "y"
) -> DataFrame:
    """(keys, epoch_id, series, frame, x, n_samples, n_frames): overlapping frames of each epoch's finite samples, as arrays.

    Epochs are half-open; without any, a recording is one epoch 0. Epochs shorter than a frame give no rows. Each sample is
    sent to the one or few frames that it belongs to.
    """
    step = nperseg - int(nperseg * overlap)
    held = samples.where(F.col(value).isNotNull())
    cut = held.withColumn("epoch_id", F.lit(0).cast("long")) if epochs is None else samples_in(held, epochs, keys, keep=["epoch_id"])
    group = [*keys, "epoch_id", *series]
    cut = cut.withColumn("__i", F.row_number().over(ordered(group, "t", "sample")) - 1).withColumn("n_samples", F.count("*").over(Window.partitionBy(*group)))
    cut = cut.where(F.col("n_samples") >= nperseg).withColumn("n_frames", (F.floor((F.col("n_samples") - nperseg) / step) + 1).cast("long"))
    first = F.greatest(F.lit(0), F.ceil((F.col("__i") - nperseg + 1) / step)).cast("long")
    last = F.least(F.col("n_frames") - 1, F.floor(F.col("__i") / step)).cast("long")
    spread = cut.where(first <= last).withColumn("frame", F.explode(F.sequence(first, last)))
    collected = spread.groupBy(*group, "frame").agg(
        F.sort_array(F.collect_list(F.struct("__i", F.col(value).alias("v")))).alias("__x"), F.first("n_samples").alias("n_samples"),
        F.first("n_frames").alias("n_frames")
    )
    return collected.select(*group, "frame", F.col("__x.v").alias("x"), "n_samples", "n_frames")


def frame_spectra(made: DataFrame, nperseg: int, detrend: bool = True) -> DataFrame:
    """Frames with re and im: the transform of each Hann-windowed frame less its mean."""
    ship(made.sparkSession)
    window = hann(nperseg)

    @F.pandas_udf("re array<double>, im array<double>")
    def transform(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            a = np.stack(x.to_list()) if len(x) else np.zeros((0, nperseg))
            a = a - a.mean(axis=1, keepdims=True) if detrend else a
            s = np.fft.rfft(a * window, axis=1)
            yield pd.DataFrame({"re": list(s.real), "im": list(s.imag)})

    return made.withColumn("__s", transform("x")).select(*[c for c in made.columns if c != "x"], F.col("__s.re").alias("re"), F.col("__s.im").alias("im"))


def one_sided(nperseg: int, fs: float) -> np.ndarray:
    """Density scale of each frequency."""
    scale = np.full(nperseg // 2 + 1, 2.0)
    scale[0] = 1.0
    if nperseg % 2 == 0:
        scale[-1] = 1.0
    return scale / (fs * np.sum(hann(nperseg) ** 2))


def _density(nperseg: int, fs: float) -> Column:
    return F.array(*[F.lit(float(v)) for v in one_sided(nperseg, fs)])


def welch(
    samples: DataFrame, epochs: DataFrame | None, fs: float, segment_s: float = 4.0, keys: Sequence[str] = KEYS,
    series: Sequence[str] = ("channel",)
) -> DataFrame:
    """(keys, epoch_id, series, freq_idx, freq, power): Welch spectra per epoch."""
    nperseg = int(round(segment_s * fs))
    made = frame_spectra(frames(samples, epochs, nperseg, 0.5, keys, series), nperseg)
    power = F.transform(F.arrays_zip("re", "im", _density(nperseg, fs).alias("d")), lambda x: (x.re * x.re + x.im * x.im) * x.d)
    rows = made.select(*keys, "epoch_id", *series, F.posexplode(power).alias("freq_idx", "p"))
    return rows.groupBy(*keys, "epoch_id", *series, "freq_idx").agg(F.avg("p").alias("power")).withColumn("freq", F.col("freq_idx") * F.lit(fs / nperseg))


def mean_spectrum(spectra: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Geometric mean per frequency; 0 where any power is 0; nulls ignored."""
    return spectra.groupBy(*groups, "freq_idx", "freq").agg(
        F.when(F.min("power") == 0, 0.0).otherwise(F.exp(F.avg(F.when(F.col("power") > 0, F.ln("power"))))).alias("power")
    )


def aperiodic_peak(
    spectra: DataFrame, groups: Sequence[str], peak_hz: tuple[float, float] = (2.5, 6.5), fit_hz: tuple[float, float] = (1.0, 12.0)
) -> DataFrame:
    """(groups, peak_hz, peak_gain): the largest power over a power-law background that is fitted outside of peak_hz."""
    f, p = F.col("freq"), F.col("power")
    in_peak = f.between(*peak_hz)
    used = f.between(*fit_hz) & ~in_peak & (p > 0)
    fit = spectra.groupBy(*groups).agg(
        F.regr_slope(
            F.when(used, F.ln(p)), F.when(used, F.ln(f))
        ).alias("__a"), F.regr_intercept(F.when(used, F.ln(p)), F.when(used, F.ln(f))).alias("__b"), F.count_if(used).alias("__n")
    )
    rows = spectra.join(fit, list(groups)).where(in_peak & (F.col("__n") >= 2)).withColumn("gain", p / F.exp(F.col("__b") + F.col("__a") * F.ln(f)))
    return rows.groupBy(*groups).agg(F.max_by("freq", F.struct("gain", -F.col("freq"))).alias("peak_hz"), F.max("gain").alias("peak_gain"))


def cross_spectra(
    samples: DataFrame, reference: DataFrame, epochs: DataFrame | None, fs: float, segment_s: float = 4.0, overlap: float = 0.5,
    keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, channel, freq_idx, freq, power, reference_power, re, im, n_samples): each channel's spectrum with the reference's,
    E[conj(R) X], pooled over epochs by their number of samples. Samples that the reference or any channel lacks are left out.

    samples and reference are matched by (keys, sample).
    """
    table = epoch_matrix(
        samples.unionByName(reference.withColumn("channel", F.lit("\u0000ref")), allowMissingColumns=True), epochs, fs, segment_s, overlap, keys
    )
    ref = table.where("k = '\u0000ref' and l = '\u0000ref'").select(*keys, "freq_idx", F.col("re").alias("reference_power"))
    own = table.where("k = l and k <> '\u0000ref'").select(*keys, F.col("l").alias("channel"), "freq_idx", F.col("re").alias("power"))
    cross = table.where("k = '\u0000ref' and l <> '\u0000ref'").select(*keys, F.col("l").alias("channel"), "freq_idx", "freq", "re", "im", "n_samples")
    return cross.join(own, [*keys, "channel", "freq_idx"]).join(ref, [*keys, "freq_idx"])


def epoch_matrix(
    samples: DataFrame, epochs: DataFrame | None, fs: float, segment_s: float = 4.0, overlap: float = 0.5, keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, k, l, freq_idx, freq, re, im, n_samples) for channels k <= l: E[conj(x_k) x_l]; the other half is its conjugate.

    Pairs are formed within one frame and frequency and summed before the shuffle by (keys, k, l, frequency).
    """
    nperseg = int(round(segment_s * fs))
    n_channels = samples.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.countDistinct("channel").alias("__m"))
    whole = samples.where(F.col("y").isNotNull()).groupBy(*keys, "sample").agg(F.countDistinct("channel").alias("__k")).join(n_channels, list(keys)).where("__k = __m").select(*keys, "sample")
    made = frame_spectra(frames(samples.join(whole, [*keys, "sample"]), epochs, nperseg, overlap, keys, ("channel",)), nperseg)
    frame = [*keys, "epoch_id", "frame"]
    left = made.select(*frame, F.col("channel").alias("k"), F.col("re").alias("a"), F.col("im").alias("b"), "n_samples", "n_frames")
    right = made.select(*frame, F.col("channel").alias("l"), F.col("re").alias("c"), F.col("im").alias("d"))
    parts = F.posexplode(F.arrays_zip("a", "b", "c", "d", _density(nperseg, fs).alias("s")))
    both = left.join(right, frame).where("k <= l").select(*keys, "epoch_id", "k", "l", "n_samples", "n_frames", parts.alias("freq_idx", "x"))
    weight = F.col("x.s") * F.col("n_samples") / F.col("n_frames")
    sums = both.groupBy(*keys, "k", "l", "freq_idx").agg(
        F.sum((F.col("x.a") * F.col("x.c") + F.col("x.b") * F.col("x.d")) * weight).alias("re"),
        F.sum((F.col("x.a") * F.col("x.d") - F.col("x.b") * F.col("x.c")) * weight).alias("im"),
        F.sum(F.col("n_samples") / F.col("n_frames")).alias("n"),
    )
    return sums.select(
        *keys, "k", "l", "freq_idx", (F.col("freq_idx") * F.lit(fs / nperseg)).alias("freq"), (F.col("re") / F.col("n")).alias("re"),
        (F.col("im") / F.col("n")).alias("im"), F.round("n").cast("long").alias("n_samples")
    )


def band_coupling(cross: DataFrame, band: tuple[float, float], groups: Sequence[str] = (*KEYS, "channel")) -> DataFrame:
    """(groups, power, coherence, lag_s) over [band): lag is positive when the channel follows the reference."""
    spacing = cross.groupBy(*groups).agg((F.max("freq") / F.max("freq_idx")).alias("__step"))
    inside = cross.where((F.col("freq") >= band[0]) & (F.col("freq") < band[1]))
    weight = F.hypot("re", "im")
    sums = inside.groupBy(*groups).agg(
        F.sum("power").alias("__p"), F.sum("reference_power").alias("__r"), F.sum("re").alias("__re"), F.sum("im").alias("__im"), (
            F.sum(weight * F.col("freq")) / F.sum(weight)
        ).alias("__centre")
    )
    return sums.join(spacing, list(groups)).select(
        *groups,
        (F.col("__p") * F.col("__step")).alias("power"),
        ((F.col("__re") * F.col("__re") + F.col("__im") * F.col("__im")) / (F.col("__p") * F.col("__r"))).alias("coherence"),
        (-F.atan2("__im", "__re") / (2 * np.pi * F.col("__centre"))).alias("lag_s"),
    )


def aperiodic_fit(spectra: DataFrame, groups: Sequence[str], fit_hz: tuple[float, float] = (1.0, 8.0), rounds: int = 3) -> DataFrame:
    """(groups, offset, exponent, r_squared) of a line of log10 power over log10 frequency, refitted without the bins above it by more
    than one standard deviation of the residuals that were used; null for fewer than four bins."""
    w = Window.partitionBy(*groups)
    rows = spectra.where(
        F.col("freq").between(*fit_hz) & (F.col("power") > 0)
    ).withColumn("__x", F.log10("freq")).withColumn("__y", F.log10("power")).withColumn("__u", F.lit(True)).withColumn("__n", F.count("*").over(w))
    for _ in range(rounds + 1):
        x, y = F.when(F.col("__u"), F.col("__x")), F.when(F.col("__u"), F.col("__y"))
        rows = rows.withColumn("__a", F.regr_slope(y, x).over(w)).withColumn("__b", F.regr_intercept(y, x).over(w))
        rows = rows.withColumn("__r", F.col("__y") - F.col("__b") - F.col("__a") * F.col("__x"))
        used = F.when(F.col("__u"), F.col("__r"))
        rows = rows.withColumn("__sd", F.stddev_samp(used).over(w)).withColumn("__m", F.count(used).over(w))
        rows = rows.withColumn("__u", F.when(F.col("__m") > 2, F.col("__r") <= F.col("__sd")).otherwise(F.col("__u")))
    kept = F.col("__u") & (F.col("__n") >= 4)
    fit = rows.groupBy(*groups).agg(
        F.first("__a").alias("__a"), F.first("__b").alias("__b"), F.var_pop(F.when(kept, F.col("__r"))).alias("__vr"), F.var_pop(F.when(kept, F.col("__y"))).alias("__vy"), F.first("__n").alias("__n")
    )
    good = F.col("__n") >= 4
    return fit.select(
        *groups, F.when(good, F.col("__b")).alias("offset"), F.when(good, -F.col("__a")).alias("exponent"),
        F.when(good, 1 - F.col("__vr") / F.col("__vy")).alias("r_squared")
    )


def morlet_power(
    samples: DataFrame, fs: float, freqs: Sequence[float], width: float = 6.0, chunk: int = 4096, series: Sequence[str] = KEYS, carry: Sequence[str] = ()
) -> DataFrame:
    """(series, sample, carry, freq_idx, freq, power): wavelet power at each sample, with the sample's columns in ``carry``. Samples must be
    numbered 0, 1, ... without gaps.

    The mean is removed and missing samples are 0. Kernels are finite, so time is cut into chunks with a halo of half the longest kernel
    on each side, and a chunk gives what the whole series gives; no series is one task.
    """
    ship(samples.sparkSession)
    kernels = [morlet(f, fs, width) for f in freqs]
    halo = max(len(k) for k in kernels) // 2 + 1
    mean = samples.groupBy(*series).agg(F.avg("y").alias("__mean"), F.count("*").alias("__n"))
    own = samples.join(mean, list(series)).withColumn("__v", F.coalesce(F.col("y") - F.col("__mean"), F.lit(0.0)))
    lo, hi = F.greatest(F.lit(0), F.floor((F.col("sample") - halo) / chunk)), F.floor(F.least(F.col("__n") - 1, F.col("sample") + halo) / chunk)
    cut = own.withColumn("__chunk", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    names = list(series)
    kinds = ", ".join(f"{c} {samples.schema[c].dataType.simpleString()}" for c in names)
    held = "".join(f"{c} {samples.schema[c].dataType.simpleString()}, " for c in carry)

    def convolve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample")
        at, c, n = part["sample"].to_numpy(), int(part["__chunk"].iloc[0]), int(part["__n"].iloc[0])
        inner = part[(at >= c * chunk) & (at < (c + 1) * chunk)]
        begin, end = c * chunk, min(n, (c + 1) * chunk)
        x = np.zeros(end - begin + 2 * halo)
        x[at - begin + halo] = part["__v"].to_numpy()
        rows = []
        for i, k in enumerate(kernels):
            full = np.convolve(x, k)
            start = halo + (len(k) - 1) // 2
            rows.append(
                pd.DataFrame({"sample": np.arange(begin, end), **{x: inner[x].to_numpy() for x in carry}, "freq_idx": i, "freq": float(freqs[i]), "power": np.abs(full[start : start + end - begin]) ** 2})
            )
        out = pd.concat(rows)
        for name in reversed(names):
            out.insert(0, name, part[name].iloc[0])
        return out

    return cut.select(*names, "__chunk", "sample", "__n", "__v", *carry).groupBy(*names, "__chunk").applyInPandas(
        convolve, f"{kinds}, sample long, {held}freq_idx int, freq double, power double"
    )


def ssd(matrix: DataFrame, band: tuple[float, float], flanks: Sequence[tuple[float, float]], shrinkage: float = 0.01, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, component, channel, ratio, filter, pattern): spatio-spectral decomposition of epoch_matrix rows.

    Bands are closed; 0 Hz is never a flank. The two covariances are sums of aggregates; only their channels-by-channels solve is in Python.
    """
    centre = matrix.select(*keys).distinct().withColumn("centre_hz", F.lit(sum(band) / 2))
    return _solve(
        _covariances(matrix, centre, lambda c: (F.lit(band[0]), F.lit(band[1])), [lambda c, x=x: (F.lit(x[0]), F.lit(x[1])) for x in flanks], keys),
        shrinkage, keys, False
    ).drop("centre_hz")


def ssd_scan(
    matrix: DataFrame, centres: Sequence[float], half_width: float = 0.5, flank_hz: tuple[float, float] = (1.0, 2.0), shrinkage: float = 0.01,
    keys: Sequence[str] = KEYS
) -> DataFrame:
    """(keys, centre_hz, channel, ratio, filter, pattern): the first component at each centre, its pattern's largest entry being +1."""
    own = matrix.select(*keys).distinct().withColumn("centre_hz", F.explode(F.array(*[F.lit(float(c)) for c in centres])))
    sides = [lambda c: (c - flank_hz[1], c - flank_hz[0]), lambda c: (c + flank_hz[0], c + flank_hz[1])]
    made = _solve(_covariances(matrix, own, lambda c: (c - half_width, c + half_width), sides, keys), shrinkage, keys, True)
    return made.where("component = 0").drop("component")


def _covariances(matrix: DataFrame, centres: DataFrame, band, flanks, keys: Sequence[str]) -> DataFrame:
    c, f = F.col("centre_hz"), F.col("freq")
    inside = f.between(*band(c))
    beside = F.lit(False)
    for flank in flanks:
        beside = beside | f.between(*flank(c))
    beside = beside & (f > 0) & ~inside
    rows = matrix.join(centres, list(keys))
    return rows.groupBy(*keys, "centre_hz", "k", "l").agg(
        F.sum(F.when(inside, F.col("re"))).alias("s"), F.sum(F.when(beside, F.col("re"))).alias("r"), F.count_if(inside).alias("ns"), F.count_if(beside).alias("nr")
    )


def _solve(cov: DataFrame, shrinkage: float, keys: Sequence[str], unit: bool) -> DataFrame:
    ship(cov.sparkSession)
    names = list(keys)
    kinds = ", ".join(f"{k} {cov.schema[k].dataType.simpleString()}" for k in names)

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        channels = sorted(set(part["k"]) | set(part["l"]))
        at = {c: i for i, c in enumerate(channels)}
        n = len(channels)
        s, r = np.zeros((n, n)), np.zeros((n, n))
        for k, l, a, b in zip(part["k"], part["l"], part["s"], part["r"], strict=True):
            s[at[k], at[l]] = s[at[l], at[k]] = a
            r[at[k], at[l]] = r[at[l], at[k]] = b
        if not np.isfinite(s).all() or not np.isfinite(r).all() or np.trace(r) <= 0:
            return pd.DataFrame(columns=[*names, "centre_hz", "component", "channel", "ratio", "filter", "pattern"])
        values, w = generalized_eigh(s, r + shrinkage * np.trace(r) / n * np.eye(n))
        pattern = s @ w / np.einsum("nk,nm,mk->k", w, s, w)
        sign = np.sign(pattern[np.abs(pattern).argmax(axis=0), np.arange(n)])
        w, pattern = w * sign, pattern * sign
        if unit:
            pattern = pattern / np.abs(pattern).max(axis=0)
        ratio = values * part["nr"].iloc[0] / part["ns"].iloc[0]
        i, j = np.divmod(np.arange(n * n), n)
        out = pd.DataFrame(
            {
                "centre_hz": part["centre_hz"].iloc[0], "component": i, "channel": [channels[x] for x in j], "ratio": ratio[i], "filter": w[j, i],
                "pattern": pattern[j, i]
            }
        )
        for name in reversed(names):
            out.insert(0, name, part[name].iloc[0])
        return out

    return cov.groupBy(*names, "centre_hz").applyInPandas(
        solve, f"{kinds}, centre_hz double, component int, channel string, ratio double, filter double, pattern double"
    )
