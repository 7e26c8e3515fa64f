"""Cleaning and smoothing of samples, per recording and channel."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.filters import gaussian_weights, savgol_matrix
from ..model import KEYS, everything, finite, ordered
from .asof import interpolate_own, remap_linear
from .quantiles import exact_quantiles
from .segments import median_step

SERIES = (*KEYS, "source", "channel")


def _numbers(values: np.ndarray) -> Column:
    """A literal array (of arrays) of doubles."""
    if values.ndim == 2:
        return F.array(*[_numbers(row) for row in values])
    return F.array(*[F.lit(float(v)) for v in values])


def _dot(values: Column, weights: Column) -> Column:
    return F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def _placed(samples: DataFrame, series: Sequence[str]) -> DataFrame:
    """With the position __i and the series' length __n."""
    return samples.withColumn("__i", F.row_number().over(ordered(series, "sample")) - 1).withColumn("__n", F.count("*").over(everything(series)))


def fit_polynomials(samples: DataFrame, window: int, order: int, series: Sequence[str] = SERIES, column: str = "y") -> DataFrame:
    """Savitzky-Golay smoothing of a column without gaps; the ends take the values of the polynomials through the first and last window."""
    half, matrix = window // 2, _numbers(savgol_matrix(window, order))
    around = F.collect_list(column).over(ordered(series, "sample").rowsBetween(-2 * half, 2 * half))
    rows = _placed(samples, series).withColumn("__l", around)
    at, n = F.col("__i"), F.col("__n")
    start = F.when(at < half, F.lit(0)).when(at > n - 1 - half, F.size("__l") - window).otherwise(F.least(at, F.lit(2 * half)) - half)
    row = F.when(at < half, at).when(at > n - 1 - half, window - (n - at)).otherwise(F.lit(half))
    smooth = _dot(F.slice("__l", (start + 1).cast("int"), window), F.element_at(matrix, (row + 1).cast("int")))
    return rows.withColumn(column, F.when(n < window, F.col(column)).otherwise(smooth)).drop("__l", "__i", "__n")


def smooth_savgol(samples: DataFrame, window_s: float, fs: float, order: int = 3, series: Sequence[str] = SERIES) -> DataFrame:
    """Smoothing by seconds: nulls are interpolated by position first and put back after; series no longer than the window stay as they are."""
    window = max(3, round(window_s * fs) + (round(window_s * fs) % 2 == 0))
    if window <= order:
        raise ValueError(f"a window of {window} samples can't carry a polynomial of order {order}")
    filled = interpolate_own(samples, "sample", series)
    n = F.count("*").over(everything(series))
    filled = filled.withColumn("__short", n <= window).withColumn("__gap", F.col("y").isNull())
    smooth = fit_polynomials(filled, window, order, series, "filled")
    return smooth.withColumn("y", F.when(F.col("__short"), F.col("y")).when(~F.col("__gap"), F.col("filled"))).drop("filled", "__short", "__gap")


def smooth_median(samples: DataFrame, size: int = 3, series: Sequence[str] = SERIES, column: str = "y") -> DataFrame:
    """Running median with reflected ends; series no longer than ``size`` stay as they are."""
    half = size // 2
    around = F.collect_list(column).over(ordered(series, "sample").rowsBetween(-half, half))
    rows = _placed(samples, series).withColumn("__l", around)
    front = F.slice("__l", F.lit(1), F.greatest(F.lit(0), half - F.col("__i")).cast("int"))
    missing = F.greatest(F.lit(0), F.col("__i") + half - F.col("__n") + 1).cast("int")
    back = F.when(missing > 0, F.slice("__l", F.greatest(F.lit(1), F.size("__l") - missing + 1), missing)).otherwise(F.slice("__l", 1, 0))
    middle = F.element_at(F.array_sort(F.concat("__l", front, back)), half + 1)
    return rows.withColumn(column, F.when(F.col("__n") <= size, F.col(column)).otherwise(middle)).drop("__l", "__i", "__n")


def smooth_dense(samples: DataFrame, median_size: int = 3, window: int = 5, order: int = 2, series: Sequence[str] = SERIES, column: str = "y") -> DataFrame:
    """Median, then Savitzky-Golay, of series without gaps."""
    first = smooth_median(samples, median_size, series, column) if median_size > 1 else samples
    return fit_polynomials(first, window, order, series, column)


def smooth_gaussian(samples: DataFrame, sigma: float, series: Sequence[str] = SERIES, column: str = "y") -> DataFrame:
    """Gaussian weights to 4 sigma, reflected ends; the series must be longer than the kernel's half."""
    w = gaussian_weights(sigma)
    half = len(w) // 2
    around = F.collect_list(column).over(ordered(series, "sample").rowsBetween(-half, half))
    rows = _placed(samples, series).withColumn("__l", around)
    head = F.greatest(F.lit(0), half - F.col("__i")).cast("int")
    tail = F.greatest(F.lit(0), F.col("__i") + half - F.col("__n") + 1).cast("int")
    front = F.reverse(F.slice("__l", F.lit(1), head))
    back = F.reverse(F.slice("__l", F.greatest(F.lit(1), F.size("__l") - tail + 1), tail))
    return rows.withColumn(column, _dot(F.concat(front, "__l", back), _numbers(w))).drop("__l", "__i", "__n")


def remove_outliers(samples: DataFrame, k: float = 4.0, series: Sequence[str] = SERIES) -> DataFrame:
    """``inlier`` and y, null outside of [q1 - k*iqr, q3 + k*iqr] of its series; exact quartiles, nulls ignored."""
    joined = samples.join(exact_quantiles(samples, series, "y", {"__q1": 0.25, "__q3": 0.75}), list(series), "left")
    iqr = F.col("__q3") - F.col("__q1")
    ok = F.coalesce(F.col("y").between(F.col("__q1") - k * iqr, F.col("__q3") + k * iqr), F.lit(False))
    return joined.withColumn("inlier", ok).withColumn("y", F.when(F.col("inlier"), F.col("y"))).drop("__q1", "__q3")


def zscore(samples: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Less the mean, over the population's standard deviation; null where that is 0."""
    w = everything(series)
    sd = F.stddev_pop("y").over(w)
    return samples.withColumn("z", F.when(sd > 0, (F.col("y") - F.avg("y").over(w)) / sd))


def detrend_zscore(samples: DataFrame, series: Sequence[str] = SERIES) -> DataFrame:
    """Residuals of a line over the position, over their sample standard deviation; a deviation of 0 counts as 1."""
    fit = samples.groupBy(*series).agg(
        F.regr_slope("y", F.col("sample").cast("double")).alias("__a"), F.regr_intercept("y", F.col("sample").cast("double")).alias("__b")
    )
    rest = samples.join(fit, list(series)).withColumn("__r", F.col("y") - F.col("__a") * F.col("sample") - F.col("__b"))
    w = everything(series)
    sd = F.stddev_samp("__r").over(w)
    return rest.withColumn("z", (F.col("__r") - F.avg("__r").over(w)) / F.when(sd > 0, sd).otherwise(1.0)).drop("__a", "__b", "__r")


def clean_steps(
    samples: DataFrame, max_step: float, bounds: tuple[float, float] | None = None, max_fill_s: float = 0.5, series: Sequence[str] = SERIES
) -> DataFrame:
    """``flagged`` and ``cleaned``: missing, out-of-bounds and jumping samples are flagged; short runs of them are interpolated in time."""
    w = ordered(series, "t", "sample")
    y = F.col("y")
    jump = lambda other: F.coalesce(F.abs(y - other) > max_step, F.lit(False))
    bad = finite("y").isNull() | jump(F.lag("y").over(w)) | jump(F.lead("y").over(w))
    if bounds is not None:
        bad = bad | F.coalesce((y <= bounds[0]) | (y > bounds[1]), F.lit(False))
    rows = samples.withColumn("flagged", bad)
    rows = rows.withColumn("__new", (F.col("flagged") != F.coalesce(F.lag("flagged").over(w), ~F.col("flagged"))).cast("int"))
    rows = rows.withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    point = F.struct("t", "y")
    rows = rows.withColumn("__prev", F.lag(point).over(w)).withColumn("__next", F.lead(point).over(w))
    inside = Window.partitionBy(*series, "__run").orderBy("t", "sample").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("__a", F.first("__prev").over(inside)).withColumn("__b", F.last("__next").over(inside)).withColumn(
        "__span", F.max("t").over(inside) - F.min("t").over(inside)
    )
    rows = rows.join(median_step(samples, series), list(series))
    fill = F.col("__a.y") + (F.col("__b.y") - F.col("__a.y")) * (F.col("t") - F.col("__a.t")) / (F.col("__b.t") - F.col("__a.t"))
    fits = F.col("__a").isNotNull() & F.col("__b").isNotNull() & (F.col("__span") + F.col("step") <= max_fill_s)
    return rows.withColumn("cleaned", F.when(~F.col("flagged"), y).when(fits, fill)).drop("__new", "__run", "__prev", "__next", "__a", "__b", "__span", "step")


#: Named recipes of styled traces and of the overview's variables: quartile factor, smoothing seconds, then median, window and order.
STYLES = {
    "speed": {"k": 2.0, "median": 1, "window": 7, "order": 2}, "pupil": {"k": 1.5, "median": 1, "window": 15, "order": 3},
    "diameter": {"k": 1.5, "median": 1, "window": 15, "order": 3}
}


def prepare_trace(
    reference: DataFrame, source: DataFrame, k: float | None = None, smooth_s: float | None = None, fs: float | None = None,
    dense: tuple[int, int, int] | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Remapped to the reference's times, outliers away, smoothed by seconds, then by samples; each step only if it is asked for."""
    out = remap_linear(reference, source, keys)
    if k is not None:
        out = remove_outliers(out, k, keys)
    if smooth_s is not None and fs is not None:
        out = smooth_savgol(out, smooth_s, fs, series=keys)
    return smooth_dense(out, *dense, series=keys) if dense else out


def process_variable(samples: DataFrame, name: str, series: Sequence[str] = SERIES) -> DataFrame:
    """Outliers away and the valid samples smoothed, as the variable's name asks; other names pass. ``valid`` tells what is left."""
    style = next((s for key, s in STYLES.items() if key in name.lower()), None)
    if style is None:
        return samples.withColumn("valid", F.col("y").isNotNull())
    marked = remove_outliers(samples, style["k"], series).withColumnRenamed("inlier", "valid")
    kept = marked.where("valid").select(*series, "sample", F.col("y").alias("__y"))
    smooth = smooth_dense(kept, style["median"], style["window"], style["order"], series, "__y")
    return marked.join(smooth, [*series, "sample"], "left").withColumn("y", F.coalesce("__y", "y")).drop("__y")


def timeline(
    samples: DataFrame, trim_head_s: float = 0.0, trim_tail_s: float = 0.0, gap_s: float = 0.0, within: Sequence[str] = ("subject",),
    order: str = "session"
) -> DataFrame:
    """``timeline_s``: sessions after one another, each trimmed and shifted by the lengths of those before and ``gap_s`` after each."""
    spans = samples.groupBy(*within, order).agg(F.min("t").alias("__lo"), F.max("t").alias("__hi"))
    spans = spans.withColumn("__lo", F.col("__lo") + trim_head_s).withColumn("__hi", F.col("__hi") - trim_tail_s).where("__hi >= __lo")
    before = ordered(within, order).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("__off", F.coalesce(F.sum(F.col("__hi") - F.col("__lo") + gap_s).over(before), F.lit(0.0)))
    kept = samples.join(spans, [*within, order]).where(F.col("t").between(F.col("__lo"), F.col("__hi")))
    return kept.withColumn("timeline_s", F.col("t") - F.col("__lo") + F.col("__off")).drop("__lo", "__hi", "__off")
