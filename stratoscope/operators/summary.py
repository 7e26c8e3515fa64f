"""Grouped statistics: means and errors, pivots, change from the first, box summaries, correlations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import KEYS
from .quantiles import exact_median, exact_quantiles


def sem(x: str) -> Column:
    """Standard error of the mean; null for a single value."""
    return F.stddev_samp(x) / F.sqrt(F.count(x))


def sem0(x: str) -> Column:
    """The same; 0 for a single value."""
    return F.when(F.count(x) > 1, sem(x)).otherwise(0.0)


def group_mean_sem(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(value).alias("mean"), F.when(F.count(value) > 1, sem(value)).alias("sem"))


def pivot_mean(df: DataFrame, row: str, column: str, values: Sequence, value: str) -> DataFrame:
    """Means by row and column; the columns are named, so no pass looks for them."""
    return df.groupBy(row).pivot(column, list(values)).agg(F.avg(value))


def change_from_first(df: DataFrame, values: Sequence[str], subject: str = "subject", order: str = "session_n") -> DataFrame:
    """d_<v> and pct_<v>: difference to and share of the subject's first non-null value."""
    w = Window.partitionBy(subject).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for v in values:
        first = F.first(v, True).over(w)
        df = df.withColumn(f"d_{v}", F.col(v) - first).withColumn(f"pct_{v}", F.when(first != 0, (F.col(v) - first) / first))
    return df


def mean_sem_n(df: DataFrame, x: str, y: str) -> DataFrame:
    """Mean, standard error and number by x, without nulls, in order."""
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x).agg(
        F.avg(y).alias("mean"), F.when(F.count(y) > 1, sem(y)).alias("sem"), F.count(y).alias("n")
    ).orderBy(x)


def recording_reducers(samples: DataFrame, keys: Sequence[str] = KEYS, value: str = "y") -> DataFrame:
    sums = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"))
    return sums.join(exact_median(samples, keys, value), list(keys)).select(*keys, "mean", "median", "max")


def box_summary(df: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whiskers at the last data points within 1.5 quartile ranges, mean, standard error (0 for one), n."""
    held = df.where(F.col(value).isNotNull())
    q1, middle, q3 = (F.col(f"__{c}") for c in ("q1", "median", "q3"))
    rows = held.join(exact_quantiles(held, groups, value, {"__q1": 0.25, "__median": 0.5, "__q3": 0.75}), list(groups))
    inside = F.col(value).between(q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return rows.groupBy(*groups).agg(
        F.first(q1).alias("q1"),
        F.first(middle).alias("median"),
        F.first(q3).alias("q3"),
        F.min(F.when(inside & (F.col(value) <= q1), F.col(value))).alias("whisker_lo"),
        F.max(F.when(inside & (F.col(value) >= q3), F.col(value))).alias("whisker_hi"),
        F.avg(value).alias("mean"),
        sem0(value).alias("sem"),
        F.count(value).alias("n"),
    ).withColumn("whisker_lo", F.coalesce("whisker_lo", "q1")).withColumn("whisker_hi", F.coalesce("whisker_hi", "q3"))


def subjects_by_category(df: DataFrame, subject: str, category: str, value: str, group: str | None = None) -> DataFrame:
    """Mean and standard error over subjects' means, per category, overall and per group (``grp`` is 'all' for the former)."""
    own = df.groupBy(*([group] if group else []), subject, category).agg(F.avg(value).alias("__m"))
    both = own.withColumn("grp", F.explode(F.array(F.lit("all"), F.col(group).cast("string")))) if group else own.withColumn("grp", F.lit("all"))
    return both.groupBy("grp", category).agg(
        F.avg("__m").alias("mean"), F.when(F.count("__m") > 1, sem("__m")).alias("sem"), F.countDistinct(subject).alias("n_subjects")
    )


def correlations(samples: DataFrame, keys: Sequence[str], at: str = "sample", channel: str = "channel", value: str = "y") -> DataFrame:
    """(keys, a, b, r) for all channels a <= b that share samples: pairs are made within one sample, and summed before the shuffle."""
    own = samples.select(*keys, at, F.col(channel).alias("a"), F.col(value).alias("va"))
    other = samples.select(*keys, at, F.col(channel).alias("b"), F.col(value).alias("vb"))
    return own.join(other, [*keys, at]).where("a <= b").groupBy(*keys, "a", "b").agg(F.corr("va", "vb").alias("r"))


def correlation_scale(table: DataFrame, diverging: bool | None = None) -> DataFrame:
    """One row (lo, hi, kind): off-diagonal entries decide between a scale from 0 and one centred on 0."""
    ends = table.where("a <> b").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    kind = (F.col("lo") < 0) if diverging is None else F.lit(diverging)
    limit = F.greatest(F.abs("lo"), F.abs("hi"))
    return ends.select(
        F.when(kind, -limit).otherwise(0.0).alias("vmin"), F.when(kind, limit).otherwise(F.col("hi")).alias("vmax"),
        F.when(kind, "diverging").otherwise("sequential").alias("scale")
    )
