"""Reference distributions per subject."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import exact_quantiles


def describe(reference: DataFrame, subject: str = "subject", value: str = "y") -> DataFrame:
    """(subject, n, mean, sd) of the finite samples."""
    return reference.where(F.col(value).isNotNull()).groupBy(subject).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) > 1, F.stddev_samp(value)).alias("sd")
    )


def zscores(values: DataFrame, reference: DataFrame, subject: str = "subject", value: str = "y") -> DataFrame:
    own = describe(reference, subject, value)
    return values.join(own, subject).withColumn("z", F.when(F.col("sd") > 0, (F.col(value) - F.col("mean")) / F.col("sd"))).drop("n", "mean", "sd")


def percentiles(values: DataFrame, reference: DataFrame, subject: str = "subject", value: str = "y") -> DataFrame:
    """Mid-rank percentile, 0 to 100, of each value in its subject's reference: ties count half.

    Reference and values are walked together per subject in one sort; subjects without a reference give null.
    """
    held = F.struct(*[F.col(c) for c in values.columns])
    both = values.select(F.col(subject).alias("__s"), F.col(value).alias("__v"), F.lit(0).alias("__r"), held.alias("__row")).unionByName(
        reference.where(F.col(value).isNotNull()).select(
            F.col(subject).alias("__s"), F.col(value).alias("__v"), F.lit(1).alias("__r")
        ), allowMissingColumns=True
    )
    upto = Window.partitionBy("__s").orderBy("__v")
    le = F.sum("__r").over(upto)
    eq = F.sum("__r").over(Window.partitionBy("__s", "__v"))
    n = F.sum("__r").over(Window.partitionBy("__s"))
    ranked = both.withColumn("__p", F.when((n > 0) & F.col("__v").isNotNull(), 100.0 * (2 * le - eq) / (2 * n)))
    return ranked.where("__r = 0").select("__row.*", F.col("__p").alias("percentile"))


def quantiles(reference: DataFrame, at: Sequence[float], subject: str = "subject", value: str = "y", exact: bool = True) -> DataFrame:
    """(subject, q, value): linear quantiles, or approximate ones in bounded memory."""
    if exact:
        found = exact_quantiles(reference, [subject], value, {f"q{i}": q for i, q in enumerate(at)})
        values = [F.col(f"q{i}") for i in range(len(at))]
    else:
        found = reference.groupBy(subject).agg(F.percentile_approx(value, list(at)).alias("__q"))
        values = [F.col("__q")[i] for i in range(len(at))]
    rows = F.array(*[F.struct(F.lit(float(q)).alias("q"), v.alias("value")) for q, v in zip(at, values, strict=True)])
    return found.select(subject, F.explode(rows).alias("__x")).select(subject, "__x.q", "__x.value")
