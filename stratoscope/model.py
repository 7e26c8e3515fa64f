"""Names, schemas and adapters of the long sample layout.

A recording is named by (subject, session, task). Samples are long: one row per recording, source, channel and sample, with the time
``t`` in seconds from the recording's start and the value ``y``. NaN and infinities become null where data enters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ("subject", "session", "task")

_key_fields = [T.StructField(k, T.StringType()) for k in KEYS]
SAMPLES = T.StructType(
    [
        *_key_fields, T.StructField("source", T.StringType()), T.StructField("channel", T.StringType()), T.StructField("sample", T.LongType()),
        T.StructField("t", T.DoubleType()), T.StructField("y", T.DoubleType())
    ]
)
EPOCHS = T.StructType(
    [
        *_key_fields,
        T.StructField("epoch_id", T.LongType()),
        T.StructField("start_s", T.DoubleType()),
        T.StructField("end_s", T.DoubleType()),
        T.StructField("duration_s", T.DoubleType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("start_idx", T.LongType()),
        T.StructField("end_idx", T.LongType()),
    ]
)
EVENTS = T.StructType(
    [*_key_fields, T.StructField("event_type", T.StringType()), T.StructField("event_time", T.DoubleType()), T.StructField("condition", T.StringType())]
)


def finite(y: Column | str) -> Column:
    """The number, or null for NaN and infinities."""
    c = F.col(y) if isinstance(y, str) else y
    c = c.cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def ordered(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def before_and_now(keys: Sequence[str], *order: Column | str) -> WindowSpec:
    return ordered(keys, *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def everything(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as samples: a user is a subject, a week a session, an event type a channel, seconds since 2024 the time."""
    micros = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    t = (micros / F.lit(1e6)).cast("double")
    return read_table(spark, sf_dir, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("subject"),
        F.concat(F.lit("ses-"), F.lpad((F.floor(t / 604800) + 1).cast("string"), 2, "0")).alias("session"),
        F.lit("task-spont").alias("task"),
        F.lit("clicks").alias("source"),
        F.col("event_type").alias("channel"),
        F.col("event_id").alias("sample"),
        t.alias("t"),
        finite("value").alias("y"),
    )
