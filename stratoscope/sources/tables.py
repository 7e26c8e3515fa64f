"""Wide datasets to long tables, the recordings table, and the catalogue's views."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.labels import first_number
from ..model import KEYS
from ..operators.quantiles import exact_median

#: Short names of the session's scalars in the sessions view.
SESSION_FIELDS = {
    "sex": "session_config__sex",
    "genotype": "session_config__genotype",
    "cage_id": "session_config__cage_id",
    "dob": "session_config__DOB",
    "weight_g": "session_config__weight_g",
    "inj_vol_ml": "session_config__inj_vol_mL",
    "duration_s": "session_config__duration",
    "protocol": "session_config__protocol",
}


def open_dataset(spark: SparkSession, path: str) -> DataFrame:
    """A wide dataset in Parquet, or CSV with a header, one row per recording."""
    return spark.read.csv(path, header=True, inferSchema=True) if path.endswith(".csv") else spark.read.parquet(path)


def sql_name(*parts: str) -> str:
    return "__".join(parts).replace("-", "_").replace(" ", "_")


def wide_to_long(wide: DataFrame, source: str, features: dict[str, str], keys: Sequence[str] = KEYS) -> DataFrame:
    """A source's array cells as one row per sample: keys, sample and a column per feature; a feature that a recording lacks is null."""
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(wide.schema[c].dataType)).alias(sql_name(n)) for n, c in features.items()])
    rows = wide.select(*keys, F.posexplode(zipped).alias("sample", "__x"))
    return rows.select(*keys, F.col("sample").cast("long").alias("sample"), *[F.col(f"__x.{sql_name(n)}").alias(sql_name(n)) for n in features])


def split_features(wide: DataFrame, time: str, features: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """(features that fit the time vector in every recording, features that get a table of their own), from one aggregate."""
    row = wide.agg(*[F.coalesce(F.max((F.size(c) != F.size(time)) & F.col(c).isNotNull()), F.lit(False)).alias(n) for n, c in features.items()]).first()
    return {n: c for n, c in features.items() if not row[n]}, {n: c for n, c in features.items() if row[n]}


def recordings_table(wide: DataFrame, scalars: Sequence[str], keys: Sequence[str] = KEYS, labels: Sequence[str] = ()) -> DataFrame:
    """Keys, labels and scalar cells; maps, structs and arrays as JSON text, NaN as null."""
    return wide.select(*keys, *labels, *[_scalar(wide, c).alias(sql_name(c)) for c in scalars])


def _scalar(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    if isinstance(kind, (T.MapType, T.StructType, T.ArrayType)):
        return F.to_json(name)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def typed(df: DataFrame, *columns: str) -> DataFrame:
    """Text columns as bigint or double where no row loses anything, else as they are; 'nan' counts as null. One pass judges all."""
    own = {c: F.when(F.lower(F.trim(c)) != "nan", F.col(c)) for c in columns}
    whole = lambda c: F.bool_and(c.isNull() | c.try_cast("bigint").isNotNull() & ~F.contains(c, F.lit(".")))
    number = lambda c: F.bool_and(c.isNull() | c.try_cast("double").isNotNull())
    row = df.agg(*[f(c) for c in own.values() for f in (whole, number)]).first()
    kinds = ["bigint" if row[2 * i] else "double" if row[2 * i + 1] else "string" for i in range(len(columns))]
    return df.withColumns({name: c.try_cast(kind) for (name, c), kind in zip(own.items(), kinds, strict=True)})


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows under the old ones by name; columns that either lacks are null."""
    return old.unionByName(new, allowMissingColumns=True)


def sessions_view(recordings: DataFrame) -> DataFrame:
    """Labels, the session's first number, and the session's scalars by their short names."""
    labels = [c for c in (*KEYS, "task_label", "condition") if c in recordings.columns]
    fields = [(F.col(c).try_cast("int") if n == "duration_s" else F.col(c)).alias(n) for n, c in SESSION_FIELDS.items() if c in recordings.columns]
    return recordings.select(*labels, first_number(F.col("session")).try_cast("int").alias("ses_num"), *fields)


def coverage_view(sources: dict[str, DataFrame], keys: Sequence[str] = KEYS, time: str = "t") -> DataFrame:
    """(keys, source, n_samples, t_start_s, t_stop_s, rate_hz), the rate from the median step by sample."""
    parts = [df.select(*keys, F.lit(name).alias("source"), "sample", F.col(time).alias("t")) for name, df in sources.items()]
    return coverage(reduce(DataFrame.unionByName, parts), [*keys, "source"])


def coverage(samples: DataFrame, keys: Sequence[str] = (*KEYS, "source"), time: str = "t") -> DataFrame:
    """The same per any keys of one long table: one window over all series."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy("sample"))
    spans = samples.groupBy(*keys).agg(F.count("*").alias("n_samples"), F.min(time).alias("t_start_s"), F.max(time).alias("t_stop_s"))
    rates = exact_median(samples.withColumn("__dt", step), keys, "__dt", "__step")
    return spans.join(rates, list(keys)).select(*keys, "n_samples", "t_start_s", "t_stop_s", (1 / F.col("__step")).alias("rate_hz"))


def parcels_view(mesomap: DataFrame, channels: Sequence[str], keys: Sequence[str] = KEYS) -> DataFrame:
    """(parcel, hemisphere, region, n_recordings with a sample), one pass over the wide table."""
    counts = mesomap.groupBy(*keys).agg(*[F.count(c).alias(c) for c in channels])
    long = counts.unpivot(list(keys), list(channels), "parcel", "n")
    made = long.groupBy("parcel").agg(F.count_if(F.col("n") > 0).alias("n_recordings"))
    return made.select(
        "parcel", F.substring("parcel", 1, 1).alias("hemisphere"), F.substring("parcel", 3, 1 << 30).alias("region"), "n_recordings"
    ).orderBy("region", "hemisphere")


def mesomap_long_view(mesomap: DataFrame, channels: Sequence[str], recordings: DataFrame, keys: Sequence[str] = KEYS, time: str = "t") -> DataFrame:
    long = mesomap.unpivot([*keys, "sample", time], list(channels), "parcel", "dff").where(F.col("dff").isNotNull())
    labels = [c for c in (*keys, "task_label", "condition") if c in recordings.columns]
    return long.join(recordings.select(*labels), list(keys)).select(
        *labels, "sample", F.col(time).alias("time_s"), "parcel", F.substring("parcel", 1, 1).alias("hemisphere"),
        F.substring("parcel", 3, 1 << 30).alias("region"), "dff"
    )


def labelled_view(samples: DataFrame, recordings: DataFrame, columns: dict[str, str], keys: Sequence[str] = KEYS, time: str = "t") -> DataFrame:
    """Samples with their recording's labels."""
    labels = [c for c in ("task_label", "condition") if c in recordings.columns]
    return samples.join(recordings.select(*keys, *labels), list(keys)).select(
        *keys, *labels, "sample", F.col(time).alias("time_s"), *[F.col(c).alias(n) for n, c in columns.items()]
    )


def locomotion_view(treadmill: DataFrame, recordings: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Speed and distance with labels, and gap_s to the sample before: a gap means that the animal was still."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*keys).orderBy("sample"))
    return labelled_view(treadmill.withColumn("gap_s", gap), recordings, {"speed_mm_s": "speed_mm", "distance_mm": "distance_mm", "gap_s": "gap_s"}, keys)


def save_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """By suffix: .parquet, .json, else CSV with a header; a folder of part files, written where the data is."""
    writer = df.write.mode(mode)
    if path.endswith(".parquet"):
        writer.parquet(path)
    elif path.endswith(".json"):
        writer.json(path)
    else:
        writer.csv(path, header=True)
