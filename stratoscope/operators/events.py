"""Point-event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS


def make_events(times: DataFrame, columns: dict[str, str], keys: Sequence[str] = KEYS, condition: str | None = None) -> DataFrame:
    """One row per non-null time: ``columns`` maps an event type to the column (double or array of double) that holds its times."""
    rows = F.array(
        *[
            F.struct(F.lit(k).alias("event_type"), (F.col(c) if times.schema[c].dataType.typeName() == "array" else F.array(c)).alias("times")) for k,
            c in columns.items()
        ]
    )
    held = [F.col(condition).alias("condition")] if condition else []
    made = times.select(*keys, *held, F.explode(rows).alias("__r")).select(
        *keys, *[x.alias("condition") for x in held[:0]], *(["condition"] if condition else []), F.col("__r.event_type").alias("event_type"),
        F.explode("__r.times").alias("event_time")
    )
    return made.where(F.col("event_time").isNotNull())


def onsets_and_offsets(epochs: DataFrame, onset: str = "onset", offset: str = "offset", keys: Sequence[str] = KEYS) -> DataFrame:
    """Starts and ends of epochs as events."""
    return make_events(epochs, {onset: "start_s", offset: "end_s"}, keys)
