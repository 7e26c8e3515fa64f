"""Bouts and summaries of unbounded sample streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship


def stream_bouts(
    samples: DataFrame, least: float, merge_gap: str = "30 seconds", watermark: str = "5 minutes", time: str = "ts", value: str = "y",
    key: str = "subject"
) -> DataFrame:
    """Sessions of samples at or above ``least`` that are no more than ``merge_gap`` apart, with count, mean and peak; late rows go by the watermark."""
    kept = samples.withWatermark(time, watermark).where(F.col(value) >= least)
    made = kept.groupBy(key, F.session_window(time, merge_gap).alias("w")).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("peak"), F.min(time).alias("start_ts"), F.max(time).alias("end_ts")
    )
    return made.drop("w")


def stream_summary(
    samples: DataFrame, width: str = "1 hour", slide: str | None = None, watermark: str = "1 hour", time: str = "ts", value: str = "y",
    key: str = "channel"
) -> DataFrame:
    """Counts, means and maxima in tumbling or sliding windows."""
    made = samples.withWatermark(time, watermark).groupBy(F.window(time, width, slide or width).alias("w"), key).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max")
    )
    return made.select(F.col("w.start").alias("window_start"), key, "n", "mean", "max")


CONFIRMED = "subject string, start_s double, confirmed_s double"


def confirmed_bouts(
    samples: DataFrame, least: float, min_duration_s: float, merge_gap_s: float, watermark: str = "5 minutes", time: str = "ts", key: str = "subject"
) -> DataFrame:
    """(subject, start_s, confirmed_s) as soon as a bout has lasted ``min_duration_s``: once per bout, without looking ahead.

    State per subject is the open bout's start, last sample and whether it was reported; it goes once the watermark is past the pause that ends the bout.
    Within a micro-batch samples are taken in the order of time, for which a subject's times at or above ``least`` are held, 8 bytes each;
    samples that are older than the state's last one, or than the watermark, are dropped, and those without a time or value.
    """
    ship(samples.sparkSession)

    def step(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:  # the watermark is past the last sample and the pause that ends a bout
            state.remove()
            return
        start, last, told = state.get if state.exists else (None, -1e300, False)
        out, latest, times = [], 0, []
        for part in parts:  # a subject's rows come in several parts, in no order of time
            latest = max(latest, int(part["ms"].max()))
            times.append(part["t"].to_numpy()[part["t"] > last])
        t = np.concatenate(times)
        t.sort()
        if len(t):
            opens = np.diff(t, prepend=last) > merge_gap_s
            opens[0] |= start is None
            bout = np.cumsum(opens)  # 0 is the state's
            begin = np.concatenate([[np.nan if start is None else start], t[opens]])[bout]
            found, at = np.unique(bout[t - begin >= min_duration_s], return_index=True)
            when = t[t - begin >= min_duration_s][at]
            new = ~((found == 0) & told)
            out += zip(begin[np.searchsorted(bout, found[new])], when[new], strict=True)
            told = bool((len(found) and found[-1] == bout[-1]) or (bout[-1] == 0 and told))
            start, last = float(begin[-1]), float(t[-1])
        if start is not None:
            state.update((start, last, told))
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + int(merge_gap_s * 1000) + 1)
        yield pd.DataFrame({"subject": [keys[0]] * len(out), "start_s": [x for x, _ in out], "confirmed_s": [x for _, x in out]})

    high = samples.withWatermark(time, watermark).where((F.col("y") >= least) & ~F.isnan("y") & F.col("t").isNotNull() & F.col(time).isNotNull())
    held = high.select(F.col(key).alias("subject"), time, F.unix_millis(time).alias("ms"), "t")
    return held.groupBy("subject").applyInPandasWithState(step, CONFIRMED, "start double, last double, told boolean", "append", GroupStateTimeout.EventTimeTimeout)


def drain(df: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there now, in append mode, into Parquet below ``path``, and reads that."""
    query = df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
