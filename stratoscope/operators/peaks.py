"""Prominent peaks of long series: stretches of time are searched by tasks of their own, and what one must know of others is carried over."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import peaks as kernel
from ..model import KEYS, everything, ordered
from ..shipping import ship, staged
from .asof import interpolate_own
from .segments import median_step

#: Samples of a stretch.
CHUNK = 1 << 16
PEAKS = "onset_s double, peak_s double, trough_s double, onset_value double, peak_value double, trough_value double, prominence double, amplitude double, rise_s double, constriction_s double"
ROW, PEAK, BEFORE, AFTER = range(4)
END = -1


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names)


def _labelled(made: pd.DataFrame, part: pd.DataFrame, names: Sequence[str]) -> pd.DataFrame:
    for name in reversed(names):
        made.insert(0, name, part[name].iloc[0])
    return made


def turning_points(samples: DataFrame, min_separation_s: float, series: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """(series, chunk, i, t, v, gaps, gap, apart, top): samples at which a series, its gaps filled, turns or rests, and its first and last.

    ``top`` is the place of the maximum that ends here (of a plateau the middle, rounded down), ``apart`` the least distance of peaks in samples.
    Series with fewer than three values have none.
    """
    filled = interpolate_own(samples.where(F.col("t").isNotNull()), "t", series)
    filled = filled.withColumn("__n", F.count("y").over(everything(series))).where("__n >= 3")
    w = ordered(series, "t", "sample")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    v = F.col("filled")
    rows = filled.select(
        *series, "t", v.alias("v"), F.col("y").isNull().alias("gap"), (F.row_number().over(w) - 1).cast("long").alias("i"),
        F.sum(F.col("y").isNull().cast("long")).over(upto).alias("gaps"), (v - F.lag(v).over(w)).alias("__in"), (F.lead(v).over(w) - v).alias("__out"),
    )
    start = F.last(F.when(F.coalesce(F.col("__in") != 0, F.lit(True)), F.struct("i", (F.col("__in") > 0).alias("up"))), True).over(ordered(series, "i").rowsBetween(Window.unboundedPreceding, 0))
    step = median_step(samples, series).select(*series, F.when(F.col("step") > 0, F.greatest(F.lit(1), F.rint(F.lit(float(min_separation_s)) / F.col("step")).cast("long"))).otherwise(1).alias("apart"))
    rows = rows.where(F.coalesce(F.col("__in") * F.col("__out") <= 0, F.lit(True))).withColumn("__start", start)
    top = F.when(F.col("__start.up") & (F.col("__out") < 0), F.floor((F.col("__start.i") + F.col("i")) / 2).cast("long"))
    return rows.join(step, list(series)).select(*series, F.floor(F.col("i") / chunk).cast("long").alias("chunk"), "i", "t", "v", "gaps", "gap", "apart", top.alias("top"))


def spaced(maxima: DataFrame, series: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """Of maxima (series, i, v, apart) those that no higher one within ``apart`` samples drops, higher ones first, of equal ones the later.

    A task settles the maxima of a stretch as far as those within the distance beyond its borders allow; what stays open is settled in
    the next round, from what the neighbours have settled. A round works on stretches with open maxima only.
    """
    names = list(series)
    width = F.greatest(F.lit(chunk), 4 * F.col("apart"))
    own = maxima.select(*names, "i", "v", "apart", F.floor(F.col("i") / width).cast("long").alias("cell"), width.alias("width"), F.lit(kernel.OPEN).alias("state"))
    schema = f"{_kinds(maxima, names)}, i long, v double, apart long, cell long, width long, state int"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        columns = [part[c].to_numpy() for c in ("i", "v", "state")]
        mine = (part["cell"] == part["at"]).to_numpy()
        state = kernel.settle(*columns, mine, int(part["apart"].iloc[0]))
        return part.drop(columns="at").assign(state=state)[mine]

    done, open_ = [], own
    while True:
        left = F.when(F.col("i") - F.col("cell") * F.col("width") < F.col("apart"), F.col("cell") - 1)
        right = F.when((F.col("cell") + 1) * F.col("width") - F.col("i") <= F.col("apart"), F.col("cell") + 1)
        dealt = open_.withColumn("at", F.explode(F.array_compact(F.array("cell", left, right))))
        if done:  # only where something is open
            dealt = dealt.join(open_.where(F.col("state") == kernel.OPEN).select(*names, F.col("cell").alias("at")).distinct(), [*names, "at"], "left_semi").select(*dealt.columns)
        made = staged(dealt.groupBy(*names, "at").applyInPandas(run, schema))
        still = made.where(F.col("state") == kernel.OPEN)
        done.append(made.where(F.col("state") == kernel.KEPT).select(*names, "i"))
        if still.isEmpty():
            break
        before = open_.where(F.col("state") == kernel.KEPT) if len(done) > 1 else None
        open_ = made.where(F.col("state") != kernel.DROPPED)
        open_ = open_.unionByName(before).dropDuplicates([*names, "i"]) if before is not None else open_
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.distinct() if len(done) > 1 else out


def _outlooks(rows: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records of each stretch to either side, what its peaks need from either side)."""
    schema = f"{_kinds(rows, names)}, chunk long, kind int, value double, before double, low double, lo_0 double, hi_0 double, lo_1 double, hi_1 double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["i", "kind"])
        rowed = part["kind"].to_numpy() == ROW
        v = part["v"].to_numpy()[rowed]
        peak = np.isin(part["i"].to_numpy()[rowed], part["i"].to_numpy()[~rowed])
        out = {c: [] for c in ("kind", "value", "before", "low")}
        needs = []
        for side, x, p in ((BEFORE, v, peak), (AFTER, v[::-1], peak[::-1])):
            values, lows = kernel.records(x)
            for c, col in zip(out, (np.full(len(values), side), values, np.r_[-np.inf, values[:-1]] if len(values) else values, lows), strict=True):
                out[c].append(col)
            reach = x[p & (np.maximum.accumulate(x) == x)]  # nothing higher before it in this stretch
            needs += [reach.min(), reach.max()] if len(reach) else [np.nan, np.nan]
        out["kind"].append([ROW])
        for c, x in (("value", v.max()), ("before", np.nan), ("low", v.min())):
            out[c].append([x])
        made = pd.DataFrame({c: np.concatenate(x) for c, x in out.items()}).assign(**{k: np.nan for k in ("lo_0", "hi_0", "lo_1", "hi_1")})
        made.loc[len(made) - 1, ["lo_0", "hi_0", "lo_1", "hi_1"]] = needs
        made.insert(0, "chunk", part["chunk"].iloc[0])
        return _labelled(made, part, names)

    made = staged(rows.groupBy(*names, "chunk").applyInPandas(run, schema))
    return made.where(F.col("kind") != ROW), made.where(F.col("kind") == ROW)


def _reach(stretches: DataFrame, names: list[str]) -> DataFrame:
    """Which stretches' records each stretch needs: (series, chunk, kind, of, above, hi, low), ``of`` END for the end of the series.

    A stack of stretches with falling maxima, from either end; a stretch that is passed on the way is taken off the stack, so the work is linear
    in the number of stretches, and a group holds a few numbers for each.
    """
    schema = f"{_kinds(stretches, names)}, chunk long, kind int, of long, above double, hi double, low double"

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("chunk")
        out = []
        for side, turned, lo, hi in ((BEFORE, part, "lo_0", "hi_0"), (AFTER, part[::-1], "lo_1", "hi_1")):
            # (chunk, its maximum, the lowest value after it and before the next of the stack, its own lowest value); the end is higher than all
            stack: list[tuple[int, float, float, float]] = [(END, np.inf, np.inf, np.inf)]
            for c, top, bottom, least, most in turned[["chunk", "value", "low", lo, hi]].itertuples(index=False):
                c = int(c)
                if not np.isnan(least):
                    above, low = least, np.inf
                    for j, high, after, floor in reversed(stack):
                        low = min(low, after)
                        if high > above:
                            out.append((c, side, j, above, most, low))
                            above = high
                        if high > most:
                            break
                        low = min(low, floor)
                after = np.inf
                while stack[-1][1] <= top:
                    _, _, a, floor = stack.pop()
                    after = min(after, a, floor)
                j, high, a, floor = stack[-1]
                stack[-1] = (j, high, min(a, after), floor)
                stack.append((c, top, np.inf, bottom))
        made = pd.DataFrame(out, columns=["chunk", "kind", "of", "above", "hi", "low"])
        return _labelled(made, part, names)

    return stretches.groupBy(*names).applyInPandas(run, schema)


def _carried(rows: DataFrame, names: list[str]) -> DataFrame:
    """(series, chunk, kind, v, low): the records before and after each stretch that its peaks can meet."""
    found, stretches = _outlooks(rows, names)
    needed = staged(_reach(stretches, names))
    far = found.select(*names, F.col("chunk").alias("of"), "kind", "value", "before", F.col("low").alias("__low"))
    met = needed.join(far, [*names, "of", "kind"]).where("value > above AND before <= hi")
    ends = needed.where(F.col("of") == END).select(*names, "chunk", "kind", F.lit(float("inf")).alias("v"), "low")
    return met.select(*names, "chunk", "kind", F.col("value").alias("v"), F.least("__low", "low").alias("low")).unionByName(ends)


def prominence_events(samples: DataFrame, prominence: float, min_separation_s: float, series: Sequence[str] = KEYS, chunk: int = CHUNK) -> DataFrame:
    """Peaks with the lowest sample since the peak before as onset and until the next as trough; gaps are interpolated in time for the
    search, and peaks with a gap between onset and trough are dropped. Series with fewer than three values give no rows.

    Only turning points matter. They are cut into stretches of ``chunk`` samples, whatever the series' length, and no task holds more than one:
    the distance rule is settled in rounds over stretches and their borders; a peak's lowest points on either side are found from the stretch and
    from records of others (values higher than all nearer ones, with the lowest value on the way), as far as its peaks reach; and onsets and
    troughs are the least of what the stretches between two peaks have.
    """
    ship(samples.sparkSession)
    names = list(series)
    points = staged(turning_points(samples, min_separation_s, series, chunk))
    last, widest = points.agg(F.max("chunk"), F.max("apart")).first()
    tops = points.where(F.col("top").isNotNull()).select(*names, F.col("top").alias("i"), "v", "apart")
    kept = spaced(tops, names, chunk) if (widest or 1) > 1 else tops.select(*names, "i")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("t", "double"), ("v", "double"), ("gaps", "long"), ("gap", "boolean"), ("low", "double"))]
    rows = points.select(*names, "chunk", F.lit(ROW).alias("kind"), "i", "t", "v", "gaps", "gap", none[4]).unionByName(
        kept.select(*names, F.floor(F.col("i") / chunk).cast("long").alias("chunk"), F.lit(PEAK).alias("kind"), "i", *none)
    )
    if last:
        rows = staged(rows)
        carried = _carried(rows, names)
        rows = rows.unionByName(carried.select(*names, "chunk", "kind", F.lit(None).cast("long").alias("i"), none[0], "v", *none[2:4], "low"))
    part_of = "chunk long, k long, peak boolean, peak_t double, peak_v double, height double, low_v double, low_i long, low_t double, low_gaps long, low_gap boolean"

    def find(part: pd.DataFrame) -> pd.DataFrame:
        kind = part["kind"].to_numpy()
        own = part[kind == ROW].sort_values("i")
        v, i = own["v"].to_numpy(), own["i"].to_numpy()
        sides = [kernel.as_stretch(*(part.loc[kind == s, c].to_numpy(float) for c in ("v", "low"))) for s in (BEFORE, AFTER)]
        which = np.searchsorted(i, np.sort(part.loc[kind == PEAK, "i"].to_numpy(np.int64)))
        heights = kernel.prominences(v, *sides)[which]
        which, heights = which[heights >= prominence], heights[heights >= prominence]
        starts = np.r_[0, which] if not len(which) or which[0] else which
        ends = np.r_[starts[1:], len(v)]
        lows = [a + int(np.argmin(v[a:b])) for a, b in zip(starts, ends, strict=True)]
        low = own.iloc[lows]
        headed = np.isin(starts, which)
        pick = lambda x: np.where(headed, x[starts], np.nan)
        tall = np.full(len(starts), np.nan)
        tall[headed] = heights
        made = pd.DataFrame(
            {
                "chunk": part["chunk"].iloc[0], "k": np.arange(len(starts)), "peak": headed, "peak_t": pick(own["t"].to_numpy()), "peak_v": pick(v), "height": tall, "low_v": low["v"].to_numpy(), "low_i": low["i"].to_numpy(),
                "low_t": low["t"].to_numpy(), "low_gaps": low["gaps"].to_numpy(np.int64), "low_gap": low["gap"].to_numpy(bool)
            }
        )
        return _labelled(made, part, names)

    parts = rows.groupBy(*names, "chunk").applyInPandas(find, f"{_kinds(samples, names)}, {part_of}")
    number = F.sum(F.col("peak").cast("long")).over(ordered(names, "chunk", "k").rowsBetween(Window.unboundedPreceding, 0))
    least = F.min(F.struct("low_v", "low_i", "low_t", "low_gaps", "low_gap"))
    head = F.max(F.when(F.col("peak"), F.struct("peak_t", "peak_v", "height")))
    between = parts.withColumn("n", number).groupBy(*names, "n").agg(least.alias("trough"), head.alias("p")).withColumn("onset", F.lag("trough").over(ordered(names, "n")))
    whole = F.col("trough.low_gaps") - F.col("onset.low_gaps") + F.col("onset.low_gap").cast("long") == 0
    return between.where(F.col("p").isNotNull() & whole).select(
        *names, F.col("onset.low_t").alias("onset_s"), F.col("p.peak_t").alias("peak_s"), F.col("trough.low_t").alias("trough_s"),
        F.col("onset.low_v").alias("onset_value"), F.col("p.peak_v").alias("peak_value"), F.col("trough.low_v").alias("trough_value"), F.col("p.height").alias("prominence"),
        (F.col("p.peak_v") - F.col("onset.low_v")).alias("amplitude"), (F.col("p.peak_t") - F.col("onset.low_t")).alias("rise_s"), (F.col("trough.low_t") - F.col("p.peak_t")).alias("constriction_s")
    )
