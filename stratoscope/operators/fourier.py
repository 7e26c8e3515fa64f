"""The Hilbert transform of series that are longer than a task: a transform in columns and rows, with two shuffles between."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import KEYS
from ..shipping import ship

#: Columns, and rows, of a tile.
TILE = 32


def hilbert_kernel(n: int, k: np.ndarray) -> np.ndarray:
    """What a value gives to the transform k places later, k between -n and n, in a series of n that goes round."""
    angle = np.pi * (k % n) / n
    with np.errstate(divide="ignore", invalid="ignore"):
        odd = (k % n) % 2 != 0
        h = 1 / np.tan(angle) - np.where(odd, -1.0, 1.0) / np.sin(angle) if n % 2 else np.where(odd, 2 / np.tan(angle), 0.0)
    return np.where(k % n == 0, 0.0, h) / n


def _shape(n: int) -> tuple[int, int]:
    """Rows and columns of the table that a series of n, with as many zeros after it, is written into."""
    bits = (2 * n - 2).bit_length()
    return 1 << bits // 2, 1 << (bits - bits // 2)


def _twiddles(rows: np.ndarray, columns: np.ndarray, size: int) -> np.ndarray:
    return np.exp(-2j * np.pi * ((rows[:, None] * columns) % size) / size)


def with_hilbert(samples: DataFrame, value: str, series: Sequence[str] = KEYS) -> DataFrame:
    """``samples`` with ``hilbert``, the whole series' discrete Hilbert transform; samples are numbered 0, 1, ... without gaps or nulls.

    The transform of n values is their circular convolution with a known kernel, here a plain one over a table of 2 n places or more with
    about as many rows as columns: tasks transform columns (of the values, and of the kernel), then rows, multiply, and go back the same way.
    A task holds TILE columns or rows, so what it needs grows with the square root of the series. Equal to one transform up to rounding.
    """
    ship(samples.sparkSession)
    names = list(series)
    columns = F.expr("shiftleft(1L, length(bin(2 * __size - 2)) - cast(floor(length(bin(2 * __size - 2)) / 2) as int))")
    sized = samples.join(samples.groupBy(*names).agg(F.count("*").alias("__size")), names).withColumn("__q", F.floor((F.col("sample") % columns) / TILE).cast("long"))
    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in names)
    tiles = f"{kinds}, __size long, __q long, __r long, tile binary"

    def keyed(made: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        for name in reversed(names):
            made.insert(0, name, part[name].iloc[0])
        return made

    def down(part: pd.DataFrame) -> pd.DataFrame:
        n, q = int(part["__size"].iloc[0]), int(part["__q"].iloc[0])
        rows, cols = _shape(n)
        here = np.arange(q * TILE, min(cols, (q + 1) * TILE))
        table = np.zeros((2, rows, len(here)))
        at = part["sample"].to_numpy()
        table[0, at // cols, at % cols - here[0]] = part[value].to_numpy(float)
        place = np.arange(rows)[:, None] * cols + here
        back = place - rows * cols
        table[1] = np.where(place < n, hilbert_kernel(n, place), np.where(back > -n, hilbert_kernel(n, back), 0.0))
        made = np.fft.fft(table, axis=1) * _twiddles(np.arange(rows), here, rows * cols)
        parts = [made[:, r : r + TILE].tobytes() for r in range(0, rows, TILE)]
        return keyed(pd.DataFrame({"__size": n, "__q": q, "__r": np.arange(len(parts)), "tile": parts}), part)

    def across(part: pd.DataFrame) -> pd.DataFrame:
        n, r = int(part["__size"].iloc[0]), int(part["__r"].iloc[0])
        rows, cols = _shape(n)
        here = np.arange(r * TILE, min(rows, (r + 1) * TILE))
        part = part.sort_values("__q")
        both = np.concatenate([np.frombuffer(t, complex).reshape(2, len(here), -1) for t in part["tile"]], axis=2)
        both = np.fft.fft(both, axis=2)
        made = np.fft.ifft(both[0] * both[1], axis=1) * _twiddles(here, np.arange(cols), rows * cols).conj()
        parts = [np.ascontiguousarray(made[:, q * TILE : (q + 1) * TILE]).tobytes() for q in part["__q"]]
        return keyed(pd.DataFrame({"__size": n, "__q": part["__q"].to_numpy(), "__r": r, "tile": parts}), part)

    def up(part: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        n, q = int(part["__size"].iloc[0]), int(part["__q"].iloc[0])
        rows, cols = _shape(n)
        width = min(cols, (q + 1) * TILE) - q * TILE
        table = np.concatenate([np.frombuffer(t, complex).reshape(-1, width) for t in tiles.sort_values("__r")["tile"]])
        made = np.fft.ifft(table, axis=0).real
        at = part["sample"].to_numpy()
        return part.drop(columns=["__size", "__q"]).assign(hilbert=made[at // cols, at % cols - q * TILE])

    own = sized.select(*names, "__size", "__q", "sample", value)
    first = own.groupBy(*names, "__q").applyInPandas(down, tiles)
    second = first.groupBy(*names, "__r").applyInPandas(across, tiles)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in samples.schema.fields)
    return sized.select(*samples.columns, "__size", "__q").groupBy(*names, "__q").cogroup(second.groupBy(*names, "__q")).applyInPandas(up, f"{schema}, hilbert double")
