"""Users' own functions over recordings."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..model import KEYS
from ..shipping import ship


def to_frame(samples: DataFrame, extractor: Callable[[pd.DataFrame], pd.DataFrame | dict | None], schema: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows that a function makes of each recording's samples, keys first; None skips a recording. ``schema`` names what it adds.

    A recording is one group, as it is for the function; for ones that are larger than a worker see ``stream_of``.
    """
    ship(samples.sparkSession)
    names = list(keys)
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in names)
    columns = [*names, *[x.strip().split()[0] for x in schema.split(",")]]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        made = extractor(part)
        if made is None:
            return pd.DataFrame(columns=columns)
        rows = pd.DataFrame([made]) if isinstance(made, dict) else made.reset_index(drop=True).copy()
        for k in reversed(names):
            rows.insert(0, k, part[k].iloc[0])
        return rows[columns]

    return samples.groupBy(*names).applyInPandas(run, f"{kinds}, {schema}")


def stream_of(
    samples: DataFrame, start: Callable[[], Any], step: Callable[[Any, pd.DataFrame], tuple[Any, pd.DataFrame | dict | None]], schema: str,
    keys: Sequence[str] = KEYS, order: Sequence[str] = ("t", "sample"), end: Callable[[Any], pd.DataFrame | dict | None] | None = None
) -> DataFrame:
    """Rows that a function makes of each recording's samples as they come in order, keys first.

    ``start`` makes a recording's state, ``step`` takes the state and the next samples and gives the new state and rows or None, and ``end``
    takes the last state. Recordings are sorted by Spark, which spills, and a worker holds one Arrow batch of samples and one state: a
    recording may be of any length. How samples are cut into batches is Spark's choice, so a step must not depend on it. Null keys are one recording.
    """
    ship(samples.sparkSession)
    names = list(keys)
    kinds = ", ".join(f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in names)
    columns = [*names, *[x.strip().split()[0] for x in schema.split(",")]]

    def labelled(made: pd.DataFrame | dict | None, key: tuple) -> Iterator[pd.DataFrame]:
        if made is not None and len(rows := pd.DataFrame([made]) if isinstance(made, dict) else made.reset_index(drop=True).copy()):
            for name, value in reversed(list(zip(names, key, strict=True))):
                rows.insert(0, name, pd.Series([value] * len(rows), dtype=object))
            yield rows[columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            own = batch[names].astype(object).where(batch[names].notna(), None)
            new = (own.ne(own.shift()) & ~(own.isna() & own.shift().isna())).any(axis=1).to_numpy()
            new[0] = True
            cuts = [*new.nonzero()[0].tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                here = tuple(own.iloc[a])
                if key != here or state is None:
                    if key is not None and end is not None:
                        yield from labelled(end(state[0]), key)
                    key, state = here, (start(),)
                after, made = step(state[0], batch.iloc[a:b].reset_index(drop=True))
                state = (after,)
                yield from labelled(made, key)
        if key is not None and end is not None:
            yield from labelled(end(state[0]), key)

    dealt = samples.repartition(*names).sortWithinPartitions(*names, *order)
    return dealt.mapInPandas(run, f"{kinds}, {schema}")


def pooled(samples: DataFrame, extract: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Samples that a transform takes out, for a pooled reference."""
    return samples.transform(extract)
