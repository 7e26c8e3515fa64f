"""Selection and labelling of recordings."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import all_of, any_of, first_number, recorded
from ..model import KEYS


def _values(value) -> list:
    return list(value) if isinstance(value, Iterable) and not isinstance(value, (str, bytes)) else [value]


def _level(df: DataFrame, name: str) -> str | None:
    return next((c for c in df.columns if c.lower() == name.lower()), None)


def include(df: DataFrame, **levels) -> DataFrame:
    """Rows that match every level's value or list; names in any case, unknown ones ignored."""
    return df.where(all_of([F.col(c).isin(_values(v)) for k, v in levels.items() if (c := _level(df, k))]))


def exclude(df: DataFrame, **levels) -> DataFrame:
    """Rows that match no level."""
    return df.where(~F.coalesce(any_of([F.col(c).isin(_values(v)) for k, v in levels.items() if (c := _level(df, k))]), F.lit(False)))


def _dropped(df: DataFrame, spec, levels: Sequence[str]) -> Column:
    if isinstance(spec, Mapping):
        found = [F.col(c).isin(_values(v)) for k, v in spec.items() if (c := _level(df, str(k)))]
        return all_of(found) if found else F.lit(False)
    if isinstance(spec, tuple):
        found = [F.col(c).isin(_values(v)) for c, v in zip(levels, spec, strict=False)]
        return all_of(found) if found else F.lit(False)
    if isinstance(spec, Iterable) and not isinstance(spec, (str, bytes)):
        items = list(spec)
        if items and all(isinstance(x, (str, bytes)) or not isinstance(x, Iterable) for x in items):
            return _dropped(df, tuple(items), levels)
        return any_of([_dropped(df, x, levels) for x in items])
    return F.lit(False)


def drop_rows(df: DataFrame, spec, levels: Sequence[str] = KEYS) -> DataFrame:
    """Without the rows that a spec names: a mapping (all its levels), a tuple or flat list of values by position, or a collection of
    these (any of them)."""
    return df.where(~F.coalesce(_dropped(df, spec, levels), F.lit(False)))


def drop_listed(df: DataFrame, specs: DataFrame) -> DataFrame:
    """The same for a long table of specs with any of the key columns."""
    return df.join(specs.distinct(), [c for c in specs.columns if c in df.columns], "left_anti")


def recordings_of(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def one_recording(df: DataFrame, subject: str, session: str, task: str) -> DataFrame:
    """The rows of one recording; an error unless exactly one matches."""
    found = df.where((F.col("subject") == subject) & (F.col("session") == session) & (F.col("task") == task))
    if found.isEmpty():
        raise LookupError(f"no recording {subject}, {session}, {task}")
    return found


def recordings(df: DataFrame, task=None, subject=None, subjects=None, sessions=None) -> DataFrame:
    """Rows of all recordings that match; an error when there are none."""
    wanted = {"task": task, "subject": subject if subject is not None else subjects, "session": sessions}
    found = include(df, **{k: v for k, v in wanted.items() if v is not None})
    if found.isEmpty():
        raise LookupError(f"no recording matches {wanted}")
    return found


def first_recording(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keys of the first recording in the order of the keys."""
    return recordings_of(df, keys).orderBy(*keys).limit(1)


def listing(df: DataFrame, level: str) -> DataFrame:
    return df.select(level).distinct().orderBy(level)


def inventory(samples: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """(keys, source, channel, n, t_start_s, t_stop_s)."""
    return samples.groupBy(*keys, "source", "channel").agg(F.count("*").alias("n"), F.min("t").alias("t_start_s"), F.max("t").alias("t_stop_s"))


def recordings_per(df: DataFrame, level: str, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct().groupBy(level).agg(F.count("*").alias("n_recordings"))


def signals_of(samples: DataFrame, times: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Channels with at least max(1, half of the time column's length) samples; times: (keys, source, n_t)."""
    counted = samples.groupBy(*keys, "source", "channel").agg(F.count("*").alias("n"))
    return counted.join(times, [*keys, "source"]).where(F.col("n") >= F.greatest(F.lit(1), F.floor(0.5 * F.col("n_t"))))


def signal(samples: DataFrame, source: str, channel: str, required: bool = False) -> DataFrame:
    """A channel's samples of all recordings; with ``required`` it must be somewhere (one more look at the samples)."""
    if required:
        require_source(samples, source, channel)
    return samples.where((F.col("source") == source) & (F.col("channel") == channel))


def time_vector(samples: DataFrame, source: str, keys: Sequence[str] = KEYS, required: bool = False) -> DataFrame:
    """(keys, sample, t) of a source's times, whatever channels it has; with ``required`` it must be somewhere."""
    if required:
        require_source(samples, source)
    return samples.where(F.col("source") == source).groupBy(*keys, "sample").agg(F.first("t", True).alias("t"))


def _alike(names: DataFrame, column: str, wanted: str, most: int = 20) -> list[str]:
    """Names that are spelled most like a wanted one, the likest first; ``most`` of them are told."""
    found = names.select(F.col(column).alias("name")).where("name IS NOT NULL").distinct()
    return [r["name"] for r in found.orderBy(F.levenshtein(F.lower("name"), F.lit(wanted.lower())), "name").limit(most).collect()]


def require_source(samples: DataFrame, source: str, channel: str | None = None) -> None:
    """Fails if the source, or its channel, is nowhere in the samples, however many there are, and names those spelled most alike."""
    own = samples.where(F.col("source") == source)
    if own.isEmpty():
        raise LookupError(f"no source {source!r}; likest of those that are there: {_alike(samples, 'source', source)}")
    if channel is not None and own.where(F.col("channel") == channel).isEmpty():
        raise LookupError(f"no channel {channel!r} in {source!r}; likest of those that are there: {_alike(own, 'channel', channel)}")


def resolve_sources(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """``source`` by its canonical name; aliases: (alias, canonical)."""
    table = aliases.select(F.col("alias").alias("source"), "canonical")
    return df.join(table, "source", "left").withColumn("source", F.coalesce("canonical", "source")).drop("canonical")


def with_roles(df: DataFrame, specs: DataFrame) -> DataFrame:
    """role and unit per (source, channel), null where undeclared."""
    return df.join(specs.select("source", "channel", "role", "unit"), ["source", "channel"], "left")


def canonical_tasks(df: DataFrame, rules: DataFrame) -> DataFrame:
    """``task`` by its canonical name and its ``task_label``; rules: (alias, canonical, label), any of the latter two null."""
    names = rules.where(F.col("canonical").isNotNull()).select(F.col("alias").alias("task"), "canonical")
    labels = rules.where(F.col("label").isNotNull()).groupBy(F.coalesce("canonical", "alias").alias("task")).agg(F.min("label").alias("label"))
    named = df.join(names, "task", "left").withColumn("task", F.coalesce("canonical", "task")).drop("canonical")
    return named.join(labels, "task", "left").withColumn("task_label", F.coalesce("label", "task")).drop("label")


def with_conditions(df: DataFrame, rules: DataFrame, recorded_col: str = "recorded") -> DataFrame:
    """``condition``: declared for subject and session, else recorded, else declared for the session, else ''.

    rules: (subject, session, condition), subject null for rules of a session."""
    own = rules.where(F.col("subject").isNotNull()).groupBy("subject", "session").agg(F.min("condition").alias("__own"))
    any_subject = rules.where(F.col("subject").isNull()).groupBy("session").agg(F.min("condition").alias("__any"))
    joined = df.join(own, ["subject", "session"], "left").join(any_subject, "session", "left")
    return joined.withColumn("condition", F.coalesce("__own", recorded(F.col(recorded_col)), "__any", F.lit(""))).drop("__own", "__any")


def with_session_number(df: DataFrame, column: str = "session", out: str = "session_n", pattern: str = r"(\d+)") -> DataFrame:
    return df.withColumn(out, first_number(F.col(column), pattern))


def sorted_sessions(df: DataFrame, column: str = "session") -> DataFrame:
    return with_session_number(df.select(column).distinct(), column).orderBy("session_n", column)


def pick_feature(features: DataFrame, candidates: Sequence[str], groups: Sequence[str] = ("source",), column: str = "channel") -> DataFrame:
    """Per group the first candidate that exists, exact names before names in another case."""
    order = F.array(*[F.lit(c) for c in candidates])
    exact, loose = F.array_position(order, F.col(column)), F.array_position(F.transform(order, F.lower), F.lower(column))
    ranked = features.select(*groups, column).distinct().where(loose > 0).withColumn("__r", F.when(exact > 0, exact).otherwise(len(candidates) + loose))
    return ranked.groupBy(*groups).agg(F.min_by(column, "__r").alias("feature"))


def default_column(signals: DataFrame, specs: DataFrame, groups: Sequence[str] = ("source",)) -> DataFrame:
    """Per source the first column declared as a time series, else the first signal."""
    roles = with_roles(signals.select(*groups, "channel").distinct(), specs)
    rank = Window.partitionBy(*groups).orderBy(F.coalesce(F.col("role") == "timeseries", F.lit(False)).desc(), "channel")
    return roles.withColumn("__r", F.row_number().over(rank)).where("__r = 1").select(*groups, F.col("channel").alias("default_column"))


def clean_xy(samples: DataFrame) -> DataFrame:
    """Samples whose time and value are finite."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return samples.where(ok("t") & ok("y"))


def in_window(samples: DataFrame, window: tuple[float, float]) -> DataFrame:
    """Closed window; its ends may come in either order."""
    return samples.where(F.col("t").between(min(window), max(window)))


def window_bounds(samples: DataFrame, window: tuple[float, float], keys: Sequence[str] = KEYS) -> DataFrame:
    return in_window(samples, window).groupBy(*keys).agg(F.min("sample").alias("first_sample"), F.max("sample").alias("last_sample"))


def decimate(samples: DataFrame, step: int) -> DataFrame:
    return samples.where(F.col("sample") % step == 0)
