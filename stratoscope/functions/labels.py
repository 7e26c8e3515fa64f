"""Column functions of recording labels and region names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Region acronyms by functional group, and the narrower groups that traces are averaged over.
REGION_GROUPS: dict[str, tuple[str, ...]] = {
    "Vis": ("VISa", "VISal", "VISam", "VISl", "VISli", "VISp", "VISpl", "VISpm", "VISpor", "VISrl"),
    "SS": ("SSp-bfd", "SSp-ll", "SSp-m", "SSp-n", "SSp-tr", "SSp-ul", "SSp-un", "SSs"),
    "Mo": ("MOp", "MOs"),
    "Aud": ("AUDd", "AUDp", "AUDpo", "AUDv"),
    "RSP": ("RSPagl", "RSPd", "RSPv"),
    "Front": ("FRP", "ACAd", "PL"),
    "Other": ("TEa", "VISC"),
}
ROI_GROUPS: dict[str, tuple[str, ...]] = {
    "Motor": ("MOp", "MOs"),
    "Somatosensory": ("SSp-bfd", "SSp-ll", "SSp-m", "SSp-n", "SSp-tr", "SSp-ul", "SSp-un", "SSs"),
    "Visual primary": ("VISp",),
    "Visual higher": ("VISa", "VISal", "VISam", "VISl", "VISpm", "VISrl"),
    "Retrosplenial": ("RSPagl", "RSPd", "RSPv"),
}


def session_day(label: Column | str) -> Column:
    """The number of a whole label ses-NN; null otherwise."""
    return F.expr("cast(null as int)") if label is None else F.regexp_extract(F.trim(label), r"^ses-(\d+)$", 1).try_cast("int")


def trailing_number(label: Column | str) -> Column:
    return F.regexp_extract(label, r"(\d+)$", 1).try_cast("double")


def first_number(label: Column | str, pattern: str = r"(\d+)") -> Column:
    return F.regexp_extract(label, pattern, 1).try_cast("double")


def strip_prefix(value: Column, prefix: str) -> Column:
    """Without the prefix, whose case doesn't count."""
    return F.when(F.startswith(F.lower(value), F.lit(prefix.lower())), F.substring(value, len(prefix) + 1, 1 << 30)).otherwise(value)


def region_acronym(region: Column) -> Column:
    return F.regexp_replace(region, "^[LR]_", "")


def hemisphere(region: Column) -> Column:
    return F.when(region.rlike("^[LR]_"), F.substring(region, 1, 1))


def region_table(spark: SparkSession, groups: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(acronym, grp, grp_rank): a lookup of a few dozen rows."""
    rows = [(a, g, i) for i, (g, names) in enumerate((groups or REGION_GROUPS).items()) for a in names]
    return spark.createDataFrame(rows, "acronym string, grp string, grp_rank int")


def region_group(region: Column, groups: dict[str, tuple[str, ...]] | None = None, default: str | None = "Other") -> Column:
    """The region's functional group."""
    pairs = [(a, g) for g, names in (groups or REGION_GROUPS).items() for a in names]
    table = F.create_map(*[F.lit(x) for p in pairs for x in p])
    found = F.try_element_at(table, region_acronym(region))
    return found if default is None else F.coalesce(found, F.lit(default))


def roi_group(region: Column) -> Column:
    return region_group(region, ROI_GROUPS, None)


def mapped(column: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The value that the table gives; else ``default`` or null. For tables of literals; larger ones are joined."""
    if not table:
        return default if default is not None else F.lit(None).cast("string")
    found = F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), column)
    return found if default is None else F.coalesce(found, default)


def first_of(*columns: str) -> Column:
    """The first that isn't null."""
    return F.coalesce(*columns)


def recorded(value: Column) -> Column:
    """A recorded condition, or null where it says nothing."""
    return F.when(~F.lower(F.trim(value)).isin("", "nan", "none"), F.trim(value))


def condition_from_map(table: dict[str, str], keys: tuple[str, ...] = ("subject", "session", "task")) -> Column:
    """By 'subject,session,task', then by task, then 'all'."""
    return F.coalesce(mapped(F.concat_ws(",", *keys), table), mapped(F.col(keys[-1]), table), F.lit("all"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
