"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship, staged

__all__ = ["as_bytes", "blank_words", "letter_words", "map_text", "named", "rekeyed", "slices", "staged", "table"]

FOLDED = bytes(b if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in bytes(range(256)).lower())


def blank_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and cuts at ASCII white space, [\\x20\\x09-\\x0D]."""
    return text.lower().split()


def letter_words(text: bytes) -> list[bytes]:
    """Lower-cases A-Z and cuts at all ASCII but letters and digits."""
    return text.translate(FOLDED).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """The column of just this name, with dots or backticks in it; what goes to Arrow tasks is renamed, as Spark looks names up there as they stand."""
    return F.col(f"`{name.replace('`', '``')}`")


def rekeyed(key: Column | str) -> Column:
    """The same string key as an expression of its own.

    A join on it shuffles both sides, so that Spark may split a hot key's rows at run time;
    joined on the plain key, an aggregate's own partitioning would be kept and the other side could not be split.
    """
    return F.concat(F.col(key) if isinstance(key, str) else key, F.lit(""))


def as_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_text(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list[bytes]], list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """Appends columns that Python derives from a text column, batch by batch.

    ``make`` runs once per task and returns the function from texts (UTF-8, null as empty) to one Arrow array per field;
    the columns in ``keep`` pass through untouched.
    """
    n = len(keep)
    schema = T.StructType([*df.select(*[named(c) for c in keep]).schema.fields, *fields])
    source = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(text).alias("text"))
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for part in slices(batch):
                made = work(as_bytes(part.column(n)))
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *made], names=schema.names)
                pa.default_memory_pool().release_unused()  # workers outlive the task

    return source.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, mb: int = 2) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many MB, so that a worker's memory doesn't follow the batch."""
    step = max(1, int(batch.num_rows / max(1, batch.nbytes / (mb << 20))))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)
