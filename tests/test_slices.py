"""One recording in many slices of time gives the rows of whole recordings."""

import random

import pytest
from pyspark.sql import functions as F

from stratoscope.operators import asof, segments

R = ("subject",)


def rows_of(df, *names):
    return sorted(tuple(map(repr, r)) for r in (df.select(*names) if names else df).collect())


@pytest.fixture(scope="module")
def tables(spark):
    """Times that tie and leave long pauses, rows without a time, a value or a key, one long and one short recording."""
    rng = random.Random(1)
    times = sorted(rng.choice([rng.randrange(0, 60), rng.randrange(300, 330), 700]) * 0.5 for _ in range(250))
    a = [("A", i, t, rng.choice([None, float(rng.randrange(9))])) for i, t in enumerate(times)]
    b = [("B", i, float(i), float(i % 3)) for i in range(5)] + [("A", 990, None, 1.0), (None, 1, 3.0, 2.0), (None, 2, 9.0, 4.0)]
    schema = "subject string, sample long, t double, y double"
    other = [("A", i, rng.uniform(-20, 380), float(i)) for i in range(120)] + [("B", 0, 2.0, 5.0), ("C", 0, 2.0, 5.0), (None, 0, 5.0, 7.0)]
    return spark.createDataFrame(a + b, schema), spark.createDataFrame(other, schema)


@pytest.mark.parametrize("width", [0.5, 7.0, 90.0, 1e6])
def test_neighbours_cross_slices(tables, width):
    own, other = tables
    for exact in (True, False):
        whole, cut = (asof.with_neighbours(own, other.withColumnRenamed("y", "z"), R, ("z",), exact_next=exact, slice_s=s) for s in (None, width))
        assert rows_of(whole) == rows_of(cut)
    for f in (asof.align_nearest, asof.hold_previous, asof.remap_linear):
        assert rows_of(f(own.drop("y"), other, keys=R)) == rows_of(f(own.drop("y"), other, keys=R, slice_s=width))


@pytest.mark.parametrize("width", [0.5, 7.0, 90.0, 1e6])
def test_runs_cross_slices(tables, width):
    own = tables[0].where(F.col("t").isNotNull())
    mask = F.col("y") > 3
    for gap in (None, 0.4, 20.0):
        whole, cut = (segments.masked_samples(own, mask, R, gap, s) for s in (None, width))
        assert set(whole.columns) == set(cut.columns) and rows_of(whole, *sorted(whole.columns)) == rows_of(cut, *sorted(whole.columns))
    whole, cut = (segments.detect_epochs(own, mask, "e", 1.0, 2.0, 5.0, R, s) for s in (None, width))
    assert rows_of(whole) == rows_of(cut)
    assert rows_of(segments.median_step(own, R)) == rows_of(segments.median_step(own, R, width))


def test_no_rows(tables):
    own, other = tables
    assert asof.align_nearest(own.where("false"), other, keys=R, slice_s=5.0).count() == 0
    assert segments.detect_epochs(own.where("false"), F.col("y") > 0, keys=R, slice_s=5.0).count() == 0
