"""Users' functions over recordings that are larger than what a worker is given at once."""

import pandas as pd
import pytest

from stratoscope.plans import udf

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, "7")
    yield
    spark.conf.set(BATCH, before)


def running_total():
    """A function of a function, so that workers get it whole."""

    def step(state, part):
        assert len(part) <= 7
        return state + part["y"].sum(), part[["sample"]].assign(total=state + part["y"].cumsum())

    return step


def test_a_state_goes_through_a_recording_in_order(spark, small_batches):
    rows = [(k, i, float((i * 37) % 101), float(i % 5)) for k, n in (("A", 101), ("B", 3), ("C", 7), (None, 20)) for i in range(n)]
    df = spark.createDataFrame(rows, "subject string, sample long, t double, y double").repartition(5)
    made = udf.stream_of(df, lambda: 0.0, running_total(), "sample long, total double", ("subject",), end=lambda s: {"sample": -1, "total": s}).collect()
    want = pd.DataFrame(rows, columns=["subject", "sample", "t", "y"]).sort_values(["t", "sample"])
    for k in ("A", "B", "C", None):
        own = want[want["subject"].isna()] if k is None else want[want["subject"] == k]
        got = {r.sample: r.total for r in made if r.subject == k}
        assert got == {**dict(zip(own["sample"], own["y"].cumsum(), strict=True)), -1: own["y"].sum()}
    assert udf.stream_of(df.where("false"), lambda: 0.0, running_total(), "sample long, total double", ("subject",)).count() == 0


def test_steps_may_give_nothing(spark, small_batches):
    df = spark.createDataFrame([("A", i, float(i), 1.0) for i in range(30)] + [("B", 0, 0.0, 2.0)], "subject string, sample long, t double, y double")
    made = udf.stream_of(df, list, lambda s, part: ([*s, len(part)], None), "n long", ("subject",), end=lambda s: {"n": sum(s)}).collect()
    assert sorted((r.subject, r.n) for r in made) == [("A", 30), ("B", 1)]
