"""The sweep over starts, ends and samples against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from stratoscope.operators import intervals, segments

R = ("subject",)


def tables(spark, seed):
    """Times that tie, intervals that nest, touch, are points or end before they start; rows without a time or a key."""
    rng = random.Random(seed)
    samples = [(rng.choice("AB"), i, float(rng.randrange(40))) for i in range(120)] + [("A", 900, None), (None, 901, 5.0), ("C", 902, 3.0)]
    spans = []
    for i in range(40):
        a = rng.randrange(-5, 42)
        spans.append((rng.choice("AB"), i, float(a), float(a + rng.choice([0, 0, 1, 3, 20, 100, -2]))))
    spans += [(None, 90, 0.0, 50.0), ("D", 91, 0.0, 50.0)]
    return samples, spans, spark.createDataFrame(samples, "subject string, sample long, t double"), spark.createDataFrame(spans, "subject string, span long, start_s double, end_s double")


def holds(s, p, closed):
    return s[0] is not None and s[2] is not None and s[0] == p[0] and p[2] <= s[2] and (s[2] <= p[3] if closed else s[2] < p[3])


@pytest.mark.parametrize("closed", [False, True])
def test_samples_in_intervals_equal_all_pairs(spark, closed):
    samples, spans, df, own = tables(spark, 3)
    for block in (1, 7, 4096):
        made = intervals.samples_in(df, own, R, closed, keep=["span"], block=block)
        assert sorted((r.sample, r.span) for r in made.collect()) == sorted((s[1], p[1]) for s in samples for p in spans if holds(s, p, closed))
    inside = {s[1] for s in samples if any(holds(s, p, closed) for p in spans)}
    assert sorted(r.sample for r in intervals.samples_in(df, own, R, closed, "left_semi").collect()) == sorted(inside)
    assert sorted(r.sample for r in intervals.samples_in(df, own, R, closed, "left_anti").collect()) == sorted({s[1] for s in samples} - inside)
    assert intervals.samples_in(df, own.where("false"), R, closed, "left_anti").count() == len(samples)
    assert intervals.samples_in(df.where("false"), own, R, closed).count() == 0


def test_a_long_interval_is_one_row(spark):
    df = spark.range(1000).select(F.lit("A").alias("subject"), F.col("id").alias("sample"), F.col("id").cast("double").alias("t"))
    own = spark.createDataFrame([("A", 0, -1e12, 1e12)], "subject string, span long, start_s double, end_s double")
    found = intervals.places(own, df, R, keep=["span"]).collect()
    assert [(r["__lo"], r["__hi"]) for r in found] == [(0, 1000)]
    assert intervals.samples_in(df, own, R, keep=["span"]).count() == 1000


@pytest.mark.parametrize("seed", range(3))
def test_overlaps_equal_all_pairs(spark, seed):
    _, spans, _, own = tables(spark, seed)
    _, asked, _, other = tables(spark, seed + 10)
    other = other.withColumnRenamed("span", "interval_id")
    made = {(r.subject, r.interval_id): r for r in intervals.epoch_latency(other, own, R).collect()}
    assert len(made) == len(asked)
    for k, i, a0, a1 in asked:
        met = [p for p in spans if k is not None and p[0] == k and p[2] <= p[3] and a0 <= a1 and p[2] < a1 and p[3] > a0]
        first = min((p[2] for p in spans if k is not None and p[0] == k and p[2] <= p[3] and a0 < p[2] < a1), default=None)
        open_ = any(p[2] <= a0 < p[3] for p in spans if k is not None and p[0] == k and p[2] <= p[3]) and a0 <= a1
        r = made[k, i]
        assert (r.n_overlapping, r.open_at_start, r.first_start_s) == (len(met), open_, first), (k, i, a0, a1)
        assert r.overlap_s == pytest.approx(sum(min(a1, p[3]) - max(a0, p[2]) for p in met))
        assert r.latency_s == (0.0 if open_ else None if first is None else first - a0)


def test_bounds_of_windows(spark):
    samples, spans, df, own = tables(spark, 5)
    made = segments.window_bounds(own.withColumnRenamed("span", "epoch_id"), df, R).collect()
    for r in made:
        times = sorted((s[2], s[1]) for s in samples if s[0] == r.subject and s[2] is not None)
        inside = [i for i, (t, _) in enumerate(times) if r.subject is not None and r.start_s <= t <= r.end_s]
        assert (r.start_idx, r.end_idx) == ((inside[0], inside[-1]) if inside else (None, None))
