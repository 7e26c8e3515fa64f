"""Peaks of long series against a plain search, with stretches so short that everything crosses their borders."""

import numpy as np
import pytest
from test_numeric import brute_peaks, frame

from stratoscope.functions import filters, peaks as kernel
from stratoscope.operators import peaks

R = ("subject",)


def shapes(seed):
    rng = np.random.default_rng(seed)
    n = 150
    zigzag = np.where(np.arange(n) % 2, 3.0, 0.0)
    return {
        "noise": rng.standard_normal(n), "plateaus": rng.integers(0, 4, n).astype(float), "rising": zigzag + np.arange(n) * 0.7, "falling": zigzag - np.arange(n) * 0.7,
        "valley": zigzag + np.abs(np.arange(n) - n / 2), "hill": zigzag - np.abs(np.arange(n) - n / 2), "walk": rng.standard_normal(n).cumsum(), "equal": zigzag, "flat": np.zeros(n),
        "waves": np.sin(np.arange(n) / 5) + np.sin(np.arange(n) / 31) * 3, "steps": np.repeat(rng.integers(0, 5, n // 10), 10).astype(float)
    }


def plainly(x, prominence, distance):
    """(onset, peak, trough) by whole-series searches."""
    found = brute_peaks(x, prominence, distance)
    ends = [0, *found, len(x)]
    return [(ends[k] + int(np.argmin(x[ends[k] : p + 1])), p, p + int(np.argmin(x[p : ends[k + 2]]))) for k, p in enumerate(found)]


@pytest.mark.parametrize("seed", range(4))
def test_linear_distance_rule(seed):
    for x in shapes(seed).values():
        for prominence, distance in ((0.0, 1), (0.5, 3), (1.0, 7), (0.1, 40), (0.0, 1000)):
            assert list(filters.prominent_peaks(x, prominence, distance)[0]) == brute_peaks(x, prominence, distance)


def test_many_peaks_are_settled_in_linear_time():
    n = 300_000
    state = kernel.settle(np.arange(n), np.random.default_rng(0).random(n), np.zeros(n, int), np.ones(n, bool), 1000)
    kept = np.flatnonzero(state == kernel.KEPT)
    assert np.diff(kept).min() >= 1000 and len(kept) > n / 2000


def test_open_neighbours_leave_peaks_open():
    i, v = np.array([0, 5, 10, 30]), np.array([4.0, 3.0, 2.0, 1.0])
    own = np.array([False, True, True, True])
    assert kernel.settle(i, v, np.zeros(4, int), own, 6).tolist() == [kernel.OPEN, kernel.OPEN, kernel.OPEN, kernel.KEPT]
    assert kernel.settle(i, v, np.array([kernel.KEPT, 0, 0, 0]), own, 6).tolist() == [kernel.KEPT, kernel.DROPPED, kernel.KEPT, kernel.KEPT]


def test_records_stand_for_a_stretch():
    rng = np.random.default_rng(1)
    for _ in range(200):
        left, here, right = (rng.integers(0, 6, rng.integers(0, 12)).astype(float) for _ in range(3))
        here = np.r_[here, 2.0]
        ended = [(np.r_[values, np.inf], np.r_[lows, np.min(x, initial=np.inf)]) for x in (left, right[::-1]) for values, lows in [kernel.records(x)]]
        sides = [kernel.as_stretch(*x) for x in ended]
        want = kernel.prominences(np.concatenate([left, here, right]), left[:0], left[:0])[len(left) : len(left) + len(here)]
        assert np.array_equal(kernel.prominences(here, *sides), want)


@pytest.mark.parametrize("chunk,prominence,distance", [(4, 0.0, 1), (7, 1.0, 5), (32, 0.5, 13), (1 << 16, 1.0, 3)])
def test_stretches_equal_the_whole(spark, chunk, prominence, distance):
    own = shapes(5)
    rows = [(name, i, float(i), float(v)) for name, x in own.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "subject string, sample long, t double, y double")
    made = peaks.prominence_events(df, prominence, float(distance), R, chunk).orderBy("subject", "peak_s").collect()
    for name, x in own.items():
        want = plainly(x, prominence, distance)
        got = [r for r in made if r.subject == name]
        assert [(r.onset_s, r.peak_s, r.trough_s) for r in got] == want, name
        heights = dict(zip(*filters.prominent_peaks(x, prominence, distance), strict=True))
        assert all(np.isclose(r.prominence, heights[int(r.peak_s)]) and r.peak_value == x[int(r.peak_s)] for r in got)


def test_peaks_with_gaps_are_dropped_alike_in_any_stretches(spark):
    x = np.random.default_rng(8).standard_normal(120)
    y = [None if i % 17 == 3 else v for i, v in enumerate(x)]
    whole, cut = (sorted(map(tuple, peaks.prominence_events(frame(spark, y), 0.5, 3.0, R, c).collect())) for c in (1 << 16, 9))
    assert whole and whole == cut


def test_short_series_and_no_rows(spark):
    assert peaks.prominence_events(frame(spark, [1.0, None, 2.0]), 0.0, 1.0, R).count() == 0
    assert peaks.prominence_events(frame(spark, [1.0, 2.0, 1.0]).where("false"), 0.0, 1.0, R).count() == 0
    assert [r.peak_s for r in peaks.prominence_events(frame(spark, [1.0, 2.0, 1.0]), 0.0, 1.0, R).collect()] == [1.0]
