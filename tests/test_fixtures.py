"""Small cases with answers worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from stratoscope.functions import labels
from stratoscope.operators import asof, eta, intervals, locomotion, oscillation, preproc, reference, segments, select, spectral, summary
from stratoscope.sources import tables

R = ("subject",)


def series(spark, t, y, subject="A"):
    return spark.createDataFrame(
        [(subject, i, float(a), None if b is None else float(b)) for i, (a, b) in enumerate(zip(t, y, strict=True))],
        "subject string, sample long, t double, y double"
    )


def spans(spark, pairs, subject="A"):
    return spark.createDataFrame(
        [(subject, i, float(a), float(b)) for i, (a, b) in enumerate(pairs)], "subject string, epoch_id long, start_s double, end_s double"
    )


def column(df, name, order="sample"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_break_at_gaps(spark):
    made = segments.break_at_gaps(series(spark, [0, 0.1, 5.0, 5.1], [1, 2, 3, 4]), 1.0, R).orderBy("sample", "part").collect()
    assert [r.t for r in made] == [0, 0.1, None, 5.0, 5.1]


def test_session_day(spark):
    df = spark.createDataFrame([("ses-04",), (" ses-7 ",), ("baseline",), ("ses-04b",)], "s string")
    assert [r[0] for r in df.select(labels.session_day(F.col("s"))).collect()] == [4, 7, None, None]


def runs(df):
    return [(r.start_idx, r.end_idx) for r in df.orderBy("start_idx").collect()]


def test_runs_merges_and_lengths(spark):
    s = series(spark, range(5), [0, 1, 1, 0, 1])
    on = F.col("y") > 0
    assert runs(segments.mask_runs(s, on, R)) == [(1, 2), (4, 4)]
    assert column(segments.detect_epochs(s, on, keys=R), "duration_s", "start_idx") == [2.0, 1.0]
    assert runs(segments.detect_epochs(s, on, merge_gap_s=2.0, keys=R)) == [(1, 4)]
    assert runs(segments.detect_epochs(s, on, min_duration_s=1.5, keys=R)) == [(1, 2)]
    far = series(spark, [0, 1, 10], [1, 1, 1])
    assert runs(segments.mask_runs(far, on, R, 5.0)) == [(0, 1), (2, 2)]


def test_nearest_tie_goes_back_and_tolerance_is_inclusive(spark):
    ref = series(spark, [1.0], [0]).drop("y")
    made = asof.align_nearest(ref, series(spark, [0.5, 1.5], [10, 20]), 0.5, R).first()
    assert (made.source_t, made.y) == (0.5, 10.0)
    assert asof.align_nearest(ref, series(spark, [0.4, 1.6], [10, 20]), 0.5, R).first().y is None


def test_hold_and_linear(spark):
    src = series(spark, [1, 2], [10, 20])
    ref = series(spark, [0.5, 1.0, 1.9, 3], [0] * 4).drop("y")
    assert column(asof.hold_previous(ref, src, R), "y") == [10, 10, 10, 20]
    ref = series(spark, [0.5, 1.5, 3], [0] * 3).drop("y")
    assert column(asof.remap_linear(ref, src, R), "y") == [10, 15, 20]
    none = src.where("false")
    assert column(asof.remap_linear(ref, none, R), "y") == [0, 0, 0]
    assert column(asof.remap_linear(ref, src, R, gap_s=0.5, fill=-1.0), "y") == [10, 15, -1]


def test_event_interpolation_is_null_outside(spark):
    src = series(spark, [1, 2], [10, 20]).withColumn("channel", F.lit("x"))
    ev = spark.createDataFrame([("A", "e", 0, 1.5)], "subject string, event_type string, event_id long, event_time double")
    made = eta.epoch_traces(src, ev, (-1.0, 1.0), 0.5, R)
    assert column(made, "value", "rel_idx") == [None, 10, 15, 20, None]


def test_overlap_and_latency(spark):
    one = spans(spark, [(0, 10)]).withColumnRenamed("epoch_id", "interval_id")
    ep = spans(spark, [(-1, 2), (5, 6), (9, 12)])
    made = intervals.epoch_latency(one, ep, R).first()
    assert (made.n_overlapping, made.overlap_s, made.open_at_start, made.first_start_s, made.latency_s) == (3, 4.0, True, 5.0, 0.0)


def periods(spark, bouts, span):
    s = spark.createDataFrame([("A", *map(float, span))], "subject string, lo double, hi double")
    made = locomotion.quiescent_periods(spans(spark, bouts), s, keys=R).orderBy("start_s").collect()
    return [(r.start_s, r.end_s, r.next_bout, r.censored, r.opens_recording) for r in made]


def test_quiescent_periods(spark):
    assert periods(spark, [(2, 3), (5, 6)], (0, 8)) == [(0, 2, 0, False, True), (3, 5, 1, False, False), (6, 8, None, True, False)]
    assert periods(spark, [(9, 10)], (0, 8)) == [(0, 8, 0, False, True)]
    assert periods(spark, [], (0, 8)) == [(0, 8, None, True, True)]


def test_bout_statistics(spark):
    made = locomotion.bout_events(series(spark, [0, 1, 2], [10, 20, 30]), 5.0, keys=R).first()
    assert (made.mean_speed_cms, made.peak_speed_cms, made.time_to_peak_s, made.distance_m) == (20, 30, 2, 0.5)
    back = locomotion.bout_events(series(spark, [0, 1, 2], [-10, -20, -5]), 5.0, "backward", keys=R).first()
    assert (back.peak_speed_cms, back.time_to_peak_s, back.distance_m) == (-20, 1, -0.25)


def test_classes(spark):
    df = spark.createDataFrame([(3.0, -8.0), (2.9, 9.0), (1.0, 1.0), (5.0, 1.0)], "duration_s double, mean_speed_cms double")
    assert column(locomotion.classify_bouts(df), "bout_type", "duration_s") == ["Short & slow", "Short & fast", "Long & fast", "Long & slow"]


def test_errors_of_the_mean(spark):
    means = spark.createDataFrame(
        [("all", "e", "r", 0, 0.0, v) for v in (1.0, 3.0)],
        "condition string, event_type string, roi string, rel_idx long, rel_time double, mean double"
    )
    both = eta.group_means(means).first()
    assert (both.mean, both.sem) == (2.0, 1.0)
    assert eta.group_means(means.limit(1)).first().sem == 0.0
    assert summary.group_mean_sem(means.limit(1), ["roi"], "mean").first().sem is None


def test_mid_rank(spark):
    ref = spark.createDataFrame([("A", float(v)) for v in (1, 2, 2, 3)], "subject string, y double")
    assert reference.percentiles(spark.createDataFrame([("A", 2.0)], "subject string, y double"), ref).first().percentile == 50.0


def test_change_from_first(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("A", 2, 3.0)], "subject string, session_n int, v double")
    made = summary.change_from_first(df, ["v"]).orderBy("session_n").collect()
    assert [(r.d_v, r.pct_v) for r in made] == [(0.0, 0.0), (1.0, 0.5)]


def test_conditions(spark):
    rec = spark.createDataFrame(
        [("A", "s1", " NaN "), ("B", "s1", "drug"), ("C", "s2", None), ("D", "s1", "x")], "subject string, session string, recorded string"
    )
    rules = spark.createDataFrame([(None, "s1", "Baseline"), ("D", "s1", "own")], "subject string, session string, condition string")
    assert column(select.with_conditions(rec, rules), "condition", "subject") == ["Baseline", "drug", "", "own"]


def test_step_cleaning(spark):
    made = preproc.clean_steps(series(spark, [0, 0.1, 0.2, 0.3, 0.4], [1, 1, 9, 1, 1]), 2.0, None, 0.5, R)
    assert column(made, "flagged") == [False, True, True, True, False]
    assert column(made, "cleaned") == [1, 1, 1, 1, 1]


def test_peak_frequency_and_lag(spark):
    fs, n = 64.0, 64 * 20
    rng = np.random.default_rng(1)
    t = np.arange(n) / fs
    x = np.sin(2 * np.pi * 4 * t) + 0.01 * rng.standard_normal(n)
    y = np.sin(2 * np.pi * 4 * (t - 0.05)) + 0.01 * rng.standard_normal(n)
    rows = [("A", c, i, float(t[i]), float(v[i])) for c, v in (("x", x), ("y", y)) for i in range(n)]
    df = spark.createDataFrame(rows, "subject string, channel string, sample long, t double, y double")
    psd = spectral.welch(df, None, fs, 4.0, R)
    assert psd.where("channel = 'x'").orderBy(F.desc("power")).first().freq == 4.0
    cross = spectral.cross_spectra(df.where("channel = 'y'"), df.where("channel = 'x'").drop("channel"), None, fs, 4.0, 0.5, R)
    made = spectral.band_coupling(cross, (3.0, 5.0), ("subject", "channel")).first()
    assert made.lag_s == pytest.approx(0.05, abs=1e-3) and made.coherence > 0.99


def test_bosc_threshold():
    assert -math.log(1 - 0.95) == pytest.approx(2.995732, abs=1e-6)
    assert len(oscillation.bosc_frequencies((1.0, 8.0), 8)) == 25


def test_drop_rows(spark):
    df = spark.createDataFrame([("A", "s0", "t"), ("A", "s1", "t"), ("B", "s0", "u")], "subject string, session string, task string")
    left = lambda spec: sorted((r.subject, r.session) for r in select.drop_rows(df, spec).collect())
    assert left({"Session": "s0"}) == [("A", "s1")]
    assert left(["A", "s0"]) == [("A", "s1"), ("B", "s0")]
    assert left([("B",), {"session": "s1"}]) == [("A", "s0")]
    assert left({"nothing": 1}) == [("A", "s0"), ("A", "s1"), ("B", "s0")]


def test_one_recording_must_exist(spark):
    df = spark.createDataFrame([Row(subject="A", session="s", task="t")])
    assert select.one_recording(df, "A", "s", "t").count() == 1
    with pytest.raises(LookupError):
        select.one_recording(df, "B", "s", "t")


def test_wide_tables(spark, tmp_path):
    wide = spark.createDataFrame(
        [("A", [1.0, 2.0], [5.0, 6.0], [7.0]), ("B", [1.0], None, [8.0])], "subject string, t array<double>, a array<double>, b array<double>"
    )
    fit, split = tables.split_features(wide, "t", {"a": "a", "b": "b"})
    assert (list(fit), list(split)) == (["a"], ["b"])
    long = tables.wide_to_long(wide, "s", {"t": "t", "a": "a"}, R).orderBy("subject", "sample").collect()
    assert [(r.subject, r.sample, r.a) for r in long] == [("A", 0, 5.0), ("A", 1, 6.0), ("B", 0, None)]
    assert tables.sql_name("my-source", "a b") == "my_source__a_b"
    for suffix in ("x.parquet", "x.json", "x.csv"):
        tables.save_table(wide.select("subject"), str(tmp_path / suffix))
    assert tables.open_dataset(spark, str(tmp_path / "x.csv")).count() == 2
