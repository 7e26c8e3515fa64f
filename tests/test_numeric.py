"""Windowed operators against NumPy, and chunked ones against whole series."""

import numpy as np
import pytest

from stratoscope.functions import filters
from stratoscope.operators import fourier, oscillation, preproc, pupil, spectral

R = ("subject",)


def frame(spark, y):
    return spark.createDataFrame(
        [("A", i, float(i), None if v is None else float(v)) for i, v in enumerate(y)], "subject string, sample long, t double, y double"
    )


def values(df, name="y"):
    return np.array([r[name] for r in df.orderBy("sample").collect()], float)


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(3).standard_normal(700).cumsum() * 0.1 + np.random.default_rng(4).standard_normal(700)


@pytest.mark.parametrize(("window", "order"), [(5, 2), (7, 3), (9, 1)])
def test_polynomials(spark, noise, window, order):
    h, m = window // 2, filters.savgol_matrix(window, order)
    want = np.array(
        [
            m[i] @ noise[:window] if i < h else m[window - (len(noise) - i)] @ noise[-window:] if i > len(noise) - 1 - h else m[h] @ noise[i - h : i + h + 1] for i in range(len(noise))
        ]
    )
    assert np.allclose(values(preproc.fit_polynomials(frame(spark, noise), window, order, R)), want)
    line = 3 + 2 * np.arange(40.0)
    assert np.allclose(values(preproc.fit_polynomials(frame(spark, line), window, order, R)), line)


def test_short_series_stay(spark):
    assert list(values(preproc.smooth_median(frame(spark, [3, 1, 2]), 3, R))) == [3, 1, 2]
    assert list(values(preproc.smooth_savgol(frame(spark, [3, 1, 2, 9, 4]), 5.0, 1.0, 2, R))) == [3, 1, 2, 9, 4]
    with pytest.raises(ValueError):
        preproc.smooth_savgol(frame(spark, [1, 2, 3, 4]), 3.0, 1.0, 3, R)


@pytest.mark.parametrize("size", [3, 5, 9])
def test_median(spark, noise, size):
    h = size // 2
    padded = np.r_[noise[:h][::-1], noise, noise[-h:][::-1]]
    want = [np.median(padded[i : i + size]) for i in range(len(noise))]
    assert np.allclose(values(preproc.smooth_median(frame(spark, noise), size, R)), want)


def test_gaussian(spark, noise):
    w = filters.gaussian_weights(2.0)
    h = len(w) // 2
    padded = np.r_[noise[:h][::-1], noise, noise[-h:][::-1]]
    assert np.allclose(values(preproc.smooth_gaussian(frame(spark, noise), 2.0, R)), [w @ padded[i : i + len(w)] for i in range(len(noise))])


def test_bandpass_response():
    fs, band = 50.0, (3.1, 4.3)
    sos = filters.butter_bandpass(4, *band, fs)
    z = np.exp(2j * np.pi * np.array([3.1, 4.3, np.sqrt(3.1 * 4.3), 1.0, 12.0]) / fs)
    gain = np.abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, _, a1, a2 in sos], axis=0))
    assert np.allclose(gain[:2], np.sqrt(0.5), atol=1e-6) and gain[2] == pytest.approx(1, abs=1e-2) and (gain[3:] < 1e-3).all()
    assert max(np.abs(np.roots(s[3:])).max() for s in sos) == pytest.approx(0.97555, abs=1e-4)


def test_zero_phase_keeps_a_band_sine():
    t = np.arange(4000) / 50.0
    x = np.sin(2 * np.pi * 3.65 * t)
    y = filters.zero_phase(filters.butter_bandpass(4, 3.1, 4.3, 50.0), x)
    assert np.abs(y - x)[500:-500].max() < 1e-3
    assert np.allclose(np.abs(filters.analytic(np.cos(2 * np.pi * np.arange(100) / 20))), 1)


def test_chunks_equal_the_whole(spark):
    x = np.random.default_rng(5).standard_normal(6000)
    df = frame(spark, x)
    whole = values(oscillation.bandpass(df, 1.0, (0.1, 0.2), 4, None, False, R), "filtered")
    parts = values(oscillation.bandpass(df, 1.0, (0.1, 0.2), 4, 1000, False, R), "filtered")
    assert np.abs(whole - parts).max() < 1e-9
    assert np.allclose(whole, filters.zero_phase(filters.butter_bandpass(4, 0.1, 0.2, 1.0), x))
    a = [r.power for r in spectral.morlet_power(df, 1.0, [0.1], chunk=512, series=R).orderBy("sample").collect()]
    k = filters.morlet(0.1, 1.0)
    start = (len(k) - 1) // 2
    assert np.allclose(a, np.abs(np.convolve(x - x.mean(), k)[start : start + len(x)]) ** 2)


def test_kernel_is_the_transform():
    for n in (1, 2, 3, 8, 9, 30, 31):
        x = np.random.default_rng(n).standard_normal(n)
        made = [sum(x[s] * fourier.hilbert_kernel(n, np.array([t - s]))[0] for s in range(n)) for t in range(n)]
        assert np.allclose(made, filters.analytic(x).imag)


@pytest.mark.parametrize("n", [300, 301, 4099])
def test_transform_in_columns_and_rows_equals_the_whole(spark, n):
    rng = np.random.default_rng(n)
    own = {"A": rng.standard_normal(n).cumsum(), "B": rng.standard_normal(n // 3), "C": rng.standard_normal(n)}
    rows = [(k, i, float(i), float(v)) for k, x in own.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "subject string, sample long, t double, y double")
    made = fourier.with_hilbert(df, "y", R)
    assert made.columns == [*df.columns, "hilbert"]
    for k, x in own.items():
        assert np.allclose(values(made.where(f"subject = '{k}'"), "hilbert"), filters.analytic(x).imag, atol=1e-9 * np.abs(x).max() * 100)


def test_envelopes_do_not_depend_on_chunks(spark):
    """The series' two ends included; a short series beside a long one."""
    x = np.random.default_rng(15).standard_normal(3001)
    df = frame(spark, x).unionByName(frame(spark, x[:400]).withColumn("subject", oscillation.F.lit("B")))
    whole, parts = (oscillation.bandpass(df, 1.0, (0.1, 0.2), 4, c, True, R) for c in (None, 500))
    for k in "AB":
        a, b = ({c: values(d.where(f"subject = '{k}'"), c) for c in ("filtered", "envelope", "phase")} for d in (whole, parts))
        assert np.abs(a["filtered"] - b["filtered"]).max() < 1e-9 and np.abs(a["envelope"] - b["envelope"]).max() < 1e-8
        turn = a["phase"] - b["phase"]
        assert np.abs(np.angle(np.exp(1j * turn))).max() < 1e-6


def test_too_short_gives_no_bursts(spark):
    made = oscillation.OscillationDetector(1.0, (0.1, 0.2)).run(frame(spark, np.arange(20)), R)
    assert made.count() == 0
    with pytest.raises(ValueError):
        oscillation.OscillationDetector(1.0, (0.3, 0.2))


def test_bursts_of_a_planted_oscillation(spark):
    rng = np.random.default_rng(6)
    x = 0.1 * rng.standard_normal(3000)
    x[1000:1200] += 3 * np.sin(2 * np.pi * 0.15 * np.arange(200))
    made = oscillation.OscillationDetector(1.0, (0.1, 0.2), 4, None, 4.0, 20.0, 5.0).run(frame(spark, x), R).collect()
    assert len(made) == 1
    b = made[0]
    assert abs(b.start_s - 1000) < 25 and abs(b.end_s - 1200) < 25 and b.frequency_hz == pytest.approx(0.15, abs=0.01) and b.start_s < b.confirmed_s < b.end_s
    episodes = oscillation.bosc_episodes(
        frame(spark, x), 1.0, (0.1, 0.2), (0.05, 0.4), 4, chunk=512, series=R
    )["episodes"].orderBy(oscillation.F.desc("duration_s")).first()
    assert abs(episodes.start_s - 1000) < 60 and 0.1 <= episodes.frequency_hz <= 0.2


def brute_peaks(x, prominence, distance):
    peaks, i = [], 1
    while i < len(x) - 1:
        j = i
        while j < len(x) - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < len(x) - 1 and x[j + 1] < x[i]:
            peaks.append((i + j) // 2)
        i = j + 1
    kept = set(peaks)
    for p in sorted(peaks, key=lambda p: (x[p], p), reverse=True):
        if p in kept:
            kept -= {q for q in kept if q != p and abs(q - p) < distance}
    out = []
    for p in sorted(kept):
        sides = []
        for step in (-1, 1):
            low, k = x[p], p
            while 0 <= k < len(x) and x[k] <= x[p]:
                low = min(low, x[k])
                k += step
            sides.append(low)
        if x[p] - max(sides) >= prominence:
            out.append(p)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_peaks(spark, seed):
    x = np.random.default_rng(seed).integers(0, 9, 200).astype(float)
    want = brute_peaks(x, 3.0, 4)
    assert list(filters.prominent_peaks(x, 3.0, 4)[0]) == want
    made = pupil.prominence_events(frame(spark, x), 3.0, 4.0, R).orderBy("peak_s").collect()
    assert [int(r.peak_s) for r in made] == want
    ends = [0, *want, len(x)]
    for k, r in enumerate(made):
        p = want[k]
        assert r.onset_value == x[ends[k] : p + 1].min() and r.trough_value == x[p : ends[k + 2]].min() and r.amplitude == r.peak_value - r.onset_value


def test_spatial_components(spark):
    rng = np.random.default_rng(7)
    n = 64 * 40
    hidden, mix = np.sin(2 * np.pi * 0.18 * np.arange(n)), np.array([1.0, -0.5, 0.25])
    x = hidden[:, None] * mix + 0.3 * rng.standard_normal((n, 3)).cumsum(axis=0) * 0.1 + 0.3 * rng.standard_normal((n, 3))
    rows = [("A", f"c{k}", i, float(i), float(x[i, k])) for k in range(3) for i in range(n)]
    df = spark.createDataFrame(rows, "subject string, channel string, sample long, t double, y double")
    m = spectral.epoch_matrix(df, None, 1.0, 64.0, 0.5, R)
    top = spectral.ssd_scan(m, [0.18], 0.02, (0.04, 0.08), keys=R).orderBy("channel").collect()
    assert np.allclose([r.pattern for r in top], mix, atol=0.1) and top[0].ratio > 5
    both = spectral.ssd(m, (0.16, 0.2), [(0.08, 0.12), (0.24, 0.28)], keys=R).where("component = 0").orderBy("channel").collect()
    assert np.allclose([r.pattern / both[0].pattern for r in both], mix, atol=0.1)
