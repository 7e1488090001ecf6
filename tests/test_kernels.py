import random

import numpy as np
import pytest

from ridgeline.operators import signal
from ridgeline.operators.bench import fit, ideal_displacement, period_of

from . import whole_signal as whole


def test_savgol_is_exact_on_cubics():
    t = np.arange(40) * 0.1
    y = 2 + t - 3 * t**2 + 0.5 * t**3
    assert np.allclose(whole.savgol(y, 0.1, 1), 1 - 6 * t + 1.5 * t**2)
    assert np.allclose(whole.savgol(y, 0.1, 2), -6 + 3 * t)
    assert np.allclose(whole.savgol(y[:7], 0.1, 1), (1 - 6 * t + 1.5 * t**2)[:7])
    gap = y.copy()
    gap[5] = np.nan
    assert np.isfinite(whole.savgol(gap, 0.1, 1)).all()
    assert np.allclose(whole.savgol(np.array([1.0, 3.0]), 1.0, 1), [2, 2])


@pytest.mark.parametrize("order", [1, 2, 3, 4, 5])
def test_butterworth(order):
    rate, cut = 200.0, 15.0
    sos = signal.butterworth_sos(order, cut, rate)

    def gain(f):
        z = np.exp(-2j * np.pi * f / rate)
        return abs(np.prod([(b0 + b1 * z + b2 * z * z) / (1 + a1 * z + a2 * z * z) for b0, b1, b2, _, a1, a2 in sos]))

    assert gain(0) == pytest.approx(1) and gain(cut) == pytest.approx(0.5**0.5)
    t = np.arange(2000) / rate
    y = np.sin(2 * np.pi * t)
    assert np.abs(whole.lowpass(y + 0.5, rate, cut, order) - y - 0.5)[100:-100].max() < 0.01 if order > 1 else True
    assert np.allclose(whole.lowpass(np.full(200, 3.0), rate, cut, order), 3)
    assert whole.lowpass(np.array([1.0, np.nan, 2.0]), rate, cut, order) is None
    with pytest.raises(ValueError):
        signal.butterworth_sos(2, 120, rate)


def test_peaks():
    y = np.array([0, 3, 3, 0, 5, 1, 2, 0, 9.0])
    assert signal.find_peaks(y).tolist() == [1, 4, 6]
    assert whole.find_peaks(y, distance=3).tolist() == [1, 4]
    assert whole.find_peaks(y, prominence=2).tolist() == [1, 4]
    assert signal.find_peaks(np.zeros(5)).tolist() == []


def test_phased():
    y = np.array([-2, -2, 0, 0, 2, 2, 0, -2, 0, 2.0])
    assert whole.phased_crossings(y, -1, 1).tolist() == [4, 9]
    assert whole.phased_crossings(y, -1, 1, (2, 2, 1)).tolist() == [4]
    assert whole.phased_crossings(y, -1, 1, direction="falling").tolist() == [7]
    assert whole.phased_crossings(y, -1, 1, direction="either").tolist() == [4, 7, 9]


def test_period_and_fit():
    t = np.arange(4000) / 200
    y = ideal_displacement(2 * np.pi * (t - 0.3) / 1.25, 20, 120) / 0.02
    assert period_of(t, y) == pytest.approx(1.25, rel=0.01)
    p, shift, scale, rms = fit(t, y, 20, 120, 1.25)
    assert p == pytest.approx(1.25, rel=0.002) and scale == pytest.approx(0.02, rel=0.02) and rms < 0.3


def test_periods_over_blocks_are_those_of_whole_captures(spark):
    from ridgeline.operators.bench import periods

    rng = np.random.default_rng(6)
    series = {f"p{p}n{n}": np.sin(2 * np.pi * np.arange(n) / p + 1) * 5 + rng.normal(size=n) * 0.3 for p, n in ((12.5, 400), (33, 1000), (60, 257), (9, 5), (9, 3), (17, 64))}
    series |= {"flat": np.full(50, 2.0), "falling": -np.arange(90.0)}
    rows = [(s, i, i * 0.1, float(v)) for s, y in series.items() for i, v in enumerate(y)]
    frame = spark.createDataFrame(rows, "s string, sample_idx long, t double, y double").repartition(4)
    for block in (128, 1 << 16):
        got = {r.s: r.period_s for r in periods(frame, ["s"], "t", "y", 6.0, 100.0, block).collect()}
        for s, y in series.items():
            want = period_of(np.arange(len(y)) * 0.1, y, 6.0, 100.0)
            assert got[s] is None if np.isnan(want) else got[s] == pytest.approx(want, abs=1e-6), s


def machine(y, level, h):
    armed, out = True, []
    for i in range(1, len(y)):
        if y[i] is None or y[i - 1] is None:
            pass
        elif armed and y[i - 1] < level <= y[i]:
            out.append(i)
            armed = False
        if y[i] is not None and y[i] <= level - h:
            armed = True
    return out


@pytest.mark.parametrize("h", [0.0, 0.25, 0.7])
def test_crossings_against_state_machine(spark, h):
    from ridgeline.operators.series import threshold_crossings

    rng = random.Random(3)
    series = {}
    for s in range(40):
        x, y = 0.0, []
        for _ in range(80):
            x += rng.gauss(0, 0.4)
            y.append(None if rng.random() < 0.05 else x)
        series[s] = y
    df = spark.createDataFrame([(s, i, v) for s, y in series.items() for i, v in enumerate(y)], "s int, sample_idx long, y double")
    got = {}
    for r in threshold_crossings(df, ["s"], "y", 0.25, h).collect():
        got.setdefault(r.s, []).append(r.sample_idx)
    for s, y in series.items():
        assert sorted(got.get(s, [])) == machine(y, 0.25, h)
