"""Kernels over blocks against the same over whole sessions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.operators import signal

from . import whole_signal as whole

SIZES = [1, 2, 3, 7, 10, 11, 31, 32, 33, 63, 64, 65, 96, 130, 257]
BLOCK = 32
WAYS = [BLOCK, None]


def _series(kind, n, seed):
    rng = np.random.default_rng(seed)
    if kind == "steps":
        y = np.repeat(rng.integers(-3, 4, n), rng.integers(1, 40, n))[:n].astype(float)
    elif kind == "stairs":
        y = np.arange(n) + 3.0 * (np.arange(n) % 2) + 40 * (np.arange(n) // 90 % 2)
    else:
        y = np.cumsum(rng.normal(size=n)) + rng.normal(size=n)
    return y


@pytest.fixture(scope="module")
def series():
    out = {}
    for kind in ("walk", "steps", "stairs"):
        for k, n in enumerate(SIZES):
            y = _series(kind, n, k)
            out[f"{kind}{n}"] = y
            gaps = y.copy()
            gaps[np.random.default_rng(k).random(n) < 0.4] = np.nan
            if n > 96:
                gaps[20:90] = np.nan
            out[f"{kind}{n}gaps"] = gaps
    return out | {"nothing": np.full(70, np.nan), "flat": np.full(70, 2.0), "late": np.r_[np.full(80, np.nan), 1.0, 5.0, 2.0]}


@pytest.fixture(scope="module")
def frame(spark, series):
    rows = [(s, i, None if np.isnan(v) else float(v), "x") for s, y in series.items() for i, v in enumerate(y)]
    return spark.createDataFrame(rows, "session string, sample_idx long, y double, low string").repartition(5).persist()


def _by_session(df, series, *names):
    out = {s: {n: np.full(len(y), np.nan) for n in names} for s, y in series.items()}
    rows = df.select("session", "sample_idx", *names).collect()
    assert len(rows) == sum(map(len, series.values()))
    for r in rows:
        for n in names:
            if r[n] is not None:
                out[r.session][n][r.sample_idx] = r[n]
    return out


@pytest.mark.parametrize("block", WAYS)
@pytest.mark.parametrize(("window", "order"), [(11, 3), (5, 2), (31, 4)])
def test_savgol(spark, frame, series, window, order, block):
    got = _by_session(signal.derivatives(frame, ["session"], "y", 20.0, window, order, block=block), series, "vel", "acc")
    for s, y in series.items():
        for n, d in (("vel", 1), ("acc", 2)):
            assert np.allclose(got[s][n], whole.savgol(y, 1 / 20, d, window, order), rtol=1e-8, atol=1e-6, equal_nan=True), (s, n)


@pytest.mark.parametrize(("order", "block"), [(1, BLOCK), (2, BLOCK), (3, None), (4, BLOCK), (4, None)])
def test_butterworth(spark, frame, series, order, block):
    wanted = {"soft": ("y", 2.0, order), "softer": ("y", 0.5, 2)}
    got = _by_session(signal.lowpass_columns(frame, ["session"], wanted, 20.0, {"soft": "rest"}, block=block), series, "soft", "softer", "rest")
    for s, y in series.items():
        for n, (_, cut, k) in wanted.items():
            want = whole.lowpass(y, 20.0, cut, k)
            want = np.full(len(y), np.nan) if want is None else want
            assert np.allclose(got[s][n], want, rtol=1e-9, atol=1e-9, equal_nan=True), (s, n)
        assert np.allclose(got[s]["rest"], y - got[s]["soft"], equal_nan=True)


@pytest.mark.parametrize("direction", ["rising", "falling", "either"])
@pytest.mark.parametrize(("dwell", "smooth"), [((1, 1, 1), 1), ((2, 1, 3), 1), ((5, 2, 40), 1), ((1, 1, 2), 4)])
def test_phased(spark, frame, series, dwell, smooth, direction):
    _phased(frame, series, dwell, smooth, direction, BLOCK)
    if direction == "either":
        _phased(frame, series, dwell, smooth, direction, None)


def _phased(frame, series, dwell, smooth, direction, block):
    got = signal.phased(frame, ["session"], "y", -0.7, 0.8, dwell, smooth, direction, block=block)
    found = {(r.session, r.sample_idx) for r in got.collect()}
    want = {(s, int(i)) for s, y in series.items() if len(y) >= smooth for i in whole.phased_crossings(y, -0.7, 0.8, dwell, smooth, direction)}
    assert {x for x in found if len(series[x[0]]) >= smooth} == want
    assert got.columns == ["session", "sample_idx", "y", "low", "strength"]


@pytest.mark.parametrize(("kind", "block"), [("max", BLOCK), ("min", BLOCK), ("max", None)])
@pytest.mark.parametrize(("distance", "prominence"), [(1, None), (3, None), (20, None), (1, 2.0), (4, 3.0), (1, 45.0)])
def test_peaks(spark, frame, series, kind, distance, prominence, block):
    got = {(r.session, r.sample_idx) for r in signal.peaks(frame, ["session"], "y", kind, distance, prominence, block=block).collect()}
    sign = -1 if kind == "min" else 1
    want = {(s, int(i)) for s, y in series.items() for i in whole.find_peaks(sign * whole._fill(y), distance, prominence)}
    assert got == want


@pytest.mark.parametrize("block", WAYS)
@pytest.mark.parametrize("prominence", [None, 2.0])
def test_peaks_without_plateaus(spark, frame, series, prominence, block):
    got = {(r.session, r.sample_idx) for r in signal.peaks(frame, ["session"], "y", "max", 1, prominence, block=block, plateaus=False).collect()}
    filled = {s: whole._fill(y) for s, y in series.items()}
    want = {(s, int(i)) for s, y in filled.items() for i in whole.find_peaks(y, 1, prominence) if y[i - 1] < y[i] > y[i + 1]}
    assert got == want


def test_peaks_by_prominence_takes_no_plateau(spark, tmp_path):
    from __spark_entry__ import queries

    values = [1.0, 50.0, 50.0, 2.0, 60.0, 3.0]
    spark.range(6).selectExpr("id as event_id", "timestamp_seconds(id) as ts", "1L as user_id", "'a' as event_type", f"array({','.join(map(str, values))})[cast(id as int)] as value", "'' as props").write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(r) for r in queries()["peaks_by_prominence"](spark, str(tmp_path)).collect()] == [(1, 4, 60.0)]


@pytest.mark.parametrize("block", [1000, BLOCK])
def test_only_long_sessions_go_in_blocks(frame, series, block):
    from ridgeline.operators.blocks import by_length

    seen = []

    def kernel(rows, b):
        seen.append(b)
        return signal.peaks(rows, ["session"], "y", "max", 3, 2.0, block=b)

    got = {(r.session, r.sample_idx) for r in by_length(frame, ["session"], kernel, block).collect()}
    assert seen == ([None] if block == 1000 else [None, block])
    assert got == {(s, int(i)) for s, y in series.items() for i in whole.find_peaks(whole._fill(y), 3, 2.0)}


@pytest.mark.parametrize("name", ["prominent_peaks", "butterworth"])
def test_short_sessions_take_one_python_pass(spark, name):
    from __spark_entry__ import queries

    plan = queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "LeftSemi" not in plan


def test_a_session_is_many_tasks(spark):
    long = spark.range(200_000).select(F.lit("a").alias("session"), F.col("id").alias("sample_idx"), F.sin(F.col("id") / 50).alias("y"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spread = signal.smoothed(long, ["session"], "y", 100.0, 5.0, block=10_000).groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(spread) > 1 and sum(r["count"] for r in spread) == 200_000


def test_empty(spark, frame):
    none = frame.filter("false")
    assert signal.derivatives(none, ["session"], "y", 1.0).count() == 0
    assert signal.smoothed(none, ["session"], "y", 10.0, 1.0).count() == 0
    assert signal.peaks(none, ["session"], "y", "max", 3, 1.0).count() == 0
    assert signal.phased(none, ["session"], "y", 0, 1).count() == 0


def test_ema_keeps_its_state_across_batches(spark):
    from ridgeline.operators.series import ema_deadband

    rng = np.random.default_rng(5)
    data = {s: [None if rng.random() < 0.1 else float(x) for x in np.cumsum(rng.normal(size=n)) * 5] for s, n in (("a", 500), ("b", 1), ("c", 230))}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    frame = spark.createDataFrame([(s, i, x) for s, v in data.items() for i, x in enumerate(v)], "s string, sample_idx long, y double").repartition(3)
    got = {(r.s, r.sample_idx): r.ema for r in ema_deadband(frame, ["s"], "y", 0.25, 3.0).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, v in data.items():
        e = None
        for i, x in enumerate(v):
            if x is not None:
                e = x if e is None else e if abs(e - x) < 3.0 else 0.25 * x + 0.75 * e
            elif e is not None:
                e = None
            assert got[s, i] == (None if e is None else int(np.floor(e + 0.5))), (s, i)


@pytest.mark.parametrize("use_median", [True, False])
def test_zero_offset_against_every_window(spark, use_median):
    from ridgeline.operators.series import zero_offset

    rng = np.random.default_rng(9)
    data = {}
    for s, n in (("a", 300), ("b", 4), ("c", 1), ("d", 60), (None, 40)):
        t = np.sort(rng.integers(0, 8 * n, n)) * 100_000
        data[s] = [(int(a), None if rng.random() < 0.2 else float(v)) for a, v in zip(t, rng.normal(size=n), strict=True)]
    data["none"] = [(0, None), (100_000, float("nan"))]
    rows = [(s, i, t, v) for s, x in data.items() for i, (t, v) in enumerate(x)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "23")
    frame = spark.createDataFrame(rows, "s string, sample_idx long, t long, y double").repartition(3)
    got = {r.s: r.offset for r in zero_offset(frame, ["s"], "y", "t", 4.0, 5, use_median).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s, x in data.items():
        known = [(t, v) for t, v in x if v is not None and v == v]
        windows = [[v for u, v in known if t - 4_000_000 <= u <= t] for t, _ in x]
        levels = [float(np.median(w) if use_median else np.mean(w)) for w in windows if len(w) >= 5]
        want = min(levels) if levels else known[0][1] if known else None
        assert got[s] is None if want is None else got[s] == pytest.approx(want, abs=1e-9), s
    assert set(got) == set(data)
