import numpy as np
import pytest
from pyspark.sql import functions as F

SPECS = [
    {"type": "peak", "signal": "disp", "kind": "max", "return_time": True},
    {"type": "peak", "signal": "vel", "kind": "min", "id": "low"},
    {"type": "interval_stats", "signal": "disp", "start_trigger": "hit", "end_trigger": "land", "ops": ["mean", "max", "min", "delta", "integral"], "return_debug": True},
    {"type": "interval_stats", "signal": "vel", "id": "soft", "start_trigger": "land", "end_trigger": "hit", "ops": ["mean", "max"], "smooth_ms": 500, "min_delay_s": 0.2},
    {"type": "trigger_delta", "start_trigger": "land", "end_trigger": "hit", "quantity": "samples", "abs": True, "return_debug": True},
    {"type": "trigger_delta", "id": "air", "start_trigger": "hit", "end_trigger": "land"},
]
INLINE = [
    {"type": "integral", "signal": "disp", "abs": True},
    {"type": "integral", "signal": "disp"},
    {"type": "peak", "signal": "vel", "kind": "min", "return_time": True},
    {"type": "time_above", "signal": "disp", "threshold": 0.5},
    {"type": "trigger_delta", "start_trigger": "primary", "end_trigger": "land", "quantity": "seconds"},
    {"type": "interval_stats", "signal": "vel", "start_trigger": "hit", "end_trigger": "land", "ops": ["mean", "peak", "delta", "integral", "time_above"], "polarity": "pos_to_neg", "smooth_ms": 300, "return_debug": True},
    {"type": "interval_stats", "signal": "disp", "ops": ["max", "min"]},
    {"type": "interval_stats", "signal": "disp", "id": "x", "start_trigger": "hit", "end_trigger": "land", "min_delay_s": 2.0, "ops": ["mean"]},
]
N, DT = 60, 0.1


def box(y, win):
    return np.array([y[max(0, i - win // 2) : i + (win - 1) // 2 + 1].sum() / win for i in range(len(y))])


@pytest.fixture
def data(spark):
    rng = np.random.default_rng(4)
    d, v = rng.normal(0, 1, N), rng.normal(0, 1, N)
    rows = [("s", i, i * DT, float(d[i]), float(v[i]), float(-d[i])) for i in range(N)]
    samples = spark.createDataFrame(rows, "session_key string, sample_idx long, time_s double, `d a` double, v double, other double")
    ev = [("s", "jump", "e0", "rear", 10, 1.0, 5, 20, 0.5, 2.0, 18, 1.8), ("s", "jump", "e1", "rear", 30, 3.0, 25, 40, 2.5, 4.0, None, None), ("s", "jump", "e2", "front", 45, 4.5, 40, 55, 4.0, 5.5, 58, 5.8), ("s", "dip", "e3", "rear", 12, 1.2, 10, 16, 1.0, 1.6, None, None)]
    events = spark.createDataFrame(ev, "session_key string, schema_id string, event_id string, signal string, trigger_idx long, trigger_time_s double, start_idx long, end_idx long, start_time_s double, end_time_s double, land_idx long, land_time_s double")
    return samples, events, d, v


INPUTS = {"rear": {"disp": "d a", "vel": "v"}, "front": {"disp": "other", "vel": "v"}}


def test_segment_metrics(data):
    from ridgeline.operators.event_metrics import Spec, segment_metrics

    samples, events, d, v = data
    got = {r.event_id: r for r in segment_metrics(samples, events, [Spec("jump", "hit", SPECS, ["land"]), Spec("dip", "p", [{"type": "peak", "signal": "disp", "id": "low"}])], INPUTS, DT).collect()}
    assert len(got) == 4
    near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
    a = got["e0"]
    assert a.m_peak_disp_max == near(d[5:21].max()) and a.m_peak_disp_max_t_rel_s == near((5 + d[5:21].argmax()) * DT - 1.0)
    assert a.m_low == near(v[5:21].min())
    x = d[10:19]
    assert (a.m_interval_disp_mean, a.m_interval_disp_max, a.m_interval_disp_min, a.m_interval_disp_delta) == near((x.mean(), x.max(), x.min(), x[-1] - x[0]))
    assert a.m_interval_disp_integral == near(((x[1:] + x[:-1]) / 2 * DT).sum())
    assert (a.d_interval_disp_t0_rel_s, a.d_interval_disp_t1_rel_s, a.d_interval_disp_i0, a.d_interval_disp_i1, a.d_interval_disp_swapped) == near((0.0, 0.8, 5, 14, 0))
    seg = v[5:21]
    soft = np.array([seg[max(0, i - 2) : i + 3].mean() for i in range(16)])[5:14]
    assert (a.m_soft_mean, a.m_soft_max) == near((soft.mean(), soft.max()))
    assert (a.m_trigger_delta_land_hit_samples, a.m_air, a.d_trigger_delta_land_hit_samples_start_idx) == near((8, 0.8, 18))
    b = got["e1"]
    assert b.m_peak_disp_max == near(d[25:41].max()) and b.m_interval_disp_mean is None and b.m_air is None
    assert got["e2"].m_peak_disp_max == near((-d[40:56]).max()) and got["e2"].m_interval_disp_max == near((-d[45:56]).max())
    assert got["e3"].m_low == near(d[10:17].max()) and got["e3"].m_peak_disp_max is None


def test_inline_metrics(data):
    from ridgeline.operators.event_metrics import Spec, inline_metrics

    samples, events, d, v = data
    out = inline_metrics(samples, events, [Spec("jump", "hit", INLINE, ["land"])], INPUTS, DT)
    got = {r.event_id: r.asDict() for r in out.collect()}
    assert len(got) == 4 and got["e3"]["m_peak_vel"] is None
    near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
    trap = lambda y: float(((y[1:] + y[:-1]) / 2).sum() * DT)
    a = got["e0"]
    own = d[5:21]
    assert (a["m_integral_disp_abs"], a["m_integral_disp"]) == near((trap(abs(own)), trap(own)))
    assert (a["m_peak_vel"], a["m_peak_vel_t"]) == near((v[5:21].min(), (5 + v[5:21].argmin()) * DT - 1.0))
    assert a["m_time_above_disp_0.5"] == near((own > 0.5).sum() * DT) and a["m_trigger_delta_primary_land_seconds"] == near(0.8)
    y = box(v[10:19], 3)
    assert (a["m_int_vel_mean"], a["m_int_vel_peak"], a["m_int_vel_delta"], a["m_int_vel_integral"], a["m_int_vel_time_above_0"]) == near((y.mean(), y.min(), y[-1] - y[0], trap(y), (y > 0).sum() * DT))
    assert (a["m_int_vel_t_start"], a["m_int_vel_t_end"], a["m_int_disp_max"], a["m_int_disp_mean"]) == (near(1.0), near(1.8), near(own.max()), None)
    assert got["e1"]["m_int_vel_mean"] is None and got["e1"]["m_int_disp_min"] == near(d[25:41].min())
    y = box(v[45:59], 3)  # the interval leaves the event's window
    assert got["e2"]["m_int_vel_mean"] == near(y.mean())


def test_delta_tests_over_several_columns(spark):
    from ridgeline.operators.conditions import Block, Test, apply_conditions

    rows = [("e", 5, i, float(i), float(-i)) for i in range(10)] + [("f", 5, i, float(i), float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "event_id string, at long, sample_idx long, x double, y double")
    block = Block(0, 5, [Test("delta", "x", cmp=">=", value=4.0), Test("delta", "y", cmp="<=", value=-4.0)])
    assert [r.event_id for r in apply_conditions(df, ["event_id"], "at", "sample_idx", [block]).collect()] == ["e"]


def test_open_search_goes_to_the_end_of_the_session(spark):
    from ridgeline.plans import detect
    from ridgeline.plans.schema import parse

    rows = [("s", i, i * 10.0, 5.0 if i in (3, 700) else 0.0) for i in range(800)]
    samples = spark.createDataFrame(rows, "session_key string, sample_idx long, time_s double, `rear_shock_dom_suspension [mm]` double")
    schema = parse("""
version: '1'
events:
- id: a
  sensors: []
  trigger: {id: t, type: simple_threshold_crossing, signal: disp, value: 4, dir: rising}
  debounce: {gap_s: 10000}
  secondary_triggers:
  - {id: far, type: simple_threshold_crossing, signal: disp, value: 4, dir: rising, base_trigger: t, search: {min_delay_s: 20}}
  metrics: [{type: trigger_delta, id: d, start_trigger: t, end_trigger: far}]
""")
    from ridgeline.functions.naming import registry

    reg = registry({c: t for c, t in samples.dtypes if c != "session_key"})
    events = detect.detect(samples, schema, reg, 10.0)
    assert [(r.trigger_idx, r.far_idx) for r in events.collect()] == [(3, 700)]
    assert detect.metrics(samples, events, schema, reg, 10.0).first().m_d == 6970.0
    assert [(r.trigger, r.time_s) for r in detect.secondary_times(events).collect()] == [("far", 7000.0)]
    cut = detect.relative_slices(samples, events, {"disp": "rear_shock_dom_suspension [mm]"}, 20.0, 30.0).orderBy("t_rel").collect()
    assert [r.t_rel for r in cut] == [-20.0, -10.0, 0.0, 10.0, 20.0, 30.0] and cut[0].secondary[0].offset_s == 6970.0


def test_joint_interpolation_in_cells(spark):
    from ridgeline.operators.joins import interp_columns, nearest_join

    rng = np.random.default_rng(7)
    src = [(k, float(t), float(a) if rng.random() > 0.3 else None, float(b)) for k in ("p", "q") for t, a, b in zip(np.sort(rng.uniform(0, 100, 40)), rng.normal(size=40), rng.normal(size=40), strict=True)]
    source = spark.createDataFrame(src, "k string, t double, a double, b double")
    target = spark.createDataFrame([(k, float(t)) for k in ("p", "q", "r") for t in range(-5, 110, 3)], "k string, t double")
    cols = {"a": "x", "b": "y"}
    whole = sorted(map(str, interp_columns(target, source, ["k"], "t", cols).collect()))
    assert whole == sorted(map(str, interp_columns(target, source, ["k"], "t", cols, cell=9.0).collect()))
    for k in ("p", "q"):
        got = {r.t: r.x for r in interp_columns(target, source, ["k"], "t", cols, cell=4.0).filter(F.col("k") == k).collect()}
        ts, ys = np.array([[s[1], s[2]] for s in src if s[0] == k and s[2] is not None]).T
        for t, x in got.items():
            assert (x is None) if t < ts[0] or t > ts[-1] else x == pytest.approx(np.interp(t, ts, ys))
    a = sorted(map(str, nearest_join(target, source, ["k"], "t", "b", "n").collect()))
    assert a == sorted(map(str, nearest_join(target, source, ["k"], "t", "b", "n", cell=5.0).collect()))
