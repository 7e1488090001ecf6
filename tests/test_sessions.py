import json

import numpy as np
import pytest

SCHEMA = """
version: '5'
defaults: {window: {pre_s: 0.5, post_s: 0.5}, debounce: {gap_s: 0.2}}
events:
- id: jump>1
  label: Jump
  sensors: [rear_shock, front_shock]
  trigger: {id: top, type: simple_threshold_crossing, signal: disp_norm, value: 0.05, dir: falling, hysteresis: 0}
  secondary_triggers:
  - {id: land, type: simple_threshold_crossing, signal: disp_norm, value: 0.05, dir: rising, base_trigger: top, search: {min_delay_s: 0.2, max_delay_s: 5.0}}
  - {id: deepest, type: local_extrema, signal: disp, kind: max, prominence: 5, base_trigger: land, search: {min_delay_s: 0.0, max_delay_s: 1.0}}
  preconditions:
  - within_s: [0.05, 0.2]
    all_of: [{type: range, signal: disp_norm, max: 0.05}]
  metrics:
  - {type: trigger_delta, id: air, start_trigger: top, end_trigger: land}
  - {type: peak, signal: disp, kind: max}
  - {type: interval_stats, signal: vel, start_trigger: land, end_trigger: deepest, ops: [mean, max]}
  tags: [air]
"""


@pytest.fixture
def recording(tmp_path):
    t = np.arange(1000) / 100
    d = 60 * np.maximum(0, np.sin(2 * np.pi * t / 2))
    lines = ["timestamp_ms,rear_shock_dom_suspension [mm],mark"] + [f"{int(x * 1000)},{y:.6f},{int(i == 50)}" for i, (x, y) in enumerate(zip(t, d, strict=True))]
    lines += ["# run_stats_begin", "# samples_dropped=0", "# flush_max_ms=3.5", "# run_stats_end"]
    path = tmp_path / "2026-02-19_08-35-11.CSV"
    path.write_text("\n".join(lines) + "\n")
    side = {
        "contract": {"name": "log", "version": "0.1"},
        "session": {"session_id": "s1"},
        "streams": {"primary": {"type": "uniform", "time_col": "timestamp_ms", "sample_rate_hz": 100}},
        "columns": {"rear_shock_dom_suspension [mm]": {"class": "signal", "unit": "mm", "sensor": "rear_shock", "quantity": "disp", "stream": "primary"}},
    }
    (tmp_path / "2026-02-19_08-35-11.json").write_text(json.dumps(side))
    return str(path)


def test_whole_pipeline(spark, recording, tmp_path):
    from ridgeline.plans.session import Profile, Smoothing, run
    from ridgeline.sources.logger import run_statistics, typed
    from ridgeline.sources.store import ArtifactStore

    profile = Profile({"rear_shock_dom_suspension [mm]": 60.0}, zeroing=False, smoothing=[Smoothing(20.0)], active_disp="rear_shock_dom_suspension [mm]")
    # timestamp_ms is the declared time column; the declared one is read by size: the largest is below 1e6
    out = run(spark, recording, SCHEMA, profile)
    samples = out.prepared.samples
    assert samples.count() == 999 and out.prepared.rate_hz == 100
    assert {"rear_shock_vel_dom_suspension [mm/s]", "rear_shock_dom_suspension [1]_op_norm", "rear_shock_dom_suspension [mm]_op_Butterworth_20Hz_4Order", "active_mask_qc"} <= set(samples.columns)
    events = out.events.orderBy("trigger_idx").collect()
    assert [e.event_id for e in events] == [f"jump>1:rear_shock:{i}" for i in range(5)]
    metrics = {r.event_id: r for r in out.metrics.collect()}
    assert metrics["jump>1:rear_shock:0"].m_peak_disp_max == pytest.approx(60, rel=0.01)
    store = ArtifactStore(spark, str(tmp_path / "store"))
    store.write(samples, "samples", "run1", "s1")
    store.write(out.events, "events", "run1", "s1")
    with pytest.raises(Exception, match="(?i)exist"):
        store.write(samples, "samples", "run1", "s1")
    store.write_manifest("run1", "s1", {"source": {"sha256": store.hashes(recording).first().sha256}})
    assert store.unprocessed(recording).count() == 0
    assert store.read("events").count() == 5 and store.sessions().collect()[0].session_id == "s1"
    store.describe("run1", "s1", "first")
    assert store.manifests().first().description == "first" and store.unprocessed(recording).count() == 0
    stats = {r.key: r.value for r in run_statistics(spark, recording).collect()}
    assert typed(stats) == {"samples_dropped": 0, "flush_max_ms": 3.5}


@pytest.mark.parametrize(("quality", "n"), [("{max_nan_fraction: 1.0}", 5), ("{skip_if_clipped: true}", 0)])
def test_quality_rules(spark, recording, quality, n):
    from ridgeline.plans.session import Profile, run

    profile = Profile({"rear_shock_dom_suspension [mm]": 60.0}, zeroing=False, active_disp="rear_shock_dom_suspension [mm]")
    out = run(spark, recording, SCHEMA.replace("  tags: [air]", f"  quality: {quality}\n  tags: [air]"), profile, check=False)
    assert out.events.count() == n  # every window holds samples at 0, the least value of the series


def test_first_sample_is_dropped(spark, tmp_path):
    from ridgeline.sources.logger import read_csv

    path = tmp_path / "a.csv"
    path.write_text("time_s;x;mark\n0.00;10;0\n# note\n0.03;$11;1\n0.03;12;1\n0.02;9;0\n0.06;;0\n0.09;13 mm;0\n")
    rows = read_csv(spark, str(path)).samples.orderBy("sample_idx").collect()
    assert [(r.time_s, r.x) for r in rows] == [(0.03, 11.0), (0.09, 13.0)]
    rows = read_csv(spark, str(path), keep_first_sample=True).samples.collect()
    assert len(rows) == 3


def test_interpolation_golden(spark):
    from ridgeline.sources.gps import onto_samples

    gps = spark.createDataFrame([("s", t, v, a) for t, v, a in zip([0.75, 0.25, 1.25], [3.0, 1.0, 5.0], [102.0, 100.0, 104.0], strict=True)], "session_key string, time_s double, speed double, alt double")
    s = spark.createDataFrame([("s", t) for t in (0.0, 0.5, 1.0, 1.5)], "session_key string, time_s double")
    rows = onto_samples(s, gps, ["speed", "alt"]).orderBy("time_s").collect()
    assert [r.speed for r in rows] == [None, 2.0, 4.0, None] and [r.alt for r in rows] == [None, 101.0, 103.0, None]


def test_gps_choice(spark):
    from pyspark.sql import functions as F

    from ridgeline.sources.gps import candidates, choose, upsert_binding

    ts = lambda s: F.timestamp_seconds(F.lit(s))
    sess = spark.range(1).select(F.lit("a").alias("session_id"), ts(1000).alias("start"), ts(1200).alias("end"))
    files = spark.createDataFrame([("x/one.fit", 900, 1120), ("X/ONE.FIT", 900, 1120), ("x/two.fit", 1090, 1300), ("x/far.fit", 5000, 6000)], "path string, a long, b long")
    files = files.select("path", F.timestamp_seconds("a").alias("fit_start"), F.timestamp_seconds("b").alias("fit_end"))
    c = candidates(sess, files.orderBy("path"))
    assert sorted(r.overlap_s for r in c.collect()) == [110.0, 120.0]
    assert choose(c).first().path.lower() == "x/one.fit" and choose(c, "latest_start").first().path == "x/two.fit"
    assert choose(c, "require_binding").first().status == "ambiguous"
    old = spark.createDataFrame([("a", "other.fit"), ("b", "b.fit")], "session_id string, path string")
    new = upsert_binding(old, spark.createDataFrame([("a", "two.fit")], "session_id string, path string"))
    assert sorted(map(tuple, new.collect())) == [("a", "two.fit"), ("b", "b.fit")]
    got = choose(c, "require_binding", new).first()
    assert (got.status, got.path) == ("bound_match", "x/two.fit")


def test_naming():
    from ridgeline.functions import naming as n

    s = n.parse("rear_shock_dom_suspension [mm]_op_zeroed_Butterworth_12p5Hz_4Order_resid")
    assert s == n.Signal("rear_shock", "", "suspension", "mm", ("zeroed", "diff"))
    for name in ("a [mm]", "fork_raw [counts]", "x_qc", "b_dom_bike [1]_op_zeroed_norm"):
        assert n.format_(n.parse(name)) == name
    assert n.renamed(["fork [mm]_zeroed_norm", "rear-shock"[:4] + "_shock_raw", "time_s"]) == {"fork [mm]_zeroed_norm": "front_shock [mm]_op_zeroed_norm", "rear_shock_raw": "rear_shock_raw [counts]"}
    with pytest.raises(ValueError, match="collide"):
        n.renamed(["fork [mm]", "front_shock [mm]"])
    assert n.velocity_name("rear_shock_dom_suspension [mm]_op_zeroed") == "rear_shock_vel_dom_suspension [mm/s]"
    assert n.filter_tag(12.5, 4) == "Butterworth_12p5Hz_4Order"
    assert n.canonical_sensor(" Fork ") == "front_shock" and n.side("rear_shock_vel") == "rear"
    assert n.check_registry(n.registry({"a_raw [V]": "double", "b [mm]": "double"}))


def test_schema_lint():
    from ridgeline.plans.schema import lint, parse, summary

    assert summary(parse(SCHEMA))[0]["secondary_ids"] == ["land", "deepest"]
    bad = {"events": [{"id": "a", "trigger": {"id": "t", "type": "nope"}, "preconditions": [{"within_s": [0, float("inf")]}], "metrics": [{"type": "what"}]}, {"id": "a"}]}
    assert len(lint(bad)) == 5


def test_contracts(spark):
    from ridgeline.plans.contracts import ContractError, check_metrics, check_session

    bad = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 0.5)], "session_key string, sample_idx long, time_s double")
    with pytest.raises(ContractError, match="fall"):
        check_session(bad)
    m = spark.createDataFrame([("s", "e1", "x"), ("s", "e1", "x")], "session_id string, event_id string, schema_id string")
    with pytest.raises(ContractError, match="unique"):
        check_metrics(m)
    e = spark.createDataFrame([("s", "e2", "x")], "session_id string, event_id string, schema_id string")
    with pytest.raises(ContractError, match="without an event"):
        check_metrics(m.limit(1), e)


def test_catalog(spark):
    from ridgeline.operators import catalog

    sel = spark.createDataFrame([("a", "session"), ("g", "aggregation")], "entity_key string, entity_kind string")
    agg = spark.createDataFrame([("g", "a"), ("g", "b")], "entity_key string, session_key string")
    assert sorted((r.entity_key, r.session_key) for r in catalog.expand_entities(sel, agg).collect()) == [("a", "a"), ("g", "b")]
    notes = spark.createDataFrame([("a", "t", "1"), ("b", "u", "1")], "session_key string, template_id string, template_version string")
    templates = spark.createDataFrame([("t", "1"), ("t", "2")], "template_id string, version string")
    sessions = spark.createDataFrame([("a",), ("b",), ("c",)], "session_key string")
    got = {r.session_key: r.note_status for r in catalog.session_catalog(sessions, notes, templates).collect()}
    assert got == {"a": "mismatch", "b": "template_missing", "c": "missing_note"}
    both = spark.createDataFrame([("a", "x", "h1"), ("b", "x", "h1"), ("b", "y", "h")], "session_key string, schema_id string, schema_hash string")
    assert [r.schema_id for r in catalog.schema_policy(both, "intersection").collect()] == ["x"]
    with pytest.raises(Exception, match="differ"):
        catalog.schema_policy(both, "strict").collect()


def test_streams_match_batch(spark, tmp_path):
    """Samples come in any order within the delay, some a batch late, some missing; the result is that of the batch operators."""
    import json as js

    from pyspark.sql import functions as F

    from ridgeline.operators import series
    from ridgeline.streaming import live

    rng = np.random.default_rng(2)
    rows = [(f"k{k}", i, None if rng.random() < 0.08 else float(v)) for k in range(3) for i, v in enumerate(rng.normal(0, 20, 60).cumsum())]
    df = spark.createDataFrame(rows, "k string, sample_idx long, y double")
    late = {i for i in range(60) if i % 20 in (18, 19)}  # of each part these come with the next one
    parts = [[r for r in rows if (r[1] // 20 + (r[1] in late)) == p] for p in range(4)]
    parts[3] += [("end", 100 + k, 0.0) for k in range(2)]

    def streamed(f, name):
        src = tmp_path / name
        src.mkdir()
        stream = spark.readStream.schema("k string, sample_idx long, y double").option("maxFilesPerTrigger", 1).json(str(src)).withColumn("at", F.timestamp_seconds(F.col("sample_idx") + 1000))  # the watermark begins at 0
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/cp_{name}").start()
        for p, part in enumerate(parts):
            order = rng.permutation(len(part))
            (src / f"{p}.json").write_text("\n".join(js.dumps(dict(zip(("k", "sample_idx", "y"), part[i], strict=True))) for i in order))
            q.processAllAvailable()
        q.stop()
        return [tuple(r) for r in spark.table(name).filter("k != 'end'").collect()]

    got = streamed(lambda s: live.ema(s, "k", "sample_idx", "y", 0.25, 3.0).select("k", "sample_idx", "ema"), "ema_out")
    assert sorted(got) == sorted((r.k, r.sample_idx, r.ema) for r in series.ema_deadband(df, ["k"], "y", 0.25, 3.0).collect())
    got = streamed(lambda s: live.crossings(s, "k", "sample_idx", "y", 5.0, 10.0).select("k", "sample_idx"), "cross_out")
    assert sorted(got) == sorted((r.k, r.sample_idx) for r in series.threshold_crossings(df, ["k"], "y", 5.0, 10.0).collect())
    whole = df.withColumn("y", F.floor("y"))
    got = streamed(lambda s: live.turns(s.withColumn("y", F.floor("y")), "k", "sample_idx", "y", 40, 25, idle_ms=1000).select("k", "sample_idx", "turns", "unwrapped"), "turn_out")
    assert sorted(got, key=str) == sorted(((r.k, r.sample_idx, r.turns, r.unwrapped) for r in series.wrap_turns(whole, ["k"], "y", 40, 25).collect()), key=str)


def test_many_recordings_with_gps(spark, recording, tmp_path):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from ridgeline.plans.session import Profile, run_many
    from ridgeline.sources.logger import read_csv, read_recordings

    folder = str(tmp_path)
    t = np.arange(600) / 100
    for name, sep in (("2026-02-19_10-00-00_b.csv", ","), ("loose.csv", ";")):
        lines = [sep.join(("time_s", "rear_shock_dom_suspension [mm]", "mark"))] + [f"{x:.2f}{sep}{60 * max(0, np.sin(2 * np.pi * x / 2)):.6f}{sep}0" for x in t]
        (tmp_path / name).write_text("\n".join([*lines[:5], "# a note", *lines[5:], "1;2,3;4,5,6"]) + "\n")
    found = read_recordings(spark, folder, "Australia/Perth")
    known = {r.session_key: r for r in found.sessions.withColumn("anchor", F.col("anchor").cast("long")).collect()}
    assert set(known) == {"s1", "2026-02-19_10-00-00_b", "loose"}
    utc = lambda *a: int(datetime(*a, tzinfo=timezone.utc).timestamp())
    assert known["2026-02-19_10-00-00_b"].anchor == utc(2026, 2, 19, 2) and known["loose"].anchor is None and known["s1"].anchor == utc(2026, 2, 19, 0, 35, 11)
    assert (known["s1"].rate_hz, known["loose"].rate_hz) == (100.0, None)
    got = {r["session_key"]: r["count"] for r in found.samples.groupBy("session_key").count().collect()}
    assert got == {"s1": 999, "2026-02-19_10-00-00_b": 599, "loose": 599}
    for key, path in (("s1", recording), ("loose", f"{folder}/loose.csv")):
        own = [tuple(r) for r in found.samples.filter(F.col("session_key") == key).orderBy("sample_idx").collect()]
        assert own == [tuple(r) for r in read_csv(spark, path, session_key=key).samples.orderBy("sample_idx").collect()]
    start = utc(2026, 2, 19, 2)
    records = spark.createDataFrame([("g/one.fit", i, start + i, float(i), 2.0) for i in range(5)] + [("g/two.fit", 0, start + 10**6, 1.0, 1.0)], "path string, pos long, at long, speed double, altitude double")
    records = records.withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    profile = Profile({"rear_shock_dom_suspension [mm]": 60.0})
    schema = SCHEMA[: SCHEMA.index("  secondary_triggers")].replace(", front_shock", "") + "  metrics:\n  - {type: peak, signal: disp, kind: max}\n"
    results = run_many(spark, folder, schema, profile, "Australia/Perth", check=False, records=records, inline=True)
    assert [r.prepared.rate_hz for r in results] == [100.0]
    out = results[0]
    assert {r["session_key"]: r["count"] for r in out.events.groupBy("session_key").count().collect()} == {"s1": 5, "2026-02-19_10-00-00_b": 3, "loose": 3}
    assert {r.session_id: r.status for r in out.gps.states.collect()} == {"s1": "auto_match", "2026-02-19_10-00-00_b": "auto_match", "loose": "missing_anchor"}  # s1's declared time column counts seconds
    speed = out.prepared.samples.filter("session_key = '2026-02-19_10-00-00_b' and time_s = 1.5").first()["gps_fit_speed_dom_world [m/s]"]
    assert speed == pytest.approx(1.5) and "m_peak_disp" in out.events.columns
    for r in results:
        r.events.unpersist()
        r.prepared.samples.unpersist()


def test_one_recording_takes_its_gps_stream(spark, recording):
    from datetime import datetime, timezone

    from pyspark.sql import functions as F

    from ridgeline.sources.gps import enrich
    from ridgeline.sources.logger import read_csv

    session = read_csv(spark, recording)
    start = int(datetime(2026, 2, 19, 8, 35, 11, tzinfo=timezone.utc).timestamp())
    assert spark.range(1).select(session.anchor().cast("long").alias("a")).first().a == start
    records = spark.createDataFrame([("g/one.fit", i, start + 1000 * i, float(i)) for i in range(5)], "path string, pos long, at long, speed double").withColumn("timestamp", F.timestamp_seconds("at")).drop("at")
    anchors = spark.range(1).select(F.lit("s1").alias("session_key"), session.anchor().alias("anchor"))
    out = enrich(session.samples, anchors, records)
    assert out.states.first().status == "auto_match" and out.stream.count() == 5
    rows = {round(r.time_s, 2): r["gps_fit_speed_dom_world [m/s]"] for r in out.samples.collect()}
    assert len(rows) == 999 and rows[2500.0] == pytest.approx(2.5) and rows[4500.0] is None


def test_candidate_states_and_store_guards(spark, recording, tmp_path):
    from pyspark.sql import functions as F

    from ridgeline.sources.gps import candidate_states
    from ridgeline.sources.store import ArtifactStore

    s = spark.createDataFrame([("a", 1000, 1200), ("b", 9000, 9100), ("c", None, None), ("d", 1000, 1050)], "session_id string, x long, y long")
    s = s.select("session_id", F.timestamp_seconds("x").alias("start"), F.timestamp_seconds("y").alias("end"))
    files = spark.createDataFrame([("x/one.fit", 900, 1120), ("x/two.fit", 1090, 1300)], "path string, a long, b long").select("path", F.timestamp_seconds("a").alias("fit_start"), F.timestamp_seconds("b").alias("fit_end"))
    state = lambda *a, **k: {r.session_id: (r.status, r.n_candidates) for r in candidate_states(s, *a, **k).collect()}
    assert set(state(files, enabled=False).values()) == {("disabled", 0)} and set(state(None).values()) == {("invalid_config", 0)}
    assert state(files) == {"a": ("ambiguous", 2), "b": ("no_match", 0), "c": ("missing_anchor", 0), "d": ("auto_match", 1)}
    assert state(files, policy="largest_overlap")["a"] == ("bound_match", 2)
    bound = spark.createDataFrame([("a", "two.fit")], "session_id string, path string")
    assert state(files, bindings=bound)["a"] == ("bound_match", 2)
    store = ArtifactStore(spark, str(tmp_path / "store"))
    store.check_new("r1")
    store.write(spark.range(1), "samples", "r1", "s1")
    with pytest.raises(FileExistsError):
        store.check_new("r1", "s1")
    store.check_new("r1", "s2")
    store.check_new("r1", force=True)
    store.freeze_schema("r1", "s1", SCHEMA)
    assert store.frozen_schema("r1", "s1") == SCHEMA
    sha = store.keep_source(recording, "r1", "s1")
    kept = tmp_path / "store/sources/run_id=r1/session_id=s1/2026-02-19_08-35-11.CSV"
    assert kept.read_bytes() == open(recording, "rb").read() and (kept.parent / (kept.name + ".sha256")).read_text().strip() == sha


def test_signal_columns_and_bindings_by_hash(spark):
    from pyspark.sql import functions as F

    from ridgeline.operators.selection import signal_columns
    from ridgeline.sources.gps import choose

    df = spark.createDataFrame([("s", 0, 0.0, 1.0, None, float("nan"), "t")], "session_key string, sample_idx long, time_s double, a double, b double, c double, d string")
    assert signal_columns(df, {"b": {}}) == ["b"] and signal_columns(df, {"x": {}}, ["c"]) == ["c"] and signal_columns(df) == ["a"]
    cands = spark.createDataFrame([("s", "x/one.fit", "h1", 5.0), ("s", "x/two.fit", "h2", 9.0)], "session_id string, path string, sha256 string, overlap_s double").withColumn("fit_start", F.current_timestamp())
    bind = lambda *r: choose(cands, "require_binding", spark.createDataFrame([r], "session_id string, path string, sha256 string")).first()
    assert bind("s", None, "h2").path == "x/two.fit" and bind("s", "one.fit", "h1").path == "x/one.fit"
    assert bind("s", "one.fit", "h2").status == "ambiguous" and bind("s", None, None).status == "ambiguous"
