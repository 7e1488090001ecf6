"""Recordings as users write them, and artifacts of different ages."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


def test_quoted_headers_comments_and_malformed_rows(spark, tmp_path):
    from ridgeline.sources.logger import read_csv, read_recordings

    head = 'time_s,"travel, rear [mm]",c,c'
    rows = ["0.0,1,2,3", "0.1,2,3,4", '0.2,"3",4,5 # a note, with commas', "0.3,4,5", "0.4,5,6,7,8", "0.5,6,7,8", '0.6,"7,5",8,9', "0.7,x,8,9"]
    notes = [f"# note {i}, and more; of it" for i in range(60)]
    (tmp_path / "a.csv").write_text("\n".join([*notes, head, *rows[:3], "# between", *rows[3:]]) + "\n")
    (tmp_path / "b.CSV").write_text('"time_s";"a;b"\n0;1\n1;2\n2;3\n')
    (tmp_path / "c.csv").write_text("# nothing but notes\n")
    one = read_csv(spark, str(tmp_path / "a.csv"), keep_first_sample=True)
    assert one.samples.columns == ["session_key", "sample_idx", "time_s", "travel, rear [mm]", "c", "c.1"]
    got = [tuple(r)[1:] for r in one.samples.orderBy("sample_idx").collect()]
    assert [r[1] for r in got] == pytest.approx([0.0, 0.1, 0.2, 0.5, 0.6]) and got[2][2:] == (3.0, 4.0, 5.0)
    found = read_recordings(spark, str(tmp_path), keep_first_sample=True)
    assert {r.session_key: r["count"] for r in found.samples.groupBy("session_key").count().collect()} == {"a": 5, "b": 3}
    with pytest.raises(ValueError, match="no header"):
        read_csv(spark, str(tmp_path / "c.csv"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none/c.csv").write_text("# nothing\n")
    assert read_recordings(spark, str(tmp_path / "none")).samples.count() == 0


def test_written_recordings_come_back_with_their_statistics(spark, tmp_path):
    from ridgeline.sources.logger import read_recordings, run_statistics, write_csv

    samples = spark.range(300).select((F.col("id") % 3).cast("string").alias("session_key"), F.floor(F.col("id") / 3).alias("sample_idx"), (F.col("id") / 300).alias("time_s"), (F.col("id") * 1.5).alias("travel, rear [mm]"), F.col("id").alias("mark"))
    columns = ["time_s", "travel, rear [mm]", "mark"]
    write_csv(samples.repartition(5), str(tmp_path / "plain"), columns)
    statistics = spark.createDataFrame([("0", "samples_dropped", "4"), ("0", "flush_avg_ms", "1.25"), ("1", "samples_dropped", "0")], "session_key string, name string, value string")
    write_csv(samples, str(tmp_path / "more"), columns, statistics)
    for folder in ("plain", "more"):
        files = sorted((tmp_path / folder).glob("session_key=*/*.txt"))
        assert len(files) == 3
        for f in files:
            f.rename(f.parent / f"{f.parent.name[-1]}.csv")
        back = read_recordings(spark, str(tmp_path / folder), keep_first_sample=True).samples
        assert {r.session_key: r["count"] for r in back.groupBy("session_key").count().collect()} == {"0": 100, "1": 100, "2": 100}
        assert back.agg(F.sum("`travel, rear [mm]`")).first()[0] == pytest.approx(1.5 * 299 * 150)
    said = {(r.path[-5], r.key): r.value for r in run_statistics(spark, str(tmp_path / "more/*")).collect()}
    assert said == {("0", "samples_dropped"): "4", ("0", "flush_avg_ms"): "1.25", ("1", "samples_dropped"): "0"}
    assert {r.value for r in run_statistics(spark, str(tmp_path / "plain/*")).collect()} == {"100"}


def test_artifacts_of_different_schemas_are_read_together(spark, tmp_path):
    from ridgeline.sources.store import ArtifactStore

    store = ArtifactStore(spark, str(tmp_path))
    store.write(spark.createDataFrame([("jump", 1, None, Row(a=1))], "schema_id string, idx long, note void, x struct<a:int>"), "events", "r1", "s1")
    store.write(spark.createDataFrame([("jump", 2.5, "n", Row(a=2.5, b="u"))], "schema_id string, idx double, note string, x struct<a:double,b:string>"), "events", "r1", "s2")
    store.write(spark.createDataFrame([("dip", None, [1], True)], "schema_id string, idx void, more array<int>, flag boolean"), "events", "r2", "s1")
    store.write(spark.createDataFrame([("dip", 7, [1.5], "yes")], "schema_id string, idx int, more array<double>, flag string"), "events", "r2", "s2")
    rows = {r.session_key: r for r in store.read("events").collect()}
    assert len(rows) == 4 and dict(store.read("events").dtypes)["idx"] == "double"
    assert [rows[k].idx for k in ("r1::s1", "r1::s2", "r2::s1", "r2::s2")] == [1.0, 2.5, None, 7.0]
    assert (rows["r1::s1"].note, rows["r1::s2"].note, rows["r2::s1"].note) == (None, "n", None)
    assert rows["r1::s1"].x == Row(a=1.0, b=None) and rows["r1::s2"].x == Row(a=2.5, b="u") and rows["r2::s1"].x is None
    assert rows["r2::s1"].more == [1.0] and rows["r2::s2"].more == [1.5] and (rows["r2::s1"].flag, rows["r2::s2"].flag) == ("true", "yes")
    assert store.read("events", ["session_id", "idx"]).columns == ["session_key", "session_id", "idx"]
    with pytest.raises(FileNotFoundError):
        store.read("metrics")


def test_widest_is_a_lattice():
    from itertools import permutations

    from pyspark.sql.types import ArrayType, BooleanType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, StringType, TimestampType

    from ridgeline.sources.store import widest

    kinds = [NullType(), IntegerType(), LongType(), FloatType(), DoubleType(), DecimalType(10, 2), DecimalType(5, 4), DateType(), TimestampType(), BooleanType(), StringType(), ArrayType(LongType()), ArrayType(DoubleType())]
    for a, b in permutations(kinds, 2):
        assert widest(a, b) == widest(b, a) and widest(a, a) == a and widest(widest(a, b), b) == widest(a, b)
    assert widest(LongType(), DoubleType()) == DoubleType() and widest(IntegerType(), FloatType()) == DoubleType()
    assert widest(DecimalType(10, 2), DecimalType(5, 4)) == DecimalType(12, 4) and widest(DateType(), LongType()) == StringType()


def test_route_view_chooses_a_stream_and_fills_altitude_and_speed(spark):
    from ridgeline.sources.gps import route_view

    lat, lon = "gps_fit_position_latitude_dom_world [deg]", "gps_fit_position_longitude_dom_world [deg]"
    high, fast = "gps_fit_enhanced_altitude_dom_world [m]", "gps_fit_speed_dom_world [m/s]"
    fields = f"session_key string, pos long, time_s double, `{lat}` double, `{lon}` double"
    samples = spark.createDataFrame([(s, i, float(i), 1.0 + i, 2.0, 100.0 + 10 * i, float("nan") if i % 2 else 3.0 * i) for s in ("a", "b", "c") for i in range(5)] + [("d", 0, 0.0, None, None, 1.0, 1.0)], f"session_key string, sample_idx long, time_s double, `{lat}` double, `{lon}` double, `{high}` double, `{fast}` double")
    fit = spark.createDataFrame([("a", 0, 0.5, 7.0, 8.0), ("a", 1, 0.5, 9.0, 9.0), ("a", 2, 2.5, 7.5, 8.5), ("a", 3, 99.0, 1.0, 1.0), ("b", 0, 1.0, None, 8.0)], fields)
    other = spark.createDataFrame([("a", 0, 1.0, 0.0, 0.0, 5.0), ("b", 0, 1.5, 6.0, 6.0, 7.0)], f"{fields}, `{fast}` double")
    got = {}
    for r in route_view(samples, {"other": other, "gps_fit": fit}).orderBy("session_key", "sample_idx").collect():
        got.setdefault(r.session_key, []).append((r.stream, r.time_s, r.lat, r.lon, r.altitude, r.speed))
    assert got["a"] == [("gps_fit", 0.5, 7.0, 8.0, 105.0, 1.5), ("gps_fit", 2.5, 7.5, 8.5, 125.0, 7.5)]
    assert got["b"] == [("other", 1.5, 6.0, 6.0, 115.0, 7.0)]
    assert [x[0] for x in got["c"]] == ["primary"] * 5 and [x[5] for x in got["c"]] == [0.0, None, 6.0, None, 12.0] and "d" not in got


@pytest.mark.parametrize("first", [False, True])
def test_chunks_of_a_file_give_what_the_whole_file_does(spark, tmp_path, monkeypatch, first):
    from ridgeline.sources import logger

    monkeypatch.setattr(logger, "CHUNK", 3, raising=False)
    times = [5, 6, 7, 6, 7, 8, 8, 3, 4, 9, 2, 1, 0, 10, 11, 9, 12, 13, 1, 14]
    (tmp_path / "a.csv").write_text("# about\ntime_ms,y\n" + "".join(f"{t},{i}\n" for i, t in enumerate(times)))
    samples = logger.read_csv(spark, str(tmp_path / "a.csv"), keep_first_sample=first).samples
    kept = [(t, i) for i, t in enumerate(times) if t not in times[:i]]
    want = [(t, i) for k, (t, i) in enumerate(kept) if (t > kept[k - 1][0] if k else first)]
    assert [tuple(r) for r in samples.orderBy("sample_idx").select("sample_idx", "time_s", "y").collect()] == [(k, pytest.approx((t - 5) / 1e3), i) for k, (t, i) in enumerate(want)]
    # no window or sort takes a file whole but those over its chunks
    plan = samples._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Window [" in line and "[path" in line and "chunk" not in line and "time_s" not in line]
