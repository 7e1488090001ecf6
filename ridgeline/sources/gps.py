"""GPS streams: decoded records to samples, choice of the file that fits a session, routes.

Binary recordings need a decoder, which is a parameter: a function from bytes
to record dicts. Decoded Parquet or CSV is read as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import semicircles_to_degrees, speed_class
from ridgeline.operators import joins, selection, series
from ridgeline.operators.series import finite

#: Field: canonical column, whether it is in semicircles (fixed names).
FIELDS = {
    "position_lat": ("gps_fit_position_latitude_dom_world [deg]", True),
    "position_long": ("gps_fit_position_longitude_dom_world [deg]", True),
    "altitude": ("gps_fit_altitude_dom_world [m]", False),
    "enhanced_altitude": ("gps_fit_enhanced_altitude_dom_world [m]", False),
    "speed": ("gps_fit_speed_dom_world [m/s]", False),
    "enhanced_speed": ("gps_fit_enhanced_speed_dom_world [m/s]", False),
    "distance": ("gps_fit_distance_dom_world [m]", False),
    "grade": ("gps_fit_grade_dom_world [%]", False),
    "heading": ("gps_fit_heading_dom_world [deg]", False),
}


def decode(spark: SparkSession, paths: str, decoder: Callable[[bytes], Iterator[dict]], fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """path, pos, timestamp and the fields of every record that has a timestamp."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [r for r in decoder(bytes(content)) if r.get("timestamp") is not None]
                yield pd.DataFrame({"path": path, "pos": range(len(rows)), "timestamp": pd.to_datetime([r["timestamp"] for r in rows], utc=True)} | {f: pd.Series([r.get(f) for r in rows], dtype=float) for f in fields})

    schema = "path string, pos long, timestamp timestamp, " + ", ".join(f"{f} double" for f in fields)
    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(run, schema)


def file_summary(records: DataFrame, fields: Sequence[str] = tuple(FIELDS)) -> DataFrame:
    """path, first and last timestamp in file order, the fields that hold a value."""
    held = F.array_compact(F.array(*[F.when(F.count(f) > 0, F.lit(f)) for f in fields if f in records.columns]))
    return records.groupBy("path").agg(F.min_by("timestamp", "pos").alias("fit_start"), F.max_by("timestamp", "pos").alias("fit_end"), held.alias("fields"))


def stream(records: DataFrame, start: Column, keys: Sequence[str] = ("path",)) -> DataFrame:
    """keys, time_s since start, canonical columns; the first record of each time."""
    t = (F.unix_micros("timestamp") - F.unix_micros(start)) / 1e6
    cols = [(semicircles_to_degrees(F.col(f)) if half else F.col(f).cast("double")).alias(c) for f, (c, half) in FIELDS.items() if f in records.columns]
    rows = records.select(*keys, "pos", "timestamp", t.alias("time_s"), *cols)
    return series.keep_first(rows, list(keys), "time_s", ["pos"]).drop("pos")


def candidates(sessions: DataFrame, files: DataFrame, contained: bool = False) -> DataFrame:
    """Sessions (session_id, start, end) with the files (path, fit_start, fit_end) that overlap them; a path counts once whatever its case."""
    us = lambda c: F.unix_micros(c).alias(f"__{c}")
    one = series.keep_first(files.withColumn("__low", F.lower("path")), [], "__low", ["path"]).drop("__low")
    a = sessions.withColumn("__k", F.lit(0)).select("*", us("start"), us("end"))
    b = one.withColumn("__k", F.lit(0)).select("*", us("fit_start"), us("fit_end"))
    out = joins.overlap_join(a, b, ["__k"], ("__start", "__end"), ("__fit_start", "__fit_end"), 86_400_000_000, contained)
    return out.withColumn("overlap_s", F.col("overlap") / 1e6).drop("overlap", "__k", "__start", "__end", "__fit_start", "__fit_end")


def choose(cands: DataFrame, policy: str = "largest_overlap", bindings: DataFrame | None = None) -> DataFrame:
    """session_id, status, path: one file per session.

    A single candidate is taken. Of several, latest_start and largest_overlap
    take the best; require_binding takes the one that bindings (session_id, and
    path or sha256: what is given must fit) name, and else the session is
    ambiguous.
    """
    name = F.element_at(F.split(F.col("path"), "/"), -1)
    order = {"latest_start": F.struct("fit_start", "path"), "largest_overlap": F.struct("overlap_s", "path"), "require_binding": F.struct("path")}[policy]
    per = cands.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max_by("path", order).alias("best"))
    if policy != "require_binding":
        return per.select("session_id", F.lit("auto_match").alias("status"), F.col("best").alias("path"))
    if bindings is None:
        return per.select("session_id", F.when(F.col("n") == 1, "auto_match").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("best")).alias("path"))
    text = lambda df, c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
    b = bindings.select("session_id", F.element_at(F.split(F.col("path"), "/"), -1).alias("__name") if "path" in bindings.columns else F.lit(None).cast("string").alias("__name"), text(bindings, "sha256").alias("__sha"))
    b = b.filter("__name is not null or __sha is not null")
    fits = (F.col("__name").isNull() | (F.col("__name") == name)) & (F.col("__sha").isNull() | (F.col("__sha") == F.col("__own")))
    bound = cands.withColumn("__own", text(cands, "sha256")).join(b, "session_id").filter(F.coalesce(fits, F.lit(False)))
    bound = bound.groupBy("session_id").agg(F.count_distinct("path").alias("__bound"), F.first("path").alias("__path"))
    out = per.join(bound, "session_id", "left")
    hit = F.col("__bound") == 1
    return out.select("session_id", F.when(F.col("n") == 1, "auto_match").when(hit, "bound_match").otherwise("ambiguous").alias("status"), F.when(F.col("n") == 1, F.col("best")).when(hit, F.col("__path")).alias("path"))


def upsert_binding(bindings: DataFrame, new: DataFrame) -> DataFrame:
    """bindings with the rows of new in place of those of the same session."""
    return bindings.join(new, "session_id", "left_anti").unionByName(new, allowMissingColumns=True)


def onto_samples(samples: DataFrame, gps: DataFrame, columns: Sequence[str], keys: Sequence[str] = ("session_key",), cell_s: float | None = None) -> DataFrame:
    """samples plus the GPS columns, linear between fixes; with cell_s long sessions are cut into cells of that length."""
    return joins.interp_columns(samples, gps, list(keys), "time_s", {c: c for c in columns}, cell=cell_s)


def candidate_states(sessions: DataFrame, files: DataFrame | None, enabled: bool = True, policy: str = "require_binding", bindings: DataFrame | None = None, contained: bool = False) -> DataFrame:
    """session_id, status, n_candidates, path for every session (session_id, start, end).

    disabled: no import is wanted; invalid_config: there are no files to look
    through; missing_anchor: the session has no absolute time; no_match: no file
    overlaps it; auto_match: one does; bound_match: one of several is chosen, by
    the policy or a binding; ambiguous: several, and none is chosen.
    """
    zero = F.lit(0).cast("long")
    if not enabled or files is None:
        return sessions.select("session_id", F.lit("invalid_config" if enabled else "disabled").alias("status"), zero.alias("n_candidates"), F.lit(None).cast("string").alias("path"))
    cands = candidates(sessions.filter("start is not null and end is not null"), files, contained)
    n = cands.groupBy("session_id").agg(F.count(F.lit(1)).alias("__n"))
    out = sessions.join(n, "session_id", "left").join(choose(cands, policy, bindings).select("session_id", "path"), "session_id", "left")
    status = F.when(F.col("start").isNull() | F.col("end").isNull(), "missing_anchor").when(F.col("__n").isNull(), "no_match").when(F.col("__n") == 1, "auto_match")
    status = status.when(F.col("path").isNotNull(), "bound_match").otherwise("ambiguous")
    return out.select("session_id", status.alias("status"), F.coalesce("__n", zero).alias("n_candidates"), "path")


@dataclass
class Enriched:
    """samples with the GPS columns, the sessions' own GPS streams, and each session's state."""

    samples: DataFrame
    stream: DataFrame
    states: DataFrame


def enrich(samples: DataFrame, anchors: DataFrame, records: DataFrame, policy: str = "require_binding", bindings: DataFrame | None = None, contained: bool = False, columns: Sequence[str] | None = None, cell_s: float | None = 600.0) -> Enriched:
    """Finds each session's GPS file, takes its records as a stream of the session, and interpolates them onto the samples.

    anchors has session_key and anchor (the absolute time of time_s 0, or null).
    Sessions without a chosen file keep their samples, with nulls.
    """
    bounds_ = selection.session_bounds(samples, anchors).withColumnRenamed("session_key", "session_id")
    states = candidate_states(bounds_, file_summary(records), True, policy, bindings, contained)
    mine = states.filter("path is not null").select(F.col("session_id").alias("session_key"), "path").join(anchors, "session_key")
    own = stream(records.join(mine, "path"), F.col("anchor"), ("session_key",))
    held = list(columns) if columns is not None else [c for c, _ in FIELDS.values() if c in own.columns]
    return Enriched(onto_samples(samples, own, [c for c in held if c in own.columns], cell_s=cell_s), own, states)


def route(gps: DataFrame, lat: str, lon: str, keys: Sequence[str] = ("session_key",), lo: Column | None = None, hi: Column | None = None) -> DataFrame:
    """Points with known place inside the session's time, one per time, in order (sample_idx)."""
    rows = gps.filter(F.col(f"`{lat}`").isNotNull() & F.col(f"`{lon}`").isNotNull())
    rows = rows.filter(F.col("time_s") >= lo) if lo is not None else rows
    rows = rows.filter(F.col("time_s") <= hi) if hi is not None else rows
    held = [F.col(f"`{c}`") for c in rows.columns if c not in (*keys, "time_s")]
    first = series.keep_first(rows.withColumn("__order", F.to_json(F.struct(*held))), list(keys), "time_s", ["pos" if "pos" in rows.columns else "__order"])
    return series.with_sample_idx(first.drop("__order"), list(keys), ["time_s"])


#: What a route shows, and the columns that it is taken from: the first that a stream has.
SHOWN = {"lat": ("position_lat",), "lon": ("position_long",), "altitude": ("enhanced_altitude", "altitude"), "speed": ("enhanced_speed", "speed"), "distance": ("distance",)}


def route_view(samples: DataFrame, streams: Mapping[str, DataFrame], prefer: str = "gps_fit", cell_s: float | None = 600.0) -> DataFrame:
    """session_key, stream, sample_idx, time_s, lat, lon, altitude, speed, distance: each session's route.

    A session's route comes from the preferred stream, else the next in order that
    has a place of it, else from its own samples (stream primary), within the
    samples' time. Where the route of a session has no altitude, or no speed, at
    all, it is interpolated from the samples.
    """
    names = [*([prefer] if prefer in streams else []), *[n for n in streams if n != prefer]]
    sources = [*[(n, streams[n]) for n in names], ("primary", samples)]
    number = lambda df, what: next((finite(F.col(f"`{FIELDS[f][0]}`")) for f in SHOWN[what] if FIELDS[f][0] in df.columns), F.lit(None).cast("double")).alias(what)
    points = None
    for turn, (name, df) in enumerate(sources):
        order = next((F.col(c).cast("long") for c in ("pos", "sample_idx") if c in df.columns), F.lit(0).cast("long"))
        own = df.select("session_key", F.lit(turn).alias("__turn"), F.lit(name).alias("stream"), order.alias("__order"), finite(F.col("time_s")).alias("time_s"), *[number(df, w) for w in SHOWN])
        points = own if points is None else points.unionByName(own)
    points = points.filter("time_s is not null and lat is not null and lon is not null")
    points = points.withColumn("__first", F.min("__turn").over(Window.partitionBy("session_key"))).filter("__turn = __first")
    ends = samples.groupBy("session_key").agg(F.min("time_s").alias("__a"), F.max("time_s").alias("__b"))
    points = points.join(ends, "session_key").filter("time_s between __a and __b")
    out = series.with_sample_idx(series.keep_first(points, ["session_key"], "time_s", ["__order"]), ["session_key"], ["time_s"])
    whole = Window.partitionBy("session_key")
    for what in ("altitude", "speed"):
        own = samples.select("session_key", "time_s", number(samples, what).alias("__own")).filter("__own is not null")
        own = series.keep_first(own.withColumn("__o", F.col("__own")), ["session_key"], "time_s", ["__o"]).drop("__o")
        out = joins.interp_columns(out, own, ["session_key"], "time_s", {"__own": "__fill"}, single_constant=True, cell=cell_s)
        out = out.withColumn(what, F.when(F.count(what).over(whole) > 0, F.col(what)).otherwise(F.col("__fill"))).drop("__fill")
    return out.select("session_key", "stream", "sample_idx", "time_s", *SHOWN)


def colour_runs(segments: DataFrame, lat: str, lon: str, speed_ms: str, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """keys, speed_class and the runs of that class: arrays of (lat, lon) of consecutive segments."""
    cls = speed_class(F.col(speed_ms) * 3.6)
    w = Window.partitionBy(*keys).orderBy("sample_idx")
    rows = segments.withColumn("speed_class", cls)
    new = F.when(F.col("speed_class").eqNullSafe(F.lag("speed_class").over(w)) & (F.col("sample_idx") - F.lag("sample_idx").over(w) == 1), 0).otherwise(1)
    rows = rows.withColumn("__new", new).withColumn("run", F.sum("__new").over(w))
    point = F.struct("sample_idx", F.col(lat).alias("lat"), F.col(lon).alias("lon"))
    last = F.struct(F.col(f"{lat}_next").alias("lat"), F.col(f"{lon}_next").alias("lon"))
    per = rows.groupBy(*keys, "speed_class", "run").agg(F.sort_array(F.collect_list(point)).alias("p"), F.max_by(last, "sample_idx").alias("last"))
    line = F.concat(F.transform("p", lambda x: F.struct(x["lat"].alias("lat"), x["lon"].alias("lon"))), F.array("last"))
    return per.select(*keys, "speed_class", "run", line.alias("points"))


def bounds(route_: DataFrame, lat: str, lon: str, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    ends = [f(c).alias(f"{n}_{a}") for c, a in ((lat, "lat"), (lon, "lon"), ("time_s", "t")) for n, f in (("min", F.min), ("max", F.max))]
    return route_.groupBy(*keys).agg(*ends)


def in_window(segments: DataFrame, t: str, t_next: str, t0: float | None, t1: float | None) -> DataFrame:
    """Segments that touch the window between t0 and t1, in either order; all if one is missing."""
    if t0 is None or t1 is None:
        return segments
    return segments.filter((F.col(t_next) >= min(t0, t1)) & (F.col(t) <= max(t0, t1)))
