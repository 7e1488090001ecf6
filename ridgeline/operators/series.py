"""Operators on ordered sample series: window expressions partitioned by session.

A series is a DataFrame with session columns and ``sample_idx`` (0-based row
position). Nearly all of these are built-in window functions: one exchange by
session, one sort, and Catalyst shares both between operators that follow one
another.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Iterator, Sequence
from math import floor, isnan, nan

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ridgeline.operators.blocks import streamed

ALL = (Window.unboundedPreceding, Window.unboundedFollowing)


def _by(keys: Sequence[str], *order: str | Column):
    return Window.partitionBy(*keys).orderBy(*order)


def with_sample_idx(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds sample_idx, the row's position in its session; ties of time go by the further order columns."""
    return df.withColumn("sample_idx", (F.row_number().over(_by(keys, *order)) - 1).cast("long"))


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite: null is the only missing value."""
    x = x.cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _crossing(y: Column, before: Column, level: float, rising: bool) -> Column:
    return (before < level) & (y >= level) if rising else (before > level) & (y <= level)


def threshold_crossings(df: DataFrame, keys: Sequence[str], value: str, level: float, hysteresis: float = 0.0, direction: str = "rising") -> DataFrame:
    """Samples where the series crosses level while armed, with direction and strength (size of the step).

    A crossing disarms until the series is back by the hysteresis. A row that
    re-arms starts a new group; the first crossing of each group fires.
    """
    w = _by(keys, "sample_idx")
    y, before = F.col(value), F.lag(value).over(w)
    out = None
    for rising in (True, False):
        if direction not in ("either", "rising" if rising else "falling"):
            continue
        back = y <= level - hysteresis if rising else y >= level + hysteresis
        armed = F.sum(F.when(back & (F.col("sample_idx") > 0), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
        one = df.withColumns({"__hit": _crossing(y, before, level, rising), "__group": F.coalesce(armed, F.lit(0)), "strength": F.abs(y - before), "direction": F.lit("rising" if rising else "falling")})
        one = one.filter("__hit").withColumn("__nth", F.row_number().over(_by([*keys, "__group"], "sample_idx"))).filter("__nth = 1")
        one = one.drop("__hit", "__group", "__nth")
        out = one if out is None else out.unionByName(one)
    return out


def zero_crossings(df: DataFrame, keys: Sequence[str], value: str, hysteresis: float = 0.0, direction: str = "rising") -> DataFrame:
    return threshold_crossings(df, keys, value, 0.0, hysteresis, direction)


def local_extrema(df: DataFrame, keys: Sequence[str], value: str, kind: str = "max") -> DataFrame:
    """Strict neighbours' extrema, without prominence: the sample and its value."""
    w = _by(keys, "sample_idx")
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    y = F.col(value)
    hit = (y > before) & (y > after) if kind == "max" else (y < before) & (y < after)
    return df.withColumn("__hit", hit).filter("__hit").drop("__hit")


def debounce(cands: DataFrame, keys: Sequence[str], min_gap: float, score: str | None, prefer: str = "abs", at: str = "sample_idx") -> DataFrame:
    """One candidate per cluster; a gap below min_gap to the previous candidate continues a cluster.

    prefer: abs, max or min of score; the first wins ties, and a missing score
    loses. A gap of 0 or less keeps all.
    """
    if min_gap <= 0:
        return cands
    gap = F.col(at) - F.lag(at).over(_by(keys, at))
    start = F.when(gap.isNull() | (gap >= min_gap), 1).otherwise(0)
    out = cands.withColumn("__start", start).withColumn("__cluster", F.sum("__start").over(_by(keys, at).rowsBetween(Window.unboundedPreceding, 0)))
    s = F.col(score) if score else F.lit(None).cast("double")
    s = F.abs(s) if prefer == "abs" else -s if prefer == "min" else s
    best = F.row_number().over(_by([*keys, "__cluster"], s.desc_nulls_last(), at))
    return out.withColumn("__best", best).filter("__best = 1").drop("__start", "__cluster", "__best")


def occurrences(events: DataFrame, keys: Sequence[str], name: str, at: str = "sample_idx") -> DataFrame:
    """Adds occurrence (0-based count per keys in order) and event_id name:key:n."""
    n = F.row_number().over(_by(keys, at)) - 1
    return events.withColumn("occurrence", n).withColumn("event_id", F.concat_ws(":", F.lit(name), *[F.col(k).cast("string") for k in keys], n.cast("string")))


def gap_segments(df: DataFrame, keys: Sequence[str], t: str, factor: float = 10.0, floor_s: float = 0.0) -> DataFrame:
    """Adds dt, gap (dt above factor * the session's median dt and the floor) and segment_id."""
    w = _by(keys, "sample_idx")
    out = df.withColumn("dt", F.col(t) - F.lag(t).over(w))
    median = F.percentile("dt", 0.5).over(Window.partitionBy(*keys))
    out = out.withColumn("__median", median)
    out = out.withColumn("gap", F.coalesce(F.col("dt") > F.greatest(F.col("__median") * factor, F.lit(floor_s)), F.lit(False))).drop("__median")
    return out.withColumn("segment_id", F.sum(F.col("gap").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def plot_breaks(df: DataFrame, gap: str, values: Sequence[str]) -> DataFrame:
    """Null values at gaps; booleans stay."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.when(F.col(gap), None).otherwise(F.col(c)) for c in values if kinds[c] != "boolean"})


def strictly_increasing(df: DataFrame, keys: Sequence[str], t: str, drop_first: bool = True) -> DataFrame:
    """Rows later than the previous raw row. The first row goes too unless drop_first is off."""
    step = F.col(t) - F.lag(t).over(_by(keys, "sample_idx"))
    keep = F.coalesce(step > 0, F.lit(not drop_first) & (F.col("sample_idx") == 0))
    return df.withColumn("__keep", keep).filter("__keep").drop("__keep")


def keep_first(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str]) -> DataFrame:
    """The first row of each session and time."""
    n = F.row_number().over(_by([*keys, t], *order))
    return df.withColumn("__n", n).filter("__n = 1").drop("__n")


def repair_monotonic(df: DataFrame, keys: Sequence[str], t: str, factor: float = 0.5) -> DataFrame:
    """Adds t_repaired: from each backward step on, the fall plus factor * median dt is added."""
    w = _by(keys, "sample_idx")
    out = df.withColumn("__dt", F.col(t) - F.lag(t).over(w))
    median = F.percentile(F.when(F.col("__dt") > 0, F.col("__dt")), 0.5).over(Window.partitionBy(*keys))
    bump = F.when(F.col("__dt") < 0, -F.col("__dt") + factor * F.coalesce(F.col("__median"), F.lit(0.0))).otherwise(0.0)
    out = out.withColumn("__median", median).withColumn("__bump", bump)
    return out.withColumn("t_repaired", F.col(t) + F.sum("__bump").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__dt", "__median", "__bump")


def moving_average(df: DataFrame, keys: Sequence[str], value: str, win: int, name: str = "smooth") -> DataFrame:
    """Centred mean of the non-null values among win samples; edges average what there is."""
    w = _by(keys, "sample_idx").rowsBetween(-(win // 2), (win - 1) // 2)
    return df.withColumn(name, F.avg(value).over(w))


def normalise(df: DataFrame, value: str, offset: Column, span: float | Column, clip: bool = False, name: str = "norm") -> DataFrame:
    """(value - offset) / span, null for a span of 0 or less, optionally clipped to 0..1."""
    span = F.lit(span) if not isinstance(span, Column) else span
    x = F.when(span > 0, (F.col(value) - offset) / span)
    x = F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))) if clip else x
    return df.withColumn(name, x)


def zero_offset(df: DataFrame, keys: Sequence[str], value: str, t_us: str, window_s: float, min_samples: int = 10, use_median: bool = True) -> DataFrame:
    """keys, offset: the least median (or mean) over trailing windows with enough samples, else the first value.

    A window holds the known samples of up to window_s before a time, all of that
    time included. Sessions (or segments, where keys name them) pass in order
    through one stream a partition that keeps the window's values sorted, so the
    time is linear but for the search in a window, and memory is a window.
    """
    rows = df.select(*keys, F.col(t_us).cast("long").alias("__t"), "sample_idx", finite(F.col(value)).alias("__v")).filter("__t is not null")
    span = int(window_s * 1e6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[int, float]] = deque()
        ordered: list[float] = []
        total, least, first, now, owner = 0.0, None, None, None, None
        kinds: list[pa.DataType] = []

        def settle() -> None:
            """The window that ends at the time now, of which all samples have come."""
            nonlocal least
            n = len(ordered)
            if n and n >= min_samples:
                level = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2 if use_median else total / n
                least = level if least is None else min(least, level)

        for batch in batches:
            out = []
            kinds = [batch.schema.field(k).type for k in keys]
            turns, times, values = (batch.column(c).to_pylist() for c in ("__turn", "__t", "__v"))
            for i, (turn, t, v) in enumerate(zip(turns, times, values, strict=True)):
                if turn == 1:
                    if owner is not None:
                        settle()
                        out.append((*owner, first if least is None else least))
                    held.clear()
                    ordered.clear()
                    total, least, first, now = 0.0, None, None, None
                    owner = tuple(batch.column(k)[i].as_py() for k in keys)
                if now is not None and t != now:
                    settle()
                now = t
                while held and held[0][0] < t - span:
                    gone = held.popleft()[1]
                    del ordered[bisect_left(ordered, gone)]
                    total -= gone
                if v is not None:
                    first = v if first is None else first
                    held.append((t, v))
                    insort(ordered, v)
                    total += v
            yield _columns(out, kinds)
        if owner is not None:
            settle()
            yield _columns([(*owner, first if least is None else least)], kinds)

    def _columns(out: list[tuple], kinds: list[pa.DataType]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * (len(keys) + 1)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*kinds, pa.float64()], strict=True)], [*keys, "offset"])

    fields = [*df.select(*keys).schema.fields, StructField("offset", DoubleType())]
    return streamed(rows, keys, ["__t", "sample_idx"]).mapInArrow(run, StructType(fields))


def activity_mask(df: DataFrame, keys: Sequence[str], disp: str, vel: str, t_us: str, disp_min: float, vel_min: float, window_s: float = 0.5, padding_s: float = 1.0, min_s: float = 3.0) -> DataFrame:
    """Adds active: inside a padded, merged block of activity that lasts min_s at least.

    A sample is busy if within the trailing window (its start excluded) some
    sample has both |disp| and |vel| above their limits.
    """
    us = lambda s: int(round(s * 1e6))
    raw = F.coalesce((F.abs(F.col(disp)) > disp_min) & (F.abs(F.col(vel)) > vel_min), F.lit(False)).cast("int")
    out = df.withColumn("__raw", raw)
    out = out.withColumn("__busy", F.max("__raw").over(_by(keys, t_us).rangeBetween(-(us(window_s) - 1), 0)))
    w = _by(keys, "sample_idx")
    out = out.withColumn("__new", F.when((F.col("__busy") == 1) & (F.coalesce(F.lag("__busy").over(w), F.lit(0)) == 0), 1).otherwise(0))
    out = out.withColumn("__block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = out.filter("__busy = 1").groupBy(*keys, "__block").agg((F.min(t_us) - us(padding_s)).alias("a"), (F.max(t_us) + us(padding_s)).alias("b"))
    o = _by(keys, "a", "__block")
    blocks = blocks.withColumn("__top", F.max("b").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    blocks = blocks.withColumn("__m", F.sum(F.when(F.col("a") <= F.col("__top"), 0).otherwise(1)).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    merged = blocks.groupBy(*keys, "__m").agg(F.min("a").alias("a"), F.max("b").alias("b")).filter(F.col("b") - F.col("a") >= us(min_s))
    # Merged blocks are disjoint: the last that began by a sample is the only one that can hold it.
    marks = merged.select(*keys, F.col("a").alias(t_us), F.col("b").alias("__end")).withColumn("__mark", F.lit(0))
    both = df.withColumns({"__mark": F.lit(1), "__end": F.lit(None).cast("long")}).unionByName(marks, allowMissingColumns=True)
    end = F.last("__end", ignorenulls=True).over(_by(keys, t_us, "__mark").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("active", F.coalesce(F.col(t_us) <= end, F.lit(False))).filter("__mark = 1").drop("__mark", "__end")


def unwrap(df: DataFrame, keys: Sequence[str], value: str, span: float, name: str = "unwrapped") -> DataFrame:
    """Adds value plus whole spans so that each step is the nearest of -1, 0, +1 spans (ties to -1)."""
    w = _by(keys, "sample_idx")
    d = F.col(value) - F.lag(value).over(w)
    k = F.when(d.isNull(), 0).when((F.abs(d - span) <= F.abs(d)) & (F.abs(d - span) <= F.abs(d + span)), -1).when(F.abs(d) <= F.abs(d + span), 0).otherwise(1)
    return df.withColumn("__k", k).withColumn(name, F.col(value) + F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0)) * span).drop("__k")


def wrap_turns(df: DataFrame, keys: Sequence[str], value: str, span: float, limit: float) -> DataFrame:
    """Adds turns and unwrapped: a fall of limit or more is a turn forward, a rise of limit or more one back."""
    w = _by(keys, "sample_idx")
    d = F.col(value) - F.lag(value).over(w)
    k = F.when(d <= -limit, 1).when(d >= limit, -1).otherwise(0)
    out = df.withColumn("__k", k).withColumn("turns", F.sum("__k").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("unwrapped", F.col("turns") * span + F.col(value)).drop("__k")


def route_segments(df: DataFrame, keys: Sequence[str], t: str, speed: str, *coords: str) -> DataFrame:
    """Pairs of consecutive points with rising time; speed is the mean of the known ends."""
    w = _by(keys, "sample_idx")
    nxt = {f"{c}_next": F.lead(c).over(w) for c in (t, speed, *coords)}
    out = df.withColumns(nxt).filter(F.col(f"{t}_next") > F.col(t))
    a, b = F.col(speed), F.col(f"{speed}_next")
    return out.withColumn("segment_speed", F.when(a.isNotNull() & b.isNotNull(), (a + b) / 2).otherwise(F.coalesce(a, b)))


def downsample(df: DataFrame, keys: Sequence[str], max_points: int) -> DataFrame:
    """At most max_points rows a session, at evenly spaced positions from the first to the last."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    out = df.withColumn("__n", n)
    parts, last = F.lit(max(max_points - 1, 1)), F.greatest(F.col("__n") - 1, F.lit(1))
    whole = lambda a, b: F.floor((a - F.pmod(a, b)) / b).cast("long")
    k = whole(F.col("sample_idx") * parts + last - 1, last)  # the first grid point at or after this sample
    hit = (F.col("__n") <= max_points) | (whole(k * last, parts) == F.col("sample_idx"))
    return out.filter(hit).drop("__n")


def refine_extremum(df: DataFrame, keys: Sequence[str], value: str, t: str) -> DataFrame:
    """Adds t_refined, the vertex of the parabola through the sample and its neighbours (offset within one sample)."""
    w = _by(keys, "sample_idx")
    a, y, b = F.lag(value).over(w), F.col(value), F.lead(value).over(w)
    bend = a - 2 * y + b
    shift = F.when(bend != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), 0.5 * (a - b) / bend))).otherwise(0.0)
    dt = (F.lead(t).over(w) - F.lag(t).over(w)) / 2
    return df.withColumn("t_refined", F.col(t) + shift * dt)


def block_average(df: DataFrame, keys: Sequence[str], value: str, t: str, size: int) -> DataFrame:
    """Means of size samples in a row; an incomplete last block is left out."""
    out = df.withColumn("block", F.floor(F.col("sample_idx") / size)).groupBy(*keys, "block")
    return out.agg(F.avg(t).alias("t"), F.avg(value).alias("value"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == size).drop("n")


def ema_deadband(df: DataFrame, keys: Sequence[str], value: str, alpha: float, deadband: float, name: str = "ema") -> DataFrame:
    """Adds the exponential average that holds within its dead band; the output is rounded half up.

    The hold makes it a fold, not a window sum. Sessions pass in order through
    one stream a partition that carries the average from batch to batch, so
    memory doesn't grow with a session. A missing sample clears the average, and
    the next one begins it anew.
    """
    own = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = nan
        for batch in batches:
            out = []
            for x, turn in zip(batch.column(value).cast(pa.float64()).to_pylist(), batch.column("__turn").to_pylist(), strict=True):
                x = nan if x is None else x
                if turn == 1 or isnan(e):
                    e = x
                elif not abs(e - x) < deadband:
                    e = alpha * x + (1 - alpha) * e
                out.append(None if isnan(e) else floor(e + 0.5))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in own], pa.array(out, pa.int64())], [*own, name])

    return streamed(df, keys, ["sample_idx"]).mapInArrow(run, StructType([*df.schema.fields, StructField(name, LongType())]))
