"""Live sample streams: stateful operators on Structured Streaming, one state per sensor.

A sample waits in its sensor's state until the watermark has passed its event
time; then all that wait are put in order and folded into the sensor's few
numbers. So a sample that is late by less than the watermark's delay counts where
it belongs, whatever batch it comes in, and one that is later is dropped by Spark.
Timers in event time release what waits when no sample of the sensor comes, and
free a sensor that has been idle. Keys scale out; a state holds the samples of
the delay. Back-pressure is the source's (``maxFilesPerTrigger``,
``maxOffsetsPerTrigger``); flush policy is the trigger
(``processingTime='5 seconds'``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import isnan

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ridgeline.functions.scalars import lookup, polynomial

RATES_HZ = (10, 20, 50, 100, 200, 500, 1000)


def grid_source(spark: SparkSession, rate_hz: int, t0_us: int = 0) -> DataFrame:
    """sample_id, t_us on the grid t0 + n / rate: event time is the sample's number, not its arrival."""
    if rate_hz not in RATES_HZ:
        raise ValueError(f"the rate is one of {RATES_HZ}")
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate_hz).load()
    return rows.select(F.col("value").alias("sample_id"), (F.lit(t0_us) + F.col("value") * (1_000_000 // rate_hz)).alias("t_us"))


#: Milliseconds after its last sample that a sensor's state is freed.
IDLE_MS = 3_600_000


def _folded(stream: DataFrame, key: str, order: str, value: str, at: str, late: str, out: str, state: str, step: Callable[[tuple | None, list[int], list[float | None]], tuple[tuple, dict[str, list]]], idle_ms: int) -> DataFrame:
    """key and out; step folds samples in order (a missing value is None) into the state's numbers."""
    names = [x.split()[0] for x in out.split(", ")]
    width = len(state.split(", "))
    rows = stream.select(key, F.col(order).cast("long").alias("__order"), F.col(value).cast("double").alias("__value"), F.col(at).alias("__at"))
    rows = rows.withWatermark("__at", late).withColumn("__ms", F.unix_millis(F.col("__at").cast("timestamp")))

    def run(k: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        numbers, waiting, last = None, [], 0
        if held.exists:
            *numbers, begun, orders, values, times, last = held.get
            numbers = tuple(numbers) if begun else None
            waiting = [(o, None if v is None or isnan(v) else v, t) for o, v, t in zip(orders, values, times, strict=True)]
        if not held.hasTimedOut:
            for pdf in batches:
                waiting += [(o, None if v is None or isnan(v) else v, t) for o, v, t in zip(pdf["__order"].tolist(), pdf["__value"].tolist(), pdf["__ms"].tolist(), strict=True)]
        now = held.getCurrentWatermarkMs()
        ready = sorted((x for x in waiting if x[2] <= now), key=lambda x: x[0])
        waiting = [x for x in waiting if x[2] > now]
        result: dict[str, list] = {n: [] for n in names}
        if ready:
            numbers, result = step(numbers, [x[0] for x in ready], [x[1] for x in ready])
            last = max(last, max(x[2] for x in ready))
        if not waiting and held.hasTimedOut and last + idle_ms <= now:
            held.remove()
        else:
            full = (*(numbers or (None,) * width), numbers is not None, [x[0] for x in waiting], [float("nan") if x[1] is None else x[1] for x in waiting], [x[2] for x in waiting], last)
            held.update(full)
            held.setTimeoutTimestamp(max(now + 1, min((x[2] for x in waiting), default=last + idle_ms)))
        frame = pd.DataFrame({n: pd.Series(x, dtype=object) for n, x in result.items()})
        yield frame.assign(**{key: k[0]})

    kept = f"{state}, begun boolean, orders array<long>, waiting array<double>, times array<long>, last long"
    kind = dict(stream.dtypes)[key]
    return rows.groupBy(key).applyInPandasWithState(run, f"{out}, {key} {kind}", kept, "append", GroupStateTimeout.EventTimeTimeout)


def ema(stream: DataFrame, key: str, order: str, value: str, alpha: float, deadband: float, at: str = "at", late: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """key, order, ema: the average that holds within its dead band, rounded half up; a missing sample clears it."""

    def step(held: tuple | None, orders: list[int], values: list[float | None]) -> tuple[tuple, dict[str, list]]:
        e, out = None if held is None else held[0], []
        for x in values:
            e = x if e is None or x is None else e if abs(e - x) < deadband else alpha * x + (1 - alpha) * e
            out.append(None if e is None else int((e + 0.5) // 1))
        return (e,), {order: orders, "ema": out}

    return _folded(stream, key, order, value, at, late, f"{order} long, ema long", "e double", step, idle_ms)


def turns(stream: DataFrame, key: str, order: str, value: str, span: int, limit: int, at: str = "at", late: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """key, order, turns, unwrapped: a fall of limit or more is a turn forward, a rise one back; over a missing sample there is no turn."""

    def step(held: tuple | None, orders: list[int], values: list[float | None]) -> tuple[tuple, dict[str, list]]:
        before, n = held if held is not None else (None, 0)
        count = []
        for x in values:
            d = 0 if before is None or x is None else x - before
            n += 1 if d <= -limit else -1 if d >= limit else 0
            before = x
            count.append(int(n))
        return (before, int(n)), {order: orders, "turns": count, "unwrapped": [None if v is None else int(c * span + v) for c, v in zip(count, values, strict=True)]}

    return _folded(stream, key, order, value, at, late, f"{order} long, turns long, unwrapped long", "before double, turns long", step, idle_ms)


def crossings(stream: DataFrame, key: str, order: str, value: str, level: float, hysteresis: float = 0.0, min_gap: int = 0, at: str = "at", late: str = "10 seconds", idle_ms: int = IDLE_MS) -> DataFrame:
    """key, order, strength of rising crossings while armed; one that follows the last within min_gap is left out."""

    def step(held: tuple | None, orders: list[int], values: list[float | None]) -> tuple[tuple, dict[str, list]]:
        before, armed, last = held if held is not None else (None, True, None)
        found, strength = [], []
        for i, y in zip(orders, values, strict=True):
            if before is not None and y is not None and armed and before < level <= y:
                armed = False
                if last is None or i - last >= min_gap:
                    found.append(i)
                    strength.append(float(y - before))
                last = i
            if y is not None and y <= level - hysteresis:
                armed = True
            before = y
        return (before, bool(armed), None if last is None else int(last)), {order: found, "strength": strength}

    return _folded(stream, key, order, value, at, late, f"{order} long, strength double", "before double, armed boolean, crossed long", step, idle_ms)


def engineering(counts: Column, zero: float, per_unit: float, invert: bool = False, transform: tuple[str, list] | None = None) -> Column:
    """Counts to units: (counts - zero) / per_unit, inverted if asked, then a polynomial or a lookup."""
    x = (counts - F.lit(float(zero))) / F.lit(float(per_unit))
    x = -x if invert else x
    if transform is None:
        return x
    kind, values = transform
    return polynomial(x, values) if kind == "poly" else lookup(x, values)


def with_marks(samples: DataFrame, marks: DataFrame, key: str, t_us: str, step_us: int, late: str = "10 seconds") -> DataFrame:
    """samples with mark: at most one user mark for each sample, that of its interval."""
    cell = (F.floor(F.col(t_us) / step_us) * step_us).alias("__cell")
    stamp = lambda c: F.timestamp_micros(c)
    m = marks.select(F.col(key).alias("__key"), cell, stamp(F.col(t_us)).alias("__m_at")).withWatermark("__m_at", late).dropDuplicatesWithinWatermark(["__key", "__cell"])
    s = samples.withColumns({"__cell_s": F.floor(F.col(t_us) / step_us) * step_us, "__s_at": stamp(F.col(t_us))}).withWatermark("__s_at", late)
    near = (F.col(key) == F.col("__key")) & (F.col("__cell_s") == F.col("__cell")) & (F.col("__m_at") >= F.col("__s_at") - F.expr(f"INTERVAL {step_us} MICROSECONDS")) & (F.col("__m_at") <= F.col("__s_at") + F.expr(f"INTERVAL {step_us} MICROSECONDS"))
    return s.join(m, near, "leftOuter").select(*samples.columns, F.col("__key").isNotNull().alias("mark"))


def log_sink(stream: DataFrame, path: str, checkpoint: str, every: str = "5 seconds"):
    """Writes a stream as Parquet every so often."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
