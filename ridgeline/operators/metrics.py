"""Metrics of event segments: one grouped aggregation for all metrics of a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def peak_metric(segments: DataFrame, keys: Sequence[str], role: str, t_rel: str, idx: str, kind: str = "max") -> DataFrame:
    """peak and peak_t (relative time of its first sample); null where the segment has no value."""
    y = F.col(role)
    best = F.struct((-y if kind == "max" else y).alias("y"), F.col(idx))
    first = F.min_by(F.struct(y.alias("peak"), F.col(t_rel).alias("peak_t")), F.when(y.isNotNull(), best))
    return segments.groupBy(*keys).agg(first.alias("x")).select(*keys, "x.*")


def interval_metrics(samples: DataFrame, keys: Sequence[str], role: str, t: str, idx: str, smooth: int = 1) -> DataFrame:
    """mean, most, least, delta (last known less first known) and trapezoid integral over an event's samples."""
    w = Window.partitionBy(*keys).orderBy(idx)
    rows = samples
    if smooth > 1:
        rows = rows.withColumn(role, F.avg(role).over(w.rowsBetween(-(smooth // 2), (smooth - 1) // 2)))
    rows = rows.withColumns({"__y": F.lag(role).over(w), "__t": F.lag(t).over(w)})
    y, known = F.col(role), F.when(F.col(role).isNotNull(), F.col(idx))
    area = F.sum((y + F.col("__y")) / 2 * (F.col(t) - F.col("__t")))
    return rows.groupBy(*keys).agg(F.avg(y).alias("mean"), F.max(y).alias("most"), F.min(y).alias("least"), (F.max_by(y, known) - F.min_by(y, known)).alias("delta"), F.coalesce(area, F.lit(0.0)).alias("integral"))


def time_above(samples: DataFrame, keys: Sequence[str], role: str, level: float, dt: Column) -> DataFrame:
    """Seconds with the role above the level."""
    return samples.groupBy(*keys).agg(F.sum(F.when(F.col(role) > level, dt).otherwise(0.0)).alias("time_above"))


def trigger_delta(start: Column, end: Column, absolute: bool = False) -> Column:
    """end - start, in the unit of both."""
    return F.abs(end - start) if absolute else end - start
