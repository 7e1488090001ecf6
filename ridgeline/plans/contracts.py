"""Contracts of sessions, events, metrics and segments: each check is one small aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that an events table must have (fixed names).
EVENT_COLUMNS = ("session_id", "event_id", "schema_id", "schema_version", "event_name", "signal", "start_idx", "end_idx", "trigger_idx", "start_time_s", "end_time_s", "trigger_time_s", "detector_version", "params_hash", "signal_col")
FORBIDDEN_IN_METRICS = ("start_idx", "end_idx", "start_time_s", "end_time_s")


class ContractError(ValueError):
    """A table that breaks its contract."""


def _need(df: DataFrame, columns: Sequence[str], what: str) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise ContractError(f"{what} lack columns {missing}")


def _fail(counts: dict, what: str) -> None:
    if bad := {k: v for k, v in counts.items() if v}:
        raise ContractError(f"{what}: {bad}")


def _unique(df: DataFrame, keys: Sequence[str], what: str) -> None:
    twice = df.groupBy(*keys).count().filter("count > 1").limit(5).collect()
    if twice:
        raise ContractError(f"{what} keys are not unique: {[tuple(r) for r in twice]}")


def check_session(samples: DataFrame, keys: Sequence[str] = ("session_key",)) -> None:
    """Times are known and never fall."""
    _need(samples, [*keys, "sample_idx", "time_s"], "samples")
    step = F.col("time_s") - F.lag("time_s").over(Window.partitionBy(*keys).orderBy("sample_idx"))
    row = samples.select("time_s", step.alias("d")).agg(F.count_if(F.col("time_s").isNull() | F.isnan("time_s")).alias("unknown times"), F.count_if(F.col("d") < 0).alias("times that fall")).first()
    _fail(row.asDict(), "samples")


def check_events(events: DataFrame, n_samples: int | None = None) -> None:
    _need(events, EVENT_COLUMNS, "events")
    _unique(events, ["session_id", "event_id"], "events")
    idx = [F.col(c) for c in ("start_idx", "trigger_idx", "end_idx")]
    times = [F.col(c) for c in ("start_time_s", "trigger_time_s", "end_time_s")]
    known = times[0].isNotNull() & times[1].isNotNull() & times[2].isNotNull()
    outside = (idx[0] < 0) | (idx[2] >= n_samples) if n_samples is not None else idx[0] < 0
    row = events.agg(
        F.count_if(~known).alias("unknown times"),
        F.count_if((idx[0] > idx[1]) | (idx[1] > idx[2])).alias("indices out of order"),
        F.count_if((times[0] > times[1]) | (times[1] > times[2])).alias("times out of order"),
        F.count_if(outside).alias("indices outside the session"),
    ).first()
    _fail(row.asDict(), "events")


def check_metrics(metrics: DataFrame, events: DataFrame | None = None, identity: Sequence[str] = ("schema_id",), strict: bool = False) -> None:
    keys = ["session_id", "event_id"]
    _need(metrics, keys, "metrics")
    if bad := [c for c in FORBIDDEN_IN_METRICS if c in metrics.columns]:
        raise ContractError(f"metrics hold window columns {bad}")
    if strict and (bad := [c for c in metrics.columns if c not in (*keys, *identity, "session_key", "signal", "event_name") and not c.startswith(("m_", "d_"))]):
        raise ContractError(f"metrics hold other columns {bad}")
    _unique(metrics, keys, "metrics")
    if events is not None:
        lost = metrics.join(events, keys, "left_anti").count()
        same = [c for c in identity if c in metrics.columns and c in events.columns]
        differ = metrics.alias("m").join(events.alias("e"), keys).filter(~F.forall(F.array(*[F.col(f"m.{c}").eqNullSafe(F.col(f"e.{c}")) for c in same]), lambda x: x)).count() if same else 0
        _fail({"rows without an event": lost, "rows that differ from their event": differ}, "metrics")


def check_segments(segments: DataFrame) -> None:
    _need(segments, ["session_key", "event_id", "t0_s", "t1_s"], "segments")
    _fail(segments.agg(F.count_if(F.col("t1_s") <= F.col("t0_s")).alias("empty segments")).first().asDict(), "segments")


def metrics_columns(events: DataFrame, keys: Sequence[str] = ("session_id", "event_id")) -> DataFrame:
    """Identity and m_ / d_ columns of an events table that holds metrics."""
    _need(events, keys, "events")
    own = [c for c in ("session_key", "session_id", "event_id", "schema_id", "event_name", "signal") if c in events.columns]
    return events.select(*own, *[c for c in events.columns if c.startswith(("m_", "d_"))])


def quality_summary(segments: DataFrame, reason: str = "reason") -> DataFrame:
    """reason, n: valid segments have reason ``ok``."""
    return segments.groupBy(F.coalesce(reason, F.lit("ok")).alias(reason)).count().withColumnRenamed("count", "n")
