"""Event detection: a schema compiled to one plan over the sample frame, and its segments and metrics.

Samples are a wide frame keyed (session_key, sample_idx) with time_s and one
column per signal. Each event and sensor becomes a chain of window operators;
a debounced trigger table is small next to the samples, and everything after
it (conditions, quality, metrics) is one bucketed range join with the samples
and one aggregation.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.functions.naming import sensor_inputs
from ridgeline.operators import joins, series, signal
from ridgeline.operators.blocks import BLOCK, fitting
from ridgeline.operators.conditions import Block, Test, apply_conditions, flagged, quality_gate
from ridgeline.operators.event_metrics import Spec, inline_metrics, segment_metrics
from ridgeline.operators.series import finite
from ridgeline.plans.schema import Event, Schema, Trigger

KEYS = ["session_key"]
VERSION = "1"
#: Seconds in a cell of the samples that an open search is joined with.
OPEN_CELL_S = 60.0


def _candidates(samples: DataFrame, trigger: Trigger, inputs: Mapping[str, str], dt: float, keys: Sequence[str] = KEYS, block: int | None = None) -> DataFrame:
    """sample_idx, time_s, strength (and the trigger's displacement as disp) of a trigger's candidates within keys."""
    if trigger.signal not in inputs:
        raise KeyError(f"trigger {trigger.id!r} needs the input {trigger.signal!r}")
    spec, column = trigger.spec, inputs[trigger.signal]
    disp = F.col(f"`{inputs['disp']}`") if "disp" in inputs else F.lit(None).cast("double")
    rows = samples.select(*keys, "sample_idx", "time_s", F.col(f"`{column}`").alias("y"), disp.alias("disp"))
    direction = str(spec.get("dir", "rising"))
    if trigger.type in ("simple_threshold_crossing", "zero_crossing"):
        level = float(spec.get("value", 0.0)) if trigger.type != "zero_crossing" else 0.0
        out = series.threshold_crossings(rows, keys, "y", level, float(spec.get("hysteresis") or 0.0), direction)
    elif trigger.type == "local_extrema":
        apart = max(1, round(float(spec.get("distance_s", 0.0)) / dt))
        out = signal.peaks(rows, keys, "y", str(spec.get("kind", "max")), apart, None if spec.get("prominence") is None else float(spec["prominence"]), block)
        edge = float(spec.get("edge_ignore_s", 0.0))
        if edge:
            ends = samples.groupBy(*keys).agg(F.min("time_s").alias("__a"), F.max("time_s").alias("__b"))
            out = out.join(ends, keys).filter((F.col("time_s") >= F.col("__a") + edge) & (F.col("time_s") <= F.col("__b") - edge))
        out = out.withColumn("disp", F.lit(None).cast("double"))  # an extremum carries no displacement for debouncing
    elif trigger.type == "phased_threshold_crossing":
        dwell = tuple(max(1, round(float(spec.get(k, 0.0)) / dt)) for k in ("dwell_neg_s", "dwell_zero_s", "dwell_pos_s"))
        out = signal.phased(rows, keys, "y", float(spec["low"]), float(spec["high"]), dwell, max(1, round(float(spec.get("smooth_ms", 0.0)) / 1000 / dt)), direction, block)
    else:
        raise KeyError(f"no trigger of type {trigger.type!r}")
    return out.select(*keys, "sample_idx", "time_s", "strength", "disp", "y")


def _debounced(cands: DataFrame, trigger: Trigger, dt: float, keys: Sequence[str] = KEYS) -> DataFrame:
    d = trigger.debounce
    key = {"t0_index": "sample_idx", "t0_time_s": "time_s", "disp": "disp", "strength": "strength", "value": "y"}.get(d.prefer_key)
    return series.debounce(cands, keys, round(d.gap_s / dt) if dt > 0 else 0, key, "abs" if d.prefer_abs else "max" if d.prefer_max else "min")


def _blocks(raw: Sequence[Mapping], inputs: Mapping[str, str], dt: float) -> list[Block]:
    def test(t: Mapping) -> Test:
        if t.get("signal") not in inputs:
            raise KeyError(f"a condition needs the input {t.get('signal')!r}")
        return Test(t["type"], f"__{t['signal']}", t.get("min"), t.get("max"), t.get("cmp"), t.get("value"), t.get("kind", "max"))

    return [Block(round(b["within_s"][0] / dt), round(b["within_s"][1] / dt), [test(t) for t in b.get("all_of") or []], [test(t) for t in b.get("any_of") or []]) for b in raw]


def detect_one(samples: DataFrame, event: Event, sensor: str, inputs: Mapping[str, str], dt: float, schema_version: str, block: int | None = BLOCK) -> DataFrame:
    """The events of one definition and sensor."""
    first = _debounced(_candidates(samples, event.trigger, inputs, dt, KEYS, block), event.trigger, dt)
    first = first.select(*KEYS, F.col("sample_idx").alias("trigger_idx"), F.col("time_s").alias("trigger_time_s"), F.col("strength").alias("score"))
    blocks = _blocks([*event.preconditions, *event.postconditions], inputs, dt)
    roles = [F.col(f"`{c}`").alias(f"__{r}") for r, c in inputs.items()]
    values = samples.select(*KEYS, "sample_idx", *roles)
    if blocks:
        lo, hi = min(min(b.lo_idx, b.hi_idx) for b in blocks), max(max(b.lo_idx, b.hi_idx, b.lo_idx + 1) for b in blocks)
        near = joins.window_join(first, values, KEYS, F.col("trigger_idx") + lo, F.col("trigger_idx") + hi, "sample_idx", max(hi - lo, 1))
        good = apply_conditions(near, [*KEYS, "trigger_idx"], "trigger_idx", "sample_idx", blocks)
        first = first.join(good, [*KEYS, "trigger_idx"], "left_semi")
    if event.max_null_share is not None or event.skip_if_clipped:
        own = [c for c in samples.columns if c not in KEYS]
        flags = flagged(samples, KEYS, own, sorted(set(inputs.values())) if event.skip_if_clipped else ()).select(*KEYS, "sample_idx", "__null", "__edge")
        before, after = round(event.pre_s / dt), round(event.post_s / dt)
        near = joins.window_join(first, flags, KEYS, F.col("trigger_idx") - before, F.col("trigger_idx") + after, "sample_idx", before + after + 1)
        first = first.join(quality_gate(near, [*KEYS, "trigger_idx"], event.max_null_share, event.skip_if_clipped), [*KEYS, "trigger_idx"], "left_semi")
    out = first
    names = {event.trigger.id: "trigger"}
    for t in event.secondary:
        base = "trigger_time_s" if names.get(t.base) == "trigger" else f"{t.base}_time_s"
        # Without a longest delay the search goes on to the session's end.
        most = t.max_delay_s if t.max_delay_s is not None else float("inf")
        event_keys = [*KEYS, "trigger_idx"]
        known = out.filter(F.col(base).isNotNull()).select(*event_keys, F.col(base).alias("__base_s"))
        # The search begins afresh in each event's window: arming, prominence and debouncing are local to it.
        if t.max_delay_s is None:
            last = samples.groupBy(*KEYS).agg(F.max("time_s").alias("__until"))
            known = known.join(last, KEYS)
        else:
            known = known.withColumn("__until", F.col("__base_s") + most)
        lo, hi = F.col("__base_s") + t.min_delay_s, F.col("__until")
        width = OPEN_CELL_S if t.max_delay_s is None else max(most - t.min_delay_s, dt)
        near = joins.window_join(known, samples, KEYS, lo - (0.0 if t.type == "local_extrema" else 1.5 * dt), hi, "time_s", width)
        c = _candidates(near, t, inputs, dt, event_keys).join(known, event_keys).filter((F.col("time_s") >= lo) & (F.col("time_s") <= hi))
        c = _debounced(c, t, dt, event_keys)
        rel = F.col("time_s") - F.col("__base_s")
        direction = t.direction if t.direction in ("forward", "backward") else "forward" if t.min_delay_s >= 0 else "backward" if most <= 0 else "closest"
        order = {"forward": F.struct(rel), "backward": F.struct(-rel), "closest": F.struct(F.abs(rel), rel)}[direction]
        hit = c.groupBy(*event_keys).agg(F.min_by(F.struct(F.col("sample_idx").alias("__c_idx"), F.col("time_s").alias("__c_time_s")), order).alias("secondary"))
        hit = hit.select(*KEYS, "trigger_idx", F.col("secondary.__c_idx").alias(f"{t.id}_idx"), F.col("secondary.__c_time_s").alias(f"{t.id}_time_s"))
        out = out.join(hit, [*KEYS, "trigger_idx"], "left")
        names[t.id] = t.id
    ends = samples.groupBy(*KEYS).agg(F.min("sample_idx").alias("__first"), F.max("sample_idx").alias("__last"), F.max_by("time_s", "sample_idx").alias("__end_s"), F.min_by("time_s", "sample_idx").alias("__begin_s"))
    pre, post = round(event.pre_s / dt), round(event.post_s / dt)
    out = out.join(ends, KEYS)
    bound = {"start_idx": F.greatest(F.col("trigger_idx") - pre, F.col("__first")), "end_idx": F.least(F.col("trigger_idx") + post, F.col("__last"))}
    bound |= {"start_time_s": F.greatest(F.col("trigger_time_s") - pre * dt, F.col("__begin_s")), "end_time_s": F.least(F.col("trigger_time_s") + post * dt, F.col("__end_s"))}
    out = out.withColumns(bound).drop("__first", "__last", "__end_s", "__begin_s")
    at = values.withColumnsRenamed({"sample_idx": "trigger_idx"} | {f"__{r}": f"{r}_at_trigger" for r in inputs})
    keep = [f"{r}_at_trigger" for r in ("disp", "vel", "acc", "disp_norm") if r in inputs]
    out = out.join(at.select(*KEYS, "trigger_idx", *keep), [*KEYS, "trigger_idx"], "left")
    n = F.row_number().over(Window.partitionBy(*KEYS).orderBy("trigger_idx")) - 1
    fixed = {
        "event_id": F.concat_ws(":", F.lit(event.id), F.lit(sensor), n.cast("string")),
        "session_id": F.col("session_key"),
        "schema_id": F.lit(event.id),
        "schema_version": F.lit(schema_version),
        "event_name": F.lit(event.label),
        "signal": F.lit(sensor),
        "signal_col": F.lit(inputs[event.trigger.signal]),
        "detector_version": F.lit(VERSION),
        "params_hash": F.lit(event.params_hash),
        "tags": F.array(*[F.lit(t) for t in event.tags]).cast("array<string>"),
    }
    return out.withColumns(fixed)


def detect(samples: DataFrame, schema: Schema, registry: Mapping[str, Mapping], dt: float) -> DataFrame:
    """All events of a schema; an event whose inputs a sensor lacks is left out for that sensor."""
    out, block = None, fitting(samples)
    for event in schema.events:
        for sensor in _sensors(event, registry):
            try:
                one = detect_one(samples, event, sensor, sensor_inputs(registry, sensor), dt, schema.version, block)
            except KeyError as missing:
                warnings.warn(f"event {event.id!r} is left out for sensor {sensor!r}: {missing.args[0]}", stacklevel=2)
                continue
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no event of the schema fits the session's signals")
    return out.orderBy("session_id", "schema_id", "trigger_idx")


def segments(samples: DataFrame, events: DataFrame, columns: Mapping[str, str], inclusive_end: bool = False) -> DataFrame:
    """Long segments: event keys, sample_idx, k, t_rel and the role columns. The last sample of a window is left out unless inclusive_end."""
    e = events.select("session_key", "event_id", "schema_id", "trigger_idx", "trigger_time_s", "start_idx", "end_idx")
    s = samples.select(*KEYS, "sample_idx", "time_s", *[F.col(f"`{c}`").alias(r) for r, c in columns.items()])
    hi = F.col("end_idx") if inclusive_end else F.col("end_idx") - 1
    out = joins.window_join(e, s, KEYS, F.col("start_idx"), hi, "sample_idx", 256)
    return out.withColumns({"k": F.col("sample_idx") - F.col("start_idx"), "t_rel": F.col("time_s") - F.col("trigger_time_s")})


def segment_arrays(long: DataFrame, roles: Sequence[str]) -> DataFrame:
    """One row per event with an array per role, in order."""
    keys = ["session_key", "event_id", "schema_id"]
    rows = long.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "t_rel", *roles))).alias("x"))
    return rows.select(*keys, F.col("x.t_rel").alias("t_rel"), *[F.col(f"x.{r}").alias(r) for r in roles])


def _sensors(event: Event, registry: Mapping[str, Mapping]) -> list[str]:
    """The event's sensors, or all of the registry's where it names none."""
    return list(event.sensors) or sorted({i["sensor"] for i in registry.values() if i["sensor"]})


def _specs(schema: Schema, registry: Mapping[str, Mapping]) -> tuple[list[Spec], dict[str, dict[str, str]]]:
    specs = [Spec(e.id, e.trigger.id, e.metrics, [t.id for t in e.secondary]) for e in schema.events]
    sensors = sorted({s for e in schema.events for s in _sensors(e, registry)})
    return specs, {s: sensor_inputs(registry, s) for s in sensors}


def metrics(samples: DataFrame, events: DataFrame, schema: Schema, registry: Mapping[str, Mapping], dt: float) -> DataFrame:
    """session_key, schema_id, event_id and the m_ and d_ columns: one join and one aggregation for all events and sensors."""
    return segment_metrics(samples, _with_triggers(events, schema), *_specs(schema, registry), dt, KEYS)


def with_inline_metrics(samples: DataFrame, events: DataFrame, schema: Schema, registry: Mapping[str, Mapping], dt: float) -> DataFrame:
    """events plus the metrics measured at detection."""
    return inline_metrics(samples, _with_triggers(events, schema), *_specs(schema, registry), dt, KEYS)


def _with_triggers(events: DataFrame, schema: Schema) -> DataFrame:
    """events with the columns of all secondary triggers, null where no event has them."""
    wanted = {f"{t.id}_{k}": kind for e in schema.events for t in e.secondary for k, kind in (("idx", "long"), ("time_s", "double"))}
    return events.withColumns({c: F.lit(None).cast(kind) for c, kind in wanted.items() if c not in events.columns})


def secondary_times(events: DataFrame) -> DataFrame:
    """session_key, event_id, trigger, time_s: the secondary triggers that an event has, found by their columns."""
    names = [c.removesuffix("_time_s") for c in events.columns if c.endswith("_time_s") and c not in ("trigger_time_s", "start_time_s", "end_time_s")]
    if not names:
        return events.select(*KEYS, "event_id", F.lit(None).cast("string").alias("trigger"), F.lit(None).cast("double").alias("time_s")).limit(0)
    pairs = F.array(*[F.struct(F.lit(n).alias("trigger"), F.col(f"{n}_time_s").cast("double").alias("time_s")) for n in names])
    return events.select(*KEYS, "event_id", F.inline(pairs)).filter(finite(F.col("time_s")).isNotNull())


def relative_slices(samples: DataFrame, events: DataFrame, columns: Mapping[str, str], before_s: float, after_s: float) -> DataFrame:
    """Samples around each event by time, with t_rel to its trigger, and the offsets of its secondary triggers as an array."""
    e = events.select(*KEYS, "event_id", "schema_id", "trigger_time_s")
    marks = secondary_times(events).join(e, [*KEYS, "event_id"]).groupBy(*KEYS, "event_id").agg(F.sort_array(F.collect_list(F.struct((F.col("time_s") - F.col("trigger_time_s")).alias("offset_s"), "trigger"))).alias("secondary"))
    s = samples.select(*KEYS, "sample_idx", "time_s", *[F.col(f"`{c}`").alias(r) for r, c in columns.items()])
    out = joins.window_join(e, s, KEYS, F.col("trigger_time_s") - before_s, F.col("trigger_time_s") + after_s, "time_s", max(before_s + after_s, 1e-3))
    return out.withColumn("t_rel", F.col("time_s") - F.col("trigger_time_s")).join(marks, [*KEYS, "event_id"], "left")
