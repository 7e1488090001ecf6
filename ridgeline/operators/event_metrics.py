"""Metrics of events from their schema: one join of events with samples and one aggregation for all of them.

There are two sets of rules. ``segment_metrics`` measures the segments around
events; ``inline_metrics`` measures at detection, under names of its own. Both
are aggregates over an event's samples, generated from the metric's definition.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import joins

ALIASES = ("primary", "trigger")


@dataclass
class Spec:
    """An event definition as far as metrics see it."""

    schema_id: str
    primary: str
    metrics: Sequence[Mapping[str, Any]]
    triggers: Sequence[str] = ()


@dataclass
class _Plan:
    """Columns to add before the aggregation, and the aggregates by name."""

    event_keys: list[str]
    dt: float
    smooth: dict[str, Column] = field(default_factory=dict)
    lags: dict[str, Column] = field(default_factory=dict)
    out: list[tuple[str, str, Column]] = field(default_factory=list)

    def order(self):
        return Window.partitionBy(*self.event_keys).orderBy("sample_idx")

    def smoothed(self, y: Column, win: int, padded: bool) -> str:
        """The column with a centred mean of the values given; padded divides by the whole window and knows no gaps."""
        key = f"__s{len(self.smooth)}"
        w = self.order().rowsBetween(-(win // 2), (win - 1) // 2)
        self.smooth[key] = F.sum(y).over(w) / win if padded else F.avg(y).over(w)
        return key

    def lag(self, column: str) -> str:
        self.lags[f"__p{column}"] = F.lag(column).over(self.order())
        return f"__p{column}"


def _at(spec: Spec, name: str, kind: str) -> Column:
    """Time (time_s) or position (idx) of a trigger; null where the event has none."""
    if name in (spec.primary, *ALIASES):
        return F.col(f"trigger_{kind}")
    return F.col(f"{name}_{kind}") if name in spec.triggers else F.lit(None).cast("double")


def _delta(plan: _Plan, spec: Spec, m: Mapping[str, Any]) -> None:
    a, b, quantity = str(m["start_trigger"]), str(m["end_trigger"]), str(m.get("quantity", "seconds"))
    name = m.get("id") or f"trigger_delta_{a}_{b}_{quantity}"
    kind = "idx" if quantity == "samples" else "time_s"
    delta = _at(spec, b, kind).cast("double") - _at(spec, a, kind).cast("double")
    plan.out.append((spec.schema_id, f"m_{name}", F.first(F.abs(delta) if m.get("abs") else delta)))
    if m.get("return_debug"):
        for end, t in (("start", a), ("end", b)):
            for k in ("time_s", "idx"):
                plan.out.append((spec.schema_id, f"d_{name}_{end}_{k}", F.first(_at(spec, t, k).cast("double"))))


def _area(plan: _Plan, column: str, inside: Column, before: Column, dx: Column) -> Column:
    """Trapezoids between consecutive samples that both lie inside; null where a value between them is unknown."""
    y, p = F.col(column), F.col(plan.lag(column))
    pair = inside & before
    area = F.sum(F.when(pair, (y + p) / 2 * dx))
    return F.when((F.count_if(inside & y.isNull()) == 0) & (F.count_if(inside) > 0), F.coalesce(area, F.lit(0.0)))


def _ends(column: Column, inside: Column) -> Column:
    """Last value less first value of the samples inside."""
    at = F.when(inside, F.col("sample_idx"))
    return F.max_by(column, at) - F.min_by(column, at)


def _segment(plan: _Plan, spec: Spec, m: Mapping[str, Any], n: int) -> None:
    role, mine = m.get("signal"), F.col("schema_id") == spec.schema_id
    if m["type"] == "trigger_delta":
        return _delta(plan, spec, m)
    y = f"__y_{role}"
    if m["type"] == "peak":
        kind = m.get("kind", "max")
        name = f"m_{m.get('id') or f'peak_{role}_{kind}'}"
        v = F.when(mine, F.col(y))
        plan.out.append((spec.schema_id, name, (F.max if kind == "max" else F.min)(v)))
        if m.get("return_time"):
            first = F.when(v.isNotNull(), F.struct(-v if kind == "max" else v, F.col("sample_idx")))
            plan.out.append((spec.schema_id, f"{name}_t_rel_s", F.min_by(F.col("time_s") - F.col("trigger_time_s"), first)))
        return
    if m["type"] != "interval_stats":
        return _inline(plan, spec, m, n)
    a, b = _at(spec, str(m["start_trigger"]), "time_s"), _at(spec, str(m["end_trigger"]), "time_s")
    if float(m.get("min_delay_s") or 0.0) > 0:
        a = F.when(a.isNotNull(), F.greatest(a, F.col("trigger_time_s") + float(m["min_delay_s"])))
    known = a.isNotNull() & b.isNotNull()
    lo, hi = F.when(known, F.least(a, b)), F.when(known, F.greatest(a, b))
    t = F.col("time_s")
    inside = mine & F.coalesce((t >= lo) & (t <= hi), F.lit(False))
    win = max(1, round(float(m.get("smooth_ms") or 0.0) / 1000 / plan.dt)) if plan.dt > 0 else 1
    column = y if win == 1 else plan.smoothed(F.col(y), win, False)
    before = F.col(plan.lag("time_s")) >= lo
    v, name = F.when(inside, F.col(column)), m.get("id") or f"interval_{role}"
    ops = m.get("ops") or ["integral"]
    for op in [ops] if isinstance(ops, str) else ops:
        value = {
            "mean": F.avg(v),
            "avg": F.avg(v),
            "max": F.max(v),
            "min": F.min(v),
            "delta": _ends(F.col(column), inside),
            "integral": _area(plan, column, inside, before, t - F.col(plan.lag("time_s"))),
        }.get(op)
        if value is not None:
            plan.out.append((spec.schema_id, f"m_{name}_{op}", value))
    if m.get("return_debug"):
        k = F.col("sample_idx") - F.col("start_idx")
        debug = {"t0_rel_s": F.first(lo - F.col("trigger_time_s")), "t1_rel_s": F.first(hi - F.col("trigger_time_s")), "i0": F.min(F.when(inside, k)), "i1": F.max(F.when(inside, k)) + 1, "swapped": F.first((b < a).cast("int"))}
        plan.out += [(spec.schema_id, f"d_{name}_{x}", c.cast("double")) for x, c in debug.items()]


def _inline(plan: _Plan, spec: Spec, m: Mapping[str, Any], n: int) -> None:
    kind, role, dx = m["type"], m.get("signal") or "vel", plan.dt if plan.dt > 0 else 1.0
    mine, y, given = F.col("schema_id") == spec.schema_id, f"__y_{role}", m.get("id")
    own = mine & (F.col("sample_idx") >= F.col("start_idx")) & (F.col("sample_idx") <= F.col("end_idx"))
    level = float(m.get("threshold", m.get("value", 0.0)))
    if kind == "trigger_delta":
        return _delta(plan, spec, m)
    if kind == "integral":
        column = y
        if m.get("abs"):
            column = f"__a{n}"
            plan.smooth[column] = F.abs(F.col(y))
        area = _area(plan, column, own, F.col(plan.lag("sample_idx")) >= F.col("start_idx"), F.lit(dx))
        plan.out.append((spec.schema_id, f"m_{given or f'integral_{role}'}{'_abs' if m.get('abs') else ''}", area))
    elif kind == "peak":
        v = F.when(own, F.col(y))
        sign = -1 if m.get("kind", "max") == "max" else 1
        plan.out.append((spec.schema_id, f"m_peak_{role}", (F.max if sign < 0 else F.min)(v)))
        if m.get("return_time"):
            plan.out.append((spec.schema_id, f"m_peak_{role}_t", F.min_by(F.col("time_s") - F.col("trigger_time_s"), F.when(v.isNotNull(), F.struct(sign * v, F.col("sample_idx"))))))
    elif kind == "time_above":
        plan.out.append((spec.schema_id, f"m_{given or f'time_above_{role}_{level:g}'}", F.when(F.count_if(own) > 0, F.count_if(own & (F.col(y) > level)) * dx)))
    elif kind == "interval_stats":
        if m.get("end_trigger"):
            a, b = str(m.get("start_trigger") or spec.primary), str(m["end_trigger"])
            span = _at(spec, b, "time_s") - _at(spec, a, "time_s")
            valid = mine & F.coalesce((span > 0) & (span >= float(m.get("min_delay_s", 0.0))), F.lit(False))
            lo, hi = _at(spec, a, "idx"), _at(spec, b, "idx")
            times = (_at(spec, a, "time_s"), _at(spec, b, "time_s"))
        else:
            valid, lo, hi, times = mine, F.col("start_idx"), F.col("end_idx"), (F.col("start_time_s"), F.col("end_time_s"))
        inside = valid & (F.col("sample_idx") >= lo) & (F.col("sample_idx") <= hi)
        win = round(float(m["smooth_ms"]) / 1000 / plan.dt) if m.get("smooth_ms") is not None and plan.dt > 0 else 1
        column = y if win <= 1 else plan.smoothed(F.when(inside, F.col(y)), win, True)
        v = F.when(inside, F.col(column))
        top = {"neg_to_pos": F.max(v), "pos_to_neg": F.min(v)}.get(m.get("polarity"), F.max(F.abs(v)))
        for op in m.get("ops") or []:
            name = f"m_int_{role}_{op}"
            value = {
                "mean": F.avg(v),
                "max": F.max(v),
                "min": F.min(v),
                "peak": top,
                "delta": _ends(F.col(column), inside),
                "integral": _area(plan, column, inside, F.col(plan.lag("sample_idx")) >= lo, F.lit(dx)),
                "time_above": F.when(F.count_if(inside) > 0, F.count_if(v > level) * dx),
            }.get(op)
            if value is not None:
                plan.out.append((spec.schema_id, f"{name}_{level:g}" if op == "time_above" else name, value))
        if m.get("return_debug"):
            plan.out += [(spec.schema_id, f"m_int_{role}_t_{x}", F.first(F.when(valid, c))) for x, c in zip(("start", "end"), times, strict=True)]


def _measured(samples: DataFrame, events: DataFrame, specs: Sequence[Spec], inputs: Mapping[str, Mapping[str, str]], dt: float, keys: Sequence[str], inline: bool) -> DataFrame:
    """keys, schema_id, event_id and a column per metric; an event is measured by the columns of its sensor (signal)."""
    plan = _Plan([*keys, "schema_id", "event_id"], dt)
    roles = sorted({r for x in inputs.values() for r in x})
    held = {m.get("signal") or ("vel" if inline else None) for s in specs for m in s.metrics if m["type"] != "trigger_delta"}
    columns = sorted({x[r] for x in inputs.values() for r in roles if r in x and r in held})
    number = {c: f"__c{i}" for i, c in enumerate(columns)}
    long = samples.select(*keys, "sample_idx", "time_s", *[F.col(f"`{c}`").cast("double").alias(a) for c, a in number.items()])
    idx = [f"{t}_idx" for s in specs for t in s.triggers if f"{t}_idx" in events.columns]
    reach = lambda f, own: f(own, *[F.coalesce(c, own) for c in map(F.col, idx)]) if inline and idx else own
    lo, hi = reach(F.least, F.col("start_idx")), reach(F.greatest, F.col("end_idx"))
    rows = joins.window_join(events, long, list(keys), lo, hi, "sample_idx", 256)
    for r in held & set(roles):
        of = None
        for sensor, x in inputs.items():
            if r in x:
                of = (F.when if of is None else of.when)(F.col("signal") == sensor, F.col(number[x[r]]))
        rows = rows.withColumn(f"__y_{r}", of)
    for s in specs:
        for n, m in enumerate(s.metrics):
            if m["type"] == "trigger_delta" or (m.get("signal") or "vel") in roles:
                (_inline if inline else _segment)(plan, s, m, len(plan.out) * 100 + n)
    if plan.smooth:
        rows = rows.withColumns(plan.smooth)
    if plan.lags:
        rows = rows.withColumns(plan.lags)
    named: dict[str, list[Column]] = {}
    aggs = []
    for i, (schema_id, name, c) in enumerate(plan.out):
        aggs.append(c.alias(f"__m{i}"))
        named.setdefault(name, []).append(F.when(F.col("schema_id") == schema_id, F.col(f"__m{i}")))
    out = rows.groupBy(*keys, "schema_id", "event_id").agg(*(aggs or [F.count(F.lit(1)).alias("__none")]))
    return out.select(*keys, "schema_id", "event_id", *[F.coalesce(*c).cast("double").alias(n) for n, c in named.items()])


def segment_metrics(samples: DataFrame, events: DataFrame, specs: Sequence[Spec], inputs: Mapping[str, Mapping[str, str]], dt: float, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """keys, schema_id, event_id, m_ and d_ columns of the segments around events.

    peak: the extreme and, with return_time, its first time after the trigger.
    interval_stats: between two triggers' times in either order (the start not
    before min_delay_s after the event's), inside the segment, after an optional
    centred mean of smooth_ms; null where a trigger is missing. trigger_delta:
    seconds or samples between triggers. return_debug adds d_ columns.
    """
    return _measured(samples, events, specs, inputs, dt, keys, False)


def inline_metrics(samples: DataFrame, events: DataFrame, specs: Sequence[Spec], inputs: Mapping[str, Mapping[str, str]], dt: float, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """events plus the m_ columns that are measured at detection.

    integral (of the absolute value with abs), peak, time_above (threshold),
    trigger_delta and interval_stats, whose interval must run forward for
    min_delay_s at least, from trigger sample to trigger sample, or else over
    the event; smoothing pads with zeros, and op peak follows polarity.
    """
    out = _measured(samples, events, specs, inputs, dt, keys, True)
    return events.join(out, [*keys, "schema_id", "event_id"], "left")
