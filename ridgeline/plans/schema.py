"""Event schemas: YAML into typed definitions, with lint, summary and parameter hash."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

import yaml

from ridgeline.functions.scalars import params_hash

TRIGGERS = ("simple_threshold_crossing", "zero_crossing", "local_extrema", "phased_threshold_crossing", "custom")
METRICS = ("peak", "interval_stats", "trigger_delta", "integral", "time_above")
TESTS = ("range", "delta", "peak")


@dataclass(frozen=True)
class Debounce:
    gap_s: float = 0.0
    prefer_key: str = "t0_index"
    prefer_abs: bool = False
    prefer_max: bool = False


@dataclass(frozen=True)
class Trigger:
    id: str
    type: str
    signal: str
    spec: Mapping[str, Any]
    debounce: Debounce
    base: str | None = None
    min_delay_s: float = 0.0
    max_delay_s: float | None = None
    direction: str = "auto"


@dataclass(frozen=True)
class Event:
    id: str
    label: str
    sensors: tuple[str, ...]
    trigger: Trigger
    secondary: tuple[Trigger, ...] = ()
    preconditions: tuple[Mapping, ...] = ()
    postconditions: tuple[Mapping, ...] = ()
    pre_s: float = 0.0
    post_s: float = 0.0
    metrics: tuple[Mapping, ...] = ()
    tags: tuple[str, ...] = ()
    max_null_share: float | None = None
    skip_if_clipped: bool = False
    segment: Mapping[str, Any] = field(default_factory=dict)
    params_hash: str = ""


@dataclass(frozen=True)
class Schema:
    version: str
    events: tuple[Event, ...]
    sha256: str


def _debounce(*specs: Mapping | None) -> Debounce:
    merged: dict[str, Any] = {}
    for s in specs:
        merged |= {k: v for k, v in (s or {}).items() if v is not None}
    return Debounce(float(merged.get("gap_s", 0.0)), str(merged.get("prefer_key", "t0_index")), bool(merged.get("prefer_abs", False)), bool(merged.get("prefer_max", False)))


def _trigger(raw: Mapping, debounce: Debounce, base: str | None = None) -> Trigger:
    search = raw.get("search") or {}
    most = search.get("max_delay_s")
    return Trigger(str(raw.get("id", "trigger")), str(raw.get("type")), str(raw.get("signal", "disp")), dict(raw), debounce, base, float(search.get("min_delay_s", 0.0)), None if most is None else float(most), str(search.get("direction", "auto")))


def parse(text: str) -> Schema:
    """A schema from YAML. Secondaries inherit the primary's debounce; a window comes from the event or the defaults."""
    raw = yaml.safe_load(text) or {}
    if problems := lint(raw):
        raise ValueError("; ".join(problems))
    defaults, version = raw.get("defaults") or {}, str(raw.get("version", ""))
    events = []
    for e in raw.get("events") or []:
        first = e["trigger"]
        own = _debounce(defaults.get("debounce"), e.get("debounce"), first.get("debounce"))
        window = {**(defaults.get("window") or {}), **(e.get("window") or {})}
        quality = e.get("quality") or {}
        share = quality.get("max_nan_fraction")
        second = []
        for t in e.get("secondary_triggers") or []:
            inherited = {"gap_s": own.gap_s, "prefer_key": own.prefer_key, "prefer_abs": own.prefer_abs, "prefer_max": own.prefer_max}
            second.append(_trigger(t, _debounce(inherited, t.get("debounce")), str(t.get("base_trigger", first.get("id", "trigger")))))
        events.append(
            Event(
                str(e["id"]),
                str(e.get("label", e["id"])),
                tuple(e.get("sensors") or ()),
                _trigger(first, own),
                tuple(second),
                tuple(e.get("preconditions") or ()),
                tuple(e.get("postconditions") or ()),
                float(window.get("pre_s", 0.0)),
                float(window.get("post_s", 0.0)),
                tuple(e.get("metrics") or ()),
                tuple(e.get("tags") or ()),
                None if share is None else float(share),
                bool(quality.get("skip_if_clipped", False)),
                dict(e.get("segment_defaults") or {}),
                params_hash(e, version),
            )
        )
    return Schema(version, tuple(events), hashlib.sha256(text.encode()).hexdigest())


def lint(raw: Mapping) -> list[str]:
    """What is wrong with a schema document."""
    out, seen = [], set()
    for n, e in enumerate(raw.get("events") or []):
        name = e.get("id") or f"event {n}"
        if not e.get("id"):
            out.append(f"{name}: no id")
        if name in seen:
            out.append(f"{name}: the id is used twice")
        seen.add(name)
        if not isinstance(e.get("trigger"), Mapping):
            out.append(f"{name}: no trigger")
            continue
        known = {e["trigger"].get("id")}
        for t in [e["trigger"], *(e.get("secondary_triggers") or [])]:
            if t.get("type") not in TRIGGERS:
                out.append(f"{name}: unknown trigger type {t.get('type')!r}")
            if t.get("base_trigger") and t["base_trigger"] not in known:
                out.append(f"{name}: base trigger {t['base_trigger']!r} doesn't come before {t.get('id')!r}")
            known.add(t.get("id"))
        for block in [*(e.get("preconditions") or []), *(e.get("postconditions") or [])]:
            span = block.get("within_s")
            if not (isinstance(span, list) and len(span) == 2 and all(isinstance(x, int | float) and abs(x) < float("inf") for x in span)):
                out.append(f"{name}: a condition needs finite within_s")
            for t in [*(block.get("all_of") or []), *(block.get("any_of") or [])]:
                if t.get("type") in ("peak", "delta") and t.get("cmp") not in (">", ">=", "<", "<="):
                    out.append(f"{name}: a {t.get('type')} test needs cmp")
        for m in e.get("metrics") or []:
            if m.get("type") not in METRICS:
                out.append(f"{name}: unknown metric type {m.get('type')!r}")
            if m.get("type") == "trigger_delta" and not {m.get("start_trigger"), m.get("end_trigger")} <= known:
                out.append(f"{name}: a trigger_delta metric names unknown triggers")
        if isinstance((e.get("segment_defaults") or {}).get("roles"), Mapping):
            out.append(f"{name}: roles are a list")
    return out


def summary(schema: Schema) -> list[dict]:
    """A row per event: trigger, window, debounce, secondaries, number of metrics."""
    return [{"id": e.id, "label": e.label, "sensors": list(e.sensors), "trigger_type": e.trigger.type, "signal": e.trigger.signal, "pre_s": e.pre_s, "post_s": e.post_s, "debounce_s": e.trigger.debounce.gap_s, "secondary_ids": [t.id for t in e.secondary], "n_metrics": len(e.metrics)} for e in schema.events]
