"""Signal names: ``<base>[_raw|_qc][_dom_<domain>] [unit]_op_<token>_<token>``.

Names carry a signal's kind, domain, unit and operations; all of this works on
a schema, on the driver, before any job.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, replace

#: Vocabulary of names (fixed values).
DOMAINS = frozenset({"suspension", "wheel", "bike", "world"})
OPS = frozenset({"zeroed", "norm", "clip", "filt", "fill", "smooth", "detrend", "cal", "resamp", "diff"})
FILTER_OP = re.compile(r"Butterworth_[0-9]+(?:p[0-9]+)?Hz_[1-9][0-9]*Order")
LEGACY_SUFFIXES = {"_zeroed": "zeroed", "_norm": "norm", "_filtered": "filt", "_filter": "filt", "_smoothed": "smooth", "_resampled": "resamp", "_scaled": "cal"}
NEVER_RENAMED = frozenset({"time_s", "time_ms", "ts_ms", "timestamp", "timestamp_ms", "sample_id", "mark"})
ALIASES = {"front_shock": "front_shock", "front_fork": "front_shock", "fork": "front_shock", "rear_shock": "rear_shock", "rear_fork": "rear_shock", "shock": "rear_shock"}

_NAME = re.compile(r"(?P<head>.+?)(?: \[(?P<unit>[^\]]+)\])?(?:_op_(?P<ops>.+))?")


class NameError_(ValueError):
    """A name that doesn't follow the convention."""


@dataclass(frozen=True)
class Signal:
    base: str
    kind: str = ""
    domain: str | None = None
    unit: str | None = None
    ops: tuple[str, ...] = ()


def allowed_op(token: str) -> bool:
    return token in OPS or FILTER_OP.fullmatch(token) is not None


def _tokens(text: str) -> tuple[str, ...]:
    """Operation tokens; a filter's name holds underscores of its own, and a residual counts as diff alone."""
    out, rest = [], text
    while rest:
        m = FILTER_OP.match(rest)
        token = m.group() if m else rest.split("_", 1)[0]
        rest = rest[len(token) :].removeprefix("_")
        if token == "resid" and out and FILTER_OP.fullmatch(out[-1]):
            out[-1] = "diff"
        else:
            out.append(token)
    return tuple(out)


def parse(name: str, strict: bool = True) -> Signal:
    m = _NAME.fullmatch(name.strip())
    if not m:
        raise NameError_(f"not a signal name: {name!r}")
    head, domain, kind = m["head"], None, ""
    if "_dom_" in head:
        head, domain = head.rsplit("_dom_", 1)
        if strict and domain not in DOMAINS:
            raise NameError_(f"unknown domain {domain!r} in {name!r}")
    for suffix in ("_raw", "_qc"):
        if head.endswith(suffix):
            head, kind = head.removesuffix(suffix), suffix[1:]
    ops = _tokens(m["ops"] or "")
    if strict and (bad := [x for x in ops if not allowed_op(x)]):
        raise NameError_(f"unknown operations {bad} in {name!r}")
    if not head:
        raise NameError_(f"no base in {name!r}")
    return Signal(head, kind, domain, m["unit"], ops)


def format_(s: Signal) -> str:
    kind = f"_{s.kind}" if s.kind else ""
    domain = f"_dom_{s.domain}" if s.domain else ""
    unit = f" [{s.unit}]" if s.unit else ""
    return s.base + kind + domain + unit + (f"_op_{'_'.join(s.ops)}" if s.ops else "")


def canonical_sensor(text: str | None) -> str:
    """Lower case, blanks and hyphens as one underscore, aliases resolved."""
    token = re.sub(r"_+", "_", re.sub(r"[\s-]+", "_", (text or "").strip().lower())).strip("_")
    return ALIASES.get(token, token)


def sensor_in(text: str | None) -> str | None:
    """The sensor whose alias begins the text (the longest wins)."""
    token = canonical_sensor(text)
    for alias in sorted(ALIASES, key=len, reverse=True):
        if token == alias or token.startswith(alias + "_"):
            return ALIASES[alias]
    return token if token in ALIASES.values() else None


def side(text: str | None) -> str | None:
    sensor = sensor_in(text) or canonical_sensor(text)
    return next((s for s in ("front", "rear") if sensor.startswith(s)), None)


def renamed(columns: Iterable[str], units: Mapping[str, str] | None = None, domains: Mapping[str, str] | None = None) -> dict[str, str]:
    """Old name to canonical name for ``withColumnsRenamed``; two columns of one name are an error."""
    out: dict[str, str] = {}
    for c in columns:
        if c in NEVER_RENAMED:
            continue
        m = re.fullmatch(r"(.+?)(?: \[([^\]]+)\])?((?:_[a-z]+)*)", c.strip())
        head, unit, tail = m[1], m[2], m[3] or ""
        if unit is None:
            head, tail = head + tail, ""
        if "_op_" in c:
            s = parse(c, strict=False)
        else:
            ops, text = [], tail if unit is not None else head
            while found := next((x for x in sorted(LEGACY_SUFFIXES, key=len, reverse=True) if text.endswith(x)), None):
                ops.insert(0, LEGACY_SUFFIXES[found])
                text = text.removesuffix(found)
            head = head + text if unit is not None else text
            s = replace(parse(head, strict=False), unit=unit, ops=tuple(ops))
        base = next((ALIASES[a] + s.base[len(a) :] for a in sorted(ALIASES, key=len, reverse=True) if s.base == a or s.base.startswith(a + "_")), s.base)
        unit = s.unit or (units or {}).get(base) or ("counts" if s.kind == "raw" else None)
        s = replace(s, base=base, unit=unit, domain=s.domain or (domains or {}).get(base))
        out[c] = format_(s)
    names = list(out.values())
    if clash := {n for n in names if names.count(n) > 1}:
        raise NameError_(f"columns collide as {sorted(clash)}")
    return out


QUANTITY_BY_UNIT = {"mm": "disp", "mm/s": "vel", "mm/s^2": "acc", "counts": "raw"}


def registry(columns: Mapping[str, str], strict: bool = False) -> dict[str, dict]:
    """{column: kind, unit, domain, op_chain, sensor, quantity} for the numeric columns of a schema."""
    out = {}
    for c, kind in columns.items():
        if c in NEVER_RENAMED or c == "sample_idx" or kind not in ("double", "float", "int", "bigint", "boolean", "tinyint", "smallint"):
            continue
        try:
            s = parse(c)
        except NameError_:
            if strict:
                raise
            continue
        quantity = QUANTITY_BY_UNIT.get(s.unit or "")
        if "norm" in s.ops:
            quantity = "disp_norm"
        if s.base.endswith(("_vel", "_acc")):
            quantity = s.base[-3:]
        sensor = sensor_in(s.base) or re.sub(r"_(vel|acc)$", "", s.base)
        out[c] = {"kind": s.kind, "unit": s.unit, "domain": s.domain, "op_chain": list(s.ops), "sensor": sensor, "quantity": quantity}
    return out


def check_registry(reg: Mapping[str, Mapping]) -> list[str]:
    """What is wrong with a registry, as sentences."""
    out = []
    for c, i in reg.items():
        out += [f"{c}: unknown operation {x}" for x in i["op_chain"] if not allowed_op(x)]
        if i["kind"] == "raw" and i["unit"] != "counts":
            out.append(f"{c}: raw signals are in counts")
        if i["kind"] == "" and i["unit"] is None and "norm" not in i["op_chain"]:
            out.append(f"{c}: an engineered signal needs a unit")
        want = QUANTITY_BY_UNIT.get(i["unit"] or "")
        if want and want != "raw" and not (i["sensor"] and i["quantity"] in (want, "disp_norm")):
            out.append(f"{c}: unit {i['unit']} needs a sensor and quantity {want}")
    return out


def velocity_name(column: str) -> str:
    s = parse(column, strict=False)
    return format_(replace(s, base=s.base + "_vel", unit="mm/s", ops=()))


def acceleration_name(column: str) -> str:
    s = parse(column, strict=False)
    return format_(replace(s, base=s.base + "_acc", unit="mm/s^2", ops=()))


def filter_tag(cutoff_hz: float, order: int) -> str:
    return f"Butterworth_{f'{cutoff_hz:.12g}'.replace('.', 'p')}Hz_{order}Order"


def pick_column(reg: Mapping[str, Mapping], *, sensor: str | None = None, quantity: str | None = None, unit: str | None = None, kind: str | None = None, ops: list[str] | None = None) -> str:
    """The one column that matches; with ops [] none may be applied, else all of them must be. A tie is an error."""
    found = []
    for c, i in reg.items():
        if sensor and canonical_sensor(i["sensor"]) != canonical_sensor(sensor):
            continue
        if quantity and i["quantity"] != quantity or unit and i["unit"] != unit or kind is not None and i["kind"] != kind:
            continue
        if ops is not None and (bool(i["op_chain"]) if not ops else not set(ops) <= set(i["op_chain"])):
            continue
        found.append((len(i["op_chain"]), c))
    if not found:
        raise KeyError(f"no column for sensor={sensor} quantity={quantity} unit={unit} ops={ops}")
    best = [c for n, c in sorted(found) if n == min(found)[0]]
    if len(best) > 1:
        raise KeyError(f"several columns match: {best}")
    return best[0]


def sensor_inputs(reg: Mapping[str, Mapping], sensor: str) -> dict[str, str]:
    """Roles disp, vel, acc, disp_norm, disp_zeroed, raw of a sensor: its first matching column each."""
    mine = {c: i for c, i in reg.items() if canonical_sensor(i["sensor"]) == canonical_sensor(sensor)}
    out = {}
    tests = {
        "disp": lambda i: i["quantity"] == "disp" and i["kind"] == "" and not i["op_chain"],
        "vel": lambda i: i["quantity"] == "vel",
        "acc": lambda i: i["quantity"] == "acc",
        "disp_norm": lambda i: i["quantity"] == "disp_norm",
        "disp_zeroed": lambda i: i["quantity"] == "disp" and "zeroed" in i["op_chain"],
        "raw": lambda i: i["kind"] == "raw",
    }
    for role, test in tests.items():
        hits = [c for c, i in mine.items() if test(i)]
        if role == "disp_norm":
            hits.sort(key=lambda c: "zeroed" not in mine[c]["op_chain"])
        if hits:
            out[role] = hits[0]
    return out
