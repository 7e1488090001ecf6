"""Scalar functions as column expressions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Speed classes of routes in km/h (fixed values).
SPEED_EDGES = (0.0, 10.0, 20.0, 30.0, 40.0)


def clean_number(text: Column) -> Column:
    """Text as a double after dropping what can't stand in a number; null if nothing is left or it doesn't parse."""
    kept = F.nullif(F.regexp_replace(text, r"[^0-9eE+\-.]", ""), F.lit(""))
    return kept.try_cast("double")


def clock_seconds(text: Column) -> Column:
    """MM:SS(.f) or HH:MM:SS(.f), comma or point, as seconds; null otherwise."""
    t = F.replace(F.trim(text), F.lit(","), F.lit("."))
    pattern = r"^(?:(\d+):)?(\d+):(\d+(?:\.\d+)?)$"
    part = lambda i: F.nullif(F.regexp_extract(t, pattern, i), F.lit("")).try_cast("double")
    return F.coalesce(part(1), F.lit(0.0)) * 3600 + part(2) * 60 + part(3)


def sensor_id(text: Column) -> Column:
    """Canonical sensor name: lower case, blanks and hyphens as underscores, aliases resolved."""
    token = F.regexp_replace(F.lower(F.trim(text)), r"[\s-]+", "_")
    return F.when(token == "fork", "front_shock").when(token == "shock", "rear_shock").otherwise(token)


def time_scale(t: Column, most: Column) -> Column:
    """Seconds from a numeric time column whose largest value tells its unit: us above 1e12, ms above 1e6."""
    return F.when(most > 1e12, t / 1e6).when(most > 1e6, t / 1e3).otherwise(t)


def filename_anchor(name: Column, zone: str = "UTC") -> Column:
    """UTC timestamp of a name that begins YYYY-MM-DD_HH-MM-SS, read in zone."""
    m = lambda i: F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})_(\d{2})-(\d{2})-(\d{2})", i)
    local = F.try_to_timestamp(F.nullif(F.concat(m(1), F.lit(" "), F.concat_ws(":", m(2), m(3), m(4))), F.lit(" ::")))
    return F.to_utc_timestamp(local, zone)


def semicircles_to_degrees(x: Column) -> Column:
    return x * (180.0 / 2**31)


def samples_of(seconds: Column, dt: Column) -> Column:
    """Seconds as a number of samples, halves to even; null where dt is not positive."""
    return F.when(dt > 0, F.bround(seconds / dt).cast("long"))


def speed_class(kmh: Column, edges: Sequence[float] = SPEED_EDGES) -> Column:
    """0 for below the second edge, up to the last class; null for a missing speed."""
    out = F.lit(0)
    for i, e in enumerate(edges[1:], 1):
        out = F.when(kmh >= e, i).otherwise(out)
    return F.when(kmh.isNotNull() & ~F.isnan(kmh) & (F.abs(kmh) < float("inf")), out)


def polynomial(x: Column, coefficients: Sequence[float]) -> Column:
    """Coefficients from the constant up, by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def lookup(x: Column, nodes: Sequence[tuple[float, float]], extrapolate: bool = False) -> Column:
    """Piecewise linear through at least two nodes; clamped, or extended by the outer pieces."""
    nodes = sorted(nodes)
    if len(nodes) < 2:
        raise ValueError("a lookup needs two nodes")
    line = lambda a, b: F.lit(a[1]) + (x - a[0]) * ((b[1] - a[1]) / (b[0] - a[0]))
    out = line(nodes[-2], nodes[-1]) if extrapolate else F.lit(float(nodes[-1][1]))
    for a, b in list(zip(nodes, nodes[1:], strict=False))[::-1]:
        out = F.when(x < b[0], line(a, b)).otherwise(out)
    return F.when(x.isNotNull(), out if extrapolate else F.when(x <= nodes[0][0], float(nodes[0][1])).otherwise(out))


def two_point(x: Column, raw: tuple[float, float], real: tuple[float, float]) -> Column:
    """Calibration by two anchors."""
    if abs(raw[1] - raw[0]) < 1e-9:
        raise ValueError("the anchors are one point")
    gain = (real[1] - real[0]) / (raw[1] - raw[0])
    return x * gain + (real[0] - raw[0] * gain)


def crank_displacement(theta: Column, r_mm: float, l_mm: float) -> Column:
    """Length of the string from its eyelet, l_mm from the axis, to a crank pin of radius r_mm, less the shortest."""
    return F.sqrt(r_mm**2 + l_mm**2 - 2 * r_mm * l_mm * F.cos(theta)) - abs(l_mm - r_mm)


def params_hash(event: dict, schema_version: str) -> str:
    """SHA-256 of the key-sorted JSON of an event's definition and schema version."""
    return hashlib.sha256(json.dumps({"schema_version": schema_version, "event": event}, sort_keys=True, default=str).encode()).hexdigest()
