"""Filters, option lists and ranges that consumers of sessions and metrics use."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.functions.naming import canonical_sensor, side
from ridgeline.operators.series import finite


def masked_values(df: DataFrame, value: str, keys: Sequence[str] = (), include_inactive: bool = False, mask: str = "active_mask_qc") -> DataFrame:
    """keys and the finite values of a column, of active samples unless asked otherwise."""
    rows = df if include_inactive or mask not in df.columns else df.filter(F.col(mask))
    return rows.select(*keys, finite(F.col(f"`{value}`")).alias(value)).filter(F.col(f"`{value}`").isNotNull())


def paired_values(df: DataFrame, x: str, y: str, keys: Sequence[str] = (), include_inactive: bool = False, mask: str = "active_mask_qc") -> DataFrame:
    """Rows where both columns are finite."""
    rows = df if include_inactive or mask not in df.columns else df.filter(F.col(mask))
    out = rows.select(*keys, finite(F.col(f"`{x}`")).alias(x), finite(F.col(f"`{y}`")).alias(y))
    return out.filter(F.col(f"`{x}`").isNotNull() & F.col(f"`{y}`").isNotNull())


def in_scope(rows: DataFrame, event_type: str | None = None, entities: Sequence[str] = (), sensors: Sequence[str] = (), event_col: str = "schema_id", entity_col: str = "entity_key", sensor_col: str = "sensor") -> DataFrame:
    """Rows of an event type, of the entities, of the sensors; an empty choice is no limit."""
    out = rows.filter(F.col(event_col) == event_type) if event_type is not None else rows
    out = out.filter(F.col(entity_col).isin(list(entities))) if entities else out
    return out.filter(F.col(sensor_col).isin([canonical_sensor(s) for s in sensors])) if sensors else out


def by_tags(events: DataFrame, tags: Sequence[str], schema_id: str | None = None, event_name: str | None = None) -> DataFrame:
    """Events with any of the tags (an array, or text with commas), of a schema id or else an event name."""
    out = events
    if schema_id is not None:
        out = out.filter(F.col("schema_id") == schema_id)
    elif event_name is not None:
        out = out.filter(F.col("event_name") == event_name)
    if not tags:
        return out
    own = F.col("tags") if dict(events.dtypes)["tags"].startswith("array") else F.split("tags", r"\s*,\s*")
    return out.filter(F.arrays_overlap(own, F.array(*[F.lit(t) for t in tags])))


def options(rows: DataFrame, *columns: str, without: Sequence[str] = ()) -> DataFrame:
    """Distinct known values, sorted."""
    out = rows.select(*columns).dropna().distinct()
    return (out.filter(~F.col(columns[0]).isin(list(without))) if without else out).orderBy(*columns)


def live_metrics(rows: DataFrame, metrics: Sequence[str]) -> list[str]:
    """The metrics with a finite value; all if none has one."""
    found = rows.agg(*[F.count(finite(F.col(f"`{m}`"))).alias(m) for m in metrics]).first() if metrics else None
    return [m for m in metrics if found[m]] or list(metrics)


def signals_by_unit(columns: Sequence[str], registry: Mapping[str, Mapping]) -> list[str]:
    """Columns by unit, those without one last, then by name."""
    return sorted(columns, key=lambda c: (registry.get(c, {}).get("unit") or "~", c))


def signal_columns(samples: DataFrame, registry: Mapping[str, Mapping] = {}, channels: Sequence[str] = (), without: Sequence[str] = ("session_key", "sample_idx", "time_s")) -> list[str]:
    """The registry's signals among the columns, else the recording's channels among them, else all numeric columns with a finite value."""
    for known in (registry, channels):
        if found := [c for c in samples.columns if c in known]:
            return found
    numeric = [c for c, t in samples.dtypes if c not in without and (t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal"))]
    if not numeric:
        return []
    held = samples.agg(*[F.count(finite(F.col(f"`{c}`").cast("double"))).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
    return [c for i, c in enumerate(numeric) if held[i]]


def default_signal(columns: Sequence[str], registry: Mapping[str, Mapping], previous: str | None = None, unit: str = "mm") -> str | None:
    """The previous choice if it is there, else the first of the unit, else the first."""
    if previous in columns:
        return previous
    return next((c for c in columns if registry.get(c, {}).get("unit") == unit), columns[0] if columns else None)


def latest(templates: DataFrame) -> DataFrame:
    """Of each template the greatest version."""
    rest = [c for c in templates.columns if c != "template_id"]
    return templates.groupBy("template_id").agg(F.max_by(F.struct(*rest), "version").alias("x")).select("template_id", "x.*")


def y_range(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """keys, lo, hi over all columns, 3 % wider on both sides, or by 1 where they are flat."""
    values = [finite(F.col(f"`{c}`")) for c in columns]
    lo, hi = (f(*values) if len(values) > 1 else values[0] for f in (F.least, F.greatest))
    out = df.groupBy(*keys).agg(F.min(lo).alias("a"), F.max(hi).alias("b"))
    pad = F.when(F.col("b") > F.col("a"), 0.03 * (F.col("b") - F.col("a"))).otherwise(1.0)
    return out.select(*keys, (F.col("a") - pad).alias("lo"), (F.col("b") + pad).alias("hi"))


def session_bounds(samples: DataFrame, anchors: DataFrame, keys: Sequence[str] = ("session_key",)) -> DataFrame:
    """keys, start, end: the anchor (keys, anchor), and the anchor plus the last time."""
    last = samples.groupBy(*keys).agg(F.max("time_s").alias("__t"))
    end: Column = F.timestamp_micros(F.unix_micros("anchor") + F.round(F.col("__t") * 1e6).cast("long"))
    return anchors.join(last, list(keys)).select(*keys, F.col("anchor").alias("start"), end.alias("end"))


def capture_average(samples: DataFrame, keys: Sequence[str], t_us: str, value: str, window_ms: int) -> DataFrame:
    """keys, cell, mean, n over windows of fixed length."""
    cell = F.floor(F.col(t_us) / (window_ms * 1000)).alias("cell")
    return samples.groupBy(*keys, cell).agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def columns_for(registry: Mapping[str, Mapping], sensor: str, quantity: str | None, unit: str | None, kind: str = "", ops: Sequence[str] = ()) -> list[str]:
    """A sensor's columns of one meaning, the shortest name first."""
    key = "|".join(ops)
    hits = [c for c, i in registry.items() if canonical_sensor(i["sensor"]) == canonical_sensor(sensor) and (i["quantity"], i["unit"], i["kind"], "|".join(i["op_chain"])) == (quantity, unit, kind, key)]
    return sorted(hits, key=lambda c: (len(c), c))


def displacement_pair(registry: Mapping[str, Mapping], which: str) -> tuple[str, str] | None:
    """(normalised column, column in mm) of a side that belong together best: same sensor, domain and operations."""
    mine = {c: i for c, i in registry.items() if side(c) == which}
    pairs = []
    for n, a in mine.items():
        if a["quantity"] != "disp_norm":
            continue
        for m, b in mine.items():
            if b["quantity"] == "disp" and b["unit"] == "mm":
                rest = [o for o in a["op_chain"] if o not in ("norm", "clip")]
                pairs.append(((a["sensor"] == b["sensor"], rest == b["op_chain"], a["domain"] == b["domain"], -len(b["op_chain"])), n, m))
    return max(pairs)[1:] if pairs else None
