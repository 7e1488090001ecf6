"""Joins along time or sample position, and the joins of events with metrics.

Range joins are turned into equi joins on (session, cell): each side's interval
is dealt to the cells it touches, so they shuffle by key and cell and a long
session is many cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cells(lo: Column, hi: Column, width: float) -> Column:
    return F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width)))


def window_join(events: DataFrame, samples: DataFrame, keys: Sequence[str], lo: Column, hi: Column, at: str, width: float) -> DataFrame:
    """Every event with the samples whose ``at`` lies in [lo, hi] (both of the event), ends included."""
    e = events.withColumns({"__lo": lo, "__hi": hi}).filter("__lo <= __hi").withColumn("__cell", _cells(F.col("__lo"), F.col("__hi"), width))
    s = samples.withColumn("__cell", F.floor(F.col(at) / width))
    return e.join(s, [*keys, "__cell"]).filter((F.col(at) >= F.col("__lo")) & (F.col(at) <= F.col("__hi"))).drop("__lo", "__hi", "__cell")


def overlap_join(a: DataFrame, b: DataFrame, keys: Sequence[str], a_ends: tuple[str, str], b_ends: tuple[str, str], width: float, contained: bool = False) -> DataFrame:
    """Pairs whose closed intervals meet for a positive time (overlap), or that hold an interval of length 0.

    contained: only pairs where b holds a.
    """
    x = a.withColumn("__cell", _cells(F.col(a_ends[0]), F.col(a_ends[1]), width)).withColumn("__from_a", F.floor(F.col(a_ends[0]) / width))
    y = b.withColumn("__cell", _cells(F.col(b_ends[0]), F.col(b_ends[1]), width)).withColumn("__from_b", F.floor(F.col(b_ends[0]) / width))
    out = x.join(y, [*keys, "__cell"]).filter(F.col("__cell") == F.greatest("__from_a", "__from_b"))  # once a pair
    lo, hi = F.greatest(F.col(a_ends[0]), F.col(b_ends[0])), F.least(F.col(a_ends[1]), F.col(b_ends[1]))
    out = out.withColumn("overlap", hi - lo).filter((F.col("overlap") > 0) | (F.col("overlap") == 0) & (F.col(a_ends[0]) == F.col(a_ends[1])))
    if contained:
        out = out.filter((F.col(b_ends[0]) <= F.col(a_ends[0])) & (F.col(b_ends[1]) >= F.col(a_ends[1])))
    return out.drop("__cell", "__from_a", "__from_b")


def _bracketed(target: DataFrame, source: DataFrame, keys: Sequence[str], t: str, columns: Sequence[str], cell: float | None = None) -> DataFrame:
    """target with, for each column, the last known source point at or before t and the first at or after it (__a0, __b0, ...).

    With cell, rows are ordered within (keys, cell of t) only, and each cell
    takes over the nearest points of the cells before and after it, which is a
    window over one row a cell: a long session is many tasks.
    """
    points = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.col(t).alias("t"), F.col(f"`{c}`").cast("double").alias("y"))).alias(f"__p{i}") for i, c in enumerate(columns)]
    marks = source.select(*keys, t, *points).withColumn("__target", F.lit(False))
    both = target.withColumn("__target", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    by = list(keys)
    if cell is not None:
        both, by = both.withColumn("__cell", F.floor(F.col(t) / cell)), [*keys, "__cell"]
    # Points of one time stand before the target when looking back and after it when looking ahead.
    back = Window.partitionBy(*by).orderBy(t, "__target").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.col(t).desc(), "__target").rowsBetween(Window.unboundedPreceding, 0)
    n = range(len(columns))
    sides = {f"__a{i}": F.last(f"__p{i}", ignorenulls=True).over(back) for i in n} | {f"__b{i}": F.last(f"__p{i}", ignorenulls=True).over(ahead) for i in n}
    out = both.withColumns(sides).filter("__target").drop("__target", *[f"__p{i}" for i in n])
    if cell is None:
        return out
    ends = [f(f"__p{i}", F.when(F.col(f"__p{i}").isNotNull(), F.col(t))).alias(f"{e}{i}") for i in n for e, f in (("__last", F.max_by), ("__first", F.min_by))]
    cells = both.groupBy(*by).agg(*ends)
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*keys).orderBy(F.col("__cell").desc()).rowsBetween(Window.unboundedPreceding, -1)
    near = {f"__last{i}": F.last(f"__last{i}", ignorenulls=True).over(before) for i in n} | {f"__first{i}": F.last(f"__first{i}", ignorenulls=True).over(after) for i in n}
    out = out.join(cells.withColumns(near), by)
    taken = {f"__a{i}": F.coalesce(f"__a{i}", f"__last{i}") for i in n} | {f"__b{i}": F.coalesce(f"__b{i}", f"__first{i}") for i in n}
    return out.withColumns(taken).drop("__cell", *[f"__{e}{i}" for i in n for e in ("last", "first")])


def interp_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], t: str, columns: Mapping[str, str], single_constant: bool = False, cell: float | None = None) -> DataFrame:
    """target plus columns (name in source: name in the result), each linear between its known points; null outside them.

    A column of fewer than two points gives nulls, or with single_constant its
    only value everywhere. All columns share one pass.
    """
    names = list(columns)
    out = _bracketed(target, source, keys, t, names, cell)
    counts = source.groupBy(*keys).agg(*[F.count(F.col(f"`{c}`")).alias(f"__n{i}") for i, c in enumerate(names)], *[F.first(F.col(f"`{c}`"), ignorenulls=True).alias(f"__one{i}") for i, c in enumerate(names)])
    out = out.join(counts, list(keys), "left")
    values = {}
    for i, c in enumerate(names):
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        line = F.when(a["t"] == b["t"], a["y"]).otherwise(a["y"] + (b["y"] - a["y"]) * (F.col(t) - a["t"]) / (b["t"] - a["t"]))
        value = F.when((F.col(f"__n{i}") >= 2) & a.isNotNull() & b.isNotNull(), line)
        values[columns[c]] = F.when(F.col(f"__n{i}") == 1, F.col(f"__one{i}")).otherwise(value) if single_constant else value
    return out.withColumns(values).drop(*[f"__{e}{i}" for i in range(len(names)) for e in ("a", "b", "n", "one")])


def interp_join(target: DataFrame, source: DataFrame, keys: Sequence[str], t: str, y: str, name: str | None = None, single_constant: bool = False, cell: float | None = None) -> DataFrame:
    """``interp_columns`` of one column."""
    return interp_columns(target, source, keys, t, {y: name or y}, single_constant, cell)


def shift_join(target: DataFrame, source: DataFrame, keys: Sequence[str], t: str, y: str, shift: float, name: str) -> DataFrame:
    """source, moved later by shift, interpolated onto target."""
    return interp_join(target, source.withColumn(t, F.col(t) + shift), keys, t, y, name)


def nearest_join(target: DataFrame, source: DataFrame, keys: Sequence[str], t: str, y: str, name: str, cell: float | None = None) -> DataFrame:
    """target plus y of the source point nearest in time; the earlier one wins ties."""
    out = _bracketed(target, source, keys, t, [y], cell)
    a, b = F.col("__a0"), F.col("__b0")
    near = F.when(b.isNull() | (F.col(t) - a["t"] <= b["t"] - F.col(t)), a["y"]).otherwise(b["y"])
    return out.withColumn(name, F.when(a.isNull(), b["y"]).otherwise(near)).drop("__a0", "__b0")


def secondary_trigger(primary: DataFrame, cands: DataFrame, keys: Sequence[str], event: str, t: str, cand_t: str, min_delay: float, max_delay: float, pick: str = "forward", width: float | None = None) -> DataFrame:
    """For each primary event one candidate with delay in [min_delay, max_delay], if there is one.

    pick: forward takes the earliest, backward the latest, closest the nearest
    (earlier on ties); auto is forward for delays of one positive sign,
    backward for negative ones, else closest.
    """
    if pick == "auto":
        pick = "forward" if min_delay >= 0 else "backward" if max_delay <= 0 else "closest"
    joined = window_join(primary, cands, keys, F.col(t) + min_delay, F.col(t) + max_delay, cand_t, width or max(max_delay - min_delay, 1e-9))
    c = F.col(cand_t)
    order = {"forward": F.struct(c), "backward": F.struct(-c), "closest": F.struct(F.abs(c - F.col(t)), c)}[pick]
    best = joined.groupBy(event).agg(F.min_by(F.struct(*[x for x in cands.columns if x not in keys]), order).alias("secondary"))
    return primary.join(best, event, "left")


def events_with_metrics(events: DataFrame, metrics: DataFrame, keys: Sequence[str] = ("session_key", "schema_id", "event_id")) -> DataFrame:
    """Inner join of one event with one metrics row; a key that is not unique is an error."""
    one = lambda df, side: df.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).withColumn("__n", F.when(F.col("__n") > 1, F.raise_error(F.lit(f"{side} keys are not unique"))).otherwise(F.col("__n"))).filter("__n = 1").drop("__n")
    return one(events, "event").join(one(metrics, "metric"), list(keys))


def left_merge(events: DataFrame, metrics: DataFrame, keys: Sequence[str] | None = None, suffix: str = "_m") -> DataFrame:
    """Left join on the given or the shared key columns; other shared names of metrics get the suffix."""
    keys = [k for k in (keys or ("session_key", "session_id", "event_id", "schema_id")) if k in events.columns and k in metrics.columns]
    if not keys or "event_id" not in keys:
        return events
    clash = {c: c + suffix for c in metrics.columns if c in events.columns and c not in keys}
    return events.join(metrics.withColumnsRenamed(clash), keys, "left")


def orphans(metrics: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of metrics without an event."""
    return metrics.join(events, list(keys), "left_anti")
