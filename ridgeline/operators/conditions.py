"""Pre- and postconditions of events, evaluated by aggregation over their joined samples."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COMPARE = {">=": lambda a, b: a >= b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "<": lambda a, b: a < b}


@dataclass(frozen=True)
class Test:
    """range: lo <= all values <= hi; delta: the change from the trigger compared; peak: the extreme compared.

    lo_idx and hi_idx (half-open, relative to the trigger) narrow the block's slice.
    """

    kind: str
    column: str
    lo: float | None = None
    hi: float | None = None
    cmp: str | None = None
    value: float | None = None
    peak: str = "max"
    lo_idx: int | None = None
    hi_idx: int | None = None


@dataclass(frozen=True)
class Block:
    """A slice [lo_idx, hi_idx) of samples around the trigger: all_of AND, any_of OR."""

    lo_idx: int
    hi_idx: int
    all_of: Sequence[Test] = field(default_factory=tuple)
    any_of: Sequence[Test] = field(default_factory=tuple)


def _result(test: Test, block: Block, at: str, idx: str) -> Column:
    """An aggregate over an event's samples; an empty slice or an unknown test is false."""
    a, b = sorted((block.lo_idx if test.lo_idx is None else test.lo_idx, block.hi_idx if test.hi_idx is None else test.hi_idx))
    rel = F.col(idx) - F.col(at)
    y = F.when((rel >= a) & (rel < max(b, a + 1)), F.col(test.column))
    if test.kind == "range":
        lo, hi = F.min(y), F.max(y)
        out = hi.isNotNull()
        out = out & (lo >= test.lo) if test.lo is not None else out
        out = out & (hi <= test.hi) if test.hi is not None else out
    elif test.kind in ("delta", "peak"):
        if test.cmp not in COMPARE:
            raise KeyError(f"a {test.kind} test needs cmp, one of {sorted(COMPARE)}")
        if test.kind == "delta":
            y = y - F.col(f"__at_{test.column}")
            out = COMPARE[test.cmp](F.max(y) if test.cmp[0] == ">" else F.min(y), F.lit(test.value))
        else:
            out = COMPARE[test.cmp](F.max(y) if test.peak == "max" else F.min(y), F.lit(test.value))
    else:
        out = F.lit(False)
    return F.coalesce(out, F.lit(False))


def apply_conditions(windows: DataFrame, keys: Sequence[str], at: str, idx: str, blocks: Sequence[Block]) -> DataFrame:
    """The keys of events whose blocks all hold; windows has each event's samples, ``at`` its trigger's index."""
    changing = sorted({c.column for b in blocks for c in (*b.all_of, *b.any_of) if c.kind == "delta"})
    rows = windows
    if changing:
        values = [F.first(c).alias(f"__at_{c}") for c in changing]
        rows = rows.join(windows.filter(F.col(idx) == F.col(at)).groupBy(*keys).agg(*values), list(keys), "left")
    verdicts = []
    for b in blocks:
        every = [_result(x, b, at, idx) for x in b.all_of]
        some = [_result(x, b, at, idx) for x in b.any_of]
        one = F.lit(True)
        for x in every:
            one = one & x
        if some:
            either = F.lit(False)
            for x in some:
                either = either | x
            one = one & either
        verdicts.append(one)
    out = F.lit(True)
    for v in verdicts:
        out = out & v
    return rows.groupBy(*keys).agg(out.alias("__ok")).filter("__ok").drop("__ok")


def flagged(samples: DataFrame, keys: Sequence[str], columns: Sequence[str], limits: Sequence[str] = ()) -> DataFrame:
    """samples plus __null (one of the columns is unknown) and __edge (one of limits is at its least or greatest value within keys)."""
    none = F.lit(False)
    for c in columns:
        none = none | F.col(f"`{c}`").isNull()
    if not limits:
        return samples.withColumns({"__null": none, "__edge": F.lit(False)})
    w = Window.partitionBy(*keys)
    edge = F.lit(False)
    for c in limits:
        y = F.col(f"`{c}`")
        edge = edge | F.coalesce((y == F.min(y).over(w)) | (y == F.max(y).over(w)), F.lit(False))
    return samples.withColumns({"__null": none, "__edge": edge})


def quality_gate(windows: DataFrame, keys: Sequence[str], max_null_share: float | None = None, skip_edges: bool = False) -> DataFrame:
    """The keys of events whose samples (of ``flagged``) have few enough unknowns and, if asked, touch no limit of the series."""
    good = F.lit(True)
    if max_null_share is not None:
        good = good & (F.avg(F.col("__null").cast("int")) <= max_null_share)
    if skip_edges:
        good = good & ~F.bool_or("__edge")
    return windows.groupBy(*keys).agg(good.alias("__ok")).filter("__ok").drop("__ok")
