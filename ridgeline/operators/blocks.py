"""Ordered series in blocks: what a kernel needs from other blocks comes as a halo or as a carry.

A series has session columns and ``sample_idx`` (0 to n - 1). Its rows are dealt by
session and block of samples, so a long session is many tasks and many short
ones share a task. A halo copies the samples near a block's ends to its
neighbours. A carry is a small row a block: one pass sums up each block, a scan
over the summaries of a session composes them, and the next pass gets what lies
before or after each block.

Rows reach Python as one sorted Arrow stream a partition. A group of the stream
is a block (or a session's summaries); no more than a block and a batch is held.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Samples of a block.
BLOCK = 1 << 16


@dataclass
class Group:
    """A block: positions and values (null is NaN) of its own and its halo's samples, and its carry."""

    at: int
    idx: np.ndarray
    own: np.ndarray
    values: dict[str, np.ndarray]
    carry: dict


def fitting(samples: DataFrame, block: int = BLOCK) -> int | None:
    """None where every session fits into a block, so that kernels need no other; else block."""
    most = samples.agg(F.max("sample_idx")).first()[0]
    return None if most is None or most < block else block


def by_length(df: DataFrame, keys: Sequence[str], kernel: Callable[[DataFrame, int | None], DataFrame], block: int = BLOCK) -> DataFrame:
    """What kernel(rows, block) gives: sessions that fit into a block go through it with none, in one pass, and only longer ones in blocks."""
    long = df.groupBy(*keys).agg(F.max("sample_idx").alias("__most")).filter(F.col("__most") >= block).drop("__most")
    if long.isEmpty():
        return kernel(df, None)
    same = [df[k].eqNullSafe(long[k]) for k in keys]
    return kernel(df.join(long, same, "left_anti"), None).unionByName(kernel(df.join(long, same, "left_semi"), block))


def block_of(block: int) -> Column:
    return F.floor(F.col("sample_idx") / block).cast("long")


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Whole groups of the stream and where they begin; a group begins where __turn is 1."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        starts = np.flatnonzero(batch.column("__turn").to_numpy() == 1)
        if not len(starts):
            rest.append(batch)
            continue
        cut = int(starts[-1])
        head = pa.concat_batches([*rest, batch.slice(0, cut)])
        if head.num_rows:
            yield head, np.flatnonzero(head.column("__turn").to_numpy() == 1).tolist()
        rest = [batch.slice(cut)]
    if rest and sum(b.num_rows for b in rest):
        head = pa.concat_batches(rest)
        yield head, np.flatnonzero(head.column("__turn").to_numpy() == 1).tolist()


def streamed(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """df, clustered and sorted, with __turn, the row's number in its group. An exchange that already does it is used again."""
    return df.withColumn("__turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def _dealt(df: DataFrame, keys: Sequence[str], block: int | None, halo: int, carry: DataFrame | None) -> DataFrame:
    """Rows by block (__at), with copies for the halos (not __own) and carry rows (no sample_idx). Without a block a session is one group."""
    if block is None:
        return streamed(df.withColumns({"__at": F.lit(0).cast("long"), "__own": F.lit(True)}), keys, ["sample_idx"])
    here = block_of(block)
    out = df.withColumn("__at", here)
    if halo:
        near = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-halo, 0, halo)]), lambda d: F.floor(F.greatest(F.col("sample_idx") + d, F.lit(0)) / block).cast("long")))
        out = df.withColumn("__home", here).withColumn("__at", F.explode(near)).withColumn("__own", F.col("__at") == F.col("__home")).drop("__home")
    else:
        out = out.withColumn("__own", F.lit(True))
    if carry is not None:
        out = out.unionByName(carry.withColumn("__own", F.lit(False)), allowMissingColumns=True)
    return streamed(out, [*keys, "__at"], [F.col("sample_idx").asc_nulls_first()])


def _groups(chunk: pa.RecordBatch, starts: list[int], values: Sequence[str], carried: Sequence[str] | None) -> Iterator[tuple[int, int, Group]]:
    """(first row, end, group) of each block; carry rows are left out of it. A whole session (carried is None) counts from its first sample."""
    numbers = {v: _numbers(chunk.column(v)) for v in values}
    none = chunk.column("sample_idx").is_null().to_numpy(zero_copy_only=False)
    idx = chunk.column("sample_idx").fill_null(-1).to_numpy()
    at, own = chunk.column("__at").to_numpy(), chunk.column("__own").to_numpy(zero_copy_only=False)
    for a, b in zip(starts, [*starts[1:], chunk.num_rows], strict=True):
        if carried is None:
            known = {f"known_{i}": int(np.isfinite(x[a:b]).sum()) for i, x in enumerate(numbers.values())}
            yield a, b, Group(0, idx[a:b] - idx[a], own[a:b], {v: x[a:b] for v, x in numbers.items()}, {"n": b - a, "last": 0, **known})
            continue
        first = a + int(none[a:b].sum())
        carry = {c: chunk.column(c)[a].as_py() for c in carried} if first > a else {}
        yield first, b, Group(int(at[a]), idx[first:b], own[first:b], {v: x[first:b] for v, x in numbers.items()}, carry)


def add_columns(df: DataFrame, keys: Sequence[str], values: Sequence[str], new: dict[str, str], kernel: Callable[[Group], dict[str, np.ndarray]], block: int | None = BLOCK, halo: int = 0, carry: DataFrame | None = None) -> DataFrame:
    """df with new columns (name: type); kernel gives an array over the group's samples for each. NaN becomes null."""
    fields = StructType([*df.schema.fields, *StructType.fromDDL(", ".join(f"`{n}` {t}" for n, t in new.items())).fields])
    carried = None if block is None else [c for c in carry.columns if c not in (*keys, "__at")] if carry is not None else []
    own_names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in _chunks(batches):
            out = {n: np.zeros(chunk.num_rows, bool if new[n] == "boolean" else float) for n in new}
            keep = np.zeros(chunk.num_rows, bool)
            for a, b, group in _groups(chunk, starts, values, carried):
                if group.own.any():
                    for n, x in kernel(group).items():
                        out[n][a:b] = x
                    keep[a:b] = group.own
            columns = [chunk.column(c) for c in own_names]
            columns += [pa.array(x, mask=~np.isfinite(x)) if x.dtype == float else pa.array(x) for x in out.values()]
            yield pa.RecordBatch.from_arrays(columns, [*own_names, *new]).filter(pa.array(keep))

    return _dealt(df, keys, block, halo, carry).mapInArrow(run, fields)


def emitted(df: DataFrame, keys: Sequence[str], values: Sequence[str], schema: str, kernel: Callable[[Group], dict[str, list]], block: int | None = BLOCK, halo: int = 0, carry: DataFrame | None = None) -> DataFrame:
    """keys, __at and the columns of schema: the rows that kernel gives for each block, as a list for each column."""
    kinds = StructType.fromDDL(schema).fields
    carried = None if block is None else [c for c in carry.columns if c not in (*keys, "__at")] if carry is not None else []
    named = {f.name: f for f in df.schema.fields}
    fields = StructType([*[named[k] for k in keys], StructField("__at", LongType()), *kinds])
    arrow = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in _chunks(batches):
            rows: list[int] = []
            out: dict[str, list] = {n: [] for n in arrow}
            for a, b, group in _groups(chunk, starts, values, carried):
                if group.own.any():
                    made = kernel(group)
                    rows += [a] * len(next(iter(made.values())))
                    for n, x in made.items():
                        out[n].extend(x)
            columns = [chunk.column(k).take(pa.array(rows, pa.int64())) for k in (*keys, "__at")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(x, arrow[n]) for n, x in out.items()]], [*keys, "__at", *arrow])

    return _dealt(df.select(*keys, "sample_idx", *[F.col(f"`{v}`") for v in values]), keys, block, halo, carry).mapInArrow(run, fields)


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    plain = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32(), "string": pa.string()}
    return {f.name: pa.list_(plain[t[6:-1]]) if (t := f.dataType.simpleString()).startswith("array<") else plain[t] for f in StructType.fromDDL(schema).fields}


def scanned(summaries: DataFrame, keys: Sequence[str], schema: str, compose: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """keys, __at and the columns of schema: compose gets a session's summaries in order of the blocks, and gives a row for each."""
    named = {f.name: f for f in summaries.schema.fields}
    fields = StructType([*[named[k] for k in (*keys, "__at")], *StructType.fromDDL(schema).fields])
    arrow, own = _arrow_types(schema), [c for c in summaries.columns if c not in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, starts in _chunks(batches):
            rows = chunk.select(own).to_pylist()
            out = [x for a, b in zip(starts, [*starts[1:], len(rows)], strict=True) for x in compose(rows[a:b])]
            columns = [chunk.column(k) for k in (*keys, "__at")]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array([x[n] for x in out], t) for n, t in arrow.items()]], [*keys, "__at", *arrow])

    return streamed(summaries, keys, ["__at"]).mapInArrow(run, fields)


# --- missing samples

#: What ``fills`` gives for the value of that number.
FILL = ("prev", "next", "known")


def fills(df: DataFrame, keys: Sequence[str], values: Sequence[str], block: int = BLOCK, halo: int = 0) -> DataFrame:
    """A carry: n and last (the session's samples and last block), and for each value the last known sample before the block's halo, the first after it, and the session's known samples.

    Its columns are n, last, and prev_i, next_i (position and value), known_i for the i-th value.
    """
    if halo > block:
        raise ValueError("a halo must fit into a block")
    inside = F.pmod(F.col("sample_idx"), F.lit(block))
    aggs = [(F.max("sample_idx") + 1).alias("n")]
    for i, v in enumerate(values):
        y = F.col(f"`{v}`").cast("double")
        y = F.when(~F.isnan(y) & (F.abs(y) < float("inf")), y)
        pair = F.array(F.col("sample_idx").cast("double"), y)
        for name, pick, zone in (("last", F.max_by, F.lit(True)), ("early", F.max_by, inside < block - halo), ("first", F.min_by, F.lit(True)), ("late", F.min_by, inside >= halo)):
            aggs.append(pick(pair, F.when(y.isNotNull() & zone, F.col("sample_idx"))).alias(f"{name}_{i}"))
        aggs.append(F.count(y).alias(f"count_{i}"))
    per = df.groupBy(*keys, block_of(block).alias("__at")).agg(*aggs)
    w, whole = Window.partitionBy(*keys).orderBy("__at"), Window.partitionBy(*keys)
    far = w.rowsBetween(Window.unboundedPreceding, -2), w.rowsBetween(2, Window.unboundedFollowing)
    out = [F.max("n").over(whole).alias("n"), F.max("__at").over(whole).alias("last")]
    for i in range(len(values)):
        out.append(F.coalesce(F.lag(f"early_{i}").over(w), F.last(f"last_{i}", ignorenulls=True).over(far[0])).alias(f"prev_{i}"))
        out.append(F.coalesce(F.lead(f"late_{i}").over(w), F.first(f"first_{i}", ignorenulls=True).over(far[1])).alias(f"next_{i}"))
        out.append(F.sum(f"count_{i}").over(whole).alias(f"known_{i}"))
    return per.select(*keys, "__at", *out)


def filled(group: Group, value: str, i: int = 0) -> np.ndarray:
    """The group's samples, missing ones interpolated by position; the carry is that of ``fills``."""
    y = group.values[value]
    known = np.isfinite(y)
    if known.all():
        return y
    x, v = [group.idx[known].astype(float)], [y[known]]
    before, after = group.carry.get(f"prev_{i}"), group.carry.get(f"next_{i}")
    if before:
        x, v = [[before[0]], *x], [[before[1]], *v]
    if after:
        x, v = [*x, [after[0]]], [*v, [after[1]]]
    x, v = np.concatenate(x), np.concatenate(v)
    return np.interp(group.idx, x, v) if len(x) else y
