"""Sensor bench analysis: period, scale and shift of a crank-driven sensor, and its residuals.

A capture is one session. Periods and smoothing go through blocks of it, harmonics
are plain aggregations; the fit's grid search is a grouped map by capture.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ridgeline.operators.blocks import BLOCK, Group, block_of, emitted
from ridgeline.operators.series import finite
from ridgeline.operators.signal import find_peaks, savgol_columns


def ideal_displacement(theta: np.ndarray, r_mm: float, l_mm: float) -> np.ndarray:
    """String length to a crank pin, less the shortest."""
    return np.sqrt(r_mm**2 + l_mm**2 - 2 * r_mm * l_mm * np.cos(theta)) - abs(l_mm - r_mm)


def _lags(n: int, dt: float, min_rpm: float, max_rpm: float) -> tuple[int, int]:
    """The least and largest lag that a turn may take."""
    return max(1, int(60 / max_rpm / dt)), min(n - 2, int(60 / min_rpm / dt))


def _highest(auto: np.ndarray, n: int, dt: float, min_rpm: float, max_rpm: float) -> float:
    """Seconds a turn from the mean products of samples by lag (one lag more than the largest): the highest; NaN if there is none."""
    lo, hi = _lags(n, dt, min_rpm, max_rpm)
    if n < 4 or hi <= lo:
        return float("nan")
    tops = find_peaks(auto[: hi + 2])
    tops = tops[(tops >= lo) & (tops <= hi)]
    if len(tops):  # of the turns and their multiples the first that is about as high as any
        most = auto[tops].max()
        k = int(tops[auto[tops] >= most - 0.1 * abs(most)][0])
    else:
        k = lo + int(np.argmax(auto[lo : hi + 1]))
    a, b, c = auto[k - 1 : k + 2]
    bend = a - 2 * b + c
    return (k + (0.5 * (a - c) / bend if bend else 0.0)) * dt


def _products(own: np.ndarray, rest: np.ndarray, lags: int) -> np.ndarray:
    """Sums of own samples times those 0 to lags - 1 later; rest begins with own and goes on."""
    size = 1 << (len(own) + len(rest)).bit_length()
    out = np.fft.irfft(np.conj(np.fft.rfft(own, size)) * np.fft.rfft(rest, size), size)
    return out[:lags] if lags <= len(rest) else np.pad(out[: len(rest)], (0, lags - len(rest)))


def period_of(t: np.ndarray, y: np.ndarray, min_rpm: float = 5.0, max_rpm: float = 300.0) -> float:
    """Seconds a turn of one capture."""
    if len(t) < 4:
        return float("nan")
    dt, x = float(np.median(np.diff(t))), y - y.mean()
    lags = min(len(x), _lags(len(x), dt, min_rpm, max_rpm)[1] + 2)
    return _highest(_products(x, x, max(lags, 1)) / np.arange(len(x), len(x) - max(lags, 1), -1), len(x), dt, min_rpm, max_rpm)


def fit(t: np.ndarray, y: np.ndarray, r_mm: float, l_mm: float, period: float) -> tuple[float, float, float, float]:
    """(period, shift, scale, rms) of scale * y against the ideal: a grid of shifts and periods, then a finer one."""
    best = (np.inf, period, 0.0, 1.0)
    for span, steps in ((0.02, 9), (0.005, 9), (0.001, 9)):
        _, p0, s0, _ = best
        shifts = np.linspace(0, p0, 60, endpoint=False) if span == 0.02 else s0 + np.linspace(-p0, p0, 41) * span * 3
        for p in p0 * (1 + np.linspace(-span, span, steps)):
            ideal = ideal_displacement(2 * np.pi * (t[None, :] - shifts[:, None]) / p, r_mm, l_mm)
            a = y - y.mean()
            b = ideal - ideal.mean(1, keepdims=True)
            scale = (b @ a) / max(float(a @ a), 1e-12)
            rms = np.sqrt(np.mean((b - scale[:, None] * a) ** 2, axis=1))
            k = int(np.argmin(np.where(scale > 0, rms, np.inf)))
            if rms[k] < best[0] and scale[k] > 0:
                best = (float(rms[k]), float(p), float(shifts[k]), float(scale[k]))
    rms, p, s, scale = best
    return p, s % p, scale, rms


def periods(df: DataFrame, keys: Sequence[str], t: str, y: str, min_rpm: float = 5.0, max_rpm: float = 300.0, block: int = BLOCK) -> DataFrame:
    """keys, period_s: seconds a turn of each capture (null if there is none), the highest autocorrelation between the periods of both speeds.

    Each block multiplies its samples with those up to the largest lag later, of
    which it has a halo; the sums of all blocks are added up, so only sums by lag
    of a capture meet. Missing samples count as the mean.
    """
    rows = df.select(*keys, "sample_idx", F.col(t).cast("double").alias("__t"), finite(F.col(y)).alias("__y"))
    step = F.col("__t") - F.lag("__t").over(Window.partitionBy(*keys).orderBy("sample_idx"))
    base = rows.withColumn("__dt", step).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("__y").alias("mean"), F.percentile("__dt", 0.5).alias("dt"))
    most = base.filter("dt > 0").agg(F.max(F.least(F.col("n") - 2, F.floor(60 / F.lit(float(min_rpm)) / F.col("dt"))))).first()[0] or 0
    halo = max(int(most), 0) + 1
    if halo > block:
        raise ValueError(f"a turn takes up to {halo} samples, more than a block of {block}")

    def kernel(g: Group) -> dict[str, list]:
        n, mean, dt = g.carry["n"], g.carry["mean"], g.carry["dt"]
        if n < 4 or mean is None or not dt or dt <= 0:
            return {"lag": [], "total": []}
        lags = min(n, max(_lags(n, dt, min_rpm, max_rpm)[1], 0) + 2)
        x = np.nan_to_num(g.values["__y"] - mean)
        a, b = np.flatnonzero(g.own)[[0, -1]]
        return {"lag": list(range(lags)), "total": _products(x[a : b + 1], x[a:], lags).tolist()}

    carry = rows.select(*keys, block_of(block).alias("__at")).distinct().join(base, list(keys))
    sums = emitted(rows, keys, ["__y"], "lag bigint, total double", kernel, block, halo, carry).groupBy(*keys, "lag").agg(F.sum("total").alias("total"))
    whole = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lag", "total"))).alias("sums"))  # a number a lag
    whole = base.select(*keys, "n", "dt").join(whole, list(keys), "left")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, dt, found in zip(*[batch.column(c).to_pylist() for c in ("n", "dt", "sums")], strict=True):
                auto = np.array([x["total"] for x in found or ()]) / np.arange(n, n - len(found or ()), -1)
                p = _highest(auto, n, dt, min_rpm, max_rpm) if len(auto) else float("nan")
                out.append(p if np.isfinite(p) else None)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(out, pa.float64())], [*keys, "period_s"])

    return whole.mapInArrow(choose, StructType([*df.select(*keys).schema, StructField("period_s", DoubleType())]))


def fits(df: DataFrame, keys: Sequence[str], t: str, y: str, r_mm: float, l_mm: float) -> DataFrame:
    """keys, period_s, shift_s, scale, rms_mm."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(t)
        a, b = pdf[t].to_numpy(float), pdf[y].to_numpy(float)
        p = period_of(a, b)
        out = fit(a, b, r_mm, l_mm, p) if np.isfinite(p) else (np.nan,) * 4
        return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in keys}, **dict(zip(("period_s", "shift_s", "scale", "rms_mm"), out, strict=True))}])

    schema = df.select(*keys).schema
    for n in ("period_s", "shift_s", "scale", "rms_mm"):
        schema = schema.add(n, "double")
    return df.groupBy(*keys).applyInPandas(run, schema)


def oversampling(df: DataFrame, keys: Sequence[str], t: str, y: str, r_mm: float, l_mm: float, factors: Sequence[int] = (1, 2, 4, 8)) -> DataFrame:
    """The fit of block means for each factor, and its rms over that of factor 1."""
    from ridgeline.operators.series import block_average, with_sample_idx

    many = df.select(*keys, t, y, F.explode(F.array(*[F.lit(f) for f in factors])).alias("factor"))
    many = with_sample_idx(many, [*keys, "factor"], [t])
    blocks = None
    for f in factors:
        one = block_average(many.filter(F.col("factor") == f), [*keys, "factor"], y, t, f)
        blocks = one if blocks is None else blocks.unionByName(one)
    out = fits(blocks, [*keys, "factor"], "t", "value", r_mm, l_mm)
    base = out.filter("factor = 1").select(*keys, F.col("rms_mm").alias("__base"))
    return out.join(base, list(keys), "left").withColumn("rms_ratio", F.col("rms_mm") / F.col("__base")).drop("__base")


def harmonics(df: DataFrame, keys: Sequence[str], t: str, residual: str, period_s: float, most: int = 3) -> DataFrame:
    """keys, harmonic, cosine, sine, amplitude by projection: sums over whole captures, no grouping in memory."""
    rows = df.filter(F.col(residual).isNotNull())
    angle = F.col(t) * (2 * np.pi / period_s)
    aggs = [2 * F.avg(F.col(residual) * f(angle * h)) for h in range(1, most + 1) for f in (F.cos, F.sin)]
    per = rows.groupBy(*keys).agg(*[a.alias(f"__{i}") for i, a in enumerate(aggs)])
    parts = F.array(*[F.struct(F.lit(h).alias("harmonic"), F.col(f"__{2 * h - 2}").alias("cosine"), F.col(f"__{2 * h - 1}").alias("sine")) for h in range(1, most + 1)])
    return per.select(*keys, F.inline(parts)).withColumn("amplitude", F.sqrt(F.col("cosine") * F.col("cosine") + F.col("sine") * F.col("sine")))


def smooth(df: DataFrame, keys: Sequence[str], y: str, window: int = 11, order: int = 3, block: int | None = BLOCK) -> DataFrame:
    """Adds smooth: the Savitzky-Golay value (derivative 0) of each session."""
    return savgol_columns(df, keys, {"smooth": (y, 0)}, 1.0, window, order, block)
