"""Summaries of samples and metrics, all of them exact built-in aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = (0.25, 0.5, 0.75, 0.9, 0.95)


def _agg(df: DataFrame, keys: Sequence[str], *cols: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*cols) if keys else df.agg(*cols)


def trimmed_quantiles(df: DataFrame, keys: Sequence[str], value: str, cutoff: float, min_count: int = 5) -> DataFrame:
    """n, q25 to q95, iqr and Bowley skew of values from cutoff up; nulls where there are too few."""
    x = F.when(F.col(value) >= cutoff, F.col(value))
    q = F.percentile(x, F.array(*[F.lit(p) for p in QUANTILES]))
    out = _agg(df, keys, F.count(x).alias("n"), q.alias("q"))
    enough = F.col("n") >= min_count
    out = out.select(*keys, "n", *[F.when(enough, F.col("q")[i]).alias(f"q{int(p * 100)}") for i, p in enumerate(QUANTILES)])
    iqr = F.col("q75") - F.col("q25")
    return out.withColumns({"iqr": iqr, "skew": F.when(iqr != 0, (F.col("q75") + F.col("q25") - 2 * F.col("q50")) / iqr)})


def paired_quantiles(df: DataFrame, keys: Sequence[str], norm: str, mm: str, cutoff: float = 0.05) -> DataFrame:
    """Quantiles of two columns over rows where both are known and norm reaches the cutoff."""
    rows = df.filter((F.col(norm) >= cutoff) & F.col(mm).isNotNull())
    at = F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 0.95, 1.0)])
    out = _agg(rows, keys, F.count(F.lit(1)).alias("n"), F.percentile(norm, at).alias("a"), F.percentile(mm, at).alias("b"))
    names = [f"{side}_q{p}" for side in ("norm", "mm") for p in (25, 50, 75, 95, 100)]
    return out.select(*keys, "n", *[F.col("a" if i < 5 else "b")[i % 5].alias(n) for i, n in enumerate(names)]).withColumns({f"{s}_iqr": F.col(f"{s}_q75") - F.col(f"{s}_q25") for s in ("norm", "mm")})


def phase_stats(df: DataFrame, keys: Sequence[str], vel: str) -> DataFrame:
    """n, mean, largest and 95 % absolute value of negative (rebound) and positive (compression) velocity."""
    out = []
    for name, side in (("rebound", F.col(vel) < 0), ("compression", F.col(vel) > 0)):
        v = F.when(side, F.col(vel))
        out += [F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_mean"), F.max(F.abs(v)).alias(f"{name}_max"), F.percentile(F.abs(v), 0.95).alias(f"{name}_p95")]
    return _agg(df, keys, *out)


def overflow_histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int, limit: float) -> DataFrame:
    """bin, n, share: bins of equal width over +-limit and one for what is beyond on either side."""
    x = F.col(value)
    step = 2 * limit / bins
    bin_ = F.when(F.abs(x) > limit, bins).otherwise(F.least(F.floor((x + limit) / step), F.lit(bins - 1))).cast("int")
    out = df.filter(x.isNotNull()).groupBy(*keys, bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def histogram(df: DataFrame, keys: Sequence[str], value: str, bins: int) -> DataFrame:
    """bin, lo, hi, n over min to max in bins of equal width; the last bin holds the maximum."""
    ends = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    rows = df.filter(F.col(value).isNotNull()).join(ends, list(keys)) if keys else df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends))
    step = (F.col("__hi") - F.col("__lo")) / bins
    bin_ = F.when(step > 0, F.least(F.floor((F.col(value) - F.col("__lo")) / step), F.lit(bins - 1))).otherwise(0).cast("int")
    out = rows.groupBy(*keys, "__lo", "__hi", bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "bin", (F.col("__lo") + F.col("bin") * step).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * step).alias("hi"), "n")


def ecdf(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Each distinct value with the share of values up to it: counts are summed, not rows."""
    per = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    return per.withColumn("share", F.sum("n").over(w.orderBy(value)) / F.sum("n").over(w))


def series_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _agg(df, keys, F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), F.percentile(value, 0.5).alias("median"))


def scatter_summary(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """n, ends and means of both, Pearson r, and the least-squares line, over rows where both are known."""
    rows = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ends = [f(c).alias(f"{c}_{n}") for c in (x, y) for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))]
    out = _agg(rows, keys, F.count(F.lit(1)).alias("n"), *ends, F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    few = F.col("n") < 2
    return out.withColumns({c: F.when(few | F.isnan(c), None).otherwise(F.col(c)) for c in ("r", "slope", "intercept", "r2")})


def timebase(df: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """dt (median of positive steps), rate, jitter (population deviation of the steps over dt)."""
    step = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy("sample_idx"))
    rows = df.withColumn("__dt", step).filter("__dt > 0")
    out = rows.groupBy(*keys).agg(F.percentile("__dt", 0.5).alias("dt"), F.stddev_pop("__dt").alias("__sd"), F.count(F.lit(1)).alias("n"))
    return out.select(*keys, "n", "dt", (1 / F.col("dt")).alias("rate"), (F.col("__sd") / F.col("dt")).alias("jitter"))


def phase_bins(df: DataFrame, keys: Sequence[str], t: str, value: str, period: float, bins: int) -> DataFrame:
    """phase_bin, n, mean, std, rms of value over the phase of t in the period."""
    phase = F.pmod(F.col(t), F.lit(period)) / period
    bin_ = F.least(F.floor(phase * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*keys, bin_.alias("phase_bin")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))


def cycle_periods(extrema: DataFrame, keys: Sequence[str], t: str) -> DataFrame:
    """n, mean and deviation of the time between extrema that follow one another."""
    gap = F.col(t) - F.lag(t).over(Window.partitionBy(*keys).orderBy(t))
    return extrema.withColumn("__gap", gap).groupBy(*keys).agg(F.count("__gap").alias("n"), F.avg("__gap").alias("mean"), F.stddev_pop("__gap").alias("std"))


def event_counts(events: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Counts per label, most frequent first."""
    return events.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n")).orderBy(*keys, F.col("n").desc(), label)


def signals_by_policy(members: DataFrame, session: str, signal: str, policy: str) -> DataFrame:
    """Distinct signals of a set of sessions: union, intersection, or strict (an error unless all sessions agree)."""
    if policy not in ("union", "intersection", "strict"):
        raise ValueError(f"unknown policy {policy!r}")
    rows = members.select(session, signal).distinct()
    per = rows.groupBy(signal).agg(F.count(F.lit(1)).alias("__n"))
    if policy == "union":
        return per.select(signal)
    total = rows.select(session).distinct().agg(F.count(F.lit(1)).alias("__all"))
    per = per.crossJoin(F.broadcast(total))  # one row
    if policy == "intersection":
        return per.filter("__n = __all").select(signal)
    return per.select(F.when(F.col("__n") == F.col("__all"), F.col(signal)).otherwise(F.raise_error(F.lit("sessions differ in their signals"))).alias(signal))


def first_registry(rows: DataFrame, column: str, session: str, info: Sequence[str]) -> DataFrame:
    """Of each column the entry of the first session by key."""
    return rows.groupBy(column).agg(F.min_by(F.struct(*info), session).alias("info")).select(column, "info.*")
