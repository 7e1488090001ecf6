"""From recordings to artifacts: load, canonicalise, preprocess, detect, segment, measure, check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import naming
from ridgeline.operators import series, signal, stats
from ridgeline.operators.blocks import fitting
from ridgeline.plans import contracts, detect
from ridgeline.plans.schema import Schema, parse
from ridgeline.sources import gps
from ridgeline.sources.logger import Session, read_csv, read_recordings

KEYS = ["session_key"]


@dataclass(frozen=True)
class Smoothing:
    cutoff_hz: float
    order: int = 4


@dataclass(frozen=True)
class Profile:
    """Preprocessing settings. Durations are seconds; ranges are full travel by column."""

    normalize_ranges: Mapping[str, float] = field(default_factory=dict)
    zeroing: bool = False
    zero_window_s: float = 0.4
    zero_min_samples: int = 10
    clip: bool = False
    smoothing: Sequence[Smoothing] = ()
    residuals: bool = False
    savgol_window: int = 11
    savgol_order: int = 3
    active_disp: str | None = None
    active_disp_min: float = 20.0
    active_vel_min: float = 50.0
    active_window_s: float = 0.5
    active_padding_s: float = 1.0
    active_min_s: float = 3.0


@dataclass
class Prepared:
    session: Session
    samples: DataFrame
    registry: dict[str, dict]
    rate_hz: float


def canonicalise(session: Session, units: Mapping[str, str] | None = None, domains: Mapping[str, str] | None = None) -> Session:
    names = naming.renamed([c for c in session.samples.columns if c not in (*KEYS, "sample_idx", "time_s")], units, domains)
    return replace(session, samples=session.samples.withColumnsRenamed({a: b for a, b in names.items() if a != b}))


def rate_of(session: Session) -> float:
    """The declared sample rate, else one over the median step."""
    if session.rate_hz:
        return session.rate_hz
    row = stats.timebase(session.samples, KEYS, "time_s").first()
    if row is None:
        raise ValueError("a session needs two samples or a declared rate")
    return row["rate"]


def preprocess(session: Session, profile: Profile) -> Prepared:
    """Zero, normalise, smooth, derive velocity and acceleration, mark activity.

    Each column's zero is an aggregation that joins the samples by session; all
    columns go through the filters, which work on blocks of a session, together.
    """
    rate = rate_of(session)
    df = session.samples
    block = fitting(df)
    reg = naming.registry({c: t for c, t in df.dtypes if c not in KEYS})
    disp = [c for c, i in reg.items() if i["quantity"] == "disp" and not i["op_chain"]]
    t_us = F.round(F.col("time_s") * 1e6).cast("long")
    for c in disp:
        base = c
        if profile.zeroing:
            rows = df.select(*KEYS, "sample_idx", t_us.alias("__t"), F.col(f"`{c}`").alias("__y"))
            zero = series.zero_offset(rows, KEYS, "__y", "__t", profile.zero_window_s, profile.zero_min_samples)
            base = naming.format_(replace(naming.parse(c), ops=("zeroed",)))
            df = df.join(zero, KEYS, "left").withColumn(base, F.col(f"`{c}`") - F.coalesce("offset", F.lit(0.0))).drop("offset")
        if c in profile.normalize_ranges:
            s = naming.parse(base)
            name = naming.format_(replace(s, unit="1", ops=(*s.ops, "norm", *(("clip",) if profile.clip else ()))))
            df = series.normalise(df.withColumn("__x", F.col(f"`{base}`")), "__x", F.lit(0.0), float(profile.normalize_ranges[c]), profile.clip, name).drop("__x")
    soft: dict[str, tuple[str, float, int]] = {}
    rest: dict[str, str] = {}
    for f in profile.smoothing:
        for c in disp:
            name = naming.format_(replace(naming.parse(c), ops=(naming.filter_tag(f.cutoff_hz, f.order),)))
            left = naming.format_(replace(naming.parse(c), ops=("diff",)))
            if name not in (*df.columns, *soft):
                soft[name] = (c, f.cutoff_hz, f.order)
                if profile.residuals and left not in (*df.columns, *rest.values()):
                    rest[name] = left
    if soft:
        df = signal.lowpass_columns(df, KEYS, soft, rate, rest, block)
    slopes: dict[str, tuple[str, int]] = {}
    for c in disp:
        v, a = naming.velocity_name(c), naming.acceleration_name(c)
        if v not in df.columns and a not in df.columns:
            slopes |= {v: (c, 1), a: (c, 2)}
    if slopes:
        df = signal.savgol_columns(df, KEYS, slopes, rate, profile.savgol_window, profile.savgol_order, block)
    active = profile.active_disp if profile.active_disp in df.columns else None
    if active:
        vel = naming.velocity_name(active)
        rows = df.select(*KEYS, "sample_idx", t_us.alias("t_us"), F.col(f"`{active}`").alias("d"), F.col(f"`{vel}`").alias("v"))
        mask = series.activity_mask(rows, KEYS, "d", "v", "t_us", profile.active_disp_min, profile.active_vel_min, profile.active_window_s, profile.active_padding_s, profile.active_min_s)
        df = df.join(mask.select(*KEYS, "sample_idx", F.col("active").alias("active_mask_qc")), [*KEYS, "sample_idx"])
    else:
        df = df.withColumn("active_mask_qc", F.lit(True))
    return Prepared(session, df, naming.registry({c: t for c, t in df.dtypes if c not in (*KEYS, "active_mask_qc")}), rate)


@dataclass
class Result:
    prepared: Prepared
    events: DataFrame
    metrics: DataFrame
    gps: gps.Enriched | None = None


def _finished(prepared: Prepared, schema: Schema, check: bool, inline: bool, enriched: gps.Enriched | None = None) -> Result:
    prepared = replace(prepared, samples=prepared.samples.persist())
    dt = 1 / prepared.rate_hz
    events = detect.detect(prepared.samples, schema, prepared.registry, dt)
    if inline:
        events = detect.with_inline_metrics(prepared.samples, events, schema, prepared.registry, dt)
    events = events.persist()
    metrics = detect.metrics(prepared.samples, events, schema, prepared.registry, dt)
    if check:
        contracts.check_session(prepared.samples)
        contracts.check_events(events)
        contracts.check_metrics(metrics.withColumnRenamed("session_key", "session_id"), events)
    return Result(prepared, events, metrics, enriched)


def run(spark: SparkSession, path: str, schema: str | Schema, profile: Profile | None = None, sidecar_path: str | None = None, check: bool = True, records: DataFrame | None = None, gps_policy: str = "require_binding", bindings: DataFrame | None = None, inline: bool = False) -> Result:
    """One recording through the whole pipeline; schema is YAML text or parsed.

    With GPS records (of ``gps.decode``, or decoded tables) the session's file
    is looked for and its columns join the samples. inline adds the metrics
    measured at detection to the events. Samples and events are persisted: every
    event definition reads the samples several times, and their kernels run
    once. Unpersist them when done.
    """
    session = canonicalise(read_csv(spark, path, sidecar_path=sidecar_path))
    enriched = None
    if records is not None:
        anchors = spark.range(1).select(F.lit(session.session_key).alias("session_key"), session.anchor().alias("anchor"))
        enriched = gps.enrich(session.samples, anchors, records, gps_policy, bindings)
        session = replace(session, samples=enriched.samples)
    prepared = preprocess(session, profile or Profile())
    return _finished(prepared, parse(schema) if isinstance(schema, str) else schema, check, inline, enriched)


def run_many(spark: SparkSession, folders: str | Sequence[str], schema: str | Schema, profile: Profile | None = None, zone: str = "UTC", check: bool = True, records: DataFrame | None = None, gps_policy: str = "require_binding", bindings: DataFrame | None = None, inline: bool = False) -> list[Result]:
    """All recordings of the folders, a result for each sample rate among them.

    Recordings of one rate go through one plan; a session is a key of it.
    """
    schema = parse(schema) if isinstance(schema, str) else schema
    found = read_recordings(spark, folders, zone)
    samples = found.samples.persist()
    enriched = None
    if records is not None:
        enriched = gps.enrich(samples, found.sessions.select("session_key", "anchor"), records, gps_policy, bindings)
    measured = stats.timebase(samples, KEYS, "time_s").select(*KEYS, "rate")
    rates = found.sessions.join(measured, KEYS, "left").select(*KEYS, F.round(F.coalesce("rate_hz", "rate"), 3).alias("rate")).persist()
    out = []
    for (rate,) in rates.filter("rate is not null").select("rate").distinct().orderBy("rate").collect():  # a row a rate
        rows = (enriched.samples if enriched else samples).join(rates.filter(F.col("rate") == rate).select(*KEYS), KEYS, "left_semi")
        prepared = preprocess(canonicalise(Session(rows, "", "", rate)), profile or Profile())
        out.append(_finished(prepared, schema, check, inline, enriched))
    return out
