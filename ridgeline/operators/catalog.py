"""Sessions, aggregations (saved sets of sessions), notes and bookmarks as small joined tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def expand_entities(selected: DataFrame, aggregations: DataFrame) -> DataFrame:
    """entity_key, entity_kind, session_key, from selected (entity_key, entity_kind) and aggregations (entity_key, session_key).

    A session chosen on its own is no longer a member of chosen aggregations;
    a session in two aggregations stays in both.
    """
    own = selected.filter("entity_kind = 'session'").select("entity_key", "entity_kind", F.col("entity_key").alias("session_key"))
    members = selected.filter("entity_kind = 'aggregation'").join(aggregations, "entity_key").join(own.select("session_key"), "session_key", "left_anti")
    return own.unionByName(members.select("entity_key", "entity_kind", "session_key")).distinct()


def aggregation_catalog(aggregations: DataFrame, sessions: DataFrame) -> DataFrame:
    """entity_key, title, n_members, n_valid (members that exist)."""
    valid = sessions.select("session_key").distinct().withColumn("__ok", F.lit(1))
    return aggregations.join(valid, "session_key", "left").groupBy("entity_key", "title").agg(F.count(F.lit(1)).alias("n_members"), F.count("__ok").alias("n_valid"))


def session_catalog(sessions: DataFrame, notes: DataFrame, templates: DataFrame) -> DataFrame:
    """sessions with their note and its status: missing_note, template_missing, mismatch (made with another version) or ok."""
    latest = templates.groupBy("template_id").agg(F.max("version").alias("latest_version"))
    out = sessions.join(notes, "session_key", "left").join(latest, "template_id", "left")
    status = F.when(F.col("template_id").isNull(), "missing_note").when(F.col("latest_version").isNull(), "template_missing").when(F.col("template_version") != F.col("latest_version"), "mismatch").otherwise("ok")
    return out.withColumn("note_status", status)


def schema_policy(sessions: DataFrame, policy: str) -> DataFrame:
    """schema_id of (session_key, schema_id, schema_hash) by union, intersection, or strict (same hash in every session)."""
    total = sessions.select("session_key").distinct().count()
    per = sessions.groupBy("schema_id").agg(F.count_distinct("session_key").alias("n"), F.count_distinct("schema_hash").alias("hashes"))
    if policy == "union":
        return per.select("schema_id")
    if policy == "intersection":
        return per.filter(F.col("n") == total).select("schema_id")
    if policy == "strict":
        return per.select(F.when((F.col("n") == total) & (F.col("hashes") == 1), F.col("schema_id")).otherwise(F.raise_error(F.lit("sessions differ in their event schemas"))).alias("schema_id"))
    raise ValueError(f"unknown policy {policy!r}")


def bootstrap(canonical: DataFrame, local: DataFrame, sessions: DataFrame) -> DataFrame:
    """canonical, or if it is empty the local aggregations (entity_key, session_key) whose members all exist."""
    if not canonical.isEmpty():
        return canonical
    broken = local.join(sessions.select("session_key"), "session_key", "left_anti").select("entity_key").distinct()
    return local.join(broken, "entity_key", "left_anti")


def with_sensor(events: DataFrame, schema_sensors: DataFrame, registry: DataFrame) -> DataFrame:
    """events plus sensor: from (schema_id, signal, sensor), else from (session_key, signal, sensor), else empty."""
    a = schema_sensors.withColumnRenamed("sensor", "__a")
    b = registry.withColumnRenamed("sensor", "__b")
    return events.join(a, ["schema_id", "signal"], "left").join(b, ["session_key", "signal"], "left").withColumn("sensor", F.coalesce("__a", "__b", F.lit(""))).drop("__a", "__b")


def series_grid(rows: DataFrame, entities: Sequence[str], sensors: Sequence[str], x: str, y: str) -> DataFrame:
    """entity_key, sensor and the (x, y) points of each pair, pairs without points included."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([(e, s) for e in entities for s in sensors], "entity_key string, sensor string")
    points = rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy("entity_key", "sensor").agg(F.collect_list(F.struct(x, y)).alias("points"))
    return F.broadcast(grid).join(points, ["entity_key", "sensor"], "left")


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """table with rows in place of those that share their keys: saved bookmarks, notes, scopes."""
    return table.join(rows.select(*keys).distinct(), list(keys), "left_anti").unionByName(rows, allowMissingColumns=True)


def restore_view(bookmarks: DataFrame, signals: Sequence[str], event_types: Sequence[str]) -> DataFrame:
    """bookmarks whose signals and event types are cut to those that still exist."""
    keep = lambda c, have: F.array_intersect(c, F.array(*[F.lit(x) for x in have]).cast("array<string>"))
    return bookmarks.withColumns({"signals": keep("signals", signals), "event_types": keep("event_types", event_types)})


def drift(bookmarks: DataFrame, samples: DataFrame, tolerance_s: float = 1e-6) -> DataFrame:
    """bookmarks (session_key, n_rows, t_min, t_max) with drifted: the session no longer has that many rows or that range."""
    now = samples.groupBy("session_key").agg(F.count(F.lit(1)).alias("__n"), F.min("time_s").alias("__a"), F.max("time_s").alias("__b"))
    out = bookmarks.join(now, "session_key", "left")
    same = (F.col("__n") == F.col("n_rows")) & (F.abs(F.col("__a") - F.col("t_min")) <= tolerance_s) & (F.abs(F.col("__b") - F.col("t_max")) <= tolerance_s)
    return out.withColumn("drifted", ~F.coalesce(same, F.lit(False))).drop("__n", "__a", "__b")


def nth_event(events: DataFrame, event_id: str, n: int) -> DataFrame:
    """The nth (from 0) event of an id in each session."""
    turn = F.row_number().over(Window.partitionBy("session_key").orderBy("trigger_time_s")) - 1
    return events.filter(F.col("schema_id") == event_id).withColumn("__n", turn).filter(F.col("__n") == n).drop("__n")


def event_labels(events: DataFrame) -> DataFrame:
    """events with a label, by session and time."""
    label = F.format_string("%s | %s @ %.3fs", F.col("session_id"), F.col("event_id"), F.col("trigger_time_s"))
    return events.withColumn("label", label).orderBy("session_id", "trigger_time_s")


def project_notes(notes: DataFrame, fields: Sequence[tuple[str, str, object]]) -> DataFrame:
    """session_key and ``note.<id>`` for each (id, type, default) of a template, from a JSON column ``values``.

    A field that the note lacks takes the default; one that doesn't parse as its type is null.
    """
    out = []
    for name, kind, default in fields:
        raw = F.get_json_object("values", f"$.{name}")
        value = raw.try_cast(kind)
        out.append(F.when(raw.isNull(), F.lit(default).cast(kind)).otherwise(value).alias(f"note.{name}"))
    return notes.select("session_key", *out)
