"""Logger recordings: CSV with an optional JSON sidecar and run statistics in the footer.

A file is one session. Files are read as lines by Spark (many at once); the
driver looks at the different header lines, and at a sidecar, only to learn columns.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ridgeline.functions.scalars import clean_number, clock_seconds, filename_anchor, time_scale
from ridgeline.operators.series import keep_first

#: Time columns in order of preference, and how they count: ms, a guess by size, or a clock (fixed values).
TIME_COLUMNS = (("timestamp_ms", "ms"), ("ts_ms", "ms"), ("time_ms", "ms"), ("time_s", "guess"), ("t", "guess"), ("time", "guess"), ("ts", "guess"), ("timestamp", "clock"))

#: Lines that are taken together within a split of a file, and what tells chunks of lines apart and puts them in order.
CHUNK = 1 << 16
ORDER = ["path", "block", "chunk"]


@dataclass
class Sidecar:
    raw: dict[str, Any]

    @property
    def primary(self) -> dict[str, Any]:
        streams = self.raw["streams"]
        return streams.get("primary") or next(iter(streams.values()))

    @property
    def time_column(self) -> str | None:
        return self.primary.get("time_col")

    @property
    def rate_hz(self) -> float | None:
        rate = self.primary.get("sample_rate_hz")
        return float(rate) if rate else None

    @property
    def session_id(self) -> str | None:
        return (self.raw.get("session") or {}).get("session_id")

    def channels(self) -> list[dict[str, Any]]:
        """A row per signal column: unit, sensor, role, source columns and the rate of its stream."""
        streams = self.raw["streams"]
        return [
            {"column": c, "unit": i.get("unit"), "sensor": i.get("sensor"), "role": i.get("quantity"), "source_columns": i.get("source_columns") or [], "rate_hz": (streams.get(i.get("stream")) or {}).get("sample_rate_hz")}
            for c, i in self.raw["columns"].items()
            if i.get("class") == "signal"
        ]


def read_sidecar(spark: SparkSession, path: str) -> Sidecar | None:
    """The sidecar of a CSV (same stem, .json) or of an explicit path; None where there is none."""
    path = re.sub(r"\.csv$", ".json", path, flags=re.I)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return None
    raw = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    contract = raw.get("contract") or {}
    for what, ok in (("contract name and version", contract.get("name") and contract.get("version")), ("streams", raw.get("streams")), ("columns", raw.get("columns"))):
        if not ok:
            raise ValueError(f"sidecar {path} lacks its {what}")
    return Sidecar(raw)


def _cells(line: str, delimiter: str) -> list[str]:
    return next(csv.reader([line], delimiter=delimiter), [])


def layout(head: str) -> tuple[str, list[str]]:
    """Delimiter (the more frequent of comma and semicolon outside of quotes) and column names of a header line; a name that comes again is numbered."""
    bare = re.sub(r'"[^"]*"', "", head)
    delimiter = "," if bare.count(",") > bare.count(";") else ";"
    names: list[str] = []
    for name in (c.strip() for c in _cells(head, delimiter)):
        again, k = name, 0
        while again in names:
            k += 1
            again = f"{name}.{k}"
        names.append(again)
    return delimiter, names


@dataclass
class Session:
    """Samples (session_key, sample_idx, time_s, signals) and what is known about them."""

    samples: DataFrame
    session_key: str
    source: str
    rate_hz: float | None = None
    channels: list[dict[str, Any]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    sidecar: Sidecar | None = None
    zone: str = "UTC"

    def anchor(self) -> Column:
        """The absolute time of the first sample: of the sidecar in its time zone, else of the file name in the session's."""
        about = (self.sidecar.raw.get("session") or {}) if self.sidecar else {}
        named = filename_anchor(F.lit(re.sub(r"\.[^.]*$", "", self.source.rsplit("/", 1)[-1])), self.zone)
        return F.coalesce(F.to_utc_timestamp(F.try_to_timestamp(F.lit(about.get("started_at_local"))), about.get("timezone") or self.zone), named)


def read_csv(spark: SparkSession, path: str, session_key: str | None = None, sidecar_path: str | None = None, time_columns: Sequence[str] = (), keep_first_sample: bool = False) -> Session:
    """One recording as an ordered sample frame.

    Rows with a missing value in any column are dropped, then equal times,
    then rows that aren't later than the row before; the first sample goes
    too, unless keep_first_sample. Text that can't stand in a number is
    dropped from it.
    """
    sidecar = read_sidecar(spark, sidecar_path or path)
    lines = _lines(spark.read.text(path))
    key = session_key or (sidecar.session_id if sidecar else None) or re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    declared = sidecar.time_column if sidecar else None
    known = _heads(lines).withColumns({"session_key": F.lit(key), "time_col": F.lit(declared).cast("string")}).persist()
    if known.isEmpty():
        raise ValueError(f"{path} has no header")
    samples = _parsed(lines, known, time_columns, keep_first_sample)
    return Session(samples, key, path, sidecar.rate_hz if sidecar else None, sidecar.channels() if sidecar else [], [], sidecar)


def _lines(read: DataFrame) -> DataFrame:
    """path, pos (order in the file) and value of the lines that hold a row or a header; a comment ends a line."""
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    text = F.regexp_replace(F.regexp_replace("value", "\\x00", ""), r'^((?:[^"#]|"[^"]*")*)#.*$', "$1")
    lines = read.select(F.col("_metadata.file_path").alias("path"), pos.alias("pos"), text.alias("value"))
    return lines.filter(F.trim("value") != "")


def _heads(lines: DataFrame) -> DataFrame:
    """path, head (its first line that is no comment) and first (where that stands)."""
    # A split's first line by number, then the file's: no task sorts its lines for it.
    splits = lines.groupBy("path", F.col("pos.block").alias("block")).agg(F.min("pos.n").alias("n"))
    first = splits.groupBy("path").agg(F.min(F.struct("block", "n")).alias("first")).select("path", "first", "first.*")
    at = lines.select("path", "pos.*", F.col("value").alias("head"))
    return first.join(at, ["path", "block", "n"]).select("path", "head", "first")


def _parsed(lines: DataFrame, known: DataFrame, time_columns: Sequence[str], keep_first_sample: bool) -> DataFrame:
    """session_key, sample_idx, time_s and signals of the lines; known has path, head, first, session_key and time_col.

    The plan has one branch a layout, that is header line and declared time column.
    A row with more or fewer cells than the header is dropped.
    """
    out = None
    for head, declared in known.select("head", "time_col").distinct().collect():  # a row a layout
        delimiter, names = layout(head)
        order = [(c, "guess") for c in (*time_columns, *([declared] if declared else []))] + list(TIME_COLUMNS)
        time, how = next(((c, h) for c, h in order if c in names), (None, None))
        if time is None:
            raise ValueError(f"recordings with the columns {names} have no time column")
        mine = known.filter((F.col("head") == head) & F.col("time_col").eqNullSafe(F.lit(declared))).select("path", "session_key", "first")
        rows = lines.join(mine, "path").filter("pos > first")
        fields = ", ".join(f"c{i} string" for i in range(len(names)))
        # A row in quotes as a whole would be one cell; such a row is malformed, as any that has not the header's cells.
        cells = F.from_csv("value", f"{fields}, broken string", {"sep": delimiter, "columnNameOfCorruptRecord": "broken", "mode": "PERMISSIVE"})
        rows = rows.withColumn("c", cells).filter("c.broken is null")
        cell = {n: clean_number(F.col(f"c.c{i}")) for i, n in enumerate(names)}
        if how == "clock":
            t = clock_seconds(F.col(f"c.c{names.index(time)}"))
        else:
            t = cell[time] / 1e3 if how == "ms" else cell[time]
        signals = [n for n in names if n != time]
        rows = rows.select("path", "session_key", "pos.block", (F.col("pos.n") / CHUNK).cast("long").alias("chunk"), "pos.n", t.alias("time_s"), *[cell[n].alias(n) for n in signals]).filter("time_s is not null")
        chunks = rows.groupBy(*ORDER).agg(F.min_by("time_s", "n").alias("zero"), F.max("time_s").alias("most"))
        files = chunks.groupBy("path").agg(F.min_by("zero", F.struct("block", "chunk")).alias("zero"), F.max("most").alias("most"))
        rows = rows.join(chunks.select(*ORDER).join(files, "path"), ORDER)
        if how == "guess":
            rows = rows.withColumns({c: time_scale(F.col(c), F.col("most")) for c in ("time_s", "zero")})
        rows = rows.withColumn("time_s", F.col("time_s") - F.col("zero")).drop("zero", "most").dropna(subset=["time_s", *[f"`{n}`" for n in signals]])
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    if out is None:
        return lines.sparkSession.createDataFrame([], "session_key string, sample_idx long, time_s double")
    out = _later(keep_first(out, ["path"], "time_s", ["block", "n"]), keep_first_sample)
    signals = [c for c in out.columns if c not in (*ORDER, "n", "session_key", "time_s", "sample_idx")]
    return out.select("session_key", "sample_idx", "time_s", *[F.col(f"`{c}`") for c in signals])


def _later(rows: DataFrame, keep_first_sample: bool) -> DataFrame:
    """The rows that are later than the row before, with sample_idx.

    A chunk of a file needs of those before it only the last time and how many
    rows they keep, so a long file is many tasks.
    """
    here, before = Window.partitionBy(*ORDER).orderBy("n"), Window.partitionBy("path").orderBy("block", "chunk")
    rows = rows.withColumn("__step", F.col("time_s") - F.lag("time_s").over(here))
    chunks = rows.groupBy(*ORDER).agg(F.min_by("time_s", "n").alias("first"), F.max_by("time_s", "n").alias("last"), F.count(F.when(F.col("__step") > 0, 1)).alias("__many"))
    begins = F.coalesce(F.col("first") - F.lag("last").over(before) > 0, F.lit(keep_first_sample))
    chunks = chunks.withColumn("__begins", begins).withColumn("__many", F.col("__many") + F.col("__begins").cast("long"))
    earlier = F.coalesce(F.sum("__many").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(chunks.select(*ORDER, "__begins", earlier.alias("__earlier")), ORDER)
    rows = rows.filter(F.coalesce(F.col("__step") > 0, F.col("__begins")))
    return rows.withColumn("sample_idx", F.col("__earlier") + F.row_number().over(here) - 1).drop("__step", "__begins", "__earlier")


@dataclass
class Recordings:
    """Samples of many recordings, and a row per recording: session_key, path, anchor, rate_hz."""

    samples: DataFrame
    sessions: DataFrame


def _sidecars(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """stem, session_id, started, zone, rate, time_col of the sidecars in the recordings' folders."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(paths)
    text = F.col("content").cast("string")
    get = lambda x: F.get_json_object(text, f"$.{x}")
    return files.select(
        _stem(F.col("path")).alias("stem"),
        get("session.session_id").alias("session_id"),
        get("session.started_at_local").alias("started"),
        get("session.timezone").alias("zone"),
        get("streams.primary.sample_rate_hz").cast("double").alias("rate_hz"),
        get("streams.primary.time_col").alias("time_col"),
    )


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*$", "")


def read_recordings(spark: SparkSession, folders: str | Sequence[str], zone: str = "UTC", keep_first_sample: bool = False) -> Recordings:
    """All recordings (CSV) of the folders as one sample frame; the rules of ``read_csv`` hold within each.

    Files are scanned together, whatever their number, and grouped by their
    header line, so that the plan has one branch a layout. A recording's
    session_key is its sidecar's session_id, else its file name, or the whole
    path where several recordings would share that; its anchor is
    the time of its first sample in UTC: started_at_local of the sidecar in its
    time zone, else the name's beginning in zone.
    """
    lines = _lines(spark.read.option("pathGlobFilter", "*.[cC][sS][vV]").option("recursiveFileLookup", True).text(folders))
    side = _sidecars(spark, folders)
    name = F.element_at(F.split(_stem(F.col("path")), "/"), -1)
    known = _heads(lines).join(side, _stem(F.col("path")) == F.col("stem"), "left")
    started = F.coalesce(F.to_utc_timestamp(F.try_to_timestamp("started"), F.coalesce("zone", F.lit(zone))), filename_anchor(name, zone))
    known = known.withColumns({"session_key": F.coalesce("session_id", name), "anchor": started})
    known = known.withColumn("session_key", F.when(F.count(F.lit(1)).over(Window.partitionBy("session_key")) > 1, _stem(F.col("path"))).otherwise(F.col("session_key"))).persist()  # a row a file
    return Recordings(_parsed(lines, known, (), keep_first_sample), known.select("session_key", "path", "anchor", "rate_hz"))


def run_statistics(spark: SparkSession, paths: str) -> DataFrame:
    """path, key, value of the ``# key=value`` lines between the run_stats marks of each file."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"), "value").filter("value like '#%'")
    w = Window.partitionBy("path").orderBy("n")
    mark = F.when(F.col("value").rlike(r"^#\s*run_stats_begin"), 1).when(F.col("value").rlike(r"^#\s*run_stats_end"), -1).otherwise(0)
    inside = lines.withColumn("open", F.sum(mark).over(w)).filter((F.col("open") > 0) & F.col("value").contains("="))
    part = lambda i: F.trim(F.regexp_extract("value", r"^#\s*([^=]+)=(.*)$", i))
    return inside.select("path", part(1).alias("key"), part(2).alias("value"))


def write_csv(samples: DataFrame, path: str, columns: Sequence[str], statistics: DataFrame | None = None, key: str = "session_key", order: str = "sample_idx") -> None:
    """A file a session under path/key=session: header, rows in order with fixed six decimals, and the statistics of the run as a footer.

    statistics has the key, and key-value pairs in columns name and value; without
    it the footer says how many rows were written. A session is written as a
    stream by one task; sessions are dealt to tasks.
    """
    kinds = dict(samples.dtypes)
    quoted = ",".join(f'"{c}"' if re.search(r'[",#]', c) else c for c in columns)
    cells = [F.format_string("%.6f", F.col(f"`{c}`")) if kinds[c] in ("double", "float") else F.col(f"`{c}`").cast("string") for c in columns]
    row = F.concat_ws(",", *[F.coalesce(c, F.lit("")) for c in cells])
    rows = samples.select(key, F.lit(1).alias("part"), F.col(order).cast("long").alias("turn"), row.alias("value"))
    sessions = samples.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    if statistics is None:
        statistics = sessions.select(key, F.lit("rows_written").alias("name"), F.col("n").cast("string").alias("value"))
    foot = statistics.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("name", "value"))).alias("pairs"))
    pairs = F.transform("pairs", lambda x: F.concat(F.lit("# "), x["name"], F.lit("="), x["value"]))
    feet = foot.select(key, F.posexplode(F.concat(F.array(F.lit("# run_stats_begin")), pairs, F.array(F.lit("# run_stats_end")))).alias("turn", "value"))
    heads = sessions.select(key, F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit(quoted).alias("value"))
    out = heads.unionByName(rows).unionByName(feet.select(key, F.lit(2).alias("part"), F.col("turn").cast("long").alias("turn"), "value"))
    out = out.repartition(key).sortWithinPartitions(key, "part", "turn").drop("part", "turn")
    out.write.partitionBy(key).mode("errorifexists").text(path)


def typed(values: Mapping[str, str]) -> dict[str, Any]:
    """Statistics as int, float or text."""
    out: dict[str, Any] = {}
    for k, v in values.items():
        for kind in (int, float, str):
            try:
                out[k] = kind(v)
                break
            except ValueError:
                continue
    return out
