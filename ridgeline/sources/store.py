"""Artifacts as partitioned Parquet: runs, sessions, events and metrics, with JSON manifests.

Data tables are partitioned by run_id, session_id (and schema_id), so listings
are partition listings and every consumer reads with pruning. Manifests are
small JSON documents, read with ``spark.read.json``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, NullType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Types of one line hold every value of those before; long beside float goes to double.
_NUMBERS = (ByteType(), ShortType(), IntegerType(), LongType(), FloatType(), DoubleType())


def widest(a: DataType, b: DataType) -> DataType:
    """The narrowest type that both can be cast to without loss of meaning: a lattice from no type up to text.

    Whole numbers widen; whole and fractional ones meet in double, decimals with
    decimals in a decimal that holds both; dates and times in a time; arrays
    and structs field by field; anything else in text.
    """
    if isinstance(a, NullType) or a == b:
        return b
    if isinstance(b, NullType):
        return a
    if a in _NUMBERS and b in _NUMBERS:
        low, high = sorted((a, b), key=_NUMBERS.index)
        return DoubleType() if isinstance(high, FloatType) and isinstance(low, IntegerType | LongType) else high
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        return DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if isinstance(a, DecimalType) and b in _NUMBERS or isinstance(b, DecimalType) and a in _NUMBERS:
        return DoubleType()
    times = (DateType, TimestampNTZType, TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return a if times.index(type(a)) > times.index(type(b)) else b
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(widest(a.elementType, b.elementType))
    if isinstance(a, StructType) and isinstance(b, StructType):
        names = dict.fromkeys([*a.names, *b.names])
        of = lambda t, n: t[n].dataType if n in t.names else NullType()
        return StructType([StructField(n, widest(of(a, n), of(b, n))) for n in names])
    return StringType()


def _as(x: Column, a: DataType, b: DataType) -> Column:
    """x of type a as the wider type b; fields that a struct lacks are null."""
    if isinstance(a, StructType) and isinstance(b, StructType):
        fields = [(_as(x[f.name], a[f.name].dataType, f.dataType) if f.name in a.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in b]
        return F.when(x.isNotNull(), F.struct(*fields))
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return F.transform(x, lambda e: _as(e, a.elementType, b.elementType))
    return x.cast(_typed(b))


def _typed(t: DataType) -> DataType:
    """t with text for what has no type anywhere."""
    if isinstance(t, ArrayType):
        return ArrayType(_typed(t.elementType))
    if isinstance(t, StructType):
        return StructType([StructField(f.name, _typed(f.dataType)) for f in t])
    return StringType() if isinstance(t, NullType) else t


def folder_name(schema_id: str | None) -> str:
    """An id as a folder: letters, digits, hyphen and underscore stay."""
    return re.sub(r"[^\w-]", "_", schema_id) if schema_id else "null"


def unknown_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The files whose sha256 isn't among those known."""
    return files.join(known.select("sha256"), "sha256", "left_anti")


class ArtifactStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def check_new(self, run_id: str, session_id: str | None = None, force: bool = False, tables: Sequence[str] = ("samples", "events", "metrics")) -> None:
        """An error if a table holds the run (or its session) already, unless force."""
        held = [t for t in tables if self._exists(f"{self.path(t)}/run_id={run_id}" + (f"/session_id={session_id}" if session_id else ""))]
        if held and not force:
            raise FileExistsError(f"run {run_id!r}{f', session {session_id!r}' if session_id else ''} exists in {held}")

    def freeze_schema(self, run_id: str, session_id: str, text: str) -> None:
        """The event schema's YAML beside the events it found, replaced as a whole."""
        out = self.spark.createDataFrame([(text,)], "value string").coalesce(1)
        out.write.mode("overwrite").text(f"{self.path('schemas')}/run_id={run_id}/session_id={session_id}")

    def frozen_schema(self, run_id: str, session_id: str) -> str:
        return self.spark.read.text(f"{self.path('schemas')}/run_id={run_id}/session_id={session_id}", wholetext=True).first()[0].removesuffix("\n")

    def keep_source(self, path: str, run_id: str, session_id: str, name: str | None = None) -> str:
        """Copies a raw or auxiliary file into the store, with its SHA-256 beside it; returns the hash."""
        source, fs = self._fs(path)
        target, to = self._fs(f"{self.path('sources')}/run_id={run_id}/session_id={session_id}/{name or source.getName()}")
        self.spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, source, to, target, False, True, self.spark._jsc.hadoopConfiguration())
        sha = self.hashes(target.toString()).first()["sha256"]
        mark = to.create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{target.toString()}.sha256"), True)
        mark.write(bytearray(f"{sha}\n".encode()))
        mark.close()
        return sha

    def write(self, df: DataFrame, table: str, run_id: str, session_id: str, force: bool = False) -> None:
        """One session's rows; an existing session is an error unless force."""
        out = f"{self.path(table)}/run_id={run_id}/session_id={session_id}"
        parts = []
        rows = df.drop("run_id", "session_id")
        if table in ("events", "metrics") and "schema_id" in df.columns:
            folder = F.coalesce(F.regexp_replace("schema_id", r"[^\p{L}\p{N}_-]", "_"), F.lit("null"))
            rows, parts = rows.withColumn("schema_folder", folder), ["schema_folder"]
        names = {c: c for c in rows.columns}
        (rows.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]).write.option("compression", "zstd").mode("overwrite" if force else "errorifexists").partitionBy(*parts).parquet(out))

    def read(self, table: str, columns: Sequence[str] | None = None) -> DataFrame:
        """All sessions of a table, with run_id, session_id and session_key; columns that differ are merged.

        Files are grouped by the schema of their sessions' folder: one scan a
        schema, each cast to the widest type of the column (``widest``). Columns
        without any value, of no type, take the type they have elsewhere, or text.
        """
        groups = self._by_schema(table)
        merged: dict[str, DataType] = {}
        for schema in groups:
            for f in schema:
                merged[f.name] = widest(merged.get(f.name, NullType()), f.dataType)
        out = None
        for schema, paths in groups.items():
            one = self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*paths)
            one = one.select(*[F.col(c).cast("string") for c in ("run_id", "session_id")], *[_as(F.col(f"`{c}`"), schema[c].dataType, _typed(merged[c])).alias(c) for c in schema.names])
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise FileNotFoundError(f"table {table!r} holds no session")
        out = out.withColumn("session_key", F.concat_ws("::", "run_id", "session_id"))
        return out.select("session_key", *[F.col(f"`{c}`") for c in columns]) if columns else out

    def _by_schema(self, table: str) -> dict[StructType, list[str]]:
        """The sessions' folders by the schema that their files were written with; a folder is written at once."""
        root, fs = self._fs(self.path(table))
        folders = [f.getPath() for run in fs.listStatus(root) if run.isDirectory() and run.getPath().getName().startswith("run_id=") for f in fs.listStatus(run.getPath()) if f.isDirectory()] if fs.exists(root) else []
        out: dict[str, tuple[StructType, list[str]]] = {}
        for path in folders:
            schema = self.spark.read.parquet(path.toString()).schema
            plain = StructType([f for f in schema if f.name not in ("run_id", "session_id")])
            out.setdefault(plain.json(), (plain, []))[1].append(path.toString())
        return {s: p for s, p in out.values()}

    def read_selected(self, table: str, members: DataFrame) -> DataFrame:
        """Rows of the sessions in members (session_key, and entity columns if any): a session in two entities comes twice."""
        return self.read(table).join(members, "session_key")

    def sessions(self, table: str = "samples") -> DataFrame:
        """run_id, session_id: newest run first."""
        return self.read(table).select("run_id", "session_id").distinct().orderBy(F.col("run_id").desc(), "session_id")

    def event_types(self, table: str = "events") -> DataFrame:
        return self.read(table).select("run_id", "session_id", "schema_id").distinct()

    def write_manifest(self, run_id: str, session_id: str | None, document: Mapping) -> None:
        """Key-sorted JSON, replaced as a whole."""
        name = f"{run_id}__{session_id}" if session_id else run_id
        text = json.dumps({**document, "run_id": run_id, "session_id": session_id}, sort_keys=True)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path('manifests')}/{name}")

    def manifests(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", True).json(self.path("manifests"))

    def describe(self, run_id: str, session_id: str | None, description: str) -> None:
        """Sets a manifest's description and keeps the rest."""
        same = F.col("session_id").eqNullSafe(F.lit(session_id)) if session_id else F.lit(True)
        found = self.spark.read.option("recursiveFileLookup", True).text(self.path("manifests"))
        found = found.withColumn("session_id", F.get_json_object("value", "$.session_id")).filter((F.get_json_object("value", "$.run_id") == run_id) & same & (F.lit(session_id is not None) | F.col("session_id").isNull())).limit(1).collect()
        self.write_manifest(run_id, session_id, {**(json.loads(found[0]["value"]) if found else {}), "description": description})

    def hashes(self, paths: str) -> DataFrame:
        """path, sha256 of raw files."""
        files = self.spark.read.format("binaryFile").load(paths)
        return files.select("path", F.sha2("content", 256).alias("sha256"))

    def unprocessed(self, paths: str) -> DataFrame:
        """Raw files whose hash no manifest names."""
        new = self.hashes(paths)
        if not self._exists(self.path("manifests")):
            return new
        text = self.spark.read.option("recursiveFileLookup", True).text(self.path("manifests"))
        return unknown_files(new, text.select(F.get_json_object("value", "$.source.sha256").alias("sha256")))
