"""Calibration files of sensors: ``<folder>/<sensor>/*.poly.json``, ``.poly.cfg``, ``.poly.txt``, ``.poly``, ``.lut.csv``."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession

from ridgeline.functions.scalars import lookup, polynomial


@dataclass(frozen=True)
class Transform:
    """kind poly holds coefficients from the constant up; kind lut holds (x, y) nodes by x."""

    id: str
    sensor: str
    kind: str
    values: tuple

    def apply(self, x: Column) -> Column:
        return polynomial(x, self.values) if self.kind == "poly" else lookup(x, list(self.values))


def parse(path: str, text: str) -> Transform:
    sensor, name = path.rstrip("/").split("/")[-2:]
    stem = name.split(".", 1)[0]
    if name.endswith(".poly.json"):
        raw = json.loads(text)
        if not raw.get("id"):
            raise ValueError(f"{path} has no id")
        return Transform(raw["id"], sensor, "poly", tuple(float(c) for c in raw["coeffs"]))
    if name.endswith(".lut.csv"):
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        meta = dict(re.findall(r"#\s*(\w+)\s*[=:]\s*(\S+)", "\n".join(x for x in lines if x.startswith("#"))))
        if "id" not in meta:
            raise ValueError(f"{path} has no id")
        pairs = [re.split(r"[,;]", x)[:2] for x in lines if re.match(r"[-+.\d]", x)]
        nodes = tuple(sorted((float(a), float(b)) for a, b in pairs))
        if len(nodes) < 2:
            raise ValueError(f"{path} needs two nodes")
        return Transform(meta["id"], sensor, "lut", nodes)
    given = dict(re.findall(r"^\s*(\w+)\s*=\s*(.+?)\s*$", text, re.M))
    numbers = given.get("coeffs", text if not given else "")
    if not numbers and given:
        numbers = " ".join(given[k] for k in sorted((k for k in given if re.fullmatch(r"[ac]\d+", k)), key=lambda k: int(k[1:])))
    values = tuple(float(x) for x in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", numbers))
    return Transform(given.get("id", stem), sensor, "poly", values)


def read(spark: SparkSession, folder: str) -> list[Transform]:
    """All transforms of all sensors, by path; these are settings, a few small files."""
    files = spark.read.text(f"{folder}/*/*", wholetext=True).selectExpr("_metadata.file_path as path", "value")
    found = files.filter(r"path rlike '\\.(poly(\\.json|\\.cfg|\\.txt)?|lut\\.csv)$'").orderBy("path").collect()
    return [parse(r["path"], r["value"]) for r in found]
