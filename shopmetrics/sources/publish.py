"""All-or-nothing publishing of a set of reports.

A run writes every report into a folder of its own. Only when all are there, its manifest (reports, paths, parameters) is written
and moved into the ``published`` folder under a name that sorts by time; one rename makes the whole set visible. Readers
take the newest manifest, so a run that dies half-way leaves the set before it as it was.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


def parameters_key(parameters: Mapping) -> str:
    """A short name of a parameter set, whatever its length: lists of excluded ids do not fit a path."""
    return hashlib.sha256(_as_json(parameters).encode()).hexdigest()[:16]


def _as_json(value) -> str:
    plain = lambda v: v.isoformat() if isinstance(v, (dt.date, dt.datetime)) else str(v)
    return json.dumps(value, sort_keys=True, ensure_ascii=False, default=plain)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, base: str, parameters: Mapping, write: Callable[[str], Mapping[str, str]]) -> dict:
    """Run ``write(folder) -> {report: path}`` in a new folder under ``base`` and publish what it returns; the manifest."""
    run = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    folder = os.path.join(base, "runs", run)
    manifest = {"run": run, "parameters": dict(parameters), "reports": dict(write(folder))}
    manifest = json.loads(_as_json(manifest))
    fs, staged = _fs(spark, os.path.join(folder, "_manifest.json"))
    out = fs.create(staged, False)
    try:
        out.write(bytearray(_as_json(manifest).encode()))
    finally:
        out.close()
    _, shelf = _fs(spark, os.path.join(base, "published"))
    fs.mkdirs(shelf)
    if not fs.rename(staged, spark._jvm.org.apache.hadoop.fs.Path(shelf, f"{run}.json")):
        raise RuntimeError(f"could not publish {run} under {base}")
    return manifest


def published(spark: SparkSession, base: str, back: int = 0) -> dict | None:
    """The newest published manifest under ``base`` (``back`` = 1: the one before it); None if there is none."""
    fs, shelf = _fs(spark, os.path.join(base, "published"))
    if not fs.exists(shelf):
        return None
    names = sorted(s.getPath().toString() for s in fs.listStatus(shelf) if s.getPath().getName().endswith(".json"))
    if len(names) <= back:
        return None
    return json.loads(spark.read.text(names[-1 - back], wholetext=True).first()[0])


def read_published(spark: SparkSession, base: str, report: str, fmt: str = "parquet") -> DataFrame:
    """A report of the newest published set."""
    manifest = published(spark, base)
    if manifest is None or report not in manifest["reports"]:
        raise ValueError(f"no report {report!r} is published under {base}")
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"') if fmt == "csv" else spark.read
    return reader.format(fmt).load(manifest["reports"][report])


def drop_old_runs(spark: SparkSession, base: str, keep: int = 2) -> list[str]:
    """Delete published runs but the newest ``keep`` with their manifests; the names of those deleted."""
    fs, shelf = _fs(spark, os.path.join(base, "published"))
    names = sorted(s.getPath().getName() for s in fs.listStatus(shelf)) if fs.exists(shelf) else []
    old = [n.removesuffix(".json") for n in names[: max(0, len(names) - keep)]]
    for run in old:  # the manifest first, so no reader finds a set that is half gone
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(shelf, f"{run}.json"), False)
        fs.delete(_fs(spark, os.path.join(base, "runs", run))[1], True)
    return old
