"""Table readers.

CSV inputs are always read with an explicit schema (no inference, T2):
inference scans the data twice and turns float-typed ids into doubles. The
schema is matched to the header by name.
Object-store credentials come from the Hadoop configuration of the
session (``fs.s3a.*``), never from code.
"""

from __future__ import annotations

import os
import re
import time
import weakref
from collections.abc import Iterable, Mapping
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


# Opened tables per session and path, with the time they were opened. Only
# the file listing and schema are kept (no rows). Off unless a caller asks for
# it: a table is re-listed once it is older than the ``ttl`` given.
# Keyed by the session object itself (weakly), so a later session never
# receives a DataFrame of a stopped one.
TABLE_TTL_SECONDS = 0.0
_opened: "weakref.WeakKeyDictionary[SparkSession, dict[str, tuple[float, DataFrame]]]" = weakref.WeakKeyDictionary()


def read_table(spark: SparkSession, base_dir: str, name: str, ttl: float | None = None) -> DataFrame:
    """Parquet table ``<base_dir>/<name>.parquet``.

    Re-opening the same path in the same session within ``ttl`` seconds
    reuses the listing; ``ttl=0`` always lists again.
    """
    path = os.path.join(base_dir, f"{name}.parquet")
    ttl = TABLE_TTL_SECONDS if ttl is None else ttl
    per_session = _opened.setdefault(spark, {})
    now = time.monotonic()
    hit = per_session.get(path)
    if hit is not None and now - hit[0] < ttl:
        return hit[1]
    df = _open_parquet(spark, path)
    per_session[path] = (now, df)
    return df


# The schema of a single Parquet file, with the file's size and time of writing: reading a footer costs a job, so an
# unchanged file is opened by the schema found before. Its listing is always new.
_schemas: "weakref.WeakKeyDictionary[SparkSession, dict[str, tuple[tuple, T.StructType]]]" = weakref.WeakKeyDictionary()


def _open_parquet(spark: SparkSession, path: str) -> DataFrame:
    stamp = _stamp(spark, path)
    known = _schemas.setdefault(spark, {})
    if stamp is not None and path in known and known[path][0] == stamp:
        return spark.read.schema(known[path][1]).parquet(path)
    df = spark.read.parquet(path)
    if stamp is not None:
        known[path] = (stamp, df.schema)
    return df


def _stamp(spark: SparkSession, path: str) -> tuple | None:
    """Size and time of writing of a single file; None for folders, whose parts can change unseen."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        status = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at)
        return None if status.isDirectory() or not status.getModificationTime() else (status.getLen(), status.getModificationTime())
    except Exception:  # noqa: BLE001 - no such file (the reader names it), or a session without a JVM at hand
        return None


def forget_tables() -> None:
    """Drop every remembered listing and schema."""
    _opened.clear()
    _schemas.clear()


def header_catalogue(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8") -> list[tuple[list[str], bool]]:
    """The files under ``path`` by their own first line, and by whether a quoted cell of theirs holds a line break.

    One narrow pass over the lines: a line with an odd number of quotes begins or ends inside a cell. A row for each
    file is combined per task; the driver gets the groups, as it lists the files anyway.
    """
    lines = spark.read.option("encoding", encoding).text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1
    files = lines.groupBy("file").agg(F.min_by("value", F.when(F.col("start") == 0, F.col("at"))).alias("header"), F.max(odd).alias("breaks"))
    groups = files.groupBy("header", "breaks").agg(F.sort_array(F.collect_list("file")).alias("files"))
    return [([_as_path(f) for f in r.files], r.breaks) for r in groups.orderBy("files").collect()]


def _as_path(uri: str) -> str:
    """A path to open from a file's URI: decoded, and what would read as a pattern escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(uri))


def _text_groups(spark: SparkSession, path: str | list[str], sep: str, encoding: str, multi_line: bool | None, position: str | None) -> list[DataFrame]:
    """All cells as text, a frame for each header found."""
    frames = []
    for files, breaks in header_catalogue(spark, path, encoding):
        reader = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).option("encoding", encoding)
        reader = reader.option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
        text = reader.option("multiLine", breaks if multi_line is None else multi_line).csv(files)
        if text.columns and text.columns[0].startswith("\ufeff"):
            text = text.withColumnRenamed(text.columns[0], text.columns[0].lstrip("\ufeff"))
        frames.append(text.select("*", file_position().alias(position)) if position else text)
    return frames


def file_position():
    """Where a row of a file source stands: file, begin of its split, place in the split; orders rows as the files list them."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("place"))


def read_csv_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    sep: str = ",",
    encoding: str = "UTF-8",
    timestamp_format: str | None = None,
    multi_line: bool | None = None,
    round_decimals: bool = False,
    position: str | None = None,
) -> DataFrame:
    """Comma-separated text with a header row, typed by ``schema``.

    Columns are found by their names in each file's own header, in any order; others are
    ignored, a missing one raises. Quotes are doubled inside quoted cells.
    Cells are read as text and cast strictly: a cell that is not of its
    column's type fails the job instead of becoming NULL, and a number must fit its
    column without rounding (a count may be written as ``1.0``); with ``round_decimals``, a DECIMAL column takes
    any number, rounded half-even to its scale. A quoted cell may hold line breaks: files that have such cells
    are found, and each of them is one split; ``multi_line`` sets this for all files instead. ``position`` names a column for
    each row's place in the files (``file_position``). Works for local paths and object-store URIs (``s3a://bucket/key``).
    """
    text = _texts(spark, path, schema, sep, encoding, multi_line, position)
    return text.select(*[_strict(f, timestamp_format, round_decimals) for f in schema.fields], *([position] if position else []))


def read_csv_with_misfits(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType,
    keys: tuple[str, ...] = (),
    sep: str = ",",
    encoding: str = "UTF-8",
    timestamp_format: str | None = None,
    round_decimals: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """``read_csv_table`` in two outputs: the rows of which every cell fits, and the cells that do not.

    The second has ``keys`` as text, ``column``, ``value``, ``reason`` and ``row`` (all cells as JSON), a row for each cell.
    A row with a misfit is in the second output only, so a report over the first misses it as a whole.
    """
    text = _texts(spark, path, schema, sep, encoding, None, None)
    parsed = {f.name: _parsed(f, timestamp_format, round_decimals) for f in schema.fields}
    bad = F.array_compact(F.array(*[
        F.when(~ok, F.struct(F.lit(f.name).alias("column"), F.col(f"`{f.name}`").alias("value"), F.lit(f"not {f.dataType.simpleString()}").alias("reason")))
        for f in schema.fields for _, ok in [parsed[f.name]]
    ]))
    good = text.filter(F.size(bad) == 0).select(*[value.alias(name) for name, (value, _) in parsed.items()])
    row = F.to_json(F.struct(*[F.col(f"`{f.name}`") for f in schema.fields]))
    cells = text.filter(F.size(bad) > 0).select(*[F.col(f"`{k}`") for k in keys], F.explode(bad).alias("cell"), row.alias("row"))
    return good, cells.select(*[F.col(f"`{k}`") for k in keys], "cell.column", "cell.value", "cell.reason", "row")


def _texts(spark: SparkSession, path, schema: T.StructType, sep: str, encoding: str, multi_line: bool | None, position: str | None) -> DataFrame:
    """The schema's columns as text, over files of any column order."""
    frames = _text_groups(spark, path, sep, encoding, multi_line, position)
    for text in frames or [None]:
        missing = [f.name for f in schema.fields if text is None or f.name not in text.columns]
        if missing:
            raise ValueError(f"{path} lacks column(s): {', '.join(missing)}")
    return reduce(lambda a, b: a.unionByName(b), [t.select(*[f"`{f.name}`" for f in schema.fields], *([position] if position else [])) for t in frames])


def _parsed(field: T.StructField, timestamp_format: str | None, round_decimals: bool):
    """(value, fits) of a text cell as the field's type; a cell that does not fit has fits = false."""
    col, kind = F.col(f"`{field.name}`"), field.dataType
    if isinstance(kind, T.StringType):
        return col, F.lit(True)
    if isinstance(kind, (T.LongType, T.IntegerType, T.ShortType, T.DecimalType)):
        wide = col.try_cast("decimal(38,18)")
        if round_decimals and isinstance(kind, T.DecimalType):
            value = F.bround(wide, kind.scale).try_cast(kind)
            return value, col.isNull() | value.isNotNull()
        value = wide.try_cast(kind)
        return value, col.isNull() | F.coalesce(value.cast("decimal(38,18)") == wide, F.lit(False))
    if isinstance(kind, T.TimestampNTZType) and timestamp_format:
        value = F.try_to_timestamp(col, F.lit(timestamp_format)).cast("timestamp_ntz")
    else:
        value = col.try_cast(kind)
    return value, col.isNull() | value.isNotNull()


def _strict(field: T.StructField, timestamp_format: str | None, round_decimals: bool):
    """A text column as the field's type; a cell that does not fit fails the job."""
    value, fits = _parsed(field, timestamp_format, round_decimals)
    wrong = F.raise_error(F.concat(F.lit(f"{field.name}: does not fit {field.dataType.simpleString()}: "), F.col(f"`{field.name}`")))
    return F.when(fits, value).otherwise(wrong.cast(field.dataType)).alias(field.name)


def table_name(path: str) -> str:
    """Table name of a file: its base name up to the first dot (S3)."""
    return os.path.basename(path.rstrip("/")).split(".")[0]


def load_tables(
    spark: SparkSession,
    manifest: Mapping[str, T.StructType] | Iterable[tuple[str, T.StructType]],
    register_views: bool = True,
    fmt: str | None = None,
) -> dict[str, DataFrame]:
    """Read every ``path → schema`` of a manifest into ``{name: DataFrame}`` (S3).

    The format is ``fmt`` when given, else CSV for ``*.csv`` paths and
    Parquet otherwise. CSV needs a schema (no inference); Parquet takes its
    own unless one is given. Each table is also registered as a temporary
    view under its name so the reports can be written in SQL against the
    same names.
    """
    items = manifest.items() if isinstance(manifest, Mapping) else manifest
    out: dict[str, DataFrame] = {}
    for path, schema in items:
        kind = fmt or ("csv" if path.rstrip("/").lower().endswith(".csv") else "parquet")
        if kind == "csv":
            if schema is None:
                raise ValueError(f"a schema is required for CSV input {path}")
            df = read_csv_table(spark, path, schema)
        else:
            df = spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path)
        name = table_name(path)
        out[name] = df
        if register_views:
            df.createOrReplaceTempView(name)
    return out


def read_text_sheet(spark: SparkSession, path: str | list[str], position: str | None = None) -> DataFrame:
    """Exported worksheet: first row is the header, every cell stays text, quotes are doubled in quoted cells.

    Files of several headers are united by name. Cells may hold line breaks. ``position`` as in ``read_csv_table``.
    """
    frames = _text_groups(spark, path, ",", "UTF-8", None, position)
    if not frames:
        raise ValueError(f"{path} has no header row")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_sheets(frames: list[DataFrame], sheet_col: str = "sheet_no") -> DataFrame:
    """Stack same-shaped sheets; ``sheet_col`` keeps which sheet a row came
    from so that "keep first" stays defined after the union (S6, U1)."""
    if not frames:
        raise ValueError("union_sheets needs at least one sheet")
    tagged = [f.withColumn(sheet_col, F.lit(i).cast("long")) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_sheets(spark: SparkSession, paths: list[str], sheet_col: str = "sheet_no", row_col: str = "row_key") -> DataFrame:
    """Sheets in the order given, each row with its sheet and its place in it, so (sheet, row) orders rows as the sheets list them."""
    return union_sheets([read_text_sheet(spark, p, position=row_col) for p in paths], sheet_col)


# The types a column of text cells can take, the narrowest first; text is above all.
VALUE_TYPES = ("long", "double", "date")


def _is_value(name: str, kind: str):
    """The cell reads as a value of the kind and loses nothing by it: ``0555`` is no number, ``2020-1-5`` no date."""
    col = F.col(f"`{name}`")
    if kind == "long":
        return col.try_cast("long").cast("string") == col
    if kind == "double":
        return col.try_cast("double").isNotNull() & col.rlike(r"^-?(0|[1-9][0-9]*)([.][0-9]+)?([eE][+-]?[0-9]+)?$")
    return (col.try_cast("date").cast("string") == col) & (F.length(col) == 10)


def value_types(df: DataFrame) -> dict[str, dict]:
    """For each text column its type by value, the number of cells, and how many do not fit each type.

    One pass that is reduced per task to a few counts a column.
    """
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    counts = [F.count(F.col(f"`{n}`")).alias(f"{k}:cells") for k, n in enumerate(names)]
    counts += [F.count(F.when(~_is_value(n, kind) | _is_value(n, kind).isNull() & F.col(f"`{n}`").isNotNull(), 1)).alias(f"{k}:{kind}") for k, n in enumerate(names) for kind in VALUE_TYPES]
    found = df.agg(*counts).first().asDict() if names else {}
    out = {}
    for k, n in enumerate(names):
        misfits = {kind: found[f"{k}:{kind}"] for kind in VALUE_TYPES}
        fitting = [kind for kind in VALUE_TYPES if not misfits[kind]] if found[f"{k}:cells"] else []
        out[n] = {"type": fitting[0] if fitting else "string", "cells": found[f"{k}:cells"], "misfits": misfits}
    return out


def typed_by_value(df: DataFrame, rename: Mapping[str, str] | None = None) -> DataFrame:
    """Text columns cast to the narrowest type that all their cells have; ``rename`` maps a sheet's own column names."""
    types = value_types(df)
    cols = [F.col(f"`{c}`").cast(types[c]["type"]) if c in types else F.col(f"`{c}`") for c in df.columns]
    return df.select(*[col.alias((rename or {}).get(c, c)) for c, col in zip(df.columns, cols)])
