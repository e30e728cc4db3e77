"""Files as they are exported: layouts, line breaks, misfits, sheets, positions; and publishing as a set."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopmetrics import operators as op
from shopmetrics.sources import (
    drop_old_runs, header_catalogue, parameters_key, publish, published, read_csv_table, read_csv_with_misfits, read_published, read_sheets, read_text_sheet, typed_by_value, value_types, write_report,
)

TWO = T.StructType([T.StructField("email", T.StringType()), T.StructField("phone", T.StringType())])


def folder(**files):
    d = tempfile.mkdtemp(prefix="shopmetrics %41 test-")  # a space in the path
    for name, text in files.items():
        with open(os.path.join(d, f"{name}.csv"), "w", encoding="utf-8", newline="") as f:
            f.write(text)
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_files_of_other_column_order_and_line_breaks(spark):
    d = folder(a="email,phone\na@x,1\n", b="phone,extra,email\n444,z,w@a\n", c='email,phone\n"x\ny ""q"", z",111\n', d="\ufeffemail,phone\nbom@x,9\n", e="")
    got = rows(read_csv_table(spark, d, TWO))
    assert got == sorted([("a@x", "1"), ("w@a", "444"), ('x\ny "q", z', "111"), ("bom@x", "9")], key=str)
    assert sorted((len(files), breaks) for files, breaks in header_catalogue(spark, d)) == [(1, False), (1, True), (2, False)]  # a byte order mark is no other header
    assert rows(read_csv_table(spark, [os.path.join(d, "a.csv"), os.path.join(d, "b.csv")], TWO)) == [("a@x", "1"), ("w@a", "444")]
    with pytest.raises(ValueError):
        read_csv_table(spark, folder(a="email,phone\na@x,1\n", b="email\nq@x\n"), TWO)
    with pytest.raises(ValueError):
        read_csv_table(spark, folder(e=""), TWO)


def test_float_money_is_rounded_half_even_or_refused(spark):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("v", T.DecimalType(24, 8))])
    path = folder(a="id,v\na,0.30000000000000004\nb,1e-05\nc,0.000000005\nd,0.000000015\ne,\n")
    got = {r.id: None if r.v is None else float(r.v) for r in read_csv_table(spark, path, schema, round_decimals=True).collect()}
    assert got == {"a": 0.3, "b": 1e-05, "c": 0.0, "d": 2e-08, "e": None}
    with pytest.raises(PySparkException):
        read_csv_table(spark, path, schema).collect()


def test_misfits_are_set_apart(spark):
    schema = T.StructType([T.StructField(*x) for x in (("id", T.StringType()), ("n", T.LongType()), ("d", T.DateType()), ("ok", T.BooleanType()), ("v", T.DoubleType()))])
    path = folder(a="id,n,d,ok,v\na,1,2020-01-05,true,1.5\nb,x,2020-13-05,true,1\nc,1.5,,,\nd,,,maybe,1;5\ne,2.0,,false,-3e2\n,9223372036854775808,,,\n")
    good, bad = read_csv_with_misfits(spark, path, schema, keys=("id",))
    assert rows(good) == [("a", 1, dt.date(2020, 1, 5), True, 1.5), ("e", 2, None, False, -300.0)]
    assert rows(bad.drop("row")) == sorted([
        ("b", "n", "x", "not bigint"), ("b", "d", "2020-13-05", "not date"), ("c", "n", "1.5", "not bigint"), ("d", "ok", "maybe", "not boolean"),
        ("d", "v", "1;5", "not double"), (None, "n", "9223372036854775808", "not bigint"),
    ], key=str)
    assert '"id":"d"' in [r.row for r in bad.where("id = 'd'").collect()][0]


def test_cells_are_typed_by_value(spark):
    sheet = read_text_sheet(spark, folder(a="date,phone,n,v,mixed,empty,day\n2020-01-05,0555,12,1.5,1,,2020-1-5\n2020-02-05,0666,,-2,x,,2020-1-6\n"))
    types = value_types(sheet)
    assert {k: v["type"] for k, v in types.items()} == {"date": "date", "phone": "string", "n": "long", "v": "double", "mixed": "string", "empty": "string", "day": "string"}
    assert types["mixed"] == {"type": "string", "cells": 2, "misfits": {"long": 1, "double": 1, "date": 2}} and types["n"]["cells"] == 1
    out = typed_by_value(sheet, rename={"n": "downloads"})
    assert dict(out.dtypes)["downloads"] == "bigint" and dict(out.dtypes)["date"] == "date"


def test_rows_keep_their_place_in_the_files(spark):
    sizes = [3, 4000, 1]
    d = folder(**{f"s{k}": "email,v\n" + "".join(f"{k}x{j}@x,{j}\n" for j in range(n)) for k, n in enumerate(sizes)})
    paths = [os.path.join(d, f"s{k}.csv") for k in (2, 0, 1)]  # the order given, not the names'
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # many splits
    try:
        sheets = read_sheets(spark, paths)
        assert sheets.rdd.getNumPartitions() > 4
        got = [r.email for r in sheets.orderBy("sheet_no", "row_key").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [f"{k}x{j}@x" for k in (2, 0, 1) for j in range(sizes[k])]
    geo = spark.createDataFrame([("c", "w", None, 1.0), ("c", "v", 2.0, None)], "commune string, wilaya string, Latitude double, Longitude double")
    path = os.path.join(tempfile.mkdtemp(), "geo")
    write_report(geo.coalesce(1), path, "csv")
    back = read_csv_table(spark, path, geo.schema, position="row_key")
    assert rows(op.customers_by_commune(back)) == [("c", 2, 2.0, 1.0, "w")]


def test_reports_with_quotes_read_back(spark):
    df = spark.createDataFrame([('a "b", c', "x\ny"), ('"', None)], "email string, phone string")
    path = os.path.join(tempfile.mkdtemp(), "r")
    write_report(df, path, "csv")
    assert rows(read_csv_table(spark, path, TWO)) == rows(df)


def test_a_run_that_dies_leaves_the_old_set(spark):
    base = tempfile.mkdtemp(prefix="shopmetrics-test-")

    def write(value, dies=False):
        def run(where):
            paths = {}
            for name in ("one", "two"):
                if dies and name == "two":
                    raise RuntimeError("executor gone")
                paths[name] = f"{where}/{name}"
                write_report(spark.createDataFrame([(value,)], "v long"), paths[name], "parquet")
            return paths
        return run

    assert published(spark, base) is None
    publish(spark, base, {"start": dt.date(2020, 1, 1)}, write(1))
    with pytest.raises(RuntimeError):
        publish(spark, base, {}, write(2, dies=True))
    assert [read_published(spark, base, n).first().v for n in ("one", "two")] == [1, 1]
    publish(spark, base, {}, write(3))
    assert read_published(spark, base, "two").first().v == 3
    assert published(spark, base, back=1)["parameters"] == {"start": "2020-01-01"}
    assert len(drop_old_runs(spark, base, keep=1)) == 1 and published(spark, base, back=1) is None
    with pytest.raises(ValueError):
        read_published(spark, base, "three")


def test_long_exclusion_lists_fit_a_path():
    from shopmetrics.plans.refresh import ReportParams, report_folder

    ids = tuple(f"customer-{k:012d}" for k in range(500))
    one = ReportParams(dt.date(2020, 1, 1), dt.date(2020, 12, 31), dt.datetime(2021, 1, 1), excluded_customers=ids)
    other = ReportParams(dt.date(2020, 1, 1), dt.date(2020, 12, 31), dt.datetime(2021, 1, 1), excluded_customers=ids[:-1])
    paths = {report_folder("b", p) for p in (one, other)}
    assert len(paths) == 2 and all(len(part) < 100 for p in paths for part in p.split("/"))
    assert parameters_key({"a": (1, 2)}) != parameters_key({"a": (1, 3)})


def test_sign_ups_are_exported_whole(spark):
    signups = spark.createDataFrame(
        [(dt.date(2020, 1, k), c, "l", "f", "p", "e", "DZ", "Local") for k, c in ((1, "a"), (2, "a"), (3, None))],
        "date date, customer_id string, last_name string, first_name string, phone string, email string, customer_country string, origin string",
    )
    orders = spark.createDataFrame([], "date timestamp_ntz, customer_id string, order_id string, status string, origin string, business_cat string, total_amount_dzd double")
    long = op.segments_long(signups, op.order_flags(orders))
    assert {r.segment: r["count"] for r in long.groupBy("segment").count().collect()} == {"new_signups": 3, "not_ordered": 1}
    assert long.where("segment = 'new_signups'").select(F.count("registration_date")).first()[0] == 3
