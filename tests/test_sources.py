"""Readers, writers, fixtures (S1–S10) and the skew-safe order sequence."""

import datetime as dt
import os

import pytest
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from shopmetrics.schemas import RAW_ORDERS
from shopmetrics.session import shared_dir
from shopmetrics.sources import (
    load_tables,
    read_csv_table,
    read_segment,
    read_sheets,
    read_text_sheet,
    report_path,
    table_name,
    union_sheets,
    write_report,
    write_segments,
)
from shopmetrics.sources import fixtures as fx


def _tmp():
    return tempfile.mkdtemp(prefix="shopmetrics-test-")


def test_csv_reader_keeps_ids_as_text(spark):
    d = _tmp()
    p = os.path.join(d, "orders.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("order_id,customer_id,date,job_status,customer_origine,paymentType,Order Type,businessCat,"
                "Occurence,previous_order_date,returning_customer,customer_username,customer_phone,"
                "customer_email,total_amount_dzd\n")
        f.write("1,123456789012.0,2023-01-05T10:00:00,COMPLETED,Local,CARD,INTERNE,Airtime,1,,false,u,p,e,12.5\n")
    df = read_csv_table(spark, p, RAW_ORDERS)
    r = df.first()
    assert r.customer_id == "123456789012.0" and r["Order Type"] == "INTERNE"
    assert r.date == dt.datetime(2023, 1, 5, 10) and r.previous_order_date is None
    tables = load_tables(spark, {p: RAW_ORDERS})
    assert set(tables) == {"orders"} and spark.sql("SELECT count(*) FROM orders").first()[0] == 1
    assert table_name("s3a://bucket/exports/ltv_data.csv") == "ltv_data"


def test_text_sheets_and_union(spark):
    d = _tmp()
    paths = []
    for i, rows in enumerate([["a@x", "b@x"], ["a@x", "c@x"]]):
        p = os.path.join(d, f"sheet{i}.csv")
        with open(p, "w") as f:
            f.write("email,when\n" + "".join(f"{r},2020-01-0{i + 1}\n" for r in rows))
        paths.append(p)
    sheets = [read_text_sheet(spark, p) for p in paths]
    assert dict(sheets[0].dtypes) == {"email": "string", "when": "string"}
    u = union_sheets(sheets)
    assert sorted((r.sheet_no, r.email) for r in u.collect()) == [(0, "a@x"), (0, "b@x"), (1, "a@x"), (1, "c@x")]


def test_write_report_and_segments(spark):
    d = _tmp()
    df = spark.createDataFrame([("x", 1.2345, 3)], "name string, v double, n long")
    out = report_path(d, "ltv", origin=None, category="Alimentation / x", days="over_120")
    assert out.endswith("ltv/origin=all/category=Alimentation%20%2F%20x/days=over_120")
    paths = {report_path(d, "ltv", origin=o) for o in (None, "all", "Île A", "É A", "È A", "_le_A", "a/b", "a_b")}
    assert len(paths) == 8
    write_report(df, out, "csv", index_cols=("n",))
    back = spark.read.option("header", True).csv(out).first()
    assert back.asDict() == {"n": "3", "name": "x", "v": "1.2345"}
    write_report(df, out, "csv", decimals={"v": 2})
    assert spark.read.option("header", True).csv(out).first()["v"] == "1.23"
    seg = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "segment string, customer_id string")
    write_segments(seg, os.path.join(d, "seg"))
    assert sorted(r.customer_id for r in read_segment(spark, os.path.join(d, "seg"), "a").collect()) == ["1", "3"]


def test_sequence_matches_plain_window_with_a_hot_customer(spark):
    # customer 1 holds most rows, over several days and several orders per day
    rows = []
    k = 0
    for day in range(30):
        for j in range(1 + day % 4):
            k += 1
            rows.append((k, 1, dt.datetime(2000, 1, 1 + day % 28, j)))
    rows += [(1000 + i, 2 + i % 3, dt.datetime(2000, 2, 1 + i)) for i in range(10)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz")
    got = fx._sequence_per_customer(orders).select("o_orderkey", "occurrence", "previous_order_date")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    want = orders.select(
        "o_orderkey",
        F.row_number().over(w).cast("long").alias("occurrence"),
        F.lag("o_orderdate").over(w).alias("previous_order_date"),
    )
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_fixture_tables_have_expected_schemas(spark, small_dir):
    got = [(f.name, f.dataType) for f in fx.raw_orders(fx.table_source(spark, small_dir)).schema.fields]
    assert got == [(f.name, f.dataType) for f in RAW_ORDERS.fields]
    assert fx.raw_geo(fx.table_source(spark, small_dir)).columns == ["row_key", "commune", "wilaya", "Latitude", "Longitude"]


def test_large_exclusion_list_becomes_anti_join(spark):
    from shopmetrics.functions import exclude_ids

    df = spark.createDataFrame([(str(i),) for i in range(50)] + [(None,)], "customer_id string")
    ids = [str(i) for i in range(10, 12_000)]
    out = exclude_ids(df, "customer_id", ids)
    plan = out._jdf.queryExecution().analyzed().toString()
    assert "LeftAnti" in plan
    assert sorted(out.collect(), key=str) == sorted([(str(i),) for i in range(10)] + [(None,)], key=str)


def test_table_listing_cache_and_parquet_outputs(spark, small_dir):
    from shopmetrics.sources.readers import forget_tables, read_table

    assert read_table(spark, small_dir, "nation") is not read_table(spark, small_dir, "nation")
    a = read_table(spark, small_dir, "nation", ttl=600)
    assert read_table(spark, small_dir, "nation", ttl=600) is a
    assert read_table(spark, small_dir, "nation", ttl=0) is not a
    forget_tables()
    assert read_table(spark, small_dir, "nation") is not a

    d = _tmp()
    df = spark.createDataFrame([("x", 1.5)], "name string, v double")
    write_report(df, os.path.join(d, "r"), "parquet")
    tables = load_tables(spark, {os.path.join(d, "r"): None}, register_views=False)
    assert tables["r"].collect()[0].v == 1.5


def test_materialize_writes_under_shared_folder(spark, small_dir):
    from shopmetrics.plans.catalog import Inputs
    from shopmetrics.session import materialize, shared_dir

    users = Inputs(spark, small_dir).users
    m = materialize(users, "users")
    assert m.count() == users.count()
    assert shared_dir(spark) in m.inputFiles()[0]


def test_materialize_leaves_no_shuffle_files(spark):
    import gc
    import glob

    from shopmetrics.session import SHUFFLE_CLEANUP, materialize

    def shuffled():
        folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
        return {f for d in folders for f in glob.glob(os.path.join(d, "**", "shuffle_*.data"), recursive=True)}

    df = spark.range(20_000).selectExpr("id % 999 AS k", "id").groupBy("k").sum("id").repartition(3, "k")
    setting = spark.conf.get(SHUFFLE_CLEANUP, "false")
    gc.collect()
    before = shuffled()
    assert materialize(df, "sums").count() == 999  # the count leaves its own file of one partition
    assert len(shuffled() - before) <= 4  # the write alone makes two shuffles, of several files each
    assert materialize(df, "sums-again").count() == df.count() == 999
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == setting
    with pytest.raises(Exception):
        materialize(df.selectExpr("raise_error('no')"), "failed")
    assert spark.conf.get(SHUFFLE_CLEANUP, "false") == setting


def test_refresh_writes_every_report(spark, small_dir):
    import datetime as _dt

    from shopmetrics import operators as op
    from shopmetrics.plans import params as P
    from shopmetrics.plans.refresh import ReportParams, refresh

    t = fx.table_source(spark, small_dir)
    tables = {
        "orders": fx.raw_orders(t), "ltv": fx.raw_ltv(t), "users": fx.raw_users(t), "geo": fx.raw_geo(t),
        "downloads": fx.raw_downloads(t), "first_open": fx.raw_first_open(t),
    }
    p = ReportParams(P.SLICE_START, P.SLICE_END, P.AS_OF, excluded_orders=P.EXCLUDED_ORDERS,
                     excluded_customers=P.EXCLUDED_CUSTOMERS, since=_dt.date(1998, 1, 1))
    written = refresh(tables, p, _tmp())
    assert len(written) == 19 and all("origin=all" in v for v in written.values())
    back = spark.read.parquet(written["cohort_counts"])
    direct = op.cohort_counts(op.clean_orders(tables["orders"], P.EXCLUDED_ORDERS, P.EXCLUDED_CUSTOMERS),
                              None, None, P.SLICE_START, P.SLICE_END)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, direct.collect()))


def test_refresh_command_line_from_csv_exports(spark, small_dir, capsys):
    from shopmetrics.plans.refresh import main

    t = fx.table_source(spark, small_dir)
    d = _tmp()
    paths = {}
    for name, build in (("orders", fx.raw_orders), ("ltv", fx.raw_ltv), ("users", fx.raw_users), ("geo", fx.raw_geo)):
        paths[name] = os.path.join(d, f"{name}.csv")
        frame = build(t)
        frame = frame.orderBy("row_key").drop("row_key") if name == "geo" else frame
        frame.write.option("header", True).option("escape", '"').csv(paths[name])
    out = os.path.join(d, "reports")
    main([*sum(([f"--{k}", v] for k, v in paths.items()), []), "--out", out,
          "--start", "1998-01-01", "--end", "1998-12-31", "--as-of", "2001-09-01T12:00:00", "--origin", "Local"])
    lines = capsys.readouterr().out.strip().splitlines()
    assert len(lines) == 18 and all("origin=Local" in ln for ln in lines)
    assert not os.path.exists(os.path.join(shared_dir(spark), "shopmetrics", spark.sparkContext.applicationId))
    assert spark.read.parquet(dict(ln.split("\t") for ln in lines)["retention"]).count() > 0


def test_write_report_formats_decimal_columns(spark):
    d = _tmp()
    df = spark.createDataFrame([("x", 1.235)], "name string, v double").selectExpr(
        "name", "cast(v as decimal(18,4)) as d", "v"
    )
    write_report(df, os.path.join(d, "full"), "csv")
    full = spark.read.option("header", True).csv(os.path.join(d, "full")).first().asDict()
    assert full == {"name": "x", "d": "1.2350", "v": "1.235"}
    write_report(df, os.path.join(d, "r"), "csv", decimals={"d": 2, "v": 2})
    back = spark.read.option("header", True).csv(os.path.join(d, "r")).first().asDict()
    assert back["name"] == "x" and back["d"] == "1.24" and back["v"] in ("1.24", "1.23")


def test_first_open_from_text_sheets_keeps_sheet_order(spark):
    from shopmetrics import operators as op

    d = _tmp()
    sheets = []
    for i, lines in enumerate([["b@x,2020", "a@x,2021"], ["a@x,2019", "c@x,2018"]]):
        p = os.path.join(d, f"first_open_{i}.csv")
        with open(p, "w") as f:
            f.write("email,opened\n" + "".join(x + "\n" for x in lines))
        sheets.append(p)
    fo = read_sheets(spark, sheets)
    users = spark.createDataFrame(
        [(dt.date(2020, 1, 1), e, "p", "Local", c) for c, e in (("1", "a@x"), ("2", "b@x"), ("9", "z@x"))],
        "date date, email string, phone string, origin string, customer_id string",
    )
    got = {r.email: r.opened for r in op.first_open_signups(users, fo).collect()}
    assert got == {"a@x": "2021", "b@x": "2020"}  # a@x first appears in sheet 0


def test_csv_by_header_name_with_quotes_and_strict_types(spark):
    from pyspark.sql import types as T
    from pyspark.errors import PySparkException

    schema = T.StructType([T.StructField(*x) for x in (("email", T.StringType()), ("phone", T.StringType()), ("n", T.LongType()), ("rate", T.DecimalType(18, 12)))])

    def read(text, **options):
        path = os.path.join(_tmp(), "t.csv")
        with open(path, "w") as f:
            f.write(text)
        return [tuple(r) for r in read_csv_table(spark, path, schema, **options).collect()]

    got = read('phone,extra,email,rate,n\n0555,"a ""b"", c",a@x,0.00684123,1.0\n,,b@x,,\n')
    assert [(e, p, n, r and float(r)) for e, p, n, r in got] == [("a@x", "0555", 1, 0.00684123), ("b@x", None, None, None)]
    assert read('email,phone,n,rate\n"a\nb",1,2,3\n', multi_line=True)[0][0] == "a\nb"
    for bad in ("phone,n,rate\n1,2,3\n", "email,phone,n,rate\na,1,1.5,1\n", "email,phone,n,rate\na,1,x,1\n", "email,phone,n,rate\na,1,1,0.0000000000001\n"):
        with pytest.raises((ValueError, PySparkException)):
            read(bad)


def test_ltv_without_ids_and_signed_ratios(spark):
    from shopmetrics import operators as op
    from shopmetrics.functions import half_even_ratio
    from shopmetrics.functions.textfmt import label_with_percent

    rows = [(None, "1", 5.0), (None, "2", 5.0), ("a", None, 10.0), ("a", None, 10.0)]
    ltv = spark.createDataFrame([(c, o, "Local", "X", dt.datetime(2020, 1, 1 + 30 * (k % 2)), v) for k, (c, o, v) in enumerate(rows)], "customer_id string, order_id string, origin string, business_cat string, date timestamp_ntz, v double")
    money = F.col("v").cast("decimal(18,2)")
    ltv = ltv.withColumns({c: money for c in ("total_amount_dzd", "total_amount_eur", "margin_dzd", "margin_eur")})
    out = op.customer_ltv(ltv).collect()
    assert [(r.customer_id, r.n_orders, r.ltv_gmv_dzd) for r in out] == [("a", 2, 20.0)]
    df = spark.createDataFrame([(-1, 2), (1, -3), (3, 2), (-5, 2), (1, 0)], "n long, d long")
    assert [r[0] for r in df.select(half_even_ratio("n", "d", 0)).collect()] == [0, 0, 2, -2, None]
    assert df.select(label_with_percent(F.lit("Cat"), half_even_ratio("n", "d", 4))).collect()[-1][0] == "Cat"


def test_recency_range_reaches_the_scan(spark):
    from shopmetrics import operators as op
    from shopmetrics.operators.retargeting import EXPORT_COLUMNS

    path = os.path.join(_tmp(), "orders")
    schema = ", ".join(f"{c} {'timestamp_ntz' if 'date' in c else 'string'}" for c in EXPORT_COLUMNS) + ", order_id string, status string"
    spark.createDataFrame([], schema).write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = op.retarget_buyers(spark.read.parquet(path), 30, dt.datetime(2020, 1, 1))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(previous_order_date" in plan


def test_unlisted_period_raises(spark):
    from pyspark.errors import PySparkException
    from shopmetrics import operators as op

    counts = spark.createDataFrame([(dt.date(2020, 1, 1), k, 5) for k in (0, 1, 19)], "cohort date, period_number int, n_customers long")
    assert op.cohort_matrix(counts).columns[-1] == "period_19"
    with pytest.raises(PySparkException):
        op.cohort_matrix(counts, range(12)).collect()
