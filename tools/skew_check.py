"""Write SKEW.md: per-task load when one customer holds a third of all orders.

The driver's orders are re-keyed so that every third order belongs to one
customer (data derived from the given tables, nothing synthesised), the
skew-sensitive reports run on it, and Spark's event log (written to a fresh
scratch folder) gives, per stage, the records read by the busiest task
against the stage total.

    python tools/skew_check.py /root/testdata/sf0.1 SKEW.md
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
from collections import defaultdict

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

HOT = 1  # customer key that receives every third order


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    out = sys.argv[2] if len(sys.argv) > 2 else os.path.join(ROOT, "SKEW.md")
    import zstandard
    from pyspark.sql import functions as F

    from shopmetrics import operators as op
    from shopmetrics.plans import catalog, params as P
    from shopmetrics.session import build_session

    ev = tempfile.mkdtemp(prefix="skew-events-", dir="/tmp")
    spark = build_session(
        "local[8]", "shopmetrics-skew", shuffle_partitions=16,
        # Coalescing is off here so the 16 hash partitions stay visible: with it
        # on, AQE merges these small shuffles into one task and every stage
        # would trivially show one busiest task.
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": ev,
            "spark.sql.adaptive.coalescePartitions.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    inputs = catalog.Inputs(spark, sf_dir)
    base = inputs.t

    def skewed(name):
        df = base(name)
        if name == "orders":
            df = df.withColumn(
                "o_custkey", F.when(F.col("o_orderkey") % 3 == 0, F.lit(HOT).cast("long")).otherwise(F.col("o_custkey"))
            )
        return df

    inputs.t = skewed
    cases = {
        "order sequence (fixture)": lambda: inputs.raw("raw_orders"),
        "cohort_counts": lambda: op.cohort_counts(inputs.orders, None, None, P.SLICE_START, P.SLICE_END),
        "retarget_buyers (keep last)": lambda: op.retarget_buyers(inputs.orders, P.BUYER_DAYS, P.AS_OF),
        "non_buyers (flag + last row)": lambda: op.non_buyers(inputs.orders),
        "signup_flags (first row + any completed)": lambda: inputs.flags(),
        "signup_orders (row-level join)": lambda: inputs.signup_orders,
    }
    total_orders = base("orders").count()
    hot_orders = total_orders // 3
    # Pass 2 forbids broadcast joins, so the hot customer meets the customer
    # table in a sort-merge join; skew thresholds are lowered to this data
    # size so AQE's skew-join split is exercised as it would be at scale.
    passes = {
        "": {},
        "SMJ: ": {
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        },
    }
    for prefix, conf in passes.items():
        for k, v in conf.items():
            spark.conf.set(k, v)
        for name, build in cases.items():
            spark.sparkContext.setJobGroup(prefix + name, prefix + name)
            build().write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, stats = {}, defaultdict(lambda: [0, 0, 0])
    for f in glob.glob(os.path.join(ev, "*", "events_*")):
        data = zstandard.ZstdDecompressor().stream_reader(open(f, "rb")).read().decode()
        for line in data.splitlines():
            e = json.loads(line)
            if e["Event"] == "SparkListenerJobStart":
                g = e.get("Properties", {}).get("spark.jobGroup.id")
                for s in e["Stage IDs"]:
                    stage_group[s] = g
            elif e["Event"] == "SparkListenerTaskEnd" and e.get("Task Metrics"):
                m = e["Task Metrics"]
                recs = m["Shuffle Read Metrics"]["Total Records Read"]
                s = stats[e["Stage ID"]]
                s[0] += 1
                s[1] += recs
                s[2] = max(s[2], recs)

    lines = [
        "# Skew check",
        "",
        f"Orders of `{sf_dir}` ({total_orders} rows) re-keyed so that customer {HOT} holds every third "
        f"order ({hot_orders} rows). For every stage that reads a shuffle: tasks, records read, and "
        "the records of the busiest task. A plan that sent the hot customer to one task would show a "
        f"busiest task of at least {hot_orders} records. Generated by `tools/skew_check.py` "
        "(local[8], 16 shuffle partitions, AQE on, partition coalescing off). Rows marked `SMJ:` "
        "repeat the reports with broadcast joins disabled and AQE skew-join thresholds lowered to "
        "this data size; tasks above 16 there are AQE splitting the hot partition of a join.",
        "",
        "| report | stage | tasks | shuffle records | busiest task | busiest share |",
        "| --- | --- | --- | --- | --- | --- |",
    ]
    worst = 0
    for sid in sorted(stats):
        n, recs, mx = stats[sid]
        if recs == 0 or stage_group.get(sid) is None:
            continue
        worst = max(worst, mx)
        lines.append(f"| {stage_group[sid]} | {sid} | {n} | {recs} | {mx} | {mx / recs:.0%} |")
    lines += [
        "",
        f"Largest single-task shuffle read: {worst} records, against {hot_orders} orders of the hot customer.",
        "",
        "Reading the table: aggregations and windows (sequence, cohort, keep-last, flags) stay near "
        "an even share because they combine map-side or key on (customer, day). Stages above ~16% are "
        "row-level joins: without `SMJ:` the hot join partition is far below AQE's skew threshold "
        "(256 MB by default) so it is left whole; with thresholds lowered AQE splits it, but only at "
        "map-output boundaries, and these single-file inputs have one or two map tasks, which caps the "
        "split (at cluster scale there are thousands).",
    ]
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")


if __name__ == "__main__":
    main()
