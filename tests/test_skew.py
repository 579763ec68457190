"""One key holding a large share of the rows is split at run time, results unchanged."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from terrace.operators.dimensions import lookup
from terrace.operators.facts import customer_totals
from terrace.session import tune


def test_a_hot_invoice_is_split_even_under_an_aggregate(spark):
    session = tune(spark.newSession())
    for key, value in {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.shuffle.partitions": "16",
    }.items():
        session.conf.set(key, value)
    line = F.col("id")
    lines = session.range(0, 300_000, 1, 8).select(
        line.alias("invoice_line_id"),
        F.when(line % 3 == 0, -1).otherwise(line).alias("invoice_id"),
        (line % 7).cast("int").alias("quantity"),
        (line % 1000 / 100).cast("decimal(18,2)").alias("line_total"),
    )
    invoice = F.col("id")
    invoices = session.range(-1, 300_000).select(
        invoice.alias("invoice_id"),
        (invoice % 50).alias("customer_key"),
        F.lit(20240101).alias("date_key"),
        F.lit(1).alias("employee_key"),
    )
    taken = {c: c for c in ("customer_key", "date_key", "employee_key")}
    totals = customer_totals(lookup(lines, invoices, {"invoice_id": "invoice_id"}, taken, "inner"))
    rows = totals.collect()
    plan = totals._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"SortMergeJoin\(skew=true\)", plan)

    expected = dict(
        lines.groupBy((F.col("invoice_id") % 50).alias("c")).agg(F.sum("line_total")).collect()
    )
    assert {r.customer_key: r.total_revenue for r in rows} == expected
