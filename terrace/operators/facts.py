"""Star-schema facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.names import free_name
from terrace.functions.money import cents, from_cents, line_total, mean_money
from terrace.operators.dimensions import lookup
from terrace.operators.scd2 import current_rows

TRACK_KEYS = {k: k for k in ("track_key", "album_key", "genre_key", "media_type_key")}


def keyed_invoices(
    invoices: DataFrame, customers: DataFrame, dates: DataFrame, employees: DataFrame
) -> DataFrame:
    """Invoices with customer, date and employee keys.

    These keys belong to the invoice, so they are looked up there, on the smaller side,
    and reach the lines with the one join that lines and invoices need in any case.
    """
    day, rep = (free_name(n, invoices.columns) for n in ("_day", "_rep"))
    dated = invoices.withColumn(day, F.col("InvoiceDate").try_cast("date"))
    of_customer = {"customer_key": "customer_key", rep: "support_rep_key"}
    keyed = lookup(
        dated, current_rows(customers), {"CustomerId": "customer_id"}, of_customer, "inner"
    )
    keyed = lookup(keyed, dates, {day: "full_date"}, {"date_key": "date_key"}, "inner")
    return lookup(keyed, employees, {rep: "employee_key"}, {"employee_key": "employee_key"})


def sales_fact(
    lines: DataFrame,
    invoices: DataFrame,
    customers: DataFrame,
    dates: DataFrame,
    tracks: DataFrame,
    employees: DataFrame,
) -> DataFrame:
    """One row per invoice line with its surrogate keys.

    Lines without an invoice, a current customer, a date or a track are left out (see
    ``dropped_lines``); a customer without a representative is kept.
    """
    keyed = keyed_invoices(invoices, customers, dates, employees)
    from_invoice = {
        "customer_key": "customer_key",
        "date_key": "date_key",
        "employee_key": "employee_key",
        "billing_city": "BillingCity",
        "billing_country": "BillingCountry",
    }
    sold = lookup(lines, tracks, {"TrackId": "track_id"}, TRACK_KEYS, "inner")
    sold = lookup(sold, keyed, {"InvoiceId": "InvoiceId"}, from_invoice, "inner")
    return sold.select(
        F.col("InvoiceLineId").alias("invoice_line_id"),
        F.col("InvoiceId").alias("invoice_id"),
        "customer_key",
        "date_key",
        *TRACK_KEYS,
        "employee_key",
        F.col("UnitPrice").alias("unit_price"),
        F.col("Quantity").alias("quantity"),
        line_total("UnitPrice", "Quantity").alias("line_total"),
        "billing_city",
        "billing_country",
    )


def dropped_lines(
    lines: DataFrame, invoices: DataFrame, customers: DataFrame, tracks: DataFrame
) -> DataFrame:
    """(reason, dropped): how many lines each inner join of the fact leaves out.

    A line may be counted under more than one reason. One pass over the lines.
    """
    found = F.lit(True)
    members = current_rows(customers).select("customer_id", found.alias("_customer"))
    bills = invoices.select("InvoiceId", "CustomerId", F.col("InvoiceDate").try_cast("date").alias("_day"))
    bills = lookup(bills, members, {"CustomerId": "customer_id"}, {"_customer": "_customer"})
    bills = bills.withColumn("_invoice", found)
    flags = {f: f for f in ("_invoice", "_customer", "_day")}
    flagged = lookup(lines.select("InvoiceId", "TrackId"), bills, {"InvoiceId": "InvoiceId"}, flags)
    known = tracks.select("track_id", found.alias("_track"))
    flagged = lookup(flagged, known, {"TrackId": "track_id"}, {"_track": "_track"})
    invoiced = F.col("_invoice").isNotNull()
    reasons = {
        "no invoice": ~invoiced,
        "no customer": invoiced & F.col("_customer").isNull(),
        "no date": invoiced & F.col("_day").isNull(),
        "no track": F.col("_track").isNull(),
    }
    counted = flagged.agg(*[F.count_if(c).alias(r) for r, c in reasons.items()])
    rows = [F.struct(F.lit(r).alias("reason"), F.col(r).alias("dropped")) for r in reasons]
    return counted.select(F.inline(F.array(*rows)))


def customer_totals(fact: DataFrame) -> DataFrame:
    """One row per customer from the sales fact.

    The distinct invoice count makes Spark aggregate per customer and invoice first, so
    a customer with a large share of all lines is spread over many tasks.
    """
    money: Column = cents("line_total")
    sums = fact.groupBy("customer_key").agg(
        F.max("employee_key").alias("employee_key"),
        F.count_distinct("invoice_id").alias("total_invoices"),
        F.count("invoice_line_id").alias("total_line_items"),
        F.sum("quantity").alias("total_quantity"),
        F.sum(money).alias("_cents"),
        F.count("line_total").alias("_amounts"),
        F.max("line_total").alias("max_line_total"),
        F.min("date_key").alias("first_purchase_date_key"),
        F.max("date_key").alias("last_purchase_date_key"),
    )
    return sums.select(
        "customer_key",
        "employee_key",
        "total_invoices",
        "total_line_items",
        "total_quantity",
        from_cents(F.col("_cents")).alias("total_revenue"),
        mean_money(F.col("_cents"), F.col("_amounts")).alias("avg_line_total"),
        F.round("max_line_total", 2).alias("max_line_total"),
        "first_purchase_date_key",
        "last_purchase_date_key",
    )
