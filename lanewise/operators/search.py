"""Finders, optional-filter search, sweeps, paging and the two read models."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import (
    ACTIVE_DELIVERY_STATUSES, DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE,
)
from lanewise.operators.skew import pages

SHIPMENT_FIELDS = [
    "shipment_id", "reference_no", "shipper_id", "shipper_name", "consignee_name",
    "origin_city", "origin_state", "dest_city", "dest_state", "carrier_id", "carrier_name",
    "carrier_tracking_number", "status", "weight_lbs", "declared_value", "estimated_delivery",
    "actual_delivery", "gl_code", "created_at", "updated_at",
]
LINE_FIELDS = ["description", "charge_type", "quantity", "unit_price", "total_amount", "gl_code"]


def find(df: DataFrame, **equals: object) -> DataFrame:
    """Rows whose named columns equal the given values."""
    for column, value in equals.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def contains_text(col: Column, query: str) -> Column:
    """Case-insensitive contains; ``%`` and ``_`` in the query stay wildcards, a backslash is itself."""
    pattern = query.lower().replace("\\", "\\\\")
    return F.lower(col).like(f"%{pattern}%")


def search_shipments(shipments: DataFrame, shipper_id: str | None = None,
                     carrier_id: str | None = None, status: str | None = None,
                     from_date: datetime | str | None = None,
                     to_date: datetime | str | None = None,
                     origin_city: str | None = None, dest_city: str | None = None) -> DataFrame:
    """Shipments matching every filter that is given; a filter left out is no filter."""
    wanted = {"shipper_id": shipper_id, "carrier_id": carrier_id, "status": status}
    found = find(shipments, **{c: v for c, v in wanted.items() if v is not None})
    if from_date is not None:
        found = found.filter(F.col("created_at") >= F.lit(str(from_date)))
    if to_date is not None:
        found = found.filter(F.col("created_at") <= F.lit(str(to_date)))
    if origin_city is not None:
        found = found.filter(contains_text(F.col("origin_city"), origin_city))
    if dest_city is not None:
        found = found.filter(contains_text(F.col("dest_city"), dest_city))
    return found


def list_invoices(invoices: DataFrame, status: str | None = None,
                  carrier_id: str | None = None) -> DataFrame:
    """By status if given, else by carrier if given, else all: the first named filter wins."""
    if status is not None:
        return find(invoices, status=status)
    if carrier_id is not None:
        return find(invoices, carrier_id=carrier_id)
    return invoices


def newest_first(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(F.col("created_at").desc(), F.col(key))


def page(df: DataFrame, key: str, number: int = 0, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One zero-based page, newest first.  Runs as a top-k, not as a full sort."""
    size = min(size, MAX_PAGE_SIZE)
    return newest_first(df, key).offset(number * size).limit(size)


def page_after(df: DataFrame, key: str, last_created: datetime | str, last_key: str,
               size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """The page after a known row.  Costs the same however deep the page is."""
    moment = F.lit(str(last_created))
    later = (F.col("created_at") < moment) | (
        (F.col("created_at") == moment) & (F.col(key) > F.lit(last_key)))
    return newest_first(df.filter(later), key).limit(min(size, MAX_PAGE_SIZE))


def page_totals(df: DataFrame, number: int = 0, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Row and page totals with first/last flags, from a single count."""
    size = min(size, MAX_PAGE_SIZE)
    pages = F.ceil(F.col("total_elements") / size).cast("bigint")
    return (
        df.agg(F.count(F.lit(1)).alias("total_elements"))
        .select(F.lit(number).alias("page"), F.lit(size).alias("size"), "total_elements",
                pages.alias("total_pages"), F.lit(number == 0).alias("first"),
                (F.lit(number + 1) >= pages).alias("last"))
    )


def overdue_shipments(shipments: DataFrame, threshold: datetime | str) -> DataFrame:
    """On the road although promised before the threshold."""
    return shipments.filter(F.col("status").isin(ACTIVE_DELIVERY_STATUSES)
                            & (F.col("estimated_delivery") < F.lit(str(threshold))))


def overdue_invoices(invoices: DataFrame, today: date | str) -> DataFrame:
    """Approved, due and unpaid."""
    return invoices.filter((F.col("status") == "APPROVED") & F.col("paid_at").isNull()
                           & (F.col("payment_due_date") <= F.lit(str(today))))


def status_counts(shipments: DataFrame, from_date: datetime | str) -> DataFrame:
    recent = shipments.filter(F.col("created_at") >= F.lit(str(from_date)))
    return recent.groupBy("status").agg(F.count(F.lit(1)).alias("shipments"))


def shipment_view(shipments: DataFrame) -> DataFrame:
    return shipments.select(*SHIPMENT_FIELDS)


def with_children(parents: DataFrame, children: DataFrame, key: str, fields: list[str],
                  alias: str, page_rows: int = 10_000) -> DataFrame:
    """Parents with their children as sorted arrays of structs, in pages of ``page_rows``.

    ``fields`` name the children's columns in sort order.  Every parent has a page 0 (``part``),
    empty if it has no children; a parent with more children than a page holds has further pages,
    each going on where the one before ends.
    """
    arrays = pages(children, key, fields, alias, page_rows)
    child_type = arrays.schema[alias].dataType
    return (
        parents.join(arrays, key, "left")
        .withColumn("part", F.coalesce(F.col("part"), F.lit(0)))
        .withColumn(alias, F.coalesce(F.col(alias), F.array().cast(child_type)))
    )


def shipment_with_legs(shipments: DataFrame, legs: DataFrame,
                       page_rows: int = 10_000) -> DataFrame:
    fields = ["sequence", "carrier_id", "origin_city", "estimated_departure", "status"]
    return with_children(shipments, legs, "shipment_id", fields, "legs", page_rows)


def invoice_with_lines(invoices: DataFrame, lines: DataFrame,
                       page_rows: int = 10_000) -> DataFrame:
    return with_children(invoices, lines, "invoice_id", LINE_FIELDS, "line_items", page_rows)
