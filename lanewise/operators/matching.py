"""Invoice intake, three-way match, approval and the events that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.fixed_values import (
    DEFAULT_CURRENCY, DOLLAR_TOLERANCE, MISSING_AMOUNT_TEXT, MISSING_REFERENCE_TEXT,
    PAYMENT_TERMS_DAYS, PERCENT_TOLERANCE, RATE_NOT_FOUND_TEXT, WITHIN_TOLERANCE_TEXT,
)
from lanewise.functions import pricing, text, timing
from lanewise.operators.rates import RATE_KEY, price_list, total_rate
from lanewise.operators.skew import earliest


def expected_amounts(shipments: DataFrame, rates: DataFrame) -> DataFrame:
    """Contracted charge of each shipment: its carrier's active card on its lane, on its weight.

    Shipments without a card stay, with no expected amount.
    """
    lane_id = text.lane(F.col("origin_state"), F.col("dest_state"), F.col("shipment_type"))
    cards = price_list(rates).select(*RATE_KEY, "factor", "minimum_charge",
                                     F.lit(True).alias("has_card"))
    return (
        shipments.select("shipment_id", "carrier_id", lane_id.alias("lane_id"), "weight_lbs")
        .join(cards, RATE_KEY, "left")
        .select("shipment_id", F.lit(True).alias("shipment_found"),
                F.when(F.col("has_card"), total_rate().cast(pricing.MONEY))
                .alias("contract_amount"))
    )


def with_expected(invoices: DataFrame, shipments: DataFrame, rates: DataFrame) -> DataFrame:
    """Invoices with their contracted amount and whether their shipment is known.

    The shipment side has one row per shipment; a shipment with very many invoices is on the left
    of a left join, where adaptive execution can split it.
    """
    return (
        invoices.drop("expected_amount")
        .join(expected_amounts(shipments, rates), "shipment_id", "left")
        .withColumn("shipment_found", F.coalesce(F.col("shipment_found"), F.lit(False)))
        .withColumnRenamed("contract_amount", "expected_amount")
    )


def three_way_match(invoices: DataFrame, dollars: str = DOLLAR_TOLERANCE,
                    percent: str = PERCENT_TOLERANCE, now: Column | str | None = None) -> DataFrame:
    """Decide every invoice; needs ``expected_amount`` and ``shipment_found``.

    A close enough invoice is approved at the *expected* amount, at the time ``now``.  A missing
    shipment, rate or invoiced amount is disputed too, but leaves the row in status MATCHING without
    a dispute reason of its own; the decision is in ``match_outcome``, ``match_reason`` and
    ``match_description``.
    """
    invoices = _with_approval(invoices)
    invoiced, expected = F.col("invoiced_amount"), F.col("expected_amount")
    gap = pricing.discrepancy(invoiced, expected)
    percent_off = pricing.discrepancy_percent(invoiced, expected)
    reason = (
        F.when(~F.col("shipment_found"), "MISSING_REFERENCE")
        .when(expected.isNull(), "RATE_NOT_FOUND")
        .when(invoiced.isNull(), "MISSING_AMOUNT")
        .when(pricing.within_tolerance(invoiced, expected, dollars, percent),
              F.lit(None).cast("string"))
        .when(gap > 0, "OVERCHARGE").otherwise("UNDERCHARGE")
    )
    def money(amount: Column) -> Column:
        return amount.cast("string")
    differs = F.concat(
        F.lit("Invoice amount $"), money(invoiced), F.lit(" differs from expected $"),
        money(expected), F.lit(" by $"), money(F.abs(gap)), F.lit(" ("),
        F.round(F.abs(percent_off), 1).cast("decimal(18,1)").cast("string"), F.lit("%)"))
    why = (
        F.when(F.col("match_reason") == "MISSING_REFERENCE",
               F.concat(F.lit(MISSING_REFERENCE_TEXT),
                        F.coalesce(F.col("shipment_reference_number"), F.lit("null"))))
        .when(F.col("match_reason") == "RATE_NOT_FOUND",
              F.concat(F.lit("Could not find contracted rate for carrier "),
                       F.col("carrier_id")))
        .when(F.col("match_reason").isNull(),
              F.concat(F.lit(WITHIN_TOLERANCE_TEXT), money(F.abs(gap)), F.lit(")")))
        .otherwise(differs)
    )
    approved = F.col("match_reason").isNull()
    disputed = F.col("match_reason").isin("OVERCHARGE", "UNDERCHARGE")
    return (
        invoices.withColumn("match_reason", reason)
        .withColumn("match_description", why)
        .withColumns({
            "match_outcome": F.when(approved, "APPROVED").otherwise("DISPUTED"),
            "status": F.when(approved, "APPROVED").when(disputed, "DISPUTED")
                      .otherwise("MATCHING"),
            "auto_approved": F.when(approved, True).otherwise(F.col("auto_approved")),
            "approved_amount": F.when(approved, expected).otherwise(F.col("approved_amount")),
            "approved_at": F.when(approved, _moment(now)).otherwise(F.col("approved_at")),
            "dispute_reason": F.when(disputed, F.col("match_reason")),
            "dispute_description": F.when(disputed, F.col("match_description")),
        })
    )


def _with_approval(invoices: DataFrame) -> DataFrame:
    """Invoices with the approval columns of the declared schema."""
    missing = {name: F.lit(None).cast(kind) for name, kind in
               (("approved_at", "timestamp"), ("approved_by", "string"))
               if name not in invoices.columns}
    return invoices.withColumns(missing) if missing else invoices


def _moment(now: Column | str | None) -> Column:
    return (now if isinstance(now, Column) else F.lit(now)).cast("timestamp")


def match_on_delivery(delivered: DataFrame, invoices: DataFrame) -> DataFrame:
    """Match the invoices of shipments that were just delivered.

    ``delivered`` may be a stream; shipments without invoices simply give no rows.
    """
    told = delivered.select("shipment_id", F.lit(True).alias("shipment_found"))
    return three_way_match(told.join(invoices, "shipment_id"))


def attempted(delivered: DataFrame, invoices: DataFrame) -> DataFrame:
    """Match the invoices of delivered shipments one by one: ``error`` names what stopped an invoice.

    Amounts may be text, as they come from outside.  One that holds something else than an amount, or
    more than an amount's digits, stops its own invoice only: its decision columns are null.
    """
    amounts = [name for name in ("invoiced_amount", "expected_amount", "approved_amount")
               if name in invoices.columns]
    unread = [F.when(F.col(name).isNotNull() & F.col(name).try_cast(pricing.MONEY).isNull(), F.lit(name))
              for name in amounts]
    errors = F.array_compact(F.array(*unread)) if unread else F.array().cast("array<string>")
    read = invoices.withColumn("error", F.when(
        F.size(errors) > 0, F.concat(F.lit("no amount: "), F.array_join(errors, ","))))
    read = read.withColumns({name: F.col(name).try_cast(pricing.MONEY) for name in amounts})
    decided = match_on_delivery(delivered, read)
    kept = {*invoices.columns, "error", "shipment_found"}
    failed, by_name = F.col("error").isNotNull(), {f.name: f.dataType for f in decided.schema}
    before = {"status": F.lit("MATCHING"), "auto_approved": F.lit(False)}
    return decided.withColumns({
        name: F.when(~failed, F.col(name)).otherwise(
            before.get(name, F.lit(None).cast(by_name[name])))
        for name in decided.columns if name not in kept or name in before})


def invoice_events(matched: DataFrame) -> DataFrame:
    """Approved and disputed events of decided invoices, one row each."""
    approved = F.col("match_outcome") == "APPROVED"
    invoiced, expected = F.col("invoiced_amount"), F.col("expected_amount")
    return matched.select(
        F.when(approved, "InvoiceApprovedEvent").otherwise("InvoiceDisputedEvent")
        .alias("event_type"),
        "invoice_id", "invoice_number", "carrier_id", "carrier_name", "shipment_id",
        "shipment_reference_number",
        F.when(approved, F.col("approved_amount")).alias("approved_amount"),
        F.when(approved, F.col("currency")).alias("currency"),
        F.when(approved, F.col("gl_code")).alias("gl_code"),
        F.when(approved, F.col("invoice_date")).alias("invoice_date"),
        F.when(approved, F.col("payment_due_date")).alias("payment_due_date"),
        F.when(approved, F.col("auto_approved")).alias("auto_approved"),
        F.when(approved, F.col("approved_at")).alias("approved_at"),
        F.when(~approved, invoiced).alias("invoiced_amount"),
        F.when(~approved, expected).alias("expected_amount"),
        F.when(~approved, pricing.discrepancy(invoiced, expected)).alias("discrepancy_amount"),
        F.when(~approved, pricing.discrepancy_percent(invoiced, expected).cast("double"))
        .alias("discrepancy_percentage"),
        F.when(~approved, F.col("dispute_reason")).alias("dispute_reason"),
        F.when(~approved, F.col("dispute_description")).alias("dispute_description"))


def with_discrepancy_flag(invoices: DataFrame, threshold: str) -> DataFrame:
    return invoices.withColumn("has_discrepancy", pricing.exceeds(
        F.col("invoiced_amount"), F.col("expected_amount"), threshold))


def received(requests: DataFrame, terms_days: int = PAYMENT_TERMS_DAYS) -> DataFrame:
    """Requests as invoices: default currency, due date, status RECEIVED."""
    return requests.withColumns({
        "currency": F.coalesce(F.col("currency"), F.lit(DEFAULT_CURRENCY)),
        "status": F.lit("RECEIVED"),
        "payment_due_date": timing.payment_due(F.col("invoice_date"), terms_days),
    })


def first_per_number(requests: DataFrame, order: list[str]) -> DataFrame:
    """The first request of each invoice number, with how many came in for it."""
    others = [c for c in requests.columns if c != "invoice_number"]
    first = F.min_by(F.struct(*others), F.struct(*order)).alias("first")
    return (
        requests.groupBy("invoice_number").agg(first, F.count(F.lit(1)).alias("requests"))
        .select("invoice_number", "first.*", "requests")
    )


def take_in(requests: DataFrame, existing: DataFrame, order: list[str]) -> DataFrame:
    """Accepted invoices: number not known yet, and the first of its number in the batch."""
    fresh = first_per_number(requests, order).drop("requests")
    known = existing.select("invoice_number")
    return received(fresh.join(known, "invoice_number", "left_anti"))


def rejected_requests(requests: DataFrame, existing: DataFrame) -> DataFrame:
    """Per invoice number, how many requests are turned down and why."""
    known = existing.select("invoice_number").distinct().withColumn("known", F.lit(True))
    per_number = requests.groupBy("invoice_number").agg(F.count(F.lit(1)).alias("requests"))
    return (
        per_number.join(known, "invoice_number", "left")
        .select("invoice_number",
                F.when(F.col("known"), F.col("requests")).otherwise(F.col("requests") - 1)
                .alias("rejected"),
                F.when(F.col("known"), "ALREADY_EXISTS").otherwise("REPEATED_IN_BATCH")
                .alias("reason"))
        .filter(F.col("rejected") > 0)
    )


def exploded_lines(accepted: DataFrame) -> DataFrame:
    """Line items of accepted invoices, one row each."""
    return accepted.select("invoice_number", F.explode("line_items").alias("line")).select(
        "invoice_number", "line.*")


def line_rollup(lines: DataFrame) -> DataFrame:
    """Charges by type and GL code."""
    return lines.groupBy("charge_type", "gl_code").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum("quantity").cast("decimal(22,4)").alias("total_quantity"),
        F.sum("total_amount").cast("decimal(22,2)").alias("total_amount"))


def approve(invoices: DataFrame, approvals: DataFrame) -> DataFrame:
    """Approve by hand: full invoiced amount, whoever and whenever; from any status.

    ``approvals`` has ``invoice_id, approved_by, approved_at``; the earliest approval counts, and
    ``approved_now`` marks the invoices it concerns.  An invoice without an amount has nothing to
    approve and stays as it is.
    """
    chosen = earliest(approvals.select("invoice_id", "approved_at", "approved_by"),
                      ["invoice_id"], ["approved_at", "approved_by"]).select(
        "invoice_id", F.col("approved_at").alias("new_approved_at"),
        F.col("approved_by").alias("new_approved_by"))
    hit = F.col("approved_now")
    return (
        _with_approval(invoices).join(chosen, "invoice_id", "left")
        .withColumn("approved_now", F.col("new_approved_at").isNotNull()
                    & F.col("invoiced_amount").isNotNull())
        .withColumns({
            "status": F.when(hit, "APPROVED").otherwise(F.col("status")),
            "approved_amount": F.when(hit, F.col("invoiced_amount"))
            .otherwise(F.col("approved_amount")),
            "approved_at": F.when(hit, F.col("new_approved_at")).otherwise(F.col("approved_at")),
            "approved_by": F.when(hit, F.col("new_approved_by")).otherwise(F.col("approved_by")),
        })
        .drop("new_approved_at", "new_approved_by")
    )


def approval_events(approved: DataFrame) -> DataFrame:
    """The approved event of every invoice that ``approve`` has just approved."""
    now = approved.filter("approved_now").withColumns({
        "match_outcome": F.lit("APPROVED"), "dispute_reason": F.lit(None).cast("string"),
        "dispute_description": F.lit(None).cast("string")})
    return invoice_events(now)


def mark_paid(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """Mark as paid, from any status.  ``payments`` has ``invoice_id, paid_at``."""
    paid = payments.groupBy("invoice_id").agg(F.max("paid_at").alias("new_paid_at"))
    hit = F.col("new_paid_at").isNotNull()
    return (
        invoices.join(paid, "invoice_id", "left")
        .withColumn("status", F.when(hit, "PAID").otherwise(F.col("status")))
        .withColumn("paid_at", F.coalesce(F.col("new_paid_at"), F.col("paid_at")))
        .drop("new_paid_at")
    )
