"""Notification outbox: which mail each event would send, to whom, with which variables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions import text

# FIXED VALUES: template names and subjects per event type.  In a subject, {name} stands for the
# event field of that name.  Status changes send mail for two target statuses only.
TEMPLATES = {
    "ShipmentCreatedEvent": ("shipment-created", "Shipment {referenceNumber} Created Successfully"),
    "ShipmentStatusChangedEvent/IN_TRANSIT": (
        "shipment-in-transit", "Your Shipment {referenceNumber} is In Transit"),
    "ShipmentStatusChangedEvent/OUT_FOR_DELIVERY": (
        "shipment-out-for-delivery",
        "Your Shipment {referenceNumber} is Out for Delivery Today!"),
    "ShipmentDeliveredEvent": (
        "shipment-delivered", "Shipment {referenceNumber} Delivered Successfully"),
    "InvoiceApprovedEvent": ("invoice-approved", "Invoice {invoiceNumber} Approved for Payment"),
    "InvoiceDisputedEvent": (
        "invoice-disputed", "ACTION REQUIRED: Invoice {invoiceNumber} Disputed — {disputeReason}"),
    "CarrierRateUpdatedEvent": (
        "carrier-rate-updated", "Carrier Rate Update: {carrierName} — {laneId}"),
}
RECIPIENTS = {
    "ShipmentCreatedEvent": ["shipperEmail"],
    "ShipmentStatusChangedEvent": ["shipperEmail", "consigneeEmail"],
    "ShipmentDeliveredEvent": ["shipperEmail", "consigneeEmail"],
    "InvoiceApprovedEvent": ["apTeamEmail"],
    "InvoiceDisputedEvent": ["apTeamEmail", "carrierRelationsEmail"],
    "CarrierRateUpdatedEvent": ["procurementTeamEmail"],
}
VARIABLES = {
    "ShipmentCreatedEvent": [
        "shipmentId", "referenceNumber", "shipperName", "originCity", "destinationCity",
        "carrierName", "estimatedDelivery", "weightLbs", "trackingUrl"],
    "ShipmentStatusChangedEvent": [
        "shipmentId", "referenceNumber", "newStatus", "location", "statusReason", "trackingUrl"],
    "ShipmentDeliveredEvent": [
        "shipmentId", "referenceNumber", "carrierName", "deliveredAt", "deliveryLocation",
        "recipientName", "onTime", "daysVariance", "trackingUrl"],
    "InvoiceApprovedEvent": [
        "invoiceId", "invoiceNumber", "carrierName", "shipmentReferenceNumber", "approvedAmount",
        "currency", "glCode", "paymentDueDate", "autoApproved", "invoiceUrl"],
    "InvoiceDisputedEvent": [
        "invoiceId", "invoiceNumber", "carrierName", "shipmentReferenceNumber", "invoicedAmount",
        "expectedAmount", "discrepancyAmount", "discrepancyPercentage", "disputeReason",
        "disputeDescription", "invoiceUrl"],
    "CarrierRateUpdatedEvent": [
        "carrierName", "laneId", "originRegion", "destinationRegion", "previousRate", "newRate",
        "changePercentage", "rateIncreased", "effectiveDate"],
}


STATUS_CHANGED = "ShipmentStatusChangedEvent"
LINKS = {"trackingUrl": "shipmentId", "invoiceUrl": "invoiceId"}
DERIVED = {"trackingUrl", "invoiceUrl", "rateIncreased"}


def event_schema() -> str:
    """All event fields a mail can need, as text."""
    names = {"changePercentage", *LINKS.values()}
    for fields in (*VARIABLES.values(), *RECIPIENTS.values()):
        names.update(set(fields) - DERIVED)
    return ", ".join(f"{name} string" for name in sorted(names))


def _subject(event: Column, pattern: str) -> Column:
    """The pattern with its {fields} filled; a missing field shows as ``null``."""
    parts: list[Column] = []
    for piece in pattern.split("{"):
        name, closed, rest = piece.partition("}")
        if closed:
            parts.append(F.coalesce(event[name], F.lit("null")))
            parts.append(F.lit(rest))
        else:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def _variable(event: Column, kind: str, name: str, base_url: str) -> Column:
    if name == "trackingUrl":
        return text.tracking_url(base_url, event[LINKS[name]])
    if name == "invoiceUrl":
        return text.invoice_url(base_url, event[LINKS[name]])
    if name == "carrierName" and kind == "ShipmentCreatedEvent":
        return F.coalesce(event[name], F.lit("TBD"))
    if name == "rateIncreased":
        return (event["changePercentage"].try_cast("double") > 0).cast("string")
    if name in ("changePercentage", "discrepancyPercentage"):
        return F.abs(event[name].try_cast("double")).cast("string")
    return event[name]


def outbox(events: DataFrame, base_url: str, message: str = "message",
           kind: str = "body_event_type") -> DataFrame:
    """One row per mail an event calls for.  Events without a mail give no row.

    ``recipients`` holds the addresses that are neither missing nor blank; without any the mail is
    not deliverable, but stays listed.
    """
    event, named = F.col("event"), F.col(kind)
    # Only this one field decides whether there is a mail, so it is read before the full parse.
    new_status = F.get_json_object(F.col(message), "$.newStatus")
    case = F.when(named == STATUS_CHANGED, F.concat(named, F.lit("/"), new_status)
                  ).otherwise(named)
    template, subject, recipients, variables = F, F, F, F
    for name, (template_name, pattern) in TEMPLATES.items():
        template = template.when(F.col("mail_case") == name, template_name)
        subject = subject.when(F.col("mail_case") == name, _subject(event, pattern))
    for name, fields in RECIPIENTS.items():
        recipients = recipients.when(named == name, F.array(*[event[f] for f in fields]))
        pairs = [x for v in VARIABLES[name]
                 for x in (F.lit(v), _variable(event, name, v, base_url))]
        variables = variables.when(named == name, F.create_map(*pairs))
    usable = F.filter(recipients, lambda a: F.coalesce(~a.rlike(r"^\s*$"), F.lit(False)))
    kept = [c for c in events.columns if c not in (message, "body", "readable")]
    return (
        events.filter(named.isin(list(RECIPIENTS)))
        .withColumn("mail_case", case)
        .filter(F.col("mail_case").isin(list(TEMPLATES)))
        .withColumn("event", F.from_json(F.col(message), event_schema()))
        .select(*kept, template.alias("template"), subject.alias("subject"),
                usable.alias("recipients"), variables.alias("variables"))
        .withColumn("is_deliverable", F.size("recipients") > 0)
    )
