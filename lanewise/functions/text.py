"""Identifiers, object keys, links and display text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.fixed_values import (
    CONTENT_TYPES_INDEXER, CONTENT_TYPES_UPLOAD, DEFAULT_CONTENT_TYPE, INVOICE_PREFIX,
    OCR_EXTENSIONS,
)


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def lane(origin: Column, destination: Column, shipment_type: Column | None = None) -> Column:
    """``O-D`` for spend, ``O-D-TYPE`` for rate cards; NULL if a part is NULL."""
    parts = [origin, F.lit("-"), destination]
    if shipment_type is not None:
        parts += [F.lit("-"), shipment_type]
    return F.concat(*parts)


def clean_id(value: Column) -> Column:
    """Keep only letters, digits, underscore and hyphen."""
    return F.regexp_replace(value, "[^a-zA-Z0-9_-]", "")


def place(city: Column, state: Column) -> Column:
    return F.concat(city, F.lit(", "), state)


def object_key(document_type: Column, shipment_id: Column, document_id: Column,
               extension: Column) -> Column:
    file_name = F.concat(document_id, F.lit("."), extension)
    return F.concat_ws("/", F.lower(document_type), shipment_id, file_name)


def split_file_name(file_name: Column) -> tuple[Column, Column]:
    """Stem and extension, cut at the last dot; no dot means no extension."""
    dotted = F.contains(file_name, F.lit("."))
    stem = F.when(dotted, F.regexp_extract(file_name, r"(?s)^(.*)\.([^.]*)$", 1))
    extension = F.when(dotted, F.regexp_extract(file_name, r"(?s)^(.*)\.([^.]*)$", 2))
    return stem.otherwise(file_name), extension.otherwise(F.lit(""))


def content_type(extension: Column, table: str = "indexer") -> Column:
    """The indexer knows TIFF; the upload side does not."""
    known = {"indexer": CONTENT_TYPES_INDEXER, "upload": CONTENT_TYPES_UPLOAD}[table]
    found = F.try_element_at(literal_map(known), F.lower(extension))
    return F.coalesce(found, F.lit(DEFAULT_CONTENT_TYPE))


def is_invoice_document(key: Column) -> Column:
    return F.startswith(F.lower(key), F.lit(INVOICE_PREFIX)) & key.rlike("(?i)" + OCR_EXTENSIONS)


def tracking_url(base_url: str, shipment_id: Column) -> Column:
    return F.concat(F.lit(base_url), F.lit("/shipments/"), shipment_id, F.lit("/tracking"))


def invoice_url(base_url: str, invoice_id: Column) -> Column:
    return F.concat(F.lit(base_url), F.lit("/invoices/"), invoice_id)


def show_money(amount: Column) -> Column:
    """``$1,234.50``."""
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def show_date(moment: Column) -> Column:
    """``Mar 5, 2024``."""
    return F.date_format(moment, "MMM d, yyyy")


def show_percent(percent: Column) -> Column:
    """``16.7%``, half up."""
    return F.concat(F.format_number(F.round(percent, 1), 1), F.lit("%"))


def or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))
