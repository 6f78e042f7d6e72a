"""Message bodies: envelopes, event types, JSON form and webhook signatures."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.fixed_values import ENVELOPE_MARK, UNKNOWN_CORRELATION

# Dates travel as ISO-8601 text, never as epoch numbers.
JSON_OPTIONS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]'Z'",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
    "dateFormat": "yyyy-MM-dd",
}


def unwrap(body: Column) -> Column:
    """The inner message of a topic notification; any other body as it is."""
    wrapped = F.contains(body, F.lit(ENVELOPE_MARK))
    return F.when(wrapped, F.get_json_object(body, "$.Message")).otherwise(body)


def event_type(body: Column) -> Column:
    return F.coalesce(F.get_json_object(body, "$.eventType"), F.lit(""))


def to_body(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields), JSON_OPTIONS)


def correlation_or_unknown(correlation_id: Column) -> Column:
    return F.coalesce(correlation_id, F.lit(UNKNOWN_CORRELATION))


def signing_pads(secret: str) -> tuple[bytes, bytes]:
    """Inner and outer HMAC-SHA256 pads of a secret (RFC 2104)."""
    key = secret.encode()
    if len(key) > 64:
        key = hashlib.sha256(key).digest()
    key = key.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def signature(body: Column, inner_pad: Column, outer_pad: Column) -> Column:
    """``sha256=<hex>`` over the body, from the two pads, all in the JVM."""
    inner = F.unhex(F.sha2(F.concat(inner_pad, body.cast("binary")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(outer_pad, inner), 256))
