"""Status codes and the shipment state machine as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.fixed_values import CARRIER_STATUS_CODES, TERMINAL_STATUSES, TRANSITIONS
from lanewise.functions.text import literal_map


def shipment_status(carrier_code: Column) -> Column:
    """Shipment status a carrier code stands for; NULL for codes that change nothing."""
    return F.try_element_at(literal_map(CARRIER_STATUS_CODES), F.upper(carrier_code))


def may_move(current: Column, requested: Column) -> Column:
    steps = [f"{a}>{b}" for a, targets in TRANSITIONS.items() for b in targets]
    return F.coalesce(F.concat(current, F.lit(">"), requested).isin(steps), F.lit(False))


def next_status(current: Column, requested: Column) -> Column:
    """The status after a request: the requested one if allowed, otherwise unchanged."""
    return F.when(may_move(current, requested), requested).otherwise(current)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL_STATUSES)
