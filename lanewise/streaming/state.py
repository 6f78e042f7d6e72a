"""Keyed shipment state: the life cycle as a stateful stream operator."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from lanewise.fixed_values import TRANSITIONS

VERDICT = [StructField("old_status", StringType()), StructField("new_status", StringType()),
           StructField("accepted", BooleanType())]


class StatusProcessor(StatefulProcessor):
    """Keeps one status per shipment and judges every request against it.

    The requests of one micro-batch are applied in ``(ts, event_id)`` order, micro-batches as they
    come.  State is a single value; what a busy shipment holds at a time is bounded by the source's
    limit per trigger.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.status.get()[0] if self.status.exists() else None
        batch = pd.concat(rows).sort_values(["ts", "event_id"], kind="stable")
        old, new = [], []
        for start, wanted in zip(batch["start_status"], batch["requested_status"]):
            now = now or (start if isinstance(start, str) else None)
            old.append(now)
            now = wanted if wanted in TRANSITIONS.get(now, []) else now
            new.append(now)
        if now is not None:
            self.status.update((now,))
        verdict = batch.assign(old_status=old, new_status=new)
        yield verdict.assign(accepted=verdict["old_status"] != verdict["new_status"])

    def close(self) -> None:
        pass


# Workers get this module with the plan, so that they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def replay_stream(requests: DataFrame) -> DataFrame:
    """The streaming form of ``lifecycle.replay``; needs ``start_status`` for unseen shipments."""
    schema = StructType([*requests.schema.fields, *VERDICT])
    return requests.groupBy("shipment_id").transformWithStateInPandas(
        statefulProcessor=StatusProcessor(), outputStructType=schema, outputMode="Append",
        timeMode="None")
