"""The life cycle in event time: requests wait for the watermark, so their order of arrival is of no matter."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lanewise.fixed_values import TRANSITIONS

REQUEST = ("event_id string, at_micros bigint, requested_status string, start_status string")
JUDGED = ("shipment_id string, event_id string, ts timestamp, requested_status string, "
          "old_status string, new_status string, accepted boolean, late boolean")
COLUMNS = ["shipment_id", "event_id", "ts", "requested_status", "old_status", "new_status",
           "accepted", "late"]
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


class OrderedStatusProcessor(StatefulProcessor):
    """Keeps a shipment's status and the requests that the watermark has not passed yet.

    A request goes to a list in state; one timer waits for the earliest of them.  When the watermark has
    passed it, all waiting requests up to the watermark are judged, in ``(ts, event_id)`` order: what was
    judged is final, because nothing older can come in any more.  A request that is older than the
    watermark when it comes in is late: it changes nothing and goes out marked.

    ``keep_days`` drops a shipment's status so long after its last request (0: never), so that state
    does not grow for ever; a later request then starts from the shipment's own status again.
    """

    def __init__(self, keep_days: int = 0):
        self.keep_millis = keep_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string, until bigint")
        self.waiting = handle.getListState("waiting", REQUEST)
        self.timer = handle.getValueState("timer", "millis bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, late, waiting = timerValues.getCurrentWatermarkInMs(), [], []
        for row in rows:
            micros, wanted = row["at_micros"], row["requested_status"]
            if -(-micros // 1000) < watermark:  # never before the request's own time
                late.append((key[0], row["event_id"], _moment(micros), wanted, None, None, False, True))
            else:
                waiting.append((row["event_id"], micros, wanted, row["start_status"]))
        if waiting:
            self.waiting.appendList(waiting)
            timer = self.timer.get()
            self._wait_for(waiting, timer[0] if timer else None)
        yield from map(_judged, late)

    def _wait_for(self, requests: list[tuple], set_to: int | None) -> None:
        """A timer for the earliest request, unless there is one already that is no later."""
        millis = min(-(-r[1] // 1000) for r in requests)
        if set_to is None or millis < set_to:
            self.handle.registerTimer(millis)
            self.timer.update((millis,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        due, later = [], []
        for request in self.waiting.get():
            (due if -(-request[1] // 1000) <= watermark else later).append(tuple(request))
        held = self.status.get()
        if not due:
            if held and self.keep_millis and held[1] <= watermark:
                self.status.clear()
            return
        self.waiting.clear()
        self.timer.clear()
        if later:
            self.waiting.put(later)
            self._wait_for(later, None)
        (now, until), judged = held or (None, 0), []
        for event_id, micros, wanted, start in sorted(due, key=lambda r: (r[1], r[0])):
            millis = -(-micros // 1000)
            before = now if now and (not self.keep_millis or millis <= until) else start
            now = wanted if wanted in TRANSITIONS.get(before, []) else before
            until = millis + self.keep_millis
            judged.append((key[0], event_id, _moment(micros), wanted, before, now, before != now,
                           False))
        if now is not None:
            self.status.update((now, until))
        if self.keep_millis:
            self.handle.registerTimer(until)
        yield from map(_judged, judged)

    def close(self) -> None:
        pass


def _moment(micros: int) -> datetime:
    return EPOCH + timedelta(microseconds=micros)


def _judged(values: tuple) -> Row:
    return Row(**dict(zip(COLUMNS, values)))


# Workers get this module with the plan, so that they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def replay_in_order(requests: DataFrame, lateness: str, keep_days: int = 0) -> DataFrame:
    """Status requests of a stream, judged in event time whatever order they come in.

    Needs ``shipment_id, event_id, ts, requested_status, start_status``; ``lateness`` is how far behind
    the newest request one may be.  Every request comes out once, with its verdict when the watermark has
    passed it, or at once with ``late`` set and no verdict.  The time goes into state as a number, which
    also keeps Spark from dropping late rows before they can be told.
    """
    timed = requests.withWatermark("ts", lateness).select(
        "shipment_id", F.col("event_id").cast("string").alias("event_id"),
        F.unix_micros("ts").alias("at_micros"), "requested_status", "start_status")
    return timed.groupBy("shipment_id").transformWithState(
        statefulProcessor=OrderedStatusProcessor(keep_days), outputStructType=JUDGED,
        outputMode="Append", timeMode="EventTime")
