"""Threshold alarms on a stream: runs of breaching periods in state, periods without data closed by timers."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lanewise.operators.metrics import METRIC_STEP, seconds_of


class Alarm(NamedTuple):
    """In alarm when ``statistic`` meets ``threshold`` in ``periods`` periods in a row."""
    statistic: str
    threshold: float
    periods: int = 2


def statistic(name: str, value: str) -> Column:
    """The aggregates of ``metrics.period_statistic`` in one grouping, which a stream can hold."""
    if name == "average":
        return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
    if name == "sum":
        return F.sum(value).cast("double")
    if name == "p99":
        return F.expr(f"percentile_disc(0.99) WITHIN GROUP (ORDER BY `{value}`)").cast("double")
    raise ValueError(f"unknown statistic {name!r}")


class AlarmProcessor(StatefulProcessor):
    """Keeps the last closed period of one series and alarm, and how many breached up to it in a row.

    Periods come in when the watermark has closed them.  A timer waits for the end of the period after
    the last one: if that has no data by then, it is told as such, the run ends and the state goes, so a
    series that falls silent keeps none.  With ``passed_over`` a run goes on after a gap instead.
    """

    def __init__(self, by: int, step: int, passed_over: bool):
        self.by, self.step, self.passed_over = by, step, passed_over

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at bigint, run bigint")

    def _timer(self, at: int) -> int:
        return (at + 2 * self.step) * 1000

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        closed = sorted(row for batch in rows for row in zip(
            batch["at"], batch["statistic"], batch["threshold"], batch["periods"]))
        last, run = self.last.get() if self.last.exists() else (None, 0)
        if last is not None and not self.passed_over:
            self.handle.deleteTimer(self._timer(last))
        out = []
        for at, value, threshold, periods in closed:
            at = int(at)
            if last is not None and at > last + self.step and not self.passed_over:
                out.append(self._without_data(key, last))
                run = 0
            breaching = bool(value >= threshold)
            last, run = at, run + 1 if breaching else 0
            out.append((*key, at, float(value), breaching, run >= int(periods)))
        self.last.update((last, run))
        if not self.passed_over:
            self.handle.registerTimer(self._timer(last))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _ = self.last.get()
        self.last.clear()
        yield self._frame([self._without_data(key, last)])

    def _without_data(self, key: tuple, last: int) -> tuple:
        return (*key, last + self.step, None, False, False)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [f"by{i}" for i in range(self.by)]
        return pd.DataFrame(rows, columns=[*names, "alarm", "at", "statistic", "breaching", "in_alarm"])

    def close(self) -> None:
        pass


# Workers get this module with the plan, so that they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def live_alarms(rows: DataFrame, value: str, by: list[str], alarms: dict[str, Alarm], lateness: str,
                step: str = METRIC_STEP, missing: str = "not_breaching") -> DataFrame:
    """The alarms of ``metrics.threshold_alarm`` over a stream with a time ``ts``.

    Every period is told once, when the watermark has passed its end: ``period_start``, ``by``,
    ``alarm``, ``statistic``, ``breaching``, ``in_alarm``.  With ``missing="not_breaching"`` the first period
    without data after one with data is told too, without a statistic.  Rows whose ``ts`` is older than
    the watermark are left out, as are null values: a period that has only those has no data.  The rows of
    a period are combined before the shuffle; what goes to state is one row per period and alarm.
    """
    if missing not in ("not_breaching", "missing"):
        raise ValueError(f"unknown missing-data rule {missing!r}")
    wanted = sorted({a.statistic for a in alarms.values()})
    periods = (
        rows.filter(F.col(value).isNotNull()).withWatermark("ts", lateness)
        .groupBy(F.window("ts", step).alias("period"), *by)
        .agg(*[statistic(name, value).alias(name) for name in wanted])
    )
    kinds = [periods.schema[name].dataType.simpleString() for name in by]
    asked = F.explode(F.array(*[
        F.struct(F.lit(name).alias("alarm"), F.col(a.statistic).alias("statistic"),
                 F.lit(float(a.threshold)).alias("threshold"), F.lit(a.periods).alias("periods"))
        for name, a in alarms.items()]))
    series = periods.select(
        F.unix_seconds(F.col("period")["start"]).alias("at"),
        *[F.col(name).alias(f"by{i}") for i, name in enumerate(by)], asked.alias("a"),
    ).select("at", *[f"by{i}" for i in range(len(by))], "a.*")
    told = series.groupBy(*[f"by{i}" for i in range(len(by))], "alarm").transformWithStateInPandas(
        statefulProcessor=AlarmProcessor(len(by), seconds_of(step), missing == "missing"),
        outputStructType=", ".join([*(f"by{i} {kind}" for i, kind in enumerate(kinds)),
                                    "alarm string, at bigint, statistic double, breaching boolean, "
                                    "in_alarm boolean"]),
        outputMode="Append", timeMode="EventTime")
    return told.select(F.timestamp_seconds("at").alias("period_start"),
                       *[F.col(f"by{i}").alias(name) for i, name in enumerate(by)],
                       "alarm", "statistic", "breaching", "in_alarm")
