"""Per-minute counters and timers, log filters and threshold alarms.

The aggregations work on batch and streaming input alike; a stream should carry a watermark on
``ts``.  Alarms look at several periods at once and run on the finished per-period rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.fixed_values import ERROR_LOG_LINES, METRIC_STEP
from lanewise.operators import skew


def samples(rows: DataFrame, ts: str, metric: str, value: Column | int = 1,
            **tags: Column) -> DataFrame:
    """Rows as metric samples: time, name, tags, value."""
    pairs = [x for name, tag in tags.items() for x in (F.lit(name), tag.cast("string"))]
    tag_map = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    amount = value if isinstance(value, Column) else F.lit(value)
    return rows.select(F.col(ts).alias("ts"), F.lit(metric).alias("metric"),
                       tag_map.alias("tags"), amount.cast("bigint").alias("value"))


def with_common_tags(metric_samples: DataFrame, service: str, environment: str) -> DataFrame:
    """The two tags that every metric of a service carries; a sample's own tag of that name wins."""
    common = F.create_map(F.lit("service"), F.lit(service), F.lit("environment"),
                          F.lit(environment))
    missing = F.map_filter(common, lambda k, v: ~F.array_contains(F.map_keys("tags"), k))
    return metric_samples.withColumn("tags", F.map_concat("tags", missing))


def email_samples(attempts: DataFrame, ts: str = "ts") -> DataFrame:
    """One sample per attempt to send a mail; ``failed`` tells whether it went wrong.

    Mails without a usable recipient are not attempted and count as neither.
    """
    tried = attempts.filter("is_deliverable")
    return samples(tried.filter("NOT failed"), ts, "email.sent.count").unionByName(
        samples(tried.filter("failed"), ts, "email.failure.count"))


def tag_text(tags: Column) -> Column:
    """Tags as ``a=1,b=2`` in key order, which can be grouped by."""
    entries = F.array_sort(F.map_entries(tags))
    shown = F.transform(entries, lambda e: F.concat(
        e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null"))))
    return F.array_join(shown, ",")


def counters(metric_samples: DataFrame, step: str = METRIC_STEP) -> DataFrame:
    """Counter value per step, metric and tag set."""
    tagged = metric_samples.withColumn("tags", tag_text(F.col("tags")))
    return (
        tagged.groupBy(F.window("ts", step).alias("period"), "metric", "tags")
        .agg(F.sum("value").alias("value"))
        .select(F.col("period.start").alias("period_start"), "metric", "tags", "value")
    )


def timers(rows: DataFrame, duration: str, by: list[str], step: str = METRIC_STEP) -> DataFrame:
    """Count, sum and maximum of a duration per step."""
    return (
        rows.groupBy(F.window("ts", step).alias("period"), *by)
        .agg(F.count(duration).alias("count"), F.sum(duration).alias("sum"),
             F.max(duration).alias("max"))
        .select(F.col("period.start").alias("period_start"), *by, "count", "sum", "max")
    )


def error_lines(logs: DataFrame) -> DataFrame:
    return logs.filter(F.startswith(F.col("level"), F.lit("ERROR")))


def latest_errors(logs: DataFrame, lines: int = ERROR_LOG_LINES) -> DataFrame:
    """The newest error lines, as a top-k."""
    return error_lines(logs).orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(lines)


def period_statistic(rows: DataFrame, value: str, by: list[str], statistic: str,
                     step: str = METRIC_STEP) -> DataFrame:
    """``average``, ``sum`` or ``p99`` of a value per step.

    p99 is the smallest value that 99 % of the samples do not exceed.  Samples are first counted per
    value, so the step that looks at a whole period sees different values only.
    """
    periods = rows.select(F.window("ts", step)["start"].alias("period_start"), *by, value)
    keys = ["period_start", *by]
    if statistic == "average":
        return periods.groupBy(*keys).agg(
            F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))
            .alias("statistic"))
    if statistic == "sum":
        return periods.groupBy(*keys).agg(F.sum(value).cast("double").alias("statistic"))
    if statistic != "p99":
        raise ValueError(f"unknown statistic {statistic!r}")
    histogram = (periods.filter(F.col(value).isNotNull())
                 .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n")))
    running = Window.partitionBy(*keys).orderBy(value)
    whole = Window.partitionBy(*keys)
    reached = F.sum("n").over(running) * 100 >= F.sum("n").over(whole) * 99
    return (
        histogram.withColumn("reached", reached).filter("reached")
        .groupBy(*keys).agg(F.min(value).cast("double").alias("statistic"))
    )


def seconds_of(step: str) -> int:
    """A step such as ``1 minute`` in seconds."""
    number, unit = step.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600}[unit.rstrip("s")]


def threshold_alarm(statistics: DataFrame, by: list[str], threshold: float, periods: int = 2,
                    step: str = METRIC_STEP, missing: str = "not_breaching") -> DataFrame:
    """``in_alarm`` per period: the statistic met the threshold ``periods`` times in a row.

    A period without data ends a run when ``missing="not_breaching"`` and is passed over when
    ``missing="missing"``.  Every series has one row per period.

    A breaching period counts towards itself and the ``periods - 1`` after it, so the runs come out of
    an aggregation by period: no task holds a series' whole history.
    """
    if missing == "not_breaching":
        placed = statistics.withColumn(
            "at", F.unix_timestamp(F.col("period_start").cast("timestamp")))
        apart = seconds_of(step)
    elif missing == "missing":
        placed = skew.numbered(statistics, by, ["period_start"]).withColumnRenamed("ordinal", "at")
        apart = 1
    else:
        raise ValueError(f"unknown missing-data rule {missing!r}")
    placed = placed.withColumn("breaching", (F.col("statistic") >= threshold).cast("int"))
    reached = F.sequence(F.col("at"), F.col("at") + (periods - 1) * apart, F.lit(apart).cast("bigint"))
    counted = placed.withColumn("towards", F.explode(
        F.when(F.col("breaching") == 1, reached).otherwise(F.array("at"))))
    own = F.col("towards") == F.col("at")
    row = F.struct("period_start", "statistic", "breaching")
    return (
        counted.groupBy(*by, "towards")
        .agg(F.max(F.when(own, row)).alias("own"), F.sum("breaching").alias("breaches"))
        .filter(F.col("own").isNotNull())
        .select("own.period_start", *by, "own.statistic", (F.col("own.breaching") == 1).alias("breaching"),
                (F.col("breaches") == periods).alias("in_alarm"))
    )


def composite_alarm(alarms: list[DataFrame]) -> DataFrame:
    """In alarm in every period in which one of the alarms is."""
    states = [a.select("period_start", "in_alarm") for a in alarms]
    stacked = states[0]
    for more in states[1:]:
        stacked = stacked.unionByName(more)
    return stacked.groupBy("period_start").agg(F.bool_or("in_alarm").alias("in_alarm"))
