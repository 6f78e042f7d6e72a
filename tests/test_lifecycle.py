"""The state machine against a plain loop, for ordinary and for hot shipments."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanewise.fixed_values import SHIPMENT_STATUSES, TRANSITIONS
from lanewise.functions import status, timing
from lanewise.operators import lifecycle

SCHEMA = "shipment_id string, event_id bigint, ts timestamp, requested_status string, note string"
START = datetime(2024, 1, 1)


def loop(rows, start="CARRIER_ASSIGNED"):
    """Brute force: every shipment's requests one after the other."""
    now, out = {}, []
    for s, e, ts, wanted, note in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        old = now.get(s, start)
        ok = wanted in TRANSITIONS[old]
        now[s] = wanted if ok else old
        out.append((s, e, old, now[s], ok, note))
    return sorted(out)


def random_requests(seed, hot_rows, others):
    rng = random.Random(seed)
    rows, event = [], 0
    # Time stamps repeat on purpose; the event id decides then.
    for shipment, n in [("hot", hot_rows), ("warm", hot_rows // 3)] + [
            (f"s{i}", rng.randint(1, 30)) for i in range(others)]:
        for _ in range(n):
            event += 1
            rows.append((shipment, event, START + timedelta(minutes=rng.randint(0, n)),
                         rng.choice(SHIPMENT_STATUSES[1:6]), f"n{event}"))
    rng.shuffle(rows)
    return rows


def replayed(spark, rows, **options):
    got = lifecycle.replay(spark.createDataFrame(rows, SCHEMA), **options)
    return sorted((r.shipment_id, r.event_id, r.old_status, r.new_status, r.accepted, r.note)
                  for r in got.collect())


@pytest.mark.parametrize("unit", ["minute", "hour", "day", "year"])
def test_replay_equals_loop(spark, unit):
    rows = random_requests(5, 2000, 40)
    assert replayed(spark, rows, unit=unit) == loop(rows)


def test_requests_without_time_come_first(spark):
    rows = [("a", 2, START, "IN_TRANSIT", ""), ("a", 1, None, "PICKED_UP", "")]
    assert [r[4] for r in replayed(spark, rows)] == [True, True]


def test_edges(spark):
    day = START
    rows = [
        ("a", 1, day, "PICKED_UP", ""), ("a", 2, day, "PICKED_UP", ""),       # repeat
        ("a", 3, day, "DELIVERED", ""),                                          # jump
        ("a", 4, day, "IN_TRANSIT", ""), ("a", 5, day, "EXCEPTION", ""),
        ("a", 6, day, "IN_TRANSIT", ""), ("a", 7, day, "OUT_FOR_DELIVERY", ""),
        ("a", 8, day, "DELIVERED", ""), ("a", 9, day, "IN_TRANSIT", ""),       # after the end
        ("b", 1, day, "CANCELLED", ""), ("b", 2, day, "PICKED_UP", ""),
    ]
    got = replayed(spark, rows)
    assert [r[4] for r in got] == [True, False, False, True, True, True, True, True, False,
                                   True, False]
    assert got[8][3] == "DELIVERED" and got[-1][3] == "CANCELLED"


def test_start_status_of_the_shipment(spark):
    rows = [("a", 1, START, "CARRIER_ASSIGNED", ""), ("b", 1, START, "CARRIER_ASSIGNED", "")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn(
        "start_status", F.when(F.col("shipment_id") == "a", "CREATED").otherwise("DELIVERED"))
    got = {r.shipment_id: r.accepted for r in lifecycle.replay(df).collect()}
    assert got == {"a": True, "b": False}


def test_transition_expressions(spark):
    pairs = [(a, b) for a in SHIPMENT_STATUSES for b in SHIPMENT_STATUSES]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", status.may_move(F.col("a"), F.col("b")).alias("ok"),
        status.is_terminal(F.col("a")).alias("end"))
    for r in df.collect():
        assert r.ok == (r.b in TRANSITIONS[r.a])
        assert r.end == (not TRANSITIONS[r.a])


def test_variance_and_lateness(spark):
    hours = [(None, 0), (-25, -1), (23, 0), (24, 1), (49, 2)]  # promised minus actual
    rows = [(None if h is None else START + timedelta(hours=h), START, want) for h, want in hours]
    df = spark.createDataFrame(rows, "promised timestamp, actual timestamp, want int")
    got = df.select("want", timing.days_variance(F.col("actual"), F.col("promised")).alias("got"))
    assert all(r.want == r.got for r in got.collect())
    late = spark.createDataFrame([(START + timedelta(hours=5), START + timedelta(hours=1)),
                                  (START, None), (None, START)],
                                 "actual timestamp, promised timestamp")
    both = late.select(timing.on_time(F.col("actual"), F.col("promised")),
                       timing.on_time(F.col("actual"), F.col("promised"), "date")).collect()
    assert [tuple(r) for r in both] == [(False, True), (False, False), (False, False)]


def test_reference_numbers_are_dense_and_unique(spark):
    rows = [(f"s{i}", START + timedelta(minutes=i % 3000)) for i in range(5000)]
    df = spark.createDataFrame(rows, "shipment_id string, created_at timestamp")
    got = lifecycle.reference_numbers(df, "SH").collect()
    by_day = {}
    for r in got:
        _, day, number = r.reference_number.split("-")
        by_day.setdefault(day, []).append(int(number))
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in by_day.values())
    assert sum(map(len, by_day.values())) == 5000
