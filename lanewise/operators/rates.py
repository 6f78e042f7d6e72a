"""Rate cards: quotes, refresh, history and fallback."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.fixed_values import RATE_CARDS, RATE_EVENT
from lanewise.functions import messages, pricing, text
from lanewise.operators import price_order
from lanewise.operators.skew import latest, previous_value

CARD = ["rate_per_cwt", "fuel_surcharge_percent", "minimum_charge"]
RATE_KEY = ["carrier_id", "lane_id"]
WEIGHTS_PER_CUT = 10_000
BIN_DAYS = 64


def active(rates: DataFrame) -> DataFrame:
    return rates.filter(F.col("active"))


def price_list(rates: DataFrame, *columns: str) -> DataFrame:
    """Active cards with their price factor, worked out once per card and not once per quote."""
    factor = pricing.charge_factor(F.col("rate_per_cwt"), F.col("fuel_surcharge_percent"))
    return active(rates).select("lane_id", "carrier_id", *columns, factor.alias("factor"),
                                "minimum_charge")


def total_rate() -> Column:
    return pricing.charge(F.col("weight_lbs"), F.col("factor"), F.col("minimum_charge"))


def quote_requests(shipments: DataFrame) -> DataFrame:
    """The different (lane, weight) pairs asked for: shipments that agree on both share a quote."""
    lane_id = text.lane(F.col("origin_state"), F.col("dest_state"), F.col("shipment_type"))
    return shipments.select(lane_id.alias("lane_id"), "weight_lbs").distinct()


def _cut(requests: DataFrame, cards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Different (lane, weight) pairs and cards, each with the cut of its lane where they meet.

    Few input bytes make many output rows here, so a lane is cut by its measured number of weights:
    ``WEIGHTS_PER_CUT`` of them meet one copy of the lane's cards.  Only lanes with more than that are
    listed, so the list has at most one row per ``WEIGHTS_PER_CUT`` pairs and is broadcast.
    """
    asked = requests.select("lane_id", "weight_lbs").filter(F.col("lane_id").isNotNull()).distinct()
    hot = F.broadcast(asked.groupBy("lane_id").agg(
        F.ceil(F.count(F.lit(1)) / WEIGHTS_PER_CUT).cast("int").alias("cuts")).filter("cuts > 1"))
    cuts = F.coalesce("cuts", F.lit(1))
    left = asked.join(hot, "lane_id", "left").withColumn(
        "cut", F.pmod(F.xxhash64("weight_lbs"), cuts).cast("int"))
    right = cards.filter(F.col("lane_id").isNotNull()).join(hot, "lane_id", "left").withColumn(
        "cut", F.explode(F.sequence(F.lit(0), cuts - 1)))
    return left.drop("cuts"), right.drop("cuts")


def _on_lane(requests: DataFrame, cards: DataFrame,
             prepared: Callable[[DataFrame], DataFrame] = lambda pairs: pairs,
             finished: Callable[[DataFrame], DataFrame] = lambda cards: cards) -> DataFrame:
    """Different (lane, weight) pairs next to the cards of their lane.

    ``prepared`` adds to the pairs and ``finished`` to the cards what need not be shuffled.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left, right = _cut(requests, cards)
    key = ["lane_id", "cut"]
    left, right = (prepared(left.repartition(n, *key)), finished(right.repartition(n, *key)))
    return left.join(right, key).drop("cut")


def _quick_cards(cards: DataFrame) -> DataFrame:
    """Cards of a price list with the parts of ``pricing.quick_charge`` that are the card's."""
    factor, least = F.col("factor"), F.col("minimum_charge")
    return cards.withColumns({
        "minimum": least.cast(pricing.CHARGE), "whole": pricing.whole_factor(factor),
        "reach": pricing.whole_reach(factor), "floor": pricing.whole_floor(least)})


def _weighed(pairs: DataFrame) -> DataFrame:
    """Requests with their hundredweights, worked out once per request and not once per quote."""
    cwt = pricing.hundredweights(F.col("weight_lbs"))
    return pairs.withColumns({"cwt": cwt, "whole_cwt": pricing.unscaled(cwt, 4)})


def carrier_quotes(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """What every active carrier on the lane would charge.

    Requests are first reduced to the different (lane, weight) pairs, so a lane with a third of all
    shipments brings no more rows than it has weights.  A quote is a few operations on whole numbers; what
    is the request's or the card's alone is worked out before they meet.  ``ranked_quotes`` orders them.
    """
    total = pricing.quick_charge(*map(F.col, ("cwt", "whole_cwt", "factor", "minimum", "whole", "reach",
                                              "floor")))
    return _on_lane(requests, price_list(rates, "carrier_name", "transit_days"), _weighed,
                    _quick_cards).select(
        "lane_id", "weight_lbs", "carrier_id", "carrier_name", total.alias("total_rate"), "transit_days")


def ranked_quotes(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """The quotes of each request, numbered from the cheapest, ties by carrier id.

    A request has as many quotes as its lane has carriers, however many shipments ask for it.  Quotes are
    neither shuffled nor spilled: the cards of a lane come before its requests, ``price_order`` sorts their
    prices by the block, and what it gives back for a quote is the place of its card.
    """
    n = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    asked, offers = _cut(requests, price_list(rates, "carrier_name", "transit_days"))
    offers = offers.select(
        "lane_id", "cut", *price_order.OFFERED, pricing.whole_factor(F.col("factor")).alias("whole"),
        pricing.unscaled(F.col("minimum_charge").cast(pricing.CHARGE), 4).alias("amount"))
    asked = _weighed(asked).drop("cwt")
    rows = offers.withColumn("asks", F.lit(False)).unionByName(
        asked.withColumn("asks", F.lit(True)), allowMissingColumns=True)
    kinds = {field.name: field.dataType.simpleString() for field in rows.schema}
    listed = (*price_order.ASKED, *price_order.OFFERED)
    blocks = rows.repartition(n, "lane_id", "cut").sortWithinPartitions(
        "lane_id", "cut", "asks", "carrier_id").mapInArrow(
        price_order.ranked, ", ".join(["lane_id string", *(f"{c} array<{kinds[c]}>" for c in listed),
                                       "place array<int>", "price array<bigint>"]))
    carriers = F.size("carrier_id")
    asked_at = F.call_function("div", F.col("before"), carriers).cast("int")
    each = blocks.select("lane_id", *listed, "price", F.posexplode("place").alias("before", "at"))
    return each.select(
        "lane_id", F.get("weight_lbs", asked_at).alias("weight_lbs"),
        *(F.get(c, F.col("at")).alias(c) for c in ("carrier_id", "carrier_name")),
        pricing.amount(F.get("price", F.col("before"))).alias("total_rate"),
        F.get("transit_days", F.col("at")).alias("transit_days"),
        (F.col("before") % carriers + 1).alias("rank"))


def numbered_offers(rates: DataFrame) -> DataFrame:
    """The offers that can be the cheapest, numbered per lane in carrier order.

    Cards that price alike are reduced to their smallest carrier id.  An offer goes if one of a
    smaller carrier id has neither a higher factor nor a higher minimum: it never costs less and
    loses ties.  The two such offers looked at are the one with the least factor so far and the one
    with the least minimum so far.
    """
    offers = (
        price_list(rates, "carrier_name", "transit_days")
        .groupBy("lane_id", "factor", "minimum_charge")
        .agg(F.min(F.struct("carrier_id", "carrier_name", "transit_days")).alias("offer"))
        .select("lane_id", "factor", "minimum_charge", "offer.*",
                F.coalesce("factor", F.lit(0)).alias("slope"),
                F.coalesce("minimum_charge", F.lit(0)).alias("floor"))
    )
    lane = Window.partitionBy("lane_id").orderBy("carrier_id", "slope", "floor")
    before = lane.rowsBetween(Window.unboundedPreceding, -1)
    flattest = F.min(F.struct("slope", "floor")).over(before)
    lowest = F.min(F.struct("floor", "slope")).over(before)
    seen = offers.withColumn("flattest", flattest).withColumn("lowest", lowest)
    beaten = ((F.col("flattest.slope") <= F.col("slope")) & (F.col("flattest.floor") <= F.col("floor"))
              | (F.col("lowest.floor") <= F.col("floor")) & (F.col("lowest.slope") <= F.col("slope")))
    return (
        seen.filter(~F.coalesce(beaten, F.lit(False))).drop("slope", "floor", "flattest", "lowest")
        .withColumn("offer_no", F.row_number().over(
            Window.partitionBy("lane_id").orderBy("carrier_id", "factor", "minimum_charge")))
    )


def best_quotes(requests: DataFrame, rates: DataFrame) -> DataFrame:
    """The cheapest active carrier per (lane, weight), ties to the smaller carrier id.

    A request meets the offers of its lane that can win.  Price and offer number are packed into one
    exact number, so the minimum is a plain hash aggregation that combines before the shuffle; the
    winner's columns are looked up afterwards.
    """
    offers = numbered_offers(rates)
    whole = (total_rate() * 10_000).cast("decimal(20,0)")
    packed = (whole * F.lit(1 << 32).cast("decimal(11,0)")).cast("decimal(38,0)") + F.col("offer_no")
    winners = (
        _on_lane(requests, offers.select("lane_id", "factor", "minimum_charge", "offer_no"))
        .groupBy("lane_id", "weight_lbs").agg(F.min(packed.cast("decimal(38,0)")).alias("best"))
        .withColumn("offer_no", (F.col("best") % F.lit(1 << 32).cast("decimal(11,0)")).cast("int"))
    )
    return (
        winners.join(offers, ["lane_id", "offer_no"])
        .select("lane_id", "weight_lbs", total_rate().alias("total_rate"), "carrier_id",
                "carrier_name", "transit_days")
    )


def validity_bins(rates: DataFrame, last_day: Column, asked_bins: str | None = None) -> DataFrame:
    """Cards cut at the borders of bins of ``BIN_DAYS`` days, from their first day to ``last_day``.

    In a bin a card counts from its first day there to its last.  Of cards with the same days in a bin one
    can win: the latest, then the dearest.  That is an aggregation which combines before the shuffle, so a
    bin of a (carrier, lane) holds at most ``BIN_DAYS`` squared over two rows, however many versions the
    card has had.  ``asked_bins`` names a column with the bins that are of use; others are not made.
    """
    first, last = F.col("effective_date"), F.least(
        F.coalesce(F.col("expiration_date"), last_day), last_day)
    bins = F.sequence(*(F.floor(F.unix_date(d) / BIN_DAYS) for d in (first, last)))
    if asked_bins is not None:
        bins = F.array_intersect(asked_bins, bins)
    begin = F.col("bin") * BIN_DAYS
    return (
        rates.filter(first.isNotNull() & (first <= last))
        .withColumn("bin", F.explode(bins))
        .withColumn("from_day", F.greatest(F.unix_date(first).cast("long"), begin))
        .withColumn("to_day", F.least(F.unix_date(last).cast("long"), begin + BIN_DAYS - 1))
        .groupBy(*RATE_KEY, "bin", "from_day", "to_day")
        .agg(F.max(F.struct("effective_date", *CARD)).alias("card"))
    )


def rates_on(rates: DataFrame, requests: DataFrame, on: str, request_key: str) -> DataFrame:
    """For each request the latest card of its carrier and lane that is valid on its date.

    An interval join: cards are cut for the bins that are asked for, and requests meet the cards of their
    (carrier, lane, bin) only, on the left, where adaptive execution can split a hot card; ``max`` over what is valid combines before the shuffle.  A
    request without a valid card stays, with nulls.  Of cards that become effective on one day, the one
    with the larger prices counts.  ``request_key`` names a request.
    """
    day = F.unix_date(F.to_date(F.col(on))).cast("long")
    asked = requests.select(request_key, *RATE_KEY, day.alias("asked_day")).withColumn(
        "bin", F.floor(F.col("asked_day") / BIN_DAYS))
    last_day = requests.select(F.to_date(F.max(on))).scalar()
    wanted = asked.filter(F.col("bin").isNotNull()).groupBy(*RATE_KEY).agg(
        F.collect_set("bin").alias("asked_bins"))
    versions = validity_bins(rates.join(wanted, RATE_KEY), last_day, "asked_bins")
    valid = F.col("asked_day").between(F.col("from_day"), F.col("to_day"))
    return (
        asked.join(versions, [*RATE_KEY, "bin"], "left")
        .groupBy(request_key).agg(F.max(F.when(valid, F.col("card"))).alias("card"))
        .select(request_key, *[F.col("card")[c].alias(c) for c in ("effective_date", *CARD)])
    )


def newest_rates(rates: DataFrame, order: list[str]) -> DataFrame:
    """One card per carrier and lane: the last one written."""
    return latest(rates, RATE_KEY, order)


def upsert_rates(existing: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """The table after writing ``incoming`` over it, last write wins; running it twice is safe."""
    return newest_rates(existing.unionByName(incoming), order)


def typed(cards: DataFrame) -> DataFrame:
    """Text cards with decimal prices; ``readable`` is false if a price is no number.

    Minimum and transit time default to 0 when absent.
    """
    return cards.withColumns({
        "rate_per_cwt": pricing.rate_from_text(F.col("rate_per_cwt")),
        "fuel_surcharge_percent": pricing.rate_from_text(F.col("fuel_surcharge_percent")),
        "minimum_charge": pricing.rate_from_text(F.col("minimum_charge"), "0"),
        "transit_days": F.coalesce(F.col("transit_days").cast("int"), F.lit(0)),
    }).withColumn("readable", F.col("rate_per_cwt").isNotNull()
                  & F.col("fuel_surcharge_percent").isNotNull()
                  & F.col("minimum_charge").isNotNull())


def refreshed(cards: DataFrame, now: str) -> DataFrame:
    """Readable cards as a refresh stores them: typed, active, stamped."""
    stamp = F.lit(now).cast("timestamp")
    return typed(cards).filter("readable").drop("readable").withColumns({
        "active": F.lit(True), "effective_date": F.to_date(stamp), "last_refreshed_at": stamp})


def literal_cards(spark: SparkSession) -> DataFrame:
    schema = ("carrier_id string, lane_id string, origin_state string, dest_state string, "
              "shipment_type string, rate_per_cwt string, fuel_surcharge_percent string, "
              "minimum_charge string, transit_days int")
    return spark.createDataFrame(RATE_CARDS, schema)


def with_fallback(carriers: DataFrame, fresh: DataFrame, literal: DataFrame) -> DataFrame:
    """Fresh cards of the configured carriers; literal cards for those that sent none.

    A carrier with neither is simply absent.  Literal cards are found by lower-cased carrier id.
    """
    fields = literal.columns
    silent = carriers.join(fresh.select("carrier_id").distinct(), "carrier_id", "left_anti")
    backup = (
        silent.withColumn("card_owner", F.lower("carrier_id"))
        .join(literal.withColumnRenamed("carrier_id", "card_owner"), "card_owner")
        .select(*fields).withColumn("card_source", F.lit("literal"))
    )
    sent = (
        carriers.join(fresh, "carrier_id").select(*fields)
        .withColumn("card_source", F.lit("fresh"))
    )
    return sent.unionByName(backup)


def refresh_counts(carriers: DataFrame, cards: DataFrame) -> DataFrame:
    """Stored cards, carriers processed and carriers failed: those with an unreadable card."""
    per_carrier = typed(cards).groupBy("carrier_id").agg(
        F.count_if("readable").alias("updated"), F.bool_and("readable").alias("fine"))
    joined = carriers.select("carrier_id").distinct().join(per_carrier, "carrier_id", "left")
    fine = F.coalesce(F.col("fine"), F.lit(True))
    return joined.agg(
        F.coalesce(F.sum("updated"), F.lit(0)).alias("updated"),
        F.count_if(fine).alias("carriers_processed"), F.count_if(~fine).alias("carriers_failed"))


def rate_changes(history: DataFrame, unit: str = "day") -> DataFrame:
    """Old rate, new rate and signed change in percent for every refresh of a card.

    The history must have unique (``refreshed_at``, ``refresh_id``) per card.
    """
    before = previous_value(history, RATE_KEY, ["refreshed_at", "refresh_id"], "rate_per_cwt",
                            "previous_rate", unit)
    new, old = F.col("rate_per_cwt"), F.col("previous_rate")
    change = pricing.discrepancy_percent(new.cast(pricing.MONEY), old.cast(pricing.MONEY))
    return (
        before.withColumn("change_percent", F.when(old.isNotNull(), change))
        .withColumn("rate_increased", F.col("change_percent") > 0)
        .withColumnRenamed("rate_per_cwt", "new_rate")
    )


def rate_event_messages(cards: DataFrame) -> DataFrame:
    """One rate-updated message per stored card: JSON body plus the two routing attributes."""
    moment = F.date_format("last_refreshed_at", "yyyy-MM-dd'T'HH:mm:ssXXX")
    body = messages.to_body(
        F.lit(RATE_EVENT).alias("eventType"), F.col("carrier_id").alias("carrierId"),
        F.col("lane_id").alias("laneId"), F.col("origin_state").alias("originState"),
        F.col("dest_state").alias("destinationState"),
        F.col("shipment_type").alias("shipmentType"),
        F.col("rate_per_cwt").cast("string").alias("ratePerCwt"),
        F.col("fuel_surcharge_percent").cast("string").alias("fuelSurchargePercent"),
        moment.alias("effectiveDate"))
    return cards.select(F.lit(RATE_EVENT).alias("event_type"), "carrier_id", "lane_id",
                        body.alias("body"))
