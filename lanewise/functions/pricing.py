"""Money expressions.  Every step is a bounded decimal; nothing here goes through a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise.fixed_values import DOLLAR_TOLERANCE, PERCENT_TOLERANCE

MONEY = "decimal(12,2)"
CHARGE = "decimal(14,4)"
WHOLE_MOST = 4 * 10 ** 18  # products up to here, and a rounding more, are within a long


def decimal_lit(text: str, precision: int, scale: int) -> Column:
    return F.lit(text).cast(f"decimal({precision},{scale})")


def _hundredth() -> Column:
    return decimal_lit("0.01", 2, 2)


def percent_to_factor(percent: Column) -> Column:
    """``percent / 100`` at four decimals, half up; NULL counts as none."""
    exact = percent.cast("decimal(7,4)") * _hundredth()
    return F.coalesce(F.round(exact, 4), decimal_lit("0", 8, 4)).cast("decimal(8,4)")


def charge_factor(rate_per_cwt: Column, fuel_percent: Column) -> Column:
    """Price per hundredweight with fuel; NULL without a rate."""
    fuel = (F.lit(1).cast("decimal(1,0)") + percent_to_factor(fuel_percent)).cast("decimal(8,4)")
    return (rate_per_cwt.cast("decimal(10,4)") * fuel).cast("decimal(18,8)")


def hundredweights(weight_lbs: Column) -> Column:
    return F.round(weight_lbs.cast("decimal(12,4)") * _hundredth(), 4).cast("decimal(12,4)")


def charge(weight_lbs: Column, factor: Column, minimum: Column) -> Column:
    """Hundredweights x factor, but never below the minimum.

    The comparison uses the unrounded charge.  Only a computed charge is rounded to cents; a minimum
    is charged as it stands, at four decimals.  Without a weight or a factor only the minimum is left
    (0 if none).
    """
    return cwt_charge(hundredweights(weight_lbs), factor, minimum)


def cwt_charge(cwt: Column, factor: Column, minimum: Column) -> Column:
    """``charge`` for a weight that is given in hundredweights."""
    exact = cwt * factor
    floor = minimum.cast(CHARGE)
    return (
        F.when(exact.isNull(), F.coalesce(floor, decimal_lit("0", 14, 4)))
        .when(exact < floor, floor)
        .otherwise(F.round(exact, 2).cast(CHARGE))
    )


def unscaled(amount: Column, scale: int) -> Column:
    """A decimal of at most 18 digits as a whole number of its last places."""
    return (amount * F.lit(10 ** scale).cast("decimal(9,0)")).cast("bigint")


def amount(whole: Column) -> Column:
    """The charge that a whole number of 10**-4 stands for."""
    return (whole.cast("decimal(14,0)") * decimal_lit("0.0001", 4, 4)).cast(CHARGE)


def whole_factor(factor: Column) -> Column:
    """The factor in 10**-8, for ``quick_charge``."""
    return unscaled(factor, 8)


def whole_reach(factor: Column) -> Column:
    """Up to how many 10**-4 hundredweights a product with the factor stays within a long; NULL: none."""
    return F.when(factor > 0, F.floor(F.lit(WHOLE_MOST) / whole_factor(factor)).cast("bigint") - 1)


def whole_floor(minimum: Column) -> Column:
    """The minimum in 10**-12, cut at what a long holds; below every charge if there is none."""
    whole = unscaled(minimum.cast(CHARGE), 4)
    most = WHOLE_MOST // 10 ** 8
    inside = F.greatest(F.least(whole, F.lit(most + 1)), F.lit(-most)) * 10 ** 8
    return F.when(whole.isNull(), F.lit(-1)).otherwise(inside)


def quick_charge(cwt: Column, whole_cwt: Column, factor: Column, minimum: Column, whole: Column,
                 reach: Column, floor: Column) -> Column:
    """``cwt_charge`` in whole numbers where they hold the product; ``whole_cwt`` is in 10**-4 and
    ``whole``, ``reach`` and ``floor`` are the factor's and the minimum's, worked out once per card."""
    product = whole_cwt * whole
    cents = F.call_function("div", product + 5 * 10 ** 9, F.lit(10 ** 10))
    quick = F.when(product < floor, minimum.cast(CHARGE)).otherwise(
        (cents.cast("decimal(12,0)") * _hundredth()).cast(CHARGE))
    return F.when(whole_cwt.between(0, reach), quick).otherwise(cwt_charge(cwt, factor, minimum))


def contract_rate(weight_lbs: Column, rate_per_cwt: Column, fuel_percent: Column,
                  minimum: Column) -> Column:
    """What a rate card charges for a weight."""
    return charge(weight_lbs, charge_factor(rate_per_cwt, fuel_percent), minimum)


def weight_bucket(weight_lbs: Column, width: int = 50) -> Column:
    """Lower edge of the weight bucket; unknown weights fall into bucket 0."""
    whole = weight_lbs.cast("bigint")
    return F.coalesce(whole - whole % width, F.lit(0)).cast("int")


def discrepancy(invoiced: Column, expected: Column) -> Column:
    return invoiced - expected


def discrepancy_percent(invoiced: Column, expected: Column) -> Column:
    """Signed percent at two decimals; 0 when either side is unknown or nothing was expected."""
    difference = (invoiced - expected).cast("decimal(13,2)")
    ratio = F.round(difference / F.nullif(expected, F.lit(0)).cast(MONEY), 4)
    return F.coalesce(ratio * 100, F.lit(0)).cast("decimal(18,2)")


def exceeds(invoiced: Column, expected: Column, threshold: Column | str) -> Column:
    """True when the amounts differ by more than the threshold; unknown is not a discrepancy."""
    limit = decimal_lit(threshold, 12, 2) if isinstance(threshold, str) else threshold
    return F.coalesce(F.abs(invoiced - expected) > limit, F.lit(False))


def within_tolerance(invoiced: Column, expected: Column,
                     dollars: str = DOLLAR_TOLERANCE, percent: str = PERCENT_TOLERANCE) -> Column:
    """Close enough to pay: by amount or by percent, whichever lets more through.

    An unknown amount is never close.
    """
    close = F.abs(invoiced - expected) <= decimal_lit(dollars, 12, 2)
    share = F.abs(discrepancy_percent(invoiced, expected)) <= decimal_lit(percent, 6, 2)
    return invoiced.isNotNull() & expected.isNotNull() & (close | share)


def ratio(top: Column, bottom: Column) -> Column:
    """Plain double ratio, NULL on an empty denominator."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def percent_of(part: Column, whole: Column, scale: int = 2) -> Column:
    """Exact half-up percentage of two counts."""
    exact = part.cast("decimal(14,0)") * 100 / F.nullif(whole, F.lit(0)).cast("decimal(14,0)")
    return F.round(exact, scale).cast(f"decimal(9,{scale})")


def rate_from_text(text: Column, default: str | None = None) -> Column:
    """Decimal from a carrier's text field, with a default for an absent one.

    Text that is no number gives NULL and does not fail the job.
    """
    value = text.try_cast("decimal(10,4)")
    if default is None:
        return value
    return F.when(text.isNull(), decimal_lit(default, 10, 4)).otherwise(value)
