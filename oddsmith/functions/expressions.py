"""Scalar functions as column expressions: they stay in whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from oddsmith.settings import PAYOUT, SHARE_FLOOR

# A decimal number as the time and age parsers accept it, and the grade marks.
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_OPEN_MARKS = ("オープン", "リステッド", "(L)")


def _number(text: Column) -> Column:
    # the pattern keeps out forms such as "58.9f" that a cast to double lets through
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def time_to_seconds(text: Column) -> Column:
    """``ss.s`` or ``m:ss.s`` in seconds; null for anything else."""
    parts = F.split(text, ":")
    return F.when(F.size(parts) == 1, _number(text)).when(
        F.size(parts) == 2, _number(F.get(parts, 0)) * 60 + _number(F.get(parts, 1))
    )


def speed_mps(distance: Column, seconds: Column) -> Column:
    """Metres per second; null for a zero time."""
    return F.try_divide(distance.cast("double"), seconds)


def race_grade(name: Column, race_class: Column, strict: bool = False) -> Column:
    """4 for top grade, 3, 2, 1 for open races, 0 otherwise; the first matching mark wins.

    By default a class of ``GII`` or ``GIII`` counts as 4, because it begins with `` GI`` after
    the space between name and class. ``strict`` reads the Roman numerals as written.
    """
    text = F.concat(F.coalesce(name, F.lit("None")), F.lit(" "), F.coalesce(race_class, F.lit("None")))
    if strict:
        top = text.rlike("G1|GI |(?<= )GI(?!I)")
        second = text.rlike("G2|GII(?!I)")
    else:
        top = text.contains("G1") | text.contains("GI ") | text.contains(" GI")
        second = text.contains("G2") | text.contains("GII")
    third = text.contains("G3") | text.contains("GIII")
    is_open = F.lit(False)
    for mark in _OPEN_MARKS:
        is_open = is_open | text.contains(mark)
    return F.when(top, 4).when(second, 3).when(third, 2).when(is_open, 1).otherwise(0)


def sex_of(token: Column) -> Column:
    """The first character of a sex-and-age token such as ``牡4``."""
    return F.substring(token, 1, 1)


def age_of(token: Column, bad_age: str = "zero") -> Column:
    """The rest of a sex-and-age token as a whole number.

    ``bad_age="zero"`` reads a missing or bad number as 0; ``"raise"`` reads a missing one
    as 0 and fails on a bad one.
    """
    digits = F.substring(token, 2, 2147483647)
    if bad_age == "zero":
        return F.coalesce(digits.try_cast("int"), F.lit(0))
    if bad_age == "raise":
        parsed = digits.try_cast("int")
        message = F.concat(F.lit("bad age in "), token)
        return F.when(F.length(digits) == 0, 0).when(parsed.isNotNull(), parsed).otherwise(
            F.raise_error(message).cast("int")
        )
    raise ValueError(f"unknown bad_age: {bad_age}")


def handicap_diff(handicap: Column, previous: Column) -> Column:
    """Change of carried weight since the previous start; 0 without one."""
    return F.coalesce(handicap - previous, F.lit(0.0))


def jockey_changed(jockey: Column, previous: Column) -> Column:
    """0 if the jockey of the previous start rides again, else 1, also without a previous start."""
    return F.when(jockey == previous, 0).otherwise(1)


def implied_share(odds: Column, payout: float = PAYOUT) -> Column:
    """The share of the pool that the odds stand for."""
    return F.try_divide(F.lit(float(payout)), odds)


def log_share(odds: Column, payout: float = PAYOUT) -> Column:
    return F.ln(implied_share(odds, payout))


def share_floor(share: Column, floor: float = SHARE_FLOOR) -> Column:
    return F.greatest(share, F.lit(float(floor)))


def odds_floor(odds: Column, floor: float | None) -> Column:
    """Odds not below ``floor``; None leaves them as they are."""
    return odds if floor is None else F.greatest(odds, F.lit(float(floor)))


def power_calibration(share: Column, k: float) -> Column:
    return share if k == 1.0 else F.pow(share, F.lit(float(k)))


def race_day(date_text: Column) -> Column:
    """A ``yyyy/MM/dd`` text as a day number, for windows over days."""
    return F.unix_date(F.to_date(date_text, "yyyy/MM/dd"))
