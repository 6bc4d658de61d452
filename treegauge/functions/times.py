"""Ages and retention arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The three ways an age can be missing.
NEVER = "never built"
UNREADABLE_STAMP = "stamp unreadable"
UNOPENED = "layer not read"
FUTURE = "from the future (clocks disagree)"


def stamp_seconds(stamp: Column) -> Column:
    """Epoch seconds of a stamp that is a number or an ISO time, else NULL.

    An ISO time without offset is read in the session time zone.
    """
    as_number = F.try_cast(stamp, "double") if hasattr(F, "try_cast") \
        else stamp.try_cast("double")
    as_time = F.try_to_timestamp(stamp)
    return F.coalesce(as_number, F.unix_micros(as_time) / F.lit(1e6))


def age_seconds(stamp: Column, now: Column) -> Column:
    return now - stamp_seconds(stamp)


def human(seconds: Column) -> Column:
    """`3 s`, `2 min`, `4 h`, `2 d`."""
    def amount(div, unit):
        return F.concat(F.floor(F.greatest(seconds, F.lit(0.0)) / F.lit(div))
                        .cast("bigint").cast("string"), F.lit(" " + unit))
    return (F.when(seconds.isNull(), F.lit(NEVER))
            .when(seconds < -1.0, F.lit(FUTURE))
            .when(seconds < 90, amount(1, "s"))
            .when(seconds < 90 * 60, amount(60, "min"))
            .when(seconds < 48 * 3600, amount(3600, "h"))
            .otherwise(amount(86400, "d")))


def described_age(stamp: Column, now: Column, opened: Column) -> Column:
    """An age, or which kind of missing it is."""
    return (F.when(~opened, F.lit(UNOPENED))
            .when(stamp.isNull() | (stamp == ""), F.lit(NEVER))
            .when(stamp_seconds(stamp).isNull(), F.lit(UNREADABLE_STAMP))
            .otherwise(human(age_seconds(stamp, now))))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(86400e6)
