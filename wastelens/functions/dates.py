"""Dates in text: the forms a value can have, and one order of day and month for a column.

``02/01/2024`` alone may be January or February. Whoever wrote a column wrote
all of it in one order, so :func:`column_date` lets the whole column vote: the
order that reads more of its values is taken for every value that both can read
(the month first if they read equally many). A value that only the
other order can read keeps that reading.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Two numbers, a year and perhaps a time: the order of the first two is open.
TWO_NUMBERS = r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4})(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?))?$"
_TWO_DIGIT_YEAR = r"^(?<a>\d{1,2}[/.-]\d{1,2}[/.-])(?<y>\d{2})(?<rest>$|[ T].*)"
_WITH_NAMES = ["MMM d, yyyy", "d MMM yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy H:mm", "d MMM yyyy H:mm"]


def _trimmed(c) -> Column:
    t = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    # Two-digit years: 69 to 99 are of the last century.
    short = F.when(F.regexp_extract(t, _TWO_DIGIT_YEAR, 2) >= "69", F.lit("19")).otherwise(F.lit("20"))
    return F.when(t.rlike(_TWO_DIGIT_YEAR), F.concat(
        F.regexp_extract(t, _TWO_DIGIT_YEAR, 1), short, F.regexp_extract(t, _TWO_DIGIT_YEAR, 2),
        F.regexp_extract(t, _TWO_DIGIT_YEAR, 3))).otherwise(t)


def _ordered(t: Column, day_first: bool) -> Column:
    return F.try_to_timestamp(F.regexp_replace(t, TWO_NUMBERS, "$4-$3-$1 $5" if day_first else "$4-$1-$3 $5"))


def parse_timestamp(c, day_first: Column | bool = False) -> Column:
    """Timestamp of ISO text, ``2024/1/2``, ``20240102``, month names, and two numbers and a year
    in the order ``day_first`` says, or in the other if only that can be; other text becomes null (N7)."""
    t = _trimmed(c)
    first = F.lit(day_first) if isinstance(day_first, bool) else day_first
    month, day = _ordered(t, False), _ordered(t, True)
    open_ = F.when(first, F.coalesce(day, month)).otherwise(F.coalesce(month, day))
    named = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in _WITH_NAMES])
    return (F.when(t.rlike(TWO_NUMBERS), open_)
            .when(t.rlike(r"^\d{4}/\d"), F.try_to_timestamp(F.replace(t, F.lit("/"), F.lit("-"))))
            .when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))
            .when(t.rlike(r"^\d{5,}$"), F.lit(None).cast("timestamp"))  # bare digits are no year
            .when(t.rlike(r"[A-Za-z]{3}") & t.rlike(r"^(\d{1,2}[ -])?[A-Za-z]{3}"), named)
            .otherwise(F.try_to_timestamp(t)))


def day_first_votes(df: DataFrame, name: str) -> DataFrame:
    """One row: how many values of the column the month-first and the day-first order can read."""
    t = _trimmed(f"`{name}`")
    two = t.rlike(TWO_NUMBERS)
    return df.agg(F.count_if(two & _ordered(t, False).isNotNull()).alias("month_first"),
                  F.count_if(two & _ordered(t, True).isNotNull()).alias("day_first"))


def column_date(df: DataFrame, name: str, day_first: bool | None = None) -> Column:
    """The column as timestamps, its text read in the order the whole column votes for.

    The vote is a scalar subquery of two counts over that column, so nothing runs while the
    plan is made. ``day_first`` fixes the order (a stream can't vote: the month is first there).
    """
    kind = dict(df.dtypes)[name]
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.col(f"`{name}`")
    if kind != "string" or df.isStreaming or day_first is not None:
        return parse_timestamp(f"`{name}`", bool(day_first))
    return parse_timestamp(f"`{name}`", day_first_votes(df, name).select(F.col("day_first") > F.col("month_first")).scalar())
