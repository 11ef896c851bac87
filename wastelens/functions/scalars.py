"""Scalar Column expressions with the reference's exact value semantics.

All of these are built from ``pyspark.sql.functions``; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wastelens.functions.dates import column_date, parse_timestamp

__all__ = [
    "col_of", "column_date", "ambiguous", "safe_digest", "slug", "nonneg_int", "vendor_norm", "round_half_even", "amount_bucket",
    "round4", "parse_number", "parse_timestamp", "floor_days", "week_key", "period_key",
    "period_label", "money_text", "row_digest", "text_of", "float_text", "sum0", "safe_sum",
]

_NUMBER_TEXT = r"^\s*[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?)\s*$"
_INT_TEXT = r"^\s*[+-]?[0-9]+\s*$"
_DAY_MICROS = 86_400_000_000


def col_of(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without white space at either end: all of Unicode's, and U+001C..U+001F.
    Text that begins and ends with a printable ASCII character has none there and is not searched
    (the search stands in a lambda for the reason given in :func:`float_text`)."""
    c = col_of(c)
    bare = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    cut = F.transform(F.array(c), lambda x: F.regexp_replace(x, r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$", ""))
    return F.when(bare, c).otherwise(F.get(cut, F.lit(0)))


def slug(c) -> Column:
    """File-safe name: strip, lower, space to ``_``, keep ``[a-z0-9_.-]``."""
    s = F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))
    return F.regexp_replace(s, r"[^a-z0-9_\-\.]", "")


def nonneg_int(c, numeric: bool = False) -> Column:
    """Integer at least 0, or 0 when the value is not an integer."""
    c = col_of(c)
    if numeric:
        v = c.try_cast("bigint")
    else:
        t = c.cast("string")
        v = F.when(t.rlike(_INT_TEXT), F.trim(t).try_cast("bigint"))
    return F.greatest(F.coalesce(v, F.lit(0).cast("bigint")), F.lit(0).cast("bigint"))


def vendor_norm(c) -> Column:
    """null to "", lower case, keep ``[a-z0-9 ]``, strip."""
    s = F.lower(F.coalesce(col_of(c), F.lit("")))
    return F.trim(F.regexp_replace(s, r"[^a-z0-9 ]", ""))


def round_half_even(c, places: int) -> Column:
    """Scale, round half to even on the binary value, unscale."""
    k = float(10 ** places)
    return F.rint(col_of(c) * F.lit(k)) / F.lit(k)


def amount_bucket(c) -> Column:
    """Cost rounded to cents, half to even (P10)."""
    return round_half_even(c, 2)


def round4(c) -> Column:
    """Total cost rounding to 4 places."""
    return round_half_even(c, 4)


def parse_number(c) -> Column:
    """Text or number to double; anything unparseable (or NaN) becomes null.

    Accepts what a strict decimal reader accepts: optional sign, digits with an
    optional point, optional exponent, ``inf``/``infinity``; surrounding
    blanks are ignored. Rejects ``1,000``, ``1_000``, ``0x10``, ``1d``, ``True``;
    out-of-range values are missing. Values are correctly rounded.
    """
    c = col_of(c)
    t = c.cast("string")
    v = F.when(t.rlike(_NUMBER_TEXT), F.trim(t).try_cast("double"))
    # Out-of-range text (1e632) is missing, not infinity; only an inf literal is.
    overflow = (F.abs(v) == F.lit(float("inf"))) & ~t.rlike(r"(?i)^\s*[+-]?inf(inity)?\s*$")
    return F.when(~F.isnan(v) & ~overflow, v)


def number_of(df, name: str) -> Column:
    """``df``'s column as double, NaN and bad values as null: a cast for
    numeric columns, :func:`parse_number` for text."""
    kind = dict(df.dtypes)[name]
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        v = F.col(name).cast("double")
        return F.when(~F.isnan(v), v)
    return parse_number(name)


def floor_days(later, earlier) -> Column:
    """Whole days of elapsed time, floored (N13); null if either side is null.

    The stamps' difference in microseconds over a day's, independent of the
    session time zone for TIMESTAMP_NTZ values.
    """
    day = F.expr("INTERVAL '1' DAY")
    gap = col_of(later) - col_of(earlier)
    days = F.call_function("div", gap, day)
    return days - F.when(gap < day * days, 1).otherwise(0)


def week_key(c) -> Column:
    """Week bin closed on the right at Monday, labelled by that Monday (R2)."""
    return F.next_day(F.date_sub(F.to_date(col_of(c)), 1), "Mon")


def period_key(grain: str, c) -> Column:
    """Period start (or closing Monday for weeks) as a DATE."""
    d = F.to_date(col_of(c))
    if grain == "Weekly":
        return week_key(d)
    unit = {"Monthly": "month", "Quarterly": "quarter", "Annual": "year"}.get(grain)
    if unit is None:
        raise ValueError(f"Unknown period '{grain}'. Valid: ['Weekly', 'Monthly', 'Quarterly', 'Annual']")
    return F.trunc(d, unit)


def period_label(grain, key, legacy_week_label: bool = False) -> Column:
    """Period label (R4). ``grain`` may be a name or a Column of names.

    Weekly keys are closing Mondays; the label shows the days the bin really
    covers (key - 6 .. key). ``legacy_week_label`` gives key .. key + 6.
    """
    key = col_of(key)
    g = F.lit(grain) if isinstance(grain, str) else grain
    if legacy_week_label:
        week = F.concat(key.cast("string"), F.lit(" – "), F.date_add(key, 6).cast("string"))
    else:
        week = F.concat(F.date_sub(key, 6).cast("string"), F.lit(" – "), key.cast("string"))
    return (F.when(g == "Weekly", week)
            .when(g == "Monthly", F.date_format(key, "yyyy-MM"))
            .when(g == "Quarterly", F.concat(F.year(key).cast("string"), F.lit(" Q"),
                                             F.quarter(key).cast("string")))
            .when(g == "Annual", F.year(key).cast("string"))
            .otherwise(key.cast("string")))


def money_text(c) -> Column:
    """``$`` plus whole amount with thousands separators, half to even."""
    return F.concat(F.lit("$"), F.format_number(col_of(c), 0))


def float_text(c) -> Column:
    """Text of a double as Python writes it: plain notation (``65.0``,
    ``12345678.9``) for 1e-4 <= |x| < 1e16 and 0, else ``1e+16`` style.
    Digests must not depend on ``1.23456789E7`` style text. Digits come from
    the JVM's conversion, which on Java 17 can add a 17th digit for some
    values of 1e16 and above. The JVM's own text is the same for 1e-3 <= |x| < 1e7
    and 0, where most amounts lie; the rest stands in a lambda, as its code beside that of
    other fields makes a stage's method too long for the JVM to compile."""
    c = col_of(c)
    same = ((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7)) | (c == 0)
    far = F.transform(F.array(c), lambda x: _far_float_text(x, x.cast("string")))
    return F.when(same, c.cast("string")).otherwise(F.get(far, F.lit(0)))


def _far_float_text(c: Column, t: Column) -> Column:
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"),
                                              "0+$", ""), r"\.$", ".0")
    inrange = (F.abs(c) < 1e16) & ((F.abs(c) >= 1e-4) | (c == 0))
    # Outside that range: Spark's 1.25E20 / 1.0E-5 as 1.25e+20 / 1e-05.
    sci = r"^(-?[0-9]+(?:\.[0-9]+)?)E(-?)([0-9]+)$"
    mant = F.regexp_replace(F.regexp_replace(F.regexp_extract(t, sci, 1), r"(\.[0-9]*?)0+$", "$1"),
                            r"\.$", "")
    sign = F.when(F.regexp_extract(t, sci, 2) == "-", F.lit("-")).otherwise(F.lit("+"))
    e = F.regexp_extract(t, sci, 3)
    expo = F.when(F.length(e) < 2, F.lpad(e, 2, "0")).otherwise(e)
    special = (F.when(t == "Infinity", F.lit("inf")).when(t == "-Infinity", F.lit("-inf"))
               .when(t == "NaN", F.lit("nan")).otherwise(t))
    pyexp = F.when(t.rlike(sci), F.concat(mant, F.lit("e"), sign, expo)).otherwise(special)
    return F.when(inrange, plain).otherwise(pyexp)


def text_of(c, dtype: str | None = None) -> Column:
    """Canonical text of a value for digests: null becomes ""; doubles as
    :func:`float_text`."""
    c = col_of(c)
    t = float_text(c) if dtype in ("double", "float") else c.cast("string")
    return F.coalesce(t, F.lit(""))


def row_digest(cols, dtypes: dict | None = None) -> Column:
    """SHA-256 hex of the fields joined by ``|``; null fields count as "" (H1)."""
    dtypes = dtypes or {}
    return F.sha2(F.concat_ws("|", *[text_of(c, dtypes.get(c) if isinstance(c, str) else None)
                                     for c in cols]), 256)


#: Bytes behind a text that is no digest, so that none is as long as a digest's.
_NO_DIGEST = "00" * 33


def short_digest(c) -> Column:
    """SHA-256 hex text as its 32 bytes; any other text as its bytes and 33 zero bytes. Different texts stay
    different and :func:`long_digest` gives each back; digests take half the room where rows are exchanged or stored."""
    c = col_of(c)
    return F.when(c.rlike("\\A[0-9a-f]{64}\\z"), F.unhex(c)).otherwise(F.concat(c.cast("binary"), F.unhex(F.lit(_NO_DIGEST))))


def long_digest(c) -> Column:
    """The text of which :func:`short_digest` made ``c``."""
    c = col_of(c)
    return F.when(F.octet_length(c) == 32, F.lower(F.hex(c))).otherwise(F.substring(c, F.lit(1), F.octet_length(c) - 33).cast("string"))


def ambiguous(cols, dtypes: dict | None = None) -> Column:
    """Whether a field holds the separator of :func:`row_digest`: other fields
    then give the same text (``a|b``, ``c`` and ``a``, ``b|c``), and the digest proves nothing."""
    dtypes = dtypes or {}
    parts = [text_of(c, dtypes.get(c) if isinstance(c, str) else None).contains("|") for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out | p
    return out


def safe_digest(cols, dtypes: dict | None = None) -> Column:
    """SHA-256 hex of the fields, each led by its number of bytes and ``:`` (``-`` for null):
    different rows never give the same text."""
    dtypes = dtypes or {}

    def part(c):
        t = text_of(c, dtypes.get(c) if isinstance(c, str) else None)
        return F.when(col_of(c).isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t))
    return F.sha2(F.concat(*[part(c) for c in cols]), 256)


def safe_sum(c) -> Column:
    """Sum of a column coerced to numbers, bad values and nulls as 0."""
    return F.coalesce(F.sum(F.coalesce(parse_number(c), F.lit(0.0))), F.lit(0.0))


def sum0(c) -> Column:
    """Sum that is 0 over only-null input."""
    return F.coalesce(F.sum(col_of(c)), F.lit(0))
