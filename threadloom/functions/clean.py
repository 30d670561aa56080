"""Column expressions that bring dirty text, epochs and timestamps to one form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Date and time with ``T`` or a space, optional fraction, optional offset.
ISO_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})?$"
ZONE_AT_END = r"(Z|[+-]\d{2}:?\d{2})$"
WHOLE_SECONDS = r"^\d+$"
#: Epochs above this are milliseconds.
MILLISECONDS_FROM = 1e11
WHITE = " \t\n\x0b\f\r"


def strip(col: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.btrim(col, F.lit(WHITE))


def folded(col: Column) -> Column:
    """Stripped and in lower case."""
    return F.lower(strip(col))


def is_blank(col: Column) -> Column:
    """True for null, empty and white space only."""
    return col.isNull() | ~col.rlike(r"\S")


def epoch_seconds(col: Column) -> Column:
    """Epoch in seconds, whether it was written in seconds or milliseconds."""
    return F.when(col > MILLISECONDS_FROM, col / 1000.0).otherwise(col)


def time_ms(col: Column) -> Column:
    """Epoch milliseconds of a time written as ISO text or whole epoch seconds; null for anything else.

    Text without an offset is UTC, whatever the session's time zone is.
    """
    zoned = F.when(col.rlike(ZONE_AT_END), col).otherwise(F.concat(col, F.lit("Z")))
    return F.when(col.rlike(ISO_TIME), F.unix_millis(zoned.try_cast("timestamp"))).when(
        col.rlike(WHOLE_SECONDS), F.try_multiply(col.try_cast("bigint"), F.lit(1000).cast("bigint"))
    )


def day_of(ms: Column) -> Column:
    """UTC date of epoch milliseconds."""
    return F.date_from_unix_date(F.floor(ms / F.lit(86_400_000)).cast("int"))


def week_of(ms: Column) -> Column:
    """UTC date, as text, of the Monday on or before epoch milliseconds."""
    days = F.floor(ms / F.lit(86_400_000)).cast("int")
    return F.date_from_unix_date((days - F.pmod(days + F.lit(3), F.lit(7))).cast("int")).cast("string")
