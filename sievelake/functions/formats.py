"""How times, shares and ids are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seconds(ms: Column, digits: int = 1) -> Column:
    """Milliseconds as seconds, with an s."""
    return F.concat(F.format_number(ms / 1000.0, digits), F.lit("s"))


def percent(share: Column) -> Column:
    """A share of 1 as whole per cent."""
    return F.concat(F.format_number(share * 100.0, 0), F.lit("%"))


def review_id(content: Column) -> Column:
    """Twelve characters that the submitted content decides, written as the beginning of a UUID is: eight, a hyphen, three."""
    digest = F.sha2(F.coalesce(content, F.lit("")), 256)
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 3))


def iso_or_empty(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))


def elapsed_ms(begin: Column, end: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", begin, end)
