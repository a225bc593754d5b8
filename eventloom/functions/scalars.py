"""Small column expressions: ids, ISO text, epoch values, string units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventloom.model import ISO_PATTERN, UUID_PATTERN


def md5_uuid(text: Column) -> Column:
    """A reproducible identifier in UUID shape."""
    out = F.md5(text)
    for place in (9, 14, 19, 24):
        out = F.overlay(out, F.lit("-"), place, 0)
    return out


def contains_any(text: Column, fragments: tuple[str, ...]) -> Column:
    """Plain substring searches, far cheaper on long text than one alternation.

    A fragment that holds another one adds nothing and is not searched for."""
    needed = [f for f in fragments if not any(o in f for o in fragments if o != f)]
    found = [text.contains(f) for f in needed]
    return reduce(lambda a, b: a | b, found)


# White space as the wire contract trims it: line ends, tabs, every kind of space, the byte order mark.
_BLANK = r"[\s\u000B\u2028\u2029\uFEFF\p{Zs}]+"


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, rf"\A{_BLANK}|{_BLANK}\z", "")


def is_uuid(text: Column) -> Column:
    return text.rlike(UUID_PATTERN)


def is_iso(text: Column) -> Column:
    """UTC date-time text ending in ``Z`` that names a real calendar day; NULL for NULL."""
    day = F.try_to_timestamp(F.substring(text, 1, 10), F.lit("yyyy-MM-dd"))
    return F.when(text.isNotNull(), text.rlike(ISO_PATTERN) & day.isNotNull())


def instant(text: Column) -> Column:
    """ISO text as a zone-free UTC timestamp; NULL when it is no date-time."""
    return text.try_cast("timestamp_ntz")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def epoch_millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def epoch_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def from_epoch_seconds(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds).cast("timestamp_ntz")


def utf16_units(text: Column) -> Column:
    """String length as UTF-16 code units."""
    return (F.length(F.encode(text, "UTF-16LE")) / 2).cast("int")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))
