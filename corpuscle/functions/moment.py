"""Timestamps as ISO-8601 text with milliseconds and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def iso8601(ts: Column) -> Column:
    """UTC text for a timestamp, whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), ISO)


def from_iso8601(text: Column) -> Column:
    return F.to_timestamp(text, ISO)


def in_range(iso_text: Column, start: str, end: str) -> Column:
    """Half-open range on ISO text; ISO text sorts as time, so the range is pushed down."""
    return (iso_text >= F.lit(start)) & (iso_text < F.lit(end))
