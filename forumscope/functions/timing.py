"""Parsed timestamps, and the delay between a question and its accepted answer."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def moment(iso_text: Column) -> Column:
    """Wall-clock time of an ISO string, whatever the session's zone; text that is no timestamp gives null."""
    return iso_text.try_cast("timestamp_ntz")


def delay_columns(asked: Column, answered: Column) -> dict[str, Column]:
    """Elapsed seconds, minutes and hours, and the calendar days between the two dates."""
    seconds = F.timestamp_diff("SECOND", asked, answered)
    return {
        "AnswerDurationSeconds": seconds,
        "AnswerDurationMinute": seconds / F.lit(60.0),
        "AnswerDurationHour": seconds / F.lit(3600.0),
        "AnswerDurationDays": F.datediff(answered, asked),
    }
