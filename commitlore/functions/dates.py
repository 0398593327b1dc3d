"""Date expressions."""

from pyspark.sql import Column, functions as F

from commitlore.functions.text import _c

# Calendar parts taken from a date, weekday counted from Monday = 0.
CALENDAR_PARTS = {
    "year": F.year, "month": F.month, "day": F.day, "hour": F.hour, "weekday": F.weekday,
}


def commit_time(c) -> Column:
    """Timestamp in the session zone (UTC); null for text that is no date."""
    return F.try_to_timestamp(_c(c).cast("string"))


def calendar_features(c, prefix: str) -> dict[str, Column]:
    """Calendar parts of a timestamp by column name, 0 where it is missing."""
    return {
        f"{prefix}_{part}": F.coalesce(fn(_c(c)), F.lit(0))
        for part, fn in CALENDAR_PARTS.items()
    }


def config_date(c) -> Column:
    """A yyyy-mm-dd option; a text of another form counts as not given."""
    text = _c(c)
    return F.when(
        text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(text, F.lit("yyyy-M-d"))
    )
