"""Numeric expressions."""

from pyspark.sql import Column, functions as F

from commitlore.functions.text import _c


def safe_numeric(c) -> Column:
    """Double value; 0 for text that is no number, NaN, infinities and nulls."""
    value = _c(c).try_cast("double")
    bad = F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.coalesce(F.when(~bad, value), F.lit(0.0))


def known(c) -> Column:
    """Double value with NaN read as missing."""
    value = _c(c).cast("double")
    return F.when(~F.isnan(value), value)


def net_lines(insertions="insertions", deletions="deletions") -> Column:
    return _c(insertions) - _c(deletions)


def churn_ratio(insertions="insertions", deletions="deletions") -> Column:
    return _c(deletions) / (_c(insertions) + 1)


def commit_size(insertions="insertions", deletions="deletions") -> Column:
    return _c(insertions) + _c(deletions)


def commit_size_class(size) -> Column:
    """(0,10] small, (10,50] medium, (50,200] large, above that huge; null at 0."""
    s = _c(size)
    return (
        F.when(s <= 0, F.lit(None)).when(s <= 10, "small").when(s <= 50, "medium")
        .when(s <= 200, "large").when(s > 200, "huge")
    )


def parent_count(parents) -> Column:
    """Parents given as a count, a printed list or comma-separated text."""
    c = F.trim(_c(parents).cast("string"))
    inner = F.trim(F.regexp_replace(c, r"^\[|\]$", ""))
    return (
        F.when(c.isNull() | (inner == ""), F.lit(0))
        .when(c.rlike(r"^\d+$"), c.try_cast("int"))
        .otherwise(F.size(F.split(inner, ",")))
    )


def bool_to_int(c) -> Column:
    return F.coalesce(_c(c).cast("boolean"), F.lit(False)).cast("int")


def metric_or_null(c) -> Column:
    """A metric to three decimals, null when it is no finite number."""
    value = F.lower(F.trim(_c(c).cast("string"))).try_cast("double")
    finite = ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, F.round(value, 3))


def quartile_band(value, q25, q75, low="low", middle="medium", high="high") -> Column:
    """Band of a value between two cut points; null stays null."""
    v = _c(value)
    return F.when(v <= q25, low).when(v <= q75, middle).when(v.isNotNull(), high)


def histogram_bin(value, low, high, bins: int) -> Column:
    """0-based equal-width bin over [low, high], the last one closed."""
    v = _c(value).cast("double")
    width = (high - low) / F.lit(float(bins))
    raw = F.floor((v - low) / F.when(width > 0, width))
    return F.when(v.isNotNull(), F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1)).cast("int"))
