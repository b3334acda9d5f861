"""Partial dates: text of a year, a month or a day, compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A file's date, and a year in running text.
FILE_DATE = r"D:(\d{4})(\d{2})?(\d{2})?"
YEAR = r"(?U)\b(1[89][0-9]{2}|20[0-9]{2})\b"


def year(date: Column) -> Column:
    """First four characters."""
    return F.substring(date, 1, 4)


def file_date(raw: Column) -> Column:
    """struct(date, precision) of a file's date; (null, unknown) if there is none."""
    y, m, d = (F.regexp_extract(F.coalesce(raw, F.lit("")), FILE_DATE, k) for k in (1, 2, 3))
    return (
        F.when(y == "", F.struct(F.lit(None).cast("string").alias("date"), F.lit("unknown").alias("precision")))
        .when(d != "", F.struct(F.concat_ws("-", y, m, d).alias("date"), F.lit("exact").alias("precision")))
        .when(m != "", F.struct(F.concat_ws("-", y, m).alias("date"), F.lit("month").alias("precision")))
        .otherwise(F.struct(y.alias("date"), F.lit("year").alias("precision")))
    )


def text_year(t: Column, within: int = 2000) -> Column:
    """First year 1800 to 2099 that stands alone in the first characters, or null."""
    found = F.regexp_extract(F.substring(F.coalesce(t, F.lit("")), 1, within), YEAR, 1)
    return F.when(found != "", found)


def chosen_date(created: Column, modified: Column, first_page: Column) -> Column:
    """struct(date, precision): the file's creation date, else (if it has none)
    its modification date, else a year in the text."""
    raw = F.when(F.coalesce(created, F.lit("")) != "", created).otherwise(modified)
    own, found = file_date(raw), text_year(first_page)
    return F.when(own["date"].isNotNull(), own).when(found.isNotNull(), F.struct(found.alias("date"), F.lit("year").alias("precision"))).otherwise(own)


def within(date: Column, first: str | None, last: str | None) -> Column:
    """Text comparison, both ends included; null dates fail a given end."""
    ok = F.lit(True)
    if first:
        ok = ok & (date >= first)
    if last:
        ok = ok & (date <= last)
    return F.coalesce(ok, F.lit(False))


def seconds_between(start: Column, stop: Column) -> Column:
    return F.round((F.unix_micros(stop) - F.unix_micros(start)) / 1e6, 2)
