"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_index(d: Column) -> Column:
    """0..365 in leap-year layout: 29 February is 59 and 1 March 60 in every year."""
    return F.dayofyear(F.make_date(F.lit(2000), F.month(d), F.day(d))) - 1


def month_day(d: Column) -> Column:
    return F.month(d) * 100 + F.day(d)


def winter_year(d: Column) -> Column:
    """A winter is named by its January."""
    return F.year(d) + F.when(F.month(d) >= 10, 1).otherwise(0)


def month_length(d: Column) -> Column:
    return F.day(F.last_day(d))


def new_year(year: Column) -> Column:
    return F.make_date(year, F.lit(1), F.lit(1))


def year_end(year: Column) -> Column:
    return F.make_date(year, F.lit(12), F.lit(31))


def year_length(year: Column) -> Column:
    return F.dayofyear(year_end(year))


def with_calendar(df: DataFrame, date: str = "datum") -> DataFrame:
    d = F.col(date)
    return df.withColumns({
        "jahr": F.year(d), "monat": F.month(d), "tag": F.day(d), "k": day_index(d),
        "md": month_day(d), "winter": winter_year(d), "monatslaenge": month_length(d),
    })


def mid_day(d: Column) -> Column:
    return F.unix_date(d).cast("bigint") * 86400 + 43200


def mid_month(d: Column) -> Column:
    return (F.unix_date(F.trunc(d, "month")).cast("bigint") + 14) * 86400


def mid_year(year: Column) -> Column:
    return F.unix_date(F.make_date(year, F.lit(7), F.lit(2))).cast("bigint") * 86400


def with_epoch(df: DataFrame, resolution: str, column: str = "datum") -> DataFrame:
    """Unix seconds of the middle of the day, month or year."""
    of = {"tag": mid_day, "monat": mid_month, "jahr": mid_year}[resolution]
    return df.withColumn("t", of(F.col(column)))
