"""Calendar-day normals: all days of the reference period within seven days of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isotherm.functions.calendar import day_index
from isotherm.functions.numbers import quantile_of_sorted
from isotherm.operators.common import of_period, with_value

REACH = 7
LAST = 365          # calendar days are 0..365


def _around(days: DataFrame, means: list[str], pooled: str) -> DataFrame:
    """Moving pool over the circular calendar.

    Days are gathered once per calendar day (sums, and the pooled values as one array: at most one
    per year); on a table bucketed by station that needs no exchange. From here on a station has at
    most 380 rows, whatever its length: the calendar with both ends repeated beyond the turn of the
    year, and a row without days wherever no year has one. A frame of fifteen rows then adds the sums and
    gathers the arrays, which are sorted once per calendar day as plain numbers.
    """
    pos, own = F.col("pos"), F.col("p") == F.col("pos")
    wanted = list(dict.fromkeys(means))
    gathered = days.groupBy("station", day_index(F.col("datum")).alias("k")).agg(
        *[F.sum(m).alias(f"_s_{m}") for m in wanted], *[F.count(m).alias(f"_n_{m}") for m in wanted],
        F.collect_list(pooled).alias("_v"))
    again = (
        F.when(F.col("k") < REACH, F.array("k", F.col("k") + LAST + 1))
        .when(F.col("k") > LAST - REACH, F.array("k", F.col("k") - LAST - 1)).otherwise(F.array("k")))
    order = Window.partitionBy("station").orderBy("pos")
    # a row also stands for the gap behind it, the first one for the days before it as well
    since = F.when(F.lag("pos").over(order).isNull(), F.least(pos, F.greatest(pos - REACH, F.lit(0)))).otherwise(pos)
    until = F.coalesce(F.lead("pos").over(order) - 1, F.greatest(pos, F.least(pos + REACH, F.lit(LAST))))
    rows = (
        gathered.withColumn("pos", F.explode(again)).withColumns({"_since": since, "_until": until})
        .withColumn("p", F.explode(F.sequence("_since", "_until")))
    )
    near = Window.partitionBy("station").orderBy("p").rangeBetween(-REACH, REACH)

    def total(name):
        return F.sum(F.when(own, F.col(name))).over(near)

    pools = rows.select(
        "station", "p", F.count(F.when(own, 1)).over(near).alias("_days"),
        *[F.try_divide(total(f"_s_{m}"), total(f"_n_{m}")).alias(m) for m in wanted],
        F.collect_list(F.when(own, F.col("_v"))).over(near).alias("_pool"),
    ).where(F.col("p").between(0, LAST) & (F.col("_days") > 0))
    return pools.withColumn("_pool", F.sort_array(F.flatten("_pool"))).select(
        "station", F.col("p").alias("k"), *means,
        quantile_of_sorted(F.col("_pool"), 0.1).alias("p10"), quantile_of_sorted(F.col("_pool"), 0.9).alias("p90"))


def day_normals(c: DataFrame, nv: int = 1991) -> DataFrame:
    """k, means of tmk/txk/tnk, and the 10 % and 90 % quantiles of tmk."""
    return _around(of_period(c, nv), ["tmk", "txk", "tnk"], "tmk")


def day_normal(c: DataFrame, column: str = "tmk", nv: int = 1991) -> DataFrame:
    """The same for one measure, from rows with a value: k, mittel, p10, p90."""
    rows = with_value(of_period(c, nv), column)
    return _around(rows, [column], column).withColumnRenamed(column, "mittel")


def day_means(c: DataFrame, columns: list[str], nv: int = 1991) -> DataFrame:
    """Only the means of the normals, for those who need no quantiles.

    Sums per calendar day come first and are small; only they are copied to the fifteen days
    they count for.
    """
    sums = (
        of_period(c, nv).groupBy("station", day_index(F.col("datum")).alias("k"))
        .agg(*[F.sum(x).alias(f"_s_{x}") for x in columns], *[F.count(x).alias(f"_n_{x}") for x in columns])
    )
    return (
        sums.withColumn("_o", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH))))
        .groupBy("station", F.pmod(F.col("k") + F.col("_o"), F.lit(366)).alias("k"))
        .agg(*[F.try_divide(F.sum(f"_s_{x}"), F.sum(f"_n_{x}")).alias(x) for x in columns])
    )


def normal_years(c: DataFrame, nv: int = 1991) -> DataFrame:
    """Number of years of the period with a daily mean."""
    return (
        with_value(of_period(c, nv), "tmk")
        .select("station", F.year("datum").alias("jahr")).distinct()
        .groupBy("station").agg(F.count(F.lit(1)).alias("normal_jahre"))
    )
