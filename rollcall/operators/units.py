"""Pay and headcount by organisational unit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNIT = ("sector", "ministry", "province")


def unit_base(records: DataFrame, pay: Column, keys: tuple[str, ...] = UNIT) -> DataFrame:
    """One row per unit: clean headcount, pay, mean age and 50+, and what was flagged, in one pass."""
    ok, bad = ~F.col("flag"), F.col("flag")
    return records.dropna(subset=list(keys)).groupBy(*keys).agg(
        F.count_if(ok).alias("headcount"), F.sum(F.when(ok, pay).otherwise(0.0)).alias("wage_bill"),
        F.coalesce(F.avg(F.when(ok, F.col("age"))), F.lit(0.0)).alias("mean_age"),
        F.count_if(ok & (F.col("age") >= 50)).alias("aged_50_plus"),
        F.count_if(bad).alias("flagged_records"), F.sum(F.when(bad, pay).otherwise(0.0)).alias("flagged_payroll"))


def unit_rollup(base: DataFrame, level: str) -> DataFrame:
    """Units added up to one level, mean age weighted by headcount."""
    out = base.groupBy(level).agg(
        F.sum("headcount").alias("headcount"), F.sum("wage_bill").alias("wage_bill"),
        F.sum("aged_50_plus").alias("aged_50_plus"), F.sum("flagged_records").alias("flagged_records"),
        F.sum("flagged_payroll").alias("flagged_payroll"),
        F.try_divide(F.sum(F.col("mean_age") * F.col("headcount")), F.sum("headcount")).alias("mean_age"))
    return out.withColumn("flagged_share_of_payroll",
                          F.try_divide(F.col("flagged_payroll"), F.col("wage_bill") + F.col("flagged_payroll")))


def allocate_by_share(base: DataFrame, totals: DataFrame, level: str, group: str = "sector",
                      total: str = "total") -> DataFrame:
    """A unit's future pay: its share of its group's base-year pay times the group's projected total.

    ``totals`` has one row per (group, year).
    """
    unit = base.groupBy(group, level).agg(F.sum("wage_bill").alias("_pay"))
    # one row per unit is left, so the window holds a group's units, not its records
    share = unit.withColumn("_share", F.try_divide(F.col("_pay"), F.sum("_pay").over(Window.partitionBy(group))))
    return (share.join(totals, group).groupBy(level, "year")
            .agg(F.sum(F.col("_share") * F.col(total)).alias("projected")))


def unit_comparison(base: DataFrame, totals: DataFrame, level: str, first: int, last: int, top: int = 15) -> DataFrame:
    """Units side by side: base pay, pay in two projected years, growth; the most flagged first."""
    years = (allocate_by_share(base, totals.where(F.col("year").isin(first, last)), level)
             .groupBy(level).agg(F.sum(F.when(F.col("year") == first, F.col("projected"))).alias("pay_first"),
                                 F.sum(F.when(F.col("year") == last, F.col("projected"))).alias("pay_last")))
    return (unit_rollup(base, level).join(years, level)
            .withColumn("growth", F.try_divide(F.col("pay_last"), F.col("pay_first")) - 1)
            .orderBy(F.col("flagged_share_of_payroll").desc(), F.col(level)).limit(top)
            .select(level, "headcount", "wage_bill", "flagged_share_of_payroll", "pay_first", "pay_last", "growth"))
