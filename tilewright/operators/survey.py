"""Accuracy surveys: position by altitude matrices, means, the best cell, waits and time budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def matrix(cells: DataFrame, positions: list[str]) -> DataFrame:
    """A row for each altitude and a column for each position; cells that are not OK are null."""
    return cells.where("status = 'OK'").groupBy("alt_m").pivot("pos_name", positions).agg(F.min("err_m"))


def means(cells: DataFrame) -> DataFrame:
    """Mean error and number of measured cells of each altitude; altitudes without any have a null mean."""
    measured = F.col("status") == "OK"
    return cells.groupBy("alt_m").agg(F.avg(F.when(measured, F.col("err_m"))).alias("mean_err_m"), F.count(F.when(measured, 1)).alias("n"))


def best(cells: DataFrame) -> DataFrame:
    """The cell with the smallest error; the first in altitude and position order of equal ones."""
    found = F.min_by(F.struct("alt_m", "pos_name", "err_m"), F.struct("err_m", "alt_idx", "pos_idx"))
    return cells.where("status = 'OK'").agg(found.alias("b")).select("b.*").where("err_m is not null")


def display(status: Column, err_m: Column) -> Column:
    """Errors with the sentinels of a report: -1 no fix, -2 not tested."""
    return F.when(status == "OK", err_m).when(status == "NOFIX", -1.0).otherwise(-2.0)


def wait_until(rows: DataFrame, starts: DataFrame, condition: Column, timeout_s: int) -> DataFrame:
    """flight, started, reached: the first row that meets the condition from the start on and before the time is over."""
    met = rows.where(condition).select("flight", F.col("ts").alias("started"), F.col("ts").alias("__met"), F.lit(1).alias("__side"))
    asked = starts.select("flight", "started", F.lit(None).cast(met.schema["__met"].dataType).alias("__met"), F.lit(0).alias("__side"))
    return _first_met(asked.unionByName(met), ["flight"], timeout_s).select("flight", "started", "reached")


def _first_met(both: DataFrame, keys: list[str], timeout_s: int) -> DataFrame:
    """Starts (__side 0) with the first row (__side 1) of their keys from then on and before the time is over: one window,
    in which a start comes before rows of its time."""
    ahead = W.partitionBy(*keys).orderBy("started", "__side").rowsBetween(W.currentRow, W.unboundedFollowing)
    found = both.withColumn("__next", F.first("__met", ignorenulls=True).over(ahead)).where("__side = 0")
    in_time = F.col("__next") < F.col("started") + F.make_interval(secs=F.lit(timeout_s))
    return found.withColumn("reached", F.when(in_time, F.col("__next")))


def first_near(rows: DataFrame, plan: DataFrame, tolerance_m: float, timeout_s: int) -> DataFrame:
    """flight, started, alt_m, reached of a plan: the first row (flight, ts, alt_m) near the altitude in time. Rows meet the
    different altitudes that their flight plans, and then one window for each altitude."""
    goals = plan.select("flight", "alt_m").distinct()
    near = rows.select("flight", "ts", F.col("alt_m").alias("__now")).join(goals, "flight").where(F.abs(F.col("__now") - F.col("alt_m")) <= tolerance_m)
    met = near.select("flight", "alt_m", F.col("ts").alias("started"), F.col("ts").alias("__met"), F.lit(1).alias("__side"))
    asked = plan.select("flight", "alt_m", "started", F.lit(None).cast(met.schema["__met"].dataType).alias("__met"), F.lit(0).alias("__side"))
    return _first_met(asked.unionByName(met), ["flight", "alt_m"], timeout_s).select("flight", "started", "alt_m", "reached")


def within_budget(cells: DataFrame, budget_s: float, order: list[str], key: str = "survey", seconds: str = "seconds") -> DataFrame:
    """Cells that begin after the budget is used up are NOT_TESTED and have no error."""
    before = F.coalesce(F.sum(seconds).over(W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    late = F.col("__before") >= budget_s
    return cells.withColumn("__before", before).withColumns({"status": F.when(late, "NOT_TESTED").otherwise(F.col("status")), "err_m": F.when(~late, F.col("err_m"))}).drop("__before")
