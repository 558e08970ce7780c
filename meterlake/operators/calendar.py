"""Dense calendars, heat levels and weeks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar(daily: DataFrame, first: str, last: str) -> DataFrame:
    """Every day from first to last with the tokens and requests of ``daily`` (day, tokens, requests), 0 where there are none."""
    spark = daily.sparkSession
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("__d"))
    spine = spine.select(F.date_format("__d", "yyyy-MM-dd").alias("day"))
    return spine.join(daily, "day", "left").select("day", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tokens", "requests")))


def summary(days: DataFrame) -> DataFrame:
    return days.agg(F.count_if(F.col("tokens") > 0).alias("active_days"), F.sum("requests").alias("requests"), F.max("tokens").alias("peak"))


def heat_levels(days: DataFrame) -> DataFrame:
    """``days`` with level 0 to 4: nearest-rank quartiles and the 95th percentile of the active days are the steps."""
    active = F.sort_array(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens"))))  # one number a day of the calendar
    steps = days.agg(active.alias("__a"))
    for i, q in enumerate((0.25, 0.5, 0.75, 0.95)):
        at = F.round((F.size("__a") - 1) * F.lit(q)).cast("int") + 1
        steps = steps.withColumn(f"__q{i}", F.when(F.size("__a") == 0, F.lit(i + 1)).otherwise(F.greatest(F.get("__a", at - 1), F.lit(1))))
    above = sum(((F.col("tokens") > F.col(f"__q{i}")).cast("int") for i in range(1, 4)), (F.col("tokens") > F.col("__q0")).cast("int"))
    level = F.when(F.col("tokens") <= 0, 0).otherwise(1 + F.least(F.lit(3), above))
    return days.join(F.broadcast(steps.drop("__a")), F.lit(True)).withColumn("level", level.cast("int")).drop("__q0", "__q1", "__q2", "__q3")


def weeks(days: DataFrame) -> DataFrame:
    """``days`` with the Monday of their week and the weekday from 0."""
    date = F.col("day").cast("date")
    return days.withColumns({"week": F.date_format(F.date_trunc("week", date), "yyyy-MM-dd"), "weekday": F.weekday(date)})
