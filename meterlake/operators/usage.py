"""Filters and aggregates over request facts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.usage import FAILED, grand_total, refold_aggs, total_aggs

DAY, HOUR = "yyyy-MM-dd", "yyyy-MM-dd'T'HH"


@dataclass(frozen=True)
class Filter:
    """A half-open range of instants and an adapter, each optional."""

    since: str | None = None
    until: str | None = None
    adapter: str | None = None

    def in_range(self, df: DataFrame) -> DataFrame:
        kind = df.schema["occurred_at"].dataType
        if self.since:
            df = df.filter(F.col("occurred_at") >= F.lit(self.since).cast(kind))
        if self.until:
            df = df.filter(F.col("occurred_at") < F.lit(self.until).cast(kind))
        return df.filter(F.col("adapter_id") == self.adapter) if self.adapter else df

    def usage(self, df: DataFrame) -> DataFrame:
        """Requests that did not fail."""
        return self.in_range(df).filter(F.col("request_kind") != FAILED)


EVERYTHING = Filter()


def totals(df: DataFrame, f: Filter = EVERYTHING) -> DataFrame:
    return f.usage(df).agg(*total_aggs())


def failed_count(df: DataFrame, f: Filter = EVERYTHING) -> DataFrame:
    return f.in_range(df).filter(F.col("request_kind") == FAILED).agg(F.count(F.lit(1)).alias("failed"))


def by(df: DataFrame, key: str, f: Filter = EVERYTHING) -> DataFrame:
    return f.usage(df).groupBy(key).agg(*total_aggs())


def local_label(at: str, grain: str, tz: str) -> Column:
    """The calendar label of an instant in a zone; instants without a zone are UTC."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), F.col(at).cast("timestamp_ntz")), grain)


def segment(breaks: list, at: str = "occurred_at") -> Column:
    """How many price changes an instant has behind it; the changes are one literal, however many there are."""
    if not breaks:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, breaks)), lambda b: b <= F.col(at)))


def slices(df: DataFrame, grain: str, breaks: list | None, tz: str = "UTC", f: Filter = EVERYTHING) -> DataFrame:
    """Totals per local bucket, model and price segment, with the first instant of each; without ``breaks`` the segment is a column of ``df``."""
    keyed = f.usage(df).withColumn("at", local_label("occurred_at", grain, tz))
    keyed = keyed if breaks is None else keyed.withColumn("segment", segment(breaks))
    return keyed.groupBy("at", "model_id", "segment").agg(*total_aggs(), F.min("occurred_at").alias("first_at"))


def fold_buckets(sliced: DataFrame) -> DataFrame:
    return sliced.groupBy("at").agg(*refold_aggs())


def sessions(df: DataFrame) -> DataFrame:
    """Per session and adapter: requests, failures, sums over all rows, span, and whether no row has a task."""
    sums = [c for c in total_aggs()[1:-1]]
    return df.groupBy("session_id", "adapter_id").agg(
        F.max("model_id").alias("model_id"),
        F.count_if(F.col("request_kind") != FAILED).alias("requests"),
        F.count_if(F.col("request_kind") == FAILED).alias("failed"),
        *sums,
        F.count(F.when(F.col("request_kind") != FAILED, F.col("reasoning"))).alias("reasoning_reported_by"),
        F.min("occurred_at").alias("first_at"),
        F.max("occurred_at").alias("last_at"),
        F.every(F.col("task_id").isNull()).alias("unattributed"),
    )


def recent_sessions(df: DataFrame, limit: int = 30) -> DataFrame:
    """The latest sessions; ties go by session and adapter."""
    return sessions(df).orderBy(F.desc("last_at"), "session_id", "adapter_id").limit(limit)


def top(df: DataFrame, key: str, by_tokens: bool = True, limit: int = 8) -> DataFrame:
    """The largest rows of totals by tokens or by requests."""
    order = grand_total() if by_tokens else F.col("requests")
    return df.withColumn("grand_total", grand_total()).orderBy(order.desc(), F.col(key).asc_nulls_last()).limit(limit)


def ordered(df: DataFrame, column: str, descending: bool, tie: str, limit: int | None = None) -> DataFrame:
    """Rows in order; what has no value comes last either way. ``df`` is sorted by ranges, not in one task."""
    order = F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last()
    out = df.orderBy(order, F.col(tie).asc_nulls_first())
    return out.limit(limit) if limit is not None else out


#: Parts that a ranking of all rows is cut into by value.
RANK_PARTS = 256


def positions(df: DataFrame, column: str, descending: bool, tie: str, limit: int | None = None) -> DataFrame:
    """Rows in order with their position: the first ``limit``, or all of them.

    All rows are ranked in parts of neighbouring values, whose sizes are added up, never in one task. Bounds of the
    parts are quantiles of ``column``, which must be a number.
    """
    order = [F.col(column).desc_nulls_last() if descending else F.col(column).asc_nulls_last(), F.col(tie).asc_nulls_first()]
    if limit is not None:
        return ordered(df, column, descending, tie, limit).withColumn("position", F.row_number().over(W.orderBy(*order)))
    bounds = df.select(F.col(column).cast("double").alias("v")).approxQuantile("v", [k / RANK_PARTS for k in range(1, RANK_PARTS)], 0.25 / RANK_PARTS)
    value = F.col(column).cast("double")
    below = F.size(F.filter(F.array(*map(F.lit, sorted(set(bounds)))), lambda b: b < value)) if bounds else F.lit(0)
    last = len(bounds) + 1
    parted = df.withColumn("__part", F.when(value.isNull(), F.lit(last)).otherwise(F.lit(last - 1) - below if descending else below))
    sizes = parted.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # RANK_PARTS + 1 rows at most
    bases = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    own = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    ranked = parted.withColumn("__own", own).join(F.broadcast(bases), "__part")
    return ranked.withColumn("position", (F.col("__base") + F.col("__own")).cast("int")).drop("__part", "__own", "__base")


def last_buckets(series: DataFrame, n: int) -> DataFrame:
    """The last ``n`` buckets of a series, oldest first."""
    return series.orderBy(F.desc("at")).limit(n).orderBy("at")


def unattributed(df: DataFrame) -> DataFrame:
    return df.filter(F.col("task_id").isNull()).agg(F.count(F.lit(1)).alias("unattributed"))


def bind_tasks(df: DataFrame, bindings: DataFrame) -> DataFrame:
    """Facts with the task that their session is bound to; sessions are bound once at most."""
    return df.drop("task_id").join(bindings.select("session_id", "task_id"), "session_id", "left")
