"""Ordered, stateful logic as window functions: counters, carried values, changes, ordinals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.usage import counter_delta


def reconcile(events: DataFrame, by: str, order: list[str], counters: list[str], total: str, last: str) -> DataFrame:
    """Turns cumulative counters into steps: adds kind and a ``delta_*`` per counter and for the total.

    Without a cumulative: no_data. First: turn, the counter itself. Total fell: reset, its own last
    count. Total equal: replay if last is what it was, else off_ledger with last. Total rose: turn,
    the step from the vector at which the total last moved. ``last`` names nullable columns
    ``{last}_{counter}``; ``total`` is the cumulative total and ``{last}_total`` its last.
    """
    earlier = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)  # one window, so one sort
    has = F.col(total).isNotNull()
    names = [*counters, "total"]
    data = events.withColumns({"__before": F.last(total, ignorenulls=True).over(earlier), "__last": F.struct(*[F.col(f"{last}_{c}") for c in names])})
    data = data.withColumn("__last_before", F.last(F.when(has, F.col("__last")), ignorenulls=True).over(earlier))
    moved = F.when(has & (F.col("__before").isNull() | (F.col(total) != F.col("__before"))), F.struct(*counters, F.col(total).alias("total")))
    data = data.withColumn("__base", F.last(moved, ignorenulls=True).over(earlier))
    same = F.col("__last").eqNullSafe(F.col("__last_before"))
    kind = (
        F.when(~has, "no_data").when(F.col("__before").isNull(), "turn").when(F.col(total) < F.col("__before"), "reset")
        .when(F.col(total) > F.col("__before"), "turn").when(same, "replay").otherwise("off_ledger")
    )
    data = data.withColumn("kind", kind)
    deltas = {}
    for c in names:
        now = F.col(total) if c == "total" else F.col(c)
        own = F.col(f"{last}_{c}")
        deltas[f"delta_{c}"] = (
            F.when(F.col("kind") == "turn", counter_delta(now, F.col("__base")[c]))
            .when(F.col("kind") == "reset", F.when(F.col(f"{last}_total").isNull(), now).otherwise(own))
            .when(F.col("kind") == "off_ledger", F.coalesce(own, F.lit(0)))
        )
    return data.withColumns(deltas).drop("__before", "__last", "__last_before", "__base")


def carry_forward(df: DataFrame, by: str, order: list[str], column: str, name: str) -> DataFrame:
    """The last value of ``column`` seen so far; NULL before the first."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn(name, F.last(column, ignorenulls=True).over(w))


def changes(df: DataFrame, by: str, order: list[str], column: str) -> DataFrame:
    """Rows whose value differs from the last one announced; values that are missing announce nothing."""
    known = df.filter(F.col(column).isNotNull())
    before = F.lag(column).over(W.partitionBy(by).orderBy(*order))
    return known.withColumn("__before", before).filter(~F.col("__before").eqNullSafe(F.col(column))).drop("__before")


def event_ordinal(df: DataFrame, by: str, order: list[str], emitted) -> DataFrame:
    """A running number of the rows that emit, from 0."""
    w = W.partitionBy(by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumn("ordinal", F.sum(emitted.cast("long")).over(w) - 1).filter(emitted)


def ledger_gap(reconciled: DataFrame, by: str, order: list[str], total: str) -> DataFrame:
    """What was emitted less the producer's final total."""
    return reconciled.groupBy(by).agg(
        (F.coalesce(F.sum("delta_total"), F.lit(0)) - F.coalesce(F.max_by(total, F.when(F.col(total).isNotNull(), F.struct(*order))), F.lit(0))).alias("gap")
    )
