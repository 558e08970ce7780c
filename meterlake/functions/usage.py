"""Column expressions over token counts: totals, derived totals, normalisation of producers' counters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Disjoint token counters of a request; reasoning is a nullable part of output and never added.
BANDS = ("input_fresh", "cache_read", "cache_write_5m", "cache_write_1h", "cache_write_unspecified", "output_total", "unclassified")
FAILED = "failed"
SYNTHETIC = "<synthetic>"


def zero(value: str | Column) -> Column:
    return F.coalesce(F.col(value) if isinstance(value, str) else value, F.lit(0).cast("long"))


def total_aggs() -> list[Column]:
    """Requests, sums of the bands (0 if empty), sum of reasoning (NULL if nothing reports it) and its coverage."""
    return [
        F.count(F.lit(1)).alias("requests"),
        *(F.coalesce(F.sum(b), F.lit(0)).cast("long").alias(b) for b in BANDS),
        F.sum("reasoning").alias("reasoning"),
        F.count("reasoning").alias("reasoning_reported_by"),
    ]


def refold_aggs() -> list[Column]:
    """``total_aggs`` of rows that are themselves totals."""
    return [
        F.coalesce(F.sum("requests"), F.lit(0)).cast("long").alias("requests"),
        *(F.coalesce(F.sum(b), F.lit(0)).cast("long").alias(b) for b in BANDS),
        F.sum("reasoning").alias("reasoning"),
        F.coalesce(F.sum("reasoning_reported_by"), F.lit(0)).cast("long").alias("reasoning_reported_by"),
    ]


def cache_write_total() -> Column:
    return F.col("cache_write_5m") + F.col("cache_write_1h") + F.col("cache_write_unspecified")


def input_side_total() -> Column:
    return F.col("input_fresh") + F.col("cache_read") + cache_write_total()


def grand_total() -> Column:
    return input_side_total() + F.col("output_total") + F.col("unclassified")


def cache_hit_rate() -> Column:
    """cache_read as a part of the input side; NULL without input."""
    return F.try_divide(F.col("cache_read"), input_side_total())


def cache_hit_permille() -> Column:
    """The same in whole thousandths, so that engines agree to the digit."""
    return F.expr("cache_read * 1000 div nullif(input_fresh + cache_read + cache_write_5m + cache_write_1h + cache_write_unspecified, 0)")


def bands_a(inp: Column, out: Column, write: Column, read: Column, write_5m: Column, write_1h: Column) -> dict[str, Column]:
    """Producer A: writes may be split by time to live; what the split leaves open is unspecified."""
    split = write_5m.isNotNull() | write_1h.isNotNull()
    w5, w1, reported = zero(write_5m), zero(write_1h), zero(write)
    return {
        "input_fresh": zero(inp), "cache_read": zero(read), "output_total": zero(out),
        "cache_write_5m": F.when(split, w5).otherwise(F.lit(0).cast("long")),
        "cache_write_1h": F.when(split, w1).otherwise(F.lit(0).cast("long")),
        "cache_write_unspecified": F.when(split, F.greatest(reported - (w5 + w1), F.lit(0).cast("long"))).otherwise(reported),
        "unclassified": F.lit(0).cast("long"),
        "reasoning": F.lit(None).cast("long"),
        "discrepancy": split & (reported != w5 + w1),
    }


def bands_b(inp: Column, cached: Column, write: Column, out: Column, reasoning: Column, total: Column, off_ledger: Column) -> dict[str, Column]:
    """Producer B: input holds the cached part; reasoning must fit into output; a total may be all there is."""
    only_total = off_ledger & (zero(inp) + zero(out) == 0) & (zero(total) > 0)
    none = F.lit(0).cast("long")

    def known(value: Column) -> Column:
        return F.when(only_total, none).otherwise(value)

    return {
        "input_fresh": known(zero(inp) - zero(cached)), "cache_read": known(zero(cached)),
        "cache_write_5m": none, "cache_write_1h": none, "cache_write_unspecified": known(zero(write)),
        "output_total": known(zero(out)), "unclassified": F.when(only_total, zero(total)).otherwise(none),
        "reasoning": F.when(~only_total, zero(reasoning)),
        "invalid": ~only_total & ((zero(cached) > zero(inp)) | (zero(reasoning) > zero(out))),
        "discrepancy": ~off_ledger & total.isNotNull() & (total != zero(inp) + zero(out)),
    }


def bands_c(inp: Column, read: Column, write: Column, out: Column, reasoning: Column) -> dict[str, Column]:
    """Producer C: as B, but reasoning that is not reported stays NULL."""
    none = F.lit(0).cast("long")
    return {
        "input_fresh": zero(inp) - zero(read), "cache_read": zero(read), "cache_write_5m": none, "cache_write_1h": none,
        "cache_write_unspecified": zero(write), "output_total": zero(out), "unclassified": none, "reasoning": reasoning,
        "invalid": (zero(read) > zero(inp)) | (F.coalesce(reasoning, none) > zero(out)),
    }


def counter_delta(now: Column, before: Column) -> Column:
    """A counter's step, never negative; a counter that was not there before counts whole, a missing one is NULL."""
    return F.when(now.isNotNull(), F.greatest(now - F.coalesce(before, F.lit(0)), F.lit(0).cast("long")))


def is_zero(*counters: Column) -> Column:
    """Whether none of the counters says anything but zero."""
    out = F.lit(True)
    for c in counters:
        out = out & (zero(c) == 0)
    return out
