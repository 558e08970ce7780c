"""Idempotent merges: component-wise maxima by key, insert-once failures, daily gauges.

Requests are merged through states: a row's counters, and structs that put an instant and an id before
the attributes they belong to. Least and greatest structs then choose whole rows' attributes, in any
order, grouping and repetition, so a batch and a table that grew by parts give the same request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.usage import BANDS, FAILED

KEY = ("adapter_id", "session_id", "dedup_key")
COUNTERS = (*BANDS, "reasoning")
#: A request's attributes, as ``finish`` gives them.
MERGED = (*KEY, *COUNTERS, "occurred_at", "model_id", "request_kind", "measurement_source", "raw_json", "is_sidechain", "last_event_id", "copies")


def states(facts: DataFrame) -> DataFrame:
    """Facts as states that ``combine`` takes: each row stands for itself."""
    at = ("occurred_at", "event_id")
    model, raw = (F.when(F.col(c).isNotNull(), F.struct(*at, c)) for c in ("model_id", "raw_json"))
    return facts.select(
        *KEY, "measurement_source", *COUNTERS, F.struct(*at, "request_kind", "measurement_source").alias("first"), model.alias("model"), raw.alias("raw"),
        F.col("event_id").alias("last_event_id"), "is_sidechain", F.lit(1).cast("long").alias("copies"),
    )


def combine(parts: DataFrame, *more: str) -> DataFrame:
    """States merged by request (and the columns ``more``): they can be combined again with others."""
    return parts.groupBy(*KEY, *more).agg(
        *(F.max(c).alias(c) for c in COUNTERS), F.min("first").alias("first"), F.min("model").alias("model"), F.max("raw").alias("raw"),
        F.max("last_event_id").alias("last_event_id"), F.bool_or("is_sidechain").alias("is_sidechain"), F.sum("copies").alias("copies"),
    )


def finish(combined: DataFrame) -> DataFrame:
    """Requests (MERGED): attributes of the first row by (occurred_at, event_id), its first known model, the record of the latest row that has one."""
    out = combined.withColumns({
        "occurred_at": F.col("first.occurred_at"), "request_kind": F.col("first.request_kind"), "measurement_source": F.col("first.measurement_source"),
        "model_id": F.col("model.model_id"), "raw_json": F.col("raw.raw_json"),
    })
    return out.select(*MERGED)


def merge_max(df: DataFrame) -> DataFrame:
    """One row per request: maxima of the counters, attributes of the first row by (occurred_at, event_id).

    Replays, restarts and late rows converge, as a maximum does not depend on order or repetition.
    """
    return finish(combine(states(df))).select(*KEY, *COUNTERS, "occurred_at", "model_id", "request_kind", "last_event_id", "copies")


def merged(rows: DataFrame) -> DataFrame:
    """One row per request of tables that hold counters, and perhaps ``occurred_at``, the least of which stays."""
    at = ["occurred_at"] if "occurred_at" in rows.columns else []
    return rows.groupBy(*KEY).agg(*(F.max(b).alias(b) for b in COUNTERS), *(F.min(c).alias(c) for c in at))


def merge_into(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Counters of an existing table merged with new rows of the same columns: union, then maxima again."""
    return merged(existing.unionByName(incoming))


def outcomes(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Keys of ``incoming`` with what merging them does: inserted, updated or unchanged."""
    counters = F.struct(*COUNTERS)
    old = merged(existing).select(*KEY, counters.alias("__old"))
    new = merged(existing.unionByName(incoming)).select(*KEY, counters.alias("__new"))
    keys = incoming.select(*KEY).distinct()
    both = new.join(keys, list(KEY), "left_semi").join(old, list(KEY), "left")
    outcome = F.when(F.col("__old").isNull(), "inserted").when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged").otherwise("updated")
    return both.select(*KEY, outcome.alias("outcome"))


def per_source(df: DataFrame) -> DataFrame:
    """One row per request and measurement source; the raw record of the latest row that has one."""
    latest = F.when(F.col("raw_json").isNotNull(), F.struct("occurred_at", "event_id"))
    return df.groupBy(*KEY, "measurement_source").agg(*(F.max(b).alias(b) for b in COUNTERS), F.max_by("raw_json", latest).alias("raw_json"))


def failures_once(df: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The first failure of each key that is not in ``existing``."""
    failed = df.filter(F.col("request_kind") == FAILED)
    once = failed.groupBy(*KEY).agg(F.min("occurred_at").alias("occurred_at"))
    return once.join(existing.select(*KEY).distinct(), list(KEY), "left_anti") if existing is not None else once


def daily_gauge(df: DataFrame, day: str, value: str) -> DataFrame:
    """A sampled counter that resets every day: its maximum per day."""
    return df.groupBy(day).agg(F.max(value).alias(value))
