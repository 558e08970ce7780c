"""Values that carry how well they are known: exact, calculated, estimated, partial (a floor) or unavailable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("unavailable", "partial", "estimated", "calculated", "exact")


def strength(kind: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(KINDS):
        out = F.when(kind == name, F.lit(i)).otherwise(out)
    return out


def kind_of(strength_: Column) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), strength_ + 1)


def prefix(kind: Column) -> Column:
    return F.when(kind == "exact", "").when(kind.isin("calculated", "estimated"), "≈").when(kind == "partial", "≥").otherwise("—")


def measured_sum(df: DataFrame, keys: list[str], value: str, kind: str, reason: str) -> DataFrame:
    """Sums measurements: complete sums keep the weakest kind, others are partial, or unavailable with a reason.

    Of several reasons the smallest is reported, so that the result does not depend on row order.
    """
    sums = df.groupBy(*keys).agg(
        F.sum(value).alias("value"), F.count(value).alias("measured"), F.count(F.lit(1)).alias("total"),
        F.min(strength(F.col(kind))).alias("__weakest"), F.min(F.when(F.col(kind) == "unavailable", F.col(reason))).alias("__reason"),
    )
    # fixed values: reports say these sentences
    missing = F.format_string("%d of %d contributing measurements reported a value; the rest could not be measured", F.col("total") - F.col("measured"), F.col("total"))
    return sums.select(
        *keys, "value", "measured", "total",
        F.when(F.col("measured") == 0, "unavailable").when(F.col("measured") < F.col("total"), "partial").otherwise(kind_of(F.col("__weakest"))).alias("kind"),
        F.when(F.col("measured") == 0, F.coalesce("__reason", F.lit("No contributing measurement reported a value.")))
        .when(F.col("measured") < F.col("total"), missing).alias("reason"),
    )


def reasoning_measure(df: DataFrame) -> DataFrame:
    """Adds reasoning_kind and reasoning_reason to totals: NULL is unavailable, incomplete coverage is partial."""
    text = F.format_string("%d of %d requests report reasoning tokens", F.col("reasoning_reported_by"), F.col("requests"))
    partial = F.col("reasoning_reported_by") < F.col("requests")
    return df.withColumns({
        "reasoning_kind": F.when(F.col("reasoning").isNull(), "unavailable").when(partial, "partial").otherwise("exact"),
        "reasoning_reason": F.when(F.col("reasoning").isNull(), "not reported by the provider").when(partial, text),
    })


# Reports say these sentences.
NO_COST = "This agent does not report a cost figure."
REASONS = {
    "no_pricing_for_model": ("No price is configured for model `", "`."),
    "subscription_billed": ("Billed under the ", " subscription, not per token."),
}


def sentence(reason: Column, subject: Column, detail: Column) -> Column:
    """One sentence for why a value is missing; ``subject`` is the model, plan or level that the reason names."""
    out = F.when(reason == "requires_capture_level", F.concat(detail, F.lit(" Enable "), subject, F.lit(" to measure this.")))
    for name, (before, after) in REASONS.items():
        out = out.when(reason == name, F.concat(F.lit(before), subject, F.lit(after)))
    return out.otherwise(detail)


def cost_breakdown(costs: DataFrame, plan: str) -> DataFrame:
    """``costs`` (cost_e15, kind) as three amounts that are never summed: computed, reported by the agent, and billed.

    The last two are never known under a subscription, and each says why.
    """
    none = F.lit(None).cast("decimal(38,0)")

    def missing(reason: str, detail: str) -> Column:
        return F.struct(none.alias("cost_e15"), F.lit("unavailable").alias("kind"), sentence(F.lit(reason), F.lit(plan), F.lit(detail)).alias("reason"))

    reason = F.col("reason") if "reason" in costs.columns else F.lit(None).cast("string")
    return costs.withColumns({
        "api_equivalent": F.struct(F.col("cost_e15").alias("cost_e15"), F.col("kind").alias("kind"), reason.alias("reason")),
        "provider_reported": missing("not_reported_by_provider", NO_COST), "actual_billed": missing("subscription_billed", ""),
    }).drop("cost_e15", "kind", "reason")


LATENCIES = ("average_ms", "median_ms", "p95_ms", "time_to_first_token_ms", "output_tokens_per_sec")


def latency_summary(df: DataFrame, detail: str, level: str) -> DataFrame:
    """``df`` with what logs cannot tell about latency, each unavailable with the remedy."""
    why = sentence(F.lit("requires_capture_level"), F.lit(level), F.lit(detail))
    none = F.struct(F.lit(None).cast("long").alias("value"), F.lit("unavailable").alias("kind"), why.alias("reason"))
    return df.withColumns(dict.fromkeys(LATENCIES, none))


# Fixed value: what a daily total covers.
DAILY_SCOPE = (
    "Every token Claude Desktop counted for the whole application on this day. It carries no model, no input/output split and no conversation, "
    "so it cannot be attributed to a task or priced."
)


def daily_total(gauge: DataFrame, newest: int = 30) -> DataFrame:
    """The latest day of a gauge (day, tokens) with its scope and the newest days, latest first; no row without a reading."""
    rows = gauge.orderBy(F.desc("day")).limit(newest)
    history = F.reverse(F.array_sort(F.collect_list(F.struct("day", "tokens"))))  # at most ``newest`` days
    one = rows.agg(history.alias("history")).filter(F.size("history") > 0)
    latest = F.get("history", F.lit(0))
    return one.select(latest["day"].alias("day"), latest["tokens"].alias("tokens"), F.lit("calculated").alias("kind"), F.lit("application_telemetry").alias("source"), F.lit(DAILY_SCOPE).alias("scope"), "history")
