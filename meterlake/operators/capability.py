"""What a producer's records show, and which capabilities follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.usage import FAILED, cache_write_total

# Capabilities in the order of the matrix.
CAPABILITIES = (
    "exact_token_counts", "cache_read_tokens", "cache_write_tokens", "cache_ttl_breakdown", "reasoning_tokens", "model_identity", "per_request_latency",
    "provider_reported_cost", "actual_billed_cost", "sub_agent_attribution", "failure_visibility",
)

# Producers whose logs are read, and applications that write sessions without counting tokens.
MEASURED = ("claude_code", "codex", "copilot")
UNMEASURED = ("claude_desktop", "cursor", "jetbrains_ai", "junie", "gemini_cli")


def observed(facts: DataFrame) -> DataFrame:
    """Per adapter: usage rows, largest non-zero value of each field, absences, failures."""
    ok = F.col("request_kind") != FAILED

    def most(value: Column) -> Column:
        return F.max(F.when(ok & (value > 0), value))

    return facts.groupBy("adapter_id").agg(
        F.count_if(ok).alias("usage_rows"), most(F.col("cache_read")).alias("cache_read"), most(cache_write_total()).alias("cache_write"),
        most(F.col("cache_write_1h")).alias("cache_write_1h"), most(F.col("reasoning")).alias("reasoning"), F.count_if(ok & F.col("reasoning").isNull()).alias("reasoning_absent"),
        F.max(F.when(ok, F.col("model_id"))).alias("model"), F.coalesce(F.bool_or(F.col("is_sidechain") & ok), F.lit(False)).alias("sidechain"), F.count_if(~ok).alias("failures"),
    )


def capabilities(facts: DataFrame) -> DataFrame:
    """adapter_id, capability, state: supported, unsupported or unknown; without usage all are unknown."""

    def seen(column: str) -> Column:
        return F.when(F.col(column).isNotNull(), "supported").otherwise("unknown")

    states = {
        "exact_token_counts": F.lit("supported"),
        "cache_read_tokens": seen("cache_read"),
        "cache_write_tokens": seen("cache_write"),
        "cache_ttl_breakdown": F.when(F.col("cache_write_1h").isNotNull(), "supported").when(F.col("cache_write").isNotNull(), "unsupported").otherwise("unknown"),
        "reasoning_tokens": F.when(F.col("reasoning").isNotNull(), "supported").when(F.col("reasoning_absent") > 0, "unsupported").otherwise("unknown"),
        "model_identity": F.when(F.col("model").isNotNull(), "supported").otherwise("unsupported"),
        "per_request_latency": F.lit("unsupported"),
        "provider_reported_cost": F.lit("unsupported"),
        "actual_billed_cost": F.lit("unsupported"),
        "sub_agent_attribution": F.when(F.col("sidechain"), "supported").otherwise("unknown"),
        "failure_visibility": F.when(F.col("failures") > 0, "supported").otherwise("unknown"),
    }
    wide = observed(facts).select("adapter_id", *(F.when(F.col("usage_rows") == 0, "unknown").otherwise(states[c]).alias(c) for c in CAPABILITIES))
    return wide.unpivot("adapter_id", list(CAPABILITIES), "capability", "state")


def descriptors(facts: DataFrame) -> DataFrame:
    """The matrix of all applications: what facts show of those that are read, and that the others count nothing.

    A producer without a fact is unknown throughout.
    """
    shown = capabilities(facts)
    names = F.explode(F.array(*map(F.lit, CAPABILITIES))).alias("capability")
    spark = facts.sparkSession
    silent = spark.createDataFrame([(a,) for a in MEASURED], "adapter_id string").join(shown.select("adapter_id").distinct(), "adapter_id", "left_anti")
    others = spark.createDataFrame([(a,) for a in UNMEASURED], "adapter_id string")
    rows = [shown, silent.select("adapter_id", names, F.lit("unknown").alias("state")), others.select("adapter_id", names, F.lit("unsupported").alias("state"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])
