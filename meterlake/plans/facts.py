"""A deterministic stand-in for request facts, derived from the events table, and its price list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.usage import FAILED


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("k", F.get_json_object("props", "$.k").cast("long"))


def usage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per event: see FACTS_SQL for the same projection in SQL."""
    failed = F.col("event_type") == "error"
    codex = F.col("user_id") % 3 == 1

    def band(value):
        return F.when(failed, F.lit(0)).otherwise(value).cast("long")

    zero = F.lit(0).cast("long")
    k, adapter = F.col("k"), F.col("user_id") % 3
    return events(spark, sf_dir).select(
        "event_id", F.col("ts").alias("occurred_at"),
        F.when(adapter == 0, "claude_code").when(adapter == 1, "codex").otherwise("copilot").alias("adapter_id"),
        F.concat(F.lit("s"), F.col("user_id")).alias("session_id"),
        F.expr("k div 10").cast("string").alias("dedup_key"),
        F.when(F.col("user_id") % 7 == 0, F.concat(F.lit("t"), F.col("user_id"))).alias("task_id"),
        F.when(F.col("event_id") % 4 == 0, "claude-opus-5").when(F.col("event_id") % 4 == 1, "gpt-5.6-sol").when(F.col("event_id") % 4 == 2, "no-such-model").alias("model_id"),
        F.when(failed, FAILED).otherwise("turn").alias("request_kind"),
        F.when(adapter == 0, "provider_exact").when(adapter == 1, "provider_cumulative_delta").otherwise("provider_otel_span").alias("measurement_source"),
        F.when(F.col("event_id") % 3 != 0, F.col("props")).alias("raw_json"),
        (F.col("event_id") % 5 == 0).alias("is_sidechain"),
        band(10 * k).alias("input_fresh"), band(7 * k).alias("cache_read"),
        band(F.when(adapter == 0, 2 * k).otherwise(zero)).alias("cache_write_5m"), band(F.when(adapter == 0, k).otherwise(zero)).alias("cache_write_1h"),
        band(F.when(codex, 3 * k).otherwise(zero)).alias("cache_write_unspecified"),
        band(k).alias("output_total"), band(F.when(F.col("event_id") % 50 == 0, k).otherwise(zero)).alias("unclassified"),
        F.when(codex & ~failed, k).alias("reasoning"),
    )


FACTS_SQL = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
facts AS (
    SELECT event_id, ts AS occurred_at, CASE user_id % 3 WHEN 0 THEN 'claude_code' WHEN 1 THEN 'codex' ELSE 'copilot' END AS adapter_id,
        's' || user_id AS session_id, CAST(k // 10 AS VARCHAR) AS dedup_key, CASE WHEN user_id % 7 = 0 THEN 't' || user_id END AS task_id,
        CASE event_id % 4 WHEN 0 THEN 'claude-opus-5' WHEN 1 THEN 'gpt-5.6-sol' WHEN 2 THEN 'no-such-model' END AS model_id,
        CASE WHEN event_type = 'error' THEN 'failed' ELSE 'turn' END AS request_kind,
        CASE user_id % 3 WHEN 0 THEN 'provider_exact' WHEN 1 THEN 'provider_cumulative_delta' ELSE 'provider_otel_span' END AS measurement_source,
        CASE WHEN event_id % 3 <> 0 THEN props END AS raw_json, event_id % 5 = 0 AS is_sidechain,
        CASE WHEN event_type = 'error' THEN 0 ELSE 10 * k END AS input_fresh, CASE WHEN event_type = 'error' THEN 0 ELSE 7 * k END AS cache_read,
        CASE WHEN event_type <> 'error' AND user_id % 3 = 0 THEN 2 * k ELSE 0 END AS cache_write_5m,
        CASE WHEN event_type <> 'error' AND user_id % 3 = 0 THEN k ELSE 0 END AS cache_write_1h,
        CASE WHEN event_type <> 'error' AND user_id % 3 = 1 THEN 3 * k ELSE 0 END AS cache_write_unspecified,
        CASE WHEN event_type = 'error' THEN 0 ELSE k END AS output_total,
        CASE WHEN event_type <> 'error' AND event_id % 50 = 0 THEN k ELSE 0 END AS unclassified,
        CASE WHEN event_type <> 'error' AND user_id % 3 = 1 THEN k END AS reasoning
    FROM ev
)"""

#: (version_id, model_id, input, output, cache_read, write_5m, write_1h rates, effective_from, source)
PRICES = (
    ("v1", "claude-opus-5", 5_000_000_000, 25_000_000_000, 500_000_000, 6_250_000_000, 10_000_000_000, "2024-01-01 00:00:00", "seed"),
    ("v2", "gpt-5.6-sol", 5_000_000_000, 30_000_000_000, 500_000_000, None, None, "2023-12-01 00:00:00", "seed"),
    ("v3", "gpt-5.6-sol", 4_000_000_000, 20_000_000_000, 400_000_000, None, None, "2024-01-15 12:00:00", "seed"),
    ("v4", "gpt-5.6-sol", 4_500_000_000, 20_000_000_000, 400_000_000, None, None, "2024-01-15 12:00:00", "user"),
)
PRICE_SCHEMA = "version_id string, model_id string, input_rate long, output_rate long, cache_read_rate long, write_5m_rate long, write_1h_rate long, effective_from string, source string"


def prices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), PRICE_SCHEMA).withColumn("effective_from", F.col("effective_from").cast("timestamp_ntz"))


def _value(x) -> str:
    return "NULL" if x is None else str(x) if isinstance(x, int) else f"'{x}'"


PRICES_SQL = f"""prices AS (
    SELECT version_id, model_id, CAST(i AS BIGINT) AS input_rate, CAST(o AS BIGINT) AS output_rate, CAST(coalesce(r, i) AS BIGINT) AS cache_read_rate,
        CAST(coalesce(w5, i) AS BIGINT) AS write_5m_rate, CAST(coalesce(w1, i) AS BIGINT) AS write_1h_rate, CAST(f AS TIMESTAMP) AS effective_from, source
    FROM (VALUES {", ".join("(" + ", ".join(map(_value, p)) + ")" for p in PRICES)}) t(version_id, model_id, i, o, r, w5, w1, f, source)
)"""

#: (quote_currency, rate in 1e-9, as_of, source)
FX = (("EUR", 900_000_000, "2024-01-01 00:00:00", "bank"), ("EUR", 920_000_000, "2024-01-29 00:00:00", "bank"), ("CZK", 23_000_000_000, "2024-01-10 00:00:00", "bank"))


def fx_rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(FX), "quote_currency string, rate_nano long, as_of string, source string").withColumn("as_of", F.col("as_of").cast("timestamp"))


def order_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price list with a version per order, so it grows with the tables: see ORDER_PRICES_SQL. Some start at the same time, some lack cache rates."""
    key = F.col("o_orderkey")
    rate = (F.round(F.col("o_totalprice") * 100).cast("long") * 100).alias("input_rate")
    priced = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.format_string("o%012d", key).alias("version_id"), F.concat(F.lit("m"), F.col("o_custkey") % 40).alias("model_id"), rate, (key % 1000 * 1_000_000).alias("output_rate"),
        F.when(key % 3 == 0, key % 77 * 100_000).alias("cache_read_rate"), F.when(key % 5 == 0, key % 99 * 100_000).alias("write_5m_rate"), F.lit(None).cast("long").alias("write_1h_rate"),
        F.col("o_orderdate").alias("effective_from"), F.when(key % 7 == 0, "user").otherwise("seed").alias("source"),
    )
    return priced


ORDER_PRICES_SQL = """prices AS (
    SELECT version_id, model_id, input_rate, output_rate, coalesce(r, input_rate) AS cache_read_rate, coalesce(w5, input_rate) AS write_5m_rate, input_rate AS write_1h_rate, effective_from, source
    FROM (SELECT 'o' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS version_id, 'm' || (o_custkey % 40) AS model_id, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS input_rate, o_orderkey % 1000 * 1000000 AS output_rate,
        CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 77 * 100000 END AS r, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 99 * 100000 END AS w5, o_orderdate AS effective_from, CASE WHEN o_orderkey % 7 = 0 THEN 'user' ELSE 'seed' END AS source FROM orders)
)"""


def order_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange rates with one per order, some of the same date: see ORDER_RATES_SQL."""
    key = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        F.when(key % 3 == 0, "EUR").otherwise("CZK").alias("quote_currency"), (F.round(F.col("o_totalprice") * 100).cast("long") * 100).alias("rate_nano"),
        F.col("o_orderdate").cast("timestamp").alias("as_of"), F.lower("o_orderpriority").alias("source"),
    )


ORDER_RATES_SQL = """fx AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'CZK' END AS quote_currency, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS rate_nano, o_orderdate AS as_of, lower(o_orderpriority) AS source FROM orders),
ranked AS (SELECT *, row_number() OVER (PARTITION BY quote_currency ORDER BY as_of DESC, source, rate_nano) AS pick FROM fx)"""


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage with a row per line item, over all models of ``order_prices`` and one that it does not know: see PART_FACTS_SQL."""
    qty = F.col("l_quantity").cast("long")
    none = F.lit(0).cast("long")
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("m"), F.when(F.col("l_suppkey") % 3 == 0, F.lit(7)).otherwise(F.col("l_partkey") % 41)).alias("model_id"), F.col("l_shipdate").alias("occurred_at"),
        qty.alias("input_fresh"), (qty * 2).alias("output_total"), (qty * 3).alias("cache_read"), none.alias("cache_write_5m"), qty.alias("cache_write_1h"), none.alias("cache_write_unspecified"),
    )


PART_FACTS_SQL = """facts AS (SELECT l_orderkey, l_linenumber, 'm' || CASE WHEN l_suppkey % 3 = 0 THEN 7 ELSE l_partkey % 41 END AS model_id, l_shipdate AS occurred_at, CAST(trunc(l_quantity) AS BIGINT) AS input_fresh, CAST(trunc(l_quantity) AS BIGINT) * 2 AS output_total,
    CAST(trunc(l_quantity) AS BIGINT) * 3 AS cache_read, 0 AS cache_write_5m, CAST(trunc(l_quantity) AS BIGINT) AS cache_write_1h, 0 AS cache_write_unspecified FROM lineitem)"""
