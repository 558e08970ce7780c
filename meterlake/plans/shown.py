"""Registered queries of what reports show: money, rates, times, sentences, descriptors, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, measured, usage
from ..operators import merge, pricing, redact
from ..operators import usage as ops
from ..operators.usage import DAY
from . import catalog as c
from .catalog import query
from .facts import ORDER_RATES_SQL, events, order_rates, prices, usage_facts

NOW = "2024-01-30 12:00:00"


def _even(amount: str, digits: int) -> str:
    """Whole 1e-15 units as text with so many digits, half to even."""
    unit = 10 ** (15 - digits)
    up = f"CASE WHEN ({amount}) % {unit} * 2 > {unit} OR (({amount}) % {unit} * 2 = {unit} AND ({amount}) // {unit} % 2 = 1) THEN 1 ELSE 0 END"
    n = f"(({amount}) // {unit} + {up})"
    return f"CAST({n} // {10**digits} AS VARCHAR) || '.' || lpad(CAST({n} % {10**digits} AS VARCHAR), {digits}, '0')"


MONEY_SQL = f"CASE WHEN c >= 1000000000000000 THEN {_even('c', 2)} WHEN c >= 10000000000000 THEN {_even('c', 4)} ELSE {_even('c', 6)} END"


@query(f"""{c.WITH}, {c.SPANS_SQL}, {c._asof_sql('ok', 'occurred_at')}, costed AS (SELECT event_id, CAST(CAST({c.COST_SQL} AS DECIMAL(38, 0)) AS HUGEINT) * CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 37 ELSE 1001 END AS c FROM priced)
    SELECT event_id, CASE WHEN c IS NULL THEN '—' ELSE '≈€' || {MONEY_SQL} END AS shown FROM costed""")
def money_display(spark: SparkSession, d: str) -> DataFrame:
    priced = pricing.price_asof(ops.EVERYTHING.usage(usage_facts(spark, d)), prices(spark), "occurred_at")
    times = F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 3 == 1, 37).otherwise(1001)
    amount = pricing.usd((pricing.cost_e15() * times).cast("decimal(38,0)"))
    return priced.select("event_id", display.money_text(amount, F.lit("calculated"), F.lit("EUR")).alias("shown"))


@query(f"""{c.NATIVE}, r AS (SELECT event_id, k * 7500000 + event_id % 10 * 1000 AS n, k * user_id * 1000 - 5000 AS t FROM ev)
    SELECT event_id, regexp_replace((n // 1000000000) || '.' || lpad(CAST(n % 1000000000 AS VARCHAR), 9, '0'), '0{{1,7}}$', '') AS rate, format('{{:,}}', CAST(t AS BIGINT)) AS tokens FROM r""")
def rate_display(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    return events(spark, d).select("event_id", display.rate(k * 7_500_000 + e % 10 * 1000).alias("rate"), display.grouped(k * F.col("user_id") * 1000 - 5000).alias("tokens"))


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stored,
    CASE WHEN event_id % 10 = 0 THEN 'unknown value of' ELSE strftime(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Prague', '%Y-%m-%d %H:%M') END AS local FROM events""")
def time_display(spark: SparkSession, d: str) -> DataFrame:
    stored = display.stored_time(F.col("ts"))
    text = F.when(F.col("event_id") % 10 == 0, "unknownTvalue of a file").otherwise(stored)
    return events(spark, d).select("event_id", stored.alias("stored"), display.local_minute(text, "Europe/Prague").alias("local"))


CODES = ("usd", "EUR", "cZk", "GBP", "")
CODES_SQL = "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(CODES)) + " END"


@query(f"""WITH e AS (SELECT event_id, {CODES_SQL} AS given FROM events), p AS (SELECT *, CASE WHEN upper(given) IN ('USD', 'EUR', 'CZK') THEN upper(given) END AS code FROM e)
    SELECT event_id, code, CASE code WHEN 'EUR' THEN '€' WHEN 'CZK' THEN 'Kč' ELSE '$' END AS symbol FROM p""")
def currency_display(spark: SparkSession, d: str) -> DataFrame:
    given = F.element_at(F.array(*map(F.lit, CODES)), (F.col("event_id") % 5 + 1).cast("int"))
    return events(spark, d).select("event_id", display.currency(given).alias("code")).withColumn("symbol", display.symbol(F.col("code")))


ASKED_SQL = "asked AS (SELECT * FROM (VALUES ('EUR'), ('CZK'), ('USD')) t(code))"
# fixed values: the sentences that reports say of a rate
SENTENCE_SQL = f"""CASE WHEN as_of IS NULL THEN 'No exchange rate available.' WHEN date_diff('second', as_of, TIMESTAMP '{NOW}') // 86400 >= 7
    THEN 'FX rate ' || date_diff('second', as_of, TIMESTAMP '{NOW}') // 86400 || ' days old, from ' || strftime(as_of, '%Y-%m-%d') || ' (' || source || '). Amounts shown in ' || code || ' are approximate.'
    ELSE 'FX rate updated ' || strftime(as_of, '%Y-%m-%d') || ' (' || source || ').' END"""


@query(f"""WITH {ORDER_RATES_SQL}, mine AS (SELECT quote_currency, rate_nano, as_of, source FROM fx UNION ALL SELECT 'CZK', 22500000000, TIMESTAMP '2024-01-28 00:00:00', 'manual'),
    latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quote_currency ORDER BY as_of DESC, source, rate_nano) AS pick FROM mine) WHERE pick = 1), {ASKED_SQL}
    SELECT code, CAST(rate_nano AS BIGINT) AS rate_nano, {SENTENCE_SQL} AS sentence FROM asked LEFT JOIN latest ON code = quote_currency""")
def fx_entered(spark: SparkSession, d: str) -> DataFrame:
    """The rates after a user entered one, as reports describe them."""
    rates = pricing.latest_rates(pricing.enter_rate(order_rates(spark, d), "czk", "22.5", "2024-01-28 00:00:00"))
    return _described(spark, rates).select("code", "rate_nano", "sentence")


@query(f"""WITH {ORDER_RATES_SQL}, {ASKED_SQL} SELECT code, {SENTENCE_SQL} AS sentence FROM asked LEFT JOIN (SELECT * FROM ranked WHERE pick = 1) ON code = quote_currency""")
def fx_described(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, pricing.latest_rates(order_rates(spark, d))).select("code", "sentence")


def _described(spark: SparkSession, rates: DataFrame) -> DataFrame:
    asked = spark.createDataFrame([("EUR",), ("CZK",), ("USD",)], "code string")
    age = F.floor((F.unix_seconds(F.lit(NOW).cast("timestamp")) - F.unix_seconds("as_of")) / 86400)
    both = asked.join(rates, F.col("code") == F.col("quote_currency"), "left")
    return both.withColumn("sentence", display.rate_sentence(F.col("as_of"), F.col("source"), F.col("code"), age))


REASONS = ("no_telemetry", "not_reported_by_provider", "request_failed", "no_pricing_for_model", "model_unknown", "subscription_billed", "requires_capture_level")


@query("""SELECT event_id, CASE event_id % 7 WHEN 3 THEN 'No price is configured for model `m' || user_id || '`.' WHEN 5 THEN 'Billed under the m' || user_id || ' subscription, not per token.'
    WHEN 6 THEN 'Seen ' || event_type || '. Enable m' || user_id || ' to measure this.' ELSE 'Seen ' || event_type || '.' END AS sentence FROM events""")
def reason_sentences(spark: SparkSession, d: str) -> DataFrame:
    reason = F.element_at(F.array(*map(F.lit, REASONS)), (F.col("event_id") % 7 + 1).cast("int"))
    detail = F.concat(F.lit("Seen "), "event_type", F.lit("."))
    return events(spark, d).select("event_id", measured.sentence(reason, F.concat(F.lit("m"), "user_id"), detail).alias("sentence"))


@query(f"""{c.PRICED_DAYS}, {c._costs_sql('model_id')} SELECT model_id, cost_e15 AS api_e15, kind AS api_kind, reason AS api_reason, 'unavailable' AS provider_kind, 'This agent does not report a cost figure.' AS provider_reason,
    'unavailable' AS billed_kind, 'Billed under the team subscription, not per token.' AS billed_reason FROM measured""")
def cost_breakdown(spark: SparkSession, d: str) -> DataFrame:
    triple = measured.cost_breakdown(pricing.cost_measured(c._priced(spark, d), ["model_id"]), "team")
    names = {"api_equivalent": "api", "provider_reported": "provider", "actual_billed": "billed"}
    parts = [F.col(f"{a}.{x}").alias(f"{b}_{x}") for a, b in names.items() for x in ("kind", "reason")]
    return triple.select("model_id", F.col("api_equivalent.cost_e15").alias("api_e15"), *parts)


@query(f"""WITH {c.FACTS_SQL} SELECT DISTINCT adapter_id, {", ".join(f"'Logs hold no request times. Enable L2 to measure this.' AS {x}" for x in measured.LATENCIES)} FROM facts""")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    adapters = usage_facts(spark, d).select("adapter_id").distinct()
    shape = measured.latency_summary(adapters, "Logs hold no request times.", "L2")
    return shape.select("adapter_id", *(F.coalesce(F.col(f"{x}.value").cast("string"), F.col(f"{x}.reason")).alias(x) for x in measured.LATENCIES))


def _gauge(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.date_format("ts", DAY).alias("day"), (F.col("k") * F.col("user_id")).alias("tokens"))
    return merge.daily_gauge(rows, "day", "tokens")


@query(f"""{c.NATIVE}, g AS (SELECT strftime(ts, '%Y-%m-%d') AS day, max(k * user_id) AS tokens FROM ev GROUP BY 1), n AS (SELECT * FROM g ORDER BY day DESC LIMIT 14)
    SELECT max(day) AS day, arg_max(tokens, day) AS tokens, 'calculated' AS kind, 'application_telemetry' AS source, string_agg(day || '=' || tokens, ',' ORDER BY day DESC) AS history FROM n""")
def gauge_history(spark: SparkSession, d: str) -> DataFrame:
    total = measured.daily_total(_gauge(spark, d), 14)
    each = F.transform("history", lambda x: F.concat_ws("=", x["day"], x["tokens"].cast("string")))
    return total.select("day", "tokens", "kind", "source", F.array_join(each, ",").alias("history"))


@query(f"""{c.WITH}, {c.DAY_SLICES}, daily AS (SELECT "at", CAST(sum({c.GRAND_SQL}) AS BIGINT) AS tokens FROM slices GROUP BY 1) SELECT * FROM daily ORDER BY "at" DESC LIMIT 10""")
def last_buckets(spark: SparkSession, d: str) -> DataFrame:
    series = ops.fold_buckets(c._day_slices(spark, d)).select("at", usage.grand_total().alias("tokens"))
    return ops.last_buckets(series, 10)


@query("""SELECT event_id, event_id % 4 = 0 AND event_id % 6 = 0 AS nothing FROM events""")
def zero_counters(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    return events(spark, d).select("event_id", usage.is_zero(e % 4, F.when(e % 6 != 0, F.lit(1)), F.lit(0)).alias("nothing"))


@query(f"""WITH {c.FACTS_SQL}, old AS (SELECT adapter_id, session_id, dedup_key, {c.MAXES} FROM facts WHERE event_id % 3 <> 0 GROUP BY 1, 2, 3), every AS (SELECT adapter_id, session_id, dedup_key, {c.MAXES} FROM facts WHERE event_id % 3 <> 0 OR event_id % 2 = 0 GROUP BY 1, 2, 3),
    keys AS (SELECT DISTINCT adapter_id, session_id, dedup_key FROM facts WHERE event_id % 2 = 0)
    SELECT k.*, CASE WHEN o.adapter_id IS NULL THEN 'inserted' WHEN {" AND ".join(f"o.{b} IS NOT DISTINCT FROM e.{b}" for b in (*usage.BANDS, "reasoning"))} THEN 'unchanged' ELSE 'updated' END AS outcome
    FROM keys k JOIN every e USING (adapter_id, session_id, dedup_key) LEFT JOIN old o USING (adapter_id, session_id, dedup_key)""")
def merge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    facts = usage_facts(spark, d)
    rows = [facts.filter(x).select(*merge.KEY, *usage.BANDS, "reasoning") for x in ("event_id % 3 != 0", "event_id % 2 = 0")]
    return merge.outcomes(*rows)


KEEP, PATHS = {"type", "id"}, {"cwd"}
def _masked_sql(x: str) -> str:
    return f"CASE WHEN length({x}) <= 3 THEN {x} ELSE repeat('x', least(length({x}), 200)) END"


SHORT_SQL = "replace(substr(text, 1, CAST(1 + turn % 5 AS INTEGER)), chr(10), ' ')"


@query(f"""SELECT conv_id, turn, '{{"type": "' || role || '", "cwd": "/redacted/path-' || substr(sha256('/home/u' || conv_id), 1, 16) || '", "n": ' || turn || ', "text": "' || {_masked_sql('text')} || '", "deep": [{{"id": "' || role || '", "k": "' || {_masked_sql(SHORT_SQL)} ||
    '", "at": "/redacted/path-' || substr(sha256('/tmp/' || turn), 1, 16) || '"}}]}}' AS value, CAST(NULL AS VARCHAR) AS leak, CASE WHEN length(text) > 3 THEN substr(text, 1, 200) END AS first_leak FROM conversations""")
def redact_text(spark: SparkSession, d: str) -> DataFrame:
    """Lines with kept keys, paths, text, short strings and nesting, redacted; and what the check finds in them before and after."""
    rows = spark.read.parquet(f"{d}/conversations.parquet")
    short = F.replace(F.substring("text", F.lit(1), (1 + F.col("turn") % 5).cast("int")), F.lit("\n"), F.lit(" "))
    deep = F.array(F.struct(F.col("role").alias("id"), short.alias("k"), F.concat(F.lit("/tmp/"), "turn").alias("at")))
    line = F.struct(F.col("role").alias("type"), F.concat(F.lit("/home/u"), "conv_id").alias("cwd"), F.col("turn").alias("n"), "text", deep.alias("deep"))
    raw = F.struct(F.col("role").alias("type"), F.col("turn").alias("n"), "text")
    lines = rows.select("conv_id", "turn", F.to_json(line).alias("value"), F.to_json(raw).alias("raw"))
    clean = redact.leaks(redact.redact_json(lines, KEEP, PATHS), KEEP)
    before = redact.leaks(clean.select("conv_id", "turn", F.col("value").alias("done"), F.col("leak").alias("none"), F.col("raw").alias("value")), KEEP)
    return before.select("conv_id", "turn", F.col("done").alias("value"), F.col("none").alias("leak"), F.substring("leak", 1, 200).alias("first_leak"))
