"""The registered queries of the analytics operators, each beside the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import display, usage
from ..functions.measured import measured_sum, prefix, reasoning_measure
from ..operators import calendar, capability, merge, ordered, pricing
from ..operators import usage as ops
from ..operators.usage import DAY, HOUR, Filter
from ..sources import producers
from .facts import FACTS_SQL, FX, ORDER_PRICES_SQL, ORDER_RATES_SQL, PART_FACTS_SQL, PRICES_SQL, events, fx_rates, order_prices, order_rates, part_facts, prices, usage_facts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


BANDS_SQL = ", ".join(f"CAST(coalesce(sum({b}), 0) AS BIGINT) AS {b}" for b in usage.BANDS)
TOTALS_SQL = f"count(*) AS requests, {BANDS_SQL}, CAST(sum(reasoning) AS BIGINT) AS reasoning, count(reasoning) AS reasoning_reported_by"
WITH = f"WITH {FACTS_SQL}, ok AS (SELECT * FROM facts WHERE request_kind <> 'failed')"
INPUT_SQL = "input_fresh + cache_read + cache_write_5m + cache_write_1h + cache_write_unspecified"
GRAND_SQL = f"{INPUT_SQL} + output_total + unclassified"
BREAK_SQL = "TIMESTAMP '2024-01-15 12:00:00'"


def _slices_sql(fmt: str, zone: str | None = None, where: str = "TRUE") -> str:
    local = "occurred_at" if zone is None else f"occurred_at AT TIME ZONE 'UTC' AT TIME ZONE '{zone}'"
    return f"""slices AS (
        SELECT strftime({local}, '{fmt}') AS "at", model_id, CAST(occurred_at >= {BREAK_SQL} AS INTEGER) AS segment, {TOTALS_SQL}, min(occurred_at) AS first_at
        FROM ok WHERE {where} GROUP BY 1, 2, 3
    )"""


DAY_SLICES = _slices_sql("%Y-%m-%d")
TIMELINE_SQL = """
one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_id, effective_from ORDER BY source = 'user' DESC, version_id DESC) AS pick FROM prices) WHERE pick = 1),
spans AS (
    SELECT *, lead(effective_from) OVER (PARTITION BY model_id ORDER BY effective_from) AS effective_until,
        row_number() OVER (PARTITION BY model_id ORDER BY effective_from) AS n FROM one
)"""
SPANS_SQL = f"{PRICES_SQL}, {TIMELINE_SQL}"


def _asof_sql(source: str, at: str, name: str = "priced") -> str:
    return f"""{name} AS (
        SELECT s.*, p.version_id, p.effective_from, p.input_rate, p.output_rate, p.cache_read_rate, p.write_5m_rate, p.write_1h_rate
        FROM {source} s LEFT JOIN spans p ON s.model_id = p.model_id AND (p.n = 1 OR s.{at} >= p.effective_from) AND (p.effective_until IS NULL OR s.{at} < p.effective_until)
    )"""


COST_SQL = " + ".join(f"CAST({b} AS DECIMAL(20, 0)) * CAST({r} AS DECIMAL(18, 0))" for b, r in pricing.PRICED)


def _costs_sql(keys: str) -> str:
    return f"""costed AS (SELECT *, CAST({COST_SQL} AS DECIMAL(38, 0)) AS cost FROM priced),
    costs AS (
        SELECT {keys}, CAST(sum(cost) AS DECIMAL(38, 0)) AS cost_e15, count(*) AS items, count(cost) AS priced_items, CAST(sum(requests) AS BIGINT) AS requests,
            CAST(coalesce(sum(requests) FILTER (WHERE cost IS NOT NULL), 0) AS BIGINT) AS priced_requests,
            CAST(coalesce(sum(unclassified) FILTER (WHERE cost IS NOT NULL), 0) AS BIGINT) AS unpriceable
        FROM costed GROUP BY {keys}
    ),
    measured AS (
        SELECT *, CASE WHEN priced_items = 0 THEN 'unavailable' WHEN priced_items = items AND unpriceable = 0 THEN 'calculated' ELSE 'partial' END AS kind,
            CASE WHEN priced_items > 0 AND NOT (priced_items = items AND unpriceable = 0) THEN concat_ws('; ',
                CASE WHEN priced_items < items THEN (requests - priced_requests) || ' of ' || requests || ' requests have no price for their model' END,
                CASE WHEN unpriceable > 0 THEN unpriceable || ' tokens were counted by the provider without an input/output split and cannot be priced' END) END AS reason
        FROM costs
    )"""


COST_COLUMNS = "cost_e15, items, priced_items, requests, priced_requests, unpriceable, kind, reason"
PRICED_DAYS = f"{WITH}, {DAY_SLICES}, {SPANS_SQL}, {_asof_sql('slices', 'first_at')}"


def _nano(converted: DataFrame) -> DataFrame:
    """Whole 1e-9 units of converted amounts."""
    return converted.withColumn("converted_nano", F.expr("cast(converted_e24 div 1000000000000000 as bigint)"))



def _breaks(spark: SparkSession) -> list:
    return [r[0] for r in pricing.price_breaks(prices(spark)).collect()]


def _day_slices(spark: SparkSession, d: str) -> DataFrame:
    return ops.slices(usage_facts(spark, d), DAY, _breaks(spark))


def _priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price_asof(_day_slices(spark, d), prices(spark), "first_at")


# --- priced time series ---


@query(f"""{PRICED_DAYS}, {_costs_sql('"at"')} SELECT "at", {COST_COLUMNS} FROM measured""")
def daily_priced(spark: SparkSession, d: str) -> DataFrame:
    return pricing.cost_measured(_priced(spark, d), ["at"])


HOUR_SLICES = _slices_sql("%Y-%m-%dT%H")


@query(f"""{WITH}, {HOUR_SLICES}, {SPANS_SQL}, {_asof_sql('slices', 'first_at')}, {_costs_sql('"at"')} SELECT "at", {COST_COLUMNS} FROM measured""")
def hourly_priced(spark: SparkSession, d: str) -> DataFrame:
    sliced = ops.slices(usage_facts(spark, d), HOUR, _breaks(spark))
    return pricing.cost_measured(pricing.price_asof(sliced, prices(spark), "first_at"), ["at"])


@query(f"""{PRICED_DAYS}, {_costs_sql('model_id')} SELECT model_id, {COST_COLUMNS} FROM measured""")
def cost_by_model(spark: SparkSession, d: str) -> DataFrame:
    return pricing.cost_measured(_priced(spark, d), ["model_id"])


@query(f"""{WITH}, a AS (SELECT adapter_id, model_id, CAST(occurred_at >= {BREAK_SQL} AS INTEGER) AS segment, {TOTALS_SQL}, min(occurred_at) AS first_at FROM ok GROUP BY 1, 2, 3), {SPANS_SQL}, {_asof_sql('a', 'first_at')}, {_costs_sql('adapter_id')} SELECT adapter_id, {COST_COLUMNS}, CASE kind WHEN 'calculated' THEN '≈' WHEN 'partial' THEN '≥' ELSE '—' END AS prefix FROM measured""")
def cost_accuracy(spark: SparkSession, d: str) -> DataFrame:
    facts = ops.EVERYTHING.usage(usage_facts(spark, d)).withColumn("segment", ops.segment(_breaks(spark)))
    sliced = facts.groupBy("adapter_id", "model_id", "segment").agg(*usage.total_aggs(), F.min("occurred_at").alias("first_at"))
    return pricing.cost_measured(pricing.price_asof(sliced, prices(spark), "first_at"), ["adapter_id"]).withColumn("prefix", prefix(F.col("kind")))


@query(f"""{WITH}, {SPANS_SQL}, {_asof_sql('ok', 'occurred_at')} SELECT event_id, model_id, version_id, CAST({COST_SQL} AS DECIMAL(38, 0)) AS cost_e15 FROM priced""")
def asof_price(spark: SparkSession, d: str) -> DataFrame:
    facts = ops.EVERYTHING.usage(usage_facts(spark, d))
    return pricing.price_asof(facts, prices(spark), "occurred_at").select("event_id", "model_id", "version_id", pricing.cost_e15().alias("cost_e15"))


@query(f"""WITH {ORDER_PRICES_SQL}, firsts AS (SELECT model_id, min(effective_from) AS first FROM prices GROUP BY 1) SELECT DISTINCT effective_from FROM prices JOIN firsts USING (model_id) WHERE effective_from > first""")
def price_breaks(spark: SparkSession, d: str) -> DataFrame:
    return pricing.price_breaks(order_prices(spark, d))


@query(f"""WITH {ORDER_PRICES_SQL}, {TIMELINE_SQL} SELECT model_id, version_id, effective_from, effective_until, input_rate, cache_read_rate FROM spans""")
def price_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Versions in force of a list of very many: of equal starts the user's, then the last."""
    return pricing.timeline(order_prices(spark, d)).select("model_id", "version_id", "effective_from", "effective_until", "input_rate", "cache_read_rate")


@query(f"""WITH {ORDER_PRICES_SQL}, {TIMELINE_SQL}, {PART_FACTS_SQL}, starts AS (SELECT model_id, min(effective_from) AS first FROM spans GROUP BY 1),
    looked AS (SELECT f.*, greatest(f.occurred_at, s.first) AS held FROM facts f LEFT JOIN starts s USING (model_id)),
    priced AS (SELECT l.*, p.version_id, p.input_rate, p.output_rate, p.cache_read_rate, p.write_5m_rate, p.write_1h_rate FROM looked l ASOF LEFT JOIN spans p ON l.model_id = p.model_id AND l.held >= p.effective_from)
    SELECT model_id, count(*) AS items, count(version_id) AS priced_items, count(DISTINCT version_id) AS versions, min(version_id) AS least_version, CAST(sum({COST_SQL}) AS DECIMAL(38, 0)) AS cost_e15 FROM priced GROUP BY 1""")
def asof_price_list(spark: SparkSession, d: str) -> DataFrame:
    """Line items at the prices of a list with a version per order; a third of them are of one model."""
    priced = pricing.price_asof(part_facts(spark, d), order_prices(spark, d), "occurred_at").withColumn("cost", pricing.cost_e15())
    return priced.groupBy("model_id").agg(
        F.count(F.lit(1)).alias("items"), F.count("version_id").alias("priced_items"), F.count_distinct("version_id").alias("versions"), F.min("version_id").alias("least_version"),
        F.sum("cost").cast("decimal(38,0)").alias("cost_e15"),
    )


@query(f"""{PRICED_DAYS} SELECT DISTINCT model_id, version_id, effective_from FROM priced WHERE version_id IS NOT NULL""")
def rates_used(spark: SparkSession, d: str) -> DataFrame:
    return pricing.rates_used(_priced(spark, d))


@query(f"""{PRICED_DAYS}, actual AS (SELECT model_id, CAST(sum({COST_SQL}) AS DECIMAL(38, 0)) AS cost_e15 FROM priced GROUP BY 1),
    latest AS (SELECT s.*, p.input_rate, p.output_rate, p.cache_read_rate, p.write_5m_rate, p.write_1h_rate FROM slices s LEFT JOIN (SELECT * FROM spans WHERE effective_until IS NULL) p ON s.model_id = p.model_id),
    flat AS (SELECT model_id, CAST(sum({COST_SQL}) AS DECIMAL(38, 0)) AS flat_e15 FROM latest GROUP BY 1)
    SELECT a.model_id, cost_e15, flat_e15, cost_e15 IS NOT DISTINCT FROM flat_e15 AS reproduces FROM actual a JOIN flat f ON a.model_id IS NOT DISTINCT FROM f.model_id""")
def one_rate(spark: SparkSession, d: str) -> DataFrame:
    return pricing.one_rate(_day_slices(spark, d), prices(spark))


@query(f"""{WITH}, {PRICES_SQL} SELECT model_id, count(*) AS requests FROM ok WHERE model_id IS NOT NULL AND model_id NOT IN (SELECT model_id FROM prices) GROUP BY 1""")
def unpriced_models(spark: SparkSession, d: str) -> DataFrame:
    return pricing.unpriced_models(ops.EVERYTHING.usage(usage_facts(spark, d)), prices(spark))


@query(f"""{PRICED_DAYS}, {_costs_sql('"at"')} SELECT "at", cost_e15, CAST(CAST(cost_e15 AS HUGEINT) * {FX[1][1]} // 1000000000000000 AS BIGINT) AS converted_nano, kind, CASE WHEN cost_e15 IS NULL THEN kind ELSE 'calculated' END AS fx_kind, kind = 'partial' AS is_floor FROM measured""")
def fx_convert(spark: SparkSession, d: str) -> DataFrame:
    costs = pricing.cost_measured(_priced(spark, d), ["at"])
    return _nano(pricing.convert(costs, fx_rates(spark), "eur", "2024-01-30 12:00:00")).select("at", "cost_e15", "converted_nano", "kind", "fx_kind", "is_floor")


@query(f"""{PRICED_DAYS}, {_costs_sql('"at"')} SELECT "at", CAST(CAST(cost_e15 AS HUGEINT) * {FX[2][1]} // 1000000000000000 AS BIGINT) AS converted_nano, CASE WHEN cost_e15 IS NULL THEN kind ELSE 'estimated' END AS fx_kind FROM measured""")
def fx_stale(spark: SparkSession, d: str) -> DataFrame:
    costs = pricing.cost_measured(_priced(spark, d), ["at"])
    return _nano(pricing.convert(costs, fx_rates(spark), "CZK", "2024-01-30 12:00:00")).select("at", "converted_nano", "fx_kind")


@query(f"""WITH {ORDER_RATES_SQL} SELECT quote_currency, rate_nano, source, CAST(floor(date_diff('second', as_of, TIMESTAMP '2024-01-30 12:00:00') / 86400) AS BIGINT) AS age_days FROM ranked WHERE pick = 1""")
def fx_latest(spark: SparkSession, d: str) -> DataFrame:
    age = F.floor((F.unix_seconds(F.lit("2024-01-30 12:00:00").cast("timestamp")) - F.unix_seconds("as_of")) / 86400)
    return pricing.latest_rates(order_rates(spark, d)).select("quote_currency", "rate_nano", "source", age.alias("age_days"))


@query(f"""{PRICED_DAYS}, {_costs_sql('model_id')} SELECT model_id, cost_e15, row_number() OVER (ORDER BY cost_e15 ASC NULLS LAST, model_id NULLS FIRST) AS cheapest, row_number() OVER (ORDER BY cost_e15 DESC NULLS LAST, model_id NULLS FIRST) AS dearest FROM measured""")
def cost_sort_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    costs = pricing.cost_measured(_priced(spark, d), ["model_id"]).select("model_id", "cost_e15")
    up = ops.positions(costs, "cost_e15", False, "model_id").withColumnRenamed("position", "cheapest")
    down = ops.positions(costs, "cost_e15", True, "model_id").select(F.col("model_id").alias("m"), F.col("position").alias("dearest"))
    return up.join(down, F.col("model_id").eqNullSafe(F.col("m"))).drop("m")


@query(f"""{PRICED_DAYS}, {_costs_sql('"at"')}, daily AS (SELECT "at", CAST(sum({GRAND_SQL}) AS BIGINT) AS tokens FROM slices GROUP BY "at")
    SELECT "at", tokens, cost_e15, kind FROM daily LEFT JOIN measured USING ("at")""")
def series_with_costs(spark: SparkSession, d: str) -> DataFrame:
    series = ops.fold_buckets(_day_slices(spark, d)).select("at", usage.grand_total().alias("tokens"))
    return series.join(pricing.cost_measured(_priced(spark, d), ["at"]).select("at", "cost_e15", "kind"), "at", "left")


@query(f"""{PRICED_DAYS}, {_costs_sql('model_id')}, m AS (SELECT model_id, {TOTALS_SQL} FROM ok GROUP BY 1)
    SELECT coalesce(m.model_id, '(not reported)') AS model, m.requests, cost_e15, kind FROM m JOIN measured c ON m.model_id IS NOT DISTINCT FROM c.model_id""")
def models_with_costs(spark: SparkSession, d: str) -> DataFrame:
    models = ops.by(usage_facts(spark, d), "model_id").select(F.col("model_id").alias("m"), "requests")
    costs = pricing.cost_measured(_priced(spark, d), ["model_id"]).drop("requests")
    return models.join(costs, F.col("m").eqNullSafe(F.col("model_id"))).select(F.coalesce("m", F.lit("(not reported)")).alias("model"), "requests", "cost_e15", "kind")


# --- totals ---


@query(f"""{WITH} SELECT {TOTALS_SQL} FROM ok""")
def totals(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(usage_facts(spark, d))


@query(f"""WITH {FACTS_SQL} SELECT count(*) AS failed FROM facts WHERE request_kind = 'failed'""")
def failed_count(spark: SparkSession, d: str) -> DataFrame:
    return ops.failed_count(usage_facts(spark, d))


@query(f"""{WITH} SELECT model_id, {TOTALS_SQL} FROM ok GROUP BY 1""")
def by_model(spark: SparkSession, d: str) -> DataFrame:
    return ops.by(usage_facts(spark, d), "model_id")


@query(f"""{WITH} SELECT adapter_id, {TOTALS_SQL} FROM ok GROUP BY 1""")
def by_adapter(spark: SparkSession, d: str) -> DataFrame:
    return ops.by(usage_facts(spark, d), "adapter_id")


@query(f"""{WITH}, {DAY_SLICES} SELECT * FROM slices""")
def slices_cut(spark: SparkSession, d: str) -> DataFrame:
    return _day_slices(spark, d)


@query(f"""{WITH} SELECT strftime(occurred_at, '%Y-%m-%d') AS "at", {TOTALS_SQL} FROM ok GROUP BY 1""")
def fold_buckets(spark: SparkSession, d: str) -> DataFrame:
    return ops.fold_buckets(_day_slices(spark, d))


@query(f"""{WITH} SELECT {TOTALS_SQL} FROM ok WHERE occurred_at >= TIMESTAMP '2024-01-05 00:00:00' AND occurred_at < TIMESTAMP '2024-01-20 06:00:00' AND adapter_id = 'codex'""")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    return ops.totals(usage_facts(spark, d), Filter("2024-01-05 00:00:00", "2024-01-20 06:00:00", "codex"))


@query(f"""{WITH}, t AS (SELECT adapter_id, {TOTALS_SQL} FROM ok GROUP BY 1) SELECT adapter_id, cache_write_5m + cache_write_1h + cache_write_unspecified AS cache_write_total, {INPUT_SQL} AS input_side, {GRAND_SQL} AS grand_total, cache_read * 1000 // nullif({INPUT_SQL}, 0) AS cache_hit_permille FROM t""")
def derived_totals(spark: SparkSession, d: str) -> DataFrame:
    t = ops.by(usage_facts(spark, d), "adapter_id")
    return t.select("adapter_id", usage.cache_write_total().alias("cache_write_total"), usage.input_side_total().alias("input_side"), usage.grand_total().alias("grand_total"), usage.cache_hit_permille().alias("cache_hit_permille"))


@query(f"""{WITH} SELECT count(*) AS unattributed FROM facts WHERE task_id IS NULL""")
def unattributed(spark: SparkSession, d: str) -> DataFrame:
    return ops.unattributed(usage_facts(spark, d))


@query(f"""{WITH}, b AS (SELECT DISTINCT 's' || user_id AS session_id, 'bound' || user_id AS task_id FROM events WHERE user_id % 5 = 0) SELECT b.task_id, count(*) AS requests, CAST(sum(output_total) AS BIGINT) AS output_total FROM ok LEFT JOIN b USING (session_id) GROUP BY 1""")
def bind_tasks(spark: SparkSession, d: str) -> DataFrame:
    bound = events(spark, d).filter("user_id % 5 = 0").select(F.concat(F.lit("s"), "user_id").alias("session_id"), F.concat(F.lit("bound"), "user_id").alias("task_id")).distinct()
    facts = ops.bind_tasks(ops.EVERYTHING.usage(usage_facts(spark, d)), bound)
    return facts.groupBy("task_id").agg(F.count(F.lit(1)).alias("requests"), F.sum("output_total").alias("output_total"))


SESSIONS_SQL = f"""SELECT session_id, adapter_id, max(model_id) AS model_id, count(*) FILTER (WHERE request_kind <> 'failed') AS requests, count(*) FILTER (WHERE request_kind = 'failed') AS failed,
    {BANDS_SQL}, CAST(sum(reasoning) AS BIGINT) AS reasoning, count(reasoning) FILTER (WHERE request_kind <> 'failed') AS reasoning_reported_by,
    min(occurred_at) AS first_at, max(occurred_at) AS last_at, bool_and(task_id IS NULL) AS unattributed FROM facts GROUP BY 1, 2"""


@query(f"""WITH {FACTS_SQL} {SESSIONS_SQL} ORDER BY last_at DESC, session_id, adapter_id LIMIT 30""")
def sessions_topk(spark: SparkSession, d: str) -> DataFrame:
    return ops.recent_sessions(usage_facts(spark, d))


@query(f"""WITH {FACTS_SQL} {SESSIONS_SQL}""")
def sessions_all(spark: SparkSession, d: str) -> DataFrame:
    return ops.sessions(usage_facts(spark, d))


@query(f"""{WITH}, m AS (SELECT session_id, {TOTALS_SQL} FROM ok GROUP BY 1) SELECT *, {GRAND_SQL} AS grand_total FROM m ORDER BY grand_total DESC, session_id LIMIT 8""")
def top_by_tokens(spark: SparkSession, d: str) -> DataFrame:
    return ops.top(ops.by(usage_facts(spark, d), "session_id"), "session_id")


@query(f"""{WITH}, t AS (SELECT adapter_id, {TOTALS_SQL} FROM ok GROUP BY 1) SELECT adapter_id, requests, reasoning, reasoning_reported_by,
    CASE WHEN reasoning IS NULL THEN 'unavailable' WHEN reasoning_reported_by < requests THEN 'partial' ELSE 'exact' END AS reasoning_kind,
    CASE WHEN reasoning IS NULL THEN 'not reported by the provider' WHEN reasoning_reported_by < requests THEN reasoning_reported_by || ' of ' || requests || ' requests report reasoning tokens' END AS reasoning_reason FROM t""")
def reasoning_measure_by_adapter(spark: SparkSession, d: str) -> DataFrame:
    return reasoning_measure(ops.by(usage_facts(spark, d), "adapter_id")).select("adapter_id", "requests", "reasoning", "reasoning_reported_by", "reasoning_kind", "reasoning_reason")


@query(f"""WITH {FACTS_SQL}, m AS (SELECT session_id, reasoning AS v, CASE WHEN reasoning IS NULL THEN 'unavailable' WHEN event_id % 2 = 0 THEN 'exact' ELSE 'calculated' END AS kind, CASE WHEN reasoning IS NULL THEN request_kind END AS reason FROM facts),
    s AS (SELECT session_id, CAST(sum(v) AS BIGINT) AS value, count(v) AS measured, count(*) AS total, min(CASE kind WHEN 'unavailable' THEN 0 WHEN 'calculated' THEN 3 ELSE 4 END) AS weakest, min(reason) AS reason FROM m GROUP BY 1)
    SELECT session_id, value, measured, total, CASE WHEN measured = 0 THEN 'unavailable' WHEN measured < total THEN 'partial' WHEN weakest = 3 THEN 'calculated' ELSE 'exact' END AS kind,
        CASE WHEN measured = 0 THEN reason WHEN measured < total THEN (total - measured) || ' of ' || total || ' contributing measurements reported a value; the rest could not be measured' END AS reason FROM s""")
def measured_sum_by_session(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("reasoning").isNull(), "unavailable").when(F.col("event_id") % 2 == 0, "exact").otherwise("calculated")
    facts = usage_facts(spark, d).withColumns({"k": kind, "why": F.when(F.col("reasoning").isNull(), F.col("request_kind"))})
    return measured_sum(facts, ["session_id"], "reasoning", "k", "why")


# --- merges ---

MAXES = ", ".join(f"max({b}) AS {b}" for b in (*usage.BANDS, "reasoning"))


@query(f"""WITH {FACTS_SQL} SELECT adapter_id, session_id, dedup_key, {MAXES}, min(occurred_at) AS occurred_at, arg_min(model_id, (occurred_at, event_id)) FILTER (WHERE model_id IS NOT NULL) AS model_id,
    arg_min(request_kind, (occurred_at, event_id)) AS request_kind, max(event_id) AS last_event_id, count(*) AS copies FROM facts GROUP BY 1, 2, 3""")
def dedup_max(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_max(usage_facts(spark, d))


@query(f"""WITH {FACTS_SQL} SELECT adapter_id, session_id, dedup_key, {MAXES}, min(occurred_at) AS occurred_at FROM facts GROUP BY 1, 2, 3""")
def merge_incremental(spark: SparkSession, d: str) -> DataFrame:
    facts = usage_facts(spark, d).select(*merge.KEY, *usage.BANDS, "reasoning", "occurred_at", "event_id")
    old = merge.merge_into(facts.filter("event_id % 3 != 0").drop("event_id"), facts.limit(0).drop("event_id"))
    return merge.merge_into(old, facts.filter("event_id % 2 = 0 or event_id % 3 = 0").drop("event_id"))


@query(f"""WITH {FACTS_SQL} SELECT adapter_id, session_id, dedup_key, measurement_source, {MAXES}, arg_max(raw_json, (occurred_at, event_id)) FILTER (WHERE raw_json IS NOT NULL) AS raw_json FROM facts GROUP BY 1, 2, 3, 4""")
def per_source_max(spark: SparkSession, d: str) -> DataFrame:
    return merge.per_source(usage_facts(spark, d))


@query(f"""WITH {FACTS_SQL}, f AS (SELECT adapter_id, session_id, dedup_key, min(occurred_at) AS occurred_at FROM facts WHERE request_kind = 'failed' GROUP BY 1, 2, 3) SELECT * FROM f WHERE (adapter_id, session_id, dedup_key) NOT IN (SELECT adapter_id, session_id, dedup_key FROM facts WHERE event_id % 10 = 0)""")
def failures_once(spark: SparkSession, d: str) -> DataFrame:
    facts = usage_facts(spark, d)
    return merge.failures_once(facts, facts.filter("event_id % 10 = 0"))


@query("WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT strftime(ts, '%Y-%m-%d') AS day, max(k * user_id) AS tokens FROM e GROUP BY 1")
def daily_max_gauge(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select(F.date_format("ts", DAY).alias("day"), (F.col("k") * F.col("user_id")).alias("tokens"))
    return merge.daily_gauge(rows, "day", "tokens")


# --- normalisation ---

NATIVE = "WITH ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(f"""{NATIVE}, n AS (SELECT event_id, 2 * k AS i, k AS o, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 10 * k END AS w, 3 * k AS r, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 4 * k END AS w5, CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id % 9) * k END AS w1 FROM ev)
    SELECT event_id, i AS input_fresh, r AS cache_read, o AS output_total, coalesce(w5, 0) AS cache_write_5m, coalesce(w1, 0) AS cache_write_1h,
        CASE WHEN w5 IS NULL THEN coalesce(w, 0) ELSE greatest(coalesce(w, 0) - (w5 + w1), 0) END AS cache_write_unspecified, w5 IS NOT NULL AND coalesce(w, 0) <> w5 + w1 AS discrepancy FROM n""")
def normalize_a(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    bands = usage.bands_a(2 * k, k, F.when(e % 4 != 0, 10 * k), 3 * k, F.when(e % 3 != 0, 4 * k), F.when(e % 3 != 0, (e % 9) * k))
    return events(spark, d).withColumns(bands).select("event_id", "input_fresh", "cache_read", "output_total", "cache_write_5m", "cache_write_1h", "cache_write_unspecified", "discrepancy")


@query(f"""{NATIVE}, n AS (SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 10 * k END AS i, CASE WHEN event_id % 17 = 0 THEN 0 ELSE (event_id % 12) * k END AS c, CASE WHEN event_id % 17 = 0 THEN 0 ELSE k END AS o, CASE WHEN event_id % 5 <> 0 THEN (event_id % 3) * k // 2 END AS r, CASE WHEN event_id % 6 <> 0 THEN 11 * k END AS t, event_id % 34 = 0 AS off FROM ev),
    m AS (SELECT *, off AND i + o = 0 AND coalesce(t, 0) > 0 AS bare FROM n)
    SELECT event_id, CASE WHEN bare THEN 0 ELSE i - c END AS input_fresh, CASE WHEN bare THEN 0 ELSE c END AS cache_read, CASE WHEN bare THEN 0 ELSE o END AS output_total, CASE WHEN bare THEN t ELSE 0 END AS unclassified,
        CASE WHEN NOT bare THEN coalesce(r, 0) END AS reasoning, NOT off AND t IS NOT NULL AND t <> i + o AS discrepancy FROM m WHERE bare OR NOT (c > i OR coalesce(r, 0) > o)""")
def normalize_b(spark: SparkSession, d: str) -> DataFrame:
    k, e = F.col("k"), F.col("event_id")
    gone = e % 17 == 0
    zero = F.lit(0).cast("long")
    bands = usage.bands_b(
        F.when(gone, zero).otherwise(10 * k), F.when(gone, zero).otherwise((e % 12) * k), zero, F.when(gone, zero).otherwise(k),
        F.when(e % 5 != 0, F.expr("(event_id % 3) * k div 2")), F.when(e % 6 != 0, 11 * k), e % 34 == 0,
    )
    return events(spark, d).withColumns(bands).filter("not invalid").select("event_id", "input_fresh", "cache_read", "output_total", "unclassified", "reasoning", "discrepancy")


def text(template: str, *values: Column) -> Column:
    """``format_string`` of a template with %d and %s as a concatenation, which sets up no formatter per row; NULL is ``null`` there too."""
    first, *rest = re.split("%[ds]", template)
    pairs = (x for v, after in zip(values, rest, strict=True) for x in (F.coalesce(v.cast("string"), F.lit("null")), F.lit(after)))
    return F.concat(F.lit(first), *pairs)


def dealt(spark: SparkSession, d: str) -> DataFrame:
    """Events in as many parts as there are cores, dealt before lines are made of them: lines are longer, and are made and read in one task."""
    return events(spark, d).repartition(spark.sparkContext.defaultParallelism, "event_id")


def lines_of(rows: DataFrame, line: Column) -> DataFrame:
    """A line per event. It passes a generator, so that filters and readers of ``value`` do not make it again."""
    made = rows.select(line.alias("line"), "event_id")
    return made.select(F.lit("f").alias("file_id"), F.col("event_id").alias("ordinal"), F.explode(F.array("line")).alias("value"))


def _span_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as trace spans: one a line, counts as strings or numbers, some in envelopes."""
    k, e = F.col("k"), F.col("event_id")

    def attribute(key: str, value):
        return text('{"key":"%s","value":{"intValue":%s}}', F.lit(key), value)

    quoted = F.when(e % 2 == 0, F.concat(F.lit('"'), 10 * k, F.lit('"'))).otherwise((10 * k).cast("string"))
    parts = [
        attribute("gen_ai.usage.input_tokens", quoted), attribute("gen_ai.usage.output_tokens", k),
        attribute("gen_ai.usage.cache_read.input_tokens", (e % 12) * k),
        F.when(e % 3 == 0, attribute("gen_ai.usage.reasoning.output_tokens", k - e % 2)),
        text('{"key":"gen_ai.conversation.id","value":{"stringValue":"c%d"}}', F.col("user_id")),
    ]
    name = F.when(e % 10 == 9, "invoke_agent").otherwise("chat")
    span = F.concat(text('{"name":"%s","spanId":"x%d","traceId":"t","endTimeUnixNano":"%d","attributes":[', name, e, F.lit(1_700_000_000_000_000_000) + e * 1_000_000_000), F.concat_ws(",", *parts), F.lit("]}"))
    wrap = e % 4 == 0
    line = F.concat(F.when(wrap, '{"resourceSpans":[{"scopeSpans":[{"spans":[').otherwise(""), span, F.when(wrap, "]}]}]}").otherwise(""))
    return lines_of(dealt(spark, d), line)


@query(f"""{NATIVE} SELECT 'c' || user_id AS session_id, 'x' || event_id AS dedup_key, (10 - event_id % 12) * k AS input_fresh, (event_id % 12) * k AS cache_read, k AS output_total,
    CASE WHEN event_id % 3 = 0 AND k >= event_id % 2 THEN k - event_id % 2 END AS reasoning, make_timestamp(1700000000000000 + event_id * 1000000) AS occurred_at
    FROM ev WHERE event_id % 10 <> 9 AND NOT ((event_id % 12) * k > 10 * k)""")
def normalize_c(spark: SparkSession, d: str) -> DataFrame:
    usage_ = producers.parse_c(_span_lines(spark, d)).usage
    return usage_.select("session_id", "dedup_key", "input_fresh", "cache_read", "output_total", "reasoning", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query(f"""{NATIVE} SELECT CASE WHEN (event_id % 12) * k > 10 * k THEN 'copilot_cache_exceeds_input' ELSE 'copilot_reasoning_exceeds_output' END AS kind, count(*) AS n
    FROM ev WHERE event_id % 10 <> 9 AND ((event_id % 12) * k > 10 * k OR (event_id % 3 = 0 AND k - event_id % 2 > k)) GROUP BY 1""")
def anomalies_c(spark: SparkSession, d: str) -> DataFrame:
    return producers.parse_c(_span_lines(spark, d)).anomalies.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _transcript_lines(spark: SparkSession, d: str) -> DataFrame:
    """Events as transcript lines: failures, lines without keys, malformed ones and other types among them."""
    k, e = F.col("k"), F.col("event_id")
    usage_ = text('{"input_tokens":%d,"output_tokens":%d,"cache_creation_input_tokens":%d,"cache_read_input_tokens":%d,"cache_creation":{"ephemeral_5m_input_tokens":%d,"ephemeral_1h_input_tokens":%d}}', 2 * k, k, 5 * k, 3 * k, F.when(e % 5 == 0, 4 * k).otherwise(5 * k), F.lit(0))
    model = F.when(F.col("event_type") == "error", "<synthetic>").otherwise("m1")
    message = text('"message":{"id":"g%d","model":"%s","usage":%s}', e, model, usage_)
    keys = F.when(e % 13 == 0, F.lit("")).otherwise(text('"requestId":"r%d",', e))
    body = F.concat(F.lit('{"type":"assistant","timestamp":"2024-01-02T03:04:05.678Z",'), keys, text('"sessionId":"s%d",', F.col("user_id")), message, F.lit("}"))
    line = F.when(e % 29 == 0, F.lit('{"type":"assistant","message":{"usage":"x"}}')).when(e % 31 == 0, F.lit('{"type":"user","text":"nothing"}')).otherwise(body)
    return lines_of(dealt(spark, d), line)


@query(f"""{NATIVE} SELECT 's' || user_id AS session_id, CASE WHEN event_id % 13 = 0 THEN 'g' || event_id ELSE 'r' || event_id || ':g' || event_id END AS dedup_key, 2 * k AS input_fresh, k AS output_total, 3 * k AS cache_read,
    CASE WHEN event_id % 5 = 0 THEN 4 * k ELSE 5 * k END AS cache_write_5m, CASE WHEN event_id % 5 = 0 THEN k ELSE 0 END AS cache_write_unspecified, event_id % 5 = 0 AND k > 0 AS discrepancy, TIMESTAMP '2024-01-02 03:04:05.678' AS occurred_at
    FROM ev WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_type <> 'error'""")
def parse_transcripts(spark: SparkSession, d: str) -> DataFrame:
    got = producers.parse_a(_transcript_lines(spark, d)).usage
    return got.select("session_id", "dedup_key", "input_fresh", "output_total", "cache_read", "cache_write_5m", "cache_write_unspecified", "discrepancy", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query(f"""{NATIVE} SELECT 'malformed_line' AS kind, count(*) AS n FROM ev WHERE event_id % 29 = 0 UNION ALL
    SELECT 'provider_self_inconsistent', count(*) FROM ev WHERE event_id % 29 <> 0 AND event_id % 31 <> 0 AND event_type <> 'error' AND event_id % 5 = 0 AND k > 0""")
def anomalies(spark: SparkSession, d: str) -> DataFrame:
    return producers.parse_a(_transcript_lines(spark, d)).anomalies.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- ordered logic ---

#: A ledger per session: it stands still now and then, falls back now and then, and has gaps.
LEDGER = """ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k0 FROM events),
steps AS (SELECT *, CASE WHEN event_id % 11 = 0 THEN 0 ELSE k0 END AS step, event_id % 50 // 25 AS lk, sum(CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch FROM ev),
ledger AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 23 <> 0 THEN sum(2 * step) OVER w END AS inp, CASE WHEN event_id % 23 <> 0 THEN sum(step) OVER w END AS out, lk, epoch
    FROM steps WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
has AS (SELECT *, inp + out AS total, lag(inp + out) OVER s AS before, lag(lk) OVER s AS last_before, lag(inp) OVER s AS inp_before, lag(out) OVER s AS out_before, row_number() OVER s AS n FROM ledger WHERE inp IS NOT NULL WINDOW s AS (PARTITION BY user_id ORDER BY ts, event_id)),
kinds AS (SELECT *, CASE WHEN n = 1 THEN 'turn' WHEN total < before THEN 'reset' WHEN total > before THEN 'turn' WHEN lk = last_before THEN 'replay' ELSE 'off_ledger' END AS kind FROM has),
deltas AS (SELECT *, CAST(CASE kind WHEN 'turn' THEN greatest(inp - coalesce(inp_before, 0), 0) WHEN 'reset' THEN 2 * lk WHEN 'off_ledger' THEN 2 * lk END AS BIGINT) AS delta_inp,
    CAST(CASE kind WHEN 'turn' THEN greatest(out - coalesce(out_before, 0), 0) WHEN 'reset' THEN lk WHEN 'off_ledger' THEN lk END AS BIGINT) AS delta_out,
    CAST(CASE kind WHEN 'turn' THEN greatest(total - coalesce(before, 0), 0) WHEN 'reset' THEN 3 * lk WHEN 'off_ledger' THEN 3 * lk END AS BIGINT) AS delta_total FROM kinds)"""


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    order = ["ts", "event_id"]
    e = F.col("event_id")
    steps = events(spark, d).withColumns({"step": F.when(e % 11 == 0, F.lit(0)).otherwise(F.col("k")), "lk": F.expr("event_id % 50 div 25")})
    steps = steps.withColumn("epoch", F.sum((e % 97 == 0).cast("int")).over(W.partitionBy("user_id").orderBy(*order)))
    w = W.partitionBy("user_id", "epoch").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    there = e % 23 != 0
    flat = steps.withColumns({"inp": F.when(there, F.sum(2 * F.col("step")).over(w)), "out": F.when(there, F.sum("step").over(w))})
    flat = flat.withColumns({"cumulative": F.col("inp") + F.col("out"), "last_inp": 2 * F.col("lk"), "last_out": F.col("lk"), "last_total": 3 * F.col("lk")})
    return ordered.reconcile(flat, "user_id", order, ["inp", "out"], "cumulative", "last")


@query(f"""WITH {LEDGER} SELECT event_id, kind, delta_inp, delta_out, delta_total FROM deltas UNION ALL SELECT event_id, 'no_data', NULL, NULL, NULL FROM ledger WHERE inp IS NULL""")
def counter_delta(spark: SparkSession, d: str) -> DataFrame:
    return _ledger(spark, d).select("event_id", "kind", "delta_inp", "delta_out", "delta_total")


@query(f"""WITH {LEDGER} SELECT user_id, CAST(coalesce(sum(delta_total), 0) - arg_max(total, (ts, event_id)) AS BIGINT) AS gap FROM deltas GROUP BY 1""")
def ledger_gap(spark: SparkSession, d: str) -> DataFrame:
    return ordered.ledger_gap(_ledger(spark, d), "user_id", ["ts", "event_id"], "cumulative")


CARRY = "PARTITION BY user_id ORDER BY ts, event_id"


@query(f"""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'm' || event_id % 4 END IGNORE NULLS) OVER ({CARRY} ROWS UNBOUNDED PRECEDING) AS model FROM events""")
def carry_forward_model(spark: SparkSession, d: str) -> DataFrame:
    said = events(spark, d).withColumn("said", F.when(F.col("event_type") == "signup", F.concat(F.lit("m"), F.col("event_id") % 4)))
    return ordered.carry_forward(said, "user_id", ["ts", "event_id"], "said", "model").select("event_id", "model")


@query(f"""WITH m AS (SELECT *, event_id % 4 % 3 AS v FROM events WHERE event_id % 4 <> 3), l AS (SELECT *, lag(v) OVER ({CARRY}) AS b FROM m) SELECT event_id, v FROM l WHERE b IS DISTINCT FROM v""")
def change_points(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("v", F.when(F.col("event_id") % 4 != 3, F.col("event_id") % 4 % 3))
    return ordered.changes(rows, "user_id", ["ts", "event_id"], "v").select("event_id", "v")


@query(f"""SELECT event_id, row_number() OVER ({CARRY}) - 1 AS ordinal FROM events WHERE event_type <> 'view'""")
def event_ordinal(spark: SparkSession, d: str) -> DataFrame:
    return ordered.event_ordinal(events(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") != "view").select("event_id", "ordinal")


# --- calendars, zones, matrix, redaction ---

SPARSE = f"daily AS (SELECT strftime(occurred_at, '%Y-%m-%d') AS day, CAST(sum({GRAND_SQL}) AS BIGINT) AS tokens, count(*) AS requests FROM ok WHERE day(occurred_at) % 3 <> 0 GROUP BY 1), days AS (SELECT strftime(d, '%Y-%m-%d') AS day, coalesce(tokens, 0) AS tokens, coalesce(requests, 0) AS requests FROM (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-02-05', INTERVAL 1 DAY)) AS d) LEFT JOIN daily ON day = strftime(d, '%Y-%m-%d'))"


def _days(spark: SparkSession, d: str) -> DataFrame:
    facts = ops.EVERYTHING.usage(usage_facts(spark, d)).filter(F.dayofmonth("occurred_at") % 3 != 0)
    daily = facts.groupBy(F.date_format("occurred_at", DAY).alias("day")).agg(F.sum(usage.grand_total()).alias("tokens"), F.count(F.lit(1)).alias("requests"))
    return calendar.calendar(daily, "2023-12-20", "2024-02-05")


@query(f"""{WITH}, {SPARSE} SELECT day, tokens, requests FROM days""")
def calendar_fill(spark: SparkSession, d: str) -> DataFrame:
    return _days(spark, d)


@query(f"""{WITH}, {SPARSE} SELECT count(*) FILTER (WHERE tokens > 0) AS active_days, CAST(sum(requests) AS BIGINT) AS requests, max(tokens) AS peak FROM days""")
def calendar_summary(spark: SparkSession, d: str) -> DataFrame:
    return calendar.summary(_days(spark, d))


@query(f"""{WITH}, {SPARSE}, a AS (SELECT list(tokens ORDER BY tokens) AS v, count(*) AS n FROM days WHERE tokens > 0),
    q AS (SELECT greatest(v[CAST(round((n - 1) * 0.25) AS BIGINT) + 1], 1) AS q0, greatest(v[CAST(round((n - 1) * 0.5) AS BIGINT) + 1], 1) AS q1, greatest(v[CAST(round((n - 1) * 0.75) AS BIGINT) + 1], 1) AS q2, greatest(v[CAST(round((n - 1) * 0.95) AS BIGINT) + 1], 1) AS q3 FROM a)
    SELECT day, tokens, requests, CAST(CASE WHEN tokens <= 0 THEN 0 ELSE 1 + least(3, (tokens > q0)::INT + (tokens > q1)::INT + (tokens > q2)::INT + (tokens > q3)::INT) END AS INTEGER) AS level FROM days, q""")
def heat_levels(spark: SparkSession, d: str) -> DataFrame:
    return calendar.heat_levels(_days(spark, d))


@query(f"""{WITH}, {SPARSE} SELECT strftime(date_trunc('week', CAST(day AS DATE)), '%Y-%m-%d') AS week, CAST(isodow(CAST(day AS DATE)) - 1 AS INTEGER) AS weekday, day, tokens FROM days""")
def week_columns(spark: SparkSession, d: str) -> DataFrame:
    return calendar.weeks(_days(spark, d)).select("week", "weekday", "day", "tokens")


@query(f"""{WITH}, {_slices_sql('%Y-%m-%d', 'America/Santiago')} SELECT "at", CAST(sum(requests) AS BIGINT) AS requests, min(first_at) AS first_at FROM slices GROUP BY 1""")
def local_day_zone(spark: SparkSession, d: str) -> DataFrame:
    sliced = ops.slices(usage_facts(spark, d), DAY, _breaks(spark), "America/Santiago")
    return sliced.groupBy("at").agg(F.sum("requests").alias("requests"), F.min("first_at").alias("first_at"))


MATRIX_SQL = f"""WITH {FACTS_SQL}, o AS (SELECT adapter_id, count(*) FILTER (WHERE request_kind <> 'failed') AS rows_, max(cache_read) AS cr, max(cache_write_5m + cache_write_1h + cache_write_unspecified) AS cw, max(cache_write_1h) AS c1,
    max(reasoning) AS rs, count(*) FILTER (WHERE request_kind <> 'failed' AND reasoning IS NULL) AS absent, max(model_id) FILTER (WHERE request_kind <> 'failed') AS model, bool_or(is_sidechain AND request_kind <> 'failed') AS side, count(*) FILTER (WHERE request_kind = 'failed') AS failures FROM facts GROUP BY 1)"""
MATRIX_CASES = {
    "exact_token_counts": "'supported'",
    "cache_read_tokens": "CASE WHEN cr > 0 THEN 'supported' ELSE 'unknown' END",
    "cache_write_tokens": "CASE WHEN cw > 0 THEN 'supported' ELSE 'unknown' END",
    "cache_ttl_breakdown": "CASE WHEN c1 > 0 THEN 'supported' WHEN cw > 0 THEN 'unsupported' ELSE 'unknown' END",
    "reasoning_tokens": "CASE WHEN rs > 0 THEN 'supported' WHEN absent > 0 THEN 'unsupported' ELSE 'unknown' END",
    "model_identity": "CASE WHEN model IS NOT NULL THEN 'supported' ELSE 'unsupported' END",
    "per_request_latency": "'unsupported'", "provider_reported_cost": "'unsupported'", "actual_billed_cost": "'unsupported'",
    "sub_agent_attribution": "CASE WHEN side THEN 'supported' ELSE 'unknown' END",
    "failure_visibility": "CASE WHEN failures > 0 THEN 'supported' ELSE 'unknown' END",
}


@query(MATRIX_SQL + " UNION ALL ".join(f" SELECT adapter_id, '{c}' AS capability, CASE WHEN rows_ = 0 THEN 'unknown' ELSE {x} END AS state FROM o" for c, x in MATRIX_CASES.items()))
def capability_matrix(spark: SparkSession, d: str) -> DataFrame:
    return capability.capabilities(usage_facts(spark, d))


COMPACT_SQL = "CASE WHEN n >= 1000000000000 THEN (n // 1000000000000) || 'T' WHEN n >= 1000000000 THEN (n // 1000000000) || 'G' WHEN n >= 1000000 THEN (n // 1000000) || 'M' WHEN n >= 1000 THEN (n // 1000) || 'k' ELSE CAST(n AS VARCHAR) END"


@query(f"""{WITH}, t AS (SELECT session_id, CAST(sum({GRAND_SQL}) AS BIGINT) AS n FROM ok GROUP BY 1), p AS (SELECT max(n) AS peak FROM t) SELECT session_id, {COMPACT_SQL} AS compact, CASE WHEN n > 0 THEN repeat('█', CAST(greatest(1, round(CAST(n AS DOUBLE) / peak * 20)) AS INTEGER)) ELSE '' END AS bar FROM t, p""")
def compact_bars(spark: SparkSession, d: str) -> DataFrame:
    t = ops.by(usage_facts(spark, d), "session_id").select("session_id", usage.grand_total().alias("n"))
    peak = t.agg(F.max("n").alias("peak"))
    return t.join(F.broadcast(peak), F.lit(True)).select("session_id", display.compact(F.col("n")).alias("compact"), display.bar(F.col("n"), F.col("peak"), 20).alias("bar"))  # one row is broadcast


from . import lists, logs, shown  # noqa: E402, F401 - they register their queries here
