"""Registered queries that read producers' log lines, made from the events table, up to one table of facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import merge
from ..sources import producers
from . import catalog as c
from .catalog import query
from .facts import events

NEEDLES = [x for own in producers.NEEDLES.values() for x in own]
PADS = (0, 2048, 4090, 4096)
LINE_SQL = (
    "repeat('x', CASE event_id % 4 " + " ".join(f"WHEN {i} THEN {n}" for i, n in enumerate(PADS)) + " END) || CASE event_id % 11 "
    + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(NEEDLES)) + " ELSE 'nothing' END"
)


def _any_sql(needles: tuple[str, ...]) -> str:
    return " OR ".join(f"contains(v, '{x}')" for x in needles)


@query(f"WITH h AS (SELECT event_id, {LINE_SQL} AS v FROM events) SELECT event_id, " + ", ".join(f"({_any_sql(own)}) AS hit_{p}" for p, own in producers.NEEDLES.items()) + " FROM h")
def prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Which lines each producer looks at: a needle counts wherever it stands in a line, also behind thousands of other characters."""
    pad = F.element_at(F.array(*map(F.lit, PADS)), (F.col("event_id") % 4 + 1).cast("int"))
    tail = F.coalesce(F.get(F.array(*map(F.lit, NEEDLES)), (F.col("event_id") % 11).cast("int")), F.lit("nothing"))
    lines = events(spark, d).select("event_id", F.concat(F.repeat(F.lit("x"), pad), tail).alias("value"))
    return lines.select("event_id", *(producers.candidate(p).alias(f"hit_{p}") for p in producers.NEEDLES))


def rollout_lines(spark: SparkSession, d: str) -> DataFrame:
    """A file per user: its session is declared before one of its first six counts, models are declared now and then."""
    flat = c._ledger(spark, d).withColumn("n", F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")

    def usage(inp, out, total):
        return c.text('{"input_tokens":%d,"output_tokens":%d,"total_tokens":%d}', inp, out, total)

    info = F.concat(F.lit('{"total_token_usage":'), usage(F.col("inp"), F.col("out"), F.col("cumulative")), F.lit(',"last_token_usage":'), usage(F.col("last_inp"), F.col("last_out"), F.col("last_total")), F.lit("}"))
    count = c.text('{"timestamp":"%s","type":"event_msg","payload":{"type":"token_count","info":%s}}', at, F.when(F.col("inp").isNotNull(), info).otherwise("null"))
    model = F.when(F.col("event_type") == "signup", c.text('{"type":"turn_context","payload":{"model":"m%d"}}', F.col("event_id") % 4))
    session = F.when(F.col("n") == F.col("user_id") % 6 + 1, c.text('{"type":"session_meta","payload":{"id":"s%d"}}', F.col("user_id")))
    each = flat.select(F.concat(F.lit("u"), "user_id").alias("file_id"), "n", F.posexplode(F.array(session, model, count)).alias("i", "value"))
    lines = each.filter("value is not null").select("file_id", (F.col("n") * 3 + F.col("i")).cast("long").alias("ordinal"), "value")
    return lines.repartition("file_id")  # written out once; a file's lines are together then


ORDER = "PARTITION BY user_id ORDER BY ts, event_id"
STEPS = c.LEDGER[c.LEDGER.index("has AS (") :].replace("FROM ledger WHERE inp IS NOT NULL", "FROM open_ WHERE inp IS NOT NULL")
ROLLOUTS = f"""{c.LEDGER[: c.LEDGER.index("has AS (")]}numbered AS (SELECT l.*, row_number() OVER ({ORDER}) AS nth, last_value(CASE WHEN event_type = 'signup' THEN 'm' || event_id % 4 END IGNORE NULLS) OVER ({ORDER} ROWS UNBOUNDED PRECEDING) AS model
    FROM ledger l JOIN (SELECT event_id, event_type FROM events) USING (event_id)),
open_ AS (SELECT * FROM numbered WHERE nth > user_id % 6), {STEPS},
used AS (SELECT *, row_number() OVER ({ORDER}) AS number FROM deltas WHERE kind IN ('turn', 'reset', 'off_ledger'))"""
ROLLOUT_KIND = "CASE WHEN kind = 'off_ledger' THEN 'off_ledger' ELSE 'turn' END"


@query(f"""WITH {ROLLOUTS} SELECT 's' || user_id AS session_id, number || ':' || {ROLLOUT_KIND} AS dedup_key, model AS model_id, {ROLLOUT_KIND} AS request_kind,
    delta_inp AS input_fresh, delta_out AS output_total, date_trunc('millisecond', ts) AS occurred_at FROM used""")
def parse_rollouts(spark: SparkSession, d: str) -> DataFrame:
    got = producers.parse_b(rollout_lines(spark, d)).usage
    return got.select("session_id", "dedup_key", "model_id", "request_kind", "input_fresh", "output_total", F.col("occurred_at").cast("timestamp_ntz").alias("occurred_at"))


def _sources(spark: SparkSession, d: str) -> tuple[producers.Parsed, ...]:
    e, user = F.col("event_id"), F.col("user_id")
    retry = c.text('{"type":"system","subtype":"api_error","sessionId":"s%d","retryAttempt":2}', user)
    compacted = c.text('{"type":"system","subtype":"compact_boundary","sessionId":"s%d","preTokens":999000}', user)
    system = events(spark, d).select(F.lit("sys").alias("file_id"), e.alias("ordinal"), F.when(e % 37 == 0, retry).when(e % 41 == 0, compacted).alias("value"))
    lines = c._transcript_lines(spark, d).unionByName(system.filter("value is not null"))
    return producers.parse_a(lines), producers.parse_b(rollout_lines(spark, d)), producers.parse_c(c._span_lines(spark, d))


A_OK = "event_id % 29 <> 0 AND event_id % 31 <> 0"
C_BAD = "((event_id % 12) * k > 10 * k OR (event_id % 3 = 0 AND k - event_id % 2 > k))"
FACTS = f"""WITH {ROLLOUTS}, ev2 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
facts AS (
    SELECT 'claude_code' AS adapter_id, 's' || user_id AS session_id, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 13 = 0 THEN 'failed' ELSE 'r' || event_id END
        WHEN event_id % 13 = 0 THEN 'g' || event_id ELSE 'r' || event_id || ':g' || event_id END AS dedup_key, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'turn' END AS request_kind,
        CASE WHEN event_type = 'error' THEN 0 ELSE 2 * k END AS input_fresh, CASE WHEN event_type = 'error' THEN 0 ELSE k END AS output_total, CASE WHEN event_type = 'error' THEN 0 ELSE 3 * k END AS cache_read FROM ev2 WHERE {A_OK}
    UNION ALL SELECT 'codex', 's' || user_id, number || ':' || {ROLLOUT_KIND}, {ROLLOUT_KIND}, delta_inp, delta_out, 0 FROM used
    UNION ALL SELECT 'copilot', 'c' || user_id, 'x' || event_id, 'assistant', (10 - event_id % 12) * k, k, (event_id % 12) * k FROM ev2 WHERE event_id % 10 <> 9 AND NOT {C_BAD}
)"""


@query(f"""{FACTS}, merged AS (SELECT adapter_id, session_id, dedup_key, request_kind, max(input_fresh) AS input_fresh, max(output_total) AS output_total, max(cache_read) AS cache_read, count(*) AS copies FROM facts GROUP BY 1, 2, 3, 4)
    SELECT adapter_id, request_kind, count(*) AS requests, CAST(sum(copies) AS BIGINT) AS copies, count(DISTINCT session_id) AS sessions, CAST(sum(input_fresh) AS BIGINT) AS input_fresh, CAST(sum(output_total) AS BIGINT) AS output_total, CAST(sum(cache_read) AS BIGINT) AS cache_read FROM merged GROUP BY 1, 2""")
def sync_facts(spark: SparkSession, d: str) -> DataFrame:
    """Lines of three producers to one table of facts, merged by request."""
    merged = merge.merge_max(producers.facts_from_signals(*_sources(spark, d)))
    sums = [F.sum(x).alias(x) for x in ("copies", "input_fresh", "output_total", "cache_read")]
    return merged.groupBy("adapter_id", "request_kind").agg(F.count(F.lit(1)).alias("requests"), F.count_distinct("session_id").alias("sessions"), *sums)


@query(f"""WITH {ROLLOUTS}, ev2 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events), t(adapter_id, signal, kind) AS (
    SELECT 'claude_code', CASE WHEN event_type = 'error' THEN 'failure' ELSE 'usage' END, NULL FROM ev2 WHERE {A_OK}
    UNION ALL SELECT 'claude_code', 'anomaly', 'provider_self_inconsistent' FROM ev2 WHERE {A_OK} AND event_type <> 'error' AND event_id % 5 = 0 AND k > 0
    UNION ALL SELECT 'claude_code', 'anomaly', 'malformed_line' FROM ev2 WHERE event_id % 29 = 0
    UNION ALL SELECT 'claude_code', CASE WHEN event_id % 37 = 0 THEN 'retry' ELSE 'compacted' END, NULL FROM ev2 WHERE event_id % 37 = 0 OR event_id % 41 = 0
    UNION ALL SELECT 'codex', 'usage', NULL FROM used UNION ALL SELECT 'codex', 'anomaly', 'cumulative_rebased' FROM used WHERE kind = 'reset'
    UNION ALL SELECT 'codex', 'anomaly', 'usage_before_session' FROM numbered WHERE nth <= user_id % 6 AND inp IS NOT NULL
    UNION ALL SELECT 'copilot', 'usage', NULL FROM ev2 WHERE event_id % 10 <> 9 AND NOT {C_BAD}
    UNION ALL SELECT 'copilot', 'anomaly', CASE WHEN (event_id % 12) * k > 10 * k THEN 'copilot_cache_exceeds_input' ELSE 'copilot_reasoning_exceeds_output' END FROM ev2 WHERE event_id % 10 <> 9 AND {C_BAD}
) SELECT adapter_id, signal, kind, count(*) AS n FROM t GROUP BY 1, 2, 3""")
def pass_statistics(spark: SparkSession, d: str) -> DataFrame:
    return producers.pass_statistics(*_sources(spark, d))
