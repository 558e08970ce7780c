"""Registered queries of price lists, days, rates and texts that reports are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import display, ranges
from ..operators import calendar, capability
from ..sources.seed import SEED, nano, nanos, seed_prices
from . import catalog as c
from .catalog import query
from .facts import ORDER_PRICES_SQL, order_prices, usage_facts
from .reports import all_prices, as_json

SEED_SQL = ", ".join(f"('seed-{m}-{day}', '{m}', {nano(rates[0])}, TIMESTAMP '{day}', 'seed')" for m, *rates, day in SEED)


@query(f"""WITH {ORDER_PRICES_SQL}, every AS (SELECT version_id, model_id, input_rate, effective_from, source FROM prices UNION ALL SELECT * FROM (VALUES {SEED_SQL}) t(version_id, model_id, input_rate, effective_from, source))
    SELECT *, row_number() OVER (PARTITION BY model_id ORDER BY effective_from, version_id) AS place FROM every""")
def list_prices(spark: SparkSession, d: str) -> DataFrame:
    """The seed and a long stored list as one, each version with its place among its model's."""
    stored = order_prices(spark, d)
    seed = seed_prices(spark).withColumn("effective_from", F.col("effective_from").cast("timestamp_ntz"))
    every = all_prices(spark, seed, stored).select("version_id", "model_id", "input_rate", "effective_from", "source")
    return every.withColumn("place", F.row_number().over(W.partitionBy("model_id").orderBy("effective_from", "version_id")))


def _json_sql(name: str, value: str, quoted: bool) -> str:
    text = f"""'"' || {value} || '"'""" if quoted else value
    return f"""'"{name}":' || coalesce({text}, 'null')"""


@query(f"""SELECT '{{' || {_json_sql("at", '"at"', True)} || ',' || {_json_sql("tokens", "CAST(tokens AS VARCHAR)", False)} || ',' || {_json_sql("cost_e15", "CAST(cost_e15 AS VARCHAR)", True)} || ',' || {_json_sql("kind", "kind", True)} || '}}' AS json
    FROM ({c.ORACLES["series_with_costs"]})""")
def report_json(spark: SparkSession, d: str) -> DataFrame:
    """A report as JSON texts: amounts as strings, what is missing as null."""
    return as_json(c.series_with_costs(spark, d).select("at", "tokens", "cost_e15", "kind"))


ZONE = "America/Sao_Paulo"


@query(f"""WITH days AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, CAST(CAST(day AS TIMESTAMP) AT TIME ZONE '{ZONE}' AT TIME ZONE 'UTC' AS TIMESTAMP) AS begins FROM days""")
def local_days(spark: SparkSession, d: str) -> DataFrame:
    """When the days of orders begin in a zone whose clocks change at midnight; a day without a midnight begins at the jump."""
    days = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    return days.select("day", ranges.midnight(F.col("day"), ZONE).alias("begins"))


@query("""SELECT p_partkey, CAST(round_even(p_partkey * 0.5, 0) AS BIGINT) AS nano, regexp_replace(CAST(CAST(round_even(p_partkey * 0.5, 0) AS DECIMAL(19, 0)) * 0.000000001 AS VARCHAR), '0{1,7}$', '') AS shown FROM part""")
def nano_rates(spark: SparkSession, d: str) -> DataFrame:
    """Decimal rates as whole 1e-9 units, half to even, and back as texts; every second one is a midpoint."""
    usd = (F.col("p_partkey").cast("decimal(19,0)") * F.lit("0.0000000005").cast("decimal(10,10)")).cast("decimal(29,10)")
    whole = nanos(usd)
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", whole.alias("nano"), display.rate(whole).alias("shown"))


@query(f"""SELECT day, level, CASE level WHEN 0 THEN '·' WHEN 1 THEN '▪' WHEN 2 THEN '▪' ELSE '■' END AS glyph FROM ({c.ORACLES["heat_levels"]})""")
def heat_glyphs(spark: SparkSession, d: str) -> DataFrame:
    return calendar.heat_levels(c._days(spark, d)).select("day", "level", display.glyph(F.col("level")).alias("glyph"))


OTHERS_SQL = f"SELECT a AS adapter_id, b AS capability, 'unsupported' AS state FROM (SELECT unnest([{', '.join(map(repr, capability.UNMEASURED))}]) AS a), (SELECT unnest([{', '.join(map(repr, capability.CAPABILITIES))}]) AS b)"


@query(f"""SELECT * FROM ({c.ORACLES["capability_matrix"]}) UNION ALL {OTHERS_SQL}""")
def descriptor_matrix(spark: SparkSession, d: str) -> DataFrame:
    """What facts show of the applications that are read, beside those that count nothing."""
    return capability.descriptors(usage_facts(spark, d))
