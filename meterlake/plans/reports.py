"""Reports over request facts and prices: each is one DataFrame, and JSON is one more column or sink."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.measured import prefix, reasoning_measure
from ..functions.usage import grand_total
from ..operators import capability, pricing
from ..operators import usage as ops
from ..operators.merge import combine, finish, states
from ..operators.usage import DAY, HOUR, Filter
from ..sources.producers import PRODUCERS, facts_from_signals
from ..streaming.tail import batch_lines


#: Price changes that are written into a plan as a literal.
MAX_BREAKS = 100


@dataclass(frozen=True)
class Reports:
    """Facts (instants in ``occurred_at``), prices, exchange rates and the user's zone."""

    facts: DataFrame
    prices: DataFrame
    rates: DataFrame | None = None
    zone: str = "UTC"
    currency: str = "USD"
    now: str = "1970-01-01 00:00:00"
    filter: Filter = field(default_factory=Filter)

    def _slices(self, grain: str) -> DataFrame:
        """Slices cut at price changes: a few are one literal, of many each fact is cut by the version in force."""
        breaks = [r[0] for r in pricing.price_breaks(self.prices).limit(MAX_BREAKS + 1).collect()]
        if len(breaks) <= MAX_BREAKS:
            return ops.slices(self.facts, grain, breaks, self.zone, self.filter)
        versions = self.prices.select("model_id", "effective_from", "version_id", "source", *pricing.RATES)
        cut = pricing.price_asof(self.facts, versions, "occurred_at").withColumn("segment", F.col("version_id"))
        return ops.slices(cut.select(*self.facts.columns, "segment"), grain, None, self.zone, self.filter)

    def _costs(self, sliced: DataFrame, key: str) -> DataFrame:
        costs = pricing.cost_measured(pricing.price_asof(sliced, self.prices, "first_at"), [key]).drop("requests")
        costs = pricing.convert(costs, self.rates, self.currency, self.now) if self.rates is not None and self.currency != "USD" else costs
        return costs.withColumn("prefix", prefix(F.col("kind")))

    def _series(self, grain: str, newest_first: bool) -> DataFrame:
        sliced = self._slices(grain)
        series = ops.fold_buckets(sliced).withColumn("grand_total", grand_total())
        joined = series.join(self._costs(sliced, "at"), "at", "left")
        return joined.orderBy(F.desc("at") if newest_first else F.asc("at"))

    def daily(self, newest_first: bool = False) -> DataFrame:
        return self._series(DAY, newest_first)

    def hourly(self, newest_first: bool = False) -> DataFrame:
        return self._series(HOUR, newest_first)

    def models(self) -> DataFrame:
        """Models by tokens, with costs, the rates used and whether the latest alone gives the cost."""
        sliced = self._slices(DAY)
        totals = ops.by(self.facts, "model_id", self.filter).withColumn("grand_total", grand_total())
        costs = self._costs(sliced, "model_id").withColumnRenamed("model_id", "__m")
        used = pricing.rates_used(pricing.price_asof(sliced, self.prices, "first_at")).groupBy(F.col("model_id").alias("__u")).agg(F.sort_array(F.collect_set(F.struct("effective_from", "version_id"))).alias("rates_used"))
        one = pricing.one_rate(sliced, self.prices).select(F.col("model_id").alias("__o"), "reproduces")
        joined = totals.join(costs, F.col("model_id").eqNullSafe(F.col("__m"))).join(used, F.col("model_id") == F.col("__u"), "left").join(one, F.col("model_id").eqNullSafe(F.col("__o")), "left")
        return joined.drop("__m", "__u", "__o").withColumn("model", F.coalesce("model_id", F.lit("(not reported)"))).orderBy(F.desc("grand_total"), "model")

    def overview(self) -> DataFrame:
        """One row: totals, failures, reasoning coverage, cost, the largest models and all adapters."""
        cost = self._costs(self._slices(DAY).withColumn("all", F.lit(1)), "all").select("cost_e15", "kind", "reason", "prefix")
        top = ops.top(ops.by(self.facts, "model_id", self.filter), "model_id").agg(F.collect_list(F.struct("model_id", "requests", "grand_total")).alias("top_models"))
        apps = ops.by(self.facts, "adapter_id", self.filter).withColumn("grand_total", grand_total()).agg(F.sort_array(F.collect_list(F.struct("adapter_id", "requests", "grand_total"))).alias("adapters"))
        unpriced = pricing.unpriced_models(self.filter.usage(self.facts), self.prices).agg(F.sort_array(F.collect_list("model_id")).alias("unpriced_models"))
        out = reasoning_measure(ops.totals(self.facts, self.filter)).withColumn("grand_total", grand_total())
        for part in (ops.failed_count(self.facts, self.filter), cost, top, apps, unpriced):
            out = out.join(part, F.lit(True), "left")  # one row each
        return out

    def sessions(self, limit: int = 30) -> DataFrame:
        """The latest sessions, whatever the filter."""
        return reasoning_measure(ops.recent_sessions(self.facts, limit)).withColumn("grand_total", grand_total())

    def apps(self) -> DataFrame:
        return capability.capabilities(self.facts)


def as_json(report: DataFrame) -> DataFrame:
    """One JSON text per row; amounts as strings, missing values as nulls, not left out."""
    texts = [F.col(n).cast("string").alias(n) if kind.startswith("decimal") else F.col(n) for n, kind in report.dtypes]
    return report.select(F.to_json(F.struct(*texts), {"ignoreNullFields": "false"}).alias("json"))


#: Rows that an export writes into one file.
MAX_EXPORT = 100_000


def export(report: DataFrame, path: str) -> None:
    """A report's rows, in their order, as one JSON-lines file; a report of more than MAX_EXPORT rows is refused."""
    if report.limit(MAX_EXPORT + 1).count() > MAX_EXPORT:
        raise ValueError(f"the report has more than {MAX_EXPORT} rows: write it as a table")
    as_json(report).coalesce(1).write.mode("error").text(path)


def all_prices(spark: SparkSession, seed: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The seed and what users entered, as one price list in order."""
    both = seed.unionByName(stored) if stored is not None else seed
    return both.orderBy("model_id", "effective_from")


def sync(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """One pass over the logs below ``roots`` (adapter id to folder): request facts, one per request, as reports take them.

    Lines are read by spans and searched for needles there, so no raw line is shuffled; each is parsed once. ``streaming.ingest``
    keeps the same tables up to date instead.
    """
    parsed = [p.parse(batch_lines(spark, roots[p.adapter_id], p.glob, p.needles)) for p in PRODUCERS if p.adapter_id in roots]
    requests = finish(combine(states(facts_from_signals(*parsed))))
    return requests.drop("copies").withColumnRenamed("last_event_id", "event_id").withColumn("task_id", F.lit(None).cast("string"))
