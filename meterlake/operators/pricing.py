"""As-of prices, exact costs and their certainty.

Rates are integers of 1e-9 USD per million tokens, so tokens x rate is an exact integer of 1e-15 USD.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.usage import SYNTHETIC

RATES = ("input_rate", "output_rate", "cache_read_rate", "write_5m_rate", "write_1h_rate")
#: A price list is broadcast up to this many rows, and shuffled beyond.
MAX_BROADCAST = 100_000
#: Beyond so many versions the time that facts span is cut into TICKS equal parts, and versions are looked up by part.
FEW_VERSIONS, TICKS = 200, 1024
#: Bands and the rates that price them; writes without a time to live take the cheaper one.
PRICED = (
    ("input_fresh", "input_rate"), ("output_total", "output_rate"), ("cache_read", "cache_read_rate"),
    ("cache_write_5m", "write_5m_rate"), ("cache_write_1h", "write_1h_rate"), ("cache_write_unspecified", "write_5m_rate"),
)


def with_defaults(prices: DataFrame) -> DataFrame:
    """Cache rates that are not stated cost what input costs, never nothing."""
    return prices.withColumns({r: F.coalesce(r, "input_rate") for r in RATES[2:]})


def timeline(prices: DataFrame) -> DataFrame:
    """Versions in force: of equal starts the user's wins; each ends where the next begins."""
    best = F.struct((F.col("source") == "user").cast("int"), "version_id")
    one = with_defaults(prices).groupBy("model_id", "effective_from").agg(F.max_by(F.struct("version_id", "source", *RATES), best).alias("__v"))
    w = W.partitionBy("model_id").orderBy("effective_from")
    return one.select("model_id", "effective_from", F.lead("effective_from").over(w).alias("effective_until"), F.row_number().over(w).alias("__n"), "__v.*")


def price_asof(df: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """``df`` with the version in force at ``at``; before a model's first version that one holds; unknown models get NULLs.

    A few versions are compared with every row of their model. Of many, each stands in the parts of the time
    (TICKS of them) in which it holds, so a row meets the versions of its part alone and a model of very many
    rows is spread over the parts. There are at most versions + models x TICKS such rows.
    """
    spans = timeline(prices).withColumnRenamed("model_id", "__model")
    since = (F.col("__n") == 1) | (F.col(at) >= F.col("effective_from"))
    until = F.col("effective_until").isNull() | (F.col(at) < F.col("effective_until"))
    same = F.col("model_id") == F.col("__model")
    if prices.limit(FEW_VERSIONS + 1).count() <= FEW_VERSIONS:
        return df.join(F.broadcast(spans), same & since & until, "left").drop("__model", "__n")

    kind = df.schema[at].dataType.simpleString()
    epoch = F.lit("1970-01-01 00:00:00").cast(kind)

    def micros(x: str) -> Column:
        return F.timestamp_diff("MICROSECOND", epoch, F.col(x).cast(kind))

    low, high = df.agg(F.min(micros(at)), F.max(micros(at))).first()
    low, high = low or 0, high or 0
    width = (high - low) // TICKS + 1

    def tick(value: Column) -> Column:
        return F.floor((value - low) / width)

    first = F.when(F.col("__n") == 1, F.lit(0)).otherwise(F.greatest(tick(micros("effective_from")), F.lit(0)))
    last = F.least(F.coalesce(tick(micros("effective_until")), F.lit(TICKS)), F.lit(TICKS))
    dealt = spans.withColumn("__tick", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    small = dealt.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST
    ticked = df.withColumn("__at", tick(micros(at)))
    joined = ticked.join(F.broadcast(dealt) if small else dealt, same & (F.col("__at") == F.col("__tick")) & since & until, "left")
    return joined.drop("__model", "__n", "__tick", "__at")


def price_breaks(prices: DataFrame) -> DataFrame:
    """Distinct starts that are not a model's first."""
    firsts = prices.groupBy("model_id").agg(F.min("effective_from").alias("__first"))
    later = prices.select("model_id", "effective_from").distinct().join(firsts, "model_id").filter("effective_from > __first")
    return later.select("effective_from").distinct().orderBy("effective_from")


def cost_e15() -> Column:
    """The exact cost of a priced row in 1e-15 USD; NULL if it has no price."""
    terms = [F.col(b).cast("decimal(20,0)") * F.col(r).cast("decimal(18,0)") for b, r in PRICED]
    total = terms[0]
    for t in terms[1:]:
        total = (total + t).cast("decimal(38,0)")
    return F.when(F.col("model_id") == SYNTHETIC, F.lit(0).cast("decimal(38,0)")).otherwise(total.cast("decimal(38,0)"))


def usd(e15: Column) -> Column:
    """Exact up to 1e7 USD."""
    return (e15.cast("decimal(22,0)") * F.lit("0.000000000000001").cast("decimal(15,15)")).cast("decimal(38,15)")


def cost_measured(priced: DataFrame, keys: list[str]) -> DataFrame:
    """Costs of priced slices by keys: exact sum, how much of it is priced, its kind and why it is partial."""
    rows = priced.withColumn("__cost", cost_e15())
    has = F.col("__cost").isNotNull()
    sums = rows.groupBy(*keys).agg(
        F.sum("__cost").cast("decimal(38,0)").alias("cost_e15"),
        F.count(F.lit(1)).alias("items"), F.count("__cost").alias("priced_items"),
        F.sum("requests").alias("requests"), F.coalesce(F.sum(F.when(has, F.col("requests"))), F.lit(0)).cast("long").alias("priced_requests"),
        F.coalesce(F.sum(F.when(has & (F.col("model_id") != SYNTHETIC), F.col("unclassified"))), F.lit(0)).cast("long").alias("unpriceable"),
    )
    # fixed values: the two sentences below are what reports say
    no_price = F.when(F.col("priced_items") < F.col("items"), F.format_string("%d of %d requests have no price for their model", F.col("requests") - F.col("priced_requests"), F.col("requests")))
    no_split = F.when(F.col("unpriceable") > 0, F.format_string("%d tokens were counted by the provider without an input/output split and cannot be priced", F.col("unpriceable")))
    whole = (F.col("priced_items") == F.col("items")) & (F.col("unpriceable") == 0)
    return sums.withColumns({
        "kind": F.when(F.col("priced_items") == 0, "unavailable").when(whole, "calculated").otherwise("partial"),
        "reason": F.when((F.col("priced_items") > 0) & ~whole, F.concat_ws("; ", no_price, no_split)),
    })


def rates_used(priced: DataFrame) -> DataFrame:
    return priced.filter("version_id is not null").select("model_id", "version_id", "effective_from").distinct()


def one_rate(sliced: DataFrame, prices: DataFrame, at: str = "first_at") -> DataFrame:
    """Whether a model's latest version alone gives the cost that its versions as of their times give."""
    actual = price_asof(sliced, prices, at).withColumn("__cost", cost_e15()).groupBy("model_id").agg(F.sum("__cost").alias("cost_e15"))
    latest = timeline(prices).filter("effective_until is null").drop("effective_from", "effective_until", "__n").withColumnRenamed("model_id", "__model")
    flat = sliced.join(latest, F.col("model_id") == F.col("__model"), "left").withColumn("__cost", cost_e15()).groupBy("model_id").agg(F.sum("__cost").alias("flat_e15"))
    both = actual.alias("a").join(flat.alias("f"), F.col("a.model_id").eqNullSafe(F.col("f.model_id")))
    return both.select("a.model_id", F.col("cost_e15").cast("decimal(38,0)").alias("cost_e15"), F.col("flat_e15").cast("decimal(38,0)").alias("flat_e15"), F.col("cost_e15").eqNullSafe(F.col("flat_e15")).alias("reproduces"))


def unpriced_models(facts: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that no version ever priced; requests without a model are not among them."""
    models = facts.filter(F.col("model_id").isNotNull() & (F.col("model_id") != SYNTHETIC)).groupBy("model_id").agg(F.count(F.lit(1)).alias("requests"))
    return models.join(prices.select("model_id").distinct(), "model_id", "left_anti")


def enter_rate(rates: DataFrame, currency: str, rate: str, as_of: str, source: str = "manual") -> DataFrame:
    """``rates`` and one that a user enters: USD in a known currency, in whole 1e-9 units. Rates are typed in, never fetched."""
    from ..functions.display import CURRENCIES
    from ..sources.seed import nano

    if currency.upper() not in CURRENCIES:
        raise ValueError(f"{currency} is no known currency")
    row = rates.sparkSession.createDataFrame([(currency.upper(), nano(rate), as_of, source)], "quote_currency string, rate_nano long, as_of string, source string")
    return rates.unionByName(row.withColumn("as_of", F.col("as_of").cast("timestamp")))


def latest_rates(rates: DataFrame) -> DataFrame:
    """The latest exchange rate of each currency; of equal dates the smallest source, then rate."""
    order = F.struct(-F.unix_micros(F.col("as_of").cast("timestamp")), "source", "rate_nano")
    rest = [c for c in rates.columns if c != "quote_currency"]
    latest = rates.groupBy("quote_currency").agg(F.min_by(F.struct(*rest), order).alias("__r"))
    return latest.select(*(c if c == "quote_currency" else F.col("__r")[c].alias(c) for c in rates.columns))


def convert(costs: DataFrame, rates: DataFrame, currency: str, now: str, stale_days: int = 7) -> DataFrame:
    """Costs (cost_e15, kind) in another currency, in 1e-24 units; old rates make them estimates.

    ``is_floor`` keeps what the conversion's kind does not say: that the amount was partial.
    """
    if currency.upper() == "USD":
        return costs.withColumns({"converted_e24": (F.col("cost_e15") * F.lit(10**9)).cast("decimal(38,0)"), "fx_kind": F.col("kind"), "is_floor": F.col("kind") == "partial"})
    one = latest_rates(rates).filter(F.upper("quote_currency") == currency.upper()).select(F.col("rate_nano").alias("__rate"), F.col("as_of").alias("__as_of"))
    joined = costs.join(F.broadcast(one), F.lit(True), "left")  # one row at most
    age = F.floor((F.unix_seconds(F.lit(now).cast("timestamp")) - F.unix_seconds(F.col("__as_of").cast("timestamp"))) / 86400)
    kind = F.when(F.col("cost_e15").isNull(), F.col("kind")).when(F.col("__rate").isNull(), "unavailable").when(age >= stale_days, "estimated").otherwise("calculated")
    amount = (F.col("cost_e15").cast("decimal(26,0)") * F.col("__rate").cast("decimal(12,0)")).cast("decimal(38,0)")
    return joined.withColumns({"converted_e24": amount, "fx_kind": kind, "is_floor": F.col("kind") == "partial"}).drop("__rate", "__as_of")
