"""Worked examples: normalisation, exact costs, counters, zones, merges."""

import datetime
import random
from datetime import timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from meterlake.functions import display, measured, usage
from meterlake.operators import calendar, merge, ordered, pricing
from meterlake.operators import usage as ops
from meterlake.operators.usage import local_label

ZERO = dict.fromkeys(usage.BANDS, 0)


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def lits(*values):
    return [F.lit(v).cast("long") for v in values]


def test_split_writes_of_producer_a(spark):
    real = one(spark, **usage.bands_a(*lits(2, 4452, 23610, 30885, 0, 23610)))
    assert (real["input_fresh"], real["cache_write_1h"], real["cache_write_unspecified"], real["discrepancy"], real["reasoning"]) == (2, 23610, 0, False, None)
    contradictory = one(spark, **usage.bands_a(*lits(0, 0, 0, 0, None, 3112)))
    assert (contradictory["cache_write_1h"], contradictory["cache_write_unspecified"], contradictory["discrepancy"]) == (3112, 0, True)
    rest = one(spark, **usage.bands_a(*lits(0, 0, 10000, 0, 0, 4000)))
    assert (rest["cache_write_unspecified"], rest["discrepancy"]) == (6000, True)
    unsplit = one(spark, **usage.bands_a(*lits(0, 0, 23610, 0, None, None)))
    assert (unsplit["cache_write_unspecified"], unsplit["discrepancy"]) == (23610, False)


def test_producer_b(spark):
    on = F.lit(False)
    real = one(spark, **usage.bands_b(*lits(16210, 11008, None, 164, 35, 16374), on))
    assert (real["input_fresh"], real["cache_read"], real["reasoning"], real["invalid"], real["discrepancy"]) == (5202, 11008, 35, False, False)
    assert one(spark, **usage.bands_b(*lits(10, 20, None, 0, None, None), on))["invalid"]
    assert one(spark, **usage.bands_b(*lits(10, 0, None, 10, 20, None), on))["invalid"]
    assert one(spark, **usage.bands_b(*lits(16210, 11008, None, 164, 35, 99999), on))["discrepancy"]
    off = one(spark, **usage.bands_b(*lits(0, 0, None, 0, None, 15683), F.lit(True)))
    assert (off["unclassified"], off["reasoning"], off["invalid"]) == (15683, None, False)


RATES = {"opus": (15, 75, 1.5, 18.75, 30), "gpt": (1.25, 10, 0.125, 1.25, 1.25)}
A = {"input_fresh": 2, "output_total": 4452, "cache_write_1h": 23610, "cache_read": 30885}
B = {"input_fresh": 5202, "output_total": 164, "cache_read": 11008}


def priced(spark, rows, prices):
    facts = spark.createDataFrame([(m, at, n, *({**ZERO, **b}[x] for x in usage.BANDS)) for m, at, n, b in rows], "model_id string, at timestamp_ntz, requests long, " + ", ".join(f"{b} long" for b in usage.BANDS))
    table = spark.createDataFrame(prices, "version_id string, model_id string, input_rate long, output_rate long, cache_read_rate long, write_5m_rate long, write_1h_rate long, effective_from timestamp_ntz, source string")
    return pricing.price_asof(facts, table, "at")


def version(name, model, since, source="seed", rates=None):
    return (name, model, *(int(r * 10**9) for r in rates or RATES[model]), since, source)


T = datetime.datetime


def cost(spark, rows, prices):
    return pricing.cost_measured(priced(spark, rows, prices).withColumn("all", F.lit(1)), ["all"]).first()


def test_exact_costs(spark):
    prices = [version("o", "opus", T(2024, 1, 1)), version("g", "gpt", T(2024, 1, 1))]
    at = T(2024, 5, 1)
    assert cost(spark, [("opus", at, 1, A)], prices).cost_e15 == Decimal("1088557500000000")
    assert cost(spark, [("gpt", at, 1, B)], prices).cost_e15 == Decimal("9518500000000")
    both = cost(spark, [("opus", at, 1, A), ("gpt", at, 1, B)], prices)
    assert (both.cost_e15, both.kind) == (Decimal("1098076000000000"), "calculated")
    part = cost(spark, [("opus", at, 3, A), ("other", at, 2, B)], prices)
    assert (part.kind, part.priced_requests, part.requests) == ("partial", 3, 5) and "2 of 5 requests" in part.reason
    nothing = cost(spark, [(None, at, 1, B)], prices)
    assert (nothing.cost_e15, nothing.kind) == (None, "unavailable")
    counted = cost(spark, [("opus", at, 1, {"unclassified": 15683})], prices)
    assert (counted.cost_e15, counted.kind, counted.unpriceable) == (0, "partial", 15683)
    assert cost(spark, [("<synthetic>", at, 1, A)], prices).cost_e15 == 0
    assert cost(spark, [("opus", at, 0, {"input_fresh": 1}), ("other", at, 0, B)], prices).kind == "partial"


def test_prices_as_of(spark):
    prices = [version("mar", "opus", T(2024, 3, 1), rates=(10,) * 5), version("aug", "opus", T(2024, 8, 1), rates=(15,) * 5), version("seed", "gpt", T(2024, 3, 1)), version("user", "gpt", T(2024, 3, 1), "user")]
    rows = [("opus", T(2024, 1, 1), 1, {}), ("opus", T(2024, 8, 1), 2, {}), ("opus", T(2024, 7, 31, 23, 59, 59, 999000), 3, {}), ("gpt", T(2023, 1, 1), 4, {}), ("gpt-", T(2024, 5, 1), 5, {})]
    got = {r.requests: r.version_id for r in priced(spark, rows, prices).collect()}
    assert got == {1: "mar", 2: "aug", 3: "mar", 4: "user", 5: None}
    million = {"input_fresh": 1_000_000}
    assert cost(spark, [("opus", T(2024, 3, 5), 1, million), ("opus", T(2024, 9, 5), 1, million)], prices).cost_e15 == 25 * 10**15


def test_counters(spark):
    total = [(1, 100), (2, 100), (3, 100), (4, 150), (5, 20), (6, None), (7, 90)]
    last = {1: 100, 2: 100, 3: 7, 4: 50, 5: 20, 6: None, 7: 70}
    rows = spark.createDataFrame([("f", i, t, t, last[i], last[i]) for i, t in total], "f string, i long, inp long, cumulative long, last_inp long, last_total long")
    got = [(r.kind, r.delta_total) for r in ordered.reconcile(rows, "f", ["i"], ["inp"], "cumulative", "last").orderBy("i").collect()]
    assert got == [("turn", 100), ("replay", None), ("off_ledger", 7), ("turn", 50), ("reset", 20), ("no_data", None), ("turn", 70)]


def test_merges_converge(spark):
    columns = "adapter_id string, session_id string, dedup_key string, " + ", ".join(f"{b} long" for b in (*usage.BANDS, "reasoning"))

    def rows(*outs):
        return spark.createDataFrame([("a", "s", "k", *({**ZERO, "output_total": o}[b] for b in usage.BANDS), None) for o in outs], columns)

    once = merge.merge_into(rows(1, 378, 1), rows(378, 1)).collect()
    assert len(once) == 1 and once[0].output_total == 378 and once[0].reasoning is None
    again = merge.merge_into(merge.merge_into(rows(1), rows(378)), rows(1, 378)).collect()
    assert again == once


def test_local_days(spark):
    cases = [
        ("Europe/Prague", "2026-08-12 22:30:00", "2026-08-13T00"), ("Europe/Prague", "2026-08-13 21:30:00", "2026-08-13T23"), ("America/New_York", "2026-08-14 02:00:00", "2026-08-13T22"),
        ("Europe/Prague", "2026-10-25 00:30:00", "2026-10-25T02"), ("Europe/Prague", "2026-10-25 01:30:00", "2026-10-25T02"), ("Europe/Prague", "2026-03-29 01:30:00", "2026-03-29T03"),
        ("America/Santiago", "2026-09-06 04:00:00", "2026-09-06T01"), ("America/Havana", "2026-03-08 05:00:00", "2026-03-08T01"),
    ]
    for zone, at, want in cases:
        got = spark.sql(f"SELECT timestamp_ntz '{at}' AS t").select(local_label("t", "yyyy-MM-dd'T'HH", zone)).first()[0]
        assert got == want, (zone, at)


def test_measured_sums(spark):
    rows = [("e", v, "exact", None) for v in (10, 20, 30)] + [("m", 100, "exact", None)] * 12 + [("m", None, "unavailable", "gone"), ("u", None, "unavailable", "gone"), ("c", 1, "exact", None), ("c", 2, "calculated", None)]
    got = {r.k: (r.value, r.kind, r.measured, r.total) for r in measured.measured_sum(spark.createDataFrame(rows, "k string, v long, kind string, reason string"), ["k"], "v", "kind", "reason").collect()}
    assert got == {"e": (60, "exact", 3, 3), "m": (1200, "partial", 12, 13), "u": (None, "unavailable", 0, 1), "c": (3, "calculated", 2, 2)}


def test_display(spark):
    money = [(Decimal("1.005"), "1.00"), (Decimal("0.0123456"), "0.0123"), (Decimal("0.004125"), "0.004125"), (Decimal("12.345"), "12.34")]
    for value, want in money:
        assert spark.range(1).select(display.money(F.lit(value).cast("decimal(38,9)"))).first()[0] == want
    assert [spark.range(1).select(display.compact(F.lit(n).cast("long"))).first()[0] for n in (0, 999, 1234, 5_600_000, 10**18)] == ["0", "999", "1k", "5M", "1E"]


def test_heat_levels_of_nothing(spark):
    days = calendar.calendar(spark.createDataFrame([], "day string, tokens long, requests long"), "2024-01-01", "2024-01-03")
    assert [r.level for r in calendar.heat_levels(days).collect()] == [0, 0, 0]


def test_stale_rates_estimate(spark):
    costs = spark.createDataFrame([(Decimal(10**17), "calculated"), (None, "unavailable")], "cost_e15 decimal(38,0), kind string")
    fx = spark.createDataFrame([("EUR", 920_000_000, T(2024, 1, 1), "bank")], "quote_currency string, rate_nano long, as_of timestamp, source string")
    fresh = {r.kind: (r.converted_e24, r.fx_kind) for r in pricing.convert(costs, fx, "EUR", "2024-01-02 00:00:00").collect()}
    assert fresh == {"calculated": (92 * 10**24, "calculated"), "unavailable": (None, "unavailable")}
    assert pricing.convert(costs, fx, "EUR", "2024-01-13 00:00:00").first().fx_kind == "estimated"
    assert pricing.convert(costs, fx, "CZK", "2024-01-13 00:00:00").first().fx_kind == "unavailable"


@pytest.mark.parametrize("most", [0, 100_000])
def test_prices_of_long_lists(spark, monkeypatch, most):
    """Versions looked up by parts of the time, broadcast or shuffled, against a plain search: ties, gaps, open ends, unknown models, no facts."""
    monkeypatch.setattr(pricing, "FEW_VERSIONS", 3)
    monkeypatch.setattr(pricing, "MAX_BROADCAST", most)
    rnd = random.Random(8)
    start = T(2024, 1, 1)
    versions = [(f"v{k}", f"m{rnd.randrange(4)}", k, 2 * k, None, None, None, start + timedelta(hours=rnd.randrange(500)), rnd.choice(["seed", "user"])) for k in range(120)]
    facts = [(k, rnd.choice(["m0", "m0", "m1", "m2", "m3", "mx", None]), start + timedelta(minutes=rnd.randrange(-6000, 40_000))) for k in range(600)]
    price_list = spark.createDataFrame(versions, "version_id string, model_id string, input_rate long, output_rate long, cache_read_rate long, write_5m_rate long, write_1h_rate long, effective_from timestamp, source string")
    df = spark.createDataFrame(facts, "id long, model_id string, at timestamp")
    got = {r.id: (r.version_id, r.cache_read_rate) for r in pricing.price_asof(df, price_list, "at").collect()}
    assert len(got) == len(facts)
    for k, model, at in facts:
        own = [v for v in versions if v[1] == model]
        past = [v for v in own if v[7] <= at] or [v for v in own if v[7] == min(x[7] for x in own)]
        want = max(past, key=lambda v: (v[7], v[8] == "user", v[0])) if own else None
        assert got[k] == ((want[0], want[2]) if want else (None, None))
    assert pricing.price_asof(df.limit(0), price_list, "at").count() == 0


def test_positions_of_all_rows(spark, monkeypatch):
    """Ranks from parts: a value that a third of the rows have, missing values, both directions; and the first few."""
    monkeypatch.setattr(ops, "RANK_PARTS", 7)
    rnd = random.Random(3)
    rows = [(f"k{k:04}", rnd.choice([5, None, rnd.randrange(-50, 50), rnd.randrange(-50, 50)])) for k in range(700)]
    df = spark.createDataFrame(rows, "k string, v long")
    for down in (False, True):
        want = sorted(rows, key=lambda r: (r[1] is None, 0 if r[1] is None else -r[1] if down else r[1], r[0]))
        got = sorted((r.position, r.k) for r in ops.positions(df, "v", down, "k").collect())
        assert got == [(n + 1, k) for n, (k, _) in enumerate(want)]
        assert sorted((r.position, r.k) for r in ops.positions(df, "v", down, "k", 9).collect()) == got[:9]
    assert ops.positions(df.limit(0), "v", True, "k").count() == 0


def test_latest_rate_of_equal_dates(spark):
    rows = [("EUR", 3, T(2024, 1, 2), "b"), ("EUR", 2, T(2024, 1, 2), "a"), ("EUR", 1, T(2024, 1, 2), "a"), ("EUR", 9, T(2024, 1, 1), "a"), ("CZK", 7, T(2023, 1, 1), "x")]
    fx = spark.createDataFrame(rows, "quote_currency string, rate_nano long, as_of timestamp, source string")
    assert sorted((r.quote_currency, r.rate_nano) for r in pricing.latest_rates(fx).collect()) == [("CZK", 7), ("EUR", 1)]
