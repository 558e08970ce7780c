import json
from datetime import UTC, date, datetime

import pytest

from pyspark.sql import functions as F

from meterlake.functions.display import currency, local_minute, money_text, rate
from meterlake.functions.measured import daily_total
from meterlake.functions.ranges import local_midnight, resolve
from meterlake.operators.capability import CAPABILITIES, MEASURED, UNMEASURED, descriptors
from meterlake.operators.pricing import enter_rate, latest_rates
from meterlake.operators.redact import leaks, write_fixture
from meterlake.plans.facts import fx_rates, prices, usage_facts
from meterlake.plans import reports
from meterlake.plans.reports import Reports, all_prices, as_json, export, sync
from meterlake.sources.seed import SEED, nano, seed_prices, user_price

from .conftest import DATA


def test_days_begin_where_they_do():
    assert local_midnight(date(2026, 9, 6), "America/Santiago") == datetime(2026, 9, 6, 4, tzinfo=UTC)
    assert local_midnight(date(2026, 9, 7), "America/Santiago") == datetime(2026, 9, 7, 3, tzinfo=UTC)
    assert local_midnight(date(2026, 3, 8), "America/Havana") == datetime(2026, 3, 8, 5, tzinfo=UTC)
    assert local_midnight(date(2026, 3, 9), "America/Havana") == datetime(2026, 3, 9, 4, tzinfo=UTC)


def test_ranges():
    f, label = resolve("week", zone="Europe/Prague", today=date(2026, 8, 13))
    assert (f.since, f.until, label) == ("2026-08-06 22:00:00.000000", None, "the last 7 days")
    f, label = resolve("2024", until="2024-07-01")
    assert (f.since[:10], f.until[:10], label) == ("2024-01-01", "2024-07-01", "2024, until 2024-07-01")
    assert resolve(since="2024-01-01T00:00:00+02:00", until="2024-02-01")[1] == "since 2024-01-01T00:00:00+02:00 until 2024-02-01"
    with pytest.raises(ValueError):
        resolve("today", since="2024-01-01")
    with pytest.raises(ValueError):
        resolve(since="yesterday")


def test_seed_list(spark):
    table = seed_prices(spark)
    assert table.count() == len(SEED) and table.select("version_id").distinct().count() == len(SEED)
    assert nano("0.075") == 75_000_000
    with pytest.raises(ValueError):
        nano("99999999999")
    both = all_prices(spark, table, user_price(spark, "own", {"input": "1", "output": "2"}, "2026-01-01"))
    assert both.count() == len(SEED) + 1


def test_reports(spark, tmp_path):
    r = Reports(usage_facts(spark, DATA), prices(spark), fx_rates(spark), "Europe/Prague", "EUR", "2024-01-30 12:00:00")
    days = r.daily().collect()
    assert [d["at"] for d in days] == sorted(d["at"] for d in days) and all(d.converted_e24 for d in days if d.cost_e15)
    assert r.hourly(True).count() > len(days)
    models = {m.model: m for m in r.models().collect()}
    assert models["gpt-5.6-sol"].reproduces is False and models["claude-opus-5"].reproduces and models["(not reported)"].cost_e15 is None
    whole = r.overview().collect()
    assert len(whole) == 1 and whole[0].unpriced_models == ["no-such-model"] and whole[0].requests == sum(d.requests for d in days)
    assert r.sessions(5).count() == 5 and r.apps().count() == 33
    first = json.loads(as_json(r.overview()).first().json)
    assert isinstance(first["cost_e15"], str) and "reasoning_reason" in first
    export(r.daily(), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == len(days)


def test_entered_rates(spark):
    rates = enter_rate(fx_rates(spark), "eur", "0.9312345678", "2024-02-01 00:00:00")
    assert {(r.quote_currency, r.rate_nano, r.source) for r in latest_rates(rates).collect()} == {("EUR", 931_234_568, "manual"), ("CZK", 23_000_000_000, "bank")}
    with pytest.raises(ValueError):
        enter_rate(rates, "GBP", "1", "2024-02-01 00:00:00")
    with pytest.raises(ValueError):
        enter_rate(rates, "EUR", "99999999999", "2024-02-01 00:00:00")


def test_fixtures_are_written_whole_or_not_at_all(spark, tmp_path):
    good = [json.dumps({"type": "assistant", "cwd": "/Users/me/x", "n": 1, "deep": [{"text": "a secret", "id": "one"}]})] * 3
    write_fixture(spark.createDataFrame([(x,) for x in good], "value string"), str(tmp_path / "good"), {"type"}, {"cwd"})
    lines = [r.value for r in spark.read.text(str(tmp_path / "good")).collect()]
    assert len(lines) == 3 and all("secret" not in x and "/Users" not in x and '"assistant"' in x for x in lines)
    with pytest.raises(ValueError):
        write_fixture(spark.createDataFrame([(x,) for x in [*good, "{"]], "value string"), str(tmp_path / "bad"), {"type"}, {"cwd"})
    assert not (tmp_path / "bad").exists()
    found = leaks(spark.createDataFrame([('{"a":{"b":["xx","xxxx","plain text"]},"type":"kept text"}',), ('{"type":"kept"}',)], "value string"), {"type"})
    assert [r.leak for r in found.collect()] == ["plain text", None]


def test_shown_values(spark):
    def shown(column):
        return spark.range(1).select(column).first()[0]

    text = F.lit("2026-08-13T08:30:00.123Z")
    assert shown(local_minute(text, "Europe/Prague")) == "2026-08-13 10:30" and shown(local_minute(F.lit("2026-08-13T10"), "Europe/Prague")) == "2026-08-13 10"
    assert [shown(rate(F.lit(n).cast("long"))) for n in (5_000_000_000, 75_000_000, 100_000_000, 1)] == ["5.00", "0.075", "0.10", "0.000000001"]
    assert shown(money_text(F.lit(None).cast("decimal(38,15)"), F.lit("unavailable"), F.lit("EUR"))) == "—"
    assert shown(currency(F.lit("czk"))) == "CZK" and shown(currency(F.lit("GBP"))) is None
    assert daily_total(spark.createDataFrame([], "day string, tokens long")).count() == 0


def test_sync_of_logs(spark, tmp_path):
    usage = {"input_tokens": 1, "output_tokens": 5}
    lines = [{"type": "assistant", "sessionId": "s", "requestId": "r", "timestamp": "2024-01-02T00:00:00Z", "isSidechain": True, "message": {"id": "m", "model": "claude-opus-5", "usage": {**usage, "output_tokens": n}}} for n in (1, 5)]
    folders = {a: tmp_path / a for a in ("claude_code", "codex")}
    for folder in folders.values():
        folder.mkdir()
    (folders["claude_code"] / "a.jsonl").write_text("".join(json.dumps(x, separators=(",", ":")) + "\n" for x in lines))
    count = {"type": "token_count", "info": {"total_token_usage": {"input_tokens": 7, "output_tokens": 2, "total_tokens": 9}}}
    (folders["codex"] / "rollout-1.jsonl").write_text("".join(json.dumps(x) + "\n" for x in ({"type": "session_meta", "payload": {"id": "t"}}, {"type": "event_msg", "timestamp": "2024-01-03T00:00:00Z", "payload": count})))
    facts = sync(spark, {a: str(f) for a, f in folders.items()})
    got = {r.adapter_id: r for r in facts.collect()}
    assert got["claude_code"].output_total == 5 and got["claude_code"].is_sidechain and json.loads(got["claude_code"].raw_json)["output_tokens"] == 5
    assert got["codex"].input_fresh == 7 and got["codex"].dedup_key == "1:turn" and len(got) == 2
    report = Reports(facts.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz")), prices(spark))
    assert report.sessions().count() == 2 and report.daily().count() == 2 and report.apps().count() == 22


def test_reports_of_many_price_changes(spark, monkeypatch, tmp_path):
    """Cut at every fact's own version, reports are as if cut at a literal of the changes; an export of too many rows is refused."""
    r = Reports(usage_facts(spark, DATA), prices(spark), zone="Europe/Prague")
    own = ("first_at", "items", "priced_items")  # of slices, which are cut elsewhere

    def shown():
        return [sorted(map(str, df.drop(*own).collect())) for df in (r.daily(), r.models())]

    few = shown()
    monkeypatch.setattr(reports, "MAX_BREAKS", 0)
    assert shown() == few
    monkeypatch.setattr(reports, "MAX_EXPORT", 3)
    with pytest.raises(ValueError):
        export(r.daily(), str(tmp_path / "out"))


def test_descriptors_of_all_applications(spark):
    facts = usage_facts(spark, DATA).filter("adapter_id = 'codex'")
    got = {(r.adapter_id, r.capability): r.state for r in descriptors(facts).collect()}
    assert len(got) == len(CAPABILITIES) * len(MEASURED + UNMEASURED)
    assert got["codex", "reasoning_tokens"] == "supported" and got["copilot", "reasoning_tokens"] == "unknown" and got["junie", "model_identity"] == "unsupported"
