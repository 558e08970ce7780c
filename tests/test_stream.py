"""The tailing source and its merge sink: any restart point gives what one pass gives."""

import json

from meterlake.functions.usage import BANDS
from meterlake.operators.capability import observed
from meterlake.operators.merge import merge_max, per_source
from meterlake.operators.redact import redact_json
from meterlake.sources.producers import FACT, daily_gauge_document, facts_from_signals, ledger_events, ledger_steps, parse_a, parse_b, parse_c, pass_statistics
from meterlake.streaming import ledger, tail
from meterlake.streaming.tail import TailReader, batch_lines, read_lines, tail_lines


def line(session, request, out, **more):
    usage = {"input_tokens": 1, "output_tokens": out, "cache_creation_input_tokens": 0, "cache_read_input_tokens": 5}
    return json.dumps({"type": "assistant", "sessionId": session, "requestId": request, "timestamp": "2024-01-02T00:00:00Z", "message": {"id": "m", "model": "x", "usage": usage}, **more}, separators=(",", ":"))


def write(path, text, mode="a"):
    with open(path, mode) as f:
        f.write(text)


def whole(path, begin, end):
    return [(at, size, line) for at, size, line in read_lines(str(path), begin, end)]


def test_every_cut_gives_every_line_once(tmp_path):
    path = tmp_path / "a.jsonl"
    write(path, "one\ntwo\n\nthree has more\nhal")
    lines = [(0, 3, b"one"), (4, 3, b"two"), (8, 0, b""), (9, 14, b"three has more")]
    size = path.stat().st_size
    for a in range(size + 1):
        for b in range(a, size + 1):
            assert whole(path, 0, a) + whole(path, a, b) + whole(path, b, size) == lines
    write(path, "f\n")
    assert whole(path, size, size + 2) == [(24, 4, b"half")]


def test_oversize_lines_are_counted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "MAX_LINE", 100)
    monkeypatch.setattr(tail, "HEAD", 20)
    path = tmp_path / "a.jsonl"
    write(path, "x" * 500 + "\nshort\n" + "y" * 300 + "\n" + "z" * 999)
    assert [(at, size) for at, size, _ in whole(path, 0, path.stat().st_size)] == [(0, 500), (501, 5), (507, 300)]
    reader = TailReader({"path": str(tmp_path)})
    rows = [r for span in reader.partitions({}, reader.latestOffset()) for r in reader.read(span)]
    assert [(r[2], r[3], len(r[4])) for r in rows] == [(0, 500, 20), (501, 5, 5), (507, 300, 20)]
    big = spark.createDataFrame([("f", 0, 9_000_000, '{"type":"assistant",'), ("f", 1, 9_000_000, "nothing")], "file_id string, ordinal long, bytes long, value string")
    assert [(r.ordinal, r.kind) for r in parse_a(big).anomalies.collect()] == [(0, "oversize_relevant_line")]


def test_offsets_do_not_fall_at_a_restart(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "SPAN_BYTES", 64)
    path = tmp_path / "a.jsonl"
    write(path, "".join(f"line number {i}\n" for i in range(100)))
    first = TailReader({"path": str(tmp_path)})
    done = first.latestOffset()
    assert sum(len(list(first.read(s))) for s in first.partitions({}, done)) == 100
    again = TailReader({"path": str(tmp_path)})  # a new process that only knows the committed offset
    assert again.latestOffset() == done and again.partitions(done, again.latestOffset()) == []
    write(path, "new\n")
    latest = TailReader({"path": str(tmp_path)})
    assert [r[4] for s in latest.partitions(done, latest.latestOffset()) for r in latest.read(s)] == ["new"]
    before = latest.latestOffset()
    path.rename(tmp_path / "hidden")  # out of sight: its offset stays
    assert latest.latestOffset() == before
    (tmp_path / "hidden").rename(path)
    write(path, "only\n", mode="w")
    assert [r[4] for s in latest.partitions(before, latest.latestOffset()) for r in latest.read(s)] == ["only"]


def test_batches_number_lines_as_the_stream_does(spark, tmp_path):
    text = "".join(f"{'é' * (i % 7)} {i}\n" for i in range(3000))
    write(tmp_path / "a.jsonl", text + "not whole")
    got = {(r.ordinal, r.value) for r in batch_lines(spark, str(tmp_path)).collect()}
    assert got == {(at, line.decode()) for at, _, line in whole(tmp_path / "a.jsonl", 0, (tmp_path / "a.jsonl").stat().st_size)}


def test_transcripts_in_batch(spark, tmp_path):
    rows = [line("s", "r", 1), line("s", "r", 1454), line("s", "q", 3, isApiErrorMessage=True), '{"type":"assistant","sessionId":7,"message":{"usage":"x"}}', '{"type":"user"}']
    write(tmp_path / "b.jsonl", "\n".join(rows) + "\n")
    got = parse_a(batch_lines(spark, str(tmp_path)))
    assert got.usage.count() == 2 and got.failures.count() == 1
    assert {r.kind for r in got.anomalies.collect()} == {"malformed_line"}


def rollout():
    def count(total, last):
        def u(n):
            return {"input_tokens": n, "output_tokens": 0, "total_tokens": n}

        return json.dumps({"type": "event_msg", "timestamp": "2024-01-02T00:00:00Z", "payload": {"type": "token_count", "info": {"total_token_usage": u(total), "last_token_usage": u(last)}}})

    rows = [count(5, 5), json.dumps({"type": "session_meta", "payload": {"id": "s"}}), json.dumps({"type": "turn_context", "payload": {"model": "m"}})]
    rows += [count(100, 100), count(100, 100), count(100, 9), count(160, 60), '{"type":"event_msg","payload":{"type":"context_compacted"}}', '"token_count" {', json.dumps({"type": "turn_context", "payload": {"model": "n"}}), count(200, 40)]
    return [*rows, count(10, 10), json.dumps({"type": "event_msg", "payload": {"type": "token_count", "info": None}}), count(10, 7)]


WANT = [("1:turn", 100, "m"), ("2:off_ledger", 9, "m"), ("3:turn", 60, "m"), ("4:turn", 40, "n"), ("5:turn", 10, "n"), ("6:off_ledger", 7, "n")]
ODD = ["cumulative_rebased", "malformed_line", "usage_before_session"]


def test_rollouts_in_batch(spark, tmp_path):
    write(tmp_path / "rollout-1.jsonl", "\n".join(rollout()) + "\n")
    got = parse_b(batch_lines(spark, str(tmp_path), "rollout-*.jsonl"))
    assert sorted((r.dedup_key, r.input_fresh, r.model_id) for r in got.usage.collect()) == WANT
    assert sorted(r.kind for r in got.anomalies.collect()) == ODD and got.compactions.count() == 1


def test_every_cut_of_a_ledger_gives_the_same_steps(spark):
    """The state of a file, kept as JSON between micro-batches, against the windows of a batch."""
    lines = spark.createDataFrame([("f", i * 10, x) for i, x in enumerate(rollout())], "file_id string, ordinal long, value string")
    events = ledger_events(lines, "2024-01-01 00:00:00")
    pdf = events.toPandas().sort_values("ordinal")
    names = [p.split()[0] for p in ledger.SCHEMA.split(", ")]
    once = list(ledger.advance({}, pdf))
    windows = {r.ordinal: r for r in ledger_steps(events).collect()}
    for row in once:
        own, want = dict(zip(names, row, strict=True)), windows[row[1]]
        assert (own["kind"], own["session_id"], own["model_id"], own["lost"]) == (want.kind, want.session_id, want.model_id, want.lost)
        assert all(own[f"delta_{c}"] == want[f"delta_{c}"] for c in ledger.NAMES)
    for cut in range(len(pdf) + 1):
        state = {}
        head = list(ledger.advance(state, pdf.iloc[:cut]))
        state = json.loads(json.dumps(state))
        assert str(head + list(ledger.advance(state, pdf.iloc[cut:]))) == str(once)


def test_facts_of_three_producers(spark):
    chat = '{"resourceSpans":[{"scopeSpans":[{"spans":[%s,%s]}]}]}'
    span = '{"name":"%s","traceId":"t","endTimeUnixNano":"1700000000123456789","attributes":[{"key":"gen_ai.usage.input_tokens","value":{"intValue":%s}},{"key":"gen_ai.request.model","value":{"intValue":"7"}}]}'
    spans = [chat % (span % ("chat", '"5"'), span % ("chat", "9")), span % ("chatty", "3"), span % ("chat", "-3"), span % ("invoke_agent", "3"), '{"name":"chat","attributes":[{"key":"gen_ai.usage.output_tokens","value":{"stringValue":"4"}}]}']
    c = parse_c(spark.createDataFrame([("c", i, x) for i, x in enumerate(spans)], "file_id string, ordinal long, value string"))
    assert sorted((r.dedup_key, r.input_fresh, r.model_id, str(r.occurred_at)[-6:]) for r in c.usage.collect()) == [("copilot:c:0:0", 5, "7", "123000"), ("copilot:c:0:1", 9, "7", "123000")]
    a_lines = [line("s", "r", 1, isSidechain=True), line("s", "r", 1454), line("s", "q", 3, isApiErrorMessage=True)]
    a_lines += ['{"type":"system","sessionId":"s","subtype":"api_error","retryAttempt":3}', '{"type":"system","sessionId":"s","subtype":"compact_boundary","preTokens":999000}', '{"type":"system","sessionId":"s","subtype":"api_error"}']
    a = parse_a(spark.createDataFrame([("a", i, x) for i, x in enumerate(a_lines)], "file_id string, ordinal long, value string"))
    assert sorted(r.attempt for r in a.retries.collect()) == [1, 3] and [r.pre_tokens for r in a.compactions.collect()] == [999000]
    b = parse_b(spark.createDataFrame([("b", i, x) for i, x in enumerate(rollout())], "file_id string, ordinal long, value string"))
    facts = facts_from_signals(a, b, c).cache()
    assert facts.columns == list(FACT) and facts.select("event_id").distinct().count() == facts.count() == 3 + len(WANT) + 2
    merged = {(r.adapter_id, r.dedup_key): (r.output_total, r.copies, r.request_kind) for r in merge_max(facts).collect()}
    assert merged["claude_code", "r:m"] == (1454, 2, "turn") and merged["claude_code", "q"] == (0, 1, "failed") and len(merged) == 2 + len(WANT) + 2
    assert per_source(facts).filter("raw_json is null").count() == 1 and {r.adapter_id for r in observed(facts).collect()} == {"claude_code", "codex", "copilot"}
    stats = {(r.adapter_id, r.signal, r.kind): r.n for r in pass_statistics(a, b, c).collect()}
    assert stats["claude_code", "usage", None] == 2 and stats["claude_code", "retry", None] == 2 and stats["codex", "anomaly", "malformed_line"] == 1


def test_gauge_and_redaction(spark):
    docs = spark.createDataFrame([('{"tokens-today":{"date":"2024-01-01","tokens":0}}',), ('{"tokens-today":{"date":" ","tokens":1}}',), ("nonsense",)], "value string")
    assert [tuple(r) for r in daily_gauge_document(docs).collect()] == [("2024-01-01", 0)]
    raw = json.dumps({"type": "assistant", "cwd": "/Users/me/x", "n": 5, "text": "a secret", "deep": [{"k": "abcd", "id": "ok"}]})
    got = [r.value for r in redact_json(spark.createDataFrame([(raw,), ("{",)], "value string"), {"type"}, {"cwd"}).collect()]
    first = json.loads(got[0])
    assert first["type"] == "assistant" and first["n"] == 5 and first["text"] == "x" * 8 and first["deep"] == [{"k": "xxxx", "id": "ok"}]
    assert first["cwd"].startswith("/redacted/path-") and got[1] is None
