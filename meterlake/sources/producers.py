"""JSON log lines of three producers to one shape of normalised signals, and signals to request facts.

Each producer has a prefilter on whole raw lines, an explicit schema (a known field of the wrong type makes
a line malformed; unknown fields are ignored) and a projection. Lines are (file_id, ordinal, value) and
may have ``bytes``, the length of a line of which ``value`` is only the head, ``hit``, whether the source
found a needle in the whole line, and rows that report on a span that was read (see ``streaming.tail``).

A line is parsed once: every row of ``signals`` is a line (or a span of it) with one of the tags that
it earned - usage, failure, retry, compacted, anomaly, or span for a report - so a line that does not add up is both usage
and anomaly. A further producer is one more function of lines to such rows (see ``Producer``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.display import RFC3339
from ..functions.usage import BANDS, FAILED, SYNTHETIC, bands_a, bands_b, bands_c
from ..operators.ordered import carry_forward, reconcile
from ..streaming.ledger import COUNTERS, REPORT, follow

#: Longer lines are skipped, and counted if they are relevant.
MAX_LINE = 8 * 1024 * 1024

# What a relevant line of each producer holds.
NEEDLES = {
    "a": ('"usage"', '"type":"assistant"', '"type":"system"', '"isApiErrorMessage"'),
    "b": ('"token_count"', '"turn_context"', '"session_meta"', '"context_compacted"'),
    "c": ("resourceSpans", "gen_ai.usage."),
}
_A_USAGE = (
    "struct<input_tokens:bigint,output_tokens:bigint,cache_creation_input_tokens:bigint,cache_read_input_tokens:bigint,"
    "cache_creation:struct<ephemeral_5m_input_tokens:bigint,ephemeral_1h_input_tokens:bigint>>"
)
SCHEMA_A = (
    "type string, subtype string, sessionId string, timestamp string, requestId string, uuid string, isSidechain boolean, agentId string, "
    f"isApiErrorMessage boolean, retryAttempt int, maxRetries int, preTokens bigint, postTokens bigint, message struct<id:string,model:string,usage:{_A_USAGE}>, _bad string"
)
_B_USAGE = (
    "struct<input_tokens:bigint,cached_input_tokens:bigint,cache_write_input_tokens:bigint,output_tokens:bigint,reasoning_output_tokens:bigint,total_tokens:bigint>"
)
SCHEMA_B = f"timestamp string, type string, payload struct<type:string,id:string,model:string,info:struct<total_token_usage:{_B_USAGE},last_token_usage:{_B_USAGE}>>, _bad string"
_SPAN = (
    "struct<name:string,spanId:string,traceId:string,startTimeUnixNano:string,endTimeUnixNano:string,"
    "attributes:array<struct<key:string,value:struct<intValue:string,stringValue:string,doubleValue:double>>>>"
)
SCHEMA_C = f"resourceSpans array<struct<scopeSpans:array<struct<spans:array<{_SPAN}>>>>>, " + _SPAN[7:-1].replace("name:string", "name string").replace("spanId:", "spanId ").replace("traceId:", "traceId ").replace("startTimeUnixNano:", "startTimeUnixNano ").replace("endTimeUnixNano:", "endTimeUnixNano ").replace("attributes:array", "attributes array") + ", _bad string"

SIGNAL = (
    "adapter_id", "file_id", "ordinal", "position", "signal", "kind", "session_id", "dedup_key", "model_id", "occurred_at", "request_kind", "measurement_source",
    *BANDS, "reasoning", "discrepancy", "is_sidechain", "attempt", "pre_tokens", "post_tokens", "raw_json", *REPORT,
)
TYPES = dict.fromkeys((*BANDS, "reasoning", "pre_tokens", "post_tokens", "bytes", "lines", "until"), "bigint") | {
    "position": "int", "attempt": "int", "discrepancy": "boolean", "is_sidechain": "boolean", "hit": "boolean", "occurred_at": "timestamp", "ordinal": "bigint",
}


def candidate(producer: str, value: str = "value") -> Column:
    """Whether a line holds one of the producer's needles; stays below the JSON parse."""
    out = F.lit(False)
    for needle in NEEDLES[producer]:
        out = out | F.contains(F.col(value), F.lit(needle))
    return out


def _beside(df: DataFrame, generator: Callable[[str], Column], value: Column, *keep: str) -> DataFrame:
    """``keep`` beside what a generator makes of a value.

    The value is computed before and is the first column: the optimizer leaves out a generator's input by its
    place, which must not move when other columns are pruned later (else it may lose one of those).
    """
    return df.select(value.alias("__in"), *keep).select(*keep, generator("__in"))


def _once(df: DataFrame, name: str, value: Column, *keep: str) -> DataFrame:
    """``keep`` and a value that later columns and filters read but do not compute again, as it passes a generator."""
    return _beside(df, lambda v: F.explode(F.array(v)).alias(name), value, *keep)


def _parsed(lines: DataFrame, producer: str, schema: str) -> DataFrame:
    """file_id, ordinal, oversize, bad and ``j``, the parsed line, of the relevant lines, and reports; oversize ones are not parsed."""
    told = [F.col(c) if c in lines.columns else F.lit(None).cast(TYPES.get(c, "string")).alias(c) for c in REPORT]
    lines = lines.select("file_id", "ordinal", "value", *told)
    report = F.col("lines").isNotNull()
    size = F.when(~report, F.coalesce(F.col("bytes"), F.octet_length("value")))
    hit = lines.filter(report | F.coalesce("hit", candidate(producer))).withColumn("oversize", F.coalesce(size > MAX_LINE, F.lit(False)))
    parsed = F.from_json(F.when(~F.col("oversize"), F.col("value")), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return _once(hit, "j", parsed, "file_id", "ordinal", "oversize", *REPORT).withColumn("bad", F.coalesce(F.col("j._bad").isNotNull(), F.lit(False)))


def _instant(text: Column, ingested_at: str | None) -> Column:
    """An RFC 3339 text as an instant in whole milliseconds, else the time of ingestion (of the micro-batch or query)."""
    when = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    return F.date_trunc("MILLISECOND", F.coalesce(F.when(text.rlike(RFC3339), F.try_to_timestamp(text)), when))


def _tags(*cases: tuple[Column, str, str | None]) -> Column:
    """(signal, kind) of each case, NULL where it does not hold; a report is a span, and its error the kind."""
    tag = [F.when(when, F.struct(F.lit(signal).alias("signal"), F.lit(kind).cast("string").alias("kind"))) for when, signal, kind in cases]
    span = F.when(F.col("lines").isNotNull(), F.struct(F.lit("span").alias("signal"), F.col("error").alias("kind")))
    return F.array(span, *tag)


def _signals(rows: DataFrame, adapter: str, tags: Column, columns: dict[str, Column]) -> DataFrame:
    """Rows of SIGNAL, one for each tag of a row; columns that a producer does not have are NULL.

    ``columns`` are computed of what earned a tag and only if somebody reads them. Tags and columns are apart
    also because one generated method with both is too long for the JVM to compile.
    """
    each = _beside(rows, lambda t: F.explode(t).alias("__tag"), tags, *rows.columns).filter("__tag is not null").withColumns(columns)
    each = each.withColumns({"adapter_id": F.lit(adapter), "signal": F.col("__tag.signal"), "kind": F.col("__tag.kind")})
    return each.select(*((F.col(c) if c in each.columns else F.lit(None)).cast(TYPES.get(c, "string")).alias(c) for c in SIGNAL))


@dataclass(frozen=True)
class Parsed:
    """The signals of a producer's lines."""

    signals: DataFrame

    def _of(self, signal: str) -> DataFrame:
        return self.signals.filter(F.col("signal") == signal)

    @property
    def usage(self) -> DataFrame:
        return self._of("usage")

    @property
    def failures(self) -> DataFrame:
        return self._of("failure").select("adapter_id", "session_id", "dedup_key", "occurred_at")

    @property
    def anomalies(self) -> DataFrame:
        return self._of("anomaly").select("adapter_id", "file_id", "ordinal", "kind")

    @property
    def retries(self) -> DataFrame:
        """Attempts, not failures: one incident may take many."""
        return self._of("retry").select("adapter_id", "session_id", "occurred_at", "attempt")

    @property
    def compactions(self) -> DataFrame:
        """Sizes of contexts, which never enter a total."""
        return self._of("compacted").select("adapter_id", "session_id", "occurred_at", "pre_tokens", "post_tokens")


def parse_a(lines: DataFrame, ingested_at: str | None = None) -> Parsed:
    """Producer A: one request a line, repeated as it streams; writes may be split by time to live."""
    j = F.col("j")
    message, u = j["message"], j["message"]["usage"]
    bands = bands_a(u["input_tokens"], u["output_tokens"], u["cache_creation_input_tokens"], u["cache_read_input_tokens"], u["cache_creation"]["ephemeral_5m_input_tokens"], u["cache_creation"]["ephemeral_1h_input_tokens"])
    good = ~F.col("bad") & j["sessionId"].isNotNull()
    turn, system = good & (j["type"] == "assistant") & message.isNotNull(), good & (j["type"] == "system")
    failed = turn & (F.coalesce(message["model"] == SYNTHETIC, F.lit(False)) | F.coalesce(j["isApiErrorMessage"], F.lit(False)))
    used = turn & ~failed & u.isNotNull()
    both = F.when(j["requestId"].isNotNull() & message["id"].isNotNull(), F.concat_ws(":", j["requestId"], message["id"]))
    name = F.coalesce(both, j["requestId"], message["id"])
    columns = {
        **bands, "dedup_key": F.when(F.col("is.failed"), F.coalesce(j["requestId"], j["uuid"], F.lit("failed"))).otherwise(name),
        "session_id": j["sessionId"], "model_id": message["model"], "occurred_at": _instant(j["timestamp"], ingested_at), "request_kind": F.lit("turn"),
        "measurement_source": F.lit("provider_exact"), "is_sidechain": F.coalesce(j["isSidechain"], F.lit(False)), "attempt": F.coalesce(j["retryAttempt"], F.lit(1)),
        "pre_tokens": j["preTokens"], "post_tokens": j["postTokens"], "raw_json": F.to_json(u), "position": F.lit(0),
    }
    known = j["requestId"].isNotNull() | message["id"].isNotNull()
    earned = {
        "failed": failed, "used": used & known, "nameless": used & ~known, "odd": used & bands["discrepancy"],
        "again": system & (j["subtype"] == "api_error"), "smaller": system & (j["subtype"] == "compact_boundary"),
    }
    rows = _parsed(lines, "a", SCHEMA_A)
    rows = _once(rows, "is", F.struct(*(v.alias(k) for k, v in earned.items())), *rows.columns)
    tags = _tags(
        (F.col("oversize"), "anomaly", "oversize_relevant_line"), (F.col("bad"), "anomaly", "malformed_line"), (F.col("is.failed"), "failure", None),
        (F.col("is.used"), "usage", None), (F.col("is.nameless"), "anomaly", "no_dedup_key"), (F.col("is.odd"), "anomaly", "provider_self_inconsistent"),
        (F.col("is.again"), "retry", None), (F.col("is.smaller"), "compacted", None),
    )
    return Parsed(_signals(rows, "claude_code", tags, columns))


def ledger_events(lines: DataFrame, ingested_at: str | None = None) -> DataFrame:
    """Producer B's relevant lines: what each declares or counts. A count's columns are NULL where it says nothing."""
    j = F.col("j")
    payload = j["payload"]
    event = ~F.col("bad") & payload.isNotNull() & (j["type"] == "event_msg")
    count = F.coalesce(event & (payload["type"] == "token_count"), F.lit(False))
    now, last = payload["info"]["total_token_usage"], payload["info"]["last_token_usage"]

    def total(u: Column) -> Column:
        own = F.coalesce(u["input_tokens"], F.lit(0)) + F.coalesce(u["output_tokens"], F.lit(0))
        return F.when(u.isNotNull(), F.coalesce(u["total_tokens"], own))

    return _parsed(lines, "b", SCHEMA_B).select(
        "file_id", "ordinal", "oversize", "bad", _instant(j["timestamp"], ingested_at).alias("occurred_at"), count.alias("is_count"),
        F.coalesce(event & (payload["type"] == "context_compacted"), F.lit(False)).alias("compacted"),
        F.when(j["type"] == "session_meta", payload["id"]).alias("session_said"), F.when(j["type"] == "turn_context", payload["model"]).alias("model_said"),
        *(F.when(count, now[c]).alias(c) for c in COUNTERS), *(F.when(count, last[c]).alias(f"last_{c}") for c in COUNTERS),
        F.when(count, total(now)).alias("cumulative"), F.when(count, total(last)).alias("last_total"), *REPORT,
    )


def ledger_steps(events: DataFrame) -> DataFrame:
    """Events with the session and model in force, their kind and step (see ``reconcile``) and whether the session is known.

    Batches take windows over a file, streams the state of a file; both give the same rows.
    """
    if events.isStreaming:
        return follow(events)
    order = ["ordinal"]
    said = carry_forward(carry_forward(events, "file_id", order, "session_said", "session_id"), "file_id", order, "model_said", "model_id")
    lost = F.col("is_count") & F.col("session_id").isNull() & F.col("cumulative").isNotNull()
    said = said.withColumn("lost", lost)
    for c in (*COUNTERS, *(f"last_{c}" for c in COUNTERS), "cumulative", "last_total"):
        said = said.withColumn(c, F.when(F.col("session_id").isNotNull(), F.col(c)))  # what comes before a session moves nothing
    return reconcile(said, "file_id", order, list(COUNTERS), "cumulative", "last")


def parse_b(lines: DataFrame, ingested_at: str | None = None) -> Parsed:
    """Producer B: cumulative counters per file; sessions and models are declared and carried forward.

    A request's key is its number among the file's requests, which is the same however the file is read.
    """
    steps = ledger_steps(ledger_events(lines, ingested_at))
    emitted, off = F.col("step_kind").isin("turn", "reset", "off_ledger"), F.col("step_kind") == "off_ledger"
    delta = [F.col(f"delta_{c}") for c in COUNTERS]
    request_kind = F.when(off, "off_ledger").otherwise("turn")
    rows = steps.withColumnRenamed("kind", "step_kind").withColumns({**bands_b(*delta, F.col("delta_total"), off), "request_kind": request_kind})
    rows = rows.withColumn("__used", emitted & ~F.col("invalid"))
    if not lines.isStreaming:
        before = W.partitionBy("file_id").orderBy("ordinal").rowsBetween(W.unboundedPreceding, 0)
        rows = rows.withColumn("number", F.sum(F.col("__used").cast("long")).over(before))
    native = F.struct(*(F.col(f"delta_{c}").alias(c) for c in COUNTERS), F.col("delta_total").alias("total_tokens"))
    columns = {
        "dedup_key": F.concat_ws(":", "number", "request_kind"), "measurement_source": F.when(off, "provider_off_ledger").otherwise("provider_cumulative_delta"),
        "is_sidechain": F.lit(False), "raw_json": F.to_json(native), "position": F.lit(0),
    }
    tags = _tags(
        (F.col("oversize"), "anomaly", "oversize_relevant_line"), (F.col("bad"), "anomaly", "malformed_line"), (F.col("lost"), "anomaly", "usage_before_session"),
        (F.col("step_kind") == "reset", "anomaly", "cumulative_rebased"), (emitted & F.col("invalid"), "anomaly", "normalize_failed"),
        (F.col("__used") & F.col("discrepancy"), "anomaly", "provider_self_inconsistent"), (F.col("__used"), "usage", None),
        (F.col("compacted") & F.col("session_id").isNotNull(), "compacted", None),
    )
    return Parsed(_signals(rows, "codex", tags, columns))


def parse_c(lines: DataFrame, ingested_at: str | None = None) -> Parsed:
    """Producer C: trace spans, in envelopes or one a line; only calls (spans named ``chat``) with a count are requests.

    A span without an id is known by its file, its line and its place in it.
    """
    j = F.col("j")
    scopes = F.flatten(F.transform(j["resourceSpans"], lambda r: F.coalesce(r["scopeSpans"], F.array())))
    spans = F.flatten(F.transform(scopes, lambda s: F.coalesce(s["spans"], F.array())))
    bare = F.array(F.struct(*[j[c].alias(c) for c in ("name", "spanId", "traceId", "startTimeUnixNano", "endTimeUnixNano", "attributes")]))
    rows = _parsed(lines, "c", SCHEMA_C)
    keep = ("file_id", "ordinal", "oversize", "bad", *REPORT)
    # a line without spans stays as one row, for its anomalies
    found = F.when(j["resourceSpans"].isNotNull(), spans).when(~F.col("oversize") & ~F.col("bad"), bare)
    each = _beside(rows, lambda v: F.posexplode_outer(v).alias("position", "s"), found, *keep)
    each = _once(each, "back", F.reverse("s.attributes"), *keep, "position", "s")  # the last of a key is the first then

    def attribute(key: str) -> Column:
        place = F.array_position("back.key", key).cast("int")
        known = F.filter("back", lambda a: (a["key"] == key) & a["value"].isNotNull())  # looked for only if the last has no value
        return F.coalesce(F.get("back.value", place - 1), F.when(place > 0, F.get(known, F.lit(0))["value"]))

    found = F.struct(*(attribute(key).alias(name) for name, key in ATTRIBUTES.items()))
    each = _once(each, "v", found, *keep, "position", "s")

    def number(name: str) -> Column:
        v, whole = F.col(f"v.{name}.intValue"), F.col(f"v.{name}.doubleValue")
        double = F.when((whole >= 0) & (whole == F.floor(whole)), whole.cast("long"))
        return F.coalesce(F.when(v.rlike(r"^\+?[0-9]+$"), v.try_cast("long")), double)

    def text(name: str) -> Column:
        return F.coalesce(F.col(f"v.{name}.stringValue"), F.col(f"v.{name}.intValue"))

    numbers = F.struct(*(number(n).alias(n) for n in ("inp", "out", "read", "write", "think")), F.coalesce(text("answered"), text("asked")).alias("model"))
    each = _once(each.withColumn("conversation", text("conversation")), "n", numbers, *keep, "position", "s", "conversation")
    n = F.col("n")
    call = ~F.col("bad") & ~F.col("oversize") & F.coalesce(F.col("s.name") == "chat", F.lit(False)) & (n["inp"].isNotNull() | n["out"].isNotNull())
    nanos = F.coalesce(F.col("s.endTimeUnixNano").try_cast("decimal(20,0)"), F.col("s.startTimeUnixNano").try_cast("decimal(20,0)"))
    when = F.lit(ingested_at).cast("timestamp") if ingested_at else F.current_timestamp()
    raw = F.struct(*(n[name].alias(key) for name, key in list(ATTRIBUTES.items())[:5]), n["model"].alias("gen_ai.response.model"))
    bands = bands_c(n["inp"], n["read"], n["write"], n["out"], n["think"])
    invalid = bands.pop("invalid")
    columns = {
        **bands, "session_id": F.coalesce("conversation", "s.traceId", F.lit("unknown")), "model_id": n["model"],
        "occurred_at": F.date_trunc("MILLISECOND", F.coalesce(F.timestamp_micros(F.floor(nanos / 1000).cast("long")), when)),
        "dedup_key": F.coalesce("s.spanId", F.concat_ws(":", F.lit("copilot"), "file_id", "ordinal", "position")), "request_kind": F.lit("assistant"),
        "measurement_source": F.lit("provider_otel_span"), "discrepancy": F.lit(False), "is_sidechain": F.lit(False), "raw_json": F.to_json(raw, {"ignoreNullFields": "false"}),
    }
    cache = F.coalesce(n["read"], F.lit(0)) > F.coalesce(n["inp"], F.lit(0))
    tags = _tags(
        (F.col("oversize"), "anomaly", "oversize_relevant_line"), (F.col("bad"), "anomaly", "malformed_line"), (call & ~invalid, "usage", None),
        (call & cache, "anomaly", "copilot_cache_exceeds_input"), (call & ~cache & invalid, "anomaly", "copilot_reasoning_exceeds_output"),
    )
    return Parsed(_signals(each, "copilot", tags, columns))


# Attributes of a call span.
ATTRIBUTES = {
    "inp": "gen_ai.usage.input_tokens", "out": "gen_ai.usage.output_tokens", "read": "gen_ai.usage.cache_read.input_tokens",
    "write": "gen_ai.usage.cache_creation.input_tokens", "think": "gen_ai.usage.reasoning.output_tokens", "conversation": "gen_ai.conversation.id",
    "answered": "gen_ai.response.model", "asked": "gen_ai.request.model",
}


@dataclass(frozen=True)
class Producer:
    """A producer: its adapter id, the files to tail, lines to signals, what relevant lines hold, and whether lines must come in order."""

    adapter_id: str
    glob: str
    parse: Callable[..., Parsed]
    needles: tuple[str, ...] = ()
    ordered: bool = False


PRODUCERS = (
    Producer("claude_code", "*.jsonl", parse_a, NEEDLES["a"]), Producer("codex", "rollout-*.jsonl", parse_b, NEEDLES["b"], True), Producer("copilot", "*.jsonl", parse_c, NEEDLES["c"]),
)

FACT = (
    "event_id", "occurred_at", "adapter_id", "session_id", "dedup_key", "task_id", "model_id", "request_kind", "measurement_source", "raw_json", "is_sidechain",
    *BANDS, "reasoning",
)


def facts_from_signals(*parsed: Parsed) -> DataFrame:
    """The requests of all producers as one table of facts (FACT), before merging.

    Failures are requests too, of which nothing could be measured. ``event_id`` names the place that a row
    was read from, so it is the same however often that is.
    """
    every = reduce(DataFrame.unionByName, (p.signals for p in parsed)).filter(F.col("signal").isin("usage", "failure"))
    failed = F.col("signal") == "failure"
    none = F.lit(0).cast("long")
    return every.withColumns({
        "event_id": F.concat_ws(":", "file_id", F.lpad(F.col("ordinal").cast("string"), 20, "0"), F.lpad(F.col("position").cast("string"), 6, "0")),
        "task_id": F.lit(None).cast("string"), "request_kind": F.when(failed, FAILED).otherwise(F.col("request_kind")),
        "measurement_source": F.when(failed, "unknown").otherwise(F.col("measurement_source")), "model_id": F.when(~failed, F.col("model_id")),
        "raw_json": F.when(~failed, F.col("raw_json")), "reasoning": F.when(~failed, F.col("reasoning")), **{b: F.when(failed, none).otherwise(F.col(b)) for b in BANDS},
    }).select(*FACT)


def pass_statistics(*parsed: Parsed) -> DataFrame:
    """What a pass found: per adapter the rows of each signal and kind of anomaly."""
    every = reduce(DataFrame.unionByName, (p.signals for p in parsed))
    return every.groupBy("adapter_id", "signal", "kind").agg(F.count(F.lit(1)).alias("n"))


def daily_gauge_document(documents: DataFrame) -> DataFrame:
    """(day, tokens) of whole JSON documents (value); what does not parse or has no day is left out."""
    schema = "`tokens-today` struct<date:string,tokens:bigint>"
    got = documents.select(F.from_json("value", schema).alias("j")).select(F.col("j.tokens-today.date").alias("day"), F.col("j.tokens-today.tokens").alias("tokens"))
    return got.filter("trim(day) != '' and tokens is not null")
