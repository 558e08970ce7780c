"""The job that ingests: folders of logs to the tables of a store, once to their end or for good.

Each producer is a stream of its own: tailing source, parser, store. ``catch_up`` reads what the logs
have gained since the offsets that are committed, in triggers of bounded bytes, and ends; what is
unchanged is not opened. ``follow`` goes on until it is stopped. Both may take turns on the same
``base`` folder, which holds a store, the stream's checkpoint and the failures to try again per
producer; it must be one that the driver's Python and all executors can open, as the logs' folders are.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..sources.producers import PRODUCERS, Producer, daily_gauge_document, facts_from_signals
from . import tail
from .store import Store


#: Characters of a gauge's document that are looked at.
MAX_DOCUMENT = 1 << 20


def producers(roots: dict[str, str]) -> list[Producer]:
    return [p for p in PRODUCERS if p.adapter_id in roots]


def store(base: str, adapter_id: str) -> Store:
    return Store(os.path.join(base, adapter_id, "store"))


def committed(checkpoint: str) -> dict:
    """The offset that a stream's checkpoint ends with: a new reader does not know it otherwise."""
    folder = os.path.join(checkpoint, "offsets")
    names = [n for n in os.listdir(folder) if n.isdigit()] if os.path.isdir(folder) else []
    if not names:
        return {}
    with open(os.path.join(folder, max(names, key=int))) as f:
        return json.loads(f.read().splitlines()[-1])


def _remember(folder: str, batch: int, failed: list[dict]) -> None:
    """Leaves a batch's failures where the source looks for them; none, if it came again and could be read."""
    name = os.path.join(folder, f"{batch}.json")
    if failed:
        os.makedirs(folder, exist_ok=True)
        with open(f"{name}.new", "w") as f:
            json.dump(failed, f)
        os.replace(f"{name}.new", name)
    elif os.path.exists(name):
        os.remove(name)


def start(spark: SparkSession, producer: Producer, root: str, base: str, source: type[DataSource] = tail.TailSource, every: str = "2 seconds", **options: Any) -> StreamingQuery:
    """The stream of one producer into its store."""
    home = os.path.join(base, producer.adapter_id)
    checkpoint, retries, sink = os.path.join(home, "checkpoint"), os.path.join(home, "retries"), Store(os.path.join(home, "store"))
    known = json.dumps(committed(checkpoint))
    lines = tail.tail_lines(spark, root, producer.glob, producer.needles, source, reports=True, ordered=producer.ordered, retries=retries, known=known, **options)
    signals = producer.parse(lines).signals
    seen = [F.count_if(F.col("signal") == s).alias(s) for s in ("usage", "failure", "retry", "anomaly")]
    signals = signals.observe("pass", F.sum("lines").alias("lines_read"), F.count_if((F.col("signal") == "span") & F.col("hit")).alias("files_scanned"), *seen)

    def batch(rows: DataFrame, number: int) -> None:
        manifest = sink.ingest(rows, number)
        _remember(retries, number, manifest["failed"].get(str(number), []))

    writer = signals.writeStream.queryName(f"{producer.adapter_id} of {base}").foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every).start()


def follow(spark: SparkSession, roots: dict[str, str], base: str, **options: Any) -> list[StreamingQuery]:
    """Streams that go on until they are stopped; ``roots`` maps adapter ids to folders."""
    return [start(spark, p, roots[p.adapter_id], base, **options) for p in producers(roots)]


def catch_up(spark: SparkSession, roots: dict[str, str], base: str, max_bytes: int = tail.MAX_BYTES, **options: Any) -> dict[str, list[dict]]:
    """Reads everything up to the logs' present sizes and ends; the progress of each trigger by adapter."""
    queries = {p.adapter_id: start(spark, p, roots[p.adapter_id], base, every="0 seconds", frozen=True, max_bytes=max_bytes, **options) for p in producers(roots)}
    out = {}
    try:
        for name, query in queries.items():
            query.processAllAvailable()
            out[name] = [json.loads(p.json) for p in query.recentProgress if p.numInputRows]
    finally:
        for query in queries.values():
            query.stop()
    return out


def _together(tables: Iterable[DataFrame | None]) -> DataFrame | None:
    found = [t for t in tables if t is not None]
    return reduce(DataFrame.unionByName, found) if found else None


def facts(spark: SparkSession, base: str, adapters: Iterable[str]) -> DataFrame | None:
    """The requests of several producers' stores; a key names its producer, so they need no merging."""
    return _together(store(base, a).facts(spark) for a in adapters)


def passes(spark: SparkSession, base: str, adapters: Iterable[str]) -> DataFrame | None:
    """The counters of each trigger (see ``store.COUNTED``) by adapter."""
    tables = {a: store(base, a).table(spark, "passes") for a in adapters}
    return _together(t.withColumn("adapter_id", F.lit(a)) for a, t in tables.items() if t is not None)


def sample_gauge(spark: SparkSession, path: str, base: str) -> DataFrame | None:
    """(day, tokens): the largest values so far of a counter that an application keeps in one small document and drops at midnight.

    It has no model, no request and no split, so it has a store of its own and reaches no total. A document that cannot be
    read, does not parse or names no day changes nothing; neither does a value that is known.
    """
    days = Store(os.path.join(base, "gauge", "store"))
    try:
        with open(path, encoding="utf-8", errors="replace") as f:
            text = f.read(MAX_DOCUMENT)
    except OSError:
        return days.table(spark, "gauge")
    now = daily_gauge_document(spark.createDataFrame([(text,)], "value string"))
    known = days.table(spark, "gauge")
    if known is not None:
        now = now.join(known.withColumnRenamed("tokens", "__known"), "day", "left").filter("__known is null or tokens > __known").select("day", "tokens")
    if not now.isEmpty():
        days.commit(spark, days.manifest(spark)["batch"] + 1, {"gauge": now}, [])
    return days.table(spark, "gauge")


def ledger_cursors(spark: SparkSession, base: str, adapter_id: str = "codex") -> DataFrame:
    """(file_id, session_id, model_id, number, ordinal, counters): the state that a restarted ledger goes on with, from the stream's state store."""
    state = spark.read.format("statestore").load(os.path.join(base, adapter_id, "checkpoint"))
    schema = "session string, model string, number bigint, ordinal bigint, base array<bigint>, before bigint, last array<bigint>"
    told = state.select(F.col("key.file_id").alias("file_id"), F.from_json("value.groupState.state", schema).alias("s"))
    return told.select("file_id", F.col("s.session").alias("session_id"), F.col("s.model").alias("model_id"), "s.number", "s.ordinal", F.col("s.base").alias("counters"))


def probe(spark: SparkSession, roots: dict[str, str], files: int = tail.SAMPLE_FILES, tail_bytes: int = tail.SAMPLE_BYTES) -> DataFrame:
    """Facts of the ends of each producer's latest files, for ``operators.capability``: which fields it fills, not who used what.

    The declaration that opens a file is far behind its end, so a ledger's files get a session of their own name.
    """
    found = []
    for p in producers(roots):
        lines = tail.tail_sample(spark, roots[p.adapter_id], p.glob, p.needles, files, tail_bytes)
        if p.ordered:
            opened = F.format_string('{"type":"session_meta","payload":{"id":"%s"}}', "file_id")
            head = lines.select("file_id").distinct().select("file_id", F.lit(-1).cast("long").alias("ordinal"), opened.alias("value"))
            lines = lines.select("file_id", "ordinal", "value").unionByName(head)
        found.append(p.parse(lines))
    return facts_from_signals(*found)


@dataclass
class Progress(StreamingQueryListener):
    """What streams have done since this listener was added: passes, counters of the last and of all, and when; by the query's name."""

    state: dict[str, dict[str, Any]] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self.state.setdefault(event.name or str(event.id), {"passes": 0, "last": {}, "cumulative": {}, "backfilling": True, "last_pass_at": None})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        own = self.state.setdefault(p.name or str(p.id), {"passes": 0, "last": {}, "cumulative": {}, "backfilling": True, "last_pass_at": None})
        counted = p.observedMetrics.get("pass")
        if counted is not None and p.numInputRows:
            own["passes"] += 1
            own["last"] = {k: v or 0 for k, v in counted.asDict().items()}
            own["cumulative"] = {k: own["cumulative"].get(k, 0) + v for k, v in own["last"].items()}
        own["last_pass_at"] = datetime.now(UTC)

    def onQueryIdle(self, event) -> None:
        for own in self.state.values():
            own["backfilling"] = False

    def onQueryTerminated(self, event) -> None:
        pass
