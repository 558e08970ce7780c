"""Several tables that a stream's batches change together, as parts under one manifest.

A batch writes a part of each table and then a manifest that lists all live parts; the manifest's
rename is the commit, so requests, sources, failures, anomalies, spans and counters of a batch appear
together or not at all. Parts have names of their own: a batch that comes again (its process was
killed before the stream's own commit) replaces its parts in the next manifest, and what no manifest
lists is removed later.

Parts have levels: ``fanout`` parts of a level become one of the next, so a row is rewritten once a
level and their number grows with the logarithm of the table. Parts above level 0 are dealt into
``buckets`` by their key, and a merge of parts is one aggregation by it. Reading merges what is live
(see ``operators.merge``), so it is the same whatever has been compacted.

All files go through Spark's own file systems, so the path may be in any store with an atomic rename.
One stream writes a store at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.usage import FAILED
from ..operators.merge import KEY, combine, daily_gauge, finish, states
from ..sources.producers import Parsed, facts_from_signals

#: Manifests that stay, for readers that began with them.
KEEP = 8
#: What a pass counts, in the order of the table.
COUNTED = ("files_scanned", "files_skipped", "lines_read", "usage_recorded", "duplicates", "failures", "retry_attempts", "anomalies", "oversize_relevant")
UNREADABLE = "unreadable_file"


def _append(rows: DataFrame) -> DataFrame:
    return rows


def _first_failures(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEY).agg(F.min("first").alias("first"))


#: Tables: the columns that deal their rows into buckets, and how rows of several parts become one.
TABLES: dict[str, tuple[tuple[str, ...], Callable[[DataFrame], DataFrame]]] = {
    "requests": (KEY, combine),
    "per_source": (KEY, lambda rows: combine(rows, "measurement_source")),
    "failures": (KEY, _first_failures),
    "anomalies": (("file_id",), lambda rows: rows.distinct()),
    "spans": (("file_id",), _append),
    "passes": (("batch",), _append),
    "gauge": (("day",), lambda rows: daily_gauge(rows, "day", "tokens")),
}


@dataclass
class Store:
    path: str
    fanout: int = 8
    buckets: int = 64

    # files

    def _fs(self, spark: SparkSession, path: str) -> tuple[Any, Any]:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark._jsc.hadoopConfiguration()), at

    def _names(self, spark: SparkSession, folder: str) -> list[str]:
        fs, at = self._fs(spark, f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def _versions(self, spark: SparkSession) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names(spark, "manifests") if n.endswith(".json") and not n.startswith((".", "_"))]

    def manifest(self, spark: SparkSession, version: int | None = None) -> dict:
        """The latest manifest, or one by its version: the batch that it ends with, the live parts, and spans that could not be read."""
        versions = self._versions(spark)
        if not versions:
            return {"version": -1, "batch": -1, "parts": [], "failed": {}}
        fs, at = self._fs(spark, f"{self.path}/manifests/{versions[-1] if version is None else version:020d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, spark: SparkSession, manifest: dict) -> None:
        """Writes a manifest aside and renames it: until then readers see the one before."""
        name = f"{self.path}/manifests/{manifest['version']:020d}.json"
        fs, aside = self._fs(spark, f"{self.path}/manifests/_{uuid.uuid4().hex}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(aside, self._fs(spark, name)[1]):
            raise RuntimeError(f"{name} is there already: another stream writes this store")

    def _write(self, rows: DataFrame, table: str, level: int, batch: int) -> dict:
        name, schema = f"{table}/{batch:012d}-{level}-{uuid.uuid4().hex}", rows.schema.json()
        if level:
            keys, _ = TABLES[table]
            rows = rows.withColumn("bucket", self._bucket(table)).repartition(self.buckets, "bucket").sortWithinPartitions("bucket", *keys)
            rows.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        else:
            rows.write.parquet(f"{self.path}/{name}")
        return {"table": table, "name": name, "level": level, "batch": batch, "schema": schema}

    # reading

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][0]), F.lit(self.buckets)).cast("int")

    def _rows(self, spark: SparkSession, parts: list[dict], buckets: list[int] | None = None) -> DataFrame | None:
        """The rows of parts of one table, as they stand; of parts that are dealt, those of ``buckets`` if they are given."""
        plain, dealt = ([f"{self.path}/{p['name']}" for p in parts if (p["level"] > 0) == level] for level in (False, True))
        if not parts:
            return None
        reader = spark.read.schema(StructType.fromJson(json.loads(parts[-1]["schema"])))
        some = [reader.parquet(*plain)] if plain else []
        some += [(rows if buckets is None else rows.filter(F.col("bucket").isin(buckets))).drop("bucket") for rows in map(reader.parquet, dealt)]
        return reduce(DataFrame.unionByName, some)

    def table(self, spark: SparkSession, name: str, manifest: dict | None = None) -> DataFrame | None:
        """A table as the latest (or the given) manifest has it; None before the first batch."""
        manifest = manifest or self.manifest(spark)
        rows = self._rows(spark, [p for p in manifest["parts"] if p["table"] == name])
        return None if rows is None else TABLES[name][1](rows)

    def facts(self, spark: SparkSession) -> DataFrame | None:
        """One row per request, as reports take them."""
        rows = self.table(spark, "requests")
        return None if rows is None else finish(rows).withColumnRenamed("last_event_id", "event_id").withColumn("task_id", F.lit(None).cast("string"))

    def per_source(self, spark: SparkSession) -> DataFrame | None:
        """One row per request and measurement source."""
        rows = self.table(spark, "per_source")
        return None if rows is None else finish(rows.drop("measurement_source")).drop("last_event_id")

    def failures(self, spark: SparkSession) -> DataFrame | None:
        """The first failure of each key."""
        rows = self.table(spark, "failures")
        return None if rows is None else rows.select(*KEY, F.col("first.occurred_at").alias("occurred_at"))

    def anomalies(self, spark: SparkSession) -> DataFrame | None:
        """What did not add up (adapter_id, file_id, ordinal, position, kind), and a ``request_failed`` for each request first seen as a failure."""
        rows, requests = self.table(spark, "anomalies"), self.table(spark, "requests")
        if rows is None:
            return None
        place = F.split("first.event_id", ":")
        failed = requests.filter(F.col("first.request_kind") == FAILED).select(
            "adapter_id", place[0].alias("file_id"), place[1].cast("long").alias("ordinal"), place[2].cast("int").alias("position"), F.lit("request_failed").alias("kind")
        )
        return rows.unionByName(failed)

    def cursors(self, spark: SparkSession) -> DataFrame | None:
        """(file_id, path, place, held): the latest name of each file, how far it was read, and whether it waits to be read again from there."""
        rows = self.table(spark, "spans")
        if rows is None:
            return None
        latest = F.struct("batch", (F.col("ordinal") + F.col("bytes")).alias("place"))
        each = rows.groupBy("file_id").agg(F.max_by("path", latest).alias("path"), F.max(latest).alias("at"))
        held = [(r["file_id"], r["begin"]) for rows in self.open_failures(spark).values() for r in rows]
        waiting = spark.createDataFrame(held, "file_id string, begin long").groupBy("file_id").agg(F.min("begin").alias("begin"))
        each = each.join(waiting, "file_id", "left")
        return each.select("file_id", "path", F.coalesce("begin", F.col("at.place")).alias("place"), F.col("begin").isNotNull().alias("held"))

    def open_failures(self, spark: SparkSession) -> dict[int, list[dict]]:
        """Batch -> spans that could not be read in it and have not been read since."""
        return {int(k): v for k, v in self.manifest(spark)["failed"].items()}

    # writing

    def _compacted(self, spark: SparkSession, parts: list[dict]) -> list[dict]:
        """``parts`` with a full level 0 made one part of the next level, and so on where that fills it too."""
        for table, (_, merge) in TABLES.items():
            level, full = 0, []
            while True:
                own = [p for p in parts if p["table"] == table and p["level"] == level]
                if len(own) + bool(full) < self.fanout:
                    break
                level, full = level + 1, full + own
            if full:
                whole = self._write(merge(self._rows(spark, full)), table, level, max(p["batch"] for p in full))
                parts = [p for p in parts if p not in full] + [whole]
        return parts

    def commit(self, spark: SparkSession, batch: int, tables: dict[str, DataFrame], failed: list[dict]) -> dict:
        """Makes a batch's rows visible; a batch that comes again takes the place of its first try."""
        before = self.manifest(spark)
        parts = [p for p in before["parts"] if not (p["level"] == 0 and p["batch"] == batch)]
        parts = self._compacted(spark, parts)
        parts += [self._write(rows, table, 0, batch) for table, rows in tables.items()]
        read = {(r["file_id"], r["begin"]) for r in tables["spans"].select("file_id", F.col("ordinal").alias("begin")).collect()} if before["failed"] and "spans" in tables else set()
        still = {k: [r for r in rows if (r["file_id"], r["begin"]) not in read] for k, rows in before["failed"].items() if int(k) != batch}
        still = {k: rows for k, rows in still.items() if rows} | ({str(batch): failed} if failed else {})
        manifest = {"version": before["version"] + 1, "batch": batch, "parts": parts, "failed": still}
        self._publish(spark, manifest)
        self._clean(spark)
        return manifest

    def _clean(self, spark: SparkSession) -> None:
        """Removes manifests but the last KEEP, and parts that none of those lists."""
        versions = self._versions(spark)
        if len(versions) <= KEEP:
            return
        live = {p["name"] for v in versions[-KEEP:] for p in self.manifest(spark, v)["parts"]}
        gone = {p["name"] for v in versions[:-KEEP] for p in self.manifest(spark, v)["parts"]} - live
        for name in [*sorted(gone), *(f"manifests/{v:020d}.json" for v in versions[:-KEEP])]:
            fs, at = self._fs(spark, f"{self.path}/{name}")
            fs.delete(at, True)

    def vacuum(self, spark: SparkSession) -> int:
        """Removes parts that no manifest lists: what killed batches left. Not while a batch is written."""
        live = {p["name"] for v in self._versions(spark) for p in self.manifest(spark, v)["parts"]}
        orphans = [f"{t}/{n}" for t in TABLES for n in self._names(spark, t) if f"{t}/{n}" not in live]
        for name in orphans:
            fs, at = self._fs(spark, f"{self.path}/{name}")
            fs.delete(at, True)
        return len(orphans)

    def ingest(self, signals: DataFrame, batch: int) -> dict:
        """``foreachBatch``: a batch of a producer's signals, with the reports on its spans, becomes a commit."""
        spark = signals.sparkSession
        signals = signals.persist()
        try:
            parsed = Parsed(signals)
            place = F.col("ordinal") + F.col("bytes")
            spans = parsed._of("span").select("adapter_id", F.lit(batch).cast("long").alias("batch"), "file_id", "path", "ordinal", "bytes", "until", "lines", "hit", F.col("kind").alias("error"))
            lost = spans.filter("error is not null").select("adapter_id", "file_id", place.alias("ordinal"), F.lit(0).alias("position"), F.lit(UNREADABLE).alias("kind"))
            anomalies = parsed._of("anomaly").select("adapter_id", "file_id", "ordinal", "position", "kind").unionByName(lost)
            each = states(facts_from_signals(parsed))
            failed = each.filter(F.col("first.request_kind") == FAILED)
            tables = {
                "requests": combine(each), "per_source": TABLES["per_source"][1](each.filter(F.col("first.request_kind") != FAILED)), "failures": _first_failures(failed),
                "anomalies": anomalies.distinct(), "spans": spans,
            }
            tables["passes"] = self._pass(spark, signals, anomalies, batch)
            # a span that failed is tried again from where it stopped
            open_ = spans.filter("error is not null").select("file_id", "path", place.alias("begin"), F.col("until").alias("end"), "error")
            return self.commit(spark, batch, tables, [r.asDict() for r in open_.collect()])
        finally:
            signals.unpersist()

    def _pass(self, spark: SparkSession, signals: DataFrame, anomalies: DataFrame, batch: int) -> DataFrame:
        """The counters of a batch (COUNTED), one row: usage whose request is new is recorded, all other is a duplicate."""
        before = self.manifest(spark)
        before = before | {"parts": [p for p in before["parts"] if not (p["level"] == 0 and p["batch"] == batch)]}
        requests, spans = ([p for p in before["parts"] if p["table"] == t] for t in ("requests", "spans"))
        spans = self._rows(spark, spans)
        keys = signals.filter("signal = 'usage'").select(*KEY).distinct()
        # whether a request is new is asked of the keys in the buckets that the batch touches
        touched = [r[0] for r in keys.select(self._bucket("requests")).distinct().collect()]
        known = self._rows(spark, requests, touched)
        new = keys if known is None else keys.join(known.select(*KEY), list(KEY), "left_anti")
        files = signals.filter("signal = 'span'").select("file_id").distinct()
        skipped = None if spans is None else spans.select("file_id").distinct().join(files, "file_id", "left_anti")
        counts = signals.agg(
            F.count_if((F.col("signal") == "span") & F.col("hit")).alias("files_scanned"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines_read"), F.count_if(F.col("signal") == "usage").alias("usage"),
            F.count_if(F.col("signal") == "failure").alias("failures"), F.count_if(F.col("signal") == "retry").alias("retry_attempts"),
            F.count_if((F.col("signal") == "anomaly") & (F.col("kind") == "oversize_relevant_line")).alias("oversize_relevant"),
        )
        ones = [counts, new.agg(F.count(F.lit(1)).alias("usage_recorded")), anomalies.agg(F.count(F.lit(1)).alias("anomalies"))]
        ones += [] if skipped is None else [skipped.agg(F.count(F.lit(1)).alias("files_skipped"))]
        out = ones[0]
        for one in ones[1:]:
            out = out.join(one, F.lit(True), "left")  # one row each
        out = out.withColumns({"batch": F.lit(batch).cast("long"), "duplicates": F.col("usage") - F.col("usage_recorded")})
        if skipped is None:
            out = out.withColumn("files_skipped", F.lit(0).cast("long"))
        return out.select("batch", *COUNTED)
