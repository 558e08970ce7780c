"""Appended JSONL lines as a source: in batches, as a stream, and as a sample of the files' ends.

Spark's file stream reads a file once; logs grow. This source's offset is the place reached in each
file, planned from sizes without reading a byte. What a file gained is cut into spans for the
executors; a span yields the lines whose newline lies in it, so half-written lines wait. A line is
numbered by its own offset in the file, and a file known by device and inode, in batches and streams
alike. A file that shrank is read anew. Of a line over MAX_LINE only the head is passed on, with its length.

``needles`` are pushed down to the reader: a span is searched as bytes, and only lines that hold one
of them anywhere leave it. A trigger admits at most ``max_bytes``, files that changed last first.

With ``reports`` a span also yields a row of its own (value NULL): from which place to which it was
read, how many lines it saw, and what went wrong. What could not be read goes on as ``error`` instead
of failing the batch; who commits the batch records it in the folder ``retries`` (see ``store``), and
the source plans it again, when it starts anew or RETRY_AFTER seconds later. Until then such a file is
not read further, so its lines never come out of order; with ``ordered`` a file gives one span a
trigger, for consumers that follow its lines one after another.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .listing import File, Listing, newest

SCHEMA = "file_id string, path string, ordinal long, bytes long, value string, hit boolean, lines long, until long, error string"
MAX_LINE = 8 * 1024 * 1024
#: Bytes of a longer line that are passed on.
HEAD = 4096
CHUNK = 1024 * 1024
#: Bytes of a file that one task reads.
SPAN_BYTES = 64 * 1024 * 1024
#: Tasks that a reading is dealt to, about, and bytes that a task of small files reads at least.
TASKS, LEAST_BYTES = 64, 1024 * 1024
#: Bytes that one trigger admits, unless told otherwise.
MAX_BYTES = 64 * 1024 * 1024 * 1024
#: Files of a sample, and bytes of each.
SAMPLE_FILES, SAMPLE_BYTES = 5, 512 * 1024
#: Seconds until a running query tries again what could not be read.
RETRY_AFTER = 60
#: The key of an offset that tells which failures have been planned again.
AGAIN = "again"


def line_start(f: BinaryIO, at: int) -> int:
    """Where the line begins that the byte before ``at`` belongs to, or a new one if that byte ends a line."""
    while at > 0:
        begin = max(0, at - CHUNK)
        f.seek(begin)
        found = f.read(at - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        at = begin
    return 0


class Lines:
    """The lines of an open file whose newline lies in [begin, end): (offset, length, line or the head of an oversize one).

    ``needles`` (bytes) leave out lines that hold none of them. ``place`` is the end of the last line
    that was passed, and ``seen`` counts the lines, also those left out. With ``fragment`` reading begins
    at ``begin`` itself, and what stands before the first newline is dropped.
    """

    def __init__(self, f: BinaryIO, begin: int, end: int, needles: tuple[bytes, ...] = (), fragment: bool = False):
        self.file, self.end, self.seen, self.fragment = f, end, 0, fragment
        self.wanted = re.compile(b"|".join(map(re.escape, needles))) if needles else None
        self.overlap = max(map(len, needles), default=1) - 1
        self.place = begin if fragment else line_start(f, begin)

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        self.file.seek(self.place)
        held, read = b"", self.place
        while read < self.end:
            chunk = self.file.read(min(CHUNK, self.end - read))
            if not chunk:
                return
            read += len(chunk)
            if self.fragment:
                stop = chunk.find(b"\n") + 1
                self.place, self.fragment = (self.place + stop, False) if stop else (read, True)
                held = chunk[stop:] if stop else b""
                if not held:
                    continue
            else:
                held += chunk
            last = held.rfind(b"\n") + 1
            if last:
                yield from self._whole(held[:last])
                held = held[last:]
            elif len(held) > MAX_LINE:
                size, hit, rest = yield from self._oversize(held, read)
                if size is None:
                    return
                read, held = self.place + len(rest), rest

    def _whole(self, block: bytes) -> Iterator[tuple[int, int, bytes]]:
        base = self.place
        if self.wanted is None:
            begin = 0
            while begin < len(block):
                stop = block.index(b"\n", begin)
                self.seen += 1
                self.place = base + stop + 1
                yield base + begin, stop - begin, block[begin : min(stop, begin + HEAD) if stop - begin > MAX_LINE else stop]
                begin = stop + 1
        else:
            begin = 0
            while found := self.wanted.search(block, begin):
                start, stop = block.rfind(b"\n", 0, found.start()) + 1, block.index(b"\n", found.end())
                yield base + start, stop - start, block[start : min(stop, start + HEAD) if stop - start > MAX_LINE else stop]
                begin = stop + 1
            self.seen += block.count(b"\n")
        self.place = base + len(block)

    def _oversize(self, held: bytes, read: int):
        """The rest of a line longer than MAX_LINE, of which only the head and whether it has a needle are kept."""
        start, head, tail = self.place, held[:HEAD], held
        hit = self.wanted is None or bool(self.wanted.search(held))
        while True:
            tail = tail[len(tail) - self.overlap :] if self.overlap else b""
            chunk = self.file.read(min(CHUNK, self.end - read))
            if not chunk:
                return None, hit, b""
            stop = chunk.find(b"\n")
            part = tail + (chunk if stop < 0 else chunk[:stop])
            hit = hit or bool(self.wanted.search(part))
            if stop >= 0:
                size = read + stop - start
                self.seen += 1
                self.place = read + stop + 1
                if hit:
                    yield start, size, head
                return size, hit, chunk[stop + 1 :]
            tail, read = part, read + len(chunk)


def read_lines(path: str, begin: int, end: int, needles: tuple[bytes, ...] = ()) -> Iterator[tuple[int, int, bytes]]:
    """``Lines`` of a file by its path."""
    with open(path, "rb") as f:
        yield from Lines(f, begin, end, needles)


class Span(InputPartition):
    def __init__(self, file_id: str, path: str, begin: int, end: int, fragment: bool = False):
        self.file_id, self.path, self.begin, self.end = file_id, path, begin, end
        #: Whether the first line may be cut, and is left out.
        self.fragment = fragment
        #: Whether this is the file's first span of its batch.
        self.first = True


def cut_spans(file_id: str, path: str, begin: int, end: int) -> list[Span]:
    """Spans of what a file gained; an empty one tells of a file that only has a new name."""
    spans = [Span(file_id, path, at, min(at + SPAN_BYTES, end)) for at in range(begin, end, SPAN_BYTES)] or [Span(file_id, path, end, end)]
    for span in spans[1:]:
        span.first = False
    return spans


class Task(InputPartition):
    """Spans that one task reads, in order: a large one or several of small files."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def packed(spans: list[Span]) -> list[Task]:
    """Spans dealt to tasks of about a TASKS-th of all bytes, at least LEAST_BYTES and at most SPAN_BYTES each."""
    size = min(max(sum(s.end - s.begin for s in spans) // TASKS, LEAST_BYTES), SPAN_BYTES)
    tasks: list[Task] = []
    room = 0
    for span in spans:
        if room <= 0:
            tasks.append(Task([]))
            room = size
        tasks[-1].spans.append(span)
        room -= max(span.end - span.begin, 1)
    return tasks


class _Reader:
    """What batches and streams share: options, and the rows of a span."""

    def __init__(self, options: dict):
        self.root, self.glob = options["path"], options.get("glob", "*.jsonl")
        self.needles = tuple(x.encode() for x in json.loads(options.get("needles", "[]")))
        self.reports = options.get("reports", "false") == "true"
        self.options = dict(options)

    def open(self, path: str) -> BinaryIO:
        return open(path, "rb")

    def read(self, task: Task | None) -> Iterator[tuple]:
        for span in task.spans if task is not None else ():  # None: there are no files
            yield from self._rows(span)

    def _rows(self, span: Span) -> Iterator[tuple]:
        place, seen, error = span.begin, 0, None
        lines = None
        try:
            with self.open(span.path) as f:
                lines = Lines(f, span.begin, span.end, self.needles, span.fragment)
                for at, size, line in lines:
                    if size:
                        yield span.file_id, span.path, at, size, line.decode("utf-8", "replace"), True if self.needles else None, None, None, None
        except OSError as failure:
            if not self.reports and not isinstance(failure, FileNotFoundError):
                raise
            error = f"{type(failure).__name__}: {failure.strerror or failure}"
        if lines is not None:
            place, seen = max(lines.place, span.begin), lines.seen
        if self.reports:
            yield span.file_id, span.path, span.begin, (place if error else span.end) - span.begin, None, span.first, seen, span.end, error


class TailBatchReader(_Reader, DataSourceReader):
    """All whole lines of the files as they are now, or of the last ``tail_bytes`` of the ``newest`` ones."""

    def partitions(self) -> list[Task]:
        files = Listing(self.root, self.glob).files()
        tail = self.options.get("tail_bytes")
        if tail is None:
            return packed([s for f in files.values() for s in cut_spans(f.file_id, f.path, 0, f.size)])
        some = newest(files, int(self.options["newest"]))
        return packed([Span(f.file_id, f.path, max(0, f.size - int(tail)), f.size, f.size > int(tail)) for f in some])


class TailReader(_Reader, DataSourceStreamReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.ordered = options.get("ordered", "false") == "true"
        self.frozen = options.get("frozen", "false") == "true"
        self.retries = options.get("retries")
        self.listing = Listing(self.root, self.glob)
        # where the query stands, as its checkpoint says: a new reader is told by the option, later ones by the calls
        self._known: dict[str, dict] = json.loads(options.get("known", "{}"))
        self._files: dict[str, File] | None = None
        self._retried_at: float | None = None

    def initialOffset(self) -> dict:
        return {}

    def _failures(self) -> dict[int, list[dict]]:
        """Batch -> what could not be read in it."""
        if not self.retries or not os.path.isdir(self.retries):
            return {}
        out = {}
        for name in os.listdir(self.retries):
            number, _, kind = name.partition(".")
            if kind == "json" and number.isdigit():
                with open(os.path.join(self.retries, name)) as f:
                    out[int(number)] = json.load(f)
        return out

    def latestOffset(self) -> dict:
        """The place reached in every file once a trigger's bytes are read; files that are not there now stay as they were known."""
        if self._files is None or not self.frozen:
            self._files = self.listing.files()
        end, room = dict(self._known), self.max_bytes
        upto = end.get(AGAIN, {"size": -1})["size"]
        open_ = {n: rows for n, rows in self._failures().items() if n > upto}
        held = {row["file_id"] for rows in open_.values() for row in rows}
        if open_ and (self._retried_at is None or time.monotonic() - self._retried_at >= RETRY_AFTER):
            end[AGAIN] = {"size": max(open_)}
            self._retried_at = time.monotonic()
        for f in sorted(self._files.values(), key=lambda f: (-f.mtime_ns, f.path)):
            known = end.get(f.file_id, {"size": 0, "path": f.path, "epoch": 0})
            shrank = f.size < known["size"]
            begin = 0 if shrank else known["size"]
            take = min(f.size - begin, room, SPAN_BYTES if self.ordered else f.size)
            if f.file_id in held or (not take and (shrank or known["path"] == f.path)):
                continue
            room -= take
            end[f.file_id] = {"size": begin + take, "path": f.path, "epoch": known["epoch"] + shrank}
        self._known = end
        return end

    def partitions(self, start: dict, end: dict) -> list[Task]:
        spans = []
        for file_id, to in end.items():
            if file_id == AGAIN:
                continue
            since = start.get(file_id, {"size": 0, "path": "", "epoch": 0})
            if since != to:
                spans += cut_spans(file_id, to["path"], since["size"] if since["epoch"] == to["epoch"] else 0, to["size"])
        before, now = (x.get(AGAIN, {"size": -1})["size"] for x in (start, end))
        for number, rows in sorted(self._failures().items()) if now > before else []:
            if before < number <= now:
                for row in rows:
                    path = end.get(row["file_id"], row)["path"]
                    spans.append(Span(row["file_id"], path, row["begin"], row["end"]))
        self._known = {**start, **end, **self._known}
        return packed(spans)

    def commit(self, end: dict) -> None:
        self._known = {**end, **self._known}


class TailSource(DataSource):
    """``spark.read`` or ``spark.readStream`` of ``format("jsonl_tail")``; the path is a folder that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "jsonl_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TailBatchReader:
        return TailBatchReader(self.options)

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options)


def _options(glob: str, needles: tuple[str, ...], more: dict[str, object]) -> dict[str, str]:
    texts = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in more.items()}
    return {"glob": glob, "needles": json.dumps(list(needles)), **texts}


def tail_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", needles: tuple[str, ...] = (), source: type[DataSource] = TailSource, **options) -> DataFrame:
    """The lines of growing files as a stream."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(**_options(glob, needles, options)).load(root)


def batch_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", needles: tuple[str, ...] = (), **options) -> DataFrame:
    """All whole lines of the files below ``root`` at once, read by spans: nothing is shuffled to number them."""
    spark.dataSource.register(TailSource)
    return spark.read.format("jsonl_tail").options(**_options(glob, needles, options)).load(root)


def tail_sample(spark: SparkSession, root: str, glob: str = "*.jsonl", needles: tuple[str, ...] = (), files: int = SAMPLE_FILES, tail_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """Lines of the ends of the files that changed last: at most ``tail_bytes`` of ``files`` files, without a first line that is cut."""
    return batch_lines(spark, root, glob, needles, newest=files, tail_bytes=tail_bytes)
