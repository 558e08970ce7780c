"""Cumulative counters of a growing file as keyed state: what a file last said outlives a micro-batch.

The state of a file is its session and model, the counters at which its total last moved, its last
step, the number of its requests and the place that was read last. A file whose lines begin again
before that place was replaced or is read anew: its state starts over, and the same lines give the
same rows. State is kept in Spark's state store, beside the offsets of the source.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

#: Counters of a total, in the order of its vector.
COUNTERS = ("input_tokens", "cached_input_tokens", "cache_write_input_tokens", "output_tokens", "reasoning_output_tokens")
NAMES = (*COUNTERS, "total")
SCHEMA = (
    "file_id string, ordinal bigint, oversize boolean, bad boolean, occurred_at timestamp, is_count boolean, compacted boolean, session_id string, model_id string, lost boolean, "
    "kind string, number bigint, " + ", ".join(f"delta_{c} bigint" for c in NAMES) + ", path string, bytes bigint, hit boolean, lines bigint, until bigint, error string"
)
#: Columns of a span's report, which pass through.
REPORT = ("path", "bytes", "hit", "lines", "until", "error")
Vector = list[int | None]


def step(state: dict[str, Any], now: Vector, last: Vector) -> tuple[str, Vector]:
    """(kind, step) of a count, both ending in the total; the rules are those of ``operators.ordered.reconcile``."""
    nothing: Vector = [None] * len(NAMES)
    if now[-1] is None:
        return "no_data", nothing
    before, base = state.get("before"), state.get("base") or nothing
    if before is None or now[-1] > before:
        kind, out = "turn", [None if n is None else max(n - (b or 0), 0) for n, b in zip(now, base, strict=True)]
    elif now[-1] < before:
        kind, out = "reset", now if last[-1] is None else last
    elif last == state["last"]:
        kind, out = "replay", nothing
    else:
        kind, out = "off_ledger", [x or 0 for x in last]
    if before != now[-1]:
        state["base"] = now
    state["before"], state["last"] = now[-1], last
    return kind, out


def usable(kind: str, delta: Vector) -> bool:
    """Whether a step is a request: parts must fit into their wholes, unless there is nothing but a total."""
    if kind not in ("turn", "reset", "off_ledger"):
        return False
    inp, cached, _, out, think, total = (x or 0 for x in delta)
    return (kind == "off_ledger" and inp + out == 0 and total > 0) or (cached <= inp and think <= out)


def _vector(row: Any, prefix: str, total: str) -> Vector:
    return [None if pd.isna(x) else int(x) for x in (*(getattr(row, f"{prefix}{c}") for c in COUNTERS), getattr(row, total))]


def advance(state: dict[str, Any], events: pd.DataFrame) -> Iterator[tuple]:
    """Rows (see SCHEMA) of one file's events in order; ``state`` is brought up to date."""
    for row in events.itertuples(index=False):
        report = [None if pd.isna(x) else x for x in (getattr(row, c) for c in REPORT)]
        if report[3] is not None:  # of a span, not a line
            yield row.file_id, int(row.ordinal), False, False, row.occurred_at, False, False, None, None, False, "no_data", state.get("number", 0), *[None] * len(NAMES), *report
            continue
        state["session"] = row.session_said if isinstance(row.session_said, str) else state.get("session")
        state["model"] = row.model_said if isinstance(row.model_said, str) else state.get("model")
        now, last = _vector(row, "", "cumulative"), _vector(row, "last_", "last_total")
        lost = bool(row.is_count) and state["session"] is None and now[-1] is not None
        kind, delta = step(state, now, last) if state["session"] is not None else ("no_data", [None] * len(NAMES))
        state["number"] = state.get("number", 0) + usable(kind, delta)
        state["ordinal"] = int(row.ordinal)
        yield row.file_id, int(row.ordinal), row.oversize, row.bad, row.occurred_at, row.is_count, row.compacted, state["session"], state["model"], lost, kind, state["number"], *delta, *report


def follow(events: DataFrame) -> DataFrame:
    """Steps of a stream of ``sources.producers.ledger_events``, by the state of each file.

    What a task holds of a file is its relevant lines of one micro-batch: with an ``ordered`` source, of one span.
    """
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: Any) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ordinal", kind="stable")
        state = json.loads(held.get[0]) if held.exists else {}
        lines = rows["ordinal"][rows["lines"].isna()]
        if "ordinal" in state and len(lines) and lines.iloc[0] <= state["ordinal"]:
            state = {}
        out = pd.DataFrame(list(advance(state, rows)), columns=names)
        held.update((json.dumps(state),))
        for c in names:
            if c in ("number", "bytes", "lines", "until") or c.startswith("delta_"):
                out[c] = out[c].astype("Int64")
        yield out

    return events.groupBy("file_id").applyInPandasWithState(run, SCHEMA, "state string", "append", "NoTimeout")
