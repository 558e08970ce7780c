"""Redaction of log lines: numbers stay, known structural strings stay, paths get aliases, text is masked."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK = 200
SHORT = 3
ALIAS = "/redacted/path-"


def mask(value: Column) -> Column:
    """Strings of up to SHORT characters stay; longer ones become as many x, MASK at most."""
    n = F.char_length(value)
    return F.when(n <= SHORT, value).otherwise(F.repeat(F.lit("x"), F.least(n, F.lit(MASK))))


def is_path(value: Column) -> Column:
    return value.startswith("/") | value.contains("/Users/")


def scrubbed(value: Column) -> Column:
    """Nothing leaks: short, an alias, or all x."""
    return (F.char_length(value) <= SHORT) | value.startswith(ALIAS) | value.rlike("^x+$")


def redact_json(lines: DataFrame, keep: set[str], paths: set[str]) -> DataFrame:
    """JSON lines (value) with strings redacted by their key; lines that do not parse become NULL.

    Keys in ``keep`` stay, keys in ``paths`` and strings that look like paths get an alias that depends
    on the path alone, other strings are masked, whatever the nesting.
    """
    import hashlib

    def text(s: str, key: str | None) -> str:
        if not s or key in keep:
            return s
        if key in paths or s.startswith("/") or "/Users/" in s:
            return ALIAS + hashlib.sha256(s.encode()).hexdigest()[:16]
        return s if len(s) <= SHORT else "x" * min(len(s), MASK)

    def walk(v, key=None):
        if isinstance(v, str):
            return text(v, key)
        if isinstance(v, list):
            return [walk(x, key) for x in v]
        return {k: walk(x, k) for k, x in v.items()} if isinstance(v, dict) else v

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            out = []
            for line in values:
                try:
                    out.append(json.dumps(walk(json.loads(line)), ensure_ascii=False))
                except (ValueError, TypeError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return lines.withColumn("value", run("value"))


def leaks(lines: DataFrame, keep: set[str]) -> DataFrame:
    """``lines`` (value) with the first string that redaction should not have left, or NULL; other values of kept keys may stay."""

    def first(v, key=None) -> str | None:
        if isinstance(v, str):
            clean = key in keep or len(v) <= SHORT or v.startswith(ALIAS) or not v.strip("x")
            return None if clean else v
        inner = ((x, key) for x in v) if isinstance(v, list) else ((x, k) for k, x in v.items()) if isinstance(v, dict) else ()
        return next((found for x, k in inner if (found := first(x, k)) is not None), None)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([None if line is None else first(json.loads(line)) for line in values], dtype=object)

    return lines.withColumn("leak", run("value"))


def write_fixture(lines: DataFrame, path: str, keep: set[str], paths: set[str]) -> None:
    """Redacted lines as text: all of them, or none if a line does not parse or something leaks."""
    redacted = redact_json(lines, keep, paths)
    bad = leaks(redacted, keep).filter(F.col("value").isNull() | F.col("leak").isNotNull()).select("value", "leak").limit(1).collect()
    if bad:
        raise ValueError("a line does not parse" if bad[0]["value"] is None else f"{bad[0]['leak'][:20]!r} is left in a redacted line")
    redacted.select("value").write.mode("error").text(path)
