"""Line dedup: drop lines whose normalised form stands in several documents.

Lines are exploded and hashed to 128 bits; only (id, position, hash) is shuffled for the counts,
pre-aggregated per task to a least and a largest document, so a line that a third of all documents
hold costs one row per task. The text itself moves once, to meet the positions that it loses.

Defined cases
* null or empty text: one empty line, nothing dropped, kept text ''.
* null id: the row takes no part in the counts and keeps all its lines.
* repeated rows: rows of one id are one document; each row keeps or loses the same lines.
* ties: the smallest id that holds a key keeps all its lines of that key.
* other columns pass through; columns named like the results are replaced.
* empty table: an empty result of the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ascii_lower, cut, spread_join


def _split(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed_lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(__id, __row, __pos, __h1, __h2) of every line whose key is long enough."""
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__id"),
        F.xxhash64(F.col(text_col)).alias("__row"),
        F.posexplode(F.split(ascii_lower(F.col(text_col)), "\n", -1)).alias("__pos", "__line"),
    )
    key = F.btrim(F.col("__line"), F.lit(WHITE))
    return (
        rows.withColumn("__line", key)
        .filter(F.char_length("__line") >= min_chars)
        .select("__id", "__row", "__pos", F.xxhash64("__line").alias("__h1"), F.xxhash64(F.lit(1), "__line").alias("__h2"))
    )


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(__h1, __h2, __first, __n) of keys in at least ``min_docs`` distinct documents; __n lines hold it."""
    keys = ["__h1", "__h2"]
    if min_docs == 2:  # two documents at least: the least and the largest id differ
        spread = lines.groupBy(*keys).agg(F.min("__id").alias("__first"), F.max("__id").alias("__last"), F.count("*").alias("__n"))
        return spread.filter("__first < __last").drop("__last")
    counted = lines.groupBy(*keys, "__id").agg(F.count("*").alias("__n")).groupBy(*keys)
    counted = counted.agg(F.count("*").alias("__docs"), F.min("__id").alias("__first"), F.sum("__n").alias("__n"))
    return counted.filter(F.col("__docs") >= min_docs).drop("__docs")


def dedup_lines(
    docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with n_lines, n_dropped (long) and kept_text.

    A key is a line stripped of ASCII white space with A-Z lower-cased. Keys of at least ``min_chars``
    code points found in at least ``min_docs`` documents lose all their lines but in the smallest id.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text")
    lines = _keyed_lines(docs, min_chars, id_col, text_col)
    repeated = cut(repeated_keys(lines, min_docs))
    lost = spread_join(lines, repeated, ["__h1", "__h2"], "__n", ["__id", "__pos"]).filter("__id != __first")
    lost = lost.groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__lost"))
    keyed = docs.withColumn("__row", F.xxhash64(F.col(text_col)))
    joined = keyed.join(
        lost.withColumnRenamed("__row", "__row2").hint("shuffle_hash"),
        (F.col(id_col) == F.col("__id")) & (F.col("__row") == F.col("__row2")),
        "left",
    )
    n_lines = F.size(_split(F.col(text_col)))
    kept_at = F.array_except(F.sequence(F.lit(0), F.col("n_lines").cast("int") - 1), F.col("__lost"))
    kept = F.array_join(F.transform(kept_at, lambda i: F.element_at("__lines", i + 1)), "\n")
    return (
        joined.withColumn("n_lines", n_lines.cast("long"))
        .withColumn("n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
        .withColumn("__lines", F.when(F.col("__lost").isNotNull(), _split(F.col(text_col))))
        .withColumn("kept_text", F.when(F.col("__lost").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept))
        .drop("__id", "__row", "__row2", "__lost", "__lines")
    )
