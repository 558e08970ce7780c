"""A corpus pipeline of five stages: language ID, line dedup, n-gram Jaccard join, source mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of
``documents``. ``run`` applies them in turn and cuts the lineage between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import cut, read
from meterlake.llm.language import UND, fit, held_out, identify
from meterlake.llm.line_dedup import dedup_lines
from meterlake.llm.mixing import mix_texts, repeats
from meterlake.llm.ngram_join import MAX_BROADCAST_IDS, link_shingles
from meterlake.llm.packing import pack_documents
from meterlake.llm.queries import tokenizer_ranks


def _apart(docs: DataFrame, *made: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with columns named like an operator's results under other names, and the way back."""
    held = {c: f"__own_{c}" for c in docs.columns if c in made}
    return docs.withColumnsRenamed(held), {v: k for k, v in held.items()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; those without a letter go.

    Null texts and texts without a letter go, null ids and repeated rows are rows like others, texts may have any
    length, other columns pass through; an empty table stays empty.
    """
    own, back = _apart(docs, "lang_pred", "lang_score", "lang_spans")
    labelled = identify(own, fit(docs.filter(~held_out()).select("text", "lang")))
    return labelled.filter(F.col("lang_pred") != UND).select(*own.columns).withColumnsRenamed(back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has; every document stays.

    Null texts stay null, rows without an id keep all their lines, rows of one id are one document and each of them
    stays; of ties the smallest id keeps its lines.
    """
    own, back = _apart(docs, "n_lines", "n_dropped", "kept_text")
    kept = dedup_lines(own).withColumn("text", F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(*own.columns).withColumnsRenamed(back)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies.

    Rows that repeat id (null too) and text are one, the least by its other columns. Null ids are linked with nothing
    and stay, as do texts without a word; rows of one id and different texts stay or go together.
    """
    if repeats(docs):
        rest = [c for c in docs.columns if c not in ("doc_id", "text")]
        least = docs.groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("__any"), *rest)).alias("__rest"))
        docs = least.select(*(c if c in ("doc_id", "text") else F.col("__rest")[c].alias(c) for c in docs.columns))
    classes = link_shingles(docs.select("doc_id", "text"))
    others = cut(classes.filter("doc_id != component_id").select("doc_id").distinct())
    few = others.count() <= MAX_BROADCAST_IDS
    return docs.join(F.broadcast(others) if few else others.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row per document and pass with the words that the pass takes.

    Texts without words are not taken. A null source is a source, null ids are documents, rows that repeat id, source
    and text are one; ties in a source's stream go by id and digest, so reruns agree.
    """
    return mix_texts(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in sequences.

    Null and empty texts are their closing token; every row is packed, whatever its id; ties go by id and digest.
    """
    return pack_documents(docs, tokenizer_ranks())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_join", ngram_join),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express language ID, the mixture or the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
