"""The registered queries: those that SQL expresses against it, and the pipeline on a small corpus."""

import pytest
from pyspark.sql import functions as F

from meterlake.llm.common import cut
from meterlake.llm.queries import oracle_sql, queries

from ..conftest import DATA
from ..oracle import compare, connect


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, name):
    compare(queries()[name](spark, DATA), connect(DATA), oracle_sql()[name])


@pytest.mark.parametrize("name", ["op2_best_fit_packing", "op5_toxicity", "op9_language_id", "op10_license_scan"])
def test_query_returns_every_document(spark, name):
    got = queries()[name](spark, DATA)
    assert got.select("doc_id").distinct().count() == spark.read.parquet(f"{DATA}/documents.parquet").count()


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        after = stage(spark, kept, DATA).cache()
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        if name == "ngram_join":
            assert after.count() <= kept.count()
        kept = after
    last = pipeline.STAGES[-1][1](spark, kept, DATA)
    assert last.filter("piece = 0").count() == kept.count()


def test_pipeline_on_odd_rows(spark):
    """Nulls in every column, empty and very long texts, repeated rows and columns named like results."""
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = " ".join(f"word{i} and" for i in range(60))
    rows = [
        (900001, words, "en", "web", 5), (900001, words, "en", "web", 5), (900002, words, None, None, None), (None, words, "en", "web", 5), (None, words, "en", "web", 5),
        (900003, None, "en", "web", None), (900004, "", "en", "web", 0), (900005, " \n\t", "en", "web", 3), (900006, "x" + " " * 600_000 + "y", "en", "web", 0),
        (900007, "z" * 500_000, "en", "web", 0), (900008, "\n" * 300_000 + "the end", "en", None, 0), (None, None, None, None, None), (900009, "one", "en", "web", 3),
    ]
    extra = ("length", "offset", "size", "score", "lang_pred", "n_lines", "taken", "shard", "slot", "u", "v", "part")
    odd = docs.limit(40).unionByName(spark.createDataFrame(rows, docs.schema))
    odd = odd.select("*", *(F.lit("clash").alias(c) for c in extra)).cache()
    kept, counts = odd, {}
    for name, stage in pipeline.STAGES[:-1]:
        kept = cut(stage(spark, kept, DATA))
        assert kept.columns == odd.columns and kept.filter(" or ".join(f"{c} != 'clash' or {c} is null" for c in extra)).isEmpty(), name
        counts[name] = {(r.doc_id, r.n) for r in kept.filter("doc_id is null or doc_id > 900000").groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts["language_id"] == {(900001, 2), (900002, 1), (None, 2), (900006, 1), (900007, 1), (900008, 1), (900009, 1)}
    assert counts["line_dedup"] == counts["language_id"]
    # 900002 lost its line to 900001 before, so only repeated rows go
    assert counts["ngram_join"] == {(900001, 1), (900002, 1), (None, 1), (900006, 1), (900007, 1), (900008, 1), (900009, 1)}
    packed = pipeline.STAGES[-1][1](spark, kept, DATA)
    assert packed.filter("piece = 0").count() == kept.count() and packed.filter("length > 2048 or offset + length > 2048").isEmpty()
