"""Every stage of the pipeline against SQL or plain Python, on what the stage before it kept."""

import re
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm.common import cut
from meterlake.llm.language import fit, held_out, identify
from meterlake.llm.mixing import mix_sizes
from meterlake.llm.queries import OP6_SQL, OP8_SQL

from ..conftest import DATA

WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, what it got, what it gave) of each stage, written in between."""
    import corpus_pipeline as pipeline

    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), {}
    some = docs.filter("n_chars > 100 and doc_id % 3 = 0")  # near copies, of which the small table has none
    docs = docs.unionByName(some.withColumns({"doc_id": F.col("doc_id") + 10_000, "text": F.regexp_replace("text", r"\S+\s*$", "another end")}))
    for name, stage in pipeline.STAGES:
        after = cut(stage(spark, docs, DATA))
        out[name] = (docs, after)
        docs = after
    return out


def sql(docs, text):
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    return con.sql(text).fetchall()


def test_languages(stages):
    before, after = stages["language_id"]
    told = identify(before, fit(before.filter(~held_out()).select("text", "lang")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in told.filter("lang_pred != 'und'").collect()}
    letters = {r.doc_id: any(c.isalpha() for c in r.text or "") for r in before.collect()}
    assert {r.doc_id for r in after.collect()} == {k for k, v in letters.items() if v}


def test_lines(stages):
    before, after = stages["line_dedup"]
    import hashlib

    want = {r[0]: (r[2], r[3]) for r in sql(before.select("doc_id", "text"), f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP6_SQL})")}
    got = {r.doc_id: r.text for r in after.collect()}
    assert got.keys() == want.keys() and {k: hashlib.sha256((t or "").encode()).hexdigest() for k, t in got.items()} == {k: v[1] for k, v in want.items()}
    assert any(n for n, _ in want.values())


def test_near_copies(stages):
    before, after = stages["ngram_join"]
    component = {r[0]: r[2] for r in sql(before.select("doc_id", "text"), f"SELECT doc_id, n_shingles, component_id FROM ({OP8_SQL})")}
    assert sorted(r.doc_id for r in after.collect()) == sorted(k for k, c in component.items() if k == c)
    assert len(set(component.values())) < len(component)


def test_mixture(stages):
    before, after = stages["mix_sources"]
    taken = {r.doc_id: r.taken for r in mix_sizes(before).collect() if r.taken}
    words, own = Counter(), {r.doc_id: re.findall(WORD, r.text or "") for r in before.collect()}
    rows = after.collect()
    for r in rows:
        some = re.findall(WORD, r.text)
        words[r.doc_id] += len(some)
        at = iter(own[r.doc_id])
        assert all(w in at for w in some)  # in their order
    assert words == Counter(taken)


def test_packing(stages):
    before, after = stages["best_fit_packing"]
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((r.doc_id, len(a.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in before.collect())
    whole, rows = defaultdict(list), after.collect()
    for r in rows:
        whole[r.sequence_id].append((r.offset, r.length))
    for own in whole.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    lengths = Counter()
    for doc in {r.doc_id for r in rows}:
        mine = [r for r in rows if r.doc_id == doc]
        assert sum(r.length for r in mine) == sum(n * c for (d, n), c in want.items() if d == doc)
        lengths[doc] = sum(r.piece == 0 for r in mine)
    assert lengths == Counter(doc for (doc, _), c in want.items() for _ in range(c))
