"""Token alignment against a plain walk over the tokens of both tokenizers."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from meterlake.llm import alignment
from meterlake.llm.queries import op12_token_alignment, piece_model, tokenizer_ranks

from ..conftest import DATA


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=piece_model())


def byte_level():
    """The printable stand-ins of bytes in the vocabulary of a byte-level BPE."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def walked(text, libraries):
    """(A's ids, B's ids, links, groups) of a text, one token at a time."""
    lib_a, lib_b = libraries
    back = byte_level()
    if not text:
        return [], [], [], []
    a, b = lib_a.encode(f" {text}", add_special_tokens=False).ids, lib_b.encode(text)
    bytes_a = [bytes(back[c] for c in lib_a.id_to_token(i)) for i in a]
    pieces = [lib_b.id_to_piece(i) for i in b]
    bytes_b = [bytes([int(p[3:5], 16)]) if lib_b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, pieces, strict=True)]
    if not b"".join(bytes_a) == f" {text}".encode() == b"".join(bytes_b):
        return [], [], [], []
    links, groups, own = [], [], ([], [])
    i = j = end_a = end_b = 0
    end_a, end_b = len(bytes_a[0]), len(bytes_b[0])
    while True:
        links.append((a[i], b[j]))
        if end_a == end_b:
            groups.append(([*own[0], a[i]], [*own[1], b[j]]))
            own = ([], [])
            i, j = i + 1, j + 1
            if i == len(a):
                return a, b, links, groups
            end_a, end_b = end_a + len(bytes_a[i]), end_b + len(bytes_b[j])
        elif end_a < end_b:
            own[0].append(a[i])
            i += 1
            end_a += len(bytes_a[i])
        else:
            own[1].append(b[j])
            j += 1
            end_b += len(bytes_b[j])


def expected(texts, libraries):
    found = [walked(t, libraries) for t in texts]
    counts = Counter(x for _, _, links, _ in found for x in links)
    top_a, top_b = Counter(), Counter()
    for (a, b), n in counts.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    out = []
    for a, b, links, groups in found:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best_a, best_b = sum(counts[x] == top_a[x[0]] for x in links), sum(counts[x] == top_b[x[1]] for x in links)
        out.append((len(a), len(b), len(groups), len(links), best_a, best_b, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


ODD = [None, "", " ", "a  b", "  x\ty\n z ", "a▁b", "<|endoftext|> and <s></s><unk>", "日本語のテキスト 😀 é́", "\x00\x07", "a　b", "one two", "one two", "z" * 70_000, "x " * 60_000, " " * 70_000 + "y" + " " * 3, "é▁ " * 30_000]


def test_odd_texts(spark, libraries, monkeypatch):
    """Null, empty, repeated and long texts, special tokens as text, clashing columns; blocks and pieces are many."""
    rnd = random.Random(2)
    texts = ODD + ["".join(rnd.choice("ab \n\té▁1.日") for _ in range(rnd.randrange(400))) for _ in range(60)]
    rows = [(None if k % 17 == 5 else k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", *(F.lit("x").alias(c) for c in ("block", "links", "n", "a", "b", "count", "best_a")))
    want = sorted(((d, *x) for (d, _), x in zip(rows, expected(texts, libraries), strict=True)), key=repr)
    monkeypatch.setattr(alignment, "BLOCK_BYTES", 20_000)
    got = alignment.align(docs.repartition(3), tokenizer_ranks(), piece_model())
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best_a", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr) == want
    assert alignment.align(docs.limit(0), tokenizer_ranks(), piece_model()).count() == 0


def test_whole_table(spark, libraries):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {r.doc_id: x for r, x in zip(docs, expected([r.text for r in docs], libraries), strict=True)}
    got = {r.doc_id: r for r in op12_token_alignment(spark, DATA).collect()}
    assert {k: (r.n_a, r.n_b, r.n_groups, r.n_links, want[k][4], r.n_best, r.count_sum, r.groups_sha256) for k, r in got.items()} == want


def test_mapping_of_ids(spark):
    """The table of pairs of ids has counts that add up to the links, and a best partner for each id."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    paths = tokenizer_ranks(), piece_model()
    linked = alignment.token_links(docs, *paths).cache()
    counts = alignment.pair_counts(alignment.block_pairs(linked, *paths)).cache()
    assert counts.agg(F.sum("count")).first()[0] == linked.agg(F.sum("n_links")).first()[0]
    for side in ("a", "b"):
        assert counts.filter(f"best_{side}").select(side).distinct().count() == counts.select(side).distinct().count()


def test_pieces_of_long_texts_give_the_same_ids(libraries, monkeypatch):
    monkeypatch.setattr(alignment, "PIECE_CHARS", 7)
    t = alignment.Tokens(tokenizer_ranks(), piece_model())
    assert t.cuttable
    rnd = random.Random(3)
    for text in [x for x in ODD if x] + ["".join(rnd.choice("ab  \n▁the é") for _ in range(300)) for _ in range(200)]:
        assert t.ids_b(text).tolist() == libraries[1].encode(text)
    text = "lorem ipsum\n" * 1_700_000  # 20 MB
    (a, b), = t.ids([text[:2_000_000]])
    ends = alignment.merge_ends(np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b]))
    assert ends[2].sum() == ends[3].sum() and ends[2][-1] and ends[3][-1]
