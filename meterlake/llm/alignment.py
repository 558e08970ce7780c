"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Tokenizer A is a byte-level BPE (a file of ranks), B a sentencepiece model that puts a space before a
text; A is given the same space, so both cover the same bytes. The ends of A's and B's tokens, as
cumulative bytes, are merged in order: where both end a group ends, and between any two ends lies one
overlap of an A token with a B token, a link. Spark counts the links of each pair of ids over the
corpus, takes the highest count on either side, and joins both back.

Links are pre-aggregated by blocks of some megabytes of text before anything is shuffled: a block sends
a row per distinct pair, gets its counts back, and its documents' compressed links meet them
in one task. So what moves is about the size of the text whatever the pairs are, and a frequent pair has
a row per block, which are spread when they are too many.

Defined cases
* null or empty text, and a text that B does not give back byte by byte (U+2581 in it): no tokens, zeros.
* strings of special tokens in a text are plain text to both.
* texts of any length are encoded in pieces that give the same ids; of a text without a cutting place
  (white space, for B a single space before something else) a piece is the whole stretch.
* null ids, repeated ids and rows: every row is a document of its own. Ties of the highest count all have it.
* empty table: an empty result. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, spread_join
from .packing import encode_plain, encoder

#: Bytes of text in a block, or one longer text.
BLOCK_BYTES = 4 << 20
#: Longer texts are given to B in pieces of about so many code points.
PIECE_CHARS = 1 << 16

LINKED = "block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
SCORED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best_a long, n_best long, count_sum long, groups_sha256 string"


class Tokens:
    """Both tokenizers with the bytes of their ids and the texts of ids that a digest is made of."""

    def __init__(self, ranks_path: str, model_path: str):
        import sentencepiece

        self.a, self.b = encoder(ranks_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_a = [self.a.decode_single_token_bytes(i) for i in range(self.a.max_token_value)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        # no piece goes on after a space that follows something else, so such a space may begin a text of its own
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.shift = 16 if max(len(pieces), len(self.bytes_a)) <= 1 << 16 else 32
        most = max(len(pieces), len(self.bytes_a))
        self.texts = {end: np.array([b"%d%s" % (i, end) for i in range(most)], dtype=object) for end in (b",", b"|", b";")}

    @property
    def kind(self) -> str:
        """The type of a link's code, which is A's id shifted over B's."""
        return "<u4" if self.shift == 16 else "<u8"

    def ids_b(self, text: str) -> np.ndarray:
        """B's ids of a text of any length."""
        if len(text) <= PIECE_CHARS or not self.cuttable:
            return np.array(self.b.encode(text), dtype=np.int64)
        out, begin = [], 0
        while len(text) - begin > PIECE_CHARS and (at := _SPACE.search(text, begin + PIECE_CHARS)):
            out.append(np.array(self.b.encode(text[begin : at.start()]), dtype=np.int64))
            begin = at.end()  # the model puts the space back
        out.append(np.array(self.b.encode(text[begin:]), dtype=np.int64))
        return np.concatenate(out)

    def ids(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A's and B's ids of each text, none where the bytes of either differ from the text's."""
        none = np.zeros(0, dtype=np.int64)
        for text in texts:
            if not text:
                yield none, none
                continue
            raw = f" {text}".encode()
            a, b = np.frombuffer(encode_plain(f" {text}", self.a), dtype=np.uint32).astype(np.int64), self.ids_b(text)
            same = self.sizes_a[a].sum() == self.sizes_b[b].sum() == len(raw)
            same = same and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw == b"".join(map(self.bytes_b.__getitem__, b.tolist()))
            yield (a, b) if same else (none, none)


#: A space before something else and after something else, neither of them a space as the model sees it.
_SPACE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")


@functools.lru_cache(maxsize=2)
def tokens(ranks_path: str, model_path: str) -> Tokens:
    return Tokens(ranks_path, model_path)


def _codes(t: Tokens, links: bytes, n: int) -> np.ndarray:
    """The codes of a document's ``n`` links."""
    return np.frombuffer(pa.decompress(links, n * np.dtype(t.kind).itemsize, "zstd", asbytes=True), dtype=t.kind).astype(np.int64)


def merge_ends(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ascending ends of tokens that cover the same bytes, merged: links (A's place, B's place), and which A and B tokens end a group."""
    ends = np.concatenate([ends_a, ends_b])
    ends.sort(kind="stable")
    ends = ends[np.append(ends[1:] != ends[:-1], True)] if len(ends) else ends
    at_a, at_b = np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)
    both = (ends_a[at_a] == ends) & (ends_b[at_b] == ends) if len(ends) else np.zeros(0, bool)
    last_a, last_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    last_a[at_a[both]] = last_b[at_b[both]] = True
    return at_a, at_b, last_a, last_b


def _digests(t: Tokens, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> list[str]:
    """Digests of ``a1,a2|b1;a3|b2,b3`` of documents whose tokens stand one after another (``of``: where each ends)."""
    until_a, until_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    out = np.empty(len(a) + len(b), dtype=object)
    out[np.arange(len(a)) + np.append(0, until_b)[group_a]] = np.where(last_a, t.texts[b"|"][a], t.texts[b","][a])
    out[np.arange(len(b)) + until_a[group_b]] = np.where(last_b, t.texts[b";"][b], t.texts[b","][b])
    ends = of_a + of_b
    return [hashlib.sha256(b"".join(out[i:j].tolist())[:-1]).hexdigest() if i < j else "" for i, j in zip(np.append(0, ends[:-1]), ends, strict=True)]


def token_links(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """One row per document (LINKED): its groups' digest and its links as compressed codes of id pairs; rows of a block stand together.

    Both paths name files that every executor has.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, block, room = tokens(ranks_path, model_path), TaskContext.get().partitionId() << 32, BLOCK_BYTES
        for batch in slices(batches, 1):
            size = batch.column(1).nbytes
            if size > room and room < BLOCK_BYTES:
                block, room = block + 1, BLOCK_BYTES
            room -= size
            found = list(t.ids(batch.column(1).to_pylist()))
            a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
            of_a, of_b = (np.cumsum([len(x[k]) for x in found]) for k in (0, 1))
            at_a, at_b, last_a, last_b = merge_ends(np.cumsum(t.sizes_a[a]), np.cumsum(t.sizes_b[b]))
            codes = ((a[at_a] << t.shift) | b[at_b]).astype(t.kind)
            # documents end where A's tokens do
            links, groups = np.searchsorted(at_a, of_a), np.append(0, np.cumsum(last_a))[of_a]
            columns = [
                np.full(len(found), block), batch.column(0), np.diff(of_a, prepend=0), np.diff(of_b, prepend=0), np.diff(groups, prepend=0), np.diff(links, prepend=0),
                _digests(t, a, b, last_a, last_b, of_a, of_b), [pa.compress(codes[i:j].tobytes(), "zstd", asbytes=True) for i, j in zip(np.append(0, links[:-1]), links, strict=True)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], names=[x.split()[0] for x in LINKED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, LINKED)


_KINDS = [pa.int64()] * 6 + [pa.string(), pa.binary()]


def block_pairs(linked: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(block, a, b, n): how many links of a block hold a pair of ids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokens(ranks_path, model_path)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks):  # a block may be cut by batches; its parts add up
                own = batch.filter(pa.array(blocks == block))
                codes = np.concatenate([_codes(t, links, n) for links, n in zip(own.column(1).to_pylist(), own.column(2).to_pylist(), strict=True)])
                codes, n = np.unique(codes, return_counts=True)
                columns = [np.full(len(codes), block), codes >> t.shift, codes & ((1 << t.shift) - 1), n]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["block", "a", "b", "n"])

    parts = linked.select("block", "links", "n_links").mapInArrow(run, "block long, a int, b int, n long")
    return parts.groupBy("block", "a", "b").agg(F.sum("n").alias("n"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(a, b, count, blocks, best_a, best_b): links of each pair of ids, and whether no other pair of its A or B id has more.

    The highest counts of a side are a row per id of its vocabulary, so they are broadcast.
    """
    counts = cut(pairs.groupBy("a", "b").agg(F.sum("n").alias("count"), F.count(F.lit(1)).alias("blocks")))
    for side in ("a", "b"):
        top = counts.groupBy(side).agg(F.max("count").alias("__top"))
        counts = counts.join(F.broadcast(top), side).withColumn(f"best_{side}", F.col("count") == F.col("__top")).drop("__top")
    return counts


def score(linked: DataFrame, pairs: DataFrame, counts: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Documents (SCORED) with the counts of their links; a block's pairs meet its documents in one task."""
    def run(docs: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        t = tokens(ranks_path, model_path)
        codes = (known["a"].to_numpy().astype(np.int64) << t.shift) | known["b"].to_numpy()
        order = np.argsort(codes)
        codes, values = codes[order], [known[c].to_numpy()[order].astype(np.int64) for c in ("best_a", "best_b", "count")]
        sums = []
        for links, n in zip(docs["links"], docs["n_links"], strict=True):
            at = np.searchsorted(codes, _codes(t, links, int(n)))
            sums.append([int(v[at].sum()) for v in values])
        docs[["n_best_a", "n_best", "count_sum"]] = np.array(sums, dtype=np.int64).reshape(-1, 3)
        return docs[[x.split()[0] for x in SCORED.split(", ")]]

    known = spread_join(pairs.drop("n"), cut(counts), ["a", "b"], "blocks", ["block"]).drop("blocks")
    return linked.groupBy("block").cogroup(known.groupBy("block")).applyInPandas(run, SCORED)


def align(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """Documents (SCORED) with their tokens, groups and links counted, and what the corpus says of their links."""
    linked = cut(token_links(docs, ranks_path, model_path))
    pairs = cut(block_pairs(linked, ranks_path, model_path))
    return score(linked, pairs, pair_counts(pairs), ranks_path, model_path)
