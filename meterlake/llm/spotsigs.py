"""SpotSigs document fingerprints.

An anchor (a common word) and the next content words after it form a spot signature; the set of a
document's signatures is its fingerprint. ``spotsigs`` compares each document with its edited text and
with the next one in ascending id, by the exact Jaccard of the sets. ``near_pairs`` joins a collection:
different fingerprints are partitioned by length such that sets that reach the threshold lie in the same
or in neighbouring partitions, meet there by a signature among the rarest of either (of sets that reach
the threshold, the first few in a common order share one), and are compared unless their lengths rule
it out. Documents of equal fingerprints are one class.

Documents are dealt into ranges of (id, hash of the text), which split null and often repeated ids
too. Each range also gets the first document of the range that follows, and is read in order as a
stream. The text is shuffled once.

Defined cases
* null or empty text: the empty fingerprint; two empty fingerprints are alike (1.0).
* a text without content words: one signature of all its words. The start of a text is an anchor.
* a text without anchors (a table, code, names, another language): every word is an anchor. In other
  texts, a content word that comes more than STRETCH content words after the last anchor is one too.
* texts of any length are read in pieces; what is held of one is its set.
* null ids come first. Repeated ids and rows follow each other in the order of their texts' hashes.
* the last document's next is the first; a single document's next is itself.
* empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, pieces, shuffle_partitions, spread_join

# Common words of English, French, German and Spanish that serve as anchors.
ANCHORS = frozenset(
    """a an and are as at be by for from has have he her his in is it its not of on or she that the their this to was were will with you
    au aux avec ce ces dans de des du elle en est et il la le les leur mais ne ou par pas pour que qui sa se son sur un une
    als auf aus das dem den der die ein eine einer es für ich im ist mit nicht sich sie so und von vor war wie zu
    al como con del el ella era esta las lo los más no nos para pero por su sus todo una y""".split()
)
CHAIN = 2
#: Content words after an anchor, or after the start, that may stand without an anchor of their own.
STRETCH = 8
#: The threshold of a collection join.
NEAR = 0.75
#: Code points of a text that are split into words at once.
PIECE_CHARS = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def signatures(text: str | None, chain: int = CHAIN) -> frozenset[int]:
    """The spot signatures of a text as 32-bit numbers, read from its end."""
    found: set[int] = set()
    following: list[str] = [""] * chain
    spot = ""
    stretch: deque[str] = deque()  # signatures at the content words before the next anchor, the last word's first
    anchored, words = False, 0

    def number(signature: str) -> int:
        return zlib.crc32(signature.encode())

    for piece in reversed(list(pieces(text or "", PIECE_CHARS))):
        own = _WORD.findall(piece.lower())
        words += len(own)
        for word in reversed(own):
            if word in ANCHORS:
                if spot:
                    found.add(number(f"{word} {spot}"))
                stretch.clear()  # an anchor stands for the STRETCH content words after it
                anchored = True
            else:
                stretch.append(f"{word} {spot}")
                if len(stretch) > STRETCH:
                    found.add(number(stretch.popleft()))
                following = [word, *following[:-1]]
                spot = " ".join(following)
    if not anchored:
        found.update(map(number, stretch))
    if spot:
        found.add(number(f"^ {spot}"))
    elif words:
        found.add(number("$ " + " ".join(_WORD.findall((text or "").lower()))))
    return frozenset(found)


def fingerprint(found: frozenset[int]) -> str:
    return np.array(sorted(found), dtype=">u4").tobytes().hex()


def parse(print_: str) -> frozenset[int]:
    return frozenset(np.frombuffer(bytes.fromhex(print_), dtype=">u4").tolist())


def length_partition(size: int, at_least: float = NEAR) -> int:
    """Sets whose Jaccard can reach ``at_least`` lie in the same partition or in neighbouring ones; the empty set in none of theirs."""
    return int(math.log(size) / -math.log(at_least) * (1 - 1e-9)) if size else -2


def likeness(a: frozenset[int], b: frozenset[int]) -> float:
    """Jaccard of two sets; two empty ones are alike."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def classes(prints: DataFrame) -> DataFrame:
    """(class, fingerprint, size, n): different fingerprints of signatures (doc_id, fingerprint), known by their least id."""
    own = prints.filter("doc_id is not null and fingerprint != ''").groupBy("fingerprint")
    return own.agg(F.min("doc_id").alias("class"), F.count(F.lit(1)).alias("n")).select("class", "fingerprint", (F.length("fingerprint") / 8).cast("long").alias("size"), "n")


def near_pairs(prints: DataFrame, at_least: float = NEAR) -> DataFrame:
    """(u, v, likeness), u < v: all pairs of different fingerprints, by their classes, whose Jaccard is ``at_least`` or more.

    Null ids and empty fingerprints pair with nothing. Frequent signatures are spread, and hardly ever among the
    rarest of a set; what they join is checked by lengths before sets are looked at.
    """
    one = cut(classes(prints))
    signs = F.expr("transform(sequence(1, length(fingerprint), 8), i -> substring(fingerprint, i, 8))")
    each = one.select("class", "size", F.explode(signs).alias("sig"))
    often = cut(each.groupBy("sig").agg(F.count(F.lit(1)).alias("n")))
    rank = F.row_number().over(W.partitionBy("class").orderBy("n", "sig"))
    rarest = F.col("size") - F.ceil(F.col("size") * at_least - 1e-9) + 1
    part = F.floor(F.log(F.col("size").cast("double")) / -math.log(at_least) * (1 - 1e-9))
    first = cut(spread_join(each, often, ["sig"], "n", ["class"]).withColumn("r", rank).filter(F.col("r") <= rarest).select("class", "size", "sig", part.alias("part")))
    left = first.select(F.col("class").alias("a"), F.col("size").alias("m"), "part", "sig")
    right = first.select(F.col("class").alias("b"), F.col("size").alias("n"), F.col("part").alias("own"), "sig", F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    met = left.join(right, ["part", "sig"]).filter((F.col("own") < F.col("part")) | (F.col("a") < F.col("b")))
    met = met.filter(F.least("m", "n") >= F.greatest("m", "n") * at_least - 1e-9)
    pairs = met.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()
    sets = one.select("class", "size", signs.alias("signs"))
    both = pairs.join(sets.withColumnsRenamed({"class": "u", "size": "m", "signs": "x"}), "u").join(sets.withColumnsRenamed({"class": "v", "size": "n", "signs": "y"}), "v")
    shared = F.size(F.array_intersect("x", "y"))
    return both.select("u", "v", (shared / (F.col("m") + F.col("n") - shared)).alias("likeness")).filter(F.col("likeness") >= at_least)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points from the start of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


KEY = ("doc_id", "__hash")


def _dealt(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, guest, doc_id, hash, text): each document in its range, and range firsts as guests of the range before."""
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), "__hash"]
    ranged = keyed.select(*KEY).repartitionByRange(ranges, *order).groupBy(F.spark_partition_id().alias("__k"))
    # the least key of every range; structs compare nulls first
    cuts = sorted(ranged.agg(F.min(F.struct(*KEY)).alias("least")).select("least.*").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["__hash"]))
    keys = [(r["doc_id"] is not None, r["doc_id"] or 0, r["__hash"]) for r in cuts]
    known = np.array([k[1] for k in keys if k[0]], dtype=np.int64)
    nulls, n = len(keys) - len(known), len(keys)
    shared = set(known.tolist())

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, there: pd.Series, hashes: pd.Series) -> pd.Series:
        some, whole = there.to_numpy(bool), ids.to_numpy(np.int64)
        at = np.zeros(len(ids), dtype=np.int64)
        at[some] = np.searchsorted(known, whole[some], side="right") + nulls - 1
        out = [[2 * k] for k in at.tolist()]
        for i, (there, x) in enumerate(zip(some.tolist(), whole.tolist(), strict=True)):
            if not there or x in shared:  # the ids that ranges begin with, and null
                key = (there, x, int(hashes.iloc[i]))
                k = max(bisect_right(keys, key) - 1, 0)
                out[i] = [2 * k, 2 * ((k - 1) % n) + 1] if keys[k] == key else [2 * k]
        return pd.Series(out)

    placed = keyed.select(*KEY, "text", F.explode(places(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), "__hash")).alias("__place"))
    return placed.select(F.shiftright("__place", 1).alias("__range"), (F.col("__place") % 2).alias("__guest"), *KEY, "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, length_partition int"


def spotsigs(docs: DataFrame, chain: int = CHAIN) -> DataFrame:
    """One row per document: fingerprints of it and of its edited text, and their likeness (see SCHEMA)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = shuffle_partitions(docs.sparkSession)
    dealt = _dealt(docs, 4 * parts)
    ordered = dealt.repartition(parts, "__range").sortWithinPartitions("__range", "__guest", *KEY, "text").drop("__hash")
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(list(zip(names, [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2, pa.int32()], strict=True)))
        rows: list[tuple] = []
        size = 0
        before: tuple | None = None  # the row that waits for its next
        for batch in batches:
            for at in range(batch.num_rows):
                range_, guest, doc, text = (c[at].as_py() for c in batch.columns)
                waits = before is not None and before[0] == range_
                if guest and not waits:
                    before = None
                    continue
                text = text or ""
                found = signatures(text, chain)
                if waits:
                    _, old_doc, old_text, old = before
                    new_text = edited(old_text, text)
                    new = signatures(new_text, chain)
                    rows.append((
                        old_doc, len(old_text), hashlib.sha256(new_text.encode()).hexdigest(), fingerprint(old), fingerprint(new),
                        likeness(old, new), likeness(old, found), length_partition(len(old)),
                    ))
                    size += 8 * (len(old) + len(new))
                before = None if guest else (range_, doc, text, found)
                if size > 8_000_000 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return ordered.mapInArrow(run, SCHEMA)
