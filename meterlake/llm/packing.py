"""Best-fit packing of tokenised documents by linear grouping.

A sequence holds ``capacity`` tokens, so whatever the corpus size there are at most ``capacity``
distinct piece lengths. The driver sees only that histogram. It
1. sorts large lengths and cuts them into groups of equal cardinality, rounding each up to its
   group's longest,
2. optimises configurations (multisets of the few rounded sizes) by repeated subset-sum fills,
3. substitutes the actual lengths back, which frees the rounding slack,
4. best-fits the small lengths into what is free.
Several group counts are tried on the histogram and the plan of fewest sequences is kept. The plan
is a list of runs (length, first rank, count, first sequence, per sequence, offset), whose number is
bounded by the capacity and the groups, never by the documents. Spark ranks the pieces of each
length (in parts of bounded size, so one length may hold any share of the rows) and joins them with
the runs.

Defined cases
* null or empty text: the single closing token.
* texts of any length, words and runs of blanks of any length: encoded in pieces, with the same ids.
* null id, repeated ids or rows: every row is packed as a document of its own.
* long documents are cut into pieces of ``capacity`` tokens, of which the first may be shorter.
* ties between equal lengths go by id, piece and digest, so reruns agree.
* empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UNICODE_WHITE, cut, pieces, slices

CAPACITY = 2048
#: Pieces up to this share of the capacity are small: they are placed last, by best fit.
SMALL = 1 / 8
#: Group counts and small shares that are tried; the last ones are as good as no rounding.
TRIALS = ((64, SMALL), (256, SMALL), (2048, SMALL), (2048, SMALL / 4))
#: Ranks within a length are taken in salted parts of about so many pieces at least; there are about
#: MAX_PARTS and one a length at most, as a part is one row on the driver.
PART_ROWS = 500
MAX_PARTS = 65_536

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: The special token of the vocabulary, which stands for itself in a text.
SPECIAL = "<|endoftext|>"
#: Longer texts are encoded in pieces of about so many code points.
PIECE_CHARS = 1 << 16
#: Longer runs of white space go around the pattern, whose engine overflows its stack on a run of a million.
RUN = 10_000
_RUN = re.compile(f"[{UNICODE_WHITE}]{{{RUN},}}")


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str):
    """The byte-level BPE of a ranks file."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: len(ranks)})


def encode(text: str, enc) -> array:
    """The ids of a text of any length; the special token in it is one id."""
    out = array("I")
    for k, part in enumerate(text.split(SPECIAL)):
        if k:
            out.append(enc.eot_token)
        out.extend(encode_plain(part, enc))
    return out


def encode_plain(text: str, enc) -> array:
    """The ids of a text of any length, in which the special token is text like any other.

    A text is cut where white space follows something else: words of the pattern never reach over such
    a place nor look beyond it. Of a run of white space within a text the pattern takes all but the
    last as one word.
    """
    out = array("I")
    for piece in pieces(text, PIECE_CHARS):
        at = 0
        for run in _RUN.finditer(piece) if len(piece) >= RUN else ():
            end = run.end() - (run.end() < len(piece))
            out.extend(enc.encode_ordinary(piece[at : run.start()]))
            out.extend(enc._encode_single_piece(piece[run.start() : end]))
            at = end
        out.extend(enc.encode_ordinary(piece[at:]))
    return out


def token_pieces(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    ``ranks_path`` is a file of byte-pair ranks on every executor. A document's ids end with id 0.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path)
        for batch in slices(batches, 1):
            out: list[list] = [[] for _ in names]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encode(text or "", enc)
                ids.append(0)
                data = np.frombuffer(ids, dtype=np.uint32).astype("<u4", copy=False)
                end = (len(ids) - 1) % capacity + 1
                start = piece = 0
                while start < len(ids):
                    part = data[start:end]
                    row = (doc, piece, start, end - start, zlib.crc32(part.tobytes()), part.astype(np.int32) if with_ids else None)
                    for column, value in zip(out, row, strict=False):
                        column.append(value)
                    start, end, piece = end, end + capacity, piece + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


def _grouped(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Cuts (length, count) runs, longest first, into groups of equal cardinality."""
    total = sum(n for _, n in large)
    size = -(-total // max(1, groups))
    out: list[list[tuple[int, int]]] = []
    room = 0
    for length, n in large:
        while n:
            if not room:
                out.append([])
                room = size
            take = min(n, room)
            out[-1].append((length, take))
            room -= take
            n -= take
    return out


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Indexes of groups whose rounded sizes fill ``room`` best: a bounded subset sum on bit sets."""
    reach = [1]
    mask = (1 << (room + 1)) - 1
    used = []
    for g, size in enumerate(sizes):
        if not left[g] or size > room:
            continue
        for _ in range(min(left[g], room // size)):
            new = (reach[-1] | reach[-1] << size) & mask
            if new == reach[-1]:
                break
            reach.append(new)
            used.append(g)
            if new >> room & 1:
                break
        if reach[-1] >> room & 1:
            break
    at = reach[-1].bit_length() - 1
    chosen = []
    for k in range(len(used), 0, -1):
        if not reach[k - 1] >> at & 1:
            chosen.append(used[k - 1])
            at -= sizes[used[k - 1]]
    return chosen


def _configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """(groups in a sequence, sequences): each takes the longest size left and fills what it leaves."""
    left, out = list(counts), []
    for g in range(len(sizes)):
        while left[g]:
            left[g] -= 1
            rest = _fill(capacity - sizes[g], sizes, left)
            left[g] += 1
            config = [g, *rest]
            need = defaultdict(int)
            for x in config:
                need[x] += 1
            times = min(left[x] // n for x, n in need.items())
            for x, n in need.items():
                left[x] -= n * times
            out.append((config, times))
    return out


def plan_runs(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 256, small: float = SMALL) -> tuple[list[tuple], int]:
    """Runs (length, rank, count, sequence, per sequence, offset) of all pieces, and the sequences used."""
    limit = int(capacity * small)
    large = sorted(((k, n) for k, n in histogram.items() if k > limit), reverse=True)
    runs: list[tuple] = []
    ranks: dict[int, int] = defaultdict(int)
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> (first sequence, sequences)

    def put(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs.append((length, ranks[length], n, first, each, offset))
        ranks[length] += n

    used = 0
    cells = _grouped(large, groups)
    for config, times in _configurations([g[0][0] for g in cells], [sum(n for _, n in g) for g in cells], capacity):
        while times:  # as many sequences as have the same actual lengths in every place
            need: dict[int, int] = defaultdict(int)
            for g in config:
                need[g] += 1
            n = min(times, *(max(1, cells[g][0][1] // k) for g, k in need.items()))
            offset = 0
            for g in config:
                length, have = cells[g][0]
                cells[g][0] = (length, have - n)
                if have == n:
                    cells[g].pop(0)
                put(length, n, used, 1, offset)
                offset += length
            free[capacity - offset].append((used, n))
            used += n
            times -= n
    for length in sorted((k for k in histogram if k <= limit), reverse=True):
        n = histogram[length]
        for room in sorted(r for r in free if r >= length):
            each = room // length
            while n and free[room]:
                first, have = free[room].pop()
                bins = min(have, n // each)
                if bins:
                    put(length, bins * each, first, each, capacity - room)
                    free[room - each * length].append((first, bins))
                    n -= bins * each
                    if have > bins:
                        free[room].append((first + bins, have - bins))
                elif n:  # fewer are left than one sequence takes
                    put(length, n, first, n, capacity - room)
                    free[room - n * length].append((first, 1))
                    if have > 1:
                        free[room].append((first + 1, have - 1))
                    n = 0
            if not n:
                break
        if n:
            each = capacity // length
            bins, rest = divmod(n, each)
            if bins:
                put(length, bins * each, used, each, 0)
                free[capacity - each * length].append((used, bins))
                used += bins
            if rest:
                put(length, rest, used, rest, 0)
                free[capacity - rest * length].append((used, 1))
                used += 1
    return runs, used


def best_plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    bound = -(-sum(k * n for k, n in histogram.items()) // capacity)
    best: tuple[list[tuple], int] | None = None
    for groups, small in TRIALS:
        found = plan_runs(histogram, capacity, groups, small)
        if best is None or found[1] < best[1]:
            best = found
        if best[1] <= bound:
            break
    return best[0]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS) -> DataFrame:
    """``pieces`` (doc_id, piece, start, length, ids_crc32, ...) with sequence_id and offset.

    The pieces of a length are ranked in as many parts as keep each at about ``part_rows`` (more in a corpus
    that has more than MAX_PARTS times as many pieces), so that the lengths that most pieces have (the capacity itself above all) are split as they grow.
    """
    spark: SparkSession = pieces.sparkSession
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most capacity rows
    part_rows = max(part_rows, -(-sum(r["n"] for r in lengths) // MAX_PARTS))
    parts_of = spark.createDataFrame([(r["length"], -(-r["n"] // part_rows)) for r in lengths], "length long, __parts long")
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("__parts")).cast("int")
    salted = pieces.join(F.broadcast(parts_of), "length").withColumn("__salt", salt).drop("__parts")
    parts = salted.groupBy("length", "__salt").count().collect()  # MAX_PARTS + capacity rows at most
    histogram: dict[int, int] = defaultdict(int)
    bases = []
    for r in sorted(parts, key=lambda r: (r["length"], r["__salt"])):
        bases.append((r["length"], r["__salt"], histogram[r["length"]]))
        histogram[r["length"]] += r["count"]
    runs = best_plan(dict(histogram), capacity)
    base = spark.createDataFrame(bases, "length long, __salt int, __base long")
    run = spark.createDataFrame(runs, "length long, __rank0 long, __n long, __seq0 long, __each long, __offset0 long")
    order = W.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = (
        salted.withColumn("__r", F.row_number().over(order).cast("long") - 1)
        .join(F.broadcast(base), ["length", "__salt"])
        .withColumn("__r", F.col("__r") + F.col("__base"))
    )
    at = (F.col("__r") >= F.col("__rank0")) & (F.col("__r") < F.col("__rank0") + F.col("__n"))
    placed = ranked.join(F.broadcast(run.withColumnRenamed("length", "__length")), (F.col("length") == F.col("__length")) & at)
    j = F.col("__r") - F.col("__rank0")
    return (
        placed.withColumn("sequence_id", F.col("__seq0") + F.floor(j / F.col("__each")).cast("long"))
        .withColumn("offset", F.col("__offset0") + (j % F.col("__each")) * F.col("length"))
        .drop("__salt", "__r", "__base", "__length", "__rank0", "__n", "__seq0", "__each", "__offset0")
    )


def pack_documents(docs: DataFrame, ranks_path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Tokenises and packs ``docs``: doc_id, piece, start, length, ids_crc32 [, ids], sequence_id, offset."""
    return pack_pieces(cut(token_pieces(docs, ranks_path, capacity, with_ids)), capacity)
