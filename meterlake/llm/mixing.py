"""Mixing sources to target weights by blocks and index permutations.

1. Every source's words form one stream, cut into blocks of fixed length. A document's place in the
   stream is a prefix sum taken in salted buckets, so a source may hold any share of the rows.
2. A source's target (words) becomes a number of slots. Output shards draw their source counts from
   a multinomial over the slots that are left, so that the totals meet the targets.
3. Slot j of a source takes pass j // blocks and, within it, the block that a keyed Feistel
   permutation of the source's block indexes gives. A block is used at most ``max_repeat`` times.
4. Blocks are joined by (source, index) with the documents that they cut. ``mix_blocks`` gives the
   mixture as its shards hold it, a row per slot; ``mix_sizes`` gives each document its share and
   first place; ``mix_texts`` gathers a document's words of each pass, for stages that need documents.
   Tokens are the words of the contract's pattern.

Only the table of sources (at most MAX_SOURCES rows) passes through the driver; shards are drawn in a task.

Defined cases
* null or empty text: size 0, nothing taken.
* null source: a source of its own, after all others; null ids are documents like others.
* repeated rows: each is a document of its own in ``mix_sizes``; in ``mix_blocks`` and
  ``mix_texts`` rows that repeat id, source and text are one.
* ties: the order in a stream goes by bucket, id, digest and size; reruns agree.
* empty table or no word at all: nothing is taken. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1.0, 2.0, 3.0)
MAX_REPEAT = 3
BLOCK_WORDS = 64
#: A source's stream is summed in at least so many buckets, and in one per BUCKET_ROWS rows of the corpus.
BUCKETS = 256
BUCKET_ROWS = 100_000
#: Sources at most: their table, some 100 bytes each, passes through the driver and is broadcast.
MAX_SOURCES = 1_000_000
MAX_SHARDS = 4096
SHARD_SLOTS = 65_536
SLOTS_A_ROW = 16_384
SEED = 20240101


def targets(sizes: list[int] | np.ndarray, weights: list[float] | np.ndarray, max_repeat: float = MAX_REPEAT) -> list[float]:
    """Shares ``sum(sizes)`` by weight; what would exceed ``max_repeat`` times a size is reshared."""
    sizes, weights = np.asarray(sizes, dtype=np.int64), np.asarray(weights, dtype=np.float64)
    total, out, open_ = float(sizes.sum()), np.zeros(len(sizes)), sizes > 0
    while open_.any():
        share = total * weights / weights[open_].sum()
        above = open_ & (share > max_repeat * sizes)
        if not above.any():
            out[open_] = share[open_]
            break
        out[above] = max_repeat * sizes[above]
        total -= float(out[above].sum())
        open_ &= ~above
    return out.tolist()


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Element-wise pseudorandom permutation of range(n): a Feistel network that walks its cycle."""
    n = np.maximum(n.astype(np.uint64), np.uint64(1))
    half = np.maximum(np.ceil(np.log2(np.maximum(n, 2)) / 2), 1).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    key = _mix64(key.astype(np.uint64) + np.uint64(SEED))
    out, todo = index.astype(np.uint64).copy(), np.arange(len(index))
    while len(todo):
        x, h, m, k = out[todo], half[todo], mask[todo], key[todo]
        left, right = x >> h, x & m
        for turn in range(4):
            left, right = right, left ^ (_mix64(right ^ (k + np.uint64(turn * 0x9E3779B9))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def draws(slots: np.ndarray, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> Iterator[np.ndarray]:
    """Source counts of one shard after another: multinomial draws over the slots left, which add up to ``slots``."""
    left = slots.astype(np.int64).copy()
    per = max(shard_slots, -(-int(left.sum()) // MAX_SHARDS))
    rng = np.random.default_rng(seed)
    while (rest := int(left.sum())) > 0:
        if rest <= per:
            yield left.copy()
            return
        counts = np.zeros_like(left)
        while (missing := per - int(counts.sum())) > 0:  # a draw beyond what is left is drawn again
            rest_now = left - counts
            counts += np.minimum(rng.multinomial(missing, rest_now / rest_now.sum()), rest_now)
        yield counts
        left -= counts


def _word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def place(docs: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """(documents in their source's stream, sources with targets and slots).

    The first: doc_id, source, __hash, size, __sid, __begin. The second: __sid, source, source_size, target, __blocks, __slots.
    """
    spark = docs.sparkSession
    buckets = max(BUCKETS, -(-docs.count() // BUCKET_ROWS))
    sized = cut(
        docs.select("doc_id", "source", F.xxhash64("text").alias("__hash"), _word_count(F.col("text")).alias("size")).withColumn(
            "__bucket", F.pmod(F.xxhash64("doc_id", "__hash"), F.lit(buckets)).cast("int")
        )
    )
    by_bucket = sized.groupBy("source", "__bucket").agg(F.sum("size").alias("__n"))
    rows = by_bucket.groupBy("source").agg(F.sum("__n").alias("n")).limit(MAX_SOURCES + 1).toArrow()
    if rows.num_rows > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = rows.take(pc.sort_indices(rows, sort_keys=[("source", "ascending")], null_placement="at_end"))  # by code points
    sizes = rows["n"].to_numpy().astype(np.int64)
    aims = np.array(targets(sizes, np.resize(WEIGHTS, len(sizes))))
    blocks = -(-sizes // block_words)
    wanted = np.minimum(MAX_REPEAT * blocks, np.rint(aims / np.maximum(sizes, 1) * blocks).astype(np.int64))
    columns = [pa.array(np.arange(len(sizes), dtype=np.int32)), rows["source"].combine_chunks().cast(pa.string()), pa.array(sizes), pa.array(aims), pa.array(blocks), pa.array(wanted)]
    names = ["__sid", "source", "source_size", "target", "__blocks", "__slots"]
    sources = spark.createDataFrame(pa.table(columns, names=names), "__sid int, source string, source_size long, target double, __blocks long, __slots long")
    base = W.partitionBy("source").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = by_bucket.select("source", "__bucket", F.coalesce(F.sum("__n").over(base), F.lit(0)).alias("__base"))
    within = W.partitionBy("source", "__bucket").orderBy("doc_id", "__hash", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("__at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    bases = bases.withColumnsRenamed({"source": "__s", "__bucket": "__b"})
    placed = placed.join(bases, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    keys = F.broadcast(sources.select("__sid", F.col("source").alias("__s2")))  # at most MAX_SOURCES rows
    placed = placed.join(keys, F.col("source").eqNullSafe(F.col("__s2"))).withColumn("__begin", F.col("__base") + F.col("__at"))
    return placed.select("doc_id", "source", "__hash", "size", "__sid", "__begin"), sources


def slots(sources: DataFrame) -> DataFrame:
    """The mixture: shard, slot, __sid, __pass, __block, one row per slot.

    The draws depend on those before them, so one task makes them, a shard at a time, and gives runs of a source's
    slots; it holds a few numbers per source. The runs are dealt out before they become slots.
    """
    spark = sources.sparkSession
    rows = sources.orderBy("__sid").select("__slots", "__blocks").toArrow()  # at most MAX_SOURCES rows of 16 bytes
    wanted, blocks = (rows[c].to_numpy().astype(np.int64) for c in ("__slots", "__blocks"))
    total, shard_slots = int(wanted.sum()), SHARD_SLOTS
    step = max(SLOTS_A_ROW, total // 65_536)
    held = spark.sparkContext.broadcast((wanted, blocks))
    schema = "shard int, __whole long, __sid int, __blocks long, __j0 long, __at long, __n long"
    names = [x.split()[0] for x in schema.split(", ")]

    def drawn(_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, blocks = held.value
        begun = np.zeros(len(wanted), dtype=np.int64)
        for shard, counts in enumerate(draws(wanted, shard_slots)):
            sid = np.flatnonzero(counts)
            n = counts[sid]
            parts = -(-n // step)
            k = (np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)) * step
            at = np.repeat(np.cumsum(n) - n, parts) + k
            sids = np.repeat(sid, parts)
            columns = [np.full(len(k), shard, np.int32), np.full(len(k), int(n.sum())), sids.astype(np.int32), blocks[sids], begun[sids] + k, at, np.minimum(step, counts[sids] - k)]
            begun += counts
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    runs = spark.range(0, 1, 1, 1).mapInArrow(drawn, schema)
    table = cut(runs).repartition(4 * spark.sparkContext.defaultParallelism)
    each = table.filter("__n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)).alias("__i"))
    each = each.select("shard", "__whole", "__sid", "__blocks", (F.col("__j0") + F.col("__i")).alias("__j"), (F.col("__at") + F.col("__i")).alias("__p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, whole, sid, blocks, j, p = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            pass_ = j // blocks
            block = permute(j % blocks, blocks, sid.astype(np.int64) * 1009 + pass_ * 7 + 1)
            slot = permute(p, whole, shard.astype(np.int64) + (1 << 40))
            arrays = [batch.column(0), pa.array(slot), batch.column(2), pa.array(pass_.astype(np.int32)), pa.array(block)]
            yield pa.RecordBatch.from_arrays(arrays, names=["shard", "slot", "__sid", "__pass", "__block"])

    return each.mapInArrow(run, "shard int, slot long, __sid int, __pass int, __block long")


def takes(placed: DataFrame, mixture: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """What each slot takes from each document: the document's key, shard, slot, __pass, __lo, __hi (words).

    The mixture grows with the corpus though its plan starts from a small table, so it is never broadcast.
    """
    end = F.col("__begin") + F.col("size")
    cuts = placed.filter("size > 0").select(
        "*",
        F.explode(
            F.sequence((F.col("__begin") / block_words).cast("long"), ((end - 1) / block_words).cast("long"))
        ).alias("__block"),
    )
    lo = F.greatest(F.col("__block") * block_words, F.col("__begin")) - F.col("__begin")
    hi = F.least((F.col("__block") + 1) * block_words, end) - F.col("__begin")
    return cuts.withColumns({"__lo": lo, "__hi": hi}).join(mixture.hint("merge"), ["__sid", "__block"])


def mix_sizes(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, size, source_size, target, taken, n_blocks, first_shard, first_slot for every row of ``docs``.

    The last three: blocks of the mixture that hold words of the document, and where the first of them stands.
    """
    placed, sources = place(docs, block_words)
    key = ["__sid", "__begin"]  # a row with words begins where no other of its source does
    taken = takes(placed, slots(sources), block_words).groupBy(*key).agg(
        F.sum(F.col("__hi") - F.col("__lo")).alias("taken"), F.count(F.lit(1)).alias("n_blocks"), F.min(F.struct("shard", "slot")).alias("__first")
    )
    some = placed.filter("size > 0").join(taken, key, "left")
    every = some.unionByName(placed.filter("size = 0"), allowMissingColumns=True).join(F.broadcast(sources.drop("source")), "__sid")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("taken", "n_blocks")]
    return every.select("doc_id", "size", "source_size", "target", *counts, F.col("__first.shard").alias("first_shard"), F.col("__first.slot").alias("first_slot"))


def mix_blocks(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture as its shards hold it: shard, slot, source, doc_ids, text; one row per slot, its words joined by spaces."""
    docs = docs.dropDuplicates(["doc_id", "source", "text"]) if repeats(docs) else docs
    placed, sources = place(docs, block_words)
    parts = takes(placed, slots(sources), block_words).select("doc_id", "source", "__hash", "__begin", "shard", "slot", "__lo", "__hi")
    met = _with_texts(docs.select("doc_id", "source", "text"), parts).withColumn("__part", F.array_join(_words("text", F.col("__lo"), F.col("__hi")), " "))
    each = F.struct("__begin", F.col("doc_id").alias("doc_id"), F.col("__part").alias("text"))
    rows = met.groupBy("shard", "slot", "source").agg(F.sort_array(F.collect_list(each)).alias("__parts"))  # a block holds block_words documents at most
    return rows.select("shard", "slot", "source", F.col("__parts.doc_id").alias("doc_ids"), F.array_join("__parts.text", " ").alias("text"))


def _words(text: str, lo: Column, hi: Column) -> Column:
    return F.slice(F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1)), lo.cast("int") + 1, (hi - lo).cast("int"))


def _with_texts(docs: DataFrame, parts: DataFrame) -> DataFrame:
    """The columns of ``docs`` beside those of ``parts`` of the same doc_id, source and text hash (nulls equal)."""
    parts = parts.withColumnsRenamed({"doc_id": "__id", "source": "__src", "__hash": "__hash2"})
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__src")) & (F.col("__hash") == F.col("__hash2"))
    return docs.withColumn("__hash", F.xxhash64("text")).join(parts, same)


def mix_texts(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixture as documents: a row per document and pass with the words that pass takes.

    A document that a pass takes whole keeps its text as it is; else the words taken are joined by
    spaces in their order. Documents of which nothing is taken go. Columns are those of ``docs``.
    """
    docs = docs.dropDuplicates(["doc_id", "source", "text"]) if repeats(docs) else docs
    placed, sources = place(docs, block_words)
    ranges = (
        takes(placed, slots(sources), block_words)
        .groupBy("doc_id", "source", "__hash", "size", "__pass")
        .agg(F.sort_array(F.collect_list(F.struct("__lo", "__hi"))).alias("__ranges"), F.sum(F.col("__hi") - F.col("__lo")).alias("__taken"))
    )
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    part = F.array_join(F.flatten(F.transform("__ranges", lambda r: F.slice("__words", r["__lo"].cast("int") + 1, (r["__hi"] - r["__lo"]).cast("int")))), " ")
    joined = _with_texts(docs, ranges.withColumnRenamed("size", "__size"))
    cut_short = F.col("__taken") < F.col("__size")
    joined = joined.withColumn("__words", F.when(cut_short, words)).withColumn("text", F.when(cut_short, part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return joined.select(*docs.columns)


def repeats(docs: DataFrame) -> bool:
    """Whether an id (or null) stands in several rows."""
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    return not keys.filter("n > 1").isEmpty()
