"""N-gram Jaccard join by parity sketches.

A document's set holds its distinct word shingles. Its parity sketch cuts the hashed shingle space
into chunks and XORs the hashes of each: two sketches differ in at most as many chunks as the sets
differ in shingles, so for each band of sizes the number of chunks is set such that sets that reach
the threshold surely agree in some (pigeonhole), and by how many. The join is on chunk keys:

1. Keys are dealt to parts of bounded size. A part finds the keys that documents share. A key that
   many documents of one task have reaches its part as a mark, its documents go to any other part.
   Small groups give pairs with the number of keys shared; pairs that share too few cannot link.
2. Groups of more than SMALL documents give memberships instead of pairs. A document with fewer such
   memberships than it must share keeps none; the others are paired with their group's first.
3. Candidates pass a screen of bit sketches, whose Hamming distance is at most the symmetric
   difference of the sets, and are verified on the whole sets; components are taken.
4. Groups that share documents form families. Within families that still hold several components,
   documents of different ones are compared by bit sketches too, those of the largest component with
   all others but not with each other. What the sketches do not rule out
   is verified as well, so no link between components is lost.
Documents of equal sets are joined by the hash of their sets.

Defined cases
* null or empty text, or white space alone: no shingle; linked with nothing.
* fewer words than a shingle: the whole sequence is the one shingle.
* null ids: linked with nothing; the component is null.
* texts of any length: read in windows of their bytes; what is held of one is its set.
* repeated ids and rows: an id is one vertex, linked where any of its rows is; each row comes back.
* ties at the threshold are links. Empty table: an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, slices, spread_join
from .components import components
from .parity import DEN, NUM, band, bands_of, chunk_keys, differences, hamming, left_out, mix, parity_bits, shingle_sets

#: Largest group of documents under one key that is listed as pairs.
SMALL = 16
#: Keys that a part holds, about, and keys that a task gathers before it deals them out.
PART_KEYS = 2_000_000
FLUSH_KEYS = 2_000_000
#: Documents of a family that are compared at once with as many others.
BLOCK = 1024
#: Ids that are broadcast at most (8 bytes each) to filter the documents; more are joined by a shuffle.
MAX_BROADCAST_IDS = 500_000


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """(ids, sets) of slices of (id, text) batches, bounded by their bytes; null texts are empty."""
    for part in slices(batches, 1):
        ids, texts = part.column(0).to_numpy(zero_copy_only=False), pa.concat_arrays([part.column(1).cast(pa.large_string()).fill_null("")])
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        yield ids, shingle_sets(data, offsets - offsets[0])


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        n = np.array([len(s) for s in sets], dtype=np.int64)
        with np.errstate(over="ignore"):
            h1 = np.array([np.add.reduce(s) for s in sets], dtype=np.uint64)
            h2 = np.array([np.add.reduce(mix(s + np.uint64(1))) for s in sets], dtype=np.uint64)
        doc = pa.array(ids, pa.int64(), from_pandas=True)
        yield pa.RecordBatch.from_arrays([doc, pa.array(n), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["doc_id", "n", "h1", "h2"])


#: A document in a band, as it is sent to a part: id (less the one before it), band, size, full chunks, keys in the part.
ENTRY = (("doc", "<i8"), ("band", "u1"), ("size", "<u4"), ("full", "<u4"), ("keys", "<u4"))


def _packed(columns: list[np.ndarray]) -> bytes:
    """Entries by columns and bytes of equal weight, so that what is small or alike compresses to next to nothing."""
    out = []
    for (_, kind), x in zip(ENTRY, columns, strict=True):
        x = np.ascontiguousarray(x.astype(kind))
        out.append(x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes())
    return b"".join(out)


def _unpacked(blob: bytes) -> dict[str, np.ndarray]:
    widths = [np.dtype(kind).itemsize for _, kind in ENTRY]
    n, at, out = len(blob) // sum(widths), 0, {}
    for (name, kind), width in zip(ENTRY, widths, strict=True):
        raw = np.frombuffer(blob, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out[name] = np.ascontiguousarray(raw.T).view(kind).ravel().astype(np.int64)
        at += n * width
    out["doc"] = np.cumsum(out["doc"])
    return out


def _dealt(parts: int, small: int):
    """Texts to rows (part, origin, entries, keys, large): who has which keys of a part.

    A key is 32 bits within its part, ordered by its entry. What more than ``small`` documents of a task's
    batch share goes no further to the key's own part than as a mark (``large``): the entries are sent to
    any other part with their ``origin``, so that a key of very many documents is spread.
    """

    def flush(entries: list, keys: list, seed: int) -> Iterator[pa.RecordBatch]:
        owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(k) for k in keys])
        key, table = np.concatenate(keys), [np.array(c, dtype=np.int64) for c in zip(*entries, strict=True)]
        known, which, count = np.unique(key, return_inverse=True, return_counts=True)
        large = count[which] > small
        part = ((key >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        low = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        marks = known[count > small]
        mark_part, mark_low = ((marks >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64), (marks & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        for chosen, spread in ((~large, False), (large, True)):
            at = np.flatnonzero(chosen)
            at = at[np.argsort(part[at], kind="stable")]
            ends = np.flatnonzero(np.append(part[at][1:] != part[at][:-1], True)) + 1 if len(at) else []
            begin = 0
            for end in ends:
                rows, own = at[begin:end], int(part[at[begin]])
                used, n = np.unique(owner[rows], return_counts=True)
                doc, *rest = (c[used] for c in table)
                blob = _packed([np.diff(doc, prepend=0), *rest, n])
                to = (own * 7919 + seed) % parts if spread else own
                yield row(to, own if spread else -1, blob, low[rows].tobytes(), b"")
                begin = end
        for own in np.unique(mark_part):
            yield row(int(own), -1, b"", b"", mark_low[mark_part == own].tobytes())

    def row(*values) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=["part", "origin", "entries", "keys", "large"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries, keys, held, seen = [], [], 0, set()
        for ids, sets in _sets(batches):
            for doc, found in zip(ids, sets, strict=True):
                if doc is None or doc != doc or not len(found):
                    continue
                same = (len(found), int(np.add.reduce(found)), int(np.add.reduce(mix(found + np.uint64(1)))))
                if same in seen:  # an equal set of this flush stands for it
                    continue
                seen.add(same)
                for i, full, own in chunk_keys(found):
                    entries.append((int(doc), i, len(found), full))
                    keys.append(own)
                    held += len(own)
            if held >= FLUSH_KEYS:
                yield from flush(entries, keys, hash(same) & 0xFFFF)
                entries, keys, held, seen = [], [], 0, set()
        if keys:
            yield from flush(entries, keys, hash(same) & 0xFFFF)

    return run


#: Pairs: documents u and v, keys to share (a), keys shared (b). Memberships: document u, group v, a: full chunks, b: size.
COLUMNS = ["pair", "u", "v", "band", "a", "b"]


def _entries(pdf: pd.DataFrame) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """(entries, keys, the entry of each key) of rows of a part."""
    tables = [_unpacked(x) for x in pdf["entries"]]
    table = {name: np.concatenate([t[name] for t in tables]) if tables else np.zeros(0, dtype=np.int64) for name, _ in ENTRY}
    key = np.frombuffer(b"".join(pdf["keys"]), dtype=np.uint32)
    return table, key, np.repeat(np.arange(len(table["doc"])), table["keys"])


def _members(origin: np.ndarray | int, table: dict[str, np.ndarray], key: np.ndarray, owner: np.ndarray) -> pd.DataFrame:
    grp = (np.int64(1) * origin << 32) | key.astype(np.int64)
    return pd.DataFrame({"pair": False, "u": table["doc"][owner], "v": grp, "band": table["band"][owner], "a": table["full"][owner], "b": table["size"][owner]})


def _shared(pdf: pd.DataFrame, small: int) -> pd.DataFrame:
    """One part: pairs of groups of up to ``small`` documents, memberships of larger ones (see COLUMNS)."""
    out = []
    for origin, rows in pdf[pdf["origin"] >= 0].groupby("origin"):
        out.append(_members(int(origin), *_entries(rows)))
    own = pdf[pdf["origin"] < 0]
    marked = np.unique(np.frombuffer(b"".join(own["large"]), dtype=np.uint32))
    table, key, owner = _entries(own)
    if len(key):
        out += _grouped(int(pdf["part"].iloc[0]), table, key, owner, marked, small)
    return pd.concat(out)[COLUMNS] if out else pd.DataFrame({c: [] for c in COLUMNS})


def _grouped(part: int, table: dict[str, np.ndarray], key: np.ndarray, owner: np.ndarray, marked: np.ndarray, small: int) -> list[pd.DataFrame]:
    """Pairs and memberships of the keys of one part; ``marked`` keys are of large groups whatever is left of them here."""
    # of each key the documents, every one once
    order = np.lexsort((table["doc"][owner], key))
    key, owner = key[order], owner[order]
    doc = table["doc"][owner]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])
    key, owner = key[new], owner[new]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(first, len(key)))
    large = (size > small) | np.isin(key[first], marked)
    out = []
    cores = np.array([band(i)[1] for i in range(int(table["band"].max()) + 1)])
    us, vs = [], []
    for m in range(2, small + 1):
        at = first[(size == m) & ~large]
        for i in range(m if len(at) else 0):
            for j in range(i + 1, m):
                us.append(owner[at + i])
                vs.append(owner[at + j])
    if us:
        u, v = np.concatenate(us), np.concatenate(vs)
        sizes, full, bands = table["size"], table["full"], table["band"]
        low, high = np.minimum(sizes[u], sizes[v]), np.maximum(sizes[u], sizes[v])
        good = (bands[u] == bands[v]) & (low <= cores[bands[u]]) & (DEN * low >= NUM * high)
        u, v = u[good], v[good]
        lost = np.maximum(left_out(full[u], sizes[u]), left_out(full[v], sizes[v]))
        need = np.maximum(np.maximum(full[u], full[v]) - differences(sizes[u] + sizes[v]) - lost, 1)
        pairs = pd.DataFrame({"u": table["doc"][u], "v": table["doc"][v], "a": need, "band": bands[u]})
        pairs = pairs.groupby(["u", "v", "band"], as_index=False).agg(a=("a", "min"), b=("u", "size"))
        out.append(pairs.assign(pair=True))
    wide = np.repeat(large, size)
    if wide.any():
        out.append(_members(part, table, key[wide], owner[wide]))
    return out


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "shingles"])


def _of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose ids are in ``wanted`` (doc_id, distinct)."""
    some = F.broadcast(wanted) if wanted.count() <= MAX_BROADCAST_IDS else wanted.hint("merge")
    return docs.join(some, "doc_id", "left_semi")


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, sets in _sets(batches):
        rows = [(int(doc), i, len(s), parity_bits(s, i)) for doc, s in zip(ids, sets, strict=True) for i in bands_of(len(s))]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["u", "band", "size", "bits"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, size and bits of both) to the pairs that the bits do not rule out."""
    for batch in batches:
        u, v, su, bu, sv, bv = batch.columns
        most = differences(su.to_numpy().astype(np.int64) + sv.to_numpy())
        apart = [int(np.bitwise_count(np.frombuffer(a, np.uint64) ^ np.frombuffer(b, np.uint64)).sum()) for a, b in zip(bu.to_pylist(), bv.to_pylist(), strict=True)]
        keep = pa.array(np.array(apart, dtype=np.int64) <= most)
        yield pa.RecordBatch.from_arrays([u.filter(keep), v.filter(keep)], names=["u", "v"])


def screen(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v, band) that bit sketches of the band, a few bytes a document, do not rule out."""
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    bits = cut(_of(docs, wanted).mapInArrow(_sketches, "u long, band int, size int, bits binary"))
    both = pairs.join(bits.hint("merge"), ["u", "band"])
    other = bits.select(F.col("u").alias("v"), "band", F.col("size").alias("__size"), F.col("bits").alias("__bits"))
    both = both.join(other.hint("merge"), ["v", "band"]).select("u", "v", "size", "bits", "__size", "__bits")
    return both.mapInArrow(_near, "u long, v long").distinct()


def verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs`` (u, v) whose documents' whole sets reach the threshold."""
    wanted = cut(pairs.select(F.explode(F.array("u", "v")).alias("doc_id")).distinct())
    sets = cut(_of(docs, wanted).mapInArrow(_whole_sets, "doc_id long, shingles array<long>"))
    left = sets.select(F.col("doc_id").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("doc_id").alias("v"), F.col("shingles").alias("b"))
    both = pairs.select("u", "v").join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    shared = F.size(F.array_intersect("a", "b")).cast("long")
    return both.filter(shared * DEN >= (F.size("a") + F.size("b") - shared) * NUM).select("u", "v").distinct()


def link_shingles(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sizes = cut(texts.mapInArrow(_sizes, "doc_id long, n long, h1 long, h2 long"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffle_partitions(spark), -(-int(total) // PART_KEYS))
    # equal sets
    known = sizes.filter("n > 0 and doc_id is not null").select("doc_id", "n", "h1", "h2")
    equal = cut(known.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("v"), F.count("*").alias("__rows")).filter("__rows > 1"))
    copies = spread_join(known, equal, ["n", "h1", "h2"], "__rows", ["doc_id"]).select(F.col("doc_id").alias("u"), "v").filter("u != v")
    # documents that share keys
    small = SMALL
    dealt = texts.mapInArrow(_dealt(parts, small), "part int, origin int, entries binary, keys binary, large binary")
    found = cut(dealt.repartition(parts, "part").groupBy("part").applyInPandas(lambda pdf: _shared(pdf, small), "pair boolean, u long, v long, band int, a int, b int"))
    members = found.filter("not pair").select("u", "band", F.col("v").alias("grp"), F.col("a").alias("full"), F.col("b").alias("size"))
    # what a member must share with any partner: its full chunks less the most differences it can have,
    # of which the two leave out less than half
    size = F.col("size")
    sure = F.col("full") - _differences(size + F.floor(size * DEN / NUM))
    own = W.partitionBy("u", "band")  # as many rows as a document has chunks
    members = members.select("u", "band", "grp", F.greatest(F.floor((sure + 1) / 2), F.lit(1)).cast("int").alias("g"))
    members = members.withColumn("c", F.count("*").over(own)).withColumn("g", F.min("g").over(own))
    # of c large groups a link shares g, so each member may leave out g - 1 in an order common to all
    members = members.withColumn("r", F.row_number().over(own.orderBy("grp")))
    members = cut(members.select("u", "band", "grp", "c", (F.col("r") <= F.col("c") - F.col("g") + 1).alias("heavy")))
    heavy = members.groupBy("u", "band").agg(F.max("c").alias("c"))
    pairs = found.filter("pair").groupBy("u", "v", "band").agg(F.sum("b").alias("n"), F.min("a").alias("need"))
    more = [heavy.select(F.col("u").alias(x), "band", F.col("c").alias(f"c{x}")) for x in ("u", "v")]
    short = cut(pairs.filter("n < need").join(more[0], ["u", "band"]).join(more[1], ["v", "band"]).filter(F.col("n") + F.least("cu", "cv") >= F.col("need")).select("u", "v", "band"))
    # large groups: members that can link there, paired with the first of them
    kept = members.filter("heavy").select("u", "band", "grp")
    groups = cut(kept.groupBy("grp").agg(F.min("u").alias("v"), F.count("*").alias("__rows")).filter("__rows > 1"))
    stars = cut(spread_join(kept, groups, ["grp"], "__rows", ["u"]).select("u", "v", "band").distinct())
    pairs = pairs.filter("n >= need").select("u", "v", "band").unionByName(short).unionByName(stars.filter("u != v"))
    candidates = cut(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "band").distinct())
    links = cut(copies.unionByName(verify(texts, cut(screen(texts, candidates)))))
    reached = components(links)
    # components of one family that are not joined
    crossing = _crossing(texts, stars, sizes, reached, candidates)
    if not crossing.isEmpty():
        reached = components(links.unionByName(verify(texts, crossing)))
    out = sizes.join(reached.withColumnRenamed("u", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _differences(sizes: Column) -> Column:
    return F.floor(sizes * (DEN - NUM) / (DEN + NUM)).cast("int")


def _compared(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one family and band, of two blocks or one: pairs of different components that may link."""
    sides = [x.sort_values("component") for _, x in pdf.groupby("block")]
    a, b = sides[0], sides[-1]
    bits = [np.frombuffer(b"".join(x["bits"]), dtype=np.uint64).reshape(len(x), -1) for x in (a, b)]
    us, vs = [], []
    for k in range(0, len(a), 256):
        part = a.iloc[k : k + 256]
        sizes = part["size"].to_numpy(np.int64)[:, None] + b["size"].to_numpy(np.int64)[None, :]
        low = np.minimum(part["size"].to_numpy()[:, None], b["size"].to_numpy()[None, :])
        ok = (part["component"].to_numpy()[:, None] != b["component"].to_numpy()[None, :]) & (low * (DEN + NUM) >= sizes * NUM)
        if ok.any():
            ok &= part["core"].to_numpy()[:, None] | b["core"].to_numpy()[None, :]
            ok &= hamming(bits[0][k : k + 256], bits[1]) <= differences(sizes)
            i, j = np.nonzero(ok)
            us.append(part["u"].to_numpy()[i])
            vs.append(b["u"].to_numpy()[j])
    u, v = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (us, vs))
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)}).drop_duplicates()


def _crossing(docs: DataFrame, stars: DataFrame, sizes: DataFrame, reached: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs not among ``done`` of documents in different components that families leave open."""
    family = components(stars.filter("u != v").select("u", "v")).withColumnRenamed("component", "family")
    own = stars.select("u", "band").distinct().join(family, "u").join(reached, "u", "left")
    own = own.join(sizes.select(F.col("doc_id").alias("u"), F.col("n").cast("int").alias("size")), "u")
    highs = F.array(*[F.lit(band(i)[1]) for i in range(64)])
    own = own.withColumn("core", F.col("size") <= F.element_at(highs, F.col("band") + 1))
    own = cut(own.withColumn("component", F.coalesce("component", "u")))
    mixed = own.groupBy("family", "band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("__rows")).filter("a != b")
    # a family's largest component is compared with the others only
    each = own.groupBy("family", "band", "component").agg(F.count("*").alias("n")).join(mixed.select("family", "band", "__rows"), ["family", "band"])
    largest = each.groupBy("family", "band", "__rows").agg(F.max(F.struct("n", "component")).alias("most"))
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    mixed = cut(largest.select("family", "band", "__rows", F.col("most.component").alias("most"), blocks(F.col("most.n")).alias("wide"), blocks(F.col("__rows") - F.col("most.n")).alias("rest")))
    own = cut(spread_join(own, mixed, ["family", "band"], "__rows", ["u"]))
    bits = _of(docs, cut(own.select(F.col("u").alias("doc_id")).distinct())).mapInArrow(_sketches, "u long, band int, size int, bits binary").drop("size")
    same = F.col("component") == F.col("most")
    number = F.xxhash64("u")
    own = own.withColumn("block", F.when(same, F.col("rest") + F.pmod(number, F.col("wide"))).otherwise(F.pmod(number, F.col("rest"))).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.when(same, F.col("rest")).otherwise(F.col("rest") + F.col("wide")) - 1))
    own = own.withColumn("other", other).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    own = own.join(bits.hint("merge"), ["u", "band"])
    pairs = own.select("family", "band", "i", "j", "block", "u", "size", "core", "component", "bits").groupBy("family", "band", "i", "j").applyInPandas(_compared, "u long, v long")
    return cut(pairs.distinct().join(done.select("u", "v").distinct(), ["u", "v"], "left_anti"))
