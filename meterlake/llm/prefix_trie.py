"""The trie of conversations' beginnings, for what a shared prefix saves.

A node is a distinct sequence of first turns; the smallest conversation that begins with it owns it.
Who owns a prefix also owns all longer ones of its own, so a conversation owns a chain of depths, from
the first that it owns to its end, and the chains hang on one another: that is the whole tree.
1. Turns are numbered and digested; a prefix's digest is the XOR of its turns' place-keyed hashes (128
   bits), so long conversations are cut into chunks whose digests are put together.
2. One aggregate gives every prefix digest its smallest conversation (the minima) and its members.
3. The first owned depth of all conversations is searched by bisection: each round is one join of
   (conversation, depth) with the minima's, keys that are unique on either side.
4. One lookup of the prefix before that depth gives the chain that a chain hangs on.
5. Totals of chains go up to all chains above by pointer doubling, and along a chain by sums from its end.

Rounds grow with the logarithm of the longest conversation and of the tree's height. No step gathers a
conversation, a group of copies or the children of a node in one task; the hash over a node's members
is sequential by nature and takes bounded chunks of ids in order.

Defined cases
* rows without conv_id belong to no conversation and are left out.
* null role or text: empty. Null turns come first; ties of turn go by digest; repeated rows are turns of their own.
* a conversation without turns is a member of the root and ends there. Empty table: no nodes.
* other columns are ignored, whatever their names, unless asked for with ``keep``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, spread_join

#: Depths of a conversation that one window takes.
CHUNK = 4096
#: Members are gathered by ranges of so many ids, in which there are no more members than ids.
IDS = 4096


def number_turns(conversations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(conv_id, depth, digest, n_bytes) and the columns ``keep`` of each turn; depth is its number in the conversation, from 1.

    Turns are sorted over all conversations, so one of any length is numbered in parts. A part begins
    within one conversation at most, so there are no more bases to add than parts.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    hashed = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("__turn"), F.rand(11).alias("__tie"),
        F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"), *keep,
    )
    order = [F.col("__turn").asc_nulls_first(), F.col("digest"), F.col("__tie")]
    ranged = hashed.repartitionByRange(shuffle_partitions(hashed.sparkSession), "conv_id", *order)
    ranged = cut(ranged.withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("conv_id", "__part").agg(F.count(F.lit(1)).alias("__n"))
    earlier = W.partitionBy("conv_id").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.withColumn("__base", F.sum("__n").over(earlier)).filter("__base > 0").drop("__n")
    own = F.row_number().over(W.partitionBy("conv_id", "__part").orderBy(*order))
    numbered = ranged.withColumn("__own", own).join(F.broadcast(bases), ["conv_id", "__part"], "left")
    depth = (F.col("__own") + F.coalesce("__base", F.lit(0))).cast("long")
    return numbered.select("conv_id", depth.alias("depth"), "digest", "n_bytes", *keep)


def lengths(turns: DataFrame) -> DataFrame:
    """(conv_id, n) of numbered turns."""
    return turns.groupBy("conv_id").agg(F.max("depth").alias("n"))


def grafted(turns: DataFrame, family: int = 5, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt to share beginnings: (numbered turns, lengths), the latter with those left without turns.

    Conversation c takes the first h turns of c - c % ``family`` and its own after its first h, where
    h = crc32(decimal c) % (``most`` + 1). All columns of ``turns`` pass through.
    """
    turns = cut(turns)
    sizes = cut(lengths(turns))
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("long")
    convs = sizes.withColumns({"__h": head, "__base": F.col("conv_id") - F.col("conv_id") % family})
    of_base = sizes.select(F.col("conv_id").alias("__base"), F.col("n").alias("__n_base"))
    taken = F.least("__h", F.coalesce("__n_base", F.lit(0)))
    convs = cut(convs.join(of_base, "__base", "left").select("conv_id", "__base", "__h", taken.alias("__m"), "n"))
    rest = [c for c in turns.columns if c not in ("conv_id", "depth")]
    own = spread_join(turns, convs, ["conv_id"], "n", ["depth"]).filter("depth > __h")
    own = own.select("conv_id", (F.col("depth") - F.col("__h") + F.col("__m")).alias("depth"), *rest)
    heads = turns.filter(F.col("depth") <= most).withColumnRenamed("conv_id", "__base")
    shared = heads.join(convs.select("conv_id", "__base", "__m"), "__base").filter("depth <= __m").select("conv_id", "depth", *rest)
    n = F.col("__m") + F.greatest(F.col("n") - F.col("__h"), F.lit(0))
    return own.unionByName(shared), convs.select("conv_id", n.alias("n"))


def _running(rows: DataFrame, group: str, at: str, forward: bool, columns: list[str], total) -> DataFrame:
    """``rows`` with each column's running total (``total`` is the aggregate) along ``at`` within a group, itself included.

    A group is cut into chunks of ``at``; a chunk's own running totals meet the totals of the chunks before it.
    """
    def order(c: str) -> Column:
        return F.col(c).asc() if forward else F.col(c).desc()

    rows = rows.withColumn("__chunk", F.floor(F.col(at) / CHUNK))
    within = W.partitionBy(group, "__chunk").orderBy(order(at)).rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy(group).orderBy(order("__chunk")).rowsBetween(W.unboundedPreceding, -1)
    chunks = rows.groupBy(group, "__chunk").agg(*(total(c).alias(c) for c in columns))
    bases = chunks.select(group, "__chunk", *(total(c).over(before).alias(f"__of_{c}") for c in columns)).filter(F.col(f"__of_{columns[0]}").isNotNull())
    out = rows.withColumns({c: total(c).over(within) for c in columns}).join(bases, [group, "__chunk"], "left")
    both = {c: F.col(c).bitwiseXOR(F.coalesce(f"__of_{c}", F.lit(0))) if total is F.bit_xor else F.col(c) + F.coalesce(f"__of_{c}", F.lit(0)) for c in columns}
    return out.withColumns(both).drop("__chunk", *(f"__of_{c}" for c in columns))


def prefix_digests(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p, q, n_bytes): the digest p, q of the first ``depth`` turns, and the bytes of the last."""
    keyed = turns.select("conv_id", "depth", "n_bytes", F.xxhash64(F.lit(1), "depth", "digest").alias("p"), F.xxhash64(F.lit(2), "depth", "digest").alias("q"))
    return _running(keyed, "conv_id", "depth", True, ["p", "q"], F.bit_xor)


def first_owned(convs: DataFrame, minima: DataFrame) -> DataFrame:
    """``convs`` (conv_id, n) with ``first``, the least depth above 0 that a conversation owns, n + 1 if it owns none.

    Bisection for all conversations at once: a probe asks whether a conversation is the minimum of its prefix of a depth.
    """
    owned = minima.select(F.col("owner").alias("conv_id"), F.col("depth").alias("__mid"), F.lit(True).alias("__hit"))
    state = convs.select("conv_id", "n", F.lit(1).cast("long").alias("first"), (F.col("n") + 1).alias("__above"))
    longest = convs.agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        wide = F.col("first") < F.col("__above")
        probes = state.withColumn("__mid", F.when(wide, F.floor((F.col("first") + F.col("__above")) / 2)))
        found = probes.join(owned, ["conv_id", "__mid"], "left")
        above = F.when(wide & F.col("__hit"), F.col("__mid")).otherwise(F.col("__above"))
        first = F.when(wide & F.col("__hit").isNull(), F.col("__mid") + 1).otherwise(F.col("first"))
        state = cut(found.select("conv_id", "n", first.alias("first"), above.alias("__above")))
    return state.drop("__above")


def _hung(chains: DataFrame, prefixes: DataFrame, minima: DataFrame, root: int) -> DataFrame:
    """``chains`` with ``at``, the depth before their first, and ``parent``, the owner there (NULL for the root's chain)."""
    chains = chains.withColumn("at", F.col("first") - 1)
    deep = chains.filter("at > 0").join(prefixes.select("conv_id", F.col("depth").alias("at"), "p", "q"), ["conv_id", "at"])
    shared = minima.filter("n_convs > 1").select(F.col("depth").alias("at"), "p", "q", F.col("owner").alias("parent"), "n_convs")
    deep = spread_join(deep, cut(shared), ["at", "p", "q"], "n_convs", ["conv_id"])
    top = chains.filter("at = 0").withColumn("parent", F.when(F.col("conv_id") != root, F.lit(root)))
    return deep.select(*top.columns).unionByName(top)


def _subtrees(chains: DataFrame, root: int, columns: list[str]) -> DataFrame:
    """(conv_id, parent, at, columns) of chains, the columns summed over all chains of their subtree.

    Pointer doubling: in round k a chain holds the sum over the chains less than 2^k above or at it, and
    points 2^k up. Nothing has to be asked of the root, whose pointer ends.
    """
    state = cut(chains.withColumn("__up", F.col("parent")))
    while not state.filter("__up is not null").isEmpty():
        gains = state.filter("__up is not null").groupBy("__up").agg(F.count(F.lit(1)).alias("__n"), *(F.sum(c).alias(f"__of_{c}") for c in columns))
        gains = cut(gains)
        nexts = state.select(F.col("conv_id").alias("__up"), F.col("__up").alias("__next"))
        nexts = cut(gains.filter(F.col("__up") != root).select("__up", "__n").join(nexts, "__up"))
        inner = spread_join(state.filter(F.col("__up") != root), nexts, ["__up"], "__n", ["conv_id"]).drop("__n")
        ended = state.filter((F.col("__up") == root) | F.col("__up").isNull()).withColumn("__next", F.lit(None).cast("long"))
        moved = inner.select(*ended.columns).unionByName(ended)
        moved = moved.join(gains.drop("__n").withColumnRenamed("__up", "conv_id"), "conv_id", "left")
        sums = {c: F.col(c) + F.coalesce(f"__of_{c}", F.lit(0)) for c in columns}
        state = cut(moved.withColumns(sums).withColumn("__up", F.col("__next")).drop("__next", *(f"__of_{c}" for c in columns)))
    return state.drop("__up")


def _ends(chains: DataFrame, root: int) -> DataFrame:
    """(conv_id, depth, n_ends, ends_sha256) of nodes at which conversations end."""
    owns = (F.col("first") <= F.col("n")) | (F.col("conv_id") == root)
    ends = chains.select(F.when(owns, F.col("conv_id")).otherwise(F.col("parent")).alias("node"), F.col("n").alias("depth"), "conv_id")
    chunks = ends.groupBy("node", "depth", F.floor(F.col("conv_id") / IDS).alias("chunk")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    chunks = chunks.select("node", "depth", "chunk", F.size("ids").cast("long").alias("n"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, total, digest = None, 0, hashlib.sha256()
        for batch in batches:
            done = []
            for node, depth, n, ids in zip(batch["node"], batch["depth"], batch["n"], batch["ids"], strict=True):
                if key != (node, depth):
                    if key:
                        done.append((*key, total, digest.hexdigest()))
                    key, total, digest = (node, depth), 0, hashlib.sha256()
                digest.update((b"," if total else b"") + ids.encode())
                total += n
            yield pd.DataFrame(done, columns=["conv_id", "depth", "n_ends", "ends_sha256"])
        if key:
            yield pd.DataFrame([(*key, total, digest.hexdigest())], columns=["conv_id", "depth", "n_ends", "ends_sha256"])

    dealt = chunks.repartition(shuffle_partitions(chunks.sparkSession), "node", "depth").sortWithinPartitions("node", "depth", "chunk")
    return dealt.mapInPandas(run, "conv_id long, depth long, n_ends long, ends_sha256 string")


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "n_ends", "n_bytes")


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """One row per node (NODE) of numbered ``turns`` (see ``number_turns``); ``convs`` (conv_id, n) may name conversations without turns.

    ``n_bytes`` is the size of a node's last text and ``n_ends`` the number of conversations that end at it.
    """
    convs = cut(lengths(turns) if convs is None else convs.select("conv_id", "n"))
    prefixes = cut(prefix_digests(turns))
    least = [F.min("conv_id").alias("owner"), F.count(F.lit(1)).alias("n_convs"), F.max("n_bytes").alias("n_bytes")]
    minima = cut(prefixes.groupBy("depth", "p", "q").agg(*least))
    root, members = convs.agg(F.min("conv_id"), F.count(F.lit(1))).first()
    top = minima.sparkSession.createDataFrame([] if root is None else [(root, 0, members, 0)], "conv_id long, depth long, n_convs long, n_bytes long")
    nodes = minima.select(F.col("owner").alias("conv_id"), "depth", "n_convs", "n_bytes").unionByName(top)

    chains = cut(_hung(first_owned(convs, minima), prefixes, minima, -1 if root is None else root))
    own = chains.filter((F.col("first") <= F.col("n")) | F.col("parent").isNull())
    hung = own.filter("parent is not null")
    # what is known at single nodes: where a chain begins, where it ends, how many hang there
    none = F.lit(None)
    marks = [
        hung.select("conv_id", F.col("first").alias("depth"), "parent", none.cast("boolean").alias("last"), F.lit(0).alias("n_hung")),
        own.select("conv_id", F.col("n").alias("depth"), none.cast("long").alias("parent"), F.lit(True).alias("last"), F.lit(0).alias("n_hung")),
        hung.select(F.col("parent").alias("conv_id"), F.col("at").alias("depth"), none.cast("long").alias("parent"), none.cast("boolean").alias("last"), F.lit(1).alias("n_hung")),
    ]
    marked = marks[0].unionByName(marks[1]).unionByName(marks[2]).groupBy("conv_id", "depth").agg(F.max("parent").alias("parent"), F.max("last").alias("last"), F.sum("n_hung").alias("n_hung"))
    last, n_hung = F.coalesce("last", F.lit(False)), F.coalesce("n_hung", F.lit(0))
    nodes = cut(nodes.join(marked, ["conv_id", "depth"], "left").select(
        "conv_id", "depth", "n_convs", "n_bytes",
        F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        (n_hung + (~last).cast("long")).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (last & (n_hung == 0)).cast("long").alias("leaves"),
    ))
    sums = ["saved", "leaves"]
    totals = nodes.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in sums))
    trees = _subtrees(own.select("conv_id", "parent", "at").join(totals, "conv_id"), -1 if root is None else root, sums)
    below = trees.filter("parent is not null").groupBy(F.col("parent").alias("conv_id"), F.col("at").alias("depth")).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    nodes = nodes.join(below, ["conv_id", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(f"__{c}", F.lit(0)) for c in sums})
    nodes = _running(nodes, "conv_id", "depth", False, sums, F.sum).join(_ends(chains, -1 if root is None else root), ["conv_id", "depth"], "left")
    return nodes.withColumns({
        "n_leaves": F.col("leaves"), "saved_tokens": F.col("saved"), "n_ends": F.coalesce("n_ends", F.lit(0)), "ends_sha256": F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)),
    }).select(*NODE)


def with_turns(nodes: DataFrame, turns: DataFrame, columns: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """Nodes with columns (as kept by ``number_turns``) of their last turn, which all members share; NULL at the root."""
    return nodes.join(turns.select("conv_id", "depth", *columns), ["conv_id", "depth"], "left")
