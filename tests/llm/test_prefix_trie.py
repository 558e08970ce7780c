"""The trie of conversations against one built in Python."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from meterlake.llm import prefix_trie as P

SCHEMA = "conv_id long, turn long, role string, text string"


def sorted_turns(rows):
    own = {}
    for c, t, r, x in rows:
        r, x = r or "", x or ""
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(own[c])] for c in own}


def brute(rows, graft):
    own = sorted_turns(rows)
    rebuilt = {c: own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :] if graft else own[c] for c in own}
    members = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = dict.fromkeys(members, 0)
    for p in members:
        if p:
            children[p[:-1]] += 1
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(p))
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ends.encode()).hexdigest())
    return out


def built(spark, rows, graft):
    turns = P.number_turns(spark.createDataFrame(rows, SCHEMA))
    nodes = P.prefix_trie(*P.grafted(turns)) if graft else P.prefix_trie(turns)
    got = nodes.collect()
    assert len({(r.conv_id, r.depth) for r in got}) == len(got)
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}


@pytest.mark.parametrize("graft", [True, False])
def test_odd_rows(spark, graft):
    """Nulls in every column, ties of turn, repeated rows, conversations without turns."""
    rnd = random.Random(1)
    rows = [(rnd.choice([None, *range(30)]), rnd.choice([None, 0, 1, 2, 3, 4]), rnd.choice(["u", "a", None]), rnd.choice(["x", "", "yé", None])) for _ in range(160)]
    assert built(spark, rows, graft) == brute(rows, graft)


def test_chunks_copies_and_a_tall_tree(spark, monkeypatch):
    """Chains hang on chains for 24 levels; conversations and hashes are put together from many chunks."""
    monkeypatch.setattr(P, "CHUNK", 3)
    monkeypatch.setattr(P, "IDS", 4)
    rows = [(c, t, "u", "same" if t < c else f"own{c % 7}") for c in range(25) for t in range(c)]
    rows += [(c, t, "u", f"copied {t}") for c in range(40, 70) for t in range(5)]
    for graft in (True, False):
        assert built(spark, rows, graft) == brute(rows, graft)


def test_empty_table_and_clashing_columns(spark):
    assert built(spark, [], True) == {}
    rows = [(7, 1, "u", "a"), (7, 2, "a", "b"), (9, 1, "u", "a")]
    names = ["depth", "digest", "n", "owner", "p", "q", "first", "parent", "n_bytes", "node"]
    clashing = spark.createDataFrame(rows, SCHEMA).select("*", *(F.lit("x").alias(c) for c in names))
    got = P.prefix_trie(P.number_turns(clashing))
    assert {(r.conv_id, r.depth, r.n_ends) for r in got.collect()} == {(7, 0, 0), (7, 1, 1), (7, 2, 1)}


def test_long_conversation_and_texts_of_nodes(spark):
    """A conversation of 9,000 turns spans chunks and parts; nodes find the turn that all members share."""
    rows = [(1, t, "u", f"t{t}") for t in range(9000)] + [(2, t, "u", f"t{t}" if t < 8500 else "other") for t in range(8600)] + [(3, 0, "u", "x" * 2_000_000)]
    turns = P.number_turns(spark.createDataFrame(rows, SCHEMA), keep=("role", "text"))
    nodes = P.prefix_trie(turns).cache()
    assert nodes.count() == 9000 + 100 + 1 + 1
    at = {(r.conv_id, r.depth): r for r in nodes.filter("depth in (0, 8500, 8501)").collect()}
    assert (at[1, 8500].n_children, at[1, 8500].n_leaves, at[2, 8501].parent_conv_id) == (2, 2, 1)
    assert at[1, 0].saved_tokens == sum(len(f"t{t}") for t in range(8500)) and at[1, 0].n_leaves == 3
    named = P.with_turns(nodes, turns).filter("depth > 0")
    assert named.filter("conv_id = 1 and text != concat('t', depth - 1)").isEmpty() and named.filter("text is null").isEmpty()
