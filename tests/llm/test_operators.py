"""Every operator against brute force on a small corpus with awkward rows, on an empty table and on odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterlake.llm import cover_tree, language, licenses, line_dedup, mixing, ngram_join, packing, parity, spotsigs, toxicity, url_filter
from meterlake.llm.queries import tokenizer_ranks

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = "[^\x20\x09-\x0d]+"


def corpus(seed=7):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)] + ["the", "and", "of", "È", "é", "İ", "Ω"]

    def prose(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = "A common line of many documents"
    texts = [prose(rng.randint(1, 120)) for _ in range(60)]
    base = prose(80).split()
    for k in range(20):  # near copies, more and more edited
        words = list(base)
        for _ in range(k // 2):
            words[rng.randrange(len(words))] = f"x{rng.random()}"
        texts.append(" ".join(words))
    texts += [texts[0], texts[0], texts[3]]
    texts += [f"{prose(30)}\n  {shared.upper()}\t\n{prose(10)}\n\n" for _ in range(12)]
    texts += ["", None, " \t\n", "\n\n", "one", "two words", "one two three four", "one two three four", prose(9000), "x" * 5000, shared, "ß​ é \U0001f600 emoji"]
    texts += ["Licensed under the Apache License, Version 2.0 or MIT-License; CC-BY. GNU General Public License v3", "mit license " * 40]
    return [(i * 3 % 251, t, "en", f"s{i % 5}" if i % 9 else None, None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Null ids, repeated rows, and columns named like results."""
    more = [(None, "no id at all " * 3, None, None, None), (None, None, None, None, None), rows[0], rows[0], (rows[1][0], "another text of the same id", None, "s1", 5)]
    names = "length", "size", "offset", "sequence_id", "n_lines", "labels", "score", "toxicity", "lang_pred", "u", "v", "band", "taken", "part"
    return spark.createDataFrame(rows[:20] + more, SCHEMA).select("*", *(F.lit("clash").alias(n) for n in names))


class Sets:
    def __init__(self):
        self.parent = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)


# --- SpotSigs ---


def spots(text):
    """The signatures by their definition, as texts."""
    words = re.findall(r"[^\W_]+", (text or "").lower())
    anchor = [w in spotsigs.ANCHORS for w in words]
    found, since = set(), 0
    for i, w in enumerate(words):
        chain = [x for x, a in zip(words[i + 1 :], anchor[i + 1 :]) if not a][:2]
        since = 0 if anchor[i] else since + 1
        if (anchor[i] and chain) or since > spotsigs.STRETCH or not any(anchor):
            found.add(" ".join([w, *chain, *[""] * (2 - len(chain))]) if chain else f"{w} ")
    content = [x for x, a in zip(words, anchor) if not a][:2]
    if content:
        found.add(" ".join(["^", *content, *[""] * (2 - len(content))]))
    elif words:
        found.add("$ " + " ".join(words))
    return frozenset(zlib.crc32(x.encode()) for x in found)


def exact(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_collection_join(spark):
    """All pairs of different fingerprints that reach a threshold: copies, sets of one signature, a group of many near copies, every length."""
    rng = random.Random(17)
    sets = [frozenset(rng.sample(range(60), rng.randrange(1, 30))) for _ in range(150)]
    base = frozenset(rng.sample(range(1000, 2000), 60))
    sets += [frozenset(sorted(base)[k % 7 :]) | {5000 + k % 11} for k in range(80)] + [frozenset(), base, base, frozenset({7}), frozenset({7}), frozenset({7, 8, 9, 10})]
    rows = [(k if k % 40 else None, spotsigs.fingerprint(x)) for k, x in enumerate(sets)]
    df = spark.createDataFrame(rows, "doc_id long, fingerprint string")
    first = {}
    for k, x in enumerate(sets):
        if k % 40 and x:
            first.setdefault(x, k)
    for at_least in (0.5, 0.75, 0.9):
        want = {(min(a, b), max(a, b)): exact(x, y) for x, a in first.items() for y, b in first.items() if a < b and exact(x, y) >= at_least}
        got = {(r.u, r.v): r.likeness for r in spotsigs.near_pairs(df, at_least).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], v) for k, v in want.items())
        for x in first:
            for y in first:
                if exact(x, y) >= at_least:
                    assert abs(spotsigs.length_partition(len(x), at_least) - spotsigs.length_partition(len(y), at_least)) <= 1
    assert spotsigs.near_pairs(df.limit(0)).count() == 0
    assert {(r["class"], r.n) for r in spotsigs.classes(df).filter("n > 1").collect()} >= {(first[base], sum(x == base and k % 40 > 0 for k, x in enumerate(sets)))}


def test_spotsigs(docs, rows):
    got = {r.doc_id: r for r in spotsigs.spotsigs(docs).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for k, (doc, text, *_) in enumerate(ordered):
        text, following = text or "", ordered[(k + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + following[:half]
        r = got[doc]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(new.encode()).hexdigest())
        own, other, third = (spots(t) for t in (text, new, following))
        assert spotsigs.parse(r.fingerprint) == own and spotsigs.parse(r.edited_fingerprint) == other
        assert r.near_edited == exact(own, other) and r.near_next == exact(own, third)
    by_text = defaultdict(set)
    for doc, text, *_ in rows:
        by_text[text or ""].add(got[doc].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_spotsigs_of_odd_rows(spark, odd, nothing):
    assert spotsigs.spotsigs(nothing).count() == 0
    got = spotsigs.spotsigs(odd).collect()
    assert len(got) == odd.count() and sum(r.doc_id is None for r in got) == 2
    single = spotsigs.spotsigs(spark.createDataFrame([(5, "the cat sat on the mat", None, None, None)], SCHEMA)).first()
    assert single.near_next == 1.0
    assert spotsigs.signatures("") == frozenset() and len(spotsigs.signatures("the and")) == 1
    assert spotsigs.likeness(frozenset({1}), frozenset(range(9))) == 1 / 9


def test_spotsigs_of_hot_ids(spark):
    """Null and repeated ids are split over ranges, and the order stays whole: every text is the next of one row."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"alpha beta gamma number{i} delta{i}", None, None, None) for i in range(600)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = spotsigs.spotsigs(frame).collect()
    assert len(got) == 600 and Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    assert {r.fingerprint for r in got} == {spotsigs.fingerprint(spots(t)) for _, t, *_ in rows}
    dealt = spotsigs._dealt(frame.select("doc_id", "text"), 16)
    hot = dealt.filter("__guest = 0 and (doc_id is null or doc_id = 7)").groupBy("__range").count().collect()
    assert len(hot) >= 8 and max(r["count"] for r in hot) < 120
    ordered = [(r.doc_id is not None, r.doc_id or 0, r["__hash"]) for r in dealt.filter("__guest = 0").orderBy("__range", "doc_id", "__hash").collect()]
    assert ordered == sorted(ordered)


def test_spotsigs_without_anchors(spark):
    def table(k, n):
        return "Item | Price | " + " | ".join(f"x{k}n{i}" for i in range(n))

    texts = [table(0, 4), table(1, 4), table(0, 400), table(1, 400), "the red fox " + table(2, 100), "the red fox " + table(3, 100), "Приказ 7 об отпуске", "Приказ 7 об оплате"]
    frame = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], SCHEMA)
    for r in spotsigs.spotsigs(frame).collect():
        assert r.near_edited < 0.7 and r.near_next < 0.4, r
    for text in texts[:4]:  # no word is without a signature
        words = re.findall("[a-z0-9]+", text.lower())
        for i in range(len(words)):
            other = spotsigs.signatures(" ".join([*words[:i], "changed", *words[i + 1 :]]))
            assert spotsigs.likeness(spotsigs.signatures(text), other) < 1


# --- packing ---


def first_fit(lengths, capacity):
    free = []
    for n in lengths:
        k = next((k for k, room in enumerate(free) if room >= n), None)
        if k is None:
            free.append(capacity - n)
        else:
            free[k] -= n
    return len(free)


def test_packing_round_trip(docs, rows):
    from pathlib import Path

    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert Path(tokenizer_ranks()).exists()
    got = packing.pack_documents(docs, tokenizer_ranks(), 256, with_ids=True).collect()
    whole, places = defaultdict(dict), defaultdict(list)
    for r in got:
        assert zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length
        whole[r.doc_id][r.piece] = r
        places[r.sequence_id].append((r.offset, r.length))
    for doc, text, *_ in rows:
        pieces = [whole[doc][k] for k in range(len(whole[doc]))]
        ids = [i for p in pieces for i in p.ids]
        assert ids == [*reference.encode(text or "", add_special_tokens=False).ids, 0]
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert all(p.length == 256 for p in pieces[1:])
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 256
    assert len(places) <= first_fit(sorted((r.length for r in got), reverse=True), 256)


@pytest.mark.parametrize("seed", range(6))
def test_plans_place_every_piece_once(seed):
    rng = random.Random(seed)
    histogram = Counter(min(200, int(rng.lognormvariate(3 + seed / 3, 1)) + 1) for _ in range(rng.choice((1, 50, 3000))))
    for groups in (3, 40, 200):
        runs, used = packing.plan_runs(dict(histogram), 200, groups)
        load, ranks = Counter(), Counter()
        for length, rank, n, first, each, _ in runs:
            assert rank == ranks[length]
            ranks[length] += n
            for j in range(n):
                load[first + j // each] += length
        assert ranks == histogram and len(load) == used and max(load.values()) <= 200


@pytest.mark.parametrize(
    "text",
    [
        "a" + " " * 1_000_000 + "b", "\n" * 1_000_000, "x" * 1_000_000, "end" + "\t" * 50_000, "a!\x1c!\x1d b\x85\xa0c" * 20_000, "e\u0301" * 50_000,
        " \t\n\u3000" * 30_000 + "z" + " " * 20_000 + "<|endoftext|>" + " " * 20_000 + "<|endoftext|> x", "a" * 65_536 + " " * 10_000 + "b" + " " * 9_999 + "c\t", "don't  12 \u4e2d " * 60_000,
    ],
    ids=["blanks", "lines", "letters", "tail", "separators", "marks", "special", "edges", "words"],
)
def test_ids_of_very_long_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert list(packing.encode(text, packing.encoder(tokenizer_ranks()))) == reference.encode(text, add_special_tokens=False).ids


def test_lengths_are_ranked_in_parts(spark):
    rows = [(i % 40, i // 40, 0, 50 if i % 3 else 1 + i % 7, i) for i in range(900)]
    pieces = spark.createDataFrame([*rows, rows[0], rows[0]], packing.PIECES).cache()
    got = packing.pack_pieces(pieces, 100, part_rows=30).collect()
    spots = defaultdict(list)
    for r in got:
        spots[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 902 and all(sum(n for _, n in x) <= 100 and [o for o, _ in sorted(x)] == [sum(n for _, n in sorted(x)[:k]) for k in range(len(x))] for x in spots.values())
    assert len(spots) == -(-sum(r.length for r in got) // 100)


def test_packing_of_odd_rows(odd, nothing):
    assert packing.pack_documents(nothing, tokenizer_ranks()).count() == 0
    got = packing.pack_documents(odd, tokenizer_ranks()).collect()
    assert sum(r.piece == 0 for r in got) == odd.count()


# --- URL filter ---


def test_urls(spark):
    entries = [("l", "a.example", "2024-01-10", "add"), ("l", "a.example", "2024-01-20", "remove"), ("l", "a.example", "2024-01-20", "add"), ("l", "a.example", "2024-02-01", "remove"), ("m", "example", "2024-01-15", "add"), (None, "x", None, "add"), ("l", "a.example", "2024-01-12", "nonsense")]
    pages = [(1, "http://u:p@WWW.A.Example:80/x", "2024-01-09"), (2, "http://www.a.example./", "2024-01-10"), (3, "https://a.example?q", "2024-01-31"), (4, "https://a.example", "2024-02-01"), (5, "http://ba.example/", "2024-01-16"), (6, None, "2024-01-16"), (7, "nonsense", "2024-01-16"), (8, "http://a.example/", None), (2, "http://www.a.example./", "2024-01-10")]
    got = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, fetched_on string"), spark.createDataFrame(entries, "list string, domain string, day string, action string"))
    out = sorted((r.page_id, r.host, r.lists, r.domain, r.blocked) for r in got.collect() if r.page_id < 6)
    assert out == [(1, "www.a.example", "", None, False), (2, "www.a.example", "l", "a.example", True), (2, "www.a.example", "l", "a.example", True), (3, "a.example", "l", "a.example", True), (4, "a.example", "", None, False), (5, "ba.example", "", None, False)]
    rest = {r.page_id: r for r in got.collect() if r.page_id > 5}
    assert rest[6].host is None and rest[7].host is None and not rest[8].blocked and rest[8].host == "a.example"
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id long, url string, fetched_on string"), url_filter.stated_entries(spark)).count() == 0


# --- mixing ---


def test_mixing(docs, rows):
    size = {doc: len(re.findall(SPACE, text or "")) for doc, text, *_ in rows}
    got = mixing.mix_sizes(docs, 8).collect()
    assert len(got) == len(rows)
    whole, taken, aim = Counter(), Counter(), {}
    source = {r[0]: r[3] for r in rows}
    for doc, n in size.items():
        whole[source[doc]] += n
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == whole[source[r.doc_id]] and r.taken <= 3 * r["size"]
        taken[source[r.doc_id]] += r.taken
        aim[source[r.doc_id]] = r.target
    assert math.isclose(sum(aim.values()), sum(whole.values()), rel_tol=1e-9)
    assert all(abs(taken[s] - aim[s]) <= 12 for s in aim)
    assert sorted(got) == sorted(mixing.mix_sizes(docs.repartition(3), 8).collect())
    texts = mixing.mix_texts(docs, 8)
    assert texts.columns == docs.columns
    words = Counter()
    for r in texts.collect():
        words[r.doc_id] += len(re.findall(SPACE, r.text))
    assert words == Counter({r.doc_id: r.taken for r in got if r.taken})


def test_targets_and_permutations():
    assert mixing.targets([10, 1000, 1000], [1, 2, 3]) == [30.0, 792.0, 1188.0]
    assert mixing.targets([], []) == [] and mixing.targets([0, 5], [1, 1]) == [0.0, 5.0]
    for n in (1, 2, 7, 64, 1000):
        index = np.arange(n)
        assert sorted(mixing.permute(index, np.full(n, n), np.full(n, 3)).tolist()) == list(range(n))
    slots = np.array([5000, 0, 70000, 12])
    counts = np.array(list(mixing.draws(slots, 1000)))
    assert (counts.sum(axis=0) == slots).all() and (counts[:-1].sum(axis=1) == 1000).all()


def test_very_many_sources(spark):
    """Two hundred thousand sources, of one document each: targets by code point and weight, as many words as the mixture takes."""
    n = 200_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.format_string("%07d", "id")).alias("source"), F.repeat(F.lit("w "), (1 + F.col("id") % 5).cast("int")).alias("text"))
    got = mixing.mix_sizes(docs).select("doc_id", "size", "target", "taken").toPandas().sort_values("doc_id")
    sizes = 1 + np.arange(n) % 5
    want = np.array(mixing.targets(sizes, np.resize([1, 2, 3], n)))
    assert (got["size"].to_numpy() == sizes).all() and np.allclose(got["target"].to_numpy(), want)
    assert (got["taken"].to_numpy() <= 3 * sizes).all() and abs(got["taken"].sum() - sizes.sum()) / sizes.sum() < 0.35


def test_shards_hold_what_was_drawn(docs, rows, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 100)
    placed, sources = mixing.place(docs, 8)
    table = sources.orderBy("__sid").collect()
    drawn = np.array(list(mixing.draws(np.array([r["__slots"] for r in table]), 100)))
    assert len(drawn) > 5 and len({tuple(x) for x in drawn.tolist()}) > 5
    blocks = mixing.mix_blocks(docs, 8).collect()
    held = Counter((r["shard"], r["source"]) for r in blocks)
    assert held == Counter({(k, table[i]["source"]): int(n) for k, x in enumerate(drawn) for i, n in enumerate(x) if n})
    for k, x in enumerate(drawn):  # every slot of a shard holds one block
        assert sorted(r["slot"] for r in blocks if r["shard"] == k) == list(range(int(x.sum())))
    words = {doc: re.findall(SPACE, text or "") for doc, text, *_ in rows}
    for r in blocks:
        own = r["text"].split(" ")
        assert 1 <= len(own) <= 8
        assert {r["source"]} == {source for doc, _, _, source, _ in rows if doc in r["doc_ids"]}
        assert len(r["doc_ids"]) > 1 or any(words[r["doc_ids"][0]][i : i + len(own)] == own for i in range(len(words[r["doc_ids"][0]])))
    first = {(r["doc_id"]): (r["first_shard"], r["first_slot"], r["n_blocks"]) for r in mixing.mix_sizes(docs, 8).collect()}
    places = defaultdict(list)
    for r in blocks:
        for doc in r["doc_ids"]:
            places[doc].append((r["shard"], r["slot"]))
    assert first == {doc: (*min(places[doc]), len(places[doc])) if doc in places else (None, None, 0) for doc in words}


def test_mixing_of_odd_rows(odd, nothing):
    assert mixing.mix_sizes(nothing).count() == 0 and mixing.mix_texts(nothing).count() == 0
    assert mixing.mix_sizes(odd, 8).count() == odd.count()


def test_mixing_takes_repeated_rows_once(spark, rows):
    some = [r for r in rows if r[3]][:40]
    once = spark.createDataFrame(some, SCHEMA)
    repeated = spark.createDataFrame([*some, *some[:20], *some[:5]], SCHEMA)
    assert sorted(r.text for r in mixing.mix_texts(repeated, 8).collect()) == sorted(r.text for r in mixing.mix_texts(once, 8).collect())


def test_pipeline_keeps_one_of_repeated_rows(spark):
    import corpus_pipeline as pipeline

    text, other = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, text, "en", "s1", 5), (1, text, "en", "s0", 5), (2, text, "en", "s1", 5), (3, other, "en", "s1", 5), (None, text, "en", "s1", 5), (None, text, "en", "s1", 5)]
    kept = pipeline.ngram_join(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(kept.collect(), key=str) == sorted([rows[1], rows[3], rows[4]], key=lambda r: str(spark.createDataFrame([r], SCHEMA).first()))


# --- line dedup ---


def test_lines(docs, rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    where = defaultdict(set)
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                where[key(line)].add(doc)
    got = {r.doc_id: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(got) == len(rows)
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(where[key(x)]) >= 2 and min(where[key(x)]) != doc)]
        assert (got[doc].n_lines, got[doc].n_dropped, got[doc].kept_text) == (len(lines), len(lines) - len(kept), "\n".join(kept))
    three = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(docs, min_docs=3).collect()}
    for doc, text, *_ in rows:
        assert three[doc] == sum(len(where[key(x)]) >= 3 and min(where[key(x)]) != doc for x in (text or "").split("\n"))


def test_hot_lines_are_split(spark):
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the very same line\nown line number "), "id").alias("text"))
    assert line_dedup.dedup_lines(many).agg(F.sum("n_dropped")).first()[0] == 2999


def test_lines_of_odd_rows(odd, nothing):
    assert line_dedup.dedup_lines(nothing).count() == 0
    got = line_dedup.dedup_lines(odd).collect()
    assert len(got) == odd.count()
    assert all(r.n_dropped == 0 for r in got if r.doc_id is None)


# --- embeddings ---


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    center = rng.normal(size=16)
    vectors = [(center + rng.normal(size=16) * s).tolist() for s in [0.05] * 60 + [0.3] * 40] + rng.normal(size=(120, 16)).tolist()
    vectors += [vectors[0], vectors[0], [2 * x for x in vectors[1]], [0.0] * 16, None, [float("nan")] * 16, [1.0, None] + [0.0] * 14, [1.0, 0.0], [2.0, 0.0], [], [float("inf")] * 16]
    rows = [(i * 5 % 977, v, "x") for i, v in enumerate(vectors)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, tile string").repartition(4), tile=64).collect()}
    assert len(got) == len(rows)
    sets, links = Sets(), Counter()
    unit = {}
    for i, v, _ in rows:
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    for a in unit:
        for b in unit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95:
                sets.join(a, b)
                links[a] += 1
                links[b] += 1
    for i, _, _ in rows:
        root = sets.root(i)
        assert got[i] == (links[i], root, root == i), i


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("noise", [0.001, 0.02, 0.05, 0.1, 0.3])
def test_dual_traversal(noise):
    """Counts, forest and pruning of one tile and of two, at the default constants."""
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(30, 32))
    x = unit(np.repeat(centers, 40, axis=0) + noise * rng.normal(size=(1200, 32)) * np.linalg.norm(centers[0]) / 6)
    y = unit(np.vstack([np.repeat(centers[:10], 50, axis=0) + noise * rng.normal(size=(500, 32)), rng.normal(size=(300, 32))]))
    wx, wy = rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    for a, b, wa, wb, same in ((x, x, wx, wx, True), (x, y, wx, wy, False), (y, y, wy, wy, True)):
        hit = a @ b.T >= 0.95
        if same:
            np.fill_diagonal(hit, False)
        ca, cb, u, v, work = cover_tree.link_tiles(a, b, wa, wb, 0.95, same)
        assert (ca == hit @ wb).all() and (same or (cb == wa @ hit).all())
        assert hit[u, v].all()
        sets, want = Sets(), Sets()
        for i, j in zip(u.tolist(), v.tolist(), strict=True):
            sets.join(i, j if same else j + len(a))
        for i, j in zip(*map(np.ndarray.tolist, np.nonzero(hit)), strict=True):
            want.join(i, j if same else j + len(a))
        size = len(a) if same else len(a) + len(b)
        assert [sets.root(k) for k in range(size)] == [want.root(k) for k in range(size)]
        assert len(u) == size - len({sets.root(k) for k in range(size)})
        if same and len(a) == 1200 and noise < 0.1:  # clusters: a small part of the 1.44 million pairs is looked at
            assert work["centres"] + work["decided"] < len(a) ** 2 / 10 and work["pruned"] > 0.8 * 30 * 29 / 2


def test_nested_levels():
    rng = np.random.default_rng(5)
    x = unit(np.repeat(rng.normal(size=(5, 8)), 100, axis=0) + 0.2 * rng.normal(size=(500, 8)))
    radii = cover_tree.levels(math.sqrt(0.1))
    tree = cover_tree.build(x, radii)
    assert radii[0] == 0.5 and all(b == a / 2 for a, b in zip(radii, radii[1:], strict=False)) and sorted(tree.rows) == list(range(500))
    depth = {0: 0}
    for k in range(len(tree.begin)):
        members = x[tree.rows[tree.begin[k] : tree.end[k]]]
        assert math.isclose(np.linalg.norm(members - members[0], axis=1).max(), tree.radius[k], abs_tol=1e-12)
        kids = range(tree.first[k], tree.last[k])
        if kids:
            assert tree.rows[tree.begin[kids[0]]] == tree.rows[tree.begin[k]]  # nested: the centre is the first child's
            assert [tree.begin[c] for c in kids] == [tree.begin[k], *[tree.end[c] for c in kids[:-1]]] and tree.end[kids[-1]] == tree.end[k]
            centers = x[[tree.rows[tree.begin[c]] for c in kids]]
            r = radii[depth[k]]
            apart = np.linalg.norm(centers[:, None] - centers[None], axis=2) + 9 * np.eye(len(kids))
            assert apart.min() > r - 1e-3 and all(tree.radius[c] <= r + 1e-3 for c in kids)
            depth |= dict.fromkeys(kids, depth[k] + 1)
    assert max(depth.values()) >= 2


def test_embeddings_of_odd_rows(spark):
    assert cover_tree.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (2, [1.0, 0.01])]
    got = sorted((r.vec_id or -1, r.n_links, r.component_id) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (1, 2, 1), (2, 2, 1)]


# --- n-gram join ---


def shingles(text):
    words = re.findall(SPACE, (text or "").translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def expected_components(rows):
    sets, own = Sets(), [(doc, shingles(text)) for doc, text, *_ in rows]
    for a, s in own:
        for b, t in own:
            if a < b and s and t and 100 * len(s & t) >= 75 * len(s | t):
                sets.join(a, b)
    return {doc: (len(s), sets.root(doc)) for doc, s in own}


def test_ngram_join(docs, rows, monkeypatch):
    want = expected_components(rows)
    for small in (16, 2):  # 2: nearly all groups are large ones
        monkeypatch.setattr(ngram_join, "SMALL", small)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_shingles(docs).collect()}
        assert got == want


def test_ngram_join_of_a_large_family(spark, monkeypatch):
    rng = random.Random(5)
    rows = []
    for family in range(3):
        base = [f"b{family}.{i}" for i in range(60)]
        for k in range(60):
            words = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                words[rng.randrange(60)] = f"e{rng.random()}"
            rows.append((family * 1000 + k, " ".join(words), None, None, None))
    rng.shuffle(rows)
    want = expected_components(rows)
    assert len({c for _, c in want.values()}) > 3
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link_shingles(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_windows_of_bytes_do_not_matter(rows, monkeypatch):
    texts = [(t or "").encode() for _, t, *_ in rows]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    whole = parity.shingle_sets(data, offsets)
    assert [len(s) for s in whole] == [len(shingles(t)) for _, t, *_ in rows]
    for window in (7, 64, 4099):
        monkeypatch.setattr(parity, "WINDOW", window)
        parity._powers.cache_clear()
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(whole, parity.shingle_sets(data, offsets), strict=True))
    parity._powers.cache_clear()


def test_entries_are_packed_without_loss():
    rng = np.random.default_rng(2)
    columns = [rng.integers(-(2**62), 2**62, 50), rng.integers(0, 64, 50), *rng.integers(0, 2**31, (3, 50))]
    got = ngram_join._unpacked(ngram_join._packed([np.diff(columns[0], prepend=0), *columns[1:]]))
    assert all((got[name] == x).all() for (name, _), x in zip(ngram_join.ENTRY, columns, strict=True))
    assert len(ngram_join._unpacked(b"")["doc"]) == 0


def test_ngram_join_of_odd_rows(odd, nothing):
    assert ngram_join.link_shingles(nothing).count() == 0
    got = ngram_join.link_shingles(odd).collect()
    assert len(got) == odd.count() and all(r.component_id is None for r in got if r.doc_id is None)


# --- language ---


def test_languages(spark):
    rng = random.Random(2)
    words = {"aa": ["kato", "mira", "solo", "pani"], "bb": ["grund", "stark", "blitz", "wurm"], "cc": ["мир", "дом", "лес"]}
    train = [(i, " ".join(rng.choice(words[lang]) for _ in range(30)), lang) for i, lang in enumerate(sorted(words) * 30)]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = language.fit(docs)
    cases = [(1, "mira pani kato"), (2, "blitz grund"), (3, "дом лес"), (4, None), (5, "12 !? ½"), (6, " ".join(["kato mira"] * 30 + ["grund wurm"] * 20))]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(cases, "doc_id long, text string").withColumn("lang_pred", F.lit("x")), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["aa", "bb", "cc", "und", "und", "aa"]
    assert got[4].lang_score == 0 and [(s.lo, s.hi, s["lang"]) for s in got[6].lang_spans] == [(0, 60, "aa"), (60, 100, "bb")]
    none = language.fit(docs.limit(0))
    assert language.identify(docs, none).filter("lang_pred != 'und'").count() == 0
    assert language.identify(docs.limit(0), model).count() == 0


def test_viterbi_finds_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(40):
        scores = rng.normal(size=(6, 3)) * 3
        path = language.viterbi(scores, 2.0)

        def value(p, s=scores):
            return sum(s[i, x] for i, x in enumerate(p)) - 2.0 * sum(a != b for a, b in itertools.pairwise(p))

        assert math.isclose(value(path), max(value(p) for p in itertools.product(range(3), repeat=6)))


def test_long_texts_are_scored_in_pieces(monkeypatch):
    rng = random.Random(8)
    counts = np.array([[rng.randint(1, 50) for _ in range(language.BUCKETS)] for _ in range(3)], dtype=float)
    model = language.Model(["aa", "bb", "cc"], counts, np.ones((3, len(language._NAMES))))
    text = " ".join(rng.choice(["Kato", "mira,", "ΣΟΦΟΣ", "x", "longerword", "12", "\n"]) for _ in range(3000))
    want = language.label([text], model, 2.0)
    monkeypatch.setattr(language, "PIECE_CHARS", 100)
    monkeypatch.setattr(language, "HELD_BYTES", 3000)
    assert language.label([text], model, 2.0)[0][::2] == want[0][::2] and math.isclose(language.label([text], model, 2.0)[0][1], want[0][1])
    scores = np.random.default_rng(4).normal(size=(500, 3))
    for penalty in (0.5, 5.0, 20.0, 60.0):
        best = int(np.argmax(scores.sum(axis=0)))
        gain = np.vstack([np.zeros((1, 3)), np.cumsum(scores - scores[:, [best]], axis=0)])
        assert language._leaves((scores[i : i + 7] for i in range(0, 500, 7)), best, penalty) == bool((gain - np.minimum.accumulate(gain, axis=0)).max() >= penalty)


def test_paths_in_blocks_and_many_languages(monkeypatch):
    """Blocks of any size, empty ones too, give the path of the whole; with very many languages tables get fewer buckets."""
    rng = np.random.default_rng(11)
    for n in (1, 2, 30, 200):
        scores = rng.normal(size=(n, 4)) + 2 * np.repeat(rng.normal(size=(n // 20 + 1, 4)), 20, axis=0)[:n]
        for penalty in (0.5, 3.0, 30.0):
            cuts = sorted({0, n, *rng.integers(0, n + 1, 5).tolist()})
            parts = [np.zeros((0, 4)), *(scores[a:b] for a, b in zip(cuts, cuts[1:], strict=False)), np.zeros((0, 4))]
            path = language.viterbi_blocks(lambda k, parts=parts: parts[k], len(parts), penalty)
            assert path.tolist() == language.viterbi(scores, penalty).tolist()
    assert [language.shift(n) for n in (0, 1, 512, 513, 1024, 1025, 2049)] == [0, 0, 0, 1, 1, 2, 3]
    monkeypatch.setattr(language, "MAX_LANGS", 1)
    counts = np.ones((3, language.BUCKETS >> 2))
    model = language.Model(["aa", "bb", "cc"], counts, np.ones((3, len(language._NAMES))))
    assert model.table.shape == (language.BUCKETS >> 2, 3) and language.label(["some words", ""], model)[1] == (language.UND, 0.0, [])


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language.identify(docs, language.fit(docs.filter(~language.held_out()))).filter(language.held_out())
    assert got.filter("lang_pred = lang").count() >= 0.95 * got.count()


# --- toxicity ---


def test_toxicity(spark):
    rng = random.Random(4)
    clean = [f"c{i}" for i in range(200)]
    rows = []
    for i in range(400):
        words = [rng.choice(clean) for _ in range(40)]
        toxic = i % 8 == 0
        if toxic:
            for w in ("zorkel", "zorkend", "blorf"):
                words[rng.randrange(40)] = w
        rows.append((i, " ".join(words), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = frame.select("doc_id", "text"), frame.select("doc_id", "toxic")
    lexicon = toxicity.fit(docs, labels.filter(~toxicity.held_out()))
    scored = toxicity.score_toxicity(docs.join(labels, "doc_id").withColumn("toxicity", F.lit("x")), lexicon)
    assert scored.filter((F.col("toxicity") >= 0.5) != (F.col("toxic") == 1)).count() == 0
    automaton = lexicon.automaton()
    assert toxicity.score("such a Bl0rf, you Zоrcend zork3l", lexicon, automaton) > 0.5
    assert toxicity.score(None, lexicon, automaton) < 0.5 and toxicity.score("trash can", lexicon, automaton) < 0.5
    assert toxicity.match("xblorf blorfx", lexicon, automaton) == []
    assert toxicity.fit(docs, labels.filter("toxic = 0")) == toxicity.Lexicon()
    assert toxicity.score_toxicity(docs.limit(0), lexicon).count() == 0
    assert toxicity.score_toxicity(docs, toxicity.Lexicon()).filter("toxicity != 0").count() == 0


def naive_matches(text, lexicon):
    """Every place of every term, tried one by one."""
    folded, found = toxicity.fold(text), []
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\W\d_]+", folded)]
    for k, (at, word) in enumerate(words):
        for term, weight in lexicon.weights.items():
            if word == term or (term.endswith("*") and word.startswith(term[:-1])):
                after = words[k + 1] if k + 1 < len(words) else (10**9, "")
                before = words[k - 1] if k else (-(10**9), "")
                near = after[0] + len(after[1]) <= at + len(word) + 40 and (word, after[1]) in lexicon.exceptions
                if not near and (before[1], word) not in lexicon.exceptions:
                    found.append((term, weight, at))
    return sorted(found)


def test_matches_against_a_naive_matcher():
    rng = random.Random(6)
    lexicon = toxicity.Lexicon({"idiot": 5.0, "moro*": 4.0, "moron": 2.0, "trash": 3.0, "scum": 1.0, "id*": 1.5}, frozenset({("trash", "can"), ("pond", "scum"), ("an", "idiot")}), (-3.0, 1.0, 0.5))
    automaton = lexicon.automaton()
    bits = ["idiot", "1d10t", "idiots", "xidiot", "Moronic", "mоron", "trash", "trash can", "can", "pond scum", "scum.", "5cum", "an", "idea", "a_idiot", "idiot2", "!", "ok", "sc\u200bum"]
    for _ in range(300):
        text = rng.choice([" ", ", ", "\n"]).join(rng.choice(bits) for _ in range(rng.randint(0, 15)))
        assert sorted(toxicity.match(toxicity.fold(text), lexicon, automaton)) == naive_matches(text, lexicon), text
        x, rate, _ = toxicity.features(text, lexicon, automaton)
        weight = sum(w for _, w, _ in naive_matches(text, lexicon))
        n = len(re.findall(r"[^\W\d_]+", toxicity.fold(text)))
        assert math.isclose(x, math.log1p(weight)) and math.isclose(rate, min(100 * weight / max(n, 20), 50.0) / 5)
    assert toxicity.features("an idiot", lexicon, automaton)[0] == 0


def test_windows_of_words(monkeypatch):
    text = " ".join(f"w{chr(97 + i % 26)}" * (1 + i % 3) for i in range(200))
    whole = ["", *re.findall(r"[^\W\d_]+", toxicity.fold(text)), ""]
    monkeypatch.setattr(toxicity, "PIECE_CHARS", 20)
    assert [tuple(w[i - 1 : i + 2]) for w in toxicity.windows(text) for i in range(1, len(w) - 1)] == [tuple(whole[i - 1 : i + 2]) for i in range(1, len(whole) - 1)]
    assert list(toxicity.windows(None)) == [["", ""]]


def test_folding():
    assert toxicity.fold("1D10T sc​um рathetic 2024 10") == "idiot scum pathetic 2024 10"


# --- licenses ---


def test_license_places(docs, rows):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    for doc, text, *_ in rows:
        words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places, labels = [], set()
        for phrase, label in licenses.BASE:
            parts = phrase.split()
            at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
            places += at
            labels |= {label} if at else set()
        r = got[doc]
        want = (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        spans = [(x.lo, x.hi, x.priority, x.rule) for x in r.licenses]
        for a in spans:
            assert not any(b[0] <= a[0] and b[1] >= a[1] and (b[2] < a[2] or (b[2] == a[2] and (b[1] - b[0] > a[1] - a[0] or b[3] < a[3]))) for b in spans)


def test_license_rules(spark, odd, nothing):
    texts = {
        "This is licensed under the GNU General Public License, version 3.0": "gpl,gpl-3.0", "SPDX-License-Identifier: MIT": "mit", "BSD 3-Clause": "bsd-3-clause",
        "Nothing of that kind, mit freundlichem Gruss": "", "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit", "CC BY-SA 4.0": "cc-by,cc-by-sa-4.0",
    }
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.labels for r in licenses.scan_licenses(frame).orderBy("doc_id").collect()] == list(texts.values())
    assert len(licenses.rules()) > 200
    assert licenses.scan_licenses(nothing).count() == 0 and licenses.scan_licenses(odd).count() == odd.count()


def test_license_rules_against_brute_force(spark, rows):
    rng = random.Random(9)
    bits = ["licensed under the", "Released under", "the terms of", "apache license", "Apache Software License,", "version 2.0", "v3", "2", "GNU General Public License", "general public licence", "GPL", "or any later version",
            "or later", "BSD", "BSD-style license", "3-clause", "MIT", "mit license", "cc by", "CC-BY-SA", "4.0", "all rights reserved", "public domain", "dedicated to the public domain", "word", "and", "mpl", "wtfpl", "license"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(1, 60))) for _ in range(120)] + [t or "" for _, t, *_ in rows]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        norm = " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", texts[r.doc_id].translate(LOWER))) + " "
        spans = []
        for rule, pattern, priority, score, label in licenses.rules():
            for m in re.finditer(f"(?<= )(?:{pattern})(?= )", norm):
                lo = norm[: m.start()].count(" ") - 1
                spans.append((rule, priority, score, label, lo, lo + m[0].count(" ") + 1))

        def inside(a, b):
            wider = b[5] - b[4] > a[5] - a[4]
            return b[4] <= a[4] and b[5] >= a[5] and (b[1] < a[1] or (b[1] == a[1] and (wider or b[0] < a[0])))

        want = {a for a in spans if not any(inside(a, b) for b in spans)}
        assert {tuple(x) for x in r.licenses} == want and len(r.licenses) == len(want), texts[r.doc_id]
        assert r.labels == ",".join(sorted({a[3] for a in want} | set(filter(None, r.base_labels.split(",")))))


def test_license_places_of_a_long_text(spark):
    import time

    frame = spark.createDataFrame([(1, "mit license " * 64_000)], "doc_id long, text string")
    began = time.perf_counter()
    r = licenses.scan_licenses(frame).selectExpr("n_base", "last_word", "size(licenses) AS n").first()
    assert (r.n_base, r.last_word, r.n) == (64_000, 127_998, 64_000) and time.perf_counter() - began < 30


def test_every_license_name_fires_its_rule(spark):
    def spellings(name):
        yield re.sub(r"\(\?:([^)]*)\)\?", r"\1", name).replace("[cs]", "c").replace(" ?", " ")
        yield re.sub(r"\(\?:[^)]*\)\?", "", name).replace("[cs]", "s").replace(" ?", "")

    cases = []
    for label, _, names, versions in licenses.FAMILIES:
        for name in {x for n in names for x in spellings(n)}:
            cases += [(f"See {name.title()}.", label)] if name not in ("apache", "mit", "bsd") else []
            cases += [(f"Released under {name},", label), (f"distributed under the_terms of_the __{name.upper()}__", label)]
            cases += [(f"{name}, version {v}", f"{label}-{v.replace(' clause', '-clause').replace(' ', '.') + '.0' * v.isdigit()}") for v in versions]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    for r in licenses.scan_licenses(frame).collect():
        assert {x.label for x in r.licenses} == {cases[r.doc_id][1]}, r


@pytest.mark.parametrize(("tile", "size", "bundles"), [(16, 1 << 20, 3), (64, 8 * 16 * 20, 2), (4096, 1 << 20, 4096)])
def test_tiles_meet_through_balls_of_balls(spark, tile, size, bundles):
    """Tiles bounded by rows or bytes, groups and bundles of any size: the same links, and clustered vectors exchange few groups."""
    rng = np.random.default_rng(12)
    centers = rng.normal(size=(12, 16))
    x = unit(np.concatenate([c + rng.normal(size=(60, 16)) * s for c, s in zip(centers, [0.05, 0.1, 0.2] * 4, strict=True)]))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_duplicates(df, tile=tile, tile_bytes=size, bundles=bundles).collect()}
    near = x @ x.T >= 0.95
    sets = Sets()
    for a, b in zip(*np.nonzero(near), strict=True):
        sets.join(int(a), int(b))
    assert got == {k: (int(near[k].sum()) - 1, sets.root(k)) for k in range(len(x))}


def test_bounds_of_tiles():
    """A task's two groups hold at most 2 x GROUP_BYTES of vectors, at any dimension and number of tiles."""
    for dim in (1, 64, 768, 4096, 100_000):
        rows = cover_tree.tile_rows(dim)
        assert rows >= 1 and (rows * dim * 8 <= cover_tree.TILE_BYTES or rows == 1)
        for tiles in (1, 100, 10**6):
            group = cover_tree.group_tiles([2, dim], tiles)
            assert group >= 1 and group * rows * dim * 8 <= cover_tree.GROUP_BYTES
    assert cover_tree.group_tiles([64], 10**6) == 64 and cover_tree.group_tiles([768], 10**6) == 5


def test_meeting_groups(spark):
    """Pairs of balls within reach, against all pairs; each group meets itself."""
    rng = np.random.default_rng(13)
    centers, radii = rng.normal(size=(80, 3)), rng.random(80) * 0.2
    rows = [(0, k, k // 7, centers[k].tolist(), float(radii[k])) for k in range(80)]
    groups = spark.createDataFrame(rows, "dim int, grp long, bundle long, center array<double>, radius double")
    got = sorted((r.a, r.b) for r in cover_tree._meeting(groups, 0.3).collect())
    far = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(axis=2)) - radii[:, None] - radii[None]
    assert got == sorted((a, b) for a in range(80) for b in range(a, 80) if a == b or far[a, b] <= 0.3)
