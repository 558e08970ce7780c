"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded: lower case, zero-width characters dropped, homoglyphs of other scripts and digits
or signs that stand for letters replaced. An automaton finds the lexicon's words and word stems;
matches inside an exception phrase do not count. The weights of the rest are summed, normalised by
the length in words, and a logistic curve turns sum and rate into a score.

The lexicon is learned from at most about SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents: words and
stems that stand in several different contexts of toxic documents and hardly in clean ones (copies
of one text share their contexts, so its accidental words do not qualify). Spark counts them; only
the chosen terms and a few numbers per sampled document come to the driver.

Defined cases
* null or empty text: no match, the score of a clean text.
* texts of any length are folded whole; their words are counted in pieces.
* repeated rows: scored alike. Null ids count as training ids but have no label.
* labels that are null, or ids labelled more than once: null is no label; toxic wins.
* no training labels of one kind: the lexicon is empty, every score is 0.
* empty table: an empty result. Other columns pass through; those named like results are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, slices

SAMPLE_TOXIC = 2500
SAMPLE_CLEAN = 7500
#: Code points of a text whose words are split at once, and rows that a task counts before it sends them on.
PIECE_CHARS = 1 << 20
HELD = 500_000
# Insults that are in the lexicon unless clean labelled documents hold them as often.
SEEDS = ("bastard", "clown", "cretin", "disgusting", "dumb", "idiot", "imbecile", "loser", "moron", "pathetic", "scum", "stupid", "trash", "vermin", "worthless")
SEED_WEIGHT = 5.0
#: A term needs this share of the sampled toxic documents (4 at least), as many different contexts, and
#: this log ratio of its document rates.
MIN_SHARE = 0.004
MIN_WEIGHT = 4.0
#: A longer term replaces a stem of whose toxic documents it has this share.
SPECIFIC = 0.9
MAX_TERMS = 5000
STEMS = (4, 5, 6)
#: Contexts of a term in as many clean documents, and in none that is toxic, become exceptions.
MIN_EXCEPTION = 3

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip(
    "аеорсухіјѕԁһӏԛԝвкмнтαοινρτυχκ",
    "aeopcyxijsdhlqwbkmhtaoivptuxk", strict=True,
))
# Digits and signs that stand for letters.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l"}
#: Phrases in which a word is harmless: word -> the word after it.
EXCEPTIONS = (("trash", "can"), ("trash", "bin"), ("clown", "fish"), ("pond", "scum"))

_FOLD = str.maketrans(HOMOGLYPHS | dict.fromkeys("­​‌‍⁠﻿"))
_ODD = re.compile("[" + "".join(HOMOGLYPHS) + "­​‌‍⁠﻿]")
_SIGNS = "[" + re.escape("".join(DIGITS)) + "]"
_LEET = re.compile(rf"(?<=[^\W\d_]){_SIGNS}+(?=[^\W\d_])|(?<![^\W_]){_SIGNS}(?=[^\W\d_])")
_WORD = re.compile(r"[^\W\d_]+")


def fold(text: str | None) -> str:
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD)
    return _LEET.sub(lambda m: "".join(DIGITS[c] for c in m[0]), text)


def terms(word: str) -> list[str]:
    """A word and its proper stems, marked by '*'."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[tuple[str, str]] = frozenset()
    curve: tuple[float, float, float] | None = None

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            found.add_word(term.rstrip("*"), (term, weight))
        if self.weights:
            found.make_automaton()
        return found


def match(text: str, lexicon: Lexicon, automaton) -> list[tuple[str, float, int]]:
    """(term, weight, position) of the matches of folded ``text`` that begin a word and are no exception."""
    found = []
    if not lexicon.weights:
        return found
    last = len(text) - 1
    for end, (term, weight) in automaton.iter(text):
        begin = end - len(term.rstrip("*")) + 1
        if (begin and text[begin - 1].isalpha()) or (not term.endswith("*") and end < last and text[end + 1].isalpha()):
            continue
        if lexicon.exceptions and _excepted(text, begin, lexicon.exceptions):
            continue
        found.append((term, weight, begin))
    return found


def _excepted(text: str, begin: int, exceptions: frozenset[tuple[str, str]]) -> bool:
    here = _WORD.match(text, begin)
    after = _WORD.search(text, here.end(), here.end() + 40)
    before = _WORD.findall(text[max(0, begin - 40) : begin])
    return (after is not None and (here[0], after[0]) in exceptions) or (bool(before) and (before[-1], here[0]) in exceptions)


def features(text: str | None, lexicon: Lexicon, automaton) -> tuple[float, float, list[tuple[str, float, int]]]:
    """Log of the matched weight, the matched weight per hundred words (at most 10), and the matches."""
    folded = fold(text)
    found = match(folded, lexicon, automaton)
    weight = sum(w for _, w, _ in found)
    if not weight:
        return 0.0, 0.0, found
    n = sum(1 for _ in _WORD.finditer(folded))
    return math.log1p(weight), min(100 * weight / max(n, 20), 50.0) / 5, found


def scored(text: str | None, lexicon: Lexicon, automaton) -> tuple[float, list[tuple[str, float, int]]]:
    """(score, matches) of a text; without a curve nothing is toxic."""
    x, rate, found = features(text, lexicon, automaton)
    if lexicon.curve is None:
        return 0.0, found
    a, b, c = lexicon.curve
    return 1 / (1 + math.exp(-max(min(a + b * x + c * rate, 30), -30))), found


def score(text: str | None, lexicon: Lexicon, automaton) -> float:
    return scored(text, lexicon, automaton)[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method for logistic regression with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    beta, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def windows(text: str | None) -> Iterator[list[str]]:
    """The words of a text in lists that overlap by two, with '' before the first word and after the last."""
    held = [""]
    for piece in pieces(fold(text), PIECE_CHARS):
        held += _WORD.findall(piece)
        if len(held) > 2:
            yield held
            held = held[-2:]
    yield [*held, ""]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, toxic) to (term, context, toxic, n documents): context '' for each term of a document, and
    in toxic documents the pair of words around it (of which only the different ones count)."""

    def flush(rows: Counter) -> pa.RecordBatch:
        term, context, toxic = zip(*rows, strict=True) if rows else ((), (), ())
        arrays = [pa.array(term, pa.string()), pa.array(context, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(rows.values()), pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names=["term", "context", "toxic", "n"])

    rows: Counter = Counter()
    for batch in slices(batches, 0):
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen: set[str] = set()
            for own in windows(text):
                seen.update(own[1:-1])
                if toxic:
                    rows.update((t, f"{own[i - 1]} {own[i + 1]}", toxic) for i in range(1, len(own) - 1) for t in terms(own[i]))
                    if len(rows) > HELD:
                        yield flush(rows)
                        rows = Counter()
            rows.update((t, "", toxic) for t in {t for word in seen for t in terms(word)})
            if len(rows) > HELD:
                yield flush(rows)
                rows = Counter()
    yield flush(rows)


def _chosen(found: list[tuple[str, float, int]]) -> dict[str, float]:
    """Of (term, weight, toxic documents): no stem that a longer term nearly equals, nothing that a stem covers."""
    count = {term: n for term, _, n in found}
    for term in sorted(count, key=len, reverse=True):
        word = term.rstrip("*")
        for n in STEMS:
            stem = f"{word[:n]}*"
            if stem != term and n <= len(word) and stem in count and count[term] >= SPECIFIC * count[stem]:
                count[stem] = -1
    chosen: dict[str, float] = {}
    for term, weight, _ in sorted(found, key=lambda x: (len(x[0].rstrip("*")), not x[0].endswith("*"), x[0])):
        word = term.rstrip("*")
        if count[term] > 0 and not any(f"{word[:n]}*" in chosen for n in STEMS if n <= len(word)):
            chosen[term] = weight
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN) -> Lexicon:
    """A lexicon from labelled documents; ``docs`` (doc_id, text) are joined with ``labels`` (doc_id, toxic)."""
    own = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sizes = {r["toxic"]: r["count"] for r in own.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Lexicon()
    rate = F.when(F.col("toxic") == 1, F.lit(sample_toxic / sizes[1])).otherwise(F.lit(sample_clean / sizes[0]))
    # a sample by hash, of bounded size, so that it may be broadcast
    drawn = own.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).limit(2 * (sample_toxic + sample_clean))
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("text", "toxic"))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not totals.get(1) or not totals.get(0):
        return Lexicon()
    rows = sample.mapInArrow(_counted, "term string, context string, toxic int, n long").groupBy("term", "context", "toxic").agg(F.sum("n").alias("n"))
    by_term = rows.groupBy("term").agg(
        F.sum(F.when((F.col("toxic") == 1) & (F.col("context") != ""), 1).otherwise(0)).alias("contexts"),
        F.sum(F.when((F.col("toxic") == 1) & (F.col("context") == ""), F.col("n")).otherwise(0)).alias("toxic"),
        F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("clean"),
    )
    weight = F.log((F.col("toxic") + 0.5) / (totals[1] + 1)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1))
    least = max(4, round(MIN_SHARE * totals[1]))
    # what may be chosen or refuted: a small part of all terms, counted once
    some = ((F.col("contexts") >= least) & (F.col("toxic") >= least)) | F.col("term").isin(*SEEDS)
    by_term = cut(by_term.filter(some))
    best = by_term.filter((F.col("contexts") >= least) & (F.col("toxic") >= least)).withColumn("weight", weight).filter(F.col("weight") >= MIN_WEIGHT)
    best = best.orderBy(F.desc("contexts"), "term").limit(MAX_TERMS).collect()
    refuted = by_term.filter(F.col("term").isin(*SEEDS) & (F.col("clean") > 0)).withColumn("weight", weight).filter("weight < 1").collect()
    lexicon = Lexicon(_chosen([(r["term"], min(r["weight"], 8.0), r["toxic"]) for r in best]))
    for word in sorted(set(SEEDS) - {r["term"] for r in refuted}):
        if not any(t in lexicon.weights for t in terms(word)):
            lexicon.weights[word] = SEED_WEIGHT
    lexicon.exceptions = frozenset(EXCEPTIONS) | _learned_exceptions(sample, lexicon)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, 0):
            x = [features(t, lexicon, automaton)[:2] for t in batch.column(0).to_pylist()]
            arrays = [pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch.column(1)]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "toxic"])

    table = sample.mapInArrow(measured, "a double, b double, toxic int").toArrow()  # three numbers per sampled document
    x = np.column_stack([table["a"].to_numpy(), table["b"].to_numpy()])
    lexicon.curve = tuple(_logistic(x, table["toxic"].to_numpy().astype(float)))
    return lexicon


def _learned_exceptions(sample: DataFrame, lexicon: Lexicon) -> frozenset[tuple[str, str]]:
    """Pairs of neighbouring words around a term in several clean documents and in no toxic one."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(batches, 0):
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                folded, seen = fold(text), set()
                for _, _, begin in match(folded, lexicon, automaton):
                    here = _WORD.match(folded, begin)
                    after = _WORD.search(folded, here.end(), here.end() + 40)
                    before = _WORD.findall(folded[max(0, begin - 40) : begin])
                    seen |= {(here[0], after[0])} if after else set()
                    seen |= {(before[-1], here[0])} if before else set()
                out += [(a, b, toxic) for a, b in seen]
            columns = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)], names=["a", "b", "toxic"])

    found = sample.mapInArrow(pairs, "a string, b string, toxic int").groupBy("a", "b").agg(F.count("*").alias("n"), F.max("toxic").alias("toxic"))
    rows = found.filter((F.col("n") >= MIN_EXCEPTION) & (F.col("toxic") == 0)).orderBy(F.desc("n"), "a", "b").limit(MAX_TERMS).collect()
    return frozenset((r["a"], r["b"]) for r in rows)


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels must not be learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def score_toxicity(docs: DataFrame, lexicon: Lexicon, matches: bool = True) -> DataFrame:
    """``docs`` with toxicity (0 to 1) and, unless they are not asked for, toxic_matches (term, weight, position in the folded text)."""
    kept = docs.drop("toxicity", "toxic_matches")
    names, at = kept.columns, kept.columns.index("text")
    held = kept.sparkSession.sparkContext.broadcast(lexicon)  # at most MAX_TERMS terms and exceptions
    kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64()), ("at", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = held.value
        automaton = lexicon.automaton()
        for batch in slices(batches, at):
            scores, found = zip(*(scored(text, lexicon, automaton) for text in batch.column(at).to_pylist()), strict=True)
            made = [pa.array(scores, pa.float64())]
            if matches:
                made.append(pa.array([[{"term": t, "weight": w, "at": p} for t, w, p in x] for x in found], kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*names, "toxicity", "toxic_matches"][: len(names) + len(made)])

    more = ["cast(null as array<struct<term:string,weight:double,at:int>>) toxic_matches"] if matches else []
    schema = kept.limit(0).selectExpr("*", "cast(null as double) toxicity", *more).schema
    return kept.mapInArrow(run, schema)
