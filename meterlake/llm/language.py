"""Language identification with spans.

Letters are split into words; the script of a word (by ranges of code points) narrows its candidate
languages; hashed letter trigrams and bigrams give a score per word and language; Viterbi with a
switching penalty labels the words, so that a text of several languages falls into spans. A text
whose best language cannot be left with a gain is recognised without the full pass: if no stretch of
words gains more than the penalty, the best path stays in one language (the result is the same).

The model is fitted on at most about SAMPLE_PER_LANG different whole training documents per language; counts are
summed by Spark into BUCKETS features per language.

Defined cases
* null text or one without a letter: 'und', score 0, no spans.
* training rows without text or language are left out; null ids belong to the training part.
* texts of any length: scored in pieces, labelled as a whole.
* repeated rows: labelled alike, each on its own. Ties between languages go to the first by name.
* no training rows: everything with a letter is 'und'.
* empty table: an empty result. Extra columns pass through; those named like results are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, slices

UND = "und"
BUCKETS = 1 << 15
SAMPLE_PER_LANG = 1500
#: Languages with whole tables; of twice as many the tables have half the buckets, and so on up to MOST_LANGS.
MAX_LANGS, MOST_LANGS = 512, 16_384
PENALTY = 20.0
CLIP = 6.0
#: Longer texts are scored in pieces of about so many code points.
PIECE_CHARS = 1 << 18
#: Bytes of a long text's scores that are kept between the walks over its pieces.
HELD_BYTES = 64 << 20

#: First code points of scripts, in order; a code point belongs to the last range that begins at or before it.
SCRIPTS = (
    (0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
    (0x1200, "ethiopic"), (0x1380, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"),
    (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"),
    (0xFB13, "other"), (0xFF21, "latin"), (0xFF66, "kana"), (0x10000, "other"), (0x20000, "han"), (0x30000, "other"),
)
_NAMES = sorted({name for _, name in SCRIPTS})


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(maxsize=1)
def _ranges() -> tuple[np.ndarray, np.ndarray]:
    return np.array([x for x, _ in SCRIPTS], dtype=np.uint32), np.array([_NAMES.index(n) for _, n in SCRIPTS], dtype=np.int64)


class Words:
    """The words of several texts: features of their letters, and where words and texts begin."""

    def __init__(self, texts: list[str]):
        lower = [f"{t.lower()} " for t in texts]
        codes = np.frombuffer(" ".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _letters()[codes]
        at = np.flatnonzero(letter)
        plain = np.where(letter, codes, 32).astype(np.uint64)
        before, here, after = plain[at - 1], plain[at], plain[at + 1]
        three = (before * np.uint64(0x9E3779B97F4A7C15) ^ here * np.uint64(0xC2B2AE3D27D4EB4F) ^ after * np.uint64(0x165667B19E3779F9)) * np.uint64(0xD6E8FEB86659FD93)
        two = (here * np.uint64(0xA0761D6478BD642F) ^ after * np.uint64(0xE7037ED1A0B428DB)) * np.uint64(0x8EBC6AF09C88C6E3)
        self.features = ((three >> np.uint64(49)).astype(np.int64), (two >> np.uint64(49)).astype(np.int64))
        first = np.flatnonzero(~letter[at - 1]) if len(at) else np.zeros(0, dtype=np.int64)
        self.first = first  # of each word, an index of letters
        self.size = np.diff(np.append(first, len(at)))
        starts, scripts = _ranges()
        self.script = scripts[np.searchsorted(starts, here[first].astype(np.uint32), side="right") - 1]
        ends = np.cumsum([len(t) + 1 for t in lower])  # in codes, after the leading blank
        self.until = np.searchsorted(at[first], ends) if len(at) else np.zeros(len(texts), dtype=np.int64)

    def scores(self, model: Model) -> np.ndarray:
        """(words, languages)"""
        if not len(self.first):
            return np.zeros((0, len(model.langs)))
        letters = model.table[self.features[0] >> model.shift] + model.table[self.features[1] >> model.shift]
        words = np.clip(np.add.reduceat(letters, self.first, axis=0), -CLIP, CLIP)
        allowed = model.allowed[self.script]
        return np.where(allowed | ~allowed.any(axis=1, keepdims=True), np.where(allowed.any(axis=1, keepdims=True), words, 0), -CLIP)


def shift(langs: int) -> int:
    """Bits that a feature loses so that a model of very many languages stays as large as one of MAX_LANGS."""
    return max(0, (langs - 1) // MAX_LANGS).bit_length()


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        """counts: (languages, buckets); scripts: (languages, scripts) words."""
        self.langs, self.shift, buckets = langs, shift(len(langs)), counts.shape[1]
        logs = np.log((counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets)) if langs else np.zeros((0, buckets))
        self.table = np.ascontiguousarray((logs - logs.mean(axis=0, keepdims=True)).T / 2) if langs else np.zeros((buckets, 0))
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.allowed = (share >= 0.001).T


def _leaves(blocks: Iterable[np.ndarray], best: int, penalty: float) -> bool:
    """Whether some stretch of words gains as much as the penalty by another language than ``best``."""
    gain: np.ndarray | float = 0.0
    low: np.ndarray | None = None
    for part in blocks:
        if not len(part):
            continue
        low = np.zeros((1, part.shape[1])) if low is None else low
        gains = np.cumsum(part - part[:, [best]], axis=0) + gain
        lows = np.minimum.accumulate(np.vstack([low, gains]), axis=0)
        if (gains - lows[1:]).max() >= penalty:
            return True
        gain, low = gains[-1:], lows[-1:]
    return False


def _forward(scores: np.ndarray, value: np.ndarray | None, penalty: float, came: np.ndarray) -> np.ndarray | None:
    """The best values after the words of a block, from those before it (None: the block begins the text); ``came`` gets each word's predecessors."""
    own = np.arange(scores.shape[1])
    for i, row in enumerate(scores):
        if value is None:
            value = row.copy()
            continue
        top = int(np.argmax(value))
        stay = value >= value[top] - penalty
        came[i] = np.where(stay, own, top)
        value = np.where(stay, value, value[top] - penalty) + row
    return value


def viterbi_blocks(block: Callable[[int], np.ndarray], blocks: int, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path of a text whose scores come in blocks (as often as asked for).

    One block's scores and predecessors are held at a time, and the values at the blocks' ends.
    """
    sizes, total = [], 0
    for k in range(blocks):
        scores = block(k)
        sizes.append(len(scores))
        total = total + scores.sum(axis=0)
    best = int(np.argmax(total))
    if not _leaves((block(k) for k in range(blocks)), best, penalty):
        return np.full(sum(sizes), best, dtype=np.int16)
    values: list[np.ndarray | None] = [None]
    came = np.zeros((0, 0), dtype=np.int16)
    for k in range(blocks):
        scores = block(k)
        came = np.zeros(scores.shape, dtype=np.int16)  # of the last block in the end
        values.append(_forward(scores, values[-1], penalty, came))
    path = np.zeros(sum(sizes), dtype=np.int16)
    at, now = len(path) - 1, int(np.argmax(values[-1]))
    for k in reversed(range(blocks)):
        if k < blocks - 1:
            scores = block(k)
            came = np.zeros(scores.shape, dtype=np.int16)
            _forward(scores, values[k], penalty, came)
        for row in reversed(came.tolist()):
            path[at] = now
            at, now = at - 1, row[now]
    return path


def viterbi(scores: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of each word on the best path."""
    return viterbi_blocks(lambda _: scores, 1, penalty)


def _labelled(path: np.ndarray, sizes: np.ndarray, model: Model) -> tuple[str, float, list[dict]]:
    if not len(sizes):
        return UND, 0.0, []
    letters = np.bincount(path, weights=sizes, minlength=len(model.langs))
    best = int(np.argmax(letters))
    edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    spans = [{"lo": a, "hi": b, "lang": model.langs[path[a]]} for a, b in zip(edges, edges[1:], strict=False)]
    return model.langs[best], float(letters[best] / letters.sum()), spans


def label(texts: list[str | None], model: Model, penalty: float = PENALTY) -> list[tuple[str, float, list[dict]]]:
    """(language, its share of the letters, spans of words) of each text; a long one is scored in pieces."""
    if not model.langs:
        return [(UND, 0.0, [])] * len(texts)
    if len(texts) == 1 and len(texts[0] or "") > PIECE_CHARS:
        parts = list(pieces(texts[0], PIECE_CHARS))
        sizes: dict[int, np.ndarray] = {}
        held: dict[int, np.ndarray] = {}

        def block(k: int) -> np.ndarray:
            """Scores of a piece: as many pieces as HELD_BYTES allow are kept, others are scored again when they are asked for."""
            if k in held:
                return held[k]
            words = Words([parts[k]])
            sizes[k] = words.size
            scores = words.scores(model)
            if sum(x.nbytes for x in held.values()) + scores.nbytes <= HELD_BYTES:
                held[k] = scores
            return scores

        path = viterbi_blocks(block, len(parts), penalty)
        return [_labelled(path, np.concatenate([sizes[k] for k in range(len(parts))]), model)]
    words = Words([t or "" for t in texts])
    scores, out, lo = words.scores(model), [], 0
    for hi in words.until.tolist():
        own = scores[lo:hi]
        out.append(_labelled(viterbi(own, penalty), words.size[lo:hi], model) if hi > lo else (UND, 0.0, []))
        lo = hi
    return out


def fit(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> Model:
    """A model of ``docs`` (text, lang), from at most about ``sample_per_lang`` documents a language."""
    spark = docs.sparkSession
    known = docs.filter("text is not null and lang is not null").select("text", "lang")
    sizes = known.groupBy("lang").count().orderBy("lang").limit(MOST_LANGS + 1).collect()
    if len(sizes) > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} languages: these are no languages")
    langs = [r["lang"] for r in sizes]
    less, buckets = shift(len(langs)), BUCKETS >> shift(len(langs))
    rates = spark.createDataFrame([(r["lang"], min(1.0, sample_per_lang / r["count"])) for r in sizes], "__lang string, __rate double")
    drawn = known.join(F.broadcast(rates), F.col("lang") == F.col("__lang"))  # at most MOST_LANGS rows
    drawn = drawn.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < F.col("__rate") * (1 << 20)).select("text", "lang")
    drawn = drawn.dropDuplicates(["text", "lang"])  # copies of a text come together, and must not fill the sample

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(langs), buckets + len(_NAMES)), dtype=np.int64)
        number = {lang: k for k, lang in enumerate(langs)}
        for batch in slices(batches, 0):
            own = np.array([number[x] for x in batch.column(1).to_pylist()])
            texts = batch.column(0).to_pylist()
            for k in np.unique(own).tolist():
                mine = [t for t, x in zip(texts, own, strict=True) if x == k]
                for part in pieces(mine[0], PIECE_CHARS) if len(mine) == 1 else [None]:
                    words = Words(mine if part is None else [part])
                    for f in words.features:
                        counts[k, :buckets] += np.bincount(f >> less, minlength=buckets)
                    counts[k, buckets:] += np.bincount(words.script, minlength=len(_NAMES))
        k, f = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(f.astype(np.int32)), pa.array(counts[k, f])], names=["k", "f", "n"])

    rows = drawn.mapInArrow(count, "k int, f int, n long").groupBy("k", "f").agg(F.sum("n").alias("n"))
    table = rows.toArrow()  # at most MAX_LANGS x BUCKETS and the scripts
    counts = np.zeros((len(langs), buckets + len(_NAMES)))
    counts[table["k"].to_numpy(), table["f"].to_numpy()] = table["n"].to_numpy()
    return Model(langs, counts[:, :buckets], counts[:, buckets:])


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_spans (words lo to hi, hi exclusive)."""
    made = "lang_pred string, lang_score double, lang_spans array<struct<lo:int,hi:int,lang:string>>"
    kept = docs.drop("lang_pred", "lang_score", "lang_spans")
    held = kept.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers a language
    names = kept.columns
    at = names.index("text")
    span = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at, 256, PIECE_CHARS):
            langs, scores, spans = zip(*label(batch.column(at).to_pylist(), held.value, penalty), strict=True)
            arrays = [*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(spans, span)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, "lang_pred", "lang_score", "lang_spans"])

    schema = kept.limit(0).selectExpr("*", *(f"cast(null as {kind}) {name}" for name, kind in (x.split(" ", 1) for x in made.split(", ", 2)))).schema
    return kept.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Rows that the model must not learn from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))

