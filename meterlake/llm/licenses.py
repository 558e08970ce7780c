"""License scans: ordered signature rules over normalised words.

Hundreds of regular expressions are built from the families and templates below. A document is
looked at closely only if a gate of keywords matches, a family's rules run only if the document holds one
of its keywords and then one of its names. Every match is an interval of words with a priority. An interval that lies within
one of better priority (or an equal interval of an earlier rule) is suppressed, so "gpl version 3"
inside a full notice reports the notice alone. All of it is one projection of built-in functions.

Defined cases
* null or empty text: 0 words, no place, null positions, empty labels, score 0.
* null ids and repeated rows: each row is scanned on its own; columns named like results are replaced.
* texts of any length with any number of places: the work grows in proportion to words and places.
* ties: of equal intervals and priorities the earlier rule reports.
* empty table: an empty result.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

# The base phrases and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, keywords of which one must occur as a word, names as regular expressions over words, versions)
FAMILIES = (
    ("gpl", "general", ("(?:gnu )?general public licen[cs]e",), ("1", "2", "3")),
    ("gpl", "gpl", ("(?:gnu )?gpl",), ("1", "2", "3")),
    ("lgpl", "lesser", ("(?:gnu )?lesser general public licen[cs]e",), ("2", "2 1", "3")),
    ("lgpl", "library", ("(?:gnu )?library general public licen[cs]e",), ("2",)),
    ("lgpl", "lgpl", ("(?:gnu )?lgpl",), ("2", "2 1", "3")),
    ("agpl", "affero", ("(?:gnu )?affero general public licen[cs]e",), ("1", "3")),
    ("agpl", "agpl", ("(?:gnu )?agpl",), ("1", "3")),
    ("gfdl", "documentation", ("(?:gnu )?free documentation licen[cs]e",), ("1 1", "1 2", "1 3")),
    ("apache", "apache", ("apache(?: software)? licen[cs]e", "apache"), ("1", "1 1", "2", "2 0")),
    ("mit", "mit", ("mit(?: x11)? licen[cs]e", "mit"), ()),
    ("mit", "expat", ("expat licen[cs]e",), ()),
    ("bsd", "bsd", ("bsd(?: style)? licen[cs]e", "bsd"), ("2 clause", "3 clause", "4 clause")),
    ("mpl", "mozilla", ("mozilla public licen[cs]e",), ("1", "1 1", "2", "2 0")),
    ("mpl", "mpl", ("mpl",), ("1", "1 1", "2", "2 0")),
    ("epl", "eclipse", ("eclipse public licen[cs]e",), ("1", "1 0", "2", "2 0")),
    ("cddl", "cddl development", ("cddl", "common development and distribution licen[cs]e"), ("1", "1 0", "1 1")),
    ("isc", "isc", ("isc licen[cs]e",), ()),
    ("zlib", "zlib", ("zlib licen[cs]e",), ()),
    ("artistic", "artistic", ("artistic licen[cs]e",), ("1", "1 0", "2", "2 0")),
    ("bsl", "boost", ("boost software licen[cs]e",), ("1", "1 0")),
    ("eupl", "eupl european", ("eupl", "european union public licen[cs]e"), ("1 1", "1 2")),
    ("unlicense", "unlicense", ("(?:the )?unlicense",), ()),
    ("wtfpl", "wtfpl", ("wtfpl",), ("2",)),
    ("cc-by", "cc", ("cc by",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", "cc", ("cc by sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", "cc", ("cc by nc",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", "cc", ("cc by nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", "cc", ("cc by nc sa",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", "cc", ("cc by nc nd",), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc0", "cc0", ("cc0",), ("1 0",)),
    ("cc-by", "attribution", ("creative commons attribution(?: licen[cs]e)?",), ("2 0", "3 0", "4 0")),
    ("cc-by-sa", "share sharealike", ("creative commons attribution share ?alike", "creative commons attribution sharealike"), ("2 0", "3 0", "4 0")),
)
#: (priority, confidence, template); {name} and {version} are filled in. Lower priorities win.
NOTICES = ("licensed under (?:the )?(?:terms of (?:the )?)?", "released under (?:the )?(?:terms of (?:the )?)?", "distributed under (?:the )?(?:terms of (?:the )?)?", "spdx license identifier ")
JOINTS = ("", "v", "version ", "licen[cs]e ", "licen[cs]e version ")
#: Other texts that name no family: (label, keyword, pattern, priority, confidence).
TEXTS = (
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy", 1, 1.0),
    ("bsd", "redistribution", "redistribution and use in source and binary forms", 1, 1.0),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in) the public domain", 1, 0.9),
    ("public-domain", "domain", "public domain", 3, 0.5),
    ("proprietary", "reserved", "all rights reserved", 3, 0.5),
)
#: What every rule's text holds, in lower case: one of these strings or a match of the pattern.
GATE = ("licen", "spdx", "gpl", "apache", "bsd", "wtfpl", "eupl", "cddl", "redistribution", "hereby", "domain", "reserved", "creative")
GATE_WORDS = r"(?<![a-z0-9])(?:mpl|cc0?)(?![a-z0-9])|under[\W_]+(?:the[\W_]+)?(?:terms[\W_]+of[\W_]+)?(?:the[\W_]+)?mit(?![a-z0-9])"

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a raw text: as those of the lower-cased one, with A-Z among the letters. (A class of what
#: is in, possessive: Java runs it several times faster than the negated class.)
WORD = r"[A-Za-z0-9\x80-\x{10FFFF}]++"

#: Marks around a match; no word holds them.
BEGIN, END = "\x01", "\x02"
INTERVAL = "struct<lo:bigint,back:bigint,priority:int,rule:int,hi:bigint,score:double,label:string>"
TABLE = "array<struct<keywords:array<string>,probe:string,rules:array<struct<rule:int,pattern:string,priority:int,score:double,label:string>>>>"
CHUNK = 128

Rule = tuple[int, str, int, float, str]


def families() -> list[tuple[str, str, list[Rule]]]:
    """(keywords, probe, rules) in order; a rule is (order, pattern, priority, confidence, label)."""
    out, order = [], 0
    for label, keyword, names, versions in FAMILIES:
        found: list[tuple[str, int, float, str]] = []
        probes = []
        for name in names:
            bare = "licen" in name or " " in name or name not in ("apache", "mit", "bsd")
            probes.append(name if bare or versions else f"(?:under|of|the|identifier) {name}")
            for version in versions:
                tag = version.replace(" clause", "-clause").replace(" ", ".")
                tag = tag if "." in tag or "clause" in tag else f"{tag}.0"
                joined = "|".join(f"{j}{version}" for j in JOINTS)
                for notice in NOTICES:
                    found.append((f"{notice}{name} (?:{joined})", 1, 1.0, f"{label}-{tag}"))
                found.append((f"{name} (?:{joined})(?: or (?:any )?later(?: version)?)?", 2, 0.9, f"{label}-{tag}"))
            for notice in NOTICES:
                found.append((f"{notice}{name}", 2, 0.9, label))
            if bare:
                found.append((name, 3, 0.7, label))
        out.append((keyword, "|".join(probes), [(order + i, *r) for i, r in enumerate(found)]))
        order += len(found)
    for label, keyword, pattern, priority, score in TEXTS:
        out.append((keyword, pattern, [(order, pattern, priority, score, label)]))
        order += 1
    return out


def rules() -> list[Rule]:
    return [r for _, _, own in families() for r in own]


def _table() -> list[dict]:
    fields = ("rule", "pattern", "priority", "score", "label")
    return [
        {"keywords": [f" {x} " for x in k.split()], "probe": f" (?:{p})(?= )", "rules": [dict(zip(fields, r, strict=True)) for r in own]}
        for k, p, own in families()
    ]


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _words_before(norm: Column, at: Column) -> Column:
    """Words of ' w0 w1 ... ' that begin before the code point ``at`` (1: the first blank)."""
    head = F.substring(norm, F.lit(1), at)
    return (F.char_length(head) - F.char_length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")


def _matches(norm: Column, rule: Column) -> Column:
    """Intervals of one rule: (lo, back, priority, rule, hi, score, label) in words, hi exclusive and back its negative.

    The places are marked in the text, so that all of them are found in one walk over its words.
    """
    pattern = F.concat(F.lit("(?<= )(?:"), rule["pattern"], F.lit(")(?= )"))

    def found(marked: Column) -> Column:
        words = F.split(F.trim(marked), " ", -1)
        return F.when(F.contains(marked, F.lit(BEGIN)), _bind(words, intervals))

    def intervals(words: Column) -> Column:
        begins = F.array_compact(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(BEGIN)), i.cast("long"))))
        ends = F.array_compact(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(END)), i.cast("long") + 1)))

        def one(lo: Column, ends: Column, k: Column) -> Column:
            hi = F.get(ends, k)
            return F.struct(
                lo.alias("lo"), (-hi).alias("back"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), hi.alias("hi"),
                rule["score"].alias("score"), rule["label"].alias("label"),
            )

        return _bind(ends, lambda e: F.transform(begins, lambda lo, k: one(lo, e, k)))

    return _bind(F.regexp_replace(norm, pattern, F.lit(f"{BEGIN}$0{END}")), found)


def _kept(intervals: Column) -> Column:
    """Without those inside an interval of better priority, and later ones of equal intervals.

    In order of place, longest first, then priority and rule, whatever suppresses an interval stands
    before it. The order is cut into chunks: the furthest ends of earlier chunks, by priority, decide
    together with the intervals before it in its own chunk.
    """

    def furthest(chunk: Column) -> Column:
        def end(priority: int) -> Column:
            own = F.transform(chunk, lambda x: F.when(x["priority"] <= priority, x["hi"]))
            return F.coalesce(F.array_max(own), F.lit(0).cast("long"))

        return F.array(*map(end, (1, 2, 3)))

    def decided(chunk: Column, before: Column) -> Column:
        def open_(a: Column, j: Column) -> Column:
            near = F.exists(F.slice(chunk, F.lit(1), j), lambda b: (b["priority"] <= a["priority"]) & (b["hi"] >= a["hi"]))
            return (F.get(before, a["priority"] - 1) < a["hi"]) & ~near

        return F.filter(chunk, open_)

    def walk(ordered: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(ordered), F.lit(1)), F.lit(CHUNK))
        return _bind(F.transform(starts, lambda at: F.slice(ordered, at, F.lit(CHUNK))), lambda chunks: _bind(F.transform(chunks, furthest), lambda ends: joined(chunks, ends)))

    def joined(chunks: Column, ends: Column) -> Column:
        none = F.array(*[F.lit(0).cast("long")] * 3)
        # one walk gives the furthest ends before each chunk
        begun = F.struct(F.array().cast("array<array<bigint>>").alias("seen"), none.alias("now"))
        walked = F.aggregate(
            ends, begun, lambda m, e: F.struct(F.array_append(m["seen"], m["now"]).alias("seen"), F.zip_with(m["now"], e, lambda a, b: F.greatest(a, b)).alias("now")), lambda m: m["seen"]
        )
        return _bind(walked, lambda before: F.flatten(F.zip_with(chunks, before, decided)))

    kept = _bind(F.array_sort(intervals), walk)
    return F.transform(kept, lambda x: F.struct(*[x[c].alias(c) for c in ("rule", "priority", "score", "label", "lo", "hi")]))


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score and ``licenses``.

    ``licenses`` lists the intervals that remain after suppression by place: rule, priority, score, label, lo, hi.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    made = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "licenses"]
    table = F.from_json(F.lit(json.dumps(_table())), TABLE)
    out = docs.drop(*made).withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long"))
    out = out.withColumn("__lower", F.lower(text))
    gate = F.col("__lower").rlike(GATE_WORDS)
    for key in reversed(GATE):
        gate = F.contains(F.col("__lower"), F.lit(key)) | gate
    clean = F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), BREAK, " ")), F.lit(" "))
    out = out.withColumn("__norm", F.when(gate, clean)).drop("__lower")
    norm = F.col("__norm")
    places, firsts, lasts, names = [], [], [], []
    for phrase, label in BASE:
        n = F.regexp_count(norm, F.lit(f"(?<= ){phrase}(?= )"))
        places.append(F.coalesce(n, F.lit(0)))
        firsts.append(F.when(n > 0, _words_before(norm, F.instr(norm, f" {phrase} "))))
        back = F.char_length(norm) - F.instr(F.reverse(norm), f" {phrase[::-1]} ") - len(phrase)
        lasts.append(F.when(n > 0, _words_before(norm, back)))
        names.append(F.when(n > 0, F.lit(label)))
    there = F.filter(table, lambda f: F.exists(f["keywords"], lambda k: F.contains(norm, k)) & F.rlike(norm, f["probe"]))
    found = F.flatten(F.array_compact(F.transform(F.flatten(F.transform(there, lambda f: f["rules"])), lambda r: _matches(norm, r))))
    none = F.array().cast("array<struct<rule:int,priority:int,score:double,label:string,lo:bigint,hi:bigint>>")
    out = out.withColumn("licenses", F.when(norm.isNull(), none).otherwise(_bind(found, _kept)))
    base = F.array_sort(F.array_compact(F.array(*names)))
    out = out.withColumns({
        "n_base": sum(places[1:], places[0]).cast("long"),
        "first_word": F.when(norm.isNotNull(), F.least(*firsts)),
        "last_word": F.when(norm.isNotNull(), F.greatest(*lasts)),
        "__base": base,
    })
    labels = F.array_sort(F.array_distinct(F.concat("__base", F.transform("licenses", lambda x: x["label"]))))
    score = F.aggregate("licenses", F.when(F.size("__base") > 0, F.lit(0.7)).otherwise(F.lit(0.0)), lambda a, x: F.greatest(a, x["score"]))
    return out.withColumns({"base_labels": F.array_join("__base", ","), "labels": F.array_join(labels, ","), "score": score}).drop("__norm", "__base")
