"""Null ids, repeated rows, clashing columns and texts of 20 MB, for operators whose other tests lack them."""

import time

from pyspark.sql import functions as F

from meterlake.llm import language, ngram_join, packing, spotsigs, toxicity, url_filter
from meterlake.llm.queries import tokenizer_ranks


def clashing(df, *names):
    return df.select("*", *(F.lit("clash").alias(n) for n in names))


def test_urls_with_clashing_columns(spark):
    rows = [(1, "http://a.example.com/x", "2024-03-01"), (1, "http://a.example.com/x", "2024-03-01"), (None, "http://example.org/", "2024-07-02"), (2, None, "2024-03-01"), (3, "http://b.example.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched_on string")
    entries = spark.createDataFrame([("l", "example.org", "2024-07-01", "add"), ("l", "a.example.com", "2024-02-01", "add"), (None, "x", "2024-01-01", "add"), ("l", "b.example.org", None, "add")], "list string, domain string, day string, action string")
    names = ("host", "domain", "lists", "start", "until", "blocked", "n_lists")
    got = url_filter.filter_urls(clashing(pages, *names), clashing(entries, "start", "until", "on", "was", "host"))
    assert sorted(((r.page_id, r.host, r.lists, r.domain, r.blocked) for r in got.collect()), key=repr) == sorted(
        [(1, "a.example.com", "l", "a.example.com", True), (1, "a.example.com", "l", "a.example.com", True), (None, "example.org", "l", "example.org", True), (2, None, "", None, False), (3, "b.example.org", "", None, False)], key=repr
    )


def test_a_listed_domain_of_very_many_hosts(spark):
    """A third of all hosts below one listed domain, in parts: the same as each host alone."""
    rows = [(k, f"http://h{k}.hosting.example/x" if k % 3 == 0 else f"http://h{k}.example.net/", "2024-03-01") for k in range(4000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, fetched_on string")
    entries = spark.createDataFrame([("spam", "hosting.example", "2024-02-01", "add"), ("spam", "h9.hosting.example", "2024-02-01", "add")], "list string, domain string, day string, action string")
    got = {r.page_id: (r.blocked, r.domain) for r in url_filter.filter_urls(pages, entries).collect()}
    assert got == {k: (k % 3 == 0, "h9.hosting.example" if k == 9 else "hosting.example" if k % 3 == 0 else None) for k in range(4000)}


def test_toxicity_of_odd_rows(spark):
    lexicon = toxicity.Lexicon({"idiot": 5.0}, frozenset(), (-3.0, 2.0, 0.5))
    rows = [(None, "an idiot"), (None, None), (1, "fine"), (1, "fine"), (1, "idiot"), (2, ""), (3, "idiot " * 3)]
    names = ("toxicity", "toxic_matches", "term", "weight", "at", "toxic")
    got = toxicity.score_toxicity(clashing(spark.createDataFrame(rows, "doc_id long, text string"), *names), lexicon)
    found = sorted(((r.doc_id, r.text, r.toxicity > 0.5, len(r.toxic_matches), r.term) for r in got.collect()), key=repr)
    assert found == sorted([(d, t, "idiot" in (t or ""), (t or "").count("idiot"), "clash") for d, t in rows], key=repr)
    alone = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), lexicon, matches=False)
    assert alone.columns == ["doc_id", "text", "toxicity"] and sorted(r.toxicity for r in alone.collect()) == sorted(r.toxicity for r in got.collect())
    labels = spark.createDataFrame([(None, 1), (1, None), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels) == toxicity.Lexicon()


def test_languages_of_odd_rows(spark):
    train = [(k, "der und die das ist nicht", "de") for k in range(20)] + [(k, "the and of that is not", "en") for k in range(20, 40)] + [(40, None, "en"), (41, "x", None)]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    rows = [(None, "that is the"), (None, None), (1, "die und das"), (1, "die und das"), (1, "that is not the"), (2, "12 !"), (3, "")]
    names = ("lang_pred", "lang_score", "lang_spans", "lo", "hi", "lang", "script")
    got = language.identify(clashing(spark.createDataFrame(rows, "doc_id long, text string"), *names), model)
    want = {"that is the": "en", "die und das": "de", "that is not the": "en"}
    assert sorted(((r.doc_id, r.text, r.lang_pred, r.lo) for r in got.collect()), key=repr) == sorted([(d, t, want.get(t, "und"), "clash") for d, t in rows], key=repr)


def test_features_against_plain_counts():
    """Letter n-grams per word and the first letter's script, one at a time; words are runs of letters."""
    text = "Ab ÉTÉ,  x1y\nΣΟΦΟΣ — 日本 i̇ \U00010437z"
    words = language.Words([text, "", "q"])
    lower = f" {text.lower()}  "
    runs, at = [], 0
    while at < len(lower):
        end = at
        while end < len(lower) and lower[end].isalpha():
            end += 1
        if end > at:
            runs.append(lower[at:end])
        at = max(end, at + 1)
    assert words.size.tolist() == [len(r) for r in runs] + [1] and words.until.tolist() == [len(runs), len(runs), len(runs) + 1]
    names = [language._NAMES[k] for k in words.script]
    assert names[:4] == ["latin", "latin", "latin", "latin"] and "greek" in names and "han" in names
    mask = (1 << 64) - 1
    three, two = [], []
    for r in [*runs, "q"]:
        codes = [32, *map(ord, r), 32]
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            three.append((((a * 0x9E3779B97F4A7C15) ^ (b * 0xC2B2AE3D27D4EB4F) ^ (c * 0x165667B19E3779F9)) & mask) * 0xD6E8FEB86659FD93 % (1 << 64) >> 49)
            two.append((((b * 0xA0761D6478BD642F) ^ (c * 0xE7037ED1A0B428DB)) & mask) * 0x8EBC6AF09C88C6E3 % (1 << 64) >> 49)
    assert words.features[0].tolist() == three and words.features[1].tolist() == two


def test_lexicon_against_plain_counts(spark):
    """The terms that are chosen, with their weights, from documents of which half are toxic: a plain count of documents and contexts."""
    import math
    import random
    import re
    from collections import defaultdict

    rng = random.Random(21)
    plain = [f"wort{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    rows = []
    for k in range(400):
        words = [rng.choice(plain) for _ in range(25)]
        if k % 4 == 0:
            words[rng.randrange(25)], words[rng.randrange(25)] = rng.choice(["grobian", "grobiane", "lump"]), "schurke"
        rows.append((k, " ".join(words), int(k % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    seen, contexts = defaultdict(lambda: [0, 0]), defaultdict(set)
    for _, text, toxic in rows:
        words = ["", *re.findall(r"[^\W\d_]+", toxicity.fold(text)), ""]
        for t in {t for w in words[1:-1] for t in toxicity.terms(w)}:
            seen[t][toxic] += 1
        if toxic:
            for i in range(1, len(words) - 1):
                for t in toxicity.terms(words[i]):
                    contexts[t].add((words[i - 1], words[i + 1]))
    totals = [sum(r[2] == k for r in rows) for k in (0, 1)]
    least = max(4, round(toxicity.MIN_SHARE * totals[1]))
    weight = {t: math.log((b + 0.5) / (totals[1] + 1)) - math.log((a + 0.5) / (totals[0] + 1)) for t, (a, b) in seen.items()}
    good = [(t, min(weight[t], 8.0), seen[t][1]) for t in seen if len(contexts[t]) >= least and seen[t][1] >= least and weight[t] >= toxicity.MIN_WEIGHT]
    want = toxicity._chosen(good)
    learned = {t: w for t, w in lexicon.weights.items() if w != toxicity.SEED_WEIGHT}
    assert learned.keys() == want.keys() and all(math.isclose(learned[t], w) for t, w in want.items())
    assert any(t.startswith("schur") for t in want) and any(t.startswith("grob") for t in want)


def test_texts_of_twenty_megabytes(spark):
    """One text of four million words beside short ones, in every operator that reads texts in Python; results are those of its parts."""
    words = " ".join(f"word{k % 997} and the" for k in range(1000))
    texts = [words + " " + words.replace("and", "und"), (words + "\n") * 1200, "short one", None]
    assert len(texts[1]) > 15_000_000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).cache()
    begin = time.time()
    prints = {r.doc_id: r for r in spotsigs.spotsigs(docs).collect()}
    assert prints[1].n_chars == len(texts[1]) and spotsigs.parse(prints[1].fingerprint) >= spotsigs.signatures(words) - spotsigs.signatures("the")
    sets = {r.doc_id: r.n_shingles for r in ngram_join.link_shingles(docs).collect()}
    tokens = texts[1].lower().split()
    assert sets[1] == len(set(zip(*(tokens[k:] for k in range(5)), strict=False)))
    lexicon = toxicity.Lexicon({"word5": 1.0, "und": 2.0}, frozenset(), (-3.0, 1.0, 0.5))
    assert {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, lexicon, matches=False).collect()}.keys() == {0, 1, 2, 3}
    model = language.fit(spark.createDataFrame([("und der die", "de"), ("and the of", "en")] * 5, "text string, lang string"))
    assert {r.doc_id: r.lang_pred for r in language.identify(docs, model).drop("lang_spans").collect()}[1] == "en"
    pieces = packing.token_pieces(docs, tokenizer_ranks()).filter("doc_id = 1").agg(F.sum("length")).first()[0]
    assert pieces == len(packing.encode(texts[1], packing.encoder(tokenizer_ranks()))) + 1
    assert time.time() - begin < 300
