r"""Personal data by patterns of writing, and by contexts that such data teach.

What the regular expressions of four kinds find are seeds. The words around a seed, with the shape of
what stands there, are lexical patterns; every other token that looks like an identifier stands in such
contexts too. Patterns and values form a graph, which Spark scores in rounds:
* a pattern's confidence in a kind is the score of its values over their number (plus one, so that a
  few values make no certainty), and it must have values enough;
* a value's score joins the confidences of its patterns: 1 - product of (1 - confidence). Seeds keep 1.
Values found in one round support further patterns in the next. A value whose score ends high enough
is an identifier wherever it stands, unless a seed's place overlaps it.

All of it is DataFrame functions. The texts are read once and never shuffled: places come from the
pieces between matches, and only places, contexts and values go on. Expressions are possessive and
begin where a run begins, so they take time in proportion to a text. Frequent values and patterns are
spread over parts; a document's places are ordered in one task.

Defined cases
* null or empty text: no spans. Every row is a document of its own, whatever its id.
* equal places of two kinds are both given; ties of a value's best kind go to the kind listed first.
* words around a place that hold no letter, and places at a text's edge, teach nothing.
* empty table: an empty result. Other columns pass through, but those named like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, spread_join

#: What each kind's matches look like: (kind, expression, a text without this has none).
KINDS = (
    ("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    ("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", ""),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
)
NAMES = [k for k, _, _ in KINDS]
#: A token that may be an identifier: a word with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Letters and digits that an identifier has at least.
MIN_CHARS = 5
#: Code points around a place in which context words are looked for.
AROUND = 64
#: Values that a pattern needs, its least confidence, the least score of a found value, and rounds of scoring.
SUPPORT, CONFIDENCE, FOUND, ROUNDS = 3, 0.7, 0.8, 3


PLACE = "struct<kind:string,number:bigint,value:string,gap:bigint,left:string,right:string>"


def _bind(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _places(text: Column, kind: str, pattern: str) -> Column:
    """Matches from left to right: kind, number, value, the code points since the match before, and what stands on either side."""
    hits, parts = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def one(hit: Column, k: Column, parts: Column) -> Column:
        left, right = F.get(parts, k), F.get(parts, k + 1)
        return F.struct(
            F.lit(kind).alias("kind"), k.cast("long").alias("number"), hit.alias("value"), F.char_length(left).cast("long").alias("gap"),
            F.right(left, F.lit(AROUND)).alias("left"), F.left(right, F.lit(AROUND)).alias("right"),
        )

    return _bind(parts, lambda p: F.transform(hits, lambda hit, k: one(hit, k, p)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the digits, every second from the right doubled and digits of the products added, make a multiple of ten."""
    def weighed(c: Column, k: Column) -> Column:
        n = c.try_cast("int")
        return F.when(k % 2 == 0, n).otherwise(n * 2 - F.when(n > 4, 9).otherwise(0))

    each = F.transform(F.split(F.reverse(digits), ""), weighed)
    return F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes() -> Column:
    """Whether a match (kind, value) is one of its kind."""
    value, digits = F.col("value"), _digits(F.col("value"))
    n = F.length(digits)
    small = F.forall(F.split(value, r"\."), lambda x: F.rlike(x, F.lit("^0*[0-9]{1,3}$")) & (F.right(x, F.lit(3)).try_cast("int") <= 255))
    card = F.when(n.between(14, 19), _luhn(digits)).otherwise(False)
    return F.when(F.col("kind") == "ip", small).when(F.col("kind") == "card", card).when(F.col("kind") == "phone", n.between(10, 15)).otherwise(True)


def find_places(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, kind, number, value, gap, left, right) of every match and token, and a row of kind NULL with ``doc``, the other columns, per document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.array().cast(f"array<{PLACE}>")
    own = [F.when(F.contains(text, F.lit(sign)) & text.rlike("[0-9]" if kind != "email" else "@"), _places(text, kind, p)).otherwise(none) for kind, p, sign in KINDS]
    tokens = F.when(text.rlike("[0-9@]"), _places(text, "", TOKEN)).otherwise(none)
    rest = F.struct(F.lit(0).alias("__any"), *(c for c in docs.columns if c != text_col))
    each = F.concat(F.array(F.lit(None).cast(PLACE)), F.flatten(F.array(*own, tokens)))
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), rest.alias("doc"), each.alias("each"))
    rows = numbered.select("row", "doc", F.explode("each").alias("at"))
    return rows.select("row", F.when(F.col("at").isNull(), F.col("doc")).alias("doc"), "at.*")


def place(rows: DataFrame) -> DataFrame:
    """Matches with ``start`` and ``end`` in code points, those that fail their kind's test left out."""
    order = W.partitionBy("row", "kind").orderBy("number").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.char_length("value")).over(order)
    found = rows.filter("kind is not null").withColumn("end", end).withColumn("start", F.col("end") - F.char_length("value"))
    return found.filter(_passes()).select("row", "kind", "start", "end", "value", "left", "right")


def apart(found: DataFrame) -> DataFrame:
    """Without tokens that overlap a match of some kind."""
    match = F.col("kind") != ""
    by_start = W.partitionBy("row").orderBy("start", F.col("kind").desc())
    by_start_down = W.partitionBy("row").orderBy(F.col("start").desc(), "kind")
    before = F.max(F.when(match, F.col("end"))).over(by_start.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(match, F.col("start"))).over(by_start_down.rowsBetween(W.unboundedPreceding, 0))
    marked = found.withColumns({"__before": before, "__after": after})
    free = (F.coalesce("__before", F.lit(0)) <= F.col("start")) & (F.col("__after").isNull() | (F.col("__after") >= F.col("end")))
    return marked.filter(match | free).drop("__before", "__after")


def shape(value: Column) -> Column:
    """Runs of letters and of digits as one sign each, and whether there are few, some or many digits."""
    signs = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9"), r"\s+", " ")
    n = F.length(_digits(value))
    return F.concat_ws(":", F.left(signs, F.lit(AROUND)), F.when(n < 4, "few").when(n < 9, "some").otherwise("many"))


def contexts(found: DataFrame) -> DataFrame:
    """(pattern, instance, kind) of every place with words around it, each once: the graph's edges. Kind is '' for mere tokens."""
    def words(text: Column, expression: str, n: int) -> Column:
        some = [F.lower(F.regexp_replace(F.regexp_extract(text, expression, k + 1), r"[^\p{L}]", "")) for k in range(n)]
        whole = some[0] != ""
        for w in some[1:]:
            whole = whole & (w != "")
        return F.when(whole, F.concat_ws(" ", *some))

    left, right = F.col("left"), F.col("right")
    around = [("<", words(left, r"(?:^|\s)(\S+)\s*$", 1)), ("<<", words(left, r"(?:^|\s)(\S+)\s+(\S+)\s*$", 2)), (">", words(right, r"^\s*(\S+)", 1))]
    kept = F.filter(F.array(*(F.struct(F.lit(side).alias("side"), w.alias("words")) for side, w in around)), lambda x: x["words"].isNotNull())
    edges = found.filter((F.col("kind") != "") | _long()).select("kind", instance().alias("instance"), shape(_bare()).alias("__shape"), F.explode(kept).alias("__c"))
    pattern = F.xxhash64("__c.side", "__c.words", "__shape").alias("pattern")
    return edges.select(pattern, "instance", "kind", F.col("__c.side").alias("side"), F.col("__c.words").alias("words"), F.col("__shape").alias("shape")).distinct()


def _long() -> Column:
    return F.length(F.regexp_replace(F.col("value"), r"[^\p{L}0-9]", "")) >= MIN_CHARS


def _bare() -> Column:
    """A value without punctuation at its ends."""
    return F.regexp_replace(F.regexp_replace(F.col("value"), r"^[^\p{L}0-9+]+", ""), r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", "")


def instance() -> Column:
    """A bare value without case, as a digest."""
    return F.xxhash64(F.lower(_bare()))


def score(edges: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances) with their kind and score after the rounds: patterns of confidence, and all scored instances."""
    links = cut(edges.groupBy("pattern", "instance").agg(F.lit(1).alias("one")).drop("one"))
    degree = cut(links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")))
    width = cut(links.groupBy("instance").agg(F.count(F.lit(1)).alias("n")))
    seeds = cut(edges.filter("kind != ''").select("instance", "kind").distinct().withColumn("score", F.lit(1.0)))
    scored, patterns = seeds, None
    for _ in range(rounds):
        # values to patterns: a row per (instance, kinds), which a frequent value's patterns meet in parts
        own = scored.groupBy("instance").agg(F.collect_list(F.struct("kind", "score")).alias("__kinds")).join(width, "instance")
        votes = spread_join(links, cut(own), ["instance"], "n", ["pattern"]).select("pattern", F.explode("__kinds").alias("__k")).select("pattern", "__k.*")
        sums = votes.groupBy("pattern", "kind").agg(F.round(F.sum("score"), 9).alias("__sum")).join(degree, "pattern")
        sums = sums.withColumn("confidence", F.col("__sum") / (F.col("n") + 1))
        patterns = cut(sums.filter((F.col("__sum") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "kind", "confidence", "n"))
        # patterns to values
        heard = spread_join(links, patterns, ["pattern"], "n", ["instance"])
        doubt = F.exp(F.sum(F.log(1 - F.col("confidence"))))
        news = heard.groupBy("instance", "kind").agg(F.round(1 - doubt, 9).alias("score"))
        scored = cut(seeds.unionByName(news).groupBy("instance", "kind").agg(F.max("score").alias("score")))
    return patterns, scored


def found_spans(found: DataFrame, scored: DataFrame) -> DataFrame:
    """(row, kind, start, end) of tokens whose value is an identifier of a kind."""
    number = F.array_position(F.array(*map(F.lit, NAMES)), F.col("kind"))
    best = scored.filter(F.col("score") >= FOUND).groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), number)).alias("kind"))
    tokens = found.filter((F.col("kind") == "") & _long()).select("row", "start", "end", "value", instance().alias("instance"))
    often = tokens.groupBy("instance").agg(F.count(F.lit(1)).alias("n"))
    known = cut(best.join(often, "instance"))
    hits = spread_join(tokens, known, ["instance"], "n", ["row", "start"])
    # without the punctuation around a token
    lead = F.length(F.regexp_extract("value", r"^[^\p{L}0-9+]*", 0))
    tail = F.length(F.regexp_extract("value", r"(?<=[\p{L}0-9])[^\p{L}0-9]++$", 0))
    return hits.select("row", "kind", (F.col("start") + lead).alias("start"), (F.col("end") - tail).alias("end"))


def scan_pii(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The other columns of ``docs`` with n_email, n_ip, n_card, n_phone, base_sha256, spans and ``found``, the spans as structs.

    ``found`` lists (start, end, kind, base) by start and kind; base tells what the expressions found.
    """
    counts = [f"n_{k}" for k in NAMES]
    rows = cut(find_places(docs.drop(*counts, "base_sha256", "spans", "found"), text_col))
    found = cut(apart(place(rows)))
    _, scored = score(contexts(found))
    spans = found.filter("kind != ''").select("row", "kind", "start", "end", F.lit(True).alias("base"))
    spans = spans.unionByName(found_spans(found, scored).withColumn("base", F.lit(False)))
    number = F.array_position(F.array(*map(F.lit, NAMES)), F.col("kind")).cast("int")
    order = F.struct("start", number.alias("no"), "end", "kind", "base")
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(order)).alias("found"))
    out = rows.filter("kind is null").select("row", "doc").join(by_row, "row", "left")
    found_all = F.coalesce("found", F.array().cast("array<struct<start:bigint,no:int,end:bigint,kind:string,base:boolean>>"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["base"] & (x["kind"] == kind))).cast("long")

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    out = out.withColumn("found", found_all).select("doc.*", "found").drop("__any")
    base = F.filter("found", lambda x: x["base"])
    return out.withColumns({
        **{f"n_{k}": count(k) for k in NAMES},
        "base_sha256": F.sha2(text(base).cast("binary"), 256), "spans": text(F.col("found")),
        "found": F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["base"].alias("base"))),
    })
