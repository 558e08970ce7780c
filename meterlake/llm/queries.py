"""The registered queries of the training-data operators: one per operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read


def tokenizer_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import spotsigs

    return spotsigs(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer_ranks())


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import derived_entries, fetch_day, filter_urls, stated_entries

    pages = read(spark, sf_dir, "pages").select("page_id", "url", fetch_day(F.col("page_id")).alias("fetched_on"))
    return filter_urls(pages, stated_entries(spark).unionByName(derived_entries(pages)))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sizes

    return mix_sizes(read(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, held_out, score_toxicity

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").select("doc_id", "toxic")
    scored = score_toxicity(docs, fit(docs, labels.filter(~held_out())), matches=False)
    predicted = (F.col("toxicity") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), predicted)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    kept = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_cover_tree_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cover_tree import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import link_shingles

    return link_shingles(read(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fit, held_out, identify

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labelled = identify(docs.select("doc_id", "text"), fit(docs.filter(~held_out())))
    return labelled.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    return scan_licenses(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import grafted, number_turns, prefix_trie

    return prefix_trie(*grafted(number_turns(read(spark, sf_dir, "conversations")))).drop("n_ends", "n_bytes")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(read(spark, sf_dir, "documents"), tokenizer_ranks(), piece_model()).drop("n_best_a")


def op13_pii_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import scan_pii

    names = ["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    return scan_pii(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *names)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_spotsigs": op1_spotsigs,
        "op2_best_fit_packing": op2_best_fit_packing,
        "op3_url_filter": op3_url_filter,
        "op4_mix_sources": op4_mix_sources,
        "op5_toxicity": op5_toxicity,
        "op6_line_dedup": op6_line_dedup,
        "op7_cover_tree_dedup": op7_cover_tree_dedup,
        "op8_ngram_join": op8_ngram_join,
        "op9_language_id": op9_language_id,
        "op10_license_scan": op10_license_scan,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_token_alignment": op12_token_alignment,
        "op13_pii_contexts": op13_pii_contexts,
    }


#: Lines of at least 10 code points that stand in two documents stay only in the first.
OP6_SQL = r"""
WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (
    SELECT doc_id, pos, lines[pos] AS line,
        trim(translate(lines[pos], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key
    FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM docs)
),
firsts AS (SELECT key, min(doc_id) AS first FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT l.*, f.key IS NOT NULL AND l.doc_id <> f.first AS dropped FROM lines l LEFT JOIN firsts f ON l.key = f.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN dropped THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

#: Cosines of all pairs, then the smallest vector reached.
OP7_SQL = """
WITH RECURSIVE units AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM units a JOIN units b
    ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95
),
reach(u, v) AS (SELECT vec_id, vec_id FROM units UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM units JOIN least ON vec_id = least.u LEFT JOIN counts ON vec_id = counts.u
"""

#: Shared shingles of all pairs, then the smallest document reached.
OP8_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
),
grams AS (
    SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
half AS (
    SELECT s.u, s.v FROM shared s JOIN sizes a ON a.doc_id = s.u JOIN sizes b ON b.doc_id = s.v WHERE 100 * s.n >= 75 * (a.n + b.n - s.n)
),
links AS (SELECT u, v FROM half UNION ALL SELECT v, u FROM half),
reach(u, v) AS (SELECT doc_id, doc_id FROM words UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM words w JOIN least ON w.doc_id = least.u LEFT JOIN sizes USING (doc_id)
"""


#: Beginnings as lists of turns, each with all nodes below it. The CRC takes a bit at a time.
OP11_SQL = r"""
WITH own AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS depth, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL
),
bits AS (
    SELECT conv_id, list_concat([4294967295], flatten([[ord(x), 0, 0, 0, 0, 0, 0, 0] FOR x IN string_split(CAST(conv_id AS VARCHAR), '')])) AS b
    FROM (SELECT DISTINCT conv_id FROM own)
),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base,
        xor(list_reduce(b, lambda crc, e: xor(xor(crc, e) >> 1, 3988292384 * (xor(crc, e) & 1))), 4294967295) % 9 AS h
    FROM bits
),
turns AS (
    SELECT c.conv_id, 0 AS part, o.depth, role, text FROM convs c JOIN own o ON o.conv_id = c.base AND o.depth <= h
    UNION ALL SELECT c.conv_id, 1, o.depth, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.depth > h
),
rebuilt AS (SELECT c.conv_id, coalesce(t, []) AS t FROM convs c LEFT JOIN (SELECT conv_id, list({'r': role, 't': text} ORDER BY part, depth) AS t FROM turns GROUP BY conv_id) USING (conv_id)),
prefixes AS (SELECT conv_id, len(t) AS n, d AS depth, t[1:d] AS p, t[d].t AS last FROM (SELECT conv_id, t, unnest(range(0, len(t) + 1)) AS d FROM rebuilt)),
nodes AS (
    SELECT p, depth, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(max(strlen(last)), 0) AS n_bytes,
        coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
    FROM prefixes GROUP BY p, depth
),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
own_values AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.p = c.p),
below AS (
    SELECT p[1:k] AS p, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM own_values) GROUP BY 1
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM own_values n JOIN below b ON n.p = b.p LEFT JOIN nodes up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.p = n.p[1:n.depth - 1]
"""


def oracle_sql() -> dict[str, str]:
    from .url_filter import oracle

    return {"op3_url_filter": oracle(), "op6_line_dedup": OP6_SQL, "op7_cover_tree_dedup": OP7_SQL, "op8_ngram_join": OP8_SQL, "op11_prefix_trie": OP11_SQL}
