"""The registered queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm import archives, decontaminate, hard_negatives, language_model, licenses, merkle, mixing, order_minhash, quality, secrets, simhash, url_filter, wrappers
from tablelens.llm.common import read_table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_table(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.pages_table(read_table(spark, sf_dir, "pages"))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.language_table(read_table(spark, sf_dir, "documents"))


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_table(read_table(spark, sf_dir, "pages"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_table(read_table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_table(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.duplicates_table(read_table(spark, sf_dir, "documents"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_table(read_table(spark, sf_dir, "pages"))


def op10_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints_table(read_table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all anchors against all vectors."""
    return hard_negatives.negatives_table(read_table(spark, sf_dir, "embeddings"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and verified proofs of all documents."""
    return merkle.manifest_table(read_table(spark, sf_dir, "documents"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases and licence labels of all documents."""
    return licenses.license_table(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_quality_classifier, op3_html_extraction, op4_language_model, op5_warc_archives,
        op6_source_mixing, op7_decontamination, op8_simhash_dedup, op9_url_filter, op10_order_minhash, op11_hard_negatives, op12_merkle_manifest, op13_license_scan,
    )
}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_POSTINGS = ", ".join(f"({t}, '{w}', {i}, {str(m).lower()})" for t, w, i, m in licenses.postings())
_TEMPLATES = ", ".join(f"({t}, '{x.label}', {len(x.text.split())})" for t, x in enumerate(licenses.TEMPLATES))
_FUNCTION_WORDS = ", ".join(f"'{w}'" for w in licenses.FUNCTION_WORDS)
_BASE_PLACES = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM spread WHERE w[i : i + {len(p.split()) - 1}] = {p.split()!r}" for p, label in licenses.BASE
)


def _field(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(strlen({text}) || ':' || {text}, '-')"


_LEAF = "sha256(" + " || ".join(_field(c) for c in merkle.FIELDS) + ")"
_TAMPERED = "sha256(" + " || ".join(_field("replace(text, chr(10), '')" if c == "text" else c) for c in merkle.FIELDS) + ")"

CHECKS: dict[str, str] = {
    "op11_hard_negatives": """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
                  CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
           FROM r a JOIN r b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
     n AS (SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                  vec_id AS negative_id, positive_score, score AS negative_score
           FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10""",
    "op12_merkle_manifest": f"""
WITH RECURSIVE
     bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
              lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
     sums AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
              lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS crc FROM documents, bits),
     leaves AS (SELECT doc_id, source, {_LEAF} AS leaf, CASE WHEN crc % 2 = 0 THEN {_TAMPERED} ELSE {_LEAF} END AS kept,
                       dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree,
                       row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx
                FROM documents JOIN sums USING (doc_id)),
     up AS (SELECT tree, 0 AS lvl, idx, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM leaves
            UNION ALL
            SELECT tree, lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (max(n) + 2) // 3 FROM up WHERE n > 1 GROUP BY tree, lvl, idx // 3),
     top AS (SELECT 0 AS lvl, tree AS idx, d, count(*) OVER () AS n FROM up WHERE n = 1
             UNION ALL
             SELECT lvl + 1, idx // 3, sha256(string_agg(d, '' ORDER BY idx)), (max(n) + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3),
     height AS (SELECT tree, max(lvl) AS h, max(d) FILTER (n = 1) AS subroot FROM up GROUP BY tree),
     step AS (SELECT doc_id, lvl AS k, coalesce(string_agg(d, '' ORDER BY up.idx) FILTER (up.idx < l.idx // CAST(pow(3, lvl) AS BIGINT)), '') AS before,
                     coalesce(string_agg(d, '' ORDER BY up.idx) FILTER (up.idx > l.idx // CAST(pow(3, lvl) AS BIGINT)), '') AS after
              FROM leaves l JOIN up ON up.tree = l.tree AND n > 1 AND up.idx // 3 = l.idx // CAST(pow(3, lvl + 1) AS BIGINT) GROUP BY doc_id, lvl
              UNION ALL
              SELECT doc_id, h + top.lvl, coalesce(string_agg(d, '' ORDER BY top.idx) FILTER (top.idx < l.tree // CAST(pow(3, top.lvl) AS BIGINT)), ''),
                     coalesce(string_agg(d, '' ORDER BY top.idx) FILTER (top.idx > l.tree // CAST(pow(3, top.lvl) AS BIGINT)), '')
              FROM leaves l JOIN height USING (tree) JOIN top ON n > 1 AND top.idx // 3 = l.tree // CAST(pow(3, top.lvl + 1) AS BIGINT) GROUP BY doc_id, h, top.lvl),
     folded AS (SELECT doc_id, 0 AS k, kept AS d FROM leaves
                UNION ALL SELECT f.doc_id, f.k + 1, sha256(before || f.d || after) FROM folded f JOIN step s ON s.doc_id = f.doc_id AND s.k = f.k),
     ends AS (SELECT doc_id, arg_max(d, k) AS folded_root FROM folded GROUP BY doc_id),
     proofs AS (SELECT doc_id, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM step GROUP BY doc_id),
     whole AS (SELECT d AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN height USING (tree) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id), whole""",
    "op13_license_scan": f"""
WITH posts(t, word, spot, must) AS (VALUES {_POSTINGS}), sizes(t, label, size) AS (VALUES {_TEMPLATES}),
     d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
     spread AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
     base AS ({_BASE_PLACES}),
     hits AS (SELECT doc_id, i - 1 AS place, w[i] AS word FROM spread WHERE w[i] IN (SELECT word FROM posts)),
     df AS (SELECT word, count(DISTINCT doc_id) AS n FROM hits GROUP BY word),
     rare AS (SELECT doc_id, word FROM (SELECT DISTINCT doc_id, word FROM hits WHERE word NOT IN ({_FUNCTION_WORDS})) JOIN df USING (word)
              QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n, word) <= {licenses.RARE}),
     votes AS (SELECT doc_id, t, place - spot AS start FROM hits JOIN rare USING (doc_id, word) JOIN posts USING (word) GROUP BY ALL HAVING count(*) >= {licenses.VOTES}),
     met AS (SELECT v.doc_id, v.t, v.start, count(*) AS n, count(*) FILTER (must) AS m
             FROM votes v JOIN posts p ON p.t = v.t JOIN hits h ON h.doc_id = v.doc_id AND h.place = v.start + p.spot AND h.word = p.word GROUP BY ALL),
     shares AS (SELECT doc_id, label, n / size AS share, m = (SELECT count(*) FROM posts p WHERE p.t = met.t AND must) AS whole FROM met JOIN sizes USING (t)),
     marks AS (SELECT doc_id, max(share) AS share FROM shares GROUP BY doc_id),
     every AS (SELECT doc_id, label FROM base UNION SELECT doc_id, label FROM shares WHERE whole AND share >= {licenses.SHARE}),
     said AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM every GROUP BY doc_id),
     b AS (SELECT doc_id, count(*) AS n, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels,
       coalesce(said.labels, '') AS labels, CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0::DOUBLE) END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN said USING (doc_id) LEFT JOIN marks USING (doc_id)""",
    "op5_warc_archives": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
     r AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS payload_digest,
                  max(page_id) OVER (PARTITION BY html) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> keeper THEN keeper END AS refers_to
FROM r""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, coalesce({_WORDS}, []) AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS said
            FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
     lens AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS said
            FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
     hits AS (SELECT doc_id, item, i, dw.n FROM dw JOIN bw ON dw.said = bw.said AND dw.n = bw.n),
     spots AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
     items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS said FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(said, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN spots USING (doc_id) LEFT JOIN items USING (doc_id)""",
}
