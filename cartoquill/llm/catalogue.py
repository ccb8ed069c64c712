"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import tables
from . import licenses, neighbours, quality, simhash, substrings, tiling, tokenfile, tokens, transducer, warc


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(tables.table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transducer.encode_pieces(tables.table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(tables.table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(tables.table(spark, sf_dir, "embeddings"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(tables.table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "labels"))


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(tables.table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_archive(tables.table(spark, sf_dir, "pages"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(tables.table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contaminated(tables.table(spark, sf_dir, "documents"), tables.table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_substring_dedup, op4_nearest_neighbours, op5_simhash, op6_quality, op7_token_file, op8_warc, op9_licenses, op10_decontamination)}



def _pattern(markup: str) -> str:
    """A template as a regular expression over words, each with a space behind it, that starts behind a space."""
    out = " "
    for gap, mark, word in re.findall(r"<<(\d+)>>|(\[\[|\]\])|([0-9A-Za-z]+)", markup):
        out += rf"(?:\S+ ){{0,{gap}}}" if gap else {"[[": "(?:", "]]": ")?"}.get(mark) or f"{word.lower()} "
    return out


#: DuckDB SQL of the queries that SQL can express at that size; the others are tested against brute force and round trips.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s HAVING count(DISTINCT doc_id) > 1),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE doc_id > first),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, (SELECT unnest(range(13)) AS k)),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
""",
    "op4_nearest_neighbours": """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
s AS (SELECT q.vec_id AS query_id, x.vec_id, list_inner_product(q.v, x.v) AS score FROM v q JOIN v x ON q.vec_id % 20 = 0 AND q.vec_id <> x.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20
""",
    "op9_licenses": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, ' ' || array_to_string(w, ' ') || ' ' AS j FROM d),
phrase AS (SELECT * FROM (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) AS x(p, label)),
place AS (SELECT doc_id, label, i - 1 AS i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d), phrase WHERE w[i] = p[1] AND w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, list(DISTINCT label) AS l FROM place GROUP BY doc_id),
template AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{label}', '{_pattern(markup)}')" for label, markup in licenses.TEMPLATES)
    + r""") AS x(label, r)),
hit AS (SELECT doc_id, label, j, regexp_extract(j, r) AS m FROM t, template WHERE regexp_matches(j, r)),
run AS (SELECT doc_id, label, len(regexp_extract_all(substr(j, 1, instr(j, m) - 1), '\S+')) AS a, len(regexp_extract_all(m, '\S+')) AS n FROM hit),
one AS (SELECT doc_id, label, a, a + n AS e FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY a, n DESC) = 1),
more AS (SELECT doc_id, list(label) AS l, string_agg(label || ':' || a || '-' || e, ',' ORDER BY label) AS spans FROM one GROUP BY doc_id)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(array_to_string(list_sort(base.l), ','), '') AS base_labels,
 coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.l, []), coalesce(more.l, [])))), ','), '') AS labels, CASE WHEN more.l IS NOT NULL THEN 1.0 WHEN base.l IS NOT NULL THEN 0.5 ELSE 0.0 END::DOUBLE AS score, coalesce(spans, '') AS spans
FROM t LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT page_id, html, hex, max(page_id) OVER (PARTITION BY hex) AS first FROM p),
digits AS (SELECT page_id, k, ('0x' || substr(hex, 5 * k + 1, 5))::BIGINT AS x FROM bits, (SELECT unnest(range(8)) AS k)),
digest AS (SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 15) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 10) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> 5) & 31)::INT + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (x & 31)::INT + 1, 1), '' ORDER BY k) AS d FROM digits GROUP BY page_id)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits JOIN digest USING (page_id)
""",
}
