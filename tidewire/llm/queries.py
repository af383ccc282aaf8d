"""The operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_url_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urls

    return urls.judge(_table(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.plan(_table(spark, sf_dir, "documents"))


def op5_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    return decontam.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity

    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_simhash_bitsliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.cluster(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secret_scan

    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    return suffix_dedup.remove(_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_relative_lz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rlz_dedup

    return rlz_dedup.remove(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    return pii.find(_table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_align

    return token_align.align(_table(spark, sf_dir, "documents"))


def op12_dom_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_extract

    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op13_walsh_hadamard_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_toxicity_crf, op3_url_redirects, op4_best_fit_packing, op5_quality_lines, op6_simhash_bitsliced, op7_secret_scan, op8_suffix_array, op9_relative_lz, op10_pii_bootstrap, op11_token_alignment, op12_dom_boosting, op13_walsh_hadamard_audit)}

ORACLE: dict[str, str] = {
    "op8_suffix_array": """
        WITH x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        win AS (SELECT doc_id, i, hash(substr(h, 2 * i + 1, 200)) AS s FROM x, unnest(range(0, length(h) // 2 - 99)) AS u(i)),
        first AS (SELECT s, min({'d': doc_id, 'i': i}) AS f FROM win GROUP BY s),
        hit AS (SELECT doc_id, i FROM win JOIN first USING (s) WHERE f.d < doc_id OR f.i < i),
        runs AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, -1) AS gap FROM hit),
        groups AS (SELECT doc_id, i, sum(CASE WHEN gap > 0 OR gap = i + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs),
        spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM groups GROUP BY doc_id, g),
        lists AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z, count(*) AS n, sum(z - a) AS gone FROM spans GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
            sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(0, n + 1), lambda k: substr(h, 2 * (CASE WHEN k = 0 THEN 0 ELSE z[k] END) + 1, 2 * ((CASE WHEN k = n THEN length(h) // 2 ELSE a[k + 1] END) - (CASE WHEN k = 0 THEN 0 ELSE z[k] END)))), '') END)) AS kept_sha256
        FROM x LEFT JOIN lists USING (doc_id)
    """,
    "op9_relative_lz": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM t, unnest(range(1, len(w) - 11)) AS u(i)),
        first AS (SELECT s, min(doc_id) AS f FROM win GROUP BY s),
        gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN first USING (s), unnest(range(0, 13)) AS v(k) WHERE f < doc_id),
        words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM t)
        SELECT t.doc_id, count(x.p) AS n_words, count(g.p) AS n_removed, sha256(coalesce(string_agg(x.x, ' ' ORDER BY x.p) FILTER (WHERE g.p IS NULL), '')) AS kept_sha256
        FROM t LEFT JOIN words x ON x.doc_id = t.doc_id LEFT JOIN gone g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY t.doc_id
    """,
    "op13_walsh_hadamard_audit": r"""
        WITH t AS (SELECT d.doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS bad FROM documents d LEFT JOIN labels USING (doc_id)),
        f AS (SELECT part, good, bad, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b, 100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * len(text) AS c,
                regexp_matches(text, '[#$%&*|]') AS d, doc_id > min(doc_id) OVER (PARTITION BY text) AS e FROM t),
        m AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE bad) AS x FROM f GROUP BY ALL),
        l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
        o AS (SELECT a.c || b.c || c.c || d.c || e.c AS s FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
        p AS (SELECT s, k AS step, 1 << (ascii(s[k]) - 65) AS bit, coalesce(list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(s[j]) - 65))), 0)::INT AS before FROM o, unnest(range(1, 6)) AS u(k))
        SELECT part, s AS filter_order, step::INT AS step,
            coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS removed,
            coalesce(sum(n) FILTER (WHERE mask & bit > 0 AND mask & before > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
            coalesce(sum(g) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(x) FILTER (WHERE mask & bit > 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
            coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (WHERE mask & bit > 0), 0)::BIGINT AS shapley
        FROM m, p GROUP BY ALL
    """,
}
