"""Registered queries of the numbered operators: each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from .ann import nearest
from .common import crc_of_id, table
from .katz import score_texts
from .langid import detect_languages
from .media import media_features
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .pii import BASE_KINDS, find_personal_data, written
from .prefixtrie import prefix_trie
from .quality import score_documents
from .suffixes import remove_repeats
from .urlfilter import URL_RULES, judge_urls, junk_hosts
from .whitening import whiten


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents")).drop("media")


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = crc_of_id() % 4 == 2
    return detect_languages(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, share=(85, 100), bands=40, rows=7)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "rate")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    of = lambda kind: F.filter(base, lambda s: s["kind"] == kind)
    counts = [F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select(
        "doc_id", *counts, F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(F.col("spans")).alias("spans")
    )


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_of_id() % 7 == 2)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, URL_RULES))} AS r(host, path, verdict)")
    return judge_urls(pages, rules, junk_hosts(pages))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_media": op2_media,
    "op3_langid": op3_langid,
    "op4_minhash": op4_minhash,
    "op5_packing": op5_packing,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_pii": op9_pii,
    "op10_katz": op10_katz,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_url_filter": op12_url_filter,
    "op13_whitening": op13_whitening,
}

ORACLES: dict[str, str] = {
    "op4_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ), s AS (
            SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS g
            FROM d
        ), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
            JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
            GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 85 * (na.n + nb.n - count(*))
        ), r AS (SELECT a, b FROM p UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.low, d.doc_id)) AS component_id,
            d.doc_id = least(d.doc_id, coalesce(m.low, d.doc_id)) AS kept
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a) m USING (doc_id)
    """,
    "op6_suffixes": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        w AS (SELECT doc_id, s, substr(h, (2 * s + 1)::INTEGER, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS s FROM d)),
        f AS (SELECT g, min(doc_id) AS low FROM w GROUP BY g HAVING min(doc_id) < max(doc_id)),
        x AS (SELECT w.doc_id, w.s FROM w JOIN f USING (g) WHERE f.low < w.doc_id),
        o AS (SELECT doc_id, s, s > 50 + lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS gap FROM x),
        k AS (SELECT doc_id, s, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM o),
        i AS (SELECT doc_id, min(s) AS lo, max(s) + 50 AS hi FROM k GROUP BY doc_id, run),
        j AS (SELECT i.doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY i.doc_id ORDER BY lo), 0) AS since, h FROM i JOIN d USING (doc_id)),
        t AS (
            SELECT doc_id, sum(hi - lo) AS gone, count(*) AS spans, max(hi) AS last,
                string_agg(substr(h, (2 * since + 1)::INTEGER, (2 * (lo - since))::INTEGER), '' ORDER BY lo) AS head
            FROM j GROUP BY doc_id
        )
        SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans,
            sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::INTEGER))) AS kept_sha256
        FROM d LEFT JOIN t USING (doc_id)
    """,
    "op1_ann": """
        WITH v AS (
            SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e) AS score
            FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id AND len(d.e) = len(q.e)
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
        FROM s WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
        QUALIFY row_number() OVER w <= 20
    """,
    # crc32 is spelled out bit by bit.
    "op11_prefix_trie": """
        WITH RECURSIVE t AS (
            SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS j, g, n
            FROM (
                SELECT conv_id, turn, length(coalesce(text, '')) AS n,
                    sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g
                FROM conversations WHERE conv_id IS NOT NULL
            )
        ), k AS (
            SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS c FROM t
            UNION ALL
            SELECT conv_id, s, i + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
            FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(substr(s, i // 8 + 1, 1))::BIGINT) ELSE c END AS x FROM k WHERE i < 8 * length(s))
        ), h AS (SELECT conv_id, xor(c, 4294967295) % 6 AS h FROM k WHERE i = 8 * length(s)),
        r AS (
            SELECT h.conv_id, 0 AS own, t.j, t.g, t.n FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.j <= h.h
            UNION ALL SELECT h.conv_id, 1, t.j, t.g, t.n FROM h JOIN t ON t.conv_id = h.conv_id AND t.j > h.h
        ), w AS (
            SELECT conv_id, row_number() OVER o AS d, n, sha256(string_agg(g, '') OVER o) AS p
            FROM r WINDOW o AS (PARTITION BY conv_id ORDER BY own, j)
            UNION ALL SELECT conv_id, 0, 0, '' FROM h
        ), v AS (SELECT *, lag(p) OVER (PARTITION BY conv_id ORDER BY d) AS up, max(d) OVER (PARTITION BY conv_id) AS last FROM w),
        m AS (
            SELECT p, min(conv_id) AS conv_id, min(d) AS depth, min(up) AS up, min(n) AS n, count(*) AS n_convs,
                sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = last), '')) AS ends_sha256
            FROM v GROUP BY p
        ), c AS (SELECT up AS p, count(*) AS n FROM m WHERE up IS NOT NULL GROUP BY up),
        s AS (
            SELECT b.a AS p, sum(CASE WHEN c.n IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_leaves, sum((m.n_convs - 1) * m.n)::BIGINT AS saved_tokens
            FROM (SELECT DISTINCT a.p AS a, b.p AS b FROM v a JOIN v b ON a.conv_id = b.conv_id AND b.d >= a.d) b
            JOIN m ON m.p = b.b LEFT JOIN c ON c.p = b.b GROUP BY b.a
        )
        SELECT m.conv_id, m.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, m.n_convs, coalesce(c.n, 0)::BIGINT AS n_children,
            s.n_leaves, s.saved_tokens, m.ends_sha256
        FROM m JOIN s USING (p) LEFT JOIN c USING (p) LEFT JOIN m u ON u.p = m.up
    """,
    "op12_url_filter": r"""
        WITH r(rule_host, rule_path, rule_verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), p AS (
            SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages
        ), q AS (
            SELECT i, page_id, translate(regexp_extract(u, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(u, '^([^/?#]*)([^?#]*)', 2) AS path FROM p
        ), m AS (
            SELECT q.i, r.*, row_number() OVER (PARTITION BY q.i ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC) AS k
            FROM q JOIN r ON (q.host = rule_host OR ends_with(q.host, '.' || rule_host)) AND starts_with(q.path, rule_path)
        )
        SELECT page_id, host, path, m.rule_host || m.rule_path AS rule,
            coalesce(m.rule_verdict, CASE WHEN regexp_matches(host, '(^|\.)([^.]*-)?(ads|adult|bets|casino|pills|spam)(-[^.]*)?(\.|$)') THEN 'block' ELSE 'allow' END) AS verdict
        FROM q LEFT JOIN m ON m.i = q.i AND m.k = 1
    """,
}
