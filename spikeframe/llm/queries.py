"""The queries of the subpackage: production parameters over whole tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_decode
from .collocations import collocations
from .common import table
from .divergence import audit_sources
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .piece_bpe import encode_decode_pieces
from .quality import judge_quality
from .simhash import simhash_components
from .substring_dedup import dedup_substrings
from .suffix_dedup import dedup_suffixes
from .topk import top_inner_products
from .toxicity import score_toxicity
from .url_rules import judge_urls

#: host, path, verdict, name
URL_RULES = [
    ("com", "/en/", "block", "com/en/"),
    ("example.com", "/en/7", "allow", "example.com/en/7"),
    ("net", "/de/", "allow", "net/de/"),
    ("example.net", "/de/8", "block", "example.net/de/8"),
    ("org", "/es/", "block", "org/es/"),
]


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"), width=20)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_suffixes(table(spark, sf_dir, "documents"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").where(~held_out())
    out = score_toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "evidence")


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string, rule string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return out.select("doc_id", "source", "block", "slot", "position")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_inner_products(vectors, vectors.where("vec_id % 20 = 0"), k=20, scale=64.0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=4, differing_bits=4)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), max_words=3, min_count=10, covered=50, most=2000)


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode_pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"), min_docs=30, k=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_suffix_dedup, op3_toxicity, op4_url_rules, op5_mixing, op6_line_dedup, op7_topk, op8_bpe, op9_quality, op10_simhash, op11_collocations, op12_pieces, op13_divergence)
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM docs),
        windows AS (
            SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) > 1 AS again
            FROM (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM docs WHERE len(w) >= 20))),
        marked AS (
            SELECT words.doc_id, j, word, coalesce(max(again::INTEGER) OVER (PARTITION BY words.doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone
            FROM words LEFT JOIN windows ON windows.doc_id = words.doc_id AND i = j)
        SELECT d.doc_id, count(j) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '')) AS kept_sha256
        FROM docs d LEFT JOIN marked USING (doc_id) GROUP BY d.doc_id""",
    "op4_url_rules": r"""
        WITH after AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS a FROM pages),
        parts AS (
            SELECT page_id,
                translate(coalesce(regexp_extract(a, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                coalesce(regexp_extract(a, '^[^/?#]*([^?#]*)', 1), '') AS path
            FROM after),
        rules(rhost, rpath, rverdict, rname) AS (VALUES
            ('com', '/en/', 'block', 'com/en/'), ('example.com', '/en/7', 'allow', 'example.com/en/7'), ('net', '/de/', 'block', 'net/de/'),
            ('example.net', '/de/8', 'allow', 'example.net/de/8'), ('org', '/es/', 'block', 'org/es/'))
        SELECT p.page_id, p.host, p.path, b.rname AS rule, coalesce(b.rverdict, 'allow') AS verdict
        FROM parts p LEFT JOIN LATERAL (
            SELECT rname, rverdict FROM rules
            WHERE (p.host = rhost OR suffix(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
            ORDER BY length(rname) DESC LIMIT 1) b ON true""",
    "op5_mixing": r"""
        WITH RECURSIVE docs AS (SELECT doc_id, source, coalesce('=' || source, '') AS src FROM documents),
        targets AS (SELECT src, count(*) AS k FROM docs GROUP BY src),
        block AS (SELECT ceil(sum(k) / 2000)::BIGINT AS size FROM targets),
        blocks AS (SELECT src, k, (k + size - 1) // size AS m FROM targets, block),
        plan AS (SELECT list(src ORDER BY src) AS srcs, list(k ORDER BY src) AS ks, list(m ORDER BY src) AS ms, sum(m)::BIGINT AS total FROM blocks),
        run(slot, done, i) AS (
            SELECT -1::BIGINT, list_transform(ms, lambda x: 0::BIGINT), 0::BIGINT FROM plan
            UNION ALL
            SELECT slot + 1, list_transform(range(1, len(ms) + 1), lambda q: done[q] + CASE WHEN q = pick THEN 1 ELSE 0 END), pick
            FROM (
                SELECT slot, done, ms, list_min(list_transform(range(1, len(ms) + 1), lambda q:
                    CASE WHEN done[q] < ms[q] AND (done[q] * total) // ms[q] <= slot + 1
                    THEN (((done[q] + 1) * total + ms[q] - 1) // ms[q]) * 1000000 + q END)) % 1000000 AS pick
                FROM run, plan WHERE slot + 1 < total)),
        slots AS (
            SELECT slot, srcs[i] AS src, ks[i] AS k, ms[i] AS m, done[i] - 1 AS j FROM run, plan WHERE slot >= 0),
        begun AS (SELECT *, (j * k + m - 1) // m AS b, ((j + 1) * k + m - 1) // m - (j * k + m - 1) // m AS size FROM slots),
        placed AS (SELECT *, coalesce(sum(size) OVER (ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM begun),
        ranked AS (SELECT doc_id, source, src, row_number() OVER (PARTITION BY src ORDER BY md5(doc_id::VARCHAR)) - 1 AS r FROM docs)
        SELECT doc_id, source, j AS block, slot, (start + r - b)::BIGINT AS position
        FROM ranked JOIN placed USING (src) WHERE r < k AND (r * m) // k = j""",
    "op6_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
            FROM documents),
        keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
        often AS (SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT l.*, o.k IS NOT NULL AND o.keeper <> l.doc_id AS gone FROM keyed l LEFT JOIN often o USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op7_topk": r"""
        WITH vectors AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pairs AS (
            SELECT q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
            FROM vectors q JOIN vectors p ON q.vec_id % 20 = 0 AND p.vec_id <> q.vec_id)
        SELECT query_id, rank::INTEGER AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 20""",
    "op11_collocations": r"""
        WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM docs),
        words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
        grams AS (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i : i + m - 1], ' '))) AS phrase
            FROM words, (VALUES (1), (2), (3)) sizes(m) WHERE len(w) >= m),
        counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10),
        cuts AS (SELECT lang, m, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM counts, (VALUES (1), (2)) ks(k) WHERE k < m),
        scores AS (
            SELECT c.lang, c.m, c.phrase, c.a, l.f AS l, r.f AS r, c.k, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
            FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:c.k], ' ') JOIN counts r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        longer AS (
            SELECT lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') AS part, max(f) AS f FROM counts, (VALUES (1), (2)) parts(i) WHERE m = 3 GROUP BY ALL),
        kept AS (SELECT b.* FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.part = b.phrase WHERE g.f IS NULL OR 100 * g.f < 50 * b.a)
        SELECT * FROM (
            SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase))::INTEGER AS rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang))
        WHERE rank <= 2000""",
    "op13_divergence": r"""
        WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        terms AS (SELECT d, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
        often AS (SELECT lang, term, count(*) AS c FROM terms GROUP BY ALL HAVING count(DISTINCT d) >= 30),
        langs AS (SELECT lang, sum(c)::BIGINT AS n, count(*) AS v FROM often GROUP BY lang),
        counts AS (SELECT lang, source, term, count(*) AS c FROM terms SEMI JOIN often USING (lang, term) GROUP BY ALL),
        sizes AS (SELECT lang, source, sum(c)::BIGINT AS n FROM counts GROUP BY ALL),
        groups AS (SELECT lang, source, coalesce(s.n, 0) AS n, coalesce(l.n, 0) AS lang_n, coalesce(l.v, 0) AS v
            FROM (SELECT DISTINCT lang, source FROM docs) LEFT JOIN sizes s USING (lang, source) LEFT JOIN langs l USING (lang)),
        shares AS (SELECT g.lang, g.source, o.term, coalesce(c.c, 0) AS c,
                1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 5)) // (g.n + 5 * g.v) AS p, 1 + (1000000000::HUGEINT * (o.c + 5)) // (g.lang_n + 5 * g.v) AS q
            FROM groups g JOIN often o USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = o.term),
        sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value
            FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        rows AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
            FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM shares WHERE c > 0 AND p > q)
        SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item))::INTEGER AS rank FROM rows)
        WHERE part = 'pair' OR rank <= 50""",
}
