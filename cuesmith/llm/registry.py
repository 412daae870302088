"""The queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, divergence, exact_dedup, hard_negatives, mixing, near_dedup, packing, personal_data, quality, rule_ensemble, token_ids, url_filter, web_archive
from .common import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


LEDGER_SQL = r"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    pos AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS k FROM d),
    win AS (SELECT doc_id, k, word || chr(10) || lead(word) OVER x || chr(10) || lead(word, 2) OVER x AS g FROM pos WINDOW x AS (PARTITION BY doc_id ORDER BY k)),
    twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win WHERE g IS NOT NULL) WHERE n > 1),
    rep AS (SELECT doc_id, count(DISTINCT k) AS n_repeat_words FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS k FROM twice) GROUP BY doc_id),
    line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
    dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup_lines, count(*) AS n_lines FROM line WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    m AS (SELECT d.doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
          coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^!]', '', 'g')) AS n_exclaims, length(regexp_replace(t, '[^\p{Lu}]', '', 'g')) AS n_capitals, coalesce(list_max(list_transform(w, lambda x: strlen(x))), 0) AS longest_word
          FROM d LEFT JOIN rep ON d.doc_id = rep.doc_id LEFT JOIN dup ON d.doc_id = dup.doc_id),
    f AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (n_symbols * 10 > n_words)::BIGINT + 8 * (n_dup_lines * 2 > n_lines)::BIGINT
          + 16 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::BIGINT + 32 * (n_exclaims * 5 > n_words)::BIGINT + 64 * (n_capitals * 2 > word_chars)::BIGINT + 128 * (n_words > 1000000)::BIGINT + 256 * (longest_word > 1000)::BIGINT AS fail_bits FROM m)
"""


@query("op1_quality_ledger", LEDGER_SQL + "SELECT *, fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept FROM f")
def op1(spark, sf_dir):
    rows = quality.ledger(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", *quality.MEASURES, F.col("failed").alias("fail_bits"), (~quality.passes(quality.BASE)).alias("base_failed"), quality.passes(quality.POLICIES["v1"]).alias("kept"))


@query(
    "quality_ablations",
    LEDGER_SQL
    + """
    , r(rule, bit) AS (VALUES ('few_words', 1), ('repeated_words', 2), ('symbols', 4), ('repeated_lines', 8), ('word_length', 16), ('exclaims', 32), ('capitals', 64)),
    p(policy, mask) AS (VALUES ('base', 3), ('v1', 63), ('v2', 127))
    SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS n_failed, count(*) FILTER (fail_bits & mask = bit) AS n_only, count(*) FILTER (fail_bits & mask = 0) AS n_kept,
           count(*) FILTER (fail_bits & mask & ~bit = 0) AS n_kept_without, policy
    FROM f, r, p WHERE mask & bit <> 0 GROUP BY rule, policy
    """,
)
def quality_ablations(spark, sf_dir):
    """What each rule costs each policy, from a ledger that is written once."""
    ledger = stored(quality.ledger(table(spark, sf_dir, "documents")).select("failed"), "ledger")
    return reduce(DataFrame.unionByName, [quality.ablations(ledger, p) for p in quality.POLICIES.values()])


@query("op5_source_mixing")
def op5(spark, sf_dir):
    sized = mixing.sizes(table(spark, sf_dir, "documents"))
    rows = mixing.with_takes(sized, mixing.plan_mix(sized), F.col("key"))
    return rows.select(F.col("row.id").alias("doc_id"), "row.size", "at.source_size", "at.target", (F.col("row.size") * F.size("takes")).alias("taken"), F.transform("takes", lambda t: t["shard"]).alias("shards"))


#: The rules of the registered query (fixed values).
URL_RULES = [url_filter.Rule("block", "net"), url_filter.Rule("allow", "example.net", "/en/"), url_filter.Rule("block", "example.com", "/de/"), url_filter.Rule("allow", "org", "/fr/")]


@query(
    "op7_url_trie",
    r"""
    WITH u AS (
        SELECT page_id,
               translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
               coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
        FROM pages),
    r(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
    hits AS (
        SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(action, length(rhost || rpath)) AS action
        FROM u, r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
    SELECT u.page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM u LEFT JOIN hits USING (page_id)
    """,
)
def op7(spark, sf_dir):
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query(
    "op9_exact_dedup",
    """
    WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
    FROM d JOIN (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256) USING (text_sha256)
    """,
)
def op9(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query("sequences_read_back")
def sequences_read_back(spark, sf_dir):
    """The same sequences written whole and read back: per piece the digest of its content."""
    path = packing.write_sequences(packing.pack(table(spark, sf_dir, "documents")))
    return packing.read_sequences(spark, path).withColumn("body", F.sha2("body", 256)).withColumnRenamed("body", "body_sha256")


@query(
    "op2_setsketch_near_dedup",
    r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda k: w[k] || chr(10) || w[k + 1]) END) AS s FROM w)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 80 * (x.n + y.n - c)),
    e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
    c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
    """,
)
def op2(spark, sf_dir):
    return near_dedup.near_groups(table(spark, sf_dir, "documents"), near_dedup.Sketch(words=2))


@query("op4_weak_personal_data")
def op4(spark, sf_dir):
    return personal_data.find_personal_data(table(spark, sf_dir, "documents"))


@query(
    "op6_zip_archives",
    """
    WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN first <> page_id THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
    """,
)
def op6(spark, sf_dir):
    archives = web_archive.write_archives(table(spark, sf_dir, "pages"))
    return web_archive.read_records(archives).drop("url").withColumnRenamed("id", "page_id")


@query("op8_token_id_files")
def op8(spark, sf_dir):
    import public_tokenizers

    return token_ids.encode_corpus(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_class_ngrams")
def op3(spark, sf_dir):
    return class_lm.score_corpus(table(spark, sf_dir, "documents"))


@query("op11_rule_ensemble")
def op11(spark, sf_dir):
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    scored = rule_ensemble.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held("id"))
    return scored.select("doc_id", held("doc_id").alias("held_out"), "score", "predicted")


@query(
    "op12_radix_negatives",
    """
    WITH v AS (SELECT row_number() OVER () AS row, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
               FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.row AS arow, a.id AS anchor, b.row AS brow, b.id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
          FROM v a JOIN v b ON a.row <> b.row AND len(a.x) = len(b.x) WHERE a.id % 100 = 0),
    p AS (SELECT * FROM s WHERE same AND id <> anchor QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, id) <= 5),
    n AS (SELECT p.anchor AS anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.arow, p.brow ORDER BY s.score DESC, s.id) AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
          FROM p JOIN s ON p.arow = s.arow AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
    SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
    """,
)
def op12(spark, sf_dir):
    own = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), own.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)


@query(
    "op13_divergence_audit",
    r"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT id, lang, source, unnest(w) AS term FROM d),
    v AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
    z AS (SELECT lang, count(*) AS kept, sum(n)::HUGEINT AS total FROM v GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN v USING (lang, term) GROUP BY lang, source, term),
    u AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM c GROUP BY lang, source),
    s AS (SELECT g.lang, g.source, v.term, coalesce(c.n, 0) AS n,
                 (1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 2) // (coalesce(u.total, 0) + 2 * z.kept))::BIGINT AS p, (1 + 1000000000::HUGEINT * (v.n + 2) // (z.total + 2 * z.kept))::BIGINT AS q
          FROM g JOIN v USING (lang) JOIN z USING (lang) LEFT JOIN u ON u.lang = g.lang AND u.source = g.source LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
    f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
          UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM s WHERE n > 0 AND p > q),
    k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
    SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
    """,
)
def op13(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
