"""The registered queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnframe.llm import decontaminate, divergence, merkle, packing, quality, setsketch, simhash, substrings, suffixarray, suffixtree, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(spark, _table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixarray.remove_repeated_bytes(spark, _table(spark, sf_dir, "documents")).drop("kept")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.language_model_scores(spark, _table(spark, sf_dir, "documents"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(spark, _table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(spark, _table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, _table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(spark, _table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(spark, _table(spark, sf_dir, "documents")).drop("source")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_substring_dedup, op2_toxicity, op3_suffix_array_dedup, op4_warc, op5_simhash, op6_lm_scoring, op7_url_filters, op8_quality_rules, op9_best_fit_packing, op10_decontamination, op11_setsketch, op12_source_divergence, op13_merkle_manifest, pipeline)}

ORACLE_SQL = {
    "op4_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first_id THEN first_id END AS refers_to
        FROM d LEFT JOIN f USING (payload_digest)""",
    "op11_setsketch": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, hash(unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda k: array_to_string(w[k : k + 4], ' ')))) AS shingle FROM w WHERE len(w) > 0),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        reach AS (SELECT doc_id, doc_id AS node FROM w UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.node),
        found AS (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY 1)
        SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, f.component_id, w.doc_id = f.component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN found f USING (doc_id)""",
    "op12_source_divergence": r"""
        WITH d AS (
            SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
        found AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
        kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT id) >= 3),
        n AS (SELECT lang, source, term, count(*) AS n FROM found SEMI JOIN kept USING (lang, term) GROUP BY ALL),
        every AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN n USING (lang, source, term)),
        p AS (SELECT *, 1 + (1000000000::HUGEINT * (n + 1)) // sum(n + 1) OVER (PARTITION BY lang, source) AS p FROM every),
        q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 1)) // sum(n + 1) OVER (PARTITION BY lang) AS q FROM (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL)),
        term AS (
            SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value,
                   row_number() OVER (PARTITION BY lang, source ORDER BY (p - q) * (p - q) // q DESC, term) AS rank
            FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q QUALIFY rank <= 200),
        summed AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        groups AS (SELECT DISTINCT lang, source FROM d),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
                 FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN summed s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
        SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM term
        UNION ALL SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM pair""",
    "op13_merkle_manifest": """
        WITH RECURSIVE row_text AS (
            SELECT doc_id, source, text, lang, n_chars,
                   CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed
            FROM (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda d: [ord(d)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                                lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS crc FROM documents)),
        part AS (
            SELECT doc_id, source, text, changed,
                   coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                   || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head
            FROM row_text),
        leaf AS (
            SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(changed) || ':' || changed, '-')) AS changed FROM part),
        place AS (
            SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY source) AS size,
                   dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp
            FROM leaf),
        inner_tree AS (
            SELECT grp, 0 AS lvl, idx, size, leaf AS h FROM place
            UNION ALL
            SELECT grp, lvl + 1, idx // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM inner_tree WHERE size > 1 GROUP BY ALL),
        subroot AS (SELECT grp, h FROM inner_tree WHERE size = 1),
        outer_tree AS (
            SELECT 0 AS lvl, grp AS idx, (SELECT count(*) FROM subroot) AS size, h FROM subroot
            UNION ALL
            SELECT lvl + 1, idx // 16, (size + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM outer_tree WHERE size > 1 GROUP BY ALL),
        sibling AS (
            SELECT p.grp, p.idx, t.lvl, t.idx AS pos, t.h, p.idx // (16 ** t.lvl)::BIGINT AS own FROM place p JOIN inner_tree t
            ON t.grp = p.grp AND t.idx // 16 = p.idx // (16 ** (t.lvl + 1))::BIGINT AND t.size > 1
            UNION ALL
            SELECT p.grp, p.idx, 100 + t.lvl, t.idx, t.h, p.grp // (16 ** t.lvl)::BIGINT FROM place p JOIN outer_tree t
            ON t.idx // 16 = p.grp // (16 ** (t.lvl + 1))::BIGINT AND t.size > 1),
        step AS (
            SELECT grp, idx, row_number() OVER (PARTITION BY grp, idx ORDER BY lvl) AS k,
                   coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < own), '') AS before, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > own), '') AS after
            FROM sibling GROUP BY grp, idx, lvl),
        proof AS (SELECT grp, idx, string_agg(before || after, '' ORDER BY k) AS proof FROM step GROUP BY ALL),
        fold AS (
            SELECT grp, idx, 0 AS k, changed AS h FROM place
            UNION ALL
            SELECT f.grp, f.idx, s.k, sha256(s.before || f.h || s.after) FROM fold f JOIN step s ON s.grp = f.grp AND s.idx = f.idx AND s.k = f.k + 1),
        folded AS (SELECT grp, idx, arg_max(h, k) AS h FROM fold GROUP BY ALL)
        SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, sha256(coalesce(x.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM place p JOIN subroot s USING (grp) JOIN folded f ON f.grp = p.grp AND f.idx = p.idx LEFT JOIN proof x ON x.grp = p.grp AND x.idx = p.idx
        CROSS JOIN (SELECT h FROM outer_tree WHERE size = 1) r""",
}
