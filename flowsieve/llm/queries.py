"""The registered queries of this subpackage: each applies one operator, with
its production settings, to the whole table it is meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from flowsieve.llm.exact_dedup import exact_duplicates
from flowsieve.llm.lang_mixture import fit_languages, predict_languages
from flowsieve.llm.licenses import LICENCES, MARKERS, NOTICES, scan_licenses
from flowsieve.llm.line_rules import line_quality
from flowsieve.llm.merkle_midstate import manifest, tampered_leaf
from flowsieve.llm.minhash_tensor import NearDupConfig, near_duplicates
from flowsieve.llm.mixing import MixConfig, mix_report
from flowsieve.llm.packing_dp import PackConfig, pack_documents
from flowsieve.llm.quality_conv import fit_quality, score_quality
from flowsieve.llm.shard_table import assign_shards
from flowsieve.llm.viterbi_count import token_counts
from flowsieve.llm.warc_members import archive_report
from flowsieve.llm.whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_quality_conv(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id")
    return assign_shards(docs, F.col("doc_id"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(_documents(spark, sf_dir), MixConfig())


def op4_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality(_documents(spark, sf_dir))


def op5_viterbi_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), _vocabulary("piece_bpe_32k.model"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's path is its source, its language, its id."""
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                       F.col("doc_id").cast("string"))
    files = _documents(spark, sf_dir).select(F.col("doc_id").alias("id"), path.alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("id", "doc_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_documents(spark, sf_dir), PackConfig(_vocabulary("byte_bpe_50k.json")))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), NearDupConfig(shingle=4))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return predict_languages(docs, fit_languages(docs))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_report(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_documents(spark, sf_dir), tampered_leaf())


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    whitened = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return whitened.withColumn("deviation", F.col("deviation").cast("long"))


LLM_QUERIES = {
    "op1_quality_conv": op1_quality_conv,
    "op2_shard_table": op2_shard_table,
    "op3_mixing": op3_mixing,
    "op4_line_rules": op4_line_rules,
    "op5_viterbi_count": op5_viterbi_count,
    "op6_license_scan": op6_license_scan,
    "op7_packing": op7_packing,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_language_id": op10_language_id,
    "op11_warc": op11_warc,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_whitening": op13_whitening,
    "pipeline": corpus_pipeline.run,
}

_TEMPLATE_ROWS = ", ".join(f"({i}, '{kind}', '{name}', '{text}')" for i, (kind, name, text) in enumerate(
    [("notice", *t) for t in NOTICES] + [("licence", *t) for t in LICENCES]))


def _sql_pairs(words: str) -> str:
    return (f"list_concat({words}, CASE WHEN len({words}) > 1 THEN list_transform(range(1, len({words})), "
            f"lambda i: {words}[i] || ' ' || {words}[i + 1]) ELSE [] END)")



def _merkle_sql(levels: int = 6) -> str:
    """Trees of up to 8 ** levels leaves a language: a level is a grouping of the
    nodes by eights, and each leaf is folded level by level with its run."""
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in (
            "doc_id", "source", "lang", "n_chars", text)) + ")"

    def climb(n: str, f: str, key: str, steps: int) -> list[str]:
        out = []
        for k in range(steps):
            out.append(f"{n}{k + 1} AS (SELECT {key}, p // 8 AS p, CASE WHEN any_value(total) = 1 THEN any_value(d) ELSE "
                       f"sha256(string_agg(d, '' ORDER BY p)) END AS d FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS total "
                       f"FROM {n}{k}) GROUP BY {key}, p // 8)")
            out.append(f"{f}{k + 1} AS (SELECT f.doc_id, any_value(f.{key}) AS {key}, any_value(f.p) // 8 AS p, "
                       f"CASE WHEN any_value(r.total) = 1 THEN any_value(f.c) ELSE sha256(string_agg(CASE WHEN r.p = f.p THEN f.c ELSE r.d END, '' "
                       f"ORDER BY r.p)) END AS c, any_value(f.proof) || coalesce(string_agg(CASE WHEN r.p <> f.p THEN r.d END, '' ORDER BY r.p), '') "
                       f"AS proof, any_value(f.leaf) AS leaf, any_value(f.tree) AS tree FROM {f}{k} f JOIN (SELECT *, count(*) OVER (PARTITION BY {key}) AS total FROM {n}{k}) r "
                       f"ON r.{key} = f.{key} AND r.p // 8 = f.p // 8 GROUP BY f.doc_id)")
        return out
    steps = [f"h AS (SELECT doc_id, lang, {leaf('text')} AS leaf, {leaf(low)} AS changed FROM documents)",
             "g AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT lang FROM h))",
             "n0 AS (SELECT doc_id, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id) - 1 AS p, leaf AS d, changed "
             "FROM h JOIN g ON h.lang IS NOT DISTINCT FROM g.lang)",
             "tampered AS (SELECT doc_id, changed FROM n0 WHERE doc_id IN (SELECT doc_id FROM crc WHERE remainder = 0))",
             "f0 AS (SELECT n0.doc_id, tree, p, coalesce(t.changed, d) AS c, '' AS proof, d AS leaf FROM n0 LEFT JOIN tampered t USING (doc_id))"]
    steps += climb("n", "f", "tree", levels)
    steps += ["m0 AS (SELECT 0 AS one, tree AS p, d FROM n%d)" % levels,
              "e0 AS (SELECT doc_id, 0 AS one, tree AS p, c, proof, leaf, tree FROM f%d)" % levels]
    steps += climb("m", "e", "one", levels)
    # CRC-32 of the decimal doc_id, bit by bit
    crc = ("bits AS (SELECT doc_id, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), "
           "lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER, 1))::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), "
           "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS c FROM documents), "
           "crc AS (SELECT doc_id, xor(c, 4294967295) % 3 AS remainder FROM bits)")
    return (f"WITH {crc}, " + ", ".join(steps) + f" SELECT e.doc_id, e.leaf, s.d AS subroot, r.d AS root, sha256(e.proof) AS proof_sha256, "
            f"e.c AS folded_root, e.c = r.d AS verified FROM e{levels} e JOIN n{levels} s USING (tree), m{levels} r")


LLM_ORACLE_SQL: dict[str, str] = {
    "op11_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
             g AS (SELECT body, min(page_id) AS first_id FROM p GROUP BY body)
        SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
               CASE WHEN strlen(body) >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN strlen(body) >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM p JOIN g USING (body)
    """,
    "op12_merkle_manifest": _merkle_sql(),
    "op6_license_scan": rf"""
        WITH d AS (SELECT doc_id, coalesce(source, 'unknown') || '/' || coalesce(lang, 'unknown') AS dir,
                          coalesce(source, 'unknown') AS top,
                          translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
                   FROM documents),
        h AS (SELECT doc_id, dir, regexp_extract_all(t, '[a-z0-9]+') AS words,
                     list_filter(string_split(regexp_replace(regexp_replace(t, '\n[\x20\x09\r]*\n', chr(1), 'g'),
                         '([.!?])[\x20\x09-\x0D]+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '{MARKERS}')) AS sentences,
                     list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{MARKERS}')) AS lines
              FROM d WHERE regexp_matches(t, '{MARKERS}')),
        units AS (SELECT doc_id, 'notice' AS kind, regexp_extract_all(unit, '[a-z0-9]+') AS words
                  FROM (SELECT doc_id, unnest(list_distinct(list_concat(sentences, lines))) AS unit FROM h)
                  UNION ALL SELECT doc_id, 'licence', words FROM h WHERE len(words) <= 2000),
        texts AS (SELECT row_number() OVER () AS unit, * FROM (SELECT DISTINCT kind, words FROM units)),
        templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(template, kind, license, wording)),
        tw0 AS (SELECT template, kind, license, regexp_extract_all(translate(wording, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                       'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS words FROM templates),
        t_tf AS (SELECT template, kind, license, term, count(*) AS tf FROM (
                   SELECT template, kind, license, unnest({_sql_pairs('words')}) AS term FROM tw0) GROUP BY ALL),
        idf AS (SELECT term, ln((1.0 + (SELECT count(*) FROM templates)) / (count(*) + 1)) + 1 AS idf FROM t_tf GROUP BY term),
        u_tf AS (SELECT unit, kind, term, count(*) AS tf FROM (
                   SELECT unit, kind, unnest({_sql_pairs('words')}) AS term FROM texts) GROUP BY ALL),
        uw AS (SELECT unit, kind, term, tf * coalesce(idf, ln(1.0 + (SELECT count(*) FROM templates)) + 1) AS w FROM u_tf LEFT JOIN idf USING (term)),
        tw AS (SELECT template, kind, license, term, tf * idf AS w FROM t_tf JOIN idf USING (term)),
        un AS (SELECT unit, sqrt(sum(w * w)) AS n FROM uw GROUP BY unit),
        tn AS (SELECT template, sqrt(sum(w * w)) AS n FROM tw GROUP BY template),
        dots AS (SELECT unit, kind, template, license, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (kind, term) GROUP BY ALL),
        scored AS (SELECT unit, kind, license, round(dot / (un.n * tn.n), 6) AS score FROM dots JOIN un USING (unit) JOIN tn USING (template)),
        own AS (SELECT doc_id, license, score, kind FROM units JOIN texts USING (kind, words) JOIN scored USING (unit, kind)
                WHERE score >= CASE WHEN kind = 'licence' THEN 0.7 ELSE 0.6 END
                QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, score DESC, license) = 1),
        marked AS (SELECT own.doc_id, own.license, own.score, h.dir, own.kind = 'licence'
                          OR least(len(regexp_extract_all(array_to_string(sentences, chr(10)), '[a-z0-9]+')),
                                   len(regexp_extract_all(array_to_string(lines, chr(10)), '[a-z0-9]+'))) * 100 >= len(h.words) * 50 AS is_file
                   FROM own JOIN h USING (doc_id)),
        speaking AS (SELECT dir, license, score FROM marked WHERE is_file
                     QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, license) = 1)
        SELECT d.doc_id, d.dir || '/' || d.doc_id AS path, coalesce(m.license, s.license) AS license,
               CASE WHEN m.license IS NOT NULL THEN m.score ELSE s.score END AS score,
               CASE WHEN m.is_file THEN 'file' WHEN m.license IS NOT NULL THEN 'header'
                    WHEN s.license IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
               CASE WHEN m.is_file THEN d.dir WHEN m.license IS NULL THEN s.dir END AS license_dir
        FROM d LEFT JOIN marked m USING (doc_id) LEFT JOIN speaking s ON s.dir = d.dir
    """,
    "op4_line_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents),
        words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
                  FROM (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d)),
        grams AS (SELECT doc_id, i, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3
                  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        marked AS (SELECT doc_id, i, w3 IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, w, w2, w3) > 1 AS again
                   FROM grams),
        covered AS (SELECT doc_id, again OR coalesce(lag(again, 1) OVER o, false)
                           OR coalesce(lag(again, 2) OVER o, false) AS c
                    FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        per_words AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (c) AS n_repeat_words FROM covered GROUP BY doc_id),
        raw AS (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS line FROM d),
        lines AS (SELECT doc_id, host, t, line,
                         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
                         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
                  FROM raw WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
        dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY doc_id),
        per_line AS (SELECT host, norm, count(DISTINCT t) AS n_docs FROM lines GROUP BY host, norm),
        per_host AS (SELECT host, count(DISTINCT t) AS host_docs FROM d GROUP BY host),
        boilerplate AS (SELECT host, norm FROM per_line JOIN per_host USING (host)
                        WHERE n_docs > 100 OR n_docs >= 10 AND n_docs * 100 > host_docs * 10),
        removed AS (SELECT doc_id, sum(n)::BIGINT AS removed_words FROM lines JOIN boilerplate USING (host, norm) GROUP BY doc_id),
        facts AS (SELECT doc_id, coalesce(n_words, 0) AS n_words,
                         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
                         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                         coalesce(removed_words, 0) AS removed_words
                  FROM d LEFT JOIN per_words USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN removed USING (doc_id)),
        judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND 100 * (n_words - removed_words) >= 30 * n_words AS kept, removed_words
        FROM judged
    """,
    "op8_minhash_near_dedup": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                     ELSE list_distinct(list_transform(range(1, len(w) - 2),
                              lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS shingles FROM d),
        n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
        t AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM t a JOIN t b USING (shingle)
              WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
              WHERE 100 * common >= 80 * (a.n_shingles + b.n_shingles - common)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id, doc_id AS seen FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
        SELECT doc_id, n_shingles, min(seen) AS component_id, min(seen) = doc_id AS kept
        FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles
    """,
    "op9_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
             g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.body) AS text_sha256
        FROM n JOIN g USING (body)
    """,
}
