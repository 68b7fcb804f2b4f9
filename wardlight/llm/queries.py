"""The registered queries of the training-data operators: each applies one to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from wardlight.llm import (bpe_fst, byte_cnn, conversation_repair, decontaminate, kd_shards, language_crf, lexical_packing, ngram_join,
                           ranked_search, substring_dedup, token_files, top_k, url_templates)
from wardlight.llm.common import read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


_WORD = r"'[^\x20\x09-\x0D]+'"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return deco


@register("op1_token_files")
def op1_token_files(spark, sf_dir):
    return token_files.token_file_digest(read_table(spark, sf_dir, "documents"),
                                         public_tokenizers.path("word_bpe_49k.json"))


@register("op2_kd_shards")
def op2_kd_shards(spark, sf_dir):
    rows = kd_shards.kd_shards(read_table(spark, sf_dir, "documents"),
                               ["doc_id", "size", "lang", "source"], shards=24)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


@register("op4_bpe_fst")
def op4_bpe_fst(spark, sf_dir):
    return bpe_digest(read_table(spark, sf_dir, "documents"))


def bpe_digest(docs):
    rows = bpe_fst.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"),
                       F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op5_substring_dedup", f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS ws FROM documents),
    windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS w
                FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM t WHERE len(ws) >= 13)),
    firsts AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM windows JOIN firsts USING (w), generate_series(0, 12) AS g(k) WHERE first < doc_id),
    words AS (SELECT doc_id, unnest(generate_series(1, len(ws))) AS i, unnest(ws) AS word FROM t),
    kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
    FROM t LEFT JOIN kept USING (doc_id)""")
def op5_substring_dedup(spark, sf_dir):
    rows = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "n_removed",
                       F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op3_ngram_join", f"""
    WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_WORD}) AS ws FROM documents),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s
                 FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM t WHERE len(ws) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM pairs JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * same >= 80 * (a.n + b.n - same)),
    edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
    reach AS (SELECT doc_id AS d, doc_id AS root FROM t UNION SELECT y, root FROM reach JOIN edges ON x = d)
    SELECT t.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(root) AS component_id
    FROM t JOIN reach ON d = t.doc_id LEFT JOIN sizes ON sizes.doc_id = t.doc_id GROUP BY t.doc_id""")
def op3_ngram_join(spark, sf_dir):
    return ngram_join.near_duplicates(read_table(spark, sf_dir, "documents"))


# The rules of the query's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
             ("net/es/", "block"), ("net/fr/", "block")]


@register("op6_url_templates")
def op6_url_templates(spark, sf_dir):
    return url_templates.filter_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


@register("op10_exact_top_k", """
    WITH used AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM used q JOIN used c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored QUALIFY rank <= 20""")
def op10_exact_top_k(spark, sf_dir):
    return top_k.top_k(read_table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)


@register("op7_byte_cnn")
def op7_byte_cnn(spark, sf_dir):
    return byte_cnn.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@register("op8_language_crf")
def op8_language_crf(spark, sf_dir):
    return language_crf.identify(read_table(spark, sf_dir, "documents"))


@register("op9_decontaminate")
def op9_decontaminate(spark, sf_dir):
    return decontaminate.find_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@register("op11_lexical_packing")
def op11_lexical_packing(spark, sf_dir):
    pieces = lexical_packing.pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@register("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    rows = read_table(spark, sf_dir, "conversations")
    return conversation_repair.repair_conversations(conversation_repair.damaged(rows), rows)


_APART = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"


@register("op13_ranked_search", f"""
    WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_APART}) AS ws FROM documents),
    corpus AS (SELECT CAST(count(*) FILTER (len(ws) > 0) AS BIGINT) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM t),
    wanted AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), {_APART})) AS term
               FROM benchmark),
    found AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM t)
              WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
    weighed AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM found, corpus GROUP BY term, n_docs),
    parts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms))) AS part
              FROM found JOIN weighed USING (term), corpus),
    scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM wanted JOIN parts USING (term) GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 50""")
def op13_ranked_search(spark, sf_dir):
    return ranked_search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
