"""Registered queries over the given tables: each operator on its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newslab.llm import (block_knn, bpe, chat, language, letter_trie, max_sketch, near_graph, packing, quality, repeats,
                         simhash, super_kmers, token_files)
from newslab.llm.common import documents, key_hash
from newslab.session import new_table_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: A document counts as good from this score on.
GOOD = 0.3


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


@query("op1_perspective_rotation", """
    WITH rows AS (
        SELECT conv_id, turn, CAST(floor(coalesce(turn, 0) / 256) AS BIGINT) AS part,
               coalesce(nullif(role, ''), 'unknown') AS name, replace(coalesce(text, ''), '<|', '< |') AS body
        FROM conversations WHERE conv_id IS NOT NULL),
    counted AS (
        SELECT conv_id, part, turn, count(*) AS n, sum(count(*)) OVER (PARTITION BY conv_id, part) AS total,
               coalesce(sum(count(*)) OVER (PARTITION BY conv_id, part ORDER BY turn NULLS FIRST
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM rows GROUP BY conv_id, part, turn),
    said AS (
        SELECT DISTINCT r.*, CASE WHEN total > 4096 THEN CAST(before // 4096 AS BIGINT) ELSE 0 END AS section,
               CASE WHEN total > 4096 THEN CAST('0x' || substr(md5(name || ':' || body), 1, 8) AS BIGINT)
                    % CAST(ceil(n / 4096) AS BIGINT) ELSE 0 END AS slice
        FROM rows AS r JOIN counted AS c
        ON r.conv_id = c.conv_id AND r.part = c.part AND r.turn IS NOT DISTINCT FROM c.turn),
    people AS (SELECT DISTINCT conv_id, name AS perspective FROM said WHERE name <> 'system'),
    views AS (
        SELECT said.*, perspective, name = perspective AS mine,
               CASE WHEN name = 'system' THEN '<|system|>' || chr(10)
                    WHEN name = perspective THEN '<|assistant|>' || chr(10)
                    ELSE '<|user|>' || chr(10) || replace(name, '<|', '< |') || ': ' END AS head
        FROM said JOIN people USING (conv_id)),
    lines AS (
        SELECT *, head || body || '<|end|>' || chr(10) AS line,
               sum(length(head) + length(body) + 8) OVER (
                   PARTITION BY conv_id, perspective, part, section, slice ORDER BY turn NULLS FIRST, name, body
                   ROWS UNBOUNDED PRECEDING) - length(body) - 8 AS start
        FROM views)
    SELECT conv_id, perspective, part, section, slice,
           string_agg(line, '' ORDER BY turn NULLS FIRST, name, body) AS rendered, count(*) AS n_turns,
           coalesce(string_agg(CASE WHEN mine THEN start || '-' || (start + length(body) + 7) END, ','
                               ORDER BY turn NULLS FIRST, name, body), '') AS mask,
           CAST(sum(CASE WHEN mine THEN length(body) + 7 ELSE 0 END) AS BIGINT) AS n_learnt
    FROM lines GROUP BY conv_id, perspective, part, section, slice""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    views = chat.rotate_perspectives(spark.read.parquet(f"{folder}/conversations.parquet"))
    span = F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["stop"].cast("string")))
    return views.select("conv_id", "perspective", "part", "section", "slice", "rendered", F.col("n_turns").cast("long").alias("n_turns"),
                        F.array_join(span, ",").alias("mask"), F.col("n_learnt").cast("long").alias("n_learnt"))


@query("op2_near_graph", """
    WITH RECURSIVE v AS (
        SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    links AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b
        ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (
        SELECT vec_id AS a, vec_id AS b FROM v
        UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
    SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = vec_id) AS n_links,
           (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS component_id,
           vec_id = (SELECT min(b) FROM reach WHERE reach.a = vec_id) AS kept
    FROM v""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_graph.near_duplicates(spark.read.parquet(f"{folder}/embeddings.parquet"), threshold=0.9)


@query("op3_cost_balanced_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packed(documents(spark, folder))


def packed(docs: DataFrame) -> DataFrame:
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id"], end_id=0, ids=False)
    return pieces.select("row.doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query("op4_suffix_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return found.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                        (F.col("n_bytes") - F.col("n_removed")).alias("n_kept"), "kept_sha256", "kept_text")


@query("op5_language_codes")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", F.coalesce(key_hash("doc_id") % 3 == 1, F.lit(False)))
    model = language.train(docs.where(key_hash("doc_id") % 3 != 1))
    found = language.predict(docs, model, ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "lang_pred", "score", "ambiguous")


@query("op6_prefix_bpe")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = bpe.encode_and_decode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                                  public_tokenizers.PATTERN, ["doc_id"], outputs=False)
    return found.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op7_block_knn", """
    WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    pairs AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
        FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id, score
    FROM pairs QUALIFY rank <= 20""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return block_knn.nearest(spark.read.parquet(f"{folder}/embeddings.parquet"), "id % 20 = 0", k=20)


@query("op8_elias_fano_files")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "token-files")
    token_files.write_token_files(documents(spark, folder), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read_token_files(spark, path, ids=False)


@query("op9_quality_network")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).withColumn("held_out", F.coalesce(key_hash("doc_id") % 5 == 0, F.lit(False)))
    found = quality.score(docs, quality_network(docs, folder), ["doc_id", "held_out"])
    return found.select("row.doc_id", "row.held_out", "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def quality_network(docs: DataFrame, folder: str):
    labels = docs.sparkSession.read.parquet(f"{folder}/labels.parquet").where(key_hash("doc_id") % 5 != 0)
    return quality.train(docs, labels)


@query("op10_simhash_trees")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder), words=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op11_max_sketch_search", r"""
    WITH texts AS (
        SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                          '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
        FROM documents),
    sizes AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n FROM texts WHERE len(terms) > 0),
    corpus AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes),
    held AS (SELECT doc_id, unnest(terms) AS term FROM texts),
    counted AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
    weights AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counted, corpus GROUP BY term, docs),
    asked AS (
        SELECT item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
        FROM benchmark),
    scored AS (
        SELECT item_id, doc_id,
               CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
        FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), corpus
        GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= 20""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = max_sketch.search(spark.read.parquet(f"{folder}/benchmark.parquet"), documents(spark, folder))
    return found.select(F.col("query").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


@query("op12_letter_trie")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return letter_trie.spelling_variants(documents(spark, folder))


@query("op13_super_kmers")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    found = super_kmers.remove_repeats(documents(spark, folder).select("doc_id", "text"), ["doc_id"])
    return found.select("row.doc_id", "n_words", "n_removed", (F.col("n_words") - F.col("n_removed")).alias("n_kept"),
                        "kept_sha256", "kept_text")
