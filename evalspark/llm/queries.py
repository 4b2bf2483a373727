"""One query per operator, over whole tables and with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalspark.llm import byte_bpe, language, line_dedup, packing, prefix_trie, quality, simhash, store, substring_dedup, token_files, top_products, toxicity, vantage, vector_codes

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir), shingle=3, radius=2).select(
        "doc_id", F.lower(F.hex("fingerprint")).alias("fingerprint"), "component_id"
    )


@_query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.fresh_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write(_table(spark, sf_dir), path, tokenizer, end_id=2)
    return token_files.read(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


@_query
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(_table(spark, sf_dir), path, public_tokenizers.PATTERN)
    return byte_bpe.decode(encoded, path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op4_vantage_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return vantage.search(rows, rows.where("vec_id % 100 = 0"), k=10, factor=1.0)


@_query
def op5_exact_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return top_products.search(rows, rows.where("vec_id % 50 = 0"), k=5, scale=256)


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.cut_documents(_table(spark, sf_dir), tokenizer, end_id=0, capacity=2048)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(store.written(pieces, "pieces"), capacity=2048)


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir)
    return language.identify(documents, language.fit(documents))


@_query
def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"))


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_table(spark, sf_dir), window=13).select(
        "doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@_query
def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_blocks(_table(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256")
    )


@_query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = prefix_trie.sequences(_table(spark, sf_dir, "conversations"))
    return prefix_trie.trie(prefix_trie.with_shared_openings(turns, every=20, kinds=4))


@_query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = vector_codes.compress(_table(spark, sf_dir, "embeddings"), parts=8, entries=16, rounds=6, scale=4096)
    return coded.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@_query
def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir), _table(spark, sf_dir, "labels"), threshold=0.5)


ORACLE["op4_vantage_points"] = """
WITH v AS (
    SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
      AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), d AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, 
        sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank, vec_id, score
FROM d QUALIFY rank <= 10
"""

ORACLE["op5_exact_top_products"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
    FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""

ORACLE["op9_substring_dedup"] = r"""
WITH t AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS win FROM t, unnest(range(1, len(w) - 11)) AS r(i)
), f AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) < doc_id AS again FROM s
), g AS (
    SELECT DISTINCT doc_id, i + k AS place FROM f, unnest(range(13)) AS r(k) WHERE again
), p AS (
    SELECT doc_id, list(place) AS gone FROM g GROUP BY doc_id
)
SELECT t.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, i: gone IS NULL OR NOT list_contains(gone, i)), ' ')) AS kept_sha256
FROM t LEFT JOIN p ON t.doc_id = p.doc_id
"""

ORACLE["op11_prefix_trie"] = r"""
WITH t AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
    FROM conversations WHERE conv_id IS NOT NULL
), own AS (
    SELECT conv_id, list(len(r)::VARCHAR || ':' || r || x ORDER BY k) AS turns,
        list(len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) ORDER BY k) AS words FROM t GROUP BY conv_id
), crc AS (  -- the checksum of the decimal id, bit by bit
    SELECT *, conv_id - conv_id % 20 AS home, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda v, z: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END)), 4294967295::BIGINT) % 4 AS h FROM own
), built AS (
    SELECT c.conv_id, list_concat(coalesce(b.turns[1:h], []), c.turns[h + 1:]) AS s, list_concat(coalesce(b.words[1:h], []), c.words[h + 1:]) AS w
    FROM crc c LEFT JOIN own b ON b.conv_id = c.home
), prefixes AS (
    SELECT conv_id, len(s) AS n, d, s[1:d] AS p, coalesce(w[d], 0) AS w FROM built, unnest(range(len(s) + 1)) AS u(d)
), node AS (
    SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
        coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends
    FROM prefixes GROUP BY p, d
), kids AS (
    SELECT p[1:d - 1] AS p, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL
), below AS (
    SELECT node.p[1:k] AS p, count(*) FILTER (WHERE kids.n IS NULL) AS n_leaves, sum((n_convs - 1) * w) AS saved
    FROM node LEFT JOIN kids ON kids.p = node.p, unnest(range(node.d + 1)) AS u(k) GROUP BY ALL
)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n, 0) AS n_children,
    below.n_leaves, below.saved::BIGINT AS saved_tokens, sha256(node.ends) AS ends_sha256
FROM node JOIN below ON below.p = node.p LEFT JOIN kids ON kids.p = node.p
LEFT JOIN node up ON node.d > 0 AND up.d = node.d - 1 AND up.p = node.p[1:node.d - 1]
"""

ORACLE["op12_vector_codes"] = vector_codes.oracle_sql(parts=8, entries=16, rounds=6, scale=4096)
