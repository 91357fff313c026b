"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cueloom.llm.exact_dedup import exact_dedup
from cueloom.llm.language_id import held_out, identify, learn
from cueloom.llm.line_dedup import remove_repeated_lines
from cueloom.llm.minhash import near_duplicates
from cueloom.llm.packing import pack
from cueloom.llm.pieces import digests
from cueloom.llm.pii import find, trained
from cueloom.llm.preferences import conversation_pairs, format_pairs
from cueloom.llm.secrets import scan
from cueloom.llm.secrets import trained as trained_forest
from cueloom.llm.topk import top_inner_products
from cueloom.sources.tables import table
from cueloom.sources.workspace import bounded_batches


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return table(spark, sf_dir, "documents")


def vocabulary() -> tuple[str, str]:
    """The public byte-level vocabulary, as tokenizer file and as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=2)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), *vocabulary())


def op3_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = format_pairs(conversation_pairs(table(spark, sf_dir, "conversations")))

    def spans(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["first"].cast("string"), s["after_last"].cast("string"))), ",").alias(mask)

    return pairs.select("pair_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"), "paired", "comparable")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scan(docs, trained_forest(docs))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return find(docs, trained(docs))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = remove_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"), passages=True)
    text = F.coalesce("text", F.lit(""))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_removed_chunks",
        "n_removed_lines",
        F.length(text).cast("long").alias("n_chars_kept"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    learned = learn(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, learned).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(documents(spark, sf_dir), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_preference_format": op3_preference_format,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii": op5_pii,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_topk": op7_exact_topk,
    "op9_line_dedup": op9_line_dedup,
    "op10_language_id": op10_language_id,
    "op8_exact_dedup": op8_exact_dedup,
}

ORACLE_SQL = {
    "op3_preference_format": """
        WITH t AS (
            SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, role, text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
                   '<|im_start|>' || replace(coalesce(role, ''), '<|', '< |') || chr(10) AS head,
                   replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body
            FROM conversations WHERE conv_id IS NOT NULL
        ), sizes AS (
            SELECT pair_id, count(*) FILTER (side = 0) AS n0, count(*) FILTER (side = 1) AS n1 FROM t GROUP BY pair_id
        ), same AS (
            SELECT a.pair_id, a.i, a.role IS NOT DISTINCT FROM b.role AND a.text IS NOT DISTINCT FROM b.text AS eq
            FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
        ), n AS (
            SELECT s.pair_id, s.n0, s.n1, coalesce(min(m.i) FILTER (NOT m.eq) - 1, least(s.n0, s.n1)) AS n
            FROM sizes s LEFT JOIN same m USING (pair_id) GROUP BY s.pair_id, s.n0, s.n1
        ), placed AS (
            SELECT t.*, n.n, CAST(coalesce(sum(length(head) + length(body)) OVER (
                PARTITION BY t.pair_id, side, t.i > n.n ORDER BY t.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins
            FROM t JOIN n USING (pair_id)
        ), span AS (SELECT *, (begins + length(head)) || ':' || (begins + length(head) + length(body)) AS span FROM placed)
        SELECT n.pair_id, CAST(n.n AS INTEGER) AS n_common,
               coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i <= n.n), '') AS prompt,
               coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 0 AND i > n.n), '') AS chosen,
               coalesce(string_agg(head || body, '' ORDER BY i) FILTER (side = 1 AND i > n.n), '') AS rejected,
               coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 0 AND i > n.n AND role = 'assistant'), '') AS chosen_mask,
               coalesce(string_agg(span, ',' ORDER BY i) FILTER (side = 1 AND i > n.n AND role = 'assistant'), '') AS rejected_mask,
               n.n0 > 0 AND n.n1 > 0 AS paired,
               count(*) FILTER (i = n.n + 1 AND role = 'assistant') = 2 AS comparable
        FROM n JOIN span USING (pair_id) GROUP BY n.pair_id, n.n, n.n0, n.n1
    """,
    "op7_exact_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored
        ) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
    """,
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
}
