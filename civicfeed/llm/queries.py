"""One query for each training-data operator, over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, hard_negatives, language, lexical, mixing, near_dup, packing, quality_crf, suffix_tree, token_store, toxicity
from .common import clear, table, train_bucket  # noqa: F401
from .quality_rules import quality_rules

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies and how many documents it is linked to.

    Null, empty and blank texts are classes of their own; copies and repeated rows are linked to each other; ties in
    naming a class go to the least id; an empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dup.jaccard_join(docs)


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and digest, read back from the store that was written.

    Null and empty texts are the end id alone; documents without an id come last, by position; repeated ids follow each
    other by a hash of their text; long texts are encoded whole; an empty table gives an empty store.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, vocabulary=49_408)
    return token_store.read_store(spark, path).select(
        F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, base verdict, posterior of good and final verdict.

    Null, empty and blank texts have counts of 0 and fail the base; repeated rows get equal verdicts; long texts are counted
    whole; an empty table gives no rows and a model of beliefs alone.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good"
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, their digest, and that of the bytes that they decode to.

    Null and empty texts have no ids and the digest of nothing; texts are encoded whole; rows are coded one by one, so
    repeated rows agree; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every query vector.

    Null, zero and non-finite vectors take no part; ties go to the smaller id; rows equal in id and vector count once; fewer
    candidates give fewer rows; an empty table gives none.
    """
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, beside its source's size and target.

    A null source is the last source; null and empty texts have size 0 and give nothing; rows equal in id and size are taken
    alike; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score and prediction.

    Null, empty and blank texts have the share of good labels; repeated rows agree; without labels of both classes all
    lines have that share; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.trained(spark, sf_dir, docs)
    held = (train_bucket("doc_id", 3) == 1).alias("held_out")
    return quality_crf.score(docs, model).select("doc_id", held, "score", "predicted")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction.

    Null and empty texts have the model's bias alone; repeated rows agree; without labels of both classes the score is their
    share; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.trained(spark, sf_dir, docs)
    held = (train_bucket("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held, "score", "predicted")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's predicted language and how near its profile is.

    Null, empty and letterless texts are ``und`` with 0; ties go to the first language by name; repeated rows agree; without
    languages to learn from all are ``und``; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = language.trained(docs)
    held = (train_bucket("doc_id", 5) == 0).alias("held_out")
    return language.identify(docs.drop("lang"), profiles).select("doc_id", held, "lang_pred", "score")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability by the tree, beside the base's by single tokens.

    Null and empty texts are the end alone; repeated rows agree; without rows to learn from N is 0 and all bytes are
    alike; an empty table gives no rows.
    """
    return suffix_tree.production(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item.

    Null, empty and termless texts find nothing and are not found; equal scores come by ascending id, null ids last; repeated
    documents are found as often as they are there, repeated items are one; empty tables give no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lexical.rank(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document's ids, each with its place in a sequence of at most 4,096 ids.

    Null and empty texts are the end id alone; repeated documents and ids are packed as often as they are there; long texts are
    cut into whole sequences and a rest; an empty table gives no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, vocabulary=49_408)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five rows of other labels for each of the five positives of every anchor, within the positive's window of scores.

    Null labels, null vectors and non-finite components take no part; ties go to the smaller id; rows equal in id, vector and
    label are one; anchors without positives or with empty windows give no rows; an empty table gives none.
    """
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard,
        op2_token_store,
        op3_quality_rules,
        op4_byte_bpe,
        op5_ann,
        op6_mixing,
        op7_quality_crf,
        op8_toxicity,
        op9_language,
        op10_suffix_tree,
        op11_lexical,
        op12_packing,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    # all pairs: what the search must find, exact where blocks hold no more points than it reranks
    "op5_ann": """
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
        WHERE rank <= 20""",
    "op6_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                coalesce(doc_id::VARCHAR, '') AS k, md5('11:' || coalesce(doc_id::VARCHAR, '')) AS h
            FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
            FROM sized GROUP BY source),
        levels AS (
            SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (
                    ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / sum(weight) OVER (ORDER BY 3 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM sources),
        targets AS (
            SELECT source, source_size, least(max(level) OVER () * weight, (3 * source_size)::DOUBLE) AS target FROM levels),
        rests AS (
            SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::INT ELSE 0 END AS whole FROM targets),
        runs AS (
            SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
                sum(size) OVER (PARTITION BY source ORDER BY h, k, size) AS upto,
                sum(size) OVER (PARTITION BY source, h, k, size) AS own
            FROM sized JOIN rests USING (source))
        SELECT doc_id, size, source_size, target,
            (size * (whole + CASE WHEN upto - own / 2 <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM runs""",
    "op11_lexical": r"""
        WITH docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
        items AS (
            SELECT row_number() OVER () AS i, item_id, unnest(list_distinct(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))) AS t FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        totals AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM docs WHERE len(ts) > 0),
        tokens AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM docs),
        counts AS (SELECT r, doc_id, n, t, count(*) AS tf FROM tokens GROUP BY ALL),
        weights AS (
            SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
            FROM counts, totals GROUP BY t, n_docs),
        scores AS (
            SELECT i, item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM items JOIN counts USING (t) JOIN weights USING (t), totals GROUP BY ALL)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scores WHERE score > 0)
        WHERE rank <= 50""",
    "op13_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scores AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM (
            SELECT p.anchor_id, p.positive_id, p.positive_score, s.other_id AS negative_id, s.score AS negative_score,
                row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
            FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
                AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score)
        WHERE rank <= 5""",
}
