"""The operators applied to their whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as dedup
from . import decontaminate, html_extract, jaccard_join, language_id, packing, pii, quality, token_store, toxicity
from .common import crc_mod, labelled_sample, scratch_path, table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(crc_mod(F.col("doc_id"), 3) != 1))
    return language_id.predict(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labelled_sample(docs, labels, "quality", crc_mod(F.col("doc_id"), 5) != 0, quality.FIT_ROWS)
    scored = quality.predict(docs, quality.fit(known))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.fit(docs))
    joined = {c: F.concat_ws(",", F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))) for c in ("base", "spans")}
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE_KINDS]
    secrets = F.expr("cast(size(filter(spans, s -> s.kind = 'secret')) as bigint)").alias("n_secret")
    added = F.expr("cast(size(spans) - size(base) as bigint)").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined["base"], 256).alias("base_sha256"), joined["spans"].alias("spans"), secrets, added)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    path = scratch_path(spark)
    token_store.write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), keep_space=False, end_id=2)
    return token_store.read_token_files(spark, path)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    known = labelled_sample(docs, labels, "toxic", crc_mod(F.col("doc_id"), 3) != 1, toxicity.FIT_ROWS)
    scored = toxicity.predict(docs, toxicity.fit(known))
    return scored.select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_extraction, op2_language_id, op3_quality_classifier, op4_decontamination, op5_exact_dedup, op6_packing, op7_pii, op8_token_ids, op9_toxicity, op10_ngram_jaccard_join)
}

SQL = {
    "op5_exact_dedup": """
        WITH h AS (
          SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
        )
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
        FROM h WINDOW g AS (PARTITION BY text_sha256)""",
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
        ), s AS (
          SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) END AS sh FROM w
        ), e AS (SELECT doc_id, unnest(sh) AS g FROM s
        ), i AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), l AS (
          SELECT u, v FROM i JOIN s x ON x.doc_id = u JOIN s y ON y.doc_id = v WHERE 100 * c >= 75 * (len(x.sh) + len(y.sh) - c)
        ), b AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l
        ), r(doc_id, c) AS (
          SELECT doc_id, doc_id FROM s UNION SELECT b.v, r.c FROM r JOIN b ON b.u = r.doc_id
        )
        SELECT s.doc_id, len(any_value(sh)) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY s.doc_id""",
}
