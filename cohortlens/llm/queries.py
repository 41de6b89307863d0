"""The registered queries of the training-data operators.

Each ``opN_<name>`` applies one operator with its production parameters to the
whole table it is meant for and returns its full result.  ``ORACLE`` has the SQL
of those that SQL can express; tokenizers, hashing and models are not (the tests
compare each with a brute-force version or held-out accuracy).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.sources.tables import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _word_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op1_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.vector_links import link_vectors

    return link_vectors(load(spark, sf_dir, "embeddings"))


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.token_counts import token_counts

    return token_counts(load(spark, sf_dir, "documents"), _word_bpe())


@_query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.packing import pack

    return pack(load(spark, sf_dir, "documents"), _word_bpe())


@_query
def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.order_minhash import near_duplicates

    return near_duplicates(load(spark, sf_dir, "documents"))


@_query
def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.line_dedup import dedup_similar_lines

    kept = dedup_similar_lines(load(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "lines_before", "lines_dropped", F.length("text").alias("chars_kept"), F.crc32("text").alias("text_crc32")
    )


@_query
def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.decontaminate import contaminated

    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@_query
def op8_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.ppm import score_documents

    return score_documents(load(spark, sf_dir, "documents"))


@_query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.language_id import fit_text_model, identify, page_rows

    model = fit_text_model(load(spark, sf_dir, "documents"))
    return identify(page_rows(load(spark, sf_dir, "pages")), model).withColumnRenamed("id", "page_id")


@_query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.toxicity import score_documents

    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


@_query
def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.chat_format import repair, summary

    return summary(repair(load(spark, sf_dir, "conversations")))


@_query
def op11_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.warc_index import archived

    found = archived(load(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: Base32 of a hexadecimal SHA-1: five digits are four letters.
_BASE32 = """array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0],
  lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, 5 * i::INT + 1, 5))::INT >> b) & 31) + 1), 1)), '')), '')"""

ORACLE["op11_warc_index"] = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS s,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM hashed"""


@_query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.periodic_runs import crc_places, periodic_runs, run_digest

    return run_digest(periodic_runs(load(spark, sf_dir, "documents"), places=crc_places))


@_query
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cohortlens.llm.lexical_search import search

    return search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


_TERMS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""

ORACLE["op13_lexical_search"] = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ts FROM documents),
held AS (SELECT r, doc_id, len(ts) AS n, unnest(ts) AS t FROM doc),
total AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM doc WHERE len(ts) > 0),
tf AS (SELECT r, doc_id, n, t, count(*) AS tf FROM held GROUP BY ALL),
term AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t),
item AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS t FROM benchmark),
scored AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // n_terms)))))::BIGINT AS score
  FROM item JOIN tf USING (t) JOIN term USING (t), total GROUP BY item_id, r, doc_id),
ranked AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, r)::INT AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50"""


@_query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
