"""Queries of the text problems and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.llm.canonical import canonical_records
from anchorloom.llm.leakage import PASSAGE, item_words, passage_matches, term_counts
from anchorloom.llm.residue import residue_entries
from anchorloom.llm.spam import spam_pages
from anchorloom.llm.tokenizer import decode_documents, encode_documents
from anchorloom.runtime import Workspace
from anchorloom.sources.tables import table


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    terms = table(spark, d, "sitemap_autolink_terms").select("id", "phrase", "normalized_phrase")
    posts = table(spark, d, "posts").select("id", "raw")
    return canonical_records({"sitemap_autolink_terms": (terms, "id", ["phrase", "normalized_phrase"]), "posts": (posts, "id", ["raw"])})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_records(spark, d).select("record_table", "record_id").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_residue(spark, d).select("entry_id")


def p5_residue(spark: SparkSession, d: str) -> DataFrame:
    return residue_entries(table(spark, d, "sitemap_autolink_entries"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_documents(table(spark, d, "documents"))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tokens by language label, and documents whose ids do not decode to their text."""
    docs = table(spark, d, "documents").select(F.monotonically_increasing_id().alias("row"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    # A row number stands for the document, as ids may repeat or be null; encoded once.
    docs = Workspace(spark, "encoded").write(docs, "docs")
    ids = Workspace(spark, "encoded").write(encode_documents(docs.withColumnRenamed("row", "doc_id")), "ids")
    back = decode_documents(ids).select(F.col("doc_id").alias("row"), F.xxhash64("text").alias("decoded"))
    sizes = ids.select(F.col("doc_id").alias("row"), F.size("ids").alias("n"))
    one = docs.select("row", "lang", F.xxhash64("text").alias("given")).join(sizes, "row").join(back, "row")
    return one.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n_tokens"), F.count_if(F.col("given") != F.col("decoded")).alias("n_broken"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return passage_matches(spark, table(spark, d, "documents"), table(spark, d, "eval_items"), near=PASSAGE).select("doc_id", "item_id")


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return passage_matches(spark, table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_terms(spark: SparkSession, d: str) -> DataFrame:
    """The index's dictionary: how often each term of the items occurs in the corpus."""
    terms = item_words(table(spark, d, "eval_items")).select(F.explode("item_words").alias("term")).distinct()
    return term_counts(table(spark, d, "documents"), terms)


def p8_pages(spark: SparkSession, d: str) -> DataFrame:
    return spam_pages(spark, table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_pages(spark, d).select("doc_id")


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p5_found, p5_residue, p6_ids, p6_counts, p7_found, p7_near, p7_terms, p8_found, p8_pages)}

_WORDS = r"SELECT {0}, regexp_extract_all(lower({1}), '[\p{{L}}\p{{N}}]+') AS w FROM {2} WHERE {1} IS NOT NULL"
ORACLES = {
    "p7_found": "WITH d AS (" + _WORDS.format("doc_id", "text", "documents") + "), i AS (" + _WORDS.format("item_id", "item_text", "eval_items") + "), "
    "dg AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d)), "
    "ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 11], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)) "
    "SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)",
    "p7_near": "WITH d AS (" + _WORDS.format("doc_id", "text", "documents") + "), i AS (" + _WORDS.format("item_id", "item_text", "eval_items") + "), "
    "dw AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM d WHERE doc_id IS NOT NULL), iw AS (SELECT item_id, len(w) AS n, unnest(w) AS term, unnest(range(len(w))) AS p FROM i WHERE len(w) >= 12), "
    "dg AS (SELECT DISTINCT doc_id, item_id, n, pos - p AS dg, list(DISTINCT p) AS ps FROM dw JOIN iw USING (term) GROUP BY ALL HAVING count(DISTINCT p) >= 9), "
    "wn AS (SELECT doc_id, item_id, ps, unnest(range(n - 11)) AS s FROM dg) "
    "SELECT doc_id, item_id, max(k)::INTEGER AS best_words FROM (SELECT doc_id, item_id, len(list_filter(ps, lambda p: p >= s AND p < s + 12)) AS k FROM wn) GROUP BY ALL HAVING max(k) >= 9",
    "p7_terms": "WITH d AS (" + _WORDS.format("doc_id", "text", "documents") + "), i AS (" + _WORDS.format("item_id", "item_text", "eval_items") + "), "
    "t AS (SELECT DISTINCT unnest(w) AS term FROM i WHERE len(w) >= 12) "
    "SELECT term, count(*) AS n FROM (SELECT unnest(w) AS term FROM d) JOIN t USING (term) GROUP BY term",
}
