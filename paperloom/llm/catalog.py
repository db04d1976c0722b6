"""Queries of the training-data operators, with the SQL to check them by where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import clusters, matching, mixture, names, scans, spam, split, tokens
from paperloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"))


def p7_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Documents, characters and tokens per language as stored."""
    counted = tokens.count_tokens(table(spark, d, "documents"), keep=["lang", "n_chars"])
    return counted.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"))


QUERIES |= {"p7_ids": p7_ids, "p7_sizes": p7_sizes}


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents with their copies."""
    counted = mixture.sizes(table(spark, d, "documents"))
    return mixture.mixture(counted, mixture.rates(counted, table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached."""
    counted = mixture.sizes(table(spark, d, "documents"))
    return mixture.shares(counted, mixture.rates(counted, table(spark, d, "mix_targets")))


def p8_full(spark: SparkSession, d: str) -> DataFrame:
    """Shares asked for and reached at the size of all listed documents, where caps bind and the others fill up."""
    counted = mixture.sizes(table(spark, d, "documents"))
    return mixture.shares(counted, mixture.rates(counted, table(spark, d, "mix_targets"), mixture.ALL))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of keywords, links or tags rather than sentences."""
    return spam.spam_pages(table(spark, d, "documents")).select("doc_id").distinct()


QUERIES |= {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_full": p8_full, "p9_found": p9_found}


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(item_table, citation_key, text) of both tables with long texts; exact duplicate rows once."""
    corpus = table(spark, d, "corpus").select(F.lit("corpus").alias("item_table"), "citation_key", "text")
    contexts = table(spark, d, "summarization_contexts").select(F.lit("summarization_contexts").alias("item_table"), "citation_key", F.col("full_text").alias("text"))
    return corpus.unionByName(contexts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts that have to be cut."""
    return split.oversized(_texts(spark, d), "text", ["item_table", "citation_key"]).select("item_table", "citation_key").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The ordered pieces of every text."""
    return split.pieces(_texts(spark, d), "text", ["item_table", "citation_key"])


QUERIES |= {"p4_found": p4_found, "p4_pieces": p4_pieces}
ORACLES["p4_found"] = """
select distinct item_table, citation_key from (select 'corpus' as item_table, citation_key, text from corpus
union all select 'summarization_contexts', citation_key, full_text from summarization_contexts) where length(text) > 6000"""


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Damaged lines of scanned texts."""
    return scans.found_lines(_texts(spark, d), table(spark, d, "library").select("venue"))


def p6_text(spark: SparkSession, d: str) -> DataFrame:
    """All texts, scanned ones as continuous paragraphs."""
    return scans.repaired(_texts(spark, d), table(spark, d, "library").select("venue"))


QUERIES |= {"p6_found": p6_found, "p6_text": p6_text}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Papers in clusters of mutually similar directions, with the smallest key of the cluster."""
    return clusters.members(table(spark, d, "paper_embeddings")).select("citation_key", "cluster_key")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical papers of each cluster."""
    return clusters.described(clusters.members(table(spark, d, "paper_embeddings")))


QUERIES |= {"p1_found": p1_found, "p1_clusters": p1_clusters}


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of spellings of one person or organisation."""
    return names.variant_pairs(table(spark, d, "parsed_summaries"), table(spark, d, "given_name_aliases"))


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Each spelling with the smallest spelling of its entity."""
    return names.variants(table(spark, d, "parsed_summaries"), table(spark, d, "given_name_aliases"))


QUERIES |= {"p5_found": p5_found, "p5_entities": p5_entities}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with their hits."""
    return matching.matches(table(spark, d, "parsed_summaries"), table(spark, d, "search_results")).select("citation_key", "seq")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    """Summaries with their hits and the confidence of each match."""
    return matching.matches(table(spark, d, "parsed_summaries"), table(spark, d, "search_results"))


QUERIES |= {"p2_found": p2_found, "p2_scores": p2_scores}

ORACLES["p1_found"] = """
with v as (select collection, citation_key, min(vec)::double[] as v from paper_embeddings where vec is not null group by 1, 2),
u as (select * from v where list_sum(list_transform(v, lambda x: x * x)) > 0),
p as (select a.citation_key, b.citation_key as other from u a join u b on a.collection = b.collection where list_cosine_similarity(a.v, b.v) >= 0.8 or a.citation_key = b.citation_key)
select citation_key, min(other) as cluster_key from p group by citation_key having count(distinct other) >= 3"""
