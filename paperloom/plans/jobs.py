"""Jobs that string operators together (OP1-OP13, AG19, PL17). They return plans; files are never deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators import inventory, meta, resolve
from paperloom.operators import select as sel
from paperloom.sources import payloads


def ingest(raw: DataFrame, library: DataFrame) -> DataFrame:
    """OP1, OP2: payloads to rows, duplicates out, new entries with their keys."""
    rows = payloads.parse(raw).withColumn("seq", F.monotonically_increasing_id())
    kept = rows.join(resolve.deduplicated(rows).select("seq"), "seq")
    return resolve.new_entries(kept, library)


def work(library: DataFrame, artifacts: DataFrame, log: DataFrame) -> DataFrame:
    """OP3-OP5: what to fetch, extract and summarize."""
    return inventory.work_lists(library, artifacts, log.filter("status = 'failed'"))


def cleanup(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """OP6, OP10: what would be removed: entries without a PDF and files without an entry."""
    a = library.join(sel.present(artifacts, "pdf"), "citation_key", "left_anti").select(F.lit("entry").alias("what"), "citation_key", F.lit(None).cast("string").alias("path"))
    b = inventory.orphaned_files(library, artifacts).select("kind", "citation_key", "path")
    return a.unionByName(b.withColumnRenamed("kind", "what"))


def meta_analysis(library: DataFrame) -> dict[str, DataFrame]:
    """OP7, SK15: all results of the meta-analysis by name."""
    return {
        "years": meta.by_year(library), "rate": meta.publication_rate(library), "keywords": meta.keyword_counts(library, 2), "keyword_years": meta.keyword_years(library), "emerging": meta.emerging_keywords(library),
        "venues": meta.top(meta.counts_of(library, "venue"), 10), "authors": meta.top(meta.counts_of(library, "authors"), 10), "summary": meta.metadata_summary(library), "completeness": meta.completeness(library),
        "classes": meta.classification(library), "citations": meta.citation_stats(library), "coauthors": meta.pair_counts(library, "citation_key", "authors"),
    }


def enrich(library: DataFrame, results: DataFrame) -> DataFrame:
    """OP8: DOIs for entries without one."""
    return resolve.best_enrichment(sel.missing_doi(library), results)


def open_library(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """OP11: the tables of a data folder by name."""
    names = ("library", "artifacts", "progress", "search_results", "parsed_summaries", "corpus", "summarization_contexts", "paper_embeddings")
    return {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
