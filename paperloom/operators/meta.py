"""Aggregates over a library of papers: time, keywords, metadata, classes (AG1-AG19, AG36-AG44, FL1, SR2-SR4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import keywords, nonempty


def has_year(c: str = "year") -> Column:
    return nonempty(F.col(c), "number")


def year_range(library: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """FL1: rows with a year within the bounds, which are inclusive and may be missing."""
    keep = F.col("year").isNotNull()
    if start is not None:
        keep &= F.col("year") >= start
    if end is not None:
        keep &= F.col("year") <= end
    return library.filter(keep)


def data_quality(library: DataFrame) -> DataFrame:
    """AG1: counts and coverage of six fields with three sufficiency flags; zeros for an empty table."""
    n = F.count(F.lit(1))
    fields = {"titles": nonempty(F.col("title")), "abstracts": nonempty(F.col("abstract")), "years": has_year(), "authors": nonempty(F.col("authors"), "array"), "venues": nonempty(F.col("venue")), "citations": F.col("citation_count").isNotNull()}
    counts = [F.count_if(c).alias(f"n_{k}") for k, c in fields.items()]
    got = library.agg(n.alias("n"), *counts)
    rate = lambda k: F.when(F.col("n") > 0, F.round(F.col(f"n_{k}") * 100.0 / F.col("n"), 6)).otherwise(0.0)
    return got.select("n", *[f"n_{k}" for k in fields], *[rate(k).alias(f"pct_{k}") for k in fields], (F.col("n_years") > 0).alias("enough_for_time"), (F.col("n_abstracts") >= 2).alias("enough_for_features"), (F.col("n_titles") > 0).alias("enough_for_keywords"))


def by_year(library: DataFrame) -> DataFrame:
    """AG2, AG4, PL1: papers per year; rows without a year or with year 0 are left out."""
    return library.filter(has_year()).groupBy("year").agg(F.count(F.lit(1)).alias("n_papers"))


def publication_rate(library: DataFrame) -> DataFrame:
    """AG3: papers per year that has any, slope of the counts, and the busiest year, the earliest of equals."""
    years = by_year(library)
    total = library.agg(F.count(F.lit(1)).alias("total"))
    stats = years.agg(
        F.count(F.lit(1)).alias("n_years"), F.round(F.coalesce(F.regr_slope("n_papers", "year"), F.lit(0.0)), 6).alias("growth_rate"),
        F.max_by("year", F.struct("n_papers", (-F.col("year")))).alias("peak_year"), F.max("n_papers").alias("peak_count"),
    )
    return stats.join(total, F.lit(True)).select("total", "n_years", F.when(F.col("n_years") > 0, F.round(F.col("total") / F.col("n_years"), 6)).otherwise(0.0).alias("average_per_year"), "growth_rate", "peak_year", "peak_count")


def keyword_rows(library: DataFrame, abstracts: bool = True) -> DataFrame:
    """(year, keyword): one row per field of a paper that has the keyword, so two at most per paper."""
    fields = ["title", "abstract"] if abstracts else ["title"]
    lists = F.concat(*[F.coalesce(keywords(F.col(f)), F.array().cast("array<string>")) for f in fields])
    return library.select("year", F.explode(lists).alias("keyword"))


def keyword_counts(library: DataFrame, min_frequency: int = 1, abstracts: bool = True) -> DataFrame:
    """AG5, AG6, PL2: how many fields have each keyword."""
    return keyword_rows(library, abstracts).groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_frequency)


def keyword_years(library: DataFrame, abstracts: bool = True) -> DataFrame:
    """AG5, AG44: the same per year, rows without a year left out."""
    return keyword_rows(library, abstracts).filter(has_year()).groupBy("keyword", "year").agg(F.count(F.lit(1)).alias("n"))


def emerging_keywords(library: DataFrame, recent: int = 3, threshold: float = 1.5) -> DataFrame:
    """AG7, WN4: keywords with more in the last observed years than before; infinite where they are new."""
    counts = keyword_years(library)
    years = counts.select("year").distinct().withColumn("rank", F.dense_rank().over(Window.orderBy(F.col("year").desc())))
    # one row per year
    got = counts.join(F.broadcast(years), "year").groupBy("keyword").agg(F.sum(F.when(F.col("rank") <= recent, F.col("n")).otherwise(0)).alias("n_recent"), F.sum(F.when(F.col("rank") > recent, F.col("n")).otherwise(0)).alias("n_earlier"))
    enough = years.agg(F.count(F.lit(1)).alias("n_years"))
    ratio = F.when(F.col("n_earlier") == 0, F.lit(float("inf"))).otherwise(F.round(F.col("n_recent") / F.when(F.col("n_earlier") == 0, 1).otherwise(F.col("n_earlier")), 9))
    return got.join(F.broadcast(enough), F.lit(True)).filter((F.col("n_years") >= recent) & (F.col("n_recent") > 0)).withColumn("ratio", ratio).filter(F.col("ratio") >= threshold).select("keyword", "n_recent", "n_earlier", "ratio")


def counts_of(library: DataFrame, field: str) -> DataFrame:
    """AG8, AG38, PL3, PL8: papers per venue or source, or per author; a missing source is 'unknown'."""
    if field == "authors":
        rows = library.select(F.explode("authors").alias("value")).filter(F.trim("value") != "")
    elif field == "source":
        rows = library.select(F.when(nonempty(F.col("source")), F.col("source")).otherwise("unknown").alias("value"))
    else:
        rows = library.filter(nonempty(F.col(field))).select(F.col(field).alias("value"))
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def top(counts: DataFrame, n: int, by: str = "n", name: str = "value") -> DataFrame:
    """SR3, SR4, SR6: the n largest; equal counts in the order of their names."""
    return counts.orderBy(F.col(by).desc(), name).limit(n)


def metadata_summary(library: DataFrame) -> DataFrame:
    """AG9: numbers of venues, authors and sources, citations, most frequent venue and author."""
    first = lambda f: counts_of(library, f).agg(F.count(F.lit(1)).alias(f"n_{f}"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias(f"top_{f}"))
    base = library.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("citation_count"), 6).alias("mean_citations"), F.max("citation_count").alias("max_citations"), F.count_if(nonempty(F.col("doi"))).alias("n_doi"), F.count_if(nonempty(F.col("pdf_path"))).alias("n_pdf"))
    return base.join(first("venue"), F.lit(True)).join(first("authors"), F.lit(True)).join(first("source").select("n_source"), F.lit(True))


def completeness(library: DataFrame) -> DataFrame:
    """AG10, PL7: per field how many rows have it; here year 0 counts as there."""
    have = {"year": F.col("year").isNotNull(), "authors": nonempty(F.col("authors"), "array"), "abstract": nonempty(F.col("abstract")), "doi": nonempty(F.col("doi")), "pdf": nonempty(F.col("pdf_path")), "venue": nonempty(F.col("venue")), "citations": F.col("citation_count").isNotNull()}
    got = library.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(k) for k, c in have.items()])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("available")) for k in have])).alias("r")
    share = F.when(F.col("total") > 0, F.col("available") / F.col("total")).otherwise(0.0)
    return got.select("total", rows).select("r.field", "total", "r.available").withColumn("missing", F.col("total") - F.col("available")).withColumn("percentage", F.round(share * 100, 6))


def classification(library: DataFrame) -> DataFrame:
    """AG11, PL9: papers per category with their share of the classified ones."""
    got = library.select(F.col("metadata")["category"].alias("category")).filter(nonempty(F.col("category"))).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("percentage", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 6))


def citation_stats(library: DataFrame) -> DataFrame:
    """AG12: citations and years of a library; the deviation is of the population."""
    c = F.col("citation_count")
    years = F.when(has_year(), F.col("year"))
    got = library.agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, F.lit(0.5)), 6).alias("median"), F.round(F.stddev_pop(c), 6).alias("std"),
        F.min(c).alias("least"), F.max(c).alias("most"), F.sum(c).alias("total"), F.min(years).alias("first_year"), F.max(years).alias("last_year"),
    )
    return got.withColumn("papers_per_year", F.round(F.col("n") / (F.col("last_year") - F.col("first_year") + 1), 6))


def source_statistics(results: DataFrame, keys: tuple[str, ...] = ("keyword", "source")) -> DataFrame:
    """AG15, AG16, AG47: hits, citations, PDFs and DOIs per query and source, or over all queries."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_results"), F.sum(F.coalesce("citation_count", F.lit(0))).alias("n_citations"),
        F.count_if(nonempty(F.col("pdf_url"))).alias("n_pdf"), F.count_if(nonempty(F.col("doi"))).alias("n_doi"),
    )


def citation_trend(library: DataFrame) -> DataFrame:
    """AG36: least squares of citations over years."""
    rows = library.filter(has_year() & F.col("citation_count").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.regr_slope("citation_count", "year"), 4).alias("slope"), F.round(F.regr_intercept("citation_count", "year"), 2).alias("intercept"))


def venue_years(library: DataFrame, n: int = 10) -> DataFrame:
    """AG37, AG40, PL19: papers per year of the n largest venues; the venues kept have a fixed number."""
    best = top(counts_of(library, "venue"), n).select(F.col("value").alias("venue"))
    return library.filter(has_year()).join(F.broadcast(best), "venue").groupBy("venue", "year").agg(F.count(F.lit(1)).alias("n"))


def correlations(library: DataFrame) -> DataFrame:
    """AG39: Pearson correlations of year, citations (missing is 0) and number of authors."""
    rows = library.filter(has_year()).select("year", F.coalesce("citation_count", F.lit(0)).alias("c"), F.coalesce(F.size("authors"), F.lit(0)).alias("a"))
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.round(F.corr(x, y), 6).alias(k) for k, x, y in (("year_citations", "year", "c"), ("year_authors", "year", "a"), ("citations_authors", "c", "a"))])


def pair_counts(rows: DataFrame, key: str, items: str) -> DataFrame:
    """AG26, AG42, AG43: how many rows have both items of a pair, a < b; pairs within a row only."""
    s = F.array_sort(F.array_distinct(F.filter(items, lambda x: x.isNotNull() & (x != ""))))
    pairs = F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.filter(F.size(items) > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


def recent_additions(library: DataFrame, n: int = 5) -> DataFrame:
    """SR2: the latest entries with their titles cut to 60 characters."""
    cut = F.when(F.length("title") > 60, F.concat(F.left("title", F.lit(60)), F.lit("..."))).otherwise(F.col("title"))
    return library.orderBy(F.col("added_date").desc(), "citation_key").limit(n).select("citation_key", cut.alias("title"), "year", "added_date")


def top_keywords(library: DataFrame, n: int) -> DataFrame:
    """AG41, SR4: the ``n`` most frequent keywords with their rank, equal ones by name."""
    best = keyword_counts(library).orderBy(F.col("n").desc(), "keyword").limit(n)
    # n rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "keyword")))
