"""What is written out: rows as text, JSON and matrices, built as DataFrames and written by Spark (SK1-SK27)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import nonempty


def bibtex(key: Column, title: Column, authors: Column, year: Column, venue: Column, doi: Column, url: Column) -> Column:
    """SK2: one BibTeX entry; fields without a value are left out."""
    line = lambda name, c, keep: F.when(keep, F.concat(F.lit(f"  {name} = {{"), c.cast("string"), F.lit("}")))
    parts = F.concat_ws(",\n", line("title", title, nonempty(title)), line("author", F.array_join(authors, " and "), nonempty(authors, "array")), line("year", year, nonempty(year, "number")), line("journal", venue, nonempty(venue)), line("doi", doi, nonempty(doi)), line("url", url, nonempty(url)))
    return F.concat(F.lit("@article{"), key, F.lit(",\n"), parts, F.lit("\n}"))


def bibtex_rows(library: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """SK2-SK4: (citation_key, entry); keys that are in the file already are left out, compared as whole keys."""
    rows = library if known is None else library.join(known.select("citation_key"), "citation_key", "left_anti")
    cols = [F.col(c) for c in ("citation_key", "title", "authors", "year", "venue", "doi", "url")]
    return rows.select("citation_key", bibtex(*cols).alias("entry"))


def json_rows(rows: DataFrame, key: str | None = None) -> DataFrame:
    """SK1, SK5, SK7-SK10, SK16, SK21-SK25, SK27: each row as JSON, for ``write.text``; by key for files that are maps."""
    cols = [c for c in rows.columns if c != key]
    body = F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})
    return rows.select(body.alias("value")) if key is None else rows.select(F.concat(F.lit('"'), F.col(key), F.lit('": '), body).alias("value"))


def envelope(rows: DataFrame, version: str, updated: str, key: str | None = None) -> DataFrame:
    """SK1: one JSON document with version, count and entries, as a map by key or as a list.

    One row holds all entries, so this is for exports of a size that a file of that kind can have."""
    value = F.struct(*rows.columns)
    entries = F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key), value.alias("v"))))) if key else F.array_sort(F.collect_list(value))
    return rows.agg(F.count(F.lit(1)).alias("count"), entries.alias("entries")).select(F.to_json(F.struct(F.lit(version).alias("version"), F.lit(updated).alias("updated"), "count", "entries")).alias("value"))


def matrix(long: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """SK6, SK11, SK19: a long table as a wide one, zeros where there is nothing; for a bounded set of columns."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value)).fillna(0)


def word_importance(loadings: DataFrame) -> DataFrame:
    """SK13, WN9: words by the sum of their absolute loadings, with rank."""
    from pyspark.sql.window import Window

    got = loadings.groupBy("word").agg(F.round(F.sum(F.abs("loading")), 6).alias("importance"))
    return got.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "word")))


def top_words(loadings: DataFrame, n: int = 10) -> DataFrame:
    """SK12, SR5, PL6, VE23: the words of largest absolute loading of each component."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("component").orderBy(F.abs("loading").desc(), "word"))
    return loadings.withColumn("rank", rank).filter(F.col("rank") <= n)


def report_lines(title: str, rows: DataFrame) -> DataFrame:
    """SK12, SK15, SK18, SK20: rows of a small result as markdown list lines under a title."""
    head = rows.sparkSession.createDataFrame([(0, f"# {title}")], "at int, value string")
    body = rows.select(F.lit(1).alias("at"), F.concat(F.lit("- "), F.concat_ws(": ", *[F.col(c).cast("string") for c in rows.columns])).alias("value"))
    return head.unionByName(body).orderBy("at", "value").select("value")
