"""Co-occurrence and trends of items mentioned in texts (AG26-AG35, JN3, SC7, SC8, ST22-ST24, SK19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.mentions import LANGUAGES, TOOLS, mentioned, repositories
from paperloom.functions.text import key_year
from paperloom.operators.meta import pair_counts


def mentions(texts: DataFrame, library: DataFrame | None = None, key: str = "paper", text: str = "text") -> DataFrame:
    """JN3, SC7: (paper, year, urls, tools, languages) of texts that name a repository."""
    got = texts.select(F.col(key).alias("paper"), F.col(text).alias("_t")).withColumn("urls", repositories(F.col("_t"))).filter(F.size("urls") > 0)
    got = got.select("paper", key_year(F.col("paper")).alias("key_year"), "urls", mentioned(F.col("_t"), TOOLS).alias("tools"), mentioned(F.col("_t"), LANGUAGES).alias("languages"))
    if library is None:
        return got.withColumnRenamed("key_year", "year")
    known = library.select(F.col("citation_key").alias("paper"), F.col("year").alias("lib_year"))
    return got.join(known, "paper", "left").select("paper", F.coalesce(F.nullif("lib_year", F.lit(0)), "key_year").alias("year"), "urls", "tools", "languages")


def single_counts(rows: DataFrame, items: str) -> DataFrame:
    """AG26: rows that have each item."""
    return rows.select(F.explode(F.array_distinct(items)).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def combination_counts(rows: DataFrame, items: str) -> DataFrame:
    """AG26, AG30: rows per exact combination, with its size."""
    return rows.filter(F.size(items) > 0).groupBy(F.array_join(F.array_sort(F.array_distinct(items)), ", ").alias("combination"), F.size(F.array_distinct(items)).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def stacks_by_size(rows: DataFrame, items: str, most: int = 10) -> DataFrame:
    """AG30: the most frequent combinations of each size."""
    rank = F.row_number().over(Window.partitionBy("size").orderBy(F.col("n").desc(), "combination"))
    return combination_counts(rows, items).withColumn("rank", rank).filter(F.col("rank") <= most)


def triple_counts(rows: DataFrame, items: str) -> DataFrame:
    """AG27: rows that have all three items, a < b < c."""
    s = F.array_sort(F.array_distinct(items))
    triples = F.flatten(F.flatten(F.transform(s, lambda a, i: F.transform(F.slice(s, i + 2, F.size(s)), lambda b, j: F.transform(F.slice(s, i + j + 3, F.size(s)), lambda c: F.struct(a.alias("a"), b.alias("b"), c.alias("c")))))))
    return rows.filter(F.size(items) > 2).select(F.explode(triples).alias("t")).groupBy("t.a", "t.b", "t.c").agg(F.count(F.lit(1)).alias("n"))


def pair_jaccard(rows: DataFrame, key: str, items: str) -> DataFrame:
    """AG28: pairs with their Jaccard similarity n12 / (n1 + n2 - n12)."""
    one = single_counts(rows, items)
    a, b = one.select(F.col("item").alias("a"), F.col("n").alias("na")), one.select(F.col("item").alias("b"), F.col("n").alias("nb"))
    return pair_counts(rows, key, items).join(a, "a").join(b, "b").select("a", "b", "n", F.round(F.col("n") / (F.col("na") + F.col("nb") - F.col("n")), 9).alias("jaccard"))


def cooccurrence(rows: DataFrame, key: str, items: str) -> DataFrame:
    """AG29, SK19: the symmetric matrix in long form, with each item's own count on the diagonal."""
    pairs = pair_counts(rows, key, items)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))
    return both.unionByName(single_counts(rows, items).select(F.col("item").alias("a"), F.col("item").alias("b"), "n"))


def item_years(rows: DataFrame, items: str) -> DataFrame:
    """AG31, AG32, AG34: rows per year and item, years and items without any at zero."""
    long = rows.filter(F.col("year").isNotNull()).select("year", F.explode(F.array_distinct(items)).alias("item")).groupBy("year", "item").agg(F.count(F.lit(1)).alias("n"))
    # years times items: both are small dictionaries, taken from the aggregate
    grid = long.select("year").distinct().join(long.select("item").distinct(), F.lit(True))
    return grid.join(long, ["year", "item"], "left").fillna(0, ["n"])


def trends(rows: DataFrame, items: str, span: int = 3, up: float = 1.2, down: float = 0.8) -> DataFrame:
    """AG33: last against first observed years of each item; none where fewer than twice ``span`` years are observed."""
    long = item_years(rows, items)
    years = long.select("year").distinct().withColumns({"early": F.row_number().over(Window.orderBy("year")), "late": F.row_number().over(Window.orderBy(F.col("year").desc())), "n_years": F.count(F.lit(1)).over(Window.partitionBy())})
    got = long.join(F.broadcast(years), "year").filter(F.col("n_years") >= 2 * span).groupBy("item").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("early") <= span, F.col("n")).otherwise(0)).alias("n_early"), F.sum(F.when(F.col("late") <= span, F.col("n")).otherwise(0)).alias("n_late"))
    label = F.when(F.col("n_late") > up * F.col("n_early"), "Increasing").when(F.col("n_late") < down * F.col("n_early"), "Decreasing").otherwise("Stable")
    return got.withColumn("trend", label).withColumn("growth", F.when(F.col("n_early") > 0, F.round(F.col("n_late") / F.col("n_early"), 9)))


def current_state(texts: DataFrame, key: str = "paper", text: str = "text") -> DataFrame:
    """AG35: texts, those that name a repository, those whose key has a year."""
    return texts.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size(repositories(F.col(text))) > 0).alias("with_repository"), F.count_if(key_year(F.col(key)).isNotNull()).alias("with_year"))
