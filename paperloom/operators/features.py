"""TF-IDF, principal components and k-means of papers (VE1-VE4, AG5 inputs of PL5, PL6)."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Common English words that are no features.
STOP = (
    "the", "of", "and", "a", "an", "in", "to", "for", "on", "with", "is", "are", "was", "were", "be", "been", "by", "from", "that", "this", "these", "those", "it", "its", "as", "at", "or",
    "not", "but", "we", "our", "they", "their", "which", "can", "has", "have", "had", "than", "then", "so", "such", "into", "also", "between",
)


def terms(papers: DataFrame, key: str = "citation_key", stop: tuple[str, ...] = STOP) -> DataFrame:
    """(key, term, tf): words of title and abstract and pairs of neighbours, counted per paper; ``stop`` takes a longer list."""
    text = F.lower(F.concat_ws(" ", "title", "abstract"))
    w = F.filter(F.split(text, r"[^\p{L}\p{N}_]+"), lambda x: (F.length(x) >= 2) & ~x.isin(*stop))
    pairs = F.when(F.size("w") >= 2, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.array_join(F.slice("w", i, 2), " "))).otherwise(F.array().cast("array<string>"))
    rows = papers.select(key, w.alias("w")).filter(F.size("w") > 0).select(key, F.explode(F.concat("w", pairs)).alias("term"))
    return rows.groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(papers: DataFrame, key: str = "citation_key", max_features: int = 1000, min_df: int = 2, max_df: float = 0.95, stop: tuple[str, ...] = STOP) -> DataFrame:
    """VE1: (key, term, weight) with idf ln((1+n)/(1+df))+1 and unit length; the vocabulary is of the most frequent terms."""
    tf = terms(papers, key, stop)
    n = tf.agg(F.count_distinct(key).alias("n_docs"))
    vocabulary = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total")).join(F.broadcast(n), F.lit(True))
    fits = (F.col("df") >= F.least(F.lit(min_df), F.greatest(F.col("n_docs") - 1, F.lit(1)))) & (F.col("df") <= max_df * F.col("n_docs"))
    best = vocabulary.filter(fits & (F.col("n_docs") >= 2)).orderBy(F.col("total").desc(), "term").limit(max_features)
    weight = F.col("tf") * (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1)
    # the vocabulary has at most max_features rows
    raw = tf.join(F.broadcast(best.select("term", "df", "n_docs")), "term").select(key, "term", weight.alias("w"))
    return raw.withColumn("weight", F.round(F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key))), 9)).select(key, "term", "weight")


def dense(weights: DataFrame, key: str = "citation_key") -> DataFrame:
    """(key, vec): weights as vectors over the sorted vocabulary, for projection and clustering."""
    vocabulary = [r[0] for r in weights.select("term").distinct().orderBy("term").collect()]  # at most max_features
    zero = F.lit(0.0)
    got = weights.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("m"))
    return got.select(key, F.transform(F.array(*[F.lit(t) for t in vocabulary]), lambda t: F.coalesce(F.col("m")[t], zero)).alias("vec"))


def clustered(vectors: DataFrame, vec: str, k: int = 5, runs: int = 10, seed: int = 42) -> DataFrame:
    """VE4: the rows with a ``cluster``; the best of ``runs`` starts by cost."""
    data = vectors.withColumn("_v", array_to_vector(F.transform(vec, lambda x: x.cast("double"))))
    models = [KMeans(k=k, seed=seed + i, featuresCol="_v", predictionCol="cluster").fit(data) for i in range(runs)]
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(data).drop("_v")


def loadings(vectors: DataFrame, vec: str, words: list[str], k: int = 5) -> DataFrame:
    """VE3, SK11, SK14: (component, word, loading) of the first k components."""
    from paperloom.operators.vectors import covariance_spectrum

    _, (_, basis) = covariance_spectrum(vectors, vec)
    rows = [(f"PC{j + 1}", w, float(basis[i, j])) for i, w in enumerate(words) for j in range(min(k, basis.shape[1]))]
    return vectors.sparkSession.createDataFrame(rows, "component string, word string, loading double")
