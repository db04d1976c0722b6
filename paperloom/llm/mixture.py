"""Mixing of sources to target weights.

Tokens are summed per source, a repetition rate is derived for each source, and each document is
emitted floor(rate) times plus once more with the probability of the fraction, drawn from a hash
of seed and document so that a repeated run draws alike.

Without ``total_tokens`` the total is the largest at which every listed source that has documents
reaches its weight within its repeats. A larger total (``ALL`` for that of all listed documents) lets
caps bind: a source that cannot give more leaves its part to the others in proportion to their weights,
up to their own caps, and the report shows the shares that result.
Sources are compared without letter case and blanks around them.

Defined results: documents of other sources, without a source or without tokens are not emitted;
a listed source without documents has share 0; targets with null or non-positive weight or repeats
ask for nothing; of targets listed twice the first by weight and repeats holds; repeated documents
each draw on their own row's ``doc_id``; empty tables give an empty mixture and zero shares.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm import tokens
from paperloom.runtime import checkpoint

ALL = -1  # for ``total_tokens``: as many tokens as the documents of the listed sources have
MAX_SOURCES = 100_000  # rows of the target table that may be broadcast


def _name(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def sizes(documents: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens), written once since both the rates and the mixture read it."""
    counted = tokens.count_tokens(documents, keep=["doc_id", "source"], vocabulary=vocabulary)
    return checkpoint(counted.select("doc_id", _name(F.col("source")).alias("source"), "n_tokens"))


def rates(counted: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, weight, max_repeats, n_docs, available, rate, total): one row per target."""
    wanted = (
        targets.select(_name(F.col("source")).alias("source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeats").cast("int").alias("max_repeats"))
        .filter(F.col("source").isNotNull())
        .withColumns({"weight": F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), "max_repeats": F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))})
        .groupBy("source").agg(F.min(F.struct("weight", "max_repeats")).alias("t")).select("source", "t.weight", "t.max_repeats")
    )
    have = counted.filter(F.col("n_tokens") > 0).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("available"))
    both = wanted.join(have, "source", "left").fillna(0, ["n_docs", "available"])
    usable = (F.col("weight") > 0) & (F.col("available") > 0) & (F.col("max_repeats") > 0)
    limit = F.when(usable, F.col("max_repeats") * F.col("available") / F.col("weight"))
    if total_tokens is None:
        total = F.coalesce(F.min(limit), F.lit(0.0))
    else:
        total = F.coalesce(F.sum(F.when(usable, F.col("available"))), F.lit(0)).cast("double") if total_tokens == ALL else F.lit(float(total_tokens))
    # the targets are few; of them, in the order in which their caps bind, the first that does not bind sets the level of all that follow
    in_order = Window.orderBy("limit", "source")
    capped = F.coalesce(F.sum(F.col("max_repeats") * F.col("available")).over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum("weight").over(in_order.rowsBetween(0, Window.unboundedFollowing))
    steps = both.filter(usable).withColumn("limit", limit).withColumns({"capped": capped, "open": open_})
    one = both.agg(total.alias("total"))
    level = steps.join(F.broadcast(one), F.lit(True)).withColumn("level", (F.col("total") - F.col("capped")) / F.col("open")).filter(F.col("level") <= F.col("limit")).agg(F.min_by("level", F.struct("limit", "source")).alias("level"))
    found = one.join(F.broadcast(level), F.lit(True))
    rate = F.when(usable, F.least(F.coalesce(F.col("weight") * F.col("level") / F.col("available"), F.col("max_repeats").cast("double")), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return both.join(F.broadcast(found), F.lit(True)).withColumn("rate", F.round(rate, 9)).drop("level")


def mixture(counted: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, source, copy_no, n_tokens): the mixed documents, copies numbered from 1."""
    if rated.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES:
        rated = F.broadcast(rated)
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    copies = (F.floor("rate") + (draw < F.col("rate") - F.floor("rate")).cast("int")).cast("int")
    return (
        counted.filter(F.col("n_tokens") > 0)
        .join(rated.select("source", "rate"), "source")
        .withColumn("copies", copies)
        .filter(F.col("copies") > 0)
        .select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens")
    )


def shares(counted: DataFrame, rated: DataFrame, seed: int = 17) -> DataFrame:
    """Target and reached share of each listed source, with its rate, documents and tokens."""
    got = mixture(counted, rated, seed).groupBy("source").agg(F.count(F.lit(1)).alias("n_emitted"), F.sum("n_tokens").alias("tokens"))
    whole = got.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("whole"))
    share = F.when(F.col("whole") > 0, F.col("tokens") / F.col("whole")).otherwise(0.0)
    return (
        rated.join(got, "source", "left").fillna(0, ["n_emitted", "tokens"]).join(F.broadcast(whole), F.lit(True))
        .select("source", F.col("weight").alias("target_share"), share.alias("reached_share"), "rate", "max_repeats", "n_docs", "available", "n_emitted", "tokens")
    )
