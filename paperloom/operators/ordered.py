"""Ordered computations as windows (WN1-WN10, SR1, SR9, AG22-AG25, AG45, AG50, SC34)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import citation_key_base, nonempty


def moving_average(rows: DataFrame, value: str, order: list[str], part: list[str], width: int = 10) -> DataFrame:
    """WN1: mean of the last ``width`` values, once there are that many; groups with fewer as they are."""
    w = Window.partitionBy(*part).orderBy(*order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*part))
    mean = F.when(n < width, F.col(value)).otherwise(F.avg(value).over(w.rowsBetween(-(width - 1), 0)))
    return rows.withColumn("_at", F.row_number().over(w)).withColumn("_n", n).withColumn("trend", F.round(mean, 6)).filter((F.col("_n") < width) | (F.col("_at") >= width)).drop("_at", "_n")


def last_rows(rows: DataFrame, n: int, order: list[Column], part: list[str]) -> DataFrame:
    """WN2, SK23: the last n rows of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def cumulative_share(rows: DataFrame, value: str, order: list, marks: tuple[float, ...] = (0.95, 0.99)) -> tuple[DataFrame, DataFrame]:
    """WN3: running share of the total, and the first position at which each mark is reached."""
    w = Window.orderBy(*order)
    run = rows.withColumn("position", F.row_number().over(w)).withColumn("cumulative", F.round(F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(value).over(Window.partitionBy()), 9))
    return run, run.agg(*[F.min(F.when(F.col("cumulative") >= m, F.col("position"))).alias(f"n_{round(m * 100)}") for m in marks])


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """WN5: remaining time if it goes on as it went; null before anything is done."""
    return F.when((done > 0) & (total > 0), elapsed / done * (total - done))


def eta_ema(times: Column, remaining: Column, alpha: float = 0.3) -> Column:
    """WN5: remaining time by the exponential mean of the times of single items, in their order."""
    ema = F.aggregate(times, F.lit(None).cast("double"), lambda s, x: F.when(s.isNull(), x).otherwise(alpha * x + (1 - alpha) * s))
    return ema * remaining


def eta_bounds(times: Column, remaining: Column) -> Column:
    """WN5: least, mean and greatest remaining time."""
    mean = F.aggregate(times, F.lit(0.0), lambda s, x: s + x) / F.size(times)
    return F.when(F.size(times) > 0, F.struct((F.array_min(times) * remaining).alias("least"), (mean * remaining).alias("mean"), (F.array_max(times) * remaining).alias("most")))


def prune_context(turns: DataFrame, budget: int = 4096, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """WN7: the latest turns of each conversation within a budget of tokens; a leading system turn always stays."""
    tokens = F.floor(F.length("text") / 4)
    w = Window.partitionBy(conversation).orderBy(order)
    pinned = (F.row_number().over(w) == 1) & (F.col("role") == "system")
    rows = turns.withColumn("tokens", F.coalesce(tokens, F.lit(0))).withColumn("pinned", pinned)
    room = F.lit(budget) - F.coalesce(F.sum(F.when(F.col("pinned"), F.col("tokens"))).over(Window.partitionBy(conversation)), F.lit(0))
    later = Window.partitionBy(conversation, "pinned").orderBy(F.col(order).desc())
    rows = rows.withColumn("room", room).withColumn("later", F.sum("tokens").over(later.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter(F.col("pinned") | (F.col("later") <= F.col("room"))).drop("room", "later")


def context_usage(turns: DataFrame, budget: int = 4096, conversation: str = "conv_id") -> DataFrame:
    """WN8: tokens of each conversation, their share of the budget and its state."""
    got = turns.groupBy(conversation).agg(F.count(F.lit(1)).alias("n_turns"), F.sum(F.coalesce(F.floor(F.length("text") / 4), F.lit(0))).alias("tokens"))
    share = F.round(F.col("tokens") * 100.0 / budget, 6)
    return got.withColumn("pct", share).withColumn("state", F.when(share >= 95, "critical").when(share >= 80, "warning").otherwise("healthy"))


def numbered_keys(rows: DataFrame, order: str) -> DataFrame:
    """WN10: citation keys made unique: titles that come later under the same base key get 2, 3 and so on."""
    base = citation_key_base(F.col("title"), F.col("authors"), F.col("year"))
    title = F.lower(F.trim("title"))
    keyed = rows.withColumn("base_key", base).withColumn("_title", title)
    first = keyed.groupBy("base_key", "_title").agg(F.min(order).alias("_first"))
    rank = first.withColumn("_rank", F.row_number().over(Window.partitionBy("base_key").orderBy("_first"))).select("base_key", F.col("_title").alias("_t"), "_rank")
    out = keyed.withColumnRenamed("base_key", "_base").join(rank, (F.col("_base") == F.col("base_key")) & F.col("_title").eqNullSafe(F.col("_t")))
    return out.withColumn("citation_key", F.when(F.col("_rank") > 1, F.concat("base_key", F.col("_rank").cast("string"))).otherwise(F.col("base_key"))).drop("_base", "_title", "_t", "_rank")


def relevance(as_of_year: int = 2025) -> Column:
    """SR1: citations, recency, source and completeness of a search result."""
    age = F.lit(as_of_year) - F.col("year")
    cited = F.coalesce(F.least(F.lit(1.0), F.col("citation_count") / 100.0) * 0.4, F.lit(0.0))
    recent = F.when(~nonempty(F.col("year"), "number"), 0.0).when(age <= 10, (1.0 - age / 10.0) * 0.3).when(age <= 20, 0.1).otherwise(0.0)
    source = F.when(F.col("source") == "semanticscholar", 0.15).when(F.col("source").isin("arxiv", "pubmed", "crossref"), 0.1).otherwise(0.05) * 0.1
    part = lambda c, v: F.when(c, v).otherwise(0.0)
    whole = part(nonempty(F.col("doi")), 0.2) + part(F.coalesce(F.length("abstract") > 100, F.lit(False)), 0.3) + part(nonempty(F.col("venue")), 0.2) + part(nonempty(F.col("pdf_url")), 0.3)
    return cited + recent + source + whole * 0.2


def hourly_metrics(events: DataFrame, time: str, value: str, failed: Column) -> DataFrame:
    """AG22, SM5: operations, mean value and failures per hour."""
    hour = F.date_trunc("hour", F.col(time))
    return events.groupBy(hour.alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_value"), F.count_if(failed).alias("n_failed"))


def running_metrics(events: DataFrame, order: list, value: str, failed: Column, part: list[str]) -> DataFrame:
    """AG22: the running aggregate after each operation, with failures over all operations so far."""
    w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return events.withColumn("n_so_far", F.count(F.lit(1)).over(w)).withColumn("mean_so_far", F.round(F.avg(value).over(w), 6)).withColumn("failure_rate", F.round(F.sum(failed.cast("int")).over(w) / F.col("n_so_far"), 6))


def health(events: DataFrame, order: list, value: str, failed: Column, part: list[str], n: int = 50) -> DataFrame:
    """AG24: state by success and mean value of each group's last n operations."""
    last = last_rows(events.withColumn("_failed", failed), n, order, part)
    got = last.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.round(1 - F.avg(F.col("_failed").cast("int")), 6).alias("success_rate"), F.round(F.avg(value), 6).alias("mean_value"))
    rate = F.col("success_rate")
    return got.withColumn("state", F.when(rate >= 0.9, "excellent").when(rate >= 0.75, "good").when(rate >= 0.5, "fair").otherwise("poor"))


def log_statistics(events: DataFrame, operation: str, error: Column, duration: str) -> DataFrame:
    """AG25, AG23: operations, errors and total duration per operation."""
    return events.groupBy(operation).agg(F.count(F.lit(1)).alias("n"), F.count_if(error).alias("errors"), F.round(F.sum(duration), 4).alias("total_duration"))


def slow_stages(stages: DataFrame, name: str, seconds: str) -> DataFrame:
    """AG45: stages that take more than twice the mean."""
    mean = stages.agg(F.round(F.avg(seconds), 6).alias("mean"))
    return stages.join(F.broadcast(mean), F.lit(True)).filter(F.col(seconds) > 2 * F.col("mean")).select(name, seconds, "mean")


def source_health(events: DataFrame, source: str, order: list, failed: Column, limit: int = 3) -> DataFrame:
    """SC34, AG47: failures in a row at the end of each source's log; healthy below ``limit``."""
    w = Window.partitionBy(source).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    good_later = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    trailing = events.withColumn("_good", good_later).groupBy(source).agg(F.count_if(F.col("_good") == 0).alias("consecutive_failures"))
    return trailing.withColumn("healthy", F.col("consecutive_failures") < limit)


def log_dedup_batch(log: DataFrame, message: str, time: str, part: list[str], seconds: float = 1.0) -> DataFrame:
    """WN6, SM9 in batch: a message is dropped within a second of the last one kept; warnings always stay.

    The fold keeps only the time of the last kept message, so that it runs over a sorted list per message."""
    times = F.array_sort(F.collect_list(F.struct((F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"), F.col("event_id").alias("id"))))
    start = F.struct(F.lit(None).cast("double").alias("kept"), F.array().cast("array<bigint>").alias("ids"))
    fold = F.aggregate(times, start, lambda s, x: F.when(s["kept"].isNull() | (x["t"] - s["kept"] > seconds), F.struct(x["t"].alias("kept"), F.concat(s["ids"], F.array(x["id"])).alias("ids"))).otherwise(s))
    return log.groupBy(*part, message).agg(fold["ids"].alias("ids")).select(*part, message, F.explode("ids").alias("event_id"))
