"""The library against the files on disk, held in a table (JN1-JN12, JN20, JN21, FL9, FL11, AG13, AG14, AG17-AG21, SO1-SO4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import cache_key, nonempty
from paperloom.operators import overlap
from paperloom.operators.select import present

KINDS = ("pdf", "text", "summary")


def live(artifacts: DataFrame) -> DataFrame:
    """Files that are there, exact duplicate rows once."""
    return artifacts.filter(F.col("deleted_at").isNull()).select("kind", "citation_key", "path", "size").distinct()


def with_texts(library: DataFrame, corpus: DataFrame) -> DataFrame:
    """JN1, SC6: each paper with its text, its abstract where it has none; exact copies of a text once."""
    texts = corpus.select("citation_key", F.col("text").alias("full")).groupBy("citation_key").agg(F.max("full").alias("full"))
    text = F.coalesce(F.when(F.trim("full") != "", F.col("full")), F.nullif("abstract", F.lit("")))
    return library.join(texts, "citation_key", "left").select("citation_key", text.alias("text"), F.when(F.trim("full") != "", "text").when(nonempty(F.col("abstract")), "abstract").otherwise("none").alias("origin"))


def latest(log: DataFrame, key: str = "citation_key") -> DataFrame:
    """DD7, DD8, SM4: the last state of each key; a state delivered twice counts once."""
    return log.groupBy(key).agg(F.max_by(F.struct(*[c for c in log.columns if c != key]), F.struct("logged_at", "entry_id")).alias("s")).select(key, "s.*")


def needs_pdf(library: DataFrame, artifacts: DataFrame, failed: DataFrame, retry: bool = False) -> DataFrame:
    """JN4: papers without a PDF, those that failed before left out unless they are to be tried again."""
    out = library.join(present(artifacts, "pdf"), "citation_key", "left_anti")
    return out if retry else out.join(failed.select("citation_key").distinct(), "citation_key", "left_anti")


def needs_extraction(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN5: a PDF but no text."""
    return library.join(present(artifacts, "pdf"), "citation_key", "left_semi").join(present(artifacts, "text"), "citation_key", "left_anti")


def needs_summary(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN6, JN21: a PDF and a text but no summary."""
    both = library.join(present(artifacts, "pdf"), "citation_key", "left_semi").join(present(artifacts, "text"), "citation_key", "left_semi")
    return both.join(present(artifacts, "summary"), "citation_key", "left_anti")


def work_lists(library: DataFrame, artifacts: DataFrame, failed: DataFrame) -> DataFrame:
    """JN7: (citation_key, step) of what is to be done."""
    steps = (("pdf", needs_pdf(library, artifacts, failed)), ("extraction", needs_extraction(library, artifacts)), ("summary", needs_summary(library, artifacts)))
    out = None
    for step, rows in steps:
        part = rows.select("citation_key", F.lit(step).alias("step"))
        out = part if out is None else out.unionByName(part)
    return out


def orphaned_files(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN8, JN9, SO3: files whose paper is not in the library."""
    return live(artifacts).join(library.select("citation_key"), "citation_key", "left_anti")


def orphan_totals(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN9: number and size of orphaned files of each kind."""
    return orphaned_files(library, artifacts).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"))


def presence(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(citation_key, in_library, pdf, text, summary): existence of everything, from one aggregate of the files."""
    files = live(artifacts).groupBy("citation_key").agg(*[F.bool_or(F.col("kind") == k).alias(k) for k in KINDS])
    mine = library.select("citation_key", F.lit(True).alias("in_library"))
    no = F.lit(False)
    return mine.join(files, "citation_key", "full").select("citation_key", F.coalesce("in_library", no).alias("in_library"), *[F.coalesce(k, no).alias(k) for k in KINDS])


def analysis(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """JN10: counters of what the papers have and lack, and of what the files belong to."""
    p = presence(library, artifacts)
    mine = F.col("in_library")
    return p.agg(
        F.count_if(mine).alias("papers"), *[F.count_if(mine & F.col(k)).alias(f"with_{k}") for k in KINDS], *[F.count_if(mine & ~F.col(k)).alias(f"without_{k}") for k in KINDS],
        F.count_if(mine & F.col("pdf") & F.col("text") & F.col("summary")).alias("complete"), F.count_if(mine & ~F.col("pdf") & ~F.col("text") & ~F.col("summary")).alias("bare"),
        F.count_if(mine & F.col("pdf") & ~F.col("text")).alias("need_extraction"), F.count_if(mine & F.col("pdf") & F.col("text") & ~F.col("summary")).alias("need_summary"),
        *[F.count_if(~mine & F.col(k)).alias(f"orphaned_{k}") for k in KINDS],
    )


def library_stats(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """AG13, AG14: size of a library, what is downloaded and summarized, bytes of PDFs and years."""
    p = presence(library, artifacts).filter("in_library")
    have = p.agg(F.count(F.lit(1)).alias("papers"), F.count_if(F.col("pdf")).alias("downloaded"), F.count_if(F.col("summary")).alias("summarized"))
    size = live(artifacts).filter("kind = 'pdf'").join(library.select("citation_key"), "citation_key", "left_semi").agg(F.sum("size").alias("pdf_bytes"))
    years = library.agg(F.min(F.when(F.col("year") != 0, F.col("year"))).alias("first_year"), F.max(F.when(F.col("year") != 0, F.col("year"))).alias("last_year"))
    share = lambda c: F.when(F.col("papers") > 0, F.round(F.col(c) * 100.0 / F.col("papers"), 6)).otherwise(0.0)
    return have.join(size, F.lit(True)).join(years, F.lit(True)).select("*", share("downloaded").alias("pct_downloaded"), share("summarized").alias("pct_summarized"))


def report_rows(library: DataFrame, log: DataFrame, summaries: DataFrame) -> DataFrame:
    """JN2, SK17: each paper with its last state and its summary; a skipped paper is told from a failed one first."""
    state = latest(log.dropDuplicates(["entry_id"])).select("citation_key", F.col("status").alias("last_status"), "download_attempts", "last_error")
    done = summaries.groupBy("citation_key").agg(F.max("quality_score").alias("quality_score"), F.max("output_words").alias("output_words"))
    status = F.when(F.col("last_status").isNull(), "skipped").when(F.col("last_status") == "failed", "failed").when(F.col("quality_score").isNotNull() | (F.col("last_status") == "summarized"), "summarized").otherwise(F.col("last_status"))
    return library.select("citation_key", "title", "year", "source").join(state, "citation_key", "left").join(done, "citation_key", "left").select("citation_key", "title", "year", "source", status.alias("status"), "download_attempts", "last_error", "quality_score", "output_words")


def cached(texts: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """JN11, ST34: each text with the key of its embedding and whether the cache has it."""
    keyed = texts.withColumn("text_key", cache_key(F.col(text)))
    return keyed.join(cache.select(F.col("text_key"), F.lit(True).alias("hit")).distinct(), "text_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def missing_vectors(library: DataFrame, embeddings: DataFrame) -> DataFrame:
    """JN12, SO4: papers that should have a vector and have none."""
    return library.select("citation_key").join(embeddings.filter(F.col("vec").isNotNull() & ~F.coalesce("skipped", F.lit(False))).select("citation_key"), "citation_key", "left_anti")


def progress_counters(log: DataFrame, per: str = "run_id") -> DataFrame:
    """AG17, AG18, AG20: states of each run's papers, success and completion in percent, mean time of a summary."""
    last = log.dropDuplicates(["entry_id"]).groupBy(per, "citation_key").agg(F.max_by(F.struct("status", "summary_time"), F.struct("logged_at", "entry_id")).alias("s")).select(per, "s.*")
    is_ = lambda s: F.count_if(F.col("status") == s)
    got = last.groupBy(per).agg(F.count(F.lit(1)).alias("total"), is_("summarized").alias("successful"), is_("failed").alias("failed"), is_("downloaded").alias("downloaded"), is_("pending").alias("pending"), F.round(F.avg(F.when(F.col("summary_time") > 0, F.col("summary_time"))), 6).alias("mean_time"))
    pct = lambda c: F.round(c * 100.0 / F.col("total"), 6)
    return got.withColumn("pct_success", pct(F.col("successful"))).withColumn("pct_complete", pct(F.col("successful") + F.col("failed")))


def summary_statistics(summaries: DataFrame) -> DataFrame:
    """AG21: averages over positive values only, sums over all."""
    rows = summaries.groupBy("citation_key").agg(F.max("input_words").alias("i"), F.max("output_words").alias("o"), F.max("quality_score").alias("q"), F.max("attempts").alias("a"))
    mean = lambda c: F.round(F.avg(F.when(F.col(c) > 0, F.col(c))), 6)
    return rows.agg(F.count(F.lit(1)).alias("n"), mean("i").alias("mean_input"), mean("o").alias("mean_output"), mean("q").alias("mean_quality"), F.sum("i").alias("sum_input"), F.sum("o").alias("sum_output"), F.sum("a").alias("sum_attempts"))


def related_papers(library: DataFrame, profiles: DataFrame, most: int = 5) -> DataFrame:
    """JN16: for each profile (citation_key, keywords) the papers whose abstracts share most of its keywords.

    Shared keywords are counted on an index of bits, for all papers at once; no pair but the best is written."""
    from paperloom.functions.text import keywords

    def search(index: overlap.Index, paper: str, words: list[str]) -> list[tuple[str, int, float]]:
        # one more than asked for, since the paper itself may be among them
        found = [(index.idents[at], n) for at, n in overlap.top(index, words, most + 1) if index.idents[at] != paper]
        return [(key, rank, float(n)) for rank, (key, n) in enumerate(found[:most], 1)]

    def merge(before: overlap.Found, found: overlap.Found) -> overlap.Found:
        # of papers that share as many, those of the blocks before come first
        both = sorted([*before, *found], key=lambda r: -r[2])[:most]
        return [(key, rank, n) for rank, (key, _, n) in enumerate(both, 1)]

    named = F.col("citation_key").isNotNull()
    asked = profiles.filter(named & F.col("keywords").isNotNull()).select(F.col("citation_key").alias("query"), F.array_distinct("keywords").alias("words"))
    items = library.filter(named & F.col("abstract").isNotNull()).select(F.col("citation_key").alias("ident"), F.lit(0).alias("rank"), "abstract")
    found, _ = overlap.asked(items, keywords(F.col("abstract")), asked, search, merge=merge)
    best = found.select(F.col("query").alias("paper"), F.col("ident").alias("citation_key"), F.col("value").cast("bigint").alias("shared"), "rank")
    return best.select("paper", "citation_key", "shared", F.round(F.col("shared") * 0.1, 6).alias("score"), "rank")
