"""Declarative selection of papers (FL2-FL8, FL12-FL16, FL18, FL19, FL21-FL23, AG46, SC39)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import nonempty


@dataclass
class Selection:
    """What to select; an empty field does not restrict."""

    citation_keys: list[str] = field(default_factory=list)
    year_min: int | None = None
    year_max: int | None = None
    sources: list[str] = field(default_factory=list)
    has_pdf: bool | None = None
    has_summary: bool | None = None
    keywords: list[str] = field(default_factory=list)
    limit: int | None = None

    @classmethod
    def from_dict(cls, spec: dict) -> Selection:
        """SC39: from the parsed form of a selection file, with years as {min, max}."""
        spec = spec.get("selection", spec)
        years = spec.get("years") or {}
        rest = {k: v for k, v in spec.items() if k in cls.__dataclass_fields__ and v is not None}
        return cls(**rest | {"year_min": years.get("min"), "year_max": years.get("max")})


def keyword_filter(keyword: str, title: str = "title", abstract: str = "abstract") -> Column:
    """FL8: the keyword at the start of a word of title or abstract, whatever its case."""
    whole = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(abstract, F.lit(""))))
    return whole.rlike(r"(?:^|[^\p{L}\p{N}_])" + re.sub(r"([^\w\s])", r"\\\1", keyword.lower()))


def select(library: DataFrame, spec: Selection, artifacts: DataFrame | None = None, order: str = "citation_key") -> DataFrame:
    """FL2: all conditions of the selection, then its first rows by ``order``."""
    out = library
    if spec.citation_keys:
        out = out.filter(F.col("citation_key").isin(*spec.citation_keys))
    if spec.year_min is not None or spec.year_max is not None:
        out = out.filter(F.col("year").isNotNull())
        out = out.filter(F.col("year") >= spec.year_min) if spec.year_min is not None else out
        out = out.filter(F.col("year") <= spec.year_max) if spec.year_max is not None else out
    if spec.sources:
        out = out.filter(F.col("source").isin(*spec.sources))
    for kind, want in (("pdf", spec.has_pdf), ("summary", spec.has_summary)):
        if want is not None:
            out = out.join(present(artifacts, kind), "citation_key", "left_semi" if want else "left_anti")
    for k in spec.keywords:
        out = out.filter(keyword_filter(k))
    return out.orderBy(order).limit(spec.limit) if spec.limit is not None else out


def present(artifacts: DataFrame, kind: str) -> DataFrame:
    """Keys that have a file of a kind which has not been deleted."""
    return artifacts.filter((F.col("kind") == kind) & F.col("deleted_at").isNull()).select("citation_key").distinct()


def selection_summary(library: DataFrame, selected: DataFrame) -> DataFrame:
    """AG46: rows, selected rows and their share."""
    a, b = library.agg(F.count(F.lit(1)).alias("total")), selected.agg(F.count(F.lit(1)).alias("selected"))
    return a.join(b, F.lit(True)).withColumn("rate", F.when(F.col("total") > 0, F.round(F.col("selected") / F.col("total"), 6)).otherwise(0.0))


def download_failure(message: Column, status: Column | None = None) -> Column:
    """FL18, FL22: reason of a failed download by the message and the status, in this order."""
    low = F.lower(message)
    code = status if status is not None else F.nullif(F.regexp_extract(message, r"(?:HTTP |status )(\d{3})", 1), F.lit("")).cast("int")
    has = lambda *words: low.rlike("|".join(words))
    return (
        F.when(message.isNull(), None).when(message.contains("Received HTML instead of PDF"), "html_response").when(message.contains("no working PDF URLs found in content"), "html_no_pdf_link")
        .when(message.contains("Content-Type mismatch"), "content_mismatch").when((code == 403) | has("forbidden"), "access_denied").when((code == 404) | has("not found"), "not_found")
        .when(code == 429, "rate_limited").when(code >= 500, "server_error").when(has("timeout", "timed out"), "timeout").when(has("connection", "network"), "network_error")
        .when(has("redirect") & has("loop"), "redirect_loop").otherwise("unknown")
    )


def is_retriable(reason: Column) -> Column:
    """FL13."""
    return F.coalesce(reason.isin("network_error", "timeout"), F.lit(False))


def summary_failure(message: Column) -> Column:
    """FL19: label of a failed summary by words of the message, in this order."""
    low = F.lower(message)
    return (
        F.when(message.isNull(), None).when(low.contains("repetition"), "Repetition Issues").when(low.contains("hallucination"), "Hallucination").when(low.contains("title mismatch"), "Title Mismatch")
        .when(low.rlike("connection|llm"), "LLM Connection Error").when(low.contains("timeout"), "Timeout").when(low.contains("context") & low.contains("limit"), "Context Limit Exceeded")
        .when(low.rlike("extraction|pdf"), "PDF Extraction Error").when(low.rlike("empty|no text"), "Empty/No Content").otherwise("Other Error")
    )


def failures(progress: DataFrame) -> DataFrame:
    """AG49: failures per label with their share and the smallest two keys as examples."""
    rows = progress.filter(F.col("status") == "failed").select("entry_id", "citation_key", summary_failure(F.coalesce("last_error", F.lit(""))).alias("label")).distinct()
    # the two smallest keys come from two passes of a bounded aggregate, not from a list of all
    first = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("citation_key").alias("example"))
    total = first.agg(F.sum("n").alias("total"))
    return first.join(F.broadcast(total), F.lit(True)).select("label", "n", F.round(F.col("n") * 100.0 / F.col("total"), 6).alias("percentage"), "example")


def missing_doi(library: DataFrame) -> DataFrame:
    """FL10."""
    return library.filter(~nonempty(F.col("doi")))


def listing(library: DataFrame) -> DataFrame:
    """FL21: what a list of papers shows."""
    first = F.when(F.size("authors") > 1, F.concat(F.element_at("authors", 1), F.lit(" et al."))).when(F.size("authors") == 1, F.element_at("authors", 1)).otherwise("Unknown")
    return library.select("citation_key", F.left("title", F.lit(70)).alias("title"), first.alias("authors"), "year", F.nullif("doi", F.lit("")).alias("doi"), nonempty(F.col("pdf_path")).alias("has_pdf"))


def pdf_magic(content: Column) -> Column:
    """FL17: whether bytes begin as a PDF."""
    return F.coalesce(F.substring(content, 1, 4) == F.lit(b"%PDF"), F.lit(False))


def html_magic(content: Column) -> Column:
    """FL17: whether the first 1,024 bytes hold an HTML marker."""
    head = F.lower(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return F.coalesce(head.rlike("<!doctype html|<html|<head|<body|<title|<meta|<div|<script|<link|<p>"), F.lit(False))
