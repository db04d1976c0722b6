"""Duplicates and upserts (DD1-DD8, JN13-JN15, FL20, WN10, SK3, SK4)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.functions.text import author_overlap, nonempty, normalize_title, title_similarity, words, year_match
from paperloom.operators import overlap
from paperloom.operators.ordered import numbered_keys, relevance
from paperloom.runtime import checkpoint

SIMILAR = 0.85


def connected(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, label): smallest node of each connected set of (a, b) edges, by minimum labels with shortcuts."""
    both = checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label"))
    for _ in range(rounds):
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("o")), "b").groupBy("a").agg(F.min("o").alias("m"))
        step = labels.join(near, "a").select("a", "label", F.least("label", "m").alias("new"))
        jump = checkpoint(step.join(step.select(F.col("a").alias("new"), F.col("new").alias("root")), "new", "left").select("a", "label", F.least("new", F.coalesce("root", "new")).alias("new")))
        moved = jump.filter("new <> label").limit(1).count()
        labels = jump.select("a", F.col("new").alias("label"))
        if not moved:
            return labels.withColumnRenamed("a", "node")
    raise RuntimeError("labels have not converged")


def similar_titles(titles: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """JN15: (a, b, similarity) of different normalized titles with a Jaccard similarity at or above the threshold.

    Exact prefix filter: of two word sets that similar, the rarest words of the one include one of the
    rarest of the other; only as many words as that needs are joined. Titles are different, so equal
    ones form no pairs however often they occur."""
    t = titles.select("title").distinct().withColumn("w", words(F.col("title"))).filter(F.size("w") > 0)
    df = t.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    ranked = t.select("title", F.size("w").alias("size"), F.explode("w").alias("x")).join(df, "x")
    at = F.row_number().over(Window.partitionBy("title").orderBy("n", "x"))
    prefix = ranked.withColumn("at", at).filter(F.col("at") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("title", "size", "x")
    a, b = prefix.select(F.col("title").alias("a"), F.col("size").alias("sa"), "x"), prefix.select(F.col("title").alias("b"), F.col("size").alias("sb"), "x")
    small = (F.col("sa") >= threshold * F.col("sb")) & (F.col("sb") >= threshold * F.col("sa"))
    pairs = a.join(b, "x").filter((F.col("a") < F.col("b")) & small).select("a", "b").distinct()
    wa, wb = words(F.col("a")), words(F.col("b"))
    sim = F.size(F.array_intersect(wa, wb)) / F.size(F.array_union(wa, wb))
    return pairs.withColumn("similarity", sim).filter(F.col("similarity") >= threshold - 1e-12)


def _better(a, b) -> bool:
    """FL20: whether a row replaces the one kept so far."""
    if bool(a.doi) != bool(b.doi):
        return bool(a.doi)
    if pd.notna(a.citation_count) and pd.notna(b.citation_count) and a.citation_count != b.citation_count:
        return a.citation_count > b.citation_count
    if len(a.abstract or "") != len(b.abstract or ""):
        return len(a.abstract or "") > len(b.abstract or "")
    return bool(a.venue) and not b.venue


def _fold(block: pd.DataFrame) -> pd.DataFrame:
    """The sequential rule within titles that can meet each other: first similar title keeps its place."""
    kept: dict[str, tuple] = {}
    for row in block.sort_values("seq").itertuples(index=False):
        mine, hit = set(row.normal.split()), None
        if row.normal in kept:
            hit = row.normal
        else:
            for title in kept:
                other = set(title.split())
                if mine and other and len(mine & other) / len(mine | other) >= SIMILAR:
                    hit = title
                    break
        if hit is None:
            kept[row.normal] = (row.seq, row)
        elif _better(row, kept[hit][1]):
            kept[hit] = (kept[hit][0], row)
    return pd.DataFrame([(place, r.seq) for place, r in kept.values()], columns=["place", "seq"])


def deduplicated(results: DataFrame) -> DataFrame:
    """DD1, DD2: (place, seq) of the hits that stay. Hits with a DOI: the first of each. Hits without: the
    first title and the best row of those similar to it, within sets of titles that are connected."""
    by_doi = results.filter(nonempty(F.trim("doi"))).groupBy(F.lower(F.trim("doi")).alias("d")).agg(F.min("seq").alias("seq")).select(F.col("seq").alias("place"), "seq")
    rest = results.filter(~nonempty(F.trim("doi"))).withColumn("normal", F.coalesce(normalize_title(F.col("title")), F.lit("")))
    label = connected(similar_titles(rest.select(F.col("normal").alias("title"))).select("a", "b"))
    # rows of one title that compare alike are reduced to the first of them before they meet in one task
    alike = [F.col("normal"), nonempty(F.col("doi")).alias("_d"), F.col("citation_count").alias("_c"), F.length(F.coalesce("abstract", F.lit(""))).alias("_l"), nonempty(F.col("venue")).alias("_v")]
    ends = rest.join(rest.groupBy(*alike).agg(F.min("seq").alias("seq")).select("seq"), "seq")
    block = ends.join(label.withColumnsRenamed({"node": "normal", "label": "block"}), "normal", "left").withColumn("block", F.coalesce("block", "normal"))
    cols = ["block", "normal", "seq", "doi", "citation_count", "abstract", "venue"]
    folded = block.select(*cols).groupBy("block").applyInPandas(lambda x: _fold(x), "place bigint, seq bigint")
    return by_doi.unionByName(folded)


def ranked(results: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """DD1 with SR1: the hits that stay, best first; rank is their order."""
    kept = results.join(deduplicated(results), "seq")
    return kept.withColumn("score", F.round(relevance(as_of_year), 9)).select("seq", "place", "score")


def new_entries(results: DataFrame, library: DataFrame) -> DataFrame:
    """DD3: hits that the library has neither by DOI nor by title, the first of each, with their new keys."""
    fresh = results.join(library.filter("doi <> ''").select("doi").distinct(), "doi", "left_anti") if "doi" in library.columns else results
    low = fresh.withColumn("_t", F.lower(F.trim("title")))
    low = low.join(library.select(F.lower(F.trim("title")).alias("_t")).distinct(), "_t", "left_anti")
    by_doi = F.row_number().over(Window.partitionBy(F.coalesce(F.nullif("doi", F.lit("")), F.concat(F.lit("#"), F.col("seq").cast("string")))).orderBy("seq"))
    by_title = F.row_number().over(Window.partitionBy("_t").orderBy("seq"))
    first = low.withColumn("_r", by_doi).filter("_r = 1").drop("_r").withColumn("_r", by_title).filter("_r = 1").drop("_r", "_t")
    return numbered_keys(first, "seq")


def as_results(library: DataFrame) -> DataFrame:
    """FL15, FL16: library entries in the layout of search results, for searches over both."""
    return library.select(
        "title", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "year", "abstract", "url", F.nullif("doi", F.lit("")).alias("doi"),
        F.coalesce("source", F.lit("library")).alias("source"), F.col("pdf_path").alias("pdf_url"), "venue", "citation_count",
    )


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """DD4, DD8: rows of ``changes`` replace those of the same key field by field where they are not null; new ones are added."""
    cols = [c for c in table.columns if c != key]
    new = changes.select(key, *[F.col(c).alias(f"_{c}") for c in cols if c in changes.columns])
    return table.join(new, key, "full").select(key, *[F.coalesce(f"_{c}", c).alias(c) if c in changes.columns else F.col(c) for c in cols])


def best_enrichment(entries: DataFrame, results: DataFrame, least: float = SIMILAR) -> DataFrame:
    """JN13, JN14, JN22: the best hit of each entry by .6 title, .3 authors, .1 year; sources in their order of trust.

    Candidates are the pairs of similar titles of an entry and a hit, found on an index of bits. Hits that score
    alike for any entry are one, the first of them."""
    a = entries.withColumn("na", normalize_title(F.col("title")))
    b = results.withColumn("nb", normalize_title(F.col("title")))
    trust = F.when(F.col("source") == "crossref", 0).when(F.col("source") == "semanticscholar", 1).when(F.col("source") == "openalex", 2).otherwise(3)
    r = b.filter(nonempty(F.col("doi")) & F.col("nb").isNotNull()).groupBy("nb", F.col("authors").alias("ra"), F.col("year").alias("ry"), trust.alias("trust"))
    r = checkpoint(r.agg(F.min(F.struct("seq", "source", "doi")).alias("first")).select("nb", "ra", "ry", "trust", "first.*"))
    e = a.filter(F.col("na").isNotNull()).select("citation_key", "na", F.col("authors").alias("ea"), F.col("year").alias("ey"))

    def search(index: overlap.Index, title: str, asks: list[str]) -> list[tuple[str, int, float]]:
        at, s = overlap.similar(index, asks, SIMILAR - 1e-12)
        return [(index.idents[p], 0, float(x)) for p, x in zip(at, s, strict=True) if index.idents[p] != title]

    wordy = lambda df: df.filter(F.size("words") > 0)
    mine = wordy(e.select(F.col("na").alias("query")).distinct().withColumn("words", words(F.col("query"))))
    theirs = r.select(F.col("nb").alias("ident"), F.lit(0).alias("rank")).distinct()
    near, _ = overlap.asked(theirs, words(F.col("ident")), mine, search)
    same = r.select(F.col("nb").alias("a"), F.col("nb").alias("b"), F.lit(1.0).alias("similarity")).distinct()
    links = near.select(F.col("query").alias("a"), F.col("ident").alias("b"), F.col("value").alias("similarity")).unionByName(same)
    both = e.join(links, F.col("na") == F.col("a")).join(r, F.col("nb") == F.col("b"))
    score = 0.6 * F.col("similarity") + 0.3 * author_overlap(F.col("ea"), F.col("ra")) + 0.1 * year_match(F.col("ey"), F.col("ry"))
    got = both.withColumn("score", F.round(score, 9)).filter(F.col("score") >= least)
    rank = F.row_number().over(Window.partitionBy("citation_key").orderBy("trust", F.col("score").desc(), "seq"))
    return got.withColumn("r", rank).filter("r = 1").select("citation_key", "seq", "doi", "source", "score")


def title_matches(a: Column, b: Column, least: float = 0.7) -> Column:
    """SC11, SC29: whether a found title is the one asked for."""
    return title_similarity(a, b) >= least
