import pytest
from pyspark.sql import functions as F

from paperloom.functions import mentions as men
from paperloom.functions import text as tx


def one(spark, schema, row, **exprs):
    return spark.createDataFrame([row], schema).select(*[e.alias(n) for n, e in exprs.items()]).collect()[0]


@pytest.mark.parametrize(("title", "authors", "year", "key"), [
    ("Deep Learning for NLP", ["John Smith"], 2024, "smith2024deep"), ("Collaborative Research", ["Jane Doe", "X Y"], 2023, "doe2023collaborative"), ("Undated Paper", ["Author Name"], None, "namenodateundated"),
    ("Anonymous Paper", [], 2024, "anonymous2024anonymous"), ("What's New? A Study!", ["José García-López"], 2024, "garcíalópez2024whats"), ("Research Paper", ["Mary Jane Watson"], 2024, "watson2024research"), (None, None, 0, "anonymousnodatepaper"),
])
def test_citation_keys(spark, title, authors, year, key):
    got = one(spark, "t string, a array<string>, y int", (title, authors, year), k=tx.citation_key_base(F.col("t"), F.col("a"), F.col("y")))
    assert got.k == key


def test_scores(spark):
    a = F.array(F.lit("John Smith"), F.lit("Jane Doe"))
    got = spark.range(1).select(
        tx.author_overlap(a, F.array(F.lit("John Smith"), F.lit("Bob Johnson"))).alias("o"), tx.author_overlap(a, F.array(F.lit("X Y"))).alias("z"), tx.year_match(F.lit(2024), F.lit(2024)).alias("y0"), tx.year_match(F.lit(2024), F.lit(2023)).alias("y1"),
        tx.year_match(F.lit(2024), F.lit(2020)).alias("y4"), tx.year_match(F.lit(None).cast("int"), F.lit(2020)).alias("yn"), tx.title_similarity(F.lit("A b c d e f g"), F.lit("a b c d e f g h")).alias("s"), tx.title_similarity(F.lit(""), F.lit("x")).alias("e"),
    ).collect()[0]
    assert (got.o, got.z, got.y0, got.y1, round(got.y4, 6), got.yn, got.s, got.e) == (0.5, 0.0, 1.0, 0.8, 0.4, 0.5, 0.875, 0.0)


def test_small_functions(spark):
    got = spark.range(1).select(
        tx.normalize_title(F.lit("  Café: The\tStudy! ")).alias("n"), tx.keywords(F.lit("éouon auou This neural Neural x1 data_set")).alias("k"), tx.strip_thinking(F.lit("<think>a</think>b<thinking>open")).alias("t"), tx.format_duration(F.lit(90061.0)).alias("d"),
        tx.format_duration(F.lit(59.9)).alias("s"), tx.key_year(F.lit("smith2024deep")).alias("y"), tx.key_year(F.lit("smith1820deep")).alias("yo"), tx.key_year(F.lit("none")).alias("y0"), tx.count_references(F.lit("[3] and [12] see [x]")).alias("r"), tx.comparable(F.lit("## A  b 12 *c*")).alias("c"),
        tx.unique_ratio(F.lit("ab" * 300)).alias("u"), tx.unique_ratio(F.lit("")).alias("u0"), tx.estimate_tokens(F.lit("123456789")).alias("e"), tx.has_tables(F.lit(None).cast("string")).alias("h"), tx.hybrid_similarity(F.lit("a b c d"), F.lit("a b c d")).alias("hy"),
    ).collect()[0]
    assert (got.n, got.k, got.t, got.d, got.s, got.y, got.yo, got.y0, got.r) == ("café the study", ["auou", "neural"], "b", "1d 1h", "59s", 2024, None, None, 12)
    assert (got.c, round(got.u, 6), got.u0, got.e, got.h, round(got.hy, 9)) == (" a b N c", round(1 / 3, 6), 1.0, 2, False, 1.0)


def test_repositories_and_tools(spark):
    rows = [("a2020x", "PyTorch and NumPy, see https://github.com/u/r."), ("b2021y", "pytorch (github.com/u/s), jax"), ("c2022z", "numpy only"), ("d", None)]
    from paperloom.operators import mining

    got = {x.paper: (x.year, list(x.urls), list(x.tools)) for x in mining.mentions(spark.createDataFrame(rows, "paper string, text string")).collect()}
    assert got == {"a2020x": (2020, ["https://github.com/u/r"], ["NumPy", "PyTorch"]), "b2021y": (2021, ["https://github.com/u/s"], ["JAX", "PyTorch"])}
    pairs = mining.pair_jaccard(mining.mentions(spark.createDataFrame(rows, "paper string, text string")), "paper", "tools").collect()
    assert [(p.a, p.b, p.n, p.jaccard) for p in sorted(pairs)] == [("JAX", "PyTorch", 1, 0.5), ("NumPy", "PyTorch", 1, 0.5)]


def test_addresses(spark):
    doi = lambda d: spark.range(1).select(men.doi_pdf_urls(F.lit(d)).alias("u")).collect()[0].u
    page = lambda u: spark.range(1).select(men.alternative_pdf_urls(F.lit(u)).alias("u")).collect()[0].u
    assert doi("https://doi.org/10.1371/journal.pone.1") == ["https://journals.plos.org/plosone/article/file?id=10.1371/journal.pone.1&type=printable", "https://doi.org/10.1371/journal.pone.1"]
    assert doi("10.31234/osf.io/ab12")[0] == "https://osf.io/ab12/download"
    assert doi("10.1109/TPAMI.2020.123")[0] == "https://ieeexplore.ieee.org/document/123"
    assert page("https://arxiv.org/abs/2401.01234v2") == ["https://arxiv.org/pdf/2401.01234.pdf", "https://export.arxiv.org/pdf/2401.01234.pdf"]
    assert page("https://www.ncbi.nlm.nih.gov/pmc/articles/PMC77/")[0] == "https://www.ncbi.nlm.nih.gov/pmc/articles/PMC77/pdf/"
    assert page("https://nowhere.example/") == []


def test_domains(spark):
    got = spark.createDataFrame([("The patient received clinical treatment and therapy.", "Diagnosis of disease", None), ("", None, None)], "x string, t string, a string").select(men.detect_domain(F.col("x"), F.col("t"), F.col("a")).alias("d")).collect()
    assert got[0].d.domain == "medicine" and got[1].d.domain == "unknown" and got[1].d.confidence == 0.0
