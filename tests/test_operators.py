import datetime as dt
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.operators import features, inventory, meta, ordered, resolve
from paperloom.operators import select as sel
from paperloom.operators import vectors as vec

LIB = "citation_key string, title string, authors array<string>, year int, doi string, source string, url string, pdf_path string, added_date string, abstract string, venue string, citation_count int, metadata map<string,string>, n int"


def lib(spark, rows):
    full = [{"citation_key": f"k{i}", "title": "No title", "authors": [], "year": None, "doi": None, "source": None, "url": None, "pdf_path": None, "added_date": "2024-01-01T00:00:00", "abstract": None, "venue": None, "citation_count": None, "metadata": None, "n": i} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r[c.split()[0]] for c in LIB.replace("map<string,string>", "m").split(", ")) for r in full], LIB)


def test_rates_and_ranges(spark):
    x = lib(spark, [{"year": 2020, "doi": "1"}, {"year": 2021, "doi": "2"}, {"year": 2022, "doi": "3"}, {"year": 0}, {"year": None}])
    assert meta.year_range(x, 2021, 2022).count() == 2 and meta.year_range(x, 2021).count() == 2 and meta.year_range(x).count() == 4
    got = meta.publication_rate(x.filter("year > 0")).collect()[0]
    assert (got.average_per_year, got.growth_rate, got.peak_year) == (1.0, 0.0, 2020)
    q = meta.data_quality(x).collect()[0]
    assert (q.n, q.n_years) == (5, 3)


def test_empty_library(spark):
    x = lib(spark, [])
    assert meta.data_quality(x).collect()[0].n == 0 and meta.by_year(x).count() == 0 and meta.emerging_keywords(x).count() == 0 and meta.citation_stats(x).collect()[0].n == 0
    assert meta.publication_rate(x).collect()[0].average_per_year == 0.0


def test_emerging(spark):
    x = lib(spark, [{"title": "alpha", "year": y} for y in (2018, 2019)] + [{"title": "alpha omega", "year": y} for y in (2020, 2021, 2022)])
    got = {r.keyword: r.ratio for r in meta.emerging_keywords(x).collect()}
    assert got == {"alpha": 1.5, "omega": float("inf")}


def test_pairs_and_ties(spark):
    x = lib(spark, [{"authors": ["B", "A", "A", ""], "venue": "V"}, {"authors": ["A", "B"], "venue": "U"}, {"authors": None}])
    assert [(r.a, r.b, r.n) for r in meta.pair_counts(x, "citation_key", "authors").collect()] == [("A", "B", 2)]
    assert [r.value for r in meta.top(meta.counts_of(x, "venue"), 1).collect()] == ["U"]


def test_selection(spark):
    x = lib(spark, [{"title": "Learning Paper", "year": 2023, "source": "arxiv"}, {"title": "Relearning Paper", "year": 2024, "source": "arxiv"}, {"title": "x", "abstract": "deep learning", "year": None, "source": "crossref"}])
    keys = lambda s: sorted(r.citation_key for r in sel.select(x, s).collect())
    assert keys(sel.Selection(keywords=["learning"])) == ["k0", "k2"] and keys(sel.Selection(year_min=2023)) == ["k0", "k1"] and keys(sel.Selection(sources=["arxiv"], keywords=["re"], limit=5)) == ["k1"]
    assert keys(sel.Selection.from_dict({"selection": {"years": {"min": 2024}, "sources": ["arxiv"]}})) == ["k1"]


def test_inventory(spark):
    x = lib(spark, [{}, {}, {}])
    a = spark.createDataFrame([("pdf", "k0", "p0", 5, None), ("pdf", "k0", "p0", 5, None), ("text", "k0", "t0", 1, None), ("pdf", "k1", "p1", None, None), ("pdf", "zz", "pz", 7, None), ("pdf", "k2", "p2", 1, dt.datetime(2024, 1, 1))], "kind string, citation_key string, path string, size bigint, deleted_at timestamp")
    none = spark.createDataFrame([("k2",)], "citation_key string")
    work = {(r.citation_key, r.step) for r in inventory.work_lists(x, a, none.limit(0)).collect()}
    assert work == {("k2", "pdf"), ("k1", "extraction"), ("k0", "summary")}
    assert inventory.needs_pdf(x, a, none).count() == 0 and inventory.needs_pdf(x, a, none, retry=True).count() == 1
    got = inventory.analysis(x, a).collect()[0]
    assert (got.papers, got.with_pdf, got.bare, got.orphaned_pdf) == (3, 2, 1, 1)
    assert [(r.kind, r.n, r.bytes) for r in inventory.orphan_totals(x, a).collect()] == [("pdf", 1, 7)]


def brute_dedup(rows):
    out, seen, reps = [], set(), {}
    for r in sorted(rows, key=lambda r: r[0]):
        doi = (r[2] or "").strip()
        if doi:
            if doi.lower() not in seen:
                seen.add(doi.lower())
                out.append(r[0])
    better = lambda a, b: a[3] > b[3] if a[3] is not None and b[3] is not None and a[3] != b[3] else len(a[4] or "") > len(b[4] or "") if len(a[4] or "") != len(b[4] or "") else bool(a[5]) and not b[5]
    for r in sorted(rows, key=lambda r: r[0]):
        if (r[2] or "").strip():
            continue
        t = " ".join((r[1] or "").lower().split())
        w = set(t.split())
        hit = t if t in reps else next((k for k in reps if w and k.split() and len(w & set(k.split())) / len(w | set(k.split())) >= 0.85), None)
        if hit is None:
            reps[t] = r
        elif better(r, reps[hit]):
            reps[hit] = r
    return sorted(out + [r[0] for r in reps.values()])


@pytest.mark.parametrize("seed", range(3))
def test_dedup_against_brute_force(spark, seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(9)]
    rows = []
    for i in range(60):
        title = " ".join(sorted(rng.sample(vocab, rng.choice([6, 7, 7, 8]))))
        rows.append((i, title if rng.random() > 0.05 else None, rng.choice([None, "", "10.1/a", " 10.1/A", "10.1/b"]), rng.choice([1, 5, 9]), rng.choice(["", "abc", "abcdef"]), rng.choice([None, "v"])))
    df = spark.createDataFrame(rows, "seq bigint, title string, doi string, citation_count int, abstract string, venue string")
    assert sorted(r.seq for r in resolve.deduplicated(df).collect()) == brute_dedup(rows)


def test_dedup_empty(spark):
    df = spark.createDataFrame([], "seq bigint, title string, doi string, citation_count int, abstract string, venue string")
    assert resolve.deduplicated(df).count() == 0


def test_similar_titles_exact(spark):
    rng = random.Random(5)
    titles = sorted({" ".join(rng.sample([f"w{i}" for i in range(10)], rng.randint(1, 9))) for _ in range(80)})
    got = {(r.a, r.b) for r in resolve.similar_titles(spark.createDataFrame([(t,) for t in titles], "title string")).collect()}
    j = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    assert got == {(a, b) for a in titles for b in titles if a < b and j(a, b) >= 0.85}


def test_context_and_keys(spark):
    turns = spark.createDataFrame([(1, 1, "system", "x" * 40), (1, 2, "user", "x" * 80), (1, 3, "user", "x" * 40), (2, 1, "user", None)], "conv_id int, turn int, role string, text string")
    assert sorted((r.conv_id, r.turn) for r in ordered.prune_context(turns, 25).collect()) == [(1, 1), (1, 3), (2, 1)]
    rows = spark.createDataFrame([(1, "Deep one", ["A Smith"], 2024), (2, "Deep two", ["B Smith"], 2024), (3, " deep ONE ", ["C Smith"], 2024)], "seq int, title string, authors array<string>, year int")
    assert {r.seq: r.citation_key for r in ordered.numbered_keys(rows, "seq").collect()} == {1: "smith2024deep", 2: "smith2024deep2", 3: "smith2024deep"}


def test_nearest_is_exact(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (60, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "id bigint, vec array<double>")
    got = sorted((r.query, r["rank"], r.neighbour) for r in vec.nearest(df, df.filter("id % 10 = 0"), "id", "vec", 5).collect())
    n = np.linalg.norm(v, axis=1)
    u = v / np.where(n == 0, 1, n)[:, None]
    sims = np.round(u @ u.T, 9)
    want = sorted((q, k + 1, j) for q in range(0, 60, 10) for k, j in enumerate(sorted((j for j in range(60) if j != q), key=lambda j: (-sims[q, j], j))[:5]))
    assert got == want


def test_vector_quality(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], False), ("b", [0.0, 0.0], True), ("c", None, True), ("d", [float("nan"), 1.0], False)], "k string, vec array<float>, skipped boolean")
    q = vec.quality(df, "k", "vec", F.col("skipped")).collect()[0]
    assert (q.n, q.skipped_zero, q.failed_zero, q.n_nan, q.valid) == (3, 1, 0, 1, False)
    same = spark.range(1).select(vec.cosine(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("z"), vec.cosine(F.array(F.lit(2.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(0.0))).alias("o")).collect()[0]
    assert (same.z, same.o) == (0.0, 1.0)


def test_cluster_metrics_and_variance(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (20, 3)) for c in (0, 5)])
    lab = [0] * 20 + [1] * 20
    df = spark.createDataFrame([(i, [float(y) for y in row], lab[i]) for i, row in enumerate(x)], "id bigint, vec array<double>, label int")
    got = vec.cluster_metrics(df, "label", "vec").collect()[0]
    inertia = sum(((x[np.array(lab) == k] - x[np.array(lab) == k].mean(0)) ** 2).sum() for k in (0, 1))
    assert got.inertia == pytest.approx(inertia, abs=1e-3) and got.davies_bouldin < 0.1
    share = [r.share for r in vec.explained_variance(df, "vec").collect()]
    want = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert share == pytest.approx(list(want / want.sum()), abs=1e-5)


def test_features(spark):
    x = lib(spark, [{"title": "neural networks", "abstract": "deep neural networks"}, {"title": "neural models"}, {"title": None}])
    w = features.tfidf(x).collect()
    # a term of all papers is too frequent; of two papers one is enough
    assert {r.citation_key for r in w} == {"k0", "k1"} and "neural" not in {r.term for r in w} and {"networks", "deep neural"} <= {r.term for r in w}
    for key in ("k0", "k1"):
        assert sum(r.weight**2 for r in w if r.citation_key == key) == pytest.approx(1, abs=1e-6)
    vectors = features.dense(features.tfidf(x))
    assert vectors.count() == 2 and features.loadings(vectors, "vec", sorted({r.term for r in w}), 1).count() == len({r.term for r in w})
    got = features.clustered(spark.createDataFrame([(i, [float(i // 5) * 10, 0.0]) for i in range(10)], "id int, vec array<double>"), "vec", 2, runs=2)
    assert sorted(r["count"] for r in got.groupBy("cluster").count().collect()) == [5, 5]


def test_links_are_not_capped(spark, tmp_path):
    from paperloom.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.array([1.0, 0.2, 0.0]) + rng.normal(size=3) * 0.05]) for i in range(120)] + [(i, [1.0, 0.0, 0.0]) for i in range(120, 160)] + [(160, [-1.0, 0.0, 0.0]), (161, [0.0, 0.0, 0.0])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query, r.neighbour) for r in catalog.QUERIES["jn19_links"](spark, str(tmp_path)).collect()}
    assert got == {(q, n) for q in (0, 50, 100, 150) for n in range(160) if q != n}


def test_checks_read_all_vectors(spark, tmp_path):
    from paperloom.plans import catalog

    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [1.0, None])]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    r = catalog.QUERIES["ve16_all"](spark, str(tmp_path)).collect()[0]
    assert (r.n, r.not_finite, r.out_of_range, r.bad_diagonal, r.asymmetric, r.damaged) == (16, 7, 7, 1, 7, 3)
    assert r.mean_off_diagonal == pytest.approx(2 * 0.5**0.5 / 6, abs=1e-6)


def test_checks_of_similarities_see_all_rows(spark):
    from paperloom.operators import vectors as vec

    rows = [(i, [1.0, float(i % 7), 0.5]) for i in range(200)] + [(1000, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    got = vec.query_checks(df, df.filter("vec_id % 50 = 0"), "vec_id", "v").collect()[0]
    assert (got.n, got.out_of_range, got.bad_diagonal, got.asymmetric) == (5 * 201, 0, 0, 0)
    broken = df.unionByName(spark.createDataFrame([(2001, [float("nan"), 1.0, 0.0])], df.schema))
    got = vec.query_checks(broken, broken.filter("vec_id % 50 = 0"), "vec_id", "v").collect()[0]
    assert got.out_of_range == 5 and got.bad_diagonal == 1
    assert vec.query_checks(df, df.limit(0), "vec_id", "v").collect()[0].n == 0 and vec.similarity_statistics(df, df.limit(0), "vec_id", "v").collect()[0].n == 0


def test_links_beyond_a_hundred(spark):
    from paperloom.operators import vectors as vec

    rows = [(i, [1.0, i / 1e4]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<double>")
    assert vec.links(df, df.filter("vec_id = 0"), "vec_id", "v", 0.9).count() == 299
    got = vec.nearest(df, df.filter("vec_id % 150 = 0"), "vec_id", "v", 7).collect()
    assert sorted((r.query, r.rank, r.neighbour) for r in got if r.query == 0) == [(0, i, i) for i in range(1, 8)] and len(got) == 14
    assert vec.nearest(df, df.limit(0), "vec_id", "v", 7).count() == 0 and vec.silhouette(df, df.limit(0), "vec_id", "v", "vec_id").count() == 0


def test_overlaps_against_brute_force(spark):
    from paperloom.operators import overlap

    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    pick = lambda k: rng.sample(words[:14], k) if rng.random() < 0.8 else rng.sample(words, k)
    items = [(f"k{rng.randrange(900):04d}", 0, pick(rng.randint(0, 9))) for _ in range(1200)]
    queries = [(f"k{rng.randrange(900):04d}", pick(rng.randint(0, 8))) for _ in range(150)]
    mine, theirs = {}, {}
    for out, rows in ((mine, items), (theirs, queries)):
        for r in rows:
            out.setdefault(r[0], Counter()).update(r[-1])
    expected = set()
    for q, asks in theirs.items():
        shared = sorted((-sum(n * c[w] for w, n in asks.items()), k) for k, c in mine.items() if k != q)
        expected |= {(q, k, -n) for n, k in shared[:5] if n}
    i = spark.createDataFrame(items, "ident string, rank int, words array<string>")
    q = spark.createDataFrame(queries, "query string, words array<string>")
    top = lambda index, query, asks: [(index.idents[at], 0, float(n)) for at, n in overlap.top(index, asks, 6) if index.idents[at] != query][:5]
    got, blocks = overlap.asked(i, F.col("words"), q, top, 3)
    assert blocks == 1 and {(r.query, r.ident, r.value) for r in got.collect()} == expected
    # blocks hold the best among others
    several, blocks = overlap.asked(i, F.col("words"), q, top, 2, 500)
    assert blocks == 3 and {(r.query, r.ident, r.value) for r in several.collect()} >= expected
    # sets without repetition by similarity
    sets = {f"s{n:04d}": sorted(set(pick(rng.randint(1, 9)))) for n in range(700)}
    near = lambda index, query, asks: [(index.idents[at], 0, float(s)) for at, s in zip(*overlap.similar(index, asks, 0.6), strict=True)]
    i = spark.createDataFrame([(k, 0, w) for k, w in sets.items()], "ident string, rank int, words array<string>")
    got, _ = overlap.asked(i, F.col("words"), i.limit(200).select(F.col("ident").alias("query"), "words"), near, 3)
    some = sorted(sets)[:200]
    assert {(r.query, r.ident, r.value) for r in got.collect()} == {(a, b, len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))) for a in some for b in sets if len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.6}


def test_related_papers_write_no_pairs(spark):
    """Papers with common keywords are not joined pair by pair."""
    papers = spark.range(50).select(F.format_string("k%02d", "id").alias("citation_key"), F.lit("neural models").alias("abstract"))
    got = inventory.related_papers(papers, papers.select("citation_key", F.split("abstract", " ").alias("keywords")))
    assert not re.search(r"Join \[k#", got._jdf.queryExecution().executedPlan().toString())
    assert [(r.citation_key, r.shared, r["rank"]) for r in got.filter("paper = 'k01'").orderBy("rank").collect()] == [("k00", 2, 1), ("k02", 2, 2), ("k03", 2, 3), ("k04", 2, 4), ("k05", 2, 5)]


def test_related_papers_of_several_blocks_are_not_shuffled(spark, monkeypatch):
    """What the blocks give is merged where it is found; the result is that of one block."""
    from paperloom.operators import overlap

    rng = random.Random(3)
    rows = [(f"k{i:04d}", " ".join(rng.choices("neural models graph sparse bayesian causal vision speech".split(), k=3)), rng.choice([None, 1])) for i in range(900)]
    papers = spark.createDataFrame([*rows, rows[5]], "citation_key string, abstract string, n int")
    profiles = papers.select("citation_key", F.split("abstract", " ").alias("keywords"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, inventory.related_papers(papers, profiles).collect()))
    asked = overlap.asked
    monkeypatch.setattr(overlap, "asked", lambda *a, **k: asked(*a, **k, block=300))
    got = inventory.related_papers(papers, profiles)
    assert sorted(map(tuple, got.collect())) == whole and len(whole) >= 4500
    assert "Window" not in plan(got)


def test_titles_are_asked_without_a_join_on_words(spark):
    from paperloom.plans.payload_queries import by_title

    hits = spark.createDataFrame([(9, "arxiv", "A B c d e f g"), (3, "arxiv", "g f e d c b a"), (1, "crossref", "a b c d e f g"), (7, "biorxiv", "a b c x y z"), (4, "arxiv", " "), (5, "dblp", "a b c d e f g")], "seq bigint, source string, title string")
    asked = spark.createDataFrame([("a b c d e f g h",), ("a b c d e f g",), ("x",), (None,)], "title string")
    got = by_title(asked, hits, ["biorxiv", "arxiv", "crossref"])
    assert not re.search(r"Join \[w#", got._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in got.collect()} == {("a b c d e f g h", 3, 0.875), ("a b c d e f g", 3, 1.0)}


def test_hits_that_score_alike_are_joined_once(spark):
    """Copies of a hit do not multiply with the entries of their title, and titles of hits are not compared with each other."""
    entries = spark.createDataFrame([(f"k{i}", "a b c d e f g h", ["A Kim"], 2020) for i in range(20)], "citation_key string, title string, authors array<string>, year int")
    hits = [(i, "a b c d e f g", ["B Kim"], 2020, "crossref" if i > 30 else "dblp", f"10.1/{i}") for i in range(60)] + [(70, "A b c d e f g h!", ["C Kim"], 2021, "openalex", "10.1/70"), (71, "a b c d e f g h", ["C Kim"], 2020, "crossref", None)]
    hits = spark.createDataFrame(hits, "seq bigint, title string, authors array<string>, year int, source string, doi string")
    got = resolve.best_enrichment(entries, hits)
    assert not re.search(r"Join \[x#", got._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in got.collect()} == {(f"k{i}", 31, "10.1/31", "crossref", 0.925) for i in range(20)}
