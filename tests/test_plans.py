import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from paperloom.plans import catalog, jobs
from paperloom.sources import files, sinks
from paperloom.streaming import streams


def test_entry(spark):
    df = entry_point.entry(spark)
    assert df.columns == ["keyword", "year", "n"] and df.count() > 0


def test_names_and_sql():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 100


@pytest.mark.parametrize("name", ["sm5_hourly", "sm4_latest", "dd1_deduplicated", "ve1_tfidf", "sc14_payloads", "jn7_work", "vd1_scores"])
def test_queries_run(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() >= 0


def test_against_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for t in ("library", "artifacts", "progress", "search_results", "documents", "events"):
        con.execute(f"create view {t} as select * from read_parquet('{data}/{t}.parquet')")
    for name in ("ag2_by_year", "ag7_emerging", "jn10_analysis", "ag42_coauthors", "p3_found", "ag24_health"):
        got, want = catalog.QUERIES[name](spark, data).toPandas(), con.execute(catalog.ORACLES[name]).df()
        key = lambda f: sorted(map(str, f[sorted(f.columns)].astype(str).itertuples(index=False)))
        assert key(got) == key(want), name


def test_library_file(spark, tmp_path):
    body = {"entries": {"k1": {"title": "T", "authors": ["A", "B"], "year": 2020, "venue": ["V", "W"], "citation_key": "k1"}, "k2": {"authors": "Solo", "year": None}}}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "b.json").write_text("broken")
    (tmp_path / "c.json").write_text(json.dumps({"entries": [{"citation_key": "k3", "venue": []}]}))
    got = {r.citation_key: (r.title, r.authors, r.year, r.venue) for f in "abc" for r in files.read_library(spark, str(tmp_path / f"{f}.json")).collect()}
    assert got == {"k1": ("T", ["A", "B"], 2020, "V, W"), "k2": ("No title", ["Solo"], None, None), "k3": ("No title", [], None, None)}


def test_texts_and_sinks(spark, tmp_path):
    (tmp_path / "k1.txt").write_text("line\nline")
    assert [(r.citation_key, r.text) for r in files.read_texts(spark, str(tmp_path)).collect()] == [("k1", "line\nline")]
    lib = spark.createDataFrame([("k1", "T", ["A", "B"], 2020, None, "", "u"), ("k1b", "T2", None, 0, None, None, None)], "citation_key string, title string, authors array<string>, year int, venue string, doi string, url string")
    got = {r.citation_key: r.entry for r in sinks.bibtex_rows(lib, spark.createDataFrame([("k1b",)], "citation_key string")).collect()}
    assert got == {"k1": "@article{k1,\n  title = {T},\n  author = {A and B},\n  year = {2020},\n  url = {u}\n}"}
    env = json.loads(sinks.envelope(lib.select("citation_key", "title"), "1.0", "now", "citation_key").collect()[0].value)
    assert env["count"] == 2 and list(env["entries"]) == ["k1", "k1b"]
    load = spark.createDataFrame([("PC1", "a", -2.0), ("PC1", "b", 1.0), ("PC2", "a", 0.5)], "component string, word string, loading double")
    assert [r.word for r in sinks.word_importance(load).orderBy("rank").collect()] == ["a", "b"]
    assert sinks.top_words(load, 1).count() == 2 and sinks.report_lines("R", load).count() == 4


def test_settings(monkeypatch):
    monkeypatch.setenv("PAPERLOOM_SEARCH_LIMIT", "7")
    monkeypatch.setenv("PAPERLOOM_PDF_TIMEOUT", "x")
    s = files.Settings.from_env()
    assert (s.search_limit, s.pdf_timeout) == (7, 60)
    assert files.fragment('{"a": {"b": "c"}}', "f#a/b") == "c" and files.fragment("{}", "f#a") is None


def test_jobs(spark):
    raw = spark.createDataFrame([("k", "semanticscholar", json.dumps({"data": [{"title": "New Paper", "year": 2020, "authors": [{"name": "Ann Lee"}]}, {"title": "new paper", "year": 2020, "authors": [{"name": "Ann Lee"}]}, {"title": "Known", "authors": []}]}))], "keyword string, source string, payload string")
    lib = spark.createDataFrame([("x", "known", None)], "citation_key string, title string, doi string")
    assert [r.citation_key for r in jobs.ingest(raw, lib).collect()] == ["lee2020new"]


def test_stream_dedup_resumes(spark, tmp_path):
    schema = "user_id bigint, event_id bigint, t double"
    add = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: streams.run_to_parquet(streams.dedup_since_last_kept(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "user_id", 1.0), out, check)
    add(1, [(1, 1, 0.0), (1, 2, 0.9), (1, 3, 1.5), (2, 4, 0.5)])
    run()
    add(2, [(1, 5, 2.4), (1, 6, 2.6)])
    run()
    assert sorted(r.event_id for r in spark.read.parquet(out).collect()) == [1, 3, 4, 6]


def test_hourly_watermark(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, 1, 0, 10), 1.0), (dt.datetime(2024, 1, 1, 0, 50), 3.0), (dt.datetime(2024, 1, 1, 5, 0), 5.0)]
    spark.createDataFrame(rows, "ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts timestamp, value double").parquet(str(tmp_path / "in"))
    got = streams.run_complete(streams.hourly(s, "ts", "value"), str(tmp_path / "o"), str(tmp_path / "c"))
    assert sorted((r.hour.hour, r.n, r.mean_value) for r in got.collect()) == [(0, 2, 2.0), (5, 1, 5.0)]


def test_without_llm(monkeypatch):
    import builtins

    real = builtins.__import__

    def no_llm(name, *a, **k):
        if name.startswith("paperloom.llm") or (name == "paperloom.llm"):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", no_llm)
    assert set(entry_point.queries()) == set(catalog.QUERIES) and set(entry_point.oracle_sql()) == set(catalog.ORACLES)


def test_column_names_with_clashes(spark):
    from paperloom.operators import meta

    df = spark.createDataFrame([("a", "t", 1, 2, 3)], "venue string, value string, n int, rank int, keyword int")
    assert meta.counts_of(df, "venue").collect()[0].n == 1
    assert meta.keyword_rows(df.withColumn("title", F.lit("neural")).withColumn("abstract", F.lit(None).cast("string")).withColumn("year", F.lit(2020))).collect()[0].keyword == "neural"


def test_comparable_of_all_documents(spark, tmp_path):
    rows = [(1, "summary", "\n# Ünï\u00a0\u2003 \u0664\u0662 x"), (2, "web_page", "a\t[b] 12\r\n" + "y" * 500), (3, "summary", None)]
    spark.createDataFrame(rows, "doc_id bigint, doc_type string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.comparable for r in catalog.QUERIES["st27_texts"](spark, str(tmp_path)).collect()}
    assert got == {1: " ünï N x", 2: "a b N " + "y" * 500, 3: None}


def test_all_papers_and_years(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"create view library as select * from read_parquet('{data}/library.parquet')")
    for name in ("jn16_related", "jn16_all"):
        got = sorted(map(tuple, catalog.QUERIES[name](spark, data).select("paper", "citation_key", "shared", "score", "rank").collect()))
        assert got == sorted((*r[:3], float(r[3]), r[4]) for r in con.execute(catalog.ORACLES[name]).fetchall()), name
    wide = catalog.QUERIES["sk6_all"](spark, data).collect()
    assert sum(sum(v for k, v in r.asDict().items() if k != "source") for r in wide) == con.execute("select count(*) from library").fetchone()[0]
