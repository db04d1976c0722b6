"""Queries over duplicates, generated text, structure, features, payloads, sinks and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import pages, providers, quality, structure
from paperloom.functions import repetition as rep
from paperloom.functions import text as tx
from paperloom.operators import features, ordered, resolve
from paperloom.operators import vectors as vec
from paperloom.plans import jobs
from paperloom.plans.text_queries import NT, WORDS
from paperloom.runtime import shared_folder, table
from paperloom.sources import payloads, sinks
from paperloom.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
MAX_YEARS = 5000  # columns of a table by years


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def per_row(rows: DataFrame, keys: list[str], inputs: list[str], one: Callable[..., tuple], schema: str) -> DataFrame:
    """``one`` of the input columns for each row, in vectorized passes; the keys go along."""
    kinds = dict(rows.dtypes)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [one(*v) for v in zip(*(part[c] for c in inputs), strict=True)]
            out = pd.DataFrame(got, columns=names)
            for k in reversed(keys):
                out.insert(0, k, part[k].values)
            yield out

    return rows.select(*dict.fromkeys([*keys, *inputs])).mapInPandas(run, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + schema)


def _summaries(s, d) -> DataFrame:
    return table(s, d, "documents").filter("doc_type = 'summary' and text is not null").select("doc_id", "citation_key", "text")


@query("dd1_by_doi", "select min(seq) as seq from search_results where trim(doi) <> '' group by lower(trim(doi))")
def dd1_by_doi(s, d):
    """DD1, first phase: the first hit of each DOI."""
    r = table(s, d, "search_results").filter(tx.nonempty(F.trim("doi")))
    return r.groupBy(F.lower(F.trim("doi")).alias("d")).agg(F.min("seq").alias("seq")).select("seq")


_W1, _W2 = WORDS.format(c="x.t"), WORDS.format(c="y.t")


@query("jn15_similar", f"""with t as (select distinct {NT.format(c='title')} as t from search_results where coalesce(trim(doi), '') = ''), w as (select t, unnest({WORDS.format(c='t')}) as w from t), p as (select x.t as a, y.t as b, count(*) as k from w x join w y on x.w = y.w and x.t < y.t group by 1, 2), n as (select t, count(*) as n from w group by t)
select a, b, round(k / (x.n + y.n - k), 9) as similarity from p join n x on x.t = a join n y on y.t = b where k / (x.n + y.n - k) >= 0.85 - 1e-12""")
def jn15_similar(s, d):
    """JN15, SO5: similar titles of hits without a DOI."""
    r = table(s, d, "search_results").filter(~tx.nonempty(F.trim("doi"))).select(tx.normalize_title(F.col("title")).alias("title"))
    return resolve.similar_titles(r).withColumn("similarity", F.round("similarity", 9))


@query("dd1_deduplicated")
def dd1_deduplicated(s, d):
    """DD1, DD2, FL20, SR1: the hits that stay with their score."""
    return resolve.ranked(table(s, d, "search_results"))


@query("dd3_new_entries")
def dd3_new_entries(s, d):
    """DD3, WN10, OP1."""
    return resolve.new_entries(table(s, d, "search_results"), table(s, d, "library")).select("seq", "citation_key")


@query("dd4_upsert", """select coalesce(l.citation_key, c.citation_key) as citation_key, coalesce(c.title, l.title) as title, coalesce(c.year, l.year) as year from (select citation_key, title, year from library) l
full join (select citation_key, max(title) as title, max(year) as year from parsed_summaries group by 1) c on l.citation_key = c.citation_key""")
def dd4_upsert(s, d):
    """DD4."""
    changes = table(s, d, "parsed_summaries").groupBy("citation_key").agg(F.max("title").alias("title"), F.max("year").alias("year"))
    return resolve.upsert(table(s, d, "library").select("citation_key", "title", "year"), changes, "citation_key")


@query("dd7_latest", "select citation_key, arg_max(status, (logged_at, entry_id)) as status from progress group by citation_key")
def dd7_latest(s, d):
    """DD7, DD8, SM4: the last state of each key."""
    return table(s, d, "progress").groupBy("citation_key").agg(F.max_by("status", F.struct("logged_at", "entry_id")).alias("status"))


@query("jn13_enriched")
def jn13_enriched(s, d):
    """JN13, JN14, OP8: DOIs for entries without one."""
    return jobs.enrich(table(s, d, "library"), table(s, d, "search_results"))


@query("rp6_repetition")
def rp6_repetition(s, d):
    """RP5, RP6, RP10, RP11, VD16 on all documents."""
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "text")
    one = lambda t: (*rep.detect(t), rep.repeated_sentences(t), rep.repeated_headers(t), rep.repeated_paragraphs(t))
    return per_row(docs, ["doc_id"], ["text"], one, "repeated boolean, duplicates int, unique_ratio double, sentences boolean, headers boolean, paragraphs boolean")


@query("rp9_cleaned")
def rp9_cleaned(s, d):
    """RP7-RP9, DD5, DD6, ST29: summaries without their repetitions."""
    one = lambda t: (rep.without_repeated_sections(rep.without_nested(rep.without_repeated_bullets(structure.clean_summary(t)))),)
    return per_row(_summaries(s, d), ["doc_id"], ["text"], one, "cleaned string")


@query("vd1_scores")
def vd1_scores(s, d):
    """VD1-VD8: each summary against its paper's text and title."""
    texts = table(s, d, "corpus").groupBy("citation_key").agg(F.max("text").alias("source"))
    rows = _summaries(s, d).join(texts, "citation_key", "left").join(table(s, d, "library").select("citation_key", "title"), "citation_key", "left")

    def one(summary, source, title):
        valid, score, errors = quality.summary_score(summary, source, title)
        return valid, score, "; ".join(errors), quality.quote_count(summary), quality.hard_failure(errors)

    return per_row(rows, ["doc_id"], ["text", "source", "title"], one, "valid boolean, score double, errors string, n_quotes int, hard boolean")


@query("vd10_supported")
def vd10_supported(s, d):
    """VD9-VD12: lines of summaries that their papers support."""
    texts = table(s, d, "corpus").groupBy("citation_key").agg(F.max("text").alias("source"))
    rows = _summaries(s, d).join(texts.filter("source is not null"), "citation_key")
    return per_row(rows, ["doc_id"], ["text", "source"], lambda t, src: (quality.methods_output(quality.quotes_in_source(t, src), src)[0],), "supported string")


@query("vd15_form", "select doc_id, len(regexp_extract_all(text, '\\[\\d+(?:,\\s*\\d+)*\\]'))::int as n_numbered, length(text) between 200 and 4000 as length_ok from documents where text is not null")
def vd15_form(s, d):
    """VD14, VD15: numbered citations and length."""
    t = F.col("text")
    return table(s, d, "documents").filter("text is not null").select("doc_id", F.size(F.regexp_extract_all(t, F.lit(r"(\[\d+(?:,\s*\d+)*\])"), F.lit(1))).alias("n_numbered"), F.length(t).between(200, 4000).alias("length_ok"))


@query("vd18_tone")
def vd18_tone(s, d):
    """VD13-VD20: tone, headers and actions of summaries."""
    one = lambda t: (quality.is_off_topic(t), len(quality.conversational(t)), len(quality.missing_headers(t, ["Overview", "Key points"])), quality.formatting_ok(t), len(quality.action_items(t)), len(quality.citations(t)), len(quality.review_errors(t, "translation")))
    return per_row(_summaries(s, d), ["doc_id"], ["text"], one, "off_topic boolean, n_chatty int, n_missing int, formatted boolean, n_actions int, n_citations int, n_errors int")


@query("tx1_sections")
def tx1_sections(s, d):
    """TX1, TX2, TX7, TX8, TX10, TX11: sections and title lines of the long texts."""
    rows = table(s, d, "corpus").dropDuplicates(["pos"]).filter("text is not null")

    def one(t):
        got = structure.sections(t)
        return structure.title_line(t), list(got), [e - b for b, e in got.values()], max(1, len(t.split()) // 500)

    return per_row(rows, ["pos", "citation_key"], ["text"], one, "title_line string, names array<string>, sizes array<int>, pages int")


@query("tx4_chunks")
def tx4_chunks(s, d):
    """TX3-TX6: chunks of the long texts by section and by tokens."""
    rows = table(s, d, "corpus").dropDuplicates(["pos"]).filter("text is not null")

    def one(t):
        names, starts, ends = zip(*structure.chunks(t), strict=True)
        return list(names), list(starts), list(ends), len(structure.token_chunks(t))

    got = per_row(rows, ["pos"], ["text"], one, "names array<string>, starts array<int>, ends array<int>, n_token_chunks int")
    return got.select("pos", "n_token_chunks", F.posexplode(F.arrays_zip("names", "starts", "ends")).alias("chunk_no", "c")).select("pos", "chunk_no", F.col("c.names").alias("section"), F.col("c.starts").alias("start_at"), F.col("c.ends").alias("end_at"), "n_token_chunks")


@query("tx9_truncated")
def tx9_truncated(s, d):
    """TX9, TX12, TX15: what of a long text fits a budget of 8,000 characters."""
    rows = table(s, d, "summarization_contexts").filter("full_text is not null")
    return per_row(rows, ["citation_key"], ["full_text"], lambda t: (structure.truncated(t, 8000),), "kept string")


@query("tx13_summaries")
def tx13_summaries(s, d):
    """TX13, TX14, SC38: fields and sections of summary documents."""

    def one(t):
        f, parts = structure.summary_fields(t), structure.markdown_sections(t)
        return f["Title"], f["Author"], f["Year"], list(parts), [len(v) for v in parts.values()]

    return per_row(_summaries(s, d), ["doc_id"], ["text"], one, "title string, authors string, year string, sections array<string>, sizes array<int>")


@query("ht1_links")
def ht1_links(s, d):
    """HT1-HT12: links and text of the documents' pages that hold HTML."""
    rows = table(s, d, "documents").filter("doc_type = 'web_page' and text rlike '<[a-zA-Z]+[ >]'")
    one = lambda t: (pages.publisher("https://mirror.invalid/"), pages.pdf_links(t, "https://mirror.invalid/"), len(pages.page_text(t)), pages.is_paper(pages.strip_tags(t)))
    return per_row(rows, ["doc_id"], ["text"], one, "publisher string, links array<string>, n_text int, is_paper boolean")


@query("ve1_tfidf", """with w as (select citation_key, list_filter(string_split_regex(lower(concat_ws(' ', title, abstract)), '[^\\pL\\pN_]+'), lambda x: length(x) >= 2 and x not in (""" + ", ".join(f"'{w}'" for w in features.STOP) + """)) as w from library),
t as (select citation_key, unnest(list_concat(w, case when len(w) >= 2 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else [] end)) as term from w where len(w) > 0),
c as (select citation_key, term, count(*) as tf from t group by 1, 2), n as (select count(distinct citation_key) as n from c), v as (select term, count(*) as df, sum(tf) as total from c group by term),
b as (select term, df from v, n where df >= least(2, greatest(n - 1, 1)) and df <= 0.95 * n order by total desc, term limit 1000), x as (select citation_key, term, tf * (ln((1 + n) / (1 + df)) + 1) as w from c join b using (term), n)
select citation_key, term, round(round(w / sqrt(sum(w * w) over (partition by citation_key)), 9), 6) as weight from x""")
def ve1_tfidf(s, d):
    """VE1."""
    return features.tfidf(table(s, d, "library")).withColumn("weight", F.round("weight", 6))


@query("st27_texts")
def st27_texts(s, d):
    """ST27 on the whole text of all documents, by Python's rules for blanks, digits and case."""
    return per_row(table(s, d, "documents"), ["doc_id"], ["text"], lambda t: (rep.comparable(t) if isinstance(t, str) else None,), "comparable string")


@query("ve4_clusters")
def ve4_clusters(s, d):
    """VE4, PL11: sizes of five k-means clusters of the vectors."""
    got = features.clustered(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 5)
    return got.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


@query("ve20_embedded")
def ve20_embedded(s, d):
    """VE19-VE21, UD3, JN11: vectors of the contexts' texts from a deterministic provider."""
    rows = table(s, d, "summarization_contexts").select("citation_key", F.coalesce(F.when(F.trim("full_text") != "", F.col("full_text")), F.col("abstract")).alias("text"))
    got = providers.embed(rows, providers.hash_embedder(8), "citation_key", dim=8)
    return got.select("citation_key", "skipped", F.round(vec.norm(F.col("vec")), 6).alias("norm"))


@query("ud5_prompt")
def ud5_prompt(s, d):
    """UD4-UD8, OP9: one prompt over a selection and its answer from a deterministic provider."""
    prompt = providers.gathered_prompt(table(s, d, "library").filter("year = 2024"), "Compare these papers.").withColumn("id", F.lit("review"))
    return providers.answer(prompt, lambda texts: [f"{t.count('---') + 1} papers, {len(t)} characters" for t in texts], "id")


@query("sc14_payloads", "select seq, title, authors, year, doi, case when pdf_url is not null then pdf_url end as pdf_url, venue, citation_count from (select seq, title, coalesce(authors, []) as authors, year, doi, pdf_url, nullif(venue, '') as venue, citation_count from search_results)")
def sc14_payloads(s, d):
    """SC9-SC32: hits written as a service's payload and parsed back."""
    r = table(s, d, "search_results")
    paper = F.struct("title", F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.struct(a.alias("name"))).alias("authors"), "year", "abstract", "url", F.struct(F.col("doi").alias("DOI")).alias("externalIds"), F.struct(F.col("pdf_url").alias("url")).alias("openAccessPdf"), F.lit(True).alias("isOpenAccess"), "venue", F.col("citation_count").alias("citationCount"))
    raw = r.select(F.col("seq").cast("string").alias("keyword"), F.lit("semanticscholar").alias("source"), F.to_json(F.struct(F.array(paper).alias("data"))).alias("payload"))
    return payloads.parse(raw).select(F.col("keyword").cast("bigint").alias("seq"), "title", "authors", "year", "doi", "pdf_url", "venue", "citation_count")


@query("sk2_bibtex", """select citation_key, '@article{' || citation_key || E',\\n' || concat_ws(E',\\n', case when title <> '' then '  title = {' || title || '}' end, case when len(authors) > 0 then '  author = {' || array_to_string(authors, ' and ') || '}' end, case when year <> 0 then '  year = {' || year || '}' end,
case when venue <> '' then '  journal = {' || venue || '}' end, case when doi <> '' then '  doi = {' || doi || '}' end, case when url <> '' then '  url = {' || url || '}' end) || E'\\n}' as entry from library""")
def sk2_bibtex(s, d):
    """SK2-SK4."""
    return sinks.bibtex_rows(table(s, d, "library"))


@query("sk1_json")
def sk1_json(s, d):
    """SK1, SK5, SK7-SK10, SK16, SK21-SK27: entries as JSON lines."""
    return sinks.json_rows(table(s, d, "library").drop("metadata"))


@query("sk6_matrix", "select source, " + ", ".join(f"count(*) filter (year = {y}) as \"{y}\"" for y in range(2015, 2025)) + " from library group by source")
def sk6_matrix(s, d):
    """SK6, SK11, SK19, AG40: papers per source and year as a wide table of stated years; ``sk6_all`` has all years."""
    years = list(range(2015, 2025))
    long = table(s, d, "library").groupBy("source", "year").agg(F.count(F.lit(1)).alias("n"))
    return sinks.matrix(long, "source", "year", "n", years)


@query("sk6_all")
def sk6_all(s, d):
    """SK6, SK11, SK19, AG40: papers per source and year with all years of the data, at most MAX_YEARS; 'none' where there is none."""
    long = table(s, d, "library").groupBy("source", F.coalesce(F.col("year").cast("string"), F.lit("none")).alias("year")).agg(F.count(F.lit(1)).alias("n"))
    years = [r[0] for r in long.select("year").distinct().limit(MAX_YEARS + 1).collect()]
    if len(years) > MAX_YEARS:
        raise ValueError(f"more than {MAX_YEARS} different years")
    return sinks.matrix(long, "source", "year", "n", sorted(years))


@query("op6_cleanup", "select 'entry' as what, citation_key, null::varchar as path from library where citation_key not in (select citation_key from artifacts where kind = 'pdf' and deleted_at is null) union all select distinct kind, citation_key, path from artifacts where deleted_at is null and citation_key not in (select citation_key from library)")
def op6_cleanup(s, d):
    """OP6, OP10: what a clean-up would remove."""
    return jobs.cleanup(table(s, d, "library"), table(s, d, "artifacts")).distinct()


def _stream(s, d, name: str, columns: list[str]) -> DataFrame:
    """A table's file as a stream; timestamps with their zone."""
    path = f"{d}/{name}.parquet"
    schema = s.read.parquet(path).schema
    import os

    # a single file is named by a pattern of its folder
    at = path if os.path.isdir(path) else f"{d}/{name}.parque[t]"
    return streams.file_stream(s, at, schema).select(*columns)


def _checkpoint_folder(s) -> str:
    """A folder of its own in the shared one, for the state and result of a stream."""
    return f"{shared_folder(s)}/stream-{uuid.uuid4().hex}"


@query("sm5_hourly", "select date_trunc('hour', ts) as hour, count(*) as n, round(avg(value), 6) as mean_value from events group by 1")
def sm5_hourly(s, d):
    """SM5, SM7, SM8: events per hour from a stream, in complete mode so that no hour waits for the watermark."""
    e = _stream(s, d, "events", ["ts", "value"]).withColumn("ts", F.col("ts").cast("timestamp"))
    folder = _checkpoint_folder(s)
    return streams.run_complete(streams.hourly(e, "ts", "value"), folder + "-out", folder).select("hour", "n", F.round("mean_value", 6).alias("mean_value"))


@query("sm4_latest", "select citation_key, arg_max(status, (logged_at, entry_id)) as status, count(*) as n_states from progress group by citation_key")
def sm4_latest(s, d):
    """SM4: the running state of each key from a stream."""
    p = _stream(s, d, "progress", ["citation_key", "status", "logged_at", "entry_id"])
    folder = _checkpoint_folder(s)
    return streams.run_complete(streams.latest_status(p, "citation_key", "logged_at"), folder + "-out", folder)


@query("sm9_dedup")
def sm9_dedup(s, d):
    """SM9, WN6: events not within a minute of the last kept one of their user, from a stream with state."""
    e = _stream(s, d, "events", ["event_id", "user_id", "ts"]).select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    folder = _checkpoint_folder(s)
    streams.run_to_parquet(streams.dedup_since_last_kept(e, "user_id", 60.0), folder + "-out", folder)
    return s.read.parquet(folder + "-out").select("user_id", "event_id")


@query("sm1_chunks", "select citation_key, count(*) as n_chunks, sum(length(pdf_path))::bigint as n_chars from progress group by citation_key")
def sm1_chunks(s, d):
    """SM1-SM3: running sizes per key from a stream."""
    p = _stream(s, d, "progress", ["citation_key", "pdf_path", "logged_at"])
    folder = _checkpoint_folder(s)
    return streams.run_complete(streams.chunk_metrics(p, "citation_key", "pdf_path", "logged_at"), folder + "-out", folder).select("citation_key", "n_chunks", "n_chars")


@query("wn3_cumulative", "with y as (select year, count(*) as n from library where year <> 0 group by year) select year, n, row_number() over (order by year) as position, round(sum(n) over (order by year) / sum(n) over (), 9) as cumulative from y")
def wn3_cumulative(s, d):
    """WN3 on papers per year."""
    from paperloom.operators import meta

    run, _ = ordered.cumulative_share(meta.by_year(table(s, d, "library")).withColumnRenamed("n_papers", "n"), "n", ["year"])
    return run.select("year", "n", "position", "cumulative")
