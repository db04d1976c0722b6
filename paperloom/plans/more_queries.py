"""Queries of single functions and of the inputs of charts, each with the SQL to check it by."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import checks
from paperloom.functions import text as tx
from paperloom.operators import inventory as inv
from paperloom.operators import meta, ordered, resolve, select
from paperloom.operators import vectors as vec
from paperloom.plans.library_queries import KW_ROWS
from paperloom.plans.text_queries import _ALNUM, _FIRST, _KEYWORD
from paperloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


@query("st5_queries", "select citation_key, concat_ws(' ', title, case when len(authors) > 0 then string_split_regex(trim(authors[1]), '\\s+')[-1] end) as query from library")
def st5_queries(s, d):
    """ST5."""
    return table(s, d, "library").select("citation_key", tx.search_query(F.col("title"), F.col("authors")).alias("query"))


_THINK = "case when doc_id % 3 = 0 then '<think>a' || chr(10) || 'b</think> ' || text when doc_id % 3 = 1 then text || ' <thinking>never closed' else text end"


@query("st25_stripped", f"select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g'), '(?is)<thinking>.*?</thinking>', '', 'g'), '(?is)<(?:think|thinking)>.*$', '')) as stripped from (select doc_id, {_THINK} as t from documents where text is not null)")
def st25_stripped(s, d):
    """ST25: documents with a closed or an open block of thoughts."""
    return table(s, d, "documents").filter("text is not null").select("doc_id", tx.strip_thinking(F.expr(_THINK.replace("chr(10)", "char(10)"))).alias("stripped"))


_MESSAGE = "'run ' || run_id || ' at ' || strftime(timezone('UTC', logged_at), '%Y-%m-%dT%H:%M:%SZ') || ' took ' || entry_id || ' ms, attempt ' || download_attempts"


@query("st28_messages", f"select entry_id, regexp_replace(regexp_replace(regexp_replace(m, '\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}:\\d{{2}}(?:\\.\\d+)?Z?', '<time>', 'g'), '\\d+(?:\\.\\d+)?\\s*(?:ms|s|sec|seconds|minutes|min|m|h)([^A-Za-z]|$)', '<duration>\\1', 'g'), '\\d+', '<n>', 'g') as message from (select distinct entry_id, {_MESSAGE} as m from progress)")
def st28_messages(s, d):
    """ST28: log messages without times, durations and counts."""
    at = F.date_format("logged_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    m = F.concat(F.lit("run "), "run_id", F.lit(" at "), at, F.lit(" took "), F.col("entry_id").cast("string"), F.lit(" ms, attempt "), F.col("download_attempts").cast("string"))
    return table(s, d, "progress").select("entry_id", tx.normal_message(m).alias("message")).distinct()


@query("st30_markdown", "select doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)[ \\t]+$', '', 'g'), '(?m)^(#{1,6})([^#\\s])', '\\1 \\2', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) as fixed from documents where text is not null and not regexp_matches(text, '[\\r\\x{0B}\\x{0C}\\x{85}\\x{2028}\\x{2029}]')")
def st30_markdown(s, d):
    """ST30 on texts whose line ends both engines read alike."""
    docs = table(s, d, "documents").filter("text is not null").filter(~F.col("text").rlike("[\\r\\x0B\\x0C\\x85\\u2028\\u2029]"))
    return docs.select("doc_id", tx.fix_markdown(F.col("text")).alias("fixed"))


@query("st32_texts", "select citation_key, left(concat_ws(chr(10) || chr(10), nullif(title, ''), nullif(abstract, ''), nullif(introduction, ''), nullif(conclusion, ''), case when len(key_terms) > 0 then 'Key terms: ' || array_to_string(key_terms[1:10], ', ') end), 8000) as text from summarization_contexts")
def st32_texts(s, d):
    """ST32."""
    c = table(s, d, "summarization_contexts")
    return c.select("citation_key", tx.prioritized_text(F.col("title"), F.col("abstract"), F.col("introduction"), F.col("conclusion"), F.col("key_terms")).alias("text"))


_BASE = f"coalesce(nullif({_ALNUM.format(c=f'''string_split_regex(trim({_FIRST}), '[[:space:]]+')[-1]''')}, ''), 'anonymous') || case when coalesce(year, 0) = 0 then 'nodate' else year::varchar end || coalesce({_KEYWORD}, 'paper')"


@query("wn10_numbered", f"""with k as (select seq, {_BASE} as base, lower(trim(title)) as t from search_results), f as (select base, t, min(seq) as first from k group by 1, 2), r as (select base, t, row_number() over (partition by base order by first) as n from f)
select seq, case when n > 1 then k.base || n else k.base end as citation_key from k join r on k.base = r.base and k.t is not distinct from r.t""")
def wn10_numbered(s, d):
    """WN10: unique citation keys of all hits in the order of arrival."""
    return ordered.numbered_keys(table(s, d, "search_results"), "seq").select("seq", "citation_key")


@query("wn5_times", """with r as (select run_id, list(summary_time order by logged_at, entry_id) as x from (select distinct run_id, entry_id, summary_time, logged_at from progress where summary_time is not null) group by run_id)
select run_id, round(list_sum(x) / len(x) * 100, 4) as linear, round(list_reduce(x, lambda a, y: 0.7 * a + 0.3 * y) * 100, 4) as ema, round(list_min(x) * 100, 4) as least, round(list_max(x) * 100, 4) as most from r""")
def wn5_times(s, d):
    """WN5: remaining time of each run by linear, exponential and bounded estimates; a run's summaries are bounded by its papers."""
    p = table(s, d, "progress").dropDuplicates(["entry_id"]).filter("summary_time is not null").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("logged_at", "entry_id", "summary_time"))).alias("x"))
    times, left = F.transform("x", lambda r: r["summary_time"]), F.lit(100.0)
    bounds = ordered.eta_bounds(times, left)
    total = F.aggregate(times, F.lit(0.0), lambda a, b: a + b)
    r = lambda c: F.round(c, 4)
    return p.select("run_id", r(ordered.eta(F.size("x"), F.size("x") + 100, total)).alias("linear"), r(ordered.eta_ema(times, left)).alias("ema"), r(bounds["least"]).alias("least"), r(bounds["most"]).alias("most"))


_CMP = "regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' ')), '\\s+', ' ', 'g'), '[#*_`\\[\\]()]', '', 'g'), '\\d+', 'N', 'g')"
_W = "list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> '')"


@query("rp2_counts", f"""with t as (select citation_key, {_W.format(c=_CMP.format(c='a'))} as x, {_W.format(c=_CMP.format(c='b'))} as y from (select citation_key, l.abstract as a, p.overview as b from library l join (select citation_key, max(overview) as overview from parsed_summaries group by 1) p using (citation_key) where l.abstract is not null and p.overview is not null)),
u as (select citation_key, list_distinct(list_concat(x, y)) as w, x, y from t)
select citation_key, round(case when len(x) > 0 and len(y) > 0 then list_sum(list_transform(w, lambda z: len(list_filter(x, lambda q: q = z)) * len(list_filter(y, lambda q: q = z)))) / (sqrt(list_sum(list_transform(w, lambda z: len(list_filter(x, lambda q: q = z)) ** 2))) * sqrt(list_sum(list_transform(w, lambda z: len(list_filter(y, lambda q: q = z)) ** 2)))) else 0 end, 9) as cosine from u""")
def rp2_counts(s, d):
    """RP2: abstracts against the overviews of their summaries."""
    p = table(s, d, "parsed_summaries").groupBy("citation_key").agg(F.max("overview").alias("overview"))
    both = table(s, d, "library").join(p, "citation_key").filter("abstract is not null and overview is not null")
    return both.select("citation_key", F.round(tx.frequency_cosine(F.col("abstract"), F.col("overview")), 9).alias("cosine"))


_RUNS = "list_distinct(case when len({w}) >= 3 then list_transform(range(1, len({w}) - 1), lambda i: array_to_string({w}[i:i + 2], ' ')) else [] end)"


@query("rp3_runs", f"""with t as (select citation_key, {_W.format(c=_CMP.format(c='a'))} as x, {_W.format(c=_CMP.format(c='b'))} as y from (select citation_key, l.abstract as a, p.overview as b from library l join (select citation_key, max(overview) as overview from parsed_summaries group by 1) p using (citation_key) where l.abstract is not null and p.overview is not null)),
u as (select citation_key, {_RUNS.format(w='x')} as x, {_RUNS.format(w='y')} as y from t)
select citation_key, round(case when len(x) > 0 and len(y) > 0 then len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) else 0 end, 9) as similarity from u""")
def rp3_runs(s, d):
    """RP3: abstracts against the overviews of their summaries, by runs of three words."""
    p = table(s, d, "parsed_summaries").groupBy("citation_key").agg(F.max("overview").alias("overview"))
    both = table(s, d, "library").join(p, "citation_key").filter("abstract is not null and overview is not null")
    return both.select("citation_key", F.round(tx.sequence_similarity(F.col("abstract"), F.col("overview")), 9).alias("similarity"))


@query("ag4_trends", "select year, count(*) as n_papers from library where year <> 0 group by year")
def ag4_trends(s, d):
    """AG2, AG4, PL1."""
    return meta.by_year(table(s, d, "library"))


@query("ag41_topics", f"with k as (select keyword, count(*) as n from {KW_ROWS} group by keyword) select keyword, n, row_number() over (order by n desc, keyword) as rank from k qualify rank <= 30")
def ag41_topics(s, d):
    """AG41, SR4, PL2: the thirty most frequent keywords, input of topic charts and word clouds."""
    return meta.top_keywords(table(s, d, "library"), 30)


@query("ag44_evolution", f"with k as (select keyword, count(*) as n from {KW_ROWS} group by keyword), t as (select keyword from k order by n desc, keyword limit 10) select keyword, year, count(*) as n from {KW_ROWS} join t using (keyword) where year <> 0 group by keyword, year")
def ag44_evolution(s, d):
    """AG44, SR4: years of the ten most frequent keywords."""
    lib = table(s, d, "library")
    # ten rows
    return meta.keyword_years(lib).join(F.broadcast(meta.top_keywords(lib, 10).select("keyword")), "keyword")


_CELL = "least(9, greatest(0, floor((c + 1) * 5)))::int"


@query("pl10_distribution", f"select bin, count(*) as n from (select {_CELL.replace('c +', 'round(list_cosine_similarity(q.v, e.v), 6) +')} as bin from (select vec_id, embedding::double[] as v from embeddings where vec_id % 50 = 0) q join (select vec_id, embedding::double[] as v from embeddings) e on q.vec_id <> e.vec_id) group by bin")
def pl10_distribution(s, d):
    """PL10: histogram of the similarities of the vectors whose id is divisible by 50 with all others."""
    e = table(s, d, "embeddings")
    return vec.similarity_histogram(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10)


@query("pl12_results", """with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 50 = 0), p as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.v, e.embedding::double[]), 9) as c from q join embeddings e on q.vec_id <> e.vec_id)
select query, row_number() over (partition by query order by c desc, neighbour) as rank, neighbour, round(c, 6) as cosine, round(c / max(c) over (partition by query), 5) as share from p qualify rank <= 5""")
def pl12_results(s, d):
    """PL12: the five best hits of each query with their share of the best, input of result charts."""
    e = table(s, d, "embeddings")
    got = vec.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 5)
    best = got.filter("rank = 1").select("query", F.col("cosine").alias("best"))
    return got.join(best, "query").select("query", "rank", "neighbour", F.round("cosine", 6).alias("cosine"), F.round(F.col("cosine") / F.col("best"), 5).alias("share"))


@query("fl17_kinds", "select doc_id, starts_with(text, '%PDF') as is_pdf, regexp_matches(lower(left(text, 256)), '<!doctype html|<html|<head|<body|<title|<meta|<div|<script|<link|<p>') as is_html from (select doc_id, case doc_id % 3 when 0 then '%PDF-1.4 ' || text when 1 then '<HTML><body>' || text else text end as text from documents where text is not null)")
def fl17_kinds(s, d):
    """FL17: content told by its first bytes."""
    t = F.expr("case doc_id % 3 when 0 then '%PDF-1.4 ' || text when 1 then '<HTML><body>' || text else text end")
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", t.cast("binary").alias("content"), t.alias("t"))
    return docs.select("doc_id", select.pdf_magic(F.col("content")).alias("is_pdf"), select.html_magic(F.left("t", F.lit(256)).cast("binary")).alias("is_html"))


@query("sc4_entry", "select * exclude (metadata) from library where citation_key = (select min(citation_key) from library)")
def sc4_entry(s, d):
    """SC4: one entry by its key; the filter reaches the scan."""
    lib = table(s, d, "library")
    key = lib.agg(F.min("citation_key")).collect()[0][0]
    return lib.filter(F.col("citation_key") == key).drop("metadata")


@query("ag14_statistics", "select count(*) as papers, min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year from library")
def ag14_statistics(s, d):
    """AG14."""
    return inv.library_stats(table(s, d, "library"), table(s, d, "artifacts")).select("papers", "first_year", "last_year")


@query("rp7_attributions", """select doc_id, len(regexp_extract_all(text, '(?i)(?:"The authors state:\\s*"|"According to [^:]+:\\s*"|"They note:\\s*"|"The paper argues:\\s*")\\s*(?:"The authors state:\\s*"|"According to [^:]+:\\s*"|"They note:\\s*"|"The paper argues:\\s*")'))::int as n from (select doc_id, '"They note: " "The authors state: "' || text as text from documents where text is not null)""")
def rp7_attributions(s, d):
    """RP7: attributions that follow each other, in documents that begin with two."""
    t = F.concat(F.lit('"They note: " "The authors state: "'), F.col("text"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", checks.repeated_attributions(t).alias("n"))


@query("dd3_fresh", f"""with r as (select * from search_results where coalesce(doi not in (select doi from library where doi <> ''), true) and coalesce(lower(trim(title)) not in (select lower(trim(title)) from library where title is not null), true)),
a as (select *, lower(trim(title)) as t from r qualify row_number() over (partition by coalesce(nullif(doi, ''), '#' || seq) order by seq) = 1), b as (select * from a qualify row_number() over (partition by t order by seq) = 1),
k as (select seq, {_BASE} as base, t from b), n as (select seq, base, row_number() over (partition by base order by seq) as n from k) select seq, case when n > 1 then base || n else base end as citation_key from n""")
def dd3_fresh(s, d):
    """DD3, OP1: hits that the library lacks, with their new keys."""
    return resolve.new_entries(table(s, d, "search_results"), table(s, d, "library")).select("seq", "citation_key")


#: Per remainder of the hit's number: the page's address, what the page holds, and the first address that the rules make of it.
_PAGES = {
    0: ("https://www.sciencedirect.com/a", '<a data-pii="S{n}">x</a>', "https://www.sciencedirect.com/science/article/pii/S{n}/pdfft?isDTMRedir=true&download=true"),
    1: ("https://link.springer.com/a", '<meta data-article-id="s{n}">', "https://link.springer.com/content/pdf/10.1007/s{n}.pdf"),
    2: ("https://ieeexplore.ieee.org/a", '<div data-arnumber="{n}">', "https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber={n}"),
    3: ("https://dl.acm.org/doi/10.1145/{n}", "<p>text</p>", "https://dl.acm.org/doi/pdf/10.1145/{n}"),
    4: ("https://onlinelibrary.wiley.com/a", '<p data-doi="10.1002/w{n}">', "https://onlinelibrary.wiley.com/doi/pdfdirect/10.1002/w{n}"),
    5: ("https://osf.io/p{n}", "<p>text</p>", "https://osf.io/p{n}/download"),
    6: ("https://mirror.invalid/a/b", '<a href="../c/{n}.pdf">x</a>', "https://mirror.invalid/c/{n}.pdf"),
}
_NAMES = ("elsevier", "springer", "ieee", "acm", "wiley", "osf", "generic")


@query("ht4_publishers", "select seq, case seq % 7 " + " ".join(f"when {i} then {n!r}" for i, n in enumerate(_NAMES)) + " end as publisher, case seq % 7 " + " ".join(f"when {i} then replace('{x[2]}', '{{n}}', (seq + 1000)::varchar)" for i, x in _PAGES.items()) + " end as first_link from search_results")
def ht4_publishers(s, d):
    """HT1, HT2, HT4, HT5: each hit as a page of one of the publishers, and the first address found on it."""
    from paperloom.functions import pages
    from paperloom.plans.other_queries import per_row

    fill = lambda k: F.replace(F.element_at(F.create_map(*[F.lit(v) for i, x in _PAGES.items() for v in (i, x[k])]), (F.col("seq") % 7).cast("int")), F.lit("{n}"), (F.col("seq") + 1000).cast("string"))
    rows = table(s, d, "search_results").select("seq", fill(0).alias("url"), fill(1).alias("page"))
    return per_row(rows, ["seq"], ["url", "page"], lambda url, page: (pages.publisher(url), next(iter(pages.pdf_links(page, url)), None)), "publisher string, first_link string")
