"""Queries over the library, its files and its search results, with the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.text import KEYWORD_STOP_WORDS
from paperloom.operators import inventory as inv
from paperloom.operators import meta, ordered
from paperloom.operators import select as sel
from paperloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


STOP = ", ".join(f"'{w}'" for w in KEYWORD_STOP_WORDS)
KW = "list_distinct(list_filter(string_split_regex(lower({c}), '[^\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}') and w not in (" + STOP + ")))"
KW_ROWS = f"(select year, unnest({KW.format(c='title')}) as keyword from library union all select year, unnest({KW.format(c='abstract')}) from library)"
LIVE = "(select distinct kind, citation_key, path, size from artifacts where deleted_at is null)"


def has(kind: str) -> str:
    return f"(select citation_key from artifacts where kind = '{kind}' and deleted_at is null)"


@query("sc3_scan", "select citation_key, title, year, source from library")
def sc3_scan(s, d):
    return table(s, d, "library").select("citation_key", "title", "year", "source")


@query("sc5_known", "select r.seq from search_results r where exists (select 1 from library l where lower(trim(l.title)) = lower(trim(r.title)) or (l.doi <> '' and l.doi = r.doi))")
def sc5_known(s, d):
    """SC4, SC5: search results that the library has already, by DOI or by title."""
    lib, res = table(s, d, "library"), table(s, d, "search_results")
    by_title = res.withColumn("t", F.lower(F.trim("title"))).join(lib.select(F.lower(F.trim("title")).alias("t")).distinct(), "t", "left_semi").select("seq")
    by_doi = res.join(lib.filter("doi <> ''").select("doi").distinct(), "doi", "left_semi").select("seq")
    return by_title.union(by_doi).distinct()


@query("fl1_years", "select citation_key, year from library where year between 2010 and 2020")
def fl1_years(s, d):
    return meta.year_range(table(s, d, "library"), 2010, 2020).select("citation_key", "year")


@query("fl2_selection", f"""select citation_key from library where year >= 2005 and source in ('arxiv', 'crossref', 'openalex') and citation_key in {has('pdf')}
and regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '(?:^|[^\\pL\\pN_])model') order by citation_key limit 100""")
def fl2_selection(s, d):
    """FL2-FL8: a selection with its limit."""
    spec = sel.Selection.from_dict({"years": {"min": 2005}, "sources": ["arxiv", "crossref", "openalex"], "has_pdf": True, "keywords": ["model"], "limit": 100})
    return sel.select(table(s, d, "library"), spec, table(s, d, "artifacts")).select("citation_key")


@query("fl6_without_summary", f"select citation_key from library where citation_key not in {has('summary')}")
def fl6_without_summary(s, d):
    return sel.select(table(s, d, "library"), sel.Selection(has_summary=False), table(s, d, "artifacts")).select("citation_key")


@query("fl8_keywords", "select citation_key from library where regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '(?:^|[^\\pL\\pN_])infer') and regexp_matches(lower(coalesce(title, '') || ' ' || coalesce(abstract, '')), '(?:^|[^\\pL\\pN_])causal')")
def fl8_keywords(s, d):
    return sel.select(table(s, d, "library"), sel.Selection(keywords=["infer", "causal"])).select("citation_key")


@query("fl9_without_pdf", f"select citation_key from library where citation_key not in {has('pdf')}")
def fl9_without_pdf(s, d):
    return table(s, d, "library").join(sel.present(table(s, d, "artifacts"), "pdf"), "citation_key", "left_anti").select("citation_key")


@query("fl10_missing_doi", "select citation_key from library where coalesce(doi, '') = ''")
def fl10_missing_doi(s, d):
    return sel.missing_doi(table(s, d, "library")).select("citation_key")


@query("fl11_cleanup", f"select citation_key, citation_key in {has('pdf')} as keep from library")
def fl11_cleanup(s, d):
    """FL11, OP6: what a clean-up keeps and what it would remove; nothing is deleted."""
    kept = sel.present(table(s, d, "artifacts"), "pdf").withColumn("keep", F.lit(True))
    return table(s, d, "library").select("citation_key").join(kept, "citation_key", "left").select("citation_key", F.coalesce("keep", F.lit(False)).alias("keep"))


@query("fl12_failures", """select reason, count(*) as n, reason in ('network_error', 'timeout') as retriable from (select distinct entry_id, case when last_error = 'HTTP 403' then 'access_denied' when lower(last_error) like '%timeout%' then 'timeout' else 'unknown' end as reason
from progress where last_error is not null) group by reason""")
def fl12_failures(s, d):
    """FL12, FL13, FL18, FL22: failed entries by reason, and whether trying again makes sense."""
    rows = table(s, d, "progress").filter("last_error is not null").select("entry_id", sel.download_failure(F.col("last_error")).alias("reason")).distinct()
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn("retriable", sel.is_retriable(F.col("reason")))


@query("fl14_incomplete", "select distinct entry_id, citation_key, status from progress where status not in ('summarized', 'failed')")
def fl14_incomplete(s, d):
    return table(s, d, "progress").filter(~F.col("status").isin("summarized", "failed")).select("entry_id", "citation_key", "status").distinct()


@query("fl19_failure_labels", """select label, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percentage, min(citation_key) as example from (select distinct entry_id, citation_key,
case when lower(coalesce(last_error, '')) like '%timeout%' then 'Timeout' when lower(coalesce(last_error, '')) like '%empty%' then 'Empty/No Content' else 'Other Error' end as label from progress where status = 'failed') group by label""")
def fl19_failure_labels(s, d):
    """FL19, AG49, AG50."""
    return sel.failures(table(s, d, "progress"))


@query("fl21_listing", """select citation_key, left(title, 70) as title, case when len(authors) > 1 then authors[1] || ' et al.' when len(authors) = 1 then authors[1] else 'Unknown' end as authors, year, nullif(doi, '') as doi, coalesce(pdf_path <> '', false) as has_pdf from library""")
def fl21_listing(s, d):
    return sel.listing(table(s, d, "library"))


@query("ag1_quality", """select n, n_titles, n_abstracts, n_years, n_authors, n_venues, n_citations, round(n_titles * 100.0 / n, 6) as pct_titles, round(n_abstracts * 100.0 / n, 6) as pct_abstracts, round(n_years * 100.0 / n, 6) as pct_years,
round(n_authors * 100.0 / n, 6) as pct_authors, round(n_venues * 100.0 / n, 6) as pct_venues, round(n_citations * 100.0 / n, 6) as pct_citations, n_years > 0 as enough_for_time, n_abstracts >= 2 as enough_for_features, n_titles > 0 as enough_for_keywords
from (select count(*) as n, count(nullif(title, '')) as n_titles, count(nullif(abstract, '')) as n_abstracts, count(nullif(year, 0)) as n_years, count(*) filter (len(authors) > 0) as n_authors, count(nullif(venue, '')) as n_venues, count(citation_count) as n_citations from library)""")
def ag1_quality(s, d):
    return meta.data_quality(table(s, d, "library"))


@query("ag2_by_year", "select year, count(*) as n_papers from library where year <> 0 group by year")
def ag2_by_year(s, d):
    return meta.by_year(table(s, d, "library"))


@query("ag3_rate", """with y as (select year, count(*) as n from library where year <> 0 group by year) select (select count(*) from library) as total, count(*) as n_years, round((select count(*) from library) / count(*), 6) as average_per_year,
round(regr_slope(n, year), 6) as growth_rate, (select year from y order by n desc, year limit 1) as peak_year, max(n) as peak_count from y""")
def ag3_rate(s, d):
    return meta.publication_rate(table(s, d, "library"))


@query("ag5_keywords", f"select keyword, count(*) as n from {KW_ROWS} group by keyword having count(*) >= 2")
def ag5_keywords(s, d):
    """AG5, AG6."""
    return meta.keyword_counts(table(s, d, "library"), 2)


@query("ag5_keyword_years", f"select keyword, year, count(*) as n from {KW_ROWS} where year <> 0 group by keyword, year")
def ag5_keyword_years(s, d):
    return meta.keyword_years(table(s, d, "library"))


@query("ag7_emerging", f"""with k as (select keyword, year, count(*) as n from {KW_ROWS} where year <> 0 group by keyword, year), y as (select year, dense_rank() over (order by year desc) as r from (select distinct year from k)),
c as (select keyword, sum(case when r <= 3 then n else 0 end)::bigint as n_recent, sum(case when r > 3 then n else 0 end)::bigint as n_earlier from k join y using (year) group by keyword)
select keyword, n_recent, n_earlier, case when n_earlier = 0 then 'inf'::double else round(n_recent / n_earlier, 9) end as ratio from c where n_recent > 0 and (select count(*) from y) >= 3 and (n_earlier = 0 or round(n_recent / n_earlier, 9) >= 1.5)""")
def ag7_emerging(s, d):
    """AG7, WN4."""
    return meta.emerging_keywords(table(s, d, "library"))


@query("ag8_counts", """select 'venue' as field, venue as value, count(*) as n from library where venue <> '' group by venue union all select 'authors', a, count(*) from (select unnest(authors) as a from library) where trim(a) <> '' group by a
union all select 'source', coalesce(nullif(source, ''), 'unknown'), count(*) from library group by 2""")
def ag8_counts(s, d):
    """AG8, AG38."""
    lib = table(s, d, "library")
    parts = [meta.counts_of(lib, f).select(F.lit(f).alias("field"), "value", "n") for f in ("venue", "authors", "source")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ag9_summary", """with v as (select venue as x, count(*) as n from library where venue <> '' group by 1), a as (select a as x, count(*) as n from (select unnest(authors) as a from library) where trim(a) <> '' group by 1)
select count(*) as n, round(avg(citation_count), 6) as mean_citations, max(citation_count) as max_citations, count(nullif(doi, '')) as n_doi, count(nullif(pdf_path, '')) as n_pdf, (select count(*) from v) as n_venue, (select x from v order by n desc, x limit 1) as top_venue,
(select count(*) from a) as n_authors, (select x from a order by n desc, x limit 1) as top_authors, count(distinct coalesce(nullif(source, ''), 'unknown')) as n_source from library""")
def ag9_summary(s, d):
    return meta.metadata_summary(table(s, d, "library"))


@query("ag10_completeness", """select field, total, available, total - available as missing, round(available / total * 100, 6) as percentage from (select count(*) as total, unnest(['year', 'authors', 'abstract', 'doi', 'pdf', 'venue', 'citations']) as field,
unnest([count(year), count(*) filter (len(authors) > 0), count(nullif(abstract, '')), count(nullif(doi, '')), count(nullif(pdf_path, '')), count(nullif(venue, '')), count(citation_count)]) as available from library)""")
def ag10_completeness(s, d):
    return meta.completeness(table(s, d, "library"))


@query("ag11_classes", "select metadata['category'] as category, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6) as percentage from library where metadata['category'] <> '' group by 1")
def ag11_classes(s, d):
    return meta.classification(table(s, d, "library"))


@query("ag12_citations", """select *, round(n / (last_year - first_year + 1), 6) as papers_per_year from (select count(*) as n, round(avg(citation_count), 6) as mean, round(quantile_cont(citation_count, 0.5), 6) as median, round(stddev_pop(citation_count), 6) as std,
min(citation_count) as least, max(citation_count) as most, sum(citation_count)::bigint as total, min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year from library)""")
def ag12_citations(s, d):
    return meta.citation_stats(table(s, d, "library"))


@query("ag13_stats", f"""select papers, downloaded, summarized, pdf_bytes, first_year, last_year, round(downloaded * 100.0 / papers, 6) as pct_downloaded, round(summarized * 100.0 / papers, 6) as pct_summarized from (select count(*) as papers,
count(*) filter (citation_key in {has('pdf')}) as downloaded, count(*) filter (citation_key in {has('summary')}) as summarized, min(nullif(year, 0)) as first_year, max(nullif(year, 0)) as last_year from library),
(select sum(size)::bigint as pdf_bytes from {LIVE} where kind = 'pdf' and citation_key in (select citation_key from library))""")
def ag13_stats(s, d):
    return inv.library_stats(table(s, d, "library"), table(s, d, "artifacts"))


@query("ag15_sources", "select keyword, source, count(*) as n_results, sum(coalesce(citation_count, 0))::bigint as n_citations, count(nullif(pdf_url, '')) as n_pdf, count(nullif(doi, '')) as n_doi from search_results group by keyword, source")
def ag15_sources(s, d):
    return meta.source_statistics(table(s, d, "search_results"))


@query("ag16_overall", "select source, count(*) as n_results, sum(coalesce(citation_count, 0))::bigint as n_citations, count(nullif(pdf_url, '')) as n_pdf, count(nullif(doi, '')) as n_doi from search_results group by source")
def ag16_overall(s, d):
    """AG16, AG47."""
    return meta.source_statistics(table(s, d, "search_results"), ("source",))


@query("ag20_runs", """with l as (select run_id, citation_key, arg_max(struct_pack(status := status, t := summary_time), (logged_at, entry_id)) as x from (select distinct * from progress) group by run_id, citation_key)
select run_id, count(*) as total, count(*) filter (x.status = 'summarized') as successful, count(*) filter (x.status = 'failed') as failed, count(*) filter (x.status = 'downloaded') as downloaded, count(*) filter (x.status = 'pending') as pending,
round(avg(x.t) filter (x.t > 0), 6) as mean_time, round(count(*) filter (x.status = 'summarized') * 100.0 / count(*), 6) as pct_success, round(count(*) filter (x.status in ('summarized', 'failed')) * 100.0 / count(*), 6) as pct_complete from l group by run_id""")
def ag20_runs(s, d):
    """AG17-AG20."""
    return inv.progress_counters(table(s, d, "progress"))


@query("ag21_summaries", """select count(*) as n, round(avg(i) filter (i > 0), 6) as mean_input, round(avg(o) filter (o > 0), 6) as mean_output, round(avg(q) filter (q > 0), 6) as mean_quality, sum(i)::bigint as sum_input, sum(o)::bigint as sum_output, sum(a)::bigint as sum_attempts
from (select max(input_words) as i, max(output_words) as o, max(quality_score) as q, max(attempts) as a from parsed_summaries group by citation_key)""")
def ag21_summaries(s, d):
    return inv.summary_statistics(table(s, d, "parsed_summaries"))


@query("ag36_trend", "select count(*) as n, round(regr_slope(citation_count, year), 4) as slope, round(regr_intercept(citation_count, year), 2) as intercept from library where year <> 0 and citation_count is not null")
def ag36_trend(s, d):
    return meta.citation_trend(table(s, d, "library"))


@query("ag37_venue_years", "select venue, year, count(*) as n from library where year <> 0 and venue in (select venue from library where venue <> '' group by venue order by count(*) desc, venue limit 10) group by venue, year")
def ag37_venue_years(s, d):
    """AG37, AG40."""
    return meta.venue_years(table(s, d, "library"))


@query("ag39_correlations", "select count(*) as n, round(corr(year, c), 6) as year_citations, round(corr(year, a), 6) as year_authors, round(corr(c, a), 6) as citations_authors from (select year::double as year, coalesce(citation_count, 0)::double as c, coalesce(len(authors), 0)::double as a from library where year <> 0)")
def ag39_correlations(s, d):
    return meta.correlations(table(s, d, "library"))


@query("ag42_coauthors", "select x.a as a, y.a as b, count(*) as n from (select distinct citation_key, unnest(authors) as a from library) x join (select distinct citation_key, unnest(authors) as a from library) y on x.citation_key = y.citation_key and x.a < y.a group by 1, 2")
def ag42_coauthors(s, d):
    return meta.pair_counts(table(s, d, "library"), "citation_key", "authors")


@query("ag43_keyword_pairs", f"with k as (select citation_key, unnest({KW.format(c='title')}) as k from library) select x.k as a, y.k as b, count(*) as n from k x join k y on x.citation_key = y.citation_key and x.k < y.k group by 1, 2")
def ag43_keyword_pairs(s, d):
    from paperloom.functions.text import keywords

    return meta.pair_counts(table(s, d, "library").select("citation_key", keywords(F.col("title")).alias("k")), "citation_key", "k")


@query("ag46_selection", "select (select count(*) from library) as total, count(*) as selected, round(count(*) / (select count(*) from library), 6) as rate from library where year >= 2015")
def ag46_selection(s, d):
    lib = table(s, d, "library")
    return sel.selection_summary(lib, sel.select(lib, sel.Selection(year_min=2015)))


@query("jn1_texts", """select l.citation_key, coalesce(case when trim(t.x) <> '' then t.x end, nullif(l.abstract, '')) as text, case when trim(t.x) <> '' then 'text' when l.abstract <> '' then 'abstract' else 'none' end as origin
from library l left join (select citation_key, max(text) as x from corpus group by 1) t using (citation_key)""")
def jn1_texts(s, d):
    """JN1, SC6."""
    return inv.with_texts(table(s, d, "library"), table(s, d, "corpus"))


@query("jn2_report", """with l as (select citation_key, arg_max(struct_pack(s := status, n := download_attempts, e := last_error), (logged_at, entry_id)) as x from (select distinct * from progress) group by 1), q as (select citation_key, max(quality_score) as quality_score, max(output_words) as output_words from parsed_summaries group by 1)
select citation_key, title, year, source, case when x is null then 'skipped' when x.s = 'failed' then 'failed' when quality_score is not null or x.s = 'summarized' then 'summarized' else x.s end as status, x.n as download_attempts, x.e as last_error, quality_score, output_words
from library left join l using (citation_key) left join q using (citation_key)""")
def jn2_report(s, d):
    """JN2, SK17."""
    return inv.report_rows(table(s, d, "library"), table(s, d, "progress"), table(s, d, "parsed_summaries"))


@query("jn7_work", f"""with f as (select distinct citation_key from progress where status = 'failed') select citation_key, 'pdf' as step from library where citation_key not in {has('pdf')} and citation_key not in (select citation_key from f where citation_key is not null)
union all select citation_key, 'extraction' from library where citation_key in {has('pdf')} and citation_key not in {has('text')} union all select citation_key, 'summary' from library where citation_key in {has('pdf')} and citation_key in {has('text')} and citation_key not in {has('summary')}""")
def jn7_work(s, d):
    """JN4-JN7, JN20, JN21."""
    return inv.work_lists(table(s, d, "library"), table(s, d, "artifacts"), table(s, d, "progress").filter("status = 'failed'"))


@query("jn8_orphans", f"select kind, citation_key, path, size from {LIVE} where citation_key not in (select citation_key from library)")
def jn8_orphans(s, d):
    """JN8, SO3."""
    return inv.orphaned_files(table(s, d, "library"), table(s, d, "artifacts")).select("kind", "citation_key", "path", "size")


@query("jn9_orphan_totals", f"select kind, count(*) as n, sum(coalesce(size, 0))::bigint as bytes from {LIVE} where citation_key not in (select citation_key from library) group by kind")
def jn9_orphan_totals(s, d):
    return inv.orphan_totals(table(s, d, "library"), table(s, d, "artifacts"))


_P = f"""(select coalesce(l.citation_key, a.citation_key) as k, l.citation_key is not null as m, coalesce(p, false) as p, coalesce(t, false) as t, coalesce(s, false) as s from library l full join
(select citation_key, bool_or(kind = 'pdf') as p, bool_or(kind = 'text') as t, bool_or(kind = 'summary') as s from {LIVE} group by 1) a on l.citation_key = a.citation_key)"""


@query("jn10_analysis", f"""select count(*) filter (m) as papers, count(*) filter (m and p) as with_pdf, count(*) filter (m and t) as with_text, count(*) filter (m and s) as with_summary, count(*) filter (m and not p) as without_pdf, count(*) filter (m and not t) as without_text,
count(*) filter (m and not s) as without_summary, count(*) filter (m and p and t and s) as complete, count(*) filter (m and not p and not t and not s) as bare, count(*) filter (m and p and not t) as need_extraction, count(*) filter (m and p and t and not s) as need_summary,
count(*) filter (not m and p) as orphaned_pdf, count(*) filter (not m and t) as orphaned_text, count(*) filter (not m and s) as orphaned_summary from {_P}""")
def jn10_analysis(s, d):
    return inv.analysis(table(s, d, "library"), table(s, d, "artifacts"))


@query("jn11_cached", """select pos, sha256(text) as text_key, sha256(text) in (select sha256(full_text) from summarization_contexts where full_text is not null) as hit from corpus where text is not null""")
def jn11_cached(s, d):
    """JN11, VE19, SM6: which texts the cache of embeddings has; here the cache holds the contexts' texts."""
    from paperloom.functions.text import cache_key

    cache = table(s, d, "summarization_contexts").filter("full_text is not null").select(cache_key(F.col("full_text")).alias("text_key"))
    return inv.cached(table(s, d, "corpus").filter("text is not null").select("pos", "text"), cache).select("pos", "text_key", "hit")


@query("jn12_missing_vectors", "select citation_key from library where citation_key not in (select citation_key from paper_embeddings where vec is not null and not coalesce(skipped, false))")
def jn12_missing_vectors(s, d):
    """JN12, SO4."""
    return inv.missing_vectors(table(s, d, "library"), table(s, d, "paper_embeddings"))


@query("jn16_related", f"""with a as (select citation_key as paper, unnest({KW.format(c='title')}) as k from library where year = 2024), b as (select citation_key, unnest({KW.format(c='abstract')}) as k from library),
c as (select paper, citation_key, count(*) as shared from a join b using (k) where paper <> citation_key group by 1, 2) select paper, citation_key, shared, round(shared * 0.1, 6) as score, rank from (select *, row_number() over (partition by paper order by shared desc, citation_key) as rank from c) where rank <= 5""")
def jn16_related(s, d):
    """JN16: the papers of one year against the whole library; ``jn16_all`` has all papers."""
    from paperloom.functions.text import keywords

    lib = table(s, d, "library")
    return inv.related_papers(lib, lib.filter("year = 2024").select("citation_key", keywords(F.col("title")).alias("keywords")))


@query("jn16_all", f"""with a as (select citation_key as paper, unnest({KW.format(c='title')}) as k from library), b as (select citation_key, unnest({KW.format(c='abstract')}) as k from library),
c as (select paper, citation_key, count(*) as shared from a join b using (k) where paper <> citation_key group by 1, 2) select paper, citation_key, shared, round(shared * 0.1, 6) as score, rank from (select *, row_number() over (partition by paper order by shared desc, citation_key) as rank from c) where rank <= 5""")
def jn16_all(s, d):
    """JN16: every paper against the whole library."""
    from paperloom.functions.text import keywords

    lib = table(s, d, "library")
    return inv.related_papers(lib, lib.select("citation_key", keywords(F.col("title")).alias("keywords")))


@query("sr1_relevance", """select seq, round(coalesce(least(1.0, citation_count / 100.0) * 0.4, 0) + case when coalesce(year, 0) = 0 then 0 when 2025 - year <= 10 then (1.0 - (2025 - year) / 10.0) * 0.3 when 2025 - year <= 20 then 0.1 else 0 end
+ case when source = 'semanticscholar' then 0.15 when source in ('arxiv', 'pubmed', 'crossref') then 0.1 else 0.05 end * 0.1 + (case when doi <> '' then 0.2 else 0 end + case when length(abstract) > 100 then 0.3 else 0 end + case when venue <> '' then 0.2 else 0 end + case when pdf_url <> '' then 0.3 else 0 end) * 0.2, 6)::double as score from search_results""")
def sr1_relevance(s, d):
    return table(s, d, "search_results").select("seq", F.round(ordered.relevance(), 6).alias("score"))


@query("sr2_recent", "select citation_key, case when length(title) > 60 then left(title, 60) || '...' else title end as title, year, added_date from library order by added_date desc, citation_key limit 5")
def sr2_recent(s, d):
    return meta.recent_additions(table(s, d, "library"))


@query("sr3_top", "select * from (select venue as value, count(*) as n from library where venue <> '' group by 1 order by n desc, value limit 15)")
def sr3_top(s, d):
    """SR3, SR4, SR6, SR8, PL1-PL3."""
    return meta.top(meta.counts_of(table(s, d, "library"), "venue"), 15)


@query("so1_union", """select citation_key, title from library union all select citation_key, title from parsed_summaries""")
def so1_union(s, d):
    """SO1, SO2."""
    return table(s, d, "library").select("citation_key", "title").unionByName(table(s, d, "parsed_summaries").select("citation_key", "title"))


@query("so5_shared", "select citation_key from library intersect select citation_key from corpus")
def so5_shared(s, d):
    """SO5 on keys."""
    return table(s, d, "library").select("citation_key").intersect(table(s, d, "corpus").select("citation_key"))


@query("pl4_histogram", "select floor(citation_count / 25)::bigint as bin, count(*) as n from library where citation_count is not null group by 1")
def pl4_histogram(s, d):
    """PL4: citations in bins of 25."""
    return table(s, d, "library").filter("citation_count is not null").groupBy(F.floor(F.col("citation_count") / 25).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("pl16_cited", "select bool_or(citation_count > 0) as any_cited from library")
def pl16_cited(s, d):
    """PL16, PL18."""
    return table(s, d, "library").agg(F.bool_or(F.col("citation_count") > 0).alias("any_cited"))
