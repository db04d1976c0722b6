"""Queries over texts, logs, vectors and orders, with the SQL to check them by where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import mentions as men
from paperloom.functions import text as tx
from paperloom.operators import meta, mining, ordered
from paperloom.operators import vectors as vec
from paperloom.plans.library_queries import KW
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


NT = "trim(regexp_replace(regexp_replace(lower({c}), '[^\\pL\\pN_\\s]', '', 'g'), '\\s+', ' ', 'g'))"
WORDS = "list_distinct(list_filter(string_split_regex({c}, '\\s+'), lambda w: w <> ''))"


@query("keyword_trends", f"select keyword, year, count(*) as n from (select year, unnest({KW.format(c='text')}) as keyword from documents) where year <> 0 group by keyword, year having count(*) >= 2")
def keyword_trends(s, d):
    """Keywords of the documents per year that at least two documents have."""
    rows = table(s, d, "documents").select("year", F.explode(tx.keywords(F.col("text"))).alias("keyword")).filter("year <> 0")
    return rows.groupBy("keyword", "year").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")


@query("st1_titles", f"select citation_key, {NT.format(c='title')} as normal from library")
def st1_titles(s, d):
    return table(s, d, "library").select("citation_key", tx.normalize_title(F.col("title")).alias("normal"))


_A, _B = WORDS.format(c=NT.format(c="l.title")), WORDS.format(c=NT.format(c="r.title"))


@query("st2_similarity", f"""select l.citation_key, r.seq, round(len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))), 9) as similarity, case when coalesce(l.year, 0) = 0 or coalesce(r.year, 0) = 0 then 0.5 when l.year = r.year then 1.0 when abs(l.year - r.year) <= 1 then 0.8 else greatest(0.0, round(1.0 - 0.2 * (abs(l.year - r.year) - 1), 9)) end::double as year_match
from library l join search_results r on l.doi = r.doi where l.doi <> ''
union all select l.citation_key, r.seq, round(len(list_intersect({_A}, {_B})) / len(list_distinct(list_concat({_A}, {_B}))), 9), case when coalesce(l.year, 0) = 0 or coalesce(r.year, 0) = 0 then 0.5 when l.year = r.year then 1.0 when abs(l.year - r.year) <= 1 then 0.8 else greatest(0.0, round(1.0 - 0.2 * (abs(l.year - r.year) - 1), 9)) end::double
from library l join search_results r on l.venue = r.venue and l.year = r.year and l.source = r.source""")
def st2_similarity(s, d):
    """ST2, ST4, RP1: similarity of titles and years of entries and hits with the same DOI, or of one venue, year and source."""
    l, r = table(s, d, "library").alias("l"), table(s, d, "search_results").alias("r")  # noqa: E741
    cols = ["l.citation_key", "r.seq", F.round(tx.title_similarity(F.col("l.title"), F.col("r.title")), 9).alias("similarity"), F.round(tx.year_match(F.col("l.year"), F.col("r.year")), 9).alias("year_match")]
    by_doi = l.filter("doi <> ''").join(r, F.col("l.doi") == F.col("r.doi")).select(*cols)
    same = l.join(r, (F.col("l.venue") == F.col("r.venue")) & (F.col("l.year") == F.col("r.year")) & (F.col("l.source") == F.col("r.source"))).select(*cols)
    return by_doi.unionByName(same)


_LN = "list_distinct(list_transform(list_filter(coalesce({c}, []), lambda a: trim(a) <> ''), lambda a: lower(string_split_regex(trim(a), '\\s+')[-1])))"
_LA, _LB = _LN.format(c="l.authors"), _LN.format(c="p.authors")


@query("st3_authors", f"select l.citation_key, round(case when len({_LA}) = 0 or len({_LB}) = 0 then 0 else len(list_intersect({_LA}, {_LB})) / len({_LA}) end, 9)::double as overlap from library l join (select distinct citation_key, authors from parsed_summaries) p using (citation_key)")
def st3_authors(s, d):
    p = table(s, d, "parsed_summaries").select("citation_key", F.col("authors").alias("b")).distinct()
    return table(s, d, "library").join(p, "citation_key").select("citation_key", F.round(tx.author_overlap(F.col("authors"), F.col("b")), 9).alias("overlap"))


_ALNUM = "regexp_replace(lower({c}), '[^\\pL\\pN]', '', 'g')"
_FIRST = "list_filter(coalesce(authors, []), lambda a: trim(a) <> '')[1]"
_KEYWORD = f"list_filter(list_transform(string_split_regex(coalesce(title, ''), '\\s+'), lambda w: {_ALNUM.format(c='w')}), lambda w: w <> '' and w not in ('a', 'an', 'the', 'on', 'in', 'of', 'for', 'to', 'and', 'with'))[1]"


@query("st6_keys", f"""select citation_key, coalesce(nullif({_ALNUM.format(c=f"string_split_regex(trim({_FIRST}), '\\s+')[-1]")}, ''), 'anonymous') || case when coalesce(year, 0) = 0 then 'nodate' else year::varchar end || coalesce({_KEYWORD}, 'paper') as generated from library""")
def st6_keys(s, d):
    """ST6, ST7."""
    return table(s, d, "library").select("citation_key", tx.citation_key_base(F.col("title"), F.col("authors"), F.col("year")).alias("generated"))


@query("st8_keywords", f"select doc_id, list_sort({KW.format(c='text')}) as keywords from documents")
def st8_keywords(s, d):
    return table(s, d, "documents").select("doc_id", F.array_sort(tx.keywords(F.col("text"))).alias("keywords"))


@query("st9_top_terms", f"""with t as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[^\\pL\\pN_]+'), lambda w: regexp_full_match(w, '[a-z]{{4,}}'))) as w from documents),
c as (select doc_id, w as term, count(*) as n from t where w not in ({", ".join(f"'{w}'" for w in tx.KEYWORD_STOP_WORDS)}) group by 1, 2) select doc_id, term, n from c qualify row_number() over (partition by doc_id order by n desc, term) <= 15""")
def st9_top_terms(s, d):
    """ST9, ST12: most frequent terms of each document."""
    rows = table(s, d, "documents").select("doc_id", F.explode(tx.keyword_tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return ordered.last_rows(rows, 15, [F.col("n").desc(), F.col("term")], ["doc_id"])


@query("st14_flags", """select doc_id, coalesce(regexp_matches(text, '(?i)(?:figure|fig\\.)\\s*\\d+'), false) as figures, coalesce(regexp_matches(text, '(?i)table\\s*\\d+'), false) as tables, coalesce(regexp_matches(text, '(?im)^\\s*(?:\\d+\\.?\\s*)?(?:references|bibliography|works cited)\\s*$'), false) as has_refs,
coalesce(list_max(list_transform(regexp_extract_all(text, '\\[(\\d{1,9})\\]', 1), lambda x: x::int)), 0) as n_refs from documents""")
def st14_flags(s, d):
    """ST14, ST15."""
    t = F.col("text")
    return table(s, d, "documents").select("doc_id", tx.has_figures(t).alias("figures"), tx.has_tables(t).alias("tables"), tx.has_references(t).alias("has_refs"), tx.count_references(t).alias("n_refs"))


@query("st13_structure")
def st13_structure(s, d):
    """ST13, ST14, ST16, ST17 on the long texts."""
    t = F.col("text")
    return table(s, d, "corpus").dropDuplicates(["pos"]).select("pos", tx.equations(t).alias("equations"), tx.has_equations(t).alias("has_equations"), tx.analyze_references(t).alias("refs"), F.round(tx.complexity(t, F.lit(7)), 6).alias("complexity"))


@query("st10_topics")
def st10_topics(s, d):
    """ST10, ST11: capitalised phrases of each document with their frequency, the first ten."""
    rows = table(s, d, "documents").select("doc_id", F.explode(tx.topics(F.col("text"))).alias("topic")).groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return ordered.last_rows(rows, 10, [F.col("n").desc(), F.col("topic")], ["doc_id"])


@query("st18_domains")
def st18_domains(s, d):
    """ST18, ST19: domain and type of each paper with the instructions for it."""
    texts = table(s, d, "corpus").groupBy("citation_key").agg(F.max("text").alias("text"))
    papers = table(s, d, "library").select("citation_key", "title", "abstract").join(texts, "citation_key", "left")
    got = papers.select("citation_key", men.detect_domain(F.col("text"), F.col("title"), F.col("abstract")).alias("d"))
    return got.select("citation_key", "d.domain", F.round("d.confidence", 6).alias("confidence"), "d.paper_type", F.round("d.type_confidence", 6).alias("type_confidence"), men.domain_instructions(F.col("d.domain")).alias("instructions"))


@query("st23_key_years", "select citation_key, case when y between 1990 and 2030 then y end as year from (select citation_key, try_cast(nullif(regexp_extract(citation_key, '(\\d{4})', 1), '') as int) as y from library)")
def st23_key_years(s, d):
    return table(s, d, "library").select("citation_key", tx.key_year(F.col("citation_key")).alias("year"))


@query("st26_tokens", "select doc_id, floor(length(text) / 4)::int as n_tokens, sha256(text) as text_key from documents")
def st26_tokens(s, d):
    """ST26, ST34."""
    return table(s, d, "documents").select("doc_id", tx.estimate_tokens(F.col("text")).alias("n_tokens"), tx.cache_key(F.col("text")).alias("text_key"))


@query("st27_comparable", "select doc_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(left(text, 400), ' ')), '\\s+', ' ', 'g'), '[#*_`\\[\\]()]', '', 'g'), '\\d+', 'N', 'g') as comparable from documents where doc_type = 'summary' and not regexp_matches(text, '[^\\x{20}-\\x{7E}\\n]')")
def st27_comparable(s, d):
    """ST27 on plain texts, as far as SQL agrees (``st27_texts`` has all); the first 400 characters are the key the repetition operators compare by."""
    plain = table(s, d, "documents").filter("doc_type = 'summary'").filter(~F.col("text").rlike("[^\\x20-\\x7E\\n]"))
    return plain.select("doc_id", tx.comparable(F.left("text", F.lit(400))).alias("comparable"))


@query("st31_durations", """select distinct entry_id, case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm ' || (s % 60) || 's' when s < 86400 then (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' else (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' end as duration
from (select entry_id, floor(summary_time * download_attempts * 100)::bigint as s from progress where summary_time is not null)""")
def st31_durations(s, d):
    p = table(s, d, "progress").filter("summary_time is not null")
    return p.select("entry_id", tx.format_duration(F.col("summary_time") * F.col("download_attempts") * 100).alias("duration")).distinct()


@query("st32_prioritized")
def st32_prioritized(s, d):
    """ST12, ST32: the parts of a paper that a prompt has room for."""
    c = table(s, d, "summarization_contexts")
    return c.select("citation_key", tx.prioritized_text(F.col("title"), F.col("abstract"), F.col("introduction"), F.col("conclusion"), F.col("key_terms")).alias("text"), tx.key_terms(F.col("title"), F.col("full_text")).alias("terms"))


@query("st35_doi_urls")
def st35_doi_urls(s, d):
    """ST35, ST36, SR7, SC12, SC13: addresses to try for each hit."""
    r = table(s, d, "search_results")
    return r.select("seq", men.doi_pdf_urls(F.nullif("doi", F.lit(""))).alias("by_doi"), men.arxiv_first(F.concat(F.array("url"), men.alternative_pdf_urls(F.col("url"))), F.col("source")).alias("by_url"), men.arxiv_pdf(F.col("url")).alias("arxiv"), men.is_arxiv_pdf(F.col("url")).alias("is_arxiv"))


_HOSTS = ["papers.example", "cite.example", "lit-hub.example", "mirror.invalid", "openpdf.invalid", "library.test", "free-energy-shop.example"]
_ITEMS = "select doc_id, year, list_filter([" + ", ".join(f"'{h}'" for h in _HOSTS) + "], lambda h: contains(lower(text), h)) as items from documents where text is not null"


def _site_rows(s, d):
    """Documents with the sites they name, as items."""
    items = F.array_sort(F.array_compact(F.array(*[F.when(F.lower("text").contains(h), F.lit(h)) for h in _HOSTS])))
    return table(s, d, "documents").filter("text is not null").select("doc_id", "year", items.alias("items"))


@query("ag26_singles", f"select item, count(*) as n from (select unnest(items) as item from ({_ITEMS})) group by item")
def ag26_singles(s, d):
    return mining.single_counts(_site_rows(s, d), "items")


@query("ag26_combinations", f"select array_to_string(list_sort(items), ', ') as combination, len(items)::int as size, count(*) as n from ({_ITEMS}) where len(items) > 0 group by 1, 2")
def ag26_combinations(s, d):
    """AG26, AG30."""
    return mining.combination_counts(_site_rows(s, d), "items")


@query("ag27_triples", f"with i as (select doc_id, unnest(items) as x from ({_ITEMS})) select p.x as a, q.x as b, r.x as c, count(*) as n from i p join i q on p.doc_id = q.doc_id and p.x < q.x join i r on q.doc_id = r.doc_id and q.x < r.x group by 1, 2, 3")
def ag27_triples(s, d):
    return mining.triple_counts(_site_rows(s, d), "items")


_PAIRS = f"(with i as (select doc_id, unnest(items) as x from ({_ITEMS})) select p.x as a, q.x as b, count(*) as n from i p join i q on p.doc_id = q.doc_id and p.x < q.x group by 1, 2)"


@query("ag28_jaccard", f"with i as (select x as item, count(*) as n from (select unnest(items) as x from ({_ITEMS})) group by 1) select p.a, p.b, p.n, round(p.n / (x.n + y.n - p.n), 9) as jaccard from {_PAIRS} p join i x on x.item = p.a join i y on y.item = p.b")
def ag28_jaccard(s, d):
    return mining.pair_jaccard(_site_rows(s, d), "doc_id", "items")


@query("ag29_matrix", f"select a, b, n from {_PAIRS} union all select b, a, n from {_PAIRS} union all select x, x, count(*) from (select unnest(items) as x from ({_ITEMS})) group by x")
def ag29_matrix(s, d):
    """AG29, SK19."""
    return mining.cooccurrence(_site_rows(s, d), "doc_id", "items")


_IY = f"(with i as (select year, unnest(items) as item from ({_ITEMS}) where year is not null), c as (select year, item, count(*) as n from i group by 1, 2) select y.year, x.item, coalesce(c.n, 0) as n from (select distinct year from c) y cross join (select distinct item from c) x left join c on c.year = y.year and c.item = x.item)"


@query("ag31_item_years", f"select * from {_IY}")
def ag31_item_years(s, d):
    """AG31, AG32, AG34."""
    return mining.item_years(_site_rows(s, d), "items")


@query("ag33_trends", f"""with l as {_IY}, y as (select year, row_number() over (order by year) as e, row_number() over (order by year desc) as t, count(*) over () as k from (select distinct year from l)),
g as (select item, sum(n)::bigint as total, sum(case when e <= 3 then n else 0 end)::bigint as n_early, sum(case when t <= 3 then n else 0 end)::bigint as n_late from l join y using (year) where k >= 6 group by item)
select *, case when n_late > 1.2 * n_early then 'Increasing' when n_late < 0.8 * n_early then 'Decreasing' else 'Stable' end as trend, case when n_early > 0 then round(n_late / n_early, 9) end as growth from g""")
def ag33_trends(s, d):
    return mining.trends(_site_rows(s, d), "items")


@query("ag35_state")
def ag35_state(s, d):
    """AG35, JN3, SC7, ST20-ST22: texts that name repositories, tools and languages."""
    c = table(s, d, "corpus").dropDuplicates(["pos"]).select(F.col("citation_key").alias("paper"), "text")
    return mining.current_state(c)


@query("jn3_mentions")
def jn3_mentions(s, d):
    c = table(s, d, "corpus").dropDuplicates(["pos"]).select(F.col("citation_key").alias("paper"), "text")
    return mining.mentions(c, table(s, d, "library"))


ERR = "event_type = 'error'"


@query("ag22_hourly", f"select date_trunc('hour', ts) as hour, count(*) as n, round(avg(value), 6) as mean_value, count(*) filter ({ERR}) as n_failed from events group by 1")
def ag22_hourly(s, d):
    """AG22, SM5."""
    return ordered.hourly_metrics(table(s, d, "events"), "ts", "value", F.expr(ERR))


@query("ag22_running", f"select event_id, user_id, count(*) over w as n_so_far, round(avg(value) over w, 6) as mean_so_far, round(sum(({ERR})::int) over w / count(*) over w, 6) as failure_rate from events window w as (partition by user_id order by ts, event_id rows unbounded preceding)")
def ag22_running(s, d):
    return ordered.running_metrics(table(s, d, "events"), ["ts", "event_id"], "value", F.expr(ERR), ["user_id"]).select("event_id", "user_id", "n_so_far", "mean_so_far", "failure_rate")


@query("ag24_health", f"""with l as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events), g as (select user_id, count(*) as n, round(1 - avg(({ERR})::int), 6) as success_rate, round(avg(value), 6) as mean_value from l where r <= 50 group by user_id)
select *, case when success_rate >= 0.9 then 'excellent' when success_rate >= 0.75 then 'good' when success_rate >= 0.5 then 'fair' else 'poor' end as state from g""")
def ag24_health(s, d):
    """AG24, WN2."""
    return ordered.health(table(s, d, "events"), [F.col("ts").desc(), F.col("event_id").desc()], "value", F.expr(ERR), ["user_id"])


@query("ag25_log", f"select event_type, count(*) as n, count(*) filter ({ERR}) as errors, round(sum(value), 4) as total_duration from events group by 1")
def ag25_log(s, d):
    """AG23, AG25, AG50."""
    return ordered.log_statistics(table(s, d, "events"), "event_type", F.expr(ERR), "value")


@query("ag45_slow", "select event_id, value, round(avg(value) over (), 6) as mean from events qualify value > 2 * round(avg(value) over (), 6)")
def ag45_slow(s, d):
    """AG45 over all events."""
    return ordered.slow_stages(table(s, d, "events"), "event_id", "value")


@query("sc34_health", f"with w as (select user_id, sum((not ({ERR}))::int) over (partition by user_id order by ts desc, event_id desc rows unbounded preceding) as g from events) select user_id, count(*) filter (g = 0) as consecutive_failures, count(*) filter (g = 0) < 3 as healthy from w group by user_id")
def sc34_health(s, d):
    """SC34, AG47: failures in a row at the end of each user's log."""
    return ordered.source_health(table(s, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()], F.expr(ERR))


@query("wn1_trend", "with r as (select *, row_number() over w as pos, count(*) over (partition by user_id) as k, avg(value) over (partition by user_id order by ts, event_id rows 9 preceding) as m from events window w as (partition by user_id order by ts, event_id)) select event_id, round(case when k < 10 then value else m end, 6) as trend from r where k < 10 or pos >= 10")
def wn1_trend(s, d):
    return ordered.moving_average(table(s, d, "events"), "value", ["ts", "event_id"], ["user_id"]).select("event_id", "trend")


@query("wn5_eta")
def wn5_eta(s, d):
    """WN5: remaining time of each run by linear, exponential and bounded estimates."""
    p = table(s, d, "progress").dropDuplicates(["entry_id"]).filter("summary_time is not null").groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("logged_at", "entry_id", "summary_time"))).alias("x"), F.count(F.lit(1)).alias("done"))
    # a run's summaries are bounded by the papers of the run
    times = F.transform("x", lambda r: r["summary_time"])
    left = F.lit(100.0)
    return p.select("run_id", F.round(ordered.eta(F.col("done"), F.col("done") + 100, F.aggregate(times, F.lit(0.0), lambda a, b: a + b)), 4).alias("linear"), F.round(ordered.eta_ema(times, left), 4).alias("ema"), ordered.eta_bounds(times, left).alias("bounds"))


@query("wn6_dedup")
def wn6_dedup(s, d):
    """WN6: events of one user and type are dropped within a minute of the last one kept."""
    return ordered.log_dedup_batch(table(s, d, "events"), "event_type", "ts", ["user_id"], 60.0).select("event_id")


_T = "(select user_id as conv_id, row_number() over (partition by user_id order by ts, event_id) as turn, case when event_type = 'signup' then 'system' else 'user' end as role, repeat('x', (value * 10)::int) as text from events)"


@query("wn7_context", f"""with t as (select *, length(text) // 4 as tokens, turn = 1 and role = 'system' as pinned from {_T}), r as (select *, 200 - coalesce(sum(case when pinned then tokens end) over (partition by conv_id), 0) as room, sum(tokens) over (partition by conv_id, pinned order by turn desc rows unbounded preceding) as later from t)
select conv_id, turn, tokens from r where pinned or later <= room""")
def wn7_context(s, d):
    """WN7: each user's events as turns within a budget of 200 tokens."""
    turns = _turns(s, d)
    return ordered.prune_context(turns, 200).select("conv_id", "turn", "tokens")


def _turns(s, d):
    from pyspark.sql.window import Window

    e = table(s, d, "events")
    at = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("conv_id"), at.alias("turn"), F.when(F.col("event_type") == "signup", "system").otherwise("user").alias("role"), F.expr("repeat('x', cast(round(value * 10) as int))").alias("text"))


@query("wn8_usage", f"select conv_id, count(*) as n_turns, sum(length(text) // 4)::bigint as tokens, round(sum(length(text) // 4) * 100.0 / 4096, 6) as pct, case when sum(length(text) // 4) * 100.0 / 4096 >= 95 then 'critical' when sum(length(text) // 4) * 100.0 / 4096 >= 80 then 'warning' else 'healthy' end as state from {_T} group by conv_id")
def wn8_usage(s, d):
    return ordered.context_usage(_turns(s, d))


@query("wn10_keys")
def wn10_keys(s, d):
    """WN10, DD3: unique citation keys of all hits in the order of arrival."""
    return ordered.numbered_keys(table(s, d, "search_results"), "seq").select("seq", "citation_key")


EMB = "(select vec_id, embedding::double[] as v from embeddings)"


@query("ve8_norms", "select count(*) as n, max(dim)::int as dim, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as least, round(max(x), 6) as most, round(quantile_cont(x, 0.5), 6) as median from (select len(embedding) as dim, sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))) as x from embeddings)")
def ve8_norms(s, d):
    return vec.norm_statistics(table(s, d, "embeddings"), "embedding")


@query("ve8_dimensions", "select dim, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std, round(min(x), 6) as least, round(max(x), 6) as most from (select unnest(range(len(embedding)))::int as dim, unnest(embedding::double[]) as x from embeddings) group by dim")
def ve8_dimensions(s, d):
    """VE8, VE13, PL13."""
    return vec.dimension_statistics(table(s, d, "embeddings"), "embedding")


@query("ve6_nearest", f"""with q as (select * from {EMB} where vec_id % 50 = 0), p as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.v, e.v), 9) as cosine from q join {EMB} e on q.vec_id <> e.vec_id)
select query, neighbour, round(cosine, 6) as cosine from p qualify row_number() over (partition by query order by cosine desc, neighbour) <= 10""")
def ve6_nearest(s, d):
    """VE6, JN18: the ten nearest of all vectors for every vector whose id is divisible by 50."""
    e = table(s, d, "embeddings")
    return vec.nearest(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 10).select("query", "neighbour", F.round("cosine", 6).alias("cosine"))


@query("jn19_links", f"""with q as (select * from {EMB} where vec_id % 50 = 0), p as (select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.v, e.v), 9) as cosine from q join {EMB} e on q.vec_id <> e.vec_id)
select query, neighbour, round(cosine, 6) as cosine from p where cosine >= 0.5""")
def jn19_links(s, d):
    """JN17, JN19, VE5, VE9, VE16: all links of the stated queries at a cosine of .5 or more; these data have none, ``jn19_edges`` has a lower one."""
    e = table(s, d, "embeddings")
    return vec.links(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 0.5).select("query", "neighbour", F.round("cosine", 6).alias("cosine"))


_QUARTILES = ", ".join(f"round(quantile_cont(c, {q}), 6) as p{round(100 * q)}" for q in (0.05, 0.25, 0.5, 0.75, 0.95))


@query("ve9_similarity", f"select count(*) as n, round(avg(c), 6) as mean, round(stddev_pop(c), 6) as std, round(min(c), 6) as least, round(max(c), 6) as most, {_QUARTILES} from (select round(list_cosine_similarity(q.v, e.v), 6) as c from (select * from {EMB} where vec_id % 50 = 0) q join {EMB} e on q.vec_id <> e.vec_id)")
def ve9_similarity(s, d):
    """VE9: similarities of the stated queries with all others; the queries are a fiftieth of the rows."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return vec.similarity_statistics(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding")


@query("ve16_checks", f"select count(*) as n, 0::bigint as out_of_range, 0::bigint as bad_diagonal, 0::bigint as asymmetric, round(avg(list_cosine_similarity(q.v, e.v)) filter (q.vec_id <> e.vec_id), 6) as mean_off_diagonal from (select * from {EMB} where vec_id % 50 = 0) q, {EMB} e")
def ve16_checks(s, d):
    """VE16: the similarities of the stated queries with all rows; ``ve16_all`` has those of all with all."""
    e = table(s, d, "embeddings")
    return vec.query_checks(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding")


@query("ve16_all")
def ve16_all(s, d):
    """VE16: the similarity table of all vectors."""
    return vec.matrix_checks(table(s, d, "embeddings"), "vec_id", "embedding")


@query("ve10_metrics")
def ve10_metrics(s, d):
    """VE10, PL14: quality of the given labels as clusters."""
    return vec.cluster_metrics(table(s, d, "embeddings"), "label", "embedding")


@query("ve11_variance")
def ve11_variance(s, d):
    """VE2, VE11, WN3, PL15."""
    return vec.explained_variance(table(s, d, "embeddings"), "embedding")


@query("ve7_projection")
def ve7_projection(s, d):
    """VE2, VE7, PL5, PL11: two principal components of each vector."""
    got = vec.projected(table(s, d, "embeddings"), "vec_id", "embedding", 2)
    return got.select("vec_id", F.round("pc1", 6).alias("pc1"), F.round("pc2", 6).alias("pc2"))


@query("ve14_quality", """select count(*) as n, count(*) filter (x < 1e-10 and skipped) as skipped_zero, count(*) filter (x < 1e-10 and not skipped) as failed_zero, 0::bigint as n_nan, 0::bigint as n_inf, min(len(vec))::int as least_dim, max(len(vec))::int as most_dim,
count(*) filter (x < 1e-10 and not skipped) = 0 and min(len(vec)) = max(len(vec)) as valid from (select vec, skipped, sqrt(list_sum(list_transform(vec::double[], lambda y: y * y))) as x from paper_embeddings where vec is not null)""")
def ve14_quality(s, d):
    """VE14, VE15, VE18."""
    return vec.quality(table(s, d, "paper_embeddings"), "citation_key", "vec", F.col("skipped"))


@query("ve17_zscore", "with n as (select vec_id, sqrt(list_sum(list_transform(embedding::double[], lambda y: y * y))) as x from embeddings) select vec_id, round(x, 6) as norm from n where (select stddev_pop(x) from n) > 0 and abs(x - (select avg(x) from n)) / (select stddev_pop(x) from n) > 2.5")
def ve17_zscore(s, d):
    """VE12, VE17."""
    return vec.outliers(table(s, d, "embeddings"), "vec_id", "embedding")


@query("ve17_iqr", "with n as (select citation_key, sqrt(list_sum(list_transform(vec::double[], lambda y: y * y))) as x from paper_embeddings where vec is not null), q as (select quantile_cont(x, 0.25) as a, quantile_cont(x, 0.75) as b from n) select citation_key, round(x, 6) as norm from n, q where x < a - 1.5 * (b - a) or x > b + 1.5 * (b - a)")
def ve17_iqr(s, d):
    return vec.outliers(table(s, d, "paper_embeddings").filter("vec is not null"), "citation_key", "vec", "iqr")


@query("ve22_ellipse")
def ve22_ellipse(s, d):
    """VE22: ellipses of the two components of each label."""
    e = table(s, d, "embeddings")
    return vec.confidence_ellipse(vec.projected(e, "vec_id", "embedding", 2).join(e.select("vec_id", "label"), "vec_id"), "pc1", "pc2", ["label"])


@query("ag26_baskets", "with b as (select l_orderkey, p_brand as x from lineitem join part on l_partkey = p_partkey group by 1, 2) select p.x as a, q.x as b, count(*) as n from b p join b q on p.l_orderkey = q.l_orderkey and p.x < q.x group by 1, 2")
def ag26_baskets(s, d):
    """AG26 on orders: pairs of brands; an order's brands are at most the number of brands."""
    b = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set("p_brand").alias("items"))
    return meta.pair_counts(b, "l_orderkey", "items")
