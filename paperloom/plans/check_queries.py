"""Queries of the checks that are column functions, each with the SQL to check it by."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions import checks, mentions, pages, quality
from paperloom.functions import text as tx
from paperloom.operators import inventory as inv
from paperloom.operators import mining, ordered, resolve
from paperloom.operators import vectors as vec
from paperloom.runtime import table
from paperloom.sources import sinks

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql_count(p: str, flags: str = "") -> str:
    return f"len(regexp_extract_all(text, {_q(f'(?{flags})' + p if flags else p)}))"


def _sql_has(c: str, p: str, flags: str = "i") -> str:
    return f"regexp_matches({c}, {_q(f'(?{flags})' + p)})"


def _docs(s, d) -> DataFrame:
    return table(s, d, "documents").filter("text is not null").select("doc_id", "text")


@query("vd3_quotes", f"select doc_id, n_quotes, n_quotes >= 3 as enough from (select doc_id, ({' + '.join(_sql_count(p) for p in quality.QUOTES)})::int as n_quotes from documents where text is not null)")
def vd3_quotes(s, d):
    """VD3."""
    got = _docs(s, d).select("doc_id", checks.quotes(F.col("text")).alias("n_quotes"))
    return got.withColumn("enough", F.col("n_quotes") >= 3)


def _sql_signs(rules) -> str:
    return "list_filter([" + ", ".join(f"case when {_sql_has('text', p)} then {_q(why)} end" for p, why in rules) + "], lambda x: x is not null)"


@query("vd5_signs", f"select doc_id, array_to_string({_sql_signs(quality.OFF_TOPIC)}, '; ') as signs from documents where text is not null")
def vd5_signs(s, d):
    """VD5."""
    return _docs(s, d).select("doc_id", F.array_join(checks.signs(F.col("text"), quality.OFF_TOPIC), "; ").alias("signs"))


_INVENTED = "coalesce(" + ", ".join(f"case when {_sql_has('text', p)} and not coalesce({_sql_has('src', p)}, false) then {_q(why)} end" for p, why in quality.HALLUCINATION) + ")"


@query("vd4_invented", f"select doc_id, {_INVENTED} as sign from documents left join (select citation_key, max(text) as src from corpus group by 1) c using (citation_key) where documents.text is not null")
def vd4_invented(s, d):
    """VD4: each document against its paper's text."""
    sources = table(s, d, "corpus").groupBy("citation_key").agg(F.max("text").alias("source"))
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "citation_key", "text").join(sources, "citation_key", "left")
    return docs.select("doc_id", checks.invented(F.col("text"), F.col("source")).alias("sign"))


_GENERIC = " or ".join(f"(length(lower(text)) - length(replace(lower(text), {_q(p)}, ''))) > {3 * len(p)}" for p in quality.GENERIC)
_STARTS = "list_transform(list_filter(list_transform(string_split_regex(lower(text), '[.!?]+'), lambda z: list_filter(string_split_regex(z, '\\s+'), lambda w: w <> '')), lambda z: len(z) > 3), lambda z: array_to_string(z[1:3], ' '))"


@query("vd6_density", f"""with t as (select doc_id, text, len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) as n, {_STARTS} as starts from documents where text is not null)
select doc_id, n >= 50 and ({_GENERIC}) as generic, n >= 50 and ({' + '.join(_sql_count(p, 'i') for p in quality.SPECIFIC)}) / greatest(1.0, n / 50) < 0.3 as few_specifics, n >= 50 and coalesce(list_max(map_values(list_histogram(starts))), 0) > 2 as alike from t""")
def vd6_density(s, d):
    """VD6."""
    return _docs(s, d).select("doc_id", checks.density_issues(F.col("text")).alias("x")).select("doc_id", "x.*")


@query("vd14_form", "select doc_id, not (contains(text, '!!!') or contains(text, '???') or contains(text, '  ')) as well_formed, length(text) between 200 and 4000 as length_ok from documents where text is not null")
def vd14_form(s, d):
    """VD14."""
    return _docs(s, d).select("doc_id", checks.well_formed(F.col("text")).alias("well_formed"), F.length("text").between(200, 4000).alias("length_ok"))


@query("vd15_citations", "select doc_id, " + ", ".join(f"{_sql_count(p)}::int as {n}" for p, n in zip(quality.CITATIONS, ("author_year", "numbered", "keys"), strict=True)) + " from documents where text is not null")
def vd15_citations(s, d):
    """VD15: all three forms."""
    return _docs(s, d).select("doc_id", checks.citations(F.col("text")).alias("x")).select("doc_id", "x.*")


_ON = " + ".join(f"{_sql_has('text', p)}::int" for p in quality.ON_TOPIC)
_BARE = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_OFF = " or ".join([*[_sql_has(f"left({_BARE}, 100)", p, "im") for p in quality.OFF_TOPIC_START], *[_sql_has(_BARE, p) for p in quality.OFF_TOPIC_ANYWHERE]])


@query("vd18_topic", f"select doc_id, ({_ON})::int as n_on_topic, (({_ON}) < 2) and ({_OFF}) as off_topic, ({' + '.join(_sql_has('text', p) + '::int' for p in quality.CONVERSATIONAL)})::int as n_chatty from documents where text is not null")
def vd18_topic(s, d):
    """VD18."""
    t = F.col("text")
    return _docs(s, d).select("doc_id", checks.on_topic(t).alias("n_on_topic"), checks.off_topic(t).alias("off_topic"), checks.conversational(t).alias("n_chatty"))


_TERMS = " or ".join(f"contains(low, {_q(t)})" for t in pages.PAPER_TERMS)


@query("ht10_papers", f"""with t as (select doc_id, text, lower(text) as low, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') as w from documents where text is not null),
p as (select *, list_filter(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), lambda x: length(x) < 20) as pairs from t)
select doc_id, length(text) >= 2000 and ({_TERMS}) and len(w) >= 100 and coalesce(list_max(map_values(list_histogram(pairs))), 0) <= 0.1 * len(w) as is_paper from p""")
def ht10_papers(s, d):
    """HT10 on all documents."""
    return _docs(s, d).select("doc_id", checks.is_paper(F.col("text")).alias("is_paper"))


_CMP = "regexp_replace(regexp_replace(regexp_replace(lower(trim({c}, ' ')), '\\s+', ' ', 'g'), '[#*_`\\[\\]()]', '', 'g'), '\\d+', 'N', 'g')"


@query("rp5_unique", f"with t as (select doc_id, list_transform(range(1, length(text) + 1, 200), lambda i: {_CMP.format(c='substring(text, i, 200)')}) as p from documents where text is not null) select doc_id, round(case when len(p) = 0 then 1 else len(list_distinct(p)) / len(p) end, 9) as unique_ratio from t")
def rp5_unique(s, d):
    """RP5."""
    return _docs(s, d).select("doc_id", F.round(checks.unique_ratio(F.col("text")), 9).alias("unique_ratio"))


_TOPIC = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2}\b"


@query("st10_phrases", f"with t as (select doc_id, unnest(regexp_extract_all(text, {_q(_TOPIC)})) as topic from documents), g as (select doc_id, topic, count(*) as n from t group by 1, 2) select doc_id, topic, n from g qualify row_number() over (partition by doc_id order by n desc, topic) <= 10")
def st10_phrases(s, d):
    """ST10: capitalised phrases of each document with their frequency, the first ten."""
    rows = table(s, d, "documents").select("doc_id", F.explode(tx.topics(F.col("text"))).alias("topic")).groupBy("doc_id", "topic").agg(F.count(F.lit(1)).alias("n"))
    return ordered.last_rows(rows, 10, [F.col("n").desc(), F.col("topic")], ["doc_id"])


@query("st11_concepts", f"""with t as (select doc_id, list_concat(regexp_extract_all(text, {_q(_TOPIC)}), regexp_extract_all(text, '"([^"\\n]{{3,50}})"', 1)) as c from documents where text is not null),
u as (select doc_id, list_filter(c, lambda x, i: list_position(c, x) = i) as c from t) select doc_id, array_to_string(c[1:15], '; ') as concepts from u""")
def st11_concepts(s, d):
    """ST11."""
    return _docs(s, d).select("doc_id", F.array_join(tx.concepts(F.col("text")), "; ").alias("concepts"))


_LIVE_LIBRARY = "(select * from library where metadata['removed_at'] is null)"
_LIVE = "(select distinct kind, citation_key, path, size from artifacts where deleted_at is null)"


def _entries(s, d) -> DataFrame:
    """The library without the entries that were taken out again."""
    return table(s, d, "library").filter(F.col("metadata")["removed_at"].isNull())


@query("jn8_left_behind", f"select kind, citation_key, path, size from {_LIVE} where citation_key not in (select citation_key from {_LIVE_LIBRARY})")
def jn8_left_behind(s, d):
    """JN8, SO3: files whose paper was taken out of the library."""
    return inv.orphaned_files(_entries(s, d), table(s, d, "artifacts")).select("kind", "citation_key", "path", "size")


@query("jn9_left_behind", f"select kind, count(*) as n, sum(coalesce(size, 0))::bigint as bytes from {_LIVE} where citation_key not in (select citation_key from {_LIVE_LIBRARY}) group by kind")
def jn9_left_behind(s, d):
    """JN9."""
    return inv.orphan_totals(_entries(s, d), table(s, d, "artifacts"))


_MENTION_TEXT = "coalesce(text, '') || ' see https://github.com/' || lower(trim(source)) || '/' || citation_key || '. Uses ' || case doc_type when 'abstract' then 'PyTorch and NumPy' when 'summary' then 'Julia with Flux.jl' when 'full_text' then 'MATLAB, ROS2' else 'python notebooks in Jupyter' end || '.'"


def _mention_texts(s, d) -> DataFrame:
    """The documents, each followed by a sentence on its code, since none of them names any."""
    docs = table(s, d, "documents").filter("source is not null and citation_key is not null and regexp_like(trim(source), '^[A-Za-z_]+$')")
    return docs.select("doc_id", F.col("citation_key").alias("paper"), F.expr(_MENTION_TEXT).alias("text"))


def _sql_mentioned(items: dict[str, str]) -> str:
    """Names whose pattern is found; the ends of words are written out, since SQL's are those of ASCII words."""

    def one(p: str) -> str:
        p = p.replace("(?!2)", "")
        p = r"(?:^|[^\pL\pN_])" + p[2:] if p.startswith(r"\b") else p
        return p[:-2] + r"(?:[^\pL\pN_]|$)" if p.endswith(r"\b") else p

    cases = ", ".join(f"case when {_sql_has('low', '|'.join(map(one, p.split('|'))), 's')} then {_q(n)} end" for n, p in items.items())
    return f"list_sort(list_filter([{cases}], lambda x: x is not null))"


_MENTION_ROWS = f"""(select doc_id, paper, url, {_sql_mentioned(mentions.TOOLS)} as tools, {_sql_mentioned(mentions.LANGUAGES)} as languages from (select doc_id, citation_key as paper, 'https://github.com/' || lower(trim(source)) || '/' || citation_key as url,
lower({_MENTION_TEXT}) as low from documents where source is not null and citation_key is not null and regexp_full_match(trim(source), '[A-Za-z_]+')))"""


@query("jn3_repositories", f"select doc_id, m.paper, coalesce(nullif(l.year, 0), case when y between 1990 and 2030 then y end) as year, array_to_string([m.url], ' ') as urls, array_to_string(tools, ' ') as tools, array_to_string(languages, ' ') as languages from (select *, try_cast(nullif(regexp_extract(paper, '(\\d{{4}})', 1), '') as int) as y from {_MENTION_ROWS}) m left join library l on l.citation_key = m.paper")
def jn3_repositories(s, d):
    """JN3, SC7, ST20-ST22: repositories, tools and languages that texts name, with the paper's year."""
    docs = _mention_texts(s, d)
    got = mining.mentions(docs.select(F.concat_ws("|", "doc_id", "paper").alias("id"), "paper", "text").withColumnRenamed("paper", "_paper"), None, "id").select("paper", "urls", "tools", "languages")
    keyed = got.select(F.split("paper", r"\|")[0].cast("bigint").alias("doc_id"), F.split("paper", r"\|")[1].alias("paper"), "urls", "tools", "languages")
    years = table(s, d, "library").select(F.col("citation_key").alias("paper"), F.nullif("year", F.lit(0)).alias("lib_year"))
    join = lambda c: F.array_join(c, " ").alias(c)
    return keyed.join(years, "paper", "left").select("doc_id", "paper", F.coalesce("lib_year", tx.key_year(F.col("paper"))).alias("year"), join("urls"), join("tools"), join("languages"))


@query("ag35_mentions", f"select count(*) as n, count(*) as with_repository, count(*) filter (try_cast(nullif(regexp_extract(paper, '(\\d{{4}})', 1), '') as int) between 1990 and 2030) as with_year from {_MENTION_ROWS}")
def ag35_mentions(s, d):
    """AG35."""
    return mining.current_state(_mention_texts(s, d))


@query("sk1_entries", "select citation_key, title, authors, year, nullif(venue, '') as venue, citation_count from library")
def sk1_entries(s, d):
    """SK1: entries written as JSON lines and read back."""
    lines = sinks.json_rows(table(s, d, "library").drop("metadata"))
    column = next(c for c, t in lines.dtypes if t == "string" and c != "citation_key")
    schema = "citation_key string, title string, authors array<string>, year int, venue string, citation_count int"
    return lines.select(F.from_json(column, schema).alias("x")).select("x.*").withColumn("venue", F.nullif("venue", F.lit("")))


@query("wn6_kept", """with recursive e as (select event_id, user_id, event_type, epoch_us(ts) as t, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events),
r as (select user_id, event_type, k, event_id, t as last, true as kept from e where k = 1 union all
select e.user_id, e.event_type, e.k, e.event_id, case when e.t - r.last >= 60000000 then e.t else r.last end, e.t - r.last >= 60000000 from r join e on e.user_id = r.user_id and e.event_type = r.event_type and e.k = r.k + 1)
select event_id from r where kept""")
def wn6_kept(s, d):
    """WN6, SM9: events of one user and type are dropped within a minute of the last one kept."""
    return ordered.log_dedup_batch(table(s, d, "events"), "event_type", "ts", ["user_id"], 60.0).select("event_id")


@query("fl15_results", "select title, coalesce(authors, []) as authors, year, abstract, url, nullif(doi, '') as doi, coalesce(source, 'library') as source, pdf_path as pdf_url, venue, citation_count from library")
def fl15_results(s, d):
    """FL15, FL16: library entries as search results."""
    return resolve.as_results(table(s, d, "library"))


@query("jn19_edges", """with q as (select vec_id, embedding::double[] as v from embeddings where vec_id % 50 = 0) select q.vec_id as query, e.vec_id as neighbour, round(list_cosine_similarity(q.v, e.embedding::double[]), 6) as cosine from q join embeddings e on q.vec_id <> e.vec_id where round(list_cosine_similarity(q.v, e.embedding::double[]), 9) >= 0.3""")
def jn19_edges(s, d):
    """JN17, JN19: all links of at least 0.3 from every vector whose id is divisible by 50 to all others."""
    e = table(s, d, "embeddings")
    got = vec.links(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", 0.3)
    return got.select("query", "neighbour", F.round("cosine", 6).alias("cosine"))


@query("ve8_medians", "select dim, round(quantile_disc(x, 0.5), 6) as median from (select unnest(range(len(embedding)))::int as dim, unnest(embedding::double[]) as x from embeddings) group by dim")
def ve8_medians(s, d):
    """VE8."""
    return vec.dimension_medians(table(s, d, "embeddings"), "embedding").withColumn("median", F.round("median", 6))


@query("ve10_silhouette", """with e as (select vec_id, vec_id % 5 as label, embedding::double[] as v from embeddings), g as (select q.vec_id as query, q.label as own, e.label, sum(list_distance(q.v, e.v)) as gap, count(*) as n from e q join e on q.vec_id % 50 = 0 group by 1, 2, 3),
s as (select query, own, max(case when own = label then gap / greatest(n - 1, 1) end) as a, min(case when own <> label then gap / n end) as b, max(case when own = label then n end) as n from g group by 1, 2)
select query, own, round(case when n > 1 then (b - a) / greatest(a, b) else 0 end, 6) as silhouette from s""")
def ve10_silhouette(s, d):
    """VE10: silhouettes of the vectors whose id is divisible by 50 against all, for given clusters."""
    e = table(s, d, "embeddings").withColumn("label", F.col("vec_id") % 5)
    return vec.silhouette(e, e.filter("vec_id % 50 = 0"), "vec_id", "embedding", "label").withColumn("silhouette", F.round("silhouette", 6))


@query("ve10_sizes", "select vec_id % 5 as label, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from embeddings group by 1")
def ve10_sizes(s, d):
    """VE10, PL14: sizes of given clusters."""
    sizes = table(s, d, "embeddings").groupBy((F.col("vec_id") % 5).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return sizes.join(F.broadcast(total), F.lit(True)).select("label", "n", F.round(F.col("n") / F.col("total"), 9).alias("share"))
