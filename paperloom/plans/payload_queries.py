"""Hits written in the layout of each bibliographic service and parsed back: one query per parser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions import text as tx
from paperloom.operators import overlap
from paperloom.runtime import table
from paperloom.sources import payloads

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name] = f
        ORACLES[name] = sql
        return f

    return add


def _parsed(s, d, source: str, payload: Column, columns: list[str]) -> DataFrame:
    """The hits as payloads of a service, one each, and the columns that come out of its parser."""
    raw = table(s, d, "search_results").select(F.col("seq").cast("string").alias("keyword"), F.lit(source).alias("source"), payload.alias("payload"))
    return payloads.parse(raw).select(F.col("keyword").cast("bigint").alias("seq"), *columns)


def _people(field: str) -> Column:
    """Authors as objects with the name in one field."""
    return F.transform("authors", lambda a: F.struct(a.alias(field)))


def _xml(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def _tag(name: str, c: Column | str) -> Column:
    """An element, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"<{name}>"), _xml(c), F.lit(f"</{name.split()[0]}>")), F.lit(""))


_NAMES = "coalesce(list_filter(authors, lambda a: a <> ''), [])"


def _date() -> Column:
    return F.concat(F.lpad(F.col("year").cast("string"), 4, "0"), F.lit("-03-01"))



@query("sc9_arxiv", f"select seq, nullif(trim(replace(title, chr(10), ' ')), '') as title, {_NAMES} as authors, year, nullif(trim(replace(abstract, chr(10), ' ')), '') as abstract, nullif(trim(doi), '') as doi, url, coalesce(pdf_url, replace(url, '/abs/', '/pdf/')) as pdf_url, 'arXiv' as venue from search_results")
def sc9_arxiv(s, d):
    """SC9: Atom entries."""
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<author><name>"), _xml(a), F.lit("</name></author>"))), "")
    link = F.coalesce(F.concat(F.lit('<link title="pdf" href="'), _xml("pdf_url"), F.lit('"/>')), F.lit(""))
    entry = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom" xmlns:x="http://arxiv.org/schemas/atom"><entry>'), _tag("id", "url"), _tag("title", "title"), _tag("summary", "abstract"), _tag("published", _date()), people, _tag("x:doi", "doi"), link, F.lit("</entry></feed>"))
    return _parsed(s, d, "arxiv", entry, ["title", "authors", "year", "abstract", "doi", "url", "pdf_url", "venue"])


@query("sc16_crossref", "select seq, title, coalesce(list_transform(authors, lambda a: coalesce(a, '')), []) as authors, year, doi, case when doi <> '' then 'https://doi.org/' || doi else url end as url, pdf_url, venue, citation_count from search_results")
def sc16_crossref(s, d):
    """SC16: items with dates in parts and lists of one title."""
    link = F.when(F.col("pdf_url").isNotNull(), F.array(F.struct(F.lit("text/html").alias("content-type"), F.col("url").alias("URL")), F.struct(F.lit("application/pdf").alias("content-type"), F.col("pdf_url").alias("URL"))))
    item = F.struct(F.array("title").alias("title"), _people("family").alias("author"), F.struct(F.array(F.array("year")).alias("date-parts")).alias("published-print"), F.col("doi").alias("DOI"), F.col("url").alias("URL"), link.alias("link"), F.array("venue").alias("container-title"), F.col("citation_count").alias("is-referenced-by-count"))
    return _parsed(s, d, "crossref", F.to_json(F.struct(F.struct(F.array(item).alias("items")).alias("message"))), ["title", "authors", "year", "doi", "url", "pdf_url", "venue", "citation_count"])


@query("sc18_openalex", f"select seq, title, {_NAMES} as authors, year, abstract, nullif(doi, '') as doi, url, pdf_url, venue, coalesce(citation_count, 0) as citation_count from search_results where title <> ''")
def sc18_openalex(s, d):
    """SC18: works with their abstract as an inverted index."""
    w = F.split("abstract", " ", -1)
    index = F.map_from_entries(F.transform(F.array_distinct(w), lambda x: F.struct(x, F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i) == x))))
    people = F.transform("authors", lambda a: F.struct(F.struct(a.alias("display_name")).alias("author")))
    work = F.struct("title", people.alias("authorships"), F.col("year").alias("publication_year"), index.alias("abstract_inverted_index"), F.col("url").alias("id"), F.concat(F.lit("https://doi.org/"), F.nullif("doi", F.lit(""))).alias("doi"), F.struct(F.col("pdf_url").alias("oa_url")).alias("open_access"), F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), F.col("citation_count").alias("cited_by_count"))
    return _parsed(s, d, "openalex", F.to_json(F.struct(F.array(work).alias("results"))), ["title", "authors", "year", "abstract", "doi", "url", "pdf_url", "venue", "citation_count"])


@query("sc20_dblp", "select seq, title, coalesce(authors, []) as authors, year, case when starts_with(doi, '10.') then doi end as doi, url, nullif(pdf_url, '') as pdf_url, nullif(venue, '') as venue from search_results")
def sc20_dblp(s, d):
    """SC20: hits whose years are text."""
    info = F.struct("title", F.struct(_people("text").alias("author")).alias("authors"), F.col("year").cast("string").alias("year"), "url", F.array(F.col("pdf_url")).alias("ee"), "doi", "venue")
    return _parsed(s, d, "dblp", F.to_json(F.struct(F.struct(F.struct(F.array(F.struct(info.alias("info"))).alias("hit")).alias("hits")).alias("result"))), ["title", "authors", "year", "doi", "url", "pdf_url", "venue"])


@query("sc22_europepmc", f"select seq, title, {_NAMES} as authors, year, abstract, doi, case when pdf_url is not null then 'https://europepmc.org/article/PMC/PMC' || seq else 'https://europepmc.org/article/MED/' || seq end as url, pdf_url, venue, citation_count from search_results")
def sc22_europepmc(s, d):
    """SC22: the PubMed Central address where there is one."""
    links = F.when(F.col("pdf_url").isNotNull(), F.array(F.struct(F.lit("html").alias("documentStyle"), F.col("url").alias("url")), F.struct(F.lit("pdf").alias("documentStyle"), F.col("pdf_url").alias("url"))))
    item = F.struct("title", F.struct(_people("lastName").alias("author")).alias("authorList"), F.col("year").cast("string").alias("pubYear"), F.col("abstract").alias("abstractText"), F.col("seq").cast("string").alias("id"), F.when(F.col("pdf_url").isNotNull(), F.concat(F.lit("PMC"), F.col("seq").cast("string"))).alias("pmcid"), "doi", F.struct(links.alias("fullTextUrl")).alias("fullTextUrlList"), F.col("venue").alias("journalTitle"), F.col("citation_count").cast("string").alias("citedByCount"))
    return _parsed(s, d, "europepmc", F.to_json(F.struct(F.struct(F.array(item).alias("result")).alias("resultList"))), ["title", "authors", "year", "abstract", "doi", "url", "pdf_url", "venue", "citation_count"])


@query("sc24_pubmed", "select seq, trim(title) as title, coalesce(list_transform(authors, lambda a: coalesce(a, '')), []) as authors, year, nullif(trim(abstract), '') as abstract, doi, 'https://pubmed.ncbi.nlm.nih.gov/' || seq || '/' as url, case when pdf_url is not null then 'https://www.ncbi.nlm.nih.gov/pmc/articles/PMC' || seq || '/pdf/' end as pdf_url, venue from search_results")
def sc24_pubmed(s, d):
    """SC24: articles whose abstract has two parts or one."""
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<string>")), lambda a: F.concat(F.lit("<Author>"), F.coalesce(F.concat(F.lit("<LastName>"), _xml(a), F.lit("</LastName>")), F.lit("")), F.lit("</Author>"))), "")
    first, rest = F.regexp_extract("abstract", r"^(\S*)", 1), F.regexp_extract("abstract", r"^\S* ([\s\S]*)$", 1)
    parts = F.when(rest != "", F.concat(_tag("AbstractText", first), _tag("AbstractText", rest))).otherwise(_tag("AbstractText", "abstract"))
    ids = F.concat(*[F.coalesce(F.concat(F.lit(f'<ArticleId IdType="{kind}">'), _xml(c), F.lit("</ArticleId>")), F.lit("")) for kind, c in (("doi", F.col("doi")), ("pmc", F.when(F.col("pdf_url").isNotNull(), F.concat(F.lit("PMC"), F.col("seq").cast("string")))))])
    article = F.concat(F.lit("<PubmedArticleSet><PubmedArticle><MedlineCitation>"), _tag("PMID", F.col("seq").cast("string")), F.lit("<Article>"), _tag("ArticleTitle", "title"), F.lit("<Abstract>"), F.coalesce(parts, F.lit("")), F.lit("</Abstract><AuthorList>"), people, F.lit("</AuthorList><Journal>"), _tag("Title", "venue"), F.lit("<JournalIssue><PubDate>"), _tag("Year", F.lpad(F.col("year").cast("string"), 4, "0")), F.lit("</PubDate></JournalIssue></Journal></Article></MedlineCitation><PubmedData><ArticleIdList>"), ids, F.lit("</ArticleIdList></PubmedData></PubmedArticle></PubmedArticleSet>"))
    return _parsed(s, d, "pubmed", article, ["title", "authors", "year", "abstract", "doi", "url", "pdf_url", "venue"])


@query("sc26_biorxiv", """select seq, title, coalesce(list_filter(list_transform(string_split(array_to_string(authors, ';'), ';'), lambda a: trim(a)), lambda a: a <> ''), []) as authors, year, abstract, nullif(doi, '') as doi, 'https://www.' || w || '.org/content/' || nullif(doi, '') || 'v2' as url, 'https://www.' || w || '.org/content/' || nullif(doi, '') || 'v2.full.pdf' as pdf_url, w as venue
from (select *, case when seq % 2 = 0 then 'medrxiv' else 'biorxiv' end as w from search_results)""")
def sc26_biorxiv(s, d):
    """SC26-SC28, SC30: papers of both servers, whose addresses follow from the DOI."""
    paper = F.struct(F.nullif("doi", F.lit("")).alias("doi"), "title", F.array_join("authors", "; ").alias("authors"), _date().alias("date"), F.lit("2").alias("version"), "abstract", F.when(F.col("seq") % 2 == 0, "medrxiv").alias("server"))
    return _parsed(s, d, "biorxiv", F.to_json(F.struct(F.array(paper).alias("collection"))), ["title", "authors", "year", "abstract", "doi", "url", "pdf_url", "venue"])


@query("sc31_unpaywall", "select seq, title, year, doi, url, case when seq % 2 = 0 then coalesce(pdf_url, url) else pdf_url end as pdf_url, venue from search_results")
def sc31_unpaywall(s, d):
    """SC31, SC32: the best open place, else another one with a PDF."""
    place = lambda c: F.struct(c.alias("url_for_pdf"))
    others = F.when(F.col("seq") % 2 == 0, F.array(place(F.lit(None).cast("string")), place(F.col("url"))))
    paper = F.struct("title", "year", "doi", F.col("url").alias("doi_url"), place(F.col("pdf_url")).alias("best_oa_location"), others.alias("oa_locations"), F.col("venue").alias("journal_name"))
    return _parsed(s, d, "unpaywall", F.to_json(paper), ["title", "year", "doi", "url", "pdf_url", "venue"])


@query("sc26_keywords", "select seq, title from search_results where list_has_any(string_split_regex(lower(concat_ws(' ', title, abstract)), '\\s+'), ['robotics', 'inference', 'bayesian'])")
def sc26_keywords(s, d):
    """SC26, SC27: papers that share a word with the query."""
    return payloads.keyword_hits(table(s, d, "search_results"), ["Robotics", "inference", "Bayesian"]).select("seq", "title")


_BEST = """with q as (select distinct title as asked from parsed_summaries where trim(title) <> ''), c as (select seq, title, source from search_results where trim(title) <> '' and source in ('biorxiv', 'arxiv', 'crossref')),
w as (select asked, {a} as wa from q), x as (select seq, source, {b} as wb from c), p as (select asked, seq, source, len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))) as s from w join x on list_has_any(wa, wb) where len(wa) > 0 and len(wb) > 0)
select asked, seq, round(s, 6) as similarity from p where s >= 0.7 qualify row_number() over (partition by asked order by case source when 'biorxiv' then 0 when 'arxiv' then 1 else 2 end, round(s, 9) desc, seq) = 1"""


def by_title(asked: DataFrame, hits: DataFrame, order: list[str], least: float = 0.7) -> DataFrame:
    """SC11, SC29: for each asked title the most similar hit of the first source in ``order`` that has one of ``least`` similarity.

    Hits of the same words are one, the first of them; shared words are counted on an index of bits."""
    rank = F.coalesce(*[F.when(F.col("source") == s, i) for i, s in enumerate(order)])
    words = lambda c: F.array_distinct(F.filter(F.split(tx.normalize_title(F.col(c)), " "), lambda w: w != ""))
    a = asked.select(F.col("title").alias("query")).filter(F.trim("query") != "").distinct().withColumn("words", words("query")).filter(F.size("words") > 0)
    b = hits.filter(F.col("source").isin(*order)).filter(F.trim("title") != "").select("seq", rank.alias("rank"), F.array_sort(words("title")).alias("words")).filter(F.size("words") > 0)
    first = b.groupBy("words").agg(F.min(F.struct("rank", "seq")).alias("first")).select(F.col("first.seq").cast("string").alias("ident"), "first.rank", "words")

    def search(index: overlap.Index, title: str, asks: list[str]) -> list[tuple[str, int, float]]:
        at, s = overlap.similar(index, asks, least)
        if not len(at):
            return []
        # the first source, then the most similar, then the first hit
        at, s = at[(ranks := index.ranks[at]) == ranks.min()], s[ranks == ranks.min()]
        near = np.round(s, 9)
        at, s = at[near == near.max()], s[near == near.max()]
        best = min(range(len(at)), key=lambda i: int(index.idents[at[i]]))
        return [(index.idents[at[best]], int(index.ranks[at[best]]), float(s[best]))]

    good, _ = overlap.asked(first, F.col("words"), a, search)
    seq = F.col("ident").cast(dict(hits.dtypes)["seq"]).alias("seq")
    best = good.select(F.col("query").alias("asked"), seq, "rank", "value").groupBy("asked").agg(F.min_by(F.struct("seq", "value"), F.struct("rank", -F.round("value", 9), "seq")).alias("r"))
    return best.select("asked", "r.seq", F.round("r.value", 6).alias("similarity"))


def _words_sql(c: str) -> str:
    from paperloom.plans.text_queries import NT

    return f"list_distinct(list_filter(string_split({NT.format(c=c)}, ' '), lambda z: z <> ''))"


@query("sc29_by_title", _BEST.format(a=_words_sql("asked"), b=_words_sql("title")))
def sc29_by_title(s, d):
    """SC11, SC29: the most similar hit of each title, by the order of the sources."""
    return by_title(table(s, d, "parsed_summaries"), table(s, d, "search_results"), ["biorxiv", "arxiv", "crossref"])
