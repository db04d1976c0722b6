"""Payloads of bibliographic services as rows of one schema (SC9-SC32).

A payload table has (source, payload, keyword); each parser is a function of one payload, run by one
vectorized pass. The services themselves are outside the engine: a provider fills the payload table."""

from __future__ import annotations

import html
import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "keyword string, title string, authors array<string>, year int, abstract string, url string, doi string, source string, pdf_url string, venue string, citation_count int"
FIELDS = ["keyword", "title", "authors", "year", "abstract", "url", "doi", "source", "pdf_url", "venue", "citation_count"]


def _row(source: str, **kw) -> dict:
    return {"title": None, "authors": [], "year": None, "abstract": None, "url": None, "doi": None, "pdf_url": None, "venue": None, "citation_count": None} | kw | {"source": source}


def _int(x) -> int | None:
    try:
        return int(str(x)[:4]) if x not in (None, "") else None
    except ValueError:
        return None


def _list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def _bare_doi(x: str | None) -> str | None:
    return re.sub(r"^(?:https?://(?:dx\.)?doi\.org/|doi:)", "", x) if x else None


def arxiv(payload: str) -> list[dict]:
    """SC9: Atom entries; the PDF is the link of that title, else made from the id."""
    ns = {"a": "http://www.w3.org/2005/Atom", "x": "http://arxiv.org/schemas/atom"}
    out = []
    for e in ET.fromstring(payload).findall("a:entry", ns):
        get = lambda p, e=e: (e.findtext(p, None, ns) or "").strip().replace("\n", " ") or None
        pdf = next((link.get("href") for link in e.findall("a:link", ns) if link.get("title") == "pdf"), None)
        url = get("a:id")
        out.append(_row("arxiv", title=get("a:title"), authors=[n for a in e.findall("a:author", ns) if (n := a.findtext("a:name", None, ns))], year=_int(get("a:published")), abstract=get("a:summary"), url=url, doi=get("x:doi"), pdf_url=pdf or (url or "").replace("/abs/", "/pdf/") or None, venue="arXiv"))
    return out


def semanticscholar(payload: str) -> list[dict]:
    """SC14: a PDF only where it is open."""
    return [_row("semanticscholar", title=p.get("title"), authors=[a.get("name") for a in _list(p.get("authors")) if a.get("name")], year=p.get("year"), abstract=p.get("abstract"), url=p.get("url"), doi=(p.get("externalIds") or {}).get("DOI"), pdf_url=(p.get("openAccessPdf") or {}).get("url") if p.get("isOpenAccess") else None, venue=p.get("venue") or None, citation_count=p.get("citationCount")) for p in _list(json.loads(payload).get("data"))]


def crossref(payload: str) -> list[dict]:
    """SC16: printed before online year; abstract without tags; first PDF link."""
    out = []
    for i in _list(json.loads(payload).get("message", {}).get("items")):
        parts = ((i.get("published-print") or i.get("published-online") or {}).get("date-parts") or [[None]])[0]
        doi = i.get("DOI")
        out.append(_row("crossref", title=(_list(i.get("title")) or [None])[0], authors=[" ".join(x for x in (a.get("given"), a.get("family")) if x) for a in _list(i.get("author"))], year=parts[0] if parts else None, abstract=html.unescape(re.sub(r"<[^>]+>", "", i["abstract"])).strip() if i.get("abstract") else None, url=f"https://doi.org/{doi}" if doi else i.get("URL"), doi=doi, pdf_url=next((x.get("URL") for x in _list(i.get("link")) if x.get("content-type") == "application/pdf"), None), venue=(_list(i.get("container-title")) or [None])[0], citation_count=i.get("is-referenced-by-count")))
    return out


def inverted_abstract(index: dict | None) -> str | None:
    """SC18: words at their positions; a missing position leaves an empty word."""
    if not index:
        return None
    at = {p: w for w, ps in index.items() for p in ps}
    return " ".join(at.get(i, "") for i in range(max(at) + 1)) if at else None


def openalex(payload: str) -> list[dict]:
    """SC18: works without a title are left out."""
    out = []
    for w in _list(json.loads(payload).get("results")):
        if w.get("title"):
            place = w.get("primary_location") or {}
            out.append(_row("openalex", title=w["title"], authors=[n for a in _list(w.get("authorships")) if (n := (a.get("author") or {}).get("display_name"))], year=w.get("publication_year"), abstract=inverted_abstract(w.get("abstract_inverted_index")), url=w.get("id"), doi=_bare_doi(w.get("doi")), pdf_url=(w.get("open_access") or {}).get("oa_url") or place.get("pdf_url"), venue=(place.get("source") or {}).get("display_name"), citation_count=int(w.get("cited_by_count") or 0)))
    return out


def dblp(payload: str) -> list[dict]:
    """SC20: single values in place of lists; a DOI begins with '10.'; the PDF is the first such address, else the first one."""
    out = []
    for h in _list((json.loads(payload).get("result", {}).get("hits") or {}).get("hit")):
        i = h.get("info", {})
        people = [a.get("text") if isinstance(a, dict) else a for a in _list((i.get("authors") or {}).get("author"))]
        links = [x for x in _list(i.get("ee")) if x]
        doi = i.get("doi")
        out.append(_row("dblp", title=i.get("title"), authors=people, year=_int(i.get("year")), url=i.get("url"), doi=doi if doi and doi.startswith("10.") else None, pdf_url=next((x for x in links if x.endswith(".pdf")), links[0] if links else None), venue=", ".join(_list(i.get("venue"))) or None))
    return out


def europepmc(payload: str) -> list[dict]:
    """SC22."""
    out = []
    for r in _list((json.loads(payload).get("resultList") or {}).get("result")):
        people = [" ".join(x for x in (a.get("firstName"), a.get("lastName")) if x) for a in _list((r.get("authorList") or {}).get("author"))]
        links = _list((r.get("fullTextUrlList") or {}).get("fullTextUrl"))
        url = f"https://europepmc.org/article/PMC/{r['pmcid']}" if r.get("pmcid") else f"https://europepmc.org/article/MED/{r['id']}" if r.get("id") else None
        out.append(_row("europepmc", title=r.get("title"), authors=[p for p in people if p], year=_int(r.get("pubYear")), abstract=r.get("abstractText"), url=url, doi=r.get("doi"), pdf_url=next((x.get("url") for x in links if x.get("documentStyle") == "pdf"), None), venue=r.get("journalTitle"), citation_count=int(r["citedByCount"]) if r.get("citedByCount") not in (None, "") else None))
    return out


def pubmed(payload: str) -> list[dict]:
    """SC24: all parts of an abstract, joined."""
    out = []
    for a in ET.fromstring(payload).iter("PubmedArticle"):
        ids = {i.get("IdType"): i.text for i in a.iter("ArticleId")}
        text = lambda e: "".join(e.itertext()).strip() if e is not None else None
        pmid, pmc = a.findtext(".//PMID"), ids.get("pmc")
        out.append(_row("pubmed", title=text(a.find(".//ArticleTitle")), authors=[" ".join(x for x in (n.findtext("ForeName"), n.findtext("LastName")) if x) for n in a.iter("Author")], year=_int(a.findtext(".//PubDate/Year") or a.findtext(".//PubDate/MedlineDate")), abstract=" ".join(t for t in (text(x) for x in a.iter("AbstractText")) if t) or None, url=f"https://pubmed.ncbi.nlm.nih.gov/{pmid}/" if pmid else None, doi=ids.get("doi"), pdf_url=f"https://www.ncbi.nlm.nih.gov/pmc/articles/{pmc}/pdf/" if pmc else None, venue=a.findtext(".//Journal/Title")))
    return out


def biorxiv(payload: str, server: str = "biorxiv") -> list[dict]:
    """SC26-SC30: papers of a server's collection; the address and PDF follow from the DOI."""
    out = []
    for p in _list(json.loads(payload).get("collection")):
        doi, where = _bare_doi(p.get("doi")), p.get("server") or server
        page = f"https://www.{where}.org/content/{doi}v{p.get('version') or 1}" if doi else None
        out.append(_row("biorxiv", title=p.get("title"), authors=[a.strip() for a in (p.get("authors") or "").split(";") if a.strip()], year=_int(p.get("date")), abstract=p.get("abstract"), url=page, doi=doi, pdf_url=f"{page}.full.pdf" if page else None, venue=where))
    return out


def unpaywall(payload: str) -> list[dict]:
    """SC31, SC32: the best open place with a PDF, else the first that has one."""
    p = json.loads(payload)
    places = [p.get("best_oa_location") or {}, *_list(p.get("oa_locations"))]
    return [_row("unpaywall", title=p.get("title"), year=p.get("year"), doi=p.get("doi"), url=p.get("doi_url"), pdf_url=next((x["url_for_pdf"] for x in places if x.get("url_for_pdf")), None), venue=p.get("journal_name"))]


PARSERS: dict[str, Callable[[str], list[dict]]] = {"arxiv": arxiv, "semanticscholar": semanticscholar, "crossref": crossref, "openalex": openalex, "dblp": dblp, "europepmc": europepmc, "pubmed": pubmed, "biorxiv": biorxiv, "unpaywall": unpaywall}


def parse(payloads: DataFrame) -> DataFrame:
    """Rows of all payloads; payloads that cannot be read, and those of unknown sources, give none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for keyword, source, payload in zip(part["keyword"], part["source"], part["payload"], strict=True):
                try:
                    rows.extend({**r, "keyword": keyword} for r in PARSERS[source](payload))
                except (KeyError, ValueError, TypeError, AttributeError, ET.ParseError):
                    continue
            frame = pd.DataFrame(rows, columns=FIELDS)
            for c in ("year", "citation_count"):
                frame[c] = pd.to_numeric(frame[c], errors="coerce").astype("Int32")
            yield frame

    return payloads.select("keyword", "source", "payload").mapInPandas(run, SCHEMA)


def keyword_hits(papers: DataFrame, words: list[str], limit: int | None = None) -> DataFrame:
    """SC26, SC27: papers that share a word of title or abstract with the query."""
    from pyspark.sql import functions as F

    tokens = F.split(F.lower(F.concat_ws(" ", "title", "abstract")), r"\s+")
    hits = papers.filter(F.arrays_overlap(tokens, F.array(*[F.lit(w.lower()) for w in words])))
    return hits.orderBy("title").limit(limit) if limit is not None else hits
