"""Addresses and text from HTML pages (HT1-HT13), driven by a table of publishers' rules."""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from typing import NamedTuple
from urllib.parse import urljoin

class Publisher(NamedTuple):
    """Rules of one publisher: parts of its addresses, patterns of ids with the addresses made from them, patterns of links.

    A further one is added with ``PUBLISHERS.insert``; the first whose hosts fit is used."""

    name: str
    hosts: tuple[str, ...]
    ids: tuple[tuple[str, tuple[str, ...]], ...]
    links: tuple[str, ...]


#: The publishers' rules.
PUBLISHERS = [
    Publisher(
        "osf",
        ("osf.io", "10.31234", "10.31219"),
        (
            (r"osf\.io/([a-z0-9_]+)", ("https://osf.io/{0}/download",)),
        ),
        (
            r"href=[\"']([^\"']*download[^\"']*)[\"']",
            r"href=[\"']([^\"']*\.pdf[^\"']*)[\"']",
            r"data-download-url=[\"']([^\"']*)[\"']",
        ),
    ),
    Publisher(
        "elsevier",
        ("sciencedirect.com", "elsevier.com"),
        (
            (r"pii[\"']?\s*[:=]\s*[\"']([A-Z0-9]+)[\"']", ("https://www.sciencedirect.com/science/article/pii/{0}/pdfft?isDTMRedir=true&download=true",)),
            (r"sciencedirect\.com/science/article/pii/([A-Z0-9]+)", ("https://www.sciencedirect.com/science/article/pii/{0}/pdfft?isDTMRedir=true&download=true",)),
            (r"data-pii=[\"']([A-Z0-9]+)[\"']", ("https://www.sciencedirect.com/science/article/pii/{0}/pdfft?isDTMRedir=true&download=true",)),
            (r"\"pii\":\"([A-Z0-9]+)\"", ("https://www.sciencedirect.com/science/article/pii/{0}/pdfft?isDTMRedir=true&download=true",)),
        ),
        (
            r"href=[\"']([^\"']*sciencedirect[^\"']*\.pdf[^\"']*)[\"']",
            r"href=[\"']([^\"']*elsevier[^\"']*\.pdf[^\"']*)[\"']",
            r"data-pdf-url=[\"']([^\"']*)[\"']",
            r"data-download-url=[\"']([^\"']*)[\"']",
            r"downloadUrl[\"']?\s*[:=]\s*[\"']([^\"']*\.pdf[^\"']*)[\"']",
        ),
    ),
    Publisher(
        "springer",
        ("springer.com", "nature.com"),
        (
            (r"springer\.com/article/([0-9]+)", ("https://link.springer.com/content/pdf/10.1007/{0}.pdf", "https://link.springer.com/content/pdf/{0}.pdf", "https://link.springer.com/article/{0}/pdf")),
            (r"link\.springer\.com/article/10\.\d+/([^/\"'\s]+)", ("https://link.springer.com/content/pdf/10.1007/{0}.pdf", "https://link.springer.com/content/pdf/{0}.pdf", "https://link.springer.com/article/{0}/pdf")),
            (r"link\.springer\.com/content/pdf/10\.\d+/([^/]+)\.pdf", ("https://link.springer.com/content/pdf/10.1007/{0}.pdf", "https://link.springer.com/content/pdf/{0}.pdf", "https://link.springer.com/article/{0}/pdf")),
            (r"articleId[\"']?\s*[:=]\s*[\"']([^\"']+)[\"']", ("https://link.springer.com/content/pdf/10.1007/{0}.pdf", "https://link.springer.com/content/pdf/{0}.pdf", "https://link.springer.com/article/{0}/pdf")),
            (r"data-article-id=[\"']([^\"']+)[\"']", ("https://link.springer.com/content/pdf/10.1007/{0}.pdf", "https://link.springer.com/content/pdf/{0}.pdf", "https://link.springer.com/article/{0}/pdf")),
            (r"doi[\"']?\s*[:=]\s*[\"'](10\.\d+/[^\"']+)[\"']", ("https://link.springer.com/content/pdf/{0}.pdf",)),
            (r"data-doi=[\"'](10\.\d+/[^\"']+)[\"']", ("https://link.springer.com/content/pdf/{0}.pdf",)),
            (r"link\.springer\.com/article/(10\.\d+/[^/\"'\s]+)", ("https://link.springer.com/content/pdf/{0}.pdf",)),
        ),
        (
            r"data-pdf-url=[\"']([^\"']*)[\"']",
            r"pdfDownloadUrl[\"']?\s*[:=]\s*[\"']([^\"']*)[\"']",
            r"href=[\"']([^\"']*springer[^\"']*pdf[^\"']*)[\"']",
        ),
    ),
    Publisher(
        "ieee",
        ("ieee.org",),
        (
            (r"arnumber[\"']?\s*[:=]\s*[\"']?([0-9]+)[\"']?", ("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber={0}", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber={0}")),
            (r"ieee\.org/document/([0-9]+)", ("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber={0}", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber={0}")),
            (r"documentNumber[\"']?\s*[:=]\s*[\"']?([0-9]+)[\"']?", ("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber={0}", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber={0}")),
            (r"data-arnumber=[\"']([0-9]+)[\"']", ("https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber={0}", "https://ieeexplore.ieee.org/stamp/stamp.jsp?tp=&arnumber={0}")),
        ),
        (
            r"pdfUrl[\"']?\s*[:=]\s*[\"']([^\"']*ieee[^\"']*\.pdf[^\"']*)[\"']",
            r"downloadUrl[\"']?\s*[:=]\s*[\"']([^\"']*ieee[^\"']*)[\"']",
            r"href=[\"']([^\"']*ieeexplore[^\"']*pdf[^\"']*)[\"']",
        ),
    ),
    Publisher(
        "acm",
        ("acm.org",),
        (
            (r"acm\.org/doi/(?:pdf/|abs/)?(10\.\d+/[0-9.]+)", ("https://dl.acm.org/doi/pdf/{0}",)),
        ),
        (
            r"href=[\"']([^\"']*acm[^\"']*pdf[^\"']*)[\"']",
            r"data-pdf-url=[\"']([^\"']*)[\"']",
        ),
    ),
    Publisher(
        "wiley",
        ("wiley.com",),
        (
            (r"onlinelibrary\.wiley\.com/doi/(?:abs/|full/)?(10\.\d+/[^/\"'\s]+)", ("https://onlinelibrary.wiley.com/doi/pdfdirect/{0}",)),
            (r"data-doi=[\"'](10\.\d+/[^\"']+)[\"']", ("https://onlinelibrary.wiley.com/doi/pdfdirect/{0}",)),
        ),
        (
            r"href=[\"']([^\"']*wiley[^\"']*pdf[^\"']*)[\"']",
            r"data-pdf-url=[\"']([^\"']*)[\"']",
        ),
    ),
]
LINKS = (r"href=[\"']([^\"']*\.pdf(?:[?#][^\"']*)?)[\"']", r"<meta[^>]+(?:citation_pdf_url)[\"'][^>]+content=[\"']([^\"']+)[\"']", r"(?:pdfUrl|pdf_url|downloadUrl)[\"']?\s*[:=]\s*[\"']([^\"']+)[\"']", r"data-pdf-url=[\"']([^\"']*)[\"']")


def publisher(url: str) -> str:
    """HT1, HT5: the first publisher whose host is in the address; 'generic' for none."""
    low = (url or "").lower()
    return next((p.name for p in PUBLISHERS if any(h in low for h in p.hosts)), "generic")


def valid_urls(urls: list[str]) -> list[str]:
    """HT3: web addresses, each once, in their order."""
    out = []
    for u in urls:
        u = u.strip()
        u = "https:" + u if u.startswith("//") else u
        if re.match(r"https?://[^\s/]+", u) and u not in out:
            out.append(u)
    return out


def pdf_links(page: str | bytes | None, url: str) -> list[str]:
    """HT1, HT2, HT4, HT6, HT11: addresses of PDFs, those of the publisher's rules first."""
    text = page.decode("utf-8", "ignore") if isinstance(page, bytes) else page or ""
    text = _html.unescape(text)
    found = []
    rules = next((p for p in PUBLISHERS if p.name == publisher(url)), None)
    if rules:
        for where in (url or "", text):
            for pattern, forms in rules.ids:
                found.extend(f.format(m) for m in re.findall(pattern, where, re.I) for f in forms)
        found.extend(urljoin(url, m) for p in rules.links for m in re.findall(p, text, re.I))
    found.extend(urljoin(url, m) for p in LINKS for m in re.findall(p, text, re.I))
    return valid_urls(found)


def strip_tags(page: str) -> str:
    """HT9."""
    return _html.unescape(re.sub(r"<[^>]+>", " ", page))


def clean_text(text: str) -> str:
    """HT9: single blanks, no lines of up to three characters or of notices, single empty lines."""
    lines = [re.sub(r"[ \t]+", " ", x).strip() for x in text.split("\n")]
    notice = r"(?i)^(?:cookie|accept all|sign in|log in|subscribe|share|download pdf|skip to|©|copyright)"
    kept = [x for x in lines if not x or (len(x) > 3 and not re.match(notice, x))]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip()


def page_text(page: str | bytes | None) -> str:
    """HT6, HT7, HT8, HT12: headers and paragraphs in their order; blocks where there are fewer than five."""
    text = page.decode("utf-8", "ignore") if isinstance(page, bytes) else page or ""
    text = re.sub(r"(?is)<(script|style|nav|header|footer|aside)\b.*?</\1>", " ", text)
    title = re.search(r"(?is)<title[^>]*>(.*?)</title>", text)
    parts = [m[1] for m in re.findall(r"(?is)<(h[1-6]|p)\b[^>]*>(.*?)</\1>", text)]
    if len(parts) < 5:
        parts += re.findall(r"(?is)<div\b[^>]*>([^<]{40,})", text)
    return clean_text("\n\n".join(x for x in ([strip_tags(title[1]).strip()] if title else []) + [strip_tags(p).strip() for p in parts] if x))


#: Terms of which a paper has one.
PAPER_TERMS = (
    "abstract", "introduction", "methods", "methodology", "results", "discussion", "conclusion", "references", "background", "related work", "related works", "literature review", "experiments",
    "experimental", "evaluation", "analysis", "method", "approach",
)


def is_paper(text: str, least: int = 2000) -> bool:
    """HT10: long enough, a term of papers, a hundred words, and no short pair of words that is everywhere."""
    low = (text or "").lower()
    words = low.split()
    if len(text or "") < least or len(words) < 100 or not any(t in low for t in PAPER_TERMS):
        return False
    pairs = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if len(a) + len(b) < 19)
    return max(pairs.values(), default=0) <= 0.1 * len(words)
