import json

import pytest

from paperloom.functions import pages, providers, quality, structure
from paperloom.functions import repetition as rep
from paperloom.sources import payloads as pl

SUMMARY = "# Active Inference\n\n### Overview\n" + "The model was tested with 45 participants and reached 91.5% accuracy in 3 hours. " + "\n\n### Results\nA different finding concerns 12 layers and 30 epochs."


@pytest.mark.parametrize("n", [5, 10, 50, 100])
def test_repeated_sections(n):
    text = "\n\n".join(["### Same\nThis section says the very same thing again and again, without any end, and it goes on for more than a hundred characters."] * n)
    assert rep.detect(text)[0] and rep.repeated_headers(text) and len(rep.without_repeated_sections(text, "aggressive")) < len(text) / 2


def test_repetition_edges():
    assert rep.detect("") == (False, 0, 1.0) and rep.detect("   ") == (False, 0, 1.0) and rep.unique_ratio("") == 1.0 and rep.severe("") is None
    assert rep.similarity("", "a") == 0.0 and rep.similarity("a b c d", "a b c d") == pytest.approx(1.0)
    assert rep.without_nested('"The authors state: " "They note: "x"') == '"The authors state: "x"'
    assert rep.without_repeated_bullets("## A\n* x\n* x\n* x\n* x\n## B\n* x").count("* x") == 4
    assert rep.without_repeated_sentences("One fine day came. One fine day came. Then it went away again.") == "One fine day came. Then it went away again."
    assert rep.severe("The same long sentence is here. " * 3) == "sentence"
    long = "word " * 60_000
    assert rep.severe(long) is not None


def test_scores():
    valid, score, errors = quality.summary_score(SUMMARY, "source", "Active Inference", min_words=10)
    assert valid and errors == [] and score == pytest.approx(0.8)
    assert not quality.summary_score("", "", "A title of words")[0] and quality.summary_score(None, None)[1] >= 0
    bad = quality.summary_score("As an AI I am happy. dear sir", "text", min_words=1)
    assert not bad[0] and quality.hard_failure(bad[2])
    assert quality.title_matches("# Deep Nets\n", "deep nets for text") and not quality.title_matches("# Cooking\nfood", "Quantum gravity and particle physics")
    got = quality.detailed(SUMMARY, "s", "Active Inference", ["model", "entropy"])
    assert got["missing_terms"] == ["entropy"] and "add quotes" in got["suggestions"]


def test_checks():
    assert quality.fenced_json('x ```json\n{"a": 1}\n``` y') == {"a": 1} and quality.fenced_json("no") is None
    assert quality.structure_errors({"a": True}, {"required": ["a", "b"], "properties": {"a": {"type": "integer"}}}) == ["missing b", "a is no integer"]
    assert quality.quotes_in_source('He: "a finding of some kind"\nShe: "this was never said"\nplain', "here is a finding of  some kind") == 'He: "a finding of some kind"\nplain'
    assert quality.bullets_in_source("* PyTorch (v1)\n* Keras", "we used pytorch") == "* PyTorch (v1)"
    assert quality.without_bloat("\n".join(["not specified"] * 5)).count("not") == 3
    assert quality.formatting_ok("fine text") and not quality.formatting_ok("what!!!")
    assert quality.citations("as shown (Smith 2020) and [1], [1, 2]") == ["Smith 2020", "1"]
    assert quality.missing_headers("# Overview\n", ["Overview", "Results"]) == ["Results"]
    assert quality.is_off_topic("Dear sir, hi there") and not quality.is_off_topic("Dear sir, the authors of the study")
    assert quality.action_items("- [ ] add data\nTODO: check\n3. Fix tables") == ["add data", "check", "Fix tables"]


def test_chunks():
    assert structure.chunks("short text") == [("whole", 0, 10)]
    text = "1. Introduction\n" + "Words and more words. " * 200 + "\n2. Methods\n" + "Done so. " * 3000 + "\n3. Conclusion\nEnd."
    got = structure.chunks(text, 15000, 500)
    assert [n for n, _, _ in got][:2] == ["introduction", "conclusion"] and all(0 <= s < e <= len(text) for _, s, e in got)
    assert list(structure.sections(text)) == ["introduction", "methods", "conclusion"]
    for n in (0, 1, 999, 15000, 15001, 47311):
        parts = structure.simple_chunks("x" * n)
        assert all(s < e for s, e in parts) and (n < 1000 or parts[-1][1] == n)
    t = "A sentence here. " * 3000
    parts = structure.token_chunks(t)
    assert parts[0][0] == 0 and parts[-1][1] == len(t) and all(b[0] <= a[1] for a, b in zip(parts, parts[1:], strict=False))
    assert structure.token_chunks("") == [] and structure.sections("") == {} and structure.title_line("") is None
    assert len(structure.truncated(text, 8000)) <= 8000 and structure.truncated("ab", 5) == "ab" and len(structure.truncated("y" * 9000, 100)) <= 100


def test_markdown():
    f = structure.summary_fields("# T\n\n**Authors:** A; B\n**Year:** 2020\n- Input words: 1,234\n")
    assert (f["Title"], f["Author"], f["Year"], f["Input"]) == ("T", "A; B", "2020", "1,234")
    assert structure.markdown_sections("### A\nx\n### B\ny\n### A\nz") == {"A": "z", "B": "y"}
    assert structure.clean_summary("Here is a summary\n## Overview\nx\n## Disclaimer\ny\n## End\nz") == "## Overview\nx\n## End\nz"
    assert structure.previous_numbers("- **Papers with tools**: 1,200\n- Texts: 7") == {"papers with tools": 1200, "texts": 7}


def test_pages():
    assert pages.publisher("https://www.ScienceDirect.com/x") == "elsevier" and pages.publisher("https://x.example") == "generic" and pages.publisher("") == "generic"
    assert pages.pdf_links('<a href="/a.pdf">x</a><a href="/a.pdf">y</a><a href="ftp://b/c.pdf">', "https://h.example/p") == ["https://h.example/a.pdf"]
    assert pages.pdf_links("<p>none</p>", "https://ieeexplore.ieee.org/document/77")[:1] == ["https://ieeexplore.ieee.org/stampPDF/getPDF.jsp?arnumber=77"]
    assert pages.pdf_links(None, "https://x.example") == []
    got = pages.page_text("<title>T &amp; U</title><script>no</script><h1>Head</h1>" + "".join(f"<p>Paragraph {i} text</p>" for i in range(5)))
    assert got.startswith("T & U\n\nHead\n\nParagraph 0 text") and "no" not in got.split()
    assert not pages.is_paper("short") and pages.is_paper("abstract results " + " ".join(f"longerword{i}" for i in range(300)))


def test_parsers():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://arxiv.org/abs/1</id><title>A\nB</title><published>2020-01-02</published><summary>S</summary><author><name>N</name></author></entry></feed>'
    assert pl.arxiv(atom)[0] | {} == {"title": "A B", "authors": ["N"], "year": 2020, "abstract": "S", "url": "http://arxiv.org/abs/1", "doi": None, "pdf_url": "http://arxiv.org/pdf/1", "venue": "arXiv", "citation_count": None, "source": "arxiv"}
    c = pl.crossref(json.dumps({"message": {"items": [{"title": ["T"], "author": [{"given": "A", "family": "B"}, {"family": "C"}], "published-online": {"date-parts": [[2019, 1]]}, "abstract": "<p>x</p>", "DOI": "10/1", "link": [{"content-type": "text/html", "URL": "h"}, {"content-type": "application/pdf", "URL": "p"}]}]}}))[0]
    assert (c["authors"], c["year"], c["abstract"], c["url"], c["pdf_url"]) == (["A B", "C"], 2019, "x", "https://doi.org/10/1", "p")
    assert pl.inverted_abstract({"a": [0, 3], "b": [1]}) == "a b  a" and pl.inverted_abstract(None) is None
    assert [r["title"] for r in pl.openalex(json.dumps({"results": [{"title": None}, {"title": "T", "doi": "https://doi.org/10/2"}]}))] == ["T"]
    d = pl.dblp(json.dumps({"result": {"hits": {"hit": {"info": {"title": "T", "authors": {"author": {"text": "A"}}, "ee": ["x", "y.pdf"], "doi": "bad", "venue": ["V", "W"], "year": "2001"}}}}}))[0]
    assert (d["authors"], d["doi"], d["pdf_url"], d["venue"], d["year"]) == (["A"], None, "y.pdf", "V, W", 2001)
    e = pl.europepmc(json.dumps({"resultList": {"result": [{"title": "T", "pmcid": "PMC1", "citedByCount": 3, "fullTextUrlList": {"fullTextUrl": [{"documentStyle": "pdf", "url": "u"}]}}]}}))[0]
    assert (e["url"], e["pdf_url"], e["citation_count"]) == ("https://europepmc.org/article/PMC/PMC1", "u", 3)
    p = pl.pubmed("<S><PubmedArticle><PMID>5</PMID><ArticleTitle>T <i>x</i></ArticleTitle><AbstractText>a</AbstractText><AbstractText>b</AbstractText><Author><ForeName>F</ForeName><LastName>L</LastName></Author><ArticleId IdType='doi'>10/9</ArticleId></PubmedArticle></S>")[0]
    assert (p["title"], p["abstract"], p["authors"], p["doi"]) == ("T x", "a b", ["F L"], "10/9")
    assert pl.unpaywall(json.dumps({"best_oa_location": {}, "oa_locations": [{}, {"url_for_pdf": "q"}]}))[0]["pdf_url"] == "q"
    assert pl.biorxiv(json.dumps({"collection": [{"doi": "10.1101/1", "authors": "A; B", "date": "2022-01-01", "server": "medrxiv"}]}))[0]["pdf_url"] == "https://www.medrxiv.org/content/10.1101/1v1.full.pdf"


def test_parse_table(spark):
    rows = [("k", "semanticscholar", '{"data": [{"title": "T", "year": 2020, "authors": [{"name": "A"}]}]}'), ("k", "semanticscholar", "broken"), ("k", "nowhere", "{}"), (None, "crossref", None)]
    got = pl.parse(spark.createDataFrame(rows, "keyword string, source string, payload string")).collect()
    assert [(r.title, r.year, r.authors) for r in got] == [("T", 2020, ["A"])]


def test_providers(spark):
    rows = spark.createDataFrame([("a", "one text. " * 900), ("b", ""), ("c", None), ("d", "x" * 1_000_001)], "k string, text string")
    got = {r.k: (r.skipped, len(r.vec)) for r in providers.embed(rows, providers.hash_embedder(4), "k", dim=4).collect()}
    assert got == {"a": (False, 4), "d": (True, 4)}
    prompts = spark.createDataFrame([(1, "p", "s")], "id int, prompt string, source string")
    out = providers.refined(prompts, lambda t: [t[0] + "!"], lambda text, s: ("Mend" in text, ["again"]), "id").collect()[0]
    assert (out.attempts, out.accepted) == (2, True)
