import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import scans as S
from paperloom.llm import split as P
from paperloom.llm.tries import trie


def check(text, limit=P.LIMIT, overlap=P.OVERLAP):
    pieces = P.split(text, limit, overlap)
    assert "".join(text[new:end] for _, new, end in pieces) == text
    assert all(end - start <= limit for start, _, end in pieces)
    assert all(0 < new - start <= overlap for start, new, _ in pieces[1:])
    return pieces


@pytest.mark.parametrize("text", ["", "short", "a" * 6000, "a" * 6001, "a" * 30000, "ab " * 9000, "One sentence. " * 2000, "x\r\n" * 5000, "。" * 13000, "x" * 7000 + " " + "y" * 7000, "\n" * 20000, "\U0001f600" * 7000])
def test_invariants(text):
    assert len(check(text)) == (1 if len(text) <= 6000 else len(check(text)))


@pytest.mark.parametrize("seed", range(20))
def test_random(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "end. ", "line\n", "para\n\n", "x" * rng.randint(1, 90), "\r\n"]) for _ in range(rng.randint(1, 800)))
    check(text, rng.choice([200, 500]), rng.choice([20, 60]))


def test_prefers_paragraphs():
    text = ("A sentence here. " * 100 + "\n\n") * 10
    ends = {e for _, _, e in check(text)[:-1]}
    assert all(text[:e].endswith("\n\n") for e in ends)


def test_overlap_begins_at_a_natural_end():
    text = "This is a sentence of words. " * 600
    for start, _new, _ in check(text)[1:]:
        assert text[start - 1] == " " and text[start].isupper()


def test_split_tables(spark):
    rows = [("a", "k1", "One. " * 3000, "x"), ("a", "k1", "One. " * 3000, "x"), ("a", "k2", None, "x"), ("a", "k3", "", "x"), (None, "k4", "a" * 6001, None)]
    df = spark.createDataFrame(rows, "item_table string, citation_key string, text string, piece string")
    got = P.pieces(df, "text", ["item_table", "citation_key"])
    n = {(r.item_table, r.citation_key): r["count"] for r in got.groupBy("item_table", "citation_key").count().collect()}
    assert n == {("a", "k1"): 3, ("a", "k3"): 1, (None, "k4"): 2}
    assert sorted(r.citation_key for r in P.oversized(df, "text", ["item_table", "citation_key"]).collect()) == ["k1", "k4"]
    assert P.pieces(df.limit(0), "text", ["item_table", "citation_key"]).count() == 0


def edits(form, word):
    """Brute force for one misreading."""
    for i in range(len(form) + 1):
        for a in (0, 1, 2):
            for b in (0, 1, 2):
                if a <= len(form) - i and (a, b) not in ((2, 2), (0, 0), (0, 2), (2, 0)) and len(form) - a + b == len(word) and form[:i] == word[:i] and form[i + a :] == word[i + b :]:
                    return True
    return False


@pytest.mark.parametrize("seed", range(4))
def test_automaton_is_complete(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    root = trie(words)
    for _ in range(60):
        form = "".join(rng.choice("abc") for _ in range(rng.randint(1, 7)))
        assert {w for w, _ in S.misread(root, form)} == {w for w in words if w != form and edits(form, w)}


CLEAN = "The model measures simulation of learning in modern environments. " * 3


def page(n):
    return f"1. Introduction\n\nThe model measures sirnulation of learn-\ning in modern environ­\n[{n}]\nments. The 5imulation of lear ning and post-\nand pre-test is done.\nDownloaded from a.example on 3 May 2020\nin modern environments."


def test_scanned_pages(spark):
    rows = [("corpus", f"c{i}", CLEAN, "x") for i in range(6)] + [("corpus", f"s{i}", page(i), "x") for i in range(4)] + [("corpus", "s0", page(0), "x"), ("corpus", "n", None, "x"), ("corpus", "e", "", "x"), ("corpus", "b", "\n \n", "x")]
    df = spark.createDataFrame(rows, "item_table string, citation_key string, text string, kind string")
    venues = spark.createDataFrame([("Annals of X",), (None,)], "venue string")
    got = {(r.line_no, r.kind) for r in S.found_lines(df, venues).filter("citation_key = 's1'").collect()}
    assert {(3, "hyphen"), (4, "hyphen"), (5, "furniture"), (8, "furniture")} <= got and (6, "hyphen") not in got and not any(n in (1, 9) for n, _ in got)
    assert {r.citation_key for r in S.found_lines(df, venues).collect()} == {"s0", "s1", "s2", "s3"}
    assert S.found_lines(df.limit(0), venues.limit(0)).count() == 0
    text = {r.citation_key: r.text for r in S.repaired(df, venues).collect()}
    assert "learning in modern environments" in text["s1"] and "[1]" not in text["s1"] and "Downloaded" not in text["s1"] and text["c1"] == CLEAN and text["e"] == ""


def test_misread_forms_are_corrected(spark):
    forms = spark.createDataFrame([("sirnulation", 2), ("rnodel", 1), ("tirne", 1), ("unknowable", 1)], "form string, n_form bigint")
    vocabulary = spark.createDataFrame([("simulation", 100), ("model", 80), ("time", 50)], "word string, n_word bigint")
    got = {r.form: r.word for r in S.corrections(S.ranked(S.candidates(forms, vocabulary), 0.01)).collect()}
    assert got == {"sirnulation": "simulation", "rnodel": "model", "tirne": "time"}


def test_page_numbers_and_tables():
    none = frozenset()
    table = "Table 1\nTrials\n120\n240\nError\n0.82\n0.02".split("\n")
    assert S.furniture(table, none) == set()
    assert S.furniture(["some running text of a page that", "7", "goes on here"], none) == {1}
    assert S.furniture(["text", "", "\f103", "more"], none) == {2}
    assert S.furniture(["F = E", "(12)", "", "235 281"], none) == set()
    assert S.furniture(["Annals of X", "ANNALS OF X   12", "Anna1s 0f X", "word"], frozenset([S.fold("Annals of X")])) == {0, 1, 2}
    assert F is not None


def test_context_decides_between_candidates(spark):
    """'tbe' fits 'the' and 'toe'; the words before it decide."""
    scored = spark.createDataFrame([("bave", "have", 5.0), ("bave", "cave", 4.5), ("lone", "tone", 3.0)], "form string, word string, score double")
    words = spark.createDataFrame([("bave", "we"), ("bave", "dark"), ("bave", None), ("bave", "new"), ("lone", "we")], "form string, before string")
    texts = spark.createDataFrame([("t", f"k{i}", "we have a dark cave and we have a lamp", None) for i in range(4)], "item_table string, citation_key string, text string, heads array<string>")
    got = {(r.form, r.before): r.word for r in S.in_context(words, scored, texts, frozenset()).collect()}
    assert got == {("bave", "we"): "have", ("bave", "dark"): "cave", ("bave", "new"): "have"}


def test_many_venues_are_joined(spark, monkeypatch):
    rows = [("corpus", "s1", "some running text that goes on and\nAnnals of Very Old Things 12\non to the next page of the text", None), ("corpus", None, "some running text\nAnnals of Very Old Things\ngoes on", None), ("corpus", "c1", "no header in this\ntext", None)]
    df = spark.createDataFrame(rows, "item_table string, citation_key string, text string, heads string").drop("heads")
    venues = spark.createDataFrame([("Annals of Very Old Things",), ("Other",), (None,), ("",)], "venue string")
    few = sorted(map(tuple, S.found_lines(df, venues).collect()), key=str)
    monkeypatch.setattr(S, "MAX_HEADERS", 1)
    assert S.header_names(venues) is None
    assert sorted(map(tuple, S.found_lines(df, venues).collect()), key=str) == few and ("corpus", "s1", 2, "furniture") in few and ("corpus", None, 2, "furniture") in few


def test_short_scans_and_long_lines():
    assert S._look("a word that is bro-\nken", frozenset())[3] and S._look("[12]", frozenset())[1] == {0}
    wide = "x" * 300
    assert S.furniture([wide, wide, "Kim et al. / " + "Journal " * 20 + "(2020)", wide], frozenset()) == {2}


def test_candidates_against_brute_force(spark):
    rng = random.Random(6)
    words = sorted({"".join(rng.choice("abcm") for _ in range(rng.randint(2, 8))) for _ in range(150)})
    forms = sorted({"".join(rng.choice("abcm0") for _ in range(rng.randint(2, 8))) for _ in range(120)})
    got = {(r.form, r.word) for r in S.candidates(spark.createDataFrame([(f, 1) for f in forms], "form string, n_form bigint"), spark.createDataFrame([(w, 9) for w in words], "word string, n_word bigint")).filter("edit <> 'sign'").collect()}
    plain = {f: f.translate(str.maketrans(S.SIGNS, S.LETTERS)) for f in forms}
    # the letters meant are misread once more only where they make no word
    seen = lambda f: {f, plain[f]} if re.search("[^0-9]{2}", f) and (plain[f] == f or plain[f] not in words) else {f}
    assert got == {(f, w) for f in forms for w in words if any(v != w and edits(v, w) for v in seen(f))}


def test_misreadings_in_clean_texts_stay_misreadings(spark):
    """In a large collection some scanned texts pass for clean, and any misreading is found there more than once."""
    good = "the other ones have what the other ones have " * 10
    scanned = [("corpus", f"s{i}", f"Page {i} of 90\nwe saw tbe lamp\nand otber lamps\nthat bave oil\n{good}") for i in range(12)]
    clean = [("corpus", f"c{i}", good * 8 + ("tbe otber bave" if i < 3 else "")) for i in range(12)]
    df = spark.createDataFrame(scanned + clean, "item_table string, citation_key string, text string")
    got = {(r.citation_key, r.line_no) for r in S.found_lines(df, spark.createDataFrame([("Other",)], "venue string")).filter("kind = 'ocr'").collect()}
    assert got == {(f"s{i}", n) for i in range(12) for n in (2, 3, 4)}
