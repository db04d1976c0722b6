"""Rules for single texts at their borders."""

import pytest

from paperloom.functions import pages, quality, structure
from paperloom.functions import repetition as rep

LONG = "The first finding of the study is stated here in full. "


@pytest.mark.parametrize(("text", "n"), [
    ('"' + "a" * 20 + '"', 1), ('"' + "a" * 19 + '"', 0), ('"' + "a" * 201 + '"', 0), ("[" + "b" * 25 + "]", 1), ("'" + "c" * 25 + "'", 1), ('"short" (Kim 2020)', 1), ('As stated in the text: "x"', 1),
    ('According to Kim: "' + "d" * 30 + '"', 2), ('"' + "e" * 30 + '" (p. 3)', 2), ("", 0),
])
def test_quotes(text, n):
    assert quality.quote_count(text) == n


@pytest.mark.parametrize(("summary", "title", "ok"), [
    ("# Deep Models\n\ntext", "Deep Models", True), ("# Other Things\n\ntext", "Deep Models of Learning", False), ("# Models that learn\n", "Deep models from within", False),
    ("# Being from within models\n", "Deep models from within", True), ("text about deep models of learning", "Deep Models of Learning", True), ("no such thing", "Deep Models", False), ("deep models", "Deep Models", True),
])
def test_title(summary, title, ok):
    assert quality.title_matches(summary, title) is ok


def test_equal_beginnings_need_four_words():
    pad = " word" * 50 + ". 5% and 6% and 7%. "
    assert "equal beginnings" not in quality.low_density("We show it. " * 3 + pad) and "equal beginnings" in quality.low_density("We show it now. " * 3 + pad)


@pytest.mark.parametrize(("text", "off"), [
    ("Dear editor", True), ("Hello! I read it", True), ("The text\nRe: it", True), ("x" * 120 + "\nRe: it", False), ("see https://x.example", True), ("see https://x.example in the paper of the authors", False), ("This manual is fine", True), ("A plain text", False), ("import pandas as pd\nimport y", True),
])
def test_off_topic(text, off):
    assert quality.is_off_topic(text) is off


def test_conversation_and_citations():
    assert quality.conversational("I'd be happy to. NEED HELP? Let me know if so") == ["let me know if", "i'd be happy to", "need help?"]
    assert quality.citations("(Kim 2020) and (Kim & Lee 2021), [3], [4, 5], @key2020") == ["Kim 2020", "Kim & Lee 2021", "3", "key2020"]
    assert not quality.formatting_ok("a  b") and not quality.formatting_ok("so!!!") and quality.formatting_ok("a b\n c")


def test_repetition_by_the_best_headers():
    part = LONG * 3
    assert rep.detect("short " * 20) == (False, 0, 1.0)
    assert rep.detect("one paragraph only " * 20)[:2] == (False, 0)
    # one third-level header, three second-level ones: the latter cut more parts
    text = "\n### note\n" + "x" * 20 + f"\n## A\n{part}\n## B\nquite another text with words of its own that differ from all the rest of it and go on for long enough here\n## A\n{part}"
    assert rep.detect(text)[:2] == (True, 1)
    # whole parts are compared: equal beginnings of 400 characters count, other ends do not matter
    assert rep.detect(f"\n## A\n{LONG * 12}end one\n## A\n{LONG * 12}end two")[1] == 1
    assert rep.detect("\n## A\n" + "alpha beta gamma delta " * 8 + "\n## B\n" + "one two three four five " * 8)[1] == 0


@pytest.mark.parametrize(("text", "want"), [
    ("Same sentence stands here now. " * 3, "sentence"), ("A b c d e f g h i j. A b c d e f g h i k. A b c d e f g h i l. Quite other words are here.", None),
    ("The model learns to see the small red cube on a table top. The model learns to see the small red cube on the table top. The model learns to see a small red cube on the table top. Fine and unlike all.", "similar sentences"),
])
def test_severe(text, want):
    assert rep.severe(text) == want


@pytest.mark.parametrize("seed", range(6))
def test_chunks_cover_the_text(seed):
    import random

    rng = random.Random(seed)
    body = lambda n: "".join(rng.choice(["word ", "end. ", "line\n", "x" * rng.randint(1, 30)]) for _ in range(n))
    text = body(900) + "\nAbstract\n" + body(300) + "\nMethods\n" + body(4000) + "\nConclusion\n" + body(900) + "\nAppendix of things\n" + body(3000)
    covered = set()
    for _, a, b in structure.chunks(text, 15000, 500):
        assert 0 <= a < b <= len(text) and b - a <= 16000
        covered.update(range(a, b))
    assert not [i for i in range(len(text)) if i not in covered and text[i].strip()]


def test_break_positions():
    text = "a" * 90 + "." + "b" * 200
    assert structure.break_positions(text, 100, 10) == [91, 181, 271, 291] or structure.break_positions(text, 100, 10)[0] == 91
    ends = structure.break_positions("x" * 50_000, 15_000, 500)
    assert ends[0] == 14_801 and ends[-1] == 50_000 and all(b > a for a, b in zip(ends, ends[1:], strict=False))
    assert structure.break_positions("", 10, 1) == []


@pytest.mark.parametrize(("text", "ok"), [
    ("An evaluation " + " ".join(f"word{i} longer{i}" for i in range(150)), True), ("An evaluation " + "menu home " * 300, False), ("nothing of it " * 200, False), ("abstract", False), ("", False),
    ("The preapproaching " + " ".join(f"word{i} longer{i}" for i in range(150)), True),
])
def test_papers(text, ok):
    assert pages.is_paper(text, 1000) is ok
