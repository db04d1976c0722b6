import pytest

from paperloom.llm import mixture as M
from paperloom.llm import spam as S

DOC = "doc_id bigint, source string, text string, rate string, weight string"
TARGET = "source string, weight double, max_repeats int, note string"


def mixed(spark, docs, targets, **kw):
    counted = M.sizes(spark.createDataFrame(docs, DOC))
    rated = M.rates(counted, spark.createDataFrame(targets, TARGET), **kw)
    return M.mixture(counted, rated).collect(), {r.source: r for r in M.shares(counted, rated).collect()}


def test_shares_caps_and_holes(spark):
    docs = [(i, "Big ", "word " * 20, "", "") for i in range(400)] + [(1000 + i, "small", "word " * 20, None, None) for i in range(40)] + [(2000, None, "x", None, None), (2001, "big", None, None, None), (2002, "big", "", None, None), (2003, "other", "x y", None, None)]
    rows, shares = mixed(spark, docs, [("big", 0.6, 1, None), ("SMALL", 0.3, 3, None), ("absent", 0.1, 5, None), (None, 0.2, 1, None)])
    assert shares["absent"].reached_share == 0 and shares["small"].rate == 3.0 and max(r.copy_no for r in rows) == 3
    assert shares["big"].reached_share == pytest.approx(2 / 3, abs=0.06) and shares["small"].n_emitted == 120
    assert not {2000, 2001, 2002, 2003} & {r.doc_id for r in rows}
    again, _ = mixed(spark, docs, [("big", 0.6, 1, None), ("small", 0.3, 3, None), ("absent", 0.1, 5, None)])
    assert sorted((r.doc_id, r.copy_no) for r in rows) == sorted((r.doc_id, r.copy_no) for r in again)


def test_total_binds_caps(spark):
    docs = [(i, "a", "word " * 10, None, None) for i in range(10)]
    rows, shares = mixed(spark, docs, [("a", 1.0, 2, None), ("a", 0.5, 9, None)], total_tokens=10_000_000)
    assert len(rows) in (20, 90) and shares["a"].rate in (2.0, 9.0) and shares["a"].reached_share == 1.0


def test_what_a_capped_source_leaves_goes_to_the_others(spark):
    docs = [(i, "big", "word " * 10, None, None) for i in range(2000)] + [(9000 + i, "mid", "word " * 10, None, None) for i in range(300)] + [(8000 + i, "small", "word " * 10, None, None) for i in range(20)]
    targets = [("big", 0.5, 4, None), ("mid", 0.3, 4, None), ("small", 0.2, 2, None), ("absent", 0.5, 9, None)]
    _, shares = mixed(spark, docs, targets, total_tokens=M.ALL)
    have = {k: shares[k].available for k in ("big", "mid", "small")}
    total = sum(have.values())
    # small and mid are capped, big fills up
    assert shares["small"].rate == 2.0 and shares["mid"].rate == pytest.approx(min(4.0, 0.3 * (total - 2 * have["small"]) / 0.8 / have["mid"]))
    given = sum(shares[k].rate * have[k] for k in have)
    assert given == pytest.approx(total, rel=1e-6) and shares["absent"].rate == 0
    assert sum(s.reached_share for s in shares.values()) == pytest.approx(1)


def test_empty(spark):
    rows, shares = mixed(spark, [], [("a", 1.0, 2, None)])
    assert rows == [] and shares["a"].reached_share == 0
    rows, shares = mixed(spark, [(1, "a", "x", None, None)], [])
    assert rows == [] and shares == {}
    rows, shares = mixed(spark, [], [("a", 1.0, 2, None)], total_tokens=M.ALL)
    assert rows == [] and shares["a"].reached_share == 0


PROSE = "The model was tested with people who were in the room, and it is not clear whether they had seen the other one before. "


LISTS = {
    "keywords": "deep learning, free energy, " * 30, "links": "\n".join(f"* https://x.example/a-{i}" for i in range(30)), "tags": "#Tag " * 50, "short": "deep learning free energy message passing world models gait analysis sleep staging " * 2,
    "phrases": "the free energy of the brain pdf, " * 60, "anchors": '<a href="x.example/z">energy</a> ' * 60,
}


@pytest.mark.parametrize("kind", LISTS)
def test_lists_are_told_from_prose(spark, kind):
    docs = [(i, PROSE[:60 + i] + PROSE * (1 + i % 5)) for i in range(60)] + [(100, LISTS[kind]), (101, PROSE * 8 + "\nKeywords: a b, c d, e f"), (102, PROSE + "word " * 3), (103, "9" * 500), (104, "one word")]
    got = S.spam_pages(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id for r in got.collect()} == {100}


def test_very_long_page(spark):
    docs = [(i, PROSE * (1 + i % 5)) for i in range(20)] + [(100, "word " * 200_000), (101, PROSE * 2000)]
    assert [r.doc_id for r in S.spam_pages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()] == [100]


def test_divergence_is_the_likelihood_ratio(spark):
    """Scarcity and concentration of a page against sums over its words."""
    import math
    from collections import Counter

    docs = [(i, PROSE * (1 + i % 3)) for i in range(9)] + [(50, "the brain the world of it brain net " * 4)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {r.doc_id: r for r in S.scored(S.curves(df)).collect()}
    listed = set(S.FUNCTION_WORDS["en"])
    counts = {i: Counter(t.lower().replace(",", " ").replace(".", " ").split()) for i, t in docs}
    q = {w: sum(c[w] / sum(c.values()) for c in counts.values()) / len(counts) for w in listed}
    for i, c in counts.items():
        n = sum(c.values())
        f = sum(c[w] for w in listed)
        rest = 1 - f / n
        d = sum(c[w] / n * math.log(c[w] / n / q[w]) for w in listed if c[w]) + rest * math.log(rest / (1 - sum(q.values())))
        assert got[i].concentration == pytest.approx(math.sqrt(2 * n * max(d, 0)), abs=1e-6)
        b = rest * math.log(rest / (1 - sum(q.values()))) + f / n * math.log(f / n / sum(q.values())) if rest > 1 - sum(q.values()) else 0
        assert got[i].scarcity == pytest.approx(math.sqrt(2 * n * max(b, 0)), abs=1e-6)


def test_pages(spark):
    docs = [(i, PROSE * (1 + i % 5), "en") for i in range(60)] + [(100, "deep learning, free energy, " * 30, "en"), (101, "deep learning, free energy, " * 30, None), (102, None, "en"), (103, "", "en"), (104, " \n ", "en"), (100, "deep learning, free energy, " * 30, "en")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").withColumnRenamed("lang", "slope")
    assert sorted(r.doc_id for r in S.spam_pages(df).collect()) == [100, 101]
    assert S.spam_pages(df.limit(0)).count() == 0


def test_curve_is_least_squares(spark):
    import math
    from collections import Counter

    import numpy as np

    text = "a a a a b b c c d e f"
    got = S.curves(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()[0]
    spectrum = Counter(Counter(text.split()).values())
    x, y, rank = [], [], 0
    for n in sorted(spectrum, reverse=True):
        rank += spectrum[n]
        x.append(math.log(rank - (spectrum[n] - 1) / 2))
        y.append(math.log(n))
    slope, base = np.polyfit(x, y, 1)
    assert got.slope == pytest.approx(slope) and got.residual == pytest.approx(math.sqrt(sum((b - slope * a - base) ** 2 for a, b in zip(x, y, strict=True))), abs=1e-6)
    assert (got.n_tokens, got.n_types) == (11, 6)
