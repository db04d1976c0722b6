import random

import numpy as np
import pytest

from paperloom.llm import clusters as C
from paperloom.llm import matching as M
from paperloom.llm import names as N
from paperloom.llm import tries as T


def groups(seed, sizes, dim=16, noise=0.1):
    rng = np.random.default_rng(seed)
    out = []
    for g, n in enumerate(sizes):
        centre = rng.normal(size=dim)
        out += [(f"g{g}", [float(x) for x in (centre + rng.normal(size=dim) * noise) * rng.uniform(0.1, 9)]) for _ in range(n)]
    return out


def brute(rows):
    v = np.array([r[2] for r in rows])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T >= 0.8
    label = {}
    for i in range(len(rows)):
        todo, seen = [i], {i}
        while todo:
            j = todo.pop()
            for k in np.flatnonzero(near[j]):
                if rows[k][0] == rows[i][0] and k not in seen:
                    seen.add(int(k))
                    todo.append(int(k))
        if len(seen) >= 3:
            label[rows[i][1]] = min(rows[k][1] for k in seen)
    return label


@pytest.mark.parametrize(("seed", "part"), [(1, 500_000), (2, 40)])
def test_clusters_against_brute_force(spark, seed, part):
    found = groups(seed, [60, 1, 2, 3, 4, 10, 1, 1, 25])
    random.Random(seed).shuffle(found)
    rows = [("c1" if i % 7 else "c2", f"k{i:03d}", v, False) for i, (_, v) in enumerate(found)]
    df = spark.createDataFrame(rows + rows[:5] + [("c1", "z1", None, True), ("c1", "z2", [0.0] * 16, True), ("c1", "z3", [float("nan")] * 16, False), ("c1", "z4", [1.0] * 3, False), ("c1", None, [1.0] * 16, False)], "collection string, citation_key string, vec array<float>, skipped boolean")
    got = {r.citation_key: r.cluster_key for r in C.members(df, part=part).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("cosine", [0.805, 0.83, 0.87])
def test_recall_of_random_pairs(spark, cosine):
    """Pairs of random directions at the cosine, without a third paper to link them."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 800, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine * cosine) * b / np.linalg.norm(b, axis=1, keepdims=True)
    rows = [("c", f"{side}{i:04d}", [float(x) for x in v]) for side, m in (("a", a), ("b", b)) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "collection string, citation_key string, vec array<float>")
    got = {(r.citation_key, r.cluster_key) for r in C.members(df, min_size=2).filter("citation_key <> cluster_key").collect()}
    assert got <= {(f"b{i:04d}", f"a{i:04d}") for i in range(800)} and len(got) >= 0.95 * 800


def test_doubtful_links_are_checked_on_full_vectors(spark):
    rows = [(f"c{k}", name, v) for k, c in enumerate((0.80001, 0.79999)) for name, v in (("a", [1.0, 0.0, 0.0, 0.0]), ("b", [c, (1 - c * c) ** 0.5, 0.0, 0.0]))]
    df = spark.createDataFrame(rows, "collection string, citation_key string, vec array<double>")
    assert sorted(r.collection for r in C.members(df, min_size=2, miss=1e-6).collect()) == ["c0", "c0"]


def test_clusters_described_and_empty(spark):
    rows = [("c", f"k{i}", v) for i, (_, v) in enumerate(groups(3, [8, 5]))]
    df = spark.createDataFrame(rows, "collection string, citation_key string, vec array<float>")
    got = sorted((r.size, len(r.typical)) for r in C.described(C.members(df)).collect())
    assert got == [(5, 5), (8, 5)]
    assert C.members(df.limit(0)).count() == 0


@pytest.mark.parametrize(("rows", "copies"), [(0, 8), (40_000, 8), (600_000, 8), (10**8, 24), (10**12, 80)])
def test_copies_of_a_vector_are_constant(rows, copies):
    named, of, grids = C.grid_shape(rows, 64)
    assert grids * C.math.comb(of, named) <= copies and C.meeting_chance(64, 0.8, named, of) > 0.55


def test_small_dimensions():
    assert C.grid_shape(10, 1) == (1, 1, 1) and C.grid_shape(10**9, 2)[1] == 2


@pytest.mark.parametrize(("distance", "limit"), [(1, T.TRIE), (1, 3), (2, T.TRIE)])
def test_trie_join_is_complete(spark, distance, limit):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 11))) for _ in range(200)})
    words += sorted({w[:i] + w[i + 1 :] for w in words[::3] if len(w) > 3 for i in (0, len(w) // 2, len(w) - 1)} - set(words))
    df = spark.createDataFrame([(w,) for w in words if w], "w string")
    got = {(r.a, r.b) for r in T.trie_join(df.selectExpr("w as a"), df.selectExpr("w as b"), distance, limit=limit).collect()}
    assert got == {(a, b) for a in words for b in words if a != b and 0 < osa(a, b) <= distance}


def osa(a, b):
    """Brute force: edits with swaps of neighbours."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_organisations(spark):
    one = ["CERN Lab", "CERN Laboratory", "The CERN Laboratory"]
    two = ["Kranz Institute for Adaptive Robotics", "Kranz Institute AR", "Kranz Inst. f. Adapt. Robot.", "KRANZ Institute of Adaptive obotics", "Kranz Institute of Robotics, Adaptive"]
    three = ["Hall Institute for Adaptive Robotics", "Hall Institute Adapt. Robotics"]
    # an own name in more names than the words of its field
    units = [f"Kranz Institute for {f}" for f in ("Optics", "Theoretical Biology", "Systems Research", "Brain and Behaviour", "Applied Inference")] + [f"Kranz Centre for {f}" for f in ("Optics", "Adaptive Robotics")]
    orgs = spark.createDataFrame([(n,) for n in [*one, *two, *three, *units, "Institute", "Society of the"]], "name string")
    links = N.organisation_links(orgs)
    label = {r.citation_key: r.label for r in C.propagate(links.selectExpr("'' as collection", "a", "b")).collect()}
    groups = {frozenset(k for k in label if label[k] == v) for v in label.values()}
    assert groups == {frozenset(one), frozenset(two), frozenset(three)}


@pytest.mark.parametrize(("name", "want"), [
    ("Dr. Grażyna  K. Müller†", (["grazyna", "k", "muller"], [], False)), ("VAN DER BERG, J.K.", (["berg"], ["j", "k"], True)), ("Smith TC", (["smith", "t", "c"], [], False)),
    ("Anna Lee, PhD", (["anna", "lee"], [], False)), ("Jo Mueller1,2", (["jo", "muller"], [], False)), ("", ([], [], False)),
])
def test_read_names(name, want):
    assert N.read(name) == want


def test_variants(spark):
    people = ["Robert Smithson", "Bob Smithson", "Smithson, R.", "R. Smithsson", "Smithson Robert", "Maria K. Gonzalez", "Maria T. Gonzalez", "Gonzalez, Maria K.", "Ana Ruiz", "Ana Ruíz*", "Applied Labs", "Kranz Institute for Systems Research", "The Kranz Institute of Systems Research", "Kranz Institute SR", "Wolff Institute for Systems Research"]
    families = ("Abendroth", "Birkenfeld", "Cartellieri", "Dombrowsky", "Eisenhauer", "Falkenstein")
    filler = [f"{g} {f}" for g in ("Robert", "Maria", "Ana", "Peter", "Helga", "Olga") for f in families]
    rows = [(people[i : i + 3] + [None, ""],) for i in range(0, len(people), 3)] + [(filler,), (None,), ([],), (people[:3],)]
    authors = spark.createDataFrame([(a, "x") for (a,) in rows], "authors array<string>, name string")
    aliases = spark.createDataFrame([("Bob", "Robert"), (None, "X"), ("Y", None)], "short_form string, full_form string")
    got = {(r.name_a, r.name_b) for r in N.variant_pairs(authors, aliases).collect()}
    assert all(a < b for a, b in got)
    sets = {frozenset(p) for p in got}
    # given names that every family has are no nicknames of each other
    assert not any(f"Olga {f}" in p or f"Peter {f}" in p for p in sets for f in families)
    smith = {"Robert Smithson", "Bob Smithson", "Smithson, R.", "R. Smithsson", "Smithson Robert"}
    assert all(frozenset((a, b)) in sets for a in smith for b in smith if a != b)
    assert frozenset(("Maria K. Gonzalez", "Gonzalez, Maria K.")) in sets and frozenset(("Maria K. Gonzalez", "Maria T. Gonzalez")) not in sets and frozenset(("Ana Ruiz", "Ana Ruíz*")) in sets
    kranz = {"Kranz Institute for Systems Research", "The Kranz Institute of Systems Research", "Kranz Institute SR"}
    assert all(frozenset((a, b)) in sets for a in kranz for b in kranz if a != b) and not any("Wolff Institute for Systems Research" in p for p in sets)
    assert N.variant_pairs(authors.limit(0), aliases.limit(0)).count() == 0


S = "citation_key string, title string, authors array<string>, year int, source string, h string"
H = "seq bigint, title string, authors array<string>, year int, source string, match_score double, s string"
T1, T2 = "On the bias of deep causal models under noisy conditions: A survey", "How does scaling shape sparse networks in large systems? Limits and remedies"


def test_matching(spark):
    summaries = [("a2020on", T1, ["Ann Kowalski", "Bo Lindqvist"], 2020, "arxiv", ""), ("b2019on", T1, ["Carl Petterson"], 2015, "arxiv", ""), ("c2021how", T2, ["Dora Weissmann"], None, "dblp", ""), ("a2020on", T1, ["Ann Kowalski", "Bo Lindqvist"], 2020, "arxiv", ""), ("d", None, None, None, None, None), ("e", "", [], 0, None, None)]
    hits = [
        (1, T1.upper(), ["A Kowalski", "et al."], 2021, "x", None, ""), (2, T1, [], 2020, "x", None, ""), (3, T1, ["Petterson, C."], None, "y", None, ""), (4, "Comment on: " + T1, ["Eve Stranger"], 2021, "x", None, ""), (5, T2.split("?")[0] + "?", ["Weissmann D"], 2021, "x", None, ""),
        (6, T2[:55] + "...", ["Dora Weismann"], 2021, "z", None, ""), (7, T2, ["Other Person"], 2021, "x", None, ""), (8, None, None, None, None, None, None), (1, T1.upper(), ["A Kowalski", "et al."], 2021, "x", None, ""), (9, T1, None, 1999, "x", None, ""),
    ]
    got = {(r.citation_key, r.seq): r.match_score for r in M.matches(spark.createDataFrame(summaries, S), spark.createDataFrame(hits, H)).collect()}
    assert set(got) == {("a2020on", 1), ("a2020on", 2), ("b2019on", 3), ("c2021how", 5), ("c2021how", 6)}
    assert all(0.5 < s <= 1 for s in got.values())
    assert M.matches(spark.createDataFrame([], S), spark.createDataFrame([], H)).count() == 0


def test_every_acceptable_pair_is_scored(spark):
    rng = random.Random(5)
    pool = "deep sparse neural models networks learning systems environments simulated clinical ensembles adaptive graph in of the with within data base database".split()

    def typo(w):
        i = rng.randrange(len(w))
        return rng.choice([w[:i] + w[i + 1 :], w[:i] + "x" + w[i:], w[:i] + "q" + w[i + 1 :], w[:i] + w[i + 1 : i + 2] + w[i : i + 1] + w[i + 2 :]])

    titles = [" ".join(rng.sample(pool, rng.randint(2, 8))) + rng.choice(["", ": a long view"]) for _ in range(60)]
    changed = [" ".join(typo(w) if rng.random() < 0.5 else w for w in t.split()) + rng.choice(["", "", "..."]) for t in titles] + [t.split(":")[0] for t in titles]
    people = [["Ann Kowalski"], ["Bo Lindqvist", "Ann Weiss"], [], ["Kowalsky, A."]]
    s = [(f"k{i}", t, rng.choice(people), rng.choice([None, 2020]), "x", "") for i, t in enumerate([*titles, "Deep ensembles in simulated environments"])]
    h = [(i, t, rng.choice(people), rng.choice([None, 2021]), "y", None, "") for i, t in enumerate([*changed, "of the", "Deep ensembles in simluated environments"])]
    left, right = (M.parsed(M.classes(spark.createDataFrame(rows, kind), key)[0]) for rows, kind, key in ((s, S, "citation_key"), (h, H, "seq")))
    found = {(r.s, r.h) for r in M.scored_pairs(left, right).filter("theta > 0").collect()}
    theta = lambda x, y: M.PRIOR + M.title_score((x.words, x.main, x.cut), (y.words, y.main, y.cut)) + M.author_score(x.people, y.people) + M.year_score(x.year, y.year)
    want = {(x["class"], y["class"]) for x in left.collect() for y in right.collect() if theta(x, y) > 0}
    assert found == want and len(want) > 50


def test_pairs_of_other_authors_are_left_out_before_scoring(spark):
    people = [["Ann Kowalski"], ["Kowalsky, A."], ["Bo Lindqvist", "Ann Weiss"], ["Li Wu"], ["Lo Wux", "Bo Lindqivst"], [], None, ["et al."], ["Eve Stranger; Bo Weis"]]
    s = [(f"k{i}", T1, p, y, "x", "") for i, (p, y) in enumerate((p, y) for p in people for y in (None, 2020))]
    h = [(i, t, p, y, "y", None, "") for i, (t, p, y) in enumerate((t, p, y) for t in (T1, "Joint bias of the deep") for p in people for y in (None, 2020))]
    left, right = (M.parsed(M.classes(spark.createDataFrame(rows, kind), key)[0]).localCheckpoint() for rows, kind, key in ((s, S, "citation_key"), (h, H, "seq")))
    got = {(r.s, r.h) for r in M.candidates(left, right).collect()}
    theta = lambda x, y: M.PRIOR + M.title_score((x.words, x.main, x.cut), (y.words, y.main, y.cut)) + M.author_score(x.people, y.people) + M.year_score(x.year, y.year)
    every = {(x["class"], y["class"]): (theta(x, y), M.author_score(x.people, y.people)) for x in left.collect() for y in right.collect()}
    # no pair above the bound is lost, and none is kept for its title alone
    assert {k for k, (score, _) in every.items() if score > -5} <= got
    assert all(every[k][1] > M.AUTHORS_OTHER for k in got) and len(got) < len(every)
    assert M.PRIOR + M.TITLE_SAME + max(M.YEAR.values()) + M.AUTHORS_OTHER <= -5


def test_all_keys_are_joined_where_too_many_are_asked_for(spark, monkeypatch):
    s = [(f"k{i}", t, ["Ann Kowalski"], 2020, "x", "") for i, t in enumerate((T1, T2, "Sparse data bases", "Data of sparse"))]
    h = [(i, t, ["Ann Kowalski"], 2020, "y", None, "") for i, t in enumerate((T1, T2, "Sparse databases", "Spares dta"))]
    left, right = (M.parsed(M.classes(spark.createDataFrame(rows, kind), key)[0]).localCheckpoint() for rows, kind, key in ((s, S, "citation_key"), (h, H, "seq")))
    found = {(r.s, r.h) for r in M.word_pairs(left, right).collect()}
    monkeypatch.setattr(M, "MOST_KEYS", 0)
    assert {(r.s, r.h) for r in M.word_pairs(left, right).collect()} == found and len(found) >= 4


def test_pairs_without_rivals_need_no_rounds(spark):
    pairs = spark.createDataFrame([(1, 10, "x", 2.0), (2, 11, None, -1.0)], "s bigint, h bigint, source string, theta double")
    # with rivals this would be an error
    got = {r.s: r.match_score for r in M.propagate_beliefs(pairs, rounds=1, tolerance=0.0).collect()}
    assert got == {1: pytest.approx(0.880797, abs=1e-6), 2: pytest.approx(0.268941, abs=1e-6)}


def test_beliefs_share_a_hit(spark):
    pairs = spark.createDataFrame([(1, 10, "x", 2.0), (2, 10, "x", 2.0), (3, 11, "x", 2.0), (4, 12, None, 9.0), (5, 12, None, -1.0)], "s bigint, h bigint, source string, theta double")
    got = {(r.s, r.h): r.match_score for r in M.propagate_beliefs(pairs).collect()}
    assert got[1, 10] == pytest.approx(got[2, 10]) and got[1, 10] < 0.5 < got[3, 11] and got[4, 12] > 0.99 and got[5, 12] < 0.01
    with pytest.raises(RuntimeError):
        M.propagate_beliefs(pairs, rounds=3, tolerance=1e-9)
    # on one hit the messages give the exact marginals of 'at most one'
    import math

    assert got[1, 10] == pytest.approx(math.exp(2) / (1 + 2 * math.exp(2)), abs=1e-3)


@pytest.mark.parametrize(("a", "b", "d"), [("same", "same", 0), ("layered", "layled", 3), ("tensor", "tensors", 1), ("teh", "the", 1), ("sparse", "dense", 9), ("", "x", 9), ("clinical", "clnica", 3)])
def test_near(a, b, d):
    assert M.near(a, b) == d


def test_nicknames_of_wide_families(spark):
    """Families with a good part of all given names tell nicknames too, where names meet there more often than by chance."""
    rng = random.Random(2)
    others = ["".join(rng.choice("bcdfghklmnprst") for _ in range(9)) for _ in range(400)]
    rows = [(f"fam{f}", g) for f in range(100) for g in rng.sample(others, 60)]
    rows += [(f"fam{f}", "zabo") for f in range(10)] + [(f"fam{f}", "zeppelin") for f in range(14)]
    people = spark.createDataFrame([(f"{g} {f}", f, g, None) for f, g in rows], "name string, family string, given string, middle string")
    votes = spark.createDataFrame([(g, 100, 0) for g in {g for _, g in rows}], "t string, g bigint, f bigint")
    aliases = spark.createDataFrame([], "short_form string, full_form string")
    got = {r.given: r.full for r in N.canonical_given(people, votes, aliases).collect()}
    assert got.pop("zabo") == "zeppelin" and all(g == full for g, full in got.items())
