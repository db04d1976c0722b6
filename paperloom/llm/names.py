"""Variant spellings of names typed by people, linked by a trie join.

Names are taken apart into folded tokens. Which token is the family name follows from the order, or
from what the tokens are elsewhere where the order is turned round. Different family names, given names and
words of organisations are sharded into tries, along which an automaton is run for one edit (a
character changed, added, left out or swapped with the next; the distance is a parameter), so that all
neighbours within the distance are found. Names are then compared over all orders of their tokens:
given names equal, nicknames of each other or the initial of the other, middle initials not at odds.

Nicknames come from the table of short forms, from each other's full form, and from the names
themselves: a pair of given names that many families have together, most of those of the rarer one.

Organisations are compared by their kind and their other words, of which typing errors are put right
through the trie join, in any order; words of a field may be spelt out, cut short or given as initials.

Defined results: null, empty and blank names are linked to nothing; repeated rows and names count
once; an initial that fits several people of a family is linked to none of them; extra columns are
ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.clusters import propagate
from paperloom.llm.tries import trie_join
from paperloom.runtime import checkpoint

#: Parts of names that are no tokens of their own, titles, and words for organisations.
PARTICLES = frozenset("van von der de del den el al la di da dos du le ten ter zu bin ibn".split())
TITLES = r"(?:dr|prof|professor|mr|mrs|ms|sir)"
DEGREES = r"(?:ph\.?\s?d|m\.?\s?d|d\.?phil|msc|jr|sr|esq)"
ORG_KINDS = frozenset("centre center institute institut laboratory lab consortium group university department school college foundation society academy collaboration network project team".split())
ORG_SMALL = frozenset("the of for and de du der fur et a an at in on f working".split())
ORG_SHORT = {"ctr": "centre", "center": "centre", "wg": "group", "grp": "group", "lab": "laboratory", "inst": "institute", "institut": "institute", "cons": "consortium", "univ": "university", "dept": "department"}
_LETTERS = str.maketrans({"ø": "o", "đ": "d", "ł": "l", "ß": "ss", "æ": "ae", "œ": "oe", "ı": "i", "ð": "d", "þ": "th"})


@lru_cache(1 << 15)
def fold(token: str) -> str:
    """A token without case, accents and the second letter of a written-out umlaut."""
    flat = unicodedata.normalize("NFKD", token.casefold().translate(_LETTERS))
    flat = "".join(c for c in flat if not unicodedata.combining(c))
    return re.sub(r"([aou])e(?=[^aeiou]|$)", r"\1", flat)


def organisation(name: str) -> bool:
    words = [w.strip(".,").lower() for w in name.split()]
    return any(w in ORG_KINDS or w in ORG_SHORT for w in words) or any(len(w) >= 3 and w + "." in name.lower() and any(k.startswith(w) for k in ORG_KINDS) for w in words)


def read(name: str) -> tuple[list[str], list[str], bool]:
    """(tokens before a comma, tokens behind it, whether there is one); initials are single letters."""
    n = re.sub(r"\s*[\d*†‡§¶#^]+(?:\s*,\s*[\d*†‡§¶#^]+)*\s*$", "", name.strip())
    n = re.sub(rf",?\s*\b{DEGREES}\.?\s*$", "", n, flags=re.I)
    n = re.sub(rf"^{TITLES}\.?\s+", "", n, flags=re.I)
    before, comma, behind = n.partition(",")
    sides = []
    for side in (before, behind):
        out = []
        for t in re.split(r"[\s.,;]+", side):
            t = re.sub(r"^(?:de|van|von|el|al|der)-(?=\w)", "", t.strip("-'’\"()"), flags=re.I)
            if not t or fold(t) in PARTICLES:
                continue
            if 1 < len(t) <= 3 and t.isupper() and len(n) > len(t) + 3 and not n.isupper():
                out.extend(fold(c) for c in t)
            else:
                out.append(fold(t))
        sides.append([t for t in out if t])
    return sides[0], sides[1], bool(comma)


def parsed(authors: DataFrame) -> DataFrame:
    """(name, org, comma, front, behind) of the different names."""
    names = authors.select(F.explode("authors").alias("name")).filter(F.trim("name") != "").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_names = b.column(0).to_pylist()
            got = [read(n) for n in all_names]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([organisation(n) for n in all_names], pa.bool_()), pa.array([g[2] for g in got], pa.bool_()), pa.array([g[0] for g in got], words), pa.array([g[1] for g in got], words)],
                names=["name", "org", "comma", "front", "behind"],
            )

    return names.mapInArrow(run, "name string, org boolean, comma boolean, front array<string>, behind array<string>")


def _full(c):
    return F.filter(c, lambda t: F.length(t) > 1)


def readings(people: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((name, family, given, middle), votes): each name's family name, first given name or initial, and middle initial."""
    full = _full("front")
    a = people.withColumns({"full": full, "n": F.size(full)})
    votes = (
        a.select(F.explode(F.when(F.col("comma"), F.concat(F.transform("full", lambda t: F.struct(t.alias("t"), F.lit(0).alias("g"), F.lit(1).alias("f"))), F.transform(_full("behind"), lambda t: F.struct(t.alias("t"), F.lit(1).alias("g"), F.lit(0).alias("f")))))
            .when(F.col("n") >= 2, F.array(F.struct(F.element_at("full", 1).alias("t"), F.lit(1).alias("g"), F.lit(0).alias("f")), F.struct(F.element_at("full", -1).alias("t"), F.lit(0).alias("g"), F.lit(1).alias("f"))))
            .otherwise(F.transform("full", lambda t: F.struct(t.alias("t"), F.lit(0).alias("g"), F.lit(1).alias("f"))))).alias("v"))
        .groupBy("v.t").agg(F.sum("v.g").alias("g"), F.sum("v.f").alias("f"))
    )
    votes = checkpoint(votes)
    side = votes.select("t", F.ln((F.col("g") + 0.5) / (F.col("f") + 0.5)).alias("r"))
    first, last = F.element_at("full", 1), F.element_at("full", -1)
    # two family names without their hyphen, before or behind the given names
    ends = a.withColumns({
        "t1": F.when(F.col("n") > 0, first), "tk": F.when(F.col("n") > 0, last),
        "pair": F.when(F.col("n") >= 2, F.concat_ws("-", F.slice("full", 1, 2))), "tail": F.when(~F.col("comma") & (F.col("n") >= 3), F.concat_ws("-", F.slice("full", -2, 2))),
    })
    known = votes.filter(F.col("t").contains("-") & (F.col("f") > 0)).select("t")
    joined = (
        ends.join(side.select(F.col("t").alias("t1"), F.col("r").alias("r1")), "t1", "left").join(side.select(F.col("t").alias("tk"), F.col("r").alias("rk")), "tk", "left")
        .join(known.select(F.col("t").alias("pair"), F.lit(True).alias("has_pair")), "pair", "left").join(known.select(F.col("t").alias("tail"), F.lit(True).alias("has_tail")), "tail", "left")
    )
    natural = F.coalesce("r1", F.lit(0.0)) >= F.coalesce("rk", F.lit(0.0))
    family = (
        F.when(F.col("n") == 0, None).when(F.col("n") == 1, F.col("t1")).when(F.col("has_pair"), F.col("pair")).when(F.col("comma"), F.col("tk")).when(F.col("has_tail"), F.col("tail"))
        .when(natural, F.col("tk")).otherwise(F.col("t1"))
    )
    others = F.when(F.col("comma"), F.col("behind")).otherwise(F.filter("front", lambda t: ~F.array_contains(F.split(F.col("family"), "-"), t) & (t != F.col("family"))))
    out = joined.withColumn("family", family).withColumn("others", others).filter(F.col("family").isNotNull())
    return out.select("name", "family", F.when(F.size("others") > 0, F.element_at("others", 1)).alias("given"), F.when(F.size("others") > 1, F.substring(F.element_at("others", 2), 1, 1)).alias("middle")), votes


def canonical_given(names: DataFrame, votes: DataFrame, aliases: DataFrame, distance: int = 1) -> DataFrame:
    """(given, full): the full form of each given name that is mistyped or short."""
    common = votes.filter((F.col("g") >= 5) & (F.col("g") > F.col("f"))).select("t", "g")
    odd = names.select("given").filter(F.length("given") > 2).distinct().join(common.select(F.col("t").alias("given")), "given", "left_anti")
    near = trie_join(odd.select(F.col("given").alias("a")), common.filter(F.length("t") > 2).select(F.col("t").alias("b")), distance).select("a", "b")
    typed = checkpoint(near.join(common, near["b"] == common["t"]).groupBy(F.col("a").alias("given")).agg(F.max_by("b", F.struct("g", "b")).alias("right")))
    flat = F.udf(fold, "string")
    # the table of short forms has a fixed number of rows
    table = aliases.filter(F.col("short_form").isNotNull() & F.col("full_form").isNotNull()).select(flat("short_form").alias("short"), flat("full_form").alias("long")).distinct().groupBy("short").agg(F.min("long").alias("long"))
    # nicknames that the table lacks: most families of the rarer name have the other one as well
    per = names.filter(F.length("given") > 2).select("family", "given").distinct()
    per = checkpoint(per.join(typed, "given", "left").select("family", F.coalesce("right", "given").alias("given")).distinct())
    count = per.groupBy("given").agg(F.count(F.lit(1)).alias("n"))
    # a pair that is kept shares at least half of the rarer name's families, and two, or five where the names begin
    # differently: so all but that many of its families cannot be missed. The narrowest are asked, and of the pairs
    # that meet there the families are counted
    width = per.groupBy("family").agg(F.count(F.lit(1)).alias("width"))
    at = F.row_number().over(Window.partitionBy("given").orderBy("width", "family"))
    sized = checkpoint(per.join(width, "family").withColumn("at", at).join(count, "given"))
    start = F.substring("given", 1, 2)
    asked = lambda need: sized.filter(F.col("at") <= F.col("n") - F.greatest(F.ceil(0.5 * F.col("n")), F.lit(need)) + 1).select("family", "given", "n", start.alias("start"))
    others = sized.select("family", F.col("given").alias("other"), F.col("n").alias("m"), F.substring("given", 1, 2).alias("start"))
    # the chance that one name of each of two is in the same family, which grows with wide families
    total = checkpoint(width.agg((F.sum(F.col("width").cast("double") * F.col("width")) / F.pow(F.sum("width"), 2)).alias("same")))
    common = F.col("n") < F.col("m")
    meet = asked(2).join(others, ["family", "start"]).filter(common & (F.col("given") != F.col("other"))).select("given", "other")
    meet = meet.unionByName(asked(5).join(others.drop("start"), "family").join(F.broadcast(total), F.lit(True)).filter(common & (3 * F.col("m") * F.col("same") <= 1 + 1e-9)).select("given", "other"))
    meet = checkpoint(meet.distinct())
    pairs = meet.join(per, "given").join(per.select("family", F.col("given").alias("other")), ["family", "other"]).groupBy("given", "other").agg(F.count(F.lit(1)).alias("both"))
    # far more often than two names meet in one family by chance, which where families are large is often
    chance = F.col("n") * F.col("m") * F.col("same")
    # among many names some meet by accident more often than that, the less so where they begin alike
    beyond = F.greatest(3 * chance, F.when(F.substring("given", 1, 2) == F.substring("other", 1, 2), 0).otherwise(chance + 5 * F.sqrt(chance)))
    alike = F.substring("given", 1, 2) == F.substring("other", 1, 2)
    learned = (
        pairs.join(count, "given").join(count.select(F.col("given").alias("other"), F.col("n").alias("m")), "other").join(F.broadcast(total), F.lit(True))
        .filter((F.col("n") < F.col("m")) & (F.col("both") >= 0.5 * F.col("n")) & (F.col("both") >= F.when(alike, 2).otherwise(5)) & (F.col("both") >= beyond)).groupBy(F.col("given").alias("short")).agg(F.max_by("other", F.struct("both", "other")).alias("long"))
    )
    short = table.unionByName(learned.join(table, "short", "left_anti"))
    given = names.select("given").filter(F.col("given").isNotNull()).distinct()
    base = given.join(typed, "given", "left").join(table.select(F.col("short").alias("given"), F.col("long").alias("direct")), "given", "left").withColumn("right", F.when(F.col("direct").isNotNull(), F.col("given")).otherwise(F.coalesce("right", "given")))
    once = base.join(short.select(F.col("short").alias("right"), F.col("long").alias("l1")), "right", "left").select("given", F.coalesce("l1", "right").alias("full"))
    return once.join(short.select(F.col("short").alias("full"), F.col("long").alias("l2")), "full", "left").select("given", F.coalesce("l2", "full").alias("full"))


def person_links(names: DataFrame, votes: DataFrame, aliases: DataFrame, distance: int = 1) -> DataFrame:
    """(a, b): names of one person, each linked to others of it, not yet all pairs."""
    full = checkpoint(canonical_given(names, votes, aliases, distance))
    people = checkpoint(names.join(full, "given", "left").select("name", "family", F.coalesce("full", "given").alias("given"), "middle"))
    node = ["family", "given", "middle"]
    nodes = people.groupBy(*node).agg(F.min("name").alias("first"), F.count(F.lit(1)).alias("n"))
    nodes = checkpoint(nodes.withColumn("initial", F.length("given") == 1))
    families = nodes.groupBy("family").agg(F.sum("n").alias("n_names"))
    long = families.filter(F.length("family") > 2)
    near = trie_join(long.select(F.col("family").alias("a")), long.select(F.col("family").alias("b")), distance).select("a", "b")
    sizes = families.select("family", "n_names")
    # of two family names one edit apart one is a typing error of the other, and rare
    near = near.join(sizes.select(F.col("family").alias("a"), F.col("n_names").alias("na")), "a").join(sizes.select(F.col("family").alias("b"), F.col("n_names").alias("nb")), "b").filter(F.least("na", "nb") <= 2)
    around = near.select("a", "b", F.lit(1).alias("edit"), "na", "nb").unionByName(families.select(F.col("family").alias("a"), F.col("family").alias("b"), F.lit(0).alias("edit"), F.col("n_names").alias("na"), F.col("n_names").alias("nb")))
    around = checkpoint(around)
    x = nodes.select(*[F.col(c).alias(f"{c}_a") for c in [*node, "first", "initial"]])
    y = nodes.select(*[F.col(c).alias(f"{c}_b") for c in [*node, "first", "initial"]])
    fits = F.col("middle_a").isNull() | F.col("middle_b").isNull() | (F.col("middle_a") == F.col("middle_b"))
    both = x.join(around, F.col("family_a") == F.col("a")).drop("a")
    same = both.filter("given_a is not null").join(y, (F.col("b") == F.col("family_b")) & (F.col("given_a") == F.col("given_b"))).filter(fits & (F.col("first_a") != F.col("first_b")))
    # without a middle initial a name fits people with different ones: then it is no one's
    w = Window.partitionBy("first_a")
    lone = F.when(F.col("middle_a").isNull() & (F.size(F.collect_set(F.when(F.col("edit") == 0, F.col("middle_b"))).over(w)) > 1), 0).otherwise(1)
    # a mistyped family name belongs to the most frequent one that it fits, not to two
    most = F.max(F.when((F.col("edit") == 1) & (F.col("na") <= F.col("nb")), F.struct("nb", "b"))).over(w)
    same = same.withColumn("ok", lone).withColumn("most", most).filter("(ok = 1 or middle_b is null) and (edit = 0 or (na <= nb and b = most.b))").select("first_a", "first_b")
    letter = F.substring("given_b", 1, 1)
    short = both.filter("initial_a").join(y.filter("not initial_b"), (F.col("b") == F.col("family_b")) & (F.col("given_a") == letter)).filter(fits)
    best = F.min("edit").over(w)
    who = F.col("given_b")
    short = short.withColumn("best", best).filter("edit = best").withColumn("who", F.size(F.collect_set(who).over(w))).withColumn("mids", F.size(F.collect_set("middle_b").over(w)))
    short = short.filter((F.col("who") == 1) & ((F.col("mids") <= 1) | F.col("middle_a").isNotNull())).select("first_a", "first_b")
    # names of one node, and nodes of one person
    within = people.join(nodes.select(*[F.col(c).alias(f"_{c}") for c in node], "first"), (F.col("family") == F.col("_family")) & F.col("given").eqNullSafe(F.col("_given")) & F.col("middle").eqNullSafe(F.col("_middle"))).filter("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    return within.unionByName(same.unionByName(short).select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))).distinct()


def organisation_parts(name: str) -> tuple[list[str], list[str]]:
    """(kinds, other words) of an organisation's name, folded, small words left out."""
    words = [fold(w.strip(".,;*†()")) for w in re.sub(r"[\d*†‡]+(,\d+)*\s*$", "", name).replace("&", " ").split()]
    kinds, rest = [], []
    for w in words:
        if not w or w in ORG_SMALL:
            continue
        kind = ORG_SHORT.get(w) or next((k for k in sorted(ORG_KINDS) if k == w or (len(w) >= 4 and k.startswith(w))), None)
        (kinds if kind else rest).append(ORG_SHORT.get(kind, kind) if kind else w)
    return sorted(set(kinds)), rest


def organisation_words(orgs: DataFrame) -> DataFrame:
    """(name, kinds, word, at): the words of each organisation but those of its kind; a name of its kind alone has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for n in b.column(0).to_pylist():
                kinds, rest = organisation_parts(n)
                rows += [(n, " ".join(kinds), w, at) for at, w in enumerate(rest)]
            kind = (pa.string(), pa.string(), pa.string(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kind)], names=["name", "kinds", "word", "at"])

    return orgs.select("name").mapInArrow(run, "name string, kinds string, word string, at int")


def righted(words: DataFrame, distance: int = 1) -> DataFrame:
    """(word, right, n): each word with the more frequent one that it is a typing error of, else itself, and the names that have it.

    Words of five letters or more follow any more frequent neighbour, shorter ones, which differ by a letter
    often, only one at least three times as frequent."""
    often = checkpoint(words.groupBy("word").agg(F.count_distinct("name").alias("n")))
    long = often.filter(F.length("word") > 3)
    near = trie_join(long.select(F.col("word").alias("a")), long.select(F.col("word").alias("b")), distance).select("a", "b")
    near = near.join(often.select(F.col("word").alias("a"), F.col("n").alias("na")), "a").join(often.select(F.col("word").alias("b"), F.col("n").alias("nb")), "b")
    follows = F.when(F.least(F.length("a"), F.length("b")) > 4, F.struct(-F.col("nb"), "b") < F.struct(-F.col("na"), "a")).otherwise(F.col("nb") >= 3 * F.col("na"))
    best = near.filter(follows).groupBy(F.col("a").alias("word")).agg(F.min_by("b", F.struct(-F.col("nb"), "b")).alias("right"))
    return often.join(best, "word", "left").select("word", F.coalesce("right", "word").alias("right"), "n")


def organisation_links(orgs: DataFrame, distance: int = 1) -> DataFrame:
    """(a, b): spellings of one organisation, each linked to others of it.

    Names of equal kind and equal righted words are one. A name with words cut short, or with one word that
    may be the initials of a field, is compared with the names of its kind that share one word and the first
    three letters of the others, or their initials."""
    words = checkpoint(organisation_words(orgs))
    right = checkpoint(righted(words, distance))
    whole = right.groupBy(F.col("right").alias("word")).agg(F.sum("n").alias("n"))
    # words that a more frequent one begins with
    longer = whole.filter(F.length("word") > 3).select(F.col("n").alias("m"), "word", F.explode(F.expr("sequence(3, length(word) - 1)")).alias("k")).select(F.expr("substring(word, 1, k)").alias("word"), "m")
    cut = longer.groupBy("word").agg(F.max("m").alias("m")).join(whole, "word").filter("m >= n").select("word", F.lit(True).alias("cut"))
    told = words.join(right.select("word", "right"), "word").select("name", "kinds", F.col("right").alias("word")).join(whole, "word").join(cut, "word", "left")
    forms = told.groupBy("name", "kinds").agg(F.array_sort(F.collect_list(F.struct("word", "n", F.coalesce("cut", F.lit(False)).alias("cut")))).alias("words"))
    forms = forms.groupBy("kinds", F.transform("words", lambda x: x["word"]).alias("bare"), "words").agg(F.min("name").alias("first"), F.collect_set("name").alias("names"))
    forms = checkpoint(forms)
    same = forms.select("first", F.explode("names").alias("name")).filter("name <> first").select(F.col("name").alias("a"), F.col("first").alias("b"))
    begin = lambda c, k: F.array_join(F.array_sort(F.transform(c, lambda w: F.substring(w, 1, k))), " ")
    letters = lambda w: F.array_join(F.array_sort(F.split(w, "")), " ")
    one = F.get("rest", F.lit(0))
    apart = forms.select("kinds", "first", "bare", "words", F.explode(F.array_distinct("bare")).alias("own")).withColumn("rest", F.array_remove("bare", F.col("own"))).filter(F.size("rest") > 0)
    lone = (F.size("rest") == 1) & F.length(one).between(2, 5)
    cut_off = F.when(F.exists("words", lambda x: x["cut"]), F.concat(F.lit("b "), begin("rest", 3)))
    keys = F.array_compact(F.array(cut_off, F.when(lone, F.concat(F.lit("i "), letters(one)))))
    short = apart.select("kinds", "own", F.col("first").alias("a"), "rest", F.explode(keys).alias("key"))
    full = apart.select("kinds", "own", F.col("first").alias("b"), F.col("rest").alias("other"), F.explode(F.array(F.concat(F.lit("b "), begin("rest", 3)), F.concat(F.lit("i "), begin("rest", 1)))).alias("key"))
    pairs = short.join(full, ["kinds", "own", "key"]).filter("a <> b")
    # word by word equal or the beginning of the other in sorted order, or one word of initials
    begins = F.forall(F.arrays_zip("rest", "other"), lambda z: F.startswith(z["rest"], z["other"]) | F.startswith(z["other"], z["rest"]))
    fits = pairs.filter((F.startswith("key", F.lit("b")) & (F.size("rest") == F.size("other")) & begins) | (F.startswith("key", F.lit("i")) & (F.size("other") > 1))).select("a", "b")
    return same.unionByName(fits).distinct()


def variants(authors: DataFrame, aliases: DataFrame, distance: int = 1) -> DataFrame:
    """(name, entity): the smallest spelling of the person or organisation of each name that has several."""
    rows = checkpoint(parsed(authors))
    names, votes = readings(rows.filter("not org"))
    names = checkpoint(names)
    # written one after the other, so that no plan holds both
    edges = checkpoint(person_links(names, votes, aliases, distance)).unionByName(checkpoint(organisation_links(rows.filter("org"), distance)))
    labels = propagate(edges.select(F.lit("").alias("collection"), "a", "b"))
    return labels.select(F.col("citation_key").alias("name"), F.col("label").alias("entity"))


def variant_pairs(authors: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name_a, name_b): all pairs of spellings of one entity, name_a < name_b by code points."""
    found = checkpoint(variants(authors, aliases))
    return found.select("entity", F.col("name").alias("name_a")).join(found.select("entity", F.col("name").alias("name_b")), "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
