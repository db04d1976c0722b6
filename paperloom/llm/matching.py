"""Matching of summaries and search hits that share no identifier, by loopy belief propagation.

Candidate pairs are all pairs that the score can accept: no word of such a hit's title may be without
counterpart, so an index of title words and their misspellings is asked for its rarest words together, and
no title makes up for other authors, so pairs whose authors share no family name are left out before they
are scored. Equal records are compared once. Each pair gets log-odds from its titles, authors and years. Pairs are binary variables under two
kinds of factors: a hit belongs to one summary at most, and a summary's hits of one source crowd each
other out a little, since a source lists a work mostly once. Messages between pairs and factors are
exchanged through sums over the factors' keys until they no longer change; the marginals are reported.
Pairs without rivals in either factor get no messages and need no rounds.
Messages that have not come to rest after a stated number of rounds are an error, not a result.

Defined results: titles that are null or blank match nothing; missing authors or years count neither
for nor against; repeated rows of a summary or of a hit count once; extra columns are ignored; empty
tables give an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.names import read
from paperloom.runtime import checkpoint, small_enough

#: Log-odds of what a pair shows; fixed parameters of the model.
PRIOR = -2.5
TITLE_SAME, TITLE_CUT, TITLE_SHORT, TYPO, WORD_OFF, SMALL_OFF = 4.0, 2.5, 1.5, -0.3, -6.0, -1.0
AUTHORS_SAME, AUTHORS_SOME, AUTHORS_OTHER = 3.0, 0.5, -8.0
YEAR = {0: 1.5, 1: 0.3, 2: -0.7}
YEAR_OFF = -2.5
SAME_SOURCE = 0.7  # log-odds that a further hit of the same source costs
HARD = 30.0
SMALL = frozenset("a an the of in on for and to with under from".split())
ASKED = 2  # rarest words of a hit's title that are looked up together; the others are checked behind the look-up
MOST_KEYS = 1 << 20  # keys asked for that are sent to every worker at most; of more, all keys of summaries are joined


def title_words(title: str | None) -> tuple[list[str], int, bool]:
    """(words, number of words before the subtitle, whether the title is cut off)."""
    if not title:
        return [], 0, False
    t = html.unescape(re.sub(r"<[^>]{1,40}>", "", title))
    t = unicodedata.normalize("NFKC", t).strip()
    cut = bool(re.search(r"(?:\.\.\.|…)\s*$", t))
    t = "".join(c for c in unicodedata.normalize("NFKD", t.casefold()) if not unicodedata.combining(c))
    head = re.split(r"[:?]|\s[-–—]\s|\.\s", t.strip(" .…"), maxsplit=1)[0]
    words = re.findall(r"[^\W_]+", t)
    return words, len(re.findall(r"[^\W_]+", head)), cut


def families(authors: list[str | None] | None) -> list[list[str]]:
    """Folded tokens of each author that may be the family name, packed lists taken apart."""
    return [tokens for entry in authors or [] if entry for tokens in _families_of(entry)]


@lru_cache(1 << 15)
def _families_of(entry: str) -> list[list[str]]:
    out = []
    for name in re.split(r"\s*[;|]\s*|\s+and\s+(?=[A-Z])", entry):
        if not name.strip() or re.fullmatch(r"(?i)\s*(?:et\.? al\.?|and others|others|u\. ?a\.)\s*", name):
            continue
        front, behind, comma = read(re.sub(r"(?i),?\s*\bet\.? al\.?\s*$", "", name))
        tokens = [t for t in (front if comma else front + behind) if len(t) > 1]
        if tokens:
            out.append(tokens)
    return out


@lru_cache(1 << 16)
def near(a: str, b: str) -> int:
    """0 for equal words, 1 for one typing error apart, 3 for two in words of six letters or more, 9 for others."""
    if a == b:
        return 0
    n, m = len(a), len(b)
    most = 2 if min(n, m) >= 6 else 1
    if abs(n - m) > most or min(n, m) < 3:
        return 9
    while n and m and a[0] == b[0]:
        a, b, n, m = a[1:], b[1:], n - 1, m - 1
    while n and m and a[-1] == b[-1]:
        a, b, n, m = a[:-1], b[:-1], n - 1, m - 1
    if max(n, m) <= 1 or (n == m == 2 and a == b[::-1]):
        return 1
    if most < 2 or max(n, m) > 8:
        return 9
    row = list(range(m + 1))
    for i in range(n):
        last, row = row, [i + 1]
        for j in range(m):
            row.append(min(last[j] + (a[i] != b[j]), last[j + 1] + 1, row[j] + 1))
    return 3 if row[m] <= most else 9


def title_score(a: tuple[list[str], int, bool], b: tuple[list[str], int, bool]) -> float:
    """Log-odds of two titles: a the summary's, b the hit's; a hit's title of small words only has to be equal."""
    (wa, ma, ca), (wb, mb, cb) = a, b
    if not wa or not wb:
        return WORD_OFF
    if not bound_words(wb, mb, cb):
        return TITLE_SAME if wa == wb else WORD_OFF
    base = TITLE_SAME
    if wa != wb:
        if cb and len(wb) < len(wa) + 1 and len(wb) > 3:
            k = len(wb)
            if wa[k - 1 : k] and wa[k - 1].startswith(wb[-1]):
                wb = wb[:-1] + [wa[k - 1]]
            wa, base = wa[:k], TITLE_CUT
        elif len(wb) <= ma < len(wa) and abs(len(wb) - ma) <= 1:
            wa, base = wa[:ma], TITLE_SHORT
        elif len(wa) <= mb < len(wb) and abs(len(wa) - mb) <= 1:
            wb, base = wb[:mb], TITLE_SHORT
    if wa == wb:
        return base
    n, m = len(wa), len(wb)
    # alignment of words: typing errors are cheap, other words decide
    row = [0.0]
    for w in wb:
        row.append(row[-1] + (SMALL_OFF if w in SMALL else WORD_OFF))
    for i in range(n):
        last = row
        row = [last[0] + (SMALL_OFF if wa[i] in SMALL else WORD_OFF)]
        lo, hi = max(0, i - 4), min(m, i + 5)
        for j in range(m):
            best = max(last[j + 1] + (SMALL_OFF if wa[i] in SMALL else WORD_OFF), row[j] + (SMALL_OFF if wb[j] in SMALL else WORD_OFF))
            if lo <= j < hi:
                d = near(wa[i], wb[j])
                if d < 9:
                    best = max(best, last[j] + d * TYPO)
                elif i + 1 < n and wa[i] + wa[i + 1] == wb[j]:
                    best = max(best, last[j] + TYPO)
                elif j and wb[j - 1] + wb[j] == wa[i]:
                    best = max(best, last[j - 1] + TYPO)
            row.append(best)
    return base + row[m]


def same_family(t: str, u: str) -> bool:
    """Whether a token of a hit's author is taken for one of a summary's author."""
    return min(len(t), len(u)) >= 3 and (len(t) > 3 or t == u) and near(t, u) < 3


def author_score(a: list[list[str]], b: list[list[str]]) -> float:
    """Log-odds of two author lists by the share of family names of the shorter one."""
    if not a or not b:
        return 0.0
    left, hits = [set(x) for x in a], 0
    for name in b:
        for k, other in enumerate(left):
            if any(same_family(t, u) for t in name for u in other):
                hits += 1
                del left[k]
                break
    share = hits / min(len(a), len(b))
    return AUTHORS_SAME if share >= 0.5 else AUTHORS_SOME if hits else AUTHORS_OTHER


def year_score(a: int | None, b: int | None) -> float:
    if not a or not b:
        return 0.0
    return YEAR.get(abs(a - b), YEAR_OFF)


def parsed(df: DataFrame) -> DataFrame:
    """(class, words, main, cut, people, year, source): titles and authors taken apart once per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            titles = [title_words(t) for t in b.column(1).to_pylist()]
            people = [families(a) for a in b.column(2).to_pylist()]
            words = pa.list_(pa.string())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([t[0] for t in titles], words), pa.array([t[1] for t in titles], pa.int32()), pa.array([t[2] for t in titles], pa.bool_()), pa.array(people, pa.list_(words)), b.column(3), b.column(4)],
                names=["class", "words", "main", "cut", "people", "year", "source"],
            )

    return df.select("class", "title", "authors", "year", "source").mapInArrow(run, "class bigint, words array<string>, main int, cut boolean, people array<array<string>>, year int, source string").filter(F.size("words") > 0)


def classes(df: DataFrame, ident: str) -> tuple[DataFrame, DataFrame]:
    """(one row per different content with its class, membership): equal records are compared once.

    A class is numbered where its content is grouped, so that no two contents share one; the numbers are written,
    since they depend on the partitioning."""
    content = ["title", "authors", "year", "source"]
    rows = df.select(ident, "title", "authors", F.col("year").cast("int").alias("year"), F.lower(F.trim("source")).alias("source")).filter(F.trim("title") != "")
    first = checkpoint(rows.select(*content).distinct().withColumn("class", F.monotonically_increasing_id()))
    named = first.select("class", *[F.col(c).alias(f"_{c}") for c in content])
    same = F.col("title") == F.col("_title")
    for c in content[1:]:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return first, rows.join(named, same).select("class", ident).distinct()


def deletions(word: str) -> set[str]:
    """Strings that a word leaves without one letter (two from six letters on): words that are ``near`` share one."""
    out = {word}
    for _ in range(0 if len(word) < 3 else 1 if len(word) < 6 else 2):
        out |= {w[:i] + w[i + 1 :] for w in out for i in range(len(w))}
    return out


def bound_words(words: list[str], main: int, cut: bool) -> list[int]:
    """Positions of a hit's words that an accepted pair must align, whatever part of the titles is compared."""
    end = main or len(words)
    if cut and len(words) > 3 and end == len(words):
        end -= 1
    return [j for j in range(end) if words[j] not in SMALL]


def near_words(hit: DataFrame, summary: DataFrame) -> DataFrame:
    """(hw, sw): words of hits with the summaries' words that align with them; splits of a word by their first part."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(w, k) for w in b.column(0).to_pylist() for k in deletions(w)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["w", "k"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([near(x, y) < 9 for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))

    keys = lambda df, name: df.mapInArrow(spread, "w string, k string").select(F.col("w").alias(name), F.xxhash64("k").alias("k"))
    close = keys(hit.select("hw"), "hw").join(keys(summary.select("sw"), "sw"), "k").select("hw", "sw").distinct().mapInArrow(check, "hw string, sw string")
    at = F.explode(F.expr("sequence(1, length(hw) - 1)"))
    parts = hit.filter(F.length("hw") > 1).select("hw", at.alias("i")).select("hw", F.expr("substring(hw, 1, i)").alias("sw"), F.expr("substring(hw, i + 1)").alias("rest"))
    split = parts.join(summary.select("sw"), "sw").join(summary.select(F.col("sw").alias("rest")), "rest").select("hw", "sw")
    return close.unionByName(split).distinct()


def word_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, h): all pairs whose log-odds can exceed 0, and others.

    A word of more weight than SMALL without counterpart costs what authors and year can give at most, so each
    bound word of the hit has one among the summary's words: an equal or misspelt one, one it was joined from
    or is part of. The ASKED with the fewest summaries behind them are looked up together; the rest are checked
    on bits that the words' hashes set, which a pair that has them always passes. Titles without bound words are
    looked up as a whole."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for h, words, main, cut in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                places = bound_words(words, main, cut)
                rows += [(h, j, words[j], [words[j - 1] + words[j]] * (j > 0) + [words[j] + x for x in words[j + 1 : j + 2]]) for j in places] or [(h, -1, None, [])]
            cols = [[r[i] for r in rows] for i in range(4)]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.string()))], names=["h", "j", "hw", "joined"])

    def keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """A key of two hashed words, or of one, given twice; pairs that meet by chance are checked later."""
        return low * np.int64(0x5851F42D4C957F2D) + high

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists = b.column(1)
            j, word, n = (lists.flatten().field(i) for i in range(3))
            hit, j = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy())), j.to_numpy()
            there, word, n = word.is_valid().to_numpy(zero_copy_only=False), word.fill_null(0).to_numpy(), n.fill_null(0).to_numpy()
            # a word may be near to a place's word and joined from it
            by = np.lexsort((word, ~there, j, hit))
            hit, j, there, word, n = hit[by], j[by], there[by], word[by], n[by]
            place = np.r_[True, (hit[1:] != hit[:-1]) | (j[1:] != j[:-1])]
            once = place | there & np.r_[True, word[1:] != word[:-1]]
            hit, there, word, n, place = hit[once], there[once], word[once], n[once], place[once]
            first = np.flatnonzero(place)
            bits = np.bitwise_or.reduceat(np.where(there, np.left_shift(np.int64(1), word & 63), 0), first)
            total, of, end = np.add.reduceat(n, first), hit[first], np.r_[first[1:], len(hit)]
            order = np.lexsort((total, of))
            starts = np.flatnonzero(np.r_[True, of[order][1:] != of[order][:-1]])
            rows = []
            for x, y in zip(starts, np.r_[starts[1:], len(order)], strict=True):
                # one without a word leaves none to ask for
                asks = [word[first[k] : end[k]].tolist() if total[k] else [] for k in order[x : min(y, x + ASKED)]]
                rows += {(of[order[x]], min(ws), max(ws)) for ws in product(*asks)}
            at, low, high = np.array(rows, np.int64).reshape(-1, 3).T
            every = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(order)].astype(np.int32)), pa.array(bits[order]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(keys(low, high)), every.take(pa.array(at))], names=["h", "key", "bits"])

    def giving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # each word with itself and those behind it
            each = [x[np.stack(np.triu_indices(len(x)))] for x in (np.array(x, np.int64) for x in b.column(1).to_pylist())]
            at = np.repeat(np.arange(len(each)), [x.shape[1] for x in each])
            key = keys(*np.concatenate(each, axis=1))
            if wanted is not None:
                kept = np.isin(key, wanted.value)
                at, key = at[kept], key[kept]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(key), b.column(2).take(pa.array(at))], names=["s", "key", "bits"])

    places = checkpoint(right.select("class", "words", "main", "cut").mapInArrow(bound, "h bigint, j int, hw string, joined array<string>"))
    vocabulary = checkpoint(left.select(F.explode(F.array_distinct("words")).alias("sw")).groupBy("sw").agg(F.count(F.lit(1)).alias("n")))
    near_ = near_words(places.filter("j >= 0").select("hw").distinct(), vocabulary)
    word = F.xxhash64("sw").alias("word")
    variants = near_.join(vocabulary, "sw").select("hw", word, "n")
    variants = places.filter("j >= 0").select("h", "j", "hw").join(variants, "hw", "left").select("h", "j", "word", "n")
    joined = places.select("h", "j", F.explode("joined").alias("sw")).join(vocabulary, "sw").select("h", "j", word, "n")
    every = variants.unionByName(joined).groupBy("h").agg(F.collect_list(F.struct("j", "word", "n")).alias("places"))
    asked = checkpoint(every.mapInArrow(asking, "h bigint, key bigint, bits array<bigint>"))
    bits = lambda words: F.aggregate(words, F.lit(0).cast("bigint"), lambda m, w: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(w, F.lit(64)).cast("int"))))
    # of a summary's keys, those that no hit asks for need not be joined
    wanted, distinct = None, asked.select("key").distinct()
    if small_enough(distinct, MOST_KEYS):
        wanted = left.sparkSession.sparkContext.broadcast(np.sort(distinct.toArrow().column("key").to_numpy()))
    words = F.array_sort(F.transform(F.array_distinct("words"), lambda w: F.xxhash64(w)))
    given = left.select(F.col("class").alias("s"), words.alias("words")).withColumn("bits", bits(F.col("words"))).mapInArrow(giving, "s bigint, key bigint, bits bigint")
    found = asked.withColumnRenamed("bits", "hb").join(given.withColumnRenamed("bits", "sb"), "key").filter(F.forall("hb", lambda b: b.bitwiseAND(F.col("sb")) != 0)).select("s", "h")
    title = F.array_join("words", " ")
    whole = left.select(F.col("class").alias("s"), title.alias("title")).join(places.filter("j < 0").select("h").join(right.select(F.col("class").alias("h"), title.alias("title")), "h"), "title").select("s", "h")
    return found.unionByName(whole).distinct()


def near_names(hit: DataFrame, summary: DataFrame) -> DataFrame:
    """(ht, st): tokens of hits' authors with the tokens of summaries' authors that they are taken for."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # tokens one typing error apart share one of these
            rows = [(t, k) for t in b.column(0).to_pylist() for k in {t, *(t[:i] + t[i + 1 :] for i in range(len(t)))}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["t", "k"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([same_family(x, y) for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.bool_()))

    keys = lambda df, name: df.filter(F.length(name) >= 3).mapInArrow(spread, "t string, k string").select(F.col("t").alias(name), F.xxhash64("k").alias("k"))
    return keys(hit, "ht").join(keys(summary, "st"), "k").select("ht", "st").distinct().mapInArrow(check, "ht string, st string")


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, h): the pairs of ``word_pairs`` without those that have authors on both sides and no family name in common.

    Other authors cost more than title and year can give above the bound of ``scored_pairs``."""
    tokens = lambda df, name: df.select("class", F.explode(F.array_distinct(F.flatten("people"))).alias(name))
    of_hit, of_summary = tokens(right, "ht"), tokens(left, "st")
    near_ = near_names(of_hit.select("ht").distinct(), of_summary.select("st").distinct())
    known = of_hit.join(near_, "ht").groupBy(F.col("class").alias("h")).agg(F.collect_set(F.xxhash64("st")).alias("near"))
    x = left.select(F.col("class").alias("s"), F.transform(F.array_distinct(F.flatten("people")), lambda t: F.xxhash64(t)).alias("own"))
    # null where a hit names no authors
    y = right.select(F.col("class").alias("h"), (F.size("people") > 0).alias("named")).join(known, "h", "left")
    y = y.select("h", F.when(F.col("named"), F.coalesce("near", F.array().cast("array<bigint>"))).alias("near"))
    both = word_pairs(left, right).join(x, "s").join(y, "h")
    return both.filter(F.col("near").isNull() | (F.size("own") == 0) | F.arrays_overlap("own", "near")).select("s", "h")


def scored_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(s, h, source, theta): candidate pairs of content classes with their log-odds, hopeless ones left out."""
    pairs = candidates(left, right)
    fields = ["words", "main", "cut", "people", "year"]
    x = left.select(F.col("class").alias("s"), *fields)
    y = right.select(F.col("class").alias("h"), *[F.col(c).alias(f"{c}2") for c in fields], "source")
    both = pairs.join(x, "s").join(y, "h")
    both = both.select("s", "h", "source", *fields, *[f"{c}2" for c in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            theta = []
            for wa, ma, ca, pa_, ya, wb, mb, cb, pb, yb in zip(*(b.column(i).to_pylist() for i in range(3, 13)), strict=True):
                score = PRIOR + author_score(pa_, pb) + year_score(ya, yb)
                # the best title cannot make up for other authors
                theta.append(score + title_score((wa, ma, ca), (wb, mb, cb)) if score + TITLE_SAME > -5 else score)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(theta, pa.float64())], names=["s", "h", "source", "theta"])

    return both.mapInArrow(run, "s bigint, h bigint, source string, theta double").filter("theta > -5")


def _crowd(group: list[str], incoming: str, out: str, penalty: float):
    """Factor messages: what the others of a group leave for each pair; sums per group."""

    def step(df: DataFrame) -> DataFrame:
        e = F.exp(F.least(F.col(incoming), F.lit(HARD)))
        rest = F.greatest(F.sum(e).over(Window.partitionBy(*group)) - e, F.lit(0.0))
        return df.withColumn("_rest", rest).withColumn(out, F.log((1 + F.col("_rest") * float(2.718281828459045**-penalty)) / (1 + F.col("_rest")))).drop("_rest")

    return step


def propagate_beliefs(pairs: DataFrame, rounds: int = 120, damping: float = 0.5, tolerance: float = 1e-3) -> DataFrame:
    """(s, h, match_score): marginal probabilities of the pairs."""
    size = lambda *group: F.count(F.lit(1)).over(Window.partitionBy(*group))
    start = pairs.select("s", "h", F.coalesce("source", F.lit("")).alias("source"), "theta").withColumn("of_hit", size("h")).withColumn("of_summary", size("s", "source"))
    start = checkpoint(start.select("s", "h", "source", "theta", F.lit(0.0).alias("from_hit"), F.lit(0.0).alias("from_summary"), ((F.col("of_hit") > 1) | (F.col("of_summary") > 1)).alias("rivals")))
    # a pair that is alone in both factors gets no messages
    alone, now = start.filter(~F.col("rivals")), start.filter("rivals").drop("rivals")
    mix = lambda new, old: F.col(new) * (1 - damping) + F.col(old) * damping
    for _ in range(rounds):
        step = now.withColumns({"to_hit": F.col("theta") + F.col("from_summary"), "to_summary": F.col("theta") + F.col("from_hit")})
        step = _crowd(["h"], "to_hit", "new_hit", HARD)(step)
        step = _crowd(["s", "source"], "to_summary", "new_summary", SAME_SOURCE)(step)
        now = step.select(
            "s", "h", "source", "theta", mix("new_hit", "from_hit").alias("from_hit"), mix("new_summary", "from_summary").alias("from_summary"),
            F.greatest(F.abs(F.col("new_hit") - F.col("from_hit")), F.abs(F.col("new_summary") - F.col("from_summary"))).alias("change"),
        )
        now = checkpoint(now)
        worst = now.agg(F.max("change")).collect()[0][0]
        if worst is None or worst < tolerance:
            break
        now = now.drop("change")
    else:
        raise RuntimeError(f"messages have not come to rest after {rounds} rounds: {worst}")
    belief = F.col("theta") + F.col("from_hit") + F.col("from_summary")
    return now.select("s", "h", "theta", "from_hit", "from_summary").unionByName(alone.select("s", "h", "theta", "from_hit", "from_summary")).select("s", "h", (1 / (1 + F.exp(-belief))).alias("match_score"))


def matches(summaries: DataFrame, hits: DataFrame, least: float = 0.5) -> DataFrame:
    """(citation_key, seq, match_score) of the pairs with a marginal above ``least``."""
    # a citation key holds its paper's year, which stands in for a missing one
    in_key = F.expr("try_cast(regexp_extract(citation_key, '((?:19|20)[0-9]{2})', 1) as int)")
    year = F.coalesce(F.nullif(F.col("year").cast("int"), F.lit(0)), in_key)
    left, s_member = classes(summaries.withColumn("year", year), "citation_key")
    right, h_member = classes(hits, "seq")
    left, right = checkpoint(parsed(left)), checkpoint(parsed(right))
    found = propagate_beliefs(scored_pairs(left, right)).filter(F.col("match_score") > least)
    named = found.join(s_member.withColumnRenamed("class", "s"), "s").join(h_member.withColumnRenamed("class", "h"), "h")
    return named.groupBy("citation_key", "seq").agg(F.max("match_score").alias("match_score"))
