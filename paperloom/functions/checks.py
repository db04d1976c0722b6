"""Checks of texts as column functions: the rules of ``quality``, ``pages`` and ``repetition`` that need no loop in Python.

Patterns are read with '\\n' as the only line end, as Python reads them. Null texts give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom.functions import pages, quality
from paperloom.functions.text import comparable


def _has(c: Column, pattern: str, flags: str = "di") -> Column:
    return c.rlike(f"(?{flags}){pattern}")


def _count(c: Column, pattern: str, flags: str = "d") -> Column:
    return F.regexp_count(c, F.lit(f"(?{flags}){pattern}"))


def _sum(columns: list[Column]) -> Column:
    total = columns[0]
    for c in columns[1:]:
        total = total + c
    return total


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def quotes(c: Column) -> Column:
    """VD3: pieces of quoted evidence."""
    return _sum([_count(c, p) for p in quality.QUOTES])


def signs(c: Column, table: tuple[tuple[str, str], ...]) -> Column:
    """VD4, VD5: what the signs found in a text show, in the order of the table."""
    return F.when(c.isNotNull(), F.array_compact(F.array(*[F.when(_has(c, p), F.lit(why)) for p, why in table])))


def invented(c: Column, source: Column) -> Column:
    """VD4: the first sign that is in the text and not in its source."""
    return F.coalesce(*[F.when(_has(c, p) & ~F.coalesce(_has(source, p), F.lit(False)), F.lit(why)) for p, why in quality.HALLUCINATION])


def generic(c: Column) -> Column:
    """VD6: a generic phrase more than three times."""
    low = F.lower(c)
    found = F.lit(False)
    for phrase in quality.GENERIC:
        found = found | (F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit(""))) > 3 * len(phrase))
    return found


def specifics(c: Column) -> Column:
    """VD6: numbers with a meaning."""
    return _sum([_count(c, p, "di") for p in quality.SPECIFIC])


def equal_beginnings(c: Column) -> Column:
    """VD6: three sentences of over three words that begin with the same three."""
    starts = F.transform(F.filter(F.transform(F.split(F.lower(c), "[.!?]+"), words), lambda w: F.size(w) > 3), lambda w: F.array_join(F.slice(w, 1, 3), " "))
    return _longest_run(starts) > 2


def _longest_run(items: Column) -> Column:
    """How often the most frequent item of an array occurs."""
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, x: Column) -> Column:
        run = F.when(s["last"] == x, s["run"] + 1).otherwise(1)
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(F.array_sort(items), start, step, lambda s: s["best"])


def density_issues(c: Column) -> Column:
    """VD6: (generic, few_specifics, alike) of texts of at least fifty words; none of them for shorter ones."""
    n = F.size(words(c))
    long = n >= 50
    return F.struct((long & generic(c)).alias("generic"), (long & (specifics(c) / F.greatest(F.lit(1.0), n / 50) < 0.3)).alias("few_specifics"), (long & equal_beginnings(c)).alias("alike"))


def well_formed(c: Column) -> Column:
    """VD14: no runs of marks, no double blanks."""
    return ~(c.contains("!!!") | c.contains("???") | c.contains("  "))


def citations(c: Column) -> Column:
    """VD15: author-year, numbered and key citations, each with its number."""
    return F.struct(*[_count(c, p).alias(name) for p, name in zip(quality.CITATIONS, ("author_year", "numbered", "keys"), strict=True)])


def on_topic(c: Column) -> Column:
    """VD18: signs of a review."""
    return _sum([_has(c, p).cast("int") for p in quality.ON_TOPIC])


def off_topic(c: Column) -> Column:
    """VD18: an opening or a sign of something else, and no two signs of a review."""
    bare = F.regexp_replace(c, r"^\s+|\s+$", "")
    other = F.lit(False)
    for p in quality.OFF_TOPIC_START:
        other = other | _has(F.left(bare, F.lit(100)), p, "dim")
    for p in quality.OFF_TOPIC_ANYWHERE:
        other = other | _has(bare, p)
    return (on_topic(c) < 2) & other


def conversational(c: Column) -> Column:
    """VD18: phrases of conversation."""
    return _sum([_has(c, p).cast("int") for p in quality.CONVERSATIONAL])


def is_paper(c: Column, least: int = 2000) -> Column:
    """HT10: long enough, a term of papers, a hundred words, and no short pair of words that is everywhere."""
    low = F.lower(c)
    w = words(low)
    term = F.lit(False)
    for t in pages.PAPER_TERMS:
        term = term | low.contains(t)
    # neighbours by shifting the words by one, so that the text is split once a side and not once a pair
    pairs = F.filter(F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b)), lambda p: F.length(p) < 20)
    return (F.length(c) >= least) & term & F.when(F.size(w) >= 100, _longest_run(pairs) <= 0.1 * F.size(w)).otherwise(F.lit(False))


def unique_ratio(c: Column, size: int = 200) -> Column:
    """RP5: share of different pieces of ``size`` characters; 1 for an empty text."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(c), F.lit(size)), lambda i: comparable(F.substr(c, i, F.lit(size))))
    return F.when(F.length(c) > 0, F.size(F.array_distinct(pieces)) / F.size(pieces)).otherwise(1.0)


def repeated_attributions(c: Column) -> Column:
    """RP7: attributions that follow each other without a quote between them."""
    from paperloom.functions.repetition import ATTRIBUTIONS

    any_of = "|".join(f"(?:{a})" for a in ATTRIBUTIONS)
    return _count(c, rf"(?:{any_of})\s*(?:{any_of})", "di")
