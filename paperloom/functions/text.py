"""Scalar functions on bibliographic text, as Column expressions (rows ST1-ST34, RP1-RP5 of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the keyword extraction.
KEYWORD_STOP_WORDS = (
    "this", "that", "these", "those", "with", "from", "into", "during", "including", "against", "throughout", "despite", "towards", "upon", "concerning", "through", "about", "which",
    "their", "there", "would", "could", "should", "might", "may", "will", "shall", "must", "have", "has", "had", "been", "being", "were", "was", "are", "is", "the", "and", "for", "but",
    "not", "you", "all", "can", "her", "one", "our", "out", "day", "get", "him", "his", "how", "its", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "let", "put", "say",
    "she", "too", "use",
)
#: Stop words of citation keys.
KEY_STOP_WORDS = ("a", "an", "the", "on", "in", "of", "for", "to", "and", "with")
YEARS = (1990, 2030)


def nonempty(c: Column, kind: str = "string") -> Column:
    """Truth of a value: null, '', 0 and the empty list are false; never null."""
    if kind == "array":
        return F.coalesce(F.size(c) > 0, F.lit(False))
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False))


def normalize_title(c: Column) -> Column:
    """ST1: lower case, only letters, digits, underscores and single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def words(c: Column) -> Column:
    """Different words of a normalized text."""
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """ST2, RP1, RP12 of two word sets; 0 where one is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(0.0)


def title_similarity(a: Column, b: Column) -> Column:
    """ST2: Jaccard similarity of the words of two titles."""
    return jaccard(words(normalize_title(a)), words(normalize_title(b)))


def last_names(authors: Column) -> Column:
    """Last blank-separated token of each author in lower case, distinct."""
    names = F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: a.isNotNull() & (F.trim(a) != ""))
    return F.array_distinct(F.transform(names, lambda a: F.lower(F.element_at(F.split(F.trim(a), r"\s+"), -1))))


def author_overlap(a: Column, b: Column) -> Column:
    """ST3: shared last names over the last names of ``a``; 0 where either has none."""
    x, y = last_names(a), last_names(b)
    return F.when((F.size(x) > 0) & (F.size(y) > 0), F.size(F.array_intersect(x, y)) / F.size(x)).otherwise(0.0)


def year_match(a: Column, b: Column) -> Column:
    """ST4: .5 where a year is missing, 1 for the same, .8 for neighbours, then .2 less a year."""
    d = F.abs(a - b)
    return F.when(~nonempty(a, "number") | ~nonempty(b, "number"), 0.5).when(d == 0, 1.0).when(d <= 1, 0.8).otherwise(F.greatest(F.lit(0.0), 1.0 - 0.2 * (d - 1)))


def search_query(title: Column, authors: Column) -> Column:
    """ST5: the title and the first author's last token."""
    first = F.when(F.size(authors) > 0, F.element_at(F.split(F.trim(F.element_at(authors, 1)), r"\s+"), -1))
    return F.concat_ws(" ", title, first)


def citation_key_base(title: Column, authors: Column, year: Column) -> Column:
    """ST6, ST7: last name of the first author, year or 'nodate', first word of the title that is no stop word."""
    alnum = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")
    first = F.element_at(F.filter(F.coalesce(authors, F.array().cast("array<string>")), lambda a: F.trim(a) != ""), 1)
    name = F.coalesce(F.nullif(alnum(F.element_at(F.split(F.trim(F.when(F.size(authors) > 0, first)), r"\s+"), -1)), F.lit("")), F.lit("anonymous"))
    tokens = F.filter(F.transform(F.split(F.coalesce(title, F.lit("")), r"\s+"), alnum), lambda w: (w != "") & ~w.isin(*KEY_STOP_WORDS))
    word = F.coalesce(F.when(F.size(tokens) > 0, F.element_at(tokens, 1)), F.lit("paper"))
    return F.concat(name, F.when(nonempty(year, "number"), year.cast("string")).otherwise("nodate"), word)


def keywords(c: Column, min_length: int = 4) -> Column:
    """ST8: different ASCII words of a text that are no stop words; whole runs of word characters only."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(f"^[a-z]{{{min_length},}}$") & ~w.isin(*KEYWORD_STOP_WORDS)))


def keyword_tokens(c: Column, min_length: int = 4) -> Column:
    """ST9: as ST8 with repetitions, for counting within a document."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(f"^[a-z]{{{min_length},}}$") & ~w.isin(*KEYWORD_STOP_WORDS))


def topics(c: Column) -> Column:
    """ST10: phrases of two or three capitalised words, with repetitions."""
    return F.regexp_extract_all(c, F.lit(r"(?<![A-Za-z0-9_])([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})(?![A-Za-z0-9_])"), F.lit(1))


def concepts(c: Column, most: int = 15) -> Column:
    """ST11: capitalised phrases, then quoted strings, each once, the first ``most``."""
    quoted = F.regexp_extract_all(c, F.lit(r'"([^"\n]{3,50})"'), F.lit(1))
    return F.slice(F.array_distinct(F.concat(topics(c), quoted)), 1, most)


def equations(c: Column) -> Column:
    """ST13: up to five matches of each of three forms, ten in all."""
    forms = (r"(\$[^$]+\$)", r"(\\begin\{equation\}.*?\\end\{equation\})", r"(?m)^\s*([A-Za-z]\s*=\s*[^\n]{3,80})$")
    return F.slice(F.concat(*[F.slice(F.regexp_extract_all(c, F.lit(f), F.lit(1)), 1, 5) for f in forms]), 1, 10)


def has_equations(c: Column) -> Column:
    """ST14."""
    return F.coalesce(c.rlike(r"(?is)\$[^$]+\$|\\begin\{equation\}|\\\[|(?:equation|eq\.)\s*\(?\d+"), F.lit(False))


def has_figures(c: Column) -> Column:
    """ST14."""
    return F.coalesce(c.rlike(r"(?i)(?:figure|fig\.)\s*\d+"), F.lit(False))


def has_tables(c: Column) -> Column:
    """ST14."""
    return F.coalesce(c.rlike(r"(?i)table\s*\d+"), F.lit(False))


def has_references(c: Column) -> Column:
    """ST14."""
    return F.coalesce(c.rlike(r"(?im)^\s*(?:\d+\.?\s*)?(?:references|bibliography|works cited)\s*$"), F.lit(False))


def count_references(c: Column) -> Column:
    """ST15: the largest number in square brackets, 0 where there is none."""
    numbers = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d{1,9})\]"), F.lit(1)), lambda n: n.cast("int"))
    return F.coalesce(F.array_max(numbers), F.lit(0))


def analyze_references(c: Column) -> Column:
    """ST16: whether and where a reference section begins, and how many references there are."""
    start = F.regexp_instr(c, F.lit(r"(?im)^\s*(?:\d+\.?\s*)?(?:references|bibliography)\s*$"))
    marks = F.regexp_count(c, F.lit(r"\\cite\{")) + F.regexp_count(c, F.lit(r"\\bibitem"))
    numbers = count_references(c)
    return F.struct((start > 0).alias("has_section"), F.when(start > 0, start - 1).alias("start"), F.when(numbers > 0, numbers).otherwise(marks).alias("n_references"))


def complexity(c: Column, n_sections: Column) -> Column:
    """ST17: steps for length, sections, equations and technical terms, at most 1."""
    n = F.size(F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != ""))
    length = F.when(n > 10000, 0.3).when(n > 5000, 0.2).when(n > 2000, 0.1).otherwise(0.0)
    parts = F.when(n_sections > 8, 0.2).when(n_sections > 5, 0.1).otherwise(0.0)
    equation = F.when(F.regexp_count(c, F.lit(r"\$[^$]+\$")) > 10, 0.3).when(has_equations(c), 0.1).otherwise(0.0)
    terms = F.regexp_count(F.lower(c), F.lit("(?:algorithm|theorem|hypothesis|methodology|optimization|statistical)"))
    return F.least(F.lit(1.0), length + parts + equation + F.when(terms > 20, 0.2).when(terms > 5, 0.1).otherwise(0.0))


def key_year(c: Column) -> Column:
    """ST23: first four digits of a citation key as a year of the allowed range."""
    year = F.nullif(F.regexp_extract(c, r"(\d{4})", 1), F.lit("")).cast("int")
    return F.when(year.between(*YEARS), year)


def strip_thinking(c: Column) -> Column:
    """ST25: without <think> and <thinking> blocks, the last one even where it is not closed."""
    closed = F.regexp_replace(c, r"(?is)<(think|thinking)>.*?</\1>", "")
    return F.trim(F.regexp_replace(closed, r"(?is)<(?:think|thinking)>.*$", ""))


def estimate_tokens(c: Column) -> Column:
    """ST26: a quarter of the characters, rounded down."""
    return F.floor(F.length(c) / 4).cast("int")


def comparable(c: Column) -> Column:
    """ST27: for comparison, without markup, with single blanks, numbers as N."""
    flat = F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    return F.regexp_replace(F.regexp_replace(flat, r"[#*_`\[\]()]", ""), r"\d+", "N")


def normal_message(c: Column) -> Column:
    """ST28: a log message without times, durations and counts."""
    m = F.regexp_replace(c, r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?Z?", "<time>")
    m = F.regexp_replace(m, r"\d+(?:\.\d+)?\s*(?:ms|s|sec|seconds|minutes|min|m|h)(?![A-Za-z])", "<duration>")
    return F.regexp_replace(m, r"\d+", "<n>")


def fix_markdown(c: Column) -> Column:
    """ST30: no trailing blanks, one blank after header marks, at most one empty line."""
    m = F.regexp_replace(c, r"(?m)[ \t]+$", "")
    m = F.regexp_replace(m, r"(?m)^(#{1,6})([^#\s])", "$1 $2")
    return F.trim(F.regexp_replace(m, r"\n{3,}", "\n\n"))


def format_duration(s: Column) -> Column:
    """ST31: seconds in the largest two units; null stays null."""
    n = F.floor(s).cast("bigint")
    part = lambda a, b: F.floor(n % a / b).cast("string")
    return (
        F.when(n < 60, F.concat(n.cast("string"), F.lit("s")))
        .when(n < 3600, F.concat(part(3600, 60), F.lit("m "), (n % 60).cast("string"), F.lit("s")))
        .when(n < 86400, F.concat(part(86400, 3600), F.lit("h "), part(3600, 60), F.lit("m")))
        .otherwise(F.concat(F.floor(n / 86400).cast("string"), F.lit("d "), part(86400, 3600), F.lit("h")))
    )


def prioritized_text(title: Column, abstract: Column, introduction: Column, conclusion: Column, terms: Column, most: int = 8000) -> Column:
    """ST32: the parts of a paper in their order, cut at ``most`` characters."""
    filled = lambda c: F.nullif(c, F.lit(""))
    listed = F.when(F.size(terms) > 0, F.concat(F.lit("Key terms: "), F.array_join(F.slice(terms, 1, 10), ", ")))
    return F.left(F.concat_ws("\n\n", filled(title), filled(abstract), filled(introduction), filled(conclusion), listed), F.lit(most))


def cache_key(c: Column) -> Column:
    """ST34: SHA-256 of the text."""
    return F.sha2(c, 256)


def key_terms(title: Column, text: Column, most: int = 15) -> Column:
    """ST12: keywords of the title in their order, then those of the text's first 2,000 characters."""
    return F.slice(F.array_distinct(F.concat(keywords(title), F.slice(keywords(F.left(text, F.lit(2000))), 1, 10))), 1, most)


def trigrams(c: Column) -> Column:
    """Different runs of three words."""
    w = F.filter(F.split(c, r"\s+"), lambda x: x != "")
    return F.when(F.size(w) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.array_join(F.slice(w, i, 3), " ")))).otherwise(F.array_distinct(F.slice(w, 1, 0)))


def sequence_similarity(a: Column, b: Column) -> Column:
    """RP3: Jaccard similarity of word trigrams."""
    return jaccard(trigrams(comparable(a)), trigrams(comparable(b)))


def frequency_cosine(a: Column, b: Column) -> Column:
    """RP2: cosine of the word counts of two texts."""
    w1, w2 = (F.filter(F.split(comparable(c), r"\s+"), lambda x: x != "") for c in (a, b))
    both = F.array_intersect(w1, w2)
    count = lambda w, t: F.size(F.filter(w, lambda x: x == t))
    total = lambda ws, f: F.aggregate(ws, F.lit(0.0), lambda s, t: s + f(t))
    dot = total(both, lambda t: count(w1, t) * count(w2, t))
    norm = lambda w: F.sqrt(total(F.array_distinct(w), lambda t: F.pow(count(w, t), F.lit(2.0))))
    return F.when((F.size(w1) > 0) & (F.size(w2) > 0), dot / (norm(w1) * norm(w2))).otherwise(0.0)


def hybrid_similarity(a: Column, b: Column) -> Column:
    """RP4: .3 word sets, .4 word counts, .3 trigrams."""
    return 0.3 * jaccard(words(comparable(a)), words(comparable(b))) + 0.4 * frequency_cosine(a, b) + 0.3 * sequence_similarity(a, b)


def unique_ratio(c: Column, size: int = 200) -> Column:
    """RP5: different normalized chunks of ``size`` characters over all chunks; 1 for an empty text."""
    n = F.ceil(F.length(c) / size).cast("int")
    chunks = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: comparable(F.substring(c, i * size + 1, F.lit(size)))))
    return F.when(n > 0, F.size(F.array_distinct(chunks)) / F.size(chunks)).otherwise(1.0)
