"""Keyword-stuffed and link-list pages.

For each page the rank-frequency curve of its words is fitted with SQL windows: slope and residual of
log frequency over log rank. Beside it stands how far the page's function words diverge from those of
prose of the same language, as the signed root of the likelihood ratio, which takes a page's length
into account: ``scarcity`` is the divergence of their share of all words where it is below that of
prose, ``concentration`` that of each function word's own share, which lists that repeat a few phrases
with their articles, or a tag, drive up. ``extremity`` is how far slope or residual lie outside the
quartiles of pages of the same language and comparable length. A page is reported for scarce function
words, or for concentrated ones with an unusual curve; no other rule decides.

The language is the one whose function words occur most, by the sum of the logarithms of their counts,
since stored tags are unreliable; pages without any are compared with the prose of all languages. The word lists cover four
languages; prose in another one lacks their words, and needs its own list to be told from spam.

Defined results: null, empty and blank texts are never spam; repeated rows of a document count once
(of several texts under one id the smallest holds); extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.runtime import checkpoint

#: Articles, pronouns, prepositions, conjunctions, auxiliaries and common adverbs of each language.
FUNCTION_WORDS = {
    "en": (
        "a", "about", "after", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "between", "both", "but", "by", "can", "could", "did", "do", "does", "during", "each", "either",
        "for", "from", "had", "has", "have", "he", "her", "his", "how", "if", "in", "into", "is", "it", "its", "more", "most", "must", "nor", "not", "of", "on", "only", "or", "other", "our", "over", "she", "should", "since",
        "so", "some", "such", "than", "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "under", "until", "up", "very", "was", "we", "were", "what", "when", "where", "whether",
        "which", "while", "who", "why", "will", "with", "within", "without", "would", "you", "your",
    ),
    "de": (
        "aber", "alle", "als", "also", "am", "an", "auch", "auf", "aus", "bei", "bis", "da", "damit", "dann", "das", "dass", "dem", "den", "denn", "der", "des", "die", "diese", "doch", "durch", "ein", "eine", "einem",
        "einen", "einer", "eines", "er", "es", "etwas", "für", "gegen", "haben", "hat", "hatte", "ich", "ihr", "im", "in", "ist", "ja", "jede", "jeder", "kann", "kein", "mehr", "mit", "nach", "nicht", "noch", "nur", "ob",
        "obwohl", "oder", "ohne", "sehr", "sein", "seine", "sich", "sie", "sind", "so", "sobald", "über", "um", "und", "uns", "unter", "vom", "von", "vor", "war", "was", "weil", "wenn", "werden", "wie", "wir", "wird", "wo",
        "wurde", "zu", "zum", "zur", "zwischen",
    ),
    "fr": (
        "a", "afin", "ainsi", "alors", "après", "au", "aucun", "aussi", "autre", "aux", "avant", "avec", "bien", "car", "ce", "cela", "ces", "cet", "cette", "chaque", "comme", "dans", "de", "depuis", "des", "donc", "dont",
        "du", "elle", "elles", "en", "entre", "est", "et", "été", "être", "eux", "il", "ils", "je", "la", "le", "les", "leur", "leurs", "lorsque", "mais", "même", "moins", "ne", "ni", "nos", "notre", "nous", "on", "ont",
        "ou", "où", "par", "pas", "pendant", "plus", "pour", "pourquoi", "quand", "que", "quel", "qui", "sa", "sans", "se", "ses", "si", "son", "sont", "sous", "sur", "tandis", "tous", "tout", "très", "un", "une", "vers",
        "vous", "y",
    ),
    "es": (
        "a", "al", "algo", "ante", "antes", "aquí", "así", "aun", "aunque", "cada", "como", "con", "contra", "cual", "cuando", "de", "del", "desde", "donde", "dos", "durante", "e", "el", "ella", "ellos", "en", "entre", "era",
        "es", "esa", "ese", "eso", "esta", "este", "esto", "fue", "ha", "hasta", "hay", "la", "las", "le", "les", "lo", "los", "más", "me", "mientras", "muy", "ni", "no", "nos", "o", "otra", "otro", "para", "pero", "poco",
        "por", "porque", "pues", "que", "qué", "quien", "se", "según", "ser", "si", "sin", "sino", "sobre", "son", "su", "sus", "también", "tan", "tanto", "te", "tiene", "todo", "tras", "tu", "un", "una", "uno", "y", "ya",
    ),
}
SCARCE = 4.0  # standard deviations that the share of function words lies below that of prose
CONCENTRATED = 11.5  # root of the likelihood ratio over a hundred function words, with half the extremity of the curve


def _language_mask(w: Column) -> Column:
    return reduce(lambda mask, iw: mask.bitwiseOR(F.when(w.isin(*iw[1]), 1 << iw[0]).otherwise(0)), enumerate(FUNCTION_WORDS.values()), F.lit(0))


def curves(documents: DataFrame) -> DataFrame:
    """One row per page: n_tokens, n_types, slope and residual of its curve, language and function words with their counts.

    Only the texts are shuffled, once, by page; words are counted and ranked where they land."""
    pages = documents.select("doc_id", "text").filter(F.trim("text") != "").groupBy("doc_id").agg(F.min("text").alias("text"))
    words = pages.select("doc_id", F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("w")).filter("w <> ''")
    counted = words.groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("n")).withColumn("mask", _language_mask(F.col("w")))
    seen = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) > 0, F.log1p("n")).otherwise(0.0)).alias(lang) for i, lang in enumerate(FUNCTION_WORDS)]
    listed = F.collect_list(F.when(F.col("mask") > 0, F.struct("w", "n", "mask"))).alias("listed")
    spectrum = counted.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("types"), listed, *seen)
    # types of equal frequency share the middle of their ranks
    upto = F.sum("types").over(Window.partitionBy("doc_id").orderBy(F.col("n").desc()))
    ranked = spectrum.withColumn("rank", upto - (F.col("types") - 1) / 2)
    x, y = F.ln("rank"), F.ln("n")
    langs = list(FUNCTION_WORDS)
    best = F.element_at(F.array_sort(F.array(*[F.struct((-F.col(c)).alias("k"), F.lit(i).alias("i")) for i, c in enumerate(langs)])), 1)["i"]
    fitted = ranked.groupBy("doc_id").agg(
        F.sum(F.col("n") * F.col("types")).alias("n_tokens"), F.sum("types").alias("n_types"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.sqrt(F.coalesce(F.regr_syy(y, x) - F.regr_sxy(y, x) * F.regr_slope(y, x), F.lit(0.0)).cast("double")).alias("residual"),
        F.flatten(F.collect_list("listed")).alias("listed"), *[F.sum(lang).alias(lang) for lang in langs],
    ).withColumn("best", F.when(F.greatest(*langs) > 0, best))
    return fitted.select(
        "doc_id", "n_tokens", "n_types", "slope", F.when(F.col("residual").isNaN(), 0.0).otherwise(F.col("residual")).alias("residual"),
        F.get(F.array(*[F.lit(c) for c in langs]), F.col("best")).alias("language"),
        F.transform(F.filter("listed", lambda s: F.get(F.array(*[s["mask"].bitwiseAND(1 << i) for i in range(len(langs))]), F.col("best")) > 0), lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"))).alias("words"),
        F.floor(F.log2(F.col("n_tokens"))).cast("int").alias("size_class"),
    ).withColumn("words", F.coalesce("words", F.array().cast("array<struct<w:string,n:bigint>>")))


def prose(fitted: DataFrame) -> DataFrame:
    """(language, other, shares): per language the mean over its pages of the share of each function word and of all
    other words, so that a long page counts like a short one; a row without language holds the means over all. As many rows as languages, as many shares as listed words."""
    part = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, x: s + x["n"]) / F.col("n_tokens")
    totals = fitted.groupBy("language").agg(F.count(F.lit(1)).alias("pages"), F.sum(part).alias("function"))
    per_word = fitted.filter("language is not null").select("language", "n_tokens", F.explode("words").alias("x")).groupBy("language", "x.w").agg(F.sum(F.col("x.n") / F.col("n_tokens")).alias("share"))
    shares = per_word.join(totals, "language").groupBy("language").agg(F.map_from_entries(F.collect_list(F.struct("w", F.col("share") / F.col("pages")))).alias("shares"))
    known = totals.filter("language is not null")
    one = known.join(shares, "language").select("language", (1 - F.col("function") / F.col("pages")).alias("other"), "shares")
    every = known.agg(F.sum("function").alias("function"), F.sum("pages").alias("pages")).filter("pages > 0")
    return one.unionByName(every.select(F.lit(None).cast("string").alias("language"), (1 - F.col("function") / F.col("pages")).alias("other"), F.create_map().cast("map<string,double>").alias("shares")))


def scored(fitted: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, language, slope, residual, scarcity, concentration, extremity) of each page.

    What is broadcast has one row per language, or per language and power of two of words, whatever the input."""
    usual = fitted.groupBy("language", "size_class").agg(*[F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"{c}_q") for c in ("slope", "residual")])
    far = lambda c: (F.col(c) - F.col(f"{c}_q")[1]) / F.greatest(F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0], F.lit(0.02))
    norm = F.broadcast(prose(fitted).withColumnRenamed("language", "of_language"))
    usual = F.broadcast(usual.withColumnsRenamed({"language": "u_language", "size_class": "u_class"}))
    both = (
        fitted.join(norm, F.col("language").eqNullSafe(F.col("of_language")), "left")
        .join(usual, F.col("language").eqNullSafe(F.col("u_language")) & (F.col("size_class") == F.col("u_class")))
    )
    n = F.col("n_tokens")
    tokens = F.aggregate("words", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    kept = F.greatest(F.col("other"), F.lit(1e-6))
    rest, part = 1 - tokens / n, tokens / n
    rest_term = F.when(rest > 0, rest * F.ln(rest / kept)).otherwise(0.0)
    binary = F.when(rest > kept, rest_term + F.when(part > 0, part * F.ln(part / (1 - kept))).otherwise(0.0)).otherwise(0.0)
    every = F.aggregate("words", F.lit(0.0), lambda s, x: s + x["n"] / n * F.ln(x["n"] / n / F.col("shares")[x["w"]])) + rest_term
    root = lambda d: F.sqrt(2 * n * F.greatest(d, F.lit(0.0)))
    return both.select(
        "doc_id", "n_tokens", "language", "slope", "residual", F.coalesce(root(binary), F.lit(0.0)).alias("scarcity"), F.coalesce(root(every), F.lit(0.0)).alias("concentration"),
        F.greatest(F.abs(far("slope")), far("residual")).alias("extremity"),
    )


def spam_pages(documents: DataFrame) -> DataFrame:
    """The scores of the pages reported."""
    pages = scored(checkpoint(curves(documents)))
    return pages.filter((F.col("scarcity") > SCARCE) | (F.col("concentration") + F.col("extremity") / 2 > CONCENTRATED))
