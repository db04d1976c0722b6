"""Noise in text from scanned pages: broken words, misread characters, page furniture.

Three passes. The first counts the words of scanned and of other texts. The second finds furniture
and broken words line by line, and the words that are not among the most frequent ones. These are
looked up in the vocabulary of all texts: vocabulary words are sharded by length and a segment
into tries, and an automaton that allows one misreading (a character for another, one
for two or two for one, one too many or too few) is intersected with each trie, so that every
candidate within that distance is found. Which misreadings are believed is learned from all texts:
the edits that turn many different unknown words into far more frequent known ones. Candidates are
ranked by the misreading's frequency, by how often the word occurs, and where several remain, by how
often each follows the word before it in all texts.
Blanks inside words are found as neighbours of which one is unknown and whose joined form is known.

``found_lines`` reports the damaged lines; ``repaired`` gives the texts without the damage.

Defined results: null, empty and blank texts and texts without any furniture or broken words have no
damaged lines; exact duplicate rows count once; lines are parts between '\\n', so '\\r' and form feeds
belong to their line; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from paperloom.llm.tries import trie_join
from paperloom.runtime import checkpoint, small_enough

KEY = ["item_table", "citation_key"]
FREQUENT = 4096  # words every worker knows; a fixed bound, the rest is joined
KNOWN = 2  # times a word occurs in texts that are not scanned
PROPER = 0.125  # of its share of the words of scanned texts, what a word has at least of the words of other texts
MAX_HEADERS = 100_000  # names of venues that may be given to every worker; more are joined
MAX_RIVALS = 200_000  # words that rival for a form that may be given to every worker; for more all neighbours are counted

_WORD = re.compile(r"[^\W_]+(?:[!(][^\W\d_]+)*")
_BROKEN = re.compile(r"([^\W\d_]+)[-¬­‐‑]\s*$")
_FORMS = re.compile(
    r"\s*(?:\d+ \| \S.*|\S.* \| \d+|Downloaded from \S.*|Page \d+ of \d+|p\. ?\d+|[-–—] ?\d+ ?[-–—]|\[\d+\]|doi:\S+|\S.*: running title|\S.* et al\. / \S.*|\S.* / .+ \(\d{4}\))\s*$", re.I
)
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"\s*\d{1,5}\s*$")
_FIGURES = re.compile(r"[\d.,\s%]+$")
#: Words after a hyphen that stands for an omitted second part.
SUSPENDED = frozenset("and or to und oder bis et ou y o".split())
#: Signs that do not stand in words, and the letters they are misread from.
SIGNS, LETTERS = "à015968!(", "aolsgbbic"
_FOLD = str.maketrans({"0": "o", "1": "l", "5": "s", "9": "g", "!": "i", "(": "c"})


def fold(line: str) -> str:
    """A header for comparison: misread letters, case and a page number at either end away."""
    s = line.strip().lower()
    s = re.sub(r"^\d+\s+|\s+\d+$", "", s).translate(_FOLD)
    return unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()


def furniture(lines: list[str], headers: frozenset[str]) -> set[int]:
    """Indexes of running headers, footers and page numbers."""
    out = set()
    text = [i for i, line in enumerate(lines) if line.strip()]
    longest = max(map(len, headers), default=0) + 12
    # furniture fits on a line as the text has them
    widest = max(160, 2 * sorted(len(lines[i]) for i in text)[len(text) // 2]) if text else 0
    for k, i in enumerate(text):
        line = lines[i]
        bare = line.lstrip()
        # lines of running text, which are most, are told by their first letter
        if len(line) > widest or (bare[0].islower() and not (bare.startswith(("p.", "doi:")) or "/" in bare or "running title" in bare)):
            continue
        if ((_DIGIT.search(bare) or "running title" in bare) and _FORMS.match(line)) or (len(bare) <= longest and fold(line) in headers):
            out.add(i)
        elif len(bare) < 12 and _NUMBER.match(line):
            # a page number stands alone; figures of a table stand among figures and short labels
            above, below = (lines[text[k - 1]].strip() if k else ""), (lines[text[k + 1]].strip() if k + 1 < len(text) else "")
            if "\f" in line or (above and not _FIGURES.match(above) and not _FIGURES.match(below) and len(above) > 12):
                out.add(i)
    return out


def broken(lines: list[str], skip: set[int]) -> list[tuple[int, str, int, str]]:
    """(line, first part, next line of text, second part) of words that go on beyond the line's end."""
    text = [i for i, line in enumerate(lines) if i not in skip and line.strip()]
    out = []
    for i, j in zip(text, text[1:], strict=False):
        if lines[i].rstrip()[-1] not in "-¬\u00ad\u2010\u2011":
            continue
        left = _BROKEN.search(lines[i])
        if left:
            right = re.match(r"\s*([^\W_]+(?:[!(][^\W\d_]+)*)", lines[j])
            if right and not (right[1].lower() in SUSPENDED and left[1].lower() not in ("",)):
                out.append((i, left[1], j, right[1]))
    return out


def is_scan(skip: set[int], breaks: list) -> bool:
    """Scanned: page furniture or words broken at a line's end; texts wrapped by a program have neither."""
    return bool(skip) or bool(breaks)


def _look(text: str, headers: frozenset[str]) -> tuple[list[str], set[int], list, bool]:
    lines = text.split("\n")
    skip = furniture(lines, headers)
    breaks = broken(lines, skip)
    return lines, skip, breaks, is_scan(skip, breaks)


def scan_words(lines: list[str], skip: set[int], breaks: list) -> Iterator[str]:
    """Words of a scanned text without its furniture, broken words joined."""
    heads, tails = {i: (left + right).lower() for i, left, _, right in breaks}, {j for _, _, j, _ in breaks}
    for i, line in enumerate(lines):
        if i not in skip:
            words = _WORD.findall(line.lower())
            if i in heads and words:
                words[-1] = heads[i]
            yield from words[1:] if i in tails else words


def _texts(b: pa.RecordBatch, headers: frozenset[str] | None, at: int) -> Iterator[tuple[str | None, frozenset[str]]]:
    """Each text of a batch with the headers to look for: those given to every worker, or its own of the column behind it."""
    own = b.column(at + 1).to_pylist() if headers is None else [None] * b.num_rows
    for text, heads in zip(b.column(at).to_pylist(), own, strict=True):
        yield text, frozenset(heads or ()) if headers is None else headers


def word_counts(texts: DataFrame, headers: frozenset[str] | None) -> DataFrame:
    """(word, clean, scanned): how often each word occurs in texts of either kind; summed within batches first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = (Counter(), Counter())
        for b in batches:
            for t, heads in _texts(b, headers, 0):
                lines, skip, breaks, scan = _look(t, heads)
                totals[scan].update(scan_words(lines, skip, breaks) if scan else _WORD.findall(t.lower()))
            if len(totals[0]) + len(totals[1]) > 300_000:
                yield from emit(totals)
                totals = (Counter(), Counter())
        yield from emit(totals)

    def emit(totals: tuple[Counter, Counter]) -> Iterator[pa.RecordBatch]:
        words = list(totals[0].keys() | totals[1].keys())
        for k in range(0, len(words), 100_000):
            part = words[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([totals[0][w] for w in part], pa.int64()), pa.array([totals[1][w] for w in part], pa.int64())], names=["word", "clean", "scanned"])

    counted = texts.select("text", "heads").mapInArrow(run, "word string, clean bigint, scanned bigint")
    return counted.groupBy("word").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned"))


def following(texts: DataFrame, headers: frozenset[str] | None, words: frozenset[str] | None) -> DataFrame:
    """(before, word, n): how often each of the words (None: each word) follows another, broken words joined."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for t, heads in _texts(b, headers, 0):
                lines, skip, breaks, scan = _look(t, heads)
                before = None
                for w in scan_words(lines, skip, breaks) if scan else _WORD.findall(t.lower()):
                    if before is not None and (words is None or w in words):
                        total[before, w] += 1
                    before = w
            if len(total) > 300_000:
                yield from emit(total)
                total = Counter()
        yield from emit(total)

    def emit(total: Counter) -> Iterator[pa.RecordBatch]:
        pairs = list(total)
        for k in range(0, len(pairs), 100_000):
            part = pairs[k : k + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.string()), pa.array([x[1] for x in part], pa.string()), pa.array([total[x] for x in part], pa.int64())], names=["before", "word", "n"])

    return texts.select("text", "heads").mapInArrow(run, "before string, word string, n bigint").groupBy("before", "word").agg(F.sum("n").alias("n"))


def line_facts(texts: DataFrame, headers: frozenset[str] | None, frequent: frozenset[str]) -> DataFrame:
    """Of scanned texts: furniture lines, broken words, and per line the words that are not frequent.

    kind 'furniture' and 'hyphen' are results; 'word' has a form to look up, 'join' two neighbours
    and their joined form. ``cut`` is the length of the part on this line of a broken word."""
    names = [*KEY, "line_no", "next_no", "kind", "form", "left", "right", "before"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for table, key, (text, own) in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), _texts(b, headers, 2), strict=True):
                lines, skip, breaks, scan = _look(text, own)
                if not scan:
                    continue
                heads = {i: (left, j, right) for i, left, j, right in breaks}
                tails = {j for _, _, j, _ in breaks}

                def add(no, kind, form=None, left=None, right=None, nxt=None, before=None, table=table, key=key):
                    for c, v in zip(rows, (table, key, no + 1, nxt, kind, form, left, right, before), strict=True):
                        c.append(v)

                for i, line in enumerate(lines):
                    if i in skip:
                        add(i, "furniture")
                        continue
                    words = _WORD.findall(line.lower())
                    if i in heads:
                        left, j, right = heads[i]
                        add(i, "hyphen", left=left, right=right)
                        add(i, "word", (left + right).lower(), left.lower(), right.lower(), j + 1, words[-2] if len(words) > 1 else None)
                        words = words[:-1]
                    if i in tails:
                        words = words[1:]
                    known = [w in frequent for w in words]
                    for k, w in enumerate(words):
                        if not known[k] and len(w) > 1 + w.isalpha():
                            add(i, "word", w, before=words[k - 1] if k else None)
                        if k and not (known[k] and known[k - 1]) and words[k - 1].isalpha() and w.isalpha() and f"{words[k - 1]} {w}" in line.lower():
                            add(i, "join", words[k - 1] + w, words[k - 1], w)
            types = [pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

    return texts.select(*KEY, "text", "heads").mapInArrow(run, "item_table string, citation_key string, line_no int, next_no int, kind string, form string, left string, right string, before string")


def misread(root: dict, form: str) -> set[tuple[str, str]]:
    """(word, 'seen>meant') of all words of the trie that are one misreading away from ``form``."""
    out = set()

    def rest(node: dict, i: int, edit: str) -> None:
        for ch in form[i:]:
            node = node.get(ch)
            if node is None:
                return
        if "" in node:
            out.add((node[""], edit))

    node, n = root, len(form)
    for i in range(n + 1):
        seen, two = form[i : i + 1], form[i : i + 2]
        if seen:
            rest(node, i + 1, f"{seen}>")
        for ch, below in node.items():
            if not ch:
                continue
            if seen and ch != seen:
                rest(below, i + 1, f"{seen}>{ch}")
            rest(below, i, f">{ch}")
            if len(two) == 2:
                rest(below, i + 2, f"{two}>{ch}")
            if seen:
                for c2, deep in below.items():
                    if c2:
                        rest(deep, i + 1, f"{seen}>{ch}{c2}")
        if not seen:
            break
        node = node.get(seen)
        if node is None:
            break
    return {(w, e) for w, e in out if w != form}


def candidates(forms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(form, n_form, word, n_word, edit) of all vocabulary words one misreading away from each form.

    A form with signs that do not stand in words is also looked up with the letters meant by them."""
    plain = F.translate("form", SIGNS, LETTERS)
    looked = forms.select("form", "n_form", F.explode(F.array_distinct(F.array(F.col("form"), F.when(F.col("form").rlike("[^0-9]{2}"), plain).otherwise(F.col("form"))))).alias("seen"))
    found = trie_join(looked.select(F.col("seen").alias("a")).distinct(), vocabulary.select(F.col("word").alias("b")), 1, misread)
    signs = looked.filter("seen <> form").select("form", "n_form", F.col("seen").alias("word"), F.lit("sign").alias("edit")).join(vocabulary, "word")
    # where the letters meant make a word, a further misreading of them would be a second one
    told = signs.select(F.col("form").alias("told")).distinct()
    near = looked.join(told, (F.col("form") == F.col("told")) & (F.col("seen") != F.col("form")), "left_anti").join(found.withColumnRenamed("a", "seen"), "seen").select("form", "n_form", F.col("b").alias("word"), "edit")
    return near.distinct().join(vocabulary, "word").select("form", "n_form", "word", "n_word", "edit").unionByName(signs.select("form", "n_form", "word", "n_word", "edit"))


def ranked(found: DataFrame, min_forms: float = 0.0005) -> DataFrame:
    """(form, word, edit, score): the candidates of each misread form by a believed misreading.

    A misreading is believed if it explains at least ``min_forms`` of all forms that have an
    explanation; the count is of different forms, so one frequent word cannot carry it."""
    likely = found.filter(F.col("n_word") >= 5 * F.col("n_form"))
    edits = likely.groupBy("edit").agg(F.count_distinct("form").alias("forms"))
    total = edits.agg(F.sum("forms").alias("total"))
    # the believed ones are at most 1 / min_forms
    believed = edits.join(F.broadcast(total), F.lit(True)).filter((F.col("forms") >= 3) & (F.col("forms") >= min_forms * F.col("total")))
    scored = likely.join(F.broadcast(believed), "edit").withColumn("score", F.ln("forms") + 0.5 * F.ln("n_word"))
    return scored.groupBy("form", "word").agg(F.max("score").alias("score"), F.max_by("edit", F.struct("score", "edit")).alias("edit"))


def corrections(scored: DataFrame) -> DataFrame:
    """(form, word, edit): the best candidate of each form, its neighbours aside."""
    best = F.row_number().over(Window.partitionBy("form").orderBy(F.col("score").desc(), "word"))
    return scored.withColumn("r", best).filter("r = 1").select("form", "word", "edit")


def in_context(words: DataFrame, scored: DataFrame, texts: DataFrame, headers: frozenset[str] | None, reach: float = 3.0, weight: float = 1.5) -> DataFrame:
    """(form, before, word): the best candidate of each form behind each word, where candidates within ``reach`` of the best rival."""
    by_form = Window.partitionBy("form")
    rivals = scored.withColumn("top", F.max("score").over(by_form)).filter(F.col("score") >= F.col("top") - reach).withColumn("k", F.count(F.lit(1)).over(by_form)).filter("k > 1").select("form", "word", "score")
    rivals = checkpoint(rivals)
    asked = rivals.select("word").distinct()
    only = frozenset(r[0] for r in asked.collect()) if small_enough(asked, MAX_RIVALS) else None
    places = words.filter(F.col("before").isNotNull()).select("form", "before").distinct().join(rivals, "form")
    seen = places.join(following(texts, headers, only), ["before", "word"], "left")
    total = F.col("score") + weight * F.log1p(F.coalesce("n", F.lit(0)))
    return seen.groupBy("form", "before").agg(F.max_by("word", F.struct(total, "word")).alias("word"))


def known_words(counts: DataFrame) -> DataFrame:
    """(word, clean) of the words that texts without damage have too.

    Some scanned texts show neither furniture nor broken words and count as clean, so that any misreading is
    found in clean texts of a large collection. But it is rare there, compared with scanned texts, at any size."""
    total = counts.agg(F.sum("clean").cast("double").alias("all_clean"), F.sum("scanned").cast("double").alias("all_scanned"))
    proper = F.col("clean") * F.col("all_scanned") >= PROPER * F.col("scanned") * F.col("all_clean")
    return counts.filter(F.col("clean") >= KNOWN).join(F.broadcast(total), F.lit(True)).filter(proper).select("word", "clean")


def header_names(venues: DataFrame) -> frozenset[str] | None:
    """Folded names of venues, which stand in running headers; None where they are too many to be given to every worker."""
    names = [r[0] for r in venues.filter(F.col("venue").isNotNull()).select("venue").distinct().limit(MAX_HEADERS + 1).collect()]
    return None if len(names) > MAX_HEADERS else frozenset(fold(n) for n in names if n.strip())


def with_headers(texts: DataFrame, venues: DataFrame, headers: frozenset[str] | None) -> DataFrame:
    """The texts with the column ``heads``: of too many venues those whose folded name is a line of the text."""
    if headers is not None:
        return texts.withColumn("heads", F.lit(None).cast("array<string>"))

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([fold(v) for v in b.column(0).to_pylist()], pa.string())], names=["head"])

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(table, key, h) for table, key, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True) for h in {fold(x) for x in (text or "").split("\n")}]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=[*KEY, "head"])

    names = venues.filter(F.trim("venue") != "").select("venue").distinct().mapInArrow(folded, "head string").filter("head <> ''").distinct()
    found = texts.select(*KEY, "text").mapInArrow(lines, "item_table string, citation_key string, head string").join(names, "head")
    # bounded by the lines of a text
    heads = found.groupBy(*KEY).agg(F.collect_set("head").alias("heads")).withColumnsRenamed({c: f"_{c}" for c in KEY})
    same = F.col("item_table").eqNullSafe(F.col("_item_table")) & F.col("citation_key").eqNullSafe(F.col("_citation_key"))
    return texts.join(heads, same, "left").drop("_item_table", "_citation_key")


def analysed(texts: DataFrame, venues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, fixes): the facts of all lines, and for each damaged word its line, form and correction."""
    headers = header_names(venues)
    texts = with_headers(texts.filter(F.trim("text") != "").select(*KEY, "text").distinct(), venues, headers)
    counts = checkpoint(word_counts(texts, headers))
    known = checkpoint(known_words(counts))
    frequent = frozenset(r[0] for r in known.orderBy(F.col("clean").desc(), "word").limit(FREQUENT).select("word").collect())
    facts = checkpoint(line_facts(texts, headers, frequent))
    known = known.select("word")
    words = facts.filter("kind = 'word'")
    unknown = words.groupBy("form").agg(F.count(F.lit(1)).alias("n_form")).join(known.withColumnRenamed("word", "form"), "form", "left_anti")
    vocabulary = counts.filter((F.col("clean") >= KNOWN) | (F.col("scanned") >= 5)).filter(F.length("word") > 1).select("word", (F.col("clean") + F.col("scanned")).alias("n_word"))
    scored = checkpoint(ranked(candidates(unknown, vocabulary)))
    chosen = in_context(words, scored, texts, headers).withColumnRenamed("word", "meant")
    misread_words = (
        words.join(corrections(scored), "form").join(chosen, ["form", "before"], "left")
        .select(*KEY, "line_no", "next_no", "left", "form", F.coalesce("meant", "word").alias("word"))
    )
    joins = (
        facts.filter("kind = 'join'").select(*KEY, "line_no", "form", "left", "right")
        .join(known.withColumnRenamed("word", "form"), "form", "left_semi")
        .join(known.withColumnsRenamed({"word": "left"}).withColumn("know_left", F.lit(True)), "left", "left")
        .join(known.withColumnsRenamed({"word": "right"}).withColumn("know_right", F.lit(True)), "right", "left")
        .filter(F.col("know_left").isNull() | F.col("know_right").isNull())
        .select(*KEY, "line_no", F.lit(None).cast("int").alias("next_no"), F.lit(None).cast("string").alias("left"), F.concat_ws(" ", "left", "right").alias("form"), F.col("form").alias("word"))
    )
    return facts, misread_words.unionByName(joins)


def found_lines(texts: DataFrame, venues: DataFrame) -> DataFrame:
    """(item_table, citation_key, line_no, kind) of damaged lines of scanned texts."""
    facts, fixes = analysed(texts, venues)
    direct = facts.filter(F.col("kind").isin("furniture", "hyphen")).select(*KEY, "line_no", "kind")
    # a broken word's misread character lies on the line of the part that differs from the correction
    kept = F.col("next_no").isNotNull() & F.startswith("word", F.col("left"))
    read = fixes.select(*KEY, F.when(kept, F.col("next_no")).otherwise(F.col("line_no")).alias("line_no"), F.lit("ocr").alias("kind"))
    return direct.unionByName(read).distinct()


def reflowed(text: str, skip: set[int], breaks: list, fixes: dict[int, list[tuple[str, str]]]) -> str:
    """Continuous paragraphs of a scanned text: furniture out, broken words joined, misread ones mended."""
    lines = text.split("\n")
    joined = {i: (left, j, right) for i, left, j, right in breaks}
    tails = {j: right for _, _, j, right in breaks}
    out, open_ = [], False
    for i, line in enumerate(lines):
        if i in skip:
            continue
        body = re.sub(r"\s+", " ", line.replace("\f", " ")).strip()
        if not body:
            if not open_:
                out.append("\n\n")
            continue
        if i in tails:
            body = body[len(tails[i]) :].lstrip() if body.startswith(tails[i]) else body
        if i in joined:
            left, _, right = joined[i]
            body = _BROKEN.sub("", body) + left + right
        # joined parts first: a part on its own may have been taken for another word
        for seen, meant in sorted(fixes.get(i + 1, []), key=lambda f: " " not in f[0]):
            body = re.sub(rf"(?i)(?<!\w){re.escape(seen)}(?!\w)", lambda m, w=meant: w.capitalize() if m[0][:1].isupper() else w, body)
        open_ = i in joined
        if body:
            out.append(body if not out or out[-1].endswith(("\n", " ")) else ("" if re.match(r"[,.;:)]", body) else " ") + body)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n\n *", "\n\n", "".join(out))).strip()


def repaired(texts: DataFrame, venues: DataFrame) -> DataFrame:
    """(item_table, citation_key, text, scanned): every text, scanned ones repaired. A text's corrections are bounded by its words."""
    headers = header_names(venues)
    _, fixes = analysed(texts, venues)
    mends = fixes.groupBy(*KEY).agg(F.collect_list(F.struct("line_no", "form", "word")).alias("mends"))
    rows = with_headers(texts.select(*KEY, "text").filter(F.col("text").isNotNull()).distinct(), venues, headers).join(mends, KEY, "left").select(*KEY, "text", "heads", "mends")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done, kinds = [], []
            for (text, heads), mends_ in zip(_texts(b, headers, 2), b.column(4).to_pylist(), strict=True):
                _, skip, breaks, scan = _look(text, heads)
                by_line: dict[int, list] = {}
                for m in mends_ or []:
                    by_line.setdefault(m["line_no"], []).append((m["form"], m["word"]))
                done.append(reflowed(text, skip, breaks, by_line) if scan else text)
                kinds.append(scan)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string()), pa.array(kinds, pa.bool_())], names=[*KEY, "text", "scanned"])

    return rows.mapInArrow(run, "item_table string, citation_key string, text string, scanned boolean")
