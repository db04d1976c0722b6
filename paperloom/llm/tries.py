"""Joins of words within a bounded distance: sharded tries traversed with automata.

A word of the right side is cut into 2 d + 1 segments; d edits, each of which touches two characters next
to each other at most, leave one of them whole, moved by no more than the characters put in or left out.
So each word of the left side looks into the shards (length, segment) of its own substrings, and every
pair within the distance meets in at least one. A shard is read as a sorted stream: the words of the
right side, from which the trie is built, then those of the left side, along each of which an automaton
is run through the trie. A shard with too many words is split, so that memory is bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRIE = 50_000  # words of a shard that one trie holds; larger shards are split


def trie(words: Iterable[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = w
    return root


def one_edit(root: dict, word: str) -> set[str]:
    """``neighbours`` for the distance 1, where a path leaves the word once and then has to follow it to its end."""
    out: set[str] = set()

    def rest(node: dict, i: int) -> None:
        for ch in word[i:]:
            node = node.get(ch)
            if node is None:
                return
        if "" in node:
            out.add(node[""])

    node = root
    for i in range(len(word) + 1):
        ch = word[i : i + 1]
        if ch:
            rest(node, i + 1)
        for c, below in node.items():
            if c:
                rest(below, i)
                if ch and c != ch:
                    rest(below, i + 1)
                    if word[i + 1 : i + 2] == c and ch in below:
                        rest(below[ch], i + 2)
        if not ch or ch not in node:
            break
        node = node[ch]
    out.discard(word)
    return out


def neighbours(root: dict, word: str, distance: int = 1) -> set[str]:
    """All other words of the trie within ``distance`` edits: a character changed, added, left out or swapped with the next.

    The state of the automaton is the row of edit distances to all beginnings of ``word``, of which those above the
    distance are dropped; a branch ends where none is left."""
    if distance == 1:
        return one_edit(root, word)
    out: set[str] = set()
    n, far = len(word), distance + 1
    first = [min(i, far) for i in range(n + 1)]
    todo = [(root, first, None, "")]
    while todo:
        node, row, above, last = todo.pop()
        if "" in node and row[n] <= distance:
            out.add(node[""])
        for ch, below in node.items():
            if not ch:
                continue
            new = [min(row[0] + 1, far)]
            for i in range(1, n + 1):
                best = min(row[i] + 1, new[i - 1] + 1, row[i - 1] + (word[i - 1] != ch))
                if above is not None and i > 1 and word[i - 1] == last and word[i - 2] == ch:
                    best = min(best, above[i - 2] + 1)
                new.append(min(best, far))
            if min(new) <= distance or (last and min(row) <= distance):
                todo.append((below, new, row, ch))
    out.discard(word)
    return out


def segments(length: int, distance: int) -> list[tuple[int, int]]:
    """(start, size) of the parts that a word is cut into; none for words too short to be cut."""
    k = 2 * distance + 1
    if length < k:
        return []
    at = [length * i // k for i in range(k + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:], strict=False)]


def right_shards(word: str, distance: int) -> list[str]:
    n = len(word)
    return [f"{n} {i} {word[s : s + k]}" for i, (s, k) in enumerate(segments(n, distance))] or [str(n)]


def left_shards(word: str, distance: int) -> set[str]:
    n, out = len(word), set()
    for m in range(max(1, n - distance), n + distance + 1):
        cut, delta = segments(m, distance), n - m
        if not cut:
            out.add(str(m))
        for i, (s, k) in enumerate(cut):
            for x in range(-distance, distance + 1):
                if abs(x) + abs(delta - x) <= distance and 0 <= s + x <= n - k:
                    out.add(f"{m} {i} {word[s + x : s + x + k]}")
    return out


def _sharded(words: DataFrame, column: str, side: int, distance: int) -> DataFrame:
    """(shard, side, word) of the different words of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = right_shards if side == 0 else left_shards
        for b in batches:
            rows = [(s, w) for w in b.column(0).to_pylist() for s in shards(w, distance)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([side] * len(rows), pa.int32()), pa.array([r[1] for r in rows], pa.string())], names=["shard", "side", "word"])

    return words.select(column).filter(F.col(column) != "").mapInArrow(run, "shard string, side int, word string")


def _split(rows: DataFrame, limit: int) -> DataFrame:
    """The rows with (part, of_part): large shards are split on both sides, each part of one against all of the other."""
    hot = rows.groupBy("shard", "side").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit)
    if not hot.limit(1).count():
        return rows.withColumns({"left_part": F.lit(0), "right_part": F.lit(0)})
    parts = hot.groupBy("shard").agg(*[F.coalesce(F.max(F.when(F.col("side") == side, F.ceil(F.col("n") / limit))), F.lit(1)).cast("int").alias(name) for side, name in ((0, "rights"), (1, "lefts"))])
    both = rows.join(parts, "shard", "left").fillna(1, ["rights", "lefts"])
    own = lambda n: F.array(F.pmod(F.xxhash64("word"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    right = F.col("side") == 0
    return both.withColumn("left_part", F.explode(F.when(right, every("lefts")).otherwise(own("lefts")))).withColumn("right_part", F.explode(F.when(right, own("rights")).otherwise(every("rights")))).drop("rights", "lefts")


def trie_join(left: DataFrame, right: DataFrame, distance: int = 1, search: Callable[[dict, str], Iterable[tuple[str, str]]] | None = None, limit: int = TRIE) -> DataFrame:
    """(a, b, edit) for all words a of ``left`` and b of ``right``, columns of these names with different words, that ``search`` finds.

    ``search`` gives (word, edit) for a trie and a word; by default all other words within the distance. What it finds
    may differ in ``distance`` places of two characters at most on either side."""
    find = search or (lambda root, word: ((w, "") for w in neighbours(root, word, distance)))
    rows = _split(_sharded(right, "b", 0, distance).unionByName(_sharded(left, "a", 1, distance)), limit)
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    group = ["shard", "left_part", "right_part"]
    parted = rows.repartition(tasks, *group).sortWithinPartitions(*group, "side").select(*group, "side", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words, root = None, [], None
        for b in batches:
            out: list[tuple[str, str, str]] = []
            for *mark, side, word in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if mark != now:
                    now, words, root = mark, [], None
                if side == 0:
                    words.append(word)
                elif words:
                    root = root or trie(words)
                    out += [(word, w, e) for w, e in find(root, word)]
            out = list(set(out))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["a", "b", "edit"])

    return parted.mapInArrow(run, "a string, b string, edit string").distinct()
