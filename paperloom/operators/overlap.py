"""Exact overlaps of word sets: an index of bits, asked by bit-sliced counting, in place of a join on words.

Where words are few and frequent, a join on shared words gives nearly all pairs. Here the items are sorted and
packed, per word, as the bits or positions of the items that have it; the packed index is a small part of the
texts and is copied to ``slices`` tasks. Each of them counts, for its share of the queries, the shared words of
all items of a block at once, by adding the bits of the query's words, so that no pair is written but results.
Blocks bound the memory; the work is that of all pairs, at some hundredths of a nanosecond a pair and word.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import checkpoint

BLOCK = 1 << 20  # items of a block, about
PIECE = 1 << 16  # items that are packed at a time at most, so that a position takes two bytes
KEPT = 1 << 14  # answers that are kept for queries of the same words, at most

Slices = list[np.ndarray]
_ROW = "piece long, at int, word string, n int, bits binary, idents binary, ranks array<int>, sizes array<int>"


def packed(items: DataFrame, words: Column, pieces: int) -> DataFrame:
    """The index of items (ident string, rank int, and what ``words`` is made from) in pieces of bits, sorted by ident.

    One row of each piece, without a word, has its items. Items of one ``ident`` are one, and a word that several of them have counts as often."""

    def emit(at: int, number: int, idents: pa.Array, ranks: np.ndarray, rows: np.ndarray, words: pa.Array) -> pa.RecordBatch:
        """The bits of one piece; row i of the words belongs to item ``rows[i]``."""
        n, coded = len(idents), words.dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        by = np.lexsort((rows, codes))
        codes, rows = codes[by], rows[by]
        # how often the item has had the word before: each time is a layer of bits
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
        layer = np.arange(len(codes)) - np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0))
        by = np.lexsort((rows, layer, codes))
        codes, rows, layer = codes[by], rows[by], layer[by]
        starts = np.flatnonzero(np.r_[True, (codes[1:] != codes[:-1]) | (layer[1:] != layer[:-1])]) if len(codes) else np.zeros(0, np.int64)
        counts, bits = [], []
        for a, b in zip(starts, np.r_[starts[1:], len(codes)], strict=True):
            if (b - a) * 16 > n:
                flat = np.zeros(n, np.uint8)
                flat[rows[a:b]] = 1
                counts.append(-1)
                bits.append(zlib.compress(np.packbits(flat, bitorder="little").tobytes(), 1))
            else:
                counts.append(b - a)
                bits.append(zlib.compress(rows[a:b].astype(np.uint16).tobytes(), 1))
        k, spread = len(starts), np.bincount(rows, minlength=n) if len(rows) else np.zeros(n, np.int64)
        own = lambda values, kind: pa.array([values, *[None] * k], pa.list_(kind))
        cols = [
            pa.array([(at << 32) + number] * (k + 1), pa.int64()), pa.array(np.r_[0, layer[starts]], pa.int32()), pa.array([None, *coded.dictionary.take(pa.array(codes[starts])).to_pylist()], pa.string()), pa.array([n, *counts], pa.int32()),
            pa.array([None, *bits], pa.binary()), pa.array([zlib.compress(json.dumps(idents.to_pylist()).encode(), 1), *[None] * k], pa.binary()), own(ranks, pa.int32()), own(spread, pa.int32()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in _ROW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        number, part = 0, 0
        for b in (*batches, None):
            if b is not None:
                if not b.num_rows:
                    continue
                part = b.column(0)[0].as_py()
                held = pa.Table.from_batches([b] if held is None else [*held.to_batches(), b])
                if held.num_rows < PIECE:
                    continue
            while held is not None and held.num_rows:
                idents = held.column("ident").combine_chunks()
                coded = idents.dictionary_encode().indices.to_numpy(zero_copy_only=False)
                item = np.cumsum(np.r_[0, coded[1:] != coded[:-1]])
                # the last item may go on in the next batch
                end = held.num_rows if b is None else int(np.searchsorted(item, item[-1]))
                end = min(end, int(np.searchsorted(item, PIECE)))
                if not end:
                    break
                words = held.column("words").combine_chunks().slice(0, end)
                firsts = pa.array(np.searchsorted(item[:end], np.arange(item[end - 1] + 1)))
                lengths = np.diff(words.offsets.to_numpy())
                yield emit(part, number, idents.take(firsts), held.column("rank").combine_chunks().take(firsts).to_numpy(zero_copy_only=False), np.repeat(item[:end], lengths), words.flatten())
                number, held = number + 1, held.slice(end)
                if b is not None and held.num_rows < PIECE:
                    break

    # words are made behind the sort, whose sample reads all rows once more
    placed = items.repartitionByRange(pieces, "ident").sortWithinPartitions("ident").select(F.spark_partition_id().alias("part"), "ident", "rank", words.alias("words")).filter("words is not null")
    return placed.mapInArrow(run, _ROW)


class Index:
    """The items of one block, in order, and the bits of each word."""

    def __init__(self) -> None:
        self.idents: list[str] = []
        self._ranks: list[int] = []
        self._sizes: list[int] = []
        self._parts: dict[str, dict[int, list[tuple[int, int, bytes]]]] = {}
        self._start, self._n = 0, 0
        self._bits: dict[str, list[np.ndarray]] = {}
        self._tops: dict[tuple, list[tuple[int, int]]] = {}

    def add(self, at: int, word: str | None, n: int, bits: bytes | None, idents: bytes | None, ranks: list, sizes: list) -> None:
        """One row of the index; the row of a piece's items comes first."""
        if word is None:
            # a piece begins at a whole word of bits
            fill = -len(self.idents) % 64
            self.idents += [""] * fill + json.loads(zlib.decompress(idents))
            self._ranks += [-1] * fill + ranks
            self._sizes += [0] * fill + sizes
            self._start, self._n = len(self.idents) - n, n
        else:
            self._parts.setdefault(word, {}).setdefault(at, []).append((self._start, self._n if n < 0 else -n, bits))

    def close(self) -> None:
        self.ranks, self.sizes = np.array(self._ranks, np.int32), np.array(self._sizes, np.int32)
        self.length = (len(self.idents) + 63) // 64

    def _dense(self, parts: list[tuple[int, int, bytes]]) -> np.ndarray:
        out = np.zeros(self.length * 8, np.uint8)
        for start, n, bits in parts:
            if n >= 0:
                raw = np.frombuffer(zlib.decompress(bits), np.uint8)
                out[start // 8 : start // 8 + len(raw)] |= raw
            else:
                at = np.frombuffer(zlib.decompress(bits), np.uint16).astype(np.int64) + start
                np.bitwise_or.at(out, at >> 3, (1 << (at & 7)).astype(np.uint8))
        return out.view(np.uint64)

    def word(self, w: str) -> list[np.ndarray]:
        """The bits of the items that have a word once, twice and so on."""
        if w not in self._bits:
            layers = self._parts.get(w)
            made = [self._dense(layers[k]) for k in sorted(layers)] if layers else []
            # rare words are unpacked each time, so that all words together take what the index takes
            if any(sum(len(p[2]) for p in parts) * 8 < self.length for parts in (layers or {}).values()):
                return made
            self._bits[w] = made
        return self._bits[w]

    def counts(self, words: list[str]) -> Slices:
        """Bit slices, lowest first, of how many of the words each item has, by a tree of adders of three bits."""
        todo, slices = [bits for w in words for bits in self.word(w)], []
        while todo:
            above = []
            while len(todo) > 1:
                a, b = todo.pop(), todo.pop()
                half, both = a ^ b, a & b
                if todo:
                    c = todo.pop()
                    both |= half & c
                    half ^= c
                todo.insert(0, half)
                above.append(both)
            slices.append(todo[0])
            todo = above
        while slices and not slices[-1].any():
            slices.pop()
        return slices


def positions(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """The positions of the bits that are set, in order, the first ``most``."""
    at = np.flatnonzero(mask)
    if most is not None:
        at = at[:most]
    row, bit = np.nonzero(np.unpackbits(mask[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    out = at[row] * 64 + bit
    return out if most is None else out[:most]


def top(index: Index, words: list[str], most: int) -> list[tuple[int, int]]:
    """(position, shared) of the first ``most`` items by shared words, then by position, of those that share any."""
    key = (most, *sorted(words))
    if key in index._tops:
        return index._tops[key]
    slices, out = index.counts(words), []
    todo = [(None, 0, len(slices) - 1)]
    # the highest counts first: with the highest slice's bit before without it
    while todo and len(out) < most:
        mask, count, i = todo.pop()
        if i < 0:
            if count:
                out += [(int(p), count) for p in positions(mask, most - len(out))]
            continue
        for bit in (0, 1):
            part = slices[i] if bit else ~slices[i]
            part = part if mask is None else mask & part
            if (bit or count or i) and part.any():
                todo.append((part, count + (bit << i), i - 1))
    if len(index._tops) >= KEPT:
        index._tops.clear()
    index._tops[key] = out
    return out


def at_least(slices: Slices, count: int) -> np.ndarray | None:
    """The bits of the items with that count or more, which is at least 1; None where none can have it."""
    if count >> len(slices):
        return None
    above, equal = None, None
    for i in range(len(slices) - 1, -1, -1):
        if count >> i & 1:
            equal = slices[i] if equal is None else equal & slices[i]
        else:
            more = slices[i] if equal is None else equal & slices[i]
            above = more if above is None else above | more
            equal = ~slices[i] if equal is None else equal & ~slices[i]
    return equal if above is None else above | equal


def similar(index: Index, words: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(positions, similarities) of the items with a Jaccard similarity of ``least`` or more."""
    n, slices = len(words), index.counts(words)
    # two sets that similar share at least that part of the larger one
    mask = at_least(slices, max(1, int(np.ceil(n * least - 1e-9)))) if slices else None
    if mask is None:
        return np.zeros(0, np.int64), np.zeros(0)
    at = positions(mask)
    shared = np.zeros(len(at), np.int32)
    for i, s in enumerate(slices):
        shared += ((s[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int32) << i
    s = shared / (n + index.sizes[at] - shared)
    good = s >= least
    return at[good], s[good]


Found = list[tuple[str, int, float]]


def asked(items: DataFrame, words: Column, queries: DataFrame, search: Callable[[Index, str, list[str]], Found], slices: int | None = None, block: int = BLOCK, merge: Callable[[Found, Found], Found] | None = None) -> tuple[DataFrame, int]:
    """(query, ident, rank, value) that ``search`` gives for each query (query string, words array<string>) in each block of the items; the number of blocks.

    Rows of one query are one, with the words of all of them. With ``merge``, a task goes through all blocks, in the
    order of their idents, and of each query only that is given which ``merge`` leaves of the blocks before and the next one."""
    spark = items.sparkSession
    slices = slices or max(1, spark.sparkContext.defaultParallelism)
    n = items.count()
    # no more blocks than the items need: each has the queries copied once
    blocks = max(1, -(-n // block))
    pieces = blocks * max(1, min(-(-slices // blocks), n // 256))
    index = checkpoint(packed(items, words, pieces))
    # words that no query has are not copied
    used = queries.select(F.explode("words").alias("word")).distinct()
    index = index.filter("word is null").unionByName(index.join(used, "word", "left_semi"))
    home = F.floor(F.shiftright("piece", 32) * blocks / pieces).cast("int")
    kinds = [c.split() for c in _ROW.split(", ")]
    names, rows = [c for c, _ in kinds], ["block", *[c for c, _ in kinds], "query", "asked"]
    left = index.select(home.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), *names, F.lit(None).cast("string").alias("query"), F.lit(None).cast("string").alias("asked"))
    # behind all pieces of the index
    nulls = [F.lit(1 << 62).cast("long").alias("piece"), *[F.lit(None).cast(kind).alias(c) for c, kind in kinds[1:]]]
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.pmod(F.xxhash64("query"), F.lit(slices)).cast("int").alias("slice"), *nulls, "query", F.to_json("words").alias("asked"))
    both = left.unionByName(right).withColumn("task", F.col("slice") if merge else F.col("block") * slices + F.col("slice"))
    placed = both.repartitionById(slices if merge else blocks * slices, F.col("task")).sortWithinPartitions("block", "piece", F.col("word").asc_nulls_first(), "query").select(*rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, last, words = Index(), None, None, []
        best: dict[str, Found] = {}

        def answer() -> list[tuple]:
            if last is None:
                return []
            found = search(index, last, words)
            if merge and blocks > 1:
                found = merge(best.pop(last, []), found)
                if at < blocks - 1:
                    best[last] = found
                    return []
            return [(last, *r) for r in found]

        for b in batches:
            out: list[tuple] = []
            for of, *row, query, asks in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if of != at:
                    out += answer()
                    index, at, last, words = Index(), of, None, []
                if query is None:
                    index.add(*row[1:])
                    continue
                asks = json.loads(asks)
                if query == last:
                    words = words + asks
                else:
                    if last is None:
                        index.close()
                    else:
                        out += answer()
                    last, words = query, asks
            yield _found(out)
        yield _found(answer())

    return placed.mapInArrow(run, "query string, ident string, rank int, value double"), blocks


def _found(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["query", "ident", "rank", "value"])
