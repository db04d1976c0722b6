"""Encoding of texts with a public byte-level BPE tokenizer, as a streaming transducer.

Pretokens are cut from blocks of text and released once two characters behind them are known,
which is all the pretoken pattern ever looks ahead. The bytes of a pretoken go through
``Transducer``: after each byte the last token of the encoding so far is determined, and tokens
are emitted as soon as every continuation must keep them. Decoding is the inverse: an incremental
state machine from token bytes to text. No special tokens are added or recognised.

Defined results: the list of ids of a null text and of an empty text is empty; blank texts and
marker strings are ordinary text; repeated rows are encoded each on their own; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import codecs
import os
from array import array
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the public pretoken pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKAHEAD = 2  # characters behind a pretoken that can still change it
BLOCK = 1 << 16  # characters of text looked at together
LONG = 512  # bytes from which a pretoken is not remembered
MEMORY = 400_000  # pretokens remembered by a worker
MAX_VOCABULARY = 16 << 20  # bytes of a vocabulary file that may be broadcast


def vocabulary_file(path: str | None = None) -> str:
    """The file of byte_bpe_50k ranks: a parameter, else PAPERLOOM_TOKENIZERS, else /opt/tokenizers."""
    return path or os.path.join(os.environ.get("PAPERLOOM_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(t): int(n) for t, n in (line.split() for line in data.splitlines() if line)}


class MergeList:
    """Ranks of the vocabulary with what the transducer derives from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.longest = max(map(len, ranks))
        self.lengths = sorted({len(t) for t in ranks})
        self._splits: dict[bytes, tuple[bytes, bytes] | None] = {}
        self._fits: dict[tuple[bytes, bytes], bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The merge that makes a token; None for a single byte."""
        if len(token) == 1:
            return None
        if token not in self._splits:
            own, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], own), i) for i in range(len(parts) - 1))
                if rank >= own:
                    raise ValueError(f"no merges lead to {token!r}")
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._splits[token] = parts[0], parts[1]
        return self._splits[token]

    @cached_property
    def bound(self) -> int:
        return self.lookahead()

    def lookahead(self) -> int:
        """Bytes after which a token is surely stable: the deepest chain of merges times the longest token."""
        depth: dict[bytes, int] = {}
        for token in sorted(self.ranks, key=lambda t: (len(t), t)):
            parts = self.split(token)
            depth[token] = 0 if parts is None else 1 + max(depth[parts[0]], depth[parts[1]])
        return max(depth.values()) * self.longest

    def fits(self, left: bytes, right: bytes) -> bool:
        """Whether the encoding of left + right is these two tokens, that is, no merge crosses their border.

        Both are taken apart along their merges, last merge first; a pair over the border that
        would have been merged before one of its sides was made forbids it."""
        key = left, right
        if key in self._fits:
            return self._fits[key]
        rank, limit, ok = self.ranks, 1 << 60, True
        while True:
            joined = rank.get(left + right)
            if joined is not None and joined < limit:
                ok = False
                break
            made_left = rank[left] if len(left) > 1 else -1
            made_right = rank[right] if len(right) > 1 else -1
            if made_left < 0 and made_right < 0:
                break
            # undo the later merge; equal ranks are made from left to right, so the right one is undone first
            if made_left > made_right:
                limit, left = made_left, self.split(left)[1]
                # the left token is made at ``limit``: a crossing pair of the same rank lies right of it and comes later
                limit = made_left
            else:
                limit, right = made_right, self.split(right)[0]
                # a crossing pair of the same rank lies left of it and comes first
                limit = made_right + 1
        if len(self._fits) > 1_000_000:
            self._fits.clear()
        self._fits[key] = ok
        return ok


class Transducer:
    """Bytes of one pretoken in, stable token ids out, with memory bounded by the lookahead."""

    def __init__(self, merges: MergeList):
        self.merges = merges
        self.window = b""  # bytes from the first position that is still open
        self.last: list[bytes] = []  # last token of the encoding of each prefix of the window

    def feed(self, data: bytes) -> list[int]:
        m, ranks = self.merges, self.merges.ranks
        for i in range(len(data)):
            self.window += data[i : i + 1]
            end = len(self.window)
            for size in m.lengths:
                if size > end:
                    raise ValueError("no token ends here")
                token = self.window[end - size :]
                if token in ranks and (size == end or m.fits(self.last[end - size - 1], token)):
                    self.last.append(token)
                    break
        out = self._stable() if len(self.window) > 4 * m.longest else []
        # the computed lookahead bounds the window; it is computed once, where a window first asks for it
        if not out and len(self.window) > 8 * m.longest and len(self.window) > m.bound + m.longest + len(data):
            raise RuntimeError("no token is stable within the lookahead of the merge list")
        return out

    def _chain(self, end: int) -> list[int]:
        """Ends of the tokens of the encoding of the window's first ``end`` bytes."""
        ends = []
        while end:
            ends.append(end)
            end -= len(self.last[end - 1])
        return ends[::-1]

    def _stable(self) -> list[int]:
        """The tokens that the encodings of all prefixes which a coming token can build on have in common."""
        n = len(self.window)
        common = self._chain(n)
        for end in range(max(1, n - self.merges.longest), n):
            other = self._chain(end)
            k = 0
            while k < min(len(common), len(other)) and common[k] == other[k]:
                k += 1
            common = common[:k]
            if not common:
                return []
        out = [self.merges.ranks[self.last[e - 1]] for e in common]
        cut = common[-1]
        self.window, self.last = self.window[cut:], self.last[cut:]
        return out

    def finish(self) -> list[int]:
        out = [self.merges.ranks[self.last[e - 1]] for e in self._chain(len(self.window))]
        self.window, self.last = b"", []
        return out


class Memo(dict):
    """Pretoken to its ids as packed 32-bit integers."""

    def __init__(self, merges: MergeList):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> bytes:
        data, ids, t = piece.encode(), array("i"), Transducer(self.merges)
        for i in range(0, len(data), LONG):
            ids.extend(t.feed(data[i : i + LONG]))
        ids.extend(t.finish())
        out = ids.tobytes()
        if len(data) <= LONG:
            if len(self) >= MEMORY:
                self.clear()
            self[piece] = out
        return out


class Encoder:
    """Text to packed ids; reads a long text block by block."""

    def __init__(self, ranks: dict[bytes, int]):
        self.memo = Memo(MergeList(ranks))
        self.pattern = regex.compile(PATTERN)

    def encode(self, text: str) -> bytes:
        if len(text) <= BLOCK:
            return b"".join(map(self.memo.__getitem__, self.pattern.findall(text)))
        return b"".join(self.stream(text[i : i + BLOCK] for i in range(0, len(text), BLOCK)))

    def stream(self, blocks: Iterator[str]) -> Iterator[bytes]:
        """Packed ids of a text that comes in blocks; what is held back is the pretoken that is still open."""
        rest = ""
        for block in blocks:
            rest += block
            done = 0
            for match in self.pattern.finditer(rest):
                if match.end() + LOOKAHEAD > len(rest):
                    break
                yield self.memo[match.group()]
                done = match.end()
            rest = rest[done:]
        yield b"".join(map(self.memo.__getitem__, self.pattern.findall(rest)))


class Decoder:
    """Token ids to text as they come: bytes of a character wait until it is whole."""

    def __init__(self, ranks: dict[bytes, int]):
        self.tokens = {n: t for t, n in ranks.items()}
        self.state = codecs.getincrementaldecoder("utf-8")("strict")

    def feed(self, ids: list[int]) -> str:
        return "".join(self.state.decode(self.tokens[i]) for i in ids)

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


def _shared_ranks(spark: SparkSession, path: str | None):
    """The vocabulary as a broadcast of proven size."""
    with open(vocabulary_file(path), "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary is larger than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(data)


_ENCODERS: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder for each worker process."""
    if shared.value is not None and (key := hash(shared.value)) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(read_ranks(shared.value))
    return _ENCODERS[key]


def encode(df: DataFrame, text: str = "text", key: str = "doc_id", out: str = "ids", vocabulary: str | None = None, extra: list[str] | None = None) -> DataFrame:
    """(key, ids): the ids of each text; one row per row of ``df``, without any shuffle."""
    shared = _shared_ranks(df.sparkSession, vocabulary)
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(shared).encode
        for batch in batches:
            packed = [b"" if t is None else code(t) for t in batch.column(len(extra) + 1).to_pylist()]
            ends = array("i", [0])
            for p in packed:
                ends.append(ends[-1] + len(p) // 4)
            flat = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(extra) + 1)] + [lists], names=[key, *extra, out])

    source = df.select(key, *extra, F.col(text).alias("_text"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in [key, *extra]] + [f"`{out}` array<int>"]))


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens", vocabulary: str | None = None) -> DataFrame:
    """The columns ``keep`` and the number of tokens of each text; the ids stay in the worker."""
    shared, keep = _shared_ranks(df.sparkSession, vocabulary), keep or ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = _encoder(shared).encode
        for batch in batches:
            sizes = [0 if t is None else len(code(t)) // 4 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(sizes, pa.int64())], names=[*keep, out])

    source = df.select(*keep, F.col(text).alias("_text"))
    kinds = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + [f"`{out}` bigint"]))
