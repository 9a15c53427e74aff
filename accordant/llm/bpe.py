"""Byte-level pair encoding with the vocabulary of a public tokenizer.

Pre-tokenisation uses no regular expression.  The texts of a batch are laid end to end as one array of code points;
each gets a class (letter, number, white space, other, and the apostrophes that begin a contraction, with one
character of lookahead folded in).  A class is a transition function on eight states.  Functions compose
associatively, and all compositions of these nine form a small monoid, so the state at every place comes from a
prefix scan whose only step is a lookup in the monoid's table.  A piece begins where state and class say so.

The pieces, slices of the text, feed the pair merging, which remembers what it merged.  Token boundaries in bytes are
kept for decoding.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.windows import code_points

LETTER, NUMBER, OTHER, SHORT, LONG, SPACES, LAST_BLANK, LAST_OTHER, BREAK = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACES, BLANK, TWO_LEFT, ONE_LEFT = range(8)
WHITE = 3  # among the raw classes 0 other, 1 letter, 2 number, 3 white space
#: Code points of the White_Space property.
_WHITE_SPACE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows the apostrophe of a contraction.
_SHORT_TAILS, _LONG_TAILS = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Texts are laid end to end up to this many characters; a longer text is a block of its own.
BLOCK_CHARS = 1_000_000
#: Entries of the merge cache, which is emptied when it is full.
CACHE_ENTRIES = 500_000


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The raw class of every code point."""
    kind = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        c = unicodedata.category(chr(cp))[0]
        if c == "L":
            kind[cp] = 1
        elif c == "N":
            kind[cp] = 2
    kind[_WHITE_SPACE] = WHITE
    return kind


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after a character of class ``symbol``, and whether a piece begins at it."""
    if symbol == BREAK:
        return START, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return START, False
    if symbol in (LETTER, NUMBER, OTHER):
        run = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
        return run, state not in (run, BLANK)
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, BLANK):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    if symbol == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (BLANK if symbol == LAST_BLANK else START), True


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Element of each class, table of compositions (first row, then column), value at each state, begin flags."""
    generators = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = {tuple(range(8)): 0}
    queue = [tuple(range(8))]
    for f in queue:
        for g in generators:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                queue.append(h)
    n = len(queue)
    table = np.zeros((n, n), np.uint16)
    for f, i in elements.items():
        for g, j in elements.items():
            table[i, j] = elements[tuple(g[x] for x in f)]
    begin = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    return np.array([elements[g] for g in generators], np.uint16), table, np.array(queue, np.uint8), begin


def scan(elements: np.ndarray, table: np.ndarray, width: int = 64) -> np.ndarray:
    """Prefix compositions (inclusive): each of many short rows is scanned at once, then the rows' totals likewise."""
    n = len(elements)
    if n <= width:
        out = elements.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], out[i]]
        return out
    rows = -(-n // width)
    grid = np.zeros(rows * width, np.uint16)  # 0 is the identity
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat, m = table.ravel(), np.uint32(len(table))
    for j in range(1, width):
        grid[j] = flat[grid[j - 1] * m + grid[j]]
    before = np.zeros(rows, np.uint16)
    before[1:] = scan(grid[-1], table, width)[:-1]
    return flat[before[None, :] * m + grid].T.ravel()[:n]


def piece_starts(points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Places where a piece begins; ``breaks`` are the places of the marks between texts, which count as well."""
    n = len(points)
    raw = classes()[points]
    raw[breaks] = 4
    white = raw == WHITE
    following = np.full(n, 4, np.uint8)
    following[:-1] = raw[1:]
    symbol = np.array([OTHER, LETTER, NUMBER, SPACES, BREAK], np.uint8)[raw]
    last = white & (following != WHITE) & (following != 4)
    symbol[last] = np.where(points[last] == 0x20, LAST_BLANK, LAST_OTHER)
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        one, two = padded[quotes + 1], padded[quotes + 2]
        symbol[quotes[np.isin(one, [ord(c) for c in _SHORT_TAILS])]] = SHORT
        for a, b in _LONG_TAILS:
            symbol[quotes[(one == ord(a)) & (two == ord(b))]] = LONG
        symbol[breaks] = BREAK
    element, table, values, begin = monoid()
    after = values[scan(element[symbol], table), START]
    state = np.zeros(n, np.uint8)
    state[1:] = after[:-1]
    return np.flatnonzero(begin[state, symbol])


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, rank: dict[bytes, int]) -> list[int]:
    """The ids of one piece: the pair of the lowest rank, leftmost first, is merged until no pair has a rank."""
    whole = rank.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # a part is piece[i:end[i]]
    left = list(range(-1, n - 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\x01" * n)
    while heap:
        _, i, size = heapq.heappop(heap)
        if not alive[i] or end[i] == n or i + size != end[end[i]]:
            continue  # one of the two parts has changed since
        j = end[i]
        alive[j] = 0
        end[i] = end[j]
        if end[i] < n:
            left[end[i]] = i
            r = rank.get(piece[i : end[end[i]]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[end[i]] - i))
        if left[i] >= 0:
            k = left[i]
            r = rank.get(piece[k : end[i]])
            if r is not None:
                heapq.heappush(heap, (r, k, end[i] - k))
    out, i = [], 0
    while i < n:
        out.append(rank[piece[i : end[i]]])
        i = end[i]
    return out


class _Cache(dict):
    def __init__(self, rank: dict[bytes, int]):
        super().__init__()
        self.rank = rank

    def __missing__(self, piece: str) -> tuple[int, ...]:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        ids = tuple(merge(piece.encode("utf-8", "replace"), self.rank))
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Encoder:
    """Encodes batches of texts; one instance per worker process and vocabulary."""

    def __init__(self, path: str):
        self.cache = _Cache(ranks(path))

    def block(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of each text, one array for all, and the number of ids of each."""
        joined = "\n".join(texts) + "\n"
        points = code_points(joined)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        breaks = np.cumsum(lengths + 1) - 1
        starts = piece_starts(points, breaks)
        ends = np.append(starts[1:], len(points))
        at_break = np.zeros(len(points), bool)
        at_break[breaks] = True
        real = ~at_break[starts]
        starts, ends = starts[real], ends[real]
        get = self.cache.__getitem__
        found = [get(joined[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum()))
        upto = np.concatenate([[0], np.cumsum(sizes)])
        last = np.searchsorted(starts, breaks)  # pieces before the end of each text
        counts = np.diff(np.concatenate([[0], upto[last]]))
        return ids, counts

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, block, size = [], [], [], 0
        for text in texts:
            block.append(text or "")
            size += len(block[-1]) + 1
            if size >= BLOCK_CHARS:
                a, b = self.block(block)
                ids.append(a)
                counts.append(b)
                block, size = [], 0
        if block:
            a, b = self.block(block)
            ids.append(a)
            counts.append(b)
        if not ids:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        return np.concatenate(ids), np.concatenate(counts)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(maxsize=4)
def _token_bytes(path: str) -> tuple[list[bytes], np.ndarray]:
    table = ranks(path)
    tokens = [b""] * (max(table.values()) + 1)
    for token, i in table.items():
        tokens[i] = token
    return tokens, np.array([len(t) for t in tokens], np.int64)


def encode(df: DataFrame, key: str, path: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row; with ``offsets`` also the byte where each token begins.

    Null and empty texts have no ids (an empty array, never null).  Strings of special tokens are ordinary text.
    Repeated rows come out each.  ``path`` names a ``.tiktoken`` file of ranks that all executors can read.  The scan
    reads the two columns only and nothing is shuffled.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            ids, counts = enc.batch(batch.column(1).to_pylist())
            at = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            columns, names = [batch.column(0), pa.ListArray.from_arrays(at, pa.array(ids, pa.int32()))], [key, "ids"]
            if offsets:
                sizes = _token_bytes(path)[1][ids]
                ends = np.cumsum(sizes)
                firsts = ends - sizes
                owner = np.repeat(np.arange(len(counts)), counts)
                base = np.zeros(len(counts), np.int64)
                some = counts > 0
                base[some] = firsts[at.to_numpy()[:-1][some]]
                columns.append(pa.ListArray.from_arrays(at, pa.array((firsts - base[owner]).astype(np.int32))))
                names.append("offsets")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"`{key}` {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return df.select(key, text).mapInArrow(run, schema)


def count_tokens(df: DataFrame, keep: list[str], path: str, text: str = "text") -> DataFrame:
    """The ``keep`` columns and ``n_tokens`` of each row, without the ids leaving the worker."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            _, counts = enc.batch(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(counts, pa.int64())], names=[*keep, "n_tokens"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long"])
    return df.select(*keep, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, path: str, ids: str = "ids") -> DataFrame:
    """``key`` and ``text`` of each row of ids; an empty or null array gives an empty text."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, _ = _token_bytes(path)
        for batch in batches:
            texts = [b"".join([tokens[i] for i in x or ()]).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return df.select(key, F.col(ids)).mapInArrow(run, f"`{key}` {kind}, text string")
