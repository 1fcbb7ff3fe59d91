"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Code points become an array of symbols (letter, number, white space, ... with one step of
look-ahead folded in). A finite automaton decides where tokens begin. Each symbol is a function
from states to states; functions compose associatively, so the text is cut into lanes, all lanes
compose their functions at once, the lanes' results are chained, and a second sweep replays each
lane from its true state and marks the boundaries. No regular expression runs. The slices go
through a bounded cache in front of the pair merging; offsets of every token are kept.

Null text is empty text. Empty texts have no tokens; very long runs use a heap to merge pairs.
Rows are independent, also those that repeat a doc_id; columns that are not asked for take no part,
whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

#: Symbols. W*: white space; *L: the last of its run, before something else. C1, C2: an apostrophe
#: before a one- or two-letter contraction.
LETTER, NUMBER, OTHER, C1, C2, WS, SPACE_L, WS_L = range(8)
#: States: what the open token is. DONE: the next code point begins a token whatever it is.
DONE, IN_L, IN_N, IN_O, LEAD, IN_W, TAKE1, TAKE2 = range(8)
#: Contractions that end a word in the public pattern: fixed values.
ONE = "stmd"
TWO = ("re", "ve", "ll")
LANE = 128


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol + 8 * text begins, state] and begins[...]: whether a token begins at that symbol."""
    step, begins = np.zeros((16, 8), np.uint8), np.zeros((16, 8), np.uint8)
    opened = {LETTER: IN_L, NUMBER: IN_N, OTHER: IN_O, C1: TAKE1, C2: TAKE2, WS: IN_W, SPACE_L: LEAD, WS_L: DONE}
    goes_on = {(LETTER, IN_L), (NUMBER, IN_N), (OTHER, IN_O), (C1, IN_O), (C2, IN_O), (WS, IN_W)}
    for sym in range(8):
        for state in range(8):
            if state == TAKE2:
                to, new = TAKE1, 0
            elif state == TAKE1:
                to, new = DONE, 0
            elif state == LEAD:  # a single space belongs to what follows; a contraction cannot follow it
                to, new = (IN_O if sym in (C1, C2) else opened[sym]), 0
            elif (sym, state) in goes_on:
                to, new = state, 0
            else:
                to, new = opened[sym], 1
            step[sym, state], begins[sym, state] = to, new
        step[8 + sym], begins[8 + sym] = opened[sym], 1
    return step, begins


STEP, BEGINS = _automaton()


@cache
def class_table() -> bytes:
    """For each code point LETTER, NUMBER, WS or OTHER, as the library's version of Unicode has it: the library, given
    single bytes as its vocabulary, keeps of all code points those that match a class. Made once, on the driver."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    out = bytearray([OTHER]) * 0x110000
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", WS)):
        only = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        for c in bytes(only.encode_ordinary(every)).decode():
            out[ord(c)] = kind
    return bytes(out)


def symbols(cps: np.ndarray, first: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """cps: code points of texts, one after another; first: where each non-empty text begins."""
    n = len(cps)
    sym = classes[cps]
    ends = np.zeros(n, bool)  # the last code point of each text
    ends[first[1:] - 1] = True
    ends[-1] = True
    last = (sym == WS) & ~ends
    last[:-1] &= sym[1:] != WS
    quote = np.flatnonzero(cps == 39)
    if len(quote):
        at = lambda k: np.where(quote + k < n, cps[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        a = np.where(ends[quote], 0, a)
        b = np.where((a == 0) | ends[np.minimum(quote + 1, n - 1)], 0, b)
        one = np.isin(a, [ord(c) for c in ONE])
        two = np.zeros(len(quote), bool)
        for x, y in TWO:
            two |= (a == ord(x)) & (b == ord(y))
    sym = sym.copy()
    sym[last & (cps == 32)] = SPACE_L
    sym[last & (cps != 32)] = WS_L
    if len(quote):
        sym[quote[one]] = C1
        sym[quote[two]] = C2
    sym[first] += 8
    return sym


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Positions at which a token begins."""
    n = len(sym)
    lanes = -(-n // LANE)
    grid = np.zeros(lanes * LANE, np.int32)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T) * 8
    step, begins = STEP.ravel(), BEGINS.ravel()
    whole = np.broadcast_to(np.arange(8, dtype=np.uint8), (lanes, 8))
    for row in grid:  # compose each lane's functions, all lanes at once
        whole = step.take(row[:, None] + whole)
    state = np.zeros(lanes, np.uint8)
    table, now = whole.tolist(), DONE
    for k in range(lanes - 1):  # chain the lanes
        now = table[k][now]
        state[k + 1] = now
    mark = np.zeros((LANE, lanes), np.uint8)
    for j, row in enumerate(grid):  # replay each lane from its true state
        at = row + state
        mark[j] = begins.take(at)
        state = step.take(at)
    return np.flatnonzero(mark.T.ravel()[:n])


class Ranks:
    """Merge ranks with a bounded cache of merged slices."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 700_000):
        self.ranks, self.limit = ranks, limit
        self.cache: dict[str, bytes] = _Pieces(self)

    def merge(self, piece: bytes) -> list[int]:
        if (r := self.ranks.get(piece)) is not None:
            return [r]
        return self._short(piece) if len(piece) <= 256 else self._long(piece)

    def _short(self, piece: bytes) -> list[int]:
        get, far = self.ranks.get, 1 << 60
        parts = [piece[i : i + 1] for i in range(len(piece))]
        order = [get(piece[i : i + 2], far) for i in range(len(piece) - 1)]
        while order and (low := min(order)) != far:
            i = order.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i < len(order):
                order[i] = get(parts[i] + parts[i + 1], far)
            if i:
                order[i - 1] = get(parts[i - 1] + parts[i], far)
        return [self.ranks[p] for p in parts]

    def _long(self, piece: bytes) -> list[int]:
        """The same merges in the same order: lowest rank first, then leftmost."""
        n, get = len(piece), self.ranks.get
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != to:
                continue
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := get(piece[i : end[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, end[after[j]]))
            if before[i] >= 0 and (r := get(piece[before[i] : end[i]])) is not None:
                heapq.heappush(heap, (r, before[i], end[i]))
        return [self.ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


class _Pieces(dict):
    def __init__(self, owner: Ranks):
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        ids = np.array(self.owner.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.owner.limit:
                self.clear()
            self[piece] = ids
        return ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Codec:
    """Encodes and decodes lists of texts."""

    chunk = 1 << 20  # code points that are cut at once; a longer text is cut alone

    def __init__(self, path: str, classes: bytes | None = None):
        self.ranks = Ranks(load_ranks(path))
        self.classes = np.frombuffer(classes or class_table(), np.uint8)
        self.tokens = [b""] * (max(self.ranks.ranks.values()) + 1)
        for token, r in self.ranks.ranks.items():
            self.tokens[r] = token

    def slices(self, texts: list[str]) -> Iterator[list[str]]:
        """The pre-tokens of each text."""
        group: list[str] = []
        held = 0
        for text in texts:
            if group and held + len(text) > self.chunk:
                yield from self._cut(group)
                group, held = [], 0
            group.append(text)
            held += len(text)
        if group:
            yield from self._cut(group)

    def _cut(self, texts: list[str]) -> Iterator[list[str]]:
        lengths = np.array([len(t) for t in texts])
        stops = np.cumsum(lengths)
        if not stops[-1]:
            yield from ([] for _ in texts)
            return
        whole = "".join(texts)
        cps = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        first = (stops - lengths)[lengths > 0]
        at = boundaries(symbols(cps, first, self.classes))
        cut = np.searchsorted(at, np.concatenate(([0], stops)))
        starts = [*at.tolist(), int(stops[-1])]
        for k in range(len(texts)):
            a, b = cut[k], cut[k + 1]
            edges = starts[a : b + 1]
            yield [whole[i:j] for i, j in zip(edges, edges[1:])]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        merged = self.ranks.cache.__getitem__
        for pieces in self.slices(texts):
            yield np.frombuffer(b"".join(map(merged, pieces)), "<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def offsets(self, ids: list[int]) -> np.ndarray:
        """Byte offset of each token in the decoded text, with the total at the end."""
        return np.cumsum([0, *(len(self.tokens[i]) for i in ids)])


_CODECS: dict[str, Codec] = {}


def codec(path: str, classes: bytes) -> Codec:
    """One codec for each Python worker."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path, classes)
    return _CODECS[path]


def _texts(column) -> list[str]:
    return [t if t is not None else "" for t in column.to_pylist()]


def _mapped(df: DataFrame, keep: list[str], schema: str, text: str, path: str, work) -> DataFrame:
    classes = df.sparkSession.sparkContext.broadcast(class_table())

    def run(batches):
        import pyarrow as pa

        c = codec(path, classes.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                cols = work(c, _texts(part.column(part.num_columns - 1)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *cols.values()], names=[*keep, *cols])

    source = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return in_batches(source, run, f"{fields}, {schema}")


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, ids array<int>, offsets array<int> (byte offset of each token, and the total last)."""

    def work(c: Codec, texts):
        import pyarrow as pa

        ids = [x.tolist() for x in c.encode(texts)]
        return {"ids": pa.array(ids, pa.list_(pa.int32())), "offsets": pa.array([c.offsets(x).tolist() for x in ids], pa.list_(pa.int32()))}

    return _mapped(df, keep, "ids array<int>, offsets array<int>", text, path, work)


def digests(df: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (bytes decoded from the ids)."""

    def work(c: Codec, texts):
        import pyarrow as pa

        names = [str(i) for i in range(len(c.tokens))]
        count, ids_sha, decoded_sha = [], [], []
        for ids in c.encode(texts):
            ids = ids.tolist()
            count.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            decoded_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
        return {"n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(decoded_sha, pa.string())}

    return _mapped(df, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", text, path, work)
