"""Operator 9: byte-level BPE encoding and decoding.

Text is cut into pieces without a regular expression.  Every code point becomes a symbol (letter, number,
other, the kinds of white space, the kinds of apostrophe); a small automaton over those symbols says where a
piece begins.  A symbol is a function from state to state and functions compose associatively, so the scan
runs over all blocks of a batch side by side: compose the functions inside each block, chain the blocks'
functions, then replay each block from its own start state.  The pieces, as byte slices, feed pair merging
behind a bounded cache; the byte offsets of the tokens are kept, so that decoding can check and slice.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import load, pick, release, ship, with_text_ids
from .numeric import distinct, spread

#: Code points with the White_Space property (fixed values of Unicode).
SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
# Symbols
LETTER, NUMBER, OTHER, SHORT, LONG, SPACE_BOUND, SPACE_RUN, BLANK_LAST, END = range(9)
# States
NONE, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, PREFIX, ONE_MORE, TWO_MORE = range(8)
#: Code points of a batch that are scanned at once, and of a block of the scan.
CHUNK, BLOCK = 1 << 19, 128
CACHE = 200_000


@lru_cache(maxsize=1)
def code_classes() -> np.ndarray:
    """For each code point 0 letter, 1 number, 2 other, 3 white space."""
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)).encode()
    table = np.full(256, OTHER, np.uint8)
    table[ord("L")], table[ord("N")] = LETTER, NUMBER
    table = table[np.frombuffer(kinds, np.uint8)]
    table[SPACES] = 3
    return table


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 where a piece begins), both by [symbol, state]."""
    step, begins = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    for symbol, state in ((LETTER, IN_LETTERS), (NUMBER, IN_NUMBERS), (OTHER, IN_OTHERS)):
        step[symbol], begins[symbol, [state, PREFIX]] = state, 0
    step[LETTER, ONE_MORE], step[LETTER, TWO_MORE], begins[LETTER, [ONE_MORE, TWO_MORE]] = NONE, ONE_MORE, 0
    for symbol, state in ((SHORT, ONE_MORE), (LONG, TWO_MORE)):  # a clipped word, unless a run of others goes on
        step[symbol] = state
        step[symbol, [IN_OTHERS, PREFIX]], begins[symbol, [IN_OTHERS, PREFIX]] = IN_OTHERS, 0
    step[SPACE_BOUND] = PREFIX
    step[SPACE_RUN], begins[SPACE_RUN, IN_SPACES] = IN_SPACES, 0
    step[BLANK_LAST] = NONE
    step[END] = NONE
    return step, begins


def symbols(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ends marks the separators between documents."""
    kind = code_classes()[codes]
    kind[ends] = END
    out = kind.copy()
    after = np.append(kind[1:], END)
    blank = kind == 3
    bound = blank & (after < 3)  # the last of a run, before something that is seen
    out[blank] = SPACE_RUN
    out[bound] = np.where(codes[bound] == 0x20, SPACE_BOUND, BLANK_LAST)
    quote = np.flatnonzero((codes == 0x27) & ~ends)
    if len(quote):
        padded = np.append(codes, np.zeros(2, codes.dtype))
        one, two = padded[quote + 1], padded[quote + 2]
        is_one = np.isin(one, [ord(c) for c in "stmd"])
        is_two = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        out[quote[is_one]] = SHORT
        out[quote[is_two]] = LONG
    return out


def boundaries(sym: np.ndarray) -> np.ndarray:
    """Positions at which a piece begins, by a blocked scan of transition functions."""
    step, begins = automaton()
    n, states = len(sym), step.shape[1]
    rows = -(-n // BLOCK)
    grid = np.full(rows * BLOCK, END, np.uint8)
    grid[:n] = sym
    grid = np.ascontiguousarray(grid.reshape(rows, BLOCK).T)  # step t of every block lies together
    flat = step.ravel()
    # within a block: the composed function, a state for each start state
    f = np.broadcast_to(np.arange(states, dtype=np.uint8), (rows, states)).copy()
    # an END or any symbol that ignores the state makes a function constant: most blocks settle in a few steps
    base = grid.astype(np.int16) * states
    for t in range(BLOCK):
        f = flat[base[t][:, None] + f]
    # across blocks: prefix composition by doubling, g[i] = f[i] o ... o f[0]
    g, d = f, 1
    while d < rows:
        g = np.concatenate([g[:d], np.take_along_axis(g[d:], g[:-d].astype(np.intp), 1)])
        d *= 2
    state = np.concatenate([[NONE], g[:-1, NONE]]).astype(np.int16)
    first = np.empty((BLOCK, rows), np.uint8)
    starts = begins.ravel()
    for t in range(BLOCK):
        at = base[t] + state
        first[t] = starts[at]
        state = flat[at].astype(np.int16)
    return np.flatnonzero(first.T.ravel()[:n])


def grouped(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about CHUNK code points; a longer text stands alone."""
    group: list[str] = []
    size = 0
    for text in texts:
        if group and size + len(text) > CHUNK:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text) + 1
    if group:
        yield group


def pieces(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, the offset of every piece (and of the end), and each text's first piece (and their number)."""
    joined = "\0".join(texts)
    codes = np.frombuffer((joined + "\0").encode("utf-32-le", "surrogatepass"), "<u4")
    stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    ends = np.zeros(len(codes), bool)
    ends[stops] = True
    starts = boundaries(symbols(codes, ends))
    raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
    if len(raw) == len(joined):
        at = starts
    else:
        width = 1 + (codes >= 0x80).astype(np.int8) + (codes >= 0x800) + (codes >= 0x10000)
        at = np.cumsum(width, dtype=np.int64)[starts] - width[starts]
    # the separators are pieces of their own: leave them out of the bytes and of the offsets
    separator = ends[starts]
    inner = np.ones(len(raw), bool)
    inner[at[separator][:-1]] = False
    passed = np.cumsum(separator)
    at = (at - passed)[~separator]
    raw = raw[inner]
    split = np.concatenate([[0], np.flatnonzero(separator) - np.arange(len(texts))])
    return raw, np.append(at, len(raw)), split


@lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def merge(piece: bytes, rank: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of a piece: join the pair of lowest rank, the leftmost of equals, until none is left."""
    if (whole := rank.get(piece)) is not None:
        return (whole,)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 64:
        return _merge_long(parts, rank)
    none = len(rank) + 1
    costs = [rank.get(a + b, none) for a, b in zip(parts, parts[1:])]
    while costs and (best := min(costs)) != none:
        i = costs.index(best)
        parts[i : i + 2] = [joined := parts[i] + parts[i + 1]]
        del costs[i]
        if i < len(costs):
            costs[i] = rank.get(joined + parts[i + 1], none)
        if i:
            costs[i - 1] = rank.get(parts[i - 1] + joined, none)
    return tuple(rank[p] for p in parts)


def _merge_long(parts: list[bytes], rank: dict[bytes, int]) -> tuple[int, ...]:
    """The same for long pieces, with a heap and a linked list: n log n."""
    import heapq

    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, 1, 1) for i in range(n - 1) if (r := rank.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i] if parts[i] else n
        if j >= n or len(parts[i]) != a or len(parts[j]) != b:
            continue  # one of the two has grown or gone
        parts[i] += parts[j]
        parts[j] = b""
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (r := rank.get(parts[x] + parts[y])) is not None:
                heapq.heappush(heap, (r, x, len(parts[x]), len(parts[y])))
    return tuple(rank[p] for p in parts if p)


class Coder:
    """Encoder and decoder for one rank file, with a bounded cache of pieces."""

    def __init__(self, path: str, cache: int = CACHE):
        self.rank, self.cache, self.size = ranks(path), {}, cache
        self.token = [b""] * (max(self.rank.values(), default=-1) + 1)
        for token, i in self.rank.items():
            self.token[i] = token
        self.width = np.array([len(t) for t in self.token], np.int64)
        self.start, self.bytes = np.cumsum(self.width) - self.width, np.frombuffer(b"".join(self.token), np.uint8)
        self.digits = [str(i) for i in range(len(self.token))]
        self.byte = np.array([self.rank[bytes([i])] for i in range(256)], np.int64)
        # every pair of tokens that joins to a token: key left * base + right, sorted, and the token's rank
        self.base = len(self.token) + 1
        found = {self.rank[t[:i]] * self.base + self.rank[t[i:]]: r for t, r in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank}
        self.keys = np.array([-1, *sorted(found)], np.int64)
        self.joins = np.array([self.base, *(found[k] for k in sorted(found))], np.int64)

    def cost(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each joined pair; base, above every rank, if it is no token."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key, "right") - 1
        return np.where(self.keys[at] == key, self.joins[at], self.base)

    def merge_all(self, short: list[bytes], out: dict[bytes, tuple[int, ...]]) -> None:
        """Merge many pieces side by side, a pair of each in a round, and put their ids in out."""
        ids = self.byte[np.frombuffer(b"".join(short), np.uint8)]
        lengths = np.fromiter(map(len, short), np.int64, len(short))
        seg = np.repeat(np.arange(len(short)), lengths)
        last = np.ones(len(ids), bool)
        last[:-1] = seg[:-1] != seg[1:]
        cost = np.full(len(ids), self.base)
        inner = np.flatnonzero(~last)
        cost[inner] = self.cost(ids[inner], ids[inner + 1])
        while len(ids):
            starts = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            least = np.minimum.reduceat(cost, starts)
            size = np.diff(np.append(starts, len(ids)))
            if (done := least == self.base).any():
                over = np.repeat(done, size)
                flat, stop = ids[over].tolist(), np.cumsum(size[done]).tolist()
                for s, a, b in zip(seg[starts[done]].tolist(), [0, *stop], stop):
                    out[short[s]] = tuple(flat[a:b])
                keep = ~over
                ids, seg, last, cost, least, size = ids[keep], seg[keep], last[keep], cost[keep], least[~done], size[~done]
                if not len(ids):
                    break
            at = np.flatnonzero(cost == np.repeat(least, size))
            at = at[np.concatenate([[True], seg[at[1:]] != seg[at[:-1]]])]  # the leftmost of each piece
            ids[at] = cost[at]
            last[at] = last[at + 1]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            ids, seg, last, cost = ids[keep], seg[keep], last[keep], cost[keep]
            cost[at] = self.base
            right = at[~last[at]]
            cost[right] = self.cost(ids[right], ids[right + 1])
            left = at[(at > 0) & (seg[at - 1] == seg[at])] - 1
            cost[left] = self.cost(ids[left], ids[left + 1])

    def ids_of(self, new: list[bytes]) -> dict[bytes, tuple[int, ...]]:
        """The ids of distinct pieces, without a look at the cache."""
        out: dict[bytes, tuple[int, ...]] = {}
        for p in new:
            if (i := self.rank.get(p)) is not None:
                out[p] = (i,)
            elif len(p) > 64:
                out[p] = merge(p, self.rank)
        self.merge_all([p for p in new if len(p) <= 64 and p not in self.rank], out)
        return out

    def keep(self, merged: dict[bytes, tuple[int, ...]]) -> None:
        """Put the short ones of merged pieces in the cache, as many as it takes; long ones are rare, not worth keeping."""
        short = list(itertools.islice((p for p in merged if len(p) <= 64), self.size))
        if len(self.cache) + len(short) > self.size:  # the older half goes, or more: dicts keep the order of insertion
            gone = max(len(self.cache) // 2, len(self.cache) + len(short) - self.size)
            self.cache = dict(itertools.islice(self.cache.items(), gone, None))
        for p in short:
            self.cache[p] = merged[p]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        for group in grouped(texts):
            raw, at, split = pieces(group)
            # equal pieces of a group are looked up and merged once
            which, unique = distinct(raw, at)
            # held apart from the cache, which may be smaller than the pieces of one group
            here = {p: i for p in unique if (i := self.cache.get(p)) is not None}
            if new := [p for p in unique if p not in here]:
                merged = self.ids_of(new)
                here |= merged
                self.keep(merged)
            found = [here[p] for p in unique]
            size = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(size.sum()))
            n = size[which]
            stop = np.cumsum(n)
            ids = flat[spread((np.cumsum(size) - size)[which], n)]
            stop = np.concatenate([[0], stop])[split]
            for a, b in zip(stop, stop[1:]):
                yield ids[a:b]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset at which each token ends."""
        return np.cumsum(self.width[ids])

    def decode(self, ids: np.ndarray) -> bytes:
        width = self.width[ids]
        return self.bytes[spread(self.start[ids], width)].tobytes()

    def decimal(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return ",".join(map(self.digits.__getitem__, ids.tolist())).encode()


@lru_cache(maxsize=2)
def coder(path: str) -> Coder:
    """One for each worker process, so that the cache outlives a task."""
    return Coder(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>, offsets array<bigint>: the tokens of every whole text and where each ends, in bytes.

    Null text is the empty text and has no tokens; repeated rows and null ids are kept, a row for a row; an empty
    table gives an empty table; other columns aren't read, so that their names can't clash.
    Map only: no shuffle; a task holds a batch of texts and a cache of CACHE short pieces.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            ids = list(c.encode([t or "" for t in b["text"]]))
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": pd.Series(ids, dtype="object"), "offsets": pd.Series([c.offsets(x) for x in ids], dtype="object")})

    return with_text_ids(pick(docs, doc_id=id_col, text=text_col), lambda d: d.mapInPandas(run, "doc_id string, ids array<int>, offsets array<bigint>"))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes: the inverse of encode(); null ids give null."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "bytes": [None if x is None else c.decode(np.asarray(x, np.int64)) for x in b["ids"]]})

    return with_text_ids(encoded.select("doc_id", "ids"), lambda d: d.mapInPandas(run, "doc_id string, bytes binary"))


def digest(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes, then decodes the ids, in one pass over the texts."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = coder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in c.encode([t or "" for t in b["text"]]):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(c.decimal(ids)).hexdigest())
                text_sha.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": n, "ids_sha256": ids_sha, "decoded_sha256": text_sha})

    return docs.mapInPandas(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def default_ranks() -> str:
    """Where the installed vocabulary lies; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded."""
    return with_text_ids(pick(load(spark, sf_dir, "documents"), doc_id="doc_id", text="text"), lambda d: digest(d, default_ranks()))


def with_tokens(docs: DataFrame, path: str, *, text_col: str = "text") -> DataFrame:
    """docs, all columns, with n_tokens, ids_sha256 and decoded_sha256 (in place of columns of those names)."""
    ship(docs.sparkSession)
    new = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for b in batches:
            rows = [(len(ids), hashlib.sha256(c.decimal(ids)).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()) for ids in c.encode([t or "" for t in b.column(b.schema.get_field_index(text_col)).to_pylist()])]
            n, one, two = map(list, zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())], names=[*b.schema.names, *new])
        c.cache.clear()  # workers live on, into stages that have no use for it
        release()

    schema = StructType(list(docs.schema.fields))
    for name, kind in new.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)
