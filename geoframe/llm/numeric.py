"""Word boundaries and hashes of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_POWERS: dict[int, list[np.ndarray]] = {}
#: Odd multipliers (any would do) for words in a sequence, and a second one.
IN_SEQUENCE, SECOND = 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7


def powers(base: int, n: int) -> list[np.ndarray]:
    """The first n powers, at least, of an odd base and of its inverse modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n + (n >> 3), b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64))]
    return _POWERS[base]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every bit of the input moves every bit of the output."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... size[0] of them, then those of start[1], and so on."""
    stop = np.cumsum(size)
    return np.repeat(start - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)


class Prefix:
    """Hashes of any slices of a sequence, from prefix sums of a polynomial modulo 2**64.

    For short slices: two values in the order of Thue and Morse collide from some 1,000 places on, whatever the base.
    """

    def __init__(self, values: np.ndarray, base: int):
        self.up, self.down = powers(base, len(values) + 1)
        with np.errstate(over="ignore"):
            self.total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.up[: len(values)], dtype=np.uint64)])

    def slices(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = (self.total[stop] - self.total[start]) * self.down[start]
            return mix(h + (stop - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def majority(h: np.ndarray) -> int:
    """SimHash of hashes of 64 bits: a bit is 1 if it is in over half of them."""
    count = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        count += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > len(h), bitorder="little").view(np.uint64)[0])


def chunks(texts: list[bytes], size: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts of about so many bytes; a longer text stands alone."""
    a = total = 0
    for i, t in enumerate(texts):
        if i > a and total + len(t) > size:
            yield a, i
            a, total = i, 0
        total += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def distinct(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(number of each slice among the distinct ones, those); slices lie between consecutive offsets, compared by bytes."""
    if len(at) < 2:
        return np.zeros(0, np.int64), []
    # offsets of 64 bits only where a text needs them
    kind, width = (pa.binary(), np.int32) if at[-1] < 1 << 31 else (pa.large_binary(), np.int64)
    coded = pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(at.astype(width)), pa.py_buffer(raw)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def tokens(texts: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(number of every word among the distinct ones, those, number of the first word of each text and the number of all words)."""
    raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    seen = np.concatenate([[False], ~((raw == 0x20) | ((raw >= 9) & (raw <= 13)))])
    edge = np.flatnonzero(seen[1:] != seen[:-1])
    start, stop = edge[::2], edge[1::2]
    index, found = distinct(raw[seen[1:]], np.concatenate([[0], np.cumsum(stop - start)]))
    at = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return index, found, np.searchsorted(start, at)


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(XXH64 of every word, number of the first word of each text and the number of all words)."""
    index, found, first = tokens(texts)
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))[index], first


def sliding_min(v: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least value of each run of width values and where the leftmost of it stands."""
    at = np.arange(len(v))
    done = 1
    while done < width:
        d = min(done, width - done)
        left, right = v[:-d], v[d:]
        take = left <= right
        v, at = np.where(take, left, right), np.where(take, at[:-d], at[d:])
        done += d
    return v, at
