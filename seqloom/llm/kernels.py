"""numpy kernels over the UTF-8 buffers of Arrow string columns: words, shingles and minwise sketches as 64-bit hashes.

A word's hash is a polynomial over a random 64-bit value per byte (mod 2^64, from one running sum, so each byte is
touched a fixed number of times), then mixed. Two different words or shingles agree with probability 2^-64 or so.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that a kernel works on at once: bounds memory at about 60 times as much, and fits the cache.
CHUNK = 1 << 19

Batches = Iterator[pa.RecordBatch]


#: What a worker keeps between tasks beyond a few MB, by owner: how to drop it. Workers outlive their tasks and stages.
CACHES: dict[str, Callable[[], None]] = {}


def drop_caches(keep: str) -> None:
    for owner, drop in CACHES.items():
        if owner != keep:
            drop()


def releasing(run: Callable[[Batches], Batches], keep: str = "") -> Callable[[Batches], Batches]:
    """``run``, dropping the caches of other operators than ``keep`` first, and giving freed memory back to the system at the task's end: allocators keep what they had."""

    @functools.wraps(run)
    def task(batches: Batches) -> Batches:
        drop_caches(keep)
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return task


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def numbers(seed: int, n: int, odd: bool = False) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    x = mix(np.arange(1, n + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 % (1 << 64)))
    return x | U(1) if odd else x


BASE = int(numbers(1, 1, odd=True)[0])
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = numbers(2, 64, odd=True)


@functools.lru_cache(1)
def byte_values() -> np.ndarray:
    """A random value per byte; A-Z have those of a-z."""
    v = numbers(3, 256)
    v[65:91] = v[97:123]
    return v


@functools.lru_cache(1)
def white() -> np.ndarray:
    w = np.zeros(256, dtype=bool)
    w[[0x20, *range(0x09, 0x0E)]] = True
    return w


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, by doubling."""
    out = np.ones(n, dtype=U)
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k : k + m] = out[:m] * U(pow(base, k, 1 << 64))
        k += m
    return out


_powers: list[np.ndarray] = [np.empty(0, U), np.empty(0, U)]


def powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK + CHUNK // 4)
        if size > 4 * CHUNK:
            return powers(BASE, n), powers(BASE_INVERSE, n)
        _powers[0], _powers[1] = powers(BASE, size), powers(BASE_INVERSE, size)
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words begin (n + 1 numbers).

    Text i is ``data[offsets[i]:offsets[i + 1]]``, offsets[0] = 0. A word is a run of bytes that are not ``space``.
    """
    inside = ~(white() if space is None else space)[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[(offsets > 0) & (offsets < len(data))]
    first[cut] |= inside[cut]
    last[cut - 1] |= inside[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last)
    up, down = powers_to(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((byte_values() if values is None else values)[data] * up[: len(data)], out=total[1:])
    words = mix((total[ends + 1] - total[starts]) * down[starts])
    return words, np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, at: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order, and where each text's begin. A text of 1 to k - 1 words has its whole sequence as its one shingle."""
    n = np.diff(at)
    counts = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(int(begin[-1]), dtype=U)
    m = len(words) - k + 1
    if m > 0:
        s = words[:m] * SHINGLE[0]
        for j in range(1, k):
            s += words[j : j + m] * SHINGLE[j]
        full = n >= k
        # The shingle that starts at word i of a long enough text goes to begin[text] + i - at[text].
        which = np.repeat(np.flatnonzero(full), counts[full])
        local = np.arange(len(which)) - np.repeat(np.cumsum(counts[full]) - counts[full], counts[full])
        out[begin[which] + local] = s[at[which] + local]
    for t in np.flatnonzero((n > 0) & (n < k)):
        w = words[at[t] : at[t + 1]]
        out[begin[t]] = np.sum(np.append(w * SHINGLE[: len(w)], SHINGLE[k + len(w)]), dtype=U)
    return mix(out), begin


def distinct_sets(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, sorted, in a row, and where each begins."""
    sets = [np.unique(hashes[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    return np.concatenate([*sets, np.empty(0, U)]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def word_stream(data: np.ndarray, space: np.ndarray | None = None, size: int = 0) -> Iterator[tuple[int, int, np.ndarray]]:
    """The words of one text of any length, piece by piece: bytes [i, j) and the hashes of the words in them.

    Pieces are of at most ``size`` bytes (0: CHUNK) and end behind a separator; a longer word is a piece of its own, and hashed in slices.
    """
    size, space = size or CHUNK, white() if space is None else space
    at, n = 0, len(data)
    while at < n:
        end = min(at + size, n)
        gaps = np.flatnonzero(space[data[at:end]]) if end < n else None
        if gaps is None or len(gaps):
            end = n if gaps is None else at + int(gaps[-1]) + 1
            yield at, end, word_hashes(data[at:end], np.array([0, end - at]), space)[0]
        else:
            total, end = 0, at
            while end < n:
                part = data[end : end + size]
                gap = np.flatnonzero(space[part])
                part = part[: gap[0]] if len(gap) else part
                total += int((byte_values()[part] * powers_to(len(part))[0][: len(part)]).sum(dtype=U)) * pow(BASE, end - at, 1 << 64)
                end += len(part)
                if len(gap):
                    break
            yield at, end, mix(np.array([total % (1 << 64)], U))
        at = end


class Distinct:
    """Distinct hashes gathered piece by piece: sorted runs that are merged as they grow, so memory stays near the result's."""

    def __init__(self) -> None:
        self.runs: list[np.ndarray] = []

    def add(self, hashes: np.ndarray) -> None:
        self.runs.append(np.unique(hashes))
        while len(self.runs) > 1 and len(self.runs[-2]) <= 2 * len(self.runs[-1]):
            self.runs.append(np.unique(np.concatenate([self.runs.pop(), self.runs.pop()])))

    def values(self) -> np.ndarray:
        return np.unique(np.concatenate([*self.runs, np.empty(0, U)]))


def long_shingles(data: np.ndarray, k: int, space: np.ndarray | None = None, size: int = 0) -> np.ndarray:
    """The distinct k-word shingles of one text of any length: those of its pieces, each with the last k - 1 words before it."""
    found, held = Distinct(), np.empty(0, U)
    n = 0
    for _, _, words in word_stream(data, space, size):
        n += len(words)
        held = np.concatenate([held, words])
        if len(held) >= k:
            found.add(shingle_hashes(held, np.array([0, len(held)]), k)[0])
            held = held[len(held) - k + 1 :]
    if 0 < n < k:
        return shingle_hashes(held, np.array([0, n]), k)[0]
    return found.values()


def shingle_sets(batch: pa.RecordBatch, k: int, space: np.ndarray | None = None, limit: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows [i, j) with their distinct k-word shingles, sorted, and where each row's begin. A text above the limit is read in pieces."""
    limit = limit or CHUNK
    for i, j, data, offsets in text_chunks(batch, limit=limit):
        if len(data) <= limit:
            yield i, j, *distinct_sets(*shingle_hashes(*word_hashes(data, offsets, space), k))
        else:
            values = long_shingles(data, k, space, limit)
            yield i, j, values, np.array([0, len(values)])


def sketches(values: np.ndarray, begin: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """Minwise sketches (n x k of uint32); those of empty sets are all ones."""
    out = np.full((len(begin) - 1, k), 0xFFFFFFFF, dtype=np.uint32)
    some = np.flatnonzero(np.diff(begin) > 0)
    if len(some):
        starts = begin[:-1][some]
        for j, a in enumerate(numbers(seed, k, odd=True)):
            if len(some) == 1:  # one set of any size, in slices
                out[some, j] = min(int(((values[s : s + CHUNK] * a) >> U(32)).min()) for s in range(0, len(values), CHUNK))
            else:
                out[some, j] = np.minimum.reduceat(((values * a) >> U(32)).astype(np.uint32), starts)
    return out


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows [i, j) of a batch with at most ``limit`` bytes of text (or one row): their bytes and offsets from 0. Null texts are empty."""
    texts = batch.column(batch.schema.get_field_index(column))
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    n = len(texts)
    if not n:
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
