"""Longest common subsequence in bit vectors: numpy kernels for blocks and pair lists, and one Spark expression.

Indel similarity is 2 LCS / (la + lb). All thresholds compare whole numbers, so a pair exactly on the border is
decided exactly. Strings lie one behind the other in one array, so a long one costs its own length and nothing more.
The kernels hold one string of each pair in a word; pairs of two longer ones use Python's integers. Where all pairs are
asked for, one string is run over thousands of others at a time, a step a letter (:class:`Words`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U = np.uint64
WORD = 64
#: Pairs, and letters, that a kernel works on at once.
PAIRS, LETTERS = 1 << 15, 1 << 22


class Strings:
    """ASCII strings in a row: ``codes[start[i] : start[i] + size[i]]`` is string i. Other letters are an error, as they would not compare."""

    def __init__(self, strings: list[str]) -> None:
        self.strings = strings
        self.size = np.array([len(s) for s in strings], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.codes = np.frombuffer("".join(strings).encode("ascii"), np.uint8)

    def __len__(self) -> int:
        return len(self.strings)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """Ranges of strings with about LETTERS letters."""
        at = 0
        while at < len(self):
            end = max(at + 1, int(np.searchsorted(self.start, self.start[at] + LETTERS)))
            yield at, end
            at = end

    def counts(self, letters: np.ndarray, most: int) -> np.ndarray:
        """How often each string has each of the letters, up to ``most``, in the least type that holds that."""
        k = len(letters)
        column = np.full(256, k)
        column[letters] = np.arange(k)
        out = np.zeros((len(self), k), np.min_scalar_type(most))
        for i, j in self.blocks():
            row = np.repeat(np.arange(j - i), self.size[i:j])
            seen = np.bincount(row * (k + 1) + column[self.codes[self.start[i] : self.start[j - 1] + self.size[j - 1]]], minlength=(j - i) * (k + 1))
            out[i:j] = np.minimum(seen.reshape(j - i, k + 1)[:, :k], most)
        return out


class Shared:
    """Letters that two strings share, for all pairs: an upper bound of their LCS."""

    def __init__(self, a: Strings, b: Strings) -> None:
        letters = np.intersect1d(np.unique(a.codes), np.unique(b.codes))
        # What two strings share is at most the shorter's length, so counts above that need not be told apart.
        most = int(min(a.size.max(initial=0), b.size.max(initial=0)))
        self.a, self.b = a.counts(letters, most), b.counts(letters, most)

    def matrix(self, rows: np.ndarray | slice, columns: np.ndarray | slice) -> np.ndarray:
        a, b = self.a[rows], self.b[columns]
        out = np.zeros((len(a), len(b)), a.dtype)
        for x, y in zip(a.T, b.T):
            out += np.minimum(x[:, None], y[None, :])
        return out


def _by_words(a: Strings, b: Strings, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """LCS lengths of pairs whose string of ``a`` has at most WORD letters, by steps over the letters of ``b``."""
    rows, i = np.unique(i, return_inverse=True)
    letters = np.unique(b.codes)
    column = np.full(256, len(letters))
    column[letters] = np.arange(len(letters))
    table = np.zeros((len(rows), len(letters) + 1), U)
    size = a.size[rows]
    which = np.repeat(np.arange(len(rows)), size)
    place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
    np.bitwise_or.at(table, (which, column[a.codes[a.start[rows][which] + place]]), U(1) << place.astype(U))
    table[:, -1] = 0
    full = np.where(size >= WORD, ~U(0), (U(1) << np.minimum(size, WORD - 1).astype(U)) - U(1))
    out = np.zeros(len(i), np.int64)
    order = np.argsort(-b.size[j], kind="stable")
    for at in range(0, len(i), PAIRS):
        some = order[at : at + PAIRS]
        p, start, length = i[some], b.start[j[some]], -b.size[j[some]]
        s = np.full(len(some), ~U(0))
        for k in range(-int(length[0])):
            n = int(np.searchsorted(length, -k))  # pairs whose string goes on
            m = table[p[:n], column[b.codes[start[:n] + k]]]
            t = s[:n]
            s[:n] = (t + (t & m)) | (t & ~m)
        out[some] = np.bitwise_count(~s & full[p])
    return out


def lcs_of(a: Strings, b: Strings, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS lengths of the pairs ``(left[k], right[k])``."""
    out = np.zeros(len(left), np.int64)
    la, lb = a.size[left], b.size[right]
    by_a = (la <= WORD) & ((lb > WORD) | (lb <= la))  # a word for the longer one, where it fits, and steps over the shorter
    by_b = ~by_a & (lb <= WORD)
    if by_a.any():
        out[by_a] = _by_words(a, b, left[by_a], right[by_a])
    if by_b.any():
        out[by_b] = _by_words(b, a, right[by_b], left[by_b])
    for k in np.flatnonzero(~by_a & ~by_b).tolist():
        out[k] = lcs_long(a.strings[left[k]], b.strings[right[k]])
    return out


def lcs_pairs(a: list[str], b: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """LCS lengths of the pairs ``(a[left[k]], b[right[k]])``."""
    return lcs_of(Strings(a), Strings(b), np.asarray(left, np.int64), np.asarray(right, np.int64))


def lcs_long(a: str, b: str) -> int:
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        m = where.get(c, 0)
        s = ((s + (s & m)) | (s & ~m)) & full
    return len(a) - s.bit_count()


def lcs_matrix(a: list[str], b: list[str]) -> np.ndarray:
    i, j = np.divmod(np.arange(len(a) * len(b)), max(1, len(b)))
    return lcs_pairs(a, b, i, j).reshape(len(a), len(b))


#: Letters of a word and its type, strings that are compared with one string at once, and beginnings whose state is kept.
KINDS = ((16, np.uint16), (32, np.uint32), (64, np.uint64))
BLOCK, KEEP = 1 << 14, 64


class Words:
    """Strings of at most WORD letters beside one another, each in the top bits of the least word that holds all: what an addition carries falls off."""

    def __init__(self, size: np.ndarray, letters: dict[int, int], table: np.ndarray, start: np.ndarray) -> None:
        self.size, self.letters, self.table, self.start = size, letters, table, start

    @classmethod
    def of(cls, strings: Strings, rows: np.ndarray) -> Words:
        size = strings.size[rows]
        bits, kind = next(x for x in KINDS if size.max(initial=0) <= x[0])
        which = np.repeat(np.arange(len(rows)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        letters, column = np.unique(strings.codes[strings.start[rows][which] + place], return_inverse=True)
        table = np.zeros((len(letters), len(rows)), kind)
        np.bitwise_or.at(table, (column, which), kind(1) << (bits - size[which] + place).astype(kind))
        start = np.where(size > 0, ~kind(0) << np.minimum(bits - size, bits - 1).astype(kind), kind(0)).astype(kind)
        return cls(size, {int(c): k for k, c in enumerate(letters)}, table, start)

    def __getitem__(self, rows: np.ndarray | slice) -> Words:
        return Words(self.size[rows], self.letters, np.ascontiguousarray(self.table[:, rows]), self.start[rows])

    def sweep(self, others: list[bytes], limit: np.ndarray | Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(k, rows, left)`` for each of the sorted ``others`` and the rows that have fewer than ``limit`` letters (8 bits, read anew for each, or asked for) left beside a longest common subsequence with it.

        Each letter is one step for all rows, and strings that follow each other share the steps of their common beginning.
        """
        own: list[np.ndarray] = [self.start]
        state, before = [self.start], b""
        both, rest, left, hit = np.empty_like(self.start), np.empty_like(self.start), np.empty(len(self.start), np.uint8), np.empty(len(self.start), bool)
        for k, s in enumerate(others):
            at, end = 0, min(len(s), len(before), KEEP - 1)
            while at < end and s[at] == before[at]:
                at += 1
            before, now = s, state[at]
            del state[at + 1 :]
            for c in s[at:]:
                at = min(at + 1, KEEP)
                x = self.letters.get(c)
                if x is not None:
                    if at == len(own):
                        own.append(np.empty_like(self.start))
                    np.bitwise_and(now, self.table[x], out=both)
                    np.subtract(now, both, out=rest)
                    np.add(now, both, out=both)
                    now = np.bitwise_or(both, rest, out=own[at])
                elif at == len(own):
                    own.append(np.empty_like(self.start))
                if at == len(state):
                    state.append(now)
                else:
                    state[at] = now
            np.bitwise_count(now, out=left)
            np.less(left, limit(k) if callable(limit) else limit, out=hit)
            if hit.any():
                rows = np.flatnonzero(hit)
                yield k, rows, left[rows]


def _groups(strings: Strings) -> list[tuple[int, np.ndarray, list[bytes]]]:
    """The strings of each length: ``(length, rows, letters)``, in order."""
    order = np.array(sorted(range(len(strings)), key=strings.strings.__getitem__), np.int64)
    order = order[np.argsort(strings.size[order], kind="stable")]
    cuts = np.flatnonzero(np.diff(strings.size[order])) + 1
    return [(int(strings.size[x[0]]), x, [strings.strings[k].encode() for k in x.tolist()]) for x in np.split(order, cuts) if len(x)]


def _word_blocks(strings: Strings, most: int = WORD) -> Iterator[np.ndarray]:
    """Rows of at most ``most`` letters in blocks of one kind of word, by length."""
    order, low = np.argsort(strings.size, kind="stable"), -1
    for bits, _ in KINDS:
        some = order[(strings.size[order] > low) & (strings.size[order] <= min(bits, most))]
        # A larger word takes more room: blocks of about the same bytes.
        step = BLOCK if bits <= 32 else BLOCK // 2
        yield from (some[at : at + step] for at in range(0, len(some), step))
        low = bits


class Bags:
    """Strings as the letters they have, a bit for each "at least n of this letter": two strings share at most the common bits, and the lesser of what has no bit."""

    def __init__(self, a: Strings, b: Strings) -> None:
        """The 64 bits that tell most strings of both apart."""
        letters = np.unique(np.concatenate([np.unique(a.codes), np.unique(b.codes)]))
        self.column = np.full(256, len(letters))
        self.column[letters] = np.arange(len(letters))
        counts = np.concatenate([x.counts(letters, 255) for x in (a, b)])
        # At least n of a letter: the tail of its counts.
        tails = np.array([np.bincount(c, minlength=256)[::-1].cumsum()[::-1][1:] for c in counts.T]).reshape(len(letters), 255) / max(1, len(counts))
        best = np.argsort(-(tails * (1 - tails)).ravel(), kind="stable")[:WORD]
        self.bits = np.zeros((len(letters) + 1, 256), U)
        self.bits[best // 255, best % 255] = U(1) << np.arange(len(best), dtype=U)

    def beginnings(self, strings: Strings, rows: np.ndarray, back: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """``(bits, letters without one)`` of all beginnings of some strings (``back``: of all ends), by row and number of letters."""
        size = strings.size[rows]
        longest = int(size.max(initial=0))
        codes, rest = np.zeros((len(rows), longest + 1), U), np.zeros((len(rows), longest + 1), np.uint8)
        seen, every = np.zeros((len(rows), len(self.bits)), np.uint8), np.arange(len(rows))
        for k in range(longest):
            on = k < size
            place = strings.start[rows] + (size - 1 - k if back else k)
            letter = np.where(on, self.column[strings.codes[np.where(on, place, 0)]], len(self.bits) - 1)
            codes[:, k + 1] = codes[:, k] | self.bits[letter, seen[every, letter]]
            seen[every, letter] += on
            rest[:, k + 1] = np.minimum(k + 1, size) - np.bitwise_count(codes[:, k + 1])
        return codes, rest


#: Pairs that are measured at once, strings after which a group's share of such pairs is known, and the share from which a sweep is faster.
MEASURED, PROBE, DENSE = 1 << 15, 64, 0.15


class Near:
    """The pairs of two lists that may be at a threshold: they share enough letters as wholes, and in two parts cut about the middle."""

    def __init__(self, a: Strings, b: Strings) -> None:
        """Strings of at most 2 WORD letters."""
        self.a, self.b, bags = a, b, Bags(a, b)
        (front, front_rest), (back, back_rest) = (bags.beginnings(a, np.arange(len(a)), x) for x in (False, True))
        (self.front, self.front_rest), (self.back, self.back_rest) = (bags.beginnings(b, np.arange(len(b)), x) for x in (False, True))
        every, half = np.arange(len(a)), a.size // 2
        self.code, self.rest = front[every, a.size], front_rest[every, a.size]
        self.halves = [(front[every, half], front_rest[every, half]), (back[every, a.size - half], back_rest[every, a.size - half])]
        every = np.arange(len(b))
        self.other, self.other_rest = self.front[every, b.size], self.front_rest[every, b.size]

    def kept(self, i: np.ndarray, j: np.ndarray, need: np.ndarray) -> np.ndarray:
        """Which pairs go on: letters of the first half meet those of a beginning that is longer by what may be left out, the others those of such an end."""
        half, spare, size = self.a.size[i] // 2, self.a.size[i] - need, self.b.size[j]
        ends = np.minimum(half + size - need, size), np.minimum(size - half + spare, size)
        shared = np.zeros(len(i), np.int64)
        for (code, rest), (other, other_rest), end in zip(self.halves, ((self.front, self.front_rest), (self.back, self.back_rest)), ends):
            shared += np.bitwise_count(code[i] & other[j, end])
            shared += np.minimum(rest[i], other_rest[j, end])
        return shared >= need

    def meet(self, rows: np.ndarray, need: np.ndarray, names: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]] | None:
        """``(i, j, lcs)`` of the pairs of ``rows`` and ``names`` that need ``need`` common letters (by row) and have them; None where most pairs share enough letters."""
        code, rest, limits = self.code[rows], self.rest[rows], {}
        both, shared, hit = np.empty_like(code), np.empty(len(rows), np.uint8), np.empty(len(rows), bool)
        need = np.maximum(need, 0)

        def passing(k: int) -> np.ndarray:
            free = int(self.other_rest[k])
            if free not in limits:
                limits[free] = np.clip(need - np.minimum(rest, free), 0, 255).astype(np.uint8)
            np.bitwise_and(code, self.other[k], out=both)
            np.bitwise_count(both, out=shared)
            np.greater_equal(shared, limits[free], out=hit)
            return np.flatnonzero(hit)

        probe = [passing(k) for k in names[:PROBE].tolist()]
        if sum(map(len, probe)) > DENSE * len(rows) * len(probe):
            return None

        def measured(found: list[np.ndarray], at: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            place, j = np.concatenate(found), np.repeat(names[at], [len(x) for x in found])
            i, least = rows[place], need[place]
            ok = self.kept(i, j, least)
            i, j, least = i[ok], j[ok], least[ok]
            n = lcs_of(self.a, self.b, i, j)
            ok = n >= least
            return i[ok], j[ok], n[ok]

        def run() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            found, at, total = [], [], 0
            for k, name in enumerate(names.tolist()):
                some = probe[k] if k < len(probe) else passing(name)
                found.append(some)
                at.append(k)
                total += len(some)
                if total >= MEASURED:
                    yield measured(found, at)
                    found, at, total = [], [], 0
            if found:
                yield measured(found, at)

        return run()


def near_pairs(a: Strings, b: Strings | None, percent: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, lcs)`` of the pairs with a similarity of at least ``percent`` (``strict``: above it); without ``b`` those inside ``a``, each once.

    Strings that fit a word meet all strings of fitting lengths: only pairs that share enough letters are measured (:class:`Near`), or where
    most do, all are swept over. Longer ones are pruned by the letters they share.
    """
    own, other = b is None, a if b is None else b
    left, right, common = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    groups = _groups(other)
    rank = np.empty(len(other), np.int64)
    rank[np.concatenate([g[1] for g in groups] or [np.zeros(0, np.int64)])] = np.arange(len(other))
    # Strings that a row of at most WORD letters may be near to have a bounded length, unless the threshold is low.
    fit = np.flatnonzero(other.size <= 2 * WORD)
    place = np.empty(len(other), np.int64)
    place[fit] = np.arange(len(fit))
    short = np.flatnonzero(a.size <= WORD)
    where = np.empty(len(a), np.int64)
    where[short] = np.arange(len(short))
    pick = lambda x, rows: x if len(rows) == len(x) else Strings([x.strings[k] for k in rows.tolist()])
    near = Near(pick(a, short), pick(other, fit))
    for rows in _word_blocks(a):
        words = Words.of(a, rows)
        for length, names, letters in groups:
            need = percent * (words.size + length) // 200 + 1 if strict else -(-percent * (words.size + length) // 200)
            live = np.flatnonzero((need <= np.minimum(words.size, length)) & ((words.size >= length) | (not own)))  # of one table, a string meets those that are not longer
            if not len(live):
                continue
            live = slice(int(live[0]), int(live[-1]) + 1)  # rows are sorted by length, and so are those that fit
            if length <= 2 * WORD and (found := near.meet(where[rows[live]], need[live], place[names])) is not None:
                for i, j, n in found:
                    i, j = short[i], fit[j]
                    ok = rank[i] > rank[j] if own else slice(None)
                    for x, y in zip((left, right, common), (i, j, n)):
                        x.append(y[ok])
                continue
            limit = np.clip(words.size[live] - need[live] + 1, 0, 255).astype(np.uint8)
            for k, some, over in words[live].sweep(letters, limit):
                some = some + live.start
                ok = rank[rows[some]] > rank[names[k]] if own else slice(None)
                left.append(rows[some][ok])
                right.append(np.full(len(left[-1]), names[k]))
                common.append((words.size[some] - over)[ok])
    long = np.flatnonzero(a.size > WORD)
    if len(long):
        far = Strings([a.strings[k] for k in long.tolist()])
        rest = np.flatnonzero(a.size <= WORD) if own else np.arange(len(other))
        some = Strings([other.strings[k] for k in rest.tolist()])
        for found, place in ((_near_long(far, None, percent, strict), long), (_near_long(far, some, percent, strict), rest)) if own else ((_near_long(far, some, percent, strict), rest),):
            left.append(long[found[0]])
            right.append(place[found[1]])
            common.append(found[2])
    return np.concatenate(left), np.concatenate(right), np.concatenate(common)


def best_of(a: Strings, b: Strings, percent: int | None = None, own: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(partner, lcs, total, near)`` by row of ``a``: its best partner in ``b`` (greatest ratio, then least string; -1: none), their LCS and total length, and how many are above ``percent``.

    ``own``: a string is no partner of itself. ``b`` must be sorted. Lengths are met by falling ratio of what they allow, and rows leave
    those that allow less than their best.
    """
    best, lcs, total, near = np.full(len(a), -1), np.zeros(len(a), np.int64), np.ones(len(a), np.int64), np.zeros(len(a), np.int64)
    groups = _groups(b)
    for rows in _word_blocks(a):
        words = Words.of(a, rows)
        mean = float(words.size.mean())
        top, over, of, many = np.full(len(rows), len(b)), np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for length, names, letters in sorted(groups, key=lambda g: -min(mean, g[0]) / max(mean, g[0], 1)):
            both = words.size + length
            need = -(-over * both // of)
            if percent is not None:
                need = np.minimum(need, percent * both // 200 + 1)
            live = np.flatnonzero(need <= np.minimum(words.size, length))
            if not len(live):
                continue
            part, whole = (words[live], live) if 2 * len(live) < len(rows) else (words, np.arange(len(rows)))
            limit = np.clip(words.size - need + 1, 0, 255).astype(np.uint8)[whole]
            floor = np.zeros(len(whole), np.uint8) if percent is None else np.clip(words.size - percent * both // 200, 0, 255).astype(np.uint8)[whole]
            for k, some, left in part.sweep(letters, limit):
                at, name = whole[some], names[k]
                n, t = words.size[at] - left, both[at]
                if own:
                    ok = ~((n == length) & (t == 2 * n))
                    some, at, n, t, left = some[ok], at[ok], n[ok], t[ok], left[ok]
                if percent is not None:
                    many[at] += 200 * n > percent * t
                gain = n * of[at] - over[at] * t
                equal = gain >= 0
                limit[some[equal]] = np.maximum(left[equal], floor[some[equal]])
                won = at[(gain > 0) | (equal & (name < top[at]))]
                top[won], over[won], of[won] = name, words.size[won] - left[(gain > 0) | (equal & (name < top[at]))], both[won]
        best[rows], lcs[rows], total[rows], near[rows] = np.where(top < len(b), top, -1), over, of, many
    long = np.flatnonzero(a.size > WORD)
    if len(long) and len(b):
        far = Strings([a.strings[k] for k in long.tolist()])
        place = {s: k for k, s in enumerate(b.strings)} if own else {}
        same = np.array([place.get(s, -1) for s in far.strings])
        shared = Shared(far, b)
        for at in range(0, len(far), ROWS):
            p, q, n = best_pairs(far, b, np.arange(at, min(at + ROWS, len(far))), shared, False, 1.0 if percent is None else percent / 100, same)
            t = far.size[p] + b.size[q]
            if percent is not None:
                near[long] += np.bincount(p[200 * n > percent * t], minlength=len(far))
            order = np.lexsort((q, -(n / np.maximum(t, 1)), p))
            first = order[np.unique(p[order], return_index=True)[1]]
            best[long[p[first]]], lcs[long[p[first]]], total[long[p[first]]] = q[first], n[first], t[first]
    return best, lcs, total, near


#: Strings of one side that give the others a first best.
FIRST = 256


def bests_of_both(a: Strings, b: Strings, percent: int) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(lcs, total, near)`` of the strings of ``a`` with ``b`` and of those of ``b`` with ``a``, of at most WORD letters: each pair is swept once and serves both.

    The LCS and total length are those of a greatest ratio (0 of 1, where nothing is shared); ``near`` counts what is above ``percent``.
    """
    lcs, total, near = np.zeros(len(a), np.int64), np.ones(len(a), np.int64), np.zeros(len(a), np.int64)
    groups, some = _groups(b), sorted(a.strings[:: -(-len(a) // FIRST)])
    _, b_over, b_of, _ = best_of(b, Strings(some))
    b_near = np.zeros(len(b), np.int64)
    for rows in _word_blocks(a):
        words = Words.of(a, rows)
        mean = float(words.size.mean())
        over, of, many = np.zeros(len(rows), np.int64), np.ones(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for length, names, letters in sorted(groups, key=lambda g: -min(mean, g[0]) / max(mean, g[0], 1)):
            both, reach = words.size + length, np.minimum(words.size, length)
            need = np.minimum(-(-over * both // of), percent * both // 200 + 1)
            least = float((b_over[names] / b_of[names]).min()) - 1e-12
            live = np.flatnonzero((need <= reach) | (least * both <= reach))
            if not len(live):
                continue
            part, whole = (words[live], live) if 2 * len(live) < len(rows) else (words, np.arange(len(rows)))
            own = np.clip(words.size - need + 1, 0, 255).astype(np.uint8)[whole]
            floor = np.clip(words.size - percent * both // 200, 0, 255).astype(np.uint8)[whole]
            # Rows are in the order of their sizes, and what a string needs of them depends on these.
            sizes, counts = np.unique(words.size[whole], return_counts=True)
            limit, sums = np.empty_like(own), sizes + length

            def asked(k: int) -> np.ndarray:
                least = b_over[names[k]] * sums // b_of[names[k]]  # noqa: B023
                return np.maximum(own, np.repeat(np.clip(sizes - least, 0, 255).astype(np.uint8), counts), out=limit)  # noqa: B023

            for k, hit, left in part.sweep(letters, asked):
                at, name = whole[hit], names[k]
                n, t = words.size[at] - left, both[at]
                above = 200 * n > percent * t
                many[at] += above
                b_near[name] += above.sum()
                won = n * of[at] > over[at] * t
                if won.any():
                    over[at[won]], of[at[won]] = n[won], t[won]
                    own[hit[won]] = np.maximum(left[won], floor[hit[won]])
                top = int((n / t).argmax())
                if n[top] * b_of[name] > b_over[name] * t[top]:
                    b_over[name], b_of[name] = n[top], t[top]
        lcs[rows], total[rows], near[rows] = over, of, many
    return (lcs, total, near), (b_over, b_of, b_near)


#: Rows whose bounds to all partners are held at once.
ROWS = 64


def _near_long(a: Strings, b: Strings | None, percent: int, strict: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of :func:`near_pairs`, of strings of any length.

    Strings are sorted by length: a run of equal lengths meets a window of lengths, and only pairs that share enough
    letters are measured.
    """
    own, b = b is None, a if b is None else b
    oa, ob = np.argsort(a.size, kind="stable"), np.argsort(b.size, kind="stable")
    sa, sb = a.size[oa], b.size[ob]
    shared = Shared(a, b)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(oa):
        n = int(sa[at])
        end = min(int(np.searchsorted(sa, n, side="right")), at + 256)
        low = np.searchsorted(sb * (200 - percent), percent * n)
        high = np.searchsorted(sb * percent, n * (200 - percent), side="right")
        low = max(int(low), at) if own else int(low)
        for c in range(low, int(high), 1 << 15):
            window = slice(c, min(c + (1 << 15), int(high)))
            need = (-(-percent * (n + sb[window]) // 200)).astype(shared.a.dtype)  # no more than the shorter length in this window
            i, j = np.nonzero(shared.matrix(oa[at:end], ob[window]) >= need)
            i, j = i + at, j + c
            ok = i < j if own else slice(None)
            left.append(oa[i[ok]])
            right.append(ob[j[ok]])
        at = end
    i, j = np.concatenate(left), np.concatenate(right)
    n, total = lcs_of(a, b, i, j), a.size[i] + b.size[j]
    ok = 200 * n > percent * total if strict else 200 * n >= percent * total
    return i[ok], j[ok], n[ok]


#: Pairs of each row that are measured in each wave, those of the greatest bounds first.
WAVES = (4, 12, 48)


def best_pairs(a: Strings, b: Strings, rows: np.ndarray, shared: Shared, own: bool = False, floor: float = 1.0, same: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(i, j, lcs)`` of the pairs of some rows that may be a row's best, or whose bound is at least ``floor``.

    Each row goes down its partners by falling bound, in waves, and leaves once its best is proven: what is bounded
    below the best found so far cannot win. ``own``: b is a, and a string is no partner of itself;
    ``same``: each row's own place in b (-1: none).
    """
    total = np.maximum(a.size[rows][:, None] + b.size[None, :], 1)
    bound = 2.0 * shared.matrix(rows, slice(None)) / total
    if own:
        bound[np.arange(len(rows)), rows] = -1
    if same is not None:
        bound[np.flatnonzero(same[rows] >= 0), same[rows][same[rows] >= 0]] = -1
    width = min(sum(WAVES), len(b))
    top = np.argpartition(-bound, width - 1, axis=1)[:, :width]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(bound, top, axis=1), axis=1, kind="stable"), axis=1)
    best, found, at = np.zeros(len(rows)), [], 0
    todo = np.ones(bound.shape, bool)
    live = np.arange(len(rows))

    def measure(p: np.ndarray, q: np.ndarray) -> None:
        n = lcs_of(a, b, rows[p], q)
        found.append((rows[p], q, n))
        np.maximum.at(best, p, 2 * n / total[p, q])

    for wave in WAVES:
        if at >= width or not len(live):
            break
        # The wave's first bound decides whether a row goes on; equal bounds may still tie.
        live = live[bound[live, top[live, at]] >= np.maximum(np.minimum(best[live], floor) - 1e-12, 0)]
        p, q = np.repeat(live, len(top[0, at : at + wave])), top[live, at : at + wave].ravel()
        todo[p, q] = False
        ok = bound[p, q] >= 0
        measure(p[ok], q[ok])
        at += wave
    todo &= bound >= np.maximum(np.minimum(best, floor)[:, None] - 1e-12, 0)
    p, q = np.nonzero(todo)
    measure(p, q)
    return tuple(np.concatenate(x) for x in zip(*found))


def lcs_column(a: Column, b: Column) -> Column:
    """LCS of two strings of at most 62 letters as a Spark expression (one 64-bit word, no Python)."""
    size = F.when(F.length(a) > 62, F.raise_error(F.lit("lcs_column: more than 62 letters"))).otherwise(F.length(a))
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k.cast("int"))
    full = bit(size) - 1
    at = F.sequence(F.lit(0), size - 1)
    where = lambda c: F.aggregate(F.filter(at, lambda k: F.substr(a, k + 1, F.lit(1)) == c), F.lit(0).cast("long"), lambda s, k: s + bit(k))
    letters = F.array_distinct(F.split(a, ""))
    table = F.map_from_arrays(letters, F.transform(letters, where))

    def step(s: Column, c: Column) -> Column:
        m = F.coalesce(F.element_at(table, c), F.lit(0).cast("long"))
        return (s + s.bitwiseAND(m)).bitwiseOR(s.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    return F.when((size == 0) | (F.length(b) == 0), 0).otherwise(size - F.bit_count(F.aggregate(F.split(b, ""), full, step)))


def indel_ratio(lcs: Column, la: Column, lb: Column) -> Column:
    return 2 * lcs / (la + lb)


def ratio_at_least(lcs: Column, la: Column, lb: Column) -> Column:
    """Ratio of at least 0.8, in whole numbers."""
    return 5 * lcs >= 2 * (la + lb)


def ratio_above(lcs: Column, la: Column, lb: Column) -> Column:
    """Ratio strictly above 0.8, in whole numbers."""
    return 5 * lcs > 2 * (la + lb)
