"""Spelling variants: words at distance one by a trie self-join, each with the common word that it is a variant of.

Words are counted with built-in functions. Two words at distance one differ at one place, so they share all letters
before it and all after it. A word of length m is cut in two pieces; a unit of work is a trie of the words that agree
outside one piece, keyed by the shared prefix and suffix. Down that trie each node carries its active set: the nodes
at distance one. A node of the set is kept with its first difference only, so a pair of words is found in the one unit
of the piece where they first differ, and once there.

Units of more than ``most`` words (one prefix may hold a third of the vocabulary) have their piece halved until they
are small. A piece of one letter ends that: its unit has at most one word per letter and per pair of letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import releasing
from .shared import discard, in_units, lookup, materialize, whole_units

#: What a word is made of: fixed values.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLIP = 199
#: A form is at least so many times as frequent.
FACTOR = 5
#: Words of a unit.
UNIT = 20_000

Arrays = tuple[np.ndarray, np.ndarray]


def word_counts(docs: DataFrame, slip: int = SLIP, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """``(word, n)``: the words of all texts and how often each occurs.

    A run whose checksum with its doc_id is a multiple of ``slip`` loses one letter. Null texts have no words, a null
    doc_id counts as empty, rows that repeat are counted each time.
    """
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % slip == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _unit() -> Column:
    """A unit's name: words of one pair of lengths that agree outside the letters ``lo`` to ``hi`` of the shorter."""
    return F.xxhash64("m", "lo", "hi", F.expr("left(word, lo)"), F.expr("right(word, m - hi)"))


def units(words: DataFrame, most: int = UNIT) -> DataFrame:
    """Rows ``(unit, m, lo, hi, word, n)``: each word in the units where it may meet words of length m and m + 1."""
    size = F.length("word")
    rows = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    halves = F.array(F.struct(F.lit(0).alias("lo"), F.floor(F.col("m") / 2).cast("int").alias("hi")), F.struct(F.floor(F.col("m") / 2).cast("int").alias("lo"), F.col("m").alias("hi")))
    rows = rows.withColumn("piece", F.explode(halves)).select("m", "piece.lo", "piece.hi", "word", "n").where("lo < hi").withColumn("unit", _unit())
    while True:
        large = materialize(rows.where("hi - lo > 1").groupBy("unit").agg(F.count("*").alias("size")).where(F.col("size") > most).select("unit", F.lit(True).alias("large")), "large_units")
        if large.isEmpty():
            discard(large)
            return rows
        marked = materialize(lookup(rows, "unit", "word", large), "marked_units")
        cut = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        finer = marked.where("large").withColumn("piece", F.explode(F.array(F.struct(F.col("lo").alias("lo"), cut.alias("hi")), F.struct(cut.alias("lo"), F.col("hi").alias("hi")))))
        finer = finer.select("m", "piece.lo", "piece.hi", "word", "n").withColumn("unit", _unit())
        rows = marked.where("large IS NULL").drop("large").unionByName(finer)


def _each(starts: np.ndarray, counts: np.ndarray) -> Arrays:
    """For ranges of numbers: which range each number is from, and the number."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[which]


class Trie:
    """Tries side by side, one a unit. Nodes 0 to units - 1 are the roots; the children of a node have numbers in a row."""

    def __init__(self, roots: np.ndarray, n_roots: int, letters: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        """Word i is ``letters[starts[i] : starts[i] + lengths[i]]``, under the root ``roots[i]``."""
        at, keys, n = roots.copy(), [np.empty(0, np.int64)], n_roots
        live = np.flatnonzero(lengths > 0)
        self.levels = [(0, n_roots)]
        while len(live):
            depth = len(self.levels) - 1
            made, inverse = np.unique(at[live] << 8 | letters[starts[live] + depth], return_inverse=True)
            at[live] = n + inverse
            keys.append(made)
            self.levels.append((n, n + len(made)))
            n += len(made)
            live = live[lengths[live] > depth + 1]
        self.keys, self.n_roots = np.concatenate(keys), n_roots
        self.letter = np.concatenate([np.zeros(n_roots, np.int64), self.keys & 255])
        parents = self.keys >> 8
        self.n_children = np.bincount(parents, minlength=n)
        self.first_child = n_roots + np.searchsorted(parents, np.arange(n))
        self.word = np.full(n, -1, np.int64)
        self.word[at] = np.arange(len(at))
        self.n = n

    def child(self, nodes: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The child of each node by that letter, or -1."""
        key = nodes << 8 | letters
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[k] == key, k + self.n_roots, -1) if len(self.keys) else np.full(len(nodes), -1)

    def siblings(self, nodes: np.ndarray) -> Arrays:
        """All pairs of children of the same node, the lesser letter first."""
        which, a = _each(self.first_child[nodes], self.n_children[nodes])
        end = self.first_child[nodes] + self.n_children[nodes]
        i, b = _each(a + 1, end[which] - a - 1)
        return a[i], b


def active_pairs(trie: Trie) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level, the pairs of nodes at distance one and the depth of their first difference.

    The first node is at the level; the other beside it (another letter) or one below (one letter more). Each pair
    comes from its parents' pair by one equal letter, or is new: children of one node, or a node and its child. A node
    and its child by y go on by letters other than y only, as by y they would differ further down.
    """
    none = np.empty(0, np.int64)
    same, longer, fresh = (none, none, none), (none, none, none), (none, none)
    for depth, (begin, end) in enumerate(trie.levels):
        nodes = np.arange(begin, end)
        if depth:
            steps = []
            for u, v, born, but in ((*same, False), (*longer, False), (*fresh, np.full(len(fresh[0]), depth - 1), True)):
                i, c = _each(trie.first_child[u], trie.n_children[u])
                d = trie.child(v[i], trie.letter[c])
                ok = (d >= 0) & (trie.letter[c] != trie.letter[v[i]] if but else True)
                steps.append((c[ok], d[ok], born[i[ok]]))
            a, b = trie.siblings(np.arange(*trie.levels[depth - 1]))
            same = tuple(np.concatenate(x) for x in zip(steps[0], (a, b, np.full(len(a), depth - 1))))
            longer = tuple(np.concatenate(x) for x in zip(steps[1], steps[2]))
        i, below = _each(trie.first_child[nodes], trie.n_children[nodes])
        fresh = (nodes[i], below)
        yield from ((*same,), (*longer,), (*fresh, np.full(len(below), depth)))


def near_words(table: pa.Table) -> Arrays:
    """Row indices of the pairs of words at distance one that belong to the units of a table of whole units."""
    col = {c: table.column(c).to_numpy() for c in ("unit", "m", "lo", "hi")}
    words = table.column("word").to_pylist()
    size = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8).astype(np.int64)
    m, lo, hi = (col[c].astype(np.int64) for c in ("m", "lo", "hi"))
    units_, roots = np.unique(col["unit"], return_inverse=True)
    trie = Trie(roots, len(units_), letters, np.cumsum(size) - size + lo, hi - lo + size - m)
    left, right = [], []
    for u, v, born in active_pairs(trie):
        a, b = trie.word[u], trie.word[v]
        ok = (a >= 0) & (b >= 0)
        a, b, born = a[ok], b[ok], born[ok]
        # The shorter has m letters. A letter added after the piece belongs to the next one, where there is one.
        ok = (size[a] == m[a]) & ((born < (hi - lo)[a]) | (hi[a] == m[a]))
        left.append(a[ok])
        right.append(b[ok])
    return np.concatenate(left), np.concatenate(right)


def near_pairs(words: DataFrame, most: int = UNIT) -> DataFrame:
    """``(word, near, near_n)`` for all pairs of words that differ by one inserted, deleted or replaced letter, both ways."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            a, b = near_words(table)
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
            word, n = table.column("word").combine_chunks(), table.column("n").combine_chunks()
            yield pa.RecordBatch.from_arrays([word.take(pa.array(a)), word.take(pa.array(b)), n.take(pa.array(b))], names=["word", "near", "near_n"])

    return in_units(units(words, most), run, "word string, near string, near_n long")


def roots(forms: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``(word, root)`` from ``(word, form)``: the last word from each on, by pointer doubling. A form is more frequent than its word, so there are no circles."""
    top = materialize(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    for _ in range(max_rounds):
        step = top.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = materialize(lookup(top.drop("moved"), "root", "word", step).select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        discard(top)
        top = after
        if top.where("moved").isEmpty():
            return top.drop("moved")
    raise RuntimeError(f"roots: still moving after {max_rounds} rounds")


def variants(docs: DataFrame, slip: int = SLIP, least_length: int = 6, least_count: int = 5, factor: int = FACTOR, most: int = UNIT) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` for every word of the corpus.

    ``form``: the near word of largest n (of equals the least in code-point order), if that is at least ``factor`` times
    the word's own; else null. ``root``: the end of the chain of forms. Only doc_id and text are read, so columns of any
    other name do no harm. Null and empty texts and empty tables give no words; texts of any length are read whole; rows
    that repeat count each time.
    """
    words = materialize(word_counts(docs, slip, least_length, least_count), "words")
    # The greatest count first, of equals the least word: the least of (-n, word).
    near = near_pairs(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("w"))).alias("best"))
    is_form = -F.col("best.n") >= factor * F.col("n")
    found = words.join(near, "word", "left").select("word", F.when(is_form, F.col("best.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, -F.col("best.n")).alias("form_n"))
    found = materialize(found, "forms")
    out = found.join(roots(found.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
