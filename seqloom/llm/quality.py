"""Quality scores: histogram gradient-boosted trees over document statistics, flattened for numpy traversal.

The statistics come from the byte kernels, one pass over each whole text. Trees are grown level by level on
binned columns of a bounded labelled sample, with one histogram of gradients per (node, column, bin). The grown
forest is three arrays (column, bin, value) over complete binary trees; scoring moves all rows of a batch down one
level of one tree at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK, U, Distinct, distinct_sets, releasing, shingle_hashes, text_chunks, word_hashes, word_stream
from .language import learnable

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "mean_word", "std_word", "short_words", "long_words", "distinct_words", "distinct_trigrams",
    "upper", "lower", "digit", "space", "non_ascii", "stops", "quotes", "symbols", "other_marks",
    "capital_words", "marked_words", "mean_line", "distinct_lines", "byte_entropy", "top_byte",
)


def byte_classes() -> np.ndarray:
    """0 upper, 1 lower, 2 digit, 3 space, 4 non-ASCII, 5 stops, 6 quotes and brackets, 7 symbols, 8 other ASCII."""
    k = np.full(256, 8, np.uint8)
    k[65:91], k[97:123], k[48:58], k[128:] = 0, 1, 2, 4
    for n, group in ((3, b" \t\n\v\f\r"), (5, b".,;:?"), (6, b"'\"()[]"), (7, b"!#$%&*+/<=>@\\^_`{|}~")):
        k[list(group)] = n
    return k


CLASSES = byte_classes()
NEWLINE = np.arange(256) == 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x STATISTICS; the row of an empty text is all zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds = np.bincount(text * 9 + CLASSES[data], minlength=9 * n).reshape(n, 9)
    each = np.bincount(text * 256 + data, minlength=256 * n).reshape(n, 256)
    words, at = word_hashes(data, offsets)
    many = np.diff(at)
    inside = CLASSES[data] != 3
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(inside & (edge[:-1] | ~np.append(False, inside[:-1])))
    last = np.flatnonzero(inside & (edge[1:] | ~np.append(inside[1:], False)))
    length = (last - first + 1).astype(float)
    word_text = np.repeat(np.arange(n), many)
    total = lambda x: np.bincount(word_text, weights=x, minlength=n)
    per_word = lambda x: total(x) / np.maximum(many, 1)
    mean = per_word(length)
    _, set_at = distinct_sets(words, at)
    three, three_at = shingle_hashes(words, at, 3)
    _, three_set = distinct_sets(three, three_at)
    lines, line_at = word_hashes(data, offsets, NEWLINE)
    _, line_set = distinct_sets(lines, line_at)
    share = each / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    ratio = lambda a, b: np.diff(a) / np.maximum(np.diff(b), 1)
    fractions = (kinds / np.maximum(size, 1)[:, None]).T
    return np.column_stack([
        np.log1p(size), np.log1p(many), np.log1p(np.diff(line_at)), mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)),
        per_word(length <= 3), per_word(length > 14), ratio(set_at, at), ratio(three_set, three_at),
        *fractions, per_word(CLASSES[data[first]] == 0), per_word(CLASSES[data[last]] >= 5),
        np.log1p(many / np.maximum(np.diff(line_at), 1)), ratio(line_set, line_at), entropy, share.max(axis=1, initial=0),
    ])


def long_statistics(data: np.ndarray, size: int = 0) -> np.ndarray:
    """The same of one text of any length, summed over its pieces."""
    each = np.zeros(256)
    many = three_many = 0
    sums = np.zeros(6)  # length, its square, short, long, capital, marked
    distinct, three, lines, held, line_count = Distinct(), Distinct(), Distinct(), np.empty(0, U), 0
    for i, j, words in word_stream(data, size=size):
        part = data[i:j]
        for s in range(0, len(part), CHUNK):
            each += np.bincount(part[s : s + CHUNK], minlength=256)
        if len(words):
            if j - i <= (size or CHUNK):
                inside = np.concatenate([[False], CLASSES[part] != 3, [False]])
                first, last = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
            else:  # one long word
                first, last = np.array([0]), np.array([j - i - 1])
            length = (last - first + 1).astype(float)
            sums += length.sum(), (length**2).sum(), (length <= 3).sum(), (length > 14).sum(), (CLASSES[part[first]] == 0).sum(), (CLASSES[part[last]] >= 5).sum()
            distinct.add(words)
            held = np.concatenate([held, words])
            many += len(words)
            if len(held) >= 3:
                found = shingle_hashes(held, np.array([0, len(held)]), 3)[0]
                three_many += len(found)
                three.add(found)
                held = held[len(held) - 2 :]
    for _, _, words in word_stream(data, NEWLINE, size):
        line_count += len(words)
        lines.add(words)
    if 0 < many < 3:
        three_many = 1
    n, share = max(len(data), 1), each / max(len(data), 1)
    w = max(many, 1)
    mean = sums[0] / w
    kinds = np.bincount(CLASSES, weights=each, minlength=9) / n
    ratio = lambda d, c: len(d.values()) / max(c, 1)
    return np.array([
        np.log1p(len(data)), np.log1p(many), np.log1p(line_count), mean, np.sqrt(max(sums[1] / w - mean**2, 0)), sums[2] / w, sums[3] / w, ratio(distinct, many),
        ratio(three, three_many) if many >= 3 else float(many > 0), *kinds, sums[4] / w, sums[5] / w, np.log1p(many / max(line_count, 1)), ratio(lines, line_count),
        -(share * np.log2(np.where(share > 0, share, 1))).sum(), share.max(initial=0),
    ])


def each_statistics(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    """Runs of rows [i, j) and their statistics."""
    for i, j, data, offsets in text_chunks(batch):
        yield i, j, statistics(data, offsets) if len(data) <= CHUNK else long_statistics(data)[None, :]


@dataclass
class Forest:
    """``edges``: bin borders of each column; ``column``, ``bin``: trees x inner nodes (a row goes left if its bin is at most ``bin``); ``value``: trees x leaves."""

    edges: list[np.ndarray]
    column: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int16)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        binned, rows = self.bins(x), np.arange(len(x))
        margin = np.full(len(x), self.start)
        inner = self.column.shape[1]
        for column, border, value in zip(self.column, self.bin, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (binned[rows, column[node]] > border[node])
            margin += value[node - inner]
        return 1 / (1 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, smooth: float = 1.0) -> Forest:
    """Fit to labels 0 and 1 by second-order boosting of the logistic loss. Without rows, every score is 0.5; with one label only, it is near that label."""
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(1) for j in range(m)]
    rate1 = (y.sum() + 0.5) / (n + 1)
    inner = 2**depth - 1
    out = Forest(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), bins, np.int64), np.zeros((trees, inner + 1)), float(np.log(rate1 / (1 - rate1))))
    if not n:
        return out
    binned = out.bins(x).astype(np.int64)
    margin = np.full(n, out.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base, wide = 2**level - 1, 2**level
            local = node - base
            best = np.full(wide, 1e-9)
            for j in range(m):
                key = local * bins + binned[:, j]
                gs = np.bincount(key, weights=g, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                hs = np.bincount(key, weights=h, minlength=wide * bins).reshape(wide, bins).cumsum(axis=1)
                ga, ha = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + smooth) + (ga - gs) ** 2 / (ha - hs + smooth) - ga**2 / (ha + smooth)
                gain[:, -1] = 0
                at = gain.argmax(axis=1)
                top = gain[np.arange(wide), at]
                better = top > best
                best[better] = top[better]
                out.column[t, base : base + wide][better] = j
                out.bin[t, base : base + wide][better] = at[better]
            node = 2 * node + 1 + (binned[np.arange(n), out.column[t, node]] > out.bin[t, node])
        leaf = node - inner
        gl, hl = np.bincount(leaf, weights=g, minlength=inner + 1), np.bincount(leaf, weights=h, minlength=inner + 1)
        out.value[t] = rate * gl / (hl + smooth)
        margin += out.value[t][leaf]
    return out


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``statistics`` of the whole text as an array of doubles."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", statistics array<double>"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in each_statistics(batch):
                part = batch.slice(i, j - i)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), lists], names=[*keep, "statistics"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> Forest:
    """Fit on about ``most`` labelled rows chosen by a hash of doc_id; rows with null doc_id or label teach nothing, of several labels of one document the largest counts, and of several rows with one doc_id the text of least hash."""
    labels = labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n = labels.count()
    draw = F.pmod(F.xxhash64("doc_id", F.lit(31)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # At most `most` rows and a chance excess: small enough to be broadcast whatever the table's size.
    sample = labels.where(draw < min(1.0, most / max(1, n)))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("pick", F.xxhash64("text"))
    # Of rows that share a doc_id one teaches, so the driver gets no more rows than there are sampled labels.
    once = with_statistics(texts, ["doc_id", "quality", "pick"]).groupBy("doc_id").agg(F.min(F.struct("pick", "quality", "statistics")).alias("row"))
    rows = once.select("row.quality", "row.statistics").toPandas()
    x = np.array(rows["statistics"].tolist(), float).reshape(len(rows), len(STATISTICS))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, np.int64)  # rows arrive in any order; sums should not depend on it
    return grow(x[order], (rows["quality"].to_numpy() > 0).astype(float)[order])


def predict(docs: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and ``score``, the probability of label 1 (null texts count as empty)."""
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, x in each_statistics(batch):
                part = batch.slice(i, j - i)
                score = pa.array(forest.score(x), pa.float64())
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in keep), score], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document; learns only labels of rows that are not held out.

    Null and empty texts have all statistics 0 and get that leaf's score. A null doc_id is not held out and has no
    label; rows that repeat are rows like any other. Texts of any length are read whole; a score of exactly the
    threshold is 1; an empty table gives an empty result; other columns are not read. Without labels every score is 0.5.
    """
    learn: Column
    learn, held = learnable(F.col("doc_id"), 5, 0)
    forest = train(docs, labels.where(learn))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), forest, ["doc_id"])
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
