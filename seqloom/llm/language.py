"""Language spans of mixed texts: script ranges narrow the candidates, Viterbi over word scores labels the words.

A language's model is its smoothed log frequencies of letter trigrams (hashed to 2^16 bins, word borders
included), learnt from a bounded sample of labelled texts. A word's score is the sum over its trigrams; languages
that don't use the word's script are out. Viterbi with a switching penalty then labels all words of a text. With few
languages it runs in blocks of words: each block gives the best score from every entering to every leaving language, blocks are
chained, and the labels are read back inside all blocks at once, so a long text costs numpy steps per block
length and not per word.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import slices
from .kernels import releasing

#: Ranges of code points by script (fixed values); every letter outside them is of one further script.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x531, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
BINS = 1 << 16
PENALTY = 8.0
#: Characters above which a text is read in pieces.
LONG = 1 << 20
BLOCK = 128
#: Labels up to which Viterbi runs in blocks. Both forms compute in double precision and give the same labels.
BLOCK_LABELS = 12
#: Least share of a text's letters that its language must have for the text to be kept.
LEAST_SHARE = 0.3
OUT = np.float32(-1e4)


@functools.lru_cache(1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code point (0: not a letter) and script number of every code point."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x32400):
        if chr(c).isalpha():
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.full(0x110000, len(SCRIPTS), dtype=np.uint8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a : b + 1] = k
    return lower, script


@dataclass
class Words:
    """The words (runs of letters) of some texts: where each begins and ends among all code points, and its text."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    offsets: np.ndarray
    grams: np.ndarray
    first_gram: np.ndarray
    script: np.ndarray


def words_of(texts: list[str]) -> Words:
    lower, scripts = letters()
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    c = np.concatenate([np.zeros(1, np.uint32), lower[points]])
    inside = c > 0
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    # Trigrams that end at each letter and just after each word: 0 stands for what is outside.
    b, a = c[:-1], np.concatenate([np.zeros(1, np.uint32), c[:-2]])
    a = np.where(b > 0, a, 0)
    cur = c[1:]
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) ^ (cur * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    grams = (h >> np.uint32(16)).astype(np.int64)
    keep = inside[1:] | inside[:-1]
    place = np.cumsum(keep) - keep
    return Words(start, end, np.searchsorted(offsets, start, side="right") - 1, offsets, grams[keep], place[start], scripts[points[start]])


@dataclass
class Model:
    """``table``: languages x BINS log frequencies; ``uses``: languages x scripts."""

    names: list[str]
    table: np.ndarray
    uses: np.ndarray

    def scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        if not len(w.start):
            return np.zeros((0, len(self.names)), np.float32)
        allowed = self.uses[:, w.script]
        allowed |= ~allowed.any(axis=0)
        out = np.full((len(w.start), len(self.names)), OUT, np.float32)
        size = np.diff(np.append(w.first_gram, len(w.grams)))
        for k, row in enumerate(self.table):
            mine = np.flatnonzero(allowed[k])
            if len(mine) == len(w.start):
                out[:, k] = np.add.reduceat(row[w.grams], w.first_gram)
            elif len(mine):
                # Only the words whose script the language uses are looked up.
                n = size[mine]
                first = np.cumsum(n) - n
                at = np.repeat(w.first_gram[mine] - first, n) + np.arange(int(n.sum()))
                out[mine, k] = np.add.reduceat(row[w.grams[at]], first)
        return out


def viterbi(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row of ``scores``; sequence i is rows ``begin[i]:begin[i + 1]``; a change of label costs ``penalty``.

    Few labels: in blocks, whose tables are squares of them. More than BLOCK_LABELS: word by word, in time and
    memory of words x labels.
    """
    return viterbi_blocks(scores, begin, penalty) if scores.shape[1] <= BLOCK_LABELS else viterbi_steps(scores, begin, penalty)


def viterbi_steps(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    """All sequences at once, one word after the other: with one penalty for all changes, a word only needs its own best and the best of all."""
    n, k = scores.shape
    sizes = np.diff(begin)
    order = np.argsort(-sizes, kind="stable")
    at = begin[:-1][order]
    live = np.array([int(np.searchsorted(-sizes[order], -t, side="left")) for t in range(int(sizes.max(initial=0)) + 1)])  # sequences longer than t
    best = np.zeros((len(sizes), k))
    changed, top = np.zeros((n, k), bool), np.zeros(n, np.int64)
    for t in range(int(sizes.max(initial=0))):
        m = live[t]
        rows = at[:m] + t
        if t:
            now = best[:m]
            top[rows] = now.argmax(axis=1)
            jump = now[np.arange(m), top[rows]][:, None] - penalty
            changed[rows] = jump > now
            best[:m] = np.maximum(now, jump)
        best[:m] += scores[rows]
    labels = np.zeros(n, np.int64)
    state = best.argmax(axis=1)
    for t in range(int(sizes.max(initial=0)) - 1, -1, -1):
        rows = at[: live[t]] + t
        labels[rows] = state[: live[t]]
        state[: live[t]] = np.where(changed[rows, labels[rows]], top[rows], labels[rows])
    return labels


def viterbi_blocks(scores: np.ndarray, begin: np.ndarray, penalty: float) -> np.ndarray:
    n, k = scores.shape
    sizes = np.diff(begin)
    blocks = -(-sizes // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    if not nb:
        return np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(sizes)), blocks)
    at = begin[of] + (np.arange(nb) - first[of]) * BLOCK
    length = np.minimum(BLOCK, begin[of + 1] - at)
    steps = int(length.max())
    cur = np.full((nb, k, k), -np.inf)
    cur[:, range(k), range(k)] = 0
    switched, source = np.zeros((steps, nb, k, k), bool), np.zeros((steps, nb, k), np.int16)
    padded = np.concatenate([scores, np.zeros((BLOCK, k), scores.dtype)])
    for t in range(steps):
        s = np.where((t < length)[:, None], padded[at + t], 0)
        source[t] = cur.argmax(axis=2)
        jump = cur.max(axis=2, keepdims=True) - penalty
        switched[t] = jump > cur
        cur = np.maximum(cur, jump) + s[:, None, :]
    # Chain the blocks of each sequence: many sequences at once, one step per block.
    live = np.flatnonzero(blocks > 0)
    best = np.zeros((len(sizes), k), np.float64)
    enter = np.zeros((nb, k), np.int64)
    for step in range(int(blocks.max())):
        live = live[blocks[live] > step]
        b = first[live] + step
        through = best[live][:, :, None] + cur[b]
        enter[b] = through.argmax(axis=1)
        best[live] = through.max(axis=1)
    leave = np.zeros(nb, np.int64)
    live = np.flatnonzero(blocks > 0)
    state = best.argmax(axis=1)
    for step in range(int(blocks.max()) - 1, -1, -1):
        now = live[blocks[live] > step]
        b = first[now] + step
        leave[b] = state[now]
        state[now] = enter[b, state[now]]
    come = enter[np.arange(nb), leave]
    labels, j, every = np.zeros(n + BLOCK, np.int64), leave, np.arange(nb)
    for t in range(steps - 1, -1, -1):
        ok = t < length
        labels[at[ok] + t] = j[ok]
        j = np.where(switched[t, every, come, j], source[t, every, come], j)
    return labels[:n]


def label(model: Model, texts: list[str], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """Per text: its language, the share of its letters in that language's spans, and the spans ``(start, end, language)`` in code points."""
    w = words_of(texts)
    begin = np.searchsorted(w.text, np.arange(len(texts) + 1))
    labels = viterbi(model.scores(w), begin, penalty)
    k = len(model.names)
    weight = np.bincount(w.text * k + labels, weights=w.end - w.start, minlength=len(texts) * k).reshape(len(texts), k) if len(labels) else np.zeros((len(texts), k))
    top, total = weight.argmax(axis=1), weight.sum(axis=1)
    new = np.ones(len(labels), bool)
    new[1:] = (labels[1:] != labels[:-1]) | (w.text[1:] != w.text[:-1])
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(labels))[: len(heads)] - 1
    spans: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for t, a, b, x in zip(w.text[heads].tolist(), (w.start[heads] - w.offsets[w.text[heads]]).tolist(), (w.end[tails] - w.offsets[w.text[heads]]).tolist(), labels[heads].tolist()):
        spans[t].append((a, b, model.names[x]))
    return [(model.names[top[i]], float(weight[i, top[i]] / total[i]), spans[i]) if total[i] else ("und", 0.0, []) for i in range(len(texts))]


def viterbi_table(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Labels x labels: the best score of one sequence from each label before it to each label at its end."""
    n, k = scores.shape
    nb = -(-n // BLOCK)
    padded = np.concatenate([scores, np.zeros((nb * BLOCK - n, k), scores.dtype)]).reshape(nb, BLOCK, k)
    cur = np.full((nb, k, k), -np.inf)
    cur[:, range(k), range(k)] = 0
    for t in range(min(n, BLOCK)):
        step = np.maximum(cur, cur.max(axis=2, keepdims=True) - penalty) + padded[:, t, None, :]
        cur = step if (nb - 1) * BLOCK + t < n else np.concatenate([step[:-1], cur[-1:]])
    out = cur[0]
    for b in cur[1:]:
        out = (out[:, :, None] + b).max(axis=1)
    return out


def cut(text: str, limit: int) -> list[str]:
    """A text in pieces of about ``limit`` characters that end behind a word."""
    out, at = [], 0
    while at < len(text):
        end = at + limit
        while end < len(text) and text[end].isalpha():
            end += 1
        out.append(text[at:end])
        at = end
    return out


def label_long(model: Model, text: str, penalty: float = PENALTY, limit: int = LONG) -> tuple[str, float, list[tuple[int, int, str]]]:
    """What :func:`label` gives for one text, in memory of a piece at a time.

    Forwards, each piece is a table from the label before it to that at its end; those tables are chained. Backwards,
    each piece is read again with the labels at its two ends known.
    """
    k = len(model.names)
    pieces = cut(text, limit)
    best, enter = np.zeros(k), []
    for piece in pieces:
        scores = model.scores(words_of([piece]))
        if len(scores):
            through = best[:, None] + viterbi_table(scores, penalty)
            enter.append(through.argmax(axis=0))
            best = through.max(axis=0)
        else:
            enter.append(np.arange(k))
    state, ends = int(best.argmax()), []
    for e in reversed(enter):
        ends.append((int(e[state]), state))
        state = int(e[state])
    weight, spans, at = np.zeros(k), [], 0
    for piece, (before, after) in zip(pieces, reversed(ends)):
        w = words_of([piece])
        if len(w.start):
            scores = model.scores(w).astype(float)
            scores[-1, np.arange(k) != after] = -np.inf
            lead = np.full((1, k), -np.inf)
            lead[0, before] = 0
            labels = viterbi_steps(np.concatenate([lead, scores]), np.array([0, len(scores) + 1]), penalty)[1:] if k > BLOCK_LABELS else viterbi_blocks(np.concatenate([lead, scores]), np.array([0, len(scores) + 1]), penalty)[1:]
            weight += np.bincount(labels, weights=w.end - w.start, minlength=k)
            heads = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]]))
            for a, b, x in zip((w.start[heads] + at).tolist(), (w.end[np.append(heads[1:], len(labels)) - 1] + at).tolist(), labels[heads].tolist()):
                if spans and spans[-1][2] == model.names[x]:
                    spans[-1] = (spans[-1][0], b, model.names[x])
                else:
                    spans.append((a, b, model.names[x]))
        at += len(piece)
    total = weight.sum()
    return (model.names[int(weight.argmax())], float(weight.max() / total), spans) if total else ("und", 0.0, [])


def label_all(model: Model, texts: list[str], penalty: float = PENALTY) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """:func:`label` of any number of texts of any length, in bounded memory."""
    return [r for run in parts(texts) for r in (label(model, run, penalty) if len(run) > 1 or len(run[0]) <= LONG else [label_long(model, run[0], penalty)])]


def parts(texts: list[str], limit: int = 1 << 18) -> Iterator[list[str]]:
    """Runs of texts of about ``limit`` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > limit:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def train(labelled: DataFrame, per_language: int = 1500) -> Model:
    """Fit on whole texts of ``labelled (doc_id, text, lang)``: of each language about ``per_language`` rows, chosen by a hash of doc_id.

    Rows with a null text, language or doc_id teach nothing. Every other value of ``lang`` is learnt, however rare; the
    driver gets one count per language and bin, and tasks a table of BINS numbers a language.
    """
    labelled = labelled.select("doc_id", "text", "lang").where("doc_id is not null and lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    names = sorted(sizes)
    if not names:
        return Model(["und"], np.zeros((1, BINS), np.float32), np.ones((1, len(SCRIPTS) + 1), bool))
    share = F.element_at(F.create_map(*(F.lit(x) for name, n in sizes.items() for x in (name, min(1.0, per_language / n)))), F.col("lang"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(21)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    number = {name: k for k, name in enumerate(names)}
    width = BINS + len(SCRIPTS) + 1  # bins, then words by script

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for name in set(langs):
                for run in parts([p for t, x in zip(batch.column(0).to_pylist(), langs) if x == name for p in cut(t, LONG)]):
                    w = words_of(run)
                    seen = np.bincount(w.grams, minlength=width)
                    seen[BINS:] += np.bincount(w.script, minlength=width - BINS)
                    total[number[name]] = total.get(number[name], 0) + seen
        for k, seen in total.items():
            some = np.flatnonzero(seen)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k), pa.int32()), pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], names=["language", "bin", "n"])

    counted = labelled.where(draw < share).select("text", "lang").mapInArrow(count, "language int, bin int, n long")
    rows = counted.groupBy("language", "bin").agg(F.sum("n").alias("n")).toPandas()
    seen = np.zeros((len(names), width))
    seen[rows["language"], rows["bin"]] = rows["n"]
    grams, scripts = seen[:, :BINS], seen[:, BINS:]
    table = np.log((grams + 0.2) / (grams.sum(axis=1, keepdims=True) + 0.2 * BINS))
    table -= table.mean(axis=0)
    uses = scripts >= np.maximum(1, 0.01 * scripts.sum(axis=1, keepdims=True))
    return Model(names, table.astype(np.float32), uses)


def learnable(doc_id: Column, parts_: int = 4, held: int = 2) -> tuple[Column, Column]:
    """(rows to learn from, held-out rows) by crc32 of the id as text; rows without an id are in neither."""
    rest = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts_))
    return F.coalesce(rest != held, F.lit(False)), F.coalesce(rest == held, F.lit(False))


def predict(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` and ``lang_spans``; ``und`` with score 0 where a text is null or has no letter. Columns of these names are replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_spans")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    more = T._parse_datatype_string("lang_pred string, lang_score double, lang_spans array<struct<start: int, end: int, lang: string>>")
    schema = T.StructType([*docs.schema.fields, *more.fields])

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rows = label_all(model, texts, penalty)
            spans = [[{"start": a, "end": b, "lang": x} for a, b, x in r[2]] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array(spans, kind)],
                names=[*batch.schema.names, "lang_pred", "lang_score", "lang_spans"],
            )

    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Language of every whole text: ``doc_id, held_out, lang_pred, score, n_spans``; learns from rows that are not held out.

    ``lang_pred`` is the language with most letters in its spans (ties: the first name), ``score`` their share; ``und``
    and 0 where a text is null or has no letter. A null doc_id is not held out and teaches nothing; rows that repeat
    are rows like any other. Texts of any length are read whole; an empty table gives an empty result; other columns are
    not read. Without any labelled row every text with a letter is ``und``, with score 1.
    """
    learn, held = learnable(F.col("doc_id"))
    model = train(docs.where(learn))
    out = predict(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))


def keep_identified(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents that have a language, with it in ``lang`` (if there is such a string column).

    Rejected are texts that are null or have no letter, and those of which no language's spans hold ``least_share`` of
    the letters (of equal shares the first name counts). Texts of any length are read whole, in pieces; an empty table gives an
    empty result. All other columns stay as they are; rows that repeat are rows like any other.
    """
    learn, _ = learnable(F.col("doc_id"))
    model = train(docs.where(learn)) if "lang" in docs.columns else train(docs.limit(0).select("doc_id", "text", F.lit("").alias("lang")))
    at = next((k for k, f in enumerate(docs.schema.fields) if f.name == "lang" and isinstance(f.dataType, T.StringType)), None)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            texts = [t or "" for t in batch.column(batch.schema.get_field_index("text")).to_pylist()]
            rows = label_all(model, texts)
            if at is not None:
                batch = batch.set_column(at, batch.schema.field(at), pa.array([r[0] for r in rows], batch.schema.field(at).type))
            yield batch.filter(pa.array([r[1] > 0 and r[1] >= least_share for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
