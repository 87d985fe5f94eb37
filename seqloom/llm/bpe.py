"""Byte-pair encoding by backtracking over longest Aho-Corasick matches; decoding by an offset table.

For each piece of the pre-tokenizer, an automaton gives the longest token that starts at every byte. The encoder
takes it where it is compatible with the token before it, else the next shorter one, else it steps back; each
byte position is given up at most once, so the time is linear. Two tokens are compatible if no merge across their
border would come before the merges that make them; this is read off their merge trees and kept in a table. The
result equals that of applying all merges in rank order.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import CACHES, releasing

#: The byte-level pre-tokenizer's pattern (fixed value).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded words that a worker keeps; the table starts anew when it is full. Speed only.
KEEP = 200_000
#: A space inside a longer run of white space that does not end before a word: there a text can't be cut at spaces.
UNSAFE = re.compile(r"\s\x20(?:\s|\Z)")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable ones stand for themselves, the rest for 256 and on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def require_supported(spec: dict) -> None:
    """An error for a tokenizer file with a part that this encoder does not implement: it would give other ids without notice."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    wrong = [
        name
        for name, bad in {
            "model type": model.get("type", "BPE") != "BPE",
            "normalizer": spec.get("normalizer") is not None,
            "pre-tokenizer": pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True),
            "decoder": (spec.get("decoder") or {}).get("type") != "ByteLevel",
            "model options": any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")),
            "added tokens": any(t.get(k) for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")),
        }.items()
        if bad
    ]
    if wrong:
        raise ValueError(f"tokenizer file: not implemented: {', '.join(wrong)}")


class Encoder(dict):
    """Maps a word (text between spaces, with its leading space) to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        spec = json.load(open(path, encoding="utf-8"))
        require_supported(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {raw(s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = vocab
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[raw(a)], vocab[raw(b)], vocab[raw(a) + raw(b)]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(z, (x, y, r))
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for b, i in [*vocab.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = b
        self.sizes = [len(b) for b in self.bytes]
        lengths = np.array(self.sizes, dtype=np.int64)
        self.lengths, self.offsets = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.blob = np.frombuffer(b"".join(self.bytes), dtype=np.uint8)
        self.find = regex.compile(PIECES).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.automaton = ahocorasick.Automaton()
        for b, i in vocab.items():
            self.automaton.add_word(b.decode("latin-1"), (len(b), i))
        self.automaton.make_automaton()
        self.shorter = {}
        for b, i in vocab.items():
            self.shorter[i] = next((vocab[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in vocab), -1)
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.size = size
        self.compatible: dict[int, bool] = {}  # by a * size + b
        self.pieces: dict[str, bytes] = {}

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at the border (side 1: right, 0: left), each with the rank of the merge that consumes it."""
        if (got := self.spines.get((token, side))) is None:
            got, until, t = [], float("inf"), token
            while True:
                got.append((t, until))
                if t not in self.parts:
                    break
                until, t = self.parts[t][2], self.parts[t][side]
            self.spines[token, side] = got
        return got

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the bytes of a and b gives a and b: no merge across comes before both sides' own (of equal rank, the left one goes first)."""
        if (got := self.compatible.get(a * self.size + b)) is None:
            got = not any((r := self.rank.get((x, y))) is not None and r < ux and r <= uy for x, ux in self.spine(a, 1) for y, uy in self.spine(b, 0))
            if len(self.compatible) >= 4 * KEEP:
                self.compatible.clear()
            self.compatible[a * self.size + b] = got
        return got

    def piece(self, text: str) -> bytes:
        if (got := self.pieces.get(text)) is None:
            got = self.merged(text)
            if len(text) <= 64:
                if len(self.pieces) >= KEEP:
                    self.pieces.clear()
                self.pieces[text] = got
        return got

    def merged(self, text: str) -> bytes:
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        best = [-1] * (n + 1)
        for end, (length, token) in self.automaton.iter(data.decode("latin-1")):
            best[end + 1 - length] = token  # a later end is a longer match
        out: list[int] = []
        known, sizes, size = self.compatible, self.sizes, self.size
        dead: set[int] = set()
        pos, token, last = 0, best[0], -1
        while pos < n:
            while token >= 0:
                end = pos + sizes[token]
                if end not in dead and (last < 0 or ((fit := known.get(last * size + token)) or fit is None and self.fits(last, token))):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                pos, last = end, token
                token = best[end]
            elif out:
                dead.add(pos)
                token = out.pop()
                pos -= sizes[token]
                last = out[-1] if out else -1
                token = self.shorter[token]
            else:
                raise ValueError(f"no encoding for {text[:50]!r}")
        return struct.pack(f"<{len(out)}I", *out)

    def __missing__(self, word: str) -> bytes:
        found = self.find(word)
        # What is one piece is kept as a word alone.
        got = self.merged(word) if len(found) == 1 else b"".join(map(self.piece, found))
        if len(word) <= 64:
            if len(self) >= KEEP:
                self.clear()
            self[word] = got
        return got

    def plain(self, text: str) -> bytes:
        if UNSAFE.search(text):
            return b"".join(map(self.piece, self.find(text)))
        first, *rest = text.split(" ")
        return self[first] + b"".join(map(self.__getitem__, [" " + w for w in rest]))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if self.split_special is None or not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(struct.pack("<I", self.special[t]) if t in self.special else self.plain(t) for t in self.split_special(text) if t)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids: a gather from one blob by an offset table. Invalid UTF-8 gives U+FFFD, as in a lossy decoder."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        data = self.blob[np.repeat(self.offsets[ids] - ends + lengths, lengths) + np.arange(total)].tobytes()
        try:
            data.decode("utf-8")
        except UnicodeDecodeError:
            data = data.decode("utf-8", "replace").encode("utf-8")
        return data


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


CACHES["bpe"] = encoder.cache_clear
keeping = functools.partial(releasing, keep="bpe")


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``(key, ids array<int>)`` of every whole text; null and empty texts have no ids. ``vocabulary``: a tokenizer file that every worker can open."""

    @keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(bpe.encode(t or ""), dtype="<u4") for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                values = np.concatenate([*ids, np.empty(0, "<u4")]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[key, "ids"])

    return docs.select(key, "text").mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id") -> DataFrame:
    """``(key, text)`` of ``(key, ids)``; null ids give an empty text."""

    @keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], dtype=np.int64)).decode("utf-8") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that bound what a worker holds in Python objects at once."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def round_trip_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Encode and decode every whole text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts count as empty: no tokens, digests of nothing. Texts of any length are encoded whole; rows that repeat are
    rows like any other; an empty table gives an empty result; other columns are not read. A tokenizer file with parts
    that are not implemented is an error.
    """

    @keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t or "") for t in part.column(1).to_pylist()]
                back = [sha(bpe.decode(np.frombuffer(x, dtype="<u4").astype(np.int64))) for x in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokenized(docs: DataFrame, vocabulary: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode every whole text and decode it again: ``doc_id``, the columns ``keep``, ``ids, n_tokens, decoded_sha256``.

    Null texts count as empty; texts of any length are encoded whole; rows that repeat are rows like any other; an empty
    table gives an empty result; columns that are not kept are not read.
    """
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]) + ", ids array<int>, n_tokens long, decoded_sha256 string"

    @keeping
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        for batch in batches:
            for part in slices(batch):
                ids = [np.frombuffer(bpe.encode(t or ""), dtype="<u4").astype(np.int64) for t in part.column(len(keep) + 1).to_pylist()]
                counts = [len(x) for x in ids]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(np.concatenate([*ids, np.empty(0, np.int64)]), pa.int32()))
                back = [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], lists, pa.array(counts, pa.int64()), pa.array(back, pa.string())], names=[*part.schema.names[:-1], "ids", "n_tokens", "decoded_sha256"])

    return kept.mapInArrow(run, schema)
