"""Secrets in texts: key patterns, and high-entropy windows of candidate strings.

A window slides over each candidate, one character at a time; counts per character and the sum of c log2 c are
updated for the character that enters and the one that leaves, so a step costs the same whatever the window.
Windows whose Shannon entropy reaches the class's threshold are joined to spans. An allow-list cuts placeholders and
UUIDs out of candidates and suppresses spans that only look random. It never touches the pattern matches. Spans are
looked up in others by bisection, so a text costs about its length however many secrets it holds.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import slices
from .kernels import releasing

#: The base patterns (fixed values). Letters of the first one's words in either case, ASCII only.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_VALUE = 6
KINDS = {"assign": 0, "access": 1, "hex": 2, "entropy_hex": 3, "entropy_base64": 4}
#: Character class -> candidate strings, window, least entropy in bits per character.
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{24,}"), 24, 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/_=-]{20,}"), 20, 3.8),
}
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
PLACEHOLDER = re.compile(r"example|sample|placeholder|dummy|redacted|changeme|your[_-]|xxxx|0123456789|abcdefgh", re.IGNORECASE)
CLEARED = re.compile(f"{UUID.pattern}|{PLACEHOLDER.pattern}", re.IGNORECASE)
C_LOG_C = [0.0] + [c * math.log2(c) for c in range(1, 4096)]

Span = tuple[int, int, str]


def allowed(span: str) -> bool:
    """Whether a string is no secret for all its entropy: words or numbers only, or a UUID."""
    digit, lower, upper = (any(c in group for c in span) for group in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    return not (digit and (lower or upper)) or UUID.fullmatch(span) is not None


def pieces(candidate: str, least: int) -> Iterator[tuple[int, str]]:
    """What is left of a candidate, where it begins, once placeholders and UUIDs are cut out: one of them does not clear the rest."""
    at = 0
    for m in CLEARED.finditer(candidate):
        if m.start() - at >= least:
            yield at, candidate[at : m.start()]
        at = m.end()
    if len(candidate) - at >= least:
        yield at, candidate[at:]


class Cover:
    """Spans in the order of their starts, with the furthest end so far: tells in one bisection whether one of them contains a span."""

    def __init__(self, spans: list[Span]) -> None:
        self.starts = [s[0] for s in spans]
        self.furthest = list(itertools.accumulate((s[1] for s in spans), max))

    def contains(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start)
        return k > 0 and self.furthest[k - 1] >= end


def windows(text: str, size: int, least: float) -> Iterator[tuple[int, int]]:
    """Maximal spans covered by windows of ``size`` characters with an entropy of at least ``least``."""
    counts: dict[str, int] = {}
    total, top = 0.0, math.log2(size)
    begin = end = -1
    for k, c in enumerate(text):
        n = counts.get(c, 0)
        total += C_LOG_C[n + 1] - C_LOG_C[n]
        counts[c] = n + 1
        if k >= size:
            old = text[k - size]
            n = counts[old]
            total += C_LOG_C[n - 1] - C_LOG_C[n]
            counts[old] = n - 1
        if k >= size - 1 and top - total / size >= least:
            if begin >= 0 and k - size + 1 > end:
                yield begin, end
                begin = -1
            if begin < 0:
                begin = k - size + 1
            end = k + 1
    if begin >= 0:
        yield begin, end


def base_spans(text: str) -> list[Span]:
    spans = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]]))


def secret_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and all spans: those and the high-entropy ones that no other span contains."""
    base = base_spans(text)
    covers, found = [Cover(base)], list(base)
    for kind, (pattern, size, least) in CLASSES.items():
        own: list[Span] = []
        for m in pattern.finditer(text):
            if any(c.contains(m.start(), m.end()) for c in covers):
                continue
            for at, piece in pieces(m.group(), size):
                for a, b in windows(piece, size, least):
                    start, end = m.start() + at + a, m.start() + at + b
                    if not allowed(text[start:end]) and not any(c.contains(start, end) for c in covers):
                        own.append((start, end, kind))
        covers.append(Cover(own))  # spans of one class never overlap
        found += own
    return base, sorted(found, key=lambda s: (s[0], KINDS[s[2]]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Spans and counts of every whole text: ``doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans``.

    Null texts count as empty and have none; repeated rows are rows like any other; texts of any length are read whole, in
    time about proportional to it; an empty table gives an empty result; other columns are not read. Spans of equal start
    are in the order of KINDS.
    """
    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [secret_spans(t or "") for t in part.column(1).to_pylist()]
                count = lambda kind: pa.array([sum(s[2] == kind for s in b) for b, _ in rows], pa.int64())
                digest = [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows]
                more = pa.array([len(e) - len(b) for b, e in rows], pa.int64())
                columns = [part.column(0), count("assign"), count("access"), count("hex"), more, pa.array(digest, pa.string()), pa.array([joined(e) for _, e in rows], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def mask(text: str, mark: str = "[SECRET]") -> str:
    """The text with every span, or run of overlapping spans, replaced by ``mark``."""
    out, at = [], 0
    for a, b, _ in secret_spans(text)[1]:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text``, and ``n_chars`` (if there) of the new text.

    Null texts stay null, empty ones empty; texts of any length are masked whole; rows that repeat are rows like any other;
    an empty table gives an empty result; other columns stay as they are, whatever their names.
    """

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                at = part.schema.get_field_index("text")
                yield part.set_column(at, part.schema.field(at), pa.array([t if t is None else mask(t) for t in part.column(at).to_pylist()], part.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
