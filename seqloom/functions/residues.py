"""Column functions over sequences: identity, physical properties, composition, runs, codes and filters.

All are built-in expressions; a sequence is an upper-case string over ALPHABET unless a parameter says otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The twenty canonical residues, in index order.
ALPHABET = "ACDEFGHIKLMNPQRSTVWY"
MIN_LENGTH, MAX_LENGTH = 8, 50
PAD, BOS = 20, 21

# pK of the groups that are positive, and of those that are negative, at low and high pH; termini first.
POSITIVE_PK = {"N-terminus": 8.0, "K": 10.5, "R": 12.5, "H": 6.0}
NEGATIVE_PK = {"C-terminus": 3.1, "D": 3.9, "E": 4.1, "C": 8.3, "Y": 10.1}

# Eisenberg consensus hydrophobicity.
EISENBERG = {
    "A": 0.62, "R": -2.53, "N": -0.78, "D": -0.90, "C": 0.29, "Q": -0.85, "E": -0.74, "G": 0.48, "H": -0.40, "I": 1.38,
    "L": 1.06, "K": -1.50, "M": 0.64, "F": 1.19, "P": 0.12, "S": -0.18, "T": -0.05, "W": 0.81, "Y": 0.26, "V": 1.08,
}
HYDROPHOBIC = "AILMFWVY"
TURN_DEGREES = 100.0


def canonical(seq: Column, low: int | None = MIN_LENGTH, high: int | None = MAX_LENGTH, alphabet: str = ALPHABET) -> Column:
    """Whether a sequence has only letters of the alphabet and a length in [low, high] (None: 1 and no limit)."""
    return seq.rlike(f"^[{alphabet}]{{{low or 1},{high or ''}}}$")


def sequence_id(seq: Column) -> Column:
    return F.sha2(seq, 256)


def count_of(seq: Column, letter: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(letter), F.lit("")))


def net_charge(seq: Column, ph: float = 7.0) -> Column:
    """Henderson-Hasselbalch net charge with free termini."""
    total = F.lit(1 / (1 + 10 ** (ph - POSITIVE_PK["N-terminus"])) - 1 / (1 + 10 ** (NEGATIVE_PK["C-terminus"] - ph)))
    for letter, pk in POSITIVE_PK.items():
        if len(letter) == 1:
            total = total + count_of(seq, letter) * F.lit(1 / (1 + 10 ** (ph - pk)))
    for letter, pk in NEGATIVE_PK.items():
        if len(letter) == 1:
            total = total - count_of(seq, letter) * F.lit(1 / (1 + 10 ** (pk - ph)))
    return total


def mean_scale(seq: Column, scale: dict[str, float] | None = None) -> Column:
    """Mean of a residue scale, by letter counts (no per-letter loop)."""
    total = F.lit(0.0)
    for letter, value in (scale or EISENBERG).items():
        total = total + count_of(seq, letter) * F.lit(value)
    return total / F.length(seq)


def letters(seq: Column) -> Column:
    return F.split(seq, "")


def scale_values(seq: Column, scale: dict[str, float] | None = None) -> Column:
    table = F.create_map(*(F.lit(x) for kv in (scale or EISENBERG).items() for x in kv))
    return F.transform(letters(seq), lambda c: F.element_at(table, c))


def moment(seq: Column, scale: dict[str, float] | None = None, degrees: float = TURN_DEGREES) -> Column:
    """Hydrophobic moment of the whole chain, the first residue at angle 0."""
    values, turn = scale_values(seq, scale), math.radians(degrees)
    part = lambda f: F.aggregate(F.transform(values, lambda v, k: v * f(k * F.lit(turn))), F.lit(0.0), lambda s, x: s + x)
    return F.hypot(part(F.cos), part(F.sin)) / F.length(seq)


def windowed_moment(seq: Column, window: int = 11, scale: dict[str, float] | None = None, degrees: float = TURN_DEGREES) -> Column:
    """Mean of the moments of all windows (of the whole chain where it is shorter)."""
    width = F.least(F.lit(window), F.length(seq))
    starts = F.sequence(F.lit(1), F.length(seq) - width + 1)
    each = F.transform(starts, lambda k: moment(F.substr(seq, k, width), scale, degrees))
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x) / F.size(starts)


def properties(seq: Column) -> dict[str, Column]:
    return {"length": F.length(seq).cast("double"), "charge": net_charge(seq), "hydrophobicity": mean_scale(seq), "moment": moment(seq)}


def tokens(seq: Column, width: int | None = None, alphabet: str = ALPHABET) -> Column:
    """Letter indices from 0; with ``width``, padded by PAD."""
    out = F.transform(letters(seq), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return out if width is None else F.slice(F.concat(out, F.array_repeat(F.lit(PAD), width)), 1, width)


def composition(seq: Column, alphabet: str = ALPHABET) -> Column:
    """``map<letter, fraction>`` over the whole alphabet."""
    return F.create_map(*(x for a in alphabet for x in (F.lit(a), count_of(seq, a) / F.length(seq))))


def dipeptides(seq: Column) -> Column:
    """All overlapping pairs of letters; none for a sequence of one letter."""
    return F.when(F.length(seq) > 1, F.transform(F.sequence(F.lit(1), F.length(seq) - 1), lambda k: F.substr(seq, k, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one letter: the longest match of any letter repeated."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        run = F.when(s["last"] == c, s["run"] + 1).otherwise(1)
        return F.struct(c.alias("last"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(letters(seq), start, step, lambda s: s["best"])


def fraction_in(seq: Column, group: str = HYDROPHOBIC) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{group}]", "")) / F.length(seq)


def count_in(seq: Column, group: str) -> Column:
    return F.length(F.regexp_replace(seq, f"[^{group}]", ""))


def activity_score(mic: Column) -> Column:
    """-log2 of a concentration: higher is more active."""
    return -F.log2(mic)


def geometric_mean(x: Column) -> Column:
    return F.exp(F.avg(F.log(x)))


def z_score(x: Column, mean: Column, deviation: Column, floor: float = 0.01) -> Column:
    """Against a reference's mean and population standard deviation, which is at least ``floor``."""
    return (x - mean) / F.greatest(deviation, F.lit(floor))


def shrink(x: Column, mean: Column, blend: float) -> Column:
    return (1 - blend) * x + blend * mean


def quantile_edges(x: Column, points: int = 13) -> Column:
    """Distinct linear-interpolated quantiles at ``points`` even levels, without the last one (an aggregate)."""
    levels = [k / (points - 1) for k in range(points)]
    edges = F.array_sort(F.array_distinct(F.percentile(x, F.array(*(F.lit(q) for q in levels)))))
    return F.slice(edges, 1, F.size(edges) - 1)


def quantile_code(x: Column, edges: Column) -> Column:
    """How many edges lie below x."""
    return F.size(F.filter(edges, lambda e: e < x))


def threshold_features(x: Column, thresholds: Column) -> Column:
    return F.transform(thresholds, lambda t: (x <= t).cast("int"))


def family_of(header: Column, suffixes: Sequence[str] = ("_prob", "_MIC_uM")) -> dict[str, Column]:
    """Kind and family of a predictor column, from its suffix and the part of its name before the first of - and _."""
    kind = F.when(header.endswith(suffixes[0]), "amp_probability").when(header.endswith(suffixes[1]), "mic_um")
    return {"kind": kind, "family": F.lower(F.regexp_extract(header, r"^([^-_]+)", 1))}


def identity_gate(nident: Column, alnlen: Column) -> Column:
    """Identity above 80 %, in whole numbers."""
    return 5 * nident > 4 * alnlen


def coverage_gate(span: Column, total: Column) -> Column:
    """Coverage of at least 80 %, in whole numbers."""
    return 5 * span >= 4 * total


def bits_similarity(best_bits: Column, self_bits: Column) -> Column:
    """Best score over own score, clipped to [0, 1]; no hit is 0. Novelty is 1 minus this."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(best_bits, F.lit(0.0)) / self_bits))
