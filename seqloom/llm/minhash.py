"""Near-duplicate documents: a Chosen Path similarity join over minwise tokens, confirmed on full shingle sets.

1. Equal sets are one class, a node; only classes go on.
2. Each of TREES independent trees puts a node under one minwise token of its own. Tree nodes ("units") of at most
   SMALL are compared exhaustively by sketch. A larger unit is first compared to one of its documents, which joins
   thousands of near copies at once; if few others are left, they are compared to all of it in blocks, and else the
   unit branches: each document goes to BRANCHES children, each named by a further minwise value at a place that the
   unit picks, where documents that are joined already are not compared again. What is still large after LEVELS
   levels is compared in blocks of pairs. A unit gives the edges of a spanning forest, never all pairs.
3. The sketch only nominates (it passes pairs far below the threshold). Components of nominated edges are confirmed
   on the full sets of hashed shingles: in one task where they are small, else against one document, and what does
   not link to that against all others, in blocks. Only texts whose id a Bloom filter of fixed size passes are read
   and shuffled for this; its false positives fall out in the join.
4. Components of confirmed edges, carried back to all rows of each class.

A pair at the threshold t meets in one tree with a probability of about t (t (1 - (1 - t)^BRANCHES)^level in a deep
unit); ten trees miss one in 10^5 or fewer, and a group is only parted if all pairs that connect it are missed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK, U, mix, numbers, releasing, shingle_sets, sketches
from .shared import Forest, bloom_bits, by_salt, components, group_values, in_bloom, in_units, lookup, mark_among, materialize, salt_of, salts_in_use, whole_units

SKETCH = 64
TREES = 10
BRANCHES = 2
LEVELS = 5
SMALL = 256
FEW = 1024
#: Documents in one confirming task, and in one side of a block.
BLOCK = 200
LINKS = "a long, b long"
UNIT = ("unit", "node", "n_shingles", "label", "mute", "brief")


def least_agreement(threshold_percent: int) -> int:
    """Sketch values that must agree: six standard deviations below the threshold, so that chance loses one link in 10^9."""
    t = threshold_percent / 100
    return max(1, math.floor(SKETCH * (t - 6 * math.sqrt(t * (1 - t) / SKETCH))))


def binary_rows(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that end at ``ends`` (n + 1 byte offsets) of the bytes of ``flat``."""
    flat = np.ascontiguousarray(flat)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat.view(np.uint8).ravel())]).cast(pa.binary())


def binary_numbers(column: pa.ChunkedArray | pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of binary values in a row, and where each value's begin."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    width = np.dtype(kind).itemsize
    return data[offsets[0] : offsets[-1]].copy().view(kind), (offsets - offsets[0]) // width


def set_keys(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's members, mixed in two ways: equal for equal sets, and else only by chance (2^-128)."""
    n = np.diff(at)
    k1, k2 = np.zeros(len(n), U), np.zeros(len(n), U)
    some = np.flatnonzero(n)
    if len(some):
        a, b = numbers(9, 2, odd=True)
        if len(some) == 1:  # one set of any size, in slices
            cuts = range(0, len(values), CHUNK)
            k1[some] = np.sum([mix(values[s : s + CHUNK] * a).sum(dtype=U) for s in cuts], dtype=U)
            k2[some] = np.sum([mix(values[s : s + CHUNK] ^ b).sum(dtype=U) for s in cuts], dtype=U)
        else:
            k1[some] = np.add.reduceat(mix(values * a), at[:-1][some])
            k2[some] = np.add.reduceat(mix(values ^ b), at[:-1][some])
    return k1.view(np.int64), k2.view(np.int64)


def document_sets(docs: DataFrame, words: int) -> DataFrame:
    """``doc_id, text_key, n_shingles, k1, k2, tokens, brief`` per row: the key of its set (null if that is empty), a token per tree, and the low bytes of its sketch."""
    schema = "doc_id long, text_key long, n_shingles long, k1 long, k2 long, tokens array<int>, brief binary"

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in shingle_sets(batch, words):
                n, none = np.diff(at), np.diff(at) == 0
                k1, k2 = (pa.array(k, pa.int64(), mask=none) for k in set_keys(values, at))
                minwise = sketches(values, at, SKETCH)
                tokens = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1) * TREES, pa.int32()), pa.array(minwise[:, :TREES].copy().view(np.int32).ravel()))
                brief = binary_rows(minwise.astype(np.uint8), np.arange(len(n) + 1) * SKETCH)
                columns = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), k1, k2, tokens, brief]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "n_shingles", "k1", "k2", "tokens", "brief"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, schema)


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, k1, k2, hashes``: the whole set, as sorted 64-bit hashes, of each row whose doc_id a Bloom filter of ``ids`` passes.

    The filter is asked in the same Python worker, so a task needs one.
    """
    octets = bloom_bits(ids.select(F.xxhash64(ids.columns[0])))

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(in_bloom(octets, batch.column(1).to_numpy())))
            for i, j, values, at in shingle_sets(batch, words):
                k1, k2 = set_keys(values, at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(k1), pa.array(k2), binary_rows(values, 8 * at)], names=["id", "k1", "k2", "hashes"])

    own = F.col("doc_id").cast("long")
    return docs.select(own.alias("id"), F.xxhash64(own).alias("h"), "text").mapInArrow(run, "id long, k1 long, k2 long, hashes binary")


def nominate(threshold_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compare the pairs of each unit ``(unit, node, n_shingles, label, mute, brief)`` by sketch and size; give forest edges ``(a, b)``.

    Rows with the same ``mute`` (not null) are not compared; rows with the same ``label`` are joined already.
    """
    least = least_agreement(threshold_percent)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_units(batches):
            unit, ids, size = (table.column(c).to_numpy() for c in ("unit", "node", "n_shingles"))
            none = -1 << 63
            label, mute = (table.column(c).fill_null(none).to_numpy() for c in ("label", "mute"))
            values = binary_numbers(table.column("brief"), np.uint8)[0].reshape(-1, SKETCH)
            _, first = np.unique(unit, return_index=True)
            left = np.append(first, len(unit))[np.searchsorted(first, np.arange(len(unit)), side="right")] - np.arange(len(unit)) - 1
            found = []
            live = np.flatnonzero(left > 0)
            step = 0
            while len(live):
                step += 1
                live = live[left[live] >= step]
                for at in range(0, len(live), 20_000):
                    a = live[at : at + 20_000]
                    b = a + step
                    big, small = np.maximum(size[a], size[b]), np.minimum(size[a], size[b])
                    ok = (100 * small >= threshold_percent * big) & (ids[a] != ids[b]) & ((mute[a] != mute[b]) | (mute[a] == none))
                    a, b = a[ok], b[ok]
                    ok = (values[a] == values[b]).sum(axis=1) >= least
                    found.append(np.column_stack([a[ok], b[ok]]))
            forest = Forest()
            # Rows of a unit that one document stands for are joined already.
            known = np.flatnonzero(label != none)
            known = known[np.lexsort((label[known], unit[known]))]
            for a, b in zip(known[:-1].tolist(), known[1:].tolist()):
                if label[a] == label[b] and unit[a] == unit[b]:
                    forest.join(a, b)
            edges = [(ids[a], ids[b]) for a, b in np.concatenate([*found, np.zeros((0, 2), np.int64)]).tolist() if forest.join(a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def near_lead(threshold_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``(unit, salt, node, n_shingles, brief, label, fits)``: rows whose sketch agrees with their lead's get its label."""
    least = least_agreement(threshold_percent)

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            own, lead = (binary_numbers(column(c), np.uint8)[0].reshape(-1, SKETCH) for c in ("brief", "lead_brief"))
            size, lead_size = column("n_shingles").to_numpy(), column("lead_n").to_numpy()
            fits = ((own == lead).sum(axis=1) >= least) & (100 * np.minimum(size, lead_size) >= threshold_percent * np.maximum(size, lead_size))
            label = pa.compute.if_else(pa.array(fits), column("lead"), column("label"))
            yield pa.RecordBatch.from_arrays([*(column(c) for c in ("unit", "salt", "node", "n_shingles", "brief")), label, pa.array(fits), column("lead")], names=["unit", "salt", "node", "n_shingles", "brief", "label", "fits", "lead"])

    return run


def chosen_paths(reps: DataFrame, threshold_percent: int) -> DataFrame:
    """Nominated edges ``(a, b)`` between the classes ``(node, n_shingles, tokens, brief)``."""
    run = nominate(threshold_percent)
    rows = reps.select("node", "n_shingles", "brief", F.explode(F.array(*(F.xxhash64(F.lit(r), F.element_at("tokens", r + 1)) for r in range(TREES)))).alias("unit"), F.lit(None).cast("long").alias("label"))
    edges: list[DataFrame] = []

    def compared(units: DataFrame) -> None:
        edges.append(materialize(in_units(units.select(*UNIT), run, LINKS), "edges"))

    for depth in range(LEVELS + 1):
        rows = rows.withColumn("salt", salt_of(F.col("node")))
        aggs = {
            "n": F.count("*"),
            "labelled": F.count("label"),
            "low": F.min("label"),
            "high": F.max("label"),
            # the first document that no other stands for, else the first of all
            "lead": F.coalesce(F.min(F.when(F.col("label").isNull(), F.col("node"))), F.min("node")),
        }
        groups = rows.groupBy("unit").agg(*(c.alias(k) for k, c in aggs.items()), salts_in_use()).where(F.col("n") > SMALL)
        groups = groups.withColumn("open", ~F.coalesce((F.col("labelled") == F.col("n")) & (F.col("low") == F.col("high")), F.lit(False)))
        leads = reps.select(F.col("node").alias("lead"), F.col("n_shingles").alias("lead_n"), F.col("brief").alias("lead_brief"))
        large = materialize(groups.select("unit", "n", "open", "lead", "salts").join(leads, "lead"), "large")
        # Rows go to their unit in one shuffle; what belongs to a large unit is known from its salts.
        marked = rows.join(by_salt(large), ["unit", "salt"], "left")
        compared(marked.where("n is null").withColumn("mute", F.col("label")))
        if large.where("open").isEmpty():
            break
        if depth == LEVELS:
            chunks = F.ceil(F.col("n") / F.lit(SMALL)).cast("int")
            mine = F.pmod(F.xxhash64("node", F.lit(3)), chunks).cast("int")
            blocks = marked.where("open").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
            compared(blocks.withColumn("mute", F.col("label")).withColumn("unit", F.xxhash64("unit", F.least("mine", "other"), F.greatest("mine", "other"))))
            break
        star = marked.where("open").select("unit", "salt", "node", "n_shingles", "brief", "label", "lead", "lead_n", "lead_brief")
        star = materialize(star.mapInArrow(near_lead(threshold_percent), "unit long, salt int, node long, n_shingles long, brief binary, label long, fits boolean, lead long"), "star")
        edges.append(star.where("fits and node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")))
        # The documents under the most frequent label are joined already. Few others beside them: compare those with each
        # other (in block 0) and with all of the unit, in blocks. More of them: branch.
        each = star.groupBy("unit", "label").agg(F.count("*").alias("n"), salts_in_use())
        top = each.groupBy("unit").agg(F.sum("n").alias("n"), F.max(F.when(F.col("label").isNotNull(), F.struct("n", "label"))).alias("m"), F.bit_or("salts").alias("salts"))
        parted = materialize(top.select("unit", "n", F.col("m.label").alias("major"), F.col("m.n").alias("core_n"), "salts").where("core_n < n"), "parted")
        few = F.col("n") - F.col("core_n") <= FEW
        probed = star.join(by_salt(parted.where(few)), ["unit", "salt"])
        blocks = F.ceil(F.col("core_n") / F.lit(FEW)).cast("int")
        core = F.coalesce(F.col("label") == F.col("major"), F.lit(False))
        place = F.when(core, F.array(F.pmod(F.xxhash64("node", F.lit(4)), blocks).cast("int"))).otherwise(F.sequence(F.lit(0), blocks - 1))
        probed = probed.withColumn("core", core).withColumn("at", F.explode(place))
        mute = F.when(F.col("core") | (F.col("at") == 0), F.col("label")).otherwise(F.lit(-2))
        if not parted.where(few).isEmpty():
            compared(probed.withColumn("mute", mute).withColumn("unit", F.xxhash64("unit", "at")))
        if parted.where(~few).isEmpty():
            break
        # A child is named by one byte of the sketch, at a place that the unit picks among those that no tree began with.
        at = lambda k: (F.pmod(F.xxhash64("unit", F.lit(100 + k)), F.lit(SKETCH - TREES)) + TREES + 1).cast("int")
        branch = lambda k: F.xxhash64("unit", F.lit(k), F.substring("brief", at(k), F.lit(1)))
        children = star.join(by_salt(parted.where(~few)), ["unit", "salt"])
        rows = materialize(children.select("node", "label", "n_shingles", "brief", F.explode(F.array(*(branch(k) for k in range(BRANCHES)))).alias("unit")), "rows")
    out = edges[0]
    for e in edges[1:]:
        out = out.union(e)
    return out


def linked(threshold_percent: int, part: pa.RecordBatch) -> tuple[list[tuple[int, int]], list[int], Forest]:
    """Confirm links among the rows ``(unit, node, probe, brief, hashes)`` of one unit on the full sets; only pairs with a probe are compared. Gives forest edges."""
    least = least_agreement(threshold_percent)
    column = lambda c: part.column(part.schema.get_field_index(c))
    ids, probe = column("node").to_pylist(), column("probe").to_numpy(zero_copy_only=False)
    values, at = binary_numbers(column("hashes"), U)
    brief = binary_numbers(column("brief"), np.uint8)[0].reshape(-1, SKETCH)
    n, size, forest, edges = len(ids), np.diff(at), Forest(), []
    for k in np.flatnonzero(probe).tolist():
        ok = (100 * np.minimum(size, size[k]) >= threshold_percent * np.maximum(size, size[k])) & ~(probe & (np.arange(n) <= k))
        for j in np.flatnonzero(ok & ((brief == brief[k]).sum(axis=1) >= least)).tolist():
            if ids[j] != ids[k] and forest.top(ids[j]) != forest.top(ids[k]):
                shared = len(np.intersect1d(values[at[k] : at[k + 1]], values[at[j] : at[j + 1]], assume_unique=True))
                if 100 * shared >= threshold_percent * (size[k] + size[j] - shared):
                    forest.join(ids[j], ids[k])
                    edges.append((ids[k], ids[j]))
    return edges, ids, forest


def each_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in whole_units(batches):
        unit = table.column("unit").to_numpy()
        bounds = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
        for i, j in zip(bounds[:-1], bounds[1:]):
            yield table.slice(i, j - i).combine_chunks().to_batches()[0]


def confirm(threshold_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_unit(batches):
            edges, _, _ = linked(threshold_percent, part)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["a", "b"])

    return run


def settle(threshold_percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Units that hold whole nominated components: ``(node, part)`` for each row, where part is the least node it is linked to."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in each_unit(batches):
            _, ids, forest = linked(threshold_percent, part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([forest.top(x) for x in ids], pa.int64())], names=["node", "part"])

    return run


def confirmed_parts(docs: DataFrame, reps: DataFrame, nominated: DataFrame, threshold_percent: int, words: int) -> DataFrame:
    """``(node, part)`` of all nominated nodes: those that true links connect have the same part, a node among them."""
    group = materialize(components(nominated).join(reps.select("node", "id", "k1", "k2", "brief"), "node"), "group")
    sizes = group.withColumn("salt", salt_of(F.col("node"))).groupBy("component").agg(F.count("*").alias("n"), salts_in_use()).where(F.col("n") > BLOCK)
    sizes = materialize(sizes, "sizes")
    sets = full_sets(docs, group.select("id"), words).dropDuplicates(["id", "k1", "k2"])
    members = group.withColumn("salt", salt_of(F.col("node"))).join(by_salt(sizes), ["component", "salt"], "left").drop("salt")
    members = materialize(members.join(sets, ["id", "k1", "k2"]).select("component", "node", "n", "brief", "hashes"), "members")
    small = members.where("n is null").select(F.col("component").alias("unit"), "node", F.lit(True).alias("probe"), "brief", "hashes")
    parts = materialize(in_units(small, settle(threshold_percent), "node long, part long"), "parts")
    if sizes.isEmpty():
        return parts
    run, large = confirm(threshold_percent), members.where("n is not null")
    chunk = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.ceil(n / F.lit(BLOCK))).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.ceil(n / F.lit(BLOCK)).cast("int") - 1)
    lead = F.col("node") == F.col("component")
    star = large.withColumn("probe", lead).withColumn("at", F.explode(F.when(lead, every(F.col("n"))).otherwise(F.array(chunk(F.col("n"), 5)))))
    edges = materialize(in_units(star.select(F.xxhash64("component", "at").alias("unit"), "node", "probe", "brief", "hashes"), run, LINKS), "edges")
    rest = large.where(~lead).select("component", "node").join(edges.select(F.col("b").alias("node")), "node", "left_anti")
    rest = materialize(rest.withColumn("salt", salt_of(F.col("node"))), "rest")
    if not rest.isEmpty():
        # Each block: up to BLOCK of the unlinked against up to BLOCK of all members.
        counts = rest.groupBy("component").agg(F.count("*").alias("r"))
        dealt = lookup(large, "component", "node", counts).where("r is not null").join(rest.select("node", F.lit(True).alias("unlinked")), "node", "left")
        cells = F.transform(every(F.col("r")), lambda i: F.struct(i.cast("int").alias("i"), chunk(F.col("n"), 7).alias("j"), F.lit(False).alias("probe")))
        probes = F.transform(every(F.col("n")), lambda j: F.struct(chunk(F.col("r"), 6).alias("i"), j.cast("int").alias("j"), F.lit(True).alias("probe")))
        dealt = dealt.withColumn("at", F.explode(F.when(F.col("unlinked"), F.concat(cells, probes)).otherwise(cells)))
        blocks = dealt.select(F.xxhash64("component", "at.i", "at.j").alias("unit"), "node", "at.probe", "brief", "hashes")
        edges = edges.union(materialize(in_units(blocks, run, LINKS), "edges"))
    joined = components(edges)
    joined = large.select("node").join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    return parts.union(joined)


def assigned(docs: DataFrame, threshold_percent: int, words: int) -> DataFrame:
    """Each row's ``doc_id, text_key, n_shingles, k1, k2, class_id, component_id, first``: the least id of its class and of its component, and whether its class is the component's first."""
    sets = materialize(document_sets(docs, words), "sets")
    keyed = sets.where("doc_id is not null and k1 is not null").withColumn("salt", salt_of(F.col("doc_id")))
    # All rows of a class agree in what it is grouped by; a hot class is one row per task after the partial aggregation.
    classes = keyed.groupBy("k1", "k2", "n_shingles", "tokens", "brief").agg(F.min("doc_id").alias("id"), F.count("*").alias("n_rows"), salts_in_use())
    reps = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "reps")
    parts = confirmed_parts(docs.where("doc_id is not null"), reps, chosen_paths(reps.select("node", "n_shingles", "tokens", "brief"), threshold_percent), threshold_percent, words)
    parts = materialize(reps.select("node", "id", "k1", "k2", "salts").join(parts, "node"), "placed")
    least = parts.withColumn("salt", salt_of(F.col("node")))
    least = group_values(least, "part", {"component_id": F.min("id"), "lead": F.min(F.struct("id", "k1", "k2"))})
    parts = parts.withColumn("salt", salt_of(F.col("node"))).join(least, ["part", "salt"]).drop("salt")
    first = (F.col("lead.k1") == F.col("k1")) & (F.col("lead.k2") == F.col("k2"))
    parts = parts.select("node", "component_id", first.alias("first"))
    known = by_salt(reps.select("node", "k1", "k2", F.col("id").alias("class_id"), "n_rows", "salts").join(parts, "node", "left").where("n_rows > 1 or component_id is not null").drop("node", "n_rows"))
    own = sets.withColumn("salt", salt_of(F.col("doc_id")))
    out = own.join(materialize(known, "classes"), ["k1", "k2", "salt"], "left")
    class_id: Column = F.coalesce("class_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", "k1", "k2", class_id.alias("class_id"), F.coalesce("component_id", class_id).alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))


def near_duplicates(docs: DataFrame, threshold_percent: int = 80, words: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` per row: groups of documents linked by a Jaccard similarity of at least the threshold.

    Words are runs without ASCII white space, A-Z in lower case; fewer than ``words`` words are one shingle. Texts that are null
    or have no word link with nothing. Rows without doc_id are compared with nothing, have no component and are kept.
    Rows that repeat a doc_id are compared as texts of their own, and each has the component of its own text. Texts of
    any length are read whole; a similarity of exactly the threshold links; an empty table gives an empty result.
    Other columns are not read.
    """
    out = assigned(docs, threshold_percent, words)
    return out.select("doc_id", "n_shingles", "component_id", (F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).alias("kept"))


def keep_first(docs: DataFrame, threshold_percent: int = 80, words: int = 5) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group: of a group of near copies the one of least doc_id stays.

    A row is a document by its doc_id and its text. Equal rows of that pair count once; rows that repeat a doc_id with
    other texts stay, unless their own text is a near copy. Rows without doc_id or without a word stay (the latter once
    per doc_id and text). An empty table gives an empty result; all columns are kept, whatever their names.

    Only rows that a bitmap of the rows to decide on passes are shuffled.
    """
    rows = assigned(docs, threshold_percent, words).where("doc_id is not null")
    rows = rows.withColumn("stays", F.col("first") & (F.col("doc_id") == F.col("class_id")))
    # Of rows that share doc_id and set, which differ in white space or case only, the least text stays.
    rows = materialize(rows.groupBy("doc_id", "k1", "k2", "stays", "text_key").agg(F.count("*").alias("n")), "rows")
    several = rows.where("stays and k1 is not null").groupBy("doc_id", "k1", "k2").agg(F.min("text_key").alias("stays_key"), F.count("*").alias("texts")).where("texts > 1").drop("texts")
    rows = rows.join(several, ["doc_id", "k1", "k2"], "left")
    stays = F.col("stays") & F.coalesce(F.col("stays_key") == F.col("text_key"), F.lit(True))
    decided = materialize(rows.select("doc_id", "text_key", stays.alias("stays"), "n").where("not stays or n > 1").select(F.col("doc_id").alias("_seqloom_id"), F.col("text_key").alias("_seqloom_text"), F.col("stays").alias("_seqloom_stays")), "decided")
    tagged = docs.withColumns({"_seqloom_id": F.col("doc_id").cast("long"), "_seqloom_text": F.xxhash64("text")})
    tagged = mark_among(tagged, F.xxhash64("_seqloom_id", "_seqloom_text"), decided.select(F.xxhash64("_seqloom_id", "_seqloom_text")), "_seqloom_may")
    tagged = tagged.withColumn("_seqloom_may", F.col("_seqloom_id").isNotNull() & F.col("_seqloom_may"))
    sure = tagged.where("not _seqloom_may").select(docs.columns)
    doubtful = tagged.where("_seqloom_may").join(decided, ["_seqloom_id", "_seqloom_text"], "left")
    alone = doubtful.where("_seqloom_stays is null").select(docs.columns)
    once = doubtful.where("_seqloom_stays").dropDuplicates(["_seqloom_id", "_seqloom_text"]).select(docs.columns)
    return sure.union(alone).union(once)
