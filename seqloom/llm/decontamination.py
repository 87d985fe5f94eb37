"""Benchmark decontamination: short test items inside long documents by size-partitioned MinHash containment.

Items are partitioned by the size of their shingle set, in powers of two, and sketched by their minwise shingles. The
partition fixes the sketch: with L the shingles that its largest item may lack at the threshold, 2 (L + 1) values.
A document that contains an item of which l shingles may be missing holds all but l of the sketch, whatever the
document's own length, so a count of sketch values in a document is a containment test that loses nothing.
What it passes is verified by the exact share of the item's shingles that the document holds.

Everything is a join on shingle hashes, so neither driver nor executors hold the benchmark. Documents are read once:
a Bloom filter of fixed size over the items' shingles picks the shingles that are written and joined; what it passes
by chance falls out in the join. Both joins deal the documents of a hot shingle or item over salts.
Contamination depends on the text alone, so it is kept by two 64-bit hashes of the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kernels import CHUNK, releasing, shingle_sets
from .minhash import set_keys
from .shared import bloom_bits, in_bloom, lookup, mark_among, materialize


def separators() -> np.ndarray:
    """Bytes between words here: all of ASCII but letters and digits, so that punctuation and case don't hide a passage."""
    s = np.zeros(256, dtype=bool)
    s[:128] = True
    s[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
    return s


def item_sets(benchmark: DataFrame, words: int) -> DataFrame:
    """``item_id, k1, k2, values``: the key of each item's set, and its shingle hashes in order. Items without a word are left out."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, values, at in shingle_sets(batch, words, separators()):
                k1, k2 = set_keys(values, at)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(k1), pa.array(k2), lists], names=["item_id", "k1", "k2", "values"])

    out = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, "item_id long, k1 long, k2 long, values array<long>")
    return out.where(F.size("values") > 0)


def least_share(size: Column, threshold_percent: int) -> Column:
    """The threshold in whole shingles, upwards."""
    return F.floor((size * threshold_percent + 99) / 100).cast("int")


def text_keys(text: str = "text") -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2")]


def leaked_texts(docs: DataFrame, benchmark: DataFrame, words: int, threshold_percent: int) -> tuple[DataFrame, DataFrame]:
    """``t1, t2, k1, k2, shared, item_shingles``: the texts (by their keys) that contain an item, and the key of each item's set; and ``k1, k2, item_id``, its members."""
    items = materialize(item_sets(benchmark, words), "items")
    sets = items.dropDuplicates(["k1", "k2"]).select("k1", "k2", "values", F.size("values").alias("n"))
    # The largest size of the partition decides the sketch's length.
    largest = (F.expr("shiftleft(1L, cast(floor(log2(n)) as int) + 1)") - 1).cast("int")
    sets = sets.withColumn("need", least_share(F.col("n"), threshold_percent))
    sets = sets.withColumn("sketch", F.least(F.col("n"), 2 * (largest - least_share(largest, threshold_percent) + 1)))
    sets = materialize(sets.withColumn("least", F.greatest(F.lit(1), F.col("sketch") - (F.col("n") - F.col("need")))).withColumn("node", F.monotonically_increasing_id()), "sets")
    octets = bloom_bits(sets.select(F.explode("values")))

    @releasing
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t1, t2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, _, values, at in shingle_sets(batch, words, separators()):
                hit = np.concatenate([s + np.flatnonzero(in_bloom(octets, values[s : s + CHUNK])) for s in range(0, len(values), CHUNK)] or [np.empty(0, np.int64)])
                row = i + np.searchsorted(at, hit, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(t1[row]), pa.array(t2[row]), pa.array(values[hit].view(np.int64))], names=["t1", "t2", "value"])

    hits = docs.where("text is not null").select(*text_keys(), "text").mapInArrow(probe, "t1 long, t2 long, value long").distinct()
    hits = materialize(hits, "hits")
    minwise = sets.select("node", "least", F.explode(F.expr("slice(values, 1, sketch)")).alias("value"))
    found = lookup(hits, "value", "t1", minwise).where("node is not null")
    found = found.groupBy("t1", "t2", "node").agg(F.count("*").alias("held"), F.max("least").alias("least")).where("held >= least").select("t1", "t2", "node")
    # Each candidate's whole set against what its text holds of it.
    asked = lookup(materialize(found, "candidates"), "node", "t1", sets.select("node", "n", "need", "k1", "k2", "values")).withColumn("value", F.explode("values"))
    leaks = asked.join(hits, ["t1", "t2", "value"]).groupBy("t1", "t2", "node").agg(F.count("*").cast("int").alias("shared"), *(F.first(c).alias(c) for c in ("n", "need", "k1", "k2"))).where("shared >= need")
    return materialize(leaks.select("t1", "t2", "k1", "k2", "shared", F.col("n").alias("item_shingles")), "leaks"), items.select("k1", "k2", "item_id")


def leaked_items(leaks: DataFrame, items: DataFrame) -> DataFrame:
    """``t1, t2, item_id, shared, item_shingles``: repeated items are one set, and each comes back under its id."""
    return leaks.join(items, ["k1", "k2"]).select("t1", "t2", "item_id", "shared", "item_shingles")


def leak_pairs(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """One row per document and item found in it: ``doc_id, item_id, shared, item_shingles, containment``.

    A text holds an item if it holds ``threshold_percent`` of its distinct shingles, exactly that share included. Words
    are runs of ASCII letters, digits and non-ASCII characters, A-Z in lower case. An item of fewer than ``words``
    words is one shingle, which only a text of just these words holds; items and texts that are null or have no word
    match nothing. Rows that repeat are rows like any other, and repeated items are each reported under their id.
    Texts of any length are read whole; an empty table on either side gives an empty result; other columns are not read.
    """
    leaks = materialize(leaked_items(*leaked_texts(docs, benchmark, words, threshold_percent)), "pairs")
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys())
    rows = mark_among(rows, F.col("t1"), leaks.select("t1"), "may").where("may").drop("may")
    out = lookup(rows, ["t1", "t2"], "doc_id", leaks).where("shared is not null")
    return out.select("doc_id", "item_id", "shared", "item_shingles").withColumn("containment", F.col("shared") / F.col("item_shingles"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """``docs`` with ``leaks``: the benchmark items in each text, as :func:`leak_pairs` finds them. A column ``leaks`` of its own is replaced.

    A text's leaks are one array in the order of their items, so the items in one text must fit in a row. Null and empty
    texts, and all texts where a table is empty, have an empty array; rows that repeat, and rows without doc_id, are rows
    like any other; texts of any length are read whole; columns of any other name stay as they are.
    """
    leaks = leaked_items(*leaked_texts(docs, benchmark, words, threshold_percent))
    each = leaks.groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("item_id", "shared", "item_shingles"))).alias("leaks"))
    docs = docs.drop("leaks")
    each = each.withColumnRenamed("t1", "_seqloom_t1").withColumnRenamed("t2", "_seqloom_t2")
    rows = docs.withColumns({"_seqloom_t1": text_keys()[0], "_seqloom_t2": text_keys()[1]})
    out = lookup(rows, ["_seqloom_t1", "_seqloom_t2"], "doc_id" if "doc_id" in docs.columns else "_seqloom_t1", each)
    return out.select(*docs.columns, F.coalesce("leaks", F.array().cast(each.schema["leaks"].dataType)).alias("leaks"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 5, threshold_percent: int = 80) -> DataFrame:
    """The documents in which :func:`leak_pairs` finds nothing. All columns stay as they are, whatever their names.

    Null and empty texts stay, and so do all documents where the benchmark is empty; rows that repeat go or stay together;
    texts of any length are read whole; an empty table gives an empty result.

    Only rows whose text a bitmap of the leaked ones passes are joined; the others stay where they are.
    """
    texts = leaked_texts(docs, benchmark, words, threshold_percent)[0].select(F.col("t1").alias("_seqloom_t1"), F.col("t2").alias("_seqloom_t2")).distinct()
    texts = materialize(texts, "texts")
    tagged = docs.withColumns({"_seqloom_t1": text_keys()[0], "_seqloom_t2": text_keys()[1]})
    tagged = mark_among(tagged, F.col("_seqloom_t1"), texts.select("_seqloom_t1"), "_seqloom_may")
    tagged = tagged.withColumn("_seqloom_may", F.col("text").isNotNull() & F.col("_seqloom_may"))
    sure = tagged.where("not _seqloom_may").select(docs.columns)
    member = "doc_id" if "doc_id" in docs.columns else "_seqloom_t1"
    doubtful = lookup(tagged.where("_seqloom_may"), ["_seqloom_t1", "_seqloom_t2"], member, texts.withColumn("_seqloom_leaks", F.lit(True)))
    alone = doubtful.where("_seqloom_leaks is null").select(docs.columns)
    return sure.union(alone)
