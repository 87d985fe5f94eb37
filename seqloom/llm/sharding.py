"""Balanced label propagation: linked rows move towards their neighbours' shards under capacity quotas.

DataFrame functions only. Links are hyperedges ``(rid, hub)``: rows that share a hub are linked, so a group of n
copies is n rows and not n^2 pairs. Each round counts the shards of every hub's members (pre-aggregated by a salt,
so a hub with a third of all rows is dealt over many tasks), gives each linked row the sum of its hubs' counts as
votes, and admits moves by the 64-cell matrix of wishes: swaps between two shards are free, the rest shares what
the wanted shard has left. Unlinked rows never move for votes; they are the counterweight with which the last
step makes the row counts equal, to one row, exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, materialize, salt_of


def propagate(links: DataFrame, n_rows: int, n_shards: int, rounds: int) -> DataFrame | None:
    """``(rid, shard)`` of the rows that share a hub with another row; None if there are none.

    ``links (rid, hub)``: null hubs and hubs of a single row link nothing; repeated links count once. The shard
    counts of one hub are ``n_shards`` numbers whatever its size. The driver sees n_shards^2 counts a round.
    """
    shards = range(n_shards)
    links = links.where(F.col("hub").isNotNull() & F.col("rid").isNotNull()).distinct().withColumn("salt", salt_of(F.col("rid")))
    first = links.groupBy("hub", "salt").agg(F.count("*").alias("n"))
    shared = first.join(first.groupBy("hub").agg(F.sum("n").alias("m")).where("m > 1"), "hub").select("hub", "salt")
    links = materialize(links.join(shared, ["hub", "salt"]), "links")
    if links.isEmpty():
        return None
    state = links.select("rid").distinct().withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(n_shards)).cast("int"))
    state = materialize(state, "state")
    cap, opened, written = n_rows // n_shards, list(shards), state
    for k in range(rounds):
        at = links.join(state, "rid")
        first = at.groupBy("hub", "salt").agg(*(F.count(F.when(F.col("shard") == s, 1)).alias(f"c{s}") for s in shards))
        total = first.groupBy("hub").agg(*(F.sum(f"c{s}").alias(f"c{s}") for s in shards))
        dealt = first.select("hub", "salt").join(total, "hub")
        # Ties go to one shard that the hub itself picks, else two copies would swap shards for ever.
        tie = lambda s: (F.lit(n_shards - 1) - F.pmod(F.pmod(F.xxhash64("hub"), F.lit(n_shards)) + F.lit(s), F.lit(n_shards))) / F.lit(n_shards)
        votes = at.join(dealt, ["hub", "salt"]).groupBy("rid", "shard").agg(*(F.sum(F.col(f"c{s}") + tie(s)).alias(f"v{s}") for s in shards))
        open_to = lambda s: F.lit(s in opened) | (F.col("shard") == s)
        best = F.array_max(F.array(*(F.struct(F.when(open_to(s), F.col(f"v{s}")).otherwise(-1.0).alias("v"), F.lit(s).alias("s")) for s in shards)))["s"]
        wish = materialize(votes.select("rid", "shard", best.alias("best")), "wish")
        matrix = {(r["shard"], r["best"]): r["n"] for r in wish.groupBy("shard", "best").agg(F.count("*").alias("n")).collect()}
        held = [sum(n for (f, _), n in matrix.items() if f == s) for s in shards]
        want = {ft: n for ft, n in matrix.items() if ft[0] != ft[1]}
        if not want:
            discard(wish)
            break
        swap = {(f, t): min(n, want.get((t, f), 0)) for (f, t), n in want.items()}
        rest = {ft: n - swap[ft] for ft, n in want.items()}
        free = [max(0, cap - h) for h in held]
        asked = [sum(n for (_, t), n in rest.items() if t == s) for s in shards]
        quota = {(f, t): (swap[f, t] + rest[f, t] * min(1.0, free[t] / max(1, asked[t]))) / n for (f, t), n in want.items()}
        opened = [s for s in shards if free[s] > asked[s] * 0.999 and free[s] > cap // 1000] or opened
        draw = F.pmod(F.xxhash64("rid", F.lit(1000 + k)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        if k >= rounds // 2:
            # Late rounds move half of the rows at a time: neighbours that want to change places would follow each other for ever.
            draw = F.when(F.pmod(F.xxhash64("rid", F.lit(77 + k // 2)), F.lit(2)) == k % 2, draw).otherwise(F.lit(1.0))
        admit = F.lit(0.0)
        for (f, t), q in quota.items():
            admit = F.when((F.col("shard") == f) & (F.col("best") == t), F.lit(float(q))).otherwise(admit)
        state = wish.select("rid", F.when(draw < admit, F.col("best")).otherwise(F.col("shard")).alias("shard"))
        discard(written)
        written = wish
    return state


def shard_rows(rows: DataFrame, links: DataFrame, n_shards: int = 8, rounds: int = 8, rows_per_bucket: int = 50_000) -> DataFrame:
    """``rows (rid, ...)`` with ``shard`` (counts at most one apart) and ``slot`` (gapless from 0 in each shard).

    ``rid`` must be unique and not null; every other column is kept, whatever its name, but ``shard`` and ``slot``, which
    are replaced. The result depends on the rids and links alone, not on how the rows are dealt. Slots come from a
    two-level rank: counts by (shard, linked, bucket) are prefix-summed over at most 2 * n_shards * 4096 rows,
    and rows are numbered inside their bucket, so no shard is sorted in one task. An empty table gives an empty one.
    """
    others = [c for c in rows.columns if c not in ("rid", "shard", "slot")]
    rows = rows.select("rid", F.struct(*(F.col(f"`{c}`") for c in others)).alias("payload") if others else F.lit(None).alias("payload"))
    n = rows.count()
    state = propagate(links, n, n_shards, rounds)
    start = F.pmod(F.xxhash64("rid"), F.lit(n_shards)).cast("int")
    if state is None:
        placed = rows.withColumn("from_shard", start).withColumn("linked", F.lit(0))
    else:
        state = state.withColumnRenamed("shard", "moved")
        placed = rows.join(state, "rid", "left").withColumn("from_shard", F.coalesce("moved", start)).withColumn("linked", F.when(F.col("moved").isNotNull(), 1).otherwise(0)).drop("moved")
    buckets = int(min(4096, max(16, n // rows_per_bucket // n_shards)))
    placed = placed.withColumn("bucket", F.pmod(F.xxhash64("rid", F.lit(7)), F.lit(buckets)).cast("int"))
    placed = materialize(placed, "placed")
    sizes = placed.groupBy("from_shard", "linked", "bucket").agg(F.count("*").alias("n"))
    before = sizes.withColumn("offset", F.sum("n").over(Window.partitionBy("from_shard").orderBy("linked", "bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("from_shard", "linked", "bucket", F.coalesce("offset", F.lit(0)).alias("offset"))
    held = {r["from_shard"]: r["n"] for r in sizes.groupBy("from_shard").agg(F.sum("n").alias("n")).collect()}
    held = [held.get(s, 0) for s in range(n_shards)]
    target = [n // n_shards + (s < n % n_shards) for s in range(n_shards)]
    surplus = [max(0, h - t) for h, t in zip(held, target)]
    missing = [max(0, t - h) for h, t in zip(held, target)]
    by_shard = lambda values: F.element_at(F.array(*(F.lit(int(v)) for v in values)), F.col("from_shard") + 1).cast("long")
    inner = F.row_number().over(Window.partitionBy("from_shard", "linked", "bucket").orderBy("rid")) - 1
    ranked = placed.join(F.broadcast(before), ["from_shard", "linked", "bucket"]).withColumn("rank", F.col("offset") + inner)
    # The first `surplus` rows of a shard leave it: unlinked ones, as those come first.
    leaves = F.col("rank") < by_shard(surplus)
    queue = by_shard([sum(surplus[:s]) for s in range(n_shards)]) + F.col("rank")
    shard, slot, start_at = F.col("from_shard"), F.col("rank") - by_shard(surplus), 0
    for t in range(n_shards):
        if missing[t]:
            here = leaves & (queue >= start_at) & (queue < start_at + missing[t])
            shard = F.when(here, F.lit(t)).otherwise(shard)
            slot = F.when(here, F.lit(held[t]) + queue - F.lit(start_at)).otherwise(slot)
            start_at += missing[t]
    return ranked.select("rid", *(F.col("payload")[c].alias(c) for c in others), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Shards of documents where equal texts are linked: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    Null texts have size 1 and crc32 0 and are linked with nothing; empty texts are equal to each other. Repeated
    rows and repeated or null doc_ids are rows like any other. Texts of any length are read whole; an empty table gives
    an empty result. Further columns of ``docs`` are not read. The rows of the result do not depend on partitions.
    """
    text = F.col("text").cast("binary")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("hub"),
        F.monotonically_increasing_id().alias("at"),
    )
    # A row is named by its content, and equal rows by their number: the same names however the table is dealt.
    content = F.unhex(F.md5(F.concat(F.coalesce("hub", F.lit(b"")), F.lit(b"|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))))
    base = materialize(base.withColumn("content", content).withColumn("salt", salt_of(F.col("at"))), "rows")
    counts = base.groupBy("content", "salt").agg(F.count("*").alias("n"))
    several = counts.groupBy("content").agg(F.sum("n").alias("m")).where("m > 1").drop("m")
    # Equal rows are dealt over salts and numbered inside them; at most 64 counts of one content are summed in a window.
    before = F.sum("n").over(Window.partitionBy("content").orderBy("salt")) - F.col("n")
    offsets = materialize(counts.join(several, "content").withColumn("before", before).drop("n"), "repeats")
    numbered = base.join(offsets, ["content", "salt"]).withColumn("number", F.col("before") + F.row_number().over(Window.partitionBy("content", "salt").orderBy("at")) - 1).drop("before")
    alone = base.join(offsets.select("content").distinct(), "content", "left_anti").withColumn("number", F.lit(0).cast("long"))
    named = alone.unionByName(numbered) if not offsets.isEmpty() else alone
    rid = F.concat("content", F.unhex(F.lpad(F.hex("number"), 16, "0")))
    named = materialize(named.select(rid.alias("rid"), "doc_id", "size", "text_crc32", "hub"), "named")
    out = shard_rows(named.drop("hub"), named.select("rid", "hub"), n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
