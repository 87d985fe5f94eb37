"""Tables in the shared folder, joins that spread hot keys, units of work, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets over which the rows of one key are dealt; a key with a third of all rows becomes SALTS small keys.
SALTS = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session that runs in one JVM may leave it unset (tests): it gets a temporary folder. On a cluster that would
    be a folder of one machine, so it is an error there.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = f"file://{tempfile.mkdtemp(prefix='seqloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/seqloom/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table of :func:`materialize` that nothing will read again."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def salt_of(col: Column, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(col, F.lit(11)), F.lit(salts)).cast("int")


def salts_in_use() -> Column:
    """An aggregate: the set of the group's values of ``salt``, as the bits of a long."""
    return F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")


def by_salt(values: DataFrame) -> DataFrame:
    """One row per salt in ``salts``, with the column ``salt`` instead."""
    used = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit("salts", k) == 1)
    return values.withColumn("salt", F.explode(used)).drop("salts")


def group_values(rows: DataFrame, key: str | list[str], aggs: dict[str, Column], having: Column | None = None) -> DataFrame:
    """Rows ``(key, salt, *aggs)`` to join back to ``rows`` on key and salt without a hot key.

    One shuffle of partial aggregates: a task sends one row per key however many rows it has of it. ``rows`` must have
    the column ``salt`` (see :func:`salt_of`); a key comes back once per salt that its rows have.
    """
    groups = rows.groupBy(*([key] if isinstance(key, str) else key)).agg(*(c.alias(n) for n, c in aggs.items()), salts_in_use())
    return by_salt(groups if having is None else groups.where(having))


def lookup(rows: DataFrame, key: str | list[str], member: str, values: DataFrame) -> DataFrame:
    """``rows`` left-joined to ``values`` on ``key``, the rows of a hot key dealt over salts by ``member``."""
    keys = [key] if isinstance(key, str) else key
    salted = rows.withColumn("_seqloom_salt", salt_of(F.col(member)))
    used = salted.select(*keys, F.col("_seqloom_salt").alias("salt")).groupBy(*keys).agg(salts_in_use()).join(values, keys)
    return salted.join(by_salt(used).withColumnRenamed("salt", "_seqloom_salt"), [*keys, "_seqloom_salt"], "left").drop("_seqloom_salt")


class Forest:
    """Union-find with path halving; the least node names a set. ``join`` says whether two were still apart."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


#: Edges that one task may finish by union-find.
FINISH = 200_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges (a, b)``: one row ``(node, component)``, component = least node.

    Randomised contraction: in each round every node hooks to the neighbour (or itself) of least priority, edges are
    relabelled by those parents, self loops and repeats dropped. Priorities are the ids in the first round, which
    ends stars around their least node, and random from then on, so that nodes fall by a constant factor a round.
    Once at most FINISH edges are left, one task ends it. Each round's tables are written to the shared folder; only
    the number of edges reaches the driver. Nulls in an edge are ignored; an empty input gives an empty result.
    """
    node = edges.schema["a"].dataType.simpleString()
    e = edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kind = Forest(), pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forest.join(a, b)
        nodes = sorted({*forest.up, *forest.up.values()})
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([forest.top(x) for x in nodes], kind)], names=["node", "parent"])

    for k in range(max_rounds):
        n = e.count()
        if not n:
            break
        if n <= FINISH:
            parent = materialize(e.repartition(1).mapInArrow(finish, f"node {node}, parent {node}"), f"parent{k}")
        else:
            # A node's parent comes with the salts of its edges, so that the edges of a star's centre spread in the joins.
            both = e.union(e.select("b", "a")).withColumn("salt", salt_of(F.col("b")))
            rank = lambda c: F.struct((F.xxhash64(c, F.lit(k)) if k else F.lit(0).cast("long")).alias("h"), c.alias("v"))  # noqa: E731, B023
            parent = both.groupBy(F.col("a").alias("node")).agg(F.min(rank(F.col("b"))).alias("m"), salts_in_use())
            parent = materialize(parent.select("node", F.least("m", rank(F.col("node")))["v"].alias("parent"), "salts"), f"parent{k}")
            ends = by_salt(parent)
            pa_, pb = ends.select(F.col("node").alias("a"), "salt", F.col("parent").alias("pa")), ends.select(F.col("node").alias("b"), "salt", F.col("parent").alias("pb"))
            nxt = e.withColumn("salt", salt_of(F.col("b"))).join(pa_, ["a", "salt"]).withColumn("salt", salt_of(F.col("a"))).join(pb, ["b", "salt"]).where("pa <> pb")
            nxt = materialize(nxt.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        if label is None:
            label = parent.select("node", F.col("parent").alias("top"))
        else:
            step = parent.select(F.col("node").alias("top"), F.col("parent").alias("up"))
            label = lookup(label, "top", "node", step).select("node", F.coalesce("up", "top").alias("top"))
        discard(e)
        if n <= FINISH:
            break
        e = nxt
    else:
        raise RuntimeError(f"components: still contracting after {max_rounds} rounds")
    if label is None:
        return edges.sparkSession.createDataFrame([], f"node {node}, component {node}")
    if not k and n <= FINISH:
        return label.withColumnRenamed("top", "component")
    label = label.withColumn("salt", salt_of(F.col("node")))
    least = group_values(label, "top", {"component": F.min("node")})
    return label.join(least, ["top", "salt"]).select("node", "component")


def whole_units(batches: Iterator[pa.RecordBatch], key: str = "unit") -> Iterator[pa.Table]:
    """Tables of complete runs of ``key`` from batches in which equal keys are together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy()
        new = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            yield pa.Table.from_batches([*held, batch.slice(0, int(new[-1]))])
            held = [batch.slice(int(new[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def in_units(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, units: int | None = None) -> DataFrame:
    """Bring the rows of each ``unit`` together and apply ``run``, which gets batches sorted by unit.

    Where a unit's work is far more than its bytes say, ``units`` (how many there are) sets the number of tasks: without it the
    engine would join small partitions, and a few tasks would do all of it.
    """
    if units is None:
        dealt = rows.repartition("unit")
    else:
        most = max(4 * rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = rows.repartition(max(1, min(4 * units, most)), "unit")
    return dealt.sortWithinPartitions("unit").mapInArrow(run, schema)
