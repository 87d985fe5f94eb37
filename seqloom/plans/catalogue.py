"""Named queries over the driver's tables, and the SQL that gives the same rows.

A document's sequence is the string of the canonical capital letters of its whole text; records of 8 to 50 letters
pass the boundary check. The known collection are the sequences (any length) of conversations and of documents
labelled toxic, so it overlaps the candidates. Numbers that sums of floats produce are rounded to six digits on both
sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import residues as R
from ..functions.vectors import Gaussian, RandomFeatures, Slope
from ..operators import align, allocation, distributions, learn, ranking, reports, selection, sets, similarity, tables, validate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LETTERS = f"[^{R.ALPHABET}]"
#: What the SQL removes letter by letter goes in runs here: the same string, with one match for the text between two capitals.
RUNS = f"{LETTERS}+"
#: Common table expressions that the SQL forms start from.
SQL = {
    "c": f"c AS (SELECT doc_id, seq FROM (SELECT doc_id, regexp_replace(text, '{LETTERS}', '', 'g') AS seq FROM documents) WHERE length(seq) BETWEEN 8 AND 50)",
    "d": "d AS (SELECT DISTINCT seq FROM c)",
    "k": f"k AS (SELECT conv_id, turn, seq FROM (SELECT conv_id, turn, regexp_replace(text, '{LETTERS}', '', 'g') AS seq FROM (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT -1 - doc_id, 0, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))) WHERE length(seq) >= 1)",
    "li": "li AS (SELECT *, l_discount * 10 AS prob, l_quantity AS mic, l_tax AS known FROM lineitem)",
}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Register a query under its name, with its SQL if it has one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            heads = ", ".join(SQL.get(x, x) for x in ctes)
            ORACLES[f.__name__] = (f"WITH {'RECURSIVE ' * recursive}{heads} " if heads else "") + sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq = F.regexp_replace("text", RUNS, "")
    return table(spark, sf_dir, "documents").select("doc_id", seq.alias("seq")).where(R.canonical(F.col("seq")))


def distinct_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("seq").distinct()


def known(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    rows = rows.union(toxic.select(-1 - F.col("doc_id"), F.lit(0).cast("long"), "text"))
    return rows.select("conv_id", "turn", F.regexp_replace("text", RUNS, "").alias("seq")).where(R.canonical(F.col("seq"), None, None))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("*", (F.col("l_discount") * 10).alias("prob"), F.col("l_quantity").alias("mic"), F.col("l_tax").alias("known"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def joined(c: Column) -> Column:
    """An array as a comma-separated string."""
    return F.array_join(c.cast("array<string>"), ",")


# --- scalar functions and filters


@query("SELECT DISTINCT seq FROM c", "c")
def canonicalise_filter_distinct(spark, d):
    from ..sources.readers import clean_sequences

    return clean_sequences(candidates(spark, d))


@query("SELECT seq, sha256(seq) AS sequence_id FROM d", "c", "d")
def sequence_id_sha256(spark, d):
    return distinct_candidates(spark, d).select("seq", R.sequence_id(F.col("seq")).alias("sequence_id"))


def _counts_sql(scale: dict[str, float]) -> str:
    return " + ".join(f"(length(seq) - length(replace(seq, '{a}', ''))) * ({v!r}::DOUBLE)" for a, v in scale.items())


_CHARGES = {a: 1 / (1 + 10 ** (7 - pk)) for a, pk in R.POSITIVE_PK.items() if len(a) == 1} | {a: -1 / (1 + 10 ** (pk - 7)) for a, pk in R.NEGATIVE_PK.items() if len(a) == 1}


@query(f"SELECT seq, round(1 / (1 + pow(10, 7 - 8.0)) - 1 / (1 + pow(10, 3.1 - 7)) + {_counts_sql(_CHARGES)}, 6) AS charge FROM d", "c", "d")
def net_charge(spark, d):
    return distinct_candidates(spark, d).select("seq", r6(R.net_charge(F.col("seq"))).alias("charge"))


@query(f"SELECT seq, round(({_counts_sql(R.EISENBERG)}) / length(seq), 6) AS hydrophobicity FROM d", "c", "d")
def mean_hydropathy(spark, d):
    return distinct_candidates(spark, d).select("seq", r6(R.mean_scale(F.col("seq"))).alias("hydrophobicity"))


_SCALE_SQL = "h AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', {v!r}::DOUBLE)" for a, v in R.EISENBERG.items()) + ") AS t(aa, v))"
_CHARS_SQL = "x AS (SELECT seq, k, substring(seq, k::INT, 1) AS aa FROM (SELECT seq, unnest(range(1, length(seq) + 1)) AS k FROM d))"


@query(
    "SELECT seq, round(sqrt(pow(sum(v * cos((k - 1) * radians(100))), 2) + pow(sum(v * sin((k - 1) * radians(100))), 2)) / length(seq), 6) AS moment FROM x JOIN h USING (aa) GROUP BY seq",
    "c", "d", _SCALE_SQL, _CHARS_SQL,
)
def hydrophobic_moment(spark, d):
    return distinct_candidates(spark, d).select("seq", r6(R.moment(F.col("seq"))).alias("moment"))


@query("SELECT seq, aa, round(count(*) / any_value(length(seq)), 6) AS fraction FROM x GROUP BY seq, aa", "c", "d", _CHARS_SQL)
def residue_composition(spark, d):
    rows = distinct_candidates(spark, d).select("seq", F.explode(R.composition(F.col("seq"))).alias("aa", "fraction"))
    return rows.where("fraction > 0").select("seq", "aa", r6(F.col("fraction")).alias("fraction"))


@query(
    "SELECT seq, pair, round(count(*) / any_value(length(seq) - 1), 6) AS frequency FROM (SELECT seq, substring(seq, k::INT, 2) AS pair FROM x WHERE k < length(seq)) GROUP BY seq, pair",
    "c", "d", _CHARS_SQL,
)
def dipeptide_frequency(spark, d):
    rows = distinct_candidates(spark, d).select("seq", F.explode(R.dipeptides(F.col("seq"))).alias("pair"))
    return rows.groupBy("seq", "pair").agg(r6(F.count("*") / F.greatest(F.lit(1), F.first(F.length("seq")) - 1)).alias("frequency"))


_RUN_SQL = "runs AS (SELECT seq, aa, count(*) AS n FROM (SELECT seq, k, aa, k - row_number() OVER (PARTITION BY seq, aa ORDER BY k) AS island FROM x) GROUP BY seq, aa, island)"


@query("SELECT seq, max(n)::INT AS longest FROM runs GROUP BY seq", "c", "d", _CHARS_SQL, _RUN_SQL)
def longest_run(spark, d):
    return distinct_candidates(spark, d).select("seq", R.longest_run(F.col("seq")).alias("longest"))


@query(
    "SELECT round(quantile_cont(longest, 0.9), 6) AS run_q90, round(quantile_cont(length(regexp_replace(seq, '[^AILMFWVY]', '', 'g')) / length(seq), 0.9), 6) AS hydrophobic_q90, "
    "round(avg((seq LIKE '%C%')::INT), 6) AS cysteine, round(avg(length(regexp_replace(seq, '[^C]', '', 'g')) % 2), 6) AS odd_cysteine, round(quantile_cont(length(regexp_replace(seq, '[^CMW]', '', 'g')), 0.9), 6) AS cmw_q90 "
    "FROM d JOIN (SELECT seq, max(n) AS longest FROM runs GROUP BY seq) USING (seq)",
    "c", "d", _CHARS_SQL, _RUN_SQL,
)
def chemistry_diagnostics(spark, d):
    s = F.col("seq")
    q90 = lambda c: r6(F.percentile(c, F.lit(0.9)))
    return distinct_candidates(spark, d).agg(
        q90(R.longest_run(s)).alias("run_q90"), q90(R.fraction_in(s)).alias("hydrophobic_q90"), r6(F.avg((R.count_in(s, "C") > 0).cast("int"))).alias("cysteine"),
        r6(F.avg(R.count_in(s, "C") % 2)).alias("odd_cysteine"), q90(R.count_in(s, "CMW")).alias("cmw_q90"),
    )


@query("SELECT seq, array_to_string(list_transform(string_split(seq, ''), lambda a: strpos('ACDEFGHIKLMNPQRSTVWY', a) - 1), ',') AS tokens FROM d", "c", "d")
def residue_tokens(spark, d):
    return distinct_candidates(spark, d).select("seq", joined(R.tokens(F.col("seq"))).alias("tokens"))


@query("SELECT l_orderkey, l_linenumber, round((l_quantity - m) / greatest(s, 0.01), 6) AS z FROM lineitem, (SELECT avg(p_size) AS m, stddev_pop(p_size) AS s FROM part)")
def zscore_vs_reference(spark, d):
    stats = table(spark, d, "part").agg(F.avg("p_size").alias("m"), F.stddev_pop("p_size").alias("s"))
    rows = table(spark, d, "lineitem").crossJoin(F.broadcast(stats))  # one row
    return rows.select("l_orderkey", "l_linenumber", r6(R.z_score(F.col("l_quantity"), F.col("m"), F.col("s"))).alias("z"))


@query(
    "SELECT DISTINCT h AS predictor, CASE WHEN h LIKE '%!_prob' ESCAPE '!' THEN 'amp_probability' WHEN h LIKE '%!_MIC!_uM' ESCAPE '!' THEN 'mic_um' END AS kind, lower(regexp_extract(h, '^([^-_]+)', 1)) AS family "
    "FROM (SELECT p_type || '-' || p_brand || (CASE p_size % 3 WHEN 0 THEN '_prob' WHEN 1 THEN '_MIC_uM' ELSE '_other' END) AS h FROM part)"
)
def header_families(spark, d):
    """The headers of a score table per type and brand: what kind of score each is, and of which family of models."""
    ending = F.when(F.col("p_size") % 3 == 0, "_prob").when(F.col("p_size") % 3 == 1, "_MIC_uM").otherwise("_other")
    names = table(spark, d, "part").select(F.concat("p_type", F.lit("-"), "p_brand", ending).alias("predictor")).distinct()
    return names.select("predictor", *(c.alias(k) for k, c in R.family_of(F.col("predictor")).items()))


@query("SELECT seq, min(doc_id) AS doc_id FROM c GROUP BY seq", "c")
def first_occurrences(spark, d):
    return ranking.first_occurrences(candidates(spark, d), "seq", "doc_id")


# --- joins and sets


@query(
    "SELECT d.seq, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id, turn) AS ids, string_agg(turn::VARCHAR, ',' ORDER BY conv_id, turn) AS headers FROM d JOIN k USING (seq) GROUP BY d.seq",
    "c", "d", "k",
)
def exact_overlap_headers(spark, d):
    out = sets.exact_matches(distinct_candidates(spark, d), known(spark, d), ident="conv_id", header="turn")
    return out.select("seq", joined(F.col("ids")).alias("ids"), joined(F.col("headers")).alias("headers"))


@query("SELECT doc_id, seq FROM c WHERE seq NOT IN (SELECT seq FROM k)", "c", "k")
def exclude_known(spark, d):
    return sets.exclude(candidates(spark, d), known(spark, d)).select("doc_id", "seq")


@query("SELECT seq FROM c UNION SELECT seq FROM k", "c", "k")
def known_union(spark, d):
    return sets.known_union(candidates(spark, d), known(spark, d))


_CLASSES = "lb AS (SELECT DISTINCT seq FROM c WHERE doc_id IN (SELECT doc_id FROM labels)), un AS (SELECT DISTINCT seq FROM c WHERE doc_id NOT IN (SELECT doc_id FROM labels))"


@query("SELECT seq, seq IN (SELECT seq FROM lb) AS conflict FROM un", "c", _CLASSES)
def conflict_removal(spark, d):
    """Sequences of documents without a label against those with one: copies make some of them both."""
    rows, labels = candidates(spark, d), table(spark, d, "labels")
    clean, conflicts = sets.remove_conflicts(rows.join(labels, "doc_id", "left_anti").select("seq").distinct(), rows.join(labels, "doc_id", "left_semi"))
    return clean.select("seq", F.lit(False).alias("conflict")).union(conflicts.select("seq", F.lit(True).alias("conflict")))


@query("SELECT c.doc_id, seq, quality, toxic FROM c JOIN labels USING (doc_id)", "c")
def score_join_coverage(spark, d):
    return sets.join_scores(candidates(spark, d), table(spark, d, "labels"), "doc_id", required=False)


@query(
    "SELECT n_nationkey, round(coalesce(avg(c_acctbal), 0), 6) AS customer_balance, any_value(s) AS supplier_balance FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey "
    "LEFT JOIN (SELECT s_nationkey, round(avg(s_acctbal), 6) AS s FROM supplier GROUP BY s_nationkey) ON s_nationkey = n_nationkey GROUP BY n_nationkey",
)
def merge_predictor_tables(spark, d):
    nation = table(spark, d, "nation").select("n_nationkey")
    mean = lambda t, key, value: table(spark, d, t).groupBy(F.col(key).alias("n_nationkey")).agg(r6(F.avg(value)).alias("v"))
    a = nation.join(mean("customer", "c_nationkey", "c_acctbal"), "n_nationkey", "left").select("n_nationkey", F.coalesce("v", F.lit(0.0)).alias("customer_balance"))
    b = nation.join(mean("supplier", "s_nationkey", "s_acctbal"), "n_nationkey", "left").withColumnRenamed("v", "supplier_balance")
    return sets.merge_tables(a, b, "n_nationkey")


@query("SELECT s.seq, sum(n)::BIGINT AS rows_seen, count(*)::BIGINT AS sources FROM (SELECT seq, count(*) AS n FROM c GROUP BY seq UNION ALL SELECT seq, count(*) FROM k GROUP BY seq) AS s GROUP BY s.seq", "c", "k")
def source_counts(spark, d):
    tagged = candidates(spark, d).select("seq", F.lit("documents").alias("source")).union(known(spark, d).select("seq", F.lit("known").alias("source")))
    return tagged.groupBy("seq").agg(F.count("*").alias("rows_seen"), F.count_distinct("source").alias("sources"))


@query("SELECT count(*)::BIGINT AS records, count(DISTINCT seq)::BIGINT AS uniques, min(length(seq))::INT AS shortest, max(length(seq))::INT AS longest FROM c", "c")
def release_stats(spark, d):
    return candidates(spark, d).agg(F.count("*").alias("records"), F.count_distinct("seq").alias("uniques"), F.min(F.length("seq")).alias("shortest"), F.max(F.length("seq")).alias("longest"))


# --- aggregates, ranks, quotas


@query(
    "SELECT l_returnflag, count(*)::BIGINT AS n, round(avg(prob), 6) AS amplify_mean, round(avg(mic), 6) AS mic_mean, round(quantile_cont(mic, 0.5), 6) AS mic_median, round(quantile_cont(mic, 0.9), 6) AS mic_p90, "
    "round(exp(avg(ln(mic))), 6) AS mic_geomean, round(avg((mic <= 16)::INT), 6) AS fraction_le_16 FROM li GROUP BY l_returnflag",
    "li",
)
def activity_summary(spark, d):
    out = scores(spark, d).groupBy("l_returnflag").agg(*distributions.activity_summary(F.col("prob"), F.col("mic")))
    return out.select("l_returnflag", "n", *(r6(F.col(c)).alias(c) for c in out.columns[2:]))


def _rank_sql(x: str) -> str:
    return f"(rank() OVER (ORDER BY {x}) + (count(*) OVER (PARTITION BY {x}) - 1) / 2 - 0.5) / count(*) OVER ()"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity, round({_rank_sql('l_quantity')}, 6) AS percentile FROM lineitem")
def percentile_rank(spark, d):
    out = ranking.percentile_rank(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_quantity", "percentile")
    return out.select("l_orderkey", "l_linenumber", "l_quantity", r6(F.col("percentile")).alias("percentile"))


@query(f"SELECT l_orderkey, l_linenumber, round(0.55 * {_rank_sql('-log2(mic)')} + 0.45 * {_rank_sql('prob')} - 0.05 * {_rank_sql('known')}, 9) AS utility FROM li", "li")
def weighted_utility(spark, d):
    return ranking.weighted_utility(scores(spark, d), "prob", "mic", "known").select("l_orderkey", "l_linenumber", F.round("utility", 9).alias("utility"))


_EDGES_SQL = "e AS (SELECT list_sort(list_distinct(quantile_cont(l_extendedprice, [" + ", ".join(f"{k}/12" for k in range(13)) + "]))) AS all_edges FROM lineitem WHERE l_returnflag = 'R'), cells AS (SELECT l_returnflag, l_orderkey, l_linenumber, len(list_filter(all_edges[:len(all_edges) - 1], lambda v: v < l_extendedprice))::INT AS code FROM lineitem, e)"


@query("SELECT l_returnflag, code, count(*)::BIGINT AS n FROM cells GROUP BY l_returnflag, code", _EDGES_SQL)
def quantile_cells(spark, d):
    rows = table(spark, d, "lineitem")
    edges = rows.where("l_returnflag = 'R'").agg(R.quantile_edges(F.col("l_extendedprice")).alias("edges"))
    coded = rows.crossJoin(F.broadcast(edges)).withColumn("code", R.quantile_code(F.col("l_extendedprice"), F.col("edges")))  # one row of edges
    return coded.groupBy("l_returnflag", "code").agg(F.count("*").alias("n"))


@query("SELECT label, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS weight FROM embeddings GROUP BY label")
def cell_histogram(spark, d):
    return distributions.histogram(table(spark, d, "embeddings"), "label").select("label", "n", r6(F.col("weight")).alias("weight"))


@query(
    "SELECT round(sum(abs(coalesce(a, 0) - coalesce(b, 0))), 6) AS l1 FROM (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) "
    "FULL JOIN (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS b FROM orders GROUP BY 1) USING (o_orderpriority)",
)
def region_l1(spark, d):
    rows = table(spark, d, "orders")
    return distributions.histogram_l1(rows.where("o_orderstatus = 'F'"), rows, "o_orderpriority").select(r6(F.col("l1")).alias("l1"))


@query("SELECT round(sum(w), 6) AS mass FROM (SELECT o_orderpriority, count(*) / sum(count(*)) OVER () AS w FROM orders GROUP BY 1) WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_totalprice > 400000)")
def covered_mass(spark, d):
    rows = table(spark, d, "orders")
    return distributions.covered_mass(rows.where("o_totalprice > 400000"), distributions.histogram(rows, "o_orderpriority"), "o_orderpriority").select(r6(F.col("mass")).alias("mass"))


_STEPS_SQL = (
    "u AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT l_quantity AS v, (l_returnflag = 'A')::INT AS a, (l_returnflag = 'R')::INT AS b FROM lineitem WHERE l_returnflag IN ('A', 'R')) GROUP BY v), "
    "st AS (SELECT v, sum(a) OVER (ORDER BY v) / sum(a) OVER () AS p, sum(b) OVER (ORDER BY v) / sum(b) OVER () AS q, lead(v) OVER (ORDER BY v) - v AS width FROM u), "
    "sc AS (SELECT greatest(stddev_pop(l_quantity), 0.01) AS s FROM lineitem WHERE l_returnflag = 'R')"
)


def _flags(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    return rows.where("l_returnflag = 'A'"), rows.where("l_returnflag = 'R'")


@query("SELECT round(sum(abs(p - q) * width) / any_value(s), 6) AS wasserstein FROM st, sc", _STEPS_SQL)
def wasserstein_by_property(spark, d):
    return distributions.wasserstein(*_flags(spark, d), "l_quantity").select(r6(F.col("wasserstein")).alias("wasserstein"))


@query("SELECT l_quantity, round(sum(count(*)) OVER (ORDER BY l_quantity) / sum(count(*)) OVER (), 6) AS p FROM lineitem GROUP BY l_quantity")
def ecdf(spark, d):
    return ranking.ecdf(table(spark, d, "lineitem"), "l_quantity").select("l_quantity", r6(F.col("p")).alias("p"))


@query("SELECT v, round(sum(coalesce(sign(p - q) * width / s, 0)) OVER (ORDER BY v DESC), 6) AS potential FROM st, sc", _STEPS_SQL)
def cdf_potential(spark, d):
    return distributions.wasserstein_potential(*_flags(spark, d), "l_quantity").select("v", r6(F.col("potential")).alias("potential"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) <= 25")
def quota_topn_per_group(spark, d):
    rows = table(spark, d, "orders").withColumn("quota", F.lit(25))
    return ranking.take_quota(rows, "o_orderpriority", "quota", [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def top_k_stable(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100)


_SHARES_SQL = "g AS (SELECT label, count(*) AS weight FROM embeddings GROUP BY label), sh AS (SELECT label, 100 * weight / sum(weight) OVER () AS share FROM g), fl AS (SELECT *, floor(share + 1e-10) AS f FROM sh)"


@query("SELECT label, (f + (row_number() OVER (ORDER BY round(share - f, 9) DESC, label) <= 100 - sum(f) OVER ())::INT)::BIGINT AS quota FROM fl", _SHARES_SQL)
def largest_remainder_quota(spark, d):
    return allocation.largest_remainder(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("weight")), 100, "label")


@query(
    "SELECT label, (f + (row_number() OVER (ORDER BY round(share - f, 9) DESC, label) <= 120 - sum(f) OVER ())::INT)::BIGINT AS quota FROM (SELECT *, floor(share + 1e-10) AS f FROM wf)",
    "g AS (SELECT label, count(*) AS w, least(count(*), 30) AS cap FROM embeddings GROUP BY label)",
    # the level that fills all strata that overflow at it, and shares the rest by weight
    "lv AS (SELECT label, w, cap, (120 - coalesce(sum(cap) OVER (ORDER BY cap / w, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, label ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM g)",
    "wf AS (SELECT label, least(cap, w * (SELECT level FROM lv WHERE level <= cap / w ORDER BY cap / w, label LIMIT 1)) AS share FROM lv)",
)
def water_fill_quotas(spark, d):
    strata = table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("weight"), F.least(F.count("*"), F.lit(30)).alias("capacity"))
    return allocation.allocate(strata, 120, "label")


@query(
    "SELECT n_nationkey, unnest(range(1, (want - have + 1)::INT))::INT AS copy FROM (SELECT n_nationkey, coalesce(n, 0) AS have, top AS want FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) "
    "ON s_nationkey = n_nationkey, (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM supplier GROUP BY s_nationkey)))",
)
def shortage_templates(spark, d):
    have = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    want = have.agg(F.max("n").alias("desired"))
    strata = table(spark, d, "nation").join(have, "n_nationkey", "left").select("n_nationkey", F.coalesce("n", F.lit(0)).alias("capacity")).crossJoin(F.broadcast(want))  # one row
    return allocation.shortages(strata, "n_nationkey")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 2000)::BIGINT AS batch FROM orders")
def scoring_batches(spark, d):
    return ranking.batches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 2000).select("o_orderkey", "batch")


_VOTES_SQL = (
    "sc AS (SELECT doc_id, unnest([{'model': 'quality', 'family': 'a', 'v': quality::DOUBLE}, {'model': 'toxic', 'family': 'a', 'v': 1 - toxic::DOUBLE}, {'model': 'mic', 'family': 'b', 'v': -log2(1 + n_chars)}], recursive := true) FROM labels JOIN documents USING (doc_id)), "
    f"rk AS (SELECT doc_id, family, (rank() OVER (PARTITION BY model ORDER BY v) + (count(*) OVER (PARTITION BY model, v) - 1) / 2 - 0.5) / count(*) OVER (PARTITION BY model) AS r FROM sc), fm AS (SELECT doc_id, family, avg(r) AS f FROM rk GROUP BY doc_id, family)"
)


@query("SELECT doc_id, round(greatest(0, least(1, avg(f) - 0.25 * stddev_pop(f))), 6) AS vote FROM fm GROUP BY doc_id", _VOTES_SQL)
def model_vote(spark, d):
    rows = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    one = lambda m, f, k, v: F.struct(F.lit(m).alias("model"), F.lit(f).alias("family"), F.lit(k).alias("kind"), v.cast("double").alias("value"))
    long = rows.select(F.col("doc_id").alias("seq"), F.explode(F.array(one("quality", "a", "amp_probability", F.col("quality")), one("toxic", "a", "amp_probability", 1 - F.col("toxic")), one("mic", "b", "mic_um", 1 + F.col("n_chars")))).alias("m")).select("seq", "m.*")
    return ranking.model_votes(long).select(F.col("seq").alias("doc_id"), r6(F.col("vote")).alias("vote"))


_SETTINGS_SQL = "st AS (SELECT p_brand, avg(p_size) / 50 AS a, avg(p_retailprice) / 2000 AS b, count(*) / 1000 AS c FROM part GROUP BY p_brand)"
_GRID = [w for w in ranking.weight_grid(3)]
_REGRET_SQL = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {a!r}::DOUBLE, {b!r}::DOUBLE, {c!r}::DOUBLE)" for k, (a, b, c) in enumerate(_GRID)) + ") AS t(i, x, y, z)), sc AS (SELECT p_brand, i, a * x + b * y + c * z AS s FROM st, w), rg AS (SELECT p_brand, max(top - s) AS regret FROM sc JOIN (SELECT i, max(s) AS top FROM sc GROUP BY i) USING (i) GROUP BY p_brand)"


@query(
    "SELECT p_brand, round(regret, 6) AS regret, NOT EXISTS (SELECT 1 FROM st AS o, st AS m WHERE m.p_brand = rg.p_brand AND o.a >= m.a AND o.b >= m.b AND o.c >= m.c AND (o.a > m.a OR o.b > m.b OR o.c > m.c)) AS pareto FROM rg",
    _SETTINGS_SQL, _REGRET_SQL,
)
def scenario_regret(spark, d):
    settings = table(spark, d, "part").groupBy("p_brand").agg((F.avg("p_size") / 50).alias("a"), (F.avg("p_retailprice") / 2000).alias("b"), (F.count("*") / 1000).alias("c"))
    return ranking.minimax_regret(settings, "p_brand", ["a", "b", "c"], _GRID).select("p_brand", r6(F.col("regret")).alias("regret"), "pareto")


_GUARDS_SQL = "b AS (SELECT avg(prob) AS p, avg(mic) AS m, quantile_cont(mic, 0.9) AS q FROM li WHERE l_returnflag = 'R'), a AS (SELECT l_shipdate::DATE::VARCHAR AS ship_day, avg(prob) AS p, avg(mic) AS m, quantile_cont(mic, 0.9) AS q FROM li GROUP BY 1)"


@query("SELECT ship_day, array_to_string(list_filter([CASE WHEN NOT a.p >= b.p - 0.01 THEN 'prob' END, CASE WHEN NOT a.m <= b.m * 1.03 THEN 'mic_mean' END, CASE WHEN NOT a.q <= b.q * 1.03 THEN 'mic_p90' END], lambda x: x IS NOT NULL), ',') AS failed FROM a, b", "li", _GUARDS_SQL)
def guard_failures(spark, d):
    rows = scores(spark, d)
    stats = [F.avg("prob").alias("p"), F.avg("mic").alias("m"), F.percentile("mic", F.lit(0.9)).alias("q")]
    base = rows.where("l_returnflag = 'R'").agg(*stats).first()
    days = rows.groupBy(F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day")).agg(*stats)
    guards = {"prob": F.col("p") >= base["p"] - 0.01, "mic_mean": F.col("m") <= base["m"] * 1.03, "mic_p90": F.col("q") <= base["q"] * 1.03}
    return selection.failed_guards(days, guards).select("ship_day", joined(F.col("failed")).alias("failed"))


@query("SELECT p_brand, n FROM (SELECT p_brand, count(*)::BIGINT AS n, sum(p_size) AS s FROM part GROUP BY p_brand) ORDER BY n DESC, s DESC, p_brand DESC LIMIT 1")
def lexicographic_winner(spark, d):
    rows = table(spark, d, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum("p_size").alias("s"))
    return selection.winner(rows, "p_brand", [F.col("n"), F.col("s"), F.col("p_brand")]).select("p_brand", "n")


# --- similarity

_LCS_SQL = (
    "mk AS (SELECT seq AS a, aa, sum(1::BIGINT << (k - 1)::BIGINT)::BIGINT AS m FROM x GROUP BY seq, aa), "
    "r(a, b, k, s, m) AS (SELECT a, b, 0, (1::BIGINT << length(a)) - 1, 0::BIGINT FROM pr UNION ALL "
    "SELECT r.a, r.b, r.k + 1, (((s + (s & coalesce(mk.m, 0))) | (s & (~coalesce(mk.m, 0)))) & ((1::BIGINT << length(r.a)) - 1))::BIGINT, 0::BIGINT FROM r LEFT JOIN mk ON mk.a = r.a AND mk.aa = substring(r.b, r.k + 1, 1) WHERE r.k < length(r.b)), "
    "l AS (SELECT a, b, (length(a) - bit_count(s))::INT AS lcs FROM r WHERE k = length(b))"
)
_TO_KNOWN_SQL = "pr AS (SELECT d.seq AS a, q.seq AS b FROM d, (SELECT DISTINCT seq FROM k) AS q)"
_SELF_SQL = "pr AS (SELECT p.seq AS a, q.seq AS b FROM d AS p, d AS q WHERE p.seq < q.seq)"


@query("SELECT a AS seq, round(max(2 * lcs / (length(a) + length(b))), 6) AS similarity FROM l GROUP BY a", "c", "d", "k", _CHARS_SQL, _TO_KNOWN_SQL, _LCS_SQL, recursive=True)
def known_max_similarity(spark, d):
    best = similarity.max_similarity(distinct_candidates(spark, d), known(spark, d))
    return best.select("seq", r6(2 * F.col("best_lcs") / F.col("best_total")).alias("similarity"))


@query("SELECT a, b, lcs FROM l WHERE 5 * lcs >= 2 * (length(a) + length(b))", "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, recursive=True)
def similarity_edges(spark, d):
    return similarity.similarity_edges(distinct_candidates(spark, d))


_BOTH_SQL = "bt AS (SELECT a, b, lcs FROM l UNION ALL SELECT b, a, lcs FROM l), nb AS (SELECT d.seq, count(*) FILTER (5 * lcs > 2 * (length(a) + length(b))) AS n, coalesce(max(2 * lcs / (length(a) + length(b))), 0) AS best FROM d LEFT JOIN bt ON a = seq GROUP BY d.seq)"


@query("SELECT seq, n::BIGINT AS neighbors FROM nb", "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, _BOTH_SQL, recursive=True)
def neighbor_counts(spark, d):
    return similarity.neighbor_counts(distinct_candidates(spark, d))


@query(
    "SELECT count(*)::BIGINT AS n, round(avg((n > 0)::INT), 6) AS near_neighbor_fraction, round(avg(n), 6) AS mean_neighbors, round(quantile_cont(best, 0.5), 6) AS max_similarity_median, round(quantile_cont(1 - best, 0.5), 6) AS nearest_distance_median, "
    "round(quantile_cont(1 - best, 0.1), 6) AS nearest_distance_q10, (sum(n) // 2)::BIGINT AS undirected_edges FROM nb",
    "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, _BOTH_SQL, recursive=True,
)
def neighbor_stats(spark, d):
    out = similarity.neighbor_report(distinct_candidates(spark, d))
    return out.select(*(F.col(c) if c in ("n", "undirected_edges") else r6(F.col(c)).alias(c) for c in out.columns))


_REACH_SQL = "ed AS (SELECT a, b FROM bt WHERE 5 * lcs >= 2 * (length(a) + length(b))), rc(seq, other) AS (SELECT seq, seq FROM d UNION SELECT rc.seq, ed.b FROM rc JOIN ed ON ed.a = rc.other)"


@query("SELECT seq, min(other) AS family FROM rc GROUP BY seq", "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, _BOTH_SQL, _REACH_SQL, recursive=True)
def families(spark, d):
    return similarity.families(distinct_candidates(spark, d))


@query(
    "SELECT round(avg(v), 6) AS known_mean, round(quantile_cont(v, 0.9), 6) AS known_p90, round(avg((v <= 0.8)::INT), 6) AS known_le FROM (SELECT max(2 * lcs / (length(a) + length(b))) AS v FROM l GROUP BY a)",
    "c", "d", "k", _CHARS_SQL, _TO_KNOWN_SQL, _LCS_SQL, recursive=True,
)
def novelty_block(spark, d):
    best = similarity.max_similarity(distinct_candidates(spark, d), known(spark, d)).withColumn("v", 2 * F.col("best_lcs") / F.col("best_total"))
    eligible = 5 * F.col("best_lcs") <= 2 * F.col("best_total")
    return best.agg(r6(F.avg("v")).alias("known_mean"), r6(F.percentile("v", F.lit(0.9))).alias("known_p90"), r6(F.avg(eligible.cast("int"))).alias("known_le"))


@query(
    "SELECT d.seq, round(count(*) FILTER (5 * lcs > 2 * (length(a) + length(b)) AND b IN (SELECT seq FROM sm)) / greatest(1, (SELECT count(*) FROM sm) - (d.seq IN (SELECT seq FROM sm))::INT), 6) AS crowding FROM d LEFT JOIN bt ON a = seq GROUP BY d.seq",
    "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, _BOTH_SQL, "sm AS (SELECT DISTINCT seq FROM c JOIN labels USING (doc_id))", recursive=True,
)
def crowding_fraction(spark, d):
    rows = candidates(spark, d)
    sample = rows.join(table(spark, d, "labels"), "doc_id", "left_semi")
    return similarity.crowding(rows.select("seq").distinct(), sample).select("seq", r6(F.col("crowding")).alias("crowding"))


def ranked_candidates(spark: SparkSession, d: str, held: DataFrame | None = None) -> DataFrame:
    """Distinct sequences with activity stand-ins (labels, text length), similarity to the known set (``held``, where the caller has it), and utility."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.regexp_replace("text", RUNS, "").alias("seq"), F.col("quality").cast("double").alias("prob"), (1 + F.col("n_chars") / 100).alias("mic"), "toxic", "lang")
    rows = rows.where(R.canonical(F.col("seq"))).groupBy("seq").agg(F.avg("prob").alias("prob"), F.min("mic").alias("mic"), F.max("toxic").alias("toxic"), F.min("lang").alias("lang"))
    rows = tables.materialize(rows, "labelled")  # texts are read once, for the search and for the join
    best = similarity.max_similarity(rows, known(spark, d) if held is None else held).withColumn("known", 2 * F.col("best_lcs") / F.col("best_total")).withColumn("eligible", 5 * F.col("best_lcs") <= 2 * F.col("best_total"))
    # The ranks read the table three times: the similarities are computed once.
    return ranking.weighted_utility(tables.materialize(rows.join(best.select("seq", "known", "eligible"), "seq"), "ranked"), "prob", "mic", "known")


_RANKED_SQL = (
    "dl AS (SELECT seq, avg(quality::DOUBLE) AS prob, min(1 + n_chars / 100) AS mic FROM (SELECT regexp_replace(text, '" + LETTERS + "', '', 'g') AS seq, quality, n_chars FROM documents JOIN labels USING (doc_id)) WHERE length(seq) BETWEEN 8 AND 50 GROUP BY seq), "
    "kn AS (SELECT a AS seq, max(2 * lcs / (length(a) + length(b))) AS known, max(5 * lcs - 2 * (length(a) + length(b))) <= 0 AS eligible FROM l GROUP BY a), "
    f"ut AS (SELECT seq, mic, known, eligible, 0.55 * ({_rank_sql('-log2(mic)')}) + 0.45 * ({_rank_sql('prob')}) - 0.05 * ({_rank_sql('known')}) AS utility FROM dl JOIN kn USING (seq))"
)
_KNOWN_SQL = ("c", "d", "k", _CHARS_SQL, _TO_KNOWN_SQL, _LCS_SQL, _RANKED_SQL)
#: Strings in an order (place, seq) that follow one they exclude, each with those; then one after the other: refused, if one of them was not.
_REFUSED_SQL = (
    "nr AS (SELECT b AS seq, list(a) AS near, row_number() OVER (ORDER BY any_value(place)) AS i FROM ex GROUP BY b), "
    "rf(i, gone) AS (SELECT 0, [''] UNION ALL SELECT rf.i + 1, CASE WHEN len(list_filter(near, lambda s: NOT list_contains(gone, s))) > 0 THEN list_append(gone, nr.seq) ELSE gone END FROM rf JOIN nr ON nr.i = rf.i + 1), "
    "go AS (SELECT unnest(arg_max(gone, i)) AS seq FROM rf)"
)
_EXCLUSION_SQL = (
    _RANKED_SQL, "od AS (SELECT seq, row_number() OVER (ORDER BY utility DESC, mic, seq) AS place FROM ut WHERE eligible)",
    "po AS (SELECT p.seq AS a, q.seq AS b, q.place FROM od AS p JOIN od AS q ON p.place < q.place)",
)


@query(
    "SELECT row_number() OVER (ORDER BY place)::INT AS place, seq FROM od WHERE seq NOT IN (SELECT seq FROM go) ORDER BY place LIMIT 25",
    "c", "d", "k", _CHARS_SQL, _TO_KNOWN_SQL, _LCS_SQL, *_EXCLUSION_SQL,
    _LCS_SQL.replace("r(a,", "r2(a,").replace("FROM pr ", "FROM po ").replace("r.", "r2.").replace("FROM r LEFT", "FROM r2 LEFT").replace("FROM r WHERE", "FROM r2 WHERE").replace("l AS (", "l2 AS (").split("), ", 1)[1],
    "ex AS (SELECT a, b, place FROM l2 JOIN po USING (a, b) WHERE 5 * lcs > 2 * (length(a) + length(b)))", _REFUSED_SQL, recursive=True,
)
def top_k_mutual_exclusion(spark, d):
    ranked = ranked_candidates(spark, d).where("eligible")
    taken = similarity.exclusive(ranked, (F.desc("utility"), F.asc("mic"), F.asc("seq")))
    return taken.orderBy("at").limit(25).select(F.row_number().over(Window.orderBy("at")).alias("place"), "seq")  # 25 rows


_GREEDY_SQL = (
    "ex AS (SELECT a, b, lcs, b AS place FROM l WHERE 5 * lcs >= 2 * (length(a) + length(b)))", _REFUSED_SQL,
    "gc AS (SELECT seq, seq AS representative FROM d WHERE seq NOT IN (SELECT seq FROM go) UNION ALL SELECT b, first(a ORDER BY 2 * lcs / (length(a) + length(b)) DESC, a) FROM ex WHERE b IN (SELECT seq FROM go) AND a NOT IN (SELECT seq FROM go) GROUP BY b)",
)


@query("SELECT seq, representative FROM gc", "c", "d", _CHARS_SQL, _SELF_SQL, _LCS_SQL, *_GREEDY_SQL, recursive=True)
def greedy_clusters(spark, d):
    return similarity.greedy_clusters(distinct_candidates(spark, d))


@query()
def family_split(spark, d):
    rows = candidates(spark, d).join(table(spark, d, "labels"), "doc_id").groupBy("seq").agg(F.max("quality").alias("label"))
    return allocation.split_families(rows.join(similarity.families(rows), "seq"), {"train": 0.8, "dev": 0.1, "audit": 0.1})


# --- embeddings


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return rows.where("label % 2 = 0"), rows.where("label % 2 = 1")


_PAIRS_SQL = "ev AS (SELECT vec_id AS i, label % 2 AS h, embedding::DOUBLE[] AS e FROM embeddings), ds AS (SELECT p.i AS i, q.i AS j, p.h AS g, q.h AS h, pow(list_distance(p.e, q.e), 2) AS dd FROM ev AS p, ev AS q WHERE p.i <> q.i)"
_SIZES_SQL = "nn AS (SELECT count(*) FILTER (h = 0) AS n, count(*) FILTER (h = 1) AS m FROM ev)"


@query(
    "SELECT round(sum(CASE WHEN g = 0 AND h = 0 THEN exp(-dd / 2) END) / any_value(n * (n - 1)) + sum(CASE WHEN g = 1 AND h = 1 THEN exp(-dd / 2) END) / any_value(m * (m - 1)) - 2 * sum(CASE WHEN g = 0 AND h = 1 THEN exp(-dd / 2) END) / any_value(n * m), 6) AS mmd2 FROM ds, nn",
    _PAIRS_SQL, _SIZES_SQL,
)
def mmd_unbiased(spark, d):
    return spark.createDataFrame([(round(distributions.mmd_unbiased(*_halves(spark, d), 1.0), 6),)], "mmd2 double")


@query("SELECT round(quantile_cont(dd, 0.5), 6) AS bandwidth FROM ds WHERE i < j AND dd > 0 AND i IN (SELECT i FROM ft) AND j IN (SELECT i FROM ft)", _PAIRS_SQL, "ft AS (SELECT i FROM ev ORDER BY i LIMIT 512)")
def bandwidth_median(spark, d):
    a, b = _halves(spark, d)
    return spark.createDataFrame([(round(distributions.median_squared_distance(a.union(b)), 6),)], "bandwidth double")


@query(
    "SELECT round((SELECT avg(ok) FROM (SELECT ds.i, max((dd <= r2)::INT) AS ok FROM ds JOIN kn ON kn.i = ds.j WHERE g = 0 AND ds.h = 1 GROUP BY ds.i)), 6) AS precision, "
    "round((SELECT avg(ok) FROM (SELECT ds.i, max((dd <= r2)::INT) AS ok FROM ds JOIN kn ON kn.i = ds.j WHERE g = 1 AND ds.h = 0 GROUP BY ds.i)), 6) AS recall",
    _PAIRS_SQL, "kn AS (SELECT i, h, dd AS r2 FROM ds WHERE g = h QUALIFY row_number() OVER (PARTITION BY i ORDER BY dd) = 3)",
)
def knn_precision_recall(spark, d):
    p, r = distributions.precision_recall(*_halves(spark, d))
    return spark.createDataFrame([(p, r)], "precision double, recall double").select(r6(F.col("precision")).alias("precision"), r6(F.col("recall")).alias("recall"))


@query()
def fbd(spark, d):
    a, b = _halves(spark, d)
    return spark.createDataFrame([(distributions.frechet_distance(a, b),)], "fbd double")


@query(
    "SELECT (p - 1)::INT AS row_index, (q - 1)::INT AS column_index, round(covar_samp(e[p], e[q]), 6) + 0 AS covariance FROM (SELECT embedding::DOUBLE[] AS e FROM embeddings), (SELECT unnest(range(1, 65)) AS p), (SELECT unnest(range(1, 65)) AS q) GROUP BY p, q"
)
def covariance(spark, d):
    m = distributions.moments(table(spark, d, "embeddings")).covariance
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(m)], "row_index int, column_index int, covariance double").withColumn("covariance", r6(F.col("covariance")) + 0.0)


@query()
def kmeans_regions(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    (pc,) = learn.principal_components(rows, [rows])
    (placed,), _ = learn.regions(pc, [pc])
    return placed.select("vec_id", "region")


@query()
def property_regions(spark, d):
    """Regions of the candidates on their properties, each scaled to the known collection's mean and deviation."""
    props = lambda df: df.select("seq", *(c.alias(k) for k, c in R.properties(F.col("seq")).items()))
    # Scaling, fit and placing read both tables several times: texts are read once.
    rows, ref = (tables.materialize(props(x), "properties") for x in (distinct_candidates(spark, d), known(spark, d).select("seq").distinct()))
    scaled_rows, scaled_ref = learn.scaled_properties(rows, ref), learn.scaled_properties(ref, ref)
    (placed,), weights = learn.regions(scaled_ref, [scaled_rows], most=24)
    return placed.join(weights, "region").select("seq", "region", r6(F.col("weight")).alias("weight"))


@query()
def embedding_moments(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    (pc,) = learn.principal_components(rows, [rows], k=4)
    return learn.moment_features(pc).select("vec_id", joined(F.transform("moments", lambda x: r6(x) + 0.0)).alias("moments"))


@query()
def fbd_direction(spark, d):
    a, b = _halves(spark, d)
    slope = Slope.between(distributions.moments(a), distributions.moments(b))

    @F.pandas_udf("double")
    def score(x):
        import pandas as pd

        return pd.Series(slope(np.array(x.tolist(), float))) if len(x) else pd.Series([], dtype=float)

    return a.select("id", score("embedding").alias("score"))


def _bounded(df: DataFrame, n: int = 512) -> np.ndarray:
    """A bounded hash-ordered sample of vectors, for fits that the definition bounds itself."""
    return np.array([r[0] for r in ranking.hash_sample(df, "id", n).select("embedding").collect()], float)


@query()
def random_fourier_features(spark, d):
    a, b = _halves(spark, d)
    return learn.random_features(a, RandomFeatures.fit(_bounded(b), 42)).select("id", joined(F.transform("rff", lambda x: r6(x) + 0.0)).alias("rff"))


@query()
def mmd_random(spark, d):
    a, b = _halves(spark, d)
    return spark.createDataFrame([(distributions.mmd_random(a, b),)], "mmd2 double")


@query()
def conformity_scores(spark, d):
    rows = distinct_candidates(spark, d).select("seq", *(c.alias(k) for k, c in R.properties(F.col("seq")).items()))
    names = ["length", "charge", "hydrophobicity", "moment"]
    return learn.conformity_scores(rows, rows, names).select("seq", "conformity")


@query(
    "SELECT vec_id, arg_min(code, list_distance(embedding::DOUBLE[], v)) AS code FROM embeddings, (SELECT label AS code, list(m ORDER BY k) AS v FROM (SELECT label, k, avg(embedding[k]::DOUBLE) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY label, k) GROUP BY label) GROUP BY vec_id",
)
def nearest_code(spark, d):
    rows = table(spark, d, "embeddings")
    each = rows.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("m"))
    codes = each.groupBy(F.col("label").alias("code")).agg(F.array_sort(F.collect_list(F.struct("k", "m")))["m"].alias("vector"))
    return learn.nearest_code(rows, codes).select("vec_id", "code")


# --- bundles and further measures


@query("SELECT round(avg(abs(l_quantity - 25) / 10), 6) AS l_quantity, round(avg(abs(l_discount - l_tax) / 0.05), 6) AS l_discount FROM lineitem")
def property_mae(spark, d):
    rows = table(spark, d, "lineitem").withColumn("goal", F.lit(25.0))
    out = reports.normalized_mae(rows, ["l_quantity", "l_discount"], ["goal", "l_tax"], [10, 0.05])
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@query("SELECT o_orderpriority, round(sum(o_totalprice * n) / sum(n), 4) AS mean_price FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def weighted_means(spark, d):
    counts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders").join(counts, "o_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.round(reports.weighted_mean(F.col("o_totalprice"), F.col("n")), 4).alias("mean_price"))


@query("SELECT l_orderkey, l_linenumber, round(0.65 * l_quantity + 0.35 * m, 9) AS shrunk FROM lineitem, (SELECT avg(l_quantity) AS m FROM lineitem)")
def condition_shrink(spark, d):
    rows = table(spark, d, "lineitem")
    mean = rows.agg(F.avg("l_quantity").alias("m"))
    return rows.crossJoin(F.broadcast(mean)).select("l_orderkey", "l_linenumber", F.round(R.shrink(F.col("l_quantity"), F.col("m"), 0.35), 9).alias("shrunk"))  # one row


@query("SELECT l_orderkey, l_linenumber, array_to_string(list_transform(t, lambda v: (l_quantity <= v)::INT), '') AS features FROM lineitem, (SELECT quantile_cont(l_quantity, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t FROM lineitem WHERE l_returnflag = 'R')")
def threshold_features(spark, d):
    rows = table(spark, d, "lineitem")
    cuts = rows.where("l_returnflag = 'R'").agg(F.percentile("l_quantity", F.array(*(F.lit(k / 10) for k in range(1, 10)))).alias("t"))
    coded = rows.crossJoin(F.broadcast(cuts))  # one row
    return coded.select("l_orderkey", "l_linenumber", F.array_join(R.threshold_features(F.col("l_quantity"), F.col("t")).cast("array<string>"), "").alias("features"))


_FILL_SQL = "q AS (SELECT label, least(count(*), 8 + label) AS quota, count(*) AS have FROM embeddings GROUP BY label), rk AS (SELECT vec_id, label, quota, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings JOIN q USING (label))"


@query("SELECT vec_id, label FROM rk WHERE place <= quota UNION ALL SELECT vec_id, label FROM (SELECT vec_id, label FROM rk WHERE place > quota ORDER BY vec_id LIMIT greatest(0, 150 - (SELECT count(*) FROM rk WHERE place <= quota)))", _FILL_SQL)
def quota_selection_backfill(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", "label")
    quotas = rows.groupBy("label").agg(F.least(F.count("*"), F.col("label") + 8).alias("quota"))
    return allocation.quota_selection(rows, 150, "label", quotas, [F.asc("vec_id")]).select("vec_id", "label")


_WINDOWS_SQL = "wn AS (SELECT x.seq, st.k AS start, least(11, length(x.seq)) AS width, sum(v * cos((x.k - st.k) * radians(100))) AS a, sum(v * sin((x.k - st.k) * radians(100))) AS b FROM x JOIN h USING (aa) JOIN x AS st ON st.seq = x.seq AND st.k <= length(x.seq) - least(11, length(x.seq)) + 1 AND x.k BETWEEN st.k AND st.k + least(11, length(x.seq)) - 1 GROUP BY x.seq, st.k)"


@query("SELECT seq, round(avg(sqrt(a * a + b * b) / width), 6) AS moment FROM wn GROUP BY seq", "c", "d", _SCALE_SQL, _CHARS_SQL, _WINDOWS_SQL)
def windowed_moments(spark, d):
    return distinct_candidates(spark, d).select("seq", r6(R.windowed_moment(F.col("seq"))).alias("moment"))


@query()
def sequence_metrics(spark, d):
    return reports.sequence_metrics(candidates(spark, d), known(spark, d))


@query()
def pair_diversity(spark, d):
    return reports.pair_diversity(distinct_candidates(spark, d))


@query()
def embedding_metrics(spark, d):
    out = reports.embedding_metrics(*_halves(spark, d), 1000, (1, 2, 3))
    return spark.createDataFrame([(k, float(m), float(s)) for k, (m, s) in out.items()], "metric string, mean double, deviation double")


@query()
def reference_floor(spark, d):
    out = reports.reference_floor(_halves(spark, d)[0], (1, 2, 3))
    return spark.createDataFrame([(k, float(m), float(s)) for k, (m, s) in out.items()], "metric string, mean double, deviation double")


_PROPERTIES_SQL = (
    f"pp AS (SELECT seq, length(seq)::DOUBLE AS p1, 1 / (1 + pow(10, 7 - 8.0)) - 1 / (1 + pow(10, 3.1 - 7)) + {_counts_sql(_CHARGES)} AS p2, ({_counts_sql(R.EISENBERG)}) / length(seq) AS p3 FROM d), "
    "pm AS (SELECT seq, sqrt(pow(sum(v * cos((k - 1) * radians(100))), 2) + pow(sum(v * sin((k - 1) * radians(100))), 2)) / length(seq) AS p4 FROM x JOIN h USING (aa) GROUP BY seq)"
)
_Z_SQL = ", ".join(f"round((p{k} - avg(p{k}) OVER ()) / greatest(stddev_pop(p{k}) OVER (), 0.01), 6) + 0 AS {name}" for k, name in enumerate(("z_length", "z_charge", "z_hydrophobicity", "z_moment"), 1))


@query(
    f"SELECT seq, array_to_string(list_concat(list_transform(string_split(seq, ''), lambda a: strpos('{R.ALPHABET}', a) - 1), list_transform(range(length(seq), 50), lambda a: {R.PAD})), ',') AS tokens, length(seq)::INT AS length, {_Z_SQL} FROM pp JOIN pm USING (seq)",
    "c", "d", _SCALE_SQL, _CHARS_SQL, _PROPERTIES_SQL,
)
def training_rows(spark, d):
    rows = distinct_candidates(spark, d)
    props = R.properties(F.col("seq"))
    stats = rows.select(*(c.alias(k) for k, c in props.items())).agg(*(F.avg(k).alias(f"m_{k}") for k in props), *(F.stddev_pop(k).alias(f"s_{k}") for k in props)).first()
    out = learn.training_rows(rows, {k: stats[f"m_{k}"] for k in props}, {k: stats[f"s_{k}"] for k in props})
    return out.select("seq", joined(F.col("tokens")).alias("tokens"), "length", *((r6(F.col("conditions")[k]) + 0.0).alias(f"z_{name}") for k, name in enumerate(props)))


@query()
def proxy_classifier(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), (F.col("label") % 2).alias("label"))
    fitted, audit = ranking.hash_halves(rows, "vec_id")
    out = learn.proxy_classifier(fitted, audit=audit)
    return spark.createDataFrame(sorted((out[1] if out else {}).items()), "metric string, value double")


# --- alignments, validation, selection


_ALN_SQL = (
    "al AS (SELECT l_orderkey AS query, l_partkey AS target, l_extendedprice / 100 AS bits, l_quantity AS raw, l_linenumber AS nident, least(7, l_linenumber + (l_suppkey % 3))::INT AS alnlen, 1 AS qstart, (5 + l_linenumber)::INT AS qend, 12 AS qlen, 1 AS tstart, (4 + l_linenumber)::INT AS tend, 12 AS tlen FROM lineitem)"
)


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr(
        "l_orderkey AS query", "l_partkey AS target", "l_extendedprice / 100 AS bits", "l_quantity AS raw", "l_linenumber AS nident", "cast(least(7, l_linenumber + l_suppkey % 3) as int) AS alnlen",
        "1 AS qstart", "5 + l_linenumber AS qend", "12 AS qlen", "1 AS tstart", "4 + l_linenumber AS tend", "12 AS tlen",
    )


@query("SELECT query, count(*)::BIGINT AS n, count(*) FILTER (5 * nident > 4 * alnlen)::BIGINT AS high_identity, count(*) FILTER (5 * nident > 4 * alnlen AND 5 * (qend - qstart + 1) >= 4 * qlen)::BIGINT AS covered, max(bits) AS best_bits FROM al GROUP BY query", _ALN_SQL)
def alignment_summary_merge(spark, d):
    out = sets.alignment_summary(sets.alignment_columns(_alignments(spark, d)))
    return out.select("query", F.col("rows").alias("n"), "high_identity", F.col("high_identity_covered").alias("covered"), F.col("best.bits").alias("best_bits"))


@query("SELECT query, target, nident, alnlen, 5 * nident > 4 * alnlen AS gate, nident <= alnlen AS valid FROM al", _ALN_SQL)
def identity_gate(spark, d):
    rows = sets.alignment_columns(_alignments(spark, d))
    return rows.select("query", "target", "nident", "alnlen", R.identity_gate(F.col("nident"), F.col("alnlen")).alias("gate"), "valid")


@query("SELECT o_orderkey AS query, round(greatest(0, least(1, coalesce(max(l_extendedprice), 0) / any_value(o_totalprice))), 6) AS similarity FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def bits_novelty(spark, d):
    own = table(spark, d, "orders").selectExpr("o_orderkey AS query", "o_totalprice AS bits")
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey AS query", "l_extendedprice AS bits").join(own.select("query"), "query", "left_semi")
    return sets.best_bits(rows, own).select("query", r6(F.col("similarity")).alias("similarity"))


@query()
def local_alignments(spark, d):
    return align.align_all(distinct_candidates(spark, d), known(spark, d))


_MERS_SQL = "(SELECT seq, substr(seq, k::INT, 6) AS kmer, k FROM (SELECT seq, unnest(range(1, length(seq) - 4)) AS k FROM {}))"


@query(
    f"SELECT query, target, max(hits)::BIGINT AS hits FROM (SELECT a.seq AS query, b.seq AS target, floor((a.k - b.k) / 8) AS band, count(*) AS hits FROM {_MERS_SQL.format('d')} AS a JOIN {_MERS_SQL.format('(SELECT DISTINCT seq FROM k)')} AS b USING (kmer) GROUP BY ALL) GROUP BY query, target HAVING max(hits) >= 2",
    "c", "d", "k",
)
def seed_candidates(spark, d):
    """Pairs of a candidate and a known sequence with two common 6-mers near one diagonal."""
    return align.seed_pairs(distinct_candidates(spark, d), known(spark, d), k=6, least_hits=2)


@query()
def seeded_alignments(spark, d):
    rows = align.align_seeded(distinct_candidates(spark, d), known(spark, d), k=6, least_hits=2)
    rows = align.with_evalues(align.with_bits(rows), known(spark, d))
    return rows.select(*align.NAMES, r6(F.col("bits")).alias("bits"), "evalue")


@query(
    "SELECT doc_id AS record, unnest(list_filter([CASE WHEN seq = '' THEN 'empty sequence' END, CASE WHEN length(seq) < 8 AND seq <> '' THEN 'too short' END, CASE WHEN length(seq) > 50 THEN 'too long' END, CASE WHEN n > 1 AND seq <> '' THEN 'duplicate' END], lambda e: e IS NOT NULL)) AS error "
    f"FROM (SELECT doc_id, seq, count(*) OVER (PARTITION BY seq) AS n FROM (SELECT doc_id, regexp_replace(text, '{LETTERS}', '', 'g') AS seq FROM documents))"
)
def library_errors(spark, d):
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("record"), F.col("doc_id").cast("string").alias("header"), F.regexp_replace("text", RUNS, "").alias("seq"))
    return validate.library_errors(rows)


@query("SELECT doc_id AS record, 'not in library' AS error FROM c WHERE seq NOT IN (SELECT seq FROM k) UNION ALL SELECT doc_id, 'duplicate' FROM (SELECT doc_id, count(*) OVER (PARTITION BY seq) AS n FROM c) WHERE n > 1", "c", "k")
def ranked_list_errors(spark, d):
    top = candidates(spark, d).withColumnRenamed("doc_id", "record")
    return validate.ranked_list_errors(top, known(spark, d), top.count())


@query("SELECT a, b, lcs FROM l WHERE 5 * lcs > 2 * (length(a) + length(b))", "c", "d", "k", _CHARS_SQL, _TO_KNOWN_SQL, _LCS_SQL, recursive=True)
def too_similar(spark, d):
    return validate.too_similar(distinct_candidates(spark, d), known(spark, d))


MOST_REGIONS = 64


def _selection(spark: SparkSession, d: str) -> tuple[selection.Candidates, np.ndarray, np.ndarray, Gaussian, np.ndarray]:
    """Candidates with properties as vectors, regions by language (the MOST_REGIONS most frequent), and the reference statistics of all known sequences."""
    names = [r[0] for r in table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_REGIONS).collect() if r[0] is not None]
    langs = {x: k for k, x in enumerate(sorted(names))}
    # Languages beyond the most frequent ones, and none, share the last region.
    region = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in langs.items() for x in kv)), F.col("lang")), F.lit(len(langs))) if langs else F.lit(0)
    props = R.properties(F.col("seq"))
    held = tables.materialize(known(spark, d).select("seq").distinct(), "known")  # texts are read once, for the search and for the reference
    rows = ranked_candidates(spark, d, held).select("seq", "prob", "mic", "known", "utility", region.alias("region"), F.array(*props.values()).alias("props"))
    c = selection.candidate_table(rows.withColumn("embedding", F.col("props")))
    reference = held.where(F.length("seq") >= 2).select("seq", *(v.alias(k) for k, v in props.items()))
    reference = selection.gathered(reference, "seq", selection.MOST_CANDIDATES, f"more than {selection.MOST_CANDIDATES} known sequences for a selection")
    rp = np.column_stack([reference[k].to_numpy().astype(float) for k in props])
    weights = np.bincount(c.region, minlength=len(langs) + 1) / len(c.seq)
    n = max(4, len(c.seq) // 4)
    return c, rp, selection.quota_start(c, selection.region_quotas(c, n, weights)), Gaussian.of(rp), weights


def _features(c: selection.Candidates, rp: np.ndarray) -> tuple[selection.Features, selection.Guards]:
    fit = RandomFeatures.fit(rp, 42)
    cuts = [np.quantile(rp[:, j], np.linspace(0.005, 0.995, 33)) for j in range(rp.shape[1])]
    n = len(fit.phases)
    edges = [0, n, *(n + 33 * (j + 1) for j in range(len(cuts)))]
    target = selection.mean_of(selection.Features(rp, fit, cuts), np.arange(len(rp)))
    return selection.Features(c.props, fit, cuts), selection.Guards([slice(a, b) for a, b in zip(edges[:-1], edges[1:])], target)


def _degrees(spark: SparkSession) -> Callable[[list[str]], np.ndarray]:
    """Counts of similar strings inside a selection, by the fuzzy join."""

    def count(seqs: list[str]) -> np.ndarray:
        found = similarity.neighbor_counts(spark.createDataFrame([(s,) for s in seqs], "seq string")).toArrow()
        numbers = dict(zip(found["seq"].to_pylist(), found["neighbors"].to_pylist()))
        return np.array([numbers[s] for s in seqs], np.int64)

    return count


def _chosen(spark: SparkSession, c: selection.Candidates, ids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(c.seq[i], float(c.mic[i]), int(c.region[i])) for i in sorted(ids.tolist())], "seq string, mic double, region int")


@query()
def coverage_swaps(spark, d):
    c, rp, start, _, _ = _selection(spark, d)
    features, guards = _features(c, rp)
    return _chosen(spark, c, selection.coverage_swaps(c, start, features, guards.target)[0])


@query()
def guarded_swap(spark, d):
    c, rp, start, _, _ = _selection(spark, d)
    features, guards = _features(c, rp)
    return _chosen(spark, c, selection.guarded_swaps(c, start, features, guards)[0])


@query()
def neighbor_repair(spark, d):
    c, rp, start, _, _ = _selection(spark, d)
    features, guards = _features(c, rp)
    chosen, _, _ = selection.guarded_swaps(c, start, features, guards)
    return _chosen(spark, c, selection.repair_neighbors(c, chosen, features, guards, float(c.mic[start].sum()) * 1.05, degrees=_degrees(spark))[0])


@query()
def zero_edge_repair(spark, d):
    c, _, start, _, _ = _selection(spark, d)
    return _chosen(spark, c, selection.repair_zero_edge(c, start, np.argsort(-c.utility, kind="stable"), degrees=_degrees(spark))[0])


@query()
def exchange_refine(spark, d):
    c, rp, start, reference, weights = _selection(spark, d)
    limits = selection.limits_of(selection.selection_metrics(c, start, rp, reference, weights))
    limits = {k: 0.9 * v for k, v in limits.items()}
    return _chosen(spark, c, selection.exchange(c, start, rp, reference, weights, limits, 0.0, paired=True, epochs=60)[0])


@query()
def lp_cells(spark, d):
    c, rp, start, _, weights = _selection(spark, d)
    hit = c.mic <= 16
    edges = [np.unique(np.quantile(rp[:, j], np.linspace(0, 1, 13)))[:-1] for j in range(rp.shape[1])]
    codes = np.column_stack([c.region, *(np.searchsorted(e, c.props[:, j], side="left") for j, e in enumerate(edges))])
    features = [(c.region == r).astype(float) for r in range(len(weights))] + [(c.props[:, j] <= t).astype(float) for j, e in enumerate(edges) for t in e]
    target = np.concatenate([weights, *((rp[:, j, None] <= e).mean(axis=0) for j, e in enumerate(edges))])
    scale = np.concatenate([np.ones(len(weights)), *(np.diff(np.append(e, rp[:, j].max())) / max(rp[:, j].std(), 0.01) for j, e in enumerate(edges))])
    ids, _ = selection.allocate_cells(c, codes, hit, c.utility, len(start), np.array(features), target, scale)
    return _chosen(spark, c, ids)


@query("SELECT DISTINCT user_id FROM events")
def stream_dedupe_batches(spark, d):
    """The events table as a stream of files, each user once; runs all available batches into a table and reads it."""
    import uuid

    from ..operators.tables import shared_dir
    from ..streaming.incremental import first_seen, score_into

    base = f"{shared_dir(spark)}/stream/{uuid.uuid4().hex}"
    rows = table(spark, d, "events")
    rows.write.parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
    score_into(first_seen(stream.select("user_id"), "user_id"), lambda b: b, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").select("user_id")


@query("SELECT seq, round(utility, 6) AS utility, round(known, 6) AS known, mic FROM ut WHERE eligible ORDER BY ut.utility DESC, mic, seq LIMIT 100", *_KNOWN_SQL, recursive=True)
def flagship_top100(spark, sf_dir):
    return flagship(spark, sf_dir)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank the distinct sequences that are not too similar to the known set by weighted utility; the top 100."""
    ranked = ranked_candidates(spark, sf_dir).where("eligible")
    return ranked.select("seq", r6(F.col("utility")).alias("utility"), r6(F.col("known")).alias("known"), "mic").orderBy(F.desc("utility"), "mic", "seq").limit(100)

