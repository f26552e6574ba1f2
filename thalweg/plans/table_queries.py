"""Queries over the other test tables: evaluation metrics, lookups, strings, splits, lines, patches, models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import cnn, labels, ml, network, pairs, raster, sampling, stats
from ..plans.materialize import materialize
from ..sources.basins import with_config
from ..sources.terrain import terrain
from .terrain_queries import KEYS, Pairs, _r, _rounded

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- classification metrics: y is a line's return flag, score a mix of its price and quantity

_SCORED = "scored AS (SELECT l_linestatus AS grp, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round((l_quantity * 13 + l_linenumber * 29 + CASE WHEN l_returnflag = 'R' THEN 90 ELSE 0 END) % 500 / 500, 3) AS score FROM lineitem)"


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("l_returnflag") == "R"
    mixed = (F.col("l_quantity") * 13 + F.col("l_linenumber") * 29 + F.when(hit, 90).otherwise(0)) % 500 / 500
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linestatus", "l_returnflag", "l_quantity", "l_linenumber")
    return rows.select(F.col("l_linestatus").alias("grp"), hit.cast("int").alias("y"), F.round(mixed, 3).alias("score"))


_COUNTS = "count(*) FILTER (score >= 0.5 AND y = 1) AS tp, count(*) FILTER (score >= 0.5 AND y = 0) AS fp, count(*) FILTER (score < 0.5 AND y = 1) AS fn, count(*) FILTER (score < 0.5 AND y = 0) AS tn"


@query(f"WITH {_SCORED}, n AS (SELECT grp, {_COUNTS} FROM scored GROUP BY 1) SELECT grp, tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM n")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.confusion(_scored(spark, sf_dir), 0.5, ["grp"]))


@query(f"WITH {_SCORED}, ranked AS (SELECT grp, y, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2 AS r FROM scored) SELECT grp, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2) / nullif(count(*) FILTER (y = 1) * count(*) FILTER (y = 0), 0), 6) AS auc FROM ranked GROUP BY 1")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.roc_auc(_scored(spark, sf_dir), ["grp"]))


_CURVE = _SCORED + ", c AS (SELECT score, sum(y) AS p, count(*) - sum(y) AS q FROM scored GROUP BY 1), curve AS (SELECT score, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(q) OVER w AS BIGINT) AS fp, sum(p) OVER w / sum(p) OVER () AS tpr, sum(q) OVER w / sum(q) OVER () AS fpr, sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w) AS precision FROM c WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"


@query(f"WITH {_CURVE} SELECT score, tp, fp, {_r('tpr', 'fpr', 'precision')}, round(tpr, 6) AS recall FROM curve")
def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.curve(_scored(spark, sf_dir)))


@query(f"WITH {_CURVE} SELECT round(sum((tpr - prev) * precision), 6) AS average_precision FROM (SELECT *, coalesce(lag(tpr) OVER (ORDER BY score DESC), 0) AS prev FROM curve)")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.average_precision(_scored(spark, sf_dir)))


@query(f"WITH {_CURVE} SELECT score AS threshold, round(precision, 6) AS precision, round(tpr, 6) AS recall FROM curve WHERE tpr >= 0.5 ORDER BY curve.precision DESC, score DESC LIMIT 1")
def precision_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.best_threshold(_scored(spark, sf_dir)))


@query(f"WITH {_CURVE} SELECT round(max(abs(tpr - fpr)), 6) AS ks, max(tp) AS n1, max(fp) AS n0 FROM curve")
def ks_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.ks_two_sample(_scored(spark, sf_dir)).drop("p_value"))


@query("SELECT p AS spot, round(sum(exp(-0.5 * pow((l_quantity - p) / 4.0, 2))) / (count(*) * 4.0 * sqrt(2 * pi())), 6) AS density FROM lineitem CROSS JOIN (VALUES (5.0::DOUBLE), (25.0), (45.0)) t(p) GROUP BY 1")
def quantity_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_quantity")
    return _rounded(stats.kernel_density(rows, "l_quantity", [5.0, 25.0, 45.0], 4.0).withColumnRenamed("at", "spot"))


# -- lookups, strings, sets

_CONFIG = "cfg(name, lat, z_th, delta_L) AS (VALUES ('taiwan', 23.47, 80.0, 1.16), ('yoro', 35.28, 130.0, 1.38), ('inyo', 36.71, 1200.0, 0.17), ('clanalpine', 39.69, 1700.0, 0.27))"


@query(f"WITH {_CONFIG} SELECT n_nationkey, local, CAST(lat AS DOUBLE) AS lat, CAST(z_th AS DOUBLE) AS z_th, CAST(delta_L AS DOUBLE) AS delta_L FROM (SELECT n_nationkey, ['Taiwan', 'YORO', 'inyo', 'CalnAlpine', 'nowhere'][n_nationkey % 5 + 1] AS local FROM nation) LEFT JOIN cfg ON name = CASE lower(local) WHEN 'calnalpine' THEN 'clanalpine' ELSE lower(local) END")
def basin_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("Taiwan", "YORO", "inyo", "CalnAlpine", "nowhere")))
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", F.get(names, F.col("n_nationkey") % 5).alias("local"))
    return with_config(rows, "local").select("n_nationkey", "local", "lat", "z_th", "delta_L")


@query("SELECT flag, count(*) AS n FROM (SELECT unnest(string_split(lower(p_type), ' ')) AS flag FROM part) WHERE flag <> '' GROUP BY 1")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.explode(F.split(F.lower("p_type"), " ")).alias("flag"))
    return rows.filter("flag <> ''").groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderpriority, o_orderstatus, concat_ws('__', o_orderpriority, o_orderstatus) AS key, count(*) AS n, count(DISTINCT o_custkey) AS n_customers FROM orders GROUP BY 1, 2")
def grouped_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderpriority", "o_orderstatus", "o_custkey")
    return rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_customers")).withColumn("key", F.concat_ws("__", "o_orderpriority", "o_orderstatus"))


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders")
def remaining_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal > 0").select("c_custkey")
    return work.join(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").distinct()


@query("SELECT c_nationkey, CAST(fold AS INT) AS fold, n FROM (SELECT c_nationkey, n, CASE WHEN k % 10 < 5 THEN k % 10 ELSE 9 - k % 10 END AS fold FROM (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_nationkey) - 1 AS k FROM customer GROUP BY 1))")
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_nationkey")
    return sampling.group_folds(rows, "c_nationkey").groupBy("c_nationkey", "fold").agg(F.count(F.lit(1)).alias("n"))


def _hash(*columns: str) -> str:
    """What sampling.hashed computes with its default seed."""
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns)
    return f"CAST('0x' || substr(md5(concat_ws('|', 42, {text})), 1, 12) AS BIGINT)"


@query(f"SELECT c_mktsegment, c_nationkey, {_hash('c_mktsegment', 'c_nationkey')} % 1000000 < 200000 AS is_test, count(*) AS n FROM customer GROUP BY 1, 2, 3")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_nationkey")
    return sampling.group_split(rows, ["c_mktsegment", "c_nationkey"]).groupBy("c_mktsegment", "c_nationkey", "is_test").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_mktsegment, CAST({_hash('c_mktsegment', 'c_custkey')} % 5 AS INT) AS fold, count(*) AS n FROM customer GROUP BY 1, 2")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_mktsegment", "c_custkey")
    return sampling.stratified_folds(rows, "c_mktsegment", ["c_custkey"]).groupBy("c_mktsegment", "fold").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT c_custkey, {_hash('c_custkey')} % 1000000 < 150000 AS is_validation FROM customer")
def permutation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey")
    return sampling.permutation_split(rows, ["c_custkey"], 0.15)


@query(f"SELECT c_custkey FROM customer ORDER BY {_hash('c_custkey')}, c_custkey LIMIT 100")
def sample_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rows(spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), 100, ["c_custkey"])


@query("SELECT o_orderstatus, o_orderstatus = 'F' AS held_out, count(*) AS n FROM orders GROUP BY 1, 2")
def held_out_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest, held = sampling.hold_out(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderstatus"), "o_orderstatus", "F")
    both = rest.withColumn("held_out", F.lit(False)).union(held.withColumn("held_out", F.lit(True)))
    return both.groupBy("o_orderstatus", "held_out").agg(F.count(F.lit(1)).alias("n"))


# -- a deep tree with a closed form: part k drains to k // 2


_TREE = "SELECT p_partkey AS k FROM part WHERE p_partkey >= 1"


@query(f"WITH RECURSIVE t AS ({_TREE}), up(k, seed) AS (SELECT k, k FROM t UNION ALL SELECT k, seed // 2 FROM up WHERE seed > 1) SELECT seed, count(*) AS n FROM up JOIN t s ON s.k = seed GROUP BY 1")
def tree_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, flow = _tree(spark, sf_dir)
    return network.contributing_area(cells, flow).select(F.col("cell_id").alias("seed"), F.col("area").alias("n"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey >= 1").select(F.lit("t").alias("basin"), F.col("p_partkey").alias("cell_id"))
    k = materialize(k)
    return k, k.filter("cell_id > 1").select("basin", "cell_id", F.floor(F.col("cell_id") / 2).cast("long").alias("down_id"))


# -- lines


@query("""SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(r * 31 + c) AS BIGINT) AS checksum FROM (
  SELECT l_orderkey, l_linenumber, r0 + sign(r1 - r0) * CASE WHEN by_row THEN i WHEN m = 0 THEN 0 ELSE (2 * k * i + m) // (2 * m) END AS r, c0 + sign(c1 - c0) * CASE WHEN m = 0 THEN 0 WHEN by_row THEN (2 * k * i + m) // (2 * m) ELSE i END AS c FROM (
    SELECT *, unnest(range(0, m + 1)) AS i FROM (
      SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS m, least(abs(r1 - r0), abs(c1 - c0)) AS k, abs(r1 - r0) > abs(c1 - c0) AS by_row FROM (
        SELECT l_orderkey, l_linenumber, l_partkey % 23 AS r0, l_suppkey % 19 AS c0, l_orderkey % 29 AS r1, CAST(l_quantity AS BIGINT) AS c1 FROM lineitem)))) GROUP BY 1, 2""")
def line_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 23).alias("r0"), (F.col("l_suppkey") % 19).alias("c0"), (F.col("l_orderkey") % 29).alias("r1"), F.col("l_quantity").cast("long").alias("c1"))
    lines = geo.explode_line(rows, ["l_orderkey", "l_linenumber"], "r0", "c0", "r1", "c1")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("r") * 31 + F.col("c")).alias("checksum"))


# -- patches and models: beyond SQL


def _patches(spark: SparkSession, sf_dir: str, size: int = 128) -> DataFrame:
    net = terrain(spark, sf_dir).net
    ways = materialize(pairs.head_paths(net))
    return raster.patches(materialize(pairs.first_meet_pairs(net, ways)), net, size, ways)


@query(None)
def raster_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.patch_counts(_patches(spark, sf_dir))


@query(None)
def raster_connectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.branch_connected(_patches(spark, sf_dir))


@query(None)
def cnn_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(cnn.extract_embeddings(_patches(spark, sf_dir), cnn.initial_weights()))


@query(None)
def boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(Pairs(spark, sf_dir).labelled())
    features = ["delta_L", "headhead_dist_norm", "apex_angle_deg", "strahler_order_diff", "proximity_profile_norm"]
    folds = sampling.group_split(rows, ["basin", "outlet"], 0.2)
    model = ml.fit_trees(folds.filter("not is_test"), features, rounds=10, depth=3)
    return ml.predict(model, folds.filter("is_test"), features).select(*KEYS, "y", F.round("score", 6).alias("score"))


@query(None)
def embeddings_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    images = materialize(raster.patches(p.pairs, p.t.net, ways=p.ways))
    return labels.merge_embeddings(p.coupling(), cnn.extract_embeddings(images, cnn.initial_weights())).select(*KEYS, "touching", *[f"emb_{i}" for i in range(4)])


@query("SELECT count(*) FILTER (o_orderstatus <> 'F') AS n_done, count(*) FILTER (o_orderstatus = 'F') AS n_failed, CAST(coalesce(sum(o_custkey) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS n_pairs FROM orders")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_custkey")
    return stats.failures(rows.select(F.col("o_orderkey").alias("basin"), F.when(F.col("o_orderstatus") == "F", "failed").alias("error"), F.col("o_custkey").alias("n_pairs")))
