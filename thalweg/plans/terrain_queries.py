"""Queries over the terrain and the pairs of stream heads in it, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import asymmetry, coupling, geometry, grid, labels, network, pairs, sampling, stats
from ..plans.materialize import materialize
from ..sources.terrain import NCOLS, THRESHOLD, Terrain, terrain, terrain_cells
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
OPTIONS = coupling.CouplingOptions(threshold=THRESHOLD)
KEYS = ["basin", "outlet", "confluence", "head_1", "head_2"]
ORIENTATION_M = 3.0


def query(layers: list[str] | None, select: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = S.over(*layers, select=select) if layers else select
        return f

    return add


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


# -- grids


@query([S.CELLS], "SELECT basin, cell_id, CASE WHEN z < 0 THEN NULL ELSE z END AS z FROM cells")
def grid_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.mask_below(terrain_cells(spark, sf_dir), 0.0).select("basin", "cell_id", "z")


@query([S.CELLS], "SELECT basin, max(r) + 1 AS n_rows, max(c) + 1 AS n_cols, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(count(z) * 100.0 / count(*), 6) AS pct_valid FROM (SELECT * REPLACE (CASE WHEN z >= 0 THEN z END AS z) FROM cells) GROUP BY 1")
def grid_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(grid.grid_stats(grid.mask_below(terrain_cells(spark, sf_dir), 0.0)))


@query([S.CELLS, S.NEIGHBOURS, S.FLOW], "SELECT * FROM flow")
def flow_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.flow_directions(terrain_cells(spark, sf_dir), NCOLS)


@query(S.LAYERS[:4], "SELECT basin, cell_id, area FROM area")
def contributing_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = materialize(terrain_cells(spark, sf_dir))
    return network.contributing_area(cells, materialize(grid.flow_directions(cells, NCOLS)))


@query([S.CELLS], "SELECT basin, cell_id, cell_id // 64 AS r, cell_id % 64 AS c, CAST(10.0 + 30.0 * (cell_id % 64) AS DOUBLE) AS x, CAST(5000.0 - 30.0 * (cell_id // 64) AS DOUBLE) AS y FROM cells")
def grid_world_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = terrain_cells(spark, sf_dir)
    r, c = grid.unravel(F.col("cell_id"), NCOLS)
    x, y = grid.Affine(30.0, 0.0, 10.0, 0.0, -30.0, 5000.0).world(F.col("r"), F.col("c"))
    return cells.select("basin", "cell_id", r.alias("r"), c.alias("c")).select("*", x.alias("x"), y.alias("y"))


@query([S.CELLS], "SELECT basin, cell_id, z FROM cells WHERE r % 5 = 0 AND c % 5 = 0")
def grid_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.subsample(terrain_cells(spark, sf_dir), 5).select("basin", "cell_id", "z")


# -- networks


@query(S.TO_STREAMS, "SELECT basin, u, v FROM edges")
def stream_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).net.edges


@query(S.TO_STREAMS, "SELECT * FROM nodes")
def stream_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).net.nodes


@query(S.TO_STREAMS, "SELECT basin, node_id AS outlet FROM nodes WHERE is_outlet")
def outlet_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terrain(spark, sf_dir).net.nodes.filter("is_outlet").select("basin", F.col("node_id").alias("outlet"))


@query(S.LAYERS, f"SELECT basin, node_id, {_r('up_dist')} FROM updist")
def upstream_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(network.upstream_distance(terrain(spark, sf_dir).net))


@query([*S.TO_STREAMS, S.WAYS, S.STRAHLER], "SELECT basin, node_id, CAST(strahler AS INT) AS strahler FROM strahler")
def strahler_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.strahler_orders(terrain(spark, sf_dir).net)


@query([*S.TO_STREAMS, S.HEAD_CELLS], "SELECT basin, head, cell_id FROM head_cells")
def head_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return network.head_cells(t.net, t.flow)


@query(S.TO_STREAMS, "SELECT c.basin, c.anc AS seed, c.cell_id FROM clo c JOIN nodes n ON n.basin = c.basin AND n.node_id = c.anc AND n.is_confluence")
def dependence_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return network.dependence(t.net.nodes.filter("is_confluence").select("basin", F.col("node_id").alias("cell_id")), t.flow)


@query([*S.TO_STREAMS, S.WAYS], "SELECT DISTINCT n.* FROM nodes n JOIN clo c ON c.basin = n.basin AND c.cell_id = n.node_id JOIN nodes s ON s.basin = c.basin AND s.node_id = c.anc AND s.is_confluence WHERE NOT n.is_outlet AND NOT EXISTS (SELECT 1 FROM nodes o WHERE false)")
def upstream_of_confluences(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    sub = network.upstream_network(t.net, t.net.nodes.filter("is_confluence"))
    return t.net.nodes.join(sub.nodes.select("basin", "node_id"), ["basin", "node_id"], "left_semi").filter("not is_outlet")


@query([*S.TO_STREAMS, S.WAYS], "SELECT w.basin, w.node AS confluence, count(*) AS n_heads, array_to_string(list(w.head ORDER BY w.head), ',') AS heads FROM ways w JOIN nodes n ON n.basin = w.basin AND n.node_id = w.node AND n.is_confluence WHERE w.head <> w.node GROUP BY 1, 2")
def heads_per_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    found = network.heads_per_confluence(net, pairs.head_paths(net))
    return found.withColumn("heads", F.array_join(F.transform("heads", lambda h: h.cast("string")), ","))


# -- pairs


@query([*S.TO_STREAMS, S.WAYS], "SELECT basin, head, pos, node, via FROM ways")
def head_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.head_paths(terrain(spark, sf_dir).net)


@query(S.TO_PAIRS, "SELECT basin, outlet, confluence, head_1, head_2 FROM pairs")
def first_meet_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.first_meet_pairs(terrain(spark, sf_dir).net)


@query(S.TO_PAIRS, "SELECT basin, confluence, count(*) AS n_pairs, string_agg(head_1 || '-' || head_2, ',' ORDER BY head_1, head_2) AS pairs FROM pairs GROUP BY 1, 2")
def pairs_at_confluence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pairs.pairs_by_confluence(pairs.first_meet_pairs(terrain(spark, sf_dir).net))
    return found.select("basin", "confluence", F.size("pairs").cast("long").alias("n_pairs"), F.array_join(F.transform("pairs", lambda p: F.concat_ws("-", p["head_1"], p["head_2"])), ",").alias("pairs"))


@query(S.TO_PAIRS, "SELECT p.basin, p.confluence, p.head_1, p.head_2, a.via AS branch_1, b.via AS branch_2 FROM pairs p JOIN ways a ON a.basin = p.basin AND a.head = p.head_1 AND a.node = p.confluence JOIN ways b ON b.basin = p.basin AND b.head = p.head_2 AND b.node = p.confluence")
def branch_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    ways = pairs.head_paths(net)
    out = pairs.first_meet_pairs(net, ways)
    for k in "12":
        out = out.join(ways.select("basin", F.col("head").alias(f"head_{k}"), F.col("node").alias("confluence"), F.col("via").alias(f"branch_{k}")), ["basin", f"head_{k}", "confluence"])
    return out.select("basin", "confluence", "head_1", "head_2", "branch_1", "branch_2")


@query([*S.TO_PAIRS], "SELECT p.basin, p.confluence, p.head_1, p.head_2, w.pos, w.node FROM pairs p JOIN ways e ON e.basin = p.basin AND e.head = p.head_1 AND e.node = p.confluence JOIN ways w ON w.basin = p.basin AND w.head = p.head_1 AND w.pos <= e.pos")
def full_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    ways = pairs.head_paths(net)
    return pairs.path_to(ways, pairs.first_meet_pairs(net, ways)).select("basin", "confluence", "head_1", "head_2", "pos", "node")


@query([*S.TO_STREAMS, S.WAYS], "SELECT basin, head, max(gap) AS max_gap, round(avg(gap), 6) AS mean_gap, count(*) FILTER (gap > 1) AS n_over, round(count(*) FILTER (gap > 1) * 100.0 / count(*), 6) AS pct_over FROM (SELECT basin, head, greatest(abs(node // 64 - via // 64), abs(node % 64 - via % 64)) AS gap FROM ways WHERE via IS NOT NULL) GROUP BY 1, 2")
def path_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    r, c = grid.unravel(F.col("node"), NCOLS)
    return _rounded(pairs.path_gaps(pairs.head_paths(net).select("basin", "head", "pos", r.alias("r"), c.alias("c")), ["basin", "head"]))


@query(S.LAYERS, "SELECT basin, head_1, head_2 FROM crossing")
def stream_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    return coupling.crossing_pairs(coupling.with_places(pairs.first_meet_pairs(net), net), net)


@query([*S.TO_PAIRS, S.HEAD_CELLS, S.GATES], "SELECT basin, head_1, head_2, sqrt(CAST((r1 - r2) * (r1 - r2) + (c1 - c2) * (c1 - c2) AS DOUBLE)) <= 2.0 * sqrt(3.0) AS near FROM placed")
def distance_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    return coupling.with_places(pairs.first_meet_pairs(net), net).select("basin", "head_1", "head_2", coupling.near_enough(OPTIONS).alias("near"))


@query([*S.TO_PAIRS, S.HEAD_CELLS, S.GATES, S.COUPLING], "SELECT p.basin, p.head_1, p.head_2, n FROM pairs p JOIN contact t ON t.basin = p.basin AND t.head_1 = p.head_1 AND t.head_2 = p.head_2")
def pair_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = terrain(spark, sf_dir)
    return coupling.contacts(network.head_cells(t.net, t.flow), NCOLS, 8, pairs.first_meet_pairs(t.net))


class Pairs:
    """All tables of pairs over one terrain, with what they share materialised once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t: Terrain = terrain(spark, sf_dir)
        self.ways = materialize(pairs.head_paths(self.t.net))
        self.pairs = materialize(pairs.first_meet_pairs(self.t.net, self.ways))
        self._asymmetry: DataFrame | None = None

    def coupling(self) -> DataFrame:
        return coupling.evaluate_coupling(self.pairs, self.t.net, self.t.flow, NCOLS, OPTIONS)

    def asymmetry(self) -> DataFrame:
        if self._asymmetry is None:
            self._asymmetry = materialize(asymmetry.evaluate_asymmetry(self.pairs, self.t.net))
        return self._asymmetry

    def geometry(self) -> DataFrame:
        return geometry.evaluate_geometry(self.pairs, self.t.net, network.strahler_orders(self.t.net), self.asymmetry(), direction_m=ORIENTATION_M, ways=self.ways)

    def labelled(self) -> DataFrame:
        return labels.labelled_dataset(self.coupling(), self.asymmetry(), self.geometry())


@query(S.LAYERS, "SELECT * FROM coupling")
def evaluate_coupling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Pairs(spark, sf_dir).coupling()


@query(S.LAYERS, f"SELECT basin, outlet, confluence, head_1, head_2, {_r('L_1', 'L_2', 'delta_L')}, distance_unit FROM asymmetry")
def evaluate_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Pairs(spark, sf_dir).asymmetry())


@query(S.ALL, f"SELECT basin, outlet, confluence, head_1, head_2, {_r(*geometry.FEATURES, digits=5)}, qc_flags FROM geometry")
def evaluate_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Pairs(spark, sf_dir).geometry(), 5)


@query(S.LAYERS, f"SELECT c.*, {_r('L_1', 'L_2', 'delta_L')}, distance_unit FROM coupling c LEFT JOIN asymmetry a USING (basin, outlet, confluence, head_1, head_2)")
def coupling_with_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    return _rounded(labels.merge_asymmetry(p.coupling(), p.asymmetry()))


_LABELLED = f"basin, outlet, confluence, head_1, head_2, touching, contact_px, size1_px, size2_px, skipped_prefilter, y, {_r('L_1', 'L_2', 'delta_L', *geometry.FEATURES, digits=5)}, qc_flags"


@query(S.ALL, f"SELECT {_LABELLED} FROM labelled")
def labelled_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(Pairs(spark, sf_dir).labelled(), 5)


_HARD = """
SELECT {cols} FROM labelled l, (
  SELECT 1.2 * nullif(greatest(quantile_cont(L_1 + L_2, 0.5) FILTER (y = 1), 0), 0) AS lim_l, 1.2 * nullif(greatest(quantile_cont(headhead_dist_m, 0.5) FILTER (y = 1), 0), 0) AS lim_d FROM labelled)
WHERE y = 1 OR ((L_1 + L_2 IS NULL OR lim_l IS NULL OR L_1 + L_2 <= lim_l) AND (headhead_dist_m IS NULL OR lim_d IS NULL OR headhead_dist_m <= lim_d))"""


@query(S.ALL, _HARD.format(cols="basin, outlet, confluence, head_1, head_2, y"))
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(Pairs(spark, sf_dir).labelled())
    return labels.filter_hard_negatives(rows, 1.2, 1.2).select(*KEYS, "y")


@query(S.ALL, """SELECT l.basin, outlet, confluence, head_1, head_2, y FROM labelled l JOIN (
  SELECT basin, 1.2 * nullif(greatest(quantile_cont(L_1 + L_2, 0.5) FILTER (y = 1), 0), 0) AS lim_l, 1.2 * nullif(greatest(quantile_cont(headhead_dist_m, 0.5) FILTER (y = 1), 0), 0) AS lim_d,
         max(y) = 1 AND min(y) = 0 AS usable FROM labelled GROUP BY 1) m USING (basin)
WHERE NOT usable OR y = 1 OR ((lim_l IS NULL OR L_1 + L_2 <= lim_l) AND (lim_d IS NULL OR headhead_dist_m <= lim_d))""")
def hard_negatives_by_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(Pairs(spark, sf_dir).labelled())
    return labels.filter_hard_negatives(rows, 1.2, 1.2, "basin").select(*KEYS, "y")


_QUOTA = """, q AS (SELECT basin, count(*) FILTER (y = 0) AS neg, count(*) FILTER (y = 1) AS pos FROM labelled GROUP BY 1),
t AS (SELECT sum(neg) AS all_neg, CAST(floor(sum(pos) * 0.2) AS BIGINT) AS target FROM q),
s AS (SELECT basin, neg, target, all_neg, CASE WHEN all_neg <= target THEN neg ELSE CAST(round_even(neg / all_neg * target, 0) AS BIGINT) END AS share FROM q, t),
w AS (SELECT *, CASE WHEN all_neg <= target THEN 0 ELSE target - sum(share) OVER () END AS missing, row_number() OVER (ORDER BY neg DESC, basin) AS spot FROM s),
quota AS (SELECT basin, greatest(0, least(neg, share + CASE WHEN spot <= abs(missing) THEN sign(missing) ELSE 0 END)) AS quota FROM w)
"""


@query([*S.ALL[:-1], S.ALL[-1] + _QUOTA], "SELECT basin, CAST(quota AS BIGINT) AS quota FROM quota")
def negative_quotas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.negative_quotas(materialize(Pairs(spark, sf_dir).labelled()), 0.2)


@query([*S.ALL[:-1], S.ALL[-1] + _QUOTA], """SELECT basin, outlet, confluence, head_1, head_2, y FROM labelled WHERE y = 1
UNION ALL SELECT basin, outlet, confluence, head_1, head_2, y FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY head_1 * 7919 % 1009, head_1, head_2, confluence) AS k FROM labelled WHERE y = 0) JOIN quota USING (basin) WHERE k <= quota""")
def stratified_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialize(Pairs(spark, sf_dir).labelled())
    return labels.stratified_negatives(rows, 0.2, order=[F.col("head_1") * 7919 % 1009, "head_1", "head_2", "confluence"]).select(*KEYS, "y")


@query(S.LAYERS, "SELECT basin, outlet, confluence, head_1, head_2 FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY head_1 * 7919 % 1009, head_1, head_2, confluence) AS k FROM pairs) WHERE k <= 50")
def sample_per_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_group(Pairs(spark, sf_dir).pairs, "basin", 50, ["head_1"], order=[F.col("head_1") * 7919 % 1009, "head_1", "head_2", "confluence"])


# -- summaries


@query(S.LAYERS, "SELECT basin, round(median(delta_L), 6) AS median, round(quantile_cont(delta_L, 0.25), 6) AS p25, round(quantile_cont(delta_L, 0.75), 6) AS p75, round(avg(delta_L), 6) AS mean, round(stddev_pop(delta_L), 6) AS std, count(delta_L) AS count FROM asymmetry GROUP BY 1")
def asymmetry_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.five_numbers(Pairs(spark, sf_dir).asymmetry(), "delta_L", ["basin"]))


@query(S.LAYERS, "SELECT basin, count(*) AS n_pairs, CAST(sum(touching::INT) AS BIGINT) AS n_touching, round(avg(touching::INT), 3) AS touching_rate, CAST(count(*) - sum(touching::INT) AS BIGINT) AS n_not_touching FROM coupling GROUP BY 1")
def coupling_by_basin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.coupling_summary(Pairs(spark, sf_dir).coupling(), ["basin"])


@query(S.LAYERS, "SELECT basin, outlet, count(*) AS n FROM coupling WHERE touching GROUP BY 1, 2 ORDER BY n DESC, basin, outlet LIMIT 10")
def busiest_outlets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = Pairs(spark, sf_dir).coupling().filter("touching").groupBy("basin", "outlet").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy(F.col("n").desc(), "basin", "outlet").limit(10)


@query(S.LAYERS, "SELECT basin, outlet, n FROM (SELECT basin, outlet, count(*) FILTER (touching) AS n, row_number() OVER (PARTITION BY basin ORDER BY count(*) FILTER (touching) DESC, outlet) AS k FROM coupling GROUP BY 1, 2) WHERE k = 1")
def most_coupled_outlet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.largest_group(Pairs(spark, sf_dir).coupling(), ["basin"], "outlet", F.col("touching"))


@query(S.ALL, """SELECT 'L_1' AS "column", count(L_1) AS count, round(avg(L_1), 6) AS mean, round(stddev_samp(L_1), 6) AS std, round(min(L_1), 6) AS min, round(quantile_cont(L_1, 0.25), 6) AS p25, round(median(L_1), 6) AS p50, round(quantile_cont(L_1, 0.75), 6) AS p75, round(max(L_1), 6) AS max FROM labelled
UNION ALL SELECT 'apex_angle_deg', count(apex_angle_deg), round(avg(apex_angle_deg), 6), round(stddev_samp(apex_angle_deg), 6), round(min(apex_angle_deg), 6), round(quantile_cont(apex_angle_deg, 0.25), 6), round(median(apex_angle_deg), 6), round(quantile_cont(apex_angle_deg, 0.75), 6), round(max(apex_angle_deg), 6) FROM labelled""")
def describe_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.describe(Pairs(spark, sf_dir).labelled(), ["L_1", "apex_angle_deg"]))


@query(S.LAYERS, """SELECT 'size1_px' AS "column", count(*) FILTER (size1_px IS NULL) AS n_missing, round(count(*) FILTER (size1_px IS NULL) * 100.0 / count(*), 6) AS pct_missing FROM coupling
UNION ALL SELECT 'contact_px', count(*) FILTER (contact_px IS NULL), round(count(*) FILTER (contact_px IS NULL) * 100.0 / count(*), 6) FROM coupling""")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.missing_profile(Pairs(spark, sf_dir).coupling(), ["size1_px", "contact_px"]))


@query(S.LAYERS, "SELECT count(*) AS n_pairs, count(*) FILTER (touching) AS n_touching, round(count(*) FILTER (touching) * 100.0 / count(*), 6) AS pct_touching, count(DISTINCT basin || '__' || outlet) AS n_outlets FROM coupling")
def coupling_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Pairs(spark, sf_dir).coupling()
    hit = F.count_if("touching")
    return _rounded(c.agg(F.count(F.lit(1)).alias("n_pairs"), hit.alias("n_touching"), F.try_divide(hit * 100.0, F.count(F.lit(1))).alias("pct_touching"), F.count_distinct(F.concat_ws("__", "basin", "outlet")).alias("n_outlets")))


@query(S.ALL, "SELECT 'y' AS a, 'L_1' AS b, round(corr(y, L_1), 6) AS corr FROM labelled UNION ALL SELECT 'y', 'headhead_dist_m', round(corr(y, headhead_dist_m), 6) FROM labelled UNION ALL SELECT 'L_1', 'headhead_dist_m', round(corr(L_1, headhead_dist_m), 6) FROM labelled")
def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.correlations(Pairs(spark, sf_dir).labelled(), ["y", "L_1", "headhead_dist_m"]))


@query(S.ALL, "SELECT 'L_1' AS \"column\", round(corr(y, L_1), 6) AS corr FROM labelled UNION ALL SELECT 'headhead_dist_m', round(corr(y, headhead_dist_m), 6) FROM labelled UNION ALL SELECT 'L_2', round(corr(y, L_2), 6) FROM labelled")
def target_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.target_correlations(Pairs(spark, sf_dir).labelled(), ["L_1", "L_2", "headhead_dist_m"], "y"))


@query([S.CELLS], """SELECT bin, round(a + (b - a) / 30 * bin, 6) AS lo, round(a + (b - a) / 30 * (bin + 1), 6) AS hi, coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * ((b - a) / 30)), 6) AS density
FROM (SELECT min(z) AS a, max(z) AS b, count(z) AS total FROM cells) CROSS JOIN (SELECT CAST(range AS INT) AS bin FROM range(30))
LEFT JOIN (SELECT CAST(least(29, floor((z - a) / ((b - a) / 30))) AS INT) AS bin, count(*) AS n FROM cells, (SELECT min(z) AS a, max(z) AS b FROM cells) GROUP BY 1) USING (bin)""")
def elevation_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.histogram(terrain_cells(spark, sf_dir), "z", 30))


@query(S.LAYERS, "SELECT basin, round(abs(delta_L - mid), 6) AS distance, confluence, head_1, head_2 FROM (SELECT a.*, mid, row_number() OVER (PARTITION BY basin ORDER BY round(abs(delta_L - mid), 9), confluence, head_1, head_2) AS k FROM (SELECT basin, outlet, confluence, head_1, head_2, round(delta_L, 9) AS delta_L FROM asymmetry) a JOIN (SELECT basin, median(round(delta_L, 9)) AS mid FROM asymmetry GROUP BY 1) USING (basin)) WHERE k = 1")
def pair_nearest_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Pairs(spark, sf_dir).asymmetry().withColumn("delta_L", F.round("delta_L", 9))
    return _rounded(stats.nearest_to_median(rows, "delta_L", ["basin"], ["confluence", "head_1", "head_2"]))


@query(S.LAYERS, "SELECT basin, outlet, confluence, head_1, head_2 FROM (SELECT *, row_number() OVER (PARTITION BY basin ORDER BY outlet, confluence, head_1, head_2) AS k FROM pairs) WHERE k <= 3")
def first_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.first_rows(Pairs(spark, sf_dir).pairs, ["basin"], ["outlet", "confluence", "head_1", "head_2"], 3)


@query(S.LAYERS, "SELECT * FROM (SELECT basin, count(*) AS n_pairs, CAST(sum(touching::INT) AS BIGINT) AS n_touching, round(avg(touching::INT), 3) AS touching_rate, CAST(count(*) - sum(touching::INT) AS BIGINT) AS n_not_touching FROM coupling GROUP BY 1) LEFT JOIN (SELECT basin, round(median(delta_L), 6) AS median, round(quantile_cont(delta_L, 0.25), 6) AS p25, round(quantile_cont(delta_L, 0.75), 6) AS p75, round(avg(delta_L), 6) AS mean, round(stddev_pop(delta_L), 6) AS std, count(delta_L) AS count FROM asymmetry GROUP BY 1) USING (basin)")
def basin_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    return _rounded(stats.basin_summary(p.coupling(), p.asymmetry()))


@query(S.LAYERS, "SELECT CAST(part AS INT) AS part, round(median(delta_L), 6) AS median, round(quantile_cont(delta_L, 0.25), 6) AS p25, round(quantile_cont(delta_L, 0.75), 6) AS p75, count(delta_L) AS count FROM (SELECT head_1 % 3 AS part, delta_L FROM asymmetry) GROUP BY 1")
def experiment_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Pairs(spark, sf_dir).asymmetry().withColumn("part", (F.col("head_1") % 3).cast("int"))
    return _rounded(stats.compare_experiments(rows, "part", "delta_L"))


@query(S.LAYERS, "SELECT DISTINCT basin, head_1 AS start, outlet AS target FROM pairs")
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    asked = p.pairs.select("basin", F.col("head_1").alias("start"), F.col("outlet").alias("target")).distinct()
    back = asked.select("basin", F.col("target").alias("start"), F.col("start").alias("target")).filter("start <> target")
    return network.reachable(p.t.net, asked.union(back))


@query(S.LAYERS, "SELECT e.basin, t.outlet, e.u, e.v FROM edges e JOIN roots t ON t.basin = e.basin AND t.node_id = e.u")
def outlet_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = terrain(spark, sf_dir).net
    chosen = net.nodes.filter("is_outlet").select("basin", F.col("node_id").alias("outlet"))
    return network.outlet_view(net, chosen)


# -- what plots show


@query(S.LAYERS, "SELECT p.basin, p.head_1, p.head_2, h.cell_id, CAST(CASE WHEN h.head = p.head_1 THEN 1 ELSE 2 END AS INT) AS side FROM coupling p JOIN head_cells h ON h.basin = p.basin AND h.head IN (p.head_1, p.head_2) WHERE p.touching")
def pair_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    areas = materialize(network.head_cells(p.t.net, p.t.flow))
    hit = p.coupling().filter("touching").select("basin", "head_1", "head_2", F.inline(F.array(*[F.struct(F.lit(int(k)).alias("side"), F.col(f"head_{k}").alias("head")) for k in "12"])))
    return hit.join(areas, ["basin", "head"]).select("basin", "head_1", "head_2", "cell_id", "side")


_BOX = "greatest((max({x}) - min({x})) * 0.1, 1e-9)"


@query(S.TO_PAIRS, "SELECT basin, head_1, head_2, " + ", ".join(f"round({f}({x}) {s} {_BOX.format(x=x)}, 6) AS {x}{k}" for x in "rc" for k, f, s in ((0, "min", "-"), (1, "max", "+"))) + """ FROM (
  SELECT basin, head_1, head_2, unnest([head_1 // 64, head_2 // 64, confluence // 64]) AS r, unnest([head_1 % 64, head_2 % 64, confluence % 64]) AS c FROM pairs) GROUP BY 1, 2, 3""")
def pair_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_boxes(spark, sf_dir)[0])


def _boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Terrain]:
    t = terrain(spark, sf_dir)
    points = pairs.first_meet_pairs(t.net).select("basin", "head_1", "head_2", F.explode(F.array("head_1", "head_2", "confluence")).alias("node"))
    r, c = grid.unravel(F.col("node"), NCOLS)
    return grid.padded_box(points.select("basin", "head_1", "head_2", r.alias("r"), c.alias("c")), ["basin", "head_1", "head_2"]), t


@query(S.TO_PAIRS, """SELECT b.basin, head_1, head_2, count(*) AS n_cells, round(min(z), 6) AS z_min FROM (
  SELECT basin, head_1, head_2, min(r) - greatest((max(r) - min(r)) * 0.1, 1e-9) AS r0, max(r) + greatest((max(r) - min(r)) * 0.1, 1e-9) AS r1,
         min(c) - greatest((max(c) - min(c)) * 0.1, 1e-9) AS c0, max(c) + greatest((max(c) - min(c)) * 0.1, 1e-9) AS c1 FROM (
    SELECT basin, head_1, head_2, unnest([head_1 // 64, head_2 // 64, confluence // 64]) AS r, unnest([head_1 % 64, head_2 % 64, confluence % 64]) AS c FROM pairs) GROUP BY 1, 2, 3) b
  JOIN cells x ON x.basin = b.basin AND x.r BETWEEN greatest(r0, 0) AND r1 AND x.c BETWEEN greatest(c0, 0) AND least(c1, 63) GROUP BY 1, 2, 3""")
def cropped_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes, t = _boxes(spark, sf_dir)
    keys = ["basin", "head_1", "head_2"]
    inside = grid.crop(t.cells, boxes, keys, ncols=NCOLS)
    return _rounded(inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"), F.min("z").alias("z_min")))


@query([S.CELLS], "SELECT basin, cell_id, " + ", ".join(f"round({x}, 6) AS {n}" for n, x in (("mpd", "sqrt(111320.0 * cos(radians(abs(23.5 + r / 10.0))) * 110540.0)"), ("az", "degrees(atan2(r - 60.5, 30.25)) + CASE WHEN r < 60.5 THEN 360.0 ELSE 0.0 END"), ("dl", "CASE WHEN r = 0 THEN 0.0 ELSE 2.0 * abs(r - 2.0 * r) / (r + 2.0 * r) END"))) + ", CAST(round_even(r / 2.0, 0) AS BIGINT) AS half FROM cells")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r").cast("double")
    return _rounded(terrain_cells(spark, sf_dir).select("basin", "cell_id", geo.meters_per_degree(F.lit(23.5) + r / 10.0).alias("mpd"), geo.azimuth(r - 60.5, F.lit(30.25)).alias("az"), geo.delta_l(r, 2.0 * r).alias("dl"), geo.round_even(r / 2.0).alias("half")))


_LAT, _MPD = "(23.5 + r / 10.0)", "sqrt(111320.0 * cos(radians(abs(23.5 + r / 10.0))) * 110540.0)"


@query([S.CELLS], f"""SELECT basin, cell_id, round(c / 100.0 * {_MPD}, 6) AS pixel_m, round(sqrt((3 - r) * (3 - r) + (4 - c) * (4 - c)), 6) AS dist,
  round(CASE WHEN r > 0 OR c > 0 THEN degrees(acos(greatest(-1.0, least(1.0, (r + 2.0 * c) / (sqrt(r * r + c * c) * sqrt(5.0)))))) END, 4) AS angle,
  CAST(CASE WHEN abs(r * 2.5 - c * 5.0) > 180 THEN 360.0 - abs(r * 2.5 - c * 5.0) ELSE abs(r * 2.5 - c * 5.0) END AS DOUBLE) AS turn,
  round(CASE WHEN r > 0 OR c > 0 THEN r / sqrt(r * r + c * c) END, 6) AS ux, round(CASE WHEN r > 0 OR c > 0 THEN c / sqrt(r * r + c * c) END, 6) AS uy,
  round(CASE WHEN greatest(r, c) > 0 THEN least(r, c) / greatest(r, c) END, 6) AS ratio,
  round(CASE WHEN c < 10 THEN {_MPD} ELSE 1.0 END, 6) AS length_scale, round(CASE WHEN c < 10 THEN c / 10.0 * {_MPD} ELSE c / 10.0 END, 6) AS pixel_scale,
  CAST(CASE WHEN c % 2 = 0 THEN r ELSE c END AS DOUBLE) AS cellsize,
  round(CASE WHEN r + 1 = 60 AND c + 0.5 = 30 THEN 0.0 ELSE pi() - atan2(c + 0.5 - 30, r + 1 - 60) END, 6) AS upright,
  round(60 + (r - 60) * cos(0.5) - (c - 30) * sin(0.5), 6) AS turned_r, round(30 + (r - 60) * sin(0.5) + (c - 30) * cos(0.5), 6) AS turned_c
FROM (SELECT basin, cell_id, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c FROM cells)""")
def scalar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, c = F.col("r").cast("double"), F.col("c").cast("double")
    lat, unit = F.lit(23.5) + r / 10.0, geo.unit_vector(r, c)
    turned = geo.rotate(r, c, F.lit(60.0), F.lit(30.0), F.lit(0.5))
    columns = {
        "pixel_m": geo.pixel_size_meters(lat, c / 100.0), "dist": geo.distance(r, c, 3.0, 4.0), "angle": F.round(geo.angle_between(r, c, F.lit(1.0), F.lit(2.0)), 4),
        "turn": geo.azimuth_difference(r * 2.5, c * 5.0), "ux": unit["x"], "uy": unit["y"], "ratio": geo.length_ratio(r, c), "length_scale": geo.asymmetry_scale(lat, c / 10.0),
        "pixel_scale": geo.geometry_scale(lat, c / 10.0), "cellsize": geo.detect_cellsize(F.when(c % 2 == 0, -r), c),
        "upright": geo.rotation_angle(r, c, r + 2.0, c + 1.0, F.lit(60.0), F.lit(30.0)), "turned_r": turned[0], "turned_c": turned[1],
    }
    return _rounded(terrain_cells(spark, sf_dir).select("basin", "cell_id", *[v.alias(k) for k, v in columns.items()]))


# -- tables of pairs


@query(S.LAYERS, "SELECT p.basin, p.outlet, p.confluence, p.head_1, p.head_2, round(a.delta_L, 6) AS delta_L, c.touching FROM pairs p JOIN asymmetry a USING (basin, outlet, confluence, head_1, head_2) JOIN coupling c USING (basin, outlet, confluence, head_1, head_2)")
def inner_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    return _rounded(labels.inner_pairs(p.asymmetry().select(*KEYS, "delta_L"), p.coupling().select(*KEYS, "touching")))


@query(S.LAYERS, "SELECT basin, outlet, confluence, head_1, head_2, round(CASE WHEN confluence % 2 = 0 THEN L_1 + 1 ELSE L_1 END, 6) AS L_1, round(L_2, 6) AS L_2 FROM asymmetry")
def pair_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = Pairs(spark, sf_dir).asymmetry().select(*KEYS, "L_1", "L_2")
    new = old.withColumns({"L_1": F.when(F.col("confluence") % 2 == 0, F.col("L_1") + 1), "L_2": F.lit(None).cast("double")})
    return _rounded(labels.update_from(old, new, ["L_1", "L_2"]))


@query(S.LAYERS, "SELECT basin, outlet, confluence, head_1, head_2, round(L_1, 6) AS L_1, round(L_2, 6) AS L_2, '' AS qc_flags, CAST(NULL AS DOUBLE) AS apex_angle_deg FROM asymmetry")
def clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their heads the other way round and a column too many come out as they were."""
    rows = Pairs(spark, sf_dir).asymmetry().select(*KEYS, "L_1", "L_2").withColumn("overlap_px", F.lit(0))
    turned = rows.select("basin", "outlet", "confluence", F.col("head_2").alias("head_1"), F.col("head_1").alias("head_2"), F.col("L_2").alias("L_1"), F.col("L_1").alias("L_2"), "overlap_px")
    return _rounded(labels.clean_pairs(turned).select(*KEYS, "L_1", "L_2", "qc_flags", "apex_angle_deg"))


@query(S.TO_PAIRS, "SELECT basin, coalesce(arg_min(lat, (outlet, confluence, head_1, head_2)) FILTER (lat IS NOT NULL), 36.0) AS lat, 0.0::DOUBLE AS z_th FROM (SELECT *, CASE WHEN head_1 % 2 = 1 THEN head_1 / 100.0 END AS lat FROM pairs) GROUP BY 1")
def basin_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Pairs(spark, sf_dir).pairs
    return labels.basin_settings(rows.withColumn("lat", F.when(F.col("head_1") % 2 == 1, F.col("head_1") / 100.0)))


@query(S.TO_PAIRS, "SELECT basin, head_1, head_2, confluence, CASE WHEN basin IN (SELECT basin FROM nodes WHERE is_confluence AND node_id % 7 = 0) THEN 'short' ELSE 'short,missing_stream' END AS qc_flags FROM pairs")
def missing_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Pairs(spark, sf_dir)
    known = p.t.net.nodes.filter("is_confluence and node_id % 7 = 0").select("basin")
    return labels.mark_missing_stream(p.pairs.withColumn("qc_flags", F.lit("short")), known).select("basin", "head_1", "head_2", "confluence", "qc_flags")
