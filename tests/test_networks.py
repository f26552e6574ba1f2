import pytest
from networks import COMPLEX, TOUCHING, Y, build
from pyspark.sql import functions as F

from thalweg.operators import asymmetry, coupling, geometry, network, pairs, raster


def rows(df, *columns):
    return {tuple(r) for r in df.select(*columns).collect()}


def test_pairs_of_a_y(spark):
    net, _, _ = build(spark, Y)
    assert rows(pairs.first_meet_pairs(net), "outlet", "confluence", "head_1", "head_2") == {(6, 4, 0, 1)}
    assert rows(net.nodes.filter("is_head"), "node_id") == {(0,), (1,)}
    assert rows(net.nodes.filter("is_confluence"), "node_id") == {(4,)}
    assert rows(net.nodes.filter("is_outlet"), "node_id") == {(6,)}


def test_full_path(spark):
    net, _, _ = build(spark, Y)
    path = pairs.path_to(pairs.head_paths(net), pairs.first_meet_pairs(net)).orderBy("pos").collect()
    assert [r["node"] for r in path] == [0, 2, 4]


def test_pairs_of_three_confluences(spark):
    net, _, _ = build(spark, COMPLEX)
    expected = {(4, 0, 1), (5, 2, 3), (6, 0, 2), (6, 0, 3), (6, 1, 2), (6, 1, 3)}
    assert rows(pairs.first_meet_pairs(net), "confluence", "head_1", "head_2") == expected
    by = {r["confluence"]: len(r["pairs"]) for r in pairs.pairs_by_confluence(pairs.first_meet_pairs(net)).collect()}
    assert by == {4: 1, 5: 1, 6: 4}


def test_gates(spark):
    net, flow, ncols = build(spark, COMPLEX, by_cell=True)
    found, cell = pairs.first_meet_pairs(net), {r * 12 + c: k for k, (r, c) in COMPLEX["nodes"].items()}
    kept = coupling.evaluate_coupling(found, net, flow, ncols)
    assert {tuple(sorted((cell[r["head_1"]], cell[r["head_2"]]))) for r in kept.collect()} == {(0, 1), (2, 3), (1, 2)}
    assert coupling.evaluate_coupling(found, net, flow, ncols, stream_filter=False).count() == 6
    far = coupling.evaluate_coupling(found, net, flow, ncols, coupling.CouplingOptions(threshold=1, prefilter_multiplier=1.0))
    assert rows(far, "touching", "contact_px", "size1_px", "size2_px", "skipped_prefilter") == {(False, 0, None, None, True)}


@pytest.mark.parametrize("connectivity", [4, 8])
def test_touching_areas(spark, connectivity):
    net, flow, ncols = build(spark, TOUCHING, by_cell=True)
    got = coupling.evaluate_coupling(pairs.first_meet_pairs(net), net, flow, ncols, coupling.CouplingOptions(connectivity))
    assert rows(got, "touching", "contact_px", "size1_px", "size2_px", "skipped_prefilter") == {(True, 1, 5, 5, False)}


def test_heads_by_linear_index(spark):
    net, flow, ncols = build(spark, TOUCHING, by_cell=True)
    found = pairs.first_meet_pairs(net).limit(1)
    # (1, 2) is no node; it drains to (0, 1). (1, 3) drains to (0, 4).
    cells = spark.createDataFrame([("b", 14, 14, 1 * ncols + 2, 1 * ncols + 3)], "basin string, outlet long, confluence long, head_1 long, head_2 long")
    place = coupling.with_places(cells, net, ncols).first()
    assert (place["r1"], place["c1"], place["r2"], place["c2"]) == (1, 2, 1, 3)
    assert coupling.with_places(cells, net).count() == 0
    r = coupling.evaluate_coupling(cells, net, flow, ncols, stream_filter=False).first()
    assert (r["touching"], r["contact_px"], r["size1_px"], r["size2_px"]) == (True, 1, 1, 1)
    both = coupling.evaluate_coupling(cells.union(found.select(cells.columns)), net, flow, ncols, stream_filter=False)
    assert rows(both, "touching", "contact_px", "size1_px", "size2_px") == {(True, 1, 1, 1), (True, 1, 5, 5)}  # (1, 2) meets (1, 3) only


def test_options_are_checked():
    for bad in ({"connectivity": 6}, {"threshold": 0}, {"prefilter_multiplier": -1.0}):
        with pytest.raises(ValueError):
            coupling.CouplingOptions(**bad)


def test_no_pairs_without_a_confluence(spark):
    line = {"shape": (3, 3), "nodes": {0: (0, 0), 1: (1, 0)}, "edges": [(0, 1)]}
    net, _, _ = build(spark, line)
    assert pairs.first_meet_pairs(net).count() == 0
    assert rows(net.nodes, "node_id", "is_head", "is_outlet") == {(0, True, False), (1, False, True)}


def test_unknown_nodes_are_refused(spark):
    net, _, _ = build(spark, {"shape": (3, 3), "nodes": {0: (0, 0), 1: (1, 0)}, "edges": [(0, 1), (1, 9)]})
    with pytest.raises(IndexError):
        network.validate(net)


def test_cycles_are_refused(spark):
    net, _, _ = build(spark, {"shape": (3, 3), "nodes": {0: (0, 0), 1: (1, 0), 2: (2, 0)}, "edges": [(0, 1), (1, 2), (2, 0)]})
    with pytest.raises(ValueError):
        network.outlet_of(net).count()


def test_long_chain(spark):
    n = 300
    net, _, _ = build(spark, {"shape": (n, 1), "nodes": {k: (k, 0) for k in range(n)}, "edges": [(k, k + 1) for k in range(n - 1)]})
    far = {r["node_id"]: r["up_dist"] for r in network.upstream_distance(net).collect()}
    assert far == {k: float(n - 1 - k) for k in range(n)}
    assert rows(network.outlet_of(net), "outlet") == {(n - 1,)}
    cells = net.nodes.select("basin", F.col("node_id").alias("cell_id"))
    area = {r["cell_id"]: r["area"] for r in network.contributing_area(cells, net.edges).collect()}
    assert area == {k: k + 1 for k in range(n)}


def test_strahler(spark):
    net, _, _ = build(spark, COMPLEX)
    assert rows(network.strahler_orders(net), "node_id", "strahler") == {(0, 1), (1, 1), (2, 1), (3, 1), (4, 2), (5, 2), (6, 3), (7, 3)}


def test_upstream_network_and_heads(spark):
    net, _, _ = build(spark, COMPLEX)
    part = network.upstream_network(net, net.nodes.filter("node_id = 4"))
    assert rows(part.nodes, "node_id") == {(0,), (1,), (4,)} and rows(part.edges, "u", "v") == {(0, 4), (1, 4)}
    found = network.heads_per_confluence(net, pairs.head_paths(net))
    assert {r["confluence"]: list(r["heads"]) for r in found.collect()} == {4: [0, 1], 5: [2, 3], 6: [0, 1, 2, 3]}


def test_features_of_parallel_channels(spark):
    nodes = {k: (k, 0) for k in range(5)} | {10 + k: (k, 5) for k in range(5)} | {20: (5, 2)}
    edges = [(k, k + 1) for k in range(4)] + [(10 + k, 11 + k) for k in range(4)] + [(4, 20), (14, 20)]
    net, _, _ = build(spark, {"shape": (8, 8), "nodes": nodes, "edges": edges})
    found = pairs.first_meet_pairs(net)
    lengths = asymmetry.evaluate_asymmetry(found, net)
    g = geometry.evaluate_geometry(found, net, network.strahler_orders(net), lengths, direction_m=3.0).first()
    assert g["headhead_dist_m"] == 5.0 and g["orientation_diff_deg"] == 0.0 and g["strahler_order_diff"] == 0.0
    assert 0 < g["proximity_mean_m"] <= g["proximity_max_m"] == pytest.approx(5.0, rel=0.02) and 0 < g["proximity_profile_norm"] <= 1
    assert g["qc_flags"] == "" and 0 < g["apex_angle_deg"] < 180
    r = lengths.first()
    assert r["L_1"] == pytest.approx(4 + 5**0.5) and r["L_2"] == pytest.approx(4 + 10**0.5)


def test_resampling(spark):
    keys = {k: 0 for k in geometry.KEYS}
    points = [(keys["basin"], 0, 0, 0, 0, x, 0.0, x + 4.0 if x < 8 else None, 0.0, 4.0 if x < 8 else 0.0, x, 8.0) for x in (0.0, 4.0, 8.0)]
    df = spark.createDataFrame(points, "basin long, outlet long, confluence long, head_1 long, head_2 long, x double, y double, xn double, yn double, edge double, so_far double, total double")
    assert [r["x"] for r in geometry.resample(df, 4).orderBy("k").collect()] == [0.0, 2.0, 4.0, 6.0]


def test_patches(spark):
    net, _, _ = build(spark, Y)
    found = pairs.first_meet_pairs(net)
    images = raster.patches(found, net, 128)
    n = raster.patch_counts(images).first()
    assert sum(n[f"n{k}"] for k in range(5)) == 128 * 128 and all(n[f"n{k}"] > 0 for k in range(5))
    flags = raster.branch_connected(images).first()
    assert flags["a_connected"] and flags["b_connected"]


def test_blocks_and_tiles_change_nothing(spark, monkeypatch):
    net, _, _ = build(spark, Y)
    keys = raster.KEYS
    found = rows(pairs.first_meet_pairs(net), *keys)
    image = raster.patches(pairs.first_meet_pairs(net), net, 32).first()["pixels"]
    monkeypatch.setattr(pairs, "HEADS_IN_BLOCK", 1)
    monkeypatch.setattr(raster, "TILE", 2)
    again = pairs.first_meet_pairs(net)
    assert rows(again, *keys) == found and again.count() == len(found)
    assert raster.patches(again, net, 32).first()["pixels"] == image
