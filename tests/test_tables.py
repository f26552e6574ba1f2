import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from thalweg import cli
from thalweg.functions import geo
from thalweg.operators import cnn, grid, labels, raster, sampling, stats
from thalweg.sources import basins, files

PAIR = "basin string, outlet long, confluence long, head_1 long, head_2 long, y int, L_1 double, L_2 double, headhead_dist_m double"


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_units_and_angles(spark):
    lit = F.lit
    assert one(spark, geo.meters_per_degree(lit(0.0))) == pytest.approx(math.sqrt(111_320 * 110_540))
    assert one(spark, geo.meters_per_degree(lit(-36.7))) == pytest.approx(one(spark, geo.meters_per_degree(lit(36.7))))
    assert one(spark, geo.angle_between(lit(1.0), lit(0.0), lit(0.0), lit(2.0))) == pytest.approx(90)
    assert one(spark, geo.angle_between(lit(0.0), lit(0.0), lit(0.0), lit(2.0))) is None
    assert [one(spark, geo.azimuth(lit(x), lit(y))) for x, y in ((0.0, 1.0), (1.0, 0.0), (0.0, -1.0), (-1.0, 0.0))] == pytest.approx([0, 90, 180, 270])
    assert one(spark, geo.azimuth(lit(0.0), lit(0.0))) is None
    assert one(spark, geo.azimuth_difference(lit(350.0), lit(10.0))) == pytest.approx(20)
    assert one(spark, geo.delta_l(lit(0.0), lit(0.0))) == 0 and one(spark, geo.delta_l(lit(1.0), lit(3.0))) == 1.0
    assert one(spark, geo.length_ratio(lit(2.0), lit(4.0))) == 0.5 and one(spark, geo.length_ratio(lit(0.0), lit(0.0))) is None
    assert [one(spark, geo.round_even(lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert one(spark, geo.asymmetry_scale(lit(10.0), lit(30.0))) == 1.0 and one(spark, geo.geometry_scale(lit(10.0), lit(30.0))) == 30.0
    assert one(spark, geo.rotation_angle(*[lit(float(v)) for v in (0, 0, 0, 0, 0, 0)])) == 0.0


def test_lines_against_the_error_accumulator(spark):
    def walk(r0, c0, r1, c1):
        dr, dc, r, c = abs(r1 - r0), abs(c1 - c0), r0, c0
        steep, out = dr > dc, []
        major, minor = max(dr, dc), min(dr, dc)
        err = 2 * minor - major
        for _ in range(major + 1):
            out.append((r, c))
            if err >= 0 and major:
                r, c = (r, c + (c1 > c0) - (c1 < c0)) if steep else (r + (r1 > r0) - (r1 < r0), c)
                err -= 2 * major
            r, c = (r + (r1 > r0) - (r1 < r0), c) if steep else (r, c + (c1 > c0) - (c1 < c0))
            err += 2 * minor
        return out

    ends = [(0, 0, r, c) for r in range(-6, 7) for c in range(-6, 7)]
    df = spark.createDataFrame(ends, "a long, b long, c long, d long").select("c", "d", geo.line_pixels(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("p"), geo.line_pixels(F.col("a"), F.col("b"), F.col("c"), F.col("d"), True).alias("q"))
    for r in df.collect():
        line = [(p["r"], p["c"]) for p in r["p"]]
        assert line == walk(0, 0, r["c"], r["d"]) and [(p["r"], p["c"]) for p in r["q"]] == line[1:-1]


def test_hard_negatives_by_length(spark):
    df = spark.createDataFrame([("b", 1, 1, 10 + i, 20 + i, y, a, b, d) for i, (y, a, b, d) in enumerate([(1, 100.0, 100.0, 200.0), (0, 120.0, 130.0, 250.0), (0, 400.0, 450.0, 300.0), (0, 50.0, 60.0, 150.0)])], PAIR)
    assert {r["head_1"] for r in labels.filter_hard_negatives(df, 3, 10).collect()} == {10, 11, 13}
    assert labels.filter_hard_negatives(df.filter("y = 0"), 3, 10).count() == 3
    assert labels.filter_hard_negatives(df.filter("y = 1"), 3, 10).count() == 1
    assert labels.filter_hard_negatives(df, 3, 10, group="nowhere").count() == 3


def test_hard_negatives_by_distance_group_and_crossing(spark):
    df = spark.createDataFrame([("b", 1, 1, 10 + i, 20 + i, y, 100.0, 100.0, d) for i, (y, d) in enumerate([(1, 200.0), (0, 500.0), (0, 1500.0)])], PAIR)
    assert labels.filter_hard_negatives(df, 3, 5).count() == 2
    gone = spark.createDataFrame([("b", 11, 21), ("b", 10, 20)], "basin string, head_1 long, head_2 long")
    assert {r["head_1"] for r in labels.filter_hard_negatives(df, 3, 5, crossing=gone).collect()} == {10}
    both = df.union(df.select(F.lit("c"), "outlet", "confluence", "head_1", "head_2", "y", F.col("L_1") * 10, F.col("L_2") * 10, F.col("headhead_dist_m") * 10))
    assert labels.filter_hard_negatives(both, 3, 5, group="basin").count() == 4
    unknown = df.withColumns({"L_1": F.lit(None).cast("double"), "headhead_dist_m": F.lit(None).cast("double")})
    assert labels.filter_hard_negatives(unknown, 3, 5).count() == 3


def test_quotas_sum_up(spark):
    n = {"a": (7, 10), "b": (5, 33), "c": (2, 21), "d": (0, 3)}
    data = [(b, 1, 1, i, i, y, 1.0, 1.0, 1.0) for b, (p, q) in n.items() for y, k in ((1, p), (0, q)) for i in range(k)]
    df = spark.createDataFrame(data, PAIR)
    for ratio in (0.5, 1.0, 2.0, 9.0):
        quota = {r["basin"]: r["quota"] for r in labels.negative_quotas(df, ratio).collect()}
        assert sum(quota.values()) == min(int(14 * ratio), 67) and all(quota[b] <= n[b][1] for b in n)
        assert labels.stratified_negatives(df, ratio).count() == 14 + sum(quota.values())


def test_merges_keep_the_left_rows(spark):
    base = spark.createDataFrame([("b", 1, 1, 1, 2, True), ("b", 1, 1, 1, 3, False)], "basin string, outlet long, confluence long, head_1 long, head_2 long, touching boolean")
    emb = spark.createDataFrame([("b", 1, 1, 1, 2, 0.5, 7)], "basin string, outlet long, confluence long, head_1 long, head_2 long, emb_0 double, other int")
    got = labels.merge_embeddings(base, emb)
    assert got.columns[-1] == "emb_0" and got.count() == 2 and got.filter("emb_0 is null").count() == 1
    assert [r["y"] for r in labels.labelled_dataset(base).orderBy("head_2").collect()] == [1, 0]
    assert labels.labelled_dataset(base.limit(0)).columns[-1] == "y"
    geom = emb.select(*labels.KEYS, F.lit(1.0).alias("apex_angle_deg"))
    assert {"apex_angle_deg_x", "apex_angle_deg_y"} <= set(labels.merge_geometry(base.withColumn("apex_angle_deg", F.lit(0.0)), geom).columns)
    old = base.withColumn("v", F.lit(1.0))
    new = emb.select(*labels.KEYS, F.lit(2.0).alias("v"))
    assert [r["v"] for r in labels.update_from(old, new, ["v"]).orderBy("head_2").collect()] == [2.0, 1.0]


def test_clean_pairs(spark):
    df = spark.createDataFrame([(1, 1, 5, 2, 10.0, 20.0, 3)], "outlet long, confluence long, head_1 long, head_2 long, L_1 double, L_2 double, overlap_px int")
    r = labels.clean_pairs(df).first()
    assert (r["head_1"], r["head_2"], r["L_1"], r["L_2"], r["basin"], r["qc_flags"]) == (2, 5, 20.0, 10.0, "unknown", "") and "overlap_px" not in r.asDict()
    with pytest.raises(ValueError):
        labels.clean_pairs(df.drop("outlet"))
    marked = cli.enrich(df, {}).first()
    assert marked["qc_flags"] == "missing_stream"


def test_statistics_with_unknown_values(spark):
    df = spark.createDataFrame([(0.1,), (None,), (0.3,), (None,), (0.5,)], "x double")
    r = stats.five_numbers(df, "x").first()
    assert r["count"] == 3 and r["median"] == pytest.approx(0.3) and r["mean"] == pytest.approx(0.3) and r["std"] == pytest.approx(np.std([0.1, 0.3, 0.5]))
    assert stats.five_numbers(df.limit(0), "x").first()["count"] == 0
    assert stats.histogram(df, "x", 2).agg(F.sum("n")).first()[0] == 3


def test_metrics(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, score double")
    assert stats.roc_auc(df).first()["auc"] == pytest.approx(0.75)
    assert stats.average_precision(df).first()["average_precision"] == pytest.approx(0.8333333)
    assert stats.ks_two_sample(df).first()["ks"] == pytest.approx(0.5)
    assert stats.best_threshold(df).first()["threshold"] == 0.8
    assert stats.roc_auc(df.filter("y = 1")).first()["auc"] is None
    c = stats.confusion(df, 0.5).first()
    assert (c["tp"], c["fp"], c["fn"], c["tn"]) == (1, 0, 1, 2) and c["precision"] == 1.0


def test_splits_keep_groups_together(spark):
    df = spark.range(500).select((F.col("id") % 40).alias("g"), "id")
    assert sampling.group_split(df, ["g"]).groupBy("g").agg(F.count_distinct("is_test").alias("n")).filter("n > 1").count() == 0
    folds = sampling.group_folds(df, "g", 5)
    assert folds.count() == 500 and folds.select("fold").distinct().count() == 5 and folds.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert sampling.sample_per_group(df, "g", 3, ["id"]).count() == 120
    assert sampling.sample_rows(df, 7, ["id"]).count() == 7


def test_configuration(spark):
    assert basins.lookup("Taiwan")["z_th"] == 80 and basins.lookup("CalnAlpine")["name"] == "clanalpine"
    with pytest.raises(KeyError, match="taiwan"):
        basins.lookup("atlantis")
    assert basins.output_folder("r", "inyo", "v2", 500) == "r/inyo/v2_th500" and basins.output_folder("r", "inyo") == "r/inyo"
    assert basins.resolve_raster("INYO", "f", {"inyo": "x.tif"}, lambda p: False) == "x.tif"
    assert basins.resolve_raster("/a/b.tif", "f", {}, lambda p: p == "f/b.tif") == "f/b.tif"
    with pytest.raises(FileNotFoundError):
        basins.resolve_raster("b", "f", {}, lambda p: False)


def tiff(values, end="<"):
    """A plain float raster in one strip."""
    rows, cols = values.shape
    data = values.astype(f"{end}f4").tobytes()
    tags = [(256, 4, cols), (257, 4, rows), (258, 3, 32), (259, 3, 1), (273, 4, 8), (277, 3, 1), (278, 4, rows), (279, 4, len(data)), (339, 3, 3)]
    entry = lambda t, k, v: struct.pack(end + "HHI", t, k, 1) + struct.pack(end + ("I" if k == 4 else "H2x"), v)
    return (b"II" if end == "<" else b"MM") + struct.pack(end + "HI", 42, 8 + len(data)) + data + struct.pack(end + "H", len(tags)) + b"".join(entry(*t) for t in tags) + bytes(4)


@pytest.mark.parametrize("end", "<>")
def test_rasters(spark, tmp_path, end):
    z = np.array([[5.0, 3.0, np.nan], [4.0, 1.0, -9.0]])
    (tmp_path / "Some_strm_crop.tif").write_bytes(tiff(z, end))
    cells = {(r["r"], r["c"]): r["z"] for r in files.read_rasters(spark, str(tmp_path), nodata=-9.0).collect()}
    assert cells == {(0, 0): 5.0, (0, 1): 3.0, (0, 2): None, (1, 0): 4.0, (1, 1): 1.0, (1, 2): None}
    assert files.list_rasters(spark, str(tmp_path)).first()["name"] == "some"


def test_command(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "a.tif").write_bytes(tiff(rng.random((40, 40))))
    out = str(tmp_path / "out")
    assert cli.main([str(tmp_path / "a.tif"), "-o", out, "--threshold", "3"]) == 0
    assert spark.read.option("header", True).csv(out).count() > 0
    assert cli.main([str(tmp_path / "none.tif"), "-o", out]) == 1
    assert cli.main([str(tmp_path / "a.tif"), "-o", out, "--threshold", "100000"]) == 2


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan"))], "k int, x double")
    for name in ("one", "two", "experiments"):
        files.write_results(df.coalesce(1), str(tmp_path / name / "full_features.csv"))
    back = files.read_results(spark, str(tmp_path / "one" / "full_features.csv"), "k int, x double")
    assert {(r["k"], r["x"]) for r in back.collect()} == {(1, 0.5), (2, None)}
    files.write_by_basin(df.withColumn("basin", F.lit("one")), str(tmp_path / "by"))
    done = files.completed_basins(spark, str(tmp_path / "by"))
    work = spark.createDataFrame([("one",), ("two",)], "basin string")
    assert [r["basin"] for r in files.remaining(work, done).collect()] == ["two"]
    assert files.completed_basins(spark, str(tmp_path / "nothing")).count() == 0
    files.write_metadata(spark, str(tmp_path / "meta"), {"a": 1})
    assert spark.read.text(str(tmp_path / "meta")).first()[0] == '{"a": 1}'


def test_discovery_takes_the_basin_from_the_folder(spark, tmp_path):
    for name in ("inyo", "experiments"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "full_features.csv").write_text("k,x\n1,0.5\n2,nan\n")
    got = files.discover_results(spark, str(tmp_path), "k int, x double")
    assert {(r["basin"], r["k"], r["x"]) for r in got.collect()} == {("inyo", 1, 0.5), ("inyo", 2, None)}


def test_saved_patches(spark, tmp_path):
    a = np.arange(16, dtype=np.uint8).reshape(4, 4) % 5
    np.save(tmp_path / "p.npy", a)
    r = files.read_patches(spark, str(tmp_path)).first()
    assert r["size"] == 4 and list(r["pixels"]) == a.ravel().tolist()


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_written_patches_are_read_again(spark, tmp_path, scheme):
    keys = "basin string, outlet long, confluence long, head_1 long, head_2 long"
    images = spark.createDataFrame([("b", 9, 5, 1, 2, 2, [0, 1, 2, 4]), ("c d", 9, 5, 1, 2, 2, [3, 3, 0, 0])], f"{keys}, size int, pixels array<tinyint>")
    pairs = images.select("basin", "outlet", "confluence", "head_1", "head_2").union(spark.createDataFrame([("b", 9, 5, 1, 3)], keys))
    for _ in range(2):  # once more changes nothing
        made = files.patch_manifest(pairs, files.write_patches(images, f"{scheme}{tmp_path}"))
        got = {(r["basin"], r["head_2"]): r["raster_path"] for r in made.collect()}
    assert got == {("b", 2): f"{scheme}{tmp_path}/b/rasters/9_1_2.npy", ("c d", 2): f"{scheme}{tmp_path}/c d/rasters/9_1_2.npy", ("b", 3): None}
    assert np.load(tmp_path / "b/rasters/9_1_2.npy").tolist() == [[0, 1], [2, 4]]
    assert sorted(list(r["pixels"]) for r in files.read_patches(spark, str(tmp_path)).collect()) == [[0, 1, 2, 4], [3, 3, 0, 0]]
    assert not list(tmp_path.glob("*/rasters/.[0-9a-f]*"))


def test_missing_results(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.read_results(spark, str(tmp_path / "none.csv"), "x double")


def test_broken_patches_and_target_correlations(spark):
    seen = spark.createDataFrame([("a", True, True), ("a", False, True), ("b", True, False), ("b", False, False), ("a", True, True)], "basin string, a_connected boolean, b_connected boolean")
    assert [tuple(r) for r in raster.broken_profile(seen).collect()] == [("b", 2, 2, 100.0), ("a", 3, 1, pytest.approx(100 / 3))]
    df = spark.createDataFrame([(1.0, 3.0, 1.0, 0), (2.0, 1.0, None, 0), (3.0, 2.0, None, 1), (4.0, -9.0, 1.0, None)], "x double, z double, u double, y int")
    got = stats.target_correlations(df, ["z", "u", "x"], "y").collect()
    assert [r["column"] for r in got] == ["x", "z", "u"] and got[2]["corr"] is None
    assert got[0]["corr"] == pytest.approx(np.corrcoef([1, 2, 3], [0, 0, 1])[0, 1])


def test_basin_summary_with_configuration(spark):
    pairs = spark.createDataFrame([("Inyo", True, 0.5), ("Inyo", False, 0.1), ("elsewhere", True, 0.2)], "basin string, touching boolean, delta_L double")
    got = {r["basin"]: r for r in stats.basin_summary(pairs, pairs, basins.basin_config(spark)).collect()}
    assert got["Inyo"]["config_num_pairs"] == 2419 and got["Inyo"]["n_pairs"] == 2 and got["elsewhere"]["config_lat"] is None


def test_network_forward_and_training():
    rng = np.random.default_rng(0)
    patches = rng.integers(0, 5, (12, 16, 16))
    w = cnn.initial_weights()
    e = cnn.embed(patches, w)
    assert e.shape == (12, 4) and (e >= 0).all()
    assert np.allclose(np.concatenate([cnn.embed(patches[:5], w), cnn.embed(patches[5:], w)]), e, atol=1e-5)
    x = cnn.pooled_features(cnn.one_hot(patches), w)
    y = (x[:, 0] > np.median(x[:, 0])).astype(int)
    trained = cnn.train_head(x, y, w, validation=0.0, epochs=200, rate=0.05)
    loss = lambda q: np.mean(np.logaddexp(0, -(2 * y - 1) * cnn.logits(np.maximum(x @ q["embed.w"].T + q["embed.b"], 0), q)))
    assert loss(trained) < loss(w)
    flipped = cnn.flip(patches, rng)
    assert (np.sort(flipped.reshape(12, -1)) == np.sort(patches.reshape(12, -1))).all()


def test_flow_directions(spark):
    z = [[9.0, 8.0, 9.0], [7.0, 5.0, 7.0], [9.0, 1.0, 9.0]]
    cells = spark.createDataFrame([("b", r * 3 + c, r, c, z[r][c]) for r in range(3) for c in range(3)], "basin string, cell_id long, r long, c long, z double")
    got = {r["cell_id"]: r["down_id"] for r in grid.flow_directions(cells, 3).collect()}
    assert got[4] == 7 and 7 not in got and got[1] == 4 and got[0] == 4
    assert grid.mask_below(cells, 7.0).filter("z is null").count() == 2


def test_arrivals(spark, tmp_path):
    from thalweg.streaming.basins import process_arrivals

    source = str(tmp_path / "in")
    cells = spark.range(20).select(F.lit("b").alias("basin"), F.col("id").alias("cell_id"), F.col("id").alias("r"), F.lit(0).cast("long").alias("c"), F.col("id").cast("double").alias("z"))
    cells.write.parquet(source)
    process_arrivals(spark, source, str(tmp_path / "out"), str(tmp_path / "cp"), grid.grid_stats).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).first()["n_rows"] == 20


def test_enrichment_command(spark, tmp_path):
    rng = np.random.default_rng(3)
    (tmp_path / "inyo.tif").write_bytes(tiff(rng.random((40, 40))))
    found = cli.couple(spark, str(tmp_path / "inyo.tif"), 3, 8, None, None)
    pairs = found.select(F.lit("inyo").alias("basin"), "outlet", "confluence", "head_1", "head_2", F.lit(2.0).alias("L_1"), F.lit(3.0).alias("L_2"), F.lit(36.7).alias("lat"), F.lit(0.0).alias("z_th"), F.lit("").alias("qc_flags"))
    lost = pairs.limit(1).withColumn("basin", F.lit("nowhere"))
    files.write_results(pairs.union(lost), str(tmp_path / "in"))
    assert cli.enrich_main(["--input", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--rasters", str(tmp_path), "--threshold", "3"]) == 0
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.count() == found.count() + 1 and back.filter("basin = 'nowhere' and qc_flags = 'missing_stream'").count() == 1
    assert back.filter("basin = 'inyo' and headhead_dist_norm is not null").count() == found.count()


def test_saved_models_and_reports(spark, tmp_path):
    from thalweg.operators import ml

    df = spark.range(200).select((F.col("id") % 4).cast("string").alias("basin"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1) * 0.5).alias("a"), F.when(F.col("id") % 7 == 0, None).otherwise(F.rand(2)).alias("b"))
    model = ml.fit_trees(df, ["a", "b"], rounds=3, depth=2)
    ml.save_model(model, str(tmp_path / "m"), ["a", "b"], 0.4)
    again, features, threshold = ml.load_model(str(tmp_path / "m"))
    assert features == ["a", "b"] and threshold == 0.4
    scored = ml.predict(again, df, features)
    assert stats.roc_auc(scored).first()["auc"] > 0.95 and ml.importances(again, features)[0][0] == "a"
    report = ml.group_metrics(scored, least=10).collect()
    assert len(report) == 4 and {r["auc"] for r in report} == {None}
    assert len(ml.random_grid({"x": [1, 2, 3], "z": [1, 2]}, 4)) == 4
    runs = spark.createDataFrame([("a", None, 5), ("b", "no raster", None)], "basin string, error string, n_pairs int")
    assert tuple(stats.failures(runs).first()) == (1, 1, 5)


def test_default_ratios_of_hard_negatives(spark):
    rows = [("b", 1, 1, 1, 2, 1, 10.0), ("b", 1, 1, 3, 4, 0, 50.0), ("b", 1, 1, 5, 6, 0, 50.1)]
    df = spark.createDataFrame(rows, "basin string, outlet long, confluence long, head_1 long, head_2 long, y int, headhead_dist_m double")
    assert {r["head_1"] for r in labels.filter_hard_negatives(df).collect()} == {1, 3}


def test_windows_that_look_alike_are_convolved_once(monkeypatch):
    """Stretched patches give the same features as the plain network, from few of their windows; noise does too."""
    rng, done = np.random.default_rng(4), []
    plain, w = cnn._block, cnn.initial_weights()
    w |= {"bn2.gain": -w["bn2.gain"], "bn1.shift": w["bn1.shift"] + 0.3}
    monkeypatch.setattr(cnn, "_block", lambda x, i, w: done.append(len(x)) or plain(x, i, w))
    coarse = np.where(rng.random((6, 8, 8)) < 0.2, rng.integers(0, 5, (6, 8, 8)), 0)
    for patches, most in ((coarse.repeat(16, axis=1).repeat(16, axis=2), 0.1), (rng.integers(-1, 6, (3, 19, 26)), 1.0)):
        done.clear()
        assert np.allclose(cnn.class_features(patches, w), cnn.pooled_features(cnn.one_hot(patches), w), atol=1e-5)
        n, h, v = patches.shape
        assert sum(done) <= most * n * sum((h >> i) * (v >> i) for i in (1, 2, 3))
