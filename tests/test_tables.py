"""Table operators: key semantics, hot groups, quirks, invariants, files."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cytoframe.functions import names as N
from cytoframe.functions import paths as PA
from cytoframe.functions import scalars as S
from cytoframe.operators import columns as C
from cytoframe.operators import joins as J
from cytoframe.operators import models as M
from cytoframe.operators import neighbours as NB
from cytoframe.operators import quality as Q
from cytoframe.operators import ranks as RK
from cytoframe.operators import resample as R
from cytoframe.operators import reshape as RS
from cytoframe.operators import stats as ST
from cytoframe.plans import cell_table as CT
from cytoframe.sources import readers as SR
from cytoframe.sources import writers as SW


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


# ---------------------------------------------------------------- joins

@pytest.mark.parametrize("how", ["inner", "left", "outer"])
@pytest.mark.parametrize("many", ["left", "right"])
def test_merge_matches_pandas(spark, how, many):
    left = pd.DataFrame({"k": [1, 1, 2, None, None, 5], "j": [0, 0, 1, 1, None, 0],
                         "a": [1, 2, 3, 4, 5, 6]})
    right = pd.DataFrame({"k": [1, 2, None, None, 7], "j": [0, 1, 1, None, 0],
                          "b": [10, 20, 30, 40, 50]})
    want = left.merge(right, how=how)
    make = lambda d, s: table(
        spark, [tuple(None if pd.isna(v) else int(v) for v in r) for r in d.values], s)
    got = J.merge(make(left, "k int, j int, a int"), make(right, "k int, j int, b int"), None, how,
                  many=many)
    assert got.columns == list(want.columns)
    clean = [tuple(None if pd.isna(v) else int(v) for v in r) for r in want.values]
    assert values(got, *got.columns) == sorted(clean, key=repr)


def test_merge_suffixes_and_plain_keys(spark):
    a = table(spark, [(1, "x"), (None, "y")], "k int, v string")
    b = table(spark, [(1, "z"), (None, "w")], "k int, v string")
    assert values(J.merge(a, b, ["k"], "inner", nulls_match=False), "k", "v_x", "v_y") == [(1, "x", "z")]
    assert J.merge(a, b, ["k"]).count() == 2
    with pytest.raises(ValueError):
        J.merge(a, b.withColumnsRenamed({"k": "q", "v": "u"}))


def test_flags(spark):
    a = table(spark, [(1,), (2,), (None,)], "k int")
    b = table(spark, [(2,), (9,)], "k int")
    assert values(J.outer_flag(a, b, ["k"], "hit"), "k", "hit") == [
        (1, False), (2, True), (9, True), (None, False)]
    assert values(J.membership(a, "k", b, "in"), "k", "in") == [(1, False), (2, True), (None, False)]
    assert values(J.membership(a, "k", None, "in"), "in") == [(None,)] * 3


def test_first_match_and_conservation(spark):
    cells = table(spark, [(1,), (2,), (3,)], "k int")
    lookup = table(spark, [(1, 5, "b"), (1, 4, "a"), (2, 9, "c")], "k int, o int, v string")
    assert values(J.first_match(cells, lookup, ["k"], ["o"]), "k", "v") == [(1, "a"), (2, "c"), (3, None)]
    assert J.conservation(cells, lookup, ["k"]).first()["missing_rows"] == 1
    assert J.conservation(cells, cells, ["k"]).first()["conserved"]


# ---------------------------------------------------------------- hot groups

def hot_table(spark):
    """Group 0 holds most rows, with many ties and a heavy tail."""
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.integers(0, 40, 3000), rng.exponential(1e6, 2000), [-5.0, 0.0]])
    k = np.concatenate([np.zeros(4500, dtype=int), rng.integers(1, 5, 502)])
    pdf = pd.DataFrame({"k": k, "v": v, "id": np.arange(len(v))})
    return pdf, spark.createDataFrame(pdf).repartition(16)


def test_quantiles_are_exact_in_a_hot_group(spark):
    pdf, df = hot_table(spark)
    probs = {"p0": 0.0, "p1": 0.013, "p50": 0.5, "p97": 0.975, "p100": 1.0}
    got = {r["k"]: r for r in RK.group_quantiles(df, ["k"], "v", probs).collect()}
    for k, part in pdf.groupby("k"):
        for name, p in probs.items():
            assert got[k][name] == pytest.approx(part["v"].quantile(p), rel=1e-12)
    assert ST.global_median(df, "v") == pytest.approx(pdf["v"].median())


def test_weighted_quantiles_equal_repeated_rows(spark):
    df = table(spark, [("a", 1.0, 3), ("a", 2.0, 1), ("a", 10.0, 2)], "k string, v double, w int")
    got = RK.group_quantiles(df, ["k"], "v", {"m": 0.5, "q": 0.75}, "w").first()
    want = np.quantile([1, 1, 1, 2, 10, 10], [0.5, 0.75])
    assert (got["m"], got["q"]) == tuple(want)


def test_ranks_and_index_in_a_hot_group(spark):
    pdf, df = hot_table(spark)
    ranks = {(r["k"], r["v"]): r["r"] for r in RK.average_ranks(df, ["k"], "v", "r").collect()}
    want = pdf.groupby("k")["v"].rank(method="average")
    assert all(ranks[k, v] == w for k, v, w in zip(pdf["k"], pdf["v"], want))
    index = {r["id"]: r["i"] for r in RK.sequential_index(df, "id", "i", ["k"]).collect()}
    want = pdf.groupby("k").cumcount() + 1
    assert all(index[i] == w for i, w in zip(pdf["id"], want))


def test_kth_smallest(spark):
    df = table(spark, [("a", 5), ("a", 3), ("a", 3), ("b", 1)], "k string, v int")
    want = table(spark, [("a", 3), ("b", 1)], "k string, n int")
    assert values(RK.kth_smallest(df, ["k"], "v", want, "n", "cut"), "k", "cut") == [("a", 5), ("b", 1)]


# ---------------------------------------------------------------- shaping and quirks

def test_columns(spark):
    df = table(spark, [(1, 2, 3)], "`a.x` int, b int, c int")
    assert C.add_prefix(df, "p_", ["c"]).columns == ["p_a.x", "p_b", "c"]
    assert C.order_columns(df, ["c", "gone"], ["b"]).columns == ["c", "b", "a.x"]
    assert C.rename_substrings(df, {"a": "b", "b": "q"}).columns == ["q.x", "q", "c"]
    with pytest.raises(Exception, match="missing value"):
        C.require_integers(table(spark, [(None,)], "n double"), ["n"]).collect()


def test_later_pair_wins_when_both_probes_are_equal(spark):
    df = table(spark, [("A", "A", 1.0, 2.0), ("A", None, 3.0, None)], "p string, q string, x double, y double")
    assert values(RS.widen(df, [("p", "x"), ("q", "y")], ["A"]), "A_count") == [(2.0,), (3.0,)]
    assert RS.distinct_names(df, ["p", "q"]) == ["A"]
    with pytest.raises(ValueError):
        RS.distinct_names(df, ["p"], most=0)


def test_tidy_has_two_rows_per_cell(spark):
    rows = [(i, "A", "BC"[i % 2], float(i), float(-i)) for i in range(1, 9)]
    df = table(spark, rows, "id int, p string, q string, x double, y double")
    wide = RS.widen_from_data(df, [("p", "x"), ("q", "y")])
    long = RS.tidy(wide, [c for c in wide.columns if c.endswith("_count")])
    assert long.count() == 2 * wide.count()
    back = {(r["id"], r["FISH_probe"]): r["FISH_probe_count"] for r in long.collect()}
    assert back[3, "A"] == 3.0 and back[3, "C"] == -3.0


def test_missing_scores_are_kept(spark):
    df = table(spark, [(0, 2), (3, None), (-1, 1), (2, 5)], "m int, k int")
    assert values(Q.drop_scored(df, ["m", "k"]), "m", "k") == [(2, 5), (3, None)]
    assert values(Q.drop_scored(df, ["m", "k"], exclude=[5]), "m") == [(-1,), (0,), (3,)]


def test_pruning(spark):
    df = table(spark, [(1.0, None, 1.0), (1.0, 2.0, None), (1.0, 3.0, 1.0), (1.0, 4.0, 1.0)],
               "a double, b double, c double")
    pruned, kept = Q.prune_missing(df, ["a", "b", "c"], 0.25)
    assert kept == ["a"] and pruned.columns == ["a"]
    assert Q.prune_missing(df, ["a", "b", "c"], 0.3, "rows")[0].count() == 2
    with pytest.raises(ValueError):
        Q.prune_missing(df, ["a"], axis="both")
    assert Q.low_variance_columns(df.withColumn("g", F.lit(1)), ["g"], ["a", "b"]) == ["a"]


def test_null_error_marks_are_no_failure_unless_asked(spark):
    df = table(spark, [(1, 1.0), (2, None), (3, 0.0)], "ImageNumber int, ModuleError_x double")
    assert values(Q.failed_images(df), "ImageNumber") == [(1,)]
    assert values(Q.failed_images(df, null_is_failure=True), "ImageNumber") == [(1,), (2,)]


def test_scalars(spark):
    df = table(spark, [(0.5, "3", 0.0), (1.5, "b", 2.0), (9.0, "x", 4.0)], "v double, m string, a double")
    rows = df.select(
        S.rounded_score("v").alias("r"), S.clean_score("m").alias("c"), S.ratio("v", "a").alias("q"),
        S.mean_or_null("v", F.lit(None)).alias("n"), S.mean_of_present("v", F.lit(None)).alias("p"),
    ).collect()
    assert [r["r"] for r in rows] == [1, 2, 5]
    assert [r["c"] for r in rows] == [2, None, None]
    assert [r["q"] for r in rows] == [None, 0.75, 2.25]
    assert rows[0]["n"] is None and rows[0]["p"] == 0.5


def test_names(spark):
    raw = "20190807_M01_XS2_more E5 [144]_x-P12_C0.tif"
    df = table(spark, [(raw,)], "n string")
    assert df.select(N.field_file_name("n").alias("f")).first()["f"] == "5500000013_63X_20190807_S2_P12_E5"
    slug = table(spark, [("A b  (c)/d",)], "n string").select(N.slug("n").alias("s")).first()["s"]
    assert slug == "a_b__c_d"  # double underscores collapse once
    assert N.without_amplifier("MYH6-B1_count") == "MYH6_count"
    var = N.feature_dimension(spark, ["finalnuc_Mean_probe_638_Count", "napariCell_AreaShape_Area"])
    assert values(var, "region", "channel", "type", "probe_wavelength") == [
        ("cell", "segmentation", "shape", None), ("nuclear", "FISH", "count", "638")]


def test_image_set_kinds(spark):
    df = table(spark, [("a/b.tif", 1)], "path string, i int")
    other = PA.image_set(df, "path", "i", "/r", "nonstructure")
    assert "URL_probe_488" in other.columns and "URL_structure" not in other.columns
    assert other.first()["PathName_nuc"] == "/r/a"
    with pytest.raises(ValueError):
        PA.image_set(df, "path", "i", "/r", "other")


# ---------------------------------------------------------------- statistics and models

def test_flat_columns_are_not_scaled(spark):
    df = table(spark, [(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    out, _ = ST.z_scores({"train": df}, ["a", "b"])
    assert values(out["train"], "a", "b") == [(-1.0, 0.0), (1.0, 0.0)]


def test_report_counts_an_unpredicted_label_as_zero(spark):
    df = table(spark, [("s", 1, 1), ("s", 2, 1), ("s", 1, 3)], "split string, true int, pred int")
    rows = {r["Reduction"]: r for r in ST.confusion_report(df, ["split"]).collect()}
    assert rows["macro avg"]["precision"] == pytest.approx(0.5 / 3)
    assert rows["weighted avg"]["recall"] == pytest.approx(1 / 3)
    assert rows["macro avg"]["support"] == 3


def test_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3)) * [1, 10, 0.1]
    y = rng.integers(1, 4, 200)
    counts = np.bincount(y)
    w = len(y) / counts[y]
    xm, ym = np.average(x, axis=0, weights=w), np.average(y, weights=w)
    xc, yc = x - xm, y - ym
    want = np.linalg.solve(xc.T @ (w[:, None] * xc) + 0.001 * np.eye(3), xc.T @ (w * yc))
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y))
    model = M.fit_ridge(df, ["a", "b", "c"], "y")
    assert np.allclose(model.coefficients, want)
    assert model.intercept == pytest.approx(ym - want @ xm)


def test_bootstrap_sizes_and_repeatability(spark):
    pdf, df = hot_table(spark)
    drawn = R.bootstrap_weights(df, ["k"], ["v"], "id", 4, seed=9)
    sizes = drawn.groupBy("k", "replicate").agg(F.sum("__w__").alias("n"))
    want = pdf.groupby("k").size()
    assert all(r["n"] == want[r["k"]] for r in sizes.collect())
    first = values(R.bootstrap(df, ["k"], "v", "id", "median", 3, 1), "k", "replicate", "stat")
    again = values(R.bootstrap(df.repartition(3), ["k"], "v", "id", np.median, 3, 1), "k", "replicate", "stat")
    assert first == again


def test_bootstrap_ridge_spreads_around_the_fit(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=300)
    y = np.clip(np.rint(2 + x + rng.normal(size=300) * 0.3), 0, 5)
    df = spark.createDataFrame(pd.DataFrame({"x": x, "y": y, "id": np.arange(300)}))
    boot = M.bootstrap_ridge(df, ["x"], "y", "id", 15, 3).toPandas()
    fit = M.fit_ridge(ST.apply_scaler(df, ST.scaler_params(df, ["x"]), ["x"]), ["x"], "y")
    assert len(boot) == 15
    assert abs(boot["coef"].mean() - fit.coefficients[0]) < 0.2 and boot["coef"].std() > 0


def test_stratified_split_keeps_shares(spark):
    pdf, df = hot_table(spark)
    out = R.stratified_split(df, "k", "id", 0.25, 3).toPandas()
    for k, part in out.groupby("k"):
        assert (part["split"] == "test").sum() == np.rint(len(part) * 0.25)
    assert len(out) == len(pdf)


def test_neighbours_are_exact_over_blocks(spark):
    rng = np.random.default_rng(6)
    train = np.concatenate([rng.normal(size=(120, 4)) * 0.01, rng.normal(size=(60, 4)) * 5])
    query = np.concatenate([rng.normal(size=(20, 4)) * 0.01, rng.normal(size=(15, 4)) * 5])
    names = list("abcd")
    make = lambda m: spark.createDataFrame(
        pd.DataFrame(m, columns=names).assign(id=np.arange(len(m))))
    got = NB.nearest_rows(make(train), make(query), names, "id", 3, pivots=7, block=25).toPandas()
    d = np.abs(query[:, None, :] - train[None]).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :3]
    got = got.sort_values(["id", "rank"])
    assert np.array_equal(got["neighbour"].to_numpy().reshape(-1, 3), want)


def test_classifier_grid_is_complete():
    kinds = [c["kind"] for c in M.classifier_grid()]
    assert {k: kinds.count(k) for k in set(kinds)} == {"dummy": 4, "logistic": 8, "knn": 5, "forest": 8}


def test_classifier_query_runs_all_sets_and_classifiers(spark, monkeypatch):
    """The query hands the full grid and all five sets on."""
    import catalog
    from catalog import resampling

    catalog.load()
    handed = {}

    def caught(splits, sets, y, key, grid, **other):
        handed.update(sets=sets, grid=grid)
        return splits["train"]

    monkeypatch.setattr(resampling.CL, "prepared_splits", lambda df, *a, **b: {"train": df})
    monkeypatch.setattr(resampling.CL, "predictions", caught)
    monkeypatch.setattr(resampling.CL, "report", lambda df: df)
    catalog.QUERIES["clf_grid"](spark, "/root/testdata/sf0.001")
    assert handed["grid"] == M.classifier_grid() and len(handed["grid"]) == 25
    assert set(handed["sets"]) == set(M.FEATURE_SETS) and all(handed["sets"].values())


# ---------------------------------------------------------------- merged cell table

def cell_files(tmp_path):
    files = {
        "Image": "ImageNumber,ObjectsPathName_napari_cell,ObjectsFileName_napari_cell,ModuleError_1,Count_nuc\n"
                 "1,/d,a.tif,0,2\n2,/d,b.tif,1,0\n3,/d,c.tif,,1\n",
        "FinalNuc": "ImageNumber,ObjectNumber,Parent_FilterNuc,AreaShape_Area\n1,1,11,50\n1,2,12,60\n1,3,13,70\n",
        "FinalNucBorder": "ImageNumber,ObjectNumber,Parent_FinalNuc\n1,1,1\n1,2,3\n",
        "napari_cell": "ImageNumber,ObjectNumber,AreaShape_Area,Children_NucCentroid_Count\n1,1,500,2\n1,2,600,0\n3,1,700,0\n",
        "NucCentroid": "ImageNumber,ObjectNumber,Parent_FilterNuc,Parent_napari_cell\n1,1,11,1\n1,2,12,1\n1,3,13,\n",
    }
    for name, text in files.items():
        (tmp_path / f"run_{name}.csv").write_text(text)
    return str(tmp_path)


def test_cell_table_from_files(spark, tmp_path):
    tables = SR.read_cell_tables(spark, cell_files(tmp_path), "run_")
    manifest = table(spark, [(1, "/raw/a", "a.tif"), (9, "/raw/z", "z.tif")],
                     "fov_id long, original_fov_location string, rescaled_2D_fov_tiff_path string")
    samples = table(spark, [("/raw/a", 1, "P1", 18, "n", "g")],
                    "fov_path string, FOVId long, plate_name string, cell_age int, notes string, ge_wellID string")
    border = table(spark, [(1, "/d/a.tif", "/raw/a", 2)],
                   "FOVId long, ImagePath string, fov_path string, napariCell_ObjectNumber long")
    out = CT.feature_table(tables, manifest, samples, border_cells=border, single_cells=False, root="/d")
    rows = {(r["ImageNumber"], r["napariCell_ObjectNumber"], r["finalnuc_ObjectNumber"]): r
            for r in out.collect()}
    # two nuclei in cell 1, a nucleus without cell, a cell without nucleus, an image without cells
    assert set(rows) == {(1, 1, 1), (1, 1, 2), (1, None, 3), (1, 2, None), (2, None, None), (3, 1, None)}
    assert rows[1, 1, 1]["finalnuc_border"] is False and rows[1, 1, 2]["finalnuc_border"] is True
    assert rows[1, 2, None]["cell_border"] and not rows[1, 1, 1]["cell_border"]
    assert rows[2, None, None]["ImageFailed"] and not rows[3, 1, None]["ImageFailed"]
    assert rows[1, 1, 1]["plate_name"] == "P1" and rows[3, 1, None]["plate_name"] is None
    assert out.columns[:4] == ["ImageNumber", "FOVId", "ImagePath", "ImageFailed"]
    assert not {"notes", "ge_wellID"} & set(out.columns)
    counts = CT.object_counts(tables["image"], out)
    assert {r["ImageNumber"]: r["Count_nuc"] for r in counts.collect()} == {1: 2, 2: 0, 3: 1}


# ---------------------------------------------------------------- files

def test_score_marks_stay_text(spark, tmp_path):
    (tmp_path / "f.csv").write_text("i,score,v\n0,n,1.5\n1,0,\n")
    df = SR.read_features(spark, str(tmp_path / "f.csv"), ["score"], ["i"])
    assert values(df, "i", "score", "v") == [(0, "n", 1.5), (1, "0", None)]
    nan = SR.nan_to_null(table(spark, [(float("nan"),), (1.0,)], "v double"))
    assert values(nan, "v") == [(1.0,), (None,)]


def test_field_results_with_absent_and_denied_files(spark, tmp_path):
    for fov in (3, 40, 51):
        (tmp_path / f"fov_{fov}.csv").write_text(f"cell,area\n1,{fov}0\n2,{fov}1\n")
    expected = table(spark, [(3,), (40,), (51,), (60,)], "FOVId long")
    found, absent = SR.read_field_results(
        spark, str(tmp_path), "cell int, area int", expected, deny=[40])
    assert values(found, "FOVId", "area") == [(3, 30), (3, 31), (51, 510), (51, 511)]
    assert values(absent, "FOVId") == [(60,)]


def test_label_lists_and_matrix_market(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 5 6\n1 7 8\n")
    (tmp_path / "b.txt").write_text("0 9 9\n")
    points = SR.read_label_lists(spark, [str(tmp_path / "a.txt"), str(tmp_path / "b.txt")])
    assert values(points, "image", "r", "c", "class") == [(0, 5, 6, 0), (0, 9, 9, 1), (1, 7, 8, 0)]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n%\n3 2 3\n1 1 4\n3 1 2\n2 2 9\n")
    counts = SR.read_matrix_market(spark, str(tmp_path / "m.mtx"))
    genes = table(spark, [(0, "G0"), (1, "G1"), (2, "G2")], "row long, gene string")
    cells = table(spark, [(0, "C0"), (1, "C1")], "col long, cell string")
    named = SR.named_counts(counts, genes, cells)
    assert values(named, "gene", "cell", "count") == [("G0", "C0", 4), ("G1", "C1", 9), ("G2", "C0", 2)]
    assert SR.sample_cells(named, 1).select("cell").distinct().count() == 1


def test_publish_and_catalog(spark, tmp_path):
    df = table(spark, [(1, "p"), (2, None)], "id int, path string")
    SW.publish(SW.complete_rows(df, ["path"]), str(tmp_path / "o/one"), "v1", ["id"], ["path"], "text")
    assert values(SR_read(spark, tmp_path / "o/one"), "id") == [(1,)]
    about = spark.read.parquet(str(tmp_path / "o/one/about")).first()
    assert (about["version"], about["readme"]) == ("v1", "text")
    with pytest.raises(ValueError, match="not in the table"):
        SW.publish(df, str(tmp_path / "x"), "v1", ["gone"])
    names = table(spark, [("o/one",), ("p/one",)], "dataset string")
    with pytest.raises(ValueError, match="not unique"):
        SW.catalog(names, {}, names)
    with pytest.raises(ValueError, match="does not exist"):
        SW.catalog(names, {"p/one": "two"}, names.where("dataset = 'o/one'"))
    entries = SW.catalog(names.where("dataset = 'o/one'"), {"o/one": "first"}, names)
    assert SW.consolidate(spark, entries, str(tmp_path), str(tmp_path / "all")) == {"first": 1}
    assert SW.read_latest(spark, str(tmp_path / "all/first")).count() == 1


def test_only_changed_parts_are_published(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = [(i, f"v{i}", {"k": i}) for i in range(400)]
    df = table(spark, rows, "id int, v string, m map<string,int>")
    assert SW.publish_changes(df, root, parts=10) == 10
    assert SW.publish_changes(df.repartition(7), root) == 0  # other order, other files, same rows
    files = {str(f) for f in (tmp_path / "t/data").rglob("*.parquet")}
    assert SW.publish_changes(df.where("id <> 17"), root) == 1
    assert files < {str(f) for f in (tmp_path / "t/data").rglob("*.parquet")}  # nothing is replaced
    assert sorted(r["id"] for r in SW.read_latest(spark, root).collect()) == [i for i in range(400) if i != 17]
    # a run that breaks off before its manifest leaves the version before it
    broken = df.withColumn("v", F.when(F.col("id") == 3, "new").otherwise(F.col("v")))
    plain = spark.__class__.createDataFrame
    with monkeypatch.context() as m:
        m.setattr(spark.__class__, "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            SW.publish_changes(broken, root)
    assert spark.__class__.createDataFrame is plain
    assert SW.read_latest(spark, root).where("v = 'new'").count() == 0 and SW.read_latest(spark, root).count() == 399
    assert SW.publish_changes(broken, root) >= 1
    assert SW.read_latest(spark, root).where("v = 'new'").count() == 1
    assert SW.publish_changes(df.limit(0), root) == 0 and SW.read_latest(spark, root).count() == 0
    assert SW.read_latest(spark, root).columns == ["id", "v", "m"]
    # repeated rows count
    twice = table(spark, [(1, "a", None)] * 2, "id int, v string, m map<string,int>")
    assert SW.publish_changes(twice, str(tmp_path / "u")) == 1 and SW.publish_changes(twice.limit(1), str(tmp_path / "u")) == 1


def SR_read(spark, path):
    return SW.read_published(spark, str(path))


def test_extracts_are_fixed(spark):
    df = spark.range(50).withColumn("g", F.col("id") % 7)
    assert values(SW.extract_rows(df, "id"), "id") == values(SW.extract_rows(df.repartition(5), "id"), "id")
    a, b = SW.extract_by_key(df, [df, df.where("id < 20")], "g", 2)
    assert a.select("g").distinct().count() == 2 and b.count() <= a.count()


def test_stored_tables_read_only_their_columns(spark):
    """A hot outer merge and the plot tables keep their inputs as Parquet, not as whole rows; a stored table is not written again."""
    from cytoframe.session import stored

    left = spark.createDataFrame([(1, "a", 2.0), (None, "b", 3.0)], "k int, s string, v double")
    once = stored(left)
    assert stored(once) is once and sorted(once.collect(), key=str) == sorted(left.collect(), key=str)
    merged = J.merge(left, spark.createDataFrame([(1, 5), (2, 6)], "k int, w int"), ["k"], "outer", many="left")
    plan = merged.select("k")._jdf.queryExecution().executedPlan().toString()
    assert "struct<k:int>" in plan and "v:double" not in plan
    assert sorted((r["k"] or 0, r["s"] or "", r["w"] or 0) for r in merged.collect()) == [(0, "b", 0), (1, "a", 5), (2, "", 6)]


def test_draws_meet_their_rows_without_a_second_exchange(spark, monkeypatch):
    """Draws are counted where their rows are: one exchange for the draws and one for the rows."""
    plans, plain = [], R.materialise

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(R, "materialise", kept)
    monkeypatch.setattr(R, "broadcast_within", lambda df: F.broadcast(plain(df)))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(200).selectExpr("cast(id % 3 as string) as k", "id as o", "cast(id as double) as v")
        drawn = R.bootstrap_weights(df, ["k"], ["v"], "o", 4, 1)
        assert drawn.agg(F.sum("__w__")).first()[0] == 800
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert plans[-1].count("Exchange hashpartitioning") == 2
