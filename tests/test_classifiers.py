"""The joint classifier comparison against plain versions of each model."""

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import classifiers as C
from cytoframe.operators import models as M
from cytoframe.operators import neighbours as NB
from cytoframe.plans import classify as CL


@pytest.fixture(scope="module")
def cells(spark):
    """Two probes with other class numbers, four features, three classes that overlap."""
    draw = np.random.default_rng(3)
    n = 240
    probe = np.where(np.arange(n) % 3 == 0, "p", "q")
    label = np.where(probe == "p", draw.integers(1, 4, n), draw.integers(2, 4, n))
    x = draw.normal(size=(n, 4)) + label[:, None] * [0.8, -0.5, 0.0, 0.3]
    data = pd.DataFrame(x, columns=list("abcd")).assign(id=np.arange(n), label=label, probe=probe)
    df = spark.createDataFrame(data).repartition(3)
    return data, {"train": df.where("id < 180"), "test": df.where("id >= 180")}


SETS = {"two": ["a", "b"], "all": list("abcd")}


def weights_of(y):
    values, counts = np.unique(y, return_counts=True)
    return values, (len(y) / (len(values) * counts))[np.searchsorted(values, y)]


def test_all_logistic_models_are_at_rest(cells):
    """At the minimum the gradient of the balanced, penalised loss is 0; all probes, sets and strengths are fitted at once."""
    data, splits = cells
    rows = C.cell_vectors(splits, list("abcd"), "label", "id", "probe", "train")
    at = {"two": [0, 1], "all": [0, 1, 2, 3]}
    found = C.logistic_models(rows.where("split = 'train'"), at, {"p": [1, 2, 3], "q": [2, 3]}, [1e-5, 0.1, 100.0])
    assert len(found) == 2 * 2 * 3
    for (probe, name, c), theta in found.items():
        part = data[(data["id"] < 180) & (data["probe"] == probe)]
        labels, w = weights_of(part["label"].to_numpy())
        x = np.column_stack([part[SETS[name]], np.ones(len(part))])
        score = x @ theta.T
        share = np.exp(score - score.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        hit = part["label"].to_numpy()[:, None] == labels
        slopes = theta.copy()
        slopes[:, -1] = 0
        gradient = ((share - hit) * w[:, None]).T @ x + slopes / c
        assert np.abs(gradient).max() < 1e-6 * len(part)


def test_cut_trees_predict_like_a_walk(spark, cells):
    """Every depth of one grown forest equals a node-by-node walk that stops there."""
    _, splits = cells
    rows = C.cell_vectors(splits, list("abcd"), "label", "id", "probe", "train")
    classes = {"p": [1, 2, 3]}
    forest = C.grown_forests(rows.where("split = 'train'"), {"all": [2, 0, 1, 3]}, classes, 6, 9, 0)["p", "all"]
    draw = np.random.default_rng(1)
    x = draw.normal(size=(50, 4))
    found = forest.predict(x, [1, 3, 6])
    assert set(found) == {1, 3, 6}
    for depth, got in found.items():
        for i in range(len(x)):
            votes = np.zeros(3)
            for node in forest.roots:
                for _ in range(depth):
                    if forest.feature[node] >= 0:
                        side = forest.left if x[i, forest.feature[node]] <= forest.limit[node] else forest.right
                        node = side[node]
                votes += forest.share[node]
            assert got[i] == votes.argmax()


def test_grid_predicts_every_row_once_per_model(cells):
    data, splits = cells
    grid = M.classifier_grid(test=True) + [{"name": "Dummy uniform", "kind": "dummy", "strategy": "uniform"}]
    made = CL.predictions(splits, SETS, "label", "id", grid, probe="probe", annotator=("Second", "label")).toPandas()
    assert not made.duplicated(["split", "probe", "features", "classifier", "id"]).any()
    assert len(made) == len(data) * 2 * (len(grid) + 1)
    assert made["pred"].notna().all()
    # the deepest model learns the separated training rows better than chance, on the right probe's classes
    assert set(made[made["probe"] == "q"]["pred"]) <= {2, 3}
    lr = made[made["classifier"].str.startswith("Logistic") & (made["split"] == "test")]
    assert (lr["true"] == lr["pred"]).mean() > 0.5


def test_one_search_serves_all_probes_sets_and_k(cells, monkeypatch):
    data, splits = cells
    searches = []
    search = C.nearest_vectors
    monkeypatch.setattr(C, "nearest_vectors", lambda *a, **b: searches.append(a[2]) or search(*a, **b))
    grid = [c for c in M.classifier_grid() if c["kind"] == "knn"]
    made = C.compared(splits, SETS, "label", "id", grid, probe="probe").toPandas()
    assert searches == [9]
    for (probe, name), part in made.groupby(["probe", "features"]):
        here = data[data["probe"] == probe]
        train = here[here["id"] < 180]
        d = np.abs(here[SETS[name]].to_numpy()[:, None] - train[SETS[name]].to_numpy()[None]).sum(axis=2)
        order = np.argsort(d, axis=1, kind="stable")
        for clf in grid:
            near = train["label"].to_numpy()[order[:, : clf["k"]]]
            want = dict(zip(here["id"], [np.bincount(v).argmax() for v in near]))
            got = part[part["classifier"] == clf["name"]]
            assert dict(zip(got["id"], got["pred"])) == want


def test_second_round_visits_few_cells(spark):
    """Clustered rows: far fewer distances than rows times queries are computed, and one hot cell is cut into blocks."""
    draw = np.random.default_rng(7)
    centre = draw.normal(size=(40, 3)) * 100
    rows = np.concatenate([centre[draw.integers(0, 40, 3000)] + draw.normal(size=(3000, 3)), np.zeros((900, 3))])
    asked = centre[draw.integers(0, 40, 300)] + draw.normal(size=(300, 3))
    make = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=list("abc")).assign(id=np.arange(len(m))))
    counted = spark.sparkContext.accumulator(0)
    got = NB.nearest_rows(make(rows), make(asked), list("abc"), "id", 5, pivots=64, block=200, evaluations=counted)
    got = got.toPandas().sort_values(["id", "rank"])
    d = np.abs(asked[:, None] - rows[None]).sum(axis=2)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert np.array_equal(got["neighbour"].to_numpy().reshape(-1, 5), want)
    assert 0 < counted.value < len(rows) * len(asked) / 5


def test_neighbours_from_several_shards_and_chunks(spark, monkeypatch):
    """A crowded cell lies in several shards, queries in chunks, far values and missing ones do not spoil the bounds."""
    monkeypatch.setattr(NB, "HELD_VALUES", 3000)
    monkeypatch.setattr(NB, "CHUNK", 64)
    draw = np.random.default_rng(8)
    rows = np.concatenate([draw.normal(size=(2600, 3)), np.full((40, 3), 0.25), [[1e6, 0, 0]]])
    asked = np.concatenate([draw.normal(size=(250, 3)), np.full((3, 3), 0.25), [[9e5, 0, 0]]])
    make = lambda m: spark.createDataFrame(pd.DataFrame(m, columns=list("abc")).assign(id=np.arange(len(m))))
    got = NB.nearest_rows(make(rows), make(asked), list("abc"), "id", 5, pivots=2, block=100).toPandas().sort_values(["id", "rank"])
    d = np.abs(asked[:, None] - rows[None]).sum(axis=2)
    assert np.array_equal(got["neighbour"].to_numpy().reshape(-1, 5), np.argsort(d, axis=1, kind="stable")[:, :5])


def test_coarse_distances_never_exceed_exact_ones():
    draw = np.random.default_rng(9)
    rows, asked = draw.normal(size=(4000, 64)), draw.normal(size=(40, 64))
    rows[:3] *= 50
    piece = pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(4000), pa.int32()), pa.array(np.arange(4000)), pa.array(np.zeros(4000)),
         pa.ListArray.from_arrays(pa.array(np.arange(4001) * 64, pa.int32()), pa.array(rows.ravel()))],
        names=["cell", "t", "carry", "vec"],
    )
    shard = NB._Shard([piece], 5, 100)
    exact = np.abs(asked[:, None] - rows[None]).sum(axis=2)
    coarse = shard._bounds(shard._coarse(asked), 0, 4000)
    assert ((coarse - 64.0) * shard.step <= exact).all()
    assert (exact[:, 3:] - (coarse[:, 3:] - 64.0) * shard.step).mean() < 0.06 * exact[:, 3:].mean()


def test_neighbours_of_fewer_rows_than_k_and_of_none(spark):
    make = lambda rows: spark.createDataFrame(rows, "id int, a double, b double")
    few = [(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 1.0, 1.0)]
    got = NB.nearest_rows(make(few), make([(9, 1.0, 1.0)]), ["a", "b"], "id", 5).orderBy("rank").collect()
    assert [r["neighbour"] for r in got] == [2, 3, 1]
    assert NB.nearest_rows(make([]), make(few), ["a", "b"], "id", 5).count() == 0
    assert NB.nearest_rows(make(few), make([]), ["a", "b"], "id", 5).count() == 0


def wide_rows(spark, matrix, **columns):
    data = pd.DataFrame({"g": "", "vec": matrix.tolist()}).assign(**columns)
    return spark.createDataFrame(data, "g string, vec array<double>, " + ", ".join(f"{c} long" for c in columns))


def test_views_share_the_visit_of_a_pair(spark, monkeypatch):
    """Feature sets are views of one vector: every pair is visited once for all of them, in chunks and tiles, and each view has its own neighbours."""
    monkeypatch.setattr(NB, "CHUNK", 64)
    monkeypatch.setattr(NB, "SHARD", 300)
    draw = np.random.default_rng(11)
    rows, asked = draw.normal(size=(1500, 8)), draw.normal(size=(200, 8))
    rows[700:760] = rows[3]  # equal distances across shards
    rows[1200] = 1e7  # spoils the wide steps
    views = {"both": list(range(8)), "low": [0, 1, 2], "odd": [1, 3, 5, 7]}
    counted = spark.sparkContext.accumulator(0)
    got = NB.nearest_vectors(
        wide_rows(spark, rows, t=np.arange(1500)[::-1], carry=np.arange(1500) % 3), wide_rows(spark, asked, q=np.arange(200)), 5,
        evaluations=counted, views=views,
    ).toPandas().sort_values("q")
    assert got["q"].tolist() == list(range(200))
    for name, places in views.items():
        d = np.abs(asked[:, None, places] - rows[None, :, places]).sum(axis=2)
        want = np.lexsort((np.broadcast_to(np.arange(1500)[::-1], d.shape), d.round(9)), axis=1)[:, :5]
        assert np.array_equal(1499 - np.array([[n["t"] for n in near] for near in got[name]]), want)
        assert np.allclose([[n["distance"] for n in near] for near in got[name]], np.take_along_axis(d, want, 1))
        assert all([n["carry"] for n in near] == (w % 3).tolist() for near, w in zip(got[name], want))
    assert 0 < counted.value <= len(rows) * len(asked)


def test_the_sets_of_a_comparison_are_one_search_over_one_vector(cells, monkeypatch):
    """Every row and query goes into the search once, not once a feature set."""
    data, splits = cells
    handed = []
    search = C.nearest_vectors
    monkeypatch.setattr(C, "nearest_vectors", lambda rows, asked, *a, **b: handed.append((rows.count(), asked.count())) or search(rows, asked, *a, **b))
    grid = [c for c in M.classifier_grid() if c["kind"] == "knn"]
    made = C.compared(splits, SETS, "label", "id", grid, probe="probe")
    assert handed == [(180, 240)]
    assert made.count() == 240 * len(SETS) * len(grid)


def test_few_chunks_and_bounded_ones(spark):
    """Queries of a crowded cell are dealt to several chunks, those of small cells share one, cells of two groups never do."""
    views = NB._Views(None)
    cells = NB._Cells([("a", [0.0]), ("a", [9.0]), ("a", [1.0]), ("b", [0.0])], views)
    chunks = NB._Chunks(cells, {0: 40_000, 1: 10, 2: 20, 3: 5}, 5, 1)
    assert chunks.parts.tolist() == [-(-40_000 // 13_345), 1, 1, 1]
    assert chunks.first[1] == chunks.first[2] and chunks.group == ["a", "a", "a", "a", "b"]
    sent = chunks.order([(3, 0), (3, 1), (3, 2)])
    assert {c: [x["turn"] for x in to] for c, to in sent.items()} == {1: [0], 2: [1], 0: [2]}


def test_majority_of_the_first_labels():
    labels = pa.array([[2, 1, 1, 2, 2], [3], [], [2, 1]], pa.list_(pa.int32()))
    one, two, five = C._majorities(labels, [1, 2, 5])
    assert one.tolist() == [2, 3, -1, 2] and two.tolist() == [1, 3, -1, 1] and five.tolist() == [2, 3, -1, 1]


def test_a_row_with_a_missing_number_is_no_ones_near_neighbour(spark):
    """Rows that miss numbers come after all that have them; a query that misses some still gets an answer."""
    draw = np.random.default_rng(12)
    rows, asked = draw.normal(size=(400, 3)), draw.normal(size=(40, 3))
    rows[rows[:, 0].argsort()[:2]] = np.nan
    asked[5] = np.nan
    got = NB.nearest_vectors(
        wide_rows(spark, rows, t=np.arange(400), carry=np.zeros(400, int)), wide_rows(spark, asked, q=np.arange(40)), 3,
        views={"all": [0, 1, 2], "one": [1]},
    ).collect()
    assert len(got) == 40
    for r in got:
        for name in ("all", "one"):
            missing = [bool(np.isnan(n["distance"])) for n in r[name]]
            assert len(missing) == 3 and missing == [r["q"] == 5] * 3
