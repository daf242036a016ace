"""Pixel operators on small images with known answers, and against brute force."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import components as CC
from cytoframe.operators import distance as D
from cytoframe.operators import objects as O
from cytoframe.operators import pixels as P
from cytoframe.operators import texture as T
from cytoframe.operators import windows as W
from cytoframe.plans import fields as FD


def image(spark, **planes):
    """Images as one table; every plane is an array, all of one shape. fov is 1."""
    names = list(planes)
    h, w = planes[names[0]].shape
    rows = [
        (1, y, x, *[planes[n][y][x].item() for n in names]) for y in range(h) for x in range(w)
    ]
    kinds = ["double" if planes[n].dtype.kind == "f" else "int" for n in names]
    schema = "fov long, y int, x int, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return spark.createDataFrame(rows, schema)


def grid(df, value, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[value]
    return out


@pytest.fixture(scope="module")
def two_squares():
    label = np.zeros((12, 12), dtype=int)
    label[1:4, 1:4] = 1
    label[8:12, 8:12] = 2
    return label


def test_shapes_of_two_squares(spark, two_squares):
    rows = {r["label"]: r for r in O.shape_features(image(spark, label=two_squares)).collect()}
    assert rows[1]["area"] == 9 and rows[2]["area"] == 16
    assert (rows[1]["centroid_y"], rows[2]["centroid_x"]) == (2.0, 9.5)
    assert (rows[2]["y0"], rows[2]["y1"]) == (8, 11)
    side = 4 * math.sqrt((9 - 1) / 12 + 1 / 12)
    assert rows[1]["major_axis"] == pytest.approx(side)
    assert rows[1]["aspect_ratio"] == pytest.approx(1.0)


@pytest.mark.parametrize("buffer,expected", [(0, {2}), (1, {2}), (7, {2}), (8, {1, 2})])
def test_border_buffer(spark, two_squares, buffer, expected):
    found = O.border_labels(image(spark, label=two_squares), buffer=buffer)
    assert {r["label"] for r in found.collect()} == expected


def test_first_row_counts_as_border(spark):
    label = np.zeros((9, 9), dtype=int)
    label[0, 4] = 3
    assert O.border_labels(image(spark, label=label), buffer=0).collect()[0]["label"] == 3


def test_ring_is_filled(spark):
    ring = np.ones((7, 7), dtype=int)
    ring[2:5, 2:5] = 0
    filled = CC.fill_holes(image(spark, label=ring))
    assert filled.count() == 49
    open_ring = ring.copy()
    open_ring[3, 0:3] = 0
    assert CC.fill_holes(image(spark, label=open_ring)).count() == open_ring.sum()


def test_object_inside_a_hole_takes_the_higher_label(spark):
    nested = np.ones((7, 7), dtype=int)
    nested[2:5, 2:5] = 0
    nested[3, 3] = 2
    out = grid(CC.fill_holes(image(spark, label=nested)), "label", (7, 7))
    assert out[3, 3] == 2 and out[2, 2] == 1
    out = grid(CC.fill_holes(image(spark, label=np.where(nested > 0, 3 - nested, 0))), "label", (7, 7))
    assert out[3, 3] == 2 and (out == 2).all()


def test_split_label_is_repaired(spark):
    label = np.zeros((10, 10), dtype=int)
    label[0:3, 0:3] = 5
    label[6:10, 6:10] = 5
    label[5, 0:2] = 7
    fixed = grid(CC.repair_labels(image(spark, label=label), min_area=2), "fixed", (10, 10))
    assert set(np.unique(fixed)) == {0, 1, 2}
    assert (fixed == 1).sum() == 9 and (fixed == 2).sum() == 16
    wrong = CC.wrongly_labelled(image(spark, label=label), min_area=2).collect()
    assert [(r["labelled"], r["found"]) for r in wrong] == [(1, 2)]


def flood(label, steps):
    h, w = label.shape
    out, number = np.zeros((h, w), dtype=int), 0
    for y in range(h):
        for x in range(w):
            if label[y, x] and not out[y, x]:
                number += 1
                todo = [(y, x)]
                out[y, x] = number
                while todo:
                    cy, cx = todo.pop()
                    for dy, dx in steps:
                        ny, nx = cy + dy, cx + dx
                        if 0 <= ny < h and 0 <= nx < w and not out[ny, nx] \
                                and label[ny, nx] == label[cy, cx]:
                            out[ny, nx] = number
                            todo.append((ny, nx))
    return out


@pytest.mark.parametrize("connectivity", [4, 8])
def test_components_match_flood_fill(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    label = rng.choice([0, 1, 2], size=(40, 50), p=[0.4, 0.4, 0.2])
    # a snake, long compared with its width
    label[::4, :] = 3
    label[2::8, :-1] = 0
    label[1::8, -1] = label[2::8, -1] = label[3::8, -1] = 3
    steps = [(0, 1), (0, -1), (1, 0), (-1, 0)]
    if connectivity == 8:
        steps += [(1, 1), (1, -1), (-1, 1), (-1, -1)]
    want = flood(label, steps)
    got = grid(
        CC.connected_components(image(spark, label=label), connectivity=connectivity),
        "component", label.shape,
    )
    pairs = {(a, b) for a, b, v in zip(want.ravel(), got.ravel(), label.ravel()) if v}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) == want.max()


def test_distance_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    seed = (rng.random((23, 31)) < 0.03).astype(int)
    points = np.argwhere(seed)
    want = np.array([
        [np.sqrt(((points - (y, x)) ** 2).sum(axis=1)).min() for x in range(31)] for y in range(23)
    ])
    got = D.distance_transform(image(spark, seed=seed), ["fov"], F.col("seed") == 1)
    assert np.allclose(grid(got, "distance", seed.shape), want)


def test_distance_without_seed_is_null(spark):
    flat = image(spark, seed=np.zeros((3, 3), dtype=int))
    rows = D.distance_transform(flat, ["fov"], F.col("seed") == 1).collect()
    assert len(rows) == 9 and all(r["distance"] is None for r in rows)


def test_probe_distances(spark):
    label = np.zeros((20, 20), dtype=int)
    label[3:18, 3:18] = 1
    nucleus = np.zeros_like(label)
    nucleus[9:11, 9:11] = 1
    probe = np.zeros_like(label)
    probe[9, 5] = probe[4, 9] = 1
    probe[14:16, 14:16] = 1
    px = image(spark, label=label, nucleus=nucleus, probe=probe)
    rows, failed = D.probe_localisation(px, ["probe"], ["nucleus"], margin=2)
    row = rows.collect()[0]
    assert failed.count() == 0
    assert [(c["y"], c["x"]) for c in row["probe_centres"]] == [(4, 9), (9, 5), (14, 14)]
    far = math.hypot(4, 4)
    assert row["abs_dist_nucleus_sum"] == pytest.approx(4 + 5 + far)
    assert row["dist_nucleus_median"] == pytest.approx(sorted([4 / 7, 5 / 7, far / (far + 4)])[1])


def test_cell_without_seed_is_reported(spark):
    label = np.zeros((9, 9), dtype=int)
    label[0:3, 0:3], label[5:8, 5:8] = 1, 2
    nucleus = (label == 1).astype(int)
    rows, failed = D.probe_localisation(
        image(spark, label=label, nucleus=nucleus, probe=nucleus), ["probe"], ["nucleus"], margin=1
    )
    assert [r["label"] for r in failed.collect()] == [2]
    assert [r["label"] for r in rows.collect()] == [1]


def test_gradient_contrast(spark):
    v = np.add.outer(10 * np.arange(10), np.arange(10)).astype("int64")
    out = grid(P.quantile_contrast(image(spark, v=v), ["fov"], clip_quantiles=(0.1, 0.9)), "stretched",
               v.shape)
    lo, hi = np.quantile(v, [0.1, 0.9])
    assert np.array_equal(out, np.rint((np.clip(v, lo, hi) - lo) / (hi - lo) * 255))
    zeroed = grid(
        P.quantile_contrast(image(spark, v=v), ["fov"], clip_quantiles=(0.1, 0.9),
                            zero_below_median=True), "stretched", v.shape)
    clipped = np.clip(v, lo, hi)
    clipped[clipped < np.median(clipped)] = 0
    assert np.array_equal(zeroed, np.rint(clipped / clipped.max() * 255))


def test_histogram_contrast_zeroes_full_bins(spark):
    v = np.concatenate([np.full(60, 10), np.arange(40) * 50 + 20]).reshape(10, 10)
    out = grid(P.contrast(image(spark, v=v), ["fov"], "histogram"), "stretched", v.shape)
    assert (out[v == 10] == 0).all() and out.max() == 255


def test_contrast_needs_a_known_method(spark):
    with pytest.raises(KeyError):
        P.contrast(image(spark, v=np.zeros((2, 2), dtype=int)), ["fov"], "other")


def test_wrong_number_of_planes_is_an_error(spark):
    images = spark.createDataFrame([(1, [[1.0, 2.0]])], "fov long, planes array<array<double>>")
    with pytest.raises(Exception, match="planes"):
        P.channel_planes(images, {"bf": 0, "cell": 1}, 2).collect()


def test_crop_masks_other_cells(spark):
    label = np.array([[1, 1, 0], [1, 2, 2], [0, 2, 2]])
    v = np.array([[10, 20, 99], [30, 40, 50], [99, 60, 70]])
    rows = O.crop_cells(image(spark, label=label, v=v), ["v"]).collect()
    one = {(r["crop_y"], r["crop_x"]): r["v"] for r in rows if r["label"] == 1}
    assert one == {(0, 0): 85, (0, 1): 170, (1, 0): 255, (1, 1): 0}
    assert len([r for r in rows if r["label"] == 2]) == 4


def brute_counts(level, dy, dx):
    counts = defaultdict(int)
    h, w = level.shape
    for y in range(h):
        for x in range(w):
            if 0 <= y + dy < h and 0 <= x + dx < w and level[y, x] and level[y + dy, x + dx]:
                counts[level[y, x], level[y + dy, x + dx]] += 1
    return counts


def test_cooccurrence_matches_brute_force(spark):
    rng = np.random.default_rng(8)
    level = rng.integers(0, 5, size=(17, 29))
    level[5] = 0
    level[:, 20] = 0
    cells = image(spark, label=np.where(level > 0, 1, 0), level=level).where("label > 0")
    steps = [(0, 0), (0, 3), (2, -1), (5, 7), (-3, 2), (1, 28)]
    got = defaultdict(dict)
    for r in T.cooccurrence(cells, steps).collect():
        got[r["dy"], r["dx"]][r["i"], r["j"]] = r["n"]
    for step in steps:
        assert got[step] == dict(brute_counts(level, *step)), step


def test_stripes_repeat_every_second_column(spark):
    level = np.tile([1, 2], (12, 8))
    cells = image(spark, label=np.ones_like(level), level=level)
    corr = T.step_correlation(T.cooccurrence(cells, [(0, d) for d in range(1, 5)]))
    by_step = {r["dx"]: r["corr"] for r in corr.collect()}
    assert by_step[2] == pytest.approx(1.0) and by_step[1] == pytest.approx(-1.0)


def test_offsets_round_half_away_from_zero():
    table = T.offsets([0, 1, 2], T.even_angles(3))
    assert (0, 0, 0, 0) in table and (1, 1, 1, 0) in table and (2, 2, 0, -2) in table


def test_decay_fit_finds_the_rate(spark):
    d = np.arange(33)
    rows = [(1, 1, 0, int(k), float(math.exp(-0.02 * k * k))) for k in d]
    corr = spark.createDataFrame(rows, "fov long, label int, a int, d int, corr double")
    fitted = T.decay_residuals(corr).collect()
    assert fitted[0]["rate"] == pytest.approx(0.02, abs=1e-8)
    assert max(abs(r["residual"]) for r in fitted) < 1e-6


def test_decay_fit_is_the_weighted_minimum(spark):
    random.seed(1)
    d = np.arange(10)
    y = np.exp(-0.3 * d * d) + np.array([random.uniform(0, 0.2) for _ in d])
    corr = spark.createDataFrame(
        [(1, 1, 0, int(k), float(v)) for k, v in zip(d, y)],
        "fov long, label int, a int, d int, corr double",
    )
    rate = T.decay_residuals(corr).first()["rate"]
    w = np.exp(-0.5 * d)
    cost = lambda a: ((w * (y - np.exp(-a * d * d))) ** 2).sum()
    assert all(cost(rate) <= cost(rate + s) + 1e-12 for s in (-1e-3, 1e-3, 0.05, -0.05))


def test_class_counts_and_empty_class(spark):
    cls = np.array([[0, 1, 1], [2, 2, 2], [5, 5, 0]])
    label = np.ones_like(cls)
    nucleus = (cls == 0).astype(int)
    probe = np.array([[1, 1, 0], [0, 0, 1], [0, 0, 0]])
    px = image(spark, label=label, cls=cls, nucleus=nucleus, seg_561=probe, v=cls * 10,
               **{f"p{k}": (cls == k).astype(float) for k in range(1, 6)})
    fractions = O.class_fractions(px).first()
    assert fractions["Frac_Area_Fibers"] == pytest.approx(3 / 9)
    assert fractions["Frac_Area_Organized_Puncta"] == 0
    counts = O.probe_by_class(px, ["seg_561"], range(1, 6)).first()
    assert counts["seg_561_total_probe_cyto"] == 2 and counts["seg_561_probe_px_nuc"] == 1
    assert counts["nuc_px"] == 2 and counts["cell_px"] == 9
    from cytoframe.functions.scalars import class_densities

    dense = O.probe_by_class(px, ["seg_561"], range(1, 6)).select(
        *[e.alias(n) for n, e in class_densities("seg_561", range(1, 6)).items()]
    ).first()
    assert dense["seg_561_density_class_3"] == 0
    assert dense["seg_561_density_class_1"] == pytest.approx(0.5)
    assert dense["seg_561_density_OUTSIDE_class_1"] == pytest.approx(1 / 5)


def test_patches_are_zero_padded(spark):
    v = np.arange(1, 26).reshape(5, 5)
    arrays = W.patch_arrays(image(spark, v=v), size=4, stride=4)
    first = arrays.where("r = 0 AND c = 0").first()["patch"]
    assert len(first) == 16 and first[:10] == [0.0] * 10
    assert first[10] == pytest.approx(1 / 7) and first[15] == 1.0


def test_class_order_and_mask(spark):
    px = spark.createDataFrame(
        [(0.1, 0.9, 0.0, 0.0, 0.0, 0), (0.9, 0.1, 0.0, 0.0, 0.0, 0), (0.9, 0.0, 0.0, 0.0, 0.1, 1)],
        "p1 double, p2 double, p3 double, p4 double, p5 double, background int",
    )
    rows = W.masked_class_map(px).collect()
    assert [r["cls"] for r in rows] == [1, 5, 0]
    assert rows[2]["p5"] == 0.0


def test_field_job(spark):
    planes = {"488": np.arange(36).reshape(6, 6), "cell": np.zeros((6, 6), dtype=int)}
    planes["cell"][0:2, 0:2], planes["cell"][3:5, 3:6] = 1, 2
    rows = [
        (fov, c, y, x, int(a[y, x]) if fov == 1 or c == "488" else int(a[y, x]) * 2)
        for fov in (1, 2) for c, a in planes.items() for y in range(6) for x in range(6)
    ]
    px = spark.createDataFrame(rows, "fov long, channel string, y int, x int, v long")
    fields = spark.createDataFrame([(1, "a/f1.tiff"), (2, "a/f2.tiff"), (3, "a/f3.tiff")],
                                   "fov long, `2D_fov_tiff_path` string")
    made = FD.process_fields(fields, px, "out", channels=["488", "cell"])
    cells = made["manifest"].orderBy("cell_label_value").collect()
    assert [r["cell_label_value"] for r in cells] == [1, 2]
    assert cells[1]["rescaled_2D_single_cell_tiff_path"] == \
        "out/output_single_cell_images/f1_rescaled_cell2.ome.tiff"
    assert {(r["fov"], r["reason"]) for r in made["failed"].collect()} == {
        (2, "labels are not 1..n"), (3, "no pixels")}
    assert made["crops"].where("label = 2").count() == 6
    assert made["fields"].where("channel = 'cell' AND fov = 1 AND stretched = 2").count() == 6
