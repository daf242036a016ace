"""No silent drops, no caps, no doubling plans."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.operators import components as CO
from cytoframe.operators import joins as J
from cytoframe.operators import models as M
from cytoframe.operators import reshape as RS
from cytoframe.sources import readers as SR


def test_an_entry_like_the_size_line_stays(spark, tmp_path):
    one, two = tmp_path / "a.mtx", tmp_path / "b.mtx"
    one.write_text("%%MatrixMarket matrix coordinate\n% note\n3 4 1\n3 4 1\n")
    two.write_text("5 5 2\n1 1 7\n5 5 2\n")
    got = SR.read_matrix_market(spark, str(one)).collect()
    assert [tuple(r) for r in got] == [(2, 3, 1)]
    assert sorted(map(tuple, SR.read_matrix_market(spark, str(tmp_path)).collect())) == [(0, 0, 7), (2, 3, 1), (4, 4, 2)]


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_ridge_with_missing_values_and_large_offsets(spark, offset):
    draw = np.random.default_rng(0)
    x, z = draw.normal(size=60), draw.normal(size=60)
    rows = [
        (None if i % 5 == 0 else float(x[i] + offset), float("nan") if i % 7 == 0 else float(z[i]), float(2 * x[i] + 3 * z[i] + 1))
        for i in range(60)
    ]
    fit = M.fit_ridge(spark.createDataFrame(rows, "x double, z double, y double"), ["x", "z"], "y", balance=False, alpha=0.0)
    assert np.allclose(fit.coefficients, [2, 3], atol=1e-5)
    assert fit.intercept == pytest.approx(1 - 2 * offset, rel=1e-5, abs=1e-5)


def test_bootstrap_ridge_with_large_offsets(spark):
    draw = np.random.default_rng(0)
    x = draw.normal(size=80)
    rows = [(i, float(x[i]), float(x[i] + 1e8), int(x[i] > 0)) for i in range(80)]
    df = spark.createDataFrame(rows, "k long, x double, far double, y int")
    near, far = (
        sorted((r.replicate, r.coef) for r in M.bootstrap_ridge(df, [c], "y", "k", 3).collect()) for c in ("x", "far")
    )
    assert np.allclose([c for _, c in near], [c for _, c in far], rtol=1e-5)


def test_many_classes_can_be_drawn(spark):
    from cytoframe.operators.classifiers import dummy_predictions

    ids = spark.range(17_000).select(F.when(F.col("id") < 15_000, "train").otherwise("test").alias("split"), F.lit("all").alias("probe"),
                                     F.col("id").alias("key"), F.col("id").cast("int").alias("y"))
    made = dummy_predictions(ids, "train", ["stratified", "uniform"], 3).where("split = 'test'")
    for r in made.groupBy("classifier").agg(F.count("pred").alias("n"), F.count_distinct("pred").alias("d"), F.max("pred").alias("m")).collect():
        assert r["n"] == 2_000 and r["d"] > 1_700 and r["m"] < 15_000


def test_many_names_and_wide_images(spark):
    names = RS.distinct_names(spark.range(10_050).select(F.format_string("n%05d", "id").alias("p")), ["p"])
    assert len(names) == 10_050
    at = spark.createDataFrame([(0, 1_048_576), (1, 0), (2**30, 2**31)], "y long, x long")
    assert at.select(CO._node(F.col("y"), F.col("x")).alias("n")).distinct().count() == 3


@pytest.fixture
def shuffled_joins(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("hot", [None, "left", "right"])
def test_a_chain_of_outer_merges(spark, tmp_path, shuffled_joins, hot):
    """Seven inputs: right rows with shuffle joins, and no input scanned more than twice."""
    tables, want = [], {}
    for n in range(7):
        rows = [(k, k * 10 + n) for k in range(n, 40 + 3 * n, n + 1)] + [(None, n)]
        for k, v in rows:
            want.setdefault(k, {})[n] = v
        path = str(tmp_path / f"t{n}")
        spark.createDataFrame(rows, f"k long, v{n} long").repartition(3).write.parquet(path)
        tables.append(spark.read.parquet(path))
    merged = tables[0]
    for t in tables[1:]:
        merged = J.merge(merged, t, ["k"], "outer", many=hot)
    got = {r.k: {n: r[f"v{n}"] for n in range(7) if r[f"v{n}"] is not None} for r in merged.collect()}
    assert got == want and merged.count() == len(want)
    plan = merged._jdf.queryExecution().sparkPlan().toString()
    scans = re.findall(r"FileScan parquet[^\n]*", plan)
    assert len(scans) <= 14
    for n in range(7):
        assert sum(f"/t{n}]" in s or f"/t{n}," in s for s in scans) <= 2


def test_hot_and_missing_keys_in_outer_merges(spark, shuffled_joins):
    left = spark.createDataFrame([(1, i) for i in range(50)] + [(None, 50), (None, 51), (3, 52)], "k long, a long")
    right = spark.createDataFrame([(1, 7), (2, 8), (None, 9)], "k long, b long")
    rows = [sorted(map(str, J.merge(left, right, ["k"], "outer", many=h).collect())) for h in (None, "left", "right")]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 54
    apart = J.merge(left, right, ["k"], "outer", nulls_match=False)
    assert apart.count() == 55


def test_row_distances_in_lockstep():
    """Rows of any length and order, with repeated pixels, in one batch: equal to all pairs."""
    import pyarrow as pa

    from cytoframe.operators.distance import row_distances

    draw = np.random.default_rng(6)
    rows = []
    for width in (0, 1, 2, 7, 60, 300, 7, 2):
        for share in (0.0, 0.02, 0.5, 1.0):
            x = draw.permutation(width).astype(float)
            x[: width // 10] = x[-1:] if width else x[: width // 10]
            rows.append((x, np.where(draw.random(width) < share, draw.integers(0, 40, width), np.nan)))
    made = row_distances(pa.array([x for x, _ in rows], pa.list_(pa.float64())),
                         pa.array([[None if np.isnan(v) else v for v in g] for _, g in rows], pa.list_(pa.float64())))
    for (x, gap), got in zip(rows, made.to_pylist()):
        seen = ~np.isnan(gap)
        if not seen.any():
            assert got == [None] * len(x)
            continue
        want = np.sqrt(((x[:, None] - x[None, seen]) ** 2 + gap[None, seen] ** 2).min(1))
        assert (np.array(got) == want).all()


def test_dense_arrays(spark):
    from cytoframe.operators.columns import dense

    rows = [([(2, 1.0), (3, 2.0), (7, 3.0)],), ([(9, 4.0)],), ([(0, 5.0)],)]
    df = spark.createDataFrame(rows, "e array<struct<k:int,v:double>>")
    got = [r[0] for r in df.select(dense("e", F.lit(0), F.lit(10), F.lit(0.0))).collect()]
    assert got == [[0, 0, 1, 2, 0, 0, 0, 3, 0, 0], [0.0] * 9 + [4], [5] + [0.0] * 9]


def test_packing_of_full_size_patches(spark):
    """96 x 96 patches of one 96-wide image; searching a map for each position took about a minute."""
    import time

    from cytoframe.operators.windows import patch_arrays

    px = spark.range(96 * 96).selectExpr("0 AS fov", "cast(id div 96 AS int) AS y", "cast(id % 96 AS int) AS x", "cast(id AS double) AS v")
    start = time.time()
    rows = patch_arrays(px, stride=24).collect()
    assert len(rows) == 16 and {len(r.patch) for r in rows} == {9216} and time.time() - start < 25
    full = next(r for r in rows if (r.r, r.c) == (48, 48))
    assert full.patch == [i / 9215 for i in range(9216)]


def test_pixels_are_shuffled_at_most_twice_per_patch_row(spark):
    """An image row goes once to each row of patches that covers it: (size / stride) values a pixel, not their square."""
    from cytoframe.operators import windows

    px = spark.range(40 * 50).selectExpr("1 AS fov", "cast(id div 50 AS int) AS y", "cast(id % 50 AS int) AS x", "id % 9 AS v")
    strips = windows._in_strips(px, "fov", "v", 16, 4)
    sent = strips.agg(F.sum(F.size("xs"))).first()[0]
    assert sent + 40 * 50 <= 40 * 50 * (16 // 4) * 2
    patches = windows.sliding_patches(px, size=16, stride=4)
    assert patches.count() > 10 * 40 * 50  # what a pixel-wise exchange would have sent


def test_correlations_of_all_steps_equal_pair_counts(spark):
    """One transform a cell gives what counting every pair gives, for boxes of several sizes and holes in them."""
    from cytoframe.operators import texture

    draw = np.random.default_rng(2)
    rows = []
    for label, (h, w) in enumerate([(1, 1), (3, 9), (8, 8), (20, 5), (33, 40), (8, 8)], 1):
        level = draw.integers(0, 9, (h, w)) if label != 6 else np.full((h, w), 4)
        rows += [(1, label, y + 10 * label, x + 3, int(level[y, x])) for y in range(h) for x in range(w)]
    cells = spark.createDataFrame(rows, "fov int, label int, y int, x int, level int").where("level > 0")
    angles = texture.even_angles(7)
    steps = texture.offsets(range(12), angles)
    got = {(r.label, r.d, r.a): r["corr"] for r in texture.correlation_by_angle(cells, range(12), angles).collect()}
    pairs = texture.step_correlation(texture.cooccurrence(cells, [(dy, dx) for _, _, dy, dx in steps]))
    want = {(r.label, r.dy, r.dx): r["corr"] for r in pairs.collect()}
    assert len(got) == 6 * len(steps)
    for label in range(1, 7):
        for d, a, dy, dx in steps:
            assert abs(got[label, d, a] - abs(want.get((label, dy, dx), 1.0))) < 1e-9


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_ranks_of_groups_cut_by_partitions(spark, parts):
    """Groups of one row, of a third of all and over many partitions, null and nan keys, repeated values."""
    from cytoframe.operators import ranks

    draw = np.random.default_rng(parts)
    rows = [(("hot", None, "a", "b", f"g{i % 40}")[min(int(g), 4)], float(draw.integers(0, 150)), i)
            for i, g in enumerate(draw.integers(0, 9, 1500))]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(5)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = {}
        for k, v, i in rows:
            groups.setdefault(k, []).append(v)
        for r in ranks.cumulative_counts(df, ["k"], "v").collect():
            have = np.array(groups[r["k"]])
            assert (r["__n__"], r["__below__"], r["__total__"]) == ((have == r["v"]).sum(), (have < r["v"]).sum(), len(have))
        whole = ranks.cumulative_counts(df, [], "v").collect()
        assert {(r["v"], r["__below__"]) for r in whole} == {(v, sum(w[1] < v for w in rows)) for _, v, _ in rows}
        numbers = {}
        for r in ranks.sequential_index(df, "v", "i", ["k"]).collect():
            numbers.setdefault(r["k"], []).append((r["v"], r["i"]))
        for k, found in numbers.items():
            found.sort(key=lambda p: p[1])
            assert [i for _, i in found] == list(range(1, len(groups[k]) + 1))
            assert [v for v, _ in found] == sorted(groups[k])
        again = {r["id"]: r["i"] for r in ranks.sequential_index(df, "v", "i").collect()}
        assert sorted(again.values()) == list(range(1, 1501))
        assert again == {r["id"]: r["i"] for r in ranks.sequential_index(df.repartition(3), "v", "i").collect()}
        assert ranks.sequential_index(df.where("v < 0"), "v", "i", ["k"]).count() == 0
        assert ranks.group_quantiles(df.where("v < 0"), ["k"], "v", {"m": 0.5}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_statistics_in_parts_are_merged_over_tasks(spark):
    """A group split over many tasks: states are merged, and no task adds more than its own rows."""
    from cytoframe.operators import resample

    rows = spark.range(4000).select((F.col("id") % 2).alias("k"), (F.col("id") * 1.0).alias("v"), "id").repartition(7)
    largest = resample.Mergeable(
        start=lambda: (0, 0.0, 0),
        add=lambda s, values, times: (s[0] + int(times.sum()), s[1] + float((values * times).sum()), max(s[2], len(values))),
        merge=lambda a, b: (a[0] + b[0], a[1] + b[1], max(a[2], b[2])),
        finish=lambda s: s[1] / s[0] + (1e9 if s[2] >= 1000 else 0),
    )
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r["k"], r["replicate"]): r["stat"] for r in resample.bootstrap(rows, ["k"], "v", "id", largest, 3, 1).collect()}
        want = {(r["k"], r["replicate"]): r["stat"] for r in resample.bootstrap(rows, ["k"], "v", "id", "mean", 3, 1).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    assert len(got) == 6 and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_decay_rates_of_a_batch_rest(spark):
    """Curves of several lengths fitted together: the weighted squares do not fall to either side."""
    import pyarrow as pa

    from cytoframe.operators.texture import decay_rates

    draw = np.random.default_rng(4)
    curves = [(np.arange(n), np.exp(-a * np.arange(n) ** 2) + draw.normal(size=n) * 0.02)
              for n in (3, 6, 33) for a in (0.002, 0.05, 0.7)]
    rates = decay_rates(pa.array([d for d, _ in curves], pa.list_(pa.int64())), pa.array([y for _, y in curves], pa.list_(pa.float64())), 0.5)
    for (d, y), rate in zip(curves, rates):
        cost = lambda a: ((np.exp(-0.5 * d) * (y - np.exp(-a * d * d))) ** 2).sum()
        assert cost(rate) <= min(cost(rate - 1e-5), cost(rate + 1e-5)) + 1e-15


def plain_components(mask, corners):
    """Flood fill with the first pixel in row order as name."""
    names = {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if corners else [])
    for y, x in zip(*np.nonzero(mask)):
        if (y, x) in names:
            continue
        todo = [(y, x)]
        names[y, x] = (int(y) << 32) + int(x)
        while todo:
            cy, cx = todo.pop()
            for dy, dx in steps:
                at = (cy + dy, cx + dx)
                if 0 <= at[0] < mask.shape[0] and 0 <= at[1] < mask.shape[1] and at not in names and mask[at] == mask[cy, cx]:
                    names[at] = names[y, x]
                    todo.append(at)
    return {(int(a), int(b)): v for (a, b), v in names.items()}


@pytest.mark.parametrize("connectivity", [4, 8])
@pytest.mark.parametrize("tile", [1, 5, 256])
def test_components_over_tile_borders(spark, connectivity, tile):
    import pandas as pd

    draw = np.random.default_rng(tile)
    images = [draw.integers(0, 3, (17, 23)), (draw.random((9, 40)) < 0.6).astype(int), np.ones((12, 12), dtype=int)]
    rows = [(f, y, x, int(m[y, x])) for f, m in enumerate(images) for y in range(m.shape[0]) for x in range(m.shape[1])]
    px = spark.createDataFrame(pd.DataFrame(rows, columns=["fov", "y", "x", "label"]))
    got = {}
    for r in CO.connected_components(px, ["fov"], "label", "c", connectivity, tile).collect():
        got.setdefault(r["fov"], {})[r["y"], r["x"]] = r["c"]
    for f, mask in enumerate(images):
        assert got[f] == plain_components(mask, connectivity == 8)


def test_spiral_of_a_thousand_columns(spark, monkeypatch):
    """One winding path of half a million pixels: the rounds grow with the tiles, not with the path."""
    import pandas as pd

    n = 1024
    mask = np.zeros((n, n), dtype=bool)
    y = x = 0
    mask[0, 0] = True
    ends, turn = [n - 1, n - 1, 0, 2], 0  # right, down, left, up: how far each way goes, two pixels less every time
    while True:
        length = (ends[turn] - (x if turn % 2 == 0 else y)) * (1 if turn < 2 else -1)
        if length <= 0:
            break
        dy, dx = [(0, 1), (1, 0), (0, -1), (-1, 0)][turn]
        for _ in range(length):
            y, x = y + dy, x + dx
            mask[y, x] = True
        ends[turn] += -2 if turn < 2 else 2
        turn = (turn + 1) % 4
    assert mask.sum() > n * n / 2.1
    y, x = np.nonzero(mask)
    px = spark.createDataFrame(pd.DataFrame({"fov": 1, "y": y, "x": x, "m": 1}))
    written = []
    plain = CO.materialise
    monkeypatch.setattr(CO, "materialise", lambda df: written.append(1) or plain(df))
    got = CO.connected_components(px, ["fov"], "m", "c", 4)
    assert CO.first_of_component(np.arange(len(y) - 1), np.arange(1, len(y)), len(y)).max() == 0
    assert got.count() == len(y) and got.select("c").distinct().collect() == [(0,)]
    # one write a round, three besides; the path is cut into this many pieces by the tiles
    pieces = CO._in_tiles(px, ["fov"], "m", 4, CO.TILE).select("__node__").distinct().count()
    assert pieces < len(y) / 100 and len(written) <= 4 + np.log2(pieces)
