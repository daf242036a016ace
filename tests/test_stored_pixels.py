"""Pixel tables stored by field: same rows, and plans without an exchange on the field."""

import os

import pytest
from pyspark.sql import functions as F

from catalog.objects import cells
from cytoframe.operators import objects as O
from cytoframe.sources.stored_pixels import _name, store_pixels, stored_pixels

SF = "/root/testdata/sf0.001"
CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    """Rows in one order; sums of doubles may differ in their last digits."""
    kinds = dict(df.dtypes)
    shown = [F.round(F.col(f"`{c}`"), 9) if kinds[c] == "double" else F.col(f"`{c}`") for c in sorted(df.columns)]
    return sorted(tuple(str(v) for v in r) for r in df.select(*shown).collect())


@pytest.fixture(scope="module")
def plain(spark):
    share = [(F.col("e") * k).alias(f"p{k}") for k in range(1, 6)]
    return cells(spark, SF).select("*", *share)


@pytest.fixture(scope="module")
def kept(spark, plain, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('pixels')}/it's"
    store_pixels(plain, path, buckets=6)
    return path


@pytest.fixture
def sorted_joins(spark):
    """Joins as they are planned where neither side is small."""
    before = spark.conf.get(BROADCAST)
    spark.conf.set(BROADCAST, "-1")
    yield
    spark.conf.set(BROADCAST, before)


def work(px):
    return {
        "shapes": O.shape_features(px),
        "boxes": O.bounding_boxes(px),
        "border": O.border_labels(px),
        "missing": O.missing_labels(px.withColumn("label", F.col("label") * 2)),
        "fractions": O.class_fractions(px),
        "probes": O.probe_by_class(px, ["probe"], [1, 4]),
        "parents": O.relate_by_overlap(px, "probe", "label"),
    }


def test_work_per_field_has_no_exchange(spark, plain, kept, sorted_joins):
    stored, unstored = work(stored_pixels(spark, kept)), work(plain)
    for name, df in stored.items():
        assert "Exchange" in plan(unstored[name]), name
        assert "Exchange" not in plan(df), (name, plan(df))
        want = rows(unstored[name])
        assert want and rows(df) == want, name


def test_crops_need_no_exchange_where_the_caller_allows_it(spark, plain, kept, sorted_joins):
    want = rows(O.crop_cells(plain, ["v"]))
    assert "Exchange hashpartitioning" in plan(O.crop_cells(stored_pixels(spark, kept), ["v"]))
    before = spark.conf.get(CO_PARTITION)
    spark.conf.set(CO_PARTITION, "false")
    try:
        crops = O.crop_cells(stored_pixels(spark, kept), ["v"])
        assert "Exchange" not in plan(crops), plan(crops)
        assert want and rows(crops) == want
    finally:
        spark.conf.set(CO_PARTITION, before)


def test_one_file_a_bucket_and_single_fields_read_theirs(spark, plain, kept):
    files = [f for f in os.listdir(f"{kept}/rows") if f.endswith(".parquet")]
    assert 1 < len(files) <= 6
    fov = plain.agg(F.min("fov")).first()[0]
    one = stored_pixels(spark, kept).where(F.col("fov") == fov)
    assert "SelectedBucketsCount: 1 out of 6" in plan(O.shape_features(one))
    assert one.count() == 64


def test_other_sessions_learn_the_buckets_from_the_description(spark, plain, kept, sorted_joins):
    spark.sql(f"DROP TABLE {_name(kept)}")  # the files are not the catalogue's
    again = stored_pixels(spark, kept)
    assert again.columns == plain.columns
    fractions = O.class_fractions(again)
    assert "Exchange" not in plan(fractions)
    assert rows(fractions) == rows(O.class_fractions(plain))


def test_empty_tables_missing_fields_and_odd_names(spark, tmp_path):
    schema = "`the fov` long, label int, y int, x int"
    odd = spark.createDataFrame([(None, 1, 0, 0), (3, 1, 0, 0), (3, 1, 0, 1), (None, 2, 5, 5)], schema)
    store_pixels(odd, f"{tmp_path}/odd", "the fov", 3)
    spark.sql(f"DROP TABLE {_name(f'{tmp_path}/odd')}")
    back = stored_pixels(spark, f"{tmp_path}/odd")
    assert rows(back) == rows(odd)
    assert rows(O.shape_features(back, "the fov")) == rows(O.shape_features(odd, "the fov"))
    store_pixels(odd.limit(0), f"{tmp_path}/none", "the fov", 3)
    assert stored_pixels(spark, f"{tmp_path}/none").count() == 0


def test_a_stored_table_is_not_replaced(spark, plain, kept):
    with pytest.raises(Exception):
        store_pixels(plain, kept, buckets=6)
    assert stored_pixels(spark, kept).count() == plain.count()
