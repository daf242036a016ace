"""Objects of the label image: shapes, borders, crops, relations, class areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.measures import rounded
from catalog.pixels import SCORE_PX, score_pixels
from catalog.tables import PX, pixels, scratch, table
from cytoframe.operators import objects as O
from cytoframe.plans import fields as FD
from cytoframe.sources.stored_pixels import store_pixels, stored_pixels

# cells of uneven shape: the low values of each quarter
CELLS = f"""{PX}, cl AS (SELECT fov, y, x, v, e, probe, nucleus, cls,
    CASE WHEN e < 0.12 THEN label ELSE 0 END AS label FROM px)"""


def cells(spark, sf):
    return pixels(spark, sf).withColumn(
        "label", F.when(F.col("e") < 0.12, F.col("label")).otherwise(0)
    )


SHAPES = f"""{CELLS}, m AS (SELECT fov, label, count(*) AS area, avg(y) AS centroid_y, avg(x) AS centroid_x,
      min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1, var_pop(y) + 1.0::DOUBLE / 12 AS a,
      var_pop(x) + 1.0::DOUBLE / 12 AS b, covar_pop(y, x) AS c FROM cl WHERE label > 0 GROUP BY 1, 2)"""


SHAPE_SQL = f"""WITH {SHAPES}, s AS (SELECT *, 4 * sqrt((a + b) / 2 + sqrt((a - b) ** 2 / 4 + c * c)) AS mj,
          4 * sqrt(greatest((a + b) / 2 - sqrt((a - b) ** 2 / 4 + c * c), 0)) AS mn FROM m)
        SELECT fov, label, area, round(centroid_y, 6) AS centroid_y, round(centroid_x, 6) AS centroid_x,
          y0, y1, x0, x1, round(mj, 6) AS major_axis, round(mn, 6) AS minor_axis,
          round(mn / mj, 6) AS aspect_ratio FROM s"""


def rounded_shapes(px):
    return rounded(
        O.shape_features(px), ["centroid_y", "centroid_x", "major_axis", "minor_axis", "aspect_ratio"]
    )


@query("shape_features", SHAPE_SQL)
def shape_features(spark, sf):
    return rounded_shapes(cells(spark, sf))


def stored(px):
    """The pixels written by field and opened again from their description."""
    path = scratch(px.sparkSession) + "/pixels"
    store_pixels(px, path)
    return stored_pixels(px.sparkSession, path)


@query("stored_shapes", SHAPE_SQL)
def stored_shapes(spark, sf):
    return rounded_shapes(stored(cells(spark, sf)))


BORDER = """border AS (SELECT DISTINCT fov, label FROM cl
   WHERE label > 0 AND (y = 0 OR x = 0 OR y >= 7 - 1 OR x >= 7 - 1))"""


@query("border_labels", f"WITH {CELLS}, {BORDER} SELECT fov, label FROM border")
def border_labels(spark, sf):
    return O.border_labels(cells(spark, sf), buffer=1)


@query(
    "inner_border",
    f"""WITH {PX}, cl AS (SELECT fov, y, x, CASE WHEN e > 0.15 THEN label ELSE 0 END AS label FROM px)
        SELECT DISTINCT fov, label FROM cl WHERE label > 0 AND (y = 0 OR x = 0 OR y = 7 OR x = 7)""",
)
def inner_border(spark, sf):
    px = pixels(spark, sf).withColumn("label", F.when(F.col("e") > 0.15, F.col("label")).otherwise(0))
    return O.border_labels(px, buffer=0)


@query(
    "filter_objects",
    f"""WITH {SHAPES}, {BORDER}, k AS (SELECT fov, label FROM m WHERE area >= 13
          AND (fov, label) NOT IN (SELECT fov, label FROM border WHERE label > 2))
        SELECT fov, count(*) AS "Count_FinalNuc" FROM k GROUP BY 1""",
)
def filter_objects(spark, sf):
    px = cells(spark, sf)
    border = O.border_labels(px).where("label > 2")
    kept = O.filter_objects(O.shape_features(px), min_area=13, border=border)
    return O.counts_per_image(kept, "Count_FinalNuc")


@query(
    "bubbles",
    f"""WITH {SHAPES} SELECT fov, label, area FROM m WHERE area <= 10""",
)
def bubbles(spark, sf):
    return O.filter_objects(O.shape_features(cells(spark, sf)), max_area=10).select(
        "fov", "label", "area"
    )


@query(
    "cell_crop",
    f"""WITH {CELLS}, b AS (SELECT fov, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1
            FROM cl WHERE label > 0 GROUP BY 1, 2),
          r AS (SELECT b.*, cl.y, cl.x, CASE WHEN cl.label = b.label THEN v ELSE 0 END AS v
            FROM b JOIN cl ON cl.fov = b.fov AND cl.y BETWEEN y0 AND y1 AND cl.x BETWEEN x0 AND x1),
          m AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM r WINDOW w AS (PARTITION BY fov, label))
        SELECT fov, label, y - y0 AS crop_y, x - x0 AS crop_x, CAST(CASE WHEN hi > lo THEN
            round_even((v - lo) / CAST(hi - lo AS DOUBLE) * 255, 0) ELSE 255 END AS INTEGER) AS v FROM m""",
)
def cell_crop(spark, sf):
    return O.crop_cells(cells(spark, sf).select("fov", "y", "x", "label", "v"), ["v"])


@query(
    "missing_labels",
    f"""WITH {PX}, cl AS (SELECT DISTINCT fov, label FROM px WHERE v > 1250)
        SELECT fov, count(*) AS labels, min(label) AS first, max(label) AS last FROM cl GROUP BY 1
        HAVING min(label) <> 1 OR max(label) <> count(*)""",
)
def missing_labels(spark, sf):
    px = pixels(spark, sf).withColumn("label", F.when(F.col("v") > 1250, F.col("label")).otherwise(0))
    return O.missing_labels(px)


# ---------------------------------------------------------------- relations

# children: rows of two pixels height inside the image, only where the value is high
CHILDREN = f"""{CELLS}, ch AS (SELECT *, CASE WHEN probe = 1 THEN (y // 2) * 2 + x // 5 + 1 ELSE 0 END
    AS child FROM cl)"""


def children(spark, sf):
    return cells(spark, sf).withColumn(
        "child",
        F.when(F.col("probe") == 1, (F.expr("y div 2") * 2 + F.expr("x div 5") + 1)).otherwise(0)
        .cast("int"),
    )


OVERLAP = f"""{CHILDREN}, ov AS (SELECT fov, child, label, count(*) AS n FROM ch
      WHERE child > 0 AND label > 0 GROUP BY 1, 2, 3),
    rel AS (SELECT fov, child, label, n FROM (SELECT *, row_number() OVER (PARTITION BY fov, child
      ORDER BY n DESC, label) AS r FROM ov) WHERE r = 1)"""


@query(
    "relate_by_overlap", f"WITH {OVERLAP} SELECT fov, child, label, n AS overlap FROM rel"
)
def relate_by_overlap(spark, sf):
    return O.relate_by_overlap(children(spark, sf), "child", "label")


@query(
    "relate_by_centre",
    f"""WITH {CHILDREN}, c AS (SELECT fov, child, CAST(floor(avg(y)) AS INTEGER) AS y,
            CAST(floor(avg(x)) AS INTEGER) AS x FROM ch WHERE child > 0 GROUP BY 1, 2)
        SELECT c.fov, c.child, c.y, c.x, nullif(cl.label, 0) AS label
        FROM c LEFT JOIN cl ON cl.fov = c.fov AND cl.y = c.y AND cl.x = c.x""",
)
def relate_by_centre(spark, sf):
    return O.relate_by_centre(children(spark, sf), "child", "label")


@query(
    "relate_children",
    f"""WITH {OVERLAP}, p AS (SELECT DISTINCT fov, label FROM cl WHERE label > 0)
        SELECT p.fov, p.label, count(rel.child) AS "Children_probe_Count",
               round(avg(rel.n), 6) AS "Mean_overlap"
        FROM p LEFT JOIN rel ON rel.fov = p.fov AND rel.label = p.label GROUP BY 1, 2""",
)
def relate_children(spark, sf):
    px = children(spark, sf)
    parents = O.bounding_boxes(px).select("fov", "label")
    related = O.relate_by_overlap(px, "child", "label")
    out = O.children_per_parent(
        parents, related, ["fov", "label"], "Children_probe_Count", ["overlap"]
    )
    return rounded(out, ["Mean_overlap"])


@query(
    "merge_children",
    f"""WITH {OVERLAP} SELECT fov, child, label,
          CAST(dense_rank() OVER (PARTITION BY fov ORDER BY label) AS INTEGER) AS merged FROM rel""",
)
def merge_children(spark, sf):
    related = O.relate_by_overlap(children(spark, sf), "child", "label").drop("overlap")
    return O.merge_children(related, "label", "merged")


@query(
    "relabel",
    f"""WITH {SHAPES} SELECT fov, label, CAST(dense_rank() OVER (PARTITION BY fov
          ORDER BY y0 * 100 + x0) AS INTEGER) AS kept_label FROM m WHERE area >= 13""",
)
def relabel(spark, sf):
    kept = O.filter_objects(O.shape_features(cells(spark, sf)), min_area=13)
    return O.relabel(kept.withColumn("__o", F.col("y0") * 100 + F.col("x0")), "__o", "kept_label").select(
        "fov", "label", "kept_label"
    )


# ---------------------------------------------------------------- class areas

FRACTION_SQL = f"""WITH {SCORE_PX}, k AS (SELECT *, CASE WHEN nucleus > 0 THEN 0 ELSE CAST(list_position(
            [p1, p2, p3, p4, p5], greatest(p1, p2, p3, p4, p5)) AS INTEGER) END AS c FROM sc),
          b AS (SELECT fov, quantile_cont(v, 0.1) AS bg FROM sc GROUP BY 1),
          g AS (SELECT fov, label, count(*) AS n, round(count(*) FILTER (c = 0) / count(*), 6) AS bgd,
            round(count(*) FILTER (c = 2) / count(*), 6) AS fib, round(avg(p5), 6) AS pz,
            median(v) AS md, CAST(sum(v) AS DOUBLE) AS tot FROM k GROUP BY 1, 2)
        SELECT g.fov, label, n AS "Total_Area", bgd AS "Frac_Area_Background", fib AS "Frac_Area_Fibers",
          pz AS "Prob_Organized_ZDisks", md AS "Intensity_Median", tot AS "Intensity_Integrated",
          round(bg, 6) AS "Background_Value", round(md - bg, 6) AS "Intensity_Median_BackSub",
          round(tot - n * bg, 6) AS "Intensity_Integrated_BackSub"
        FROM g JOIN b ON b.fov = g.fov"""


def classed_pixels(spark, sf):
    scores = ["p1", "p2", "p3", "p4", "p5"]
    return score_pixels(spark, sf).withColumn("cls", O.class_map(scores, F.col("nucleus") > 0))


def rounded_fractions(px):
    out = O.class_fractions(px)
    keep = [
        "Total_Area", "Frac_Area_Background", "Frac_Area_Fibers", "Prob_Organized_ZDisks",
        "Intensity_Median", "Intensity_Integrated", "Background_Value",
        "Intensity_Median_BackSub", "Intensity_Integrated_BackSub",
    ]
    return rounded(out.select("fov", "label", *keep), keep[1:4] + keep[6:])


@query("class_fractions", FRACTION_SQL)
def class_fractions(spark, sf):
    return rounded_fractions(classed_pixels(spark, sf))


@query("stored_fractions", FRACTION_SQL)
def stored_fractions(spark, sf):
    return rounded_fractions(stored(classed_pixels(spark, sf)))


@query(
    "probe_by_class",
    f"""WITH {PX} SELECT fov, label, count(*) AS cell_px, count(*) FILTER (nucleus = 1) AS nuc_px,
          count(*) FILTER (nucleus = 0 AND probe > 0) AS probe_total_probe_cyto,
          count(*) FILTER (nucleus = 0 AND probe > 0 AND cls = 1) AS probe_probe_px_class_1,
          count(*) FILTER (nucleus = 0 AND cls = 1) AS probe_area_px_class_1,
          count(*) FILTER (nucleus = 0 AND probe > 0 AND cls = 4) AS probe_probe_px_class_4,
          count(*) FILTER (nucleus = 0 AND cls = 4) AS probe_area_px_class_4,
          count(*) FILTER (nucleus = 1 AND probe > 0) AS probe_probe_px_nuc
        FROM px GROUP BY 1, 2 HAVING count(*) > count(*) FILTER (nucleus = 1)""",
)
def probe_by_class(spark, sf):
    return O.probe_by_class(pixels(spark, sf), ["probe"], [1, 4])


# ---------------------------------------------------------------- the field job

@query(
    "field_manifest",
    f"""WITH {PX} SELECT fov, 'raw/fov_' || fov || '.ome.tiff' AS "2D_fov_tiff_path",
          'out/output_field_images/fov_' || fov || '.ome_rescaled.ome.tiff' AS rescaled_2D_fov_tiff_path,
          label AS cell_label_value, 'out/output_single_cell_images/fov_' || fov || '.ome_rescaled_cell'
            || label || '.ome.tiff' AS rescaled_2D_single_cell_tiff_path
        FROM (SELECT DISTINCT fov, label FROM px)""",
)
def field_manifest(spark, sf):
    fields = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"),
        F.format_string("raw/fov_%d.ome.tiff", "vec_id").alias("2D_fov_tiff_path"),
    )
    px = pixels(spark, sf)
    long = px.select("fov", "y", "x", F.explode(F.array(
        F.struct(F.lit("488").alias("channel"), F.col("v").alias("v")),
        F.struct(F.lit("cell").alias("channel"), F.col("label").cast("long").alias("v")),
    )).alias("c")).select("fov", "y", "x", "c.*")
    made = FD.process_fields(fields, long, "out", channels=["488", "cell"])
    return made["manifest"]


@query(
    "field_crops",
    f"""WITH {PX}, q AS (SELECT fov, quantile_cont(v, 0.0) AS lo, quantile_cont(v, 0.998) AS hi FROM px
            GROUP BY 1),
          s AS (SELECT px.fov, label, y, x, round_even((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255, 0)
            AS s FROM px JOIN q USING (fov)),
          m AS (SELECT *, min(s) OVER w AS a, max(s) OVER w AS b, min(y) OVER w AS y0, min(x) OVER w AS x0
            FROM s WINDOW w AS (PARTITION BY fov, label))
        SELECT fov, label, y - y0 AS crop_y, x - x0 AS crop_x,
          CAST(round_even((s - a) / (b - a) * 255, 0) AS INTEGER) AS "488" FROM m""",
)
def field_crops(spark, sf):
    fields = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"), F.lit("a.tiff").alias("2D_fov_tiff_path"))
    px = pixels(spark, sf)
    long = px.select("fov", "y", "x", F.explode(F.array(
        F.struct(F.lit("488").alias("channel"), F.col("v").alias("v")),
        F.struct(F.lit("cell").alias("channel"), F.col("label").cast("long").alias("v")),
    )).alias("c")).select("fov", "y", "x", "c.*")
    made = FD.process_fields(fields, long, "out", channels=["488", "cell"])
    return made["crops"].drop("cell")
