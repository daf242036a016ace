"""Whole jobs: the merged cell table, the plot tables, files in and out."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.measures import rounded
from catalog.tables import scratch, table
from cytoframe.functions import scalars as S
from cytoframe.operators import columns as C
from cytoframe.operators import joins as J
from cytoframe.operators.ranks import group_quantiles
from cytoframe.operators.reshape import stack, tidy
from cytoframe.operators.stats import mean_interval
from cytoframe.plans import cell_table as CT
from cytoframe.plans import plot_tables as PT
from cytoframe.session import stored
from cytoframe.sources import readers as SR
from cytoframe.sources import writers as SW


# ---------------------------------------------------------------- flagship

@query(
    "order_profile",
    """WITH p AS (SELECT l_orderkey, sum(l_quantity) AS area, count(*) AS n,
                    sum(l_extendedprice) FILTER (l_returnflag = 'A') AS a,
                    sum(l_extendedprice) FILTER (l_returnflag = 'N') AS n_,
                    sum(l_extendedprice) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1),
            j AS (SELECT o_orderstatus, area, a, n_, r FROM orders JOIN p ON l_orderkey = o_orderkey),
            t AS (SELECT o_orderstatus, 'A' AS probe, a / area AS density FROM j WHERE a IS NOT NULL
              UNION ALL SELECT o_orderstatus, 'N', n_ / area FROM j WHERE n_ IS NOT NULL
              UNION ALL SELECT o_orderstatus, 'R', r / area FROM j WHERE r IS NOT NULL)
       SELECT o_orderstatus, probe, round(avg(density), 6) AS mean,
              round(quantile_cont(density, 0.025), 6) AS ci_low,
              round(quantile_cont(density, 0.975), 6) AS ci_high FROM t GROUP BY 1, 2""",
)
def order_profile(spark, sf):
    """Objects per image, one column per probe, tidied to densities with their intervals."""
    flags = ["A", "N", "R"]
    per_image = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum("l_quantity").alias("area"),
        *[
            F.sum(F.when(F.col("l_returnflag") == f, F.col("l_extendedprice"))).alias(f"{f}_count")
            for f in flags
        ],
    )
    images = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    joined = J.merge(images, per_image)
    long = tidy(joined, [f"{f}_count" for f in flags], "probe", "amount")
    long = long.withColumn("density", S.ratio("amount", "area"))
    out = mean_interval(long, ["o_orderstatus", "probe"], "density")
    return rounded(out, ["mean", "ci_low", "ci_high"])


# ---------------------------------------------------------------- merged cell table

def image_tables(spark, sf):
    """The five image-analysis tables, with orders as images and lines as objects."""
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("ImageNumber"), F.col("l_linenumber").alias("ObjectNumber")
    ).agg(
        F.sum("l_quantity").alias("AreaShape_Area"), F.count("*").alias("n"),
        F.min("l_discount").alias("d"), F.max("l_tax").alias("t"),
        F.max("l_returnflag").alias("flag"),
    )
    return {
        "image": orders.select(
            F.col("o_orderkey").alias("ImageNumber"),
            F.lit("/img").alias("ObjectsPathName_napari_cell"),
            F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias(
                "ObjectsFileName_napari_cell"
            ),
            F.when(F.col("o_orderstatus") == "F", 1.0)
            .when(F.col("o_orderstatus") == "O", 0.0).alias("ModuleError_1"),
            F.col("o_custkey").alias("Count_nuc"),
        ),
        "merged_nuclei": lines.where("d <= 0.05").select(
            "ImageNumber", "ObjectNumber", F.col("ObjectNumber").alias("Parent_FilterNuc"),
            "AreaShape_Area", F.lit(1).alias("Number_Object_Number"),
        ),
        "premerge_nuclei_centroids": lines.where("t >= 0.02").select(
            "ImageNumber", (F.col("ObjectNumber") + 100).alias("ObjectNumber"),
            F.col("ObjectNumber").alias("Parent_FilterNuc"),
            F.when(F.col("flag") != "R", F.col("ObjectNumber")).alias("Parent_napari_cell"),
        ),
        "napari_cell": lines.select(
            "ImageNumber", "ObjectNumber", "AreaShape_Area",
            F.col("n").alias("Children_NucCentroid_Count"),
        ),
        "flag_border_nuclei": lines.where("t < 0.06").select(
            "ImageNumber", "ObjectNumber", F.col("ObjectNumber").alias("Parent_FinalNuc")
        ),
    }


CELL_SQL = """lines AS (SELECT l_orderkey AS img, l_linenumber AS obj, sum(l_quantity) AS area, count(*) AS n,
      min(l_discount) AS d, max(l_tax) AS t, max(l_returnflag) AS flag FROM lineitem GROUP BY 1, 2),
    a AS (SELECT m.img, m.obj AS nuc, m.area AS nuc_area, c.obj + 100 AS centroid, m.obj AS parent,
            CASE WHEN c.flag <> 'R' THEN c.obj END AS cell
          FROM lines m JOIN lines c ON m.img = c.img AND m.obj = c.obj WHERE m.d <= 0.05 AND c.t >= 0.02),
    b AS (SELECT coalesce(a.img, l.img) AS img, coalesce(a.cell, l.obj) AS cell, nuc, nuc_area, centroid,
            parent, l.area AS cell_area, l.n FROM a FULL JOIN lines l ON a.img = l.img AND a.cell = l.obj),
    br AS (SELECT img, obj FROM lines WHERE t < 0.06),
    c AS (SELECT coalesce(b.img, br.img) AS img, coalesce(b.nuc, br.obj) AS nuc, cell, nuc_area, centroid,
            parent, cell_area, n, br.img IS NULL AS border
          FROM b FULL JOIN br ON b.img = br.img AND b.nuc = br.obj),
    cells AS (SELECT coalesce(o.o_orderkey, c.img) AS "ImageNumber", '/img/i' || o.o_orderkey AS "ImagePath",
            coalesce(o.o_orderstatus = 'F', FALSE) AS "ImageFailed", cell AS "napariCell_ObjectNumber",
            n AS "napariCell_nuclei_Count", border AS finalnuc_border, nuc AS "finalnuc_ObjectNumber",
            parent AS "finalnuc_Parent_FilterNuc", centroid AS "nuccentroid_ObjectNumber",
            nuc_area AS "finalnuc_AreaShape_Area", cell_area AS "napariCell_AreaShape_Area"
          FROM orders o FULL JOIN c ON o.o_orderkey = c.img)"""


@query(
    "merged_cells", f"WITH {CELL_SQL} SELECT * FROM cells"
)
def merged_cells(spark, sf):
    from cytoframe.operators.quality import failed_images

    tables = image_tables(spark, sf)
    return CT.merge_cells(tables, failed_images(tables["image"]))


def manifests(spark, sf):
    """Image manifest and sample metadata for two thirds and half of the images."""
    orders = table(spark, sf, "orders")
    manifest = orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("fov_id"),
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("original_fov_location"),
        F.concat(F.lit("i"), F.col("o_orderkey").cast("string")).alias("rescaled_2D_fov_tiff_path"),
    )
    samples = orders.where("o_totalprice > 250000").select(
        F.concat(F.lit("f"), F.col("o_custkey").cast("string")).alias("fov_path"),
        F.col("o_orderkey").alias("FOVId"), F.col("o_orderpriority").alias("plate_name"),
        F.lit(18).alias("cell_age"), F.lit("x").alias("notes"), F.lit("y").alias("ge_wellID"),
    )
    border = table(spark, sf, "lineitem").where("l_shipdate < timestamp_ntz'1996-01-01'").select(
        F.col("l_orderkey").alias("FOVId"),
        F.concat(F.lit("/img/i"), F.col("l_orderkey").cast("string")).alias("ImagePath"),
        F.col("l_linenumber").alias("napariCell_ObjectNumber"), F.lit(True).alias("cell_border"),
    ).distinct()
    paths = manifest.select(
        F.col("fov_id").alias("FOVId"), F.col("original_fov_location").alias("fov_path")
    )
    return manifest, samples, J.merge(border, paths, ["FOVId"])


@query(
    "feature_table",
    f"""WITH {CELL_SQL},
      m AS (SELECT o_orderkey AS fov, 'f' || o_custkey AS fov_path, '/img/i' || o_orderkey AS path
            FROM orders WHERE o_orderstatus <> 'P'),
      s AS (SELECT o_orderkey AS fov, 'f' || o_custkey AS fov_path, o_orderpriority AS plate_name, 18 AS age
            FROM orders WHERE o_totalprice > 250000),
      j1 AS (SELECT cells.*, m.fov, m.fov_path, coalesce("ImagePath", m.path) AS ip
             FROM cells FULL JOIN m ON "ImagePath" IS NOT DISTINCT FROM m.path),
      j2 AS (SELECT j1.* EXCLUDE (fov, fov_path), coalesce(j1.fov, s.fov) AS fov,
               coalesce(j1.fov_path, s.fov_path) AS fov_path, s.plate_name, s.age
             FROM j1 FULL JOIN s ON j1.fov IS NOT DISTINCT FROM s.fov
               AND j1.fov_path IS NOT DISTINCT FROM s.fov_path),
      bd AS (SELECT DISTINCT l_orderkey AS fov, '/img/i' || l_orderkey AS path, l_linenumber AS obj,
               m.fov_path FROM lineitem JOIN m ON m.fov = l_orderkey
             WHERE l_shipdate < TIMESTAMP '1996-01-01')
      SELECT "ImageNumber", j2.fov AS "FOVId", ip AS "ImagePath", "ImageFailed", "napariCell_ObjectNumber",
        j2.fov_path, plate_name, CAST(age AS INTEGER) AS cell_age, bd.fov IS NOT NULL AS cell_border,
        finalnuc_border, "napariCell_AreaShape_Area", "finalnuc_AreaShape_Area"
      FROM j2 LEFT JOIN bd ON j2.fov = bd.fov AND ip = bd.path AND j2.fov_path = bd.fov_path
        AND "napariCell_ObjectNumber" = bd.obj
      WHERE "ImageNumber" IS NOT NULL""",
)
def feature_table(spark, sf):
    manifest, samples, border = manifests(spark, sf)
    cells = CT.feature_table(
        image_tables(spark, sf), manifest, samples, border_cells=border,
        single_cells=False, root="/img",
    )
    return C.keep_existing(cells, [
        "ImageNumber", "FOVId", "ImagePath", "ImageFailed", "napariCell_ObjectNumber", "fov_path",
        "plate_name", "cell_age", "cell_border", "finalnuc_border", "napariCell_AreaShape_Area",
        "finalnuc_AreaShape_Area",
    ])


@query(
    "image_counts",
    f"""WITH {CELL_SQL}, md AS (SELECT DISTINCT "ImageNumber" AS img, "ImagePath" AS path,
          CAST("ImageNumber" % 3 AS INTEGER) AS age FROM cells)
        SELECT coalesce(o_orderkey, img) AS "ImageNumber", coalesce('/img/i' || o_orderkey, path)
          AS "ImagePath", age AS cell_age, o_custkey AS "Count_nuc"
        FROM orders FULL JOIN md ON o_orderkey = img AND '/img/i' || o_orderkey = path""",
)
def image_counts(spark, sf):
    tables = image_tables(spark, sf)
    cells = CT.merge_cells(tables).withColumn(
        "cell_age", (F.col("ImageNumber") % 3).cast("int")
    )
    return CT.object_counts(tables["image"], cells)


# ---------------------------------------------------------------- plot tables

PROBES = ["MYH6-B1", "MYH7-B4", "TCAP-B3"]


def stand_in_features(spark, sf):
    """A feature table with one row per (order, line) of orders with few gaps."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"),
        F.sum("l_tax").alias("t"), F.sum("l_discount").alias("d"), F.count("*").alias("n"),
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"),
    )
    part, line = F.col("part"), F.col("l_linenumber")
    pick = lambda c: F.element_at(F.array(*[F.lit(p) for p in PROBES]), (c % 3 + 1).cast("int"))
    return lines.select(
        F.col("l_orderkey").alias("ImageNumber"),
        line.alias("napariCell_ObjectNumber"),
        F.concat(F.lit("/fov/"), F.col("l_orderkey").cast("string")).alias("fov_path"),
        F.concat(F.lit("cell"), line.cast("string")).alias("rescaled_2D_single_cell_tiff_path"),
        F.when(F.col("supp") % 2 == 0, 18).otherwise(32).alias("cell_age"),
        F.col("n").cast("int").alias("napariCell_nuclei_Count"),
        (F.col("t") > 0.04).alias("finalnuc_border"),
        ((part % 6) - 0).cast("int").alias("mh_structure_org_score"),
        ((part % 5) + 1).cast("int").alias("kg_structure_org_score"),
        pick(part).alias("probe546"), pick(part + 1).alias("probe647"),
        F.when(part % 4 == 0, "n").otherwise((part % 4).cast("string")).alias("probe_561_loc_score"),
        F.when(line % 4 == 0, None).otherwise((line % 4).cast("string")).alias("probe_638_loc_score"),
        F.col("q").alias("napariCell_AreaShape_Area"),
        (F.col("q") + 10).alias("napariCell_AreaShape_MajorAxisLength"),
        F.col("q").alias("napariCell_AreaShape_MinorAxisLength"),
        F.col("p").alias("napariCell_Children_seg_probe_561_Count"),
        (F.col("p") / 2).alias("napariCell_Children_seg_probe_638_Count"),
        F.col("d").alias("napariCell_Center_X_Center_"),
        F.when(F.col("d") > 0.03, F.col("d")).alias("finalnuc_sparse_Texture_"),
        F.lit(1.0).alias("finalnuc_flat_Texture_"),
    )


OBS = [
    "ImageNumber", "napariCell_ObjectNumber", "fov_path", "rescaled_2D_single_cell_tiff_path",
    "cell_age", "napariCell_nuclei_Count", "finalnuc_border", "mh_structure_org_score",
    "kg_structure_org_score", "probe546", "probe647", "probe_561_loc_score",
    "probe_638_loc_score",
]

FEATURE_SQL = """f AS (SELECT l_orderkey AS o, l_linenumber AS c, '/fov/' || l_orderkey AS fov_path,
      sum(l_quantity) AS q, sum(l_extendedprice) AS p, sum(l_tax) AS t, sum(l_discount) AS d,
      count(*) AS n, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
    k AS (SELECT *, CAST(part % 6 AS INTEGER) AS mh, CAST(part % 5 AS INTEGER) + 1 AS kg,
      (['MYH6', 'MYH7', 'TCAP'])[part % 3 + 1] AS p1, (['MYH6', 'MYH7', 'TCAP'])[(part + 1) % 3 + 1] AS p2
      FROM f WHERE part % 6 <> 0)"""


@query(
    "clean_features",
    f"""WITH {FEATURE_SQL} SELECT o AS "ImageNumber", c AS "napariCell_ObjectNumber", mh, kg,
          q AS "napariCell_AreaShape_Area" FROM k""",
)
def clean_features(spark, sf):
    df, features = PT.clean_features(stand_in_features(spark, sf), OBS)
    wanted = {"napariCell_AreaShape_Area", "napariCell_AreaShape_MajorAxisLength",
              "napariCell_AreaShape_MinorAxisLength", "napariCell_Children_seg_probe_561_Count",
              "napariCell_Children_seg_probe_638_Count"}
    if set(features) != wanted:
        raise ValueError(f"features kept: {sorted(features)}")
    return df.select(
        "ImageNumber", "napariCell_ObjectNumber", F.col("mh_structure_org_score").alias("mh"),
        F.col("kg_structure_org_score").alias("kg"), "napariCell_AreaShape_Area",
    )


@query(
    "annotation_checks",
    f"""WITH {FEATURE_SQL}, c AS (SELECT count(*) AS n, count(DISTINCT (o, c)) AS cells FROM k)
        SELECT * FROM (VALUES ('region known', 0::BIGINT, 0::BIGINT, TRUE), ('channel known', 0, 0, TRUE),
         ('type known', 0, 0, TRUE), ('wavelength of FISH', (SELECT CAST(2 AS BIGINT) WHERE EXISTS
         (SELECT 1 FROM lineitem)), 2, TRUE)) AS x("check", observed, expected, ok)
        UNION ALL SELECT 'cells named once', cells, n, cells = n FROM c
        UNION ALL SELECT 'probes known', count(*) FILTER (p1 IN ('MYH6', 'MYH7') AND p2 IN ('MYH6', 'MYH7', 'TCAP')), count(*),
          bool_and(p1 IN ('MYH6', 'MYH7') AND p2 IN ('MYH6', 'MYH7', 'TCAP')) FROM k
        UNION ALL SELECT 'features measured', 5 * n, 5 * n, TRUE FROM c""",
)
def annotation_checks(spark, sf):
    df, features = PT.clean_features(stand_in_features(spark, sf), OBS)
    known = {"probe546": PROBES[:2], "probe647": PROBES}
    cells = PT.cell_checks(df, features, ["ImageNumber", "napariCell_ObjectNumber"], known)
    return PT.annotation_checks(df, features).unionByName(cells)


def stand_in_structure(features):
    q, d = F.col("napariCell_AreaShape_Area"), F.col("napariCell_Center_X_Center_")
    shares = {
        "Frac_Area_Background": F.pmod(q, F.lit(7.0)) / 10, "Frac_Area_DiffuseOthers": d,
        "Frac_Area_Fibers": F.pmod(q, F.lit(5.0)) / 10,
        "Frac_Area_Disorganized_Puncta": F.pmod(q, F.lit(3.0)) / 10,
        "Frac_Area_Organized_Puncta": F.pmod(q, F.lit(11.0)) / 20,
        "Frac_Area_Organized_ZDisks": F.pmod(q, F.lit(13.0)) / 30,
        "Maximum_Coefficient_Variation": d * d, "Peak_Height": F.sqrt(q), "Peak_Distance": q % 9,
        "Peak_Angle": q % 4, "IntensityMedian": q * 2 + d, "IntensityIntegrated": q * 100,
        "IntensityMedianBkgSub": q, "IntensityIntegratedBkgSub": q * 10,
    }
    return features.select(
        "napariCell_ObjectNumber", F.col("fov_path").alias("original_fov_location"),
        *[e.cast("double").alias(n) for n, e in shares.items()],
    )


def analysis(spark, sf):
    raw = stored(stand_in_features(spark, sf))
    features, _ = PT.clean_features(raw, OBS)
    return raw, *PT.analysis_tables(features, stand_in_structure(raw), PROBES)


@query(
    "tidy_cells",
    f"""WITH {FEATURE_SQL}, t AS (
          SELECT o, c, mh, kg, q, p1 AS probe, p AS n FROM k
          UNION ALL SELECT o, c, mh, kg, q, p2, p / 2 FROM k)
        SELECT '/fov/' || o AS fov_path, c AS "napariCell_ObjectNumber", (mh + kg) / 2.0 AS structure_org_score,
          probe AS "FISH_probe", round(n, 6) AS "FISH_probe_count", round(n / q, 10) AS "FISH_probe_density",
          CASE CAST(ceil((mh + kg) / 2.0) AS INTEGER) WHEN 1 THEN '1-2' WHEN 2 THEN '1-2'
            WHEN 3 THEN '3' ELSE '4-5' END AS "group"
        FROM t""",
)
def tidy_cells(spark, sf):
    _, _, long, _ = analysis(spark, sf)
    out = long.select(
        "fov_path", "napariCell_ObjectNumber", "structure_org_score", "FISH_probe",
        "FISH_probe_count", "FISH_probe_density",
        F.col("consensus_structure_org_score_grouped").alias("group"),
    )
    return rounded(rounded(out, ["FISH_probe_count"]), ["FISH_probe_density"], 10)


@query(
    "plot_dataset",
    f"""WITH {FEATURE_SQL}, pc AS (SELECT *, CASE WHEN p1 = 'MYH6' THEN p WHEN p2 = 'MYH6' THEN p / 2 END / q
            AS d6, CASE WHEN p1 = 'MYH7' THEN p WHEN p2 = 'MYH7' THEN p / 2 END / q AS d7,
            CASE WHEN supp % 2 = 0 THEN 18 ELSE 32 END AS age FROM k),
          md AS (SELECT median(d6) AS m6, median(d7) AS m7 FROM pc),
          days AS (SELECT age, median(q * 2 + d) AS m FROM pc GROUP BY 1)
        SELECT fov_path AS "FOV path", c AS "Cell number", age AS "Cell age",
          CAST(n AS INTEGER) AS "Nuclei count",
          round(q * 0.0144, 6) AS "Cell area (μm^2)", round(d6 / 0.0144, 4) AS "MYH6 (count/μm^2)",
          round((q * 2 + d) / m, 6) AS "Alpha-actinin intensity (median, normalized per day)",
          CASE WHEN d6 IS NOT NULL AND d7 IS NOT NULL THEN
            round((d7 / m7 - d6 / m6) / (d7 / m7 + d6 / m6), 6) END AS diff,
          CASE WHEN d6 IS NOT NULL AND d7 IS NOT NULL THEN CASE part % 4 WHEN 0 THEN 'Low expression'
            ELSE 'Sarcomeric' END END AS "MYH6 localization",
          CASE WHEN d6 IS NOT NULL AND d7 IS NOT NULL THEN round(p / (p + d) - (CAST(q AS BIGINT) % 5) / 10.0, 6)
            END AS gain
        FROM pc JOIN days USING (age), md""",
)
def plot_dataset(spark, sf):
    raw, wide, _, _ = analysis(spark, sf)
    cell = [F.col("fov_path").alias("original_fov_location"), "napariCell_ObjectNumber"]
    p = F.col("napariCell_Children_seg_probe_561_Count")
    metrics = raw.select(
        *cell, *[p.alias(f"seg_{w}_cell_abs_dist_struc_total_mean") for w in (561, 638)]
    )
    classes = raw.select(
        *cell,
        *[
            e.alias(f"seg_{w}_{n}")
            for w in (561, 638)
            for n, e in (
                ("probe_px_class_2", p), ("probe_px_class_4", p), ("probe_px_class_5", p),
                ("total_probe_cyto", p), ("probe_px_nuc", F.col("napariCell_Center_X_Center_")),
                ("probe_px_OUTSIDE_class_2", p),
            )
        ],
    )
    genes = [g.split("-")[0] for g in PROBES]
    out = PT.collated(wide, raw, metrics, classes, genes=genes)
    out = out.select(
        "FOV path", "Cell number", "Cell age", "Nuclei count", "Cell area (μm^2)", "MYH6 (count/μm^2)",
        "Alpha-actinin intensity (median, normalized per day)",
        F.col("MYH7-MYH6 relative transcript abundance (normalized)").alias("diff"),
        "MYH6 localization",
        F.col("Enrichment of MYH6 transcript localization to fibers").alias("gain"),
    )
    out = rounded(out, ["Cell area (μm^2)", "diff", "gain",
                        "Alpha-actinin intensity (median, normalized per day)"])
    return rounded(out, ["MYH6 (count/μm^2)"], 4)


SCORE_PARTS = "q, q / (q + 10), q % 7 / 10, d, q % 5 / 10, q % 3 / 10, q % 11 / 20, q % 13 / 30, d * d, sqrt(q), q % 9"


@query(
    "organisation_score",
    # standardised features, a row each; normal equations of the weighted ridge, the target in column 0;
    # one step of the recursion clears one column
    f"""WITH RECURSIVE {FEATURE_SQL}, x AS (SELECT o, c, (mh + kg) / 2.0 AS y, [{SCORE_PARTS}] AS parts FROM k),
          u AS (SELECT o, c, y, unnest(range(1, 12)) AS i, unnest(parts) AS v FROM x),
          st AS (SELECT i, avg(v) AS m, CASE WHEN max(v) = min(v) THEN 1 ELSE stddev_pop(v) END AS s FROM u GROUP BY 1),
          wt AS (SELECT y, sum(count(*)) OVER () / count(*) AS w FROM x GROUP BY 1),
          z AS (SELECT o, c, i, (v - m) / s AS v, w FROM u JOIN st USING (i) JOIN wt USING (y)
                UNION ALL SELECT o, c, 0, y, w FROM x JOIN wt USING (y)),
          mid AS (SELECT i, sum(w * v) / sum(w) AS m FROM z GROUP BY 1),
          e AS (SELECT o, c, i, v - m AS v, w FROM z JOIN mid USING (i)),
          eq AS (SELECT a.i, b.i AS j, sum(a.w * a.v * b.v) + CASE WHEN a.i = b.i THEN 0.001 ELSE 0 END AS v
                 FROM e a JOIN e b ON a.o = b.o AND a.c = b.c WHERE a.i > 0 GROUP BY 1, 2),
          g AS (SELECT 0 AS step, i, j, CAST(v AS DOUBLE) AS v FROM eq
                UNION ALL SELECT g.step + 1, g.i, g.j, CASE WHEN g.i = p.i THEN g.v / p.v ELSE g.v - r.v * t.v / p.v END
                FROM g JOIN g p ON p.i = g.step + 1 AND p.j = g.step + 1
                  JOIN g r ON r.i = g.i AND r.j = g.step + 1 JOIN g t ON t.i = g.step + 1 AND t.j = g.j
                WHERE g.step < 11),
          scored AS (SELECT o, c, sum(e.v * g.v) + (SELECT m FROM mid WHERE i = 0) AS score
                     FROM e JOIN g ON g.i = e.i AND g.j = 0 AND g.step = 11 GROUP BY 1, 2)
        SELECT y AS structure_org_score, round(quantile_cont(score, 0.25), 5) AS low,
          round(quantile_cont(score, 0.5), 5) AS middle, round(quantile_cont(score, 0.75), 5) AS high
        FROM x JOIN scored USING (o, c) GROUP BY 1""",
)
def organisation_score(spark, sf):
    _, wide, _, model = analysis(spark, sf)
    scored = wide.select(
        "fov_path", "napariCell_ObjectNumber", "structure_org_score",
        "structure_org_weighted_linear_model_all",
    )
    quartiles = group_quantiles(
        scored, ["structure_org_score"], "structure_org_weighted_linear_model_all",
        {"low": 0.25, "middle": 0.5, "high": 0.75},
    )
    return rounded(quartiles, ["low", "middle", "high"], 5)


@query(
    "revised_table",
    f"""WITH {FEATURE_SQL.replace('WHERE part % 6 <> 0', '')}, fish AS (SELECT CAST(c AS VARCHAR) AS cell, fov_path, supp,
            part, mh, kg, q, CASE WHEN p1 = 'MYH6' THEN p WHEN p2 = 'MYH6' THEN p / 2 END / q AS d6,
            CASE WHEN supp % 2 = 0 THEN 18 ELSE 32 END AS age FROM k),
          live AS (SELECT o_orderkey, 'live' || o_orderkey AS fov_path, o_totalprice AS tot, o_custkey AS a
                   FROM orders)
        SELECT cell AS "napariCell_ObjectNumber", fov_path, 'FISH' AS "Type", age AS "Cell age",
          CASE WHEN supp % 2 = 0 THEN mh > 0 AND kg > 0 ELSE part % 10 <> 0 END AS gfp_keep,
          round(q * 0.0144, 6) AS area, round(d6 / 0.0144, 4) AS myh6,
          (mh + kg) / 2.0 AS expert FROM fish
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), fov_path, 'Live', 18,
          coalesce(tot / nullif(CAST(a AS DOUBLE), 0) >= 1080, FALSE), round(a * 0.0144, 6), NULL, 3.0 FROM live""",
)
def revised_table(spark, sf):
    cells = stand_in_features(spark, sf).withColumns({
        "plate_name": F.col("cell_age").cast("long"), "well_position": F.lit("B3"),
        "image_date": F.lit("2019"),
        "no_structure": F.when(F.col("napariCell_Children_seg_probe_561_Count").isNull(), 0),
    })
    part = table(spark, sf, "lineitem").groupBy(
        F.col("l_orderkey").alias("ImageNumber"), F.col("l_linenumber").alias("napariCell_ObjectNumber")
    ).agg(F.min("l_partkey").alias("part"))
    cells = stored(
        J.merge(cells, part, ["ImageNumber", "napariCell_ObjectNumber"], "inner", False)
    )
    cells = cells.withColumn("no_structure", F.when(F.col("part") % 10 == 0, 0))
    scored = cells.where("cell_age = 18").drop("no_structure")
    marked = cells.where("cell_age = 32")
    plates = table(spark, sf, "region").where("r_regionkey < 2").select(
        F.when(F.col("r_regionkey") == 0, 18).otherwise(32).alias("Plate Name"),
        F.lit("2019-05-17").alias("Replate Date"),
        F.when(F.col("r_regionkey") == 0, "OldFish").otherwise("Bonus").alias("Dataset"),
    )
    structure = stand_in_structure(cells)
    fish = PT.revised_fish(scored, [marked], plates, [structure])
    orders = table(spark, sf, "orders")
    live = orders.select(
        F.col("o_orderkey").alias("cell_id"),
        F.concat(F.lit("live"), F.col("o_orderkey").cast("string")).alias("FOV"),
        F.lit(19).alias("Cell age"), F.lit(7).cast("long").alias("plate_name"),
        F.lit("A1").alias("well_position"), F.col("o_custkey").cast("double").alias("Area"),
        F.lit(0.5).alias("Aspect_Ratio"), F.lit(2).alias("MH_score"), F.lit(4).alias("KG_score"),
        F.col("o_totalprice").alias("full_cell_total_sum_intensity_bg_subtracted"),
        *[F.lit(0.1).alias(c) for c in (
            "diffuse_fraction_area_covered", "fibers_fraction_area_covered",
            "Frac_Area_Background", "disorganized_puncta_fraction_area_covered",
            "organized_puncta_fraction_area_covered", "organized_z_disk_fraction_area_covered",
            "Maximum_Coefficient_Variation", "Peak_Height", "Peak_Distance")],
    )
    out = PT.revised_table(fish, PT.revised_live(live))
    out = out.select(
        "napariCell_ObjectNumber", "fov_path", "Type", "Cell age", "gfp_keep",
        F.col("Cell area (μm^2)").alias("area"), F.col("MYH6 (count/μm^2)").alias("myh6"),
        F.col("Expert structural annotation score (mean)").alias("expert"),
    )
    return rounded(rounded(out, ["area"]), ["myh6"], 4)


# ---------------------------------------------------------------- files

@query(
    "csv_roundtrip",
    """SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, CAST(s_acctbal AS VARCHAR) AS s_acctbal,
         'Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS s_name FROM supplier""",
)
def csv_roundtrip(spark, sf):
    folder = scratch(spark)
    supplier = table(spark, sf, "supplier").withColumn("Unnamed: 0", F.lit(1))
    SW.write_table(supplier, f"{folder}/supplier", ["s_suppkey", "s_name"])
    df = SR.read_features(spark, f"{folder}/supplier", ["s_name", "s_acctbal"], ["s_suppkey"])
    return C.drop_existing(df, ["Unnamed: 0"])


@query(
    "listed_files",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def listed_files(spark, sf):
    folder = scratch(spark)
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    for segment in ("BUILDING", "MACHINERY", "HOUSEHOLD"):
        SW.write_table(customer.where(F.col("c_mktsegment") == segment), f"{folder}/{segment}")
    listed = customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(
        F.concat(F.lit(folder + "/"), "c_mktsegment").alias("score_path")
    ).distinct()
    return SR.read_listed(spark, listed, "score_path", "c_custkey long, c_mktsegment string")


@query(
    "field_results",
    """SELECT n_regionkey AS "FOVId", n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (2)""",
)
def field_results(spark, sf):
    folder = scratch(spark)
    nation = table(spark, sf, "nation").select(
        "n_nationkey", "n_name", F.format_string("fov_%d.csv", "n_regionkey").alias("file")
    )
    nation.write.partitionBy("file").option("header", True).csv(folder)
    expected = table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("FOVId"))
    found, _ = SR.read_field_results(
        spark, folder, "n_nationkey int, n_name string", expected, deny=[2],
        pattern="*.csv", number=r"fov_(\d+)\.csv/[^/]*$",
    )
    return found.drop("file")


@query(
    "published_dataset",
    """SELECT s_suppkey AS "SupplierId", s_name AS "Name", 'text' AS role
       FROM supplier WHERE s_acctbal IS NOT NULL""",
)
def published_dataset(spark, sf):
    folder = scratch(spark)
    spec = [("s_suppkey", "SupplierId", "number of the supplier"), ("s_name", "Name", "its name")]
    made = SW.by_dictionary(SW.complete_rows(table(spark, sf, "supplier")), spec)
    SW.publish(
        made, f"{folder}/supplier", "v1", metadata_columns=["SupplierId"], path_columns=["Name"],
        readme=SW.readme_text("Suppliers", spec),
    )
    roles = spark.read.parquet(f"{folder}/supplier/columns").where("role = 'path'")
    return SR.nan_to_null(SW.read_published(spark, f"{folder}/supplier")).withColumn(
        "role", F.lit("text" if roles.count() == 1 else "wrong")
    )


@query(
    "catalog_names",
    """SELECT 'owner/' || lower(r_name) AS dataset, CASE r_name WHEN 'ASIA' THEN 'fields_fish_1'
         ELSE lower(r_name) END AS published FROM region WHERE r_name <> 'EUROPE'""",
)
def catalog_names(spark, sf):
    names = table(spark, sf, "region").select(
        F.concat(F.lit("owner/"), F.lower("r_name")).alias("dataset")
    )
    present = names.where("dataset <> 'owner/europe'")
    return SW.catalog(names, {"owner/asia": "fields_fish_1"}, present, ["owner/europe"])


@query(
    "label_files",
    """SELECT CAST(l_orderkey AS INTEGER) AS image, CAST(l_linenumber AS INTEGER) AS r, CAST(l_quantity AS INTEGER) AS c,
         CASE WHEN l_linenumber < 3 THEN 0 WHEN l_linenumber < 5 THEN 1 ELSE 2 END AS class FROM lineitem""",
)
def label_files(spark, sf):
    """One coordinate file per class, read by the label list reader."""
    folder = scratch(spark)
    points = table(spark, sf, "lineitem")
    line = F.concat_ws(" ", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("int"))
    classes = {"low": F.col("l_linenumber") < 3, "middle": F.col("l_linenumber").isin(3, 4), "high": F.col("l_linenumber") > 4}
    for name, chosen in classes.items():
        points.where(chosen).select(line).write.text(f"{folder}/{name}")
    return SR.read_label_lists(spark, [f"{folder}/{name}" for name in classes])


@query(
    "matrix_files",
    """SELECT CAST(ps - 1 AS BIGINT) AS row, CAST(ln - 1 AS BIGINT) AS col, CAST(q AS BIGINT) AS count
       FROM (SELECT o_custkey % 40 + 1 AS ps, l_linenumber AS ln, sum(CAST(l_quantity AS BIGINT)) AS q
             FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)""",
)
def matrix_files(spark, sf):
    """A sparse matrix per column file, each with comments and a size line that may look like an entry."""
    folder = scratch(spark)
    entries = (
        table(spark, sf, "lineitem")
        .join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy((F.col("o_custkey") % 40 + 1).alias("row"), F.col("l_linenumber").alias("col"))
        .agg(F.sum(F.col("l_quantity").cast("long")).alias("count"))
    )
    lines = entries.select("col", F.lit(2).alias("place"), F.concat_ws(" ", "row", "col", "count").alias("value"))
    size = entries.groupBy("col").agg(F.max("row").alias("row"), F.count("*").alias("n"))
    heads = size.select(
        "col",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("place"), F.lit("%%MatrixMarket matrix coordinate integer general").alias("value")),
                F.struct(F.lit(1).alias("place"), F.concat_ws(" ", "row", "col", "n").alias("value")),
            )
        ).alias("h"),
    ).select("col", "h.place", "h.value")
    lines.unionByName(heads).repartition("col").sortWithinPartitions("col", "place").select("col", "value").write.partitionBy(
        "col"
    ).text(folder)
    return SR.read_matrix_market(spark, folder)


@query(
    "cell_table_files",
    """SELECT 'image' AS name, CAST(o_orderkey AS BIGINT) AS "ImageNumber", CAST(o_totalprice AS DOUBLE) AS value,
         CAST(NULL AS BIGINT) AS "ObjectNumber" FROM orders
       UNION ALL SELECT unnest(['merged_nuclei', 'flag_border_nuclei', 'napari_cell', 'premerge_nuclei_centroids']), l_orderkey,
         unnest([CAST(l_extendedprice AS DOUBLE), CAST(l_discount AS DOUBLE), CAST(l_quantity AS DOUBLE), CAST(l_tax AS DOUBLE)]),
         CAST(l_linenumber AS BIGINT) FROM lineitem""",
)
def cell_table_files(spark, sf):
    """All five whole tables of a run, written as its files, read back and stacked."""
    folder = scratch(spark)
    measured = {"merged_nuclei": "l_extendedprice", "flag_border_nuclei": "l_discount", "napari_cell": "l_quantity",
                "premerge_nuclei_centroids": "l_tax"}
    for name, file in SR.CELL_TABLE_FILES.items():
        if name == "image":
            rows = table(spark, sf, "orders").select(
                F.col("o_orderkey").alias("ImageNumber"), F.col("o_totalprice").cast("double").alias("value")
            )
        else:
            rows = table(spark, sf, "lineitem").select(
                F.col("l_orderkey").alias("ImageNumber"), F.col("l_linenumber").alias("ObjectNumber"),
                F.col(measured[name]).cast("double").alias("value"),
            )
        SW.write_table(rows, f"{folder}/run_{file}")
    read = SR.read_cell_tables(spark, folder, "run_")
    number = lambda name: "ObjectNumber" if name != "image" else F.lit(None).cast("long").alias("ObjectNumber")
    return stack([rows.select(F.lit(name).alias("name"), "ImageNumber", "value", number(name)) for name, rows in read.items()])


@query(
    "consolidated",
    """SELECT 'fields_fish_1' AS published, CAST(c_custkey AS BIGINT) AS key,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILT' ELSE c_mktsegment END AS value FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier""",
)
def consolidated(spark, sf):
    """Two published datasets under the names of the catalogue, one brought up to date, and read back."""
    source, target = scratch(spark), scratch(spark)
    customer = table(spark, sf, "customer").select(F.col("c_custkey").cast("long").alias("key"), F.col("c_mktsegment").alias("value"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("key"), F.col("s_name").alias("value"))
    SW.publish(customer, f"{source}/owner/customer", "v1")
    SW.publish(supplier, f"{source}/owner/supplier", "v1")
    names = spark.createDataFrame([("owner/customer",), ("owner/supplier",)], "dataset string")
    entries = SW.catalog(names, {"owner/customer": "fields_fish_1"}, names)
    SW.consolidate(spark, entries, source, target, parts=8)
    # customers of one segment change: their parts are written again, nothing of the other dataset is
    SW.publish(customer.withColumn("value", F.regexp_replace("value", "^BUILDING$", "BUILT")), f"{source}/owner/customer", "v2")
    again = SW.consolidate(spark, entries, source, target, parts=8)
    if again["supplier"] or not again["fields_fish_1"]:
        raise ValueError(f"parts written: {again}")
    read = [SW.read_latest(spark, f"{target}/{p}").withColumn("published", F.lit(p)) for p in ("fields_fish_1", "supplier")]
    return read[0].unionByName(read[1])
