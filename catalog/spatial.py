"""Components, hole filling, distances, probe localisation and texture."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.measures import rounded
from catalog.objects import CELLS, cells
from catalog.tables import PX, pixels, table
from cytoframe.operators import components as CC
from cytoframe.operators import distance as D
from cytoframe.operators import texture as T

# ---------------------------------------------------------------- components


def reach(source: str, near: str) -> str:
    """SQL: the smallest pixel number each pixel can reach through neighbours of its value."""
    return f"""nb AS (SELECT a.k, a.y * 1048576 + a.x AS p, b.y * 1048576 + b.x AS q
        FROM {source} a JOIN {source} b ON a.k = b.k AND a.m = b.m AND {near}),
      reached(k, p, q) AS (SELECT k, y * 1048576 + x, y * 1048576 + x FROM {source}
        UNION SELECT r.k, r.p, nb.q FROM reached r JOIN nb ON nb.k = r.k AND nb.p = r.q),
      comp AS (SELECT k, p // 1048576 AS y, p % 1048576 AS x, min(q) AS c FROM reached GROUP BY 1, 2, 3)"""


FOUR = "abs(a.y - b.y) + abs(a.x - b.x) = 1"
EIGHT = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1"


def _numbered(found, name="component"):
    """Component numbers as the SQL writes them: y * 2^20 + x of the first pixel, for the small images here."""
    row, column = F.shiftright(name, 32), F.col(name).bitwiseAND(F.lit(2**32 - 1))
    return found.withColumn(name, row * 1048576 + column)


@query(
    "components",
    f"""WITH RECURSIVE {CELLS}, src AS (SELECT fov AS k, y, x, label AS m FROM cl WHERE label > 0),
        {reach('src', FOUR)} SELECT k AS fov, y, x, c AS component FROM comp""",
)
def components(spark, sf):
    px = cells(spark, sf).select("fov", "y", "x", "label")
    return _numbered(CC.connected_components(px)).select("fov", "y", "x", "component")


@query(
    "components_8",
    f"""WITH RECURSIVE {PX}, src AS (SELECT fov AS k, y, x, probe AS m FROM px WHERE probe > 0),
        {reach('src', EIGHT)} SELECT k AS fov, c AS component, count(*) AS area FROM comp GROUP BY 1, 2""",
)
def components_8(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "probe")
    found = CC.connected_components(px, ["fov"], "probe", connectivity=8)
    return CC.component_areas(_numbered(found), ["fov"], "component")


@query(
    "small_objects",
    f"""WITH RECURSIVE {PX}, src AS (SELECT fov AS k, y, x, probe AS m FROM px WHERE probe > 0),
        {reach('src', EIGHT)}, a AS (SELECT k, c, count(*) AS n FROM comp GROUP BY 1, 2),
        g AS (SELECT comp.k, y, x FROM comp JOIN a ON a.k = comp.k AND a.c = comp.c WHERE n >= 4)
        SELECT px.fov, px.y, px.x, CASE WHEN g.k IS NULL THEN 0 ELSE 255 END AS kept
        FROM px LEFT JOIN g ON g.k = px.fov AND g.y = px.y AND g.x = px.x""",
)
def small_objects(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "probe")
    return CC.small_objects_removed(px, "probe", 4).drop("probe")


# objects for hole filling: label 1 where the value is low or the pixel is on a frame
RINGS = """rings AS (SELECT fov, y, x, CASE WHEN y IN (1, 6) OR x IN (1, 6) THEN 1 + fov % 2
      WHEN probe = 1 THEN 2 - fov % 2 ELSE 0 END AS label FROM px WHERE y BETWEEN 1 AND 6
      AND x BETWEEN 1 AND 6)"""


def rings(spark, sf):
    frame = F.col("y").isin(1, 6) | F.col("x").isin(1, 6)
    label = F.when(frame, 1 + F.col("fov") % 2).when(F.col("probe") == 1, 2 - F.col("fov") % 2)
    inside = F.col("y").between(1, 6) & F.col("x").between(1, 6)
    return pixels(spark, sf).select(
        "fov", "y", "x", F.when(inside, F.coalesce(label, F.lit(0))).otherwise(0).cast("int").alias("label")
    )


FILL = """own AS (SELECT fov * 10 + label AS k, y, x FROM {objects} WHERE label > 0),
      box AS (SELECT k, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM own GROUP BY 1),
      grid AS (SELECT k, y, x, y0, y1, x0, x1 FROM box, (SELECT unnest(range(8)) AS y),
        (SELECT unnest(range(8)) AS x) WHERE y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1),
      gap AS (SELECT g.* FROM grid g ANTI JOIN own ON own.k = g.k AND own.y = g.y AND own.x = g.x),
      outside(k, y, x) AS (SELECT k, y, x FROM gap WHERE y IN (y0, y1) OR x IN (x0, x1)
        UNION SELECT gap.k, gap.y, gap.x FROM outside o JOIN gap ON gap.k = o.k
          AND abs(gap.y - o.y) + abs(gap.x - o.x) = 1),
      claim AS (SELECT k, y, x FROM own UNION SELECT k, y, x FROM (SELECT k, y, x FROM gap
        EXCEPT SELECT k, y, x FROM outside))"""


@query(
    "fill_holes",
    f"""WITH RECURSIVE {PX}, {RINGS}, {FILL.format(objects='rings')}
        SELECT k // 10 AS fov, y, x, CAST(max(k % 10) AS INTEGER) AS label FROM claim GROUP BY 1, 2, 3""",
)
def fill_holes(spark, sf):
    return CC.fill_holes(rings(spark, sf))


@query(
    "repair_labels",
    f"""WITH RECURSIVE {PX}, {RINGS}, src AS (SELECT fov AS k, y, x, label AS m FROM rings WHERE label > 0),
        {reach('src', FOUR)},
        big AS (SELECT k, c FROM comp GROUP BY 1, 2 HAVING count(*) > 2),
        num AS (SELECT k, c, row_number() OVER (PARTITION BY k ORDER BY c) AS n FROM big),
        lab AS (SELECT comp.k * 1000 + n AS k, y, x FROM comp JOIN num ON num.k = comp.k AND num.c = comp.c),
        box AS (SELECT k, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY 1),
        gap AS (SELECT box.k, gy.y, gx.x, y0, y1, x0, x1 FROM box, (SELECT unnest(range(8)) AS y) gy,
          (SELECT unnest(range(8)) AS x) gx WHERE gy.y BETWEEN y0 AND y1 AND gx.x BETWEEN x0 AND x1
          AND NOT EXISTS (SELECT 1 FROM lab WHERE lab.k = box.k AND lab.y = gy.y AND lab.x = gx.x)),
        outside(k, y, x) AS (SELECT k, y, x FROM gap WHERE y IN (y0, y1) OR x IN (x0, x1)
          UNION SELECT gap.k, gap.y, gap.x FROM outside o JOIN gap ON gap.k = o.k
            AND abs(gap.y - o.y) + abs(gap.x - o.x) = 1),
        claim AS (SELECT k, y, x FROM lab UNION SELECT k, y, x FROM (SELECT k, y, x FROM gap
          EXCEPT SELECT k, y, x FROM outside)),
        f AS (SELECT k // 1000 AS fov, y, x, max(k % 1000) AS l FROM claim GROUP BY 1, 2, 3)
        SELECT px.fov, px.y, px.x, CAST(coalesce(l, 0) AS INTEGER) AS fixed
        FROM px LEFT JOIN f ON f.fov = px.fov AND f.y = px.y AND f.x = px.x""",
)
def repair_labels(spark, sf):
    return CC.repair_labels(rings(spark, sf), min_area=2).drop("label")


@query(
    "wrongly_labelled",
    f"""WITH RECURSIVE {CELLS}, src AS (SELECT fov AS k, y, x, label AS m FROM cl WHERE label > 0),
        {reach('src', FOUR)},
        a AS (SELECT fov, count(*) AS labelled FROM (SELECT fov, label FROM cl WHERE label > 0
              GROUP BY 1, 2 HAVING count(*) > 10) GROUP BY 1),
        b AS (SELECT k, count(*) AS found FROM (SELECT k, c FROM comp GROUP BY 1, 2
              HAVING count(*) > 10) GROUP BY 1)
        SELECT coalesce(fov, k) AS fov, coalesce(labelled, 0) AS labelled, coalesce(found, 0) AS found
        FROM a FULL JOIN b ON a.fov = b.k WHERE coalesce(labelled, 0) <> coalesce(found, 0)""",
)
def wrongly_labelled(spark, sf):
    return CC.wrongly_labelled(cells(spark, sf), min_area=10)


DEPTH = """depth AS (SELECT a.k, a.y, a.x, min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d
      FROM src a JOIN (SELECT fov AS k, y, x FROM px WHERE probe = 1) b ON a.k = b.k GROUP BY 1, 2, 3)"""


@query(
    "background",
    f"""WITH RECURSIVE {PX}, src AS (SELECT fov AS k, y, x, 1 AS m FROM px WHERE probe = 0),
        {reach('src', EIGHT)}, {DEPTH},
        deep AS (SELECT DISTINCT comp.k, c FROM comp JOIN depth ON depth.k = comp.k
                 AND depth.y = comp.y AND depth.x = comp.x WHERE d > 2.5),
        bg AS (SELECT comp.k, y, x FROM comp JOIN deep ON deep.k = comp.k AND deep.c = comp.c)
        SELECT px.fov, px.y, px.x, CASE WHEN bg.k IS NULL THEN 0 ELSE 1 END AS background
        FROM px LEFT JOIN bg ON bg.k = px.fov AND bg.y = px.y AND bg.x = px.x""",
)
def background(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", (1 - F.col("probe")).alias("quiet"))
    return CC.background_regions(px, "quiet", 2.5).drop("quiet")


# ---------------------------------------------------------------- distances

@query(
    "nearest_distance",
    f"""WITH {PX} SELECT a.fov, a.y, a.x, round(min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS distance
        FROM px a LEFT JOIN px b ON a.fov = b.fov AND b.nucleus = 1 GROUP BY 1, 2, 3""",
)
def nearest_distance(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "nucleus")
    out = D.distance_transform(px, ["fov"], F.col("nucleus") == 1)
    return rounded(out.drop("nucleus"), ["distance"])


REGIONS = f"""{CELLS}, bx AS (SELECT fov, label, CASE WHEN min(y) - 2 > 0 THEN min(y) - 2 ELSE min(y) END AS y0,
      max(y) + 1 AS y1, CASE WHEN min(x) - 2 > 0 THEN min(x) - 2 ELSE min(x) END AS x0, max(x) + 1 AS x1
      FROM cl WHERE label > 0 GROUP BY 1, 2),
    rg AS (SELECT bx.fov, bx.label, cl.y, cl.x, cl.probe, cl.nucleus, cl.label = bx.label AS in_cell
      FROM bx JOIN cl ON cl.fov = bx.fov AND cl.y BETWEEN y0 AND y1 AND cl.x BETWEEN x0 AND x1)"""


def regions(spark, sf):
    px = cells(spark, sf).select("fov", "y", "x", "label", "probe", "nucleus")
    return D.cell_regions(px, ["probe", "nucleus"], margin=2)


@query("cell_regions", f"WITH {REGIONS} SELECT * FROM rg")
def cell_regions(spark, sf):
    return regions(spark, sf)


@query(
    "relative_depth",
    f"""WITH {REGIONS}, d AS (SELECT a.fov, a.label, a.y, a.x,
            min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS d FROM rg a LEFT JOIN rg b
            ON a.fov = b.fov AND a.label = b.label AND NOT b.in_cell GROUP BY 1, 2, 3, 4)
        SELECT fov, label, y, x, round(d / max(d) OVER (PARTITION BY fov, label), 6) AS depth FROM d""",
)
def relative_depth(spark, sf):
    out = D.relative_depth(regions(spark, sf).select("fov", "label", "y", "x", "in_cell"))
    return rounded(out.drop("in_cell"), ["depth"])


SEEDED = f"""{REGIONS}, sd AS (SELECT a.fov, a.label, a.y, a.x,
      min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FILTER (b.nucleus > 0) AS ds,
      min(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) FILTER (NOT b.in_cell) AS de
      FROM rg a JOIN rg b ON a.fov = b.fov AND a.label = b.label GROUP BY 1, 2, 3, 4)"""


@query(
    "relative_distance",
    f"""WITH {SEEDED} SELECT fov, label, y, x, round(ds, 6) AS d_seed, round(de, 6) AS d_edge,
          round(ds / nullif(ds + de, 0), 6) AS d_share FROM sd""",
)
def relative_distance(spark, sf):
    out = D.seed_and_edge_distances(regions(spark, sf), "nucleus")
    return rounded(
        out.select("fov", "label", "y", "x", "d_seed", "d_edge", "d_share"),
        ["d_seed", "d_edge", "d_share"],
    )


CENTRES = f"""{SEEDED}, src AS (SELECT fov * 10 + label AS k, y, x, 1 AS m FROM rg WHERE in_cell AND probe > 0),
    {reach('src', EIGHT)},
    ctr AS (SELECT k // 10 AS fov, CAST(k % 10 AS INTEGER) AS label, c,
      CAST(floor(avg(y)) AS INTEGER) AS y, CAST(floor(avg(x)) AS INTEGER) AS x FROM comp GROUP BY 1, 2, 3)"""


@query("probe_centres", f"WITH RECURSIVE {CENTRES} SELECT fov, label, c AS probe_object, y, x FROM ctr")
def probe_centres(spark, sf):
    return _numbered(D.probe_centres(regions(spark, sf), "probe"), "probe_object")


@query(
    "probe_localisation",
    f"""WITH RECURSIVE {CENTRES},
        ok AS (SELECT DISTINCT fov, label FROM rg WHERE nucleus > 0),
        pt AS (SELECT ctr.fov, ctr.label, ds, ds / nullif(ds + de, 0) AS share FROM ctr JOIN sd
               ON sd.fov = ctr.fov AND sd.label = ctr.label AND sd.y = ctr.y AND sd.x = ctr.x)
        SELECT ok.fov, ok.label, round(median(share), 6) AS dist_nucleus_median,
          round(stddev_pop(share), 6) AS dist_nucleus_std, round(sum(ds), 6) AS abs_dist_nucleus_sum,
          round(quantile_cont(ds, 0.25), 6) AS abs_dist_nucleus_c25,
          nullif(count(pt.fov), 0) AS probe_objects
        FROM ok LEFT JOIN pt ON pt.fov = ok.fov AND pt.label = ok.label GROUP BY 1, 2""",
)
def probe_localisation(spark, sf):
    px = cells(spark, sf).select("fov", "y", "x", "label", "probe", "nucleus")
    rows, _ = D.probe_localisation(px, ["probe"], ["nucleus"], margin=2)
    columns = ["dist_nucleus_median", "dist_nucleus_std", "abs_dist_nucleus_sum", "abs_dist_nucleus_c25"]
    return rounded(rows.select("fov", "label", *columns, "probe_objects"), columns)


@query(
    "failed_cells",
    f"""WITH {REGIONS} SELECT fov, label FROM rg GROUP BY 1, 2 HAVING max(nucleus) = 0""",
)
def failed_cells(spark, sf):
    px = cells(spark, sf).select("fov", "y", "x", "label", "probe", "nucleus")
    return D.probe_localisation(px, ["probe"], ["nucleus"], margin=2)[1]


@query(
    "distance_stats",
    f"""WITH {SEEDED}, s AS (SELECT sd.fov, sd.label, CASE WHEN probe = 0 THEN -1 ELSE
            ds / nullif(ds + de, 0) END AS v FROM sd JOIN rg USING (fov, label, y, x)), f AS (SELECT fov, label, v FROM s)
        SELECT fov, label, round(median(v) FILTER (v >= 0), 6) AS median,
          round(avg(v) FILTER (v >= 0), 6) AS mean, round(stddev_pop(v) FILTER (v >= 0), 6) AS std,
          round(sum(v) FILTER (v >= 0), 6) AS sum,
          round(quantile_cont(v, 0.25) FILTER (v >= 0), 6) AS c25,
          round(median(v) FILTER (v >= 0), 6) AS c50,
          round(quantile_cont(v, 0.75) FILTER (v >= 0), 6) AS c75,
          count(*) FILTER (v >= 0 AND v < 0.25) AS bin25count,
          count(*) FILTER (v >= 0.25 AND v < 0.5) AS bin50count,
          count(*) FILTER (v >= 0.5 AND v < 0.75) AS bin75count,
          count(*) FILTER (v >= 0.75) AS bin100count,
          round(count(*) FILTER (v >= 0 AND v < 0.25) / nullif(count(*) FILTER (v >= 0), 0), 6)
            AS norm_count_bin25count,
          round(count(*) FILTER (v >= 0.25 AND v < 0.5) / nullif(count(*) FILTER (v >= 0), 0), 6)
            AS norm_count_bin50count,
          round(count(*) FILTER (v >= 0.5 AND v < 0.75) / nullif(count(*) FILTER (v >= 0), 0), 6)
            AS norm_count_bin75count,
          round(count(*) FILTER (v >= 0.75) / nullif(count(*) FILTER (v > 0), 0), 6)
            AS norm_count_bin100count
        FROM f GROUP BY 1, 2""",
)
def distance_stats(spark, sf):
    out = D.seed_and_edge_distances(regions(spark, sf), "nucleus").select(
        "fov", "label", F.when(F.col("probe") == 0, F.lit(-1.0)).otherwise(F.col("d_share")).alias("v")
    )
    stats = D.value_statistics(out, ["fov", "label"], "v", quarters=True)
    exact = ("fov", "label", "bin25count", "bin50count", "bin75count", "bin100count")
    return rounded(stats, [c for c in stats.columns if c not in exact])


@query(
    "objects_by_area",
    f"""WITH {SEEDED}, q AS (SELECT sd.fov, sd.label, probe, least(CAST(floor(ds / nullif(ds + de, 0) * 4)
            AS INTEGER), 3) AS quarter FROM sd JOIN rg USING (fov, label, y, x)
            WHERE ds / nullif(ds + de, 0) >= 0)
        SELECT fov, label, quarter, count(*) AS pixels, count(*) FILTER (probe = 1) AS objects,
          round(count(*) FILTER (probe = 1) / count(*), 6) AS objects_per_pixel FROM q GROUP BY 1, 2, 3""",
)
def objects_by_area(spark, sf):
    out = D.seed_and_edge_distances(regions(spark, sf), "nucleus")
    made = D.normalised_by_area(out.where("probe = 1"), out, ["fov", "label"], "d_share")
    return rounded(made, ["objects_per_pixel"])


@query("object_pixels", f"WITH {PX} SELECT fov, y, x FROM px WHERE probe >= 1")
def object_pixels(spark, sf):
    return D.object_pixels(pixels(spark, sf), "probe")


# ---------------------------------------------------------------- texture

# the whole image as one cell for the tests of texture
WHOLE = f"""{PX}, wc AS (SELECT fov, 1 AS label, y, x, v FROM px),
    qs AS (SELECT fov, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM wc GROUP BY 1),
    cr AS (SELECT wc.fov, label, y, x, CAST(floor(least(greatest(v, lo), hi)) AS BIGINT) AS v
      FROM wc JOIN qs USING (fov) WHERE y < 7 AND x < 7),
    ed AS (SELECT fov, quantile_cont(v, 0.0) AS e0, quantile_cont(v, 0.25) AS e1,
      quantile_cont(v, 0.5) AS e2, quantile_cont(v, 0.75) AS e3 FROM cr GROUP BY 1),
    lv AS (SELECT cr.fov, label, y, x, CAST(v >= e0 AS INTEGER) + CAST(v >= e1 AS INTEGER)
      + CAST(v >= e2 AS INTEGER) + CAST(v >= e3 AS INTEGER) AS level FROM cr JOIN ed USING (fov))"""


def whole_cells(spark, sf):
    return pixels(spark, sf).select("fov", F.lit(1).alias("label"), "y", "x", "v")


def levels(spark, sf):
    return T.quantised(T.cropped_cells(whole_cells(spark, sf)), levels=4)


@query("quantised_levels", f"WITH {WHOLE} SELECT fov, label, y, x, level FROM lv")
def quantised_levels(spark, sf):
    return levels(spark, sf).drop("v")


STEPS = [(dy, dx) for dy in range(-3, 4) for dx in range(-3, 4)]


@query(
    "cooccurrence",
    f"""WITH {WHOLE} SELECT a.fov, a.label, b.y - a.y AS dy, b.x - a.x AS dx, a.level AS i, b.level AS j,
          count(*) AS n FROM lv a JOIN lv b ON a.fov = b.fov AND abs(b.y - a.y) <= 3
          AND abs(b.x - a.x) <= 3 GROUP BY 1, 2, 3, 4, 5, 6""",
)
def cooccurrence(spark, sf):
    return T.cooccurrence(levels(spark, sf), STEPS)


def _table(dmax: int, nangles: int) -> str:
    rows = T.offsets(range(dmax + 1), T.even_angles(nangles))
    return "st(d, a, dy, dx) AS (VALUES " + ", ".join(str(r) for r in rows) + ")"


CORR = f"""{WHOLE}, {_table(5, 6)},
    pr AS (SELECT a.fov, a.label, d, st.a, CAST(count(*) AS DOUBLE) AS n, CAST(sum(a.level) AS DOUBLE) AS si,
        CAST(sum(b.level) AS DOUBLE) AS sj, CAST(sum(a.level * a.level) AS DOUBLE) AS sii,
        CAST(sum(b.level * b.level) AS DOUBLE) AS sjj, CAST(sum(a.level * b.level) AS DOUBLE) AS sij
      FROM lv a, st, lv b WHERE a.fov = b.fov AND b.y = a.y + st.dy AND b.x = a.x + st.dx
      GROUP BY 1, 2, 3, 4),
    co AS (SELECT fov, label, d, a, abs(CASE WHEN n * sii - si * si > 0 AND n * sjj - sj * sj > 0 THEN
        (n * sij - si * sj) / sqrt((n * sii - si * si) * (n * sjj - sj * sj)) ELSE 1 END) AS corr FROM pr)"""


def correlations(spark, sf):
    return T.correlation_by_angle(levels(spark, sf), range(6), T.even_angles(6))


@query("cooccurrence_corr", f"WITH {CORR} SELECT fov, label, d, a, round(corr, 6) AS corr FROM co")
def cooccurrence_corr(spark, sf):
    return rounded(correlations(spark, sf), ["corr"])


@query(
    "cv_over_angles",
    f"""WITH {CORR}, cv AS (SELECT fov, label, d, stddev_pop(corr) / (0.1 + (1 - 0.1) * avg(corr)) AS cv
            FROM co GROUP BY 1, 2, 3)
        SELECT fov, label, round(max(cv), 6) AS "Maximum_Coefficient_Variation" FROM cv GROUP BY 1, 2""",
)
def cv_over_angles(spark, sf):
    out = T.max_variation(T.variation_over_angles(correlations(spark, sf)))
    return rounded(out, ["Maximum_Coefficient_Variation"])


@query(
    "peak_position",
    f"""WITH {CORR}, r AS (SELECT fov, label, d, round(corr - exp(-0.1 * d * d), 6) AS residual FROM co),
          o AS (SELECT *, row_number() OVER (PARTITION BY fov, label ORDER BY residual DESC, d) AS n FROM r)
        SELECT fov, label, residual AS "Peak_Height", CAST(d AS DOUBLE) AS "Peak_Distance"
        FROM o WHERE n = 1""",
)
def peak_position(spark, sf):
    # rounded so that equal values are equal in both engines
    r = correlations(spark, sf).withColumn(
        "residual", F.round(F.col("corr") - F.exp(-0.1 * F.col("d") * F.col("d")), 6)
    )
    return T.peaks(r, T.even_angles(6)).drop("Peak_Angle")


@query(
    "texture",
    f"""WITH {WHOLE}, st(dy, dx) AS (VALUES (0, 1), (1, 1), (1, 0), (1, -1), (0, 2), (2, 2), (2, 0), (2, -2)),
        n AS (SELECT a.fov, a.label, dy, dx, a.level AS i, b.level AS j, count(*) AS n
              FROM lv a, st, lv b WHERE a.fov = b.fov AND b.y = a.y + dy AND b.x = a.x + dx
              GROUP BY 1, 2, 3, 4, 5, 6),
        p AS (SELECT *, n / sum(n) OVER (PARTITION BY fov, dy, dx)::DOUBLE AS p FROM n),
        c AS (SELECT a.fov, dy, dx, corr(a.level, b.level) AS c, stddev_pop(a.level) AS s1,
                stddev_pop(b.level) AS s2
              FROM lv a, st, lv b WHERE a.fov = b.fov AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)
        SELECT p.fov, label, p.dy, p.dx, CAST(sum(n) AS BIGINT) AS pairs,
          round(sum(p * (i - j) * (i - j)), 6) AS contrast, round(sum(p * p), 6) AS energy,
          round(sum(p / (1 + (i - j) * (i - j))), 6) AS homogeneity, round(-sum(p * log2(p)), 6) AS entropy,
          round(max(CASE WHEN s1 > 0 AND s2 > 0 THEN c ELSE 1 END), 6) AS correlation
        FROM p JOIN c ON c.fov = p.fov AND c.dy = p.dy AND c.dx = p.dx GROUP BY 1, 2, 3, 4""",
)
def texture(spark, sf):
    out = T.texture_measures(levels(spark, sf), scales=(1, 2))
    return rounded(out, ["contrast", "energy", "homogeneity", "entropy", "correlation"])


# the same damped steps, all curves at once, one round a recursion
DECAY = f"""{CORR}, cu AS (SELECT fov, label, a, list(CAST(d AS DOUBLE) ORDER BY d) AS ds, list(corr ORDER BY d) AS ys FROM co GROUP BY 1, 2, 3),
    it AS (
      SELECT fov, label, a, ds, ys, 0 AS i, CAST(0.005 AS DOUBLE) AS rate, CAST(0.001 AS DOUBLE) AS damping FROM cu
      UNION ALL
      SELECT fov, label, a, ds, ys, i + 1, CASE WHEN tried <= cost THEN rate + step ELSE rate END,
        damping * CASE WHEN tried <= cost THEN 0.1 ELSE 10 END
      FROM (SELECT *, list_sum(list_transform(list_zip(ds, ys), lambda p:
                (exp(-0.5 * p[1]) * (p[2] - exp(-(rate + step) * p[1] * p[1]))) ** 2)) AS tried
            FROM (SELECT *, CASE WHEN curvature > 0 THEN gain / (curvature * (1 + damping)) ELSE 0 END AS step
                  FROM (SELECT *,
                      list_sum(list_transform(ds, lambda d: (d * d * exp(-rate * d * d) * exp(-0.5 * d)) ** 2)) AS curvature,
                      list_sum(list_transform(list_zip(ds, ys), lambda p: -p[1] * p[1] * exp(-rate * p[1] * p[1]) * exp(-p[1])
                        * (p[2] - exp(-rate * p[1] * p[1])))) AS gain,
                      list_sum(list_transform(list_zip(ds, ys), lambda p:
                        (exp(-0.5 * p[1]) * (p[2] - exp(-rate * p[1] * p[1]))) ** 2)) AS cost
                    FROM it WHERE i < 200)))),
    rest AS (SELECT fov, label, a, rate, unnest(ds) AS d, unnest(ys) AS corr FROM it WHERE i = 200),
    re AS (SELECT *, corr - exp(-rate * d * d) AS residual FROM rest)"""


@query(
    "decay_fit",
    f"""WITH RECURSIVE {DECAY} SELECT fov, label, a, CAST(d AS INTEGER) AS d, round(rate, 5) AS rate, round(corr, 6) AS corr,
          round(residual, 5) AS residual FROM re""",
)
def decay_fit(spark, sf):
    made = T.decay_residuals(correlations(spark, sf))
    return rounded(rounded(made, ["corr"]), ["rate", "residual"], 5)


@query(
    "global_alignment",
    f"""WITH RECURSIVE {DECAY}, cv AS (SELECT fov, label, d, stddev_pop(corr) / (0.1 + (1 - 0.1) * avg(corr)) AS cv
            FROM co GROUP BY 1, 2, 3),
          m AS (SELECT fov, label, max(cv) AS cv FROM cv GROUP BY 1, 2),
          pk AS (SELECT *, row_number() OVER (PARTITION BY fov, label ORDER BY residual DESC, d) AS nd,
                   row_number() OVER (PARTITION BY fov, label ORDER BY residual DESC, a) AS na FROM re)
        SELECT m.fov, m.label, round(cv, 6) AS "Maximum_Coefficient_Variation", round(x.residual, 5) AS "Peak_Height",
          x.d AS "Peak_Distance", z.a * 180.0 / 5 AS "Peak_Angle"
        FROM m JOIN pk x USING (fov, label) JOIN pk z USING (fov, label) WHERE x.nd = 1 AND z.na = 1""",
)
def global_alignment(spark, sf):
    made = T.global_alignment(whole_cells(spark, sf), levels=4, dmax=5, nangles=6)
    return rounded(rounded(made, ["Maximum_Coefficient_Variation"]), ["Peak_Height"], 5)


@query(
    "wide_distance",
    """WITH p AS (SELECT vec_id // 1024 AS fov, (vec_id % 1024) // 4 AS y, (vec_id % 4) * 64 + i - 1 AS x,
           CAST(embedding[i] AS DOUBLE) AS e FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
         s AS (SELECT fov, y, x FROM p WHERE e > 0.4)
       SELECT p.fov, p.y, p.x, round(min(sqrt((p.y - s.y) ** 2 + (p.x - s.x) ** 2)), 6) AS distance
       FROM p LEFT JOIN s ON p.fov = s.fov GROUP BY 1, 2, 3""",
)
def wide_distance(spark, sf):
    """Images 256 wide, of four vectors side by side, and their distance to bright pixels."""
    px = table(spark, sf, "embeddings").select(
        F.expr("vec_id div 1024").alias("fov"), F.expr("(vec_id % 1024) div 4").alias("y"), "vec_id",
        F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "e"),
    ).select("fov", "y", ((F.col("vec_id") % 4) * 64 + F.col("i")).alias("x"), "e")
    found = D.distance_transform(px, ["fov"], F.col("e") > 0.4)
    return rounded(found.select("fov", "y", "x", "distance"), ["distance"])
