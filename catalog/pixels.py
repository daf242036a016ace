"""Per-image intensity operators on the pixel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.measures import rounded
from catalog.tables import PX, pixels, table
from cytoframe.operators import pixels as P
from cytoframe.operators import windows as W
from cytoframe.plans import fields as FD


# ---------------------------------------------------------------- contrast

@query(
    "quantile_contrast",
    f"""WITH {PX}, q AS (SELECT fov, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi,
                    quantile_cont(v, 0.5) AS md FROM px GROUP BY 1),
          c AS (SELECT fov, y, x, least(greatest(v, lo), hi) AS c, lo, hi, md FROM px JOIN q USING (fov))
        SELECT fov, y, x, CAST(round_even((c - lo) / (hi - lo) * 255, 0) AS INTEGER) AS plain,
               CAST(round_even(CASE WHEN c < md THEN 0 ELSE c END / hi * 255, 0) AS INTEGER) AS zeroed
        FROM c""",
)
def quantile_contrast(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    out = P.contrast(px, ["fov"], "simple_quantile", out="plain", clip_quantiles=(0.02, 0.98))
    out = P.contrast(out, ["fov"], "simple_quantile", out="zeroed", clip_quantiles=(0.02, 0.98),
                     zero_below_median=True)
    return out.drop("v")


CHANNEL_PX = f"""{PX}, ch AS (SELECT fov, y, x, v, CASE label WHEN 1 THEN '488' WHEN 2 THEN 'bf'
    WHEN 3 THEN 'nuc' ELSE 'seg561' END AS channel FROM px)"""


def channel_pixels(spark, sf):
    channel = F.element_at(F.array(*[F.lit(c) for c in ("488", "bf", "nuc", "seg561")]), F.col("label"))
    return pixels(spark, sf).select("fov", "y", "x", "v", channel.alias("channel"))


@query(
    "channel_contrast",
    f"""WITH {CHANNEL_PX}, q AS (SELECT fov, channel,
            CASE channel WHEN 'bf' THEN quantile_cont(v, 0.00001) ELSE quantile_cont(v, 0.0) END AS lo,
            CASE channel WHEN 'bf' THEN quantile_cont(v, 0.99999) ELSE quantile_cont(v, 0.998) END AS hi
          FROM ch GROUP BY 1, 2)
        SELECT fov, channel, y, x, CASE WHEN channel = 'seg561' THEN CAST(v AS INTEGER) ELSE
            CAST(round_even((least(greatest(v, lo), hi) - lo) / (hi - lo) * 255, 0) AS INTEGER) END
            AS stretched
        FROM ch JOIN q USING (fov, channel)""",
)
def channel_contrast(spark, sf):
    return FD.contrasted_fields(channel_pixels(spark, sf)).select(
        "fov", "channel", "y", "x", "stretched"
    )


@query(
    "hist_contrast",
    f"""WITH {PX}, m AS (SELECT fov, min(v) AS lo, max(v) AS hi FROM px GROUP BY 1),
      b AS (SELECT fov, y, x, CAST(floor(floor(CAST(v - lo AS DOUBLE) / (hi - lo) * 65535.0) / 256)
              AS INTEGER) AS b FROM px JOIN m USING (fov)),
      n AS (SELECT fov, count(*) FILTER (b > 0) AS nz FROM b GROUP BY 1),
      g AS (SELECT fov, bin FROM n, (SELECT unnest(range(256)) AS bin)),
      h AS (SELECT g.fov, g.bin, count(b.b) AS c FROM g LEFT JOIN b ON b.fov = g.fov AND b.b = g.bin
            GROUP BY 1, 2),
      t AS (SELECT fov, coalesce(min(bin) FILTER (c < CAST(nz AS DOUBLE) * (1.0::DOUBLE / 10)), 0) AS lo,
              coalesce(max(bin) FILTER (c > CAST(nz AS DOUBLE) * (1.0::DOUBLE / 5000)), 255) AS hi
            FROM h JOIN n USING (fov) GROUP BY 1),
      z AS (SELECT b.fov, y, x, CASE WHEN h.c >= CAST(nz AS DOUBLE) * (1.0::DOUBLE / 10) THEN 0
              ELSE b END AS k FROM b JOIN h ON h.fov = b.fov AND h.bin = b.b JOIN n ON n.fov = b.fov)
      SELECT fov, y, x, CAST(CASE WHEN hi > lo THEN
          floor((least(greatest(k, lo), hi) - lo) / CAST(hi - lo AS DOUBLE) * 255) ELSE k END
          AS INTEGER) AS stretched
      FROM z JOIN t USING (fov)""",
)
def hist_contrast(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    return P.contrast(px, ["fov"], "histogram").drop("v")


@query(
    "rescale_limits",
    f"""WITH {PX} SELECT fov, y, x, least(greatest((v - 900) / 200.0::DOUBLE, 0), 1) AS scaled FROM px""",
)
def rescale_limits(spark, sf):
    return pixels(spark, sf).select("fov", "y", "x", P.rescale_limits("v", 900, 1100).alias("scaled"))


@query(
    "intensity_norm",
    f"""WITH {PX}, s AS (SELECT fov, avg(v) - stddev_pop(v) AS lo, avg(v) + 18 * stddev_pop(v) AS hi,
            min(v) AS mn, max(v) AS mx FROM px GROUP BY 1),
          c AS (SELECT fov, y, x, least(greatest(v, lo), hi) AS c, least(greatest(mn, lo), hi) AS b,
            least(greatest(mx, lo), hi) AS t FROM px JOIN s USING (fov))
        SELECT fov, y, x, round((c - b + 1e-8) / (t - b + 1e-8), 6) AS norm FROM c""",
)
def intensity_norm(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    return rounded(P.normalise_intensity(px, ["fov"]).drop("v"), ["norm"])


# ---------------------------------------------------------------- tiles and neighbours

@query(
    "tiles",
    f"""WITH {PX}, t AS (SELECT fov, y // 3 AS ty, x // 3 AS tx, CAST(sum(probe) AS BIGINT) AS s
                         FROM px GROUP BY 1, 2, 3)
        SELECT px.fov, y, x, s AS tile_sum, s < 3 AS quiet FROM px
        JOIN t ON t.fov = px.fov AND ty = y // 3 AND tx = x // 3""",
)
def tiles(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "probe")
    out = P.tile_sums(px, "fov", "probe", 3).withColumn("quiet", F.col("tile_sum") < 3)
    return out.drop("probe")


JUNCTIONS = f"""{PX}, j AS (SELECT a.fov, a.y, a.x, a.probe, CASE WHEN a.y BETWEEN 2 AND 5
      AND a.x BETWEEN 2 AND 5 THEN (SELECT CAST(sum(b.probe) AS BIGINT) FROM px b WHERE b.fov = a.fov
        AND abs(b.y - a.y) <= 1 AND abs(b.x - a.x) <= 1) ELSE a.probe END AS junctions FROM px a)"""


@query("junctions", f"WITH {JUNCTIONS} SELECT fov, y, x, junctions FROM j")
def junctions(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "probe")
    return P.junction_counts(px, "fov", "probe").drop("probe")


@query(
    "line_pixels",
    f"""WITH {JUNCTIONS} SELECT fov, y, x, CASE WHEN junctions > 3 THEN 0 ELSE probe END AS line FROM j""",
)
def line_pixels(spark, sf):
    return P.line_pixels(pixels(spark, sf).select("fov", "y", "x", "probe"), "fov", "probe").drop("probe")


# ---------------------------------------------------------------- patches

PATCHES = f"""{PX}, g AS (SELECT unnest([0, 2, 4, 6]) AS g),
      p AS (SELECT fov, r.g AS r, c.g AS c, y - r.g + 2 AS py, x - c.g + 2 AS px_, v FROM px, g r, g c
            WHERE y >= r.g - 2 AND y < r.g + 2 AND x >= c.g - 2 AND x < c.g + 2)"""


@query(
    "patches",
    f"""WITH {PATCHES} SELECT fov, r, c, py, px_ AS px,
          round(v / max(v) OVER (PARTITION BY fov, r, c)::DOUBLE, 6) AS share FROM p""",
)
def patches(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    return rounded(W.sliding_patches(px, size=4, stride=2), ["share"])


@query(
    "patch_arrays",
    f"""WITH {PATCHES}, s AS (SELECT fov, r, c, py, px_, v / max(v) OVER (PARTITION BY fov, r, c)::DOUBLE
                         AS share FROM p)
        SELECT fov, r, c, CAST(16 AS INTEGER) AS values, round(sum(share), 9) AS total,
          round(coalesce(max(share) FILTER (py = 0 AND px_ = 0), 0), 6) AS first,
          round(coalesce(max(share) FILTER (py = 3 AND px_ = 3), 0), 6) AS last FROM s GROUP BY 1, 2, 3""",
)
def patch_arrays(spark, sf):
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    arrays = W.patch_arrays(px, size=4, stride=2)
    return arrays.select(
        "fov", "r", "c", F.size("patch").alias("values"),
        F.round(F.aggregate("patch", F.lit(0.0), lambda a, b: a + b), 9).alias("total"),
        F.round(F.get("patch", F.lit(0)), 6).alias("first"),
        F.round(F.get("patch", F.lit(15)), 6).alias("last"),
    )


@query(
    "labelled_patches",
    f"""WITH {PX}, q AS (SELECT vec_id AS fov, label % 8 AS r, (label * 3) % 8 AS c, label // 5 AS class
            FROM embeddings),
          p AS (SELECT q.*, y - r + 2 AS py, x - c + 2 AS px_, v FROM q JOIN px ON px.fov = q.fov
            AND y >= r - 2 AND y < r + 2 AND x >= c - 2 AND x < c + 2)
        SELECT fov, r, c, class, py, px_ AS px,
          round(v / max(v) OVER (PARTITION BY fov, r, c, class)::DOUBLE, 6) AS share FROM p""",
)
def labelled_patches(spark, sf):
    points = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"), (F.col("label") % 8).alias("r"),
        (F.col("label") * 3 % 8).alias("c"), F.expr("cast(label div 5 as int)").alias("class"),
    )
    px = pixels(spark, sf).select("fov", "y", "x", "v")
    return rounded(W.labelled_patches(px, points, size=4), ["share"])


def score_columns():
    """Five class scores as simple functions of the pixel."""
    e, y, x = F.col("e"), F.col("y"), F.col("x")
    return {"p1": e * 3, "p2": e * e * 10, "p3": -e * 2, "p4": y / 10 - e, "p5": x / 10 - e * e}


SCORE_PX = f"""{PX}, sc AS (SELECT fov, y, x, label, v, probe, nucleus, e * 3 AS p1, e * e * 10 AS p2,
    -e * 2 AS p3, CAST(y AS DOUBLE) / 10 - e AS p4, CAST(x AS DOUBLE) / 10 - e * e AS p5 FROM px)"""


def score_pixels(spark, sf):
    return pixels(spark, sf).withColumns(score_columns())


@query(
    "ensemble_softmax",
    f"""WITH {SCORE_PX}, m AS (SELECT fov, y // 2 AS r, x // 2 AS c, avg(p1) AS p1, avg(p2) AS p2,
          avg(p3) AS p3, avg(p4) AS p4, avg(p5) AS p5 FROM sc GROUP BY 1, 2, 3),
        t AS (SELECT *, exp(p1) + exp(p2) + exp(p3) + exp(p4) + exp(p5) AS s FROM m)
        SELECT fov, r, c, round(exp(p1) / s, 6) AS p1, round(exp(p2) / s, 6) AS p2,
          round(exp(p3) / s, 6) AS p3, round(exp(p4) / s, 6) AS p4, round(exp(p5) / s, 6) AS p5 FROM t""",
)
def ensemble_softmax(spark, sf):
    scores = ["p1", "p2", "p3", "p4", "p5"]
    variants = score_pixels(spark, sf).withColumns(
        {"r": F.expr("cast(y div 2 as int)"), "c": F.expr("cast(x div 2 as int)")}
    )
    return rounded(W.ensemble_softmax(variants, ["fov", "r", "c"], scores), scores)


@query(
    "masked_class_map",
    f"""WITH {SCORE_PX}, m AS (SELECT fov, y, x, nucleus, p2 AS p1, p4 AS p2, p5 AS p3, p3 AS p4, p1 AS p5
                               FROM sc)
        SELECT fov, y, x, CASE WHEN nucleus > 0 THEN 0 ELSE CAST(list_position([p1, p2, p3, p4, p5],
            greatest(p1, p2, p3, p4, p5)) AS INTEGER) END AS cls,
          CASE WHEN nucleus > 0 THEN 0 ELSE round(p1, 6) END AS p1,
          CASE WHEN nucleus > 0 THEN 0 ELSE round(p5, 6) END AS p5 FROM m""",
)
def masked_class_map(spark, sf):
    out = W.masked_class_map(score_pixels(spark, sf), background="nucleus")
    return rounded(out.select("fov", "y", "x", "cls", "p1", "p5"), ["p1", "p5"])


@query(
    "scaled_map",
    f"""WITH {PX} SELECT fov, y, x, CASE WHEN label <> 4 THEN round(v / max(v) OVER
            (PARTITION BY fov)::DOUBLE, 6) ELSE 0 END AS org FROM px""",
)
def scaled_map(spark, sf):
    from cytoframe.operators.distance import scaled_map as scale

    px = pixels(spark, sf).select("fov", "y", "x", "v", F.when(F.col("label") != 4, F.col("label"))
                                  .otherwise(0).alias("label"))
    return rounded(scale(px, "v", "org"), ["org"]).drop("v", "label")


@query(
    "array_pixels",
    """SELECT vec_id AS fov, c.channel, (i - 1) // 4 AS y, (i - 1) % 4 AS x,
              CAST(embedding[c.k * 32 + i] AS DOUBLE) AS v
       FROM embeddings, (SELECT unnest(range(1, 33)) AS i),
            (VALUES ('bf', 0), ('488', 1)) AS c(channel, k)""",
)
def array_pixels(spark, sf):
    images = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"), F.col("embedding").cast("array<double>").alias("e")
    ).select("fov", F.array(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("planes"))
    return P.channel_planes(images, {"bf": 0, "488": 1}, 4)

