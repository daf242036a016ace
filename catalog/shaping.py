"""Column shaping, names and paths, reshaping and stacking."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import pixels, table
from cytoframe.functions import names as N
from cytoframe.functions import paths as PA
from cytoframe.functions import scalars as S
from cytoframe.operators import columns as C
from cytoframe.operators import joins as J
from cytoframe.operators import pixels as PX
from cytoframe.operators import quality as Q
from cytoframe.operators import ranks as RK
from cytoframe.operators import reshape as RS
from cytoframe.plans import manifests as M

# ---------------------------------------------------------------- columns


@query(
    "column_shaping",
    """SELECT p_size AS "Size", p_partkey AS "napariCell_partkey", p_brand AS "napariCell_brand",
              p_type AS "napariCell_messy_kind" FROM part""",
)
def column_shaping(spark, sf):
    df = C.add_prefix(table(spark, sf, "part"), "napariCell_", keep=["p_size"])
    df = C.rename_existing(df, {"p_size": "Size", "absent": "never"})
    df = C.rename_substrings(df, {"napariCell_p_": "napariCell_", "type": "class_1_kind",
                                  "class_1": "messy"})
    df = C.drop_containing(df, "retail")
    wanted = ["napariCell_brand", "Size", "napariCell_partkey", "napariCell_messy_kind", "gone"]
    return C.order_columns(C.keep_existing(df, wanted), ["Size"], ["napariCell_partkey"])


@query(
    "pair_subset",
    """SELECT p_partkey, p_brand, p_type FROM part
       WHERE p_brand = 'Brand#17' AND p_type = 'ECONOMY'""",
)
def pair_subset(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type")
    return part.where((F.col("p_brand") == "Brand#17") & (F.col("p_type") == "ECONOMY"))


@query(
    "published_columns",
    """SELECT s_suppkey AS "Supplier", s_nationkey AS "Nation", replace(s_name, 'Supplier#',
              '/store/supplier/') AS "Path" FROM supplier""",
)
def published_columns(spark, sf):
    supplier = table(spark, sf, "supplier").withColumn(
        "s_name", PA.replace_prefix("s_name", "Supplier#", "/store/supplier/")
    )
    supplier = C.drop_existing(supplier, ["s_acctbal", "BackgroundPath"])
    return C.select_renamed(
        supplier, [("s_suppkey", "Supplier"), ("s_nationkey", "Nation"), ("s_name", "Path")]
    )


@query(
    "integer_columns",
    """SELECT event_id, CAST(round_even(value, 0) AS INTEGER) AS n FROM events""",
)
def integer_columns(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.rint("value").alias("n"))
    return C.require_integers(df, ["n"])


# ---------------------------------------------------------------- names and paths

@query(
    "feature_names",
    """WITH n AS (SELECT DISTINCT (CASE p_size % 3 WHEN 0 THEN 'finalnuc_' WHEN 1 THEN 'napariCell_'
                    ELSE 'image_' END) ||
                  (CASE p_brand WHEN 'Brand#1' THEN 'Texture_structure_' WHEN 'Brand#2' THEN 'Mean_bf_'
                    WHEN 'Brand#3' THEN 'Mean_nuc_' WHEN 'Brand#4' THEN 'Children_probe_638_'
                    WHEN 'Brand#5' THEN 'Children_probe_561_' ELSE '_AreaShape_' END) ||
                  (CASE p_type WHEN 'ECONOMY' THEN '_Center_X' WHEN 'STANDARD' THEN '_Count'
                    WHEN 'PROMO' THEN '_Texture_a' ELSE '_AreaShape_b' END) AS name FROM part)
       SELECT name,
         CASE WHEN name LIKE 'finalnuc@_%' ESCAPE '@' THEN 'nuclear'
              WHEN name LIKE 'napariCell@_%' ESCAPE '@' THEN 'cell' END AS region,
         CASE WHEN contains(name, '_structure_') THEN 'structure' WHEN contains(name, '_bf_')
              THEN 'bright field' WHEN contains(name, '_nuc_') THEN 'DNA'
              WHEN contains(name, '_probe_') THEN 'FISH' ELSE 'segmentation' END AS channel,
         CASE WHEN contains(name, '_Center_') THEN 'location' WHEN contains(name, '_Count') THEN 'count'
              WHEN contains(name, '_Texture_') THEN 'texture'
              WHEN contains(name, '_AreaShape_') THEN 'shape' END AS type,
         CASE WHEN contains(name, 'probe_638') THEN '638' WHEN contains(name, 'probe_561') THEN '561'
              END AS probe_wavelength
       FROM n""",
)
def feature_names(spark, sf):
    part = table(spark, sf, "part")
    region = S.recode(F.col("p_size") % 3, {0: "finalnuc_", 1: "napariCell_"}, F.lit("image_"))
    channel = S.recode(
        "p_brand",
        {"Brand#1": "Texture_structure_", "Brand#2": "Mean_bf_", "Brand#3": "Mean_nuc_",
         "Brand#4": "Children_probe_638_", "Brand#5": "Children_probe_561_"},
        F.lit("_AreaShape_"),
    )
    kind = S.recode(
        "p_type", {"ECONOMY": "_Center_X", "STANDARD": "_Count", "PROMO": "_Texture_a"},
        F.lit("_AreaShape_b"),
    )
    return N.annotated(part.select(F.concat(region, channel, kind).alias("name")).distinct())


@query(
    "slugs",
    """SELECT page_id, lower(replace(replace(regexp_replace(url, '[^\\p{L}\\p{N}_. -]', '_', 'g'),
              ' ', '_'), '__', '_')) AS slug FROM pages""",
)
def slugs(spark, sf):
    return table(spark, sf, "pages").select("page_id", N.slug("url").alias("slug"))


@query(
    "path_parts",
    """SELECT page_id, regexp_extract(url, '[^/]*$') AS base,
              regexp_replace(url, '/[^/]*$', '') AS dir, '/root/' || url AS absolute,
              nullif(split_part(url, '/', 4), '') AS part3, split_part(url, '?', 1) AS plain,
              regexp_replace(replace(url, ':', '/'), '/+', '/', 'g') AS posix_path
       FROM pages""",
)
def path_parts(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", PA.base_name("url").alias("base"), PA.dir_name("url").alias("dir"),
        PA.under_root("url", "/root").alias("absolute"),
        F.nullif(PA.component("url", 3), F.lit("")).alias("part3"),
        PA.before("url", "?").alias("plain"),
        PA.posix(F.replace("url", F.lit(":"), F.lit("\\"))).alias("posix_path"),
    )


@query(
    "component_filter",
    """SELECT page_id, url FROM pages WHERE split_part(url, '/', 4) IN ('en', 'de')""",
)
def component_filter(spark, sf):
    return PA.select_by_component(
        table(spark, sf, "pages").select("page_id", "url"), "url", 3, ["en", "de"]
    )


@query(
    "field_file_names",
    """WITH raw AS (SELECT o_orderkey AS id,
                  CASE WHEN o_orderstatus = 'F' THEN '20190807' WHEN o_orderstatus = 'O'
                    THEN '20190816' ELSE '20200101' END AS day, o_custkey % 9 AS s,
                  o_custkey % 100 AS p, o_custkey % 12 + 10 AS w FROM orders)
       SELECT id, CASE day WHEN '20190807' THEN '5500000013' WHEN '20190816' THEN '5500000014' END
                || '_63X_' || day || '_S' || s || '_P' || p || '_' || w AS field FROM raw""",
)
def field_file_names(spark, sf):
    day = S.recode("o_orderstatus", {"F": "20190807", "O": "20190816"}, F.lit("20200101"))
    text = lambda c: c.cast("string")
    raw = F.concat(
        day, F.lit("_63X_AS"), text(F.col("o_custkey") % 9), F.lit("_b "),
        text(F.col("o_custkey") % 12 + 10), F.lit(" [144]_raw-P"),
        text(F.col("o_custkey") % 100), F.lit("_C0.tif"),
    )
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), N.field_file_name(raw).alias("field")
    )


@query(
    "composite_ids",
    """SELECT o_orderkey, 'fov-' || o_custkey || '-cell-' || o_orderkey AS "CellId",
              o_custkey || '-' || o_orderpriority AS ge_wellID,
              split_part(o_orderpriority, '-', 1) AS probe,
              CASE split_part(o_orderpriority, ' ', 1) WHEN '4-NOT' THEN '4-NOT'
                ELSE split_part(o_orderpriority, ' ', 1) END AS family,
              CASE o_orderstatus WHEN 'F' THEN 'Random Forest' WHEN 'O' THEN 'Logistic regression'
                ELSE 'KNN' END AS clf
       FROM orders""",
)
def composite_ids(spark, sf):
    name = S.recode("o_orderstatus", {"F": "Random Forest depth = 3", "O": "Logistic Regression C=1"},
                    F.lit("KNN k=3"))
    return table(spark, sf, "orders").select(
        "o_orderkey", N.cell_id("o_custkey", "o_orderkey").alias("CellId"),
        N.well_id("o_custkey", "o_orderpriority").alias("ge_wellID"),
        N.probe_base_name("o_orderpriority").alias("probe"),
        N.word("o_orderpriority", 0).alias("family"),
        N.classifier_family(name).alias("clf"),
    )


@query(
    "image_set",
    """WITH f AS (SELECT url, min(page_id) AS first FROM pages GROUP BY url),
            n AS (SELECT url, row_number() OVER (ORDER BY first) AS i FROM f)
       SELECT i AS "Group_Index", 'file:/img/' || url AS "URL_nuc",
              '/img/' || regexp_replace(url, '/[^/]*$', '') AS "PathName_seg_561",
              regexp_extract(url, '[^/]*$') AS "FileName_structure",
              regexp_extract(url, '[^/]*$') AS "ObjectsFileName_napari_cell",
              10 AS "Metadata_SizeT"
       FROM n WHERE url IN (SELECT url FROM pages WHERE length(html) > 500)""",
)
def image_set(spark, sf):
    pages = table(spark, sf, "pages")
    present = pages.where(F.length("html") > 500).select("url")
    made = M.image_sets(
        pages, "url", "page_id", "/img", "structure", {"Metadata_SizeT": 10, "URL_nuc": ""}, present
    )
    return made.select(
        "Group_Index", "URL_nuc", "PathName_seg_561", "FileName_structure",
        "ObjectsFileName_napari_cell", "Metadata_SizeT",
    )


# ---------------------------------------------------------------- reshape

PAIRS = """pairs AS (
  SELECT l_partkey, l_returnflag AS probe_561, l_linestatus AS probe_638,
         count(*) AS n_561, CAST(sum(l_quantity) AS DOUBLE) AS n_638
  FROM lineitem GROUP BY 1, 2, 3)"""


def probe_pairs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        "l_partkey", F.col("l_returnflag").alias("probe_561"),
        F.col("l_linestatus").alias("probe_638"),
    ).agg(F.count("*").cast("double").alias("n_561"), F.sum("l_quantity").alias("n_638"))


COLUMN_PAIRS = [("probe_561", "n_561"), ("probe_638", "n_638")]


def widened_sql(names: str) -> str:
    cols = ", ".join(
        f"CAST(CASE WHEN probe_638 = '{n}' THEN n_638 WHEN probe_561 = '{n}' THEN n_561 END AS DOUBLE)"
        f' AS "{n}_count"'
        for n in names
    )
    return f"SELECT l_partkey, {cols} FROM pairs"


@query("widen", f"WITH {PAIRS} {widened_sql('ARO')}")
def widen(spark, sf):
    return RS.widen(probe_pairs(spark, sf), COLUMN_PAIRS, ["A", "R", "O"])


@query("unmelt", f"WITH {PAIRS} {widened_sql('AFNOR')}")
def unmelt(spark, sf):
    return RS.widen_from_data(probe_pairs(spark, sf), COLUMN_PAIRS)


@query(
    "tidy",
    f"""WITH {PAIRS}, w AS ({widened_sql('ARO')})
        SELECT l_partkey, replace(k, '_count', '') AS "FISH_probe", v AS "FISH_probe_count"
        FROM (UNPIVOT w ON "A_count", "R_count", "O_count" INTO NAME k VALUE v)""",
)
def tidy(spark, sf):
    wide = RS.widen(probe_pairs(spark, sf), COLUMN_PAIRS, ["A", "R", "O"])
    return RS.tidy(wide, ["A_count", "R_count", "O_count"])


@query(
    "widen_conservation",
    f"""WITH {PAIRS} SELECT 'probe counts kept' AS "check",
          (SELECT CAST(count(*) * 2 AS BIGINT) FROM pairs) AS observed,
          (SELECT CAST(count(*) * 2 AS BIGINT) FROM pairs) AS expected, TRUE AS ok""",
)
def widen_conservation(spark, sf):
    pairs = probe_pairs(spark, sf)
    wide = RS.widen_from_data(pairs, COLUMN_PAIRS)
    counts = [c for c in wide.columns if c.endswith("_count")]
    names = pairs.agg(Q.non_null_total(["probe_561", "probe_638"])).first()[0]
    return Q.check("probe counts kept", wide, Q.non_null_total(counts), names)


@query(
    "split_by_probe",
    """SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE) AS area, l_returnflag AS "FISH_probe",
              round(sum(l_tax), 6) AS probe_count, '0' AS batch
       FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus
       UNION ALL
       SELECT l_orderkey, CAST(sum(l_quantity) AS DOUBLE), l_linestatus, round(sum(l_discount), 6), '1'
       FROM lineitem GROUP BY l_orderkey, l_returnflag, l_linestatus""",
)
def split_by_probe(spark, sf):
    cells = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("area"),
        F.round(F.sum("l_tax"), 6).alias("probe_561_count"),
        F.round(F.sum("l_discount"), 6).alias("probe_638_count"),
    )
    return RS.split_by_probe(
        cells, {"area": None, "probe_561_count": "561", "probe_638_count": "638"},
        {"561": "l_returnflag", "638": "l_linestatus"}, ["561", "638"],
    )


@query(
    "union_by_name",
    """SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS bal, c_mktsegment AS segment
       FROM customer UNION ALL BY NAME
       SELECT s_suppkey AS key, s_nationkey AS nation, s_acctbal AS bal, s_name AS name FROM supplier""",
)
def union_by_name(spark, sf):
    a = C.select_renamed(table(spark, sf, "customer"), [
        ("c_custkey", "key"), ("c_nationkey", "nation"), ("c_acctbal", "bal"),
        ("c_mktsegment", "segment")])
    b = C.select_renamed(table(spark, sf, "supplier"), [
        ("s_suppkey", "key"), ("s_nationkey", "nation"), ("s_acctbal", "bal"), ("s_name", "name")])
    return RS.stack([a, b])


@query(
    "union_like_first",
    """SELECT c_custkey AS key, c_acctbal AS bal, c_mktsegment AS segment FROM customer
       UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""",
)
def union_like_first(spark, sf):
    a = C.select_renamed(table(spark, sf, "customer"), [
        ("c_custkey", "key"), ("c_acctbal", "bal"), ("c_mktsegment", "segment")])
    b = C.select_renamed(table(spark, sf, "supplier"), [
        ("s_suppkey", "key"), ("s_acctbal", "bal"), ("s_name", "name")])
    return RS.stack_like_first(a, b)


@query("distinct_rows", "SELECT DISTINCT p_brand, p_type FROM part")
def distinct_rows(spark, sf):
    return table(spark, sf, "part").select("p_brand", "p_type").dropDuplicates()


@query(
    "unexpected_values",
    """SELECT DISTINCT value FROM (SELECT l_returnflag AS value FROM lineitem
         UNION ALL SELECT l_linestatus FROM lineitem) WHERE value NOT IN ('A', 'N', 'F')""",
)
def unexpected_values(spark, sf):
    return RS.unexpected_values(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["A", "N", "F"]
    )


@query(
    "melt_all",
    """SELECT "Feature", "Feature weight" FROM (UNPIVOT (
         SELECT l_quantity, l_discount, l_tax FROM lineitem)
         ON l_quantity, l_discount, l_tax INTO NAME "Feature" VALUE "Feature weight")""",
)
def melt_all(spark, sf):
    measures = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax")
    return RS.melt_all(measures, "Feature", "Feature weight")


@query(
    "max_projection",
    """SELECT label, (i - 1) // 8 AS y, (i - 1) % 8 AS x, max(CAST(embedding[i] AS DOUBLE)) AS e
       FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2, 3""",
)
def max_projection(spark, sf):
    labels = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"), F.col("label").alias("group"))
    px = J.merge(pixels(spark, sf).select("fov", "y", "x", "e"), labels, ["fov"], "inner", False)
    return PX.max_projection(px, ["group", "y", "x"], "e").withColumnRenamed("group", "label")


@query(
    "label_lists",
    """SELECT vec_id, CAST(0 AS INTEGER) AS class FROM embeddings WHERE label < 5
       UNION ALL SELECT vec_id, 1 FROM embeddings WHERE label >= 5""",
)
def label_lists(spark, sf):
    points = table(spark, sf, "embeddings").select("vec_id", "label")
    lists = [points.where("label < 5"), points.where("label >= 5")]
    return RS.stack([d.select("vec_id", F.lit(i).alias("class")) for i, d in enumerate(lists)])


# ---------------------------------------------------------------- sorts

@query(
    "sorted_conditions",
    """SELECT event_type, user_band, row_number() OVER (ORDER BY event_type, user_band) AS place
       FROM (SELECT DISTINCT event_type, user_id // 10 AS user_band FROM events)""",
)
def sorted_conditions(spark, sf):
    pairs = table(spark, sf, "events").select(
        "event_type", F.expr("user_id div 10").alias("user_band")
    ).distinct()
    # a compound order as one number: the place of the type leads, the band follows
    order = {t: i for i, t in enumerate(RS.distinct_names(pairs, ["event_type"]))}
    coded = pairs.withColumn(
        "code", S.recode("event_type", order).cast("long") * 1_000_000_000 + F.col("user_band")
    )
    return RK.sequential_index(coded, "code", "place").select("event_type", "user_band", "place")


@query(
    "brightest_slices",
    """WITH s AS (SELECT label AS fov, (i - 1) // 8 AS z, CAST(embedding[i] AS DOUBLE) AS v
                  FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
            m AS (SELECT fov, z, avg(v) AS m FROM s GROUP BY 1, 2),
            b AS (SELECT fov, z AS z_best FROM (SELECT *, row_number() OVER
                  (PARTITION BY fov ORDER BY m DESC, z) AS r FROM m) WHERE r = 1)
       SELECT s.fov, s.z, b.z_best, count(*) AS px FROM s JOIN b ON s.fov = b.fov
       WHERE abs(s.z - b.z_best) <= 1 GROUP BY 1, 2, 3""",
)
def brightest_slices(spark, sf):
    labels = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("fov"), F.col("label").alias("image"))
    px = J.merge(pixels(spark, sf).select("fov", "y", "e"), labels, ["fov"], "inner", False)
    volume = px.select(F.col("image").alias("fov"), F.col("y").alias("z"), F.col("e").alias("v"))
    return PX.brightest_slices(volume, around=1).groupBy("fov", "z", "z_best").agg(
        F.count("*").alias("px")
    )
