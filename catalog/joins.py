"""Joins with flags, lookups and manifests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from cytoframe.functions import names as N
from cytoframe.operators import columns as C
from cytoframe.operators import joins as J
from cytoframe.operators import quality as Q
from cytoframe.operators import resample as R
from cytoframe.operators.stats import contingency
from cytoframe.plans import cell_table as P
from cytoframe.plans import manifests as M


# ---------------------------------------------------------------- flags

@query(
    "merge_flags",
    """SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.source, l.doc_id IS NOT NULL AS labelled,
              l.doc_id IS NULL AS unlabelled
       FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id""",
)
def merge_flags(spark, sf):
    cells = table(spark, sf, "documents").select("doc_id", "source")
    scored = table(spark, sf, "labels")
    flagged = J.outer_flag(cells, scored, ["doc_id"], "labelled")
    return J.outer_flag(flagged, scored, ["doc_id"], "unlabelled", matched=False)


@query(
    "null_key_merge",
    """WITH a AS (SELECT CASE WHEN c_acctbal < 0 THEN NULL ELSE c_nationkey END AS k,
                         count(*) AS customers FROM customer GROUP BY 1),
            b AS (SELECT CASE WHEN s_acctbal < 1000 THEN NULL ELSE s_nationkey END AS k,
                         count(*) AS suppliers FROM supplier GROUP BY 1)
       SELECT coalesce(a.k, b.k) AS k, customers, suppliers
       FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k""",
)
def null_key_merge(spark, sf):
    a = table(spark, sf, "customer").select(
        F.when(~(F.col("c_acctbal") < 0), F.col("c_nationkey")).alias("k")
    )
    b = table(spark, sf, "supplier").select(
        F.when(~(F.col("s_acctbal") < 1000), F.col("s_nationkey")).alias("k")
    )
    a = a.groupBy("k").agg(F.count("*").alias("customers"))
    b = b.groupBy("k").agg(F.count("*").alias("suppliers"))
    return J.merge(a, b, ["k"], "outer")


PER_ORDER = """per_order AS (
  SELECT l_orderkey AS o_orderkey, count(*) AS objects, sum(l_quantity) AS area
  FROM lineitem GROUP BY l_orderkey)"""


def per_order(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("objects"), F.sum("l_quantity").alias("area")
    )


@query(
    "merge_chain",
    f"""WITH {PER_ORDER}
    SELECT o.o_orderkey, o.o_custkey, p.objects, p.area, c.c_mktsegment, n.n_name, n.n_regionkey
    FROM orders o FULL JOIN per_order p ON o.o_orderkey = p.o_orderkey
    FULL JOIN customer c ON o.o_custkey = c.c_custkey
    FULL JOIN nation n ON c.c_nationkey = n.n_nationkey
    WHERE o.o_orderkey IS NOT NULL""",
)
def merge_chain(spark, sf):
    images = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    people = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment"
    )
    places = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"
    )
    merged = J.merge(images, per_order(spark, sf), ["o_orderkey"], "outer")
    merged = J.merge(merged, people, ["o_custkey"], "outer")
    merged = J.merge(merged, places, ["c_nationkey"], "outer")
    merged = C.order_columns(Q.without_key(merged, "o_orderkey"), ["o_orderkey", "o_custkey"])
    return merged.drop("c_nationkey")


@query(
    "natural_join",
    """SELECT c.c_custkey, n.n_name, r.r_name
       FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
       LEFT JOIN (SELECT * FROM region WHERE r_name <> 'ASIA') r ON n.n_regionkey = r.r_regionkey""",
)
def natural_join(spark, sf):
    customer = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nation")
    )
    nation = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("nation"), "n_name", F.col("n_regionkey").alias("region")
    )
    region = table(spark, sf, "region").where("r_name <> 'ASIA'").select(
        F.col("r_regionkey").alias("region"), "r_name"
    )
    return J.merge(J.merge(customer, nation), region, None, "left").drop("nation", "region")


@query(
    "join_renamed",
    """SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
)
def join_renamed(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return J.merge_renamed(supplier, nation, {"s_nationkey": "n_nationkey"})


# ---------------------------------------------------------------- lookups

@query(
    "first_match",
    """SELECT o_orderkey, part, price FROM orders LEFT JOIN (
         SELECT l_orderkey, l_partkey AS part, l_extendedprice AS price,
                row_number() OVER (PARTITION BY l_orderkey
                  ORDER BY l_linenumber, l_partkey, l_extendedprice) AS rn
         FROM lineitem) ON l_orderkey = o_orderkey AND rn = 1""",
)
def first_match(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber",
        F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("price"),
    )
    orders = table(spark, sf, "orders").select("o_orderkey")
    return J.first_match(
        orders, lines, ["o_orderkey"], ["l_linenumber", "part", "price"]
    ).drop("l_linenumber")


@query(
    "anti_missing",
    """SELECT o_orderkey, o_custkey FROM orders
       WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def anti_missing(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return J.anti(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


@query(
    "semi_sample",
    """WITH keys AS (SELECT l_orderkey FROM (SELECT DISTINCT l_orderkey FROM lineitem)
         ORDER BY CAST('0x' || substr(md5('7|' || l_orderkey), 1, 13) AS BIGINT), l_orderkey LIMIT 2)
       SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
       WHERE l_orderkey IN (SELECT l_orderkey FROM keys)""",
)
def semi_sample(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity"
    )
    return J.semi(lines, R.sample_keys(lines, "l_orderkey", 2, 7), ["l_orderkey"])


@query(
    "lookup_by_name",
    """SELECT e.event_id, c.c_name FROM events e JOIN customer c
       ON c.c_name = 'Customer#' || lpad(CAST(e.user_id AS VARCHAR), 9, '0')""",
)
def lookup_by_name(spark, sf):
    events = table(spark, sf, "events").select(
        "event_id",
        F.concat(F.lit("Customer#"), F.lpad(F.col("user_id").cast("string"), 9, "0")).alias("c_name"),
    )
    return J.merge(events, table(spark, sf, "customer").select("c_name"), ["c_name"], "inner", False)


@query(
    "new_columns_merge",
    """SELECT o_orderkey, o_custkey, o_orderstatus, objects, area
       FROM orders JOIN (SELECT l_orderkey, count(*) AS objects, sum(l_quantity) AS area
                         FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""",
)
def new_columns_merge(spark, sf):
    cells = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    made = per_order(spark, sf).withColumn("o_orderstatus", F.lit("not used"))
    new = [c for c in made.columns if c not in cells.columns]
    return J.merge(cells, made.select("o_orderkey", *new), ["o_orderkey"], "inner", False)


@query(
    "join_conservation",
    """SELECT (SELECT count(*) FROM orders) AS main_rows, count(*) AS merged_rows,
              (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
                AS missing_rows, FALSE AS conserved
       FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem) ON l_orderkey = o_orderkey""",
)
def join_conservation(spark, sf):
    return J.conservation(
        table(spark, sf, "orders"), per_order(spark, sf), ["o_orderkey"]
    )


# ---------------------------------------------------------------- image tables

@query(
    "failed_images",
    """WITH f AS (SELECT o_orderkey, coalesce(o_orderstatus = 'F', FALSE)
                    OR o_totalprice > 400000 AS failed FROM orders)
       SELECT l_orderkey, count(*) AS objects, bool_or(failed) AS image_failed
       FROM lineitem JOIN f ON l_orderkey = o_orderkey GROUP BY 1""",
)
def failed_images(spark, sf):
    images = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_orderstatus") == "F", 1.0).when(
            F.col("o_orderstatus") == "O", 0.0
        ).alias("ModuleError_01"),
        (F.col("o_totalprice") > 400000).cast("double").alias("ModuleError_02"),
    )
    failed = Q.failed_images(images, "l_orderkey")
    objects = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("objects"))
    return J.membership(objects, "l_orderkey", failed, "image_failed")


@query(
    "object_counts",
    """SELECT coalesce(a.source, b.source) AS source, "Count_en", "Count_fr", lang
       FROM (SELECT source, count(*) FILTER (lang = 'en') AS "Count_en",
                    count(*) FILTER (lang = 'fr') AS "Count_fr" FROM documents GROUP BY 1) a
       FULL JOIN (SELECT DISTINCT source, lang FROM documents WHERE n_chars > 4000) b
         ON a.source = b.source""",
)
def object_counts(spark, sf):
    docs = table(spark, sf, "documents")
    images = docs.groupBy("source").agg(
        F.count_if(F.col("lang") == "en").alias("Count_en"),
        F.count_if(F.col("lang") == "fr").alias("Count_fr"),
    )
    counts = C.keep_existing(images, ["source", "Count_en", "Count_fr", "Count_absent"])
    metadata = docs.where("n_chars > 4000").select("source", "lang").distinct()
    return J.merge(counts, metadata, ["source"], "outer", many="right")


@query(
    "structure_scores",
    """SELECT coalesce(d.doc_id, l.doc_id) AS "FOVId", coalesce(d.cell, l.cell)
                AS "napariCell_ObjectNumber", d.n_chars, quality AS mh_structure_org_score,
              toxic AS kg_structure_org_score
       FROM (SELECT doc_id, CAST(length(lang) AS INTEGER) AS cell, n_chars FROM documents) d
       FULL JOIN (SELECT doc_id, 1 + quality AS cell, quality, toxic FROM labels) l
         ON d.doc_id = l.doc_id AND d.cell = l.cell""",
)
def structure_scores(spark, sf):
    cells = table(spark, sf, "documents").select(
        F.col("doc_id").alias("FOVId"),
        F.length("lang").alias("napariCell_ObjectNumber"), "n_chars",
    )
    scores = table(spark, sf, "labels").select(
        F.col("doc_id").alias("fov_id"), (1 + F.col("quality")).alias("cell_num"),
        F.col("quality").alias("mh score"), F.col("toxic").alias("kg score"),
        F.lit("x").alias("file_base"), F.lit("y").alias("single_cell_id"),
    )
    return P.add_structure_scores(cells, scores)


@query(
    "localisation_scores",
    """SELECT coalesce(d.doc_id, l.doc_id) AS "FOVId", coalesce(d.cell, l.cell)
                AS "napariCell_ObjectNumber", d.source, s561 AS probe_561_loc_score
       FROM (SELECT doc_id, 2 AS cell, source FROM documents) d
       FULL JOIN (SELECT doc_id, 1 + quality AS cell,
                    CASE toxic WHEN 1 THEN 'n' ELSE '2' END AS s561 FROM labels) l
         ON d.doc_id = l.doc_id AND d.cell = l.cell""",
)
def localisation_scores(spark, sf):
    cells = table(spark, sf, "documents").select(
        F.col("doc_id").alias("FOVId"), F.lit(2).alias("napariCell_ObjectNumber"), "source"
    )
    scores = table(spark, sf, "labels").select(
        F.col("doc_id").alias("FOVId"), (1 + F.col("quality")).alias("cell_num"),
        F.when(F.col("toxic") == 1, "n").otherwise("2").alias("probe_561_loc_score"),
        F.lit("f").alias("file_name"),
    )
    return P.add_localisation_scores(cells, scores)


# ---------------------------------------------------------------- manifests

@query(
    "scores_with_field",
    """WITH m AS (SELECT page_id AS fov_id, CAST(page_id % 5 AS INTEGER) AS cell_num,
                    array_to_string(string_split('x_y_' || regexp_replace(split_part(url, '/', 3),
                      '[.]', '_', 'g') || '_' || page_id, '_')[3:10], '_') AS file_base FROM pages),
            s AS (SELECT CAST(page_id % 3 AS INTEGER) AS cell_num,
                    split_part(regexp_replace(split_part(url, '/', 3), '[.]', '_', 'g') || '_' || page_id
                      || '.tif', '.', 1) AS file_base,
                    length(html) AS "mh score" FROM pages)
       SELECT m.fov_id AS "FOVId", coalesce(m.cell_num, s.cell_num) AS cell_num,
              coalesce(m.file_base, s.file_base) AS file_base, s."mh score"
       FROM m FULL JOIN s ON m.cell_num = s.cell_num AND m.file_base = s.file_base""",
)
def scores_with_field(spark, sf):
    pages = table(spark, sf, "pages")
    host = F.regexp_replace(N.word("url", 2, "/"), "[.]", "_")
    stem = F.concat(host, F.lit("_"), F.col("page_id").cast("string"))
    manifest = pages.select(
        F.col("page_id").alias("fov_id"),
        (F.col("page_id") % 5).cast("int").alias("cell_label_value"),
        F.concat(F.lit("/data/x_y_"), stem).alias("rescaled_2D_fov_tiff_path"),
    )
    scores = pages.select(
        (F.col("page_id") % 3).cast("int").alias("cell_num"),
        F.concat(stem, F.lit(".tif")).alias("file_name"),
        F.length("html").cast("long").alias("mh score"),
    )
    return M.scores_with_field(scores, manifest).drop("file_name")


@query(
    "holdout_scores",
    """WITH j AS (SELECT c_custkey AS f, c_nationkey AS cell, o_orderpriority AS "mh score"
                  FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F')
       SELECT coalesce(z.f, j.f) AS "FOVId", coalesce(z.cell, j.cell) AS "napariCell_ObjectNumber",
              z.score AS no_structure, j."mh score"
       FROM (SELECT s_suppkey AS f, s_nationkey AS cell, 0 AS score FROM supplier) z
       FULL JOIN j ON z.f = j.f AND z.cell = j.cell""",
)
def holdout_scores(spark, sf):
    manifest = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("CellPath"), F.col("c_custkey").alias("fov_id"),
        F.col("c_nationkey").alias("cell_label_value"), F.lit("p").alias("original_fov_location"),
    )
    scores = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("CellPath"),
        F.when(F.col("o_orderstatus") == "F", "fish").otherwise("live").alias("type"),
        F.col("o_orderpriority").alias("MH_score"), F.lit(1).alias("plate"),
    )
    zeros = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("fov_id"), F.col("s_nationkey").alias("cell_label_value"),
        F.lit(0).alias("score"),
    )
    return M.holdout_scores(scores, manifest, zeros)


@query(
    "live_manifest",
    """WITH m AS (SELECT o_orderkey AS cell_id, CAST(o_custkey % 30 AS BIGINT) AS plate,
                    split_part(o_orderpriority, '-', 1) AS well_position,
                    strftime(o_orderdate, '%Y%m%d') AS image_date FROM orders),
            s AS (SELECT l_orderkey AS cell_id, o_custkey % 30 AS plate, count(*) AS score
                  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
                  WHERE l_returnflag = 'R' GROUP BY 1, 2),
            p AS (SELECT n_nationkey AS plate, n_regionkey AS age FROM nation WHERE n_regionkey <> 2)
       SELECT m.cell_id, coalesce(m.plate, p.plate) AS plate_name, m.well_position, m.image_date,
              s.score, p.age AS "Cell age"
       FROM m LEFT JOIN s ON m.cell_id = s.cell_id AND m.plate = s.plate
       FULL JOIN p ON m.plate = p.plate""",
)
def live_manifest(spark, sf):
    orders = table(spark, sf, "orders")
    raw = F.concat(
        F.lit("/raw/"), (F.col("o_custkey") % 30).cast("string"), F.lit("_63X_"),
        F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_a b c d e f "),
        F.substring_index("o_orderpriority", "-", 1), F.lit(" g.czi"),
    )
    manifest = orders.select(F.col("o_orderkey").alias("CellId"), raw.alias("RawFilePath"))
    scores = (
        J.merge(
            table(spark, sf, "lineitem").select(
                F.col("l_orderkey").alias("CellId"),
                F.when(F.col("l_returnflag") == "R", "live").otherwise("fish").alias("type"),
            ),
            manifest, ["CellId"], "inner", False,
        )
        .groupBy(F.col("CellId").alias("cell_id"), "RawFilePath", "type")
        .agg(F.count("*").alias("score"))
        .withColumn("plate", N.word(F.substring_index("RawFilePath", "/", -1), 0, "_").cast("long"))
    )
    plates = table(spark, sf, "nation").select(
        F.col("n_nationkey").cast("long").alias("plate"),
        F.when(F.col("n_regionkey") != 2, "live").otherwise("fish").alias("type"),
        F.col("n_regionkey").alias("age"), F.lit("all").alias("wells"),
    )
    return M.live_manifest(manifest, scores, plates).drop("FOV")


@query(
    "plate_dates",
    """SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '-' || o_orderstatus AS ge_wellID,
              c_mktsegment AS dataset
       FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def plate_dates(spark, sf):
    cells = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("plate_name"), "o_orderstatus"
    )
    plates = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("plate_name"), F.col("c_mktsegment").alias("dataset")
    )
    joined = J.merge(cells, plates, ["plate_name"])
    return joined.select(
        "o_orderkey", N.well_id("plate_name", "o_orderstatus").alias("ge_wellID"), "dataset"
    )


@query(
    "classifier_join",
    """SELECT CAST(o_orderkey AS VARCHAR) AS obj, CAST(round(sum(l_quantity), 2) AS DOUBLE) AS score
       FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""",
)
def classifier_join(spark, sf):
    cells = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("int").cast("string").alias("obj")
    )
    scores = per_order(spark, sf).select(
        F.col("o_orderkey").cast("int").cast("string").alias("obj"),
        F.round("area", 2).alias("score"),
    )
    return J.merge(cells, scores, ["obj"])


@query(
    "contingency",
    """SELECT event_type, band, count(*) AS "Count" FROM (
         SELECT event_type, CASE WHEN value >= 1 THEN CAST(floor(value / 50) AS INTEGER) END AS band
         FROM events) WHERE band IS NOT NULL GROUP BY 1, 2""",
)
def contingency_table(spark, sf):
    events = table(spark, sf, "events").select(
        "event_type", "event_id",
        F.when(F.col("value") >= 1, F.floor(F.col("value") / 50).cast("int")).alias("band"),
    )
    return contingency(events, ["event_type", "band"])
