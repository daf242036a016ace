"""Cleaning, scores, scaling, statistics and the weighted ridge."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.tables import table
from cytoframe.functions import scalars as S
from cytoframe.operators import joins as J
from cytoframe.operators import models as MD
from cytoframe.operators import quality as Q
from cytoframe.operators import ranks as RK
from cytoframe.operators import stats as ST
from cytoframe.operators.columns import quoted


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(quoted(c), digits) for c in columns})


# ---------------------------------------------------------------- cleaning

SPARSE = """sparse AS (
  SELECT l_orderkey, l_linenumber, l_partkey,
         CASE WHEN l_discount > 0.005 THEN l_quantity END AS f1,
         CASE WHEN l_discount < 0.065 THEN l_extendedprice END AS f2,
         l_tax AS f3, CASE WHEN l_tax > 0.005 THEN l_discount END AS f4
  FROM lineitem)"""


def sparse_lines(spark, sf):
    d, t = F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(d > 0.005, F.col("l_quantity")).alias("f1"),
        F.when(d < 0.065, F.col("l_extendedprice")).alias("f2"),
        t.alias("f3"), F.when(t > 0.005, d).alias("f4"),
    )


FEATURES = ["f1", "f2", "f3", "f4"]


@query(
    "null_fractions",
    f"""WITH {SPARSE}, s AS (SELECT avg(CAST(f1 IS NULL AS INTEGER)) AS f1,
          avg(CAST(f2 IS NULL AS INTEGER)) AS f2, avg(CAST(f3 IS NULL AS INTEGER)) AS f3,
          avg(CAST(f4 IS NULL AS INTEGER)) AS f4 FROM sparse)
        SELECT feature, round(share, 9) AS share, share < 0.2 AS kept
        FROM (UNPIVOT s ON f1, f2, f3, f4 INTO NAME feature VALUE share)""",
)
def null_fractions(spark, sf):
    df = sparse_lines(spark, sf)
    shares = df.agg(*[F.avg(quoted(c).isNull().cast("double")).alias(c) for c in FEATURES])
    _, kept = Q.prune_missing(df, FEATURES, 0.2)
    return shares.unpivot([], FEATURES, "feature", "share").select(
        "feature", F.round("share", 9).alias("share"), F.col("feature").isin(kept).alias("kept")
    )


@query(
    "null_prune",
    f"""WITH {SPARSE} SELECT l_orderkey, l_linenumber, l_partkey, f1, f3, f4 FROM sparse
        WHERE (CAST(f1 IS NULL AS INTEGER) + CAST(f3 IS NULL AS INTEGER)
               + CAST(f4 IS NULL AS INTEGER)) / 3.0 < 0.2""",
)
def null_prune(spark, sf):
    df, _ = Q.prune_iteratively(sparse_lines(spark, sf), FEATURES, [0.25, 0.2])
    return df


@query(
    "low_variance",
    """WITH w AS (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity AS a,
                    CASE WHEN l_returnflag = 'R' THEN 1.5 ELSE l_tax END AS b, l_discount AS c
                  FROM lineitem),
            v AS (SELECT min(least(va, ra)) AS va, min(least(vb, rb)) AS vb, min(least(vc, rc)) AS vc
                  FROM (SELECT var_pop(a) AS va, max(a) - min(a) AS ra, var_pop(b) AS vb,
                          max(b) - min(b) AS rb, var_pop(c) AS vc, max(c) - min(c) AS rc
                        FROM w GROUP BY l_returnflag, l_linestatus))
       SELECT l_orderkey, l_returnflag, l_linestatus, a, c FROM w, v
       WHERE vb <= 0 AND va > 0 AND vc > 0""",
)
def low_variance(spark, sf):
    wide = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_returnflag", "l_linestatus", F.col("l_quantity").alias("a"),
        F.when(F.col("l_returnflag") == "R", 1.5).otherwise(F.col("l_tax")).alias("b"),
        F.col("l_discount").alias("c"),
    )
    kept, _ = Q.drop_low_variance(wide, ["l_returnflag", "l_linestatus"], ["a", "b", "c"])
    return kept


SCORES = """scores AS (
  SELECT d.doc_id, d.n_chars, CASE WHEN l.quality IS NULL THEN NULL WHEN l.toxic = 1 THEN 'n'
           WHEN l.quality = 1 THEN CAST(CAST(d.n_chars % 4 AS INTEGER) AS VARCHAR) ELSE ' ' END AS mark,
         CASE WHEN l.quality = 1 THEN CAST(d.n_chars % 7 AS INTEGER) - 1 END AS mh,
         CASE WHEN l.toxic = 0 THEN CAST(d.n_chars % 6 AS INTEGER) END AS kg
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def score_table(spark, sf):
    n = F.col("n_chars")
    joined = J.merge(
        table(spark, sf, "documents").select("doc_id", "n_chars"), table(spark, sf, "labels"),
        ["doc_id"], "left", False,
    )
    return joined.select(
        "doc_id", "n_chars",
        F.when(F.col("quality").isNull(), None).when(F.col("toxic") == 1, "n")
        .when(F.col("quality") == 1, (n % 4).cast("int").cast("string")).otherwise(" ").alias("mark"),
        F.when(F.col("quality") == 1, (n % 7).cast("int") - 1).alias("mh"),
        F.when(F.col("toxic") == 0, (n % 6).cast("int")).alias("kg"),
    )


@query(
    "score_clean",
    f"""WITH {SCORES} SELECT doc_id, CASE mark WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2
            WHEN '3' THEN 2 END AS loc, CASE mark WHEN '0' THEN 0 WHEN '1' THEN 1 WHEN '2' THEN 2
            WHEN '3' THEN 3 END AS loc_all,
          CASE kg WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 WHEN 5 THEN 3 END AS coarse,
          CASE mark WHEN 'n' THEN 'Low expression' WHEN '0' THEN 'Non-sarcomeric'
            WHEN '1' THEN 'Sarcomeric' WHEN '2' THEN 'Sarcomeric' WHEN '3' THEN 'Sarcomeric' END AS named
        FROM scores""",
)
def score_clean(spark, sf):
    from cytoframe.plans.plot_tables import LOCALISATION

    return score_table(spark, sf).select(
        "doc_id", S.clean_score("mark").alias("loc"),
        S.clean_score("mark", threes_to_twos=False).alias("loc_all"),
        S.recode("kg", {1: 1, 2: 1, 3: 2, 4: 3, 5: 3}).alias("coarse"),
        S.recode("mark", LOCALISATION).alias("named"),
    )


@query(
    "drop_bad_scores",
    f"""WITH {SCORES} SELECT doc_id, mh, kg FROM scores
        WHERE (mh IS NULL OR mh NOT IN (0, -1)) AND (kg IS NULL OR kg NOT IN (0, -1))""",
)
def drop_bad_scores(spark, sf):
    return Q.drop_scored(score_table(spark, sf).select("doc_id", "mh", "kg"), ["mh", "kg"])


@query(
    "keep_flags",
    f"""WITH {SCORES} SELECT doc_id, coalesce(mh > 0, FALSE) AND coalesce(kg > 0, FALSE) AS both_positive,
          mark IS NULL AS unmarked, coalesce(n_chars / nullif(CAST(kg AS DOUBLE), 0) >= 1080, FALSE)
            AS dense, coalesce(mh, 0) AS mh_filled
        FROM scores""",
)
def keep_flags(spark, sf):
    df = score_table(spark, sf).withColumn("mh_filled", F.col("mh")).fillna(0, ["mh_filled"])
    return df.select(
        "doc_id", S.keep_both_positive("mh", "kg").alias("both_positive"),
        S.keep_unmarked("mark").alias("unmarked"), S.keep_dense("n_chars", "kg").alias("dense"),
        "mh_filled",
    )


@query(
    "consensus_scores",
    f"""WITH {SCORES} SELECT doc_id, (mh + kg) / 2.0 AS consensus, CAST(ceil((mh + kg) / 2.0) AS INTEGER)
            AS round_up, CASE CAST(ceil((mh + kg) / 2.0) AS INTEGER) WHEN 1 THEN '1-2' WHEN 2 THEN '1-2'
            WHEN 3 THEN '3' WHEN 4 THEN '4-5' WHEN 5 THEN '4-5' END AS grouped,
          CASE WHEN mh IS NULL AND kg IS NULL THEN NULL ELSE
            (coalesce(mh, 0) + coalesce(kg, 0)) / CAST((mh IS NOT NULL)::INT + (kg IS NOT NULL)::INT
              AS DOUBLE) END AS present_mean
        FROM scores""",
)
def consensus_scores(spark, sf):
    df = score_table(spark, sf).withColumn("consensus", S.mean_or_null("mh", "kg"))
    return df.select(
        "doc_id", "consensus", S.round_up("consensus").alias("round_up"),
        S.grouped_score("consensus").alias("grouped"),
        S.mean_of_present("mh", "kg").alias("present_mean"),
    )


# ---------------------------------------------------------------- ratios and units

@query(
    "units_ratios",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / nullif(l_discount, 0), 6) AS density,
              round(l_quantity * 0.0144, 6) AS area_um, round(l_quantity * 0.12, 6) AS length_um,
              round(l_tax / 0.0144, 6) AS per_um,
              round((l_quantity + l_linenumber) / (l_quantity + l_extendedprice)
                    - (l_tax + l_discount), 6) AS gain,
              round((l_tax / 0.02 - l_discount / 0.04) / nullif(l_tax / 0.02 + l_discount / 0.04, 0), 6)
                AS rel_diff
       FROM lineitem""",
)
def units_ratios(spark, sf):
    made = {
        "density": S.ratio("l_quantity", "l_discount"),
        "area_um": S.area_units("l_quantity"),
        "length_um": S.length_units("l_quantity"),
        "per_um": S.density_units("l_tax"),
        "gain": S.enrichment(
            ["l_quantity", "l_linenumber"], "l_quantity", "l_extendedprice", ["l_tax", "l_discount"]
        ),
        "rel_diff": S.relative_difference("l_tax", "l_discount", F.lit(0.02), F.lit(0.04)),
    }
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", *[e.alias(n) for n, e in made.items()]
    )
    return rounded(df, list(made))


@query(
    "class_densities",
    """WITH p AS (SELECT l_orderkey,
         count(*) FILTER (l_returnflag = 'A') AS p0, count(*) FILTER (l_returnflag = 'N') AS p1,
         count(*) FILTER (l_returnflag = 'R') AS p2,
         CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'A'), 0) AS BIGINT) AS a0,
         CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'N'), 0) AS BIGINT) AS a1,
         CAST(coalesce(sum(l_linenumber) FILTER (l_returnflag = 'R'), 0) AS BIGINT) AS a2
       FROM lineitem GROUP BY 1)
       SELECT l_orderkey, CASE WHEN a0 = 0 THEN 0 ELSE round(p0 / a0, 6) END AS in_0,
         round((p1 + p2) / nullif(a1 + a2, 0), 6) AS out_0, p1 + p2 AS probe_out_0, a0 + a1 AS area_out_2,
         CASE WHEN a2 = 0 THEN 0 ELSE round(p2 / a2, 6) END AS in_2 FROM p""",
)
def class_densities(spark, sf):
    made = {}
    for k, flag in enumerate("ANR"):
        hit = F.col("l_returnflag") == flag
        made[f"seg_561_probe_px_class_{k}"] = F.count_if(hit)
        made[f"seg_561_area_px_class_{k}"] = F.coalesce(
            F.sum(F.when(hit, F.col("l_linenumber"))), F.lit(0)
        )
    df = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        *[e.alias(n) for n, e in made.items()]
    )
    df = df.withColumns(S.class_densities("seg_561", range(3)))
    return df.select(
        "l_orderkey", F.round("seg_561_density_class_0", 6).alias("in_0"),
        F.round("seg_561_density_OUTSIDE_class_0", 6).alias("out_0"),
        F.col("seg_561_probe_px_OUTSIDE_class_0").alias("probe_out_0"),
        F.col("seg_561_area_px_OUTSIDE_class_2").alias("area_out_2"),
        F.round("seg_561_density_class_2", 6).alias("in_2"),
    )


@query(
    "clamp_round",
    """SELECT event_id, CAST(least(greatest(round_even(value / 20, 0), 1), 5) AS INTEGER) AS score
       FROM events""",
)
def clamp_round(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", S.rounded_score(F.col("value") / 20).alias("score")
    )


# ---------------------------------------------------------------- scaling and medians

@query(
    "median_normalise",
    """SELECT event_id, round(value / median(value) OVER (PARTITION BY event_type), 6) AS rel
       FROM events""",
)
def median_normalise(spark, sf):
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    out = ST.over_group_median(events, ["event_type"], "value", "rel")
    return rounded(out.select("event_id", "rel"), ["rel"])


@query(
    "norm_difference",
    """WITH m AS (SELECT median(l_quantity) AS q, median(l_tax) AS t FROM lineitem)
       SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity / q - l_tax / t)
                / nullif(l_quantity / q + l_tax / t, 0), 6) AS diff FROM lineitem, m""",
)
def norm_difference(spark, sf):
    lines = table(spark, sf, "lineitem")
    q, t = ST.global_median(lines, "l_quantity"), ST.global_median(lines, "l_tax")
    diff = S.relative_difference("l_quantity", "l_tax", F.lit(q), F.lit(t))
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round(diff, 6).alias("diff")
    )


MEASURES = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "zscore_global",
    """SELECT l_orderkey, l_linenumber, l_partkey,
              round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6)
                AS l_quantity,
              round((l_extendedprice - avg(l_extendedprice) OVER ())
                / stddev_pop(l_extendedprice) OVER (), 6) AS l_extendedprice,
              round((l_tax - avg(l_tax) OVER ()) / stddev_pop(l_tax) OVER (), 6) AS l_tax
       FROM lineitem""",
)
def zscore_global(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *MEASURES)
    return rounded(ST.apply_scaler(df, ST.scaler_params(df, MEASURES), MEASURES), MEASURES)


@query(
    "zscore_by_group",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag,
              round((l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER (), 6)
                AS l_quantity,
              round((l_tax - avg(l_tax) OVER w) / stddev_pop(l_tax) OVER w, 6) AS l_tax, one
       FROM (SELECT *, CAST(0 AS DOUBLE) AS one FROM lineitem)
       WINDOW w AS (PARTITION BY l_returnflag)""",
)
def zscore_by_group(spark, sf):
    df = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_quantity", "l_tax",
        F.lit(7.0).alias("one"),
    )
    columns = ["l_quantity", "l_tax", "one"]
    out, _ = ST.z_scores({"all": df}, columns, ["l_tax"], "l_returnflag", fit_on="all")
    return rounded(out["all"], columns)


@query(
    "zscore_train_apply",
    """WITH p AS (SELECT avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem
                  WHERE l_shipdate < TIMESTAMP '1998-01-01')
       SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - m) / s, 6) AS l_quantity,
              CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS split
       FROM lineitem, p""",
)
def zscore_train_apply(spark, sf):
    df = table(spark, sf, "lineitem")
    early = F.col("l_shipdate") < F.expr("timestamp_ntz'1998-01-01'")
    keep = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity"]
    splits = {"train": df.where(early).select(keep), "test": df.where(~early).select(keep)}
    out, _ = ST.z_scores(splits, ["l_quantity"])
    both = [d.withColumn("split", F.lit(s)) for s, d in out.items()]
    return rounded(both[0].unionByName(both[1]), ["l_quantity"])


# ---------------------------------------------------------------- intervals and ranks

@query(
    "ci_quantiles",
    """SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.025), 6) AS ci_low,
              round(quantile_cont(value, 0.975), 6) AS ci_high FROM events GROUP BY 1""",
)
def ci_quantiles(spark, sf):
    out = ST.mean_interval(table(spark, sf, "events"), ["event_type"], "value")
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "group_quartiles",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS c25,
              round(quantile_cont(l_extendedprice, 0.5), 6) AS c50,
              round(quantile_cont(l_extendedprice, 0.75), 6) AS c75,
              min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest
       FROM lineitem GROUP BY 1""",
)
def group_quartiles(spark, sf):
    probs = {"c25": 0.25, "c50": 0.5, "c75": 0.75, "lowest": 0.0, "highest": 1.0}
    out = RK.group_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", probs)
    return rounded(out, ["c25", "c50", "c75"])


@query(
    "average_ranks",
    """SELECT DISTINCT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value)
         + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r FROM events""",
)
def average_ranks(spark, sf):
    return RK.average_ranks(table(spark, sf, "events"), ["event_type"], "value", "r")


@query(
    "spearman",
    """WITH r AS (SELECT event_type,
           rank() OVER (PARTITION BY event_type ORDER BY value)
             + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rx,
           rank() OVER (PARTITION BY event_type ORDER BY user_id)
             + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ry FROM events)
       SELECT event_type, round(corr(rx, ry), 6) AS rho FROM r GROUP BY 1""",
)
def spearman(spark, sf):
    return rounded(
        ST.spearman(table(spark, sf, "events"), ["event_type"], "value", "user_id"), ["rho"]
    )


@query(
    "sequential_index",
    """SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n,
              row_number() OVER (ORDER BY o_orderkey) - 1 AS overall FROM orders""",
)
def sequential_index(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    df = RK.sequential_index(df, "o_orderkey", "n", ["o_orderstatus"])
    return RK.sequential_index(df, "o_orderkey", "overall", start=0).drop("o_orderstatus")


# ---------------------------------------------------------------- models

DOCS = """d AS (SELECT doc_id, CAST(n_chars AS DOUBLE) / 1000 AS x1, CAST(length(source) AS DOUBLE) AS x2,
                 quality FROM documents JOIN labels USING (doc_id))"""


def labelled_documents(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", (F.col("n_chars") / 1000).alias("x1"),
        F.length("source").cast("double").alias("x2"),
    )
    return J.merge(docs, table(spark, sf, "labels").select("doc_id", "quality"), ["doc_id"],
                   "inner", False)


RIDGE = f"""WITH {DOCS},
  w AS (SELECT *, CAST(count(*) OVER () AS DOUBLE) / count(*) OVER (PARTITION BY quality) AS w FROM d),
  m AS (SELECT sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2,
               sum(w * quality) / sum(w) AS my FROM w),
  c AS (SELECT sum(w * (x1 - m1) * (x1 - m1)) + 0.001 AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b,
               sum(w * (x2 - m2) * (x2 - m2)) + 0.001 AS c, sum(w * (x1 - m1) * (quality - my)) AS u,
               sum(w * (x2 - m2) * (quality - my)) AS v FROM w, m),
  s AS (SELECT (c * u - b * v) / (a * c - b * b) AS k1, (a * v - b * u) / (a * c - b * b) AS k2 FROM c)"""


@query(
    "class_weights",
    f"""WITH {DOCS} SELECT doc_id, round(CAST(count(*) OVER () AS DOUBLE)
          / count(*) OVER (PARTITION BY quality), 6) AS weight FROM d""",
)
def class_weights(spark, sf):
    out = ST.class_weights(labelled_documents(spark, sf), "quality")
    return rounded(out.select("doc_id", "weight"), ["weight"])


@query(
    "ridge_fit",
    f"""{RIDGE} SELECT 'x1' AS feature, round(k1, 6) AS coef FROM s
        UNION ALL SELECT 'x2', round(k2, 6) FROM s""",
)
def ridge_fit(spark, sf):
    model = MD.fit_ridge(labelled_documents(spark, sf), ["x1", "x2"], "quality")
    return rounded(model.table(spark), ["coef"])


@query(
    "ridge_missing",
    f"""{RIDGE.replace("AS w FROM d)", "AS w FROM d WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0)")}
        SELECT 'x1' AS feature, round(k1, 4) AS coef FROM s UNION ALL SELECT 'x2', round(k2, 4) FROM s""",
)
def ridge_missing(spark, sf):
    """Rows with a missing value take no part, and a large offset changes no slope."""
    df = labelled_documents(spark, sf).withColumns(
        {
            "x1": F.when(F.col("doc_id") % 5 != 0, F.col("x1") + 1e6),
            "quality": F.when(F.col("doc_id") % 7 != 0, F.col("quality")),
        }
    )
    return rounded(MD.fit_ridge(df, ["x1", "x2"], "quality").table(spark), ["coef"], 4)


@query(
    "ridge_predict",
    f"""{RIDGE} SELECT doc_id, round(my + k1 * (x1 - m1) + k2 * (x2 - m2), 6) AS predicted
        FROM d, m, s""",
)
def ridge_predict(spark, sf):
    df = labelled_documents(spark, sf)
    model = MD.fit_ridge(df, ["x1", "x2"], "quality")
    return rounded(model.predict(df, "predicted").select("doc_id", "predicted"), ["predicted"])


@query(
    "confusion_report",
    """WITH p AS (SELECT CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, quality AS t,
                    toxic AS p FROM labels),
            l AS (SELECT DISTINCT split, label FROM (SELECT split, t AS label FROM p UNION ALL
                  SELECT split, p FROM p)),
            s AS (SELECT l.split, l.label, count(*) FILTER (p.t = l.label) AS sup,
                    count(*) FILTER (p.p = l.label) AS prd,
                    count(*) FILTER (p.t = l.label AND p.p = l.label) AS hit
                  FROM l JOIN p ON p.split = l.split GROUP BY 1, 2),
            q AS (SELECT split, sup, coalesce(hit / nullif(prd, 0), 0) AS pr,
                    coalesce(hit / nullif(sup, 0), 0) AS rc FROM s),
            f AS (SELECT *, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM q)
       SELECT split, 'macro avg' AS "Reduction", round(avg(pr), 6) AS precision,
              round(avg(rc), 6) AS recall, round(avg(f1), 6) AS "f1-score",
              CAST(sum(sup) AS BIGINT) AS support FROM f GROUP BY split
       UNION ALL SELECT split, 'weighted avg', round(sum(pr * sup) / sum(sup), 6),
              round(sum(rc * sup) / sum(sup), 6), round(sum(f1 * sup) / sum(sup), 6),
              CAST(sum(sup) AS BIGINT) FROM f GROUP BY split""",
)
def confusion_report(spark, sf):
    labels = table(spark, sf, "labels").select(
        F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("split"),
        F.col("quality").alias("true"), F.col("toxic").alias("pred"),
    )
    out = ST.confusion_report(labels, ["split"])
    return rounded(out, ["precision", "recall", "f1-score"])


@query(
    "annotator_accuracy",
    """SELECT CAST(doc_id % 3 AS INTEGER) AS part, round(avg(CAST(quality = toxic AS INTEGER)), 6) AS accuracy
       FROM labels GROUP BY 1""",
)
def annotator_accuracy(spark, sf):
    labels = table(spark, sf, "labels").withColumn("part", (F.col("doc_id") % 3).cast("int"))
    return rounded(ST.accuracy(labels, ["part"], "quality", "toxic"), ["accuracy"])


# ---------------------------------------------------------------- checks

@query(
    "data_checks",
    """SELECT 'orders' AS "check", (SELECT count(*) FROM orders) AS observed,
              (SELECT count(DISTINCT o_orderkey) FROM orders) AS expected, TRUE AS ok
       UNION ALL SELECT 'lines without part', (SELECT count(*) FROM lineitem WHERE l_partkey IS NULL),
              0, TRUE
       UNION ALL SELECT 'bad flags', (SELECT count(*) FROM lineitem
              WHERE l_returnflag NOT IN ('A', 'N')), 0,
              (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')) = 0""",
)
def data_checks(spark, sf):
    orders, lines = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return Q.checks([
        Q.check("orders", orders, F.count("*"), F.count_distinct("o_orderkey")),
        Q.check("lines without part", lines, F.count_if(F.col("l_partkey").isNull()), 0),
        Q.check("bad flags", lines, F.count_if(~F.col("l_returnflag").isin("A", "N")), 0),
    ])


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem
       GROUP BY 1, 2 HAVING count(*) > 1""",
)
def duplicate_keys(spark, sf):
    return Q.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "complete_rows",
    f"""WITH {SPARSE} SELECT l_orderkey, l_linenumber, l_partkey, f1, f2, f3, f4 FROM sparse
        WHERE f1 IS NOT NULL AND f2 IS NOT NULL""",
)
def complete_rows(spark, sf):
    from cytoframe.sources.writers import complete_rows as complete

    return complete(sparse_lines(spark, sf), ["f1", "f2"])
