"""Bootstrap, splits, samples, neighbours, classifiers and sparse counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import query
from catalog.measures import DOCS, labelled_documents, rounded
from catalog.tables import table
from cytoframe.operators import joins as J
from cytoframe.operators import models as MD
from cytoframe.operators import neighbours as NB
from cytoframe.operators import resample as R
from cytoframe.operators import stats as ST
from cytoframe.plans import classify as CL
from cytoframe.sources import readers as SR

HASH = "CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def md5(*parts: str) -> str:
    return HASH.format(text=" || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts))


# ---------------------------------------------------------------- bootstrap

def draws(table_sql: str, key: str, value: str, order: str, replicates: int, seed: int) -> str:
    """SQL of the drawn rows: (key, replicate, value), one row per draw."""
    return f"""base AS ({table_sql}),
      i AS (SELECT {key}, {value}, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - 1 AS i,
                   count(*) OVER (PARTITION BY {key}) AS n FROM base),
      t AS (SELECT {key}, r AS replicate, {md5(str(seed), key, 'r', 'i')} % n AS i
            FROM i, (SELECT unnest(range({replicates})) AS r)),
      drawn AS (SELECT t.{key}, t.replicate, {', '.join('i.' + v for v in value.split(', '))}
                FROM t JOIN i ON t.{key} = i.{key} AND t.i = i.i)"""


EVENTS = draws("SELECT event_type, value, user_id, event_id FROM events", "event_type",
               "value, user_id", "event_id", 10, 3)


@query(
    "bootstrap_median",
    f"WITH {EVENTS} SELECT event_type, CAST(replicate AS INTEGER) AS replicate,"
    " round(median(value), 6) AS stat FROM drawn GROUP BY 1, 2",
)
def bootstrap_median(spark, sf):
    out = R.bootstrap(table(spark, sf, "events"), ["event_type"], "value", "event_id", "median", 10, 3)
    return rounded(out, ["stat"])


@query(
    "bootstrap_mean",
    f"""WITH {EVENTS}, m AS (SELECT event_type, replicate, avg(value) AS m, stddev_pop(value) AS s
          FROM drawn GROUP BY 1, 2)
        SELECT event_type, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_low,
          round(quantile_cont(m, 0.975), 6) AS ci_high FROM m GROUP BY 1""",
)
def bootstrap_mean(spark, sf):
    boot = R.bootstrap(table(spark, sf, "events"), ["event_type"], "value", "event_id", "mean", 10, 3)
    out = ST.mean_interval(boot, ["event_type"], "stat")
    return rounded(out, ["mean", "ci_low", "ci_high"])


# the largest less the smallest value, as a user would give it in parts
SPAN = R.Mergeable(
    start=lambda: (float("inf"), float("-inf")),
    add=lambda state, values, times: (min(state[0], values.min()), max(state[1], values.max())),
    merge=lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
    finish=lambda state: state[1] - state[0],
)


@query(
    "bootstrap_custom",
    f"WITH {EVENTS} SELECT event_type, CAST(replicate AS INTEGER) AS replicate,"
    " round(max(value) - min(value), 6) AS stat FROM drawn GROUP BY 1, 2",
)
def bootstrap_custom(spark, sf):
    out = R.bootstrap(
        table(spark, sf, "events"), ["event_type"], "value", "event_id",
        SPAN, 10, 3,
    )
    return rounded(out, ["stat"])


@query(
    "spearman_ci",
    f"""WITH {EVENTS},
      r AS (SELECT event_type, replicate,
          rank() OVER (PARTITION BY event_type, replicate ORDER BY value)
            + (count(*) OVER (PARTITION BY event_type, replicate, value) - 1) / 2.0 AS rx,
          rank() OVER (PARTITION BY event_type, replicate ORDER BY user_id)
            + (count(*) OVER (PARTITION BY event_type, replicate, user_id) - 1) / 2.0 AS ry FROM drawn),
      c AS (SELECT event_type, replicate, corr(rx, ry) AS rho FROM r GROUP BY 1, 2)
      SELECT event_type, round(avg(rho), 6) AS mean, round(quantile_cont(rho, 0.025), 6) AS ci_low,
             round(quantile_cont(rho, 0.975), 6) AS ci_high FROM c GROUP BY 1""",
)
def spearman_ci(spark, sf):
    out = R.bootstrap_spearman(
        table(spark, sf, "events"), "event_type", "value", "user_id", "event_id", 10, 3
    )
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "boot_ridge",
    f"""WITH {DOCS},
      i AS (SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM d),
      t AS (SELECT r AS replicate, {md5('5', 'r', 'i')} % n AS i FROM i, (SELECT unnest(range(20)) AS r)),
      q AS (SELECT t.replicate, i.x1, i.x2, i.quality FROM t JOIN i ON t.i = i.i),
      sd AS (SELECT replicate, coalesce(nullif(stddev_pop(x1), 0), 1) AS s1,
               coalesce(nullif(stddev_pop(x2), 0), 1) AS s2 FROM q GROUP BY 1),
      w AS (SELECT q.replicate, x1 / s1 AS x1, x2 / s2 AS x2, quality,
              CAST(count(*) OVER (PARTITION BY q.replicate) AS DOUBLE)
                / count(*) OVER (PARTITION BY q.replicate, quality) AS w FROM q JOIN sd ON q.replicate = sd.replicate),
      m AS (SELECT replicate, sum(w * x1) / sum(w) AS m1, sum(w * x2) / sum(w) AS m2,
              sum(w * quality) / sum(w) AS my FROM w GROUP BY 1),
      c AS (SELECT w.replicate, sum(w * (x1 - m1) * (x1 - m1)) + 0.001 AS a, sum(w * (x1 - m1) * (x2 - m2)) AS b,
              sum(w * (x2 - m2) * (x2 - m2)) + 0.001 AS c, sum(w * (x1 - m1) * (quality - my)) AS u,
              sum(w * (x2 - m2) * (quality - my)) AS v FROM w JOIN m ON w.replicate = m.replicate GROUP BY 1),
      s AS (SELECT 'x1' AS feature, (c * u - b * v) / (a * c - b * b) AS k FROM c
            UNION ALL SELECT 'x2', (a * v - b * u) / (a * c - b * b) FROM c)
      SELECT feature, round(avg(k), 6) AS mean, round(quantile_cont(k, 0.025), 6) AS ci_low,
             round(quantile_cont(k, 0.975), 6) AS ci_high FROM s GROUP BY 1""",
)
def boot_ridge(spark, sf):
    boot = MD.bootstrap_ridge(labelled_documents(spark, sf), ["x1", "x2"], "quality", "doc_id", 20, 5)
    return rounded(ST.mean_interval(boot, ["feature"], "coef"), ["mean", "ci_low", "ci_high"])


# ---------------------------------------------------------------- splits and samples

@query(
    "stratified_split",
    f"""WITH h AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label
            ORDER BY {md5('1', 'vec_id')}, vec_id) AS r,
            round_even(count(*) OVER (PARTITION BY label) * 0.25, 0) AS k FROM embeddings)
        SELECT vec_id, label, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM h""",
)
def stratified_split(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "label")
    return R.stratified_split(vectors, "label", "vec_id", 0.25, 1)


@query(
    "patch_split",
    f"""SELECT vec_id, CASE WHEN {md5('2', 'vec_id')} / 4503599627370496.0 < 0.2 THEN 'test'
          ELSE 'train' END AS split FROM embeddings""",
)
def patch_split(spark, sf):
    return R.random_split(table(spark, sf, "embeddings").select("vec_id"), "vec_id", 0.2, 2)


@query(
    "sample_rows",
    f"SELECT doc_id, source, n_chars FROM documents ORDER BY {md5('0', 'doc_id')}, doc_id LIMIT 2",
)
def sample_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return R.sample_rows(docs, "doc_id", 2)


@query(
    "sample_by_key",
    f"""WITH k AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM events)
                   ORDER BY {md5('4', 'user_id')}, user_id LIMIT 2)
        SELECT event_id, user_id, event_type FROM events WHERE user_id IN (SELECT user_id FROM k)""",
)
def sample_by_key(spark, sf):
    from cytoframe.sources.writers import extract_by_key

    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return extract_by_key(events, [events], "user_id", 2, 4)[0]


# ---------------------------------------------------------------- classifiers

def vectors(spark, sf, n: int = 64):
    return table(spark, sf, "embeddings").select(
        "vec_id", "label",
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"f{i}") for i in range(n)],
    )


@query(
    "knn_manhattan",
    f"""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e, row_number() OVER (
            PARTITION BY label ORDER BY {md5('1', 'vec_id')}, vec_id) AS r,
            round_even(count(*) OVER (PARTITION BY label) * 0.25, 0) AS k FROM embeddings),
          d AS (SELECT q.vec_id, t.vec_id AS neighbour, t.label,
                  list_sum(list_transform(list_zip(q.e, t.e), lambda p: abs(p[1] - p[2]))) AS dist
                FROM s q, s t WHERE q.r <= q.k AND t.r > t.k),
          n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, neighbour) AS rk FROM d)
        SELECT vec_id, neighbour, CAST(rk AS INTEGER) AS rank, round(dist, 6) AS distance, label
        FROM n WHERE rk <= 5""",
)
def knn_manhattan(spark, sf):
    parts = R.stratified_split(vectors(spark, sf), "label", "vec_id", 0.25, 1)
    near = NB.nearest_rows(
        parts.where("split = 'train'"), parts.where("split = 'test'"),
        [f"f{i}" for i in range(64)], "vec_id", 5, "label", block=200,
    )
    return rounded(near, ["distance"])


@query(
    "knn_predict",
    f"""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[64] AS e, row_number() OVER (
            PARTITION BY label ORDER BY {md5('1', 'vec_id')}, vec_id) AS r,
            round_even(count(*) OVER (PARTITION BY label) * 0.25, 0) AS k FROM embeddings),
          d AS (SELECT q.vec_id, q.label AS t, t.vec_id AS nb, t.label,
                  list_sum(list_transform(list_zip(q.e, t.e), lambda p: abs(p[1] - p[2]))) AS dist
                FROM s q, s t WHERE q.r <= q.k AND t.r > t.k),
          n AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nb) AS rk FROM d),
          v AS (SELECT vec_id, t, label, count(*) AS c FROM n WHERE rk <= 9 GROUP BY 1, 2, 3),
          p AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC, label) AS o FROM v)
        SELECT vec_id, t AS "true", label AS pred FROM p WHERE o = 1""",
)
def knn_predict(spark, sf):
    parts = R.stratified_split(vectors(spark, sf), "label", "vec_id", 0.25, 1)
    out = NB.knn_predict(
        parts.where("split = 'train'"), parts.where("split = 'test'"),
        [f"f{i}" for i in range(64)], "label", "vec_id", 9,
    )
    return out.select("vec_id", F.col("label").alias("true"), F.col("__pred__").alias("pred"))


# channels of the 64 stand-in features: 16 each
CHANNELS = {
    f"f{i}": ["segmentation", "FISH", "structure", "DNA"][i // 16] for i in range(64)
}


def label_thirds(spark, sf):
    """Training and test rows of the classifier queries: three classes, split within each."""
    df = vectors(spark, sf).withColumn("second", F.col("label") % 9)
    return df.withColumn("label", F.col("label") % 3).withColumn("second", F.col("second") % 3)


THIRDS = f"""s AS (SELECT vec_id, label % 3 AS label, embedding::DOUBLE[64] AS e, row_number() OVER (
            PARTITION BY label % 3 ORDER BY {md5('1', 'vec_id')}, vec_id) AS r,
            round_even(count(*) OVER (PARTITION BY label % 3) * 0.25, 0) AS k FROM embeddings),
          p AS (SELECT *, CASE WHEN r <= k THEN 'test' ELSE 'train' END AS split FROM s)"""


@query(
    "clf_dummies",
    f"""WITH {THIRDS}, c AS (SELECT label, count(*) AS c, min({md5('1', 'vec_id')}) AS h FROM p WHERE split = 'train' GROUP BY label),
          most AS (SELECT label FROM c ORDER BY c DESC, label LIMIT 1),
          t AS (SELECT label, row_number() OVER (ORDER BY {md5('1', 'vec_id')}) - 1 AS nth, count(*) OVER () AS n
                FROM p WHERE split = 'train'),
          u AS (SELECT label, row_number() OVER (ORDER BY h) - 1 AS nth, count(*) OVER () AS n FROM c),
          coins AS (SELECT *, {md5('0', 'vec_id')} / 4503599627370496.0 AS coin FROM p),
          made AS (
            SELECT split, vec_id, label, unnest(['Dummy most_frequent', 'Dummy prior']) AS classifier,
              (SELECT label FROM most) AS pred FROM p
            UNION ALL SELECT split, vec_id, x.label, 'Dummy stratified', t.label FROM coins x JOIN t ON t.nth = floor(coin * n)
            UNION ALL SELECT split, vec_id, x.label, 'Dummy uniform', u.label FROM coins x JOIN u ON u.nth = floor(coin * n))
        SELECT split, vec_id, classifier, CAST(label AS INTEGER) AS "true", CAST(pred AS INTEGER) AS pred FROM made""",
)
def clf_dummies(spark, sf):
    splits = CL.prepared_splits(label_thirds(spark, sf), list(CHANNELS), "label", "vec_id", seed=1)
    grid = [c for c in MD.classifier_grid() if c["kind"] == "dummy"]
    made = CL.predictions(splits, {"all": list(CHANNELS)}, "label", "vec_id", grid)
    return made.select("split", "vec_id", "classifier", "true", "pred")


# the features of each set by their places, as the SQL takes them
SET_PLACES = {
    name: [i + 1 for i in range(64) if CHANNELS[f"f{i}"] in wanted] for name, wanted in MD.FEATURE_SETS.items()
}


@query(
    "clf_neighbours",
    f"""WITH {THIRDS},
          long AS (SELECT vec_id, label, split, i, e[i] AS v FROM p, (SELECT unnest(range(1, 65)) AS i)),
          m AS (SELECT i, avg(v) AS mean, stddev_pop(v) AS sd FROM long WHERE split = 'train' GROUP BY i),
          z AS (SELECT vec_id, label, split, list((v - mean) / sd ORDER BY i) AS e
                FROM long JOIN m USING (i) GROUP BY ALL),
          sets AS (SELECT unnest({list(SET_PLACES)}) AS features, unnest({list(SET_PLACES.values())}) AS places),
          x AS (SELECT vec_id, label, split, features, list_transform(places, lambda i: e[i]) AS e FROM z, sets),
          d AS (SELECT q.vec_id, q.label AS t, q.split, q.features, t.vec_id AS nb, t.label,
                  list_sum(list_transform(list_zip(q.e, t.e), lambda p: abs(p[1] - p[2]))) AS dist
                FROM x q JOIN x t ON q.features = t.features AND t.split = 'train'),
          n AS (SELECT *, row_number() OVER (PARTITION BY vec_id, features ORDER BY dist, nb) AS rk FROM d),
          v AS (SELECT vec_id, t, split, features, k, label, count(*) AS c
                FROM n, (SELECT unnest([1, 2, 3, 5, 9]) AS k) WHERE rk <= k GROUP BY ALL),
          o AS (SELECT *, row_number() OVER (PARTITION BY vec_id, features, k ORDER BY c DESC, label) AS o FROM v)
        SELECT split, features, 'KNN k=' || k AS classifier, vec_id, CAST(t AS INTEGER) AS "true",
          CAST(label AS INTEGER) AS pred FROM o WHERE o = 1""",
)
def clf_neighbours(spark, sf):
    splits = CL.prepared_splits(label_thirds(spark, sf), list(CHANNELS), "label", "vec_id", seed=1)
    grid = [c for c in MD.classifier_grid() if c["kind"] == "knn"]
    made = CL.predictions(splits, MD.feature_sets(CHANNELS), "label", "vec_id", grid)
    return made.select("split", "features", "classifier", "vec_id", "true", "pred")


@query("clf_grid")
def clf_grid(spark, sf):
    splits = CL.prepared_splits(label_thirds(spark, sf), list(CHANNELS), "label", "vec_id", seed=1)
    predicted = CL.predictions(
        splits, MD.feature_sets(CHANNELS), "label", "vec_id", MD.classifier_grid(),
        annotator=("Second", "second"),
    )
    return CL.report(predicted)


# ---------------------------------------------------------------- sparse counts

COO = """coo AS (SELECT 'G' || (i - 1) AS gene, 'C' || vec_id AS cell,
         CAST(floor(abs(CAST(embedding[i] AS DOUBLE)) * 50) AS BIGINT) AS count
       FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
       WHERE floor(abs(CAST(embedding[i] AS DOUBLE)) * 50) > 0)"""


def coo(spark, sf):
    cells = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("col"), F.posexplode(F.col("embedding").cast("array<double>")).alias("row", "v")
    )
    counts = cells.select(
        F.col("row").cast("long").alias("row"), "col",
        F.floor(F.abs("v") * 50).cast("long").alias("count"),
    ).where("count > 0")
    genes = counts.select("row").distinct().withColumn(
        "gene", F.concat(F.lit("G"), F.col("row").cast("string"))
    )
    names = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("col"), F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("cell")
    )
    return SR.named_counts(counts, genes, names)


@query("coo_normal", f"WITH {COO} SELECT gene, cell, count FROM coo")
def coo_normal(spark, sf):
    return coo(spark, sf)


@query(
    "matrix_sample",
    f"""WITH {COO}, k AS (SELECT cell FROM (SELECT DISTINCT cell FROM coo)
            ORDER BY {md5('0', 'cell')}, cell LIMIT 10)
        SELECT gene, cell, count FROM coo WHERE cell IN (SELECT cell FROM k)""",
)
def matrix_sample(spark, sf):
    return SR.sample_cells(coo(spark, sf), 10)


@query(
    "expression_subset",
    f"""WITH {COO}, m AS (SELECT 'C' || vec_id AS cell, 'D' || (12 * (1 + label % 3)) AS day,
            CASE WHEN label > 4 THEN 'p2' ELSE 'p1' END AS protocol FROM embeddings)
        SELECT m.cell, substr(m.day, 2) AS "Cell age", protocol AS "Protocol",
          CAST(coalesce(sum(count) FILTER (gene = 'G0'), 0) AS BIGINT) AS "G0 expression",
          CAST(coalesce(sum(count) FILTER (gene = 'G7'), 0) AS BIGINT) AS "G7 expression"
        FROM m LEFT JOIN coo ON m.cell = coo.cell WHERE day IN ('D12', 'D24') GROUP BY 1, 2, 3""",
)
def expression_subset(spark, sf):
    cells = table(spark, sf, "embeddings").select(
        F.concat(F.lit("C"), F.col("vec_id").cast("string")).alias("cell"),
        F.concat(F.lit("D"), (12 * (1 + F.col("label") % 3)).cast("string")).alias("day"),
        F.when(F.col("label") > 4, "p2").otherwise("p1").alias("protocol"),
    )
    return SR.expression_subset(
        coo(spark, sf), cells, {"G0": "G0 expression", "G7": "G7 expression"},
        {"D12": "12", "D24": "24"},
    )
