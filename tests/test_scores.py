"""The organisation scores against a plain weighted ridge."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalog import jobs
from cytoframe.plans import plot_tables as PT

SF = "/root/testdata/sf0.001"


def plain_scores(train, rows, features, y, alpha=0.001):
    """Standardise by the training rows, balance the classes, solve, predict every row."""
    mean = {f: train[f].mean() for f in features}
    sd = {f: train[f].std(ddof=0) or 1.0 for f in features}
    fit = train.dropna(subset=[*features, y])
    x = np.stack([(fit[f] - mean[f]) / sd[f] for f in features], 1)
    target = fit[y].to_numpy(dtype=float)
    weight = len(fit) / fit.groupby(y)[y].transform("size").to_numpy()
    centre, level = np.average(x, axis=0, weights=weight), np.average(target, weights=weight)
    a = (x - centre).T @ ((x - centre) * weight[:, None]) + alpha * np.eye(len(features))
    slopes = np.linalg.solve(a, (x - centre).T @ (weight * (target - level)))
    every = np.stack([(rows[f] - mean[f]) / sd[f] for f in features], 1)
    return level + (every - centre) @ slopes


def test_score_of_the_plot_tables(spark):
    _, wide, _, model = jobs.analysis(spark, SF)
    rows = wide.toPandas()
    features = list(PT.SCORE_FEATURES)
    assert list(model.features) == features
    want = plain_scores(rows, rows, features, "structure_org_score")
    got = rows["structure_org_weighted_linear_model_all"].to_numpy(dtype=float)
    assert np.array_equal(np.isnan(got), np.isnan(want)) and (~np.isnan(want)).sum() > 100
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6, equal_nan=True)


def revised_rows(spark, monkeypatch):
    """The whole table behind the query, which shows some of its columns only."""
    made = {}
    plain = PT.revised_table

    def kept(*args, **kwargs):
        made["table"] = plain(*args, **kwargs)
        return made["table"]

    monkeypatch.setattr(PT, "revised_table", kept)
    jobs.revised_table(spark, SF)
    return made["table"]


def test_combined_score(spark, monkeypatch):
    table = revised_rows(spark, monkeypatch)
    features = [PT.REVISED_NAMES.get(f, f) for f in PT.REVISED_FEATURES]
    y = f"{PT.EXPERT} (mean)"
    scored = [c for c in table.columns if c in ("kg_structure_org_score", "mh_structure_org_score")]
    assert len(scored) == 2
    rows = table.select("Dataset", *[F.col(f"`{c}`") for c in (*features, y, *scored)], "Combined organizational score").toPandas()
    train = rows[(rows["Dataset"] == "OldFish") & (rows[scored[0]] > 0) & (rows[scored[1]] > 0)]
    want = plain_scores(train, rows, features, y)
    got = rows["Combined organizational score"].to_numpy(dtype=float)
    assert np.allclose(got, want, rtol=1e-6, atol=1e-6, equal_nan=True) and (~np.isnan(want)).sum() > 100


def test_published_names_follow_the_genes():
    names = PT.pretty_names(["ACTN2", "MYH6"])
    assert names["ACTN2_count"] == "ACTN2 count" and names["MYH6_count_per_micrometer_squared"] == "MYH6 (count/μm^2)"
    assert names["cell_age"] == "Cell age" and "TCAP_count" not in names


def test_jobs_stop_at_bad_input(spark):
    from cytoframe.operators.quality import known_value

    df = spark.createDataFrame([("n",), (None,), ("bad",)], "m string")
    value = known_value("m", ["n"], F.upper("m")).alias("v")
    assert [r.v for r in df.where("m IS NULL OR m <> 'bad'").select(value).collect()] == ["N", None]
    with pytest.raises(Exception, match="unknown m: bad"):
        df.select(value).collect()
