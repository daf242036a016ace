"""Mixing against a plain solver, the pipeline against plain versions of its stages."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cytoframe.llm.mixing import QUALITY_TARGETS, fit_misses, mixing_rates, op9_mixing
from tests.llm.test_texts import frame, plain_components
from tests.llm.test_tokens_and_packing import library

SF = "/root/testdata/sf0.001"


def plain_rates(p, n, targets, strength, steps=3000):
    """Projected gradient on one rate per document."""
    w, mass = np.ones(len(n)), n @ p
    want = np.where(mass > 0, targets, 0)
    want = want / want.sum() * mass.sum()
    relative = np.where(mass > 0, mass, 1)
    for _ in range(steps):
        miss = np.where(mass > 0, ((w * n) @ p - want) / relative, 0)
        w = np.maximum(0, w - (p @ miss + strength * (w - 1)) / (1 + strength))
    return w, want


def test_steps_reach_the_plain_solution(spark):
    draw = np.random.default_rng(3)
    p = draw.dirichlet([0.3, 0.3, 0.3], 60)
    p[:, 2] = 0
    p /= p.sum(1, keepdims=True)
    n = draw.integers(1, 200, 60).astype(float)
    cells = spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(p, n)], "posteriors array<double>, tokens double")
    targets = np.array([0.8, 0.1, 0.1])
    misses, step = fit_misses(cells, targets.tolist(), 0.001, steps=300, close=0.0)
    w = np.ones(60)
    for miss in misses:
        w = np.maximum(0, w - step * (p @ miss + 0.001 * (w - 1)))
    want_w, want = plain_rates(p, n, targets, 0.001)
    assert np.allclose(w, want_w, atol=0.02) and w.min() >= 0
    assert np.allclose((w * n) @ p, want, rtol=0.03)


def test_expected_totals_meet_the_targets(spark):
    rows = op9_mixing(spark, SF).toPandas()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    total = rows.n_tokens.sum()
    high = (rows.rate * rows.n_tokens * rows.p_high).sum() / total
    low = (rows.rate * rows.n_tokens * rows.p_low).sum() / total
    assert high == pytest.approx(QUALITY_TARGETS[1], abs=0.02) and low == pytest.approx(QUALITY_TARGETS[0], abs=0.02)
    assert np.allclose(rows.p_high + rows.p_low, 1) and (rows.rate >= 0).all()
    assert ((rows.copies - rows.rate).abs() < 1).all()
    assert rows.copies.sum() == pytest.approx(rows.rate.sum(), rel=0.1)


def test_posteriors_follow_the_labels(spark):
    """The table tells held-out documents of the supplied labels apart better than their share does."""
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    rows = mixing_rates(docs, fit, QUALITY_TARGETS).select(F.col("row.doc_id").alias("doc_id"), F.col("posteriors")[1].alias("p"))
    both = rows.join(held, "doc_id").toPandas()
    order = both.p.rank()
    ones = both.quality == 1
    area = (order[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert area > 0.75


def test_mixing_by_hand(spark, folder):
    rows = [(1, "good words here. And more of them."), (2, "### $$$ %%% ###"), (3, None), (None, ""), (2, "### $$$ %%% ###"),
            (4, "x" * 100_000), (5, "word " * 20_000)]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (None, 1), (77, 1), (1, 9)], "doc_id bigint, quality int")
    got = mixing_rates(docs, labels, QUALITY_TARGETS).collect()
    assert Counter(r.row.doc_id for r in got) == Counter(i for i, _ in rows)
    assert got[0].row.asDict().keys() == set(docs.columns)
    assert {r.row.doc_id: r.n_tokens for r in got} == {1: 7, 2: 4, 3: 0, None: 0, 4: 1, 5: 20_000}
    even = mixing_rates(docs, labels.limit(0), QUALITY_TARGETS).collect()
    assert all(r.posteriors == [0.5, 0.5] for r in even)
    empty = folder(documents=frame(spark, []).withColumn("source", F.lit("s")), labels=labels)
    assert op9_mixing(spark, empty).collect() == []


def test_mixing_runs_without_python(spark):
    plan = op9_mixing(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- the pipeline ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's input and output on the supplied documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        found.append((name, docs, spark.createDataFrame(rows, out.schema)))
        docs = found[-1][2]
    return found


def test_stages_return_documents(stages):
    columns = stages[0][1].columns
    assert [name for name, *_ in stages] == ["toxicity", "near-dedup", "substring-dedup", "mixing", "packing"]
    for _, _, out in stages[:-1]:
        assert out.columns == columns


def test_rejected_documents_are_the_toxic_ones(spark):
    """Also among the labels that were not learned."""
    path = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    out = corpus_pipeline.drop_toxic(spark, docs, path).select("doc_id")
    held = labels.where("crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1")
    left = held.join(out, "doc_id").groupBy("toxic").count().collect()
    left, given = ({r["toxic"]: r["count"] for r in rows} for rows in (left, held.groupBy("toxic").count().collect()))
    assert left.get(1, 0) <= 0.1 * given[1] and left[0] >= 0.99 * given[0]


def test_one_of_each_group_stays(stages):
    _, docs, out = stages[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i for i, (_, component) in plain_components(rows, 5).items() if i == component}
    assert {r.doc_id for r in out.collect()} == want


def test_no_line_is_left_twice(stages):
    _, docs, out = stages[2]
    lines = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        lines.update(" ".join(line.lower().split()) for line in r.text.split("\n"))
    assert all(n == 1 for line, n in lines.items() if len(line.split()) >= 5)
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_copies_and_pieces(stages):
    _, docs, out = stages[3]
    texts = {r.doc_id: r.text for r in docs.collect()}
    copies = Counter()
    for r in out.collect():
        assert r.text == texts[r.doc_id]
        copies[r.doc_id] += 1
    tokens = {i: np.array([*library().encode(texts[i], add_special_tokens=False).ids, 0], "<u4") for i in copies}
    lengths = Counter()
    for p in stages[4][2].collect():
        lengths[p.doc_id] += p.length
        assert p.ids_crc32 == zlib.crc32(tokens[p.doc_id][p.start : p.start + p.length].tobytes())
    assert lengths == Counter({i: len(tokens[i]) * n for i, n in copies.items()})


def test_run_gives_the_last_stages_rows(spark, stages):
    pieces = corpus_pipeline.run(spark, SF).groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = stages[4][2].groupBy("doc_id").agg(F.sum("length").alias("n"))
    assert sorted(map(tuple, pieces.collect())) == sorted(map(tuple, want.collect()))


def test_odd_documents_pass_through(spark, folder):
    rows = [(1, None), (2, ""), (None, "text without an id here"), (3, "x" * 30_000), (4, "one two three four five six. " * 40),
            (4, "one two three four five six. " * 40), (5, "one two three four five six. " * 40 + "seven")]
    labels = spark.createDataFrame([(1, 0, 1), (4, 0, 0)], "doc_id bigint, toxic int, quality int")
    path = folder(documents=frame(spark, rows), labels=labels)
    got = {r.doc_id for r in corpus_pipeline.run(spark, path).collect()}
    assert 5 not in got
    empty = folder(documents=frame(spark, []), labels=labels)
    assert corpus_pipeline.run(spark, empty).collect() == []
