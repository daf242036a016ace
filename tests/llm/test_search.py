"""Exact and graph search against brute force."""

import numpy as np

from cytoframe.llm.exact_search import OP1_SQL, Tree, exact_top_k, op1_exact_top_k, whole_vectors
from cytoframe.llm.graph_search import build_index, graph_search, op4_graph_search, usable_vectors
from tests.compare import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int"


def brute(vectors, queries, k):
    rows = []
    for q, x in queries.items():
        scores = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors.items() if i != q))[:k]
        rows += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(rows)


def test_exact_search_equals_sql(spark):
    assert compare(op1_exact_top_k(spark, SF), connect(SF), OP1_SQL) is None


def odd_vectors():
    draw = np.random.default_rng(1)
    rows = [(i, draw.normal(size=8).astype("f4").tolist(), "s", 1) for i in range(0, 300)]
    rows += [(i, rows[0][1], "s", 1) for i in range(300, 700)]  # one very common vector
    rows += [rows[5], (1000, None, "s", 1), (1050, [], "s", 1), (1100, [1.0, None], "s", 1), (None, [1.0] * 8, "s", 1)]
    rows += [(1150, [float("nan")] * 8, "s", 1), (1200, [float("inf")] * 8, "s", 1), (1250, [0.0] * 8, "s", 1)]
    return rows


def test_exact_search_over_shards_and_blocks(spark):
    rows = odd_vectors()
    df = whole_vectors(spark.createDataFrame(rows, SCHEMA))
    vectors = {
        i: [int(np.floor(256.0 * float(np.float32(x)))) for x in v]
        for i, v, *_ in rows
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v)
    }
    asked = {i: v for i, v in vectors.items() if i % 50 == 0}
    got = exact_top_k(df, df.where("id % 50 = 0"), 5, shard_rows=100)
    assert sorted(map(tuple, got.collect())) == brute(vectors, asked, 5)


def test_exact_search_of_huge_values(spark):
    """Products beyond the exact doubles are summed in integers."""
    draw = np.random.default_rng(2)
    vectors = {i: draw.integers(-(2**28), 2**28, 6).tolist() for i in range(700)}
    df = spark.createDataFrame(list(vectors.items()), "id bigint, vector array<bigint>")
    asked = {i: vectors[i] for i in range(0, 700, 70)}
    got = exact_top_k(df, df.where("id % 70 = 0"), 3, shard_rows=300)
    assert sorted(map(tuple, got.collect())) == brute(vectors, asked, 3)


def test_leaves_hold_every_row_once():
    points = np.random.default_rng(0).normal(size=(1000, 3))
    leaves = Tree(points, 64).leaves()
    assert sorted(np.concatenate(leaves)) == list(range(1000)) and max(map(len, leaves)) <= 64


def test_few_and_no_rows(spark, folder):
    few = folder(embeddings=spark.createDataFrame([(0, [1.0, 2.0], "s", 1), (100, [3.0], "s", 1)], SCHEMA))
    assert sorted(map(tuple, op1_exact_top_k(spark, few).collect())) == [(0, 1, 100, 256 * 768), (100, 1, 0, 256 * 768)]
    assert sorted(map(tuple, op4_graph_search(spark, few).collect())) == [(0, 1, 100, 3.0), (100, 1, 0, 3.0)]
    none = folder(embeddings=spark.createDataFrame([], SCHEMA))
    assert op1_exact_top_k(spark, none).collect() == []
    assert op4_graph_search(spark, none).collect() == []


def test_graph_search_recall(spark):
    """Over several shards, at least 0.9 of the true neighbours; scores are exact."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    vectors = {r.vec_id: np.array(r.embedding, dtype="f8") for r in rows.collect()}
    df = usable_vectors(rows)
    index, shards = build_index(df, shard_rows=200)
    assert shards == 3
    # every row is indexed
    assert sorted(i for r in index.select("ids").collect() for i in r.ids) == sorted(vectors)
    got = graph_search(index, shards, df.where("id % 20 = 0"), 20).collect()
    ids = np.array(sorted(vectors))
    matrix = np.stack([vectors[i] for i in ids])
    hits = 0
    for q in [i for i in ids if i % 20 == 0]:
        scores = matrix @ vectors[q]
        true = [i for i in ids[np.lexsort((ids, -scores))] if i != q][:20]
        found = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [f[0] for f in found] == list(range(1, 21))
        assert all(abs(s - vectors[q] @ vectors[i]) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(true))
    assert hits >= 0.9 * 20 * len([i for i in ids if i % 20 == 0])


def test_graph_search_of_common_vectors(spark):
    rows = odd_vectors()
    df = usable_vectors(spark.createDataFrame(rows, SCHEMA))
    index, shards = build_index(df, shard_rows=250)
    got = graph_search(index, shards, df.where("id % 20 = 0"), 20).collect()
    taking = {i for i, v, *_ in rows if i is not None and i < 1000}
    assert {r.query_id for r in got} == {i for i in taking if i % 20 == 0}
    # the 400 equal vectors are each other's nearest where no other is nearer: ties go to smaller ids
    same = sorted([0, *range(300, 700)])
    x = np.array(rows[0][1], dtype="f8")
    nearer = [i for i, v, *_ in rows[:300] if i and np.array(v, dtype="f8") @ x > x @ x]
    for q in (0, 400, 680):
        mine = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q]
        assert mine[len(nearer):] == [i for i in same if i != q][: 20 - len(nearer)]


def test_every_row_is_sent_to_one_shard(spark, monkeypatch):
    """However many queries ask, an index row is sent once a pass, and queries skip cells that cannot reach their kth score."""
    from cytoframe.llm import exact_search, graph_search as graphs

    sent = []
    plain = exact_search.stream_past

    def counted(held, asked, *rest):
        sent.append((held.count(), asked.count()))
        return plain(held, asked, *rest)

    monkeypatch.setattr(exact_search, "stream_past", counted)
    monkeypatch.setattr(graphs, "stream_past", counted)
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(16, 6)) * 4
    rows = [(i, (centres[i % 16] + draw.normal(size=6) * 0.2).astype("f4").tolist(), "s", 1) for i in range(2000)]
    df = whole_vectors(spark.createDataFrame(rows, SCHEMA))
    asked = df.where("id % 4 = 0")
    got = exact_top_k(df, asked, 5, shard_rows=125)
    vectors = {r.id: r.vector for r in df.collect()}
    assert sorted(map(tuple, got.collect())) == brute(vectors, {i: v for i, v in vectors.items() if i % 4 == 0}, 5)
    assert [h for h, _ in sent] == [2000, 2000]
    assert sent[1][1] < 500 * 15 / 2
    sent.clear()
    near = usable_vectors(spark.createDataFrame(rows, SCHEMA))
    index, shards = build_index(near, shard_rows=500)
    graph_search(index, shards, near.where("id % 4 = 0"), k=3).count()
    assert [h for h, _ in sent] == [index.count()] and sent[0][1] == 500 * shards
