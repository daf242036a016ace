"""Token counts and packing against the tokenizer library and by round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cytoframe.llm.common import shared_path
from cytoframe.llm.encoding import encode
from cytoframe.llm.packing import choose_windows, op5_packing, pack
from cytoframe.llm.token_counts import CACHE, cached_counts, op3_token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, digest string, n_tokens int, start string, ids int"
ODD = [
    (1, "Hello there. General remarks! Yes?", "x", 1, "y", 2),
    (1, "Hello there. General remarks! Yes?", "x", 1, "y", 2),
    (2, None, None, None, None, None),
    (3, "", "x", 1, "y", 2),
    (None, "no id here", "x", 1, "y", 2),
    (4, "a <|endoftext|> b 你好 café ’tis", "x", 1, "y", 2),
    (5, "word " * 5000, "x", 1, "y", 2),
    (6, "x" * 20000, "x", 1, "y", 2),
]


def library():
    return Tokenizer.from_file(PATH)


def test_ids_equal_the_library():
    draw = random.Random(3)
    pool = [*map(chr, range(256)), " ", " ", "\n", "a", "e", "'", "İ", " ", " "]
    texts = ["".join(draw.choices(pool, k=draw.randrange(40))) for _ in range(3000)]
    want = [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]
    assert [list(ids) for ids in encode(texts, PATH)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_any_vocabulary(name):
    path = public_tokenizers.path(name)
    texts = [t or "" for _, t, *_ in ODD]
    want = [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(ids) for ids in encode(texts, path)] == want


def test_counts_and_cache(spark):
    docs, cache = spark.createDataFrame(ODD, SCHEMA), shared_path(spark, "cache")
    want = sorted(
        (i or 0, len((t or "").encode()), len(library().encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in ODD
    )

    def got():
        return sorted((i or 0, b, n) for i, b, n in cached_counts(spark, docs, cache, PATH).collect())

    assert got() == want
    stored = spark.read.schema(CACHE).parquet(cache)
    assert stored.count() == 6  # each distinct content once, null as the empty text
    # the stored counts are used, and nothing is encoded again
    assert got() == want
    assert spark.read.schema(CACHE).parquet(cache).count() == 6
    # another version of the tokenizer has counts of its own
    cached_counts(spark, docs, cache, public_tokenizers.path("word_bpe_49k.json"))
    assert spark.read.schema(CACHE).parquet(cache).count() == 12


def test_empty_tables(spark, folder):
    path = folder(documents=spark.createDataFrame([], SCHEMA))
    assert op3_token_counts(spark, path).collect() == []
    assert op5_packing(spark, path).collect() == []


def check_pieces(pieces, docs, limit=1024):
    """Every id lies in exactly one piece; sequences are gapless and keep to the limit."""
    tokens = {i: np.array([*library().encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t, *_ in docs}
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= limit
    covered = {}
    for p in pieces:
        ids = tokens[p.doc_id]
        assert p.doc_tokens == len(ids)
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        covered.setdefault(p.doc_id, []).append((p.start, p.length))
    copies = {}
    for i, *_ in docs:
        copies[i] = copies.get(i, 0) + 1
    for i, ids in tokens.items():
        spans = sorted(covered[i])
        assert sum(n for _, n in spans) == len(ids) * copies[i]
        assert spans[0][0] == 0 and max(a + n for a, n in spans) == len(ids)
    return [sum(p.length for p in parts) for parts in sequences.values()]


def test_packing_round_trip(spark, folder):
    path = folder(documents=spark.createDataFrame(ODD, SCHEMA))
    check_pieces(op5_packing(spark, path).collect(), ODD)


def test_packing_the_supplied_documents(spark):
    path = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    sizes = check_pieces(op5_packing(spark, path).collect(), docs)
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in sizes)
    assert padding < 0.02 * sum(sizes)


def test_order_is_kept(spark):
    docs = spark.createDataFrame([(i, f"Number {i}. " * (1 + i % 7)) for i in range(200)], "doc_id int, text string").coalesce(1)
    rows = pack(docs, PATH, limit=64).orderBy("sequence_id", "offset").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)


def test_windows_are_the_cheapest():
    """The monotone queue gives the cost of the plain quadratic recursion."""
    draw = np.random.default_rng(5)
    for _ in range(60):
        limit, cost = int(draw.choice([8, 10, 16])), 3.0
        points = np.cumsum(draw.integers(1, limit // 2 + 1, 25))
        penalty = draw.choice([0.0, 1.0, 4.0], 25)
        place = [0, *points.tolist()]

        def price(i, j):
            n = place[j] - place[i]
            return (0 if n & (n - 1) == 0 else limit - n) + penalty[j - 1] + cost

        best = [0.0]
        for j in range(1, 26):
            best.append(min(best[i] + price(i, j) for i in range(j) if place[j] - place[i] <= limit))
        ends = [0, *choose_windows(points, penalty, limit, cost).tolist()]
        assert ends[-1] == place[-1]
        assert sum(price(place.index(a), place.index(b)) for a, b in zip(ends, ends[1:])) == pytest.approx(best[-1])
