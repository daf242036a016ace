"""Prefix tries, reply trees and structure repair against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cytoframe.llm import structure_repair
from cytoframe.llm.prefix_trie import OP11_SQL, DoubleArray, op11_prefix_trie, rebuilt, trie_nodes, turn_sequences
from cytoframe.llm.reply_trees import OP12_SQL, escaped, format_paths, op12_chat_formatting, read_back, reply_paths, unescaped
from cytoframe.llm.structure_repair import FORWARD, INSERTS, OP13_SQL, _Repair, apply_edits, least_edits, op13_structure_repair
from tests.compare import compare

SCHEMA = "conv_id long, turn long, role string, text string"


def connect(path):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    return con


def agreed(rows):
    return None if rows else "no rows on either side"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def awkward(seed, conversations=24):
    """Few roles and texts, so turns repeat; nulls, ties, repeated rows, empty and long texts."""
    pick = random.Random(seed)
    texts = ["a.", "b!", "cut", "", "  \n", None, "é? x", "end. ", "</s>[INST] \\<s> ok\\", "long " * 3000 + "."]
    rows = []
    for conv in [*range(conversations), -3, 1001, None]:
        for turn in range(pick.choice([1, 2, 3, 5, 9, 14])):
            row = (conv, pick.choice([turn, turn, turn, None, 2]), pick.choice(["user", "assistant", "system", None, "", "tool"]), pick.choice(texts))
            rows += [row] * pick.choice([1, 1, 1, 2])
    return rows


@pytest.fixture(scope="module")
def table_of(spark, folder):
    def make(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        return folder(conversations=df.withColumn("digest", F.lit(1)).withColumn("node", F.lit("x")).withColumn("depth", F.lit(2.5)))

    return make


# --- prefix tries -----------------------------------------------------------------------------


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    own = {c: [r[1:] for r in in_order(v)] for c, v in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = own.get(base, [])[:h] + turns[h:]
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    leaf = {p for p in nodes if not any(q[:-1] == p for q in nodes if q)}
    out = set()
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(q[-1][1].encode()) for q in under if q)
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(p))
        out.add((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members),
                 sum(bool(q) and q[:-1] == p for q in nodes), sum(q in leaf for q in under), saved, sha(ends)))
    return out


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("shard_turns", [3, 200_000])
def test_trie_is_that_of_a_plain_one(spark, seed, shard_turns):
    rows = awkward(seed)
    rows += [(conv, t, "user", f"shared {t}") for conv in range(40, 70) for t in range(conv % 7 + 6)]
    nodes = trie_nodes(rebuilt(turn_sequences(spark.createDataFrame(rows, SCHEMA))), shard_turns)
    nodes = nodes.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))
    found = [tuple(r) for r in nodes.withColumnRenamed("saved", "saved_tokens").select(*TRIE).collect()]
    assert len(found) == len(set(found))
    assert set(found) == plain_trie(rows)


def test_trie_query_equals_its_sql_and_takes_awkward_tables(spark, table_of):
    for rows in (awkward(3), []):
        path = table_of(rows)
        assert compare(op11_prefix_trie(spark, path), connect(path), OP11_SQL) == agreed(rows)
        assert {tuple(r) for r in op11_prefix_trie(spark, path).select(*TRIE).collect()} == plain_trie(rows)


def test_double_array_holds_exactly_its_sequences():
    draw = np.random.default_rng(5)
    sequences = [draw.integers(0, 40, size=n).tolist() for n in draw.integers(0, 12, size=300)]
    sequences += [[7, 7, x] for x in range(40)] + [[]]
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])
    trie = DoubleArray(np.array([t for s in sequences for t in s]), starts)
    prefixes = {tuple(s[:d]) for s in sequences for d in range(len(s) + 1)}
    assert sum(map(len, trie.levels)) == len(prefixes) == len(set(np.concatenate(trie.levels).tolist()))
    slot = {(): 0}
    for p in sorted(prefixes - {()}, key=len):
        slot[p] = int(trie.base[slot[p[:-1]]] + p[-1])
        assert trie.check[slot[p]] == slot[p[:-1]]
    assert len(set(slot.values())) == len(slot)
    assert (trie.check >= 0).sum() == len(prefixes) - 1


# --- reply trees ------------------------------------------------------------------------------


def tree(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id long, node string, parent string, score double, role string, text string, repeats long"
    )


def test_paths_are_ranked_and_loops_have_none(spark):
    rows = [(1, "r", None, 1.0, "user", "q", 1), (1, "a", "r", 5.0, "assistant", "good", 1), (1, "b", "r", 2.0, "assistant", "bad", 2),
            (1, "c", "b", None, "user", None, 1), (2, "x", "gone", 0.0, None, "alone", 1),
            (3, "p", "q", 0.0, "user", "loop", 1), (3, "q", "p", 0.0, "user", "loop", 1), (3, "s", "q", 0.0, "user", "off it", 1)]
    paths = {}
    for r in reply_paths(tree(spark, rows)).collect():
        paths.setdefault((r.conv_id, r.rank, r.leaf), {})[r.rise] = r.node
    assert paths == {(1, 1, "a"): {0: "a", 1: "r"}, (1, 2, "c"): {0: "c", 1: "b", 2: "r"}, (2, 1, "x"): {0: "x"}}
    best = read_back(format_paths(tree(spark, rows), keep=1)).collect()
    assert {r.conv_id: r.learned for r in best} == {1: ["good"], 2: []}
    said = {r.leaf: [tuple(t) for t in r.said] for r in read_back(format_paths(tree(spark, rows))).collect()}
    assert said["c"] == [("user", "q"), ("assistant", "bad"), ("assistant", "bad"), ("user", "")]


def test_deep_random_trees_give_every_path(spark):
    pick = random.Random(4)
    rows, up = [], {}
    for i in range(400):
        up[i] = pick.choice([i - 1, i - 1, i - 1, pick.randrange(i)]) if i else None
        rows.append((1, f"{i:04d}", f"{up[i]:04d}" if i else None, float(i % 7), "user", str(i), 1))
    found = {}
    for r in reply_paths(tree(spark, rows)).collect():
        found.setdefault(r.leaf, {})[r.rise] = int(r.node)
    leaves = set(up) - set(up.values())
    assert {int(x) for x in found} == leaves
    for leaf, path in found.items():
        node, rise = int(leaf), 0
        while node is not None:
            assert path[rise] == node
            node, rise = up[node], rise + 1
        assert len(path) == rise


def test_escapes_leave_no_control_string(spark):
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", "\n", "é", "$1"]
    pick = random.Random(1)
    texts = ["".join(pick.choices(parts, k=pick.randrange(9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("e", escaped(F.col("text")))
    for r in df.withColumn("back", unescaped(F.col("e"))).collect():
        assert r.back == r.text
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def plain_formatting(rows):
    rows = [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, role or "", text or ""))
    out = set()
    for conv, turns in convs.items():
        turns = in_order(turns)
        learned = "".join(t for _, r, t in turns if r == "assistant")
        out.add((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), sha(learned)))
    return out


def test_formatting_reads_back_awkward_conversations(spark, table_of):
    for rows in (awkward(6), []):
        path = table_of(rows)
        result = op12_chat_formatting(spark, path)
        assert {tuple(r)[:5] for r in result.collect()} == plain_formatting(rows)
        assert compare(result, connect(path), OP12_SQL) is None  # the added conversation is always there


def test_formatting_runs_without_python_workers(spark, table_of):
    plan = op12_chat_formatting(spark, table_of(awkward(7)))._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))


# --- structure repair -------------------------------------------------------------------------


def all_least(codes, entry, exits):
    """All audits of least cost, by going through every cell of the lattice."""
    cells = {entry: (0, {""})}

    def better(cells, state, cost, audits):
        old = cells.get(state)
        if old is None or cost < old[0]:
            cells[state] = (cost, set(audits))
        elif cost == old[0]:
            old[1].update(audits)

    def with_inserts(cells):
        for _ in range(4):
            for state, (cost, audits) in list(cells.items()):
                for step, letter, to in INSERTS[state]:
                    better(cells, to, cost + step, {a + letter for a in audits})
        return cells

    cells = with_inserts(cells)
    for code in codes:
        after = {}
        for state, (cost, audits) in cells.items():
            for step, letter, to in FORWARD[code][state]:
                better(after, to, cost + step, {a + letter for a in audits})
        cells = with_inserts(after)
    ends = {}
    for state in exits:
        if state in cells:
            better(ends, 0, *cells[state])
    return ends.get(0)


def test_search_finds_the_least_of_all_audits():
    pick = random.Random(8)
    for _ in range(1500):
        codes = bytes(pick.randrange(12) for _ in range(pick.randrange(8)))
        entry, exits = pick.randrange(4), tuple(sorted(pick.sample(range(4), pick.randrange(1, 4))))
        found, plain = least_edits(codes, entry, exits), all_least(codes, entry, exits)
        assert (found is None) == (plain is None)
        if found:
            assert found == (plain[0], min(plain[1])), (codes, entry, exits)


def test_blocks_of_any_length_give_the_same_repair(monkeypatch):
    pick = random.Random(9)
    for n in (0, 1, 5, 23, 60):
        codes = [pick.randrange(12) for _ in range(n)]
        rows = [("sua-"[c // 3] + "x", f"t{i}") for i, c in enumerate(codes)]
        seen = set()
        for block in (1, 2, 7, 512):
            monkeypatch.setattr(structure_repair, "BLOCK_ROWS", block)
            repair = _Repair()
            for code, row in zip(codes, rows):
                repair.add(code, *row)
            seen.add(repair.finish())
        cost, audit = least_edits(bytes(codes), 0, (0, 3))
        text = "\n".join(f"{r}:{t}" for r, t in apply_edits(audit, rows, 0)[0])
        assert seen == {(cost, audit, sha(text))}


def plain_repair(rows):
    convs = {}
    for conv, turn, role, text in rows:
        kept = convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 1:
            text = ""
        if kind == 2:
            text = text.replace(".", "").replace("!", "").replace("?", "")
        if kind == 4:
            role = "user"
        kept += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    out = set()
    for conv, kept in convs.items():
        kept, seen, codes, faults = in_order(kept), set(), [], [0, 0, 0, 0]
        for _, role, text in kept:
            core = text.strip(" \t\n\v\f\r")
            fault = 1 if not core else 2 if (role, text) in seen else 0 if core[-1] in ".!?" else 3
            seen.add((role, text))
            faults[fault] += 1
            codes.append("sua".find(role[:1] or "-") * 3 + (0, 1, 1, 2)[fault] if role[:1] in ("s", "u", "a") else 9 + (0, 1, 1, 2)[fault])
        turns = [t for t, _, _ in kept if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        cost, audits = all_least(bytes(codes), 0, (0, 3))
        repaired = "\n".join(f"{r}:{t}" for r, t in apply_edits(min(audits), [k[1:] for k in kept], 0)[0])
        out.add((conv, gaps, *faults[1:], illegal, cost, min(audits), sha(repaired)))
    return out


def test_repair_equals_the_plain_one_and_its_sql(spark, table_of):
    for rows in (awkward(10), awkward(11), []):
        path = table_of(rows)
        result = op13_structure_repair(spark, path)
        assert {tuple(r) for r in result.collect()} == plain_repair(rows)
        assert compare(result, connect(path), OP13_SQL) == agreed(rows)
