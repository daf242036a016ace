"""Conversation structure repair: the cheapest edits that give the roles ``s?(ua)+`` or nothing.

A node of the edit lattice is (rows consumed, state of the role pattern). Keep costs 0, Rerole 3, Delete 4,
Insert 3; a truncated row that stays costs 3 more; blank and repeated rows must go. A bidirectional Dijkstra
searches a block of the lattice: one heap from its entry, one from its exits. It goes on until the two least costs
exceed the best crossing, so that all crossings of that cost are known, and the least concatenated
audit is read along tight edges.

A conversation is read as a stream in blocks of bounded length. Two audits of one cost between the same two nodes are
never one the beginning of the other (that would take an Insert more, which costs), so the least audit of a whole is
made of least audits of its blocks. What is carried per state is one audit (a letter a row) and one running digest;
texts are never gathered. One shuffle by conversation, sorts that spill, one pass. The digest of a conversation's
repaired text is sequential by definition, so its rows pass one task, as a stream.

Defined cases: null roles and texts are one space; rows are ordered by turn (null first), then by the digest
of role and text; equal rows are adjacent, the later ones repeated; an empty role has no initial and cannot be kept;
a null conv_id is a conversation of its own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cytoframe.llm.common import arrow, table

BLOCK_ROWS = 512
STATES = 4  # 0: nothing yet, 1: after system, 2: after user, 3: after assistant
ENDS = (0, 3)
WHITE = r"\x20\x09-\x0D"
MUST_GO, CUT_SHORT = 1, 2
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_GIVEN = {"u": "user", "a": "assistant"}


def _row_edges(initial: str, fault: int) -> list[list[tuple[int, str, int]]]:
    """Per state, the (cost, letter, next state) by which a row is consumed."""
    edges = []
    for state, moves in enumerate(_NEXT):
        out = [(DELETE, "D", state)]
        if fault != MUST_GO:
            more = CUT if fault == CUT_SHORT else 0
            for to, after in moves.items():
                if to == initial:
                    out.append((more, "K", after))
                elif to in _GIVEN:
                    out.append((REROLE + more, "R", after))
        edges.append(out)
    return edges


def _reversed(edges: list[list[tuple[int, str, int]]]) -> list[list[tuple[int, str, int]]]:
    back: list[list[tuple[int, str, int]]] = [[] for _ in range(STATES)]
    for state, out in enumerate(edges):
        for cost, letter, after in out:
            back[after].append((cost, letter, state))
    return back


INITIALS = "sua-"
FORWARD = [_row_edges(i, f) for i in INITIALS for f in range(3)]
BACKWARD = [_reversed(e) for e in FORWARD]
INSERTS = [[(INSERT, "I", after) for to, after in moves.items() if to in _GIVEN] for moves in _NEXT]
INSERTS_BACK = _reversed(INSERTS)


def _after(codes: bytes, node: int) -> Iterator[tuple[int, str, int]]:
    """(cost, letter, node) of the edges that leave a node, numbered rows * STATES + state."""
    row, state = divmod(node, STATES)
    for cost, letter, to in INSERTS[state]:
        yield cost, letter, row * STATES + to
    if row < len(codes):
        for cost, letter, to in FORWARD[codes[row]][state]:
            yield cost, letter, (row + 1) * STATES + to


def _before(codes: bytes, node: int) -> Iterator[tuple[int, str, int]]:
    row, state = divmod(node, STATES)
    for cost, letter, origin in INSERTS_BACK[state]:
        yield cost, letter, row * STATES + origin
    if row:
        for cost, letter, origin in BACKWARD[codes[row - 1]][state]:
            yield cost, letter, (row - 1) * STATES + origin


@lru_cache(maxsize=20_000)
def least_edits(codes: bytes, entry: int, exits: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost and, of that cost, the least audit from state ``entry`` before the rows to one of ``exits`` after them.

    None where no edits lead there (nothing leads back to the state before all rows).
    """
    size = STATES * (len(codes) + 1)
    goals = {len(codes) * STATES + q for q in exits}
    ahead, behind = {entry: 0}, dict.fromkeys(goals, 0)
    fore, aft = [entry], sorted(goals)
    settled, closed = set(), set()
    best = 0 if entry in goals else None
    while fore and aft:
        near, far = fore[0] // size, aft[0] // size
        if best is not None and near + far > best:
            break
        heap, done, labels, others, edges = (
            (fore, settled, ahead, behind, _after) if near <= far else (aft, closed, behind, ahead, _before)
        )
        cost, node = divmod(heappop(heap), size)
        if node in done:
            continue
        done.add(node)
        for step, _, to in edges(codes, node):
            total = cost + step
            if to not in labels or total < labels[to]:
                labels[to] = total
                heappush(heap, total * size + to)
            if to in others and (best is None or total + others[to] < best):
                best = total + others[to]
    if best is None:
        return None
    return best, _least_audit(codes, entry, goals, ahead, behind, settled, closed | goals, best)


def _least_audit(codes, entry, goals, ahead, behind, settled, closed, best) -> str:
    if entry in goals and best == 0:
        return ""

    def crosses(node: int, cost: int, to: int) -> bool:
        return to in closed and ahead[node] + cost + behind[to] == best

    # settled nodes from which tight edges lead to a crossing of the least cost
    useful = {u for u in settled if any(crosses(u, c, v) for c, _, v in _after(codes, u))}
    todo = list(useful)
    while todo:
        node = todo.pop()
        for cost, _, origin in _before(codes, node):
            if origin in settled and origin not in useful and ahead[origin] + cost == ahead[node]:
                useful.add(origin)
                todo.append(origin)
    # all nodes that one least beginning leads to, before (False) or after (True) its crossing
    audit, here = [], {(entry, False)}
    while not any(over and node in goals and behind[node] == 0 for node, over in here):
        steps: dict[str, set] = {}
        for node, over in here:
            for cost, letter, to in _after(codes, node):
                if over:
                    if to in closed and behind[node] == cost + behind[to]:
                        steps.setdefault(letter, set()).add((to, True))
                    continue
                if to in useful and ahead[node] + cost == ahead[to]:
                    steps.setdefault(letter, set()).add((to, False))
                if crosses(node, cost, to):
                    steps.setdefault(letter, set()).add((to, True))
        letter = min(steps)
        audit.append(letter)
        here = steps[letter]
    return "".join(audit)


def apply_edits(audit: str, rows: Iterable[tuple[str, str]], state: int) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that an audit makes of rows, and the state after them."""
    left, out = iter(rows), []
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(left)
        if letter == "D":
            continue
        to = role[:1] if letter == "K" else next(i for i in _NEXT[state] if i in _GIVEN)
        out.append((role if letter == "K" else _GIVEN[to], text))
        state = _NEXT[state][to]
    return out, state


class _Repair:
    """One conversation as it streams by: per state the best cost, audit and digest so far."""

    def __init__(self) -> None:
        self.best = {0: (0, "", hashlib.sha256())}
        self.codes, self.rows = bytearray(), []

    def add(self, code: int, role: str, text: str) -> None:
        if len(self.codes) == BLOCK_ROWS:
            self._fold(tuple((q,) for q in range(STATES)))
        self.codes.append(code)
        self.rows.append((role, text))

    def _fold(self, targets: tuple[tuple[int, ...], ...]) -> None:
        codes, found = bytes(self.codes), {}
        for exits in targets:
            ways = []
            for entry, (cost, audit, _) in self.best.items():
                way = least_edits(codes, entry, exits)
                if way:
                    ways.append((cost + way[0], audit + way[1], entry, way[1]))
            if ways:
                cost, audit, entry, last = min(ways)
                digest = self.best[entry][2].copy()
                out, state = apply_edits(last, self.rows, entry)
                text = "\n".join(f"{role}:{text}" for role, text in out)
                digest.update((("\n" if entry and out else "") + text).encode("utf-8", "surrogatepass"))
                found[state] = (cost, audit, digest)
        self.best, self.codes, self.rows = found, bytearray(), []

    def finish(self) -> tuple[int, str, str]:
        self._fold((ENDS,))
        cost, audit, digest = next(iter(self.best.values()))
        return cost, audit, digest.hexdigest()


OUT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)
_ARROW = pa.schema(
    [("conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    + [("audit", pa.string()), ("repaired_sha256", pa.string())]
)
_LEGAL = {"su", "ua", "au"}


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from rows sorted by conversation and order."""
    state, out = None, []

    def close() -> None:
        conv, repair, faults, illegal, (first, last, distinct), _ = state
        cost, audit, digest = repair.finish()
        gaps = 0 if first is None else last - first + 1 - distinct
        out.append((conv, gaps, *faults, illegal, cost, audit, digest))

    for batch in batches:
        for conv, turn, role, text, initial, fault, live in zip(*(c.to_pylist() for c in batch.columns)):
            if state is None or state[0] != conv:
                if state is not None:
                    close()
                state = [conv, _Repair(), [0, 0, 0], 0, (None, None, 0), None]
            if not live:
                continue
            if turn is not None:
                first, last, distinct = state[4]
                state[4] = (turn if first is None else first, turn, distinct + (turn != last))
            if fault:
                state[2][fault - 1] += 1
            if state[5] is not None and state[5] + initial not in _LEGAL:
                state[3] += 1
            state[5] = initial
            kind = (0, MUST_GO, MUST_GO, CUT_SHORT)[fault]
            at = INITIALS.find(initial) if initial in ("s", "u", "a") else 3
            state[1].add(at * 3 + kind, role, text)
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in out], schema=_ARROW)
            out.clear()
    if state is not None:
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in out], schema=_ARROW)


def message_digest(role: Column, text: Column) -> Column:
    """16 bytes that stand for a role and a text; they also order the rows of one turn."""
    return F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))


def repair_structure(messages: DataFrame, live: Column | None = None) -> DataFrame:
    """Faults, least cost, audit and digest of the repaired rows, one row a conversation.

    ``messages`` has conv_id, turn, role and text. Rows where ``live`` is false only make their conversation appear.
    """
    rows = messages.select(
        "conv_id", "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.lit(True) if live is None else live).alias("live"),
    ).withColumn("digest", message_digest(F.col("role"), F.col("text")))
    order = [F.col("turn").asc_nulls_first(), "digest"]
    seen = F.row_number().over(Window.partitionBy("conv_id", "live", "digest").orderBy(*order)) > 1
    rows = (
        rows.repartition("conv_id")
        .withColumn("seen", seen)
        .withColumn(
            "fault",
            F.when(~F.col("text").rlike(f"[^{WHITE}]"), 1)
            .when(F.col("seen"), 2)
            .when(~F.col("text").rlike(rf"[.!?][{WHITE}]*\z"), 3)
            .otherwise(0),
        )
        .sortWithinPartitions("conv_id", *order, "seen")
        .select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), "fault", "live")
    )
    return arrow(rows, _repairs, OUT)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped (not ``live``), emptied, without end marks, doubled or given to the user, by crc32 of conv_id:turn."""
    space = F.lit(" ")
    key = F.concat(
        F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space)
    )
    kind, text = F.col("kind"), F.coalesce("text", space)
    return (
        conversations.select("conv_id", "turn", "role", "text", (F.crc32(key) % 20).alias("kind"))
        .select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            (kind != 0).alias("live"),
            F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy"),
        )
        .drop("copy")
    )


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    return repair_structure(rows, F.col("live"))


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII text expression: bytes go in by xor, each followed by eight shifts (-1)."""
    return f"""xor(list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length({text}) + 1),
  lambda i: [cast(unicode(substring({text}, i, 1)) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: case when x >= 0 then xor(c, x) else xor(c >> 1, case when c & 1 = 1 then 3988292384 else 0 end) end), 4294967295)"""


OP13_SQL = f"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k
  from conversations
), kinds as (select *, {crc32_sql('k')} % 20 as kind from given),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
    unnest(case when kind = 3 then [1, 2] else [1] end) as copy
  from kinds where kind <> 0
), digested as (select *, md5(length(role) || ':' || role || text) as digest from damaged),
told as (select *, row_number() over (partition by conv_id, digest order by turn nulls first) as nth from digested),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, digest, nth) as i, left(role, 1) as initial
  from told
), faulty as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 1 when nth > 1 then 2
    when not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') then 3 else 0 end as fault,
    lag(initial) over (partition by conv_id order by i) as previous
  from numbered
), inserts(p, m, cost, audit) as (
  values (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''),
    (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 2, 3, 'I'), (1, 3, 6, 'II'), (2, 3, 3, 'I'), (3, 2, 3, 'I')
), moves(m, initial, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
steps as (
  select f.conv_id, f.i, s.p, v.q, s.cost + v.cost as cost, s.audit || v.letter as audit
  from faulty f, inserts s, lateral (
    select s.m as q, 4 as cost, 'D' as letter
    union all
    select t.q, case when t.initial = f.initial then 0 else 3 end + case when f.fault = 3 then 3 else 0 end,
      case when t.initial = f.initial then 'K' else 'R' end
    from moves t where t.m = s.m and f.fault not in (1, 2) and (t.initial = f.initial or t.initial <> 's')
  ) v
), walk as (
  select distinct conv_id, cast(0 as bigint) as i, 0 as q, 0 as cost, '' as audit from conversations
  union all
  select conv_id, i, q, least_way.cost, least_way.audit from (
    select w.conv_id, s.i, s.q, min({{'cost': w.cost + s.cost, 'audit': w.audit || s.audit}}) as least_way
    from walk w join steps s on s.conv_id is not distinct from w.conv_id and s.i = w.i + 1 and s.p = w.q
    group by w.conv_id, s.i, s.q
  )
), sizes as (select conv_id, count(*) as n from faulty group by conv_id),
best as (
  select w.conv_id, min({{'cost': w.cost + s.cost, 'audit': w.audit || s.audit}}) as way
  from walk w left join sizes z on z.conv_id is not distinct from w.conv_id
  join inserts s on s.p = w.q and s.m in (0, 3)
  where w.i = coalesce(z.n, 0) group by w.conv_id
), letters as (
  select conv_id, j, way.audit[j] as letter from (select *, unnest(range(1, length(way.audit) + 1)) as j from best)
), placed as (
  select *, count(*) filter (letter <> 'I') over w as i, count(*) filter (letter <> 'D') over w as o
  from letters window w as (partition by conv_id order by j)
), said as (
  select l.conv_id, l.j, l.o, l.letter, f.role, case when l.letter = 'I' then '' else f.text end as text,
    count(*) filter (l.letter = 'K' and l.o = 1 and f.initial = 's') over (partition by l.conv_id) as system
  from placed l left join faulty f on f.conv_id is not distinct from l.conv_id and f.i = l.i and l.letter <> 'I'
  where l.letter <> 'D'
), repaired as (
  select conv_id, sha256(string_agg(case when letter = 'K' then role when (o - system) % 2 = 1 then 'user' else 'assistant' end
    || ':' || text, chr(10) order by j)) as repaired_sha256
  from said group by conv_id
), counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
    count(*) filter (fault = 1) as blank, count(*) filter (fault = 2) as duplicate, count(*) filter (fault = 3) as truncated,
    count(*) filter (previous is not null and previous || initial not in ('su', 'ua', 'au')) as illegal
  from faulty group by conv_id
)
select b.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
  coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(way.cost as bigint) as cost, way.audit as audit,
  coalesce(repaired_sha256, sha256('')) as repaired_sha256
from best b left join counted c on c.conv_id is not distinct from b.conv_id
left join repaired r on r.conv_id is not distinct from b.conv_id
"""
