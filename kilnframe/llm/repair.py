"""Repair of conversations: the cheapest edits that give turns in order, by A* on the edit lattice.

A node of the lattice is a place among a conversation's rows and a state of the
pattern of role initials ``(s?(ua)+)?``. Edges keep, re-role or delete the next
row or insert one. The heuristic is a suffix sum: what follows costs at least
its mandatory deletions and, for each truncated row, the cheaper of deleting and
keeping it. The queue is keyed by cost plus heuristic, then by the edits so far,
so the first arrival at a node is the cheapest and among those the ASCII-least:
a part of a path costs what its letters say, and equal costs at one node are
never prefixes of each other.

Rows are dealt by ranges of conversation and turn, so a conversation of any size
is spread over tasks. One that lies inside a task is solved there. The others are
cut into blocks of a bounded size; each block is searched from each of the four
states, in parallel, and a last pass joins the blocks' best ways in order. What
one task sees of a long conversation then is a block at a time and its edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from heapq import heappop, heappush
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, small_batches

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: The states: nothing yet, after the system's turn, after the user's, after the assistant's; it may end in the first and the last.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: The one letter that an inserted or re-roled row can have in each state.
TURN = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
SPACE = " \t\n\v\f\r"
BLOCK_ROWS, BLOCK_CHARS = 2048, 4 << 20
REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COLUMNS = [c.split()[0] for c in REPORT.split(", ")]
WAYS = "array<struct<enter:int,leave:int,cost:long,audit:string>>"


def damaged(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, text, copies)``: the rows after the damage that their ids call for.

    ``crc32("conv_id:turn") % 20`` of 0 drops a row (0 copies), 1 empties its
    text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes its role ``user``. Null
    ids in that key, null roles and null texts are read as one space.
    """
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    x = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), h.alias("h"))
    text = F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return x.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 0, 0).when(F.col("h") == 3, 2).otherwise(1).alias("copies"))


def search(rows: Sequence[tuple[str, bool, bool]], enter: int, ends: Sequence[int], every: bool = False) -> dict[int, tuple[int, str]]:
    """Best ``(cost, edits)`` from state ``enter`` through ``rows`` of ``(initial, must go, truncated)`` to the first of ``ends`` that is reached, or to every one of them."""
    n = len(rows)
    left = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        left[i] = left[i + 1] + (DELETE if rows[i][1] else min(DELETE, TRUNCATED) if rows[i][2] else 0)
    queue, done, found = [(left[0], "", 0, enter)], set(), {}
    while queue:
        f, audit, i, q = heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        g = f - left[i]
        if i == n and q in ends:
            found[q] = (g, audit)
            if not every or len(found) == len(ends):
                break
        turn = TURN[q]
        after = NEXT[q][turn]
        if (i, after) not in done:
            heappush(queue, (f + INSERT, audit + "I", i, after))
        if i < n:
            initial, gone, cut = rows[i]
            if (i + 1, q) not in done:
                heappush(queue, (g + DELETE + left[i + 1], audit + "D", i + 1, q))
            if not gone:
                more = g + (TRUNCATED if cut else 0) + left[i + 1]
                if initial in NEXT[q]:
                    heappush(queue, (more, audit + "K", i + 1, NEXT[q][initial]))
                heappush(queue, (more + REROLE, audit + "R", i + 1, after))
    return found


def edited(roles: Sequence[str], texts: Sequence[str], enter: int, audit: str) -> Iterator[str]:
    """The repaired rows as ``role:text``; the edits and the state before them say every role."""
    i, q = 0, enter
    for op in audit:
        if op == "I":
            yield ROLE[TURN[q]] + ":"
            q = NEXT[q][TURN[q]]
            continue
        if op == "K":
            yield f"{roles[i]}:{texts[i]}"
            q = NEXT[q][roles[i][:1]]
        elif op == "R":
            yield f"{ROLE[TURN[q]]}:{texts[i]}"
            q = NEXT[q][TURN[q]]
        i += 1


def digest(role: str, text: str) -> str:
    return hashlib.md5(f"{role}\0{text}".encode()).hexdigest()


class Block:
    """Consecutive rows of a conversation after damage, with what was seen in blocks before."""

    def __init__(self, turns: Sequence[int | None], roles: Sequence[str], texts: Sequence[str], before: Sequence[str] = ()):
        self.turns, self.roles, self.texts = turns, roles, texts
        self.rows: list[tuple[str, bool, bool]] = []
        self.blank = self.duplicate = self.truncated = 0
        seen, earlier = set(), set(before)
        for role, text in zip(roles, texts):
            bare = text.rstrip(SPACE)
            blank = not bare
            twice = not blank and ((role, text) in seen or (bool(earlier) and digest(role, text) in earlier))
            cut = not blank and not twice and bare[-1] not in ".!?"
            seen.add((role, text))
            self.blank += blank
            self.duplicate += twice
            self.truncated += cut
            self.rows.append((role[:1], blank or twice, cut))


class Chain:
    """A conversation put together block after block, in order: the best way to each state so far and its running hash."""

    def __init__(self):
        self.settled: list[str] = []  # edits that all ways so far have in common
        self.best = {0: (0, "", hashlib.sha256(), False)}
        self.turn: tuple[int, int] | None = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial: str | None = None

    def add(self, b: Block, ways: Sequence[tuple[int, int, int, str]]) -> None:
        self.blank, self.duplicate, self.truncated = self.blank + b.blank, self.duplicate + b.duplicate, self.truncated + b.truncated
        for role in b.roles:
            if self.initial is not None and self.initial + role[:1] not in LEGAL:
                self.illegal += 1
            self.initial = role[:1]
        for t in b.turns:
            if t is not None and (self.turn is None or t != self.turn[1]):
                self.turns += 1
                self.turn = (t if self.turn is None else self.turn[0], t)
        best: dict[int, tuple[int, str, int]] = {}
        for enter, leave, cost, audit in ways:
            if enter in self.best:
                g, a = self.best[enter][:2]
                new = (g + cost, a + audit, enter)
                if leave not in best or new[:2] < best[leave][:2]:
                    best[leave] = new
        same = commonprefix([a for _, a, _ in best.values()])
        self.settled.append(same)
        then = {}
        for leave, (g, a, enter) in best.items():
            _, old, sha, begun = self.best[enter]
            sha = sha.copy()
            for line in edited(b.roles, b.texts, enter, a[len(old) :]):
                sha.update((("\n" if begun else "") + line).encode())
                begun = True
            then[leave] = (g, a[len(same) :], sha, begun)
        self.best = then

    def report(self) -> tuple:
        """The columns of ``REPORT``."""
        g, a, sha = min((self.best[q] for q in ENDS if q in self.best), key=lambda x: x[:2])[:3]
        gaps = self.turn[1] - self.turn[0] + 1 - self.turns if self.turn else 0
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, g, "".join([*self.settled, a]), sha.hexdigest()


def alone(b: Block) -> tuple:
    """The report of a conversation that is one block."""
    c = Chain()
    c.add(b, [(0, q, *found) for q, found in search(b.rows, 0, ENDS).items()])
    return c.report()


def _cut(rows: DataFrame) -> DataFrame:
    """Reports of the conversations that lie inside a task, and blocks of all others, in one table."""
    keys = ["conv_id", F.col("turn").asc_nulls_first(), F.substring("role", 1, 64), F.md5(F.concat("role", F.lit("\0"), "text")), F.xxhash64(F.monotonically_increasing_id())]
    x = rows.select("*", *[k.alias(f"k{i}") for i, k in enumerate(keys[2:])])
    order = ["conv_id", keys[1], "k0", "k1", "k2"]
    dealt = x.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "copies")
    kind = f"conv_id long, key string, part int, seq int, closed boolean, {REPORT}, turns array<long>, roles array<string>, texts array<string>"
    to = pa.schema(
        [("conv_id", pa.int64()), ("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("closed", pa.bool_())]
        + [(c, pa.string() if c in ("audit", "repaired_sha256") else pa.int64()) for c in COLUMNS]
        + [("turns", pa.list_(pa.int64())), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]
    )

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held = 0

        def flushed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), to)], schema=to)

        now, first, seq, size = None, True, 0, 0
        turns: list = []
        roles: list = []
        texts: list = []

        def block() -> tuple:
            return (now, "" if now is None else str(now), part, seq, False, *[None] * len(COLUMNS), turns, roles, texts)

        started = False
        for batch in it:
            for conv, turn, role, text, copies in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "copies")]):
                if started and conv != now:
                    if first or seq:  # it may have begun in the task before, or is longer than a block
                        out.append(block())
                        held += size
                    else:
                        out.append((now, "", part, 0, True, *alone(Block(turns, roles, texts)), None, None, None))
                    first, seq, size, turns, roles, texts = False, 0, 0, [], [], []
                now, started = conv, True
                for _ in range(copies):
                    if len(roles) >= BLOCK_ROWS or (roles and size + len(text) > BLOCK_CHARS):
                        out.append(block())
                        held += size
                        seq, size, turns, roles, texts = seq + 1, 0, [], [], []
                    turns.append(turn)
                    roles.append(role)
                    texts.append(text)
                    size += len(text) + 64
                if held > BLOCK_CHARS or len(out) >= 2000:
                    yield flushed()
                    out, held = [], 0
        if started:
            out.append(block())
        if out:
            yield flushed()

    return saved(dealt.mapInArrow(cut, kind))


def _joined(blocks: DataFrame) -> DataFrame:
    """Reports of the conversations that are cut into ``blocks``."""
    each = blocks.select("key", "part", "seq", F.explode(F.arrays_zip("roles", "texts")).alias("r"))
    slim = each.select("key", "part", "seq", F.md5(F.concat("r.roles", F.lit("\0"), "r.texts")).alias("d")).distinct()
    first = slim.groupBy("key", "d").agg(F.min(F.struct("part", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1").select("key", "d", "first")
    later = slim.join(first, ["key", "d"]).where(F.struct("part", "seq") > F.col("first")).groupBy("key", "part", "seq").agg(F.collect_list("d").alias("before"))
    met = blocks.select("conv_id", "key", "part", "seq", "turns", "roles", "texts").join(later, ["key", "part", "seq"], "left")

    def ways(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            got = []
            for turns, roles, texts, before in zip(*[batch.column(c).to_pylist() for c in ("turns", "roles", "texts", "before")]):
                b = Block(turns, roles, texts, before or ())
                got.append([{"enter": q, "leave": e, "cost": g, "audit": a} for q in range(4) for e, (g, a) in search(b.rows, q, range(4), True).items()])
            kind = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "key", "part", "seq", "turns", "roles", "texts", "before")], pa.array(got, kind)], names=["conv_id", "key", "part", "seq", "turns", "roles", "texts", "before", "ways"])

    found = met.select("conv_id", "key", "part", "seq", "turns", "roles", "texts", "before").mapInArrow(ways, f"conv_id long, key string, part int, seq int, turns array<long>, roles array<string>, texts array<string>, before array<string>, ways {WAYS}")
    dealt = found.repartition("key").sortWithinPartitions("key", "part", "seq")

    def chain(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, c, conv = None, None, None
        out: list[tuple] = []
        for batch in it:
            for row in batch.to_pylist():
                if row["key"] != now:
                    if c:
                        out.append((conv, *c.report()))
                    now, conv, c = row["key"], row["conv_id"], Chain()
                c.add(Block(row["turns"], row["roles"], row["texts"], row["before"] or ()), [(w["enter"], w["leave"], w["cost"], w["audit"]) for w in row["ways"]])
        if c:
            out.append((conv, *c.report()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) if k in (7, 8) else pa.array(x, pa.int64()) for k, x in enumerate(zip(*out))], names=["conv_id", *COLUMNS])

    return dealt.mapInArrow(chain, f"conv_id long, {REPORT}")


def repair(rows: DataFrame) -> DataFrame:
    """A report for each ``conv_id`` of ``rows(conv_id, turn, role, text[, copies])``.

    Rows without ``copies`` count once; those of 0 copies only name their
    conversation. A conversation's rows go by turn (nulls first), then by role
    and a hash of role and text. Null roles and texts are one space; rows without
    a ``conv_id`` are one conversation. Of an empty table there is no report.
    """
    small_batches(rows.sparkSession, 1000)
    blank = F.lit(" ")
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    x = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), F.coalesce(F.col("text").cast("string"), blank).alias("text"), copies.alias("copies"))
    table = _cut(x)
    return table.where("closed").select("conv_id", *COLUMNS).unionByName(_joined(table.where("not closed")))


def apply(conversation: Sequence[tuple[str, str]], audit: str) -> list[str]:
    """The repaired ``role:text`` rows of one conversation's rows, given the edits of its report."""
    return list(edited([r for r, _ in conversation], [t for _, t in conversation], 0, audit))


def query(conversations: DataFrame) -> DataFrame:
    """The report of every conversation after its damage."""
    return repair(damaged(conversations))


def sql() -> str:
    """The same reports for DuckDB: the lattice row by row as a recursive table, with the best way to each state."""
    label = "STRUCT(c BIGINT, a VARCHAR, t VARCHAR)"

    def step(state: str, op: str, cost: str, line: str = "") -> str:
        text = f"{state}.t || CASE WHEN {state}.t = '' THEN '' ELSE chr(10) END || {line}" if line else f"{state}.t"
        return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{op}', 't': {text}}} END"

    def least(*of: str) -> str:
        return f"list_aggregate([{', '.join(of)}], 'min')"

    keep, rerole = "x.cut * 5", "x.cut * 5 + 1"

    def kept(state: str, letter: str) -> str:
        return f"CASE WHEN x.gone = 0 AND x.initial = '{letter}' THEN {step(state, 'K', keep, 'x.role || chr(58) || x.text')} END"

    def reroled(state: str, role: str) -> str:
        return f"CASE WHEN x.gone = 0 THEN {step(state, 'R', rerole, f"'{role}:' || x.text")} END"

    moved = [
        step("z.l0", "D", "2"),
        least(step("z.l1", "D", "2"), kept("z.l0", "s")),
        least(step("z.l2", "D", "2"), *[f(x, v) for x in ("z.l0", "z.l1", "z.l3") for f, v in ((kept, "u"), (reroled, "user"))]),
        least(step("z.l3", "D", "2"), kept("z.l2", "a"), reroled("z.l2", "assistant")),
    ]

    def inserted(source: str) -> str:
        """All states after insertions at one place."""
        user = least(f"{source}.l2", *[step(f"{source}.{x}", "I", "5", "'user:'") for x in ("l0", "l1", "l3")])
        return f"SELECT * REPLACE ({least('l3', step('l2', 'I', '5', "'assistant:'"))} AS l3) FROM (SELECT * REPLACE ({user} AS l2) FROM {source})"

    crc = "list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(k, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384::BIGINT) ELSE s >> 1 END))"
    space = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    return f"""WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor({crc}, 4294967295::BIGINT) % 20 AS h FROM (SELECT *, concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')) AS k FROM conversations)),
e AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d, (SELECT unnest([1, 2]) AS copy) WHERE h <> 0 AND (copy = 1 OR h = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(role, 1, 64), md5(concat(role, chr(0), text))) AS i, left(role, 1) AS initial, rtrim(text, {space}) AS bare FROM e),
f AS (SELECT *, CASE WHEN bare = '' THEN 1 ELSE 0 END AS blank, CASE WHEN bare <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 1 ELSE 0 END AS twice, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM o),
x AS MATERIALIZED (SELECT *, blank + twice AS gone, CASE WHEN blank + twice = 0 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS cut FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank)::BIGINT AS blank, sum(twice)::BIGINT AS duplicate, sum(cut)::BIGINT AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND prior || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM x GROUP BY conv_id),
b AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 't': ''}}::{label} AS l0, NULL::{label} AS l1, NULL::{label} AS l2, NULL::{label} AS l3 FROM conversations),
w AS ({inserted('b')}),
r AS (SELECT conv_id, i, l0, l1, l2, l3 FROM w
UNION ALL
SELECT * FROM (WITH z AS (SELECT * FROM r), y AS (SELECT z.conv_id, x.i, {moved[0]} AS l0, {moved[1]} AS l1, {moved[2]} AS l2, {moved[3]} AS l3 FROM z JOIN x ON x.conv_id IS NOT DISTINCT FROM z.conv_id AND x.i = z.i + 1) {inserted('y')})),
g AS (SELECT conv_id, {least('l0', 'l3')} AS l FROM r WHERE i = coalesce((SELECT n FROM t WHERE t.conv_id IS NOT DISTINCT FROM r.conv_id), 0))
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, l.c AS cost, l.a AS audit, sha256(l.t) AS repaired_sha256 FROM g LEFT JOIN t ON t.conv_id IS NOT DISTINCT FROM g.conv_id"""
