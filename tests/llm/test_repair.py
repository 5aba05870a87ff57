"""Reports against a plain recursion over the edits, block-wise against whole, and against SQL."""

import hashlib
import random
import zlib
from functools import lru_cache

import duckdb
import pytest

from kilnframe.llm import repair

DIR = "/root/testdata/sf0.001"
SPACE = " \t\n\v\f\r"


def by_hand(rows):
    """``rows`` of one conversation after damage, in order: its report by trying every edit."""
    flags, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        flags.append(fault)
    n = len(rows)

    @lru_cache(None)
    def best(i, made, inserts):
        """Cheapest (cost, edits, lines) from row ``i`` on, given the role initials made so far in short."""
        out = []
        if i == n and made in ("", "a"):
            out.append((0, "", ()))
        for letter, role in (("u", "user"), ("a", "assistant")):
            if inserts < 4 and letter == {"": "u", "s": "u", "u": "a", "a": "u"}[made]:
                c, e, l = best(i, letter, inserts + 1)
                out.append((c + 5, "I" + e, (role + ":", *l)))
        if i < n:
            c, e, l = best(i + 1, made, 0)
            out.append((c + 2, "D" + e, l))
            if flags[i] not in ("blank", "duplicate"):
                charge = 5 * (flags[i] == "truncated")
                for op, cost, role in (("K", 0, rows[i][1]), ("R", 1, "user"), ("R", 1, "assistant")):
                    if made + role[:1] in ("s", "u", "su", "ua", "au") and role[:1]:
                        c, e, l = best(i + 1, role[:1], 0)
                        out.append((c + cost + charge, op + e, (f"{role}:{rows[i][2]}", *l)))
        return min(out) if out else (10**9, "~", ())

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, flags.count("blank"), flags.count("duplicate"), flags.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, *map(str, r[1:])))


def laid(rows):
    """Conversations in the operator's order."""
    out = {}
    for conv, turn, role, text, copies in rows:
        out.setdefault(conv, [])
        out[conv] += [(turn, role, text)] * copies
    for r in out.values():
        r.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1][:64], hashlib.md5(f"{x[1]}\0{x[2]}".encode()).hexdigest()))
    return out


def after_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text, copies = ("user" if h == 4 else role), {0: "", 1: "", 2: text.translate(str.maketrans("", "", ".!?"))}.get(h, text), {0: 0, 3: 2}.get(h, 1)
        out.append((conv, turn, role, text, copies))
    return out


def made_up(seed, n=400, convs=40):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", " \n", None, "Why? ", "end.\t", " ", "longer text. and more"]
    return [(rng.choice([None, *range(convs)]), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, key string, seq int").repartition(3)


def test_damage(spark):
    rows = made_up(1)
    got = [tuple(r) for r in repair.damaged(frame(spark, rows)).collect()]
    want = [(c, t, r, x, k) for c, t, r, x, k in after_damage(rows)]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("blocks", [2048, 3, 1])
def test_against_recursion(spark, monkeypatch, blocks):
    rows = made_up(2) + [(100, k, "user" if k % 2 else "assistant", f"text {k % 50}.") for k in range(120)] + [(101, 1, "user", "Same.")] * 60
    monkeypatch.setattr(repair, "BLOCK_ROWS", blocks)
    rows_after = repair.damaged(frame(spark, rows))
    table = ordered(tuple(r) for r in repair.repair(rows_after).collect())
    want = ordered((c, *by_hand(r)) for c, r in laid(after_damage(rows)).items())
    assert table == want


def test_search_from_every_state():
    rng = random.Random(3)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 9))]
        cut = rng.randint(0, len(rows))
        whole = repair.search(rows, 0, repair.ENDS)
        (q, best), = whole.items()
        first, joined = repair.search(rows[:cut], 0, range(4), True), []
        for enter, (g, a) in first.items():
            joined += [(g + g2, a + a2) for leave, (g2, a2) in repair.search(rows[cut:], enter, range(4), True).items() if leave in repair.ENDS]
        assert min(joined) == best


def test_blocks_and_edits():
    rows = [("system", "Be brief."), ("user", "Hi."), ("user", "Hi."), ("assistant", "")]
    b = repair.Block([0, 1, 1, 2], [r for r, _ in rows], [t for _, t in rows])
    report = repair.alone(b)
    assert report[:7] == (0, 1, 1, 0, 1, 6, "RRDD")
    assert hashlib.sha256("\n".join(repair.apply(rows, report[6])).encode()).hexdigest() == report[7]


def test_empty_and_all_dropped(spark):
    kind = "conv_id long, turn long, role string, text string"
    assert repair.query(spark.createDataFrame([], kind)).count() == 0
    gone = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    assert tuple(repair.query(spark.createDataFrame([(gone, 0, "user", "Hi.")], kind)).first()) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_long_texts(spark):
    rows = [(1, 0, "user", "a " * 2_000_000 + "."), (1, 1, "assistant", "b" * 3_000_000 + "!"), (1, 2, "user", "c" * 100)]
    want = {c: by_hand(r) for c, r in laid(after_damage(rows)).items()}
    assert {r.conv_id: tuple(r)[1:] for r in repair.query(frame(spark, rows)).collect()} == want


def test_against_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{DIR}/conversations.parquet'")
    cols = ["conv_id", *repair.COLUMNS]
    got = repair.query(spark.read.parquet(f"{DIR}/conversations.parquet")).select(*cols).collect()
    assert ordered(map(tuple, got)) == ordered(c.sql(repair.sql()).select(*cols).fetchall())
    c.sql("drop view conversations")
    rows = made_up(4, 300, 60)
    c.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    c.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    assert ordered(tuple(r) for r in repair.query(frame(spark, rows)).select(*cols).collect()) == ordered(c.sql(repair.sql()).select(*cols).fetchall())
