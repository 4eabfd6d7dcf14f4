"""Conversation repair beside a forward search over whole edit scripts, long conversations, odd rows."""

import hashlib
import random
import re
import zlib

import pytest

from evigraph.llm import conversations

SCHEMA = "kind string, conv_id long, turn long, role string, text string, mark int, n int"
EMPTY = hashlib.sha256(b"").hexdigest()


def damage(rows):
    for conv, turn, role, text in rows:
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        yield from [(conv, turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)


def cheapest(rows):
    """(cost, audit, lines) by Dijkstra-like relaxation forwards: for each role history state the least (cost, audit)."""
    best = {"": (0, "", ())}  # keyed by the state: "", "s", "u", "a"

    def more(state, role):
        return role[:1] if state + role[:1] in ("s", "u", "su", "ua", "au") else None

    def inserted(table):
        table = dict(table)
        for _ in range(3):
            for state, (cost, audit, lines) in list(table.items()):
                for role in ("user", "assistant"):
                    to = more(state, role)
                    new = (cost + 5, audit + "I", (*lines, f"{role}:"))
                    if to and new[:2] < table.get(to, (1 << 60,))[:2]:
                        table[to] = new
        return table

    for fault, role, text in rows:
        after = {}

        def offer(state, entry):
            if entry[:2] < after.get(state, (1 << 60,))[:2]:
                after[state] = entry

        for state, (cost, audit, lines) in inserted(best).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 * (fault == "truncated")
            if more(state, role):
                offer(more(state, role), (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
            for other in ("user", "assistant"):
                if more(state, other):
                    offer(more(state, other), (cost + 1 + extra, audit + "R", (*lines, f"{other}:{text}")))
        best = after
    return min((v for k, v in inserted(best).items() if k in ("", "a")), key=lambda v: v[:2])


def plain(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in damage(rows) if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in mine:
            body = text.strip(conversations.SPACES)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, lines = cheapest([(f, role, text) for f, (_, role, text) in zip(faults, mine, strict=True)])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(), len(mine))
    return out


def check(spark, rows):
    frame = spark.createDataFrame([("x", *r, 1, 2) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in conversations.damage_and_repair(frame).collect()]
    want = plain(rows)
    assert len(got) == len(want)
    for row in got:
        assert row == want[row[0]]


def test_query_beside_the_search(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)


def test_random_conversations(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "admin"], ["Yes.", "no", "", " \n", "Why?", "é ", None, "ok!  "]
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(roles[: rng.choice([3, 7])]), rng.choice(texts)) for c in [None, *range(150)] for _ in range(rng.randrange(1, 14))]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 7, 10, 11, 500])
def test_one_long_conversation(spark, n):
    rng = random.Random(n)
    rows = [(7, k if k % 5 else k // 2, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["Fine.", "cut", f"Turn {k}.", ""])) for k in range(n)]
    check(spark, rows + rows[: n // 2])


def test_checkpoints_grow_with_the_root_and_blocks_stay_small(spark, monkeypatch):
    n = 5000
    rows = [(1, k, ("user", "assistant")[k % 2], f"Turn {k}.") for k in range(n)]
    held = []
    walk = conversations.Repair.walk
    monkeypatch.setattr(conversations.Repair, "walk", lambda self, behind: (held.append(len(self.block)), walk(self, behind)))
    vector, points, step = conversations.END, [], 1
    for k, (_, _, role, _) in enumerate(reversed(rows), 1):
        vector = conversations.before(conversations.FINE, conversations.initial(role), vector)
        if k == step * (step + 1) // 2:
            points.extend(vector)
            step += 1
    repair = conversations.Repair(n, points)
    for _, turn, role, text in rows:
        repair.add(turn, role, text, conversations.FINE)
    assert repair.row(1)[6:8] == (0, "K" * n)
    assert sum(held) == n and max(held) <= 101 and len(points) // 4 <= 100


def test_empty_table_and_all_dropped(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert conversations.damage_and_repair(frame).collect() == []
    gone = [(c, 0) for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    frame = spark.createDataFrame([("x", c, t, "user", "Hi.", 1, 2) for c, t in gone], SCHEMA)
    got = [tuple(r) for r in conversations.damage_and_repair(frame).collect()]
    assert sorted(got) == [(c, 0, 0, 0, 0, 0, 0, "", EMPTY, 0) for c, _ in gone]


def test_very_long_text(spark):
    check(spark, [(1, 0, "user", "word " * 400_000 + "end."), (1, 1, "assistant", "word " * 400_000 + "end."), (1, 2, "user", "x" * 2_000_000)])
