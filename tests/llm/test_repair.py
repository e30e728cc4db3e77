"""Conversation repair against a plain forward search over (cost, edits) on small rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shopmetrics.llm import conversation_repair as cr

SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if fate == 0:
            continue
        if fate == 1:
            text = ""
        if fate == 2:
            text = "".join(c for c in text if c not in ".!?")
        if fate == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def searched(turns):
    """(cost, edits, repaired) of one conversation, rows in order, by a forward search that keeps the least of each state."""
    following = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insert(best):
        for _ in range(3):
            for state, (cost, edits, text) in list(best.items()):
                to = following[state]
                new = (cost + 5, edits + "I", [*text, {"u": "user:", "a": "assistant:"}[to]])
                if to not in best or new[:2] < best[to][:2]:
                    best[to] = new
        return best

    best = {"": (0, "", [])}
    for role, text, fault in turns:
        then = {}

        def offer(to, cost, edits, out):
            if to not in then or (cost, edits) < then[to][:2]:
                then[to] = (cost, edits, out)

        for state, (cost, edits, out) in insert(best).items():
            offer(state, cost + 2, edits + "D", out)
            if fault in ("blank", "duplicate"):
                continue
            more = 5 * (fault == "truncated")
            if (role[:1] == "s" and state == "") or role[:1] == following[state]:
                offer(role[:1], cost + more, edits + "K", [*out, f"{role}:{text}"])
            to = following[state]
            offer(to, cost + 1 + more, edits + "R", [*out, {"u": "user:", "a": "assistant:"}[to] + text])
        best = then
    cost, edits, out = min(v for k, v in insert(best).items() if k in ("", "a"))
    return cost, edits, "\n".join(out)


def brute(rows):
    found = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged([r for r in rows if r[0] == conv])), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, turns, count = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, _, role, text in own:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
            if fault:
                count[fault] += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [r[1] for r in own if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, edits, text = searched(turns)
        found[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, edits, hashlib.sha256(text.encode()).hexdigest())
    return found


def some(seed=3, conversations=150):
    rng = random.Random(seed)
    texts = ["Well.", "so", "Why?", "", " \n", "It is!\t", "no end", "é…", "a.b", None]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unit", "", None]
    rows = []
    for conv in range(conversations):
        turns = list(range(rng.randint(1, 14)))
        rows += [(conv, None if rng.random() < 0.05 else t, rng.choice(roles), (rng.choice(texts) or "x" * rng.randint(0, 2)) if rng.random() < 0.9 else None) for t in turns if rng.random() < 0.9]
    rows += [(None, 0, "user", "Hi."), (None, None, "assistant", "Yes."), (900, None, None, None), (901, 3, "user", "w " * 30000 + ".")]
    rows += [(902, t, ("user", "assistant")[t % 2], f"Turn {t % 40}." if t % 9 else "cut off") for t in range(700)]  # spans ranges
    rows += [(903, 5, "user", "The same."), (903, 5, "user", "The same.")] * 30
    return rows


@pytest.fixture(scope="module")
def table(ready):
    schema = "conv_id long, turn long, role string, text string, at string, same int, fault string, part long, key string, gone string"

    def make(rows):
        return ready.createDataFrame([(*r, "x", 1, "y", 2, "k", "g") for r in rows], schema).repartition(3)

    return make


def collected(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("chunk_bytes", [cr.CHUNK_BYTES, 500])
def test_repair_is_the_cheapest(table, chunk_bytes):
    rows = some()
    got = cr.repair(cr.damage(table(rows)), chunk_bytes=chunk_bytes)
    assert collected(got) == brute(rows)
    assert got.count() == len({r[0] for r in rows})


def test_repair_without_damage_and_empty(table, ready):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "assistant", "Yes.")]
    got = collected(cr.repair_conversations(table(rows)))
    assert got[1][5:7] == (0, "KK") and got[2][5:7] == (2, "D")
    assert cr.repair(cr.damage(table(rows).limit(0))).count() == 0


def test_tables_are_the_single_steps():
    vectors, one, one_by, many, many_by = cr.tables()
    rng = random.Random(2)
    for _ in range(300):
        v, block = rng.randrange(len(vectors)), [rng.randrange(cr.SYMBOLS) for _ in range(cr.BLOCK)]
        at = vectors[v]
        for symbol in reversed(block):
            at = cr._before(symbol, at)
        code = sum(s * cr.SYMBOLS**k for k, s in enumerate(block))
        assert at == tuple(c + many_by[v, code] for c in vectors[many[v, code]])


def test_a_conversation_of_a_third_of_all_rows_is_spread(table):
    rows = [(7, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(3000)] + [(100 + t, 0, "user", "Hi.") for t in range(6000)]
    frame = cr.mark_faults(cr.damage(table(rows)))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("at")]
    sizes = [r["count"] for r in frame.repartitionByRange(8, *order).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * sum(sizes) / len(sizes)
