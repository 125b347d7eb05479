import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from corpuscle.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string, part int"
WHITE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_edits(rows):
    """The least ``(cost, audit, repaired lines)`` by trying all edits row by row; rows are ``role, text, fault``."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def better(to, q, cost, audit, lines):
        if q not in to or (cost, audit) < to[q][:2]:
            to[q] = (cost, audit, lines)

    def inserted(have):
        todo = list(have.items())
        for q, (cost, audit, lines) in todo:
            for c in "ua":
                if c in follow[q] and len(audit) - len(audit.rstrip("I")) < 3:
                    todo.append((follow[q][c], (cost + 3, audit + "I", [*lines, names[c] + ":"])))
        return todo

    have = {0: (0, "", [])}
    for role, text, fault in rows:
        then = {}
        for q, (cost, audit, lines) in inserted(have):
            better(then, q, cost + 4, audit + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 * (fault == "truncated")
            if role[:1] and role[0] in follow[q]:
                better(then, follow[q][role[0]], cost + more, audit + "K", [*lines, f"{role}:{text}"])
            for c in "ua":
                if c in follow[q]:
                    better(then, follow[q][c], cost + more + 3, audit + "R", [*lines, f"{names[c]}:{text}"])
        have = then
    end = {}
    for q, found in inserted(have):
        if q in (0, 3):
            better(end, 0, *found)
    return end[0]


def plain(originals, rows):
    by_conv = {c: [] for c, *_ in originals}
    for r in rows:
        by_conv[r[0]].append(r[1:])
    out = []
    for conv, turns in by_conv.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256((f"{len(r[1].encode())}:" + r[1] + r[2]).encode()).digest()))
        seen, faulty = set(), []
        for _, role, text in turns:
            end = text.rstrip(WHITE)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        initials = [r[:1] for r, *_ in faulty]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        known = [t for t, *_ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit, lines = plain_edits(faulty)
        counts = [sum(f == name for *_, f in faulty) for name in ("blank", "duplicate", "truncated")]
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some_rows(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for conv in [None, *range(convs)]:
        for turn in range(rng.randrange(1, longest)):
            role = rng.choice(["user", "assistant"] * 6 + ["system", "tool", "", None, "sys", "änder"])
            text = rng.choice(["Yes.", "No?", "cut", "end. \n", "  ", "", None, "a\x1c", ".", f"t{turn}!", "é. b", "x" * 40])
            rows.append((conv, rng.choice([turn, turn, turn + 1, None if turn % 7 == 0 else turn]), role, text))
    return rows


def test_every_conversation_against_brute_force(spark):
    rows = some_rows(5, 250, 9) + [(900, 1, "user", "Same.")] * 12 + [(901, None, "user", None), (902, -5, "system", "Only s."), (903, 2**40, "user", "y " * 800_000 + ".")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS).repartition(3)
    for name in ("pos", "sha", "codes", "edits", "audit", "salt", "cost", "_conv", "a.b"):
        docs = docs.withColumn(name, docs["part"])
    assert result(repair.repaired(docs, repair.damaged(docs))) == plain(rows, plain_damage(rows))


def test_long_conversations_are_cut_into_segments(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"t{t}.", f"t{t}", "Again."])) for t in range(700)]
    rows += [(2, 5, "user", "Equal.")] * 300 + [(3, 1, "user", "Hi."), (3, 2, "assistant", "Ho.")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert result(repair.repaired(docs, docs.select("conv_id", "turn", "role", "text"))) == plain(rows, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_nothing_left_and_empty_table(spark):
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi.")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], COLUMNS)
    assert result(repair.repaired(docs, repair.damaged(docs))) == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert result(repair.repaired(docs.where("false"), repair.damaged(docs.where("false")))) == []


@pytest.mark.parametrize("cuts", [0, 1, 4])
def test_block_tables_with_any_cuts(cuts):
    """Costs and edits by blocks, over segments, against trying all edits."""
    rng = random.Random(cuts)
    t = repair.tables()
    roles, texts = ["system", "user", "assistant", "tool"], {0: ("Fine.", None), 1: ("", "blank"), 2: ("Fine.", "duplicate"), 3: ("cut", "truncated")}
    for _ in range(400):
        codes = np.array([rng.choice([0, 4, 4, 8, 8, 12]) + rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(rng.randrange(0, 14))], np.uint8)
        cost, audit, _ = plain_edits([(roles[c // 4], *texts[c % 4]) for c in codes])
        edges = sorted({0, len(codes), *(rng.randrange(len(codes) + 1) for _ in range(cuts))})
        pieces = [repair.CLASS[codes[a:b]] for a, b in zip(edges, edges[1:])]
        behind, added = [0], 0
        for p in pieces[::-1]:
            at, total = t.moved(p)
            added += total[behind[-1]]
            behind.append(int(at[behind[-1]]))
        assert added + t.vectors[behind[-1]][0] == cost
        state, edits = 0, ""
        for k, p in enumerate(pieces):
            more, state = t.traced(p, behind[len(pieces) - 1 - k], state, k == len(pieces) - 1)
            edits += more
        assert edits == audit

