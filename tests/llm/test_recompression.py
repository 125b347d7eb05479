import hashlib
import random
import re

import pytest

from corpuscle.llm import recompression

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, width):
    first, words = {}, [WORD.findall(t or "") for _, t in rows]
    rank = [-(2**63) if d is None else d for d, _ in rows]
    for d, ws in zip(rank, words):
        for i in range(len(ws) - width + 1):
            k = tuple(ws[i : i + width])
            first[k] = min(first.get(k, d), d)
    out = []
    for (doc_id, _), d, ws in zip(rows, rank, words):
        gone = set()
        for i in range(len(ws) - width + 1):
            if first[tuple(ws[i : i + width])] < d:
                gone |= set(range(i, i + width))
        kept = " ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((doc_id, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, width):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3 if seed % 2 else 60)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [draw(width + k) for k in range(8)] + [["a"] * (3 * width), ["a", "b"] * width, draw(4 * width)]
    rows = []
    for i in range(60):
        ws = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.3:
                p[rng.randrange(len(p))] = "edit"
            a = rng.randrange(3)
            ws += draw(rng.randrange(9)) + p[a : len(p) - rng.randrange(3)]
        rows.append((rng.randrange(50), rng.choice([" ", "\n", " \t "]).join(ws)))
    rows += rows[:4] + [(None, rows[5][1]), (None, None), (7, ""), (8, " \n"), (9, "ünï " * width)]
    return rows


@pytest.mark.parametrize("seed,width", [(0, 12), (1, 12), (2, 50), (3, 50), (4, 7)])
def test_equals_brute_force(documents, seed, width):
    rows = sample(seed, width)
    mine = sorted((tuple(r) for r in recompression.remove_repeats(documents(rows), width).collect()), key=repr)
    assert mine == brute(rows, width)


def test_empty_table(documents):
    assert recompression.remove_repeats(documents([(1, "a")]).where("false")).count() == 0
