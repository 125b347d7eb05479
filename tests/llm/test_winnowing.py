import hashlib
import random
import re

import xxhash

from corpuscle.llm import winnowing as W


def marks(text):
    piece = re.findall(W.PIECE, text or "")
    value = []
    for i in range(len(piece) - W.GRAM + 1):
        h = 42
        for p in piece[i : i + W.GRAM]:
            h = xxhash.xxh64_intdigest(p.encode(), h)
        value.append((h >> 32, i))
    if not value:
        return [(xxhash.xxh64_intdigest(" ".join(piece).encode(), 42) >> 32, 0)] if piece else []
    out = []
    for j in range(max(1, len(value) - W.WINDOW + 1)):
        least = min(value[j : j + W.WINDOW], key=lambda v: (v[0], -v[1]))
        if least not in out:
            out.append(least)
    return out


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def sample():
    rng = random.Random(4)
    draw = lambda n: " ".join(rng.choice(["a", "of", "the", "übergroß", "x" * 40, "n\n", "é🎉"]) for _ in range(n))
    rows = [(i * 5 % 83, draw(rng.choice([0, 1, 2, 3, 5, 8, 9, 30, 200]))) for i in range(60)]
    return rows + [(200, "a a a a a a a a a a a a a a a a"), (201, None), (202, " \n"), (203, "z" * 500)] + rows[:2]


def test_equals_brute_force(documents):
    rows = sample()
    last = {}
    ordered = sorted(set(rows), key=lambda r: -r[0])
    assert len({r[0] for r in ordered}) == len(ordered)
    mine = W.compared(documents(rows)).collect()
    assert len(mine) == len(rows)
    following = {d: ordered[(k + 1) % len(ordered)][1] or "" for k, (d, _) in enumerate(ordered)}
    texts = {d: t or "" for d, t in rows}
    repeated = {d for d, _ in rows[:2]}
    for r in mine:
        text, third = texts[r.doc_id], len(texts[r.doc_id]) // 3
        assert r.n_chars == len(text)
        if r.doc_id in repeated:
            continue  # one of two equal rows has the other as its next
        edited = text[: len(text) - third] + following[r.doc_id][:third]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert abs(r.near_edited - like(marks(text), marks(edited))) < 1e-12
        assert abs(r.near_next - like(marks(text), marks(following[r.doc_id]))) < 1e-12
        last.setdefault(tuple(marks(text)), set()).add(r.fingerprint)
        last.setdefault(tuple(marks(edited)), set()).add(r.edited_fingerprint)
    assert all(len(prints) == 1 for prints in last.values())


def test_positions_and_rightmost_ties(documents):
    rows = {r.doc_id: r.fingerprint for r in W.winnowed(documents(sample())).collect()}
    for d, text in sample():
        assert [tuple(p) for p in rows[d]] == marks(text)


def test_one_row_and_none(documents):
    alone = W.compared(documents([(None, "a b c d e f g h i j k")])).first()
    assert alone.near_next == 1.0
    assert W.compared(documents([(1, "a")]).where("false")).count() == 0
