import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import suffix_arrays


def brute(rows, width):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - width + 1):
            if seen[t[i : i + width]] > 1:
                gone[i : i + width] = [True] * width
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((doc_id, len(t), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def sample(seed, width):
    rng = random.Random(seed)
    draw = lambda n: "".join(rng.choice("ab" if seed % 2 else "abcdefghij é") for _ in range(n))
    passages = [draw(width + 7 * k) for k in range(6)] + ["z" * (3 * width), "xy" * width, draw(5 * width)]
    rows = []
    for i in range(60):
        text = ""
        for _ in range(rng.randrange(5)):
            p = rng.choice(passages)
            a = rng.randrange(6)
            text += draw(rng.randrange(2 * width)) + p[a : len(p) - rng.randrange(6)]
        rows.append((i, text))
    return rows + rows[:3] + [(None, rows[4][1]), (None, None), (99, ""), (100, "q" * (width - 1))]


@pytest.mark.parametrize("seed,width,shard", [(0, 60, 1 << 20), (1, 60, 1 << 20), (2, 400, 1 << 20), (3, 45, 400), (4, 60, 300)])
def test_equals_brute_force(documents, seed, width, shard):
    """Small shards split the passages of frequent keys, so that merging is at work."""
    rows = sample(seed, width)
    mine = sorted((tuple(r) for r in suffix_arrays.remove_repeats(documents(rows), width, shard).collect()), key=repr)
    assert mine == brute(rows, width)


def test_one_byte_text_over_several_pieces():
    text = np.frombuffer(b"a" * 3000, np.uint8)
    first, n, key, _ = suffix_arrays.file_windows(text, 400, np.arange(3000) <= 2600)
    assert n.sum() == 2601 and len(set(key.tolist())) == 1


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(5)
    for letters in (1, 2, 20):
        buf = rng.integers(1, 1 + letters, 500).astype(np.uint8)
        whole = buf.tobytes()
        order, place = suffix_arrays.suffix_order(buf, 1000)
        assert order.tolist() == sorted(range(500), key=lambda i: whole[i:])
        share = suffix_arrays.common_prefixes(buf, order, place, np.array([0, 200]), np.array([200, 300]), 60)
        for r in range(1, 500):
            a, b = whole[order[r] :], whole[order[r - 1] :]
            expect = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            # Zero bytes follow the end, so a lane may run into them
            assert share[order[r]] == min(60, expect) or min(len(a), len(b)) <= expect


def marks(passages, width):
    """Windows marked as occurring twice, and the windows that lead their equals, each as found and as counted."""
    of, off, twice, again = suffix_arrays.repeated_windows(passages, width)
    window = [passages[p][o : o + width] for p, o in zip(of, off)]
    seen = Counter(window)
    return twice.tolist(), sorted(w for w, a in zip(window, again) if not a), [seen[w] > 1 for w in window], sorted(seen)


def test_passages_that_go_on_alike_into_the_next():
    """Two suffixes agree over 112 bytes, twice the width, and their successors are parted by the byte after it."""
    rng = random.Random(7)
    draw = lambda n: bytes(rng.choice(b"mnopqrst") for _ in range(n))
    s, t = draw(61), draw(50)
    near = s[1:41] + b"a" * 16
    found, leads, counted, each = marks([b"x" + s, t + b"z" * 6, b"y" + s, t + b"a" * 6, near], 55)
    assert found == counted and leads == each


def test_zero_bytes_at_the_ends_of_passages():
    rng = random.Random(8)
    for _ in range(40):
        draw = lambda n: bytes(rng.choice(b"\0\0\0a") for _ in range(n))
        found, leads, counted, each = marks(list({draw(rng.randrange(8, 13)): 0 for _ in range(12)}), 8)
        assert found == counted and leads == each


def test_texts_with_zero_characters(documents):
    """Windows that are equal only across the end of a passage count for nothing, and hide none that are."""
    rng = random.Random(9)
    rows = [(i, "".join(rng.choice(["\0" * 30, "\0" * 7 + "a", "b\0"]) for _ in range(12))) for i in range(60)]
    mine = sorted((tuple(r) for r in suffix_arrays.remove_repeats(documents(rows), 45, 400).collect()), key=repr)
    assert mine == brute(rows, 45)


def test_empty_table(documents):
    assert suffix_arrays.remove_repeats(documents([(1, "a")]).where("false")).count() == 0
