import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpuscle.llm import katz


def tokens(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [None]


def brute(rows, head):
    train = [tokens(t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    c = Counter(w for ws in train for w in ws)
    n, v = sum(c.values()), len(c)
    few = lambda counts: np.array([sum(x == r for x in counts.values()) for r in range(katz.DISCOUNTED + 2)])
    factor = katz.discounts(few(c))
    cut = lambda x, f: x * (f[x] if x <= katz.DISCOUNTED else 1)
    mass = sum(cut(x, factor) for x in c.values())
    total = n if mass < n else n + 1
    unknown = 1 - mass / total if n else 1
    level = lambda x: math.floor(math.log(x) * katz.BINS)
    by_level, at, least = Counter(map(level, c.values())), 0, 10**9
    for k in sorted(by_level, reverse=True):
        if at + by_level[k] > head:
            break
        at, least = at + by_level[k], k
    known = {w for w, x in c.items() if level(x) >= least or w is None}
    of = lambda w: w if w in known else "<other>"
    one = {w: cut(c[w], factor) / total for w in known}
    one["<other>"] = max(1 - sum(one.values()), unknown)
    pairs = Counter(p for ws in train for p in zip(["<start>"] + [of(w) for w in ws[:-1]], [of(w) for w in ws]))
    pf = katz.discounts(few(pairs))
    follow = {}
    for (h, w), x in pairs.items():
        follow.setdefault(h, {})[w] = x

    def p(h, w):
        seen = follow.get(h)
        if not seen:
            return one[w]
        size = sum(seen.values())
        freed = sum(x - cut(x, pf) for x in seen.values())
        kept = 1.0 if freed > 0 else size / (size + 1)
        left = 1 - kept * (size - freed) / size
        rest = 1 - sum(one[s] for s in seen)
        if rest <= 1e-9:
            kept = kept / (1 - left)
        if w in seen:
            return cut(seen[w], pf) * kept / size
        return left / rest * one[w]

    for h in list(follow)[:20]:
        assert abs(sum(p(h, w) for w in one) - 1) < 1e-9
    out = []
    for d, t in rows:
        ws = tokens(t)
        score = 0.0
        for h, w in zip(["<start>"] + ws[:-1], ws):
            share = 1 if w in known else (cut(c[w], factor) / total if c[w] else unknown) / one["<other>"]
            score += math.log10(p(of(h) if h != "<start>" else h, of(w)) * share)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)
        held = zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
        out.append((d, held, len(ws), sum(c[w] > 0 for w in ws), n, base, score))
    return out


@pytest.mark.parametrize("head,chunk", [(1000, 3_000_000), (12, 40), (0, 200)])
def test_equals_brute_force(documents, head, chunk):
    rng = random.Random(head)
    vocabulary = [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))].title() for _ in range(n))
    rows = [(i, draw(rng.choice([0, 1, 4, 30, 90]))) for i in range(70)] + [(None, "w1 W2"), (None, None), (3, "ü \n new"), (2, "one"), (2, "one")]
    mine = sorted(map(tuple, katz.scored(documents(rows), head, chunk_tokens=chunk).collect()), key=repr)
    for a, b in zip(mine, sorted(brute(rows, head), key=repr), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_tells_every_training_word_apart(documents):
    """More words than 65,000, once the most that pairs told apart."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(70_000)] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 1000 : i * 1000 + 1000])) for i in range(140)] + [(2, "w1 w2 new w3 w4")]
    assert len({w for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2 for w in t.split()}) > 65_000
    mine = sorted(map(tuple, katz.scored(documents(rows)).collect()), key=repr)
    for a, b in zip(mine, sorted(brute(rows, 10**9), key=repr), strict=True):
        assert a[:5] == b[:5] and np.allclose(a[5:], b[5:], rtol=1e-9)


def test_nothing_to_learn_from(documents):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = katz.scored(documents([(held, "a b")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows] == [(3, 0, 0, 0.0, 0.0)]
    assert katz.scored(documents([(1, "a")]).where("false")).count() == 0


def test_packing():
    x = np.array([3, 3, 900, 2**40, 2**63], np.uint64)
    assert katz.unpack_sorted(katz.pack_sorted(x)).tolist() == x.tolist() and katz.unpack(katz.pack(x)).tolist() == x.tolist()
