import random

import numpy as np
import pyarrow as pa

from corpuscle.llm import minhash
from corpuscle.llm.components import components


def shingles(text):
    ws = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} or ({tuple(ws)} if ws else set())


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            x = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * x >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    rank = [-(2**63) if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rank[i]), rank[i])
    out = []
    for i, (d, _) in enumerate(rows):
        c = least[find(i)] if sets[i] else rank[i]
        out.append((d, len(sets[i]), None if c == -(2**63) else c, c == rank[i]))
    return sorted(out, key=repr)


def test_equals_brute_force(documents):
    rng = random.Random(3)
    draw = lambda n: [rng.choice("abcdefghijklmnop") + str(rng.randrange(40)) for _ in range(n)]
    rows, i = [], 0
    for _ in range(25):
        base = draw(rng.choice([3, 6, 8, 12, 40, 120]))
        for _ in range(rng.randrange(1, 9)):
            ws = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) * len(ws) // 60 + rng.randrange(2)):
                ws[rng.randrange(len(ws))] = draw(1)[0]
            rows.append(((i * 37) % 501, rng.choice([" ", "\n\t"]).join(ws).upper() if rng.random() < 0.2 else " ".join(ws)))
            i += 1
    hub = draw(300)  # copies like the hub, but less like each other
    for k in range(12):
        ws = list(hub)
        for j in range(7):
            ws[(k * 7 + j) * 3 % 300] = f"x{k}-{j}"
        rows.append((600 + k, " ".join(ws)))
    rows += [(700, " ".join(hub)), rows[0], rows[0], (None, rows[1][1]), (None, None), (5000, ""), (5001, " \n "), (5002, "One"), (5003, "one")]
    mine = sorted((tuple(r)[1:5] for r in minhash.near_duplicates(documents(rows)).collect()), key=repr)
    assert mine == brute(rows)


def test_one_row_of_each_component_stays(documents):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(3, long), (3, long), (None, long + " x"), (5, "other text of five words here"), (6, ""), (7, ""), (None, None)]
    left = minhash.deduplicated(documents(rows)).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in left), key=repr) == sorted([(0, long + " x"), (5, rows[3][1]), (6, ""), (7, ""), (0, None)], key=repr)


def test_densified_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for size in (4, 30, 400):
        hits = []
        for _ in range(40):
            whole = rng.integers(0, 2**63, size, dtype=np.uint64)
            code = minhash.signatures([np.sort(whole), np.sort(whole[: size * 3 // 4])], 128)
            hits.append((code[0] == code[1]).mean())
        assert abs(np.mean(hits) - 0.75) < 0.06


def test_shingle_sets_of_short_texts():
    sets = minhash.shingle_sets(pa.array(["a b", "A  B", "", "a b c d e f"]))
    assert [len(s) for s in sets] == [1, 1, 0, 2] and sets[0] == sets[1]


def test_components_of_a_long_path(spark):
    path = spark.range(200).selectExpr("(id * 7919) % 200 a", "((id + 1) * 7919) % 200 b").where("a != b")
    assert components(path).select("label").distinct().count() == 1


def test_empty_table(documents):
    assert minhash.near_duplicates(documents([(1, "a")]).where("false")).count() == 0


def test_sketches_rule_out_no_link():
    """The bound is never below the intersection, and is missing where a count does not fit."""
    rng = np.random.default_rng(4)
    for size in (1, 20, 150, 3000):
        base = rng.integers(0, 2**63, size, dtype=np.uint64)
        for keep in (0.3, 0.8, 1.0):
            other = np.unique(np.concatenate([base[: int(size * keep)], rng.integers(0, 2**63, size // 5 + 1, dtype=np.uint64)]))
            one, two = minhash._sketch(np.unique(base)), minhash._sketch(other)
            assert np.minimum(one.astype(int), two).sum() >= len(np.intersect1d(base, other))
    assert minhash._sketch(rng.integers(0, 2**63, 128 * 128, dtype=np.uint64)) is None
