import random
from collections import Counter, defaultdict

from corpuscle.llm import language


def grams(text):
    out, word = [], []
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word.append(ord(c))
            continue
        if word:
            w = [0, *word, 0]
            out += [("1", x) for x in word]
            out += [("2", a, b) for a, b in zip(w, w[1:])]
            out += [("0", a, b, c) for a, b, c in zip(w, w[1:], w[2:])]
        word = []
    return out


def profile(counts):
    """Three letters come before one, one before two, as their codes do; then by code point."""
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:300]


def test_equals_brute_force(spark):
    rng = random.Random(7)
    letters = {"aa": "abcde", "bb": "cdefgé", "cc": "xyzab"}
    rows = []
    for i in range(90):
        lang = rng.choice(list(letters))
        words = ["".join(rng.choice(letters[lang]) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(1, 40))]
        rows.append((i, rng.choice([" ", "-", "1, "]).join(words).title(), lang))
    rows += [(90, None, "aa"), (91, "12 !", "bb"), (92, "abc", None), (None, "xyz", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [r for r in rows if r[0] is None or r[0] % 2]
    counts = defaultdict(Counter)
    for _, text, lang in learned:
        if text is not None and lang is not None:
            counts[lang].update(grams(text))
    place = {lang: {g: k for k, g in enumerate(profile(c))} for lang, c in counts.items()}
    want = {}
    for doc_id, text, _ in rows:
        own = profile(Counter(grams(text)))
        off = {lang: sum(abs(p[g] - k) if g in p else 300 for k, g in enumerate(own)) for lang, p in place.items()}
        best = min(sorted(off), key=off.get)
        want[doc_id] = (best, round(1 - off[best] / (300 * len(own)), 9)) if own else ("und", 0.0)
    got = language.identified(docs.select("doc_id", "text"), docs.where("doc_id is null or doc_id % 2 = 1")).collect()
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in got} == want
