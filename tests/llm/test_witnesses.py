import hashlib
import random
import zlib

import pytest

from corpuscle.llm import witnesses


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """All levels, from the leaves to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def climb(levels, at, node):
    siblings = []
    for level in levels[:-1]:
        run = level[at - at % 8 : at - at % 8 + 8]
        siblings += run[: at % 8] + run[at % 8 + 1 :]
        run[at % 8] = node
        node, at = sha("".join(run)), at // 8
    return siblings, node


def plain(rows):
    """``doc_id, text, lang, source`` to sorted result rows."""
    by_lang = {}
    for doc_id, text, lang, source in rows:
        n_chars = len(text or "")
        leaf = plain_leaf([doc_id, source, lang, n_chars, text])
        low = None if text is None else "".join(c.lower() if c.isascii() else c for c in text)
        changed = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
        by_lang.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, plain_leaf([doc_id, source, lang, n_chars, low]) if changed else leaf))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = [plain_tree([r[2] for r in sorted(by_lang[x])]) for x in langs]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, x in enumerate(langs):
        for at, (known, doc_id, leaf, folded) in enumerate(sorted(by_lang[x])):
            below, node = climb(trees[k], at, folded)
            above, node = climb(top, k, node)
            out.append((doc_id if known else None, leaf, trees[k][-1][0], top[-1][0], sha("".join(below + above)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def result(docs, levels=4):
    got = witnesses.verified(witnesses.manifest(docs, levels))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("levels", [1, 4])
def test_every_row_against_plain_trees(documents, levels):
    rng = random.Random(4)
    rows = [(i * 7 % 5003, f"Text {i} É" if i % 9 else "plain", rng.choice(["en"] * 8 + [f"l{k}" for k in range(9)]), "s") for i in range(900)]
    rows += [(None, None, None, None), (None, "", None, "s"), (3, "a", "en", None), (3, "A", "en", None), (3, "A", "en", None), (8, "x" * 3_000_000, "zz", "s")]
    got = result(documents(rows), levels)
    assert got == plain(rows)
    assert {r[-1] for r in got} == {True, False}


def test_lone_leaf_and_empty_table(documents):
    one = [(4, "Only", "en", "s")]
    assert result(documents(one)) == plain(one)
    assert result(documents(one).where("false")) == []


def test_columns_with_clashing_names(spark, documents):
    rows = [(1, "B", "en", "s"), (2, "b", "fr", "t")]
    docs = documents(rows)
    for name in ("at", "n", "node", "leaf", "root", "tree", "block", "witness", "changed", "lang_at", "langs", "_part", "_salt", "a.b"):
        docs = docs.withColumn(name, docs["key"])
    assert result(docs) == plain(rows)


def test_witness_extends_as_siblings_complete():
    nodes = [hashlib.sha256(bytes([k])).digest() for k in range(70)]
    block = witnesses.Appender(witnesses.height(70))
    for k, node in enumerate(nodes):
        block.append(node)
        assert len(block.witnesses[0]) == 32 * (0 if k < 7 else 7 if k < 63 else 14)
    root = block.finish()
    assert root.hex() == plain_tree([n.hex() for n in nodes])[-1][0]
    for k, node in enumerate(nodes):
        assert witnesses.fold(node, k, 70, bytes(block.witnesses[k])) == (root, len(block.witnesses[k]))
        assert witnesses.fold(nodes[k - 1], k, 70, bytes(block.witnesses[k]))[0] != root
