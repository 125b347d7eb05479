import random
import struct
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corpuscle.llm import language, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_language_profiles_on_held_out_documents(spark):
    from corpuscle.llm.query_text import op9_language_id

    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = op9_language_id(spark, sf).join(truth, "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


def test_profile_orders_by_count_then_code():
    grams = language.ngrams("ab ab Ab, 12 b")
    a, b = ord("a") | 1 << 63, ord("b") | 1 << 63
    assert (grams == b).sum() == 4 and (grams == a).sum() == 3
    assert language.profile(grams, 1).tolist() == [b]


def test_undetermined_texts(documents):
    docs = documents([(1, None), (2, "12 !?"), (3, "the cat"), (3, "the cat"), (None, "the"), (5, "")])
    rows = language.identified(docs.select("doc_id", "text", "key"), documents([(9, "the cat sat", "en"), (8, "le chat", None)])).collect()
    assert sorted((r.doc_id or 0, r.lang_pred, r.key) for r in rows) == [(0, "en", 1), (1, "und", 1), (2, "und", 1), (3, "en", 1), (3, "en", 1), (5, "und", 1)]
    nothing = language.identified(docs.select("doc_id", "text"), docs.where("false"))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}


TEXTS = [
    "", " ", "a", " a b", "a  b", "a   b", "a \n b", "tail ", "tail  ", "\n", "it's we'll 12,345.67!?", "<|endoftext|> x", "naïve café ",
    "a  b c", "x\x0b y", "日本語 テキスト", "emoji 🎉🎉 ok", "tab\t tab", "'s 's", "line\n\nline", "w" * 3000, "\x1c z",
]


def test_encoder_equals_library():
    rng = random.Random(2)
    mixed = ["".join(rng.choice([" ", "  ", "\n", "a", "the", "'s", "é", "9", ".", " ", "\t"]) for _ in range(rng.randrange(30))) for _ in range(3000)]
    whole, mine = Tokenizer.from_file(PATH), token_files.Encoder(open(PATH, encoding="utf-8").read())
    for texts in (TEXTS + mixed, ["plain words", "only"], ["two  blanks"]):
        ids, edge = mine.batch(pa.array(texts))
        for k, t in enumerate(texts):
            assert ids[edge[k] : edge[k + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)


def test_encoder_forgets_and_goes_on():
    """Ids stay right when the remembered words run over."""
    whole, small = Tokenizer.from_file(PATH), token_files.Encoder(open(PATH, encoding="utf-8").read(), 50)
    for k in range(12):
        texts = [" ".join(f"word{(k * 7 + i) % 90}" for i in range(30)), "word1 word1", "", f"only{k}"]
        ids, edge = small.batch(pa.array(texts))
        for j, t in enumerate(texts):
            assert ids[edge[j] : edge[j + 1]].tolist() == whole.encode(t, add_special_tokens=False).ids
    assert len(small.known) <= 50


def test_files_round_trip(documents, tmp_path):
    rows = [((i * 31) % 97, t) for i, t in enumerate(TEXTS * 3)] + [(None, "none"), (None, None), (5, "x"), (5, "x")]
    manifest = token_files.write_tokens(documents(rows), PATH, str(tmp_path / "t"))
    got = [tuple(r) for r in token_files.read_tokens(manifest).collect()]
    whole = Tokenizer.from_file(PATH)
    ids = {t: whole.encode(t, add_special_tokens=False).ids + [0] for _, r in enumerate(rows) for t in [r[1] or ""]}
    assert sorted((d, n, c) for d, _, n, c in got if d is not None) == sorted(
        (d, len(ids[t or ""]), zlib.crc32(struct.pack(f"<{len(ids[t or ''])}I", *ids[t or ""]))) for d, t in rows if d is not None
    )
    got.sort(key=lambda r: r[1])
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got[:-1]]).tolist()
    assert [r[0] is None for r in got[:2]] == [True, True] and [r[0] for r in got[2:]] == sorted(r[0] for r in got[2:])
    first = manifest.orderBy("slot").first()
    some = token_files.fetch(first.path, {got[2][0]})
    assert next(iter(some.values()))[-1] == 0
    data = bytearray(open(first.path, "rb").read())
    data[6] ^= 255
    open(first.path, "wb").write(data)
    with pytest.raises(Exception):
        token_files.read_tokens(manifest).collect()


def test_empty_table(documents):
    none = documents([(1, "a")]).where("false")
    assert token_files.read_tokens(token_files.write_tokens(none, PATH)).count() == 0
    assert language.identified(none, none).count() == 0


def test_reading_frees_the_words_of_the_encoder():
    """A worker lives on after the last stage, and so would all words that it remembers."""
    token_files.encoder_of(open(PATH, encoding="utf-8").read())
    assert token_files.encoder_of.cache_info().currsize == 1
    assert list(token_files._read(iter([]))) == []
    assert token_files.encoder_of.cache_info().currsize == 0


def test_ngrams_counted_in_parts_add_up():
    """More text than is counted at once; counts are those of the whole."""
    texts = ["ab ba " * 100_000, "ab", "ba" * 50_000, "ab ba " * 100_000]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["x"] * 4)], names=["text", "lang"])
    parts = list(language._counted(iter([batch])))
    total: dict[int, int] = {}
    for part in parts:
        for gram, n in zip(part.column("gram").to_pylist(), part.column("n").to_pylist()):
            total[gram] = total.get(gram, 0) + n
    code, count = np.unique(language.ngrams("\n".join(texts)), return_counts=True)
    assert len(parts) > 1 and total == dict(zip(code.view(np.int64).tolist(), count.tolist()))


def test_unknown_words_are_encoded_in_long_texts():
    """Few calls of the library, and the ids of each text on its own, whatever white space and marks it holds."""
    encoder = token_files.Encoder(open(PATH, encoding="utf-8").read())
    rng, sizes = random.Random(5), []
    whole = encoder._encoded
    encoder._encoded = lambda texts: sizes.append(len(texts)) or whole(texts)
    plain = [" ".join(f"w{rng.randrange(10**9)}'sĠx" for _ in range(50)) for _ in range(40)]
    odd = ["", " ", "a", " a", "a ", "a  b", "a\n", "b c\n", "\na b", "a \tb", "  x y　", "it's 's", "Ġa Ġ", "x<|endoftext|> y", "\U0001f600 é z"]
    odd += ["".join(rng.choice("ab1' Ġ\n  .é") for _ in range(rng.randrange(20))) for _ in range(500)]
    for texts in (plain, odd, odd + plain):
        del sizes[:]
        ids, edge = encoder.batch(pa.array(texts, pa.string()))
        if texts is plain:
            assert sum(sizes) <= 1 + len(plain)  # one long text, and the first word of each text
        wanted = [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(edge, edge[1:])] == wanted
