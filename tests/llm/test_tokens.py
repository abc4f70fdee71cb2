"""Token ids as the library gives them, exact round trips, damage, hard rows."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from spoor.llm import tokens
from tests.llm.test_text import thue_morse

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def wanted(rows, end_id=2):
    """rows of (doc_id, text) -> [(doc_id, start, n_tokens, crc)]"""
    library = Tokenizer.from_file(VOCABULARY)
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out, start = [], 0
    for (i, _), e in zip(rows, library.encode_batch([t or "" for _, t in rows], add_special_tokens=False)):
        ids = np.array([*e.ids, end_id], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return sorted(out, key=lambda r: r[1])


def got(df):
    return sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect()), key=lambda r: r[1])


def test_given_documents(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokens, "ROWS", 150)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokens.write_tokens(docs, f"{tmp_path}/t", VOCABULARY, 2, lanes=20)
    assert got(tokens.read_tokens(spark, f"{tmp_path}/t")) == wanted([(r.doc_id, r.text) for r in docs.collect()])


def test_hard_rows(spark, tmp_path):
    rows = [(3, None), (1, ""), (2, " \n"), (9, "don't STOP.it's<|endoftext|>x <|ENDOFTEXT|> 12a.b,c!'s (é.́x) a b　c"), (7, "日本 " * 9000),
            (None, "x"), (None, "y"), (-(1 << 63), "z"), ((1 << 63) - 1, "z"), (4, "é.é ́ . ÀÈ"), (5, "b"), (5, "a"), (6, "w " * 30_000)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, part int")
    tokens.write_tokens(docs, f"{tmp_path}/t", VOCABULARY, 2)
    assert got(tokens.read_tokens(spark, f"{tmp_path}/t")) == wanted(rows)
    tokens.write_tokens(docs.filter("doc_id = 99"), f"{tmp_path}/e", VOCABULARY, 2)
    assert tokens.read_tokens(spark, f"{tmp_path}/e").collect() == []


def test_encoder_is_the_library():
    rng = random.Random(1)
    alphabet = ["a", "B", "é", "é", ".", ",", "'", "s", "ll", "7", " ", "\n", "\t", "<|endoftext|>", "|", "日", " ", "\x1c", "ß", "İ", "!",
                "$", "&&", "_", "-", "#", "\"", "`", "<", ">", "Σ", "ς", "\u0338", "ñ", "/"]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(3000)]
    encoder, data = tokens.WordEncoder(VOCABULARY), [r.encode() for r in rows]
    offsets = np.cumsum([0] + [len(d) for d in data])
    with np.errstate(over="ignore"):
        ids, at = encoder(np.frombuffer(b"".join(data), np.uint8), offsets)
    library = Tokenizer.from_file(VOCABULARY)
    for r, a, b in zip(rows, at[:-1], at[1:]):
        assert ids[a:b].tolist() == library.encode(r, add_special_tokens=False).ids, r


@pytest.mark.parametrize("n,kinds", [(0, 1), (1, 1), (4096, 5), (4097, 60_000), (40_000, 300), (9000, 1), (20_000, 2**31)])
def test_round_trip(n, kinds):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, kinds, n) * rng.integers(0, 2, n)).astype(np.uint32)
    if n > 100:
        ids[n // 2:n // 2 + n // 4] = ids[:n // 4]
    docs, sizes = np.array([0, -(1 << 63)]), np.array([n // 3, n - n // 3])
    raw = tokens.pack_segment(docs, sizes, ids, 1)
    back = tokens.unpack_segment(raw)
    assert (back[0] == docs).all() and (back[1] == sizes).all() and (back[2] == ids).all() and back[3] == 1
    if n >= 4096 and kinds > 1:
        damaged = bytearray(raw)
        damaged[-30] ^= 0x55
        with pytest.raises(ValueError):
            tokens.unpack_segment(bytes(damaged))
    if kinds == 5:
        assert len(raw) < n


def test_words_made_to_collide_in_polynomials():
    encoder, library = tokens.WordEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    for word in thue_morse():
        ids, _ = encoder(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]))
        assert ids.tolist() == library.encode(word, add_special_tokens=False).ids


def test_other_vocabularies_see_whole_texts():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = tokens.WordEncoder(path), Tokenizer.from_file(path)
    assert tokens.WordEncoder(VOCABULARY).by_words and not encoder.by_words
    rows = ["Two  spaces", "two  spaces", "", "A.b\n\nc"]
    data = [r.encode() for r in rows]
    ids, at = encoder(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(d) for d in data]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [library.encode(r, add_special_tokens=False).ids for r in rows]


def test_segments_keep_their_bytes():
    """The codes of ids that the coder had before its tables were laid out anew."""
    n = np.arange(60_000)
    ids = (n * n % 977 * (n // 7 % 3)).astype(np.uint32)
    ids[30_000:40_000] = ids[:10_000]
    packed = [tokens.pack_segment(np.array([1]), np.array([len(x)]), x) for x in (ids, ids * np.uint32(4_000_000))]
    assert [zlib.crc32(raw) for raw in packed] == [2266840183, 1814047354]
    model = tokens._Model(2)
    p2, p1, w2, w1, w0 = model.predict(2)                # empty contexts predict no id and have no weight
    assert (p2 == p1).all() and p2.min() >= 1 << 22 and not w2.any() and not w1.any() and w0.all()


def test_latin_words_take_the_quick_way():
    encoder, library = tokens.WordEncoder(VOCABULARY), Tokenizer.from_file(VOCABULARY)
    rng = random.Random(2)
    letters = [c for c in map(chr, range(256)) if c.isalpha()]
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 14))) for _ in range(2000)]
    words += ["<|endoftext|>", "жук", "ó", "ŸÀ", "ſ", "a" * 3000, *words[:9], "don't", "K"]
    ids, size = encoder._library(words)
    wanted_ids = [library.encode(w, add_special_tokens=False).ids for w in words]
    assert size.tolist() == [len(x) for x in wanted_ids] and ids.tolist() == [i for x in wanted_ids for i in x]
    assert encoder.quick is not None
    assert tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json")).quick is None
