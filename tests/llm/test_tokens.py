import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from trellis.llm import packing, token_counts, tokens

WORD, BYTE = (public_tokenizers.path(f) for f in ("word_bpe_49k.json", "byte_bpe_50k.json"))
HOSTILE = [None, "", " ", "a", "<|endoftext|>", "x<|startoftext|>y", "It's we'll I'M 'RE", "café naïve Åİı ſ", "你好 नमस्ते \U0001f600", "a\x00b\x85c\xa0d e", "12345 6.7%", "w" * 3000, "   \n\n\t x  y ", "  two  words ", "\x1c\x1d\x1e\x1f a"]
LATIN = "".join(chr(a) + " " + chr(a) + "b a" + chr(a) + "1\n" for a in range(0x250))


@pytest.fixture(scope="module")
def word():
    return Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def byte():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def counter():
    spec = tokens.read(WORD)
    return tokens.WordCounter(spec, tokens.whole_words(spec))


@pytest.fixture(scope="module")
def encoder():
    spec = tokens.read(BYTE)
    ranked = tokens.ranks(spec)
    assert ranked is not None
    return tokens.ByteIds(spec, ranked)


def test_whole_words_are_one_token_each(word):
    whole = tokens.whole_words(tokens.read(WORD))
    assert len(whole) > 30_000
    assert all(len(e.ids) == 1 for e in word.encode_batch(whole, add_special_tokens=False))


def test_counts_and_ids_are_the_librarys(documents, word, byte, counter, encoder):
    texts = [r.text for r in documents.select("text").limit(60).collect()] + HOSTILE + [LATIN]
    for t in texts:
        t = t or ""
        assert counter.count(t) == len(word.encode(t, add_special_tokens=False).ids)
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(max_codepoint=0x24F), max_size=60))
def test_any_latin_text(word, byte, counter, encoder, t):
    assert counter.count(t) == len(word.encode(t, add_special_tokens=False).ids)
    assert np.frombuffer(encoder.encode(t), "<u4").tolist() == byte.encode(t, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=8), st.sampled_from(["the", "“Hello", "world”", "—", "你好吗", "it’s", "ΣΑΣ'", "é", "e\u0301", " ", "\u0301x", "\u2028", "\u3000", "<|endoftext|>", "x<|startoftext|>", "İı", "'S", "’s"])), max_size=12), st.sampled_from([" ", "", "\n", "  ", "\u00a0", "\t\r"]))
def test_any_text(word, counter, pieces, by):
    t = by.join(pieces)
    assert counter.count(t) == len(word.encode(t, add_special_tokens=False).ids)


def test_only_odd_words_go_to_the_library(counter, monkeypatch, word):
    t = "“quoted” words,\tplain ones\nand Ωμέγα " * 3000 + "尾"
    sent = []
    monkeypatch.setattr(counter, "_odd", lambda chunks: sent.extend(chunks) or len(chunks))
    counter.count(t)
    assert {*sent} == {"Ωμέγα"}


def test_letters_far_and_marks(counter, word):
    import re

    found = [chr(c) for c in range(0x400, 0xD800) if re.match(f"[{tokens.FAR_LETTERS}{tokens.MARKS}]", chr(c))]
    assert len(found) > 30_000
    for a in range(0, len(found), 50):
        t = " ".join(f"{c} a{c}b {c}1{c}'s {c.upper()}" for c in found[a : a + 50])
        assert counter.count(t) == len(word.encode(t, add_special_tokens=False).ids)


def test_parts_do_not_change_counts(counter, word):
    text = "some words, and 'more' of them; " * 60
    assert "".join(tokens.parts(text, 50)) == text
    assert sum(map(counter.count, tokens.parts(text, 50))) == len(word.encode(text, add_special_tokens=False).ids)


def test_token_counts_rows(spark, word):
    rows = [*enumerate(HOSTILE), (None, "null id"), (3, "a"), (3, "a")]
    got = token_counts.token_counts(spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, n_tokens int"), WORD, limit=5)
    want = [(i, len((t or "").encode()), n := len(word.encode(t or "", add_special_tokens=False).ids), n > 5) for i, t in rows]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0


# --- packing
def check_packed(rows, capacity):
    at = {}
    for r in rows:
        at.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in at.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(at)


def test_packing_round_trip(spark, byte):
    docs = [*enumerate(HOSTILE), (100, "many words here " * 900), (100, "many words here " * 900), (None, "no id")]
    df = spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id long, text string, piece string")
    cut = packing.pieces(df, BYTE, with_ids=True)
    made = sorted(cut.collect(), key=lambda r: (str(r.doc_id), r.start))
    want = {str(i): byte.encode(t or "", add_special_tokens=False).ids + [2] for i, t in docs}
    for i, ids in want.items():
        mine = [r for r in made if str(r.doc_id) == i]
        assert sorted({r.start for r in mine}) == packing.bounds(len(ids), 1024)[:-1]
        assert all(r.ids == ids[r.start : r.start + r.length] and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in mine)
    packed = packing.pack(packing.pieces(df, BYTE)).collect()
    assert len(packed) == len(made)
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in made)
    check_packed(packed, 1024)
    assert packing.packed_documents(spark.createDataFrame([], "doc_id long, text string"), BYTE).count() == 0


def test_packing_is_dense(spark, documents):
    rows = packing.packed_documents(documents, BYTE).collect()
    n = check_packed(rows, 1024)
    least = -(-sum(r.length for r in rows) // 1024)
    large = sum(1 for r in rows if 2 * r.length > 1024)  # no two of these fit together
    assert n <= 1.05 * max(least, large) + 1


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=12))
def test_plan_places_every_piece(counts):
    made, placed = packing.plan(counts, 30), dict.fromkeys(counts, 0)
    for n, runs in made:
        assert n > 0 and sum(a * b for a, b in runs) <= 30
        assert sum(b for a, b in runs if 3 * a > 30) <= 2
        for length, each in runs:
            placed[length] += n * each
    assert placed == counts
    assert sum(n for n, _ in made) <= 1.7 * -(-sum(a * b for a, b in counts.items()) // 30) + 1
