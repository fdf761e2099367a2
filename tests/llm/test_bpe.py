"""The encoder against the tokenizers library, id by id."""

import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from vecstrata.llm import bpe
from vecstrata.llm.bpe import TrieEncoder, encode
from vecstrata.llm.queries import queries, word_vocabulary

from brute import sha256

ODD = [
    None, "", " ", "\x1c a\x1db", "İSTANBUL ΣΑΣ ΟΔΟΣ. ΣΑΣ", "a<|endoftext|>B c<|startoftext|><|endoftext|>", "don't we're I'LL it'S '''s", "é ̀x", "日本語テキスト 한국어 ½ ² ٣ 𝒳",
    "  x\x85y z", "a" * 24, "<|endoftext|>", "😀😀 👩‍👩‍👧 ﬁ ﷺ", "ab\x00c", "x" * 3000, "á" * 50, "Mixed CASE and 1234567",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def own():
    return TrieEncoder(word_vocabulary())


def agree(own, library, texts):
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert own.decode(ids).decode() == library.decode(want, skip_special_tokens=False), text


def test_odd_texts(own, library):
    agree(own, library, ODD)


def test_random_texts(own, library):
    rng = random.Random(1)
    parts = ["a", "b", "th", "e", "in", "g", " ", "'s", "É", "é", "!", "##", "1", "ß", "\n", "Σ", "ñ", "的", "́", "<|endoftext|>", "er", "on", "S"]
    agree(own, library, ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(1500)])


def test_any_ids_are_decoded(own, library):
    rng = random.Random(3)
    size = library.get_vocab_size()
    lists = [[rng.randrange(size) for _ in range(rng.randint(0, 60))] for _ in range(300)] + [sorted(own.special.values()), [size + 5, 3, size], list(range(size))]
    for ids in lists:
        assert own.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids, skip_special_tokens=False)


def test_decoding_of_rows(spark, own):
    from vecstrata.llm.bpe import decode

    rows = spark.createDataFrame([(1, "Some words <|endoftext|> here", 0), (1, "Some words <|endoftext|> here", 0), (None, "x", 1), (2, None, 2)], "doc_id bigint, text string, decoded int")
    made = encode(rows, word_vocabulary())
    back = decode(made, word_vocabulary())
    assert sorted(back.collect(), key=str) == sorted(made.select("doc_id", "decoded").collect(), key=str)
    assert decode(made.withColumn("ids", made.ids.substr(1, 0)), word_vocabulary()).where("decoded = ''").count() == 4
    assert decode(made.limit(0), word_vocabulary()).count() == 0


def test_words_are_encoded_as_by_definition(own):
    rng = random.Random(2)
    words = {"".join(rng.choice("aabcdeinorst") for _ in range(rng.randint(1, 14))).encode() for _ in range(800)} | {b"a" * n for n in range(1, 30)}
    letter = {b: own.inner[own.step[0][b]][0][1] for b in range(256)}
    last = {b: own.final[own.step[0][b]][0][1] for b in range(256)}
    for word, ids in own.encode_words(words):
        assert ids == own.merged([letter[b] for b in word[:-1]] + [last[word[-1]]])


def test_memory_is_bounded(own, library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBER_RUNS", 5)
    monkeypatch.setattr(bpe, "REMEMBER_PAIRS", 5)
    fresh = TrieEncoder(word_vocabulary())
    for k in range(6):
        agree(fresh, library, [f"word{k} some other{k} texts that are new {k}"])
        assert len(fresh.ids) <= 12


def test_frame(spark, docs, nothing, library):
    got = {r.doc_id: r for r in encode(docs, word_vocabulary()).collect() if r.doc_id is not None}
    for r in docs.collect():
        if r.doc_id is not None:
            want = library.encode(r.text or "", add_special_tokens=False).ids
            assert got[r.doc_id].n_tokens == len(want) and got[r.doc_id].decoded == library.decode(want, skip_special_tokens=False)
    assert encode(nothing, word_vocabulary()).count() == 0 and encode(docs, word_vocabulary()).count() == docs.count()


def test_query(spark, library):
    import hashlib

    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries()["op5_bpe"](spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == sha256(library.decode(ids, skip_special_tokens=False))


def test_words_beside_and_over_the_levels(own, library, monkeypatch):
    rng = random.Random(4)
    base = "".join(rng.choice("abcdeinorsté") for _ in range(200))
    words = {(base[:n] + tail).encode() for n in (1, 2, 5, 40, 61, 62, 63, 64, 65, 70, 200) for tail in ("", "a", "b", "ing", "é", "\x00")}
    words |= {b"a\x00", b"a", b"a\x00\x00", b"a\x00b"}
    letter = {b: own.inner[own.step[0][b]][0][1] for b in range(256)}
    last = {b: own.final[own.step[0][b]][0][1] for b in range(256)}
    want = [(w, own.merged([letter[b] for b in w[:-1]] + [last[w[-1]]])) for w in sorted(words)]
    assert list(own.encode_words(words)) == want
    assert list(own.encode_words([])) == []
    for levels, some, cut in ((64, 7, 3), (1, 1 << 15, 1), (3, 2, 1 << 14)):
        monkeypatch.setattr(bpe, "LEVELS", levels)
        monkeypatch.setattr(bpe, "WORDS", some)
        monkeypatch.setattr(bpe, "CUT", cut)
        assert list(own.encode_words(words)) == want
        own.forget()
        agree(own, library, ODD)


def test_pairs_share_slots(library, monkeypatch):
    monkeypatch.setattr(bpe, "PAIR_BITS", 2)
    rng = random.Random(5)
    fresh = TrieEncoder(word_vocabulary())
    agree(fresh, library, [" ".join("".join(rng.choice("aeinrstdlo") for _ in range(rng.randint(1, 20))) for _ in range(30)) for _ in range(100)])


def test_work_does_not_grow_by_calls_per_letter(own):
    """Calls from Python for 20,000 new words of eight and more letters, under eight a word."""
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["the", "ing", "at", "er", "ó", "x"]) for _ in range(8)) for _ in range(100)) for _ in range(200)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    own.forget()
    before = sys.getprofile()
    sys.setprofile(count)
    try:
        made = list(own.encode_batch(texts))
    finally:
        sys.setprofile(before)
    assert len(made) == 200 and calls < 8 * 20_000


def test_rows_are_decoded_from_ids(own):
    import pyarrow as pa

    made = pa.array([*own.encode_batch(["one text", None, "", "<|endoftext|> other"])], pa.binary())
    for rows in (made, made.slice(1), made.slice(2, 1), made.slice(0, 0)):
        assert own.decode_batch(rows).to_pylist() == [own.decode(x).decode() for x in rows.to_pylist()]
