import hashlib
import random

import pytest
import sentencepiece

from cadastra.llm.piece_codec import Codec, encode_decode, model_path

PARTS = [
    "a", "b", "▁", " ", "  ", "\n", "\t", "é", "日", "𝕏", "\x00", "the", "ing", " the", "THE", "0", "1", "www", "__", "́", "🙂", "==", "/", " " * 5, " " * 40, "ſ", "<s>", "<0x0A>", "�",
]


@pytest.fixture(scope="module")
def both():
    return Codec(model_path()), sentencepiece.SentencePieceProcessor(model_file=model_path())


def test_encodes_as_the_library(both):
    mine, theirs = both
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14)))
        ids = theirs.encode(text)
        assert mine.encode(text) == ids, repr(text)
        assert mine.encode_text(text) == ",".join(map(str, ids)), repr(text)
        assert mine.decode(ids) == mine.decode_text(mine.encode_text(text)) == theirs.decode(ids), repr(text)


def test_long_words_and_texts(both):
    mine, theirs = both
    rnd = random.Random(2)
    for text in ["ab" * 5000, "".join(rnd.choice("thesingo") for _ in range(20_000)), "word " * 10_000, "日本" * 3000]:
        assert mine.encode(text) == theirs.encode(text)


def test_any_ids_decode_as_the_library(both):
    mine, theirs = both
    rnd = random.Random(3)
    for i in range(1500):
        ids = [rnd.randrange(32_000 if i % 2 else 300) for _ in range(rnd.randint(0, 9))]
        assert mine.decode(ids) == theirs.decode(ids), ids


def test_rows(docs, both):
    _, theirs = both
    rows = [(1, "a b"), (2, None), (3, ""), (1, "a b"), (None, " x\n")]
    got = encode_decode(docs(rows), model_path(), ids=True).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "a b", None: " x\n"}.get(r.doc_id, "")
        ids = theirs.encode(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids).encode()).hexdigest()
    assert encode_decode(docs([]), model_path()).count() == 0
