import random

import pytest
from tokenizers import Tokenizer

from editrail.llm.tokenize import TOKENIZERS, encode_documents, encoder_of, vocabulary


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_random_texts_equal_the_library(reference):
    encode = encoder_of(vocabulary()).encode
    rng = random.Random(3)
    alphabet = "ab e\n\t\r 19.,'s😀é\x1c\x85\xa0  漢字ﬁ-_ABCdefth<|endoftext|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50))) for _ in range(3000)]
    texts += ["a" * 3000, "." * 2000, " " * 2000, "x" + " " * 99 + "y", "\n\n  \n a", "<|endoftext|>", " a", "a "]
    assert [s for s in texts if encode(s) != reference(s)] == []


def test_pieces_equal_the_plain_merges():
    e = encoder_of(vocabulary())
    rng = random.Random(5)
    for _ in range(1500):
        data = bytes(rng.choice(b"abcdeinrst\xc3\xa9\xff") for _ in range(rng.randint(1, 40)))
        assert e.piece(data) == e.merged(data)


def test_documents(spark, reference):
    texts = [None, "", " ", "The Committee directs.", "héllo\r\nworld", "word " * 20000]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(3, texts[3], "again"), (None, "nul", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = [tuple(r) for r in encode_documents(df).collect()]
    assert sorted(got, key=str) == sorted([(i, reference(t) if t else []) for i, t, _ in rows], key=str)
    assert encode_documents(df.where("false")).count() == 0
