import random

import pytest

from tessera.llm import tokenizer as K

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def pair():
    reference = tokenizers.Tokenizer.from_file(f"{K.VOCABULARY_DIR}/byte_bpe_50k.json")
    reference.encode_special_tokens = True
    return K.Encoder(K.rank_bytes("byte_bpe_50k")), reference


def test_equal_to_the_merge_loop(pair):
    mine, reference = pair
    rng = random.Random(1)
    texts = ["", " ", "\n\n x", "<|endoftext|>", "a" * 3000, " " * 700, "ab" * 900, "字" * 400, "กขค" * 90, "é​﻿", "it's 12,345.6 we'll", "😀" * 40]
    texts += ["".join(rng.choice("thean ding\nxyz") for _ in range(200)) for _ in range(300)]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x4E00, 0x9FFF), rng.randrange(0x10000, 0x1F000)])) for _ in range(80)) for _ in range(200)]
    for text in texts:
        assert mine.encode(text) == reference.encode(text, add_special_tokens=False).ids, text[:50]


def test_other_vocabulary_round_trip(spark):
    texts = [(1, "Märkte、市場 and ตลาด"), (2, ""), (3, None), (4, "x" * 2000), (4, "x" * 2000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumnRenamed("doc_id", "k")
    ids = K.encode_corpus(df, "k", "text", vocabulary="byte_bpe_multi_50k")
    assert ids.columns == ["k", "ids"]
    assert sorted((r.k, r.text) for r in K.decode_corpus(ids, "k", vocabulary="byte_bpe_multi_50k").collect()) == sorted((k, t or "") for k, t in texts)


def test_null_empty_and_empty_table(spark):
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "a b", "z")], "doc_id long, text string, ids string")
    assert {r.doc_id: list(r.ids) for r in K.encode_corpus(df).collect()} == {1: [], 2: [], 3: [64, 275]}
    assert K.encode_corpus(df.limit(0)).count() == 0
