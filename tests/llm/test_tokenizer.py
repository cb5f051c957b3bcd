import random

import pytest
import tiktoken

from statloom.llm.tokenizer import PATTERN, default_vocabulary, encoder, load_ranks, merge_word, token_count, token_ids


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(default_vocabulary()), special_tokens={})


def test_single_words(reference):
    ranks = load_ranks(default_vocabulary())
    for word in ("a", "aa", "가", "법률", "aaaaaaaaaaaaaaaa", "zzzzzqqqqq", "🙂", "́"):
        assert merge_word(word.encode(), ranks) == reference.encode_ordinary(word)


def test_random_texts_against_a_reference(reference):
    import numpy as np

    rng, encode = random.Random(1), encoder(default_vocabulary())
    letters = list("ab1,.'st \t\n\r\x1c\x1f\x85\xa0　가é́🙂-_") + ["  ", "\r\n", "'ll", "<|endoftext|>"]
    for _ in range(20_000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 16)))
        assert np.frombuffer(encode(text), np.int32).tolist() == reference.encode_ordinary(text), repr(text)


def test_columns(spark, reference):
    texts = [None, "", " ", "제1조(목적) this law", "가" * 30_000, "a" * 30_000, "x y " * 30_000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate([*texts, *texts])], "id int, text string, ids string")
    got = df.select("id", token_ids("text").alias("out"), token_count("text").alias("n")).orderBy("id").collect()
    for row, text in zip(got, [*texts, *texts], strict=True):
        assert row.out == (reference.encode_ordinary(text) if text else []) and row.n == len(row.out)
    assert df.limit(0).select(token_ids("text")).count() == 0
