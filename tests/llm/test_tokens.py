import os

import pytest
from pyspark.sql import functions as F

from foldmark.llm.tokens import _encoder, token_count, vocabulary_path


def test_counts_whole_texts(spark):
    texts = ["", None, "hello world", "<|endoftext|>", "ä漢\n" * 50, "a" * 50_000, "word " * 20_000]
    encoder = _encoder(vocabulary_path())
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", token_count(F.col("t")).alias("n"))
    got = dict(map(tuple, df.collect()))
    for k, t in enumerate(texts):
        ids = encoder.encode_ordinary(t or "")
        assert got[k] == len(ids) and encoder.decode(ids) == (t or "")


def test_the_path_is_a_parameter(tmp_path):
    name = "byte_bpe_multi_50k.tiktoken"
    os.symlink(vocabulary_path(name=name), tmp_path / name)
    assert vocabulary_path(str(tmp_path), name) == str(tmp_path / name)
    with pytest.raises(Exception):  # noqa: B017
        open(vocabulary_path(str(tmp_path), "no such vocabulary"))
