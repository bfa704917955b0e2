import hashlib

import numpy as np
import public_tokenizers
import tiktoken
from tessera.llm import bpe
from tessera.llm.catalog import vocabulary

TEXTS = ["", None, "Hello world, it's 2024!", "  two  spaces\n\n\ttabs ", "naïve café ▁ 日本語 🙂🙂", "<|endoftext|>",
         "a" * 5000, "\x00\x01 ÿ", " " * 300, "repeated", "repeated"]


def reference():
    path, pattern = vocabulary()
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_model_ids_are_ranks():
    path, pattern = vocabulary()
    tokens = bpe.read_ranks(path)
    codec = bpe.Codec(bpe.model_bytes(tokens), pattern)
    assert codec.tokens == tokens and codec.unknown == len(tokens)


def test_round_trip_equals_tiktoken(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, ids int")
    enc = reference()
    for r in bpe.round_trip(df, *vocabulary()).collect():
        text = TEXTS[r["doc_id"]] or ""
        ids = enc.encode_ordinary(text)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_encode_then_decode(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = bpe.encode(df, *vocabulary())
    enc = reference()
    assert {r["doc_id"]: r["ids"] for r in rows.collect()} == {
        i: enc.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}
    back = bpe.decode(rows, *vocabulary()).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {i: t or "" for i, t in enumerate(TEXTS)}


def test_other_vocabulary_and_empty_table(spark):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    df = spark.createDataFrame([(1, "Straße und Wörter")], "doc_id long, text string")
    (row,) = bpe.decode(bpe.encode(df, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN).collect()
    assert bytes(row["decoded"]).decode() == "Straße und Wörter"
    assert bpe.round_trip(df.filter("false"), *vocabulary()).count() == 0
