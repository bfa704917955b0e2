import hashlib
import os
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tessera.llm import token_align as ta
from tessera.session import table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
SCHEMA = "doc_id long, text string, a int, row string"
TEXTS = ["", None, " ", "Hello world, it's 2024!", "  two  spaces\n\n\ttabs ", "naïve café 日本語 🙂🙂", "mark ▁ inside",
         "<|endoftext|> and </s> <0x41>", "a" * 3000, "\x00\x01 ÿ", " " * 300, "repeated words", "repeated words", "x"]


@pytest.fixture(scope="module")
def voc():
    return ta.vocabularies(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"),
                           public_tokenizers.PATTERN)


def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def brute(texts, voc):
    """Figures by byte ranges, with the libraries' own encoders."""
    t, sp = tokenizers()
    rows, counts = [], Counter()
    for text in texts:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if b"".join(voc.a[i] for i in a) != whole or b"".join(voc.b[i] for i in b) != whole:
            rows.append(None)
            continue
        spans = []
        for ids, v in ((a, voc.a), (b, voc.b)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(v[i]), i))
                at += len(v[i])
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(i) for s, f, i in side if at <= s and f <= e) for side in spans))
            at = e
        counts.update(links)
        rows.append((len(a), len(b), len(ends), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    out = []
    for r in rows:
        if r is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
        else:
            out.append((*r[:3], len(r[3]), sum(counts[p] == best[p[1]] for p in r[3]), sum(counts[p] for p in r[3]), r[4]))
    return out


def found(df):
    return [(r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
            for r in df.collect()]


@pytest.mark.parametrize("most", [ta.SLICE, 7])
def test_equals_brute_force(spark, voc, most):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("abc dé, \n.1tion", k=rng.randint(1, 60))) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], SCHEMA)
    if most == 7:      # many slices of the table of pairs
        texts = texts[:12]
        df = df.filter("doc_id < 12")
    got = {r["doc_id"]: r for r in ta.align(df, voc, most if most > 7 else 60).collect()}
    want = brute(texts, voc)
    for i, w in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"]) == w, texts[i]
    assert len(got) == len(texts) and want[6][0] == 0 and want[3][0] > 0


def test_documents_equal_the_libraries(spark, voc):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    texts = [r["text"] for r in docs.select("text").collect()]
    assert sorted(found(ta.align(docs, voc))) == sorted(brute(texts, voc))


def test_gallop_and_places_equal_binary_search():
    rng = np.random.default_rng(1)
    for n, m in ((1, 1), (10, 1000), (1000, 1000), (5000, 300)):
        long = np.unique(rng.integers(0, 10 * m, m))
        short = np.unique(np.minimum(rng.integers(0, 10 * m, n), long[-1]))
        got = ta.places(short, long, np.zeros(len(short), np.int64))
        assert (got == np.searchsorted(long, short)).all()


def test_alignment_is_the_same_for_any_cut_into_texts(voc):
    encode_a, encode_b = voc.encoders()
    texts = ["one two", "", "three fourfive", "x", "nineteen ninety-nine"]
    a = [np.array(encode_a(" " + t) if t else [], voc.dtype).tobytes() for t in texts]
    b = [np.array(x if t else [], voc.dtype).tobytes() for t, x in zip(texts, encode_b(texts))]
    sizes = [np.array([len(t) for t in v]) for v in (voc.a, voc.b)]
    whole = ta.Alignment(a, b, voc.dtype, *sizes)
    parts = [ta.Alignment([x], [y], voc.dtype, *sizes) for x, y in zip(a, b)]
    n = len(voc.b)
    assert sorted(whole.codes(n).tolist()) == sorted(c for p in parts for c in p.codes(n).tolist())
    assert whole.cut_a.tolist() == [c for p in parts for c in p.cut_a.tolist()]


def test_group_ends_and_repeated_rows(spark, voc):
    df = spark.createDataFrame([(1, "some words", 1, ""), (1, "some words", 1, ""), (None, None, 1, "")], SCHEMA)
    ids = ta.encoded(df, voc)
    rows = ta.aligned(ids, voc).collect()
    assert len({r["row"] for r in rows}) == 3
    for r in rows:
        assert len(r["a_ends"]) == len(r["b_ends"]) and (r["doc_id"] is None) == (not r["a_ends"])
    got = ta.align(df, voc).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["1", "1", "None"]
    assert {r["count_sum"] for r in got if r["doc_id"]} == {2 * r["n_links"] for r in got if r["doc_id"]}


def test_empty_table(spark, voc):
    assert ta.align(spark.createDataFrame([], SCHEMA), voc).collect() == []


def test_vocabulary_bytes(voc):
    assert voc.a[:3] == [b"!", b'"', b"#"] and voc.dtype == "<u2" and len(set(voc.a)) == len(voc.a)
    assert sorted(ta.byte_alphabet().values()) == list(range(256))


@pytest.mark.parametrize("text", [" " * 300000, "x" + "\n \t" * 100000 + "y", "a" * 300000, "ab1 " * 50000, "." * 100000])
def test_very_long_texts(voc, text):
    encode_a, encode_b = voc.encoders()
    whole = (" " + text).encode()
    assert b"".join(voc.a[i] for i in encode_a(" " + text)) == whole
    assert b"".join(voc.b[i] for i in encode_b([text])[0]) == whole


def test_long_white_space_is_encoded_as_by_the_library(voc):
    encode_a, _ = voc.encoders()
    t, _ = tokenizers()
    for text in (" x" + " " * 1500 + "y z", "\n" * 2000 + "it's", " " * 1001):
        assert encode_a(text) == t.encode(text, add_special_tokens=False).ids
