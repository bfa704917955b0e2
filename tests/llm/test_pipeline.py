import random

import __spark_entry__ as E
import corpus_pipeline
from tessera.llm import bpe, pii, quality, simhash
from tessera.llm.catalog import vocabulary


def make():
    rng = random.Random(3)
    vocab = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(200)]
    rows = []
    for i in range(80):
        t = " ".join(rng.choice(vocab) for _ in range(90))
        if i % 9 == 0:
            t += f" write to person{i}@mail.example.org"
        rows.append((i, t, "en", f"s{i % 3}", len(t)))
    rows += [(100 + i, r[1], *r[2:]) for i, r in enumerate(rows[:10])]
    return rows + [(200, "too short", "en", "s0", 9), (201, None, None, None, None), (202, "", "en", "s1", 0)]


def test_stages_take_effect_and_keep_columns(spark, docs_schema):
    docs = spark.createDataFrame(make(), docs_schema)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "personal_data", "source_mixture", "token_ids"]
    kept = stages["quality_rules"](spark, docs, "").cache()
    want = {r["doc_id"] for r in quality.quality_figures(docs).collect() if r["kept"]}
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == want
    one = stages["near_duplicates"](spark, kept, "").cache()
    groups = simhash.near_duplicates(kept).collect()
    assert one.columns == docs.columns
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({r["component_id"] for r in groups})
    clean = stages["personal_data"](spark, one, "").cache()
    assert clean.columns == docs.columns and clean.count() == one.count()
    assert not any("@" in r["text"] for r in clean.collect()) and any("<EMAIL>" in r["text"] for r in clean.collect())
    assert all(r["n_chars"] == len(r["text"]) for r in clean.collect())
    assert sum(r["n_email"] for r in pii.report(clean).collect()) == 0
    mixed = stages["source_mixture"](spark, clean, "").cache()
    assert mixed.columns == docs.columns
    assert {r["text"] for r in mixed.collect()} <= {r["text"] for r in clean.collect()}
    ids = stages["token_ids"](spark, mixed, "")
    codec = bpe.Codec(bpe.model_bytes(bpe.read_ranks(vocabulary()[0])), vocabulary()[1])
    text = {r["doc_id"]: r["text"] for r in clean.collect()}
    rows = ids.collect()
    assert len(rows) == mixed.count()
    for r in rows:
        assert b"".join(codec.tokens[i] for i in r["ids"]).decode() == text[r["doc_id"]]


def test_run_over_test_tables(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "source", "ids"] and out.count() > 0


def test_empty_documents(spark, docs_schema):
    docs = spark.createDataFrame([], docs_schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = set(E.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
