import itertools

import numpy as np
from pyspark.sql import functions as F
from tessera.llm import chat


def rows():
    out = []
    for c in range(24):
        out += [(c, 0, "system", "be brief")] if c % 3 == 0 else []
        for t in range(1, 2 + c % 5):
            out.append((c, t, "user" if t % 2 else "assistant",
                        f"is it {t}?\nsecond line" if t % 2 else f"it is {t}\n\n- a\n- b"))
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x") for r in data],
                                 "conv_id long, turn long, role string, text string, states string")


def brute_path(model, parts):
    e = np.vstack([model.scores(p) for p in parts])
    best, arg = -np.inf, None
    for path in itertools.product(range(chat.K), repeat=len(e)):
        p = model.start[path[0]] + e[0, path[0]]
        for t in range(1, len(e)):
            p += model.move[path[t - 1], path[t]] + e[t, path[t]]
        if p > best:
            best, arg = p, path
    return best, list(arg)


def test_roles_are_recovered_and_rendered(spark):
    got = chat.format_conversations(frame(spark, rows())).collect()
    assert sum(r["n_lines"] for r in got) == sum(r["n_agree"] for r in got)
    first = next(r for r in got if r["conv_id"] == 0)
    assert first["text"] == "<|system|>\nbe brief\n<|end|>\n<|user|>\nis it 1?\nsecond line"
    assert all(r["n_turns"] == r["true_turns"] for r in got)


def test_viterbi_equals_all_paths(spark):
    model = chat.train(chat.segments(chat.as_transcripts(frame(spark, rows()))))
    for lines in (["User: hi", "", "yes it is", "A: no"], ["what?", "- x"], [""]):
        best, path = brute_path(model, [lines])
        got = chat.viterbi(model, lines)
        e = model.scores(lines)
        p = model.start[got[0]] + e[0, got[0]] + sum(
            model.move[a, b] + e[t + 1, b] for t, (a, b) in enumerate(zip(got, got[1:])))
        assert np.isclose(p, best)


def test_segments_chain_to_the_best_path(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 2)
    seg = chat.segments(chat.as_transcripts(frame(spark, [r for r in rows() if r[0] in (0, 4, 8)])))
    model = chat.train(seg)
    texts = seg.select("conv_id", "segment", F.array_join(F.transform("turns", lambda t: t["text"]), "\n").alias("text"))
    by = {}
    for r in sorted(chat.parse(texts, model).collect(), key=lambda r: (r["conv_id"], r["segment"])):
        by.setdefault(r["conv_id"], []).append(r)
    for parts in by.values():
        lines = [p["text"].split("\n") for p in parts]
        e = np.vstack([model.scores(x) for x in lines])
        v, back = model.start + e[0], []
        for row in e[1:]:
            reach = v[:, None] + model.move
            back.append(reach.argmax(0))
            v = reach.max(0) + row
        path = [int(v.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert [s for p in parts for s in p["states"]] == path[::-1]


def test_nulls_ties_and_empty_table(spark):
    data = [(None, 0, "user", "hi"), (None, None, None, None), (1, 0, "USER", ""), (1, 0, "user", "same"),
            (1, 0, "user", "same"), (2, 5, "stranger", "x" * 100000)]
    got = chat.format_conversations(frame(spark, data)).collect()
    assert sum(r["true_turns"] for r in got) == len(data)
    assert chat.format_conversations(frame(spark, []).filter("false")).count() == 0


def test_segments_are_bounded_whatever_the_turn_numbers(spark, monkeypatch):
    monkeypatch.setattr(chat, "TURNS", 10)
    monkeypatch.setattr(chat, "BYTES", 1000)
    data = [(None, 0, "user", f"text {i % 40}") for i in range(95)] + [(None, None, "user", "same")] * 45
    data += [(1, 3, "assistant", f"{i} " + "x" * 400) for i in range(12)] + [(2, t, "user", "hi") for t in range(8)]
    by = {}
    for r in chat.segments(frame(spark, data)).orderBy("conv_id", "segment").collect():
        assert len(r["turns"]) <= 10 and sum(len(t["text"]) for t in r["turns"][:-1]) <= 1000
        by.setdefault(r["conv_id"], []).extend((t["role"], t["text"]) for t in r["turns"])
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])
    assert by == {c: [(r[2], r[3]) for r in sorted((x for x in data if x[0] == c), key=key)] for c in (None, 1, 2)}
