import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from tessera.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string, depth int"


def brute(rows):
    """Nodes by their whole prefix."""
    turns = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return trie(seqs)


def trie(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(int)
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        w = (len(m) - 1) * len(k[-1][1]) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += w
    out = set()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(k))))
        out.add((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k],
                 hashlib.sha256(ends.encode()).hexdigest()))
    return out


def found(df):
    rows = [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"],
             r["saved_tokens"], r["ends_sha256"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_rows(n, seed, texts=3, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in [0, 100, *range(200, 200 + n)]:
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["user", "assistant", None]),
                         rng.choice([None, "", "ü" * 40, *map(str, range(texts))]), 7))
    return rows + rows[:5] + [(None, 1, "user", "no conversation", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt_conversations_equal_brute_force(spark, seed):
    rows = random_rows(120, seed)
    assert found(pt.rebuilt_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


@pytest.mark.parametrize("convs,rows,block", [(4, 1000, 3), (1000, 10, 2), (3, 7, 1000)])
def test_small_shards_and_blocks(spark, convs, rows, block):
    """Any cut into shards and blocks gives the same trie."""
    data = random_rows(60, 5, texts=1, longest=14)
    seqs = pt.rebuild(pt.ordered_turns(spark.createDataFrame(data, SCHEMA)))
    assert found(pt.nodes(seqs, convs, rows, block)) == brute(data)


def test_hot_first_turn_and_long_conversation(spark):
    rows = [(c, 0, "user", "hello", 0) for c in range(3000, 4000)]
    rows += [(c, 1, "assistant", f"answer {c % 300}", 0) for c in range(3000, 4000)]
    rows += [(100, t, "user", f"turn {t}", 0) for t in range(700)]
    df = spark.createDataFrame(rows, SCHEMA)
    seqs = pt.rebuild(pt.ordered_turns(df))
    assert found(pt.nodes(seqs, 128, 200, 64)) == brute(rows)


def test_shard_is_cut_by_rows_and_conversations():
    shard = pt.Shard(0, 5, 10)
    for c in (5, 6, 9):
        shard.add(c, 0, 1, 2, 4, 1, (0, 0))
    out = shard.walk()
    assert out["n"] == [3, 3] and out["least"] == [5, 5] and out["ends"] == [None, "5,6,9"]
    assert out["size"] == [2, 1] and len(shard.postings) == 1


def test_empty_table(spark):
    assert pt.rebuilt_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    only_null = spark.createDataFrame([(None, 1, "user", "x", 1)], SCHEMA)
    assert pt.rebuilt_trie(only_null).collect() == []
