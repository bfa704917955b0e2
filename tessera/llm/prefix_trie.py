"""Prefix trie of conversations from vertical bitmaps.

Two conversations share a node of depth d when their first d turns are equal.
The index is vertical: a (position, turn) pair is a posting, and each shard of
conversations keeps one bitset of its conversations per posting.  A node's
children are the intersections of its bitset with the postings of the next
position; a depth-first walk of these gives every node of the shard with its
popcount, its smallest member and the list of conversations that end there.

* A **shard** is a range of conversation ids with at most ``CONVS``
  conversations and about ``ROWS`` turns.  Longer conversations are cut into
  blocks of ``BLOCK`` turns, and a shard holds one block; so no task holds a
  whole long conversation, and a prefix shared by very many conversations is
  one popcount a shard.
* A **node key** is the exclusive or of the 128-bit hashes of its (position,
  turn) pairs.  It is a running sum, so a block starts from the sum of the
  blocks before, and shards meet by key.  Two different prefixes among n share
  a key with a chance of about n^2 / 2^129.
* **Subtree sums**: a node's weight is placed at its smallest member, whose
  shard holds all of the node's ancestors.  There, sums over preorder ranges
  give each shard's part of every subtree sum, and parts add up by key.
* **End lists** come out of each shard in order of id, and shards are ranges of
  ids, so the digest of a node's end list reads a piece a shard, in order.

Defined results: a null role or text is empty; turns are ordered by turn (null
first), then role, then text, so ties and repeated rows have one order and all
count.  Rows with a null id name no conversation and are left out.  An empty
table gives no node, not even a root, since a node has members.  Only the four
named columns are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import beside, prepare, stored

#: Conversations and (about) turns of a shard, and turns of a block.
CONVS, ROWS, BLOCK = 4096, 65536, 16384
#: A node with more children than this is joined to them apart from the rest.
BUSY = 64
#: conv_id modulus of the base conversation, and the modulus of shared turns.
BASE, SHARED = 100, 6


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn's content; lengths keep role and text apart."""
    return F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))


def ordered_turns(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                  text: str = "text") -> DataFrame:
    """(conv_id, place, digest, chars): the rows in one global order of
    (conv_id, turn, role, text), numbered without gaps.

    The order is a range shuffle, so a conversation of any length is spread
    over tasks; texts stay behind it."""
    def empty(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    src = turns.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        empty(role).alias("role"), empty(text).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    rows = stored(src.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "conv_id", F.monotonically_increasing_id().alias("at"), turn_digest(F.col("role"), F.col("text")).alias("digest"),
        F.char_length("text").cast("long").alias("chars")), "turns")
    part, low = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    # one row per range partition
    sizes = rows.groupBy(part.alias("part")).agg((F.max(low) + 1).alias("n"))
    before = sizes.select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return rows.join(F.broadcast(before), part == F.col("of")).select(
        "conv_id", (F.col("before") + low).alias("place"), "digest", "chars")


def rebuild(ordered: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars, n_turns): every conversation c as the
    first h turns of conversation c - c % 100 (all if fewer, none if it is
    absent) and its own turns after its first h, h = crc32(c) % 6.  A
    conversation without any turn left has one row, with pos -1."""
    ids = ordered.groupBy("conv_id").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("own"))
    ids = ids.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % SHARED,
                           "base_id": F.col("conv_id") - F.col("conv_id") % BASE})
    ids = stored(ids, "ids")
    heads = (ordered.filter(F.col("conv_id") % BASE == 0)
             .join(ids.select(F.col("conv_id").alias("of"), "start"), F.col("conv_id") == F.col("of"))
             .filter(F.col("place") - F.col("start") < SHARED)
             .groupBy(F.col("conv_id").alias("head_id"))       # at most SHARED rows each
             .agg(F.array_sort(F.collect_list(F.struct("place", "digest", "chars"))).alias("head")))
    ids = ids.join(heads, F.col("base_id") == F.col("head_id"), "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array().cast(heads.schema["head"].dataType)), F.lit(1), F.col("h").cast("int")))
    ids = ids.withColumns({"shift": F.size("head").cast("long")}).withColumn(
        "n_turns", F.col("shift") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    ids = stored(ids.select("conv_id", "start", "h", "head", "shift", "n_turns"), "rebuilt_ids")
    own = (ordered.join(ids.select(F.col("conv_id").alias("of"), "start", "h", "shift", "n_turns"),
                        F.col("conv_id") == F.col("of"))
           .withColumn("pos", F.col("place") - F.col("start") - F.col("h")).filter(F.col("pos") >= 0)
           .select("conv_id", (F.col("pos") + F.col("shift")).alias("pos"), "digest", "chars", "n_turns"))
    shared = ids.select("conv_id", "n_turns", F.posexplode("head").alias("pos", "t")).select(
        "conv_id", F.col("pos").cast("long").alias("pos"), "t.digest", "t.chars", "n_turns")
    none = ids.filter("n_turns = 0").select(
        "conv_id", F.lit(-1).cast("long").alias("pos"), F.lit("").alias("digest"), F.lit(0).cast("long").alias("chars"), "n_turns")
    return own.unionByName(shared).unionByName(none)


_LOCAL = ("block long, first long, pre long, size long, hi long, lo long, up_hi long, up_lo long, depth long, "
          "n long, least long, chars long, ends string, on array<long>")


class Shard:
    """Vertical bitmaps of one shard: conversations are bits, numbered in
    order of their ids."""

    def __init__(self, block: int, first: int, block_turns: int):
        self.block, self.first, self.start = block, first, block * block_turns
        self.ids: list[int] = []
        self.turns: list[int] = []            # n_turns of a conversation
        self.rows: list[list] = []            # postings of a conversation in order
        self.roots: dict = defaultdict(int)   # key at the block's start -> bitset
        self.postings: dict = defaultdict(int)
        self.count = 0

    def add(self, conv: int, pos: int, hi: int, lo: int, chars: int, n_turns: int, root: tuple) -> None:
        if not self.ids or self.ids[-1] != conv:
            self.ids.append(conv)
            self.turns.append(n_turns)
            self.rows.append([])
            self.roots[root] |= 1 << len(self.ids) - 1
        if pos >= 0:
            self.rows[-1].append((hi, lo, chars))
            self.postings[hi, lo] |= 1 << len(self.ids) - 1   # the hash holds the position
        self.count += 1

    def walk(self) -> dict[str, list]:
        """Depth-first intersections: the shard's nodes in preorder.  The
        roots of later blocks are nodes of the block before and only stand
        for themselves here (pre -1)."""
        out = {c.split()[0]: [] for c in _LOCAL.split(", ")}
        parents: list[int] = []
        stack = [(0, r[0], r[1], None, bits, -1, 0) for r, bits in sorted(self.roots.items(), reverse=True)]
        while stack:
            off, hi, lo, up, bits, parent, chars = stack.pop()
            depth = self.start + off
            members = self._members(bits)
            ends = [self.ids[i] for i in members if self.turns[i] <= depth]
            at = parent
            if up is not None or self.start == 0:
                at = len(parents)
                parents.append(parent)
                going = [self.ids[i] for i in members if self.turns[i] > depth and len(self.rows[i]) == off]
                for k, v in (("block", self.block), ("first", self.first), ("pre", at), ("size", 1), ("hi", hi),
                             ("lo", lo), ("up_hi", up and up[0]), ("up_lo", up and up[1]), ("depth", depth),
                             ("n", len(members)), ("least", self.ids[members[0]]), ("chars", chars),
                             ("ends", ",".join(map(str, ends)) if ends else None), ("on", going or None)):
                    out[k].append(v)
            for i in members:
                if bits >> i & 1 and len(self.rows[i]) > off:
                    a, b, c = self.rows[i][off]
                    child = bits & self.postings[a, b]
                    bits &= ~child
                    stack.append((off + 1, hi ^ a, lo ^ b, (hi, lo), child, at, c))
        size = out["size"]
        for i in range(len(parents) - 1, -1, -1):
            if parents[i] >= 0:
                size[parents[i]] += size[i]
        return out

    @staticmethod
    def _members(bits: int) -> list[int]:
        if bits & bits - 1 == 0:
            return [bits.bit_length() - 1]
        raw = np.frombuffer(bits.to_bytes(bits.bit_length() + 7 >> 3, "little"), np.uint8)
        return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def local_nodes(seqs: DataFrame, convs: int = CONVS, rows: int = ROWS, block_turns: int = BLOCK) -> DataFrame:
    """The nodes of every shard, from sequences (conv_id, pos, digest, chars,
    n_turns); written below spark.checkpoint.dir."""
    block = F.greatest(F.floor(F.col("pos") / block_turns), F.lit(0)).cast("long")
    src = seqs.select("conv_id", block.alias("block"), "pos", "chars", "n_turns",
                      F.xxhash64("pos", "digest").alias("hi"), F.xxhash64(F.lit(1), "digest", "pos").alias("lo"))
    zero = F.lit(0).cast("long")
    cut = src.filter(F.col("n_turns") > block_turns)
    if cut.isEmpty():
        src = src.withColumns({"root_hi": zero, "root_lo": zero})
    else:
        # a row per block; a conversation's blocks are a running exclusive or
        sums = cut.groupBy("conv_id", "block").agg(F.bit_xor("hi").alias("a"), F.bit_xor("lo").alias("b"))
        w = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        starts = sums.select(F.col("conv_id").alias("of"), F.col("block").alias("at"),
                             F.bit_xor("a").over(w).alias("root_hi"), F.bit_xor("b").over(w).alias("root_lo"))
        src = beside(src, stored(starts.filter("at > 0"), "block_starts"),
                     (F.col("conv_id") == F.col("of")) & (F.col("block") == F.col("at")))
        src = src.withColumns({c: F.coalesce(c, zero) for c in ("root_hi", "root_lo")})
    order = ["block", "conv_id", "pos"]
    src = (src.select("block", "conv_id", "pos", "hi", "lo", "chars", "n_turns", "root_hi", "root_lo")
           .repartitionByRange("block", "conv_id").sortWithinPartitions(*order))

    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else
                         pa.list_(pa.int64()) if c.endswith(">") else pa.int64()) for c in _LOCAL.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            for b, c, pos, hi, lo, chars, n, rh, rl in zip(*(x.to_pylist() for x in batch.columns)):
                if shard is None or b != shard.block or c != shard.ids[-1] and (
                        len(shard.ids) >= convs or shard.count >= rows):
                    if shard is not None:
                        yield pa.RecordBatch.from_pydict(shard.walk(), schema)
                    shard = Shard(b, c, block_turns)
                shard.add(c, pos, hi, lo, chars, n, (rh, rl))
        if shard is not None:
            yield pa.RecordBatch.from_pydict(shard.walk(), schema)

    return stored(src.mapInArrow(run, _LOCAL), "local_nodes")


def end_digests(local: DataFrame) -> DataFrame:
    """(hi, lo, ends_sha256) of the nodes where conversations end.  The list
    of a node is hashed a shard's piece at a time, so a list of any length
    takes the memory of one piece."""
    pieces = local.filter("ends is not null").select("hi", "lo", "first", "ends").repartition(
        "hi", "lo").sortWithinPartitions("hi", "lo", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            done = []
            for hi, lo, _, ends in zip(*(x.to_pylist() for x in batch.columns)):
                if (hi, lo) != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (hi, lo), hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if done:
                yield _rows(done)
        if key is not None:
            yield _rows([(*key, digest.hexdigest())])

    def _rows(done):
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done]) for i in range(3)], names=["hi", "lo", "ends_sha256"])

    return pieces.mapInArrow(run, "hi long, lo long, ends_sha256 string")


def subtree_sums(local: DataFrame, weights: DataFrame) -> DataFrame:
    """(hi, lo, n_leaves, saved_tokens): for every node the sums of leaf and
    saved over its subtree.  ``weights`` (block, first, pre, conv_id, leaf,
    saved) stand at one shard's node each."""
    kept = stored(weights.filter("leaf > 0 or saved > 0"), "weights")
    extra = kept.select("block", "first", "pre", "leaf", "saved")
    through = local.filter("on is not null").select("block", "first", "pre", F.explode("on").alias("conv"))
    if not through.isEmpty():
        # what a conversation's later blocks hold stands at its block's last node
        later = kept.join(through.select(F.col("conv").alias("conv_id")).distinct(), "conv_id", "left_semi")
        totals = later.groupBy("conv_id", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        # every block of such a conversation is a row, also one without weight
        spine = through.select(F.col("conv").alias("conv_id"), "block").unionByName(totals.select("conv_id", "block")).distinct()
        w = Window.partitionBy("conv_id").orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carry = spine.join(totals, ["conv_id", "block"], "left").select(
            F.col("conv_id").alias("conv"), "block", F.sum("leaf").over(w).alias("leaf"), F.sum("saved").over(w).alias("saved"))
        extra = extra.unionByName(through.join(carry.filter("leaf > 0 or saved > 0"), ["conv", "block"])
                                  .select("block", "first", "pre", "leaf", "saved"))
    nodes = local.select("block", "first", "pre", "size", "hi", "lo", F.lit(0).cast("long").alias("leaf"),
                         F.lit(0).cast("long").alias("saved"))
    null = F.lit(None).cast("long")
    both = nodes.unionByName(extra.select("block", "first", "pre", null.alias("size"), null.alias("hi"),
                                          null.alias("lo"), "leaf", "saved"))
    both = both.repartition("block", "first").sortWithinPartitions("block", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            unit = np.stack([t["block"].to_numpy(), t["first"].to_numpy()])
            cuts = np.flatnonzero((unit[:, 1:] != unit[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist()):
                yield _sums(t.slice(a, b - a))
            rest = t.slice(cuts[-1]) if len(cuts) else t
        if rest is not None:
            yield _sums(rest)

    def _sums(t: pa.Table) -> pa.RecordBatch:
        node = t.filter(t["size"].is_valid())
        pre = t["pre"].to_numpy()
        total = np.zeros((2, node.num_rows + 1), np.int64)
        for i, c in enumerate(("leaf", "saved")):
            np.add.at(total[i], pre + 1, t[c].to_numpy())
        total = np.cumsum(total, axis=1)
        at, size = node["pre"].to_numpy(), node["size"].to_numpy()
        got = total[:, at + size] - total[:, at]
        some = got.any(axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(x[some]) for x in (node["hi"].to_numpy(), node["lo"].to_numpy(), got[0], got[1])],
            names=["hi", "lo", "leaf", "saved"])

    parts = both.mapInArrow(run, "hi long, lo long, leaf long, saved long")
    return parts.groupBy("hi", "lo").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def nodes(seqs: DataFrame, convs: int = CONVS, rows: int = ROWS, block_turns: int = BLOCK) -> DataFrame:
    """The trie of sequences (conv_id, pos, digest, chars, n_turns): per node
    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  The last turn of a node is turn
    ``depth`` of conversation ``conv_id``."""
    prepare(seqs.sparkSession)
    local = local_nodes(seqs, convs, rows, block_turns)
    key = ["hi", "lo"]
    merged = stored(local.groupBy(*key).agg(
        F.min(F.struct("least", "block", "first", "pre")).alias("at"), F.sum("n").alias("n_convs"),
        F.min("depth").alias("depth"), F.min("up_hi").alias("up_hi"), F.min("up_lo").alias("up_lo"),
        F.max("chars").alias("chars")), "nodes")
    below = merged.filter("depth > 0").groupBy(F.col("up_hi").alias("hi"), F.col("up_lo").alias("lo")).agg(
        F.count(F.lit(1)).alias("n_children"))
    full = stored(merged.join(below, key, "left").select(
        *key, "up_hi", "up_lo", "at.*", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")).withColumnRenamed("least", "conv_id"), "full_nodes")
    sums = subtree_sums(local, full.select("block", "first", "pre", "conv_id",
                                           (F.col("n_children") == 0).cast("long").alias("leaf"), "saved"))
    up = full.select(F.col("hi").alias("u_hi"), F.col("lo").alias("u_lo"), F.col("conv_id").alias("parent"), "n_children")
    busy = stored(up.filter(F.col("n_children") > BUSY).drop("n_children"), "busy")
    under = (F.col("up_hi") == F.col("u_hi")) & (F.col("up_lo") == F.col("u_lo"))
    found = beside(full, busy, under).drop("u_hi", "u_lo").withColumnRenamed("parent", "busy_parent")
    # only parents with few children are left, so no key of this join is hot
    few = up.filter((F.col("n_children") <= BUSY) & (F.col("n_children") > 0)).drop("n_children")
    alone = F.col("busy_parent").isNull() & (F.col("depth") > 0)
    found = found.filter(~alone).withColumnRenamed("busy_parent", "parent_conv_id").unionByName(
        found.filter(alone).join(few, under).drop("busy_parent", "u_hi", "u_lo").withColumnRenamed("parent", "parent_conv_id"))
    empty = hashlib.sha256().hexdigest()
    return (found.join(sums, key, "left").join(end_digests(local), key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256")))


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations (see ``rebuild``)."""
    prepare(conversations.sparkSession)
    return nodes(rebuild(ordered_turns(conversations)))
