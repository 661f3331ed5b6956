"""Prefix trie of conversations by a splitter skeleton.

1. Every conversation becomes one path: 16 bytes a turn (a digest of role and text), with the words of each turn's text. Texts
   themselves are not gathered. Digests have a fixed width, so that the byte order of paths keeps each subtree together.
2. Splitters (path, conv_id) from a bounded sample deal the conversations into shards that are contiguous in that order; copies of
   one path are split by conv_id, so that no path is a hot key. A splitter keeps at most ``SPLIT_TURNS`` turns of its path.
3. The splitters are broadcast; together their prefixes are the skeleton: exactly the nodes whose subtrees reach over a shard's edge.
   Each shard is sorted and read as a stream with a stack of open nodes. Nodes off the skeleton are finished there; for skeleton
   nodes it gives partial counts, and the members that end there as small blocks of text in ascending order.
4. Partial counts of a skeleton node are added up; subtree sums run bottom-up over the skeleton, which has at most shards times
   ``SPLIT_TURNS`` nodes whatever the input. Digests of ending members are streams over the sorted blocks, in bounded memory.

Rows: a null role or text is empty, null turns come first, rows with equal turn stand in the order of role and then of the digest of role and
text; repeated rows are turns of their own. Rows with a null conv_id belong to no conversation and are left out. An empty table
gives no rows (not even a root). Other columns are not read. One conversation's path is one row, some 40 bytes a turn, and copies of a
path are split over shards where it has at most ``SPLIT_TURNS`` turns.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeweave.session import written

FAMILY = 20
HEADS = 4
WIDTH = 16
SPLIT_TURNS = 64
#: Sampled paths for each shard, and conversations that a shard should hold at least.
SAMPLED = 16
SHARD_ROWS = 512
MAX_SHARDS = 4096
#: Members in a block of a skeleton node's ends, and rows in a batch.
_BLOCK, _ROWS = 1000, 4000

_NODE = "key binary, up binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string"
_NODE_TYPES = [pa.binary(), pa.binary(), *[pa.int64()] * 8, pa.string()]
_NAMES = [c.split()[0] for c in _NODE.split(", ")]


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, words) of each conversation: its first turns are those of the first conversation of its family."""
    c = conversations
    role, text = F.coalesce(c["role"].cast("string"), F.lit("")), F.coalesce(c["text"].cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.length(role).cast("string"), role, text))
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), F.struct(c["turn"].cast("long").alias("turn"), role.alias("role"), digest.alias("d"), words_in(text).cast("int").alias("w")).alias("t"))
    own = turns.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    own = written(own.select("conv_id", F.transform("ts", lambda t: F.struct(t["d"].alias("d"), t["w"].alias("w"))).alias("ts")), "turns")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.slice("ts", 1, HEADS - 1).alias("lent"))
    h = (F.crc32(F.encode(F.col("conv_id").cast("string"), "utf-8")) % HEADS).cast("int")
    joined = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h).join(heads, "base", "left")
    lent = F.slice(F.coalesce("lent", F.array().cast("array<struct<d:string,w:int>>")), F.lit(1), F.col("h"))
    ts = F.concat(lent, F.slice("ts", F.col("h") + 1, F.greatest(F.size("ts"), F.lit(1))))
    return joined.select("conv_id", ts.alias("ts")).select("conv_id", F.unhex(F.array_join(F.transform("ts", lambda t: t["d"]), "")).alias("path"), F.transform("ts", lambda t: t["w"]).alias("words"))


def splitters(paths: DataFrame, shards: int, turns: int = SPLIT_TURNS) -> list[tuple[bytes, int]]:
    """Ascending (path, conv_id) that cut ``paths`` into at most ``shards`` pieces, from a sample of about ``SAMPLED`` a shard."""
    n = paths.count()
    shards = max(1, min(shards, MAX_SHARDS, n // SHARD_ROWS))
    if shards == 1:
        return []
    every = max(1, n // (SAMPLED * shards))
    cut = F.expr(f"substring(path, 1, {WIDTH * turns})").alias("path")
    rows = paths.where(F.pmod(F.xxhash64("conv_id"), F.lit(every)) == 0).select(cut, "conv_id")
    sample = sorted((bytes(r["path"]), r["conv_id"]) for r in rows.toLocalIterator())
    picked = [sample[len(sample) * i // shards] for i in range(1, shards)] if sample else []
    return sorted(set(picked))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common from their start."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: WIDTH * mid] == b[: WIDTH * mid] else (lo, mid - 1)
    return lo


def _key(path: bytes, depth: int) -> bytes:
    return hashlib.md5(path[: WIDTH * depth]).digest() + depth.to_bytes(8, "big")


class _Open:
    """A node whose subtree is being read. ``first`` is its smallest member: members come by path, so it is not the first one read."""

    __slots__ = ("children", "ends", "first", "leaves", "members", "saved", "words")

    def __init__(self, words: int):
        self.words, self.first, self.members, self.children, self.leaves, self.saved, self.ends = words, None, 0, 0, 0, 0, None


def _shard_task(cuts: list[tuple[bytes, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        stack: list[_Open] = []
        pending: list[list] = []  # closed children of each open node, whose parent's smallest member is not known yet
        last, shard, edge = b"", None, 0

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _NODE_TYPES, strict=True)], names=_NAMES)
            out.clear()
            return rows

        def block(depth: int, node: _Open) -> None:
            """The ids that end at a skeleton node so far, as a row of its own: conv_id is the first of them."""
            out.append((_key(last, depth), None, node.ends[0], depth, None, None, None, None, None, None, ",".join(map(str, node.ends))))
            node.ends = None

        def close(depth: int) -> None:
            node = stack.pop()
            for row in pending.pop():
                out.append((*row[:4], node.first, *row[5:]))
            if depth > edge:
                node.leaves += not node.children
                node.saved += (node.members - 1) * node.words
                digest = (node.ends or hashlib.sha256()).hexdigest()
                row = (None, None, node.first, depth, None, node.members, node.children, node.leaves, node.saved, None, digest)
                up = stack[-1]
                up.children, up.leaves, up.saved = up.children + 1, up.leaves + node.leaves, up.saved + node.saved
                if depth - 1 > edge:
                    pending[-1].append(row)
                else:  # the parent is on the skeleton: its smallest member is joined by its key
                    out.append((None, _key(last, depth - 1), *row[2:]))
            else:
                if node.ends:
                    block(depth, node)
                out.append((_key(last, depth), _key(last, depth - 1) if depth else None, node.first, depth, None, node.members, node.children, node.leaves, node.saved, node.words, None))

        for rows in batches:
            for n, conv, path, words in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
                if n != shard:
                    while stack:
                        close(len(stack) - 1)
                    sides = [cuts[i][0] for i in (n - 1, n) if 0 <= i < len(cuts)]
                    shard, last = n, path
                    stack.append(_Open(0))
                    pending.append([])
                depth, same = len(path) // WIDTH, _shared(path, last)
                while len(stack) - 1 > same:
                    close(len(stack) - 1)
                last = path
                edge = max((_shared(path, s) for s in sides), default=0)
                for d in range(len(stack), depth + 1):
                    stack.append(_Open(words[d - 1]))
                    pending.append([])
                for node in stack:
                    node.members += 1
                    node.first = conv if node.first is None or conv < node.first else node.first
                end = stack[-1]
                if depth > edge:
                    if end.ends is None:
                        end.ends = hashlib.sha256(str(conv).encode())
                    else:
                        end.ends.update(b",%d" % conv)
                else:
                    if end.ends is None:
                        end.ends = []
                    end.ends.append(conv)
                    if len(end.ends) >= _BLOCK:
                        block(depth, end)
                if len(out) >= _ROWS:
                    yield batch()
        while stack:
            close(len(stack) - 1)
        if out:
            yield batch()

    return run


def _digest_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (key, first, ids), sorted, to one digest a key: a running hash, whatever the number of blocks."""
    now, h = None, None
    for rows in batches:
        done = []
        for key, ids in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            if key == now:
                h.update(b"," + ids.encode())
                continue
            if now is not None:
                done.append((now, h.hexdigest()))
            now, h = key, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["key", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([h.hexdigest()])], names=["key", "ends"])


def _sum_up(nodes: pd.DataFrame) -> pd.DataFrame:
    """Subtree sums of the skeleton, from the deepest nodes upwards."""
    at = {k: i for i, k in enumerate(nodes["key"])}
    up = [at.get(k) for k in nodes["up"]]
    children, leaves, saved = (nodes[c].tolist() for c in ("n_children", "n_leaves", "saved_tokens"))
    first, members, words, depth = (nodes[c].tolist() for c in ("conv_id", "n_convs", "words", "depth"))
    for i in sorted(range(len(nodes)), key=lambda i: -depth[i]):
        leaves[i] += not children[i]
        saved[i] += (members[i] - 1) * words[i]
        if up[i] is not None:
            children[up[i]] += 1
            leaves[up[i]] += leaves[i]
            saved[up[i]] += saved[i]
    parent = pd.array([None if u is None else first[u] for u in up], "Int64")
    return nodes[["key", "conv_id", "depth", "n_convs"]].assign(parent_conv_id=parent, n_children=children, n_leaves=leaves, saved_tokens=saved)


def trie(paths: DataFrame, shards: int | None = None) -> DataFrame:
    """The nodes of the trie of ``paths(conv_id, path, words)``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    cuts = splitters(paths, shards or int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = spark.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(told.value, (bytes(p), c)) for p, c in zip(path, conv, strict=True)], dtype="int32")

    dealt = paths.select(shard_of("path", "conv_id").alias("shard"), "conv_id", "path", "words").repartitionById(len(cuts) + 1, F.col("shard"))
    parts = written(dealt.sortWithinPartitions("shard", "path", "conv_id").mapInArrow(_shard_task(cuts), _NODE), "trie-parts")
    whole = parts.where("key is null")
    partial = parts.where("key is not null and n_convs is not null").groupBy("key").agg(
        F.first("up").alias("up"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.first("words").alias("words"),
    )
    schema = "key binary, conv_id long, depth long, n_convs long, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"
    skeleton = written(partial.groupBy().applyInPandas(_sum_up, schema), "skeleton")
    blocks = parts.where("key is not null and n_convs is null").select("key", "conv_id", "ends")
    digests = blocks.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(_digest_task, "key binary, ends string")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    top = skeleton.join(digests, "key", "left").select(*columns, F.coalesce("ends", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    inner = whole.where("up is null").select(*columns, F.col("ends").alias("ends_sha256"))
    # The skeleton has at most MAX_SHARDS * SPLIT_TURNS rows of 32 bytes, so that a parent of very many nodes is no hot key.
    parents = F.broadcast(skeleton.select(F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id")))
    hung = whole.where("up is not null").drop("parent_conv_id").join(parents, "up")
    return top.unionByName(inner).unionByName(hung.select(*columns, F.col("ends").alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations of ``conversations(conv_id, turn, role, text, ...)``, one row a node."""
    return trie(written(rebuilt(conversations), "paths"), shards)


ORACLE = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn NULLS FIRST, role, text) AS ts FROM t GROUP BY conv_id),
crc AS (SELECT conv_id, ts, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda acc, b: list_reduce([xor(acc, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, i: CASE WHEN (x & 1) = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 4 AS h FROM own),
r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:c.h], []), c.ts[c.h + 1:]) AS ts FROM crc c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, unnest(range(len(ts) + 1)) AS depth, ts FROM r),
m AS (SELECT conv_id, depth, CAST(ts[1:depth] AS VARCHAR) AS node, CAST(ts[1:depth - 1] AS VARCHAR) AS up, len(ts) = depth AS ends, coalesce(len(regexp_extract_all(ts[depth].text, '[^\\x20\\x09-\\x0D]+')), 0) AS words FROM p),
n AS (SELECT depth, node, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256 FROM m GROUP BY depth, node),
k AS (SELECT n.*, (SELECT count(*) FROM n c WHERE c.depth = n.depth + 1 AND c.up = n.node) AS n_children, (SELECT min(q.conv_id) FROM n q WHERE q.depth = n.depth - 1 AND q.node = n.up AND n.depth > 0) AS parent_conv_id FROM n),
a AS (SELECT DISTINCT m.depth, m.node, d.depth AS under, d.node AS below FROM m JOIN m d ON m.conv_id = d.conv_id AND d.depth >= m.depth),
s AS (SELECT a.depth, a.node, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves, sum((k.n_convs - 1) * k.words) AS saved_tokens FROM a JOIN k ON k.depth = a.under AND k.node = a.below GROUP BY a.depth, a.node)
SELECT k.conv_id, k.depth, k.parent_conv_id, k.n_convs, k.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, k.ends_sha256 FROM k JOIN s ON k.depth = s.depth AND k.node = s.node
"""
