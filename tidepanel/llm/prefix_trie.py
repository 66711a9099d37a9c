"""Prefix trie of conversations, from padded matrices of turn ids.

Method.  A turn's id is 18 bytes of the SHA-256 of (role, text), as 24 base64
characters; a conversation is the string of its turns' ids, so equal prefixes
of turns are equal prefixes of the string.  Conversations are range-partitioned
and externally sorted by (string, conv_id): a node's members stand next to each
other, and a sequence shared by any number of conversations is cut by conv_id.
Each partition is read as shards of at most ``shard_turns`` turns.  A shard
numbers its turn ids and fills a padded matrix (16 turns a pass; a pass keeps
only the rows that go on, so a long conversation widens nothing).  ``lexsort``
orders the rows; a row starts a node of depth d where any of its first d
columns differs from the row above (change masks, OR-accumulated over the
columns); ``reduceat`` over those starts gives members, smallest member and the
rows that end there, for every depth.

Only nodes on the path of a shard's first or last row can go on in a
neighbouring shard.  They leave the shard as partial rows under the SHA-256 of
their prefix; partials of neighbouring shards are merged, first within the
partition, then over ``fan`` partitions at a time, level by level, until one
group is left.  A merge adds members and the sums over finished nodes below,
closes every node that cannot reach beyond the group, and hands its sums to
its parent.  Ids that end in a partial node travel as joined chunks in order
and are hashed as a stream.

Bounds.  A task holds one shard, or 2 * ``fan`` paths.  The texts are never
shuffled, nothing is collected, the number of levels is the logarithm of the
number of partitions.  The turns of one conversation (24 bytes each) must fit a
row.  SHA-256 has to read the members of one node in order: for a node where a
third of all conversations end that is one task reading chunks of 3 MB, in
constant memory.

Defined results.  A null role or text counts as empty, a null turn comes first;
equal turns of one conversation are ordered by their ids, repeated rows are
repeated turns.  Rows without ``conv_id`` belong to no conversation.  A table
without conversations gives no node, not even the root.  Texts of any length
count whole.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import work_table

ID = 24                 # characters of a turn's id
WIDTH = 16              # turns a pass
SHARD_TURNS = 1 << 18
PARTITION_TURNS = 1 << 22
FAN = 256
CLOSED, OPEN, ENDS = 0, 1, 2

_FIELDS = [("kind", pa.int32()), ("part", pa.int64()), ("seq", pa.int64()), ("key", pa.string()),
           ("up", pa.string()), ("depth", pa.int64()), ("conv_id", pa.int64()),
           ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("points", pa.int64()),
           ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()),
           ("left", pa.bool_()), ("right", pa.bool_()), ("ends_sha256", pa.string()),
           ("chunk", pa.string())]
_ARROW = pa.schema(_FIELDS)
_DDL = ("kind int, part long, seq long, key string, up string, depth long, conv_id long, "
        "parent_conv_id long, n_convs long, points long, n_children long, n_leaves long, "
        "saved_tokens long, left boolean, right boolean, ends_sha256 string, chunk string")
_OUT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256"]


def _sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


NO_ENDS = _sha("")


# --- conversations as strings of turn ids ------------------------------------

def rebuilt(conversations: DataFrame, block: int = 100, heads: int = 6) -> DataFrame:
    """(conv_id, path, points) of every rebuilt conversation: the first h
    turns of conversation ``c - c % block``, then the own turns after the
    first h, with h = crc32(c) % ``heads``.  One shuffle, by block; a block is
    at most 2 * ``block`` conversations."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length makes the pair of strings unambiguous
    said = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.expr(f"cast(conv_id - conv_id % {block} AS long)").alias("base"),
        F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"),
                 F.base64(F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, ID * 3 // 2)))
                 .alias("id"), F.length(text).alias("points")).alias("t"))
    own = (turns.repartition("base").groupBy("base", "conv_id")
           .agg(F.array_sort(F.collect_list("t")).alias("own")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    first = F.expr(f"max(CASE WHEN conv_id = base THEN slice(own, 1, {heads - 1}) END) "
                   "OVER (PARTITION BY base)")
    own = own.withColumn("head", first).withColumn("h", h)
    whole = F.concat(F.expr("coalesce(slice(head, 1, h), slice(own, 1, 0))"),
                     F.expr("slice(own, h + 1, greatest(size(own) - h, 0))"))
    return own.select("conv_id", whole.alias("t")).select(
        "conv_id", F.array_join(F.col("t.id"), "").alias("path"),
        F.col("t.points").alias("points"))


# --- one shard ----------------------------------------------------------------

def _numbered(path: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Turn ids of all paths as integers in the strings' order, and the
    offsets of the paths."""
    n = np.fromiter((len(p) // ID for p in path), np.int64, len(path))
    at = np.concatenate([[0], np.cumsum(n)])
    flat = np.frombuffer("".join(path).encode("ascii"), dtype=f"S{ID}")
    if not len(flat):
        return np.zeros(0, np.int64), at
    return np.unique(flat, return_inverse=True)[1].astype(np.int64), at


def shard_nodes(conv: np.ndarray, ids: np.ndarray, at: np.ndarray, points: np.ndarray,
                edges: tuple[int, ...] = ()) -> dict:
    """All nodes of one shard, by depth, from its rows in any order: arrays
    ``depth, conv, n, points, parent`` (index, -1 for the root), ``ends``
    (node to the ids that end there), and ``paths``, the nodes on the path of
    each row of ``edges``."""
    size = np.diff(at)
    rows = np.arange(len(conv))
    node = np.zeros(len(conv), np.int64)        # each row's node so far
    depth, members, least = [np.zeros(1, np.int64)], [np.array([len(conv)])], [conv.min()[None]]
    length, parent, total = [np.zeros(1, np.int64)], [np.array([-1])], 1
    paths = [[0] for _ in edges]
    ends: dict[int, np.ndarray] = {}

    def end(done: np.ndarray) -> None:
        """Rows that stop at their present node, grouped."""
        if len(done):
            done = done[np.lexsort((conv[done], node[done]))]
            cut = np.flatnonzero(np.diff(node[done])) + 1
            for g in np.split(done, cut):
                ends[int(node[g[0]])] = conv[g]

    end(rows[size == 0])
    rows, lo = rows[size > 0], 0
    while len(rows):
        col = np.arange(lo, lo + WIDTH)
        inside = col < size[rows, None]
        m = np.where(inside, ids[np.where(inside, at[rows, None] + col, 0)], -1)
        order = np.lexsort((*m.T[::-1], node[rows]))
        rows, m, inside = rows[order], m[order], inside[order]
        change = np.ones(m.shape, bool)
        change[1:] = m[1:] != m[:-1]
        change[1:, 0] |= node[rows[1:]] != node[rows[:-1]]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(WIDTH):
            here = np.flatnonzero(inside[:, j])
            if not len(here):
                break
            starts = np.flatnonzero(change[here, j])
            r = rows[here]
            parent.append(node[r[starts]])
            depth.append(np.full(len(starts), lo + j + 1))
            members.append(np.diff(np.append(starts, len(here))))
            least.append(np.minimum.reduceat(conv[r], starts))
            length.append(points[at[r[starts]] + lo + j])
            node[r] = total + np.cumsum(change[here, j]) - 1
            total += len(starts)
            for path, e in zip(paths, edges):
                if size[e] > lo + j:
                    path.append(int(node[e]))
            end(r[size[r] == lo + j + 1])
        lo += WIDTH
        rows = rows[size[rows] > lo]
    cat = lambda x: np.concatenate(x).astype(np.int64)
    return {"depth": cat(depth), "conv": cat(least), "n": cat(members), "points": cat(length),
            "parent": cat(parent), "ends": ends, "paths": paths}


def _prefix_keys(path: str, depth: int) -> list[str]:
    """SHA-256 of the first 0, 1, ... ``depth`` turns of a path."""
    h = hashlib.sha256()
    out = [h.copy().hexdigest()]
    for d in range(depth):
        h.update(path[d * ID:(d + 1) * ID].encode("ascii"))
        out.append(h.copy().hexdigest())
    return out


def _shard_rows(conv: list[int], path: list[str], points: list[list[int]], part: int, seq: int
                ) -> tuple[pa.RecordBatch, list[dict], pa.RecordBatch]:
    """One shard: its finished nodes, its partial nodes, its chunks of ids."""
    ids, at = _numbered(path)
    flat = np.fromiter((x for p in points for x in p), np.int64, int(at[-1]))
    # rows come sorted by path, so the first and the last are the edges of the shard
    t = shard_nodes(np.asarray(conv, np.int64), ids, at, flat, (0, len(conv) - 1))
    size = len(t["depth"])
    keys: list[str | None] = [None] * size
    for nodes, p in zip(t["paths"], (path[0], path[-1])):
        for node, key in zip(nodes, _prefix_keys(p, len(nodes) - 1)):
            keys[node] = key
    is_open = np.array([k is not None for k in keys])
    kids = np.zeros(size, np.int64)
    leaves = np.zeros(size, np.int64)
    saved = np.where(is_open, 0, (t["n"] - 1) * t["points"])
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(t["depth"])) + 1, [size]])
    for lo, hi in zip(cuts[-2:0:-1], cuts[:0:-1]):      # levels, deepest first, without the root
        own = np.flatnonzero(~is_open[lo:hi]) + lo
        leaves[own] += kids[own] == 0
        up = t["parent"][own]
        np.add.at(kids, up, 1)
        np.add.at(leaves, up, leaves[own])
        np.add.at(saved, up, saved[own])
    done = np.flatnonzero(~is_open)
    up = t["parent"][done]
    up_open = is_open[up]
    n = len(done)
    text = lambda i: ",".join(map(str, t["ends"][i].tolist()))
    closed = _batch(n, kind=np.full(n, CLOSED, np.int32), part=np.full(n, part),
                    up=[keys[u] for u in up], depth=t["depth"][done], conv_id=t["conv"][done],
                    parent_conv_id=pa.array(t["conv"][up], mask=up_open), n_convs=t["n"][done],
                    n_children=kids[done], n_leaves=leaves[done], saved_tokens=saved[done],
                    ends_sha256=[_sha(text(i)) if i in t["ends"] else NO_ENDS
                                 for i in done.tolist()])
    first, last = map(set, t["paths"])
    partial = []
    for i in np.flatnonzero(is_open).tolist():
        p = int(t["parent"][i])
        partial.append({"part": seq, "key": keys[i], "up": keys[p] if p >= 0 else None,
                        "depth": int(t["depth"][i]), "conv_id": int(t["conv"][i]),
                        "n_convs": int(t["n"][i]), "points": int(t["points"][i]),
                        "n_children": int(kids[i]), "n_leaves": int(leaves[i]),
                        "saved_tokens": int(saved[i]), "left": i in first, "right": i in last})
    chunked = [i for i in np.flatnonzero(is_open).tolist() if i in t["ends"]]
    n = len(chunked)
    ends = _batch(n, kind=np.full(n, ENDS, np.int32), part=np.full(n, part),
                  seq=np.full(n, seq), key=[keys[i] for i in chunked],
                  chunk=[text(i) for i in chunked])
    return closed, partial, ends


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[name], type=kind) if name in columns else pa.nulls(n, kind)
         for name, kind in _FIELDS], schema=_ARROW)


# --- merging partial nodes ------------------------------------------------------

def merge_partials(rows: pd.DataFrame, part: int, last: bool) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Partial nodes of neighbouring shards (``part`` gives their order) as
    one: (closed nodes, nodes that may still go on outside).  ``last``: there
    is nothing outside."""
    lo, hi = rows["part"].min(), rows["part"].max()
    rows = rows.assign(left=rows["left"] & (rows["part"] == lo),
                       right=rows["right"] & (rows["part"] == hi))
    t = rows.groupby("key", sort=False).agg(
        up=("up", "first"), depth=("depth", "first"), points=("points", "first"),
        conv_id=("conv_id", "min"), n_convs=("n_convs", "sum"), n_children=("n_children", "sum"),
        n_leaves=("n_leaves", "sum"), saved_tokens=("saved_tokens", "sum"),
        left=("left", "any"), right=("right", "any")).reset_index()
    t = t.sort_values("depth", kind="stable", ignore_index=True)
    where = dict(zip(t["key"], range(len(t))))
    parent = np.array([where[u] if isinstance(u, str) else -1 for u in t["up"]], np.int64)
    is_open = ((t["left"] | t["right"]) & (not last)).to_numpy()
    kids, leaves, saved = (t[c].to_numpy(np.int64).copy()
                           for c in ("n_children", "n_leaves", "saved_tokens"))
    gain = ((t["n_convs"] - 1) * t["points"]).to_numpy(np.int64)
    for i in range(len(t) - 1, -1, -1):
        if not is_open[i]:
            leaves[i] += kids[i] == 0
            saved[i] += gain[i]
            if parent[i] >= 0:
                kids[parent[i]] += 1
                leaves[parent[i]] += leaves[i]
                saved[parent[i]] += saved[i]
    t["n_children"], t["n_leaves"], t["saved_tokens"] = kids, leaves, saved
    t["part"] = part
    known = (parent >= 0) & ~is_open[np.maximum(parent, 0)]
    conv = t["conv_id"].to_numpy(np.int64)
    t["parent_conv_id"] = pd.array(conv[np.maximum(parent, 0)], dtype="Int64")
    t.loc[~known, "parent_conv_id"] = pd.NA
    return t[~is_open], t[is_open]


def _frame_batch(t: pd.DataFrame, kind: int) -> pa.RecordBatch:
    have = {c: pa.array(t[c], type=_ARROW.field(c).type, from_pandas=True)
            for c in t.columns if c in _ARROW.names}
    return _batch(len(t), **have, kind=np.full(len(t), kind, np.int32))


def _shards(batches: Iterator[pa.RecordBatch], turns: int) -> Iterator[tuple[int, list]]:
    """A partition's rows as lists of rows of at most ``turns`` turns (or one
    row); a conversation without turns counts as one."""
    held, size, part = [], 0, 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            n = max(1, len(row[1]) // ID)
            if held and size + n > turns:
                yield part, held
                held, size = [], 0
            held.append(row)
            size, part = size + n, row[3]
    if held:
        yield part, held


def _partition(shard_turns: int):
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial, part = [], 0
        for seq, (part, rows) in enumerate(_shards(batches, shard_turns)):
            conv, path, points, _ = (list(c) for c in zip(*rows))
            closed, more, ends = _shard_rows(conv, path, points, part, seq)
            partial += more
            yield closed
            yield ends
        if partial:
            closed, still = merge_partials(pd.DataFrame(partial), part, last=False)
            yield _frame_batch(closed, CLOSED)
            yield _frame_batch(still, OPEN)
    return body


def _group_merge(last: bool):
    def body(t: pa.Table) -> pa.Table:
        group = t.column("group")[0].as_py()
        closed, still = merge_partials(t.to_pandas(), group, last)
        return pa.Table.from_batches([_frame_batch(closed, CLOSED), _frame_batch(still, OPEN)])
    return body


def _stream_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks sorted by (key, order) into one SHA-256 a key."""
    key, h = None, None
    for batch in batches:
        out = []
        for k, chunk in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k != key:
                if h is not None:
                    out.append((key, h.hexdigest()))
                key, h = k, hashlib.sha256()
            else:
                h.update(b",")
            h.update(chunk.encode("ascii"))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.string())],
            names=["key", "ends"])
    if h is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([h.hexdigest()])],
                                         names=["key", "ends"])


# --- the operator -----------------------------------------------------------------

def prefix_trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS, fan: int = FAN,
                partitions: int | None = None) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations: conv_id
    (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256 (see the module's head for the edge cases)."""
    spark = conversations.sparkSession
    prepare(spark)
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              math.ceil(conversations.count() / PARTITION_TURNS))
    rows = (rebuilt(conversations).repartitionByRange(parts, "path", "conv_id")
            .sortWithinPartitions("path", "conv_id")
            .select("conv_id", "path", "points", F.spark_partition_id().cast("long").alias("part")))
    found = work_table(rows.mapInArrow(_partition(shard_turns), _DDL), "trie")
    partials = found.filter(F.col("kind") == OPEN)
    closed = [found.filter((F.col("kind") == CLOSED) & F.col("key").isNotNull())]
    groups = parts
    level = partials
    while True:
        groups = math.ceil(groups / fan)
        merged = work_table(
            level.withColumn("group", F.floor(F.col("part") / fan)).groupBy("group")
            .applyInArrow(_group_merge(groups == 1), _DDL), "trie-merged")
        closed.append(merged.filter(F.col("kind") == CLOSED))
        if groups == 1:
            break
        level = merged.filter(F.col("kind") == OPEN)
        partials = partials.unionByName(level)

    shared = closed[0]
    for t in closed[1:]:
        shared = shared.unionByName(t)
    ends = (found.filter(F.col("kind") == ENDS).repartition(parts, "key")
            .sortWithinPartitions("key", "part", "seq").select("key", "chunk")
            .mapInArrow(_stream_hash, "key string, ends string"))
    names = shared.select("key", F.col("conv_id").alias("up_conv"))
    # Nodes that left their shard: hash by key, parent by key.
    of_shared = (shared.join(ends, "key", "left")
                 .join(names.withColumnRenamed("key", "up"), "up", "left")
                 .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv"))
                 .withColumn("ends_sha256", F.coalesce("ends", F.lit(NO_ENDS))))
    # Nodes that did not: a parent that left is looked up by (partition, key),
    # so that the children of a common parent stay spread over the partitions.
    inner = found.filter((F.col("kind") == CLOSED) & F.col("key").isNull())
    open_here = (found.filter(F.col("key").isNotNull() & (F.col("kind") != ENDS))
                 .select("part", "key"))
    by_part = open_here.join(names, "key").withColumnRenamed("key", "up")
    of_inner = (inner.filter("parent_conv_id IS NULL").drop("parent_conv_id")
                .join(by_part.withColumnRenamed("up_conv", "parent_conv_id"), ["part", "up"]))
    return (of_shared.select(_OUT).unionByName(of_inner.select(_OUT))
            .unionByName(inner.filter("parent_conv_id IS NOT NULL").select(_OUT)))


# --- the same in SQL ----------------------------------------------------------------

ORACLE = """
WITH RECURSIVE bits AS (  -- crc32 of the decimal id, a byte at a time
    SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, 4294967295::BIGINT AS crc
    FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL
    SELECT conv_id, s, i + 1,
           list_reduce(list_prepend(xor(crc, ascii(s[i + 1])::BIGINT), range(8)),
                       lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT)
                                         ELSE a >> 1 END)
    FROM bits WHERE i < length(s)),
heads AS (SELECT conv_id, xor(crc, 4294967295::BIGINT) % 6 AS h FROM bits WHERE i = length(s)),
turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
    FROM conversations WHERE conv_id IS NOT NULL),
built AS (
    SELECT h.conv_id, t.k, t.role, t.text FROM heads h
    JOIN turns t ON t.conv_id = h.conv_id - h.conv_id % 100 AND t.k <= h.h
    UNION ALL
    SELECT h.conv_id, 1000 + t.k, t.role, t.text FROM heads h
    JOIN turns t ON t.conv_id = h.conv_id AND t.k > h.h),
numbered AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, text,
           sha256(length(role) || ':' || role || text) AS id FROM built),
prefixes AS (
    SELECT conv_id, d, length(text) AS points,
           string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM numbered
    UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
longest AS (SELECT conv_id, max(d) AS n FROM prefixes GROUP BY conv_id),
nodes AS (
    SELECT p.path, p.d, min(p.conv_id) AS conv_id, count(*) AS n, min(p.points) AS points,
           coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id)
                    FILTER (WHERE l.n = p.d), '') AS ends
    FROM prefixes p JOIN longest l USING (conv_id) GROUP BY p.path, p.d),
linked AS (
    SELECT n.*, u.path AS up, u.conv_id AS up_conv FROM nodes n
    LEFT JOIN prefixes q ON q.conv_id = n.conv_id AND q.d = n.d - 1
    LEFT JOIN nodes u ON u.path = q.path),
kids AS (SELECT up, count(*) AS c FROM linked WHERE up IS NOT NULL GROUP BY up),
below AS (
    SELECT q.path, count(*) FILTER (WHERE k.c IS NULL) AS leaves,
           sum((n.n - 1) * n.points) AS saved
    FROM nodes n LEFT JOIN kids k ON k.up = n.path
    JOIN prefixes q ON q.conv_id = n.conv_id AND q.d <= n.d GROUP BY q.path)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, n.up_conv AS parent_conv_id, n.n AS n_convs,
       coalesce(k.c, 0) AS n_children, b.leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM linked n LEFT JOIN kids k ON k.up = n.path JOIN below b ON b.path = n.path
"""
