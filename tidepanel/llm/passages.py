"""Where do a document's fixed-length windows occur in documents with a
smaller id?  The distributed frame that the two passage operators share;
each brings its own matcher.

Documents are cut by id into ordered *blocks* of bounded size.

1. *Anchors.*  Among the short runs of units (seeds) inside a window, the one
   with the smallest hash is the window's anchor.  Equal windows have equal
   anchors, and neighbouring windows mostly share one: such a stretch is a
   *segment*.  Each block asks, per hash bucket, which of its anchors occur in
   more than one document of the corpus.  All others cannot hold a repeated
   window and go no further.
2. *Segments.*  The text of the remaining segments (equal ones of a block
   once, with the smallest id that has them) goes to its anchor's bucket.
   There the matcher takes all segments in the order of these ids and says for
   every window whether a document with a smaller id has it.
3. *Coverage.*  Back at the block, the document that a segment was sent for
   takes the answers; a later document of the block has all windows of the
   segment from that one.  The union of the repeated windows is what a
   document loses.

Hashes only route; that texts are equal is decided by comparing them: windows
in the matcher, equal segments of a block before they are sent once.

*Blocks.*  The sizes of the texts, by id, are range-partitioned, sorted and
summed up; a block ends where its bytes reach ``block_bytes``, so it holds at
most that and one document more.  The ends are the only thing that is shipped
(8 bytes a block, at most :data:`MAX_BLOCKS`; beyond, blocks get larger).  Rows
of one id that fill several blocks are dealt over them, and so are rows without
an id over blocks of their own: matchers compare ids, not blocks.

*Skew.*  A block sends an anchor or segment once, however many of its
documents have it.  An anchor with very many occurrences (in many different
surroundings) is not sent to one bucket: its windows are dealt out one by one,
by their own hash.  Every message is packed per (block, bucket); no group of
documents with common text ever meets in one task.

*Long texts.*  A document is never cut: a task holds a block's text and, for
one chunk of documents (512 KB, or one document), arrays of 60 to 100 bytes a
byte of text; what stays for the block is about 10 bytes a unit.

The documents are shuffled once (the exchange by block is reused by the three
passes over the text).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    byte_codes,
    id_text,
    mix64,
    prefix_hash,
    slice_hash,
    word_hashes,
    work_table,
)

_U = np.uint64
MAX_BLOCKS = 4_000_000
CHUNK_BYTES = 1 << 19
HOT_ANCHOR = 2_000
ANCHOR_BUCKET_BLOCKS = 8


@dataclass(frozen=True)
class Scheme:
    """What the units are and how long windows and seeds."""
    window: int
    seed: int
    words: bool  # units are words (else bytes)

    def normalise(self, text: str) -> bytes:
        raw = text.encode()
        return b" ".join(raw.split()) if self.words else raw


class Chunk:
    """Some whole documents of a block: their units, hashes and segments."""

    def __init__(self, scheme: Scheme, bodies: list[bytes], first_doc: int):
        self.buf = b"\n".join(bodies)
        raw = np.frombuffer(self.buf, np.uint8)
        lens = np.array([len(b) for b in bodies], np.int64)
        hi = np.cumsum(lens + 1) - 1
        lo = hi - lens
        if scheme.words:
            gap = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
            start = np.concatenate([[0], gap + 1])
            end = np.concatenate([gap, [len(raw)]])
            real = end > start
            self.start, self.end = start[real], end[real]
            self.doc_lo = np.searchsorted(self.start, lo)
            self.doc_hi = np.searchsorted(self.start, hi)
            codes = word_hashes(raw, self.start, self.end)
        else:
            self.start = self.end = None
            self.doc_lo, self.doc_hi = lo, hi
            codes = byte_codes(raw)
        self.scheme, self.n, self.first_doc = scheme, len(codes), first_doc
        self.prefix = prefix_hash(codes)
        self._segments()

    def _segments(self) -> None:
        w, k, n = self.scheme.window, self.scheme.seed, self.n
        windows = n - w + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.anchor = self.doc = empty
        if windows <= 0:
            return
        at = np.arange(n - k + 1, dtype=np.int64)
        seed = slice_hash(self.prefix, at, at + k)
        seed ^= seed >> _U(31)
        seed *= _U(0xD6E8FEB86659FD93)
        seed ^= seed >> _U(32)
        # hash above, position below: the minimum is the leftmost smallest seed
        key = (seed & ~_U((1 << 31) - 1)) | at.astype(np.uint64)
        best = sliding_min(key, w - k + 1)
        place = (best & _U((1 << 31) - 1)).astype(np.int64)
        doc = np.repeat(np.arange(len(self.doc_lo)),
                        np.maximum(self.doc_hi - self.doc_lo - w + 1, 0))
        # windows inside one document
        size = np.maximum(self.doc_hi - self.doc_lo - w + 1, 0)
        pos = (np.arange(size.sum()) + np.repeat(self.doc_lo - (np.cumsum(size) - size), size))
        if not len(pos):
            return
        place = place[pos]
        cut = np.ones(len(pos), bool)
        cut[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])
        head = np.flatnonzero(cut)
        tail = np.append(head[1:], len(pos)) - 1
        self.first, self.last, self.anchor = pos[head], pos[tail], place[head]
        self.doc = doc[head]  # numbers within the chunk

    def anchor_keys(self) -> np.ndarray:
        return mix64(slice_hash(self.prefix, self.anchor, self.anchor + self.scheme.seed))

    def split(self, hot: np.ndarray) -> None:
        """Cut the flagged segments into single windows."""
        self.hot = hot
        if not hot.any():
            return
        n = np.where(hot, self.last - self.first + 1, 1)
        rep = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        single = hot[rep]
        first = self.first[rep] + np.where(single, step, 0)
        self.last = np.where(single, first, self.last[rep])
        self.first, self.anchor, self.doc = first, self.anchor[rep], self.doc[rep]
        self.hot = single

    def take(self, keep: np.ndarray) -> None:
        self.first, self.last = self.first[keep], self.last[keep]
        self.anchor, self.doc = self.anchor[keep], self.doc[keep]

    def segment_hashes(self) -> np.ndarray:
        end = self.last + self.scheme.window
        return mix64(slice_hash(self.prefix, self.first, end)
                     + (end - self.first).astype(np.uint64))

    def bytes_span(self) -> tuple[np.ndarray, np.ndarray]:
        end = self.last + self.scheme.window
        if not self.scheme.words:
            return self.first, end
        return self.start[self.first], self.end[end - 1]


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbouring values: prefix and suffix minima of
    blocks of w."""
    n = len(x)
    full = -(-n // w) * w
    y = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    fore = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - w + 1], fore[w - 1:n])


class Block:
    """The documents of one block, in id order, as chunks."""

    def __init__(self, scheme: Scheme, table: pa.Table, buckets: tuple[int, int]):
        self.scheme = scheme
        self.ask_buckets, self.send_buckets = buckets
        # a block holds rows with an id or rows without one
        self.null = table.column("doc_id").null_count > 0
        ids = table.column("doc_id").fill_null(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        texts = table.column("text").take(pa.array(order))
        self.chunks: list[Chunk] = []
        held, size, first = [], 0, 0
        for k in range(len(texts)):
            body = scheme.normalise(texts[k].as_py())
            held.append(body)
            size += len(body)
            if size >= CHUNK_BYTES:
                self.chunks.append(Chunk(scheme, held, first))
                held, size, first = [], 0, k + 1
        if held:
            self.chunks.append(Chunk(scheme, held, first))

    def _all(self, f: Callable[[Chunk], np.ndarray], dtype=np.uint64) -> np.ndarray:
        parts = [f(c) for c in self.chunks]
        return np.concatenate(parts) if parts else np.zeros(0, dtype)

    def docs(self) -> np.ndarray:
        """Document numbers of all segments, equal for rows of one id."""
        _, same = np.unique(self.ids, return_inverse=True)
        return same[self._all(lambda c: c.doc + c.first_doc, np.int64)]

    def anchors(self):
        """Distinct anchors in message order ``bucket << 32 | 32 bits``, the
        place of each segment's anchor in it, occurrence counts and whether
        two documents of the block have it."""
        keys = self._all(Chunk.anchor_keys)
        message = self._message(keys)
        uniq, where, counts = np.unique(message, return_inverse=True, return_counts=True)
        doc = self.docs()
        low = np.full(len(uniq), np.iinfo(np.int64).max)
        high = np.full(len(uniq), -1)
        np.minimum.at(low, where, doc)
        np.maximum.at(high, where, doc)
        return uniq, where, counts, high > low

    def _message(self, keys: np.ndarray) -> np.ndarray:
        bucket = ((keys >> _U(32)) * _U(self.ask_buckets)) >> _U(32)
        return (bucket << _U(32)) | (keys & _U(0xFFFFFFFF))

    def bucket_ranges(self, bucket: np.ndarray):
        """(bucket, lo, hi) of each stretch of a sorted bucket array."""
        if not len(bucket):
            return []
        cut = np.flatnonzero(np.diff(bucket)) + 1
        lo = np.concatenate([[0], cut])
        hi = np.append(cut, len(bucket))
        return list(zip(bucket[lo].tolist(), lo.tolist(), hi.tolist()))

    def keep_shared(self, answers: np.ndarray) -> None:
        """Drop the segments whose anchor no other document has, and cut up
        those of hot anchors."""
        where = self.anchors()[1]
        status = answers[where] if len(where) else np.zeros(0, np.uint8)
        at = 0
        for c in self.chunks:
            own = status[at:at + len(c.first)]
            at += len(own)
            c.take(own > 0)
            c.split(own[own > 0] == 2)

    def texts(self, rows: np.ndarray) -> Iterator[bytes]:
        """Texts of segments, by their rows over all chunks."""
        chunk = np.searchsorted(self._base, rows, side="right") - 1
        bufs = [c.buf for c in self.chunks]
        return (bufs[c][x:y] for c, x, y in zip(chunk.tolist(), self._lo[rows].tolist(),
                                                self._hi[rows].tolist()))

    def segments(self):
        """Distinct segments in message order (by bucket): their buckets, rows
        and smallest ids, and each segment's place among them.  Segments count
        as equal when their texts are."""
        h = self._all(Chunk.segment_hashes)
        keys = self._all(Chunk.anchor_keys)
        spans = [c.bytes_span() for c in self.chunks]
        none = np.zeros(0, np.int64)
        self._lo = np.concatenate([s[0] for s in spans]) if spans else none
        self._hi = np.concatenate([s[1] for s in spans]) if spans else none
        self._base = np.cumsum([0] + [len(c.first) for c in self.chunks])
        # a hot anchor's windows travel by their own hash, all others by the
        # anchor's; an anchor is hot everywhere or nowhere, so equal windows meet
        route = np.where(self._all(lambda c: c.hot, bool), h, keys)
        bucket = (((mix64(route) >> _U(32)) * _U(self.send_buckets)) >> _U(32)).astype(np.int64)
        doc = self.docs()
        order = np.lexsort((doc, h, bucket))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (bucket[order][1:] != bucket[order][:-1])
        head = order[new][np.cumsum(new) - 1] if len(order) else order
        again = np.flatnonzero(~new)
        for i, mine, first in zip(again.tolist(), self.texts(order[again]),
                                  self.texts(head[again])):
            if mine != first:
                head[i] = order[i]                     # another text of the same hash
        mine = head == order
        heads = order[mine]
        number = np.empty(len(order), np.int64)
        number[heads] = np.arange(len(heads))
        where = np.empty(len(order), np.int64)
        where[order] = number[head]
        ids = self.ids[self._all(lambda c: c.doc + c.first_doc, np.int64)]
        return bucket[heads], heads, ids[heads], where, doc == doc[heads][where]


def _grouped(answer_rows: pa.Table) -> bytes:
    """Answers of a block, in bucket order."""
    rows = sorted(zip(answer_rows.column("bucket").to_pylist(),
                      answer_rows.column("answer").to_pylist()))
    return b"".join(a for _, a in rows)


def _block_ends(block_bytes: int):
    """Last ids of blocks, from (doc_id, size) rows in id order."""
    def body(batches):
        held, last, ends = 0, None, []
        for batch in batches:
            for i, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held, last = held + n, i
                if held >= block_bytes:
                    ends.append(i)
                    held = 0
        if held:
            ends.append(last)
        yield pa.RecordBatch.from_arrays([pa.array(ends, pa.int64())], names=["last"])
    return body


def placed_in_blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Rows (doc_id, text) with a ``block`` number, ordered as the ids are, and
    the number of blocks; rows without an id are in the last blocks."""
    sizes = work_table(rows.select("doc_id", F.octet_length("text").alias("size")), "sizes")
    total = sizes.agg(F.sum("size").alias("n"),
                      F.sum(F.when(F.col("doc_id").isNull(), F.col("size"))).alias("nulls"),
                      F.count_if(F.col("doc_id").isNull()).alias("null_rows")).first()
    block_bytes = max(block_bytes, -(-(total["n"] or 0) // MAX_BLOCKS))
    ends = (sizes.filter("doc_id IS NOT NULL").repartitionByRange("doc_id")
            .sortWithinPartitions("doc_id").mapInArrow(_block_ends(block_bytes), "last long")
            .collect())
    bounds = np.sort(np.array([r["last"] for r in ends], np.int64))
    known = len(bounds) + 1
    others = max(1, -(-(total["nulls"] or 0) // block_bytes)) if total["null_rows"] else 0
    shipped = rows.sparkSession.sparkContext.broadcast(bounds)

    @F.pandas_udf("int")
    def block_of(ids: pd.Series, turn: pd.Series) -> pd.Series:
        i = ids.to_numpy()
        lo = np.searchsorted(shipped.value, i, side="left")
        same = np.searchsorted(shipped.value, i, side="right") - lo
        return pd.Series((lo + turn.to_numpy() % np.maximum(same, 1)).astype(np.int32))

    rows = rows.withColumn("turn", F.monotonically_increasing_id())
    deal = (F.lit(known) + F.col("turn") % F.lit(max(others, 1))).cast("int")
    block = F.when(F.col("doc_id").isNull(), deal).otherwise(
        block_of(F.coalesce("doc_id", F.lit(0)), F.col("turn")))
    return rows.select(block.alias("block"), "doc_id", "text"), known + others


def repeated_windows(docs: DataFrame, scheme: Scheme, match: Callable, finish: Callable,
                     schema: str, block_bytes: int, id_col: str = "doc_id",
                     text_col: str = "text", hot: int = HOT_ANCHOR) -> DataFrame:
    """``match(messages)`` takes messages (null, ids, segments) in the order of
    the blocks and gives one flag array for each, over all windows of its
    segments: does a document with a smaller id than the segment's have the
    window?  With ``null`` the segments' documents have no id, which is larger
    than any; they are an earlier document for none.  ``finish(ids, chunk,
    covered)`` gives the output columns of the documents of a chunk from the
    flags of its covered units."""
    placed, blocks = placed_in_blocks(id_text(docs, id_col, text_col), block_bytes)
    # anchors are a few bytes, segments are text: fewer buckets for anchors
    buckets = (math.ceil(blocks / ANCHOR_BUCKET_BLOCKS), blocks)

    def ask(table: pa.Table) -> pa.Table:
        b = Block(scheme, table, buckets)
        uniq, _, counts, several = b.anchors()
        bucket = (uniq >> _U(32)).astype(np.int64)
        low = (uniq & _U(0xFFFFFFFF)).astype("<u4")
        # one byte: occurrences up to 127, and a bit for "two documents here"
        note = (np.minimum(counts, 127) | (several.astype(np.int64) << 7)).astype(np.uint8)
        spans = b.bucket_ranges(bucket)
        blk = table.column("block")[0].as_py()
        return pa.table({
            "bucket": pa.array([s[0] for s in spans], pa.int32()),
            "block": pa.array([blk] * len(spans), pa.int32()),
            "keys": pa.array([low[lo:hi].tobytes() for _, lo, hi in spans], pa.binary()),
            "notes": pa.array([note[lo:hi].tobytes() for _, lo, hi in spans], pa.binary())})

    def answer(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(k, "<u4") for k in table.column("keys").to_pylist()]
        note = np.frombuffer(b"".join(table.column("notes").to_pylist()), np.uint8)
        uniq, where = np.unique(np.concatenate(keys), return_inverse=True)
        senders = np.bincount(where, minlength=len(uniq))
        total = np.bincount(where, note & 127, minlength=len(uniq))
        several = np.bincount(where, note >> 7, minlength=len(uniq)) > 0
        status = (((senders > 1) | several).astype(np.uint8)
                  + ((total > hot) & ((senders > 1) | several)))
        reply, at = status[where].astype(np.uint8), 0
        out = []
        for k in keys:
            out.append(reply[at:at + len(k)].tobytes())
            at += len(k)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "answer": pa.array(out, pa.binary())})

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        cols = {k: [] for k in ("bucket", "block", "null", "ids", "sizes", "data")}
        if table.num_rows:
            b = Block(scheme, table, buckets)
            b.keep_shared(np.frombuffer(_grouped(answers), np.uint8))
            bucket, heads, ids, _, _ = b.segments()
            blk, texts = table.column("block")[0].as_py(), list(b.texts(heads))
            for k, x, y in b.bucket_ranges(bucket):
                parts = texts[x:y]
                cols["bucket"].append(k)
                cols["block"].append(blk)
                cols["null"].append(b.null)
                cols["ids"].append(ids[x:y].astype("<i8").tobytes())
                cols["sizes"].append(np.array([len(p) for p in parts], "<u4").tobytes())
                cols["data"].append(b"".join(parts))
        return pa.table({"bucket": pa.array(cols["bucket"], pa.int32()),
                         "block": pa.array(cols["block"], pa.int32()),
                         "null": pa.array(cols["null"], pa.bool_()),
                         "ids": pa.array(cols["ids"], pa.binary()),
                         "sizes": pa.array(cols["sizes"], pa.binary()),
                         "data": pa.array(cols["data"], pa.binary())})

    def judge(table: pa.Table) -> pa.Table:
        blk, null = table.column("block").to_pylist(), table.column("null").to_pylist()
        ids, sizes, data = (table.column(c) for c in ("ids", "sizes", "data"))
        order = sorted(range(len(blk)), key=blk.__getitem__)

        def messages():
            for j in order:
                ends = np.cumsum(np.frombuffer(sizes[j].as_py(), "<u4").astype(np.int64))
                text, lo, segs = data[j].as_py(), 0, []
                for hi in ends.tolist():
                    segs.append(text[lo:hi])
                    lo = hi
                yield null[j], np.frombuffer(ids[j].as_py(), "<i8"), segs
        flags = [np.packbits(f).tobytes() for f in match(messages())]
        return pa.table({"block": pa.array([blk[j] for j in order], pa.int32()),
                         "bucket": table.column("bucket").take(pa.array(order)),
                         "answer": pa.array(flags, pa.binary())})

    def decide(table: pa.Table, answers: pa.Table) -> pa.Table:
        shared = answers.filter(pc.equal(answers.column("stage"), 1))
        found = answers.filter(pc.equal(answers.column("stage"), 2))
        if not table.num_rows:
            return pa.Table.from_pydict({f.name: [] for f in out_schema}, out_schema)
        b = Block(scheme, table, buckets)
        b.keep_shared(np.frombuffer(_grouped(shared), np.uint8))
        bucket, heads, _, where, asked_for = b.segments()
        windows = b._all(lambda c: c.last - c.first + 1, np.int64)
        per_head = windows[heads] if len(heads) else windows
        # unpack the flags bucket by bucket (each was padded to whole bytes)
        by_bucket = dict(zip(found.column("bucket").to_pylist(),
                             found.column("answer").to_pylist()))
        bits = []
        for k, lo, hi in b.bucket_ranges(bucket):
            n = int(per_head[lo:hi].sum())
            bits.append(np.unpackbits(np.frombuffer(by_bucket[k], np.uint8), count=n))
        bits = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
        begin = np.cumsum(per_head) - per_head
        out, at = [], 0
        for c in b.chunks:
            # every window of the chunk's segments: answered, or had from the
            # document of the block that the segment was sent for
            n = c.last - c.first + 1
            r = np.repeat(np.arange(len(n)), n)
            step = np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)
            seg = at + r
            at += len(n)
            dup = ~asked_for[seg]
            dup |= bits[begin[where[seg]] + step].astype(bool)
            own = (c.first[r] + step)[dup]
            edge = (np.bincount(own, minlength=c.n + 1)
                    - np.bincount(own + scheme.window, minlength=c.n + 1))
            covered = np.cumsum(edge[:-1]) > 0
            ids = b.ids[c.first_doc:c.first_doc + len(c.doc_lo)].tolist()
            out.append(finish([None] * len(ids) if b.null else ids, c, covered))
        return pa.concat_tables([o.cast(out_schema) for o in out])

    out_schema = _arrow_schema(docs.sparkSession, schema)
    asked = placed.groupBy("block").applyInArrow(
        ask, "bucket int, block int, keys binary, notes binary")
    shared = asked.groupBy("bucket").applyInArrow(
        answer, "block int, bucket int, answer binary")
    sent = placed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        send, "bucket int, block int, null boolean, ids binary, sizes binary, data binary")
    found = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, answer binary")
    both = (shared.withColumn("stage", F.lit(1))
            .unionByName(found.withColumn("stage", F.lit(2))))
    return placed.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(decide, schema)


def _arrow_schema(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    return to_arrow_schema(_parse_datatype_string(ddl))


def spans_of(covered: np.ndarray, lo: int, hi: int) -> list[int]:
    """Flat [start, end, start, end, ...] of the covered runs of a document,
    counted from its start."""
    edge = np.flatnonzero(np.diff(covered[lo:hi].astype(np.int8), prepend=0, append=0))
    return edge.tolist()
