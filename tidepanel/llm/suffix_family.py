"""Substring de-duplication by a logarithmic family of suffix arrays, on bytes.

A document loses every byte inside a string of ``window`` bytes that also
starts in a document with a smaller id.

Segments come in the order of the smallest id that has them and make up the
batches.  In :func:`scan_family` the batches of one bucket come in order.  Each
gets a suffix array: the places of its text in the order of the ``window`` bytes
that follow (a longer order cannot change the answer).  Equal neighbours in it
are matches for all but those of the smallest id; then the array is scanned
against every level of the family (a level is far longer than a batch, so by
binary search, not entry by entry) for matches of that length under a smaller
id.  What is new is inserted as a level of its own, and levels of like size are
merged, so their sizes grow geometrically and each string is merged a
logarithmic number of times.  Segments that are known as a whole are full
matches and skip the array.  :mod:`passages` deals out the text and joins the
answers.

*Edge cases.*  Null and empty texts and texts shorter than a window lose
nothing; any byte may occur, also NUL; matches never cross documents; rows
repeated with one id never count as an earlier document of each other; a
null id counts as larger than any other; texts of any length count whole
(memory: see :mod:`passages`; a batch's array takes about 60 bytes a byte); an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Scheme, repeated_windows, spans_of

WINDOW = 50
SEED = 24
BLOCK_BYTES = 4 << 20
BATCH_WINDOWS = 30_000

SCHEMA = ("doc_id long, n_bytes long, n_removed long, n_spans long, spans array<int>, "
          "kept binary")


def suffix_array(segments: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array of some segments, as places in the row of all their
    windows, and the suffixes' first ``window`` bytes in that order.  A closing
    byte keeps trailing NULs apart from padding."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments], np.int64)
    n = size - window + 1
    start = np.repeat(np.cumsum(size) - size, n) + (
        np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    text = np.empty((len(start), window + 1), np.uint8)
    text[:, :window] = np.lib.stride_tricks.sliding_window_view(raw, window)[start]
    text[:, window] = 1
    keys = text.view(f"S{window + 1}").ravel()
    order = np.argsort(keys, kind="stable")
    return order, keys[order]


def merge(a: tuple, b: tuple) -> tuple:
    """Two sorted levels as one (a stable sort merges the two runs)."""
    keys = np.concatenate([a[0], b[0]])
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([a[1], b[1]])[order]


class Family:
    """Sorted levels of distinct strings with the smallest id that has them,
    the largest level first."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def scan(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the sorted ``keys`` some level has, and under which id."""
        found, first = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        for level, ids in self.levels:
            at = np.searchsorted(level, keys)
            at[at == len(level)] = 0
            here = level[at] == keys
            found |= here
            first[here] = ids[at[here]]
        return found, first

    def insert(self, keys: np.ndarray, ids: np.ndarray) -> None:
        """Add new sorted distinct strings as a level; merge like sizes."""
        level = keys, ids
        while self.levels and len(self.levels[-1][0]) < 2 * len(level[0]):
            level = merge(self.levels.pop(), level)
        if len(level[0]):
            self.levels.append(level)


def _batches(messages, window: int, least: int):
    """Messages gathered to batches of at least ``least`` windows: the work per
    batch does not depend on how finely the documents were cut into blocks."""
    held, size = [], 0
    for null, ids, segments in messages:
        held.append((null, ids, segments))
        size += sum(map(len, segments)) - (window - 1) * len(segments)
        if size >= least:
            yield held
            held, size = [], 0
    if held:
        yield held


def scan_family(messages, window: int = WINDOW, least: int = BATCH_WINDOWS):
    """Flags per message (null, ids, segments): does a document with a smaller
    id have the window?"""
    family, whole = Family(), {}
    for batch in _batches(messages, window, least):
        segments = [s for _, _, part in batch for s in part]
        null = np.repeat([x for x, _, _ in batch], [len(part) for _, _, part in batch])
        ids = np.concatenate([i for _, i, _ in batch]) if segments else np.zeros(0, np.int64)
        known = np.array([s in whole and (x or whole[s] < i)
                          for s, x, i in zip(segments, null.tolist(), ids.tolist())], bool)
        n = np.array([len(s) - window + 1 for s in segments], np.int64)
        flags = np.repeat(known.astype(np.uint8), n)
        fresh = [s for s, k in zip(segments, known) if not k]
        if fresh:
            order, keys = suffix_array(fresh, window)
            old, old_id = family.scan(keys)
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            heads, run = np.flatnonzero(new), np.cumsum(new) - 1
            own = np.repeat(ids[~known], n[~known])[order]
            alone = np.repeat(null[~known], n[~known])[order]
            # the smallest id of each run of equal suffixes, if any has one
            least_id = np.minimum.reduceat(np.where(alone, np.iinfo(np.int64).max, own), heads)
            some = np.logical_or.reduceat(~alone, heads)
            earlier = (old & (old_id < own)) | (some[run] & (least_id[run] < own))
            hit = np.empty(len(order), np.uint8)
            hit[order] = np.where(alone, old | some[run], earlier)
            flags[np.repeat(~known, n)] = hit
            add = some & ~old[heads]
            family.insert(keys[heads[add]], least_id[add])
            for s, x, i in zip(segments, null.tolist(), ids.tolist()):
                if not x:
                    whole[s] = min(whole.get(s, i), i)
        ends = np.cumsum([0, *(int(x) for x in n)])
        at = np.cumsum([0, *(len(part) for _, _, part in batch)])
        for lo, hi in zip(at[:-1], at[1:]):
            yield flags[ends[lo]:ends[hi]]


def _finish(ids, chunk, covered) -> pa.Table:
    n, gone, spans, kept = [], [], [], []
    for lo, hi in zip(chunk.doc_lo.tolist(), chunk.doc_hi.tolist()):
        n.append(hi - lo)
        s = spans_of(covered, lo, hi)
        gone.append(sum(s[1::2]) - sum(s[::2]))
        spans.append(s)
        cuts = [lo, *[lo + x for x in s], hi]
        kept.append(b"".join(chunk.buf[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(n, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()),
                     "n_spans": pa.array([len(s) // 2 for s in spans], pa.int64()),
                     "spans": pa.array(spans, pa.list_(pa.int32())),
                     "kept": pa.array(kept, pa.binary())})


def suffix_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED,
                 block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
                 text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans`` (flat starts and ends,
    in bytes) and ``kept`` (the remaining bytes)."""
    return repeated_windows(
        docs, Scheme(window, seed, words=False), lambda b: scan_family(b, window), _finish,
        SCHEMA, block_bytes, id_col, text_col, **options)


def suffix_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans",
                         F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """doc_id -> (n_bytes, n_removed, n_spans, kept), for tests with unique ids."""
    raw = {d: (t or "").encode() for d, t in docs}
    first: dict[bytes, int] = {}
    for d in sorted(raw):
        for i in range(len(raw[d]) - window + 1):
            first.setdefault(raw[d][i:i + window], d)
    out = {}
    for d, b in raw.items():
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i:i + window]] < d:
                gone[i:i + window] = b"\1" * window
        runs = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, bytes(x for x, g in zip(b, gone) if not g))
    return out
