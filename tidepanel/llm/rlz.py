"""Substring de-duplication by relative Lempel-Ziv parsing, on words.

A document loses every word inside a window of ``window`` words that also
starts in a document with a smaller id.

The collection is its own reference: segments in the order of the smallest id
that has them.  In :func:`parse_segments` each segment of a bucket is factored
greedily against the indexed text of the segments before it.  A factor begins
where a window is found in the index under a smaller id and goes on word by
word along the reference text as far as both agree; what is not found is a
literal word.  The windows that begin in a factor's last words and cross its
border belong to no factor, so the parse resumes there and checks them one
by one (they may be copied from elsewhere).  Then the segment itself is
indexed.  :mod:`passages` deals out the text and joins the answers.

*Edge cases.*  Null and empty texts and texts shorter than a window lose
nothing; rows repeated with one id never count as an earlier document of each
other; a null id counts as larger than any other; texts of any length are
parsed whole (memory: see :mod:`passages`); an empty table gives no rows; extra
columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .passages import Scheme, repeated_windows, spans_of

WINDOW = 13
SEED = 5
BLOCK_BYTES = 4 << 20

SCHEMA = "doc_id long, n_words long, n_removed long, spans array<int>, kept string"


def parse_segments(messages, window: int = WINDOW):
    """Flags per message (null, ids, segments): does a document with a smaller
    id have the window?"""
    index: dict[bytes, tuple[list[bytes], int, int]] = {}  # window -> text, place, id
    whole: dict[bytes, int] = {}  # segments that are reference text as a whole, their id
    for null, ids, segments in messages:
        flags: list[np.ndarray] = [None] * len(segments)
        for j in np.argsort(ids, kind="stable").tolist():
            seg, own = segments[j], int(ids[j])
            words = seg.split(b" ")
            n = len(words) - window + 1
            if null and seg in whole or whole.get(seg, own) < own:  # one factor
                flags[j] = np.ones(n, np.uint8)
                continue
            flags[j] = hit = np.zeros(n, np.uint8)
            keys = [b" ".join(words[i:i + window]) for i in range(n)]
            i = 0
            while i < n:
                source = index.get(keys[i])
                if source is None or not (null or source[2] < own):
                    i += 1  # a literal
                    continue
                text, at, _ = source
                size = window
                while (i + size < len(words) and at + size < len(text)
                       and words[i + size] == text[at + size]):
                    size += 1
                hit[i:i + size - window + 1] = 1
                # resume at the first window that crosses the factor's border
                i += size - window + 1
            if not null:
                whole.setdefault(seg, own)
                for i, key in enumerate(keys):
                    index.setdefault(key, (words, i, own))
        yield np.concatenate(flags) if flags else np.zeros(0, np.uint8)


def _finish(ids, chunk, covered) -> pa.Table:
    n, gone, spans, kept = [], [], [], []
    for lo, hi in zip(chunk.doc_lo.tolist(), chunk.doc_hi.tolist()):
        n.append(hi - lo)
        s = spans_of(covered, lo, hi)
        gone.append(sum(s[1::2]) - sum(s[::2]))
        spans.append(s)
        parts, at = [], lo
        for a, b in zip([*s[::2], hi - lo], [*s[1::2], hi - lo]):
            if lo + a > at:
                parts.append(chunk.buf[chunk.start[at]:chunk.end[lo + a - 1]])
            at = lo + b
        kept.append(b" ".join(parts).decode())
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n, pa.int64()),
                     "n_removed": pa.array(gone, pa.int64()),
                     "spans": pa.array(spans, pa.list_(pa.int32())),
                     "kept": pa.array(kept, pa.string())})


def rlz_dedup(docs: DataFrame, window: int = WINDOW, seed: int = SEED,
              block_bytes: int = BLOCK_BYTES, id_col: str = "doc_id",
              text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_words, n_removed, spans`` (flat starts and ends, in words)
    and ``kept`` (the remaining words, joined by one space)."""
    return repeated_windows(
        docs, Scheme(window, seed, words=True), lambda m: parse_segments(m, window), _finish,
        SCHEMA, block_bytes, id_col, text_col, **options)


def rlz_digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", "n_words", "n_removed",
                         F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple]:
    """doc_id -> (n_words, n_removed, kept text), for tests with unique ids."""
    words = {d: (t or "").encode().split() for d, t in docs}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i:i + window]), d)
    out = {}
    for d, ws in words.items():
        gone = set()
        for i in range(len(ws) - window + 1):
            if first[tuple(ws[i:i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(ws), len(gone),
                  b" ".join(w for i, w in enumerate(ws) if i not in gone).decode())
    return out
