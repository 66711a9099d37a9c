"""Token counts, with huge documents encoded in overlapping chunks.

A document longer than a chunk is encoded chunk by chunk, each chunk starting
some characters before the end of the last one.  The two encodings are
spliced at a *proven common boundary*: a character position that both put
between two pieces of the split pattern.

Why that is exact.  The split pattern has no look-behind and looks ahead by
one character, so a scan's state is its position alone: two scans that share
a boundary agree from there on.  In the left chunk every piece that ends at
least :data:`MARGIN` characters before the chunk's end is the piece of the
whole text (the margin covers the look-ahead and a special token's string cut
by the chunk's end).  So a boundary of the left chunk before that margin is a
boundary of the whole text, and if the right chunk has it as well, the right
chunk's tokens from there on are the whole text's.

If the overlap holds no common boundary, it is widened by doubling (re-encoding
the right chunk from further left), and if it has reached the last proven
boundary, the chunk itself is lengthened, up to the whole rest.

*Edge cases.*  Null text: zero bytes and tokens.  Special tokens' strings
inside texts follow the library's default.  Extra columns are dropped.
"""

from __future__ import annotations

import bisect
import os
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, id_text

CHUNK_CHARS = 16_384
OVERLAP_CHARS = 256
MARGIN = 64

_LOADED: dict[str, object] = {}


def _library(path: str):
    """The tokenizers library's model of a vocabulary file, once per worker.
    The library's own threads stay off: Spark runs one task per core."""
    if path not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _LOADED[path] = t
    return _LOADED[path]


class _Chunk:
    """One encoded stretch [start, end) of a text: token ends and the
    boundaries between pieces, as positions in the whole text."""

    def __init__(self, tok, text: str, start: int, end: int):
        enc = tok.encode(text[start:end], add_special_tokens=False)
        offsets, words = enc.offsets, enc.word_ids
        self.start, self.end, self.n = start, end, len(offsets)
        self.bounds = [start]
        self.before = [0]  # tokens before each boundary
        for k, (a, b) in enumerate(pairwise(words)):
            if a != b or a is None:
                self.bounds.append(start + offsets[k + 1][0])
                self.before.append(k + 1)
        self.bounds.append(end)
        self.before.append(self.n)


def count_long(tok, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> int:
    """Tokens of ``text``, from overlapping chunks."""
    size = len(text)
    left = _Chunk(tok, text, 0, min(size, chunk))
    total, proven = 0, 0  # tokens before the proven boundary `proven`
    while left.end < size:
        width = overlap
        while True:
            start = max(left.end - width, proven)
            right = _Chunk(tok, text, start, min(size, left.end + chunk))
            lo = bisect.bisect_left(left.bounds, start)
            hi = bisect.bisect_right(left.bounds, left.end - MARGIN)
            own = set(right.bounds[1:-1])
            if start == proven:
                own.add(proven)
            # the last common boundary needs no more of the left chunk than is proven
            at = next((k for k in range(hi - 1, lo - 1, -1)
                       if left.bounds[k] in own and left.bounds[k] >= proven), None)
            if at is not None and left.bounds[at] > proven:
                break
            if start == proven:
                # nothing to splice at: let the chunk grow from the proven boundary
                left, at = right, None
                break
            width *= 2
        if at is None:
            chunk *= 2
            continue
        point = left.bounds[at]
        base = left.before[bisect.bisect_left(left.bounds, proven)]
        total += left.before[at] - base
        proven, left = point, right
    return total + left.n - left.before[bisect.bisect_left(left.bounds, proven)]


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 1024, id_col: str = "doc_id",
                 text_col: str = "text", chunk: int = CHUNK_CHARS,
                 overlap: int = OVERLAP_CHARS) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` (more than ``limit`` tokens)."""
    def body(cols):
        ids, texts, sizes = cols
        tok = _library(vocabulary)
        counts = [0] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= chunk]
        for k, e in zip(short, tok.encode_batch_fast([texts[k] for k in short],
                                                     add_special_tokens=False)):
            counts[k] = len(e)
        for k, t in enumerate(texts):
            if len(t) > chunk:
                counts[k] = count_long(tok, t, chunk, overlap)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
             pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])
    rows = id_text(docs, id_col, text_col).withColumn("n_bytes",
                                                      F.octet_length("text").cast("long"))
    return (rows.mapInArrow(by_slices(64, body, ["doc_id", "text", "n_bytes"]),
                            "doc_id long, n_bytes long, n_tokens long")
            .withColumn("over_limit", F.col("n_tokens") > limit))
