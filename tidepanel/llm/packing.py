"""Packed training sequences: token ids in rows of a fixed length.

Documents are tokenised where they are, and each task packs its stream of
documents block by block (:data:`BLOCK_TOKENS` tokens at a time), so nothing
is shuffled and a task holds one block.  A document longer than a row is split
losslessly into full rows and a rest.  Within a block, best-fit decreasing:
segments in descending length, each into the open row with the least space
left that holds it.  A segment tree over the possible free spaces finds that
row in logarithmic time.

Each output row has the padded id row, the cumulative segment lengths and the
position ids, which start again at 0 with every segment.

*Edge cases.*  Null or empty texts have no tokens and are in no row (they
lose nothing); repeated rows are packed each; a text of any length is split over
rows; ids are held in 16 or 32 bits by the size of the vocabulary, whatever the
padding id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices

LENGTH = 2048
BLOCK_TOKENS = 2_000_000
PAD = 50_256

_LOADED: dict[str, object] = {}


def tokenizer(rank_file: str):
    """Ordinary encoder of a public rank file, once per worker."""
    if rank_file not in _LOADED:
        import base64

        import public_tokenizers
        import tiktoken
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[rank_file] = tiktoken.Encoding(
            "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[rank_file]


class SpaceTree:
    """Segment tree over free spaces 0..capacity: each leaf counts the open
    rows with that much space, each inner node whether any is below it."""

    def __init__(self, capacity: int):
        self.size = 1 << max(1, capacity.bit_length())
        self.count = [0] * (2 * self.size)

    def add(self, space: int, by: int) -> None:
        i = space + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def least_at_least(self, space: int) -> int | None:
        """The smallest free space of an open row that is >= ``space``."""
        i = space + self.size
        if self.count[i]:
            return space
        while i > 1:  # climb to the first right sibling with an open row
            if not i & 1 and self.count[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.count[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of segment numbers.  Every length is in 1..capacity; ties go by
    segment number and, among rows of equal space, to the latest opened."""
    tree, rows = SpaceTree(capacity), []
    with_space: dict[int, list[int]] = {}
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        n = lengths[k]
        space = tree.least_at_least(n)
        if space is None:
            rows.append([])
            at, space = len(rows) - 1, capacity
        else:
            tree.add(space, -1)
            at = with_space[space].pop()
        rows[at].append(k)
        if space - n:
            tree.add(space - n, 1)
            with_space.setdefault(space - n, []).append(at)
    return rows


def _rows_of_block(segments, length: int, pad: int, first_id: int):
    """Arrow batch of one packed block; ``segments``: (doc_id, part, ids)."""
    rows = best_fit_decreasing([len(s[2]) for s in segments], length)
    out = {k: [] for k in ("pack_id", "doc_ids", "parts", "cu_seqlens", "n_tokens", "ids",
                           "position_ids")}
    for k, row in enumerate(rows):
        ids = [segments[j][2] for j in row]
        sizes = [len(x) for x in ids]
        used = sum(sizes)
        line = np.full(length, pad, "<u4")
        line[:used] = np.concatenate(ids)
        place = np.zeros(length, "<u4")
        place[:used] = np.concatenate([np.arange(s) for s in sizes])
        out["pack_id"].append(first_id + k)
        out["doc_ids"].append([segments[j][0] for j in row])
        out["parts"].append([segments[j][1] for j in row])
        out["cu_seqlens"].append([0, *np.cumsum(sizes).tolist()])
        out["n_tokens"].append(used)
        out["ids"].append(line.tobytes())
        out["position_ids"].append(place.tobytes())
    types = {"pack_id": pa.int64(), "doc_ids": pa.list_(pa.int64()),
             "parts": pa.list_(pa.int32()), "cu_seqlens": pa.list_(pa.int32()),
             "n_tokens": pa.int64(), "ids": pa.binary(), "position_ids": pa.binary()}
    for lo in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[k][lo:lo + 256], t) for k, t in types.items()], list(types))


PACK_SCHEMA = ("pack_id long, doc_ids array<long>, parts array<int>, cu_seqlens array<int>, "
               "n_tokens long, ids binary, position_ids binary")


def pack(docs: DataFrame, rank_file: str, length: int = LENGTH, pad: int = PAD,
         block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per packed sequence (see the module docstring); ids and
    position ids are ``length`` little-endian unsigned 32-bit integers.
    ``pack_id``: partition number * 2**40 + running number."""
    def body(batches):
        enc = tokenizer(rank_file)
        width = np.uint16 if enc.n_vocab <= 1 << 16 else np.uint32
        at = TaskContext.get().partitionId() << 40
        held, segments = 0, []
        for batch in batches:
            for b in slices(batch, 128, "text"):
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    ids = np.array(enc.encode_ordinary(text), width)
                    held += len(ids)
                    segments += [(doc, k, ids[p:p + length])
                                 for k, p in enumerate(range(0, len(ids), length))]
                    if held >= block_tokens:
                        for out in _rows_of_block(segments, length, pad, at):
                            at += out.num_rows
                            yield out
                        held, segments = 0, []
        for out in _rows_of_block(segments, length, pad, at):
            yield out
    return id_text(docs, id_col, text_col).mapInArrow(body, PACK_SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Id rows, segment bounds and position resets as Parquet; every row of
    ``ids`` and ``position_ids`` has the same width, so a reader stacks them
    into matrices without parsing."""
    packed.write.mode("errorifexists").parquet(path)


def pack_digest(packed: DataFrame) -> DataFrame:
    return packed.select("pack_id", "doc_ids", "parts", "cu_seqlens", "n_tokens",
                         F.sha2("ids", 256).alias("ids_sha256"),
                         F.sha2("position_ids", 256).alias("positions_sha256"))
