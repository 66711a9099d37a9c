"""Byte-level BPE encoding by backtracking, and decoding by an offset table.

*Encoding.*  Text is cut by the vocabulary's split pattern; each piece is
encoded on its own.  An Aho-Corasick automaton over all tokens gives the
longest token at every byte of a piece.  The encoder walks left to right,
takes the longest token that is compatible with the token before it, falls
back to the next shorter token that is a prefix, and steps back when none
is left; positions found impossible are marked, so each is left at most
once and the walk is linear.  Two tokens are compatible when no merge across
their border would have been applied before the merges that built them; the
answers are kept in a pair table.  The result is the merge list's own
segmentation.

*Decoding.*  All token bytes stand in one array with an offset per id; a
whole id array is decoded by one gather.

The encoder runs inside ``mapInArrow``, needs no shuffle, and holds one slice
of texts and a bounded piece cache per worker.

*Edge cases.*  Null text is empty and has no ids.  Special tokens' strings
inside a text become their ids, as the vocabulary file's default says.
Extra input columns are dropped.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_slices, id_text

# Fixed value: the public split pattern of byte-level BPE vocabularies.
SPLIT_PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"""
                 r"""|\s+(?!\S)|\s+""")

PIECE_CACHE = 150_000  # pieces in each of the cache's two generations,
CACHED_CHARS = 32      # none longer than this: with its ids at most 300 bytes
PAIR_CACHE = 200_000


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: printable Latin-1 bytes stand
    for themselves, the others follow from U+0100 on in byte order."""
    keep = [b for b in range(256)
            if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    out = {chr(b): b for b in keep}
    rest = [b for b in range(256) if b not in set(keep)]
    out.update({chr(0x100 + i): b for i, b in enumerate(rest)})
    return out


class Vocabulary:
    """Tables of one vocabulary file (tokenizers JSON, byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = _byte_alphabet()
        raw = lambda s: bytes(alphabet[c] for c in s)
        vocab = spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *specials.values()]) + 1
        self.specials = specials
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            self.bytes_of[i] = raw(s)
        for s, i in specials.items():
            self.bytes_of[i] = s.encode()
        self.id_of = {raw(s): i for s, i in vocab.items() if s not in specials}
        # merge order: single bytes first, then the products of the merges in turn
        self.rank = {i: -1 for b, i in self.id_of.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.product: dict[tuple[int, int], int] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m if isinstance(m, list) else m.split(" ")
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            self.product[a, b] = c
            if c not in self.parts:
                self.parts[c], self.rank[c] = (a, b), r
        ends = np.cumsum([0, *map(len, self.bytes_of)])
        self.offsets = ends.astype(np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)


class Encoder:
    """The backtracking encoder of one vocabulary; one per worker process."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        self.v = v = vocabulary_of(path)
        self.split = regex.compile(SPLIT_PATTERN).findall
        self.special = (regex.compile("(" + "|".join(
            regex.escape(s) for s in sorted(v.specials, key=len, reverse=True)) + ")")
            if v.specials else None)
        self.automaton = ahocorasick.Automaton()
        usable = [i for i in v.id_of.values() if i in v.rank]
        for i in usable:
            self.automaton.add_word(v.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        # the next shorter token that is a prefix of a token
        self.shorter: dict[int, int | None] = {}
        known = {v.bytes_of[i]: i for i in usable}
        for i in usable:
            b = v.bytes_of[i]
            self.shorter[i] = next((known[b[:n]] for n in range(len(b) - 1, 0, -1)
                                    if b[:n] in known), None)
        self.length = {i: len(v.bytes_of[i]) for i in usable}
        self.pairs: dict[int, bool] = {}
        # two generations: what the full one has and is asked for again moves on
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.packed_id = [i.to_bytes(4, "little") for i in range(len(v.bytes_of))]

    def compatible(self, a: int, b: int) -> bool:
        """Whether token ``b`` may follow token ``a``: undo the later of the
        two tokens' merges step by step; if at some step the two inner
        neighbours would themselves merge earlier than what was undone, the
        border could not have survived."""
        key = a << 32 | b
        v, rank = self.v, self.v.rank
        left, right = a, b
        # a merge across the border beats the one undone last if its rank is
        # lower; on equal rank the leftmost place is merged first
        bound = len(rank)
        answer = None
        while answer is None:
            across = v.product.get((left, right))
            if across is not None and rank[across] < bound:
                answer = False
            elif left in v.parts and (right not in v.parts or rank[left] > rank[right]):
                bound = rank[left]
                left = v.parts[left][1]
            elif right in v.parts:
                bound = rank[right] + 1
                right = v.parts[right][0]
            else:
                answer = True
        if len(self.pairs) >= PAIR_CACHE:
            self.pairs.clear()
        self.pairs[key] = answer
        return answer

    def piece(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        n, length = len(data), self.length
        longest = [0] * n
        best = [0] * n
        for end, i in self.automaton.iter(data.decode("latin-1")):
            start = end + 1 - length[i]
            if length[i] > best[start]:
                best[start], longest[start] = length[i], i
        open_at = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        known, compatible, shorter = self.pairs.get, self.compatible, self.shorter
        pos, tok = 0, longest[0]
        while True:
            end = pos + length[tok]
            if open_at[end]:
                if not out:
                    fits = True
                else:
                    fits = known(out[-1] << 32 | tok)
                    if fits is None:
                        fits = compatible(out[-1], tok)
                if fits:
                    out.append(tok)
                    if end == n:
                        return out
                    pos, tok = end, longest[end]
                    continue
            nxt = shorter[tok]
            if nxt is None:
                open_at[pos] = 0
                nxt = out.pop()
                pos -= length[nxt]
            tok = nxt

    def _packed(self, piece: str) -> bytes:
        got = self.pieces.get(piece)
        if got is not None:
            return got
        got = self.older.get(piece)
        if got is None:
            ids = self.packed_id
            got = b"".join([ids[i] for i in self.piece(piece.encode())])
            if len(piece) > CACHED_CHARS:
                return got
        if len(self.pieces) >= PIECE_CACHE:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = got
        return got

    def encode(self, text: str) -> bytes:
        """Ids of a text, packed as little-endian unsigned 32-bit integers."""
        parts = self.special.split(text) if self.special else [text]
        out: list[bytes] = []
        get, packed = self.pieces.get, self._packed
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.v.specials[part].to_bytes(4, "little"))
            else:
                out.extend([get(p) or packed(p) for p in self.split(part)])
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return decode_ids(self.v, np.frombuffer(packed, "<u4"))


def decode_ids(v: Vocabulary, ids: np.ndarray) -> bytes:
    """Bytes of an id array: one gather through the offset table."""
    ids = ids.astype(np.int64)
    lo = v.offsets[ids]
    n = v.offsets[ids + 1] - lo
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    at = np.arange(total) + np.repeat(lo - (ends - n), n)
    return v.all_bytes[at].tobytes()


_VOCABULARIES: dict[str, Vocabulary] = {}
_ENCODERS: dict[str, Encoder] = {}


def vocabulary_of(path: str) -> Vocabulary:
    """The worker's tables of a vocabulary file, read once per process."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a vocabulary file, built once per process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens long, ids binary`` (little-endian unsigned 32-bit).
    ``vocabulary``: path of the tokenizers JSON on every node."""
    def body(cols):
        ids, texts = cols
        enc = encoder(vocabulary)
        packed = [enc.encode(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()),
             pa.array(packed, pa.binary())], ["doc_id", "n_tokens", "ids"])
    return id_text(docs, id_col, text_col).mapInArrow(
        by_slices(256, body, ["doc_id", "text"]), "doc_id long, n_tokens long, ids binary")


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """Adds ``decoded string`` to the columns ``doc_id, n_tokens, ids`` of
    :func:`bpe_encode`; bytes that are not UTF-8 become U+FFFD."""
    def body(cols):
        ids, counts, packed = cols
        v = vocabulary_of(vocabulary)
        texts = [decode_ids(v, np.frombuffer(p or b"", "<u4")).decode("utf-8", "replace")
                 for p in packed]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(counts, pa.int64()),
             pa.array(packed, pa.binary()), pa.array(texts, pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"])
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(
        by_slices(256, body, ["doc_id", "n_tokens", "ids"]),
        "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_roundtrip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: :func:`bpe_encode` and
    :func:`bpe_decode` in one pass, by one worker per task."""
    def body(cols):
        ids, texts = cols
        enc = encoder(vocabulary)
        packed = [enc.encode(t) for t in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([len(p) // 4 for p in packed], pa.int64()),
             pa.array(packed, pa.binary()),
             pa.array([enc.decode(p).decode("utf-8", "replace") for p in packed], pa.string())],
            ["doc_id", "n_tokens", "ids", "decoded"])
    return id_text(docs, id_col, text_col).mapInArrow(
        by_slices(256, body, ["doc_id", "text"]),
        "doc_id long, n_tokens long, ids binary, decoded string")


def bpe_digest(docs: DataFrame, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """Round trip of every document, as digests (and the ids themselves)."""
    return bpe_roundtrip(docs, vocabulary).select(
        "doc_id", "n_tokens", *(["ids"] if with_ids else []),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
