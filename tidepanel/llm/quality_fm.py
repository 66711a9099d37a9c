"""Text quality by a factorisation machine.

Features of a text: its words hashed into :data:`BUCKETS` columns (log term
frequency, unit length per document) and some statistics of its structure
and size.  The machine adds a linear part and low-rank pairwise interactions

    score = w0 + sum_i w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

whose right-hand side costs time linear in the non-zero features.

*Training* uses a bounded sample: at most ``max_sample`` labelled documents, the
first in the order of a hash of their id (one text per id).  Its features are computed where
the documents are, and one task fits the model (a few MB).  *Scoring* is a
map over all documents, without a shuffle.

*Edge cases.*  A null text is empty and gets a score (its structure says
so); null metadata counts as missing (0 with a missing flag); several labels
of one document are averaged; rows without a label train nothing; with no
labels at all every score is 0.5.  Repeated rows are scored one by one, and
train once; a text of any length is read whole (a slice of rows ends at 1 MB of
text, a longer text is a slice, with arrays of about 60 bytes a byte); extra
columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import (
    carried_back,
    id_text,
    id_text_carry,
    slices,
    word_hashes,
    word_spans,
)

BUCKETS = 1 << 15
RANK = 6
MAX_SAMPLE = 10_000
SLICE = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 44, 46, 58, 59, 63]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_SYMBOL &= ~_STOP
N_STATS = 14


def features(texts: list[str], sizes: list[int | None]):
    """Sparse word features and dense statistics of some texts: ``row``
    (sorted), ``col``, ``val`` and a matrix of :data:`N_STATS` columns."""
    n = len(texts)
    blobs = [t.encode() for t in texts]
    lens = np.array([len(b) for b in blobs], np.int64)
    raw = np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)
    ends = np.cumsum(lens + 1)
    starts = ends - lens - 1
    lo, hi = word_spans(raw, ~_SPACE)
    doc = np.searchsorted(ends, lo, side="right")
    h = word_hashes(raw, lo, hi)
    per_doc = np.bincount(doc, minlength=n)

    # distinct words of a document (by their full hash) and their counts
    order = np.lexsort((h, doc))
    d, hs = doc[order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (hs[1:] != hs[:-1])
    at = np.flatnonzero(new)
    tf = np.diff(np.append(at, len(d)))
    row, col = d[at], (hs[at] >> np.uint64(64 - 15)).astype(np.int64)
    val = np.log1p(tf.astype(np.float64))
    norm = np.sqrt(np.bincount(row, val * val, minlength=n))
    val = val / np.maximum(norm, 1e-12)[row]

    def share(mask):  # of a document's bytes; the separators lie outside [start, end)
        c = np.concatenate([[0], np.cumsum(mask[raw])])
        return (c[ends - 1] - c[starts]) / np.maximum(lens, 1)

    words = np.maximum(per_doc, 1)
    wlen = (hi - lo).astype(np.float64)
    top = np.zeros(n)
    np.maximum.at(top, row, tf)
    same_next = np.zeros(n)
    if len(doc) > 1:
        rep = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        same_next = np.bincount(doc[1:][rep], minlength=n)
    last = raw[np.maximum(hi - 1, 0)] if len(hi) else np.zeros(0, np.uint8)
    first = raw[lo] if len(lo) else np.zeros(0, np.uint8)
    lone = (hi - lo == 1) & _SYMBOL[first]
    known = np.array([s is not None for s in sizes])
    meta = np.array([float(s or 0) for s in sizes])
    stats = np.stack([
        np.log1p(per_doc) / 5.0,
        np.bincount(doc, wlen, minlength=n) / words / 8.0,
        np.bincount(row, minlength=n) / words,
        top / words * 3.0,
        same_next / words * 3.0,
        share(_UPPER) * 3.0,
        share(_DIGIT) * 3.0,
        share(_STOP) * 5.0,
        share(_SYMBOL) * 5.0,
        np.bincount(doc[_SYMBOL[last]], minlength=n) / words * 2.0,
        np.bincount(doc[lone], minlength=n) / words * 3.0,
        (per_doc == 0).astype(float),
        np.where(known, np.log1p(np.maximum(meta, 0)) / 8.0, 0.0),
        (~known).astype(float),
    ], axis=1)
    return row, col, val, stats


def _design(row, col, val, stats):
    """One sparse matrix of both feature kinds: the statistics take the
    columns after the hashed words."""
    n = len(stats)
    r = np.concatenate([row, np.repeat(np.arange(n), N_STATS)])
    c = np.concatenate([col, np.tile(BUCKETS + np.arange(N_STATS), n)])
    v = np.concatenate([val, stats.ravel()])
    o = np.argsort(r, kind="stable")
    return r[o], c[o], v[o]


def raw_scores(model, r, c, v, n: int):
    """Linear part, plus the interactions by the sum-of-squares identity;
    also the per-factor sums the gradient needs."""
    w0, w, vf = model
    out = w0 + np.bincount(r, w[c] * v, minlength=n)
    sums = np.empty((n, vf.shape[1]))
    for f in range(vf.shape[1]):
        t = vf[c, f] * v
        sums[:, f] = np.bincount(r, t, minlength=n)
        out += 0.5 * (sums[:, f] ** 2 - np.bincount(r, t * t, minlength=n))
    return out, sums


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(row_ptr, col, val, stats, y, epochs: int = 12, batch: int = 128, rate: float = 0.05,
        l2: float = 2e-4, seed: int = 7):
    """Adagrad over mini-batches in a fixed order; logistic loss."""
    rng = np.random.default_rng(seed)
    n, dim = len(y), BUCKETS + N_STATS
    w0, w, vf = 0.0, np.zeros(dim), rng.normal(0, 0.05, (dim, RANK))
    g0, gw, gv = 1e-6, np.full(dim, 1e-6), np.full((dim, RANK), 1e-6)
    for _ in range(epochs):
        order = rng.permutation(n)
        for lo in range(0, n, batch):
            pick = np.sort(order[lo:lo + batch])
            counts = row_ptr[pick + 1] - row_ptr[pick]
            at = (np.arange(counts.sum())
                  + np.repeat(row_ptr[pick] - (np.cumsum(counts) - counts), counts))
            r, c, v = _design(np.repeat(np.arange(len(pick)), counts), col[at], val[at],
                              stats[pick])
            s, sums = raw_scores((w0, w, vf), r, c, v, len(pick))
            err = (sigmoid(s) - y[pick]) / len(pick)
            used, where = np.unique(c, return_inverse=True)
            ev = err[r] * v
            grad = np.bincount(where, ev) + l2 * w[used]
            gw[used] += grad ** 2
            w[used] -= rate * grad / np.sqrt(gw[used])
            d0 = err.sum()
            g0 += d0 ** 2
            w0 -= rate * d0 / np.sqrt(g0)
            for f in range(RANK):
                old = vf[c, f]
                grad = (np.bincount(where, ev * (sums[r, f] - old * v)) + l2 * vf[used, f])
                gv[used, f] += grad ** 2
                vf[used, f] -= rate * grad / np.sqrt(gv[used, f])
    return w0, w, vf


def _pack(model) -> bytes:
    w0, w, vf = model
    return np.concatenate([[w0], w, vf.ravel()]).astype("<f8").tobytes()


def _unpack(data: bytes | None):
    dim = BUCKETS + N_STATS
    if data is None:
        return 0.0, np.zeros(dim), np.zeros((dim, RANK))
    a = np.frombuffer(data, "<f8")
    return a[0], a[1:1 + dim], a[1 + dim:].reshape(dim, RANK)


def _feature_body(batches):
    for batch in batches:
        for part in slices(batch, SLICE, "text"):
            d = part.to_pydict()
            row, col, val, stats = features(d["text"], d["size"])
            ptr = np.searchsorted(row, np.arange(len(stats) + 1))
            yield pa.RecordBatch.from_arrays([
                pa.array(d["doc_id"], pa.int64()), pa.array(d["y"], pa.float64()),
                pa.array([col[a:e].astype("<u2").tobytes() for a, e in zip(ptr, ptr[1:])]),
                pa.array([val[a:e].astype("<f4").tobytes() for a, e in zip(ptr, ptr[1:])]),
                pa.array([s.astype("<f4").tobytes() for s in stats])],
                ["doc_id", "y", "cols", "vals", "stats"])


def _train(pdf):
    """One bounded group: the sample's features -> one row with the model."""
    import pandas as pd
    pdf = pdf.sort_values(["doc_id", "cols"], kind="stable")
    col = [np.frombuffer(b, "<u2") for b in pdf["cols"]]
    ptr = np.concatenate([[0], np.cumsum([len(c) for c in col])]).astype(np.int64)
    model = fit(ptr, np.concatenate(col).astype(np.int32),
                np.concatenate([np.frombuffer(b, "<f4") for b in pdf["vals"]]),
                np.stack([np.frombuffer(b, "<f4") for b in pdf["stats"]]).astype(float),
                pdf["y"].to_numpy(float))
    return pd.DataFrame({"model": [_pack(model)]})


def fold(id_col: str = "doc_id"):
    """crc32 of the id's text modulo 5; fold 0 is held out of training."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
          size_col: str | None = "n_chars", max_sample: int = MAX_SAMPLE) -> bytes | None:
    """The fitted model (bytes), or None without usable labels."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                           F.col(label_col).cast("double").alias("y"))
             .filter(F.col("y").isNotNull() & (fold() != 0))
             .groupBy("doc_id").agg(F.avg("y").alias("y")))
    texts = id_text(docs, extra=_size(size_col))
    # bounded: at most max_sample ids that have a document (16 bytes each), the
    # first by a hash; of rows repeated with one id one text, again by a hash
    sample = (known.join(texts.select("doc_id"), "doc_id", "left_semi")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_sample))
    rows = (texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "y")
            .agg(F.min_by(F.struct("text", "size"), F.struct(F.xxhash64("text"), "size"))
                 .alias("d")).select("doc_id", "d.text", "y", "d.size"))
    feats = rows.mapInArrow(_feature_body,
                            "doc_id long, y double, cols binary, vals binary, stats binary")
    got = (feats.groupBy(F.lit(0).alias("all")).applyInPandas(_train, "model binary")
           .collect())
    return bytes(got[0]["model"]) if got else None


def _size(size_col: str | None):
    return {"size": (F.lit(None) if size_col is None else F.col(f"`{size_col}`")).cast("long")}


def score(docs: DataFrame, model: bytes | None, size_col: str | None = "n_chars",
          threshold: float = 0.3, carry: list[str] = ()) -> DataFrame:
    """``doc_id, score, predicted`` for every document, plus the columns of
    ``carry`` as ``__carry_<name>``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    rows, text, kept = id_text_carry(docs, "doc_id", "text", carry, _size(size_col))

    def body(batches):
        m = _unpack(shipped.value)
        for batch in batches:
            for b in slices(batch, SLICE, text):
                at = b.schema.get_field_index
                feats = features([t or "" for t in b.column(at(text)).to_pylist()],
                                 b.column(at("size")).to_pylist())
                r, c, v = _design(*feats)
                s = sigmoid(raw_scores(m, r, c, v, b.num_rows)[0])
                yield pa.RecordBatch.from_arrays(
                    [b.column(at("doc_id")), pa.array(s),
                     pa.array((s >= threshold).astype(np.int32)),
                     *[b.column(at(k.name)) for k in kept]],
                    ["doc_id", "score", "predicted", *[k.name for k in kept]])
    schema = "doc_id long, score double, predicted int" + "".join(
        f", `{k.name}` {k.dataType.simpleString()}" for k in kept)
    return rows.mapInArrow(body, schema)


def keep_good(docs: DataFrame, model: bytes | None, size_col: str | None = "n_chars",
              threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches the threshold, with all columns."""
    return carried_back(score(docs, model, size_col, threshold, docs.columns)
                        .filter("predicted = 1"), docs.columns)
