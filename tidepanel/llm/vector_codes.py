"""Vector codes by product quantisation, with an equal-average nearest search.

Method.  Components become whole numbers, floor(``scale`` * x), so every
distance is exact.  A vector is cut into ``parts`` equal parts, each with a
codebook of ``entries`` entries.  The nearest entry is found by the equal-average
search: entries are sorted by component sum; from where the part's own sum
stands, candidates are taken outward, the nearer side first, until on both sides
the squared gap of the sums over the part's dimension strictly exceeds the best
squared distance (by Cauchy-Schwarz no entry further out can be as near; an
equal bound is still looked at, for ties go to the lower index).  The search
runs for all vectors of a batch at once in numpy; a vector leaves as soon as
both its sides are exhausted.

A round is one map over the vectors: each task adds up count and component sums
per (part, entry) and emits at most parts * entries rows, which Spark sums; the
new codebooks (``parts`` x ``entries`` x dimension, bounded by parameters) go
back with the next round.  The last assignment is written once to the shared
folder; errors per label are summed from it by a grouped aggregate and joined
back with the labels' sums dealt over ``salts``, so a label that holds a third
of all rows is spread.

Defined results.  Vectors that are null, empty, or hold a null or non-finite
component are left out, and so are vectors of another length than that of the
smallest kept id (ties: the smaller vector).  That length must be a multiple of
``parts``, else ValueError.  Fewer kept vectors than ``entries`` make smaller
codebooks; a table without kept vectors gives no rows.  Null ids sort last,
repeated rows count each, null labels are one label.  Whole numbers beyond
``2**26`` in absolute value leave the range in which 64-bit sums of squared
distances are safe: such a component raises ArithmeticError.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import prepare
from .common import work_table

LARGEST = 1 << 26
_BATCH = 1 << 14


def kept_vectors(embeddings: DataFrame, scale: int = 256, vector_col: str = "embedding",
                 id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v): whole-number vectors of the rows that are kept."""
    x = F.col(f"`{vector_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                             F.col(f"`{label_col}`").alias("label"), x.alias("x"))
    big = F.lit(float(LARGEST))
    whole = F.transform("x", lambda c: F.when(
        F.abs(c * scale) <= big, F.floor(c * scale).cast("long")).otherwise(
        F.raise_error(F.lit("component beyond 2**26")).cast("long")))
    return (rows.filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~bad.eqNullSafe(True))
            .select("vec_id", "label", whole.alias("v")))


# --- the search -----------------------------------------------------------------

def equal_average_search(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest row of ``book`` for every row of ``x`` (ties: the
    lower index) and its squared distance; whole numbers in, exact."""
    n, dim = x.shape
    order = np.argsort(book.sum(axis=1), kind="stable")
    entries, sums = book[order], book[order].sum(axis=1)
    own = x.sum(axis=1)
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, len(book))
    # the next candidates below and above, and the rows still searching
    high = np.searchsorted(sums, own)
    low, row = high - 1, np.arange(n)
    none = np.iinfo(np.int64).max
    while len(row):
        lo, hi, s = low[row], high[row], own[row]
        gap_lo = np.where(lo >= 0, s - sums[np.maximum(lo, 0)], none)
        gap_hi = np.where(hi < len(sums), sums[np.minimum(hi, len(sums) - 1)] - s, none)
        take_lo = gap_lo <= gap_hi
        gap = np.minimum(gap_lo, gap_hi)
        near = gap < none
        # gap**2 / dim > best, in whole numbers; the first candidate is always taken
        bound = np.where(best[row] == none, none, np.minimum(best[row], none // dim) * dim)
        near[near] &= gap[near] ** 2 <= bound[near]
        row, lo, hi, take_lo = row[near], lo[near], hi[near], take_lo[near]
        at = np.where(take_lo, lo, hi)
        distance = ((x[row] - entries[at]) ** 2).sum(axis=1)
        better = (distance < best[row]) | ((distance == best[row]) & (order[at] < index[row]))
        best[row[better]], index[row[better]] = distance[better], order[at[better]]
        low[row], high[row] = lo - take_lo, hi + ~take_lo
    return index, best


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assigned(m: np.ndarray, books: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(part, indexes, distances) for every part position of the rows of ``m``."""
    width = books.shape[2]
    for p, book in enumerate(books):
        yield p, *equal_average_search(m[:, p * width:(p + 1) * width], book)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, _BATCH):
            yield batch.slice(lo, _BATCH)


def _round(books: np.ndarray):
    """Count and component sums per (part, entry) of a task's rows."""
    parts, entries, width = books.shape

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), np.int64)
        total = np.zeros((parts, entries, width), np.int64)
        for batch in _pieces(batches):
            m = _matrix(batch.column(0), parts * width)
            for p, index, _ in _assigned(m, books):
                count[p] += np.bincount(index, minlength=entries)
                np.add.at(total[p], index, m[:, p * width:(p + 1) * width])
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays(
                [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                 pa.ListArray.from_arrays(np.arange(0, len(p) * width + 1, width, np.int32),
                                          total[p, e].ravel())],
                names=["part", "entry", "n", "total"])
    return body


def _codes(books: np.ndarray):
    parts, _, width = books.shape
    hexed = np.array([f"{i:02x}" for i in range(256)])

    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            m = _matrix(batch.column(2), parts * width)
            code, error = np.zeros(len(m), "U0"), np.zeros(len(m), np.int64)
            for _, index, distance in _assigned(m, books):
                code = np.char.add(code, hexed[index])
                error += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(code.tolist(), pa.string()),
                 pa.array(error)], names=["vec_id", "label", "code", "error"])
    return body


# --- the operator -----------------------------------------------------------------

def _updated(books: np.ndarray, vectors: DataFrame) -> np.ndarray:
    """One round: every used entry becomes the floor of its parts' mean."""
    width = books.shape[2]
    sums = (vectors.select("v").mapInArrow(
        _round(books), "part int, entry int, n long, total array<long>")
        .groupBy("part", "entry").agg(F.sum("n").alias("n"),
                                      *[F.sum(F.col("total")[j]).alias(f"t{j}")
                                        for j in range(width)]))
    books = books.copy()
    for r in sums.collect():  # at most one row per entry of the codebooks
        books[r.part, r.entry] = [r[f"t{j}"] // r.n for j in range(width)]
    return books


def codebook_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry, position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(embeddings: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2,
                 scale: int = 256, salts: int = 32, vector_col: str = "embedding",
                 id_col: str = "vec_id", label_col: str = "label") -> DataFrame:
    """One row per kept vector: vec_id, label, code (two hex digits a part),
    error, label_error (sum over equal labels), codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    spark = embeddings.sparkSession
    prepare(spark)
    vectors = kept_vectors(embeddings, scale, vector_col, id_col, label_col)
    # with one length the first ``entries`` rows are the start; other lengths are few or none
    by_id = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = vectors.orderBy(*by_id).limit(1).collect()
    dim = len(first[0].v) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of {dim} components cannot be cut into {parts} equal parts")
    vectors = vectors.filter(F.size("v") == dim)
    start = [r.v for r in vectors.orderBy(*by_id).limit(entries).collect()]
    label = embeddings.schema[label_col].dataType.simpleString()
    schema = f"vec_id long, label {label}, code string, error long"
    if not start:
        return spark.createDataFrame([], schema + ", label_error long, codebooks_sha256 string")
    books = np.array(start, np.int64).reshape(len(start), parts, -1).swapaxes(0, 1).copy()
    for _ in range(rounds):
        books = _updated(books, vectors)

    coded = work_table(vectors.mapInArrow(_codes(books), schema), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    dealt = sums.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    left = coded.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(salts)).cast("int"))
    on = left["label"].eqNullSafe(dealt["label"]) & (left["salt"] == dealt["salt"])
    return left.join(dealt, on).select(
        left["vec_id"], left["label"], "code", "error", "label_error",
        F.lit(codebook_digest(books)).alias("codebooks_sha256"))


# --- the same in SQL ----------------------------------------------------------------

def oracle(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """DuckDB SQL for the query: every part against every entry."""
    def near(k: int) -> str:
        return f"""
    d{k} AS (
        SELECT c.row, c.part, b.entry, sum((c.c - b.c) * (c.c - b.c)) AS d
        FROM cells c JOIN book{k} b ON b.part = c.part AND b.pos = c.pos GROUP BY ALL),
    near{k} AS (
        SELECT row, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{k}
        GROUP BY row, part)"""

    def update(k: int) -> str:
        return f"""
    book{k + 1} AS (
        SELECT b.part, b.entry, b.pos, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
            SELECT n.part, n.entry, c.pos,
                   CAST((sum(c.c) - (sum(c.c) % count(*) + count(*)) % count(*))
                        // count(*) AS BIGINT) AS c
            FROM near{k} n JOIN cells c ON c.row = n.row AND c.part = n.part
            GROUP BY ALL) m ON m.part = b.part AND m.entry = b.entry AND m.pos = b.pos)"""

    steps = ",".join(near(k) + "," + update(k) for k in range(rounds)) + "," + near(rounds)
    return f"""
    WITH kept AS (
        SELECT row_number() OVER (ORDER BY vec_id) AS row, vec_id, label, embedding AS e
        FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    cells AS (
        SELECT row, (i - 1) // (len(e) // {parts}) AS part, (i - 1) % (len(e) // {parts}) AS pos,
               CAST(floor(e[i]::DOUBLE * {scale}) AS BIGINT) AS c
        FROM (SELECT row, e, unnest(range(1, len(e) + 1)) AS i FROM kept)),
    book0 AS (SELECT part, row - 1 AS entry, pos, c FROM cells WHERE row <= {entries}),
    {steps},
    done AS (
        SELECT row, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
               CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY row)
    SELECT k.vec_id, d.code, d.error,
           CAST(sum(d.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error,
           (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos))
            FROM book{rounds}) AS codebooks_sha256
    FROM kept k JOIN done d USING (row)"""
