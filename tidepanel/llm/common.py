"""Helpers shared by the text operators: input columns, work tables on the
shared folder, batch-wise Arrow iteration and vectorised text hashing."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare, shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            extra: dict[str, Column] | None = None) -> DataFrame:
    """Only the columns an operator works on, under fixed names (``doc_id``
    long, ``text`` string; a null text counts as empty).  Other columns of
    the input are dropped, so their names cannot clash."""
    prepare(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
                       *[c.alias(k) for k, c in (extra or {}).items()])


def id_text_carry(docs: DataFrame, id_col: str, text_col: str, carry: Sequence[str],
                  extra: dict[str, Column] | None = None) -> tuple[DataFrame, str, list]:
    """:func:`id_text` plus the columns ``carry`` as ``__carry_<name>``; a text
    that is carried anyway is not sent twice.  Returns the frame, the name of
    its text column (which may hold nulls) and the carried fields."""
    rows = id_text(docs, id_col, text_col, {
        **(extra or {}), **{f"__carry_{c}": F.col(f"`{c}`") for c in carry}})
    name = "text"
    if text_col in carry and docs.schema[text_col].dataType.simpleString() == "string":
        rows, name = rows.drop("text"), f"__carry_{text_col}"
    return rows, name, [f for f in rows.schema.fields if f.name.startswith("__carry_")]


def carried_back(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the carried columns, under their own names."""
    return df.select(*[F.col(f"`__carry_{c}`").alias(c) for c in columns])


def work_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet under the session's shared folder
    (``spark.checkpoint.dir``) and read it back: cuts lineage, and survives
    the loss of any executor."""
    spark = df.sparkSession
    path = shared_path(spark, f"llm-{label}")
    w = df.write.option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, rows: int, text: str | None = None,
           size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most ``rows`` rows and (beyond the first row)
    ``size`` bytes of the ``text`` column: bounds what a task holds as Python
    objects and working arrays."""
    at = -1 if text is None else batch.schema.get_field_index(text)
    if at < 0:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(
        zero_copy_only=False).astype(np.int64))
    lo, before = 0, 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(ends, before + size, side="right"))
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo, before = hi, int(ends[hi - 1])


def by_slices(rows: int, fn: Callable[[list[list]], pa.RecordBatch], columns: list[str]):
    """A ``mapInArrow`` body: hands ``fn`` the named columns as Python lists,
    slice by slice."""
    def body(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, "text"):
                yield fn([part.column(part.schema.get_field_index(c)).to_pylist()
                          for c in columns])
    return body


# --- vectorised hashing ---------------------------------------------------

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_BASE_INV = _U(pow(int(_BASE), -1, 1 << 64))
_BYTE_CODE = np.random.Generator(np.random.PCG64(20240101)).integers(
    1, 1 << 63, size=256, dtype=np.uint64) * _U(2) + _U(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (murmur-style shifts and odd
    multipliers)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


_POW = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """base**0..base**(n-1) modulo 2**64 (``down``: of the inverse)."""
    have = _POW[kind]
    if len(have) < n:
        m = max(n, 2 * len(have), 1 << 16)
        b = _BASE if kind == "up" else _BASE_INV
        out = np.empty(m, np.uint64)
        out[0] = 1
        size = 1
        while size < m:  # doubling: out[size:2*size] = out[:size] * b**size
            step = _U(pow(int(b), size, 1 << 64))
            take = min(size, m - size)
            out[size:size + take] = out[:take] * step
            size += take
        _POW[kind] = have = out
    return have[:n]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Prefix sums of ``codes[i] * base**i``; any slice's hash follows from
    two entries (see :func:`slice_hash`)."""
    out = np.empty(len(codes) + 1, np.uint64)
    out[0] = 0
    np.cumsum(codes * powers("up", len(codes)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of each slice [lo, hi), independent of its position."""
    return (prefix[hi] - prefix[lo]) * powers("down", len(prefix))[lo]


def byte_codes(raw: np.ndarray) -> np.ndarray:
    return _BYTE_CODE[raw]


def word_spans(raw: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the maximal runs of word bytes in ``raw``
    (``is_word``: 256 flags)."""
    flag = np.zeros(len(raw) + 2, np.int8)
    flag[1:-1] = is_word[raw]
    step = np.diff(flag)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word; equal words have equal hashes wherever they
    stand."""
    return mix64(slice_hash(prefix_hash(byte_codes(raw)), starts, ends)
                 + (ends - starts).astype(np.uint64))
