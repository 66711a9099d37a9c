"""Archives as a Spark data source, split by member.

A zip archive ends with a directory of its members, so a task can seek to one
member and inflate it as a stream without reading the rest.  Planning reads the
directories only (a few kilobytes each, many at a time) and deals the data and
metadata members to partitions: consecutive small members share one up to
``pack_bytes`` of compressed data, a larger member has one to itself.  A task
holds one read buffer and one record batch, whatever the size of the archive.

The files are opened through pyarrow's file systems (local or mounted, HDFS,
S3, GCS); :func:`reachable` says whether a path can be.
"""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

METADATA_SUFFIX = "_metadata.csv"
SCHEMA = "path string, pid string, role string, line_no long, fields array<string>"
_ARROW = pa.schema([("path", pa.string()), ("pid", pa.string()), ("role", pa.string()),
                    ("line_no", pa.int64()), ("fields", pa.list_(pa.string()))])
READ_BYTES = 1 << 20        # read buffer of compressed data
BATCH_RECORDS = 10_000
BATCH_CHARS = 4 << 20
FIELD_CHARS = 64 << 20      # a longer field is an unclosed quote
PACK_BYTES = 32 << 20


def archive_members(names: list[str]) -> dict[str, str]:
    """``pid``, ``data`` and ``metadata`` of an archive (S6), from one index
    of its members by lower-cased base name (the first of a name counts)."""
    index: dict[str, str] = {}
    for name in names:
        index.setdefault(name.rpartition("/")[2].lower(), name)
    described = [base for base in index if base.endswith(METADATA_SUFFIX)]
    if not described:
        raise ValueError(f"archive without a *_MetaData.csv member: {names}")
    own = index[described[0]].rpartition("/")[2]
    pid = own.partition("_")[0]
    found = {"data": index.get(f"{pid}.csv".lower()),
             "metadata": index.get(pid.lower() + METADATA_SUFFIX)}
    absent = sorted(role for role, member in found.items() if member is None)
    if absent:
        raise ValueError(f"archive of {pid} lacks its {' and '.join(absent)} member: {names}")
    return {"pid": pid, **found}


# --- files ---------------------------------------------------------------------

def _located(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"(?:file:)?/*(/.*)", path)
    if local:
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(quote(path, safe=":/?=&%@"))


def reachable(path: str) -> bool:
    """Whether ``path`` can be opened outside Spark's own readers."""
    try:
        where, name = _located(path)
        return where.get_file_info(name).type != fs.FileType.NotFound
    except (pa.ArrowException, OSError, ValueError):
        return False


def open_archive(path: str) -> zipfile.ZipFile:
    """The archive at a path; opening reads its directory only."""
    where, name = _located(path)
    raw = io.BufferedReader(where.open_input_file(name), READ_BYTES)
    return zipfile.ZipFile(raw)


# --- members ----------------------------------------------------------------------

@dataclass
class Members(InputPartition):
    """What one task reads: (path, pid, role, member) of some members."""
    items: list[tuple[str, str, str, str]]


def members_of(path: str) -> list[tuple[int, tuple[str, str, str, str]]]:
    """(compressed size, item) of the data and the metadata member."""
    with open_archive(path) as archive:
        found = archive_members(archive.namelist())
        return [(archive.getinfo(found[role]).compress_size,
                 (path, found["pid"], role, found[role])) for role in ("data", "metadata")]


def dealt(sized: list[tuple[int, tuple]], pack_bytes: int) -> list[Members]:
    """Partitions of consecutive members up to ``pack_bytes``."""
    out, size = [], 0
    for n, item in sized:
        if not out or size + n > pack_bytes:
            out.append(Members([]))
            size = 0
        out[-1].items.append(item)
        size += n
    return out


def records(path: str, pid: str, role: str, member: str) -> Iterator[pa.RecordBatch]:
    """The CSV records of one member, as a stream of bounded batches."""
    csv.field_size_limit(FIELD_CHARS)
    with open_archive(path) as archive, archive.open(member) as raw:
        text = io.TextIOWrapper(io.BufferedReader(raw, READ_BYTES), encoding="utf-8-sig",
                                newline="")
        held, chars, line = [], 0, 0
        for record in csv.reader(text):
            held.append(record)
            chars += sum(map(len, record))
            if len(held) >= BATCH_RECORDS or chars >= BATCH_CHARS:
                yield _batch(path, pid, role, line, held)
                line += len(held)
                held, chars = [], 0
        if held:
            yield _batch(path, pid, role, line, held)


def _batch(path: str, pid: str, role: str, line: int, held: list[list[str]]) -> pa.RecordBatch:
    n = len(held)
    return pa.RecordBatch.from_arrays(
        [pa.array([path] * n, pa.string()), pa.array([pid] * n, pa.string()),
         pa.array([role] * n, pa.string()), pa.array(range(line, line + n), pa.int64()),
         pa.array(held, pa.list_(pa.string()))], schema=_ARROW)


class ZippedTables(DataSource):
    """``spark.read.format("zipped_tables").option("paths", <JSON list>)``."""

    @classmethod
    def name(cls) -> str:
        return "zipped_tables"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZippedReader(json.loads(self.options["paths"]),
                            int(self.options.get("packbytes", PACK_BYTES)))


class ZippedReader(DataSourceReader):
    def __init__(self, paths: list[str], pack_bytes: int):
        self.paths, self.pack_bytes = paths, pack_bytes

    def partitions(self) -> list[Members]:
        with ThreadPoolExecutor(32) as pool:
            sized = [m for found in pool.map(members_of, self.paths) for m in found]
        return dealt(sized, self.pack_bytes) or [Members([])]

    def read(self, partition: Members) -> Iterator[pa.RecordBatch]:
        for item in partition.items:
            yield from records(*item)
