"""Benchmark decontamination as a prefix-filtered containment join.

Every item becomes its windows (13 consecutive words; a shorter item is one
window), rows of a table.  A window occurs in a document only if all its words
do, so one necessary word, its rarest, decides whether to look closer.  Rarity
is an exact count of the benchmark's words over all documents; a window with a
word that no document has is dropped.  A rarest word at offset ``o`` of a window
of ``n`` words (its *prefix*) fixes where the window would stand: documents look
up every word among the prefixes, and a word at position ``p`` proposes the
words ``p - o`` to ``p - o + n`` (positional bound), if the document has them
(length bound).  The proposed words are joined with the windows by equality,
which is the exact check; overlaps of hits are counted by position.

What documents are probed with is the distinct (word, offset, length) of windows
that can occur: they are measured and shipped in blocks of at most
``block_bytes``, one pass over the documents each (one for any usual benchmark).
The benchmark's distinct words are shipped for the count only if they fit a
block; else all words of the documents are counted and joined. Windows, items
and counts stay tables.  The join by window is salted, so a
passage in a third of all documents, or a window of a third of all items, is
spread; documents are rows of one table with numbers of their own, and their
texts are not shuffled.

*Edge cases.*  Null or word-less texts have no words and no hits; items
without words have no windows; a null item id is written as the empty
string; repeated item ids count once; an empty benchmark hits nothing; texts of
any length are read whole; documents are one row in, one row out, also with
repeated ids or none; ties of rarity go to the smaller word, then the first
offset.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried_back, id_text_carry, slices, work_table

WINDOW = 13
BLOCK_BYTES = 32 << 20
SALTS = 16
COUNTED_WORDS = 500_000
SLICE = 256

# Bytes that are not part of a word become spaces; A-Z become a-z.
_FOLD = bytes(0x20 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F
              else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes."""
    return (text or "").encode().translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    size = min(size, len(words))
    return [tuple(words[i:i + size]) for i in range(len(words) - size + 1)]


def _count_body(vocabulary):
    """Counts of the words of ``vocabulary`` (None: of all) in a task's
    texts, sent on whenever they are many."""
    def counted(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
            ["word", "n"])

    def body(batches):
        wanted = None if vocabulary is None else vocabulary.value.__contains__
        total = Counter()
        for batch in batches:
            for part in slices(batch, SLICE, batch.schema.names[0]):
                for text in part.column(0).to_pylist():
                    words = words_of(text)
                    total.update(words if wanted is None else filter(wanted, words))
                if len(total) > COUNTED_WORDS:
                    yield counted(total)
                    total = Counter()
        yield counted(total)
    return body


def _window_body(size: int):
    def body(batches):
        for batch in batches:
            for part in slices(batch, SLICE, "text"):
                wins, owners = [], []
                for item, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    own = {b" ".join(w) for w in windows_of(words_of(text), size)}
                    wins += sorted(own)
                    owners += [item] * len(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wins, pa.binary()), pa.array(owners, pa.string())], ["win", "item"])
    return body


def _word_body(batches):
    """The words of each window with their offsets."""
    for batch in batches:
        wins, words, at, size = [], [], [], []
        for win in batch.column(0).to_pylist():
            own = win.split(b" ")
            wins += [win] * len(own)
            words += own
            at += range(len(own))
            size += [len(own)] * len(own)
        yield pa.RecordBatch.from_arrays(
            [pa.array(wins, pa.binary()), pa.array(words, pa.binary()), pa.array(at, pa.int32()),
             pa.array(size, pa.int32())], ["win", "word", "at", "size"])


def proposals(words: list[bytes], prefixes: dict[bytes, list[tuple[int, int]]]
              ) -> dict[int, set[int]]:
    """Where a window could stand: start -> lengths."""
    n, out = len(words), {}
    for p in [i for i, w in enumerate(words) if w in prefixes]:
        for at, size in prefixes[words[p]]:
            if p >= at and p - at + size <= n:
                out.setdefault(p - at, set()).add(size)
    return out


def _probe_body(prefixes, text: str, kept: list[pa.Field]):
    """The columns ``kept`` and, per document, its number of words and the
    proposed windows."""
    def body(batches):
        for batch in batches:
            for part in slices(batch, SLICE, text):
                yield one(part)

    def one(b):
        at = b.schema.get_field_index
        sizes, starts, wins = [], [], []
        for doc in b.column(at(text)).to_pylist():
            words = words_of(doc)
            found = sorted((lo, n) for lo, ns in proposals(words, prefixes.value).items()
                           for n in ns)
            sizes.append(len(words))
            starts.append([lo for lo, _ in found])
            wins.append([b" ".join(words[lo:lo + n]) for lo, n in found])
        return pa.RecordBatch.from_arrays(
            [*[b.column(at(c)) for c in kept], pa.array(sizes, pa.int64()),
             pa.array(starts, pa.list_(pa.int32())), pa.array(wins, pa.list_(pa.binary()))],
            [*kept, "n_words", "starts", "wins"])
    return body


def _size(df: DataFrame, key: str) -> int:
    """Bytes of the keys of ``df``, and what holding each costs."""
    return df.agg(F.sum(F.octet_length(key) + 64).alias("n")).first()["n"] or 0


def _in_blocks(df: DataFrame, key: str, block_bytes: int):
    """The rows of ``df`` in blocks of at most about ``block_bytes``, measured
    by their keys, each brought to the driver in turn."""
    blocks = max(1, math.ceil(_size(df, key) / block_bytes))
    for b in range(blocks):
        yield df.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).collect()


def _copied(df: DataFrame) -> DataFrame:
    """Each row once per salt."""
    return df.withColumn("salt", F.explode(F.array(*[
        F.lit(i).cast("long") for i in range(SALTS)])))


def _prefixes(wins: DataFrame, texts: DataFrame, block_bytes: int) -> DataFrame:
    """(word, at, size): the distinct prefixes of the windows that can occur."""
    spark = texts.sparkSession
    words = work_table(wins.mapInArrow(_word_body, "win binary, word binary, at int, size int"),
                       "window-words")
    distinct = words.select("word").distinct()
    vocabulary = None
    if _size(distinct, "word") <= block_bytes:
        vocabulary = spark.sparkContext.broadcast({bytes(r["word"]) for r in distinct.collect()})
    counts = (texts.mapInArrow(_count_body(vocabulary), "word binary, n long")
              .groupBy("word").agg(F.sum("n").alias("n")))
    if vocabulary is None:
        counts = counts.join(distinct, "word", "left_semi")
    dealt = words.withColumn("salt", F.pmod(F.xxhash64("win"), F.lit(SALTS)))
    rarest = (dealt.join(_copied(counts), ["word", "salt"], "left").groupBy("win", "size").agg(
        F.min(F.struct("n", "word", "at")).alias("least"),
        F.max(F.col("n").isNull()).alias("absent")))
    return work_table(rarest.filter("NOT absent").select("least.word", "least.at", "size")
                      .distinct(), "prefixes")


def _probed(docs: DataFrame, benchmark: DataFrame, window: int, id_col: str, text_col: str,
            item_col: str, item_text_col: str, block_bytes: int, carry: list[str]):
    """(documents: row, doc_id, n_words, carried columns; hits: row, n_hit,
    items)."""
    spark = docs.sparkSession
    rows, text, carried = id_text_carry(docs, id_col, text_col, carry)
    bench = benchmark.select(
        F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"),
        F.col(f"`{item_text_col}`").cast("string").alias("text")).distinct()
    owned = work_table(bench.mapInArrow(_window_body(window), "win binary, item string")
                       .distinct(), "windows")
    wins = work_table(owned.select("win").distinct(), "distinct-windows")
    blocks = list(_in_blocks(_prefixes(wins, rows.select(text), block_bytes), "word", block_bytes))

    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS))
    dealt = _copied(wins)
    found, source = None, rows
    for k, part in enumerate(blocks):
        prefixes = defaultdict(list)
        for r in part:
            prefixes[bytes(r["word"])].append((r["at"], r["size"]))
        keep = ["doc_id", *[f.name for f in carried]]
        if len(blocks) > 1 and text == "text":
            keep.append("text")                       # read again by the next pass
        if k:
            keep = ["row"]
        types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
        probed = source.mapInArrow(
            _probe_body(spark.sparkContext.broadcast(dict(prefixes)), text, keep),
            ", ".join(f"`{c}` {types[c]}" for c in keep)
            + ", n_words long, starts array<int>, wins array<binary>")
        if not k:
            probed = probed.withColumn("row", F.monotonically_increasing_id())
        probed = work_table(probed, "probed")
        if not k:
            source = probed.drop("n_words", "starts", "wins")
            documents = probed.drop("starts", "wins").drop(*["text"] * (text == "text"))
        proposed = (probed.select("row", F.explode(F.arrays_zip("starts", "wins")).alias("o"))
                    .select("row", F.col("o.starts").alias("start"), F.col("o.wins").alias("win"))
                    .withColumn("salt", salt("row")))
        one = proposed.join(dealt, ["win", "salt"]).select("row", "start", "win")
        found = one if found is None else found.unionByName(one)
    found = work_table(found, "hits")
    # words hit: distinct positions
    length = F.size(F.split(F.decode("win", "UTF-8"), " "))
    n_hit = (found.select("row", F.explode(F.sequence("start", F.col("start") + length - 1))
                          .alias("pos")).distinct()
             .groupBy("row").agg(F.count(F.lit(1)).alias("n_hit")))
    items = (found.select("row", "win").distinct().join(owned, "win").select("row", "item")
             .distinct().groupBy("row").agg(F.sort_array(F.collect_list("item")).alias("items")))
    return documents, work_table(n_hit.join(items, "row"), "hit-documents")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  min_share: tuple[int, int] = (1, 20), id_col: str = "doc_id",
                  text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
                  carry: list[str] = ()) -> DataFrame:
    """``doc_id, n_words, n_hit, items array<string>, contaminated``: a
    document is contaminated when it has hits and they are at least
    ``min_share`` (numerator, denominator) of its words.  The columns of
    ``carry`` come along as ``__carry_<name>``."""
    documents, hits = _probed(docs, benchmark, window, id_col, text_col, item_col, item_text_col,
                              block_bytes, list(carry))
    num, den = min_share
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (documents.join(hits, "row", "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        *[F.col(f"`__carry_{c}`") for c in carry])
        .withColumn("contaminated", (F.col("n_hit") > 0)
                    & (F.col("n_hit") * den >= F.col("n_words") * num)))


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    out = decontaminate(docs, benchmark, carry=docs.columns, **options)
    return carried_back(out.filter(~F.col("contaminated")), docs.columns)


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]],
                size: int = WINDOW) -> list[tuple]:
    """Every window against every position, for tests."""
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, t in items:
            for w in windows_of(words_of(t), size):
                for i in range(len(words) - len(w) + 1):
                    if tuple(words[i:i + len(w)]) == w:
                        hit.update(range(i, i + len(w)))
                        found.add(item)
        ids = ",".join(sorted(found))
        out.append((doc, len(words), len(hit), len(found),
                    hashlib.sha256(ids.encode()).hexdigest(),
                    len(hit) > 0 and 20 * len(hit) >= len(words)))
    return out
