"""Near-duplicate classes by BagMinHash signatures.

A text is the multiset of its five-word shingles.  Two texts are near
duplicates when the weighted Jaccard similarity of their multisets (sum of
minima over sum of maxima of the counts) is at least the threshold; classes
are the connected components.

*Signature.*  Every unit of weight of every shingle is the source of a Poisson
process whose points carry a signature slot; a slot's value is its earliest
point over the whole bag.  Two bags agree in a slot with probability equal to
their weighted Jaccard similarity.  The weight axis is discretised into
dyadic shells [0,1), [1,2), [2,4), ...: one process per shell, whose points
also carry a place in the shell and count only below the bag's weight, so a
count of thousands costs a logarithmic number of processes.  Points are
drawn only up to a horizon that fills all slots with high probability; the few
bags with empty slots go on with a doubled horizon.

*Classes.*
1. Equal bags are one node, numbered when the table of bags is written; its
   text is that of the bag's smallest (id, text hash).
2. Nodes that share a band are candidates.  Each band bucket links its
   members to its smallest one (a star, not all pairs); links are verified on
   the full multisets.
3. In buckets of three or more whose members are not yet one component, all
   members are tested against further centres, picked by a hash, one per turn
   (:data:`CENTRES` turns): this joins most of what a star leaves apart.
4. What is still open is settled exactly: a prefix-filtered join over the
   members of open buckets finds every pair across components that can reach
   the threshold (tokens are ordered by rarity, so common passages do not
   bring texts together), and the pairs are verified.
So no link between candidates is lost, and hot buckets are never expanded
into pairs.  The probability that bands miss a pair of similarity 0.8 is
(1 - 0.8**5)**24, below 1e-4.

*Words* are runs of ASCII digits and letters and all characters beyond ASCII,
with A-Z as a-z.  *Edge cases:* a text with fewer than five words, but not
none, is one shingle; null, empty and word-less texts are classes of their
own, and so are rows without an id; of rows repeated with one id each gets the
class of its own text (two such classes may have the same smallest id as name,
and are still two: of each one row is ``kept``); rows repeated with one id and
one text are kept or dropped together; a text of any length is read whole, its
working arrays are about 100 bytes a word; an empty table gives no rows; extra
columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import (
    by_slices,
    id_text,
    mix64,
    prefix_hash,
    slice_hash,
    slices,
    word_hashes,
    word_spans,
    work_table,
)

_U = np.uint64
SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 5
CENTRES = 3
SALTS = 16
SLICE = 256

# Word bytes: digits, letters, everything beyond ASCII; A-Z count as a-z.
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_bags(texts: list[str], size: int = SHINGLE):
    """Distinct shingles of each text with their counts: ``doc`` (sorted),
    ``key`` (64-bit hash) and ``count``.  A text of fewer words, but not none,
    is one shingle."""
    blobs = [t.encode() for t in texts]
    raw = _LOWER[np.frombuffer(b"\n".join(blobs) + b"\n", np.uint8)]
    ends = np.cumsum([len(b) + 1 for b in blobs])
    lo, hi = word_spans(raw, _WORD)
    doc = np.searchsorted(ends, lo, side="right")
    prefix = prefix_hash(word_hashes(raw, lo, hi))
    n = np.bincount(doc, minlength=len(texts))
    length = np.minimum(n, size)
    first = np.cumsum(n) - n
    per = np.where(n > 0, n - length + 1, 0)
    owner = np.repeat(np.arange(len(texts)), per)
    at = first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per)
    key = mix64(slice_hash(prefix, at, at + length[owner]) + length[owner].astype(np.uint64))
    order = np.lexsort((key, owner))
    owner, key = owner[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return owner[at], key[at], np.diff(np.append(at, len(key)))


def signatures(doc, key, count, n: int, size: int) -> np.ndarray:
    """BagMinHash signatures of ``n`` bags, ``size`` values each (infinite
    where a bag is empty)."""
    sig = np.full((n, size), np.inf)
    weight = np.bincount(doc, count, minlength=n)
    # the dyadic shells [0,1), [1,2), [2,4), ... of each element's weight
    levels = np.where(count > 1, np.ceil(np.log2(count)).astype(np.int64), 0) + 1
    node = np.repeat(np.arange(len(doc)), levels)
    level = np.arange(len(node)) - np.repeat(np.cumsum(levels) - levels, levels)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    rate = np.where(level > 0, low, 1).astype(float)
    seed = mix64(key[node] + level.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    owner, cap = doc[node], count[node]
    todo = weight > 0
    horizon = np.where(todo, size / np.maximum(weight, 1) * (np.log(size) + 3.0), 0.0)
    pick = np.arange(len(node))
    while len(pick):
        flat = sig.ravel()
        s, o = seed[pick], owner[pick]
        t = np.zeros(len(pick))
        live = pick
        step = 0
        while len(live):
            step += 1
            h = mix64(s + _U(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF))
            t = t - np.log(((h >> _U(11)).astype(float) + 0.5) * 2.0 ** -53) / rate[live]
            on = t <= horizon[o]
            live, s, o, t = live[on], s[on], o[on], t[on]
            if not len(live):
                break
            mark = mix64(h[on] ^ _U(0xA0761D6478BD642F))
            lot = (mark >> _U(40)).astype(float) * 2.0 ** -24 * rate[live] + low[live]
            ok = np.floor(lot) < cap[live]
            slot = o[ok] * size + ((mark[ok] & _U(0xFFFFFFFF)) % _U(size)).astype(np.int64)
            np.minimum.at(flat, slot, t[ok])
        sig = flat.reshape(n, size)
        todo &= ~np.isfinite(sig).all(axis=1)
        sig[todo] = np.inf
        horizon[todo] *= 2
        pick = pick[todo[owner[pick]]]
    return sig


def _cuts(doc: np.ndarray, n: int):
    at = np.searchsorted(doc, np.arange(n + 1))
    return list(zip(at[:-1].tolist(), at[1:].tolist()))


def _sign(bands: int, rows: int, shingle: int):
    def body(cols):
        ids, marks, texts = cols
        doc, key, count = shingle_bags(texts, shingle)
        sig = signatures(doc, key, count, len(texts), bands * rows)
        values = sig.view(np.uint64).reshape(len(texts), bands, rows)
        band = np.zeros((len(texts), bands), np.uint64)
        for r in range(rows):
            band = mix64(band + values[:, :, r])
        band ^= mix64(np.arange(1, bands + 1, dtype=np.uint64))
        bag, weight, keys = [], [], []
        for k, (a, b) in enumerate(_cuts(doc, len(texts))):
            bag.append(None if a == b else _digest(key[a:b], count[a:b]))
            keys.append(None if a == b else mix64(band[k]).view(np.int64))
            weight.append(int(count[a:b].sum()))
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(marks, pa.int64()), pa.array(bag, pa.binary()),
             pa.array(weight, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
            ["doc_id", "mark", "bag", "weight", "bands"])
    return by_slices(SLICE, body, ["doc_id", "mark", "text"])


def _digest(key: np.ndarray, count: np.ndarray) -> bytes:
    packed = key.tobytes() + count.astype("<u4").tobytes()
    return hashlib.blake2b(packed, digest_size=16).digest()


def _bags(shingle: int):
    """The bags of the nodes; a text of another bag (under the same id and
    hash) is not the node's."""
    def body(cols):
        nodes, bags, copies, texts = cols
        doc, key, count = shingle_bags(texts, shingle)
        own = [(k, a, b) for k, (a, b) in enumerate(_cuts(doc, len(texts)))
               if _digest(key[a:b], count[a:b]) == bags[k]]
        return pa.RecordBatch.from_arrays(
            [pa.array([nodes[k] for k, _, _ in own], pa.int64()),
             pa.array([copies[k] for k, _, _ in own], pa.bool_()),
             pa.array([key[a:b].astype("<u8").tobytes() for _, a, b in own], pa.binary()),
             pa.array([count[a:b].astype("<u4").tobytes() for _, a, b in own], pa.binary())],
            ["node", "copied", "keys", "counts"])
    return by_slices(SLICE, body, ["node", "bag", "copied", "text"])


def similarity(keys_a, counts_a, keys_b, counts_b) -> float:
    """Weighted Jaccard of two bags (sorted distinct keys and counts)."""
    at = np.searchsorted(keys_b, keys_a)
    at[at == len(keys_b)] = 0
    both = keys_b[at] == keys_a if len(keys_b) else np.zeros(len(keys_a), bool)
    common = np.minimum(counts_a[both], counts_b[at[both]]).sum(dtype=np.int64)
    total = counts_a.sum(dtype=np.int64) + counts_b.sum(dtype=np.int64) - common
    return float(common / total) if total else 0.0


def _verify(threshold: float):
    def body(cols):
        a, b, ka, ca, kb, cb = cols
        sim = [similarity(np.frombuffer(w, "<u8"), np.frombuffer(x, "<u4"),
                          np.frombuffer(y, "<u8"), np.frombuffer(z, "<u4"))
               for w, x, y, z in zip(ka, ca, kb, cb)]
        ok = [s >= threshold - 1e-12 for s in sim]
        return pa.RecordBatch.from_arrays(
            [pa.array([x for x, k in zip(a, ok) if k], pa.int64()),
             pa.array([x for x, k in zip(b, ok) if k], pa.int64())], ["a", "b"])
    return by_slices(SLICE, body, ["a", "b", "ka", "ca", "kb", "cb"])


def verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) whose bags reach the threshold."""
    left = bags.select(F.col("node").alias("a"), F.col("keys").alias("ka"),
                       F.col("counts").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("keys").alias("kb"),
                        F.col("counts").alias("cb"))
    return (pairs.join(left, "a").join(right, "b")
            .select("a", "b", "ka", "ca", "kb", "cb")
            .mapInArrow(_verify(threshold), "a long, b long"))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has no other one: then each
    edge leads from a node to its component's smallest."""
    inner = (_both_ways(edges).groupBy("a").agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
             .filter("lo < a AND lo <> hi"))
    return inner.limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """``node, label``: every node that is not its component's smallest, with
    that smallest one.  Alternating large-star and small-star steps, each a
    grouped minimum, until only stars are left; every step is written to the
    shared folder."""
    now = work_table(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .filter("a <> b").distinct(), "components")
    while not _all_stars(now):
        both = _both_ways(now)
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(low.select("a", F.least("a", "m").alias("m")), "a")
                 .filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").filter("b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))))
        now = work_table(small.distinct(), "components")
    return now.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _labelled(df: DataFrame, labels: DataFrame, col: str, out: str) -> DataFrame:
    return (df.join(labels.select(F.col("node").alias(col), F.col("label").alias("__l")),
                    col, "left")
            .withColumn(out, F.coalesce("__l", col)).drop("__l"))


def merge_components(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Labels after adding edges: only the components' smallest nodes take
    part in the new search."""
    e = _labelled(_labelled(edges, labels, "a", "la"), labels, "b", "lb")
    more = components(e.select(F.col("la").alias("a"), F.col("lb").alias("b")))
    old = _labelled(labels, more, "label", "to").select("node", F.col("to").alias("label"))
    return work_table(old.unionByName(more), "labels")


def _meet(rows: DataFrame, of_key: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (node, key, ...) joined with a table of one row per key; the rows of
    a hot key are dealt over salts, with that row copied to each."""
    salted = rows.withColumn("__s", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    copied = of_key.withColumn("__s", F.explode(F.array(*[
        F.lit(i).cast("long") for i in range(SALTS)])))
    return salted.join(copied, ["key", "__s"], how).drop("__s")


def _open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets of three or more that span several components."""
    m = _labelled(members.filter("n > 2"), labels, "node", "comp")
    open_ = (m.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
             .filter("lo <> hi").select("key"))
    return _meet(m, open_, "left_semi")


def _ordered(a, b):
    return F.least(a, b).alias("a"), F.greatest(a, b).alias("b")


def _tokens(batches):
    """Bags as sets: the k-th occurrence of a shingle is a token of its own."""
    for batch in batches:
        for part in slices(batch, SLICE, "keys"):
            d = part.to_pydict()
            nodes, comps, tokens, sizes = [], [], [], []
            for node, comp, k, c in zip(d["node"], d["comp"], d["keys"], d["counts"]):
                count = np.frombuffer(c, "<u4").astype(np.int64)
                nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                tok = mix64(np.repeat(np.frombuffer(k, "<u8"), count)
                            + nth.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
                tokens.append(tok.view(np.int64))
                nodes.append(np.full(len(tok), node))
                comps.append(np.full(len(tok), comp))
                sizes.append(np.full(len(tok), len(tok)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in (nodes, comps, tokens, sizes)],
                ["node", "comp", "token", "size"])


def prefix_pairs(open_bags: DataFrame, threshold: float) -> DataFrame:
    """Pairs of nodes of different components that can reach the threshold:
    they share a token among the rarest ones each must share, and pass the
    length and positional bounds.  ``open_bags``: node, comp, keys, counts."""
    t = threshold
    tok = open_bags.mapInArrow(_tokens, "node long, comp long, token long, size long")
    freq = tok.groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    by_rarity = Window.partitionBy("node").orderBy("freq", "token")
    keep = lambda share: F.col("size") - F.ceil(F.col("size") * share - 1e-9) + 1
    probe = (tok.join(freq, "token").withColumn("pos", F.row_number().over(by_rarity))
             .filter(F.col("pos") <= keep(t)))
    x = probe.filter("freq > 1").select("token", *[
        F.col(c).alias(f"x_{c}") for c in ("node", "comp", "size", "pos")])
    y = (probe.filter("freq > 1").filter(F.col("pos") <= keep(2 * t / (1 + t)))
         .select("token", *[F.col(c).alias(f"y_{c}") for c in ("node", "comp", "size", "pos")]))
    need = F.ceil((F.col("x_size") + F.col("y_size")) * (t / (1 + t)) - 1e-9)
    reach = 1 + F.least(F.col("x_size") - F.col("x_pos"), F.col("y_size") - F.col("y_pos"))
    return (x.join(y, "token")
            .filter((F.struct("y_size", "y_node") < F.struct("x_size", "x_node"))
                    & (F.col("x_comp") != F.col("y_comp"))
                    & (F.col("y_size") >= F.col("x_size") * t - 1e-9) & (reach >= need))
            .select(*_ordered("x_node", "y_node")).distinct())


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Ids, texts and a hash of each text, which tells rows of one id apart."""
    return id_text(docs, id_col, text_col).withColumn("mark", F.xxhash64("text"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE,
                    bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, kept, mark``, one row per input row; ``class_id`` is
    the smallest id of the class, ``kept`` says whether the row is the one that
    names it, ``mark`` is the hash of its text."""
    texts = _marked(docs, id_col, text_col)
    signed = work_table(
        texts.mapInArrow(_sign(bands, rows, shingle), "doc_id long, mark long, bag binary, "
                                                      "weight long, bands array<long>"),
        "signatures")
    full = signed.filter(F.col("bag").isNotNull() & F.col("doc_id").isNotNull())
    # one row per bag, numbered as it is written
    nodes = work_table(full.groupBy("bag").agg(
        F.min(F.struct("doc_id", "mark")).alias("least"),
        (F.count(F.lit(1)) > 1).alias("copied"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.explode(F.array_distinct("bands")).alias("key"))
    hubs = (keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n"))
            .filter("n > 1"))
    members = work_table(_meet(keyed, hubs), "members")
    involved = members.select("node").distinct()
    of_node = (nodes.join(involved, "node", "left_semi")
               .select("least.doc_id", "least.mark", "node", "bag", "copied").hint("merge"))
    # always by merge: the side grows with the input, so does the plan's cost
    read = work_table(texts.join(of_node, ["doc_id", "mark"])
                      .mapInArrow(_bags(shingle), "node long, copied boolean, keys binary, "
                                                  "counts binary"), "bags")
    # only a bag with copies can have come from several rows
    bags = read.filter("NOT copied").select("node", "keys", "counts").unionByName(
        read.filter("copied").groupBy("node").agg(F.first("keys").alias("keys"),
                                                  F.first("counts").alias("counts")))

    star = members.filter("node <> hub").select(*_ordered("node", "hub")).distinct()
    labels = work_table(components(verified(star, bags, threshold)), "labels")

    for turn in range(CENTRES):
        opened = work_table(_open_members(members, labels), "open")
        centre = opened.groupBy("key").agg(F.min_by(
            F.struct("node", "comp"), F.xxhash64("key", "node", F.lit(turn))).alias("c"))
        pairs = (_meet(opened, centre).filter("comp <> c.comp")
                 .select(*_ordered("node", "c.node")).distinct())
        labels = merge_components(labels, verified(pairs, bags, threshold))

    rest = _open_members(members, labels).select("node", "comp").distinct()
    pairs = prefix_pairs(bags.join(rest, "node").select("node", "comp", "keys", "counts"),
                         threshold)
    labels = merge_components(labels, verified(pairs, bags, threshold))

    labelled = _labelled(nodes.select("node", "bag", "least"), labels, "node", "label")
    named = labelled.groupBy("label").agg(F.min("least").alias("name"))
    classes = labelled.join(named, "label").select("bag", "name")
    own = F.struct("doc_id", "mark")
    return (full.select("doc_id", "mark", "bag").join(classes, "bag")
            .select("doc_id", F.col("name.doc_id").alias("class_id"),
                    (own == F.col("name")).alias("kept"), "mark")
            .unionByName(signed.filter(F.col("bag").isNull() | F.col("doc_id").isNull())
                         .select("doc_id", F.col("doc_id").alias("class_id"),
                                 F.lit(True).alias("kept"), "mark")))


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """The documents that name their class, with all their columns."""
    kept = (classes.filter("kept").select(F.col("doc_id").alias("__id"),
                                          F.col("mark").alias("__mark")).distinct())
    same = (F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col("__id"))
            & (F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
               == F.col("__mark")))
    return docs.join(kept, same, "left_semi")


def brute_force(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD,
                shingle: int = SHINGLE) -> dict[int, int]:
    """doc_id -> class_id from all pairs, for tests with unique ids."""
    ids = [d for d, _ in docs]
    doc, key, count = shingle_bags([t or "" for _, t in docs], shingle)
    bags = [(key[a:b], count[a:b].astype(np.int64)) for a, b in _cuts(doc, len(docs))]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(ids)):
        for j in range(i):
            wi, wj = bags[i][1].sum(), bags[j][1].sum()
            if wi and wj and min(wi, wj) >= threshold * max(wi, wj) - 1e-9:
                if similarity(*bags[i], *bags[j]) >= threshold - 1e-12:
                    a, b = find(ids[i]), find(ids[j])
                    root[max(a, b)] = min(a, b)
    return {d: find(d) for d in ids}
