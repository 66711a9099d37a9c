"""Secret scan through a trigram inverted index, in DataFrame functions only.

Method.  Every rule is a regular expression.  A Boolean trigram query is derived
from it (``trigram_query``): an OR of clauses, each an AND of trigrams that any
match of the clause's alternative must contain, over lower-case text.  The index
holds, per trigram that some rule asks for and per block of about 4,096
documents, the sorted keys of the documents that contain it (``trigram_index``).
A clause is answered by intersecting its postings block by block, a rule by the
union of its clauses (``candidates``).  Candidates are verified by the regular
expression on the whole text.  A rule without mandatory trigrams (``hex``) scans
every text, in the same pass.

Positions.  ``split`` and ``regexp_extract_all`` walk the same leftmost
non-overlapping matches, so a match starts after all pieces and matches before
it; lengths are counted in code points, the end is exclusive.  ``assign`` keeps
matches whose value has 12 or more characters (a shorter one is consumed and
dropped); the others ask for their length in the expression, which is the same
for maximal runs.

Skew.  A document's key is a 64-bit hash of (doc_id, text): repeated rows share
postings, a shared key can only add a candidate, never lose one.  Blocks are
dealt by key, so a trigram that every document has is spread over all blocks.
Index and candidates are tables on the shared folder; the candidates are
broadcast only if the written table is below Spark's broadcast threshold, else
the texts are shuffled to them once by key.

Defined results.  A null text is empty and has no spans; null and repeated ids
keep one row each; texts are scanned whole; other columns are not read; an empty
table gives no rows.
"""

from __future__ import annotations

import itertools
import math
from re import _constants as op
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, work_table


def _either(word: str) -> str:
    """A word with its letters in either case (ASCII)."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_WORDS = [*map(_either, ("password", "passwd", "secret", "token")),
          _either("api") + "_?" + _either("key")]

# kind, regular expression, least length of its first group (0: none asked).
# The first three are the base kinds.  The others are published key formats.
RULES: list[tuple[str, str, int]] = [
    ("assign", f"(?:{'|'.join(_WORDS)})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0),
    ("hex", r"[0-9a-f]{16,}", 0),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0),
    ("google", r"AIza[A-Za-z0-9_-]{35}", 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0),
    ("pem", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0),
]
BASE = 3
BLOCK_DOCS = 4096
SPANS = "array<struct<start:int,kind:int,end:int,g:int>>"

Query = list[frozenset]  # OR of ANDs; an empty AND is always true
_MOST = 64               # alternatives followed exactly


# --- from a regular expression to a Boolean trigram query ---------------------

def _tidy(q: Query) -> Query:
    """Without clauses that a smaller clause implies."""
    kept: Query = []
    for c in sorted(set(q), key=lambda c: (len(c), sorted(c))):
        if not any(k <= c for k in kept):
            kept.append(c)
    return kept


def _both(a: Query, b: Query) -> Query:
    """AND; where it grows too large the more selective half is enough, as
    either is a necessary condition."""
    if len(a) * len(b) > _MOST:
        return max(a, b, key=lambda q: min(map(len, q)))
    return _tidy([x | y for x, y in itertools.product(a, b)])


def _of_strings(strings: set[str]) -> Query:
    return _tidy([frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings])


def _class(items: list) -> set[str] | None:
    """The lower-cased characters of a class, if they are few."""
    out: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL and value < 128:
            out.add(chr(value).lower())
        elif kind is op.RANGE and value[1] < 128:
            out |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(tokens) -> tuple[set[str] | None, Query]:
    """The strings a pattern stands for, if they are few, and its query."""
    run, query, exact = {""}, [frozenset()], True

    def cut(more: Query) -> None:
        nonlocal run, query, exact
        query, run, exact = _both(_both(query, _of_strings(run)), more), {""}, False

    for kind, value in tokens:
        strings, inner = None, [frozenset()]
        if kind is op.LITERAL and value < 128:
            strings = {chr(value).lower()}
        elif kind is op.IN:
            strings = _class(value)
        elif kind is op.SUBPATTERN:
            strings, inner = _walk(value[3])
        elif kind is op.BRANCH:
            parts = [_walk(p) for p in value[1]]
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
            inner = _tidy([c for _, q in parts for c in q])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            least, most, item = value
            one, inner = _walk(item)
            if one is not None and most <= 4:
                strings = {"".join(p) for n in range(least, most + 1)
                           for p in itertools.product(one, repeat=n)
                           } if len(one) ** most <= _MOST else None
            if not least:
                inner = [frozenset()]
        elif kind is op.AT:
            continue
        if strings is None or len(run) * len(strings) > _MOST:
            cut(inner)
        else:
            run = {a + b for a, b in itertools.product(run, strings)}
    return (run if exact else None), _both(query, _of_strings(run))


def trigram_query(pattern: str) -> Query:
    """Clauses of lower-case trigrams, of which every match satisfies one;
    ``[]`` if the pattern has no mandatory trigrams."""
    query = _walk(_parser.parse(pattern))[1]
    return [] if frozenset() in query else query


# --- index, candidates, verification ------------------------------------------

def _key() -> Column:
    return F.xxhash64("doc_id", "text")


def trigram_index(docs: DataFrame, grams: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """(block, gram, postings): per block of documents and trigram the sorted
    keys of the documents that contain it, as a table on the shared folder.
    ``gram`` is the trigram's place in ``grams``."""
    blocks = max(1, math.ceil(docs.count() / block_docs))
    folded = docs.select(_key().alias("key"), F.lower("text").alias("folded"))
    present = F.array_compact(F.array(*[F.when(F.contains("folded", F.lit(g)), F.lit(i))
                                        for i, g in enumerate(grams)]))
    rows = folded.select("key", F.explode(present).alias("gram"))
    postings = (rows.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)))
                .groupBy("block", "gram")
                .agg(F.array_sort(F.collect_set("key")).alias("postings")))
    return work_table(postings, "trigrams")


def candidates(index: DataFrame, queries: list[Query], grams: list[str]) -> DataFrame:
    """(key, rules): the documents that satisfy a rule's Boolean query, with a
    bit for each such rule."""
    number = {g: i for i, g in enumerate(grams)}
    asked = ", ".join(f"({r}, {c}, {number[g]}, {len(clause)})"
                      for r, q in enumerate(queries) for c, clause in enumerate(q)
                      for g in sorted(clause))
    clauses = index.sparkSession.sql(  # bounded by the rules
        f"SELECT * FROM VALUES {asked} AS t(rule, clause, gram, need)")
    lists = (index.join(F.broadcast(clauses), "gram").groupBy("block", "rule", "clause", "need")
             .agg(F.collect_list("postings").alias("lists")).filter("size(lists) = need"))
    both = F.expr("aggregate(slice(lists, 2, size(lists)), lists[0], "
                  "(a, b) -> array_intersect(a, b))")
    hits = lists.select("rule", F.explode(both).alias("key"))
    return work_table(hits.groupBy("key").agg(
        F.expr("bit_or(shiftleft(1L, rule))").alias("rules")), "secret-candidates")


def spans_of(text: str, pattern: str, least: int, kind: int) -> Column:
    """array<struct<start, kind, end, g>> of a rule's matches in a text
    column; ``g`` is the length of the part that ``least`` is asked of."""
    matches, group = (F.regexp_extract_all(text, F.lit(pattern), i)
                      for i in (F.lit(0), F.lit(1 if least else 0)))
    sizes = F.zip_with(matches, group, lambda m, g: F.struct(F.length(m).alias("m"),
                                                             F.length(g).alias("g")))
    # one piece more than matches: the last has no match
    steps = F.zip_with(F.split(text, pattern, -1), sizes, lambda piece, x: F.struct(
        F.length(piece).alias("skip"), x["m"].alias("m"), x["g"].alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))

    def step(a, x):
        at = a["at"] + x["skip"]
        span = F.struct(at.alias("start"), F.lit(kind).alias("kind"), (at + x["m"]).alias("end"),
                        x["g"].alias("g"))
        return F.struct((at + F.coalesce(x["m"], F.lit(0))).alias("at"),
                        F.when(x["m"].isNull(), a["out"])
                        .otherwise(F.concat(a["out"], F.array(span))).alias("out"))
    return F.filter(F.aggregate(steps, start, step, lambda a: a["out"]),
                    lambda s: s["g"] >= least)


def secret_scan(documents: DataFrame, rules: list[tuple[str, str, int]] | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, ``found`` (all spans, by start, then
    rule): array of (start, kind, end, g), kind being the rule's place."""
    rules = rules or RULES
    docs = id_text(documents, id_col, text_col)
    queries = [trigram_query(pattern) for _, pattern, _ in rules]
    grams = sorted({g for q in queries for clause in q for g in clause})
    keyed = docs.withColumn("key", _key())
    if grams:
        hits = candidates(trigram_index(docs, grams), queries, grams)
        keyed = keyed.join(hits, "key", "left")
    else:
        keyed = keyed.withColumn("rules", F.lit(0).cast("long"))
    none = F.array().cast(SPANS)
    found = []
    for i, (_, pattern, least) in enumerate(rules):
        spans = spans_of("text", pattern, least, i)
        # no mandatory trigrams: scan in full
        asked = F.expr(f"coalesce(rules, 0L) & shiftleft(1L, {i}) != 0")
        found.append(F.when(asked, spans).otherwise(none) if queries[i] else spans)
    return keyed.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def secret_digest(scanned: DataFrame, rules: list[tuple[str, str, int]] | None = None,
                  base: int = BASE) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans."""
    rules = rules or RULES
    kinds = "array(" + ", ".join(f"'{name}'" for name, _, _ in rules) + ")"
    said = (f"concat_ws(',', transform({{}}, s -> concat_ws(':', {kinds}[s.kind], s.start, s.end)))")
    counts = [F.expr(f"cast(size(filter(found, s -> s.kind = {i})) AS long)").alias(f"n_{name}")
              for i, (name, _, _) in enumerate(rules[:base])]
    return scanned.select(
        "doc_id", *counts,
        F.sha2(F.expr(said.format(f"filter(found, s -> s.kind < {base})")), 256)
        .alias("base_sha256"),
        F.expr(said.format("found")).alias("spans"))


# --- the same in SQL ------------------------------------------------------------

def oracle(rules: list[tuple[str, str, int]] | None = None, base: int = BASE) -> str:
    """DuckDB SQL: every rule's expression over every text."""
    rules = rules or RULES
    each = []
    for i, (name, pattern, least) in enumerate(rules):
        p = "'" + pattern.replace("'", "''") + "'"
        each.append(f"""
        SELECT row, {i} AS k, '{name}' AS kind, list_transform(range(1, len(m) + 1), lambda i: {{
                   's': list_sum(list_transform(piece[1:i], lambda x: length(x)))
                        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
                   'n': length(m[i]), 'g': length(g[i])}}) AS found
        FROM (SELECT row, regexp_extract_all(t, {p}, 0) AS m, string_split_regex(t, {p}) AS piece,
                     regexp_extract_all(t, {p}, {1 if least else 0}) AS g
              FROM d)""")
    least = "CASE k " + " ".join(f"WHEN {i} THEN {r[2]}" for i, r in enumerate(rules)) + " END"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {i}) AS n_{r[0]}"
                       for i, r in enumerate(rules[:base]))
    return f"""
    WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS t FROM documents),
    every AS ({" UNION ALL ".join(each)}),
    flat AS (SELECT row, k, kind, unnest(found) AS f FROM every),
    spans AS (SELECT row, k, CAST(f.s AS BIGINT) AS s,
                     kind || ':' || CAST(f.s AS BIGINT) || ':' || CAST(f.s + f.n AS BIGINT) AS x
              FROM flat WHERE f.g >= {least}),
    summed AS (
        SELECT row, {counts},
               coalesce(string_agg(x, ',' ORDER BY s, k) FILTER (WHERE k < {base}), '') AS b,
               string_agg(x, ',' ORDER BY s, k) AS spans FROM spans GROUP BY row)
    SELECT doc_id, {", ".join(f"coalesce(n_{r[0]}, 0) AS n_{r[0]}" for r in rules[:base])},
           sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN summed USING (row)"""
