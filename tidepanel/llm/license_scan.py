"""Licences of files: TF-IDF cosine to templates, and inheritance by folder.

Tokens are words without function words, and version numbers.

*Own licence.*  Every statement of a text (a line, or a sentence of it) and
the text as a whole are compared with licence templates as sparse TF-IDF
vectors.  The best template at or above the threshold names the licence.  A
text whose best match is the whole of it, or a file with a licence file's
name, is the licence file of its folder.

*Texts and headers.*  A second table holds full licence texts, standard headers
and their paragraphs (:mod:`.license_texts`), with frequencies of its own.
Statements, blocks (lines up to one without a letter or digit), their sentences
across lines and whole texts are compared with it if they have a part of a
licence word.  A whole text close to a full licence text counts before all
other matches.  Of equally good licences the one whose version (or
distinguishing clause) stands in the nearest block is taken.  An SPDX identifier
is a match of 1; expressions stay whole.  The SQL oracle covers the statements'
table alone (``texts=()``).

*Inheritance.*  A file without a licence of its own takes the one of its
nearest ancestor folder that holds a licence file: folders are joined with
their ancestors' licence files by path, and the deepest one wins.

*Prefilter.*  A statement can only reach the threshold if it has one of a
template's necessary tokens: so many that the remaining tokens' share of the
template's norm stays below the threshold (by the Cauchy-Schwarz inequality
no statement without them can).  Any such choice is exact; numbers come
last.  Only texts and statements with a necessary token are tokenised, and
only those go on whose unknown words leave room for the threshold: u of them
weigh at least u idf_max^2, m known ones at most m^2 idf_max^2.

Only DataFrame functions.  The broadcasts are the template table and its
tokens, whose size is fixed by the caller.

*Edge cases.*  Null and empty texts have no licence of their own; a null path
is a file in the root folder; of equally good templates the first licence
by name is taken if nothing nearby decides, of several licence files of a folder the best match (then
the first name); repeated rows get the same answer each; an empty table gives
no rows; texts of any length are scanned whole (a text's blocks and tokens are
arrays of one row); extra columns are dropped.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_texts
from .common import id_text

THRESHOLD = 0.65
FULL_TEXT = 0.95  # a whole text that is a licence's text
SALTS = 32

# Licence names and short standard statements of them.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge"),
    ("MPL-2.0", "Mozilla Public License, v. 2.0"),
)
# Function words, which are no tokens.
STOP_WORDS = ("a", "and", "any", "are", "by", "for", "in", "is", "of", "or", "that", "the",
              "this", "to", "under", "with", "work")
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|unlicense|notice)([-_.].*)?$"
STATEMENT_END = r"([.!?])[ ]+"
TOKEN = r"[a-z]+|[0-9]+(?:[.][0-9]+)*"
EMPTY_LINE = r"(?md)^[^A-Za-z0-9\n]+$"
LINE_START = r"\n[^A-Za-z0-9\n]*"
SPDX_ID = r"\(*[A-Za-z0-9][A-Za-z0-9.+:-]*\)*"
SPDX = (rf"(?i)SPDX-License-Identifier:[ \t]*({SPDX_ID}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{SPDX_ID})*)")
FAR = 1 << 30


def template_vectors(templates=TEMPLATES):
    """(licence, {token: weight}, norm) of each template, and every token's
    inverse document frequency over the templates (``None``: all others)."""
    bags = [(name, Counter(t for t in re.findall(TOKEN, text.lower()) if t not in STOP_WORDS))
            for name, text in templates]
    n = len(bags)
    df = Counter(t for _, bag in bags for t in bag)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    idf[None] = math.log(1 + n) + 1
    vectors = []
    for name, bag in bags:
        w = {t: c * idf[t] for t, c in sorted(bag.items())}
        vectors.append((name, w, math.sqrt(sum(x * x for x in w.values()))))
    return vectors, idf


def necessary_tokens(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[str]:
    """Tokens of which every statement at the threshold has at least one."""
    vectors, _ = template_vectors(templates)
    need: set[str] = set()
    for _, w, norm in vectors:
        rest = norm * norm
        for t, x in sorted(w.items(), key=lambda kv: (kv[0][0].isdigit(), -kv[1], kv[0])):
            if math.sqrt(max(rest, 0)) < threshold * norm - 1e-9:
                break
            need.add(t)
            rest -= x * x
    return sorted(need)


def token_rule(tokens) -> str:
    """Finds the texts that have one of the tokens, by the tokeniser's own
    borders: a word ends at whatever is not a-z, a number goes on over dots
    between digits."""
    words = [t for t in tokens if not t[0].isdigit()]
    numbers = [re.escape(t) for t in tokens if t[0].isdigit()]
    rules = [rf"(?<![a-z])(?:{'|'.join(words)})(?![a-z])"] if words else []
    if numbers:
        rules.append(rf"(?<![0-9])(?<![0-9][.])(?:{'|'.join(numbers)})(?![0-9]|[.][0-9])")
    return "|".join(rules)


def _template_rows(templates, texts):
    """(token, long, t, licence, full, x): a unit's cosine to template ``t`` is
    the sum of its tokens' counts times ``x``, over its norm; and (token,
    idf, long_idf), ``None`` for other tokens."""
    rows, idfs = [], []
    full = set(license_texts.full_texts())
    for long, table in ((False, templates), (True, texts)):
        vectors, idf = template_vectors(table) if table else ([], {None: 1.0})
        idfs.append(idf)
        for t, (name, w, norm) in enumerate(vectors):
            rows += [(token, long, t, name, long and table[t] in full, x * idf[token] / norm)
                     for token, x in w.items()]
    tokens = sorted({r[0] for r in rows})
    return rows, [(t, *(i.get(t, i[None]) for i in idfs)) for t in tokens], [i[None] for i in idfs]


def _blocks(text: str = "text") -> Column:
    """The text's runs of lines with a letter or digit."""
    return F.split(F.regexp_replace(text, EMPTY_LINE, ""), "\n\n+")


def _sentences(text: Column) -> Column:
    return F.split(F.regexp_replace(text, STATEMENT_END, "$1\n"), "\n")


def _has(text: Column, parts) -> Column:
    return reduce(or_, [text.contains(p) for p in parts], F.lit(False))


def _spdx(rows: DataFrame) -> DataFrame:
    """SPDX identifiers: ``-only``, ``-or-later`` and ``+`` go, known names get
    their usual case."""
    names = {n.lower(): n for n, _ in TEMPLATES + license_texts.texts()}
    said = (rows.filter(F.lower("text").contains("spdx-license-identifier"))
            .select("doc_id", "path", "text_key",
                    F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("said")))
    said = said.withColumn("said", F.regexp_replace(
        "said", r"(?i)(-only|-or-later|\+)(?![A-Za-z0-9.-])", ""))
    known = F.create_map(*[F.lit(x) for kv in sorted(names.items()) for x in kv])
    return said.select("doc_id", "path", "text_key", F.lit(1).alias("block"),
                       F.coalesce(known[F.lower("said")], "said").alias("licence"),
                       F.lit(1.0).alias("score"), F.lit(False).alias("full"))


def _evidence(rows: DataFrame) -> DataFrame:
    """Where a version or clause that tells licences apart stands."""
    block = F.lower(F.regexp_replace("piece", LINE_START, " "))
    says = F.array_compact(F.array(*[F.when(block.rlike(rule), F.lit(name))
                                     for name, rule in license_texts.EVIDENCE]))
    return (rows.filter(_has(F.lower("text"), ("gnu", "gpl", "neither", "general")))
            .select("doc_id", "path", "text_key", F.posexplode(_blocks()).alias("at", "piece"))
            .select(F.col("doc_id").alias("e_id"), F.col("path").alias("e_path"),
                    F.col("text_key").alias("e_key"), (F.col("at") + 1).alias("at"),
                    F.explode(says).alias("e_licence")).distinct())


def _matches(rows: DataFrame, templates, texts, threshold: float) -> DataFrame:
    """Every unit's templates at the threshold: ``doc_id, path, text_key,
    block, licence, score, full``; block 0 is the whole text."""
    table, tokens_idf, unknown = _template_rows(templates, texts)
    spark = rows.sparkSession
    table = spark.createDataFrame(table, "token string, long boolean, t int, licence string, "
                                         "is_text boolean, x double")
    vocabulary = spark.createDataFrame(tokens_idf, "token string, idf double, long_idf double")
    words = sorted({t for _, w, _ in template_vectors(templates)[0] for t in w})
    need = token_rule(necessary_tokens(templates, threshold))
    parts = license_texts.LICENCE_WORDS if texts else ()
    lower = F.lower("text")
    pieces = (rows.filter(_has(lower, parts) | lower.rlike(need))
              .select("doc_id", "path", "text_key", F.posexplode(
                  F.concat(F.array("text"), _blocks())).alias("block", "piece")))
    def unit(kind):
        return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("unit"))
    joined = F.regexp_replace("piece", LINE_START, " ")
    units = F.transform(_sentences(F.col("piece")), unit("line"))
    if texts:
        units = F.concat(units, F.array(unit("block")(joined)), F.when(
            F.col("piece").contains("\n"), F.transform(_sentences(joined), unit("sentence")))
            .otherwise(F.expr("array()")))
    units = F.when(F.col("block") == 0, F.array(unit("whole")(F.col("piece")))).otherwise(units)
    tokens = F.filter(F.regexp_extract_all(F.lower("unit"), F.lit(f"({TOKEN})")),
                      lambda x: ~x.isin(list(STOP_WORDS)))
    # with m known and u unknown occurrences no cosine exceeds m / sqrt(m^2 + u)
    room = (1 - threshold ** 2) / threshold ** 2 + 1e-9
    m = F.size(F.filter("tokens", lambda x: x.isin(words)))
    units = (pieces.select("doc_id", "path", "text_key", "block",
                           F.posexplode(units).alias("pos", "u"))
             .select("doc_id", "path", "text_key", "block", "pos", "u.kind", "u.unit")
             .withColumn("in_long", _has(F.lower("unit"), parts))
             .withColumn("in_short", F.col("kind").isin("line", "whole")
                         & F.lower("unit").rlike(need))
             .filter("in_long OR in_short")
             .withColumn("tokens", tokens)
             .withColumn("in_short", F.col("in_short")
                         & (F.size("tokens") - m <= m * m * room))
             .filter("in_long OR in_short"))
    # repeated rows share a key: all their counts double, which no cosine sees
    key = ["doc_id", "path", "text_key", "block", "pos"]
    flags = ["in_long", "in_short"]
    tf = (units.select(*key, *flags, F.explode("tokens").alias("token"))
          .groupBy(*key, *flags, "token").agg(F.count(F.lit(1)).alias("tf"))
          .join(F.broadcast(vocabulary), "token", "left"))
    w = F.col("tf") * F.coalesce("idf", F.lit(unknown[0]))
    long_w = F.col("tf") * F.coalesce("long_idf", F.lit(unknown[1]))
    normed = tf.groupBy(*key, *flags).agg(
        F.sqrt(F.sum(w * w)).alias("norm"), F.sqrt(F.sum(long_w * long_w)).alias("long_norm"),
        F.sum(F.when(F.col("idf").isNotNull(), long_w * long_w)).alias("known"),
        F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("token", "tf"))).alias("k"))
    # no cosine exceeds the known tokens' share of the norm
    can = F.col("known") >= (threshold ** 2 - 1e-6) * F.col("long_norm") * F.col("long_norm")
    scored = (normed.withColumn("in_long", F.col("in_long") & can)
              .filter("in_long OR in_short")
              .select(*key, *flags, "norm", "long_norm", F.explode("k").alias("k"))
              .select(*key, *flags, "norm", "long_norm", "k.token", "k.tf")
              .join(F.broadcast(table), "token")
              .filter(F.when(F.col("long"), F.col("in_long")).otherwise(F.col("in_short")))
              .groupBy(*key, "long", "t", "licence", "is_text")
              .agg(F.sum(F.col("tf") * F.col("x")).alias("dot"),
                   F.max(F.when(F.col("long"), F.col("long_norm")).otherwise(F.col("norm")))
                   .alias("norm"))
              .withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
              .filter(F.col("score") >= threshold))
    return scored.select("doc_id", "path", "text_key", "block", "licence", "score", (
        F.col("is_text") & (F.col("block") == 0) & (F.col("score") >= FULL_TEXT)).alias("full"))


def _nearest(matches: DataFrame, evidence: DataFrame) -> DataFrame:
    """Adds ``far``: blocks to the nearest evidence of the match's licence."""
    key = ["doc_id", "path", "text_key", "block", "licence", "score", "full"]
    matches = matches.distinct()
    return (matches.join(evidence, F.col("doc_id").eqNullSafe(F.col("e_id"))
                         & (F.col("path") == F.col("e_path"))
                         & (F.col("text_key") == F.col("e_key"))
                         & (F.col("licence") == F.col("e_licence")), "left")
            .groupBy(*key).agg(F.coalesce(F.min(F.abs(F.col("at") - F.col("block"))), F.lit(FAR))
                               .alias("far")))


def license_scan(files: DataFrame, path: Column, templates=TEMPLATES,
                 threshold: float = THRESHOLD, id_col: str = "doc_id",
                 text_col: str = "text", texts=None) -> DataFrame:
    """``doc_id, path, licence, score, origin, licence_dir``; ``origin`` is
    ``header``, ``file``, ``inherited`` or null (no licence).  ``texts``: the
    table of texts and headers, by default all of :mod:`.license_texts`; with
    ``()`` only statements are compared, as in the oracle."""
    texts = license_texts.texts() if texts is None else texts
    rows = id_text(files, id_col, text_col,
                   {"path": F.coalesce(path.cast("string"), F.lit(""))})
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    scored = _matches(rows, templates, texts, threshold)
    if texts:
        scored = _nearest(scored.unionByName(_spdx(rows)), _evidence(rows))
    else:
        scored = scored.withColumn("far", F.lit(FAR))
    own = (scored.groupBy("doc_id", "path", "text_key")
           .agg(F.min(F.struct((~F.col("full")).alias("part"), (-F.col("score")).alias("minus"),
                               "far", "licence", "block")).alias("b"))
           .select(F.col("doc_id").alias("o_id"), F.col("path").alias("o_path"),
                   F.col("text_key").alias("o_key"), F.col("b.licence").alias("own"),
                   (-F.col("b.minus")).alias("score"), (F.col("b.block") == 0).alias("is_whole")))
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    base = F.regexp_extract("path", "([^/]*)$", 1)
    marked = (rows.select("doc_id", "path", "text_key").join(
        own, F.col("doc_id").eqNullSafe(F.col("o_id")) & (F.col("path") == F.col("o_path"))
        & (F.col("text_key") == F.col("o_key")), "left")
        .select("doc_id", "path", folder.alias("dir"), "own", "score",
                F.when(F.col("own").isNotNull(), F.when(
                    F.col("is_whole") | base.rlike(LICENCE_FILE), "file").otherwise("header"))
                .alias("origin")))

    licence_dirs = (marked.filter("origin = 'file'").groupBy("dir")
                    .agg(F.min(F.struct((-F.col("score")).alias("minus"), "own")).alias("b"))
                    .select(F.col("dir").alias("licence_dir"), F.col("b.own").alias("inherited"),
                            (-F.col("b.minus")).alias("dir_score")))
    parts = F.split("dir", "/")
    steps = F.transform(F.sequence(F.lit(0), F.size(parts)),
                        lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = (marked.filter("own IS NULL").select("dir").distinct()
             .select("dir", F.posexplode(F.array_distinct(steps)).alias("depth", "licence_dir")))
    nearest = (above.join(licence_dirs, "licence_dir").groupBy("dir")
               .agg(F.max(F.struct("depth", "licence_dir", "inherited", "dir_score")).alias("n"))
               .select(F.col("dir").alias("n_dir"), "n"))
    # a folder may hold a third of all files: its files meet copies of its one row
    nearest = nearest.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("n_salt"))
    marked = marked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "path"), F.lit(SALTS))
                               .cast("int"))
    takes = F.col("own").isNull() & F.col("n").isNotNull()
    return (marked.join(nearest, (F.col("dir") == F.col("n_dir"))
                        & (F.col("salt") == F.col("n_salt")), "left")
            .select("doc_id", "path",
                    F.when(takes, F.col("n.inherited")).otherwise(F.col("own")).alias("licence"),
                    F.when(takes, F.col("n.dir_score")).otherwise(F.col("score")).alias("score"),
                    F.when(takes, "inherited").otherwise(F.col("origin")).alias("origin"),
                    F.when(takes, F.col("n.licence_dir"))
                    .when(F.col("origin") == "file", F.col("dir")).alias("licence_dir")))


def oracle(path_sql: str, templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB SQL, over all statements (no prefilter)."""
    values = ", ".join(f"({k}, '{name}', '{text.lower()}')"
                       for k, (name, text) in enumerate(templates))
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    name_rule = LICENCE_FILE.removeprefix("(?i)")
    return f"""
    WITH templates(t, licence, body) AS (VALUES {values}),
    ttok AS (SELECT * FROM (
        SELECT t, licence, unnest(regexp_extract_all(body, '{TOKEN}')) AS token FROM templates)
        WHERE token NOT IN ({stop})),
    ttf AS (SELECT t, licence, token, count(*) AS tf FROM ttok GROUP BY ALL),
    idf AS (SELECT token, ln({1 + len(templates)}.0 / (1 + count(DISTINCT t))) + 1 AS idf
            FROM ttok GROUP BY token),
    tw AS (SELECT t, licence, token, tf * idf AS w FROM ttf JOIN idf USING (token)),
    tn AS (SELECT t, sqrt(sum(w * w)) AS norm FROM tw GROUP BY t),
    files AS (SELECT doc_id, {path_sql} AS path, coalesce(text, '') AS body FROM documents),
    units AS (
        SELECT doc_id, path, s.pos, s.unit FROM files, (
            SELECT unnest(string_split(regexp_replace(body, '([.!?])[ ]+', '\\1' || chr(10), 'g'),
                                       chr(10))) AS unit,
                   generate_subscripts(string_split(regexp_replace(body, '([.!?])[ ]+',
                                       '\\1' || chr(10), 'g'), chr(10)), 1) AS pos) s
        UNION ALL SELECT doc_id, path, -1, body FROM files),
    tok AS (SELECT * FROM (
        SELECT doc_id, path, pos, unnest(regexp_extract_all(lower(unit), '{TOKEN}')) AS token
        FROM units) WHERE token NOT IN ({stop})),
    uw AS (SELECT doc_id, path, pos, token,
                  count(*) * coalesce(any_value(idf), ln({1 + len(templates)}.0) + 1) AS w
           FROM tok LEFT JOIN idf USING (token) GROUP BY ALL),
    un AS (SELECT doc_id, path, pos, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL),
    cosines AS (SELECT doc_id, path, pos, licence,
                       round(sum(uw.w * tw.w) / (any_value(un.norm) * any_value(tn.norm)), 6)
                       AS score
                FROM uw JOIN tw USING (token) JOIN un USING (doc_id, path, pos)
                JOIN tn USING (t) GROUP BY doc_id, path, pos, t, licence),
    own AS (SELECT doc_id, path, licence AS own, score, pos FROM cosines
            WHERE score >= {threshold}
            QUALIFY row_number() OVER (PARTITION BY doc_id, path
                                       ORDER BY score DESC, licence, pos) = 1),
    marked AS (SELECT f.doc_id, f.path, regexp_replace(f.path, '/?[^/]*$', '') AS dir, own, score,
                      CASE WHEN own IS NULL THEN NULL
                           WHEN pos = -1 OR regexp_matches(regexp_extract(f.path, '([^/]*)$', 1),
                                                           '{name_rule}', 'i')
                           THEN 'file' ELSE 'header' END AS origin
               FROM files f LEFT JOIN own USING (doc_id, path)),
    dirs AS (SELECT dir AS licence_dir, own AS inherited, score AS dir_score FROM marked
             WHERE origin = 'file'
             QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, own) = 1),
    nearest AS (SELECT m.dir, licence_dir, inherited, dir_score
                FROM (SELECT DISTINCT dir FROM marked) m JOIN dirs d
                  ON d.licence_dir = '' OR m.dir = d.licence_dir
                  OR starts_with(m.dir, d.licence_dir || '/')
                QUALIFY row_number() OVER (PARTITION BY m.dir
                                           ORDER BY strlen(licence_dir) DESC) = 1)
    SELECT m.doc_id, m.path, coalesce(own, inherited) AS licence, coalesce(score, dir_score) AS score,
           CASE WHEN own IS NULL AND inherited IS NOT NULL THEN 'inherited' ELSE origin END AS origin,
           CASE WHEN own IS NULL THEN licence_dir WHEN origin = 'file' THEN m.dir END AS licence_dir
    FROM marked m LEFT JOIN nearest n ON m.dir = n.dir"""
