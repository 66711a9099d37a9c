"""The registered text queries: SQL parity where there is SQL, and the
pipeline against brute force, stage by stage."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tidepanel.llm import bagminhash, bpe, decontaminate, quality_fm, rlz, suffix_family
from tidepanel.llm.queries import ORACLES, QUERIES
from tidepanel.session import prepare


def test_all_are_registered():
    have = entry.queries()
    assert all(any(k.startswith(f"op{n}_") for k in have) for n in range(1, 14))
    assert "pipeline" in have and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(ORACLES[name]).df()
    got = QUERIES[name](spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    # a null makes a column of whole numbers a column of doubles
    rows = lambda df: sorted(map(repr, df[cols].convert_dtypes().astype(str).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs_on_all_rows(spark, sf, name):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    rows = QUERIES[name](spark, sf).count()
    assert rows == n or name.startswith("op9_") and rows > 0


def _documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def _sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op1_digests(spark, sf):
    want = {(d, n, gone, _sha(kept)) for d, (n, gone, kept) in rlz.brute_force(
        list(_documents(spark, sf).items())).items()}
    got = QUERIES["op1_rlz_substring_dedup"](spark, sf).collect()
    assert {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got} == want


def test_op10_digests(spark, sf):
    want = {(d, n, gone, runs, _sha(kept)) for d, (n, gone, runs, kept) in
            suffix_family.brute_force(list(_documents(spark, sf).items())).items()}
    got = QUERIES["op10_suffix_family_dedup"](spark, sf).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_op2_and_op4_digests(spark, sf):
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(bpe.default_vocabulary())
    trips, counts = set(), set()
    for d, t in _documents(spark, sf).items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        trips.add((d, len(ids), _sha(np.array(ids, "<u4").tobytes()),
                   _sha(lib.decode(ids, skip_special_tokens=False))))
        counts.add((d, len((t or "").encode()), len(ids), len(ids) > 1024))
    got = QUERIES["op2_bpe_roundtrip"](spark, sf).collect()
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == trips
    got = QUERIES["op4_token_counts"](spark, sf).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got} == counts


def test_op7_digests(spark, sf):
    bench = [(str(r.item_id), r.text)
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = set(decontaminate.brute_force(sorted(_documents(spark, sf).items()), bench))
    got = QUERIES["op7_benchmark_decontamination"](spark, sf).collect()
    assert {(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated)
            for r in got} == want


def test_op8_folds_and_scores(spark, sf):
    got = {r.doc_id: r for r in QUERIES["op8_quality_fm"](spark, sf).collect()}
    assert set(got) == set(_documents(spark, sf))
    for d, r in got.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)


def test_pipeline_stages(spark, sf):
    prepare(spark)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    bench = [(str(r.item_id), r.text)
             for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name == "bpe":
            from tokenizers import Tokenizer

            from tidepanel.llm.bpe import default_vocabulary
            lib = Tokenizer.from_file(default_vocabulary())
            for r in out.collect():
                ids = lib.encode(rows.pop(r.doc_id), add_special_tokens=False).ids
                assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
            assert not rows
            break
        kept = {r.doc_id for r in out.collect()}
        assert out.columns == columns and kept
        if name == "quality":
            model = quality_fm.train(docs, labels)
            want = {r.doc_id for r in quality_fm.score(docs, model).collect() if r.score >= 0.3}
        elif name == "exact_dedup":
            want = set({t: d for d, t in sorted(rows.items())}.values())
        elif name == "near_dedup":
            want = set(bagminhash.brute_force(sorted(rows.items())).values())
        else:
            want = {b[0] for b in decontaminate.brute_force(sorted(rows.items()), bench)
                    if not b[5]}
        assert kept == want, name
        ids = sorted(kept)
        docs = docs.filter(docs.doc_id.isin(ids))
