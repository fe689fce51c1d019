"""The registered queries: same rows as their SQL, contracts' columns, and the pipeline against a brute-force version."""

import hashlib
import sys
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from test_near_dup import plain as plain_near

from lectern.llm import bpe, mixing, near_dup, quality, secrets
from lectern.llm.oracles import ORACLES
from lectern.llm.queries import QUERIES

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1": "doc_id held_out lang_pred score", "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op4": "doc_id start n_tokens ids_crc32",
    "op5": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next", "op6": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256", "op8": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op9": "doc_id n_shingles component_id kept", "op10": "doc_id size source_size target taken",
    "op11": "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256",
    "op12": "lang rank phrase a l r n score",
    "op13": "doc_id held_out score predicted",
}
ROWS = {"op11": 20, "op12": 34}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF)
    assert set(COLUMNS.get(name.split("_")[0], "doc_id").split()) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == ROWS.get(name.split("_")[0], 200)
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
        want = con.execute(ORACLES[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(tuple(r[c] for c in names) for r in rows) == sorted(want.fetchall())


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "secret_scan", "source_mix", "byte_level_bpe"]
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in kept]
    _, root = plain_near(rows)
    rows = [r for r in rows if root[r[0]] == r[0]]
    rows = [(d, secrets.masked(t, secrets.all_spans(t)[1]), s) for d, t, s in rows]
    mixed = mixing.mix(spark.createDataFrame([(d, t, s) for d, t, s in rows], "doc_id long, text string, source string"))
    copies = {r.doc_id: r.copies for r in mixed.collect()}
    coder = bpe.encoding(*bpe.default_files())
    want = Counter()
    for d, t, _ in rows:
        ids = np.array(coder.encode_ordinary(t), "<u4")
        want[d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()] += copies[d]
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect())
    assert got == +want
    stage = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, SF)
        assert stage.columns == docs.columns


def test_pipeline_stages_take_empty_and_odd_tables(spark):
    import corpus_pipeline
    from cases import frame

    for docs in (frame(spark, []), frame(spark)):
        columns = docs.columns
        for _, f in corpus_pipeline.STAGES[:-1]:
            docs = f(spark, docs, "")
            assert docs.columns == columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() >= 0
    assert near_dup.PERCENT == 75
