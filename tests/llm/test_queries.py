"""Every query of the corpus operators on a whole small table: columns, types, rows and folds of its contract."""

import zlib

import pytest

from strandlake.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
FOLDS = {"op3_lm_scoring": (7, 2), "op8_quality_classifier": (5, 0), "op9_toxicity": (3, 1)}
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
COLUMNS = {
    "op1_line_dedup": "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op5_simhash_near_dedup": "doc_id bigint, fingerprint string, component_id bigint",
    "op6_url_filters": "page_id bigint, host string, path string, rule string, verdict string",
    "op8_quality_classifier": "doc_id bigint, held_out boolean, score double, predicted int",
    "op9_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_document_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op11_filter_interaction_audit": "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS),
    "op12_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op13_importance_resampling": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query_keeps_its_contract(spark, texts, name):
    df = QUERIES[name](spark, DATA)
    want = [tuple(c.split()) for c in COLUMNS[name].split(", ")]
    assert df.dtypes[: len(want)] == want
    rows = df.collect()
    if name == "op6_url_filters":
        assert sorted(r["page_id"] for r in rows) == sorted(r["page_id"] for r in spark.read.parquet(f"{DATA}/pages.parquet").select("page_id").collect())
        assert {r["verdict"] for r in rows} <= {"allow", "block"}
        return
    if name == "op11_filter_interaction_audit":
        assert len(rows) == 600 * len({r["part"] for r in rows})
        return
    if name == "op2_best_fit_packing":
        filled = {}
        for r in rows:
            filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for places in filled.values():
            end = 0
            for at, n in sorted(places):
                assert at == end
                end = at + n
            assert end <= 2048
        assert {r["doc_id"] for r in rows} == set(texts)
        return
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    if name in FOLDS:
        modulus, rest = FOLDS[name]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % modulus == rest) for r in rows)
    if "predicted" in df.columns:
        bound = 0.3 if name.startswith("op8") else 0.7
        assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= bound) for r in rows)
