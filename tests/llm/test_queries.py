"""The registered queries on the driver's smallest tables: SQL where there is one, else their contracts."""

import sys
from pathlib import Path

import duckdb
import pytest

SF = Path("/root/testdata/sf0.001")
sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "scripts"))
pytestmark = pytest.mark.skipif(not SF.exists(), reason="needs the driver's tables")

COLUMNS = {
    "op1_secret_scan": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2_exact_dedup": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op3_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op4_near_dedup": ["doc_id", "n_shingles", "component_id", "kept"],
    "op5_language_id": ["doc_id", "page_id", "language", "posterior", "kept"],
    "op6_quality_classifier": ["doc_id", "held_out", "score", "predicted"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op9_pii": ["doc_id", "text"],
    "op10_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op11_filter_audit": ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"],
    "op12_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "position"],
    "op13_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "pipeline": ["doc_id", "piece", "sequence_id"],
}


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for path in SF.glob("*.parquet"):
        c.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return c


def test_the_list_is_complete():
    from framelake.llm.queries import QUERIES

    assert list(QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", COLUMNS)
def test_query(spark, connection, name):
    from compare import compare

    from framelake.llm.oracles import ORACLES
    from framelake.llm.queries import QUERIES

    if name in ORACLES:
        assert compare(spark, connection, name, QUERIES[name], ORACLES[name], str(SF)) == "ok"
        return
    out = QUERIES[name](spark, str(SF))
    assert set(COLUMNS[name]) <= set(out.columns)
    documents = {r[0] for r in connection.sql("SELECT doc_id FROM documents").fetchall()}
    ids = [r.doc_id for r in out.select("doc_id").collect()]
    if name in ("op8_packing", "pipeline"):
        assert set(ids) <= documents and len(ids) > 0
    elif name == "op5_language_id":
        assert set(ids) - {None} == documents and ids.count(None) == connection.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    else:
        assert sorted(ids) == sorted(documents)


def test_secret_digest(spark):
    import hashlib

    from framelake.llm import secret_scan
    from framelake.llm.queries import op1_secret_scan

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op1_secret_scan(spark, str(SF)).collect():
        spans = secret_scan.spans_of(texts[r.doc_id] or "")
        base = [s for s in spans if s[0] in ("assign", "access", "hex")]
        line = lambda found: ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        assert r.base_sha256 == hashlib.sha256(line(base).encode()).hexdigest() and r.spans == line(spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, *_ in base) for kind in ("assign", "access", "hex"))


def test_held_out_quality(spark):
    """Better than the majority on labels that were never learnt from."""
    from framelake.llm.queries import op6_quality_classifier

    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in op6_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in rows) / len(rows)
    majority = sum(labels[r.doc_id] for r in rows) / len(rows)
    assert right > 0.95 > majority
