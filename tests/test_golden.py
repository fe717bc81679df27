import json

import pytest

from lodestone.operators import evidence
from lodestone.plans import benchmark
from lodestone.sources import reports


def section(text, sid="1", version="1", title="Scope"):
    return {"document_id": "d", "section_id": sid, "title": title, "text": text, "page": 3, "version": version}


DATA = {
    "dataset": "own", "version": "1",
    "retrieval": {"k": 5, "documents": [{"source": "S1", "content": "# Risk\n\nArticle 2 - Review\n\nBanks must review model risk annually."}, {"source": "S2", "content": "# Data\n\nArticle 5 - Retention\n\nPersonal records shall be erased after ten months."}],
                  "queries": [{"id": "q1", "question": "How often must banks review model risk?", "relevant_citations": ["S1 > Risk > Article 2"]}, {"id": "q2", "question": "When is the quarterly dividend disclosed?", "relevant_citations": ["S2 > Data > Article 5"]}]},
    "changes": {"materiality_threshold": 0.35, "cases": [
        {"id": "c1", "expected_material": True, "previous": section("Banks should report."), "current": section("Banks must report.", version="2")},
        {"id": "c2", "expected_material": False, "previous": section("Same text."), "current": section("same  TEXT.", version="2")},
        {"id": "c3", "expected_material": True, "previous": None, "current": section("Firms shall file.", "9")},
        {"id": "c4", "expected_material": True, "previous": section("Old words.", "8"), "current": None}]},
    "grounding": {"sources": [section("Banks must keep a register.")], "claims": [
        {"claim_id": "k1", "expected_status": "supported", "citations": [{"document_id": "d", "section_id": "1", "quote": "keep a register", "page": 3, "version": "1"}]},
        {"claim_id": "k2", "expected_status": "unsupported", "citations": [{"document_id": "d", "section_id": "1", "quote": "keep no register", "page": 3, "version": "1"}]}]},
}


def test_whole_run(spark, tmp_path):
    r = benchmark.run(spark, DATA)
    assert (r["retrieval"]["recall_at_k"], r["retrieval"]["mrr"]) == (0.5, 0.5) and r["retrieval"]["retrieved"]["q1"][0] == "S1 > Risk > Article 2"
    assert (r["changes"]["passed"], r["changes"]["failed"]) == (4, 0)
    assert [c["change_type"] for c in r["changes"]["cases_detail"]] == ["modified", "unchanged", "added", "removed"]
    assert [c["materiality_score"] for c in r["changes"]["cases_detail"]] == [0.9, 0.0, 0.75, 0.5]
    assert r["grounding"]["claims"] == 5 and r["grounding"]["groundedness"] == 0.8 and r["reviewer"]["accuracy"] == 1
    assert benchmark.run(spark, DATA) == r
    reports.write_report(r, str(tmp_path / "r" / "x.json"), str(tmp_path / "r.md"))
    assert reports.find_report([str(tmp_path / "none"), str(tmp_path / "r" / "x.json")])["available"] and "| recall_at_k | 0.5 |" in (tmp_path / "r.md").read_text()
    assert reports.find_report([]) == {"available": False}
    with pytest.raises(ValueError):
        benchmark.run(spark, {"dataset": "x"})


def test_small_parts(spark, tmp_path):
    v = spark.createDataFrame([(1.0, 0.5, 0.0, True), (0.0, 0.5, 1.0, False)], "groundedness double, correctness double, completeness double, passed boolean")
    assert tuple(benchmark.judge_summary(v).first()) == (2, 0.5, 0.5, 0.5, 0.5)
    m = spark.createDataFrame([({"d:1:x": "text"},)], "sources map<string,string>")
    assert evidence.sources_from_map(m).first()["source_id"] == "d:1:x"
    with pytest.raises(Exception):
        evidence.sources_from_map(spark.createDataFrame([({"d": "text"},)], "sources map<string,string>")).collect()
    assert reports.sidecar_errors({"a": 1}, {"filename": "f", "sha256": reports.sha256_json({"a": 1}), "counts": {}}, {}, "f") == []
    assert reports.sidecar_errors({"a": 1}, {"filename": "g"}, {}, "f") == ["filename", "sha256", "counts"]
    assert json.loads(reports.canonical_json({"b": "é", "a": 1})) == {"a": 1, "b": "é"} and reports.Settings.of(spark).max_results == 5
    with pytest.raises(ValueError):
        reports.Settings(max_results=51)
    reports.append_audit(spark.createDataFrame([("a", "x", "r", "{}")], "actor string, action string, request_id string, payload string"), str(tmp_path / "audit"))
    assert spark.read.parquet(str(tmp_path / "audit")).count() == 1
    reports.write_provenance(spark.createDataFrame([("s", 10)], "source_id string, bytes long"), "abc", str(tmp_path / "prov"))
    assert spark.read.json(str(tmp_path / "prov")).first()["manifest_sha256"] == "abc"
    assert reports.unique_violations(spark.createDataFrame([(1, 2), (1, 2)], "a int, b int"), "a", "b").count() == 1
