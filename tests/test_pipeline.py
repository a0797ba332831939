"""Delivery folder -> compiled catalogue -> queries -> snapshot -> streaming upkeep."""

import json

import pytest
from pyspark.sql import functions as F

from metaloom.plans.compile import compile_templates
from metaloom.plans.explore import Engine
from metaloom.sources import documents as D
from metaloom.sources import files as FI
from metaloom.sources import handoff as HO
from metaloom.sources import snapshot as SN
from metaloom.streaming.incremental import StreamingIndex


@pytest.fixture(scope="module")
def delivery(tmp_path_factory):
    root = tmp_path_factory.mktemp("delivery")
    col = lambda n, cat, target: {"column_name": n, "catagory": cat, "corresponding_counter_or_dim": target, "data_type": "string"}
    files = {
        "apps": {"apps": [{"app_name": "Metro", "features": [{"feature_name": "Weak coverage on lines", "feature_summary": "Find weak coverage", "customer_value": "happy riders",
                                                             "feature_description": {"metric_name": ["RSRP", "SINR"]}}]}]},
        "kpi": {"metric_summaries": [{"summary_type": "radio", "metrics": [{"metric_name": "RSRP", "metric_type": "", "related_counters": ["RSRP count"], "related_dimensions": ["Cell"],
                                                                           "description": "Reference signal received power", "calculation_formula": "avg(rsrp)"}]}],
                "counter_summaries": [{"application": "radio", "counters": [{"counter_name": "RSRP count", "description": "samples", "field": {"field_name": "rsrp_cnt"}, "related_dimensions": ["Cell"]}]}],
                "dimension": [{"dimension_name": "Cell", "sdr_name": "MR_TABLE", "field_name": "cell_id", "description": "radio cell"}]},
        "tables": {"tables": [{"table_name": "MR_TABLE", "table_description": "measurement reports of rsrp", "logic_model_name": "MR", "layer": "DWD", "domain": "Performance", "topic": "Wireless Coverage",
                               "granularity": "hour", "source": {"source_tables": ["RAW_MR"]}, "columns": [col("rsrp", "指标", "RSRP"), col("cell_id", "维度", "Cell")]}]},
        "groups": {"analysis_groups": [{"analysis_name": "Coverage", "analysis_summaries": [{"analysis_type": "Weak coverage analysis", "description": "where is coverage weak",
                                        "calculation_metric_tables": [{"table_name": "MR_TABLE", "calculation_metrics": [{"metric_name": "RSRP", "calculation_formula": "avg(x)"}]}]}]}]},
        "sid": {"metadata": {}, "domains": {"Resource": {"abes": {"Cell/A": {"bes": {"Cell object": {"description": "a cell", "source_table": "MR_TABLE", "attributes": [{"name": "cell_id", "description": "id"}]}}}}}}},
        "Template-Schema": {"apps": []},
    }
    for name, body in files.items():
        (root / f"{name}.json").write_text(json.dumps(body, ensure_ascii=False), encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def catalog(spark, delivery):
    return compile_templates(spark, delivery)


def test_contexts_fusion_and_classification(catalog):
    names = {(r["context_type"], r["name"]) for r in catalog.contexts.collect()}
    assert ("metric", "RSRP") in names and ("physical-model", "MR_TABLE") in names and ("business-object", "Cell object") in names
    formula = catalog.sections.where("section = 'formula' AND ctx_id = 'data://metrics/rsrp'").collect()
    assert [r["value"] for r in formula] == ["avg(rsrp)"]  # the definition source outranks the modelling document
    assert catalog.conflicts.where("section = 'formula'").count() == 1
    layer = {r["section"]: r["value"] for r in catalog.sections.where("ctx_id = 'data://physical-models/mr-table'").collect()}
    assert layer["classification.layer"] == "SDL" and layer["topic"] == "无线覆盖"


def test_references_and_pages(catalog):
    done = {(r["relation"], r["status"]) for r in catalog.references.collect()}
    assert ("uses_metric", "CONFIRMED") in done and ("upstream_model", "UNRESOLVED") in done
    page = catalog.pages.where("path = 'data://physical-models/mr-table'").first()
    assert "## Layer\nSDL" in page["l1"] and "## References" in page["l1"] and "## Organization: asset" in page["l1"]
    assert catalog.issues.where("severity = 'error'").count() == 0


def test_search_read_expand_explore(spark, catalog):
    engine = Engine(catalog)
    q = spark.createDataFrame([(1, "RSRP"), (2, "哪些模型提供 RSRP"), (3, "where is coverage weak")], "query_id long, text string")
    hits = engine.search(q, top_k=3, bundle_k=6, token_budget=4000).collect()
    first = {r["query_id"]: r["path"] for r in hits if r["position"] == 1}
    assert first[1] == "data://metrics/rsrp"
    assert any("weak-coverage" in r["path"] for r in hits if r["query_id"] == 3)
    assert sum(r["tokens"] for r in hits if r["query_id"] == 1) <= 4000
    seen = spark.createDataFrame([(1, "data://metrics/rsrp")], "query_id long, path string")
    again = engine.search(q.where("query_id = 1"), top_k=3, seen=seen)
    assert again.where("path = 'data://metrics/rsrp'").count() == 0
    one = spark.createDataFrame([("data://physical-models/mr-table",)], "path string")
    assert engine.read(one, "L1").first()["content"].startswith("# MR_TABLE")
    assert engine.read(one, "L2", ["grain"]).first()["value"] == "hour"
    parts = engine.expand(one, ["related", "fields", "parents", "hierarchy", "business_mapping", "evidence"])
    assert parts["related"].count() > 0 and parts["fields"].count() == 2 and parts["parents"].count() > 0
    out = engine.explore(q)
    assert {r["query_id"]: r["intent"] for r in out["plan"].collect()}[2] == "metric_to_models"
    status = {(r["query_id"], r["aspect"]): r["status"] for r in out["coverage"].collect()}
    assert status[(2, "metrics")] == "SATISFIED"
    assert out["summary"].count() == 3


def test_snapshot_roundtrip_and_order_free_version(spark, catalog, tmp_path):
    store = SN.SnapshotStore(spark, str(tmp_path / "snap"))
    tables = {"contexts": catalog.contexts, "references": catalog.references}
    v = store.save(tables, catalog.issues)
    assert store.save({k: t.repartition(3) for k, t in tables.items()}) == v
    assert store.load(verify=True)["contexts"].count() == catalog.contexts.count()
    bad = spark.createDataFrame([("error", "duplicate_path", "x")], "severity string, code string, subject string")
    with pytest.raises(ValueError, match="duplicate_path"):
        store.save(tables, bad)


def test_delivery_inventory(spark, delivery):
    actual = FI.scan_files(spark, delivery).select("path", "source_type", "sha256").withColumn("kind", F.lit("k"))
    assert actual.count() == 6
    assert FI.inventory_diff(actual, actual).count() == 0
    declared = actual.where("path <> 'kpi.json'").unionByName(actual.limit(1).withColumn("path", F.lit("../x.json")))
    assert {r["problem"] for r in FI.inventory_diff(declared, actual).collect()} == {"missing_in_manifest", "extra_in_manifest", "unsafe_path"}
    with pytest.raises(ValueError):
        FI.coverage_allowed("COMPLETE", False)


def test_fragment_handoff(spark, tmp_path):
    ok = {"fragment_id": "f1", "context_type": "metric", "candidate_name": "n", "section_type": "summary", "payload": "x", "evidence": [{"source": {"source_id": "s", "path": "p"}}]}
    (tmp_path / "f.jsonl").write_text(json.dumps(ok) + "\n" + json.dumps({**ok, "fragment_id": "f2", "status": "GUESS", "evidence": []}), encoding="utf-8")
    rows = HO.read_fragments(spark, str(tmp_path / "f.jsonl"))
    assert {(r["fragment_id"], r["error"]) for r in HO.fragment_errors(rows).collect()} == {("f2", "invalid_status"), ("f2", "missing_evidence")}


def test_two_header_rows_and_regions(spark):
    rows = [("s", 1, ["Title", "Info"]), ("s", 2, ["Name", "Formula", "Dim", "Unit", "Note"]), ("s", 3, ["a", "1", "2", "3", "4"]), ("s", 4, ["", " "]), ("s", 5, ["Model", "Layer"]), ("s", 6, ["t", "5"])]
    reg = D.sheet_regions(spark.createDataFrame(rows, "sheet string, row long, cells array<string>"))
    assert {(r["row"], r["region"], r["start_row"]) for r in reg.collect()} == {(1, 1, 1), (2, 1, 1), (3, 1, 1), (5, 2, 5), (6, 2, 5)}
    assert {r["region"]: r["header_rows"] for r in D.header_rows(reg).collect()} == {1: 2, 2: 1}


def test_streaming_index_replays_batches(spark, tmp_path):
    cols = "path string, name string, context_type string, l0 string, l1 string, identity_status string, version long, deleted boolean"
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", "A", "metric", "old text", "", "EXPLICIT", 1, False), ("b", "B", "metric", "keep me", "", "EXPLICIT", 1, False), ("a", "A", "metric", "newer text", "", "EXPLICIT", 2, False)], cols).coalesce(1).write.json(src)
    index = StreamingIndex(spark, str(tmp_path / "index"))
    run = lambda: index.start(spark.readStream.schema(cols).json(src), str(tmp_path / "ck")).awaitTermination(120)
    run()
    toks = {(r["path"], r["token"]) for r in index.tables()[1].collect()}
    assert ("a", "newer") in toks and ("a", "old") not in toks and ("b", "keep") in toks
    spark.createDataFrame([("b", "B", "metric", "gone", "", "EXPLICIT", 3, True)], cols).coalesce(1).write.mode("append").json(src)
    run()
    pages, postings = index.tables()
    assert [r["path"] for r in pages.collect()] == ["a"] and postings.where("path = 'b'").count() == 0
