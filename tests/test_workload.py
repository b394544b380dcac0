"""The workload generator, reports and streams."""

import json
import os

import pytest
from bundlefold.config import PackConfig
from bundlefold.errors import ConfigError
from bundlefold.plans import report, workload
from bundlefold.plans.pack import pack, tree_totals
from bundlefold.sources.tree import read_tree
from bundlefold.streaming.frames import arrival_rate, arrivals, frame_stream, running_totals


def recipe(tmp_path, **other):
    (tmp_path / "t.tpl").write_text("{{PACKAGE_NAME}} v{{PACKAGE_VERSION}} d{{PACKAGE_DEPTH}} [{{DEPENDENCY_NAME_ARRAY}}]\n{{IMPORT_BLOCK}}\n{{SCHEMA_PROPERTIES}}\n{{DEPENDENCIES_JSON}}")
    (tmp_path / "r.tpl").write_text("{{ROOT_PACKAGE_NAME}}\n{{ROOT_DEPENDENCIES_JSON}}")
    fields = {
        "name": "mini", "description": "", "root_package_name": "root", "root_packages": 2, "fanout_per_depth": [2], "scoped_package_period": 0, "scopes": ["@s"],
        "root_templates": [{"relative_path": "package.json", "template": "r.tpl"}], "package_templates": [{"relative_path": "package.txt", "template": "t.tpl"}],
        "expected_contract": {"package_count": 6, "regular_file_count": 7, "max_package_depth": 2, "min_directory_count": 5, "dominant_file_types": ["text"]},
    } | other
    (tmp_path / "recipe.json").write_text(json.dumps(fields, indent=1))
    return str(tmp_path / "recipe.json")


def test_mini_workload(spark, tmp_path):
    r = workload.Recipe(spark, recipe(tmp_path))
    s = workload.planned_summary(spark, r).first()
    assert (s.package_count, s.regular_file_count, s.max_package_depth) == (6, 7, 2)
    out = str(tmp_path / "out")
    assert workload.materialise(spark, r, out) == 7
    inner = f"{out}/node_modules/runtime-00001/node_modules/schema-00003/package.txt"
    assert open(inner).read() == "schema-00003 v1.3.0 d2 []\n\n\n"
    assert open(f"{out}/node_modules/helpers-00002/package.txt").read() == (
        'helpers-00002 v1.2.0 d1 ["types-00005", "router-00006"]\nimport * as dep_0 from "types-00005";\nimport * as dep_1 from "router-00006";\n'
        '    "dependency_0": { "type": "string", "default": "types-00005" },\n    "dependency_1": { "type": "string", "default": "router-00006" }\n    "types-00005": "1.0.0",\n    "router-00006": "1.0.0"'
    )
    t = tree_totals(read_tree(spark, out)).first()
    assert (t.regular_file_count, t.raw_bytes, t.directory_count) == (7, s.total_bytes, s.directory_count)
    assert workload.broken_terms(workload.planned_summary(spark, r), r.fields["expected_contract"]).count() == 0
    with pytest.raises(ConfigError):
        workload.materialise(spark, r, out)


def test_scoped_names(spark):
    rows = workload.packages(spark, 4, [], 2, ["@a", "@b", "@c"]).orderBy("index").collect()
    assert [r.name for r in rows] == ["runtime-00001", "@b/helpers-00002", "schema-00003", "@a/config-00004"]


def test_bad_recipes(spark, tmp_path):
    for wrong in ({"scopes": []}, {"package_templates": []}, {"root_templates": [{"relative_path": "x", "template": "missing"}]}):
        with pytest.raises(ConfigError):
            workload.Recipe(spark, recipe(tmp_path, **wrong))


def test_report(spark, tmp_path):
    rec = lambda b, p, ms, size: {"workload": "w", "baseline": b, "phase": p, "command": "c", "elapsed_ms": ms, "output_size_bytes": size}
    path = str(tmp_path / "r" / "report.json")
    report.write_report(path, {"dry_run": False, "workload": {"regular_file_count": 100, "total_bytes": 1 << 20}, "records": [rec("own", "pack", 1000, 10), rec("tar", "pack", 4000, 30), rec("own", "unpack", 0, None)]})
    rows = report.records(report.read_report(spark, path, "own"))
    assert {(r.phase, r.files_per_sec, r.mib_per_sec) for r in report.with_rates(rows).where("baseline = 'own'").collect()} == {("pack", 100.0, 1.0), ("unpack", None, None)}
    assert [tuple(r) for r in report.ratios(rows, "own", "tar").collect()] == [("w", "pack", 4.0, 3.0)]
    want = spark.createDataFrame([("own", "pack"), ("tar", "pack"), ("tar", "unpack")], "baseline string, phase string")
    assert {tuple(r) for r in report.missing_and_extra(rows, want, ["baseline", "phase"]).collect()} == {("tar", "unpack", "missing"), ("own", "unpack", "extra")}
    done = report.measured_command(["sh", "-c", "echo hi; exit 3"])
    assert (done["exit_status"], done["stdout"]) == (3, "hi\n")
    assert report.measured_command(["/no/such/tool"])["exit_status"] is None


def drained(query):
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_streams(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "arrived" / "one")
    src.mkdir()
    for i in range(40):
        (src / f"f{i}").write_bytes(os.urandom(300))
    row = pack(spark, str(src), out, PackConfig(bundle_target_bytes=1000, small_file_threshold=500, codec="none")).first()
    totals = running_totals(frame_stream(spark, out, per_batch=3))
    drained(totals.writeStream.outputMode("complete").format("memory").queryName("frame_totals").option("checkpointLocation", str(tmp_path / "c1")).start())
    got = spark.table("frame_totals").first()
    assert (got.frames, got.raw_bytes) == (row.bundle_count, 12000)
    drained(arrival_rate(arrivals(spark, str(tmp_path / "arrived"))).writeStream.outputMode("update").format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert sum(r.archives for r in spark.table("arrived").collect()) == 1


def test_suite(spark, tmp_path):
    from bundlefold.plans import suite

    r = workload.Recipe(spark, recipe(tmp_path))
    for dry in (True, False):
        path = str(tmp_path / f"report-{dry}.json")
        report.write_report(path, suite.run_suite(spark, r, str(tmp_path / f"out-{dry}"), dry))
        assert suite.complete(spark, path).count() == 0
    rows = {(x.baseline, x.phase): x for x in report.records(report.read_report(spark, path, "bundlefold")).collect()}
    assert rows["tar", "pack"].exit_status == rows["bundlefold", "unpack"].exit_status == 0
    stats = rows["bundlefold", "unpack"].bundlefold_stats
    w = stats.wall_breakdown
    assert stats.type == "unpack" and w.setup_ms.value + w.pipeline_ms.value + w.finalize_ms.value == stats.duration_ms
    assert sorted(x.name for x in (tmp_path / "out-False" / "own").iterdir()) == ["node_modules", "package.json"]
