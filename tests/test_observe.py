"""Guarded reads, staging, stores, and observation of two trees in stages."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from kinfold.operators import extract, observe, reports
from kinfold.sources import files, guarded, sinks, staging


@pytest.fixture
def trees(tmp_path):
    for p, text in {"A/one.bms": "x", "A/sub/k.wav": "s", "B/one.bms": "x", "B/sub/k.wav": "s", "B/three.bms": "z"}.items():
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return tmp_path


def test_walk(spark, trees):
    os.symlink(trees / "A/one.bms", trees / "A/link")
    (trees / "gone").mkdir()
    rows = {os.path.relpath(r.path, trees): r for r in guarded.walk(spark, [str(trees), str(trees / "A")]).collect()}
    assert len(rows) == 12 and rows["A/link"].kind == "REPARSE" and rows["A/sub"].kind == "DIRECTORY" and rows["A/one.bms"].size == 1
    assert {r.status for r in rows.values()} == {"OK"}
    assert [r.status for r in guarded.walk(spark, [str(trees / "no")]).collect()] == ["METADATA_ERROR"]
    assert [r["status"] for r in guarded.children(str(trees / "A/one.bms"))] == ["ENUMERATION_ERROR"]
    with pytest.raises(ValueError):
        guarded.walk(spark, [str(trees)], 1)


def test_reads(spark, trees, monkeypatch):
    os.symlink(trees / "A/one.bms", trees / "link")
    paths = spark.createDataFrame([(str(trees / p),) for p in ("A/one.bms", "no.bms", "link", "A/one.bms/x")], "path string")
    assert [r.status for r in guarded.read_charts(paths).collect()] == ["SUCCESS", "MISSING", "REPARSE", "MISSING"]
    accepted = guarded.walk(spark, [str(trees / "B")]).where("kind = 'REGULAR_FILE'")
    assert {r.status for r in guarded.refuse_stale(guarded.read_content(accepted)).collect()} == {"SUCCESS"}
    (trees / "B/one.bms").write_text("other")
    (trees / "B/three.bms").unlink()
    assert sorted(r.status for r in guarded.read_content(accepted).collect()) == ["STALE", "STALE", "SUCCESS"]
    with pytest.raises(guarded.StaleSource):
        guarded.refuse_stale(guarded.read_content(accepted))
    states = iter(range(99))
    monkeypatch.setattr(guarded, "facts", lambda p: {"kind": "REGULAR_FILE", "size": 5, "mtime_ns": next(states)})
    r = guarded.guarded_read(str(trees / "B/one.bms"))
    assert (r["status"], r["attempts"], r["bytes"], r["sha256"]) == ("UNSTABLE", 2, 10, None)


def test_database_header(spark):
    good = guarded.DATABASE_MAGIC + b"\x10\x00\x01\x01" + bytes(80)
    rows = [(good,), (good[:99],), (b"x" * 100,), (good[:18] + b"\x02\x02" + good[20:],), (None,)]
    got = spark.createDataFrame(rows, "head binary").select(guarded.database_header(F.col("head")).alias("s")).collect()
    assert [r.s for r in got] == ["OK", "SHORT", "MAGIC", "JOURNAL", "SHORT"]


def test_store(spark, tmp_path):
    store = str(tmp_path / "store")
    sinks.claim_store(spark, store)
    sinks.claim_store(spark, store)
    (tmp_path / "other").mkdir()
    (tmp_path / "other/x").write_text("")
    with pytest.raises(sinks.ForeignStore):
        sinks.claim_store(spark, str(tmp_path / "other"))
    for text in ('{"owner": "kinfold", "version": 2}', "{"):
        (tmp_path / "other/_meta.json").write_text(text)
        with pytest.raises(sinks.ForeignStore):
            sinks.claim_store(spark, str(tmp_path / "other"))


def test_staging(spark, trees):
    held = staging.lease(spark, spark.createDataFrame([(str(trees / p),) for p in ("A/one.bms", "A/sub/k.wav")], "path string"))
    assert staging.changed(held, rehash=True).isEmpty() and staging.aliases(held).isEmpty()
    targets = held.select(F.regexp_extract("path", "/A/(.*)$", 1).alias("path"), "kind", F.col("path").alias("source"), "size", "sha256")
    targets = targets.unionByName(spark.createDataFrame([("sub", "DIRECTORY"), ("empty", "DIRECTORY"), (".", "DIRECTORY")], "path string, kind string"), allowMissingColumns=True)
    out = str(trees / "out")
    copies = staging.build(spark, targets, out).collect()
    assert sorted((r.path, r.state, r.bytes) for r in copies) == [("one.bms", "COPIED", 1), ("sub/k.wav", "COPIED", 1)]
    assert staging.inspected(spark, targets, out, held).isEmpty() and sorted(os.listdir(out)) == ["empty", "one.bms", "sub"]
    with pytest.raises(FileExistsError):
        staging.build(spark, targets, out)
    sha = held.where("path LIKE '%one.bms'").first().sha256
    assert staging.copy_file(str(trees / "A/one.bms"), out + "/one.bms", sha) == (1, "COPIED")  # a task that runs again
    assert staging.copy_file(str(trees / "A/sub/k.wav"), out + "/n", sha)[1] == "DIGEST_MISMATCH" and not os.path.exists(out + "/n")
    (trees / "out/one.bms").write_text("y")
    (trees / "out/extra").write_text("y")
    (trees / "out/sub/k.wav").unlink()
    os.link(trees / "A/sub/k.wav", trees / "out/sub/k.wav")
    os.rmdir(trees / "out/empty")
    assert {(r.path, r.code) for r in staging.inspected(spark, targets, out, held).collect()} == {("one.bms", "DIGEST"), ("extra", "UNEXPECTED"), ("sub/k.wav", "ALIAS"), ("empty", "MISSING")}
    (trees / "A/one.bms").write_text("long")
    assert [os.path.basename(r.path) for r in staging.changed(held).collect()] == ["one.bms"]
    none = spark.createDataFrame([], "path string")
    with pytest.raises(staging.NotAdmitted):
        staging.admitted(targets, targets, targets, none)
    staging.admitted(targets, targets, none, none)


def test_observation(spark, trees):
    o = observe.Observation(spark, str(trees / "evidence"))
    source = o.capture(str(trees / "A"), str(trees / "B"))
    with pytest.raises(Exception, match="exists"):
        o.capture(str(trees / "A"), str(trees / "B"))
    with pytest.raises(observe.Inadmissible):
        o.preflight("0" * 64)
    pre = o.preflight(source)
    with pytest.raises(observe.Inadmissible):
        o.verify("CONTENT", pre)
    content = o.content(pre)
    assert o.compared(content)["labels"].first().labels == ["OBSERVED_TREE_SUBSET_A_IN_B"]
    assert o.verify("PREFLIGHT", pre)["pair_state"] == "BLOCKED"
    assert o.export("CONTENT", content, str(trees / "r.json"))["pair_state"] == "COMPLETE" and (trees / "r.json").exists()
    told = o.reports("CONTENT", content, str(trees / "set"))
    assert observe.export_state(str(trees / "set")) == "COMPLETED" and observe.export_state(str(trees / "nowhere")) == "NONE"
    assert set(told["files"]) == {"roots.csv", "inventory.csv", "extensions.csv", "folder_comparisons.csv", "content_groups.csv", "comparison_counts.csv", "conflicts.csv"}
    for name, r in told["files"].items():
        raw = (trees / "set" / name).read_bytes()
        assert (len(raw), hashlib.sha256(raw).hexdigest()) == (r["bytes"], r["sha256"]) and raw.endswith(b"\n")
    assert (trees / "set/inventory.csv").read_text().count("\n") == o.table("inventory").count() + 1
    with pytest.raises(FileExistsError):
        o.reports("CONTENT", content, str(trees / "set"))
    (trees / "broken").mkdir()
    (trees / "broken/_export-RUNNING.json").write_text("{}")
    assert observe.export_state(str(trees / "broken")) == "FAILED"
    with pytest.raises(observe.Inadmissible):
        o.reports("CONTENT", pre, str(trees / "other"))
    from kinfold.operators import validate

    assert validate.chained(o.records("CONTENT")).isEmpty()
    changed = o.table("content").withColumn("digest", F.lit("0")).collect()
    spark.createDataFrame(changed, o.table("content").schema).write.mode("overwrite").parquet(str(trees / "evidence/tables/content"))
    with pytest.raises(observe.Inadmissible):
        o.verify("CONTENT", content)


def test_observation_stops(spark, trees):
    o = observe.Observation(spark, str(trees / "e1"), observe.Budget(files=4))
    with pytest.raises(observe.Stopped, match="PAYLOAD_SCOPE"):
        o.preflight(o.capture(str(trees / "A"), str(trees / "B")))
    o = observe.Observation(spark, str(trees / "e2"), observe.Budget(files=None, depth=2))
    pre = o.preflight(o.capture(str(trees / "A"), str(trees / "B")))
    (trees / "A/one.bms").write_text("other")
    with pytest.raises(observe.Stopped, match="SOURCE_CHANGED"):
        o.content(pre)
    o = observe.Observation(spark, str(trees / "e3"), observe.Budget(depth=1))
    with pytest.raises(observe.Stopped, match="INVENTORY_BUDGET"):
        observe.Observation(spark, str(trees / "e3")).preflight(o.capture(str(trees / "A"), str(trees / "B")))
    for bad in ({"files": 5000}, {"depth": 0}, {"payload_bytes": None}):
        with pytest.raises(ValueError):
            observe.Budget(**bad)
    with pytest.raises(ValueError):
        observe.Observation(spark, str(trees / "A/e")).capture(str(trees / "A"), str(trees / "B"))


def test_report_is_read_anew(spark, tmp_path):
    (tmp_path / "x.bms").write_text("#WAV01 a.wav\n#00111:01\n")
    f = files.tree(spark, str(tmp_path))
    report = extract.extracted(f)
    assert extract.readmitted(report, f).isEmpty()
    assert {r.side for r in extract.readmitted(report.withColumn("coverage", F.lit("INCOMPLETE")), f).collect()} == {"REPORT", "DERIVED"}


def test_scope_rules(spark):
    f = lambda rows, schema: spark.createDataFrame(rows, schema)
    comps = f([("c", "ADMITTED"), ("d", "ADMITTED"), ("e", "REJECTED")], "component string, outcome string")
    need = f([("c", 1, 10, 1), ("c", 2, 20, 1), ("d", 2, 20, 1), ("e", 9, 1, 1)], "component string, file int, size int, mtime int")
    good = [(1, "SUCCESS", 10, 1), (2, "SUCCESS", 20, 1)]
    results = lambda rows: f(rows, "file int, status string, before_size int, before_mtime int")
    told = [("c", "COMPLETE", 2, 2, True), ("d", "COMPLETE", 1, 1, True)]
    outcomes = lambda rows: f(rows, "component string, outcome string, required long, successful long, eligible boolean")
    none = f([], "component string, file int")
    broken = lambda r, o, x=none: sorted((y.code, y.key) for y in reports.scope_violations(comps, need, results(r), outcomes(o), x).collect())
    assert broken(good, told) == []
    assert broken([*good, (9, "SUCCESS", 1, 1)], told) == [("CONTENT_SCOPE", "9")]
    assert broken([(1, "SUCCESS", 11, 1), good[1]], told) == [("CONTENT_STAMP", "1")]
    assert broken(good, told[:1]) == [("OUTCOME_MISSING", "d")]
    assert broken(good, [*told, ("e", "COMPLETE", 1, 1, False)]) == [("OUTCOME_SCOPE", "e")]
    assert broken([(1, "ERROR", 10, 1), good[1]], told) == [("OUTCOME_COUNT", "c")]
    assert broken([(1, "ERROR", 10, 1), good[1]], [("c", "INCOMPLETE", 2, 1, True), told[1]]) == [("COMPARISON_ELIGIBILITY", "c")]
    assert broken(good, told, f([("q", None), (None, 9), ("c", 1)], "component string, file int")) == [("DIAGNOSTIC_SCOPE", "9"), ("DIAGNOSTIC_SCOPE", "q")]


def test_emitted_diagnostics(spark):
    f = lambda rows: spark.createDataFrame(rows, "severity string, code string, path string")
    got = reports.emitted({"G2": f([("ERROR", "X", "a/b/c")]), "G3": f([("WARNING", "Y", "q")])}, spark.createDataFrame([("a",), ("a/b",), ("a/b/c",)], "path string"))
    assert sorted(map(tuple, got.collect())) == [("G2", "ERROR", "X", "a/b/c", "a/b"), ("G3", "WARNING", "Y", "q", None)]
