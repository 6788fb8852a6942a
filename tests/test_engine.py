"""The engine over a small library of folders."""

import json
import os

import pytest

from kinfold import engine
from kinfold.operators import extract, resolve


@pytest.fixture
def library(tmp_path):
    for p, text in {"A/one.bms": "x", "A/k.wav": "s", "B/one.bms": "x", "B/k.wav": "t", "C/two.BMS": "#WAV01 k.ogg\n#00111:01\n", "C/k.wav": "s"}.items():
        f = tmp_path / "songs" / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(text)
    return tmp_path


def test_scan_report_verify(spark, library):
    e = engine.Engine(spark, str(library / "store"))
    root = str(library / "songs")
    s = e.scan([root]).first()
    assert (s.discovered, s.new, s.hashed, s.reused) == (3, 3, 3, 0)
    (library / "songs/A/one.bms").write_text("longer")
    (library / "songs/B/one.bms").unlink()
    s = e.scan([root]).first()
    assert (s.changed, s.hashed, s.reused, s.missing) == (1, 1, 1, 1) and e.runs() == [1, 2]
    assert e.scan([root]).first().missing == 0  # what is gone already isn't missing anew
    assert e.report(str(library / "r1"), 1) == {"duplicates": 2, "pairs": 1, "related": 1, "exact": 1}
    assert e.report(str(library / "r2")) == {"duplicates": 0, "pairs": 0, "related": 0, "exact": 0}
    rows = (library / "r1/duplicate_charts.csv").read_text().splitlines()
    assert rows[0] == "sha256,md5,group_paths,root_id,absolute_path,parent_folder,filename,extension,size,mtime_utc" and [r.split(",")[4] for r in rows[1:]] == [f"{root}/{x}/one.bms" for x in "AB"]
    assert rows[1].split(",")[1:4] == ["9dd4e461268c8034f5c8564e155c67a6", "2", "1"] and rows[1].endswith("Z")
    assert (library / "r1/clusters.csv").read_text() == f"kind,cluster_id,folder_count,folder_path\nEXACT_ONLY,EXACT_ONLY_000001,2,{root}/A\nEXACT_ONLY,EXACT_ONLY_000001,2,{root}/B\nRELATED,RELATED_000001,2,{root}/A\nRELATED,RELATED_000001,2,{root}/B\n"
    assert (library / "r1/folder_candidates.csv").read_text().splitlines()[1].startswith(f"{root}/A,{root}/B,1,1,1,1,1,")
    summary = json.loads((library / "r1/summary.json").read_text())
    assert (summary["scan_id"], summary["current_chart_files"], summary["cluster_size_distribution"], summary["hash_cache_statistics"]["new"]) == (1, 3, {"2": 1}, 3)
    assert e.verify().count() == 0 and [s["status"] for s in e.scans()] == ["COMPLETED"] * 3
    with pytest.raises(ValueError):
        e.scan([root, root + "/A"])
    with pytest.raises(ValueError):
        engine.Engine(spark, root + "/store").scan([root])
    with pytest.raises(ValueError):
        e.report(str(library / "r1"))
    with engine.single_writer(str(library / "store")), pytest.raises(engine.Busy):
        e.scan([root])


def test_second_scan_opens_no_file(spark, library, monkeypatch):
    e, root = engine.Engine(spark, str(library / "store")), library / "songs"
    e.scan([str(root)])
    for f in root.rglob("*.[bB][mM][sS]"):  # the same size and time, other bytes: only a reader would notice
        stamp = f.stat()
        f.write_bytes(bytes(b ^ 1 for b in f.read_bytes()))
        os.utime(f, ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    before = {r.path: r.content_id for r in e.index().collect()}
    s = e.scan([str(root)]).first()
    assert (s.reused, s.hashed) == (3, 0) and {r.path: r.content_id for r in e.index().collect()} == before
    assert e.scan([str(root)], rehash=True).first().hashed == 3 and all(r.content_id != before[r.path] for r in e.index().collect())


def test_scan_diagnostics(spark, library):
    e, root = engine.Engine(spark, str(library / "store")), library / "songs"
    (root / "D").mkdir()
    (root / "D/three.bms").write_text("y")
    e.scan([str(root)])
    (root / "A/link.bms").symlink_to(root / "B/one.bms")  # a link is named, not followed
    (root / "D/three.bms").unlink()
    (root / "D").rmdir()
    (root / "D").symlink_to(root / "B")
    s = e.scan([str(root)]).first()
    assert (s.discovered, s.errored, s.missing) == (4, 1, 0)
    state = {os.path.relpath(r.path, root): (r.status, r.present) for r in e.index().collect()}
    assert state["D/three.bms"] == ("UNVERIFIED", False) and state["A/link.bms"] == ("ERROR", True) and state["A/one.bms"] == ("OK", True)
    said = {(r.severity, r.code, os.path.relpath(r.path, root)) for r in e.diagnostics().collect()}
    assert said == {("WARNING", "REPARSE_SKIPPED", "A/link.bms"), ("WARNING", "REPARSE_SKIPPED", "D"), ("ERROR", "CHART_READ", "A/link.bms")}
    assert e.report(str(library / "r")) == {"duplicates": 2, "pairs": 0, "related": 0, "exact": 0}  # folder A was not read whole
    assert json.loads((library / "r/summary.json").read_text())["incomplete_folders"] == 1


def test_interrupted_scan(spark, library, monkeypatch):
    e, root = engine.Engine(spark, str(library / "store")), str(library / "songs")
    monkeypatch.setattr(engine.index, "merge", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        e.scan([root])
    monkeypatch.undo()
    assert [s["status"] for s in e.scans()] == ["FAILED"] and e.runs() == []
    e.scan([root])
    assert [(s["run"], s["status"]) for s in e.scans()] == [(1, "FAILED"), (2, "COMPLETED")] and e.runs() == [2]


def test_large_charts_keep_their_row(spark, tmp_path):
    (tmp_path / "big.bms").write_bytes(b"#TITLE t\n" + b"*" * (8 << 20))
    (r,) = engine.Engine(spark, str(tmp_path / "s")).extract(str(tmp_path)).collect()
    assert [d.code for d in r.diagnostics] == ["SIZE_LIMIT"] and r.sha256 is None


def test_compare_extract_plan(spark, library):
    e = engine.Engine(spark, str(library / "store"))
    a, b, c = (str(library / "songs" / x) for x in "ABC")
    got = e.compare(a, b)
    assert got["flags"].first().path_conflict and "HARD_PATH_CONTENT_CONFLICT" in got["labels"].first().labels and got["items"].first().state == "CHART_SET_EXACT"
    charts = e.extract(c)
    found = e.resolve(charts, spark.createDataFrame([(charts.first().path.rsplit("/", 1)[0] + "/k.wav",)], "path string"))
    r = found["proof"].first()
    assert (r.proof, r.logical, r.physical) == ("NOT_PROVEN", "COMPLETE_WITHIN_ADMITTED_MODEL", "ALTERNATE_EXTENSION_PROPOSALS_ONLY_OR_MIXED") and found["usages"].count() == 1
    p = e.plan([a, b, c])
    assert {r.mask for r in p["maximal"].collect()} == {0b101, 0b010} and p["violations"].count() == 0 and p["variants"].count() == 3  # one root beside a union of two, two beside the other
    with pytest.raises(ValueError):
        e.plan([a])


def test_trees_are_read_guarded(spark, library):
    e, root = engine.Engine(spark, str(library / "store")), library / "songs"
    (root / "A/empty").mkdir()
    got = {r.path: r for r in e.tree(str(root / "A")).collect()}
    assert got["."].kind == got["empty"].kind == "DIRECTORY" and all((r.digest is None) == (r.kind == "DIRECTORY") for r in got.values())
    (root / "A/link.bms").symlink_to(root / "B/one.bms")
    with pytest.raises(engine.Unreadable, match="1 entries"):
        e.tree(str(root / "A"))
    assert engine.main(["--store", str(library / "store"), "compare", "--root", str(root / "A"), "--root", str(root / "B")]) == engine.FAILED


def test_classify_command(spark, tmp_path):
    for name, sound in (("a", b"x"), ("b", b"x"), ("c", b"y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "k.wav").write_bytes(sound)
        (tmp_path / name / "one.bms").write_bytes(b"#WAV01 k.wav\n#00111:01\n")
    e, roots = engine.Engine(spark, str(tmp_path / "s")), [str(tmp_path / x) for x in "abc"]
    c = e.classify(roots)
    got = {(os.path.basename(r.a), os.path.basename(r.b)): r.labels for r in c.pairs.collect()}
    assert got["a", "b"] == ["OBSERVATION_TREE_EXACT"] and got["a", "c"] == got["b", "c"] == ["CHART_EXACT_WITH_NONCHART_DIFFERENCES", "CHART_EXACT_POTENTIAL_REFERENCED_RESOURCE_VARIANT", "HARD_PATH_CONTENT_CONFLICT"]
    args = ["--store", str(tmp_path / "s"), "classify", *[x for r in roots for x in ("--root", r)], "--output", str(tmp_path / "out")]
    assert engine.main(args) == engine.DONE and spark.read.parquet(str(tmp_path / "out/pairs")).count() == 3


def test_same_stem(spark):
    refs = spark.createDataFrame([(1, "d", "k.ogg"), (2, "", "../x")], "ref int, base string, authored string")
    got = resolve.same_stem(refs, spark.createDataFrame([("d/K.wav",), ("d/k.png",), ("k.wav",)], "path string"))
    assert {(r.ref, r.found, r.recommended) for r in got.collect()} == {(1, "d/K.wav", True), (1, "d/k.png", False)}
