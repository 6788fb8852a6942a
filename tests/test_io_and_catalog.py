"""Sources, sinks, streaming, and every query against its SQL."""

import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from kinfold.plans import catalog
from kinfold.sources import files, sinks
from kinfold.streaming import ingest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9) if isinstance(v, float) else None if v is None or v != v else v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLE_SQL:
        assert got.count() > 0
        return
    assert not got.isEmpty()  # an empty result tells nothing
    want = duck.sql(catalog.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    index = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in index) for r in want.fetchall())


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_index_and_strict_reports(spark, tmp_path):
    root = tmp_path / "songs"
    (root / "a").mkdir(parents=True)
    (root / "b").mkdir()
    (root / "a/one.BMS").write_bytes(b"x")
    (root / "b/two.bms").write_bytes(b"x")
    (root / "b/readme.txt").write_bytes(b"y")
    listed = files.tree(spark, str(root))
    items = files.items(listed, str(root), 1)
    assert items.count() == 2 and items.select("content_id").distinct().count() == 1 and {r.container.rsplit("/", 1)[1] for r in items.collect()} == {"a", "b"}
    assert files.stable(files.stats(listed), files.stats(listed)).where("not stable").count() == 0
    where = sinks.write_run(items, str(tmp_path / "index"), 1)
    assert files.table(spark, where, files.ITEMS.replace("mtime timestamp, md5", "mtime timestamp, md5")).count() == 2
    with pytest.raises(Exception, match="exists"):
        sinks.write_run(items, str(tmp_path / "index"), 1)
    with pytest.raises(ValueError):
        files.table(spark, where, "path string")


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("RELATED", "R_1", 2, 'a,"b"\nc'), ("RELATED", "R_1", 2, "d")], files.CLUSTERS)
    sinks.write_csv(df.coalesce(1), str(tmp_path / "c"), "folder_path")
    assert sorted(files.strict_csv(spark, str(tmp_path / "c"), files.CLUSTERS).collect()) == sorted(df.collect())
    (tmp_path / "bad.csv").write_bytes(b"kind,cluster_id,folder_count,folder_path\nRELATED,R,x,y\n")
    with pytest.raises(Exception):
        files.strict_csv(spark, str(tmp_path / "bad.csv"), files.CLUSTERS).collect()
    (tmp_path / "form.csv").write_bytes(b"\xef\xbb\xbfkind\r\nx")
    form = files.csv_form(files.tree(spark, str(tmp_path / "form.csv")), "kind")
    assert {r.code for r in form.collect()} == {"BOM", "CR", "NO_FINAL_LF", "WRONG_HEADER"}
    assert sinks.receipts(spark, str(tmp_path / "c")).where("path LIKE '%.csv' AND length(sha256) = 64").count() >= 1


def test_json(spark, tmp_path):
    sinks.publish_json({"a": 1, "b": "x"}, str(tmp_path / "s.json"))
    with pytest.raises(FileExistsError):
        sinks.publish_json({}, str(tmp_path / "s.json"))
    assert json.loads((tmp_path / "s.json").read_text()) == {"a": 1, "b": "x"} and os.listdir(tmp_path) == ["s.json"]
    for name, text in (("t", '{"a":1,"a":2,"b":"x"}'), ("u", '{"a":1,"b":"x","c":1}'), ("v", '{"a":1}'), ("w", "{")):
        (tmp_path / f"{name}.json").write_text(text)
    got = {r.path.rsplit("/", 1)[1][0]: r.code for r in files.json_report(files.tree(spark, str(tmp_path)), "a int, b string").collect()}
    assert got == {"s": None, "t": "DUPLICATE_KEY", "u": "UNKNOWN_FIELD", "v": "MISSING_FIELD", "w": "INVALID"}


def test_streamed_index_equals_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.repartition(4).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    q = ingest.run_index(ingest.events(spark, str(tmp_path / "in"), schema, max_files=1), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", "ts")
    q.awaitTermination(120)
    last = max(int(x[2:]) for x in os.listdir(tmp_path / "out"))
    assert last == 3
    want = e.groupBy("user_id").agg(F.min("ts"), F.max("ts"), F.count("*")).collect()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / f"out/v={last}")).collect())) == sorted(map(tuple, want))


def test_windows_of_stream(spark, tmp_path):
    spark.read.parquet(f"{SF}/events.parquet").write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    s = ingest.windowed(ingest.events(spark, str(tmp_path / "in"), schema), "ts", "1 day", "event_type")
    q = s.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM w").first().n == spark.read.parquet(f"{SF}/events.parquet").count()


def test_whole_events_and_lines(spark, duck):
    sets = {}
    for day, kind in duck.sql("SELECT user_id || '/' || strftime(ts, '%Y-%m-%d'), event_type FROM events").fetchall():
        sets.setdefault(day, set()).add(kind)
    alike = Counter(frozenset(x) for x in sets.values())
    got = {r.container: r["size"] for r in catalog.QUERIES["g3_exact_clusters"](spark, SF).collect()}
    assert got == {u: alike[frozenset(x)] for u, x in sets.items() if alike[frozenset(x)] > 1}


def test_whole_scans_sets_and_trees(spark, duck):
    run = lambda n: catalog.QUERIES[n](spark, SF).collect()
    files = duck.sql("SELECT user_id, event_type, count(*) FILTER (WHERE event_id % 200 > 4) FROM events GROUP BY 1, 2").fetchall()
    new = {f"/lib{u % 3}/{u}/{t}": n for u, t, n in files if n}
    assert {r.path: r["size"] for r in run("j2_index_merge") if r.last_seen == 2} == new
    sizes = dict(duck.sql("SELECT l_suppkey, count(*) FROM lineitem GROUP BY 1").fetchall())
    pairs = run("j1_supplier_pairs")
    assert pairs and all((r.physical_a, r.physical_b) == (sizes[r.a], sizes[r.b]) for r in pairs)
    trees = duck.sql("SELECT DISTINCT p_partkey % 4, 's/' || p_size FROM part").fetchall()
    assert {(r.root, r.path) for r in run("c6_ledger") if r.path.startswith("s/")} == set(trees)
    custs = {c for (c,) in duck.sql("SELECT DISTINCT o_custkey FROM orders").fetchall()}
    assert custs <= {r.container for r in run("g1_related_clusters")}


def test_outcomes_count_groups_and_parts(spark, duck):
    """All counts of the query: orders by flag and status, orders and parts in all."""
    got = catalog.QUERIES["a8_distinct_outcomes"](spark, SF).first().asDict()
    want = duck.sql("SELECT l_orderkey, l_returnflag, l_linestatus, l_partkey FROM lineitem").fetchall()
    of = lambda cond: len({x[0] for x in want if cond(x)})
    assert got == {"a": of(lambda x: x[1] == "A"), "r": of(lambda x: x[1] == "R"), "o": of(lambda x: x[2] == "O"), "groups": of(lambda x: True), "parts": len({x[3] for x in want})}
    assert got == dict(zip(got, duck.sql(catalog.ORACLE_SQL["a8_distinct_outcomes"]).fetchall()[0]))
