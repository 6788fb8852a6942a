"""Containment, reconciliation by sketch, Merkle manifests and classification against plain versions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import classify, compare, contain, index, merkle, observe, relations, sketch, validate


def items(spark, sets):
    rows = [(c, x, f"{c}/{x}/{k}") for c, xs in sets.items() for x in xs for k in range(1 + len(c) % 2)]
    return spark.createDataFrame(rows, "container string, content_id string, path string").repartition(3)


def inside(sets):
    known = {c: {x for x in xs if x is not None} for c, xs in sets.items()}
    return sorted((a, b) for a in known for b in known if known[a] and known[a] < known[b])


@pytest.mark.parametrize("seed,dealt", [(1, 10_000), (2, 2)])
def test_subset_edges(spark, monkeypatch, seed, dealt):
    monkeypatch.setattr(contain, "DEALT", dealt)
    r = random.Random(seed)
    sets = {}
    for k in range(160):
        base = set(r.choices([f"x{i}" for i in range(40)], k=r.randint(1, 9)))
        sets[f"c{k}"] = base
        if k % 3 == 0:  # one that lies in it, or is equal
            sets[f"d{k}"] = set(r.sample(sorted(base), r.randint(1, len(base))))
    sets |= {"all": {f"x{i}" for i in range(40)}, "same": set(sets["c7"]), "one": {"x1"}, "hot": {"x0"}, "nothing": {None}}
    assert sorted(map(tuple, contain.subset_edges(items(spark, sets)).collect())) == inside(sets)
    assert contain.subset_edges(items(spark, sets).where("false")).isEmpty()


def test_containment_makes_few_candidates(spark):
    """Sets that share a content with all others, and one that few have: only these few are compared."""
    sets = {f"s{k}": {"common", "often" if k % 2 else "also", f"own{k // 2}"} for k in range(400)} | {f"t{k}": {"common", f"own{k}"} for k in range(50)}
    s = contain.Sets(items(spark, sets))
    work = s.work().first()
    pairs = int(relations.pair_work(relations.members(items(spark, sets))).first().work)
    assert work.sets == 450 and work.candidates < pairs / 100 and s.candidates().count() <= work.candidates
    assert s.edges().count() == len(inside(sets)) == 100


def table(spark, n, change=()):
    rows = [(i, None if i % 17 == 3 else f"s{i % 50}", "" if i % 19 == 2 else f"v{i}") for i in range(n)] + [(5, "twice", "v")] * 3
    rows = [(i, s, f"{v}!" if i in change else v) for i, s, v in rows]
    return spark.createDataFrame(rows, "i long, s string, v string").repartition(5)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_sketch_finds_what_the_join_finds(spark):
    b = table(spark, 4000)
    assert sketch.difference(b, b.repartition(2)).rows == {}
    for change, size in (((7,), 256), (range(100, 140), 256), (range(0, 1500, 2), 4096)):
        a = table(spark, 4000, set(change)).where("i <> 3999").unionByName(table(spark, 4000).where("i = 5 OR i = 11"))
        found = sketch.difference(a, b)
        assert found.size == size and sum(map(abs, found.rows.values())) == validate.reconcile(a, b).count()
        assert rows(sketch.reconciled(a, b)) == rows(validate.reconcile(a, b))
    a = table(spark, 4000, set(range(900)))
    assert sketch.difference(a, b, (64,)).rows is None
    assert rows(sketch.reconciled(a, b, (64,))) == rows(validate.reconcile(a, b))  # joined whole
    assert sketch.reconciled(b.where("false"), b.where("false")).isEmpty()


def test_sketch_moves_as_much_as_differs(spark):
    """Cells are as many as the sketch's, and named rows as many as differ, whatever the tables."""
    for n in (1000, 20_000):
        a, b = table(spark, n, {3, 4, 5}), table(spark, n)
        cells = sketch.cells(a, b, a.columns, 256)
        assert cells.count() <= 3 * 2 * 4 * 4 and len(sketch.difference(a, b).rows) == 6 + 2


def test_sketch_decodes_when_well_filled():
    r = random.Random(1)
    for size, n in ((4096, 8000), (256, 500), (32, 70)):
        many = {(r.getrandbits(64) - (1 << 63), r.getrandbits(64) - (1 << 63)): r.choice([1, 1, -1, 3]) for _ in range(n)}
        sums = {}
        for (h, c), m in many.items():
            for p in sketch.places(h, size):
                sums[p] = tuple(a + m * b for a, b in zip(sums.get(p, (0, 0, 0, 0)), (1, h, c, sketch.check(h))))
        assert sketch.decoded({p: s for p, s in sums.items() if any(s)}, size) == many


def test_sketch_tells_colliding_rows():
    h, size = 12345, 64
    sums = {p: (0, 0, 77, 0) for p in sketch.places(h, size)}  # two rows of one hash, one on either side
    assert sketch.decoded(sums, size) is None and sketch.decoded({}, size) == {}


COLUMNS = ["i", "s", "v"]


def test_manifest_has_one_root(spark):
    a = table(spark, 3000)
    nodes = relations.checkpointed(merkle.tree(a, COLUMNS, ["s", "i"]))
    roots = {merkle.root(merkle.tree(x, COLUMNS, ["s", "i"])) for x in (a, a.repartition(1), a.repartition(9, "s"), a.orderBy(F.desc("v")))}
    assert roots == {merkle.root(nodes)} and len(roots) == 1
    assert nodes.where("level = 0").agg(F.sum("rows")).first()[0] == 3003 and nodes.where("level = 0").count() == 3001
    top = merkle.top(nodes)
    assert nodes.where("parent IS NULL").count() == 1 and top >= 2
    sizes = [r["count"] for r in nodes.where("level = 0").groupBy("parent").count().collect()]
    assert len(sizes) > 3
    for other in (table(spark, 3000, {77}), a.where("i <> 77"), a.unionByName(a.where("i = 9"))):
        assert merkle.root(merkle.tree(other, COLUMNS, ["s", "i"])) not in roots
    assert merkle.root(merkle.tree(a.where("false"), COLUMNS, ["i"])) is None
    one = merkle.tree(a.where("i = 1"), COLUMNS, ["i"])
    assert one.where("level = 0").count() == 1 and merkle.top(one) == 1


def test_manifest_digests_by_hand(spark):
    """Leaves and nodes made again from the canonical bytes of the rows."""
    a = spark.createDataFrame([(i, f"n{i}") for i in range(2000)], "i long, s string")
    t = lambda x: len(x.encode()).to_bytes(4, "big") + x.encode()
    level = [(hashlib.sha256(t("i") + t(str(i)) + t("s") + t(f"n{i}")).digest(), 1) for i in range(2000)]
    zeros = lambda d: 48 if (low := int.from_bytes(d[26:32], "big")) == 0 else (low & -low).bit_length() - 1
    height = [0 if zeros(d) < 8 else 1 + (zeros(d) - 8) // 4 for d, _ in level]
    for k in range(64):
        up, new, own = [], [], []
        for (d, n), h in zip(level, height):
            own.append((d, n))
            if h > k:
                up.append(own)
                new.append(h)
                own = []
        if own:
            up.append(own)
            new.append(height[-1])
        level = [(hashlib.sha256((k + 1).to_bytes(2, "big") + b"".join(d + n.to_bytes(8, "big") for d, n in c)).digest(), sum(n for _, n in c)) for c in up]
        height = new
        if len(level) == 1:
            break
    assert merkle.root(merkle.tree(a, ["i", "s"], ["i"])) == level[0][0].hex()


def test_leaves_cut_by_ranges_and_batches(spark):
    """Places, parents and leaves by a plain pass, however many tasks share a leaf; copies and null keys included."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(merkle.LAID))
    rows_ = [(hashlib.sha256(str(i).encode()).digest(), 1 + i % 3) for i in range(3000)]
    cuts = [0, 0, 7, 8, 900, 905, 2999, 3000]  # tasks without rows, and some that no leaf ends in
    laid = []
    for part, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in own], pa.binary()), pa.array([n for _, n in own], pa.int64())], names=["digest", "rows"]) for own in (rows_[k : min(k + 64, hi)] for k in range(lo, hi, 64))]
        laid += [r | {"part": part} for b in merkle.laid_out(batches, part, arrow) for r in b.to_pylist()]
    assert [(r["digest"], r["rows"]) for r in laid if r["height"] is None] == rows_
    starts, leaves, stops = {}, {}, 0
    for part in range(len(cuts) - 1):
        starts[part] = stops
        stops += sum(r["height"] > 0 for r in laid if r["part"] == part and r["height"] is not None)
    got = {}
    for r in laid:
        if r["height"] is not None:
            own = got.setdefault(starts[r["part"]] + r["leaf"], [b"", 0, 0])
            own[0], own[1], own[2] = (r["made"] or own[0] + r["children"]), own[1] + r["rows"], r["height"]
            assert (r["made"] is None) == (r["leaf"] == 0 or r["height"] == 0)
    low = lambda d: int.from_bytes(d[26:], "big")
    own, n = b"", 0
    for k, (d, m) in enumerate(rows_):
        own, n = own + d + m.to_bytes(8, "big"), n + m
        if low(d) % 256 == 0 or k == 2999:
            leaves[len(leaves)] = [hashlib.sha256(b"\0\1" + own).digest(), n]
            own, n = b"", 0
    assert {k: [v[0] if len(v[0]) == 32 else hashlib.sha256(b"\0\1" + v[0]).digest(), v[1]] for k, v in got.items()} == leaves


def test_manifest_rows_are_stored_and_met_once(spark):
    """Rows are stored once, as Parquet, and those of both sides meet in one exchange by digest."""
    a = table(spark, 400)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "parquet" in plan(merkle.tree(a, COLUMNS, ["s", "i"]).where("level = 0"))
    x, y = merkle.tree(a, COLUMNS, ["i"]), merkle.tree(a.where("i <> 9"), COLUMNS, ["i"])
    found = plan(merkle.differing(x, y))
    assert found.count("Exchange hashpartitioning(digest") == 1 and "SortMergeJoin" not in found


def test_levels_below_many_differing_nodes_are_taken_whole(spark, monkeypatch):
    a, b = table(spark, 3000), table(spark, 3000, {5, 6, 2000}).where("i <> 77")
    x, y = merkle.tree(a, COLUMNS, ["i"]), merkle.tree(b, COLUMNS, ["i"])
    few = rows(merkle.differing(x, y))
    monkeypatch.setattr(merkle, "BROADCAST", 0)
    assert rows(merkle.differing(x, y)) == few and len(few) == 9  # of 5 there are two a side


def test_proofs_of_rows(spark):
    a = table(spark, 1500)
    nodes = relations.checkpointed(merkle.tree(a, COLUMNS, ["i"]))
    root = merkle.root(nodes)
    p = relations.checkpointed(merkle.proofs(nodes, nodes.where("level = 0 AND place % 7 = 0").unionByName(nodes.where("level = 1"))))
    assert p.count() == -(-1501 // 7)  # a node is no row
    holds = lambda path, digest, r: p.select(merkle.proven(path, digest, r).alias("x")).agg(F.min("x"), F.max("x")).first()
    assert tuple(holds(F.col("path"), F.col("digest"), root)) == (True, True)
    assert tuple(holds(F.col("path"), F.col("digest"), "0" * 64)) == (False, False)
    assert tuple(holds(F.col("path"), F.unhex(F.sha2("digest", 256)), root)) == (False, False)
    assert tuple(holds(F.slice("path", 1, F.size("path") - 1), F.col("digest"), root)) == (False, False)
    turned = F.transform("path", lambda s: s.withField("children", F.reverse(s["children"])))
    assert p.where(merkle.proven(turned, F.col("digest"), root)).count() < p.count() / 10


def test_differing_rows_are_found_from_the_root(spark):
    a, b = table(spark, 5000), table(spark, 5000, {7, 4100}).where("i <> 2500").unionByName(table(spark, 5000).where("i = 30"))
    x, y = (relations.checkpointed(merkle.tree(t, COLUMNS, ["i"])) for t in (a, b))
    want = lambda t, nodes, keep: sorted((bytes(r.digest), r.rows) for r in merkle.different_rows(t, COLUMNS, ["i"]).where(keep).collect())
    got = {s: sorted((bytes(r.digest), r.rows) for r in merkle.differing(x, y).where(F.col("side") == s).collect()) for s in "AB"}
    assert got == {"A": want(a, x, "key.k0 IN (7, 4100, 2500, 30)"), "B": want(b, y, "key.k0 IN (7, 4100, 30)")}
    assert merkle.differing(x, x).isEmpty() and merkle.differing(x, x.where("false")).count() == 5001


def test_manifest_of_groups(spark):
    a = table(spark, 300)
    groups = [("rows", a, COLUMNS, ["i"]), ("none", a.where("false"), ["i"], ["i"])]
    told, seal = merkle.manifest("d", groups)
    assert [(g["name"], g["rows"]) for g in told] == [("rows", 303), ("none", 0)] and told[1]["root"] is None
    assert merkle.manifest("d", [(n, t.repartition(4), f, o) for n, t, f, o in groups])[1] == seal
    assert merkle.manifest("e", groups)[1] != seal != merkle.manifest("d", groups[:1])[1]


# classification

A, B = "REGULAR_FILE", "DIRECTORY"


def component(spark, trees, where=None):
    where = where or {r: f"lib/{r}" for r in trees}
    e = [(r, p, k, d, i, f"{r}:{p}") for r, t in trees.items() for p, (k, d, i) in t.items()]
    return spark.createDataFrame(list(where.items()), "root string, path string"), spark.createDataFrame(e, "root string, path string, kind string, digest string, is_item boolean, native_id string")


TREES = {
    "a": {".": (B, None, False), "x.bms": (A, "1", True), "k.wav": (A, "2", False)},
    "b": {".": (B, None, False), "x.bms": (A, "1", True), "k.wav": (A, "2", False)},
    "c": {".": (B, None, False), "x.bms": (A, "1", True), "k.wav": (A, "3", False), "s": (B, None, False)},
    "d": {".": (B, None, False), "y.bms": (A, "1", True), "l.wav": (A, "2", False)},
    "e": {".": (B, None, False), "x.bms": (B, None, False), "z.wav": (A, "9", False)},
}


def test_every_pair_is_labelled(spark):
    c = classify.classified(*component(spark, TREES, {"a": "lib/a", "b": "lib/a/in", "c": "lib/c", "d": "lib/d", "e": "lib/e"}))
    got = {(r.a, r.b): r for r in c.pairs.collect()}
    assert len(got) == 10 and {r.state for r in got.values()} == {classify.PROVEN} and c.state() == "COMPLETE"
    assert got["a", "b"].labels == ["OBSERVATION_TREE_EXACT", "NESTED_OBSERVATION_ROOTS"]
    assert got["a", "c"].labels == ["CHART_EXACT_WITH_NONCHART_DIFFERENCES", "HARD_PATH_CONTENT_CONFLICT"]
    assert got["a", "d"].labels == ["CONTENT_MULTISET_EXACT_WITH_PATH_VARIANTS", "CHART_EXACT_WITH_NONCHART_DIFFERENCES", "OBSERVED_COMPLEMENTARY_CONTENT"]
    assert got["a", "e"].labels == ["HARD_PATH_KIND_CONFLICT"] and got["a", "e"].item_state == "CHART_SET_DISJOINT"
    for r in got.values():  # as one pair by itself
        x, y = (component(spark, {s: TREES[s]})[1].drop("root") for s in (r.a, r.b))
        assert compare.pair_labels(x, y, nested=(r.a, r.b) == ("a", "b")).first().labels == r.labels
        assert compare.difference_counts(compare.tree_diff(x, y)).first().asDict() == {k: r[k] for k in compare.COUNTS}
        assert compare.item_set_state(x, y).first().asDict() == {"state": r.item_state, "common": r.common, "only_a": r.only_a, "only_b": r.only_b}
    assert {(r.root, r.structure) for r in c.roots.collect()} == {("a", "CONTAINER_DIRECTORY_CANDIDATE"), *((x, "OBSERVATION_ROOT_ONLY") for x in "bcde")}
    assert c.differences.count() == sum(len(TREES[a].keys() | TREES[b].keys()) for a, b in got)
    assert rows(c.conflicts.select("a", "b", "path"))[:2] == [("a", "c", "k.wav"), ("a", "e", "x.bms")]


def test_variants_of_bound_resources(spark):
    where, entries = component(spark, {k: TREES[k] for k in "abc"})
    bindings = spark.createDataFrame([("a", "u1", "k:2"), ("b", "u1", "k:2"), ("c", "u1", "k:3")], "root string, key string, target string")
    got = {(r.a, r.b): r.labels for r in classify.classified(where, entries, bindings=bindings).pairs.collect()}
    told = "CHART_EXACT_POTENTIAL_REFERENCED_RESOURCE_VARIANT"
    assert told in got["a", "c"] and told in got["b", "c"] and told not in got["a", "b"]


def test_limits_leave_rows(spark):
    where, entries = component(spark, TREES)
    said = lambda c: {(r.code, r.key) for r in c.diagnostics.collect()}
    c = classify.classified(where, entries, classify.Limits(roots=3))
    assert said(c) == {(classify.ROOT_LIMIT, "2"), (classify.PAIRS_OPEN, "7")} and c.pairs.count() == 3
    assert {r.root for r in c.roots.where(F.col("state") == classify.ROOT_LIMIT).collect()} == {"d", "e"}
    c = classify.classified(where, entries, classify.Limits(entries=9))  # a and b take six, c's four don't fit, d's three do
    assert {r.root: r.state for r in c.roots.collect()} == {"a": classify.PROVEN, "b": classify.PROVEN, "c": classify.BLOCKED, "d": classify.PROVEN, "e": classify.BLOCKED}
    states = {(r.a, r.b): r.state for r in c.pairs.collect()}
    assert states["a", "b"] == classify.PROVEN and states["a", "d"] == classify.PAIR_ENTRIES and states["a", "c"] == classify.BLOCKED and c.state() == "INCOMPLETE"
    c = classify.classified(where, entries, classify.Limits(pairs=2))
    assert sorted(r.state for r in c.pairs.collect()) == [classify.PAIR_LIMIT] * 8 + [classify.PROVEN] * 2
    c = classify.classified(where, entries, classify.Limits(conflicts=2))
    whole = classify.classified(where, entries)
    assert c.conflicts.count() == 2 < whole.conflicts.count() and (classify.CONFLICT_LIMIT, str(whole.conflicts.count() - 2)) in said(c)
    short = c.pairs.where("conflict_coverage = 'INCOMPLETE'").collect()
    assert short and all("CONFLICT_ENUMERATION_INCOMPLETE" in r.labels for r in short)
    with pytest.raises(ValueError):
        classify.Limits(roots=33)


def test_discovery(spark):
    where, entries = component(spark, {k: TREES[k] for k in "abc"})
    candidates = spark.createDataFrame([("lib/a", "lib/b"), ("lib/a", "lib/q"), ("lib/q", "lib/r"), ("lib/b", "lib/z")], "a string, b string")
    c = classify.classified(where, entries, classify.Limits(discovery_pairs=2), candidates=candidates)
    assert rows(c.discovery) == [("lib/a", "lib/q", classify.CANDIDATE), ("lib/b", "lib/z", classify.CANDIDATE), ("lib/q", "lib/r", classify.DISCOVERY_LIMIT)]
    assert (classify.DISCOVERY_LIMIT, "1") in {(r.code, r.key) for r in c.diagnostics.collect()}


def test_sequences_in_order(spark):
    a = spark.createDataFrame([(k, f"x{k % 7}") for k in range(300)], "at int, v string").repartition(4)
    assert compare.sequence_differences(a, a.repartition(2), ["at"]).isEmpty()
    b = a.withColumn("v", F.when(F.col("at") == 70, "other").otherwise(F.col("v"))).where("at <> 299")
    assert {(r.place, r.a and r.a.v, r.b and r.b.v) for r in compare.sequence_differences(a, b, ["at"]).collect()} == {(71, "x0", "other"), (300, "x5", None)}
    turned = a.withColumn("at", F.when(F.col("at") == 1, 2).when(F.col("at") == 2, 1).otherwise(F.col("at")))
    assert {r.place for r in compare.sequence_differences(a, turned, ["at"]).collect()} == {2, 3}  # the same rows in another order


def test_blocked_rows_stay_unverified(spark):
    old = spark.createDataFrame([(p, "r", 1, 1, "d", "OK", 1, 1, True) for p in ("r/a/x", "r/a/b/y", "r/c/z", "r/ab/w", "r/k")], "path string, root string, size long, mtime long, content_id string, status string, first_seen int, last_seen int, present boolean")
    seen = old.where("path = 'r/k'").select("path", "root", "size", "mtime", "content_id")
    got = {r.path: r.outcome for r in index.merge(old, seen, 2, blocked=spark.createDataFrame([("r/a",), ("r/a/b",), ("r/k",)], "blocked string")).collect()}
    assert got == {"r/a/x": "UNVERIFIED", "r/a/b/y": "UNVERIFIED", "r/c/z": "MISSING", "r/ab/w": "MISSING", "r/k": "REUSED"}


def test_bounds_of_an_observation_only_fall():
    assert observe.Budget(entries=5).entries == 5
    for bad in (0, -1, 1 << 40):
        with pytest.raises(ValueError):
            observe.Budget(entries=bad)
