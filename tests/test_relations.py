"""Truth tables of relations, index, comparison, planning and validation."""

import itertools

import pytest
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.functions import python as P
from kinfold.operators import compare, index, plan, relations, validate


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "a,b,common,label",
    [(2, 2, 2, "EXACT_CHART_SET"), (1, 2, 1, "A_SUBSET_OF_B"), (2, 1, 1, "B_SUBSET_OF_A"), (5, 5, 4, "HIGH_OVERLAP"), (6, 5, 4, "MEDIUM_OVERLAP"), (2, 2, 1, "MEDIUM_OVERLAP"), (3, 4, 1, "SHARED_CHARTS"), (2147483647, 2147483647, 1, "SHARED_CHARTS")],
)
def test_relationship(spark, a, b, common, label):
    assert one(spark, C.relationship(F.lit(a), F.lit(b), F.lit(common))) == label


@pytest.mark.parametrize("a,b,common", [(2, 2, 0), (2, 3, 3)])
def test_relationship_refuses(spark, a, b, common):
    with pytest.raises(Exception, match="common part"):
        one(spark, C.relationship(F.lit(a), F.lit(b), F.lit(common)))


def items(spark, text):
    rows = [(f"{c}/{i}", c, x) for c, xs in (p.split(":") for p in text.split()) for i, x in enumerate(xs.split(","))]
    return spark.createDataFrame(rows, "path string, container string, content_id string")


@pytest.mark.parametrize("order", [1, -1])
def test_nine_items(spark, order):
    i = items(spark, "A:a,a,b B:a,b C:a,b D:a,c").orderBy(F.col("path").asc() if order > 0 else F.col("path").desc())
    got = {(r.a, r.b): (r.physical_a, r.physical_b, r.common, r.coverage_a, round(r.jaccard, 9), r.relationship) for r in relations.pairs(i).collect()}
    exact, medium = "EXACT_CHART_SET", "MEDIUM_OVERLAP"
    assert got == {
        ("A", "B"): (3, 2, 2, 1.0, 1.0, exact), ("A", "C"): (3, 2, 2, 1.0, 1.0, exact), ("A", "D"): (3, 2, 1, 0.5, round(1 / 3, 9), medium),
        ("B", "C"): (2, 2, 2, 1.0, 1.0, exact), ("B", "D"): (2, 2, 1, 0.5, round(1 / 3, 9), medium), ("C", "D"): (2, 2, 1, 0.5, round(1 / 3, 9), medium),
    }
    assert {r.content_id: r.locations for r in relations.duplicates(i).collect()} == {"a": 5, "b": 3}


def test_transitive_cluster(spark):
    i = items(spark, "A:x B:x,y C:y Isolated:z")
    p = relations.pairs(i)
    assert p.count() == 2
    assert {(r.cluster_id, r.container) for r in relations.numbered(relations.related_clusters(p), "RELATED").collect()} == {("RELATED_000001", c) for c in "ABC"}
    assert relations.exact_clusters(i).count() == 0
    copies = items(spark, "A:x,x B:x C:x")
    assert relations.pairs(copies).count() == 3 and {r.size for r in relations.exact_clusters(copies).collect()} == {3}


def test_pair_budget(spark):
    many = items(spark, " ".join(f"c{i}:s" for i in range(50)))
    with pytest.raises(relations.PairBudgetExceeded):
        relations.pairs(many, max_work=1000)
    assert relations.pairs(many, max_work=1225).count() == 1225


@pytest.mark.parametrize("n", [1, 2, 60])
def test_chain_component(spark, n):
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = relations.related_clusters(chain).collect()
    assert {r.cluster_key for r in got} == {0} and len(got) == n + 1


def test_incomplete_container(spark):
    i = spark.createDataFrame([("A/1", "A", "x", True, "OK"), ("A/2", "A", None, True, "ERROR"), ("B/1", "B", "x", True, "OK"), ("D/e/1", "D/e", "x", True, "OK")], "path string, container string, content_id string, present boolean, status string")
    assert [r.container for r in relations.incomplete_containers(i).collect()] == ["A"]
    d = spark.createDataFrame([("ERROR", "DIRECTORY_UNREADABLE", "D"), ("ERROR", "CHART_READ", "B/9")], "severity string, code string, path string")
    assert {r.container for r in relations.incomplete_containers(i, d).collect()} == {"A", "B", "D/e"}
    assert relations.duplicates(relations.eligible(i)).count() == 3
    s = relations.summary(i.withColumn("md5", F.lit("m")), d).first()
    assert (s.current, s.verified, s.unique_contents, s.containers, s.errors, s.warnings) == (4, 3, 1, 3, 2, 0)


SEEN = "path string, root string, size long, mtime long, content_id string"


def test_incremental_life(spark):
    empty = index.merge(spark.createDataFrame([], SEEN + ", status string, first_seen int, last_seen int, present boolean"), spark.createDataFrame([("/r/a", "/r", 1, 1, "h1")], SEEN), 1)
    steps = [([("/r/a", "/r", 1, 1, "h1")], False, "REUSED"), ([("/r/a", "/r", 1, 1, "h2")], False, "REUSED"), ([("/r/a", "/r", 1, 1, "h1")], True, "HASHED"), ([("/r/a", "/r", 2, 5, "h3")], False, "CHANGED"), ([], False, "MISSING"), ([("/r/a", "/r", 2, 5, "h3")], False, "HASHED")]
    state = empty
    assert state.first().outcome == "NEW"
    for run, (rows, rehash, outcome) in enumerate(steps, 2):
        state = index.merge(relations.checkpointed(state.drop("outcome")), spark.createDataFrame(rows, SEEN), run, rehash)
        r = state.first()
        assert (r.outcome, r.first_seen) == (outcome, 1)
        assert r.content_id == {2: "h1", 3: "h1", 4: "h1", 5: "h3", 6: "h3", 7: "h3"}[run]


def test_counters(spark):
    """A new file is new and hashed, a changed stamp is changed whatever the digest, what is missing already isn't missing anew."""
    kept = SEEN + ", status string, first_seen int, last_seen int, present boolean"
    old = [("same", 1, "h", "OK", True), ("touched", 1, "h", "OK", True), ("edited", 1, "h", "OK", True), ("broken", 1, "h", "OK", True), ("failed", 1, None, "ERROR", True), ("gone", 1, "h", "OK", True), ("long gone", 1, "h", "MISSING", False)]
    old = spark.createDataFrame([(p, "/", 1, m, h, s, 1, 1, here) for p, m, h, s, here in old], kept)
    new = [("same", 1, None, "OK"), ("touched", 2, "h", "OK"), ("edited", 2, "g", "OK"), ("broken", 2, None, "UNSTABLE"), ("failed", 1, None, "ERROR"), ("fresh", 1, "f", "OK"), ("bad", 1, None, "ERROR")]
    out = index.merge(old, spark.createDataFrame([(p, "/", 1, m, h, s) for p, m, h, s in new], SEEN + ", status string"), 2)
    assert index.statistics(out).first().asDict() == {"discovered": 7, "reused": 1, "hashed": 3, "new": 2, "changed": 3, "missing": 1, "errored": 3, "unstable": 1}
    assert {r.path: r.status for r in out.collect()} == {"same": "OK", "touched": "OK", "edited": "OK", "broken": "UNSTABLE", "failed": "ERROR", "fresh": "OK", "bad": "ERROR", "gone": "MISSING", "long gone": "MISSING"}


def test_unreadable_entry_blocks_its_folder(spark):
    items = spark.createDataFrame([("root/A", True, "OK"), ("root/A/sub", True, "OK"), ("root/B", True, "OK")], "container string, present boolean, status string")
    said = spark.createDataFrame([("ENTRY_METADATA", "root/A/x.bms")], "code string, path string")
    assert {r.container for r in relations.incomplete_containers(items, said).collect()} == {"root/A", "root/A/sub"}


def test_blocked_and_inactive(spark):
    old = spark.createDataFrame([("/a/x/1", "/a", 1, 1, "h", "OK", 1, 1, True), ("/a/y/1", "/a", 1, 1, "h", "OK", 1, 1, True), ("/b/1", "/b", 1, 1, "h", "OK", 1, 1, True)], SEEN + ", status string, first_seen int, last_seen int, present boolean")
    out = index.merge(old, spark.createDataFrame([], SEEN), 2, active_roots=spark.createDataFrame([("/a",)], "root string"), blocked=spark.createDataFrame([("/a/x",)], "blocked string"))
    assert {r.path: (r.outcome, r.present) for r in out.collect()} == {"/a/x/1": ("UNVERIFIED", False), "/a/y/1": ("MISSING", False), "/b/1": ("INACTIVE", False)}
    s = index.statistics(out).first()
    assert (s.missing, s.discovered, s.new) == (1, 0, 0)


TREE = "path string, kind string, digest string, is_item boolean"


def tree(spark, text):
    rows = [("chart.bms", "REGULAR_FILE", "c" * 4, True)]
    for part in text.split():
        p, _, h = part.partition("=")
        rows.append((p, "REGULAR_FILE", h, False) if h else (p.rstrip("/"), "DIRECTORY", None, False))
    return spark.createDataFrame(rows, TREE)


@pytest.mark.parametrize(
    "a,b,flags,only_a,only_b,kinds",
    [
        ("01.wav=aaaa", "01.wav=aaaa", "TTTTF", 0, 0, 0), ("01.wav=aaaa", "01.wav=bbbb", "FFFFT", 0, 0, 0), ("a.wav=aaaa", "b.wav=aaaa", "FTFTF", 1, 1, 0), ("kick.wav=aaaa 001.wav=aaaa", "kick.wav=aaaa", "FFFFF", 1, 0, 0),
        ("empty/", "", "FTFTF", 0, 0, 0), ("only.txt=dddd", "", "FFFFF", 1, 0, 0), ("collision=eeee", "collision/", "FFFFT", 1, 0, 1),
    ],
)
def test_tree_scenarios(spark, a, b, flags, only_a, only_b, kinds):
    x, y = tree(spark, a), tree(spark, b)
    f = compare.pair_flags(x, y).first()
    assert "".join("FT"[v] for v in (f.tree, f.multiset, f.nonchart_tree, f.nonchart_multiset, f.path_conflict)) == flags and f.fileset_variant == (not f.tree)
    n = compare.difference_counts(compare.tree_diff(x, y)).first()
    assert n.kind_conflict == kinds and (kinds or (n.file_only_a, n.file_only_b) == (only_a, only_b))


@pytest.mark.parametrize(
    "a,b,label",
    [
        ("1=a", "1=a", "OBSERVATION_TREE_EXACT"), ("a=x", "b=x", "CONTENT_MULTISET_EXACT_WITH_PATH_VARIANTS"), ("k=a l=a", "k=a", "OBSERVED_TREE_SUBSET_B_IN_A"), ("1=a", "1=b", "HARD_PATH_CONTENT_CONFLICT"),
        ("c=e", "c/", "HARD_PATH_KIND_CONFLICT"), ("", "b=1", "OBSERVED_TREE_SUBSET_A_IN_B"), ("", "e/", "OBSERVED_TREE_SUBSET_A_IN_B"), ("a=1", "b=2", "OBSERVED_COMPLEMENTARY_CONTENT"),
    ],
)
def test_pair_labels(spark, a, b, label):
    assert label in compare.pair_labels(tree(spark, a), tree(spark, b)).first().labels


def test_conflict_kinds(spark):
    x = spark.createDataFrame([("k.wav", "REGULAR_FILE", "a", False, "n1"), ("b.bms", "REGULAR_FILE", "b", True, None), ("Q", "REGULAR_FILE", "q", False, None)], TREE + ", native_id string")
    y = spark.createDataFrame([("k.wav", "REGULAR_FILE", "z", False, "n1"), ("b.bms", "REGULAR_FILE", "c", False, None), ("q", "REGULAR_FILE", "q", False, None)], TREE + ", native_id string")
    assert {(r.path, *r.kinds) for r in compare.conflicts(x, y).collect()} == {
        ("k.wav", "SAME_RELATIVE_PATH_DIFFERENT_BYTES", "RESOURCE_VARIANT"), ("b.bms", "SAME_RELATIVE_PATH_DIFFERENT_BYTES", "CHART_RESOURCE_PATH_CONFLICT"), ("Q", "CASE_COLLISION"), ("k.wav", "POTENTIAL_NATIVE_ALIAS_CONFLICT"),
    }


def roots(spark, **files):
    rows = []
    for r, text in enumerate(files.values()):
        rows += [(r, ".", "DIRECTORY", None, False)]
        for part in text.split():
            p, _, h = part.partition("=")
            rows.append((r, p.rstrip("/"), "REGULAR_FILE" if h else "DIRECTORY", h or None, False))
    return spark.createDataFrame([(r, i, *x) for i, (r, *x) in enumerate(rows)], "root int, entry long, " + TREE)


def groups(spark, e):
    return {"".join("ABCDEF"[i] for i in range(6) if r.mask >> i & 1) for r in plan.maximal(plan.subsets(e)).collect()}


@pytest.mark.parametrize("n", [3, 6])
def test_full_group(spark, n):
    e = roots(spark, **{f"r{i}": "kick.wav=X" for i in range(n)})
    assert groups(spark, e) == {"ABCDEF"[:n]} and plan.subsets(e).where("compatible").count() == 2**n - 1


def test_maximal_groups(spark):
    assert groups(spark, roots(spark, a="k=X", b="k=X", c="k=Y")) == {"AB", "C"}
    assert groups(spark, roots(spark, a="k=X", b="", c="k=Y")) == {"AB", "BC"}
    assert groups(spark, roots(spark, a="k=X", b="", c="k=Y", d="")) == {"ABD", "BCD"}
    assert groups(spark, roots(spark, a="item=X", b="item/ item/child=Y", c="")) == {"AC", "BC"}
    assert groups(spark, roots(spark, a="kick.wav=X", b="KICK.WAV=X", c="")) == {"AC", "BC"}
    with pytest.raises(ValueError):
        plan.subsets(roots(spark, **{f"r{i}": "" for i in range(7)}))


def test_union_accounts_for_everything(spark):
    e = roots(spark, a="s/ s/x=1 t=2", b="s/ s/x=9 t=2 u=3")
    c = spark.createDataFrame([("S/X",)], "path string")
    v, ledger = plan.virtual_entries(e, c), plan.ledger(e, c)
    assert {r.path for r in v.collect()} == {".", "s", "t", "u"} and ledger.count() == e.count()
    assert plan.verify_plan(e, v, ledger).count() == 0
    assert {r.code for r in plan.verify_plan(e, v.where("path <> 't'"), ledger.union(ledger.where("path = 'u'"))).collect()} == {"REPRESENTED_WITHOUT_TARGET", "ENTRY_NOT_ACCOUNTED_ONCE"}
    blocked = plan.ledger(e, spark.createDataFrame([("s",)], "path string")).where("disposition = 'BLOCKED_CONFLICT'")
    assert {r.path for r in blocked.collect()} == {"s", "s/x"}


def test_canonical_tokens(spark):
    df = spark.createDataFrame([(None, "", "é")], "a string, b string, c string")
    assert df.select(F.hex(validate.row_tokens(df, ["a", "b", "c"])).alias("h")).first().h == "0000000161FFFFFFFF0000000162000000000000000163" + "00000002C3A9"


def test_rules(spark):
    rows = [("a/1", "a", "0" * 64, 1, 1, 1, True, "OK"), ("a/2", "b", "xyz", -1, 2, 1, False, "OK"), ("a/3", "a", None, 1, 1, 1, True, "OK")]
    i = spark.createDataFrame(rows, "path string, container string, content_id string, size long, first_seen int, last_seen int, present boolean, status string")
    assert {(r.code, r.key) for r in validate.item_rules(i).collect()} == {("DIGEST_FORMAT", "a/2"), ("NEGATIVE_SIZE", "a/2"), ("SEEN_BEFORE_FIRST", "a/2"), ("ABSENT_BUT_OK", "a/2"), ("OUTSIDE_CONTAINER", "a/2"), ("OK_WITHOUT_DIGEST", "a/3")}
    log = spark.createDataFrame([(1, 1, "RUNNING"), (1, 2, "COMPLETED"), (2, 1, "RUNNING"), (2, 2, "FAILED"), (2, 3, "COMPLETED"), (3, 1, "COMPLETED")], "run_id int, step int, state string")
    assert {(r.run_id, r.step) for r in validate.transitions(log).collect()} == {(2, 3), (3, 1)}
    f = spark.createDataFrame([("RESOURCE_LIMIT", "A", "1"), ("SCOPE_CHANGED", "B", "2"), ("INVALID", "C", "3")], "kind string, code string, key string")
    assert validate.worst(f).first().code == "C"
    assert {r.code for r in validate.bounded(f, 2, "code").collect()} == {"A", "FINDINGS_TRUNCATED"} and validate.bounded(f, 3, "code").count() == 3


def test_coverage_gaps(spark):
    e = spark.createDataFrame([("c", 1), ("c", 2), ("c", 3), ("d", 1)], "component string, root int")
    p = spark.createDataFrame([("c", 1, 2), ("c", 1, 3)], "component string, a int, b int")
    assert {(r.component, r.code) for r in validate.coverage_gaps(e, e.where("root <> 3"), p).collect()} == {("c", "ROOT_WITHOUT_OUTCOME"), ("c", "PAIRS_INCOMPLETE")}


def test_chain_of_records(spark):
    r = spark.createDataFrame([("a", None, "p1"), ("b", None, "p2")], "name string, parent string, payload string")
    d = r.withColumn("digest", F.sha2(F.concat(C.token(F.col("name")), C.token(F.col("parent")), C.token(F.col("payload"))), 256))
    assert validate.chained(d).count() == 0
    assert {x.code for x in validate.chained(d.withColumn("parent", F.lit("gone"))).collect()} == {"PARENT_UNKNOWN", "DIGEST_MISMATCH"}


def test_ticks_and_numbers(spark):
    assert one(spark, C.ticks_to_text(F.lit(638000000000000000).cast("long"))) == "2022-09-28T22:13:20.0000000Z"
    assert one(spark, C.ticks_to_text(F.lit(638000000000000009).cast("long"))) == "2022-09-28T22:13:20.0000009Z"
    assert [P.dotnet_number(x) for x in (1.0, 0.5, 1e-5, 1e16, 1e15, 1e14, -2.5, 0.0, 0.0001)] == ["1", "0.5", "1E-05", "1E+16", "1E+15", "100000000000000", "-2.5", "0", "0.0001"]
    assert [one(spark, C.strict_positive(F.lit(x))) for x in ("1", "0", "-1", "+1", " 1", "2147483648", "x", "")] == [1, *[None] * 7]


def test_folding_and_order(spark):
    assert [P.fold_text(x) for x in ("ß", "ﬁ", "aé")] == ["ß", "ﬁ", "AÉ"]
    rows = spark.createDataFrame([("\U0001F600",), ("～",)], "s string")
    assert [r.s for r in rows.orderBy(C.ordinal(F.col("s"))).collect()] == ["\U0001F600", "～"] and [r.s for r in rows.orderBy("s").collect()] == ["～", "\U0001F600"]


def test_subset_oracle_of_lattice(spark):
    e = roots(spark, a="x=1 y=2", b="x=1", c="y=3", d="z/ z/q=1")
    files = {r: {p: (k, h) for (_, _, p, k, h, _) in [tuple(x) for x in e.where(F.col("root") == r).collect()]} for r in range(4)}
    got = {r.mask: r.compatible for r in plan.subsets(e).collect()}
    for mask in range(1, 16):
        own = [files[i] for i in range(4) if mask >> i & 1]
        assert got[mask] == all(a[p] == b[p] for a, b in itertools.combinations(own, 2) for p in a.keys() & b.keys())


def test_pairs_of_a_hot_content_meet_in_cells(spark, monkeypatch):
    """Cells of a few containers and tasks of a few pairs give the same pairs, and no cell holds the whole content."""
    rows = [(i, c, f"{i}/{c}") for i in range(40) for c in ("hot", f"own{i % 7}")]
    items = spark.createDataFrame(rows, "container long, content_id string, path string")
    want = sorted(map(tuple, relations.pairs(items).collect()))
    monkeypatch.setattr(relations, "BLOCK", 4)
    monkeypatch.setattr(relations, "TASK_WORK", 50)
    x, y = relations.celled(relations.members(items))
    assert max(r["count"] for r in x.groupBy("content_id", "row", "column").count().collect()) < 20
    got = relations.pairs(items)
    assert sorted(map(tuple, got.collect())) == want and len(want) == 40 * 39 // 2


def test_pairs_meet_where_their_first_container_is(spark, monkeypatch):
    """Heavy containers in parts, hot contents in cells, repeated items and null contents: as counted by hand, and no pair is shuffled as a row."""
    rows = [(i, None if c == 0 else c, f"{i}/{c}/{k}") for i in range(30) for c in range(12) if c < 2 or (i * 7 + c) % (c + 1) == 0 for k in range(1 + (i + c) % 3)]
    items = spark.createDataFrame(rows, "container long, content_id long, path string")
    monkeypatch.setattr(relations, "BLOCK", 4)
    monkeypatch.setattr(relations, "TASK_WORK", 10)
    sets, n = {}, {}
    for i, c, _ in rows:
        sets.setdefault(i, set()).update({c} - {None})
        n[i] = n.get(i, 0) + 1
    want = {(a, b, n[a], n[b], len(sets[a]), len(sets[b]), len(sets[a] & sets[b])) for a in sets for b in sets if a < b and sets[a] & sets[b]}
    got = relations.pairs(items)
    assert {(r.a, r.b, r.physical_a, r.physical_b, r.items_a, r.items_b, r.common) for r in got.collect()} == want and got.count() == len(want)
    work = sum(k * (k - 1) // 2 for k in (sum(c in x for x in sets.values()) for c in range(1, 12)))
    assert relations.pairs(items, max_work=work).count() == len(want)
    with pytest.raises(relations.PairBudgetExceeded):
        relations.pairs(items, max_work=work - 1)
    plan = got._jdf.queryExecution().executedPlan().toString()
    last = plan[: plan.index("Exchange")]
    assert last.count("HashAggregate") == 2 and "Generate explode" in last  # what is shuffled last are arrays
