"""Group plans and their check, components two ways, selections, owners, staged names."""

import random

import pytest
from pyspark.sql import functions as F

from kinfold import engine
from kinfold.operators import group, relations

ENTRY = "root int, path string, kind string, digest string, is_item boolean"


def entries(spark, *trees):
    rows = [(k, ".", "DIRECTORY", None, False) for k in range(len(trees))]
    rows += [(k, p, "REGULAR_FILE", d, p.endswith(".bms")) for k, t in enumerate(trees) for p, d in t.items()]
    return spark.createDataFrame(rows, ENTRY).withColumn("entry", F.xxhash64("root", "path"))


def test_alternatives_keep_everything(spark):
    e = entries(spark, {"a.bms": "1", "k.wav": "x"}, {"a.bms": "1", "k.wav": "y"}, {"b.bms": "2"}, {"_Variantes": "z"})
    p = group.group_plan(e)
    assert {r.mask for r in p["masks"].collect()} == {0b1101, 0b1110} and p["selection"].first().state == group.CHOOSE
    kept = p["conservation"].collect()
    assert len(kept) == 2 * e.count()
    assert {(r.candidate, r.root): r.label for r in kept if r.disposition == group.IN_PLACE} == {("group-0D", 1): "_variantes/001", ("group-0E", 0): "_variantes/001"}
    assert {(r.candidate, r.conflict) for r in p["conflicts"].collect()} == {(c, "VARIANT_LAYOUT_NAMESPACE_CONFLICT: _Variantes") for c in ("group-0D", "group-0E")}
    shown = {(r.candidate, r.path): (r.digest, [s.root for s in r.sources]) for r in p["targets"].collect()}
    assert shown["group-0D", "k.wav"] == ("x", [0]) and shown["group-0E", "."] == (None, [1, 2, 3])
    assert p["obligations"].count() == 3 and group.verify_group(e, p).count() == 0


def test_one_alternative_needs_no_choice(spark):
    e = entries(spark, {"a.bms": "1"}, {"b.bms": "2"})
    assert group.group_plan(e)["selection"].first().state == group.UNIQUE
    with pytest.raises(ValueError):
        group.group_plan(entries(spark, *[{f"{k}.bms": "1"} for k in range(7)]))


def test_faults_of_a_stored_plan(spark):
    e = entries(spark, {"a.bms": "1", "k.wav": "x"}, {"k.wav": "y"})
    p = group.group_plan(e)
    faults = {
        "lattice": (p["lattice"].withColumn("compatible", F.lit(True)), "SUBSETS"), "masks": (p["masks"].limit(1), "MAXIMAL_ALTERNATIVES"), "targets": (p["targets"].where("path <> '.'"), "VIRTUAL_NAMESPACE"),
        "conservation": (p["conservation"].withColumn("label", F.lit(None).cast("string")), "CONSERVATION_LEDGER"), "obligations": (p["obligations"].limit(0), "ITEM_OBLIGATIONS"), "selection": (p["selection"].withColumn("state", F.lit(group.UNIQUE)), "SELECTION_STATE"),
    }
    for name, (table, code) in faults.items():
        assert {r.code for r in group.verify_group(e, p | {name: table}).collect()} == {code}, name


def test_engine_group_plan(spark, tmp_path):
    for p, text in {"A/one.bms": "x", "B/one.bms": "y", "C/two.bms": "z"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(text)
    e, roots = engine.Engine(spark, str(tmp_path / "store")), [str(tmp_path / x) for x in "ABC"]
    e.store_plan(roots, str(tmp_path / "plan"))
    assert e.verify_plan(roots, str(tmp_path / "plan")).count() == 0
    (tmp_path / "C/two.bms").write_text("other")
    assert {r.code for r in e.verify_plan(roots, str(tmp_path / "plan")).collect()} == {"VIRTUAL_NAMESPACE", "ITEM_OBLIGATIONS"}
    for bad in ([roots[0], roots[0]], [str(tmp_path), roots[0]]):
        with pytest.raises(ValueError):
            e.plan(bad)
    with pytest.raises(ValueError):
        e.store_plan(roots, roots[0] + "/plan")


@pytest.mark.parametrize("seed", range(3))
def test_components_two_ways(spark, seed):
    r = random.Random(seed)
    edges = spark.createDataFrame([(f"n{r.randrange(60):02}", f"n{r.randrange(60):02}") for _ in range(40)], "a string, b string")
    key = lambda df: sorted((x.cluster_key, x.container) for x in df.collect())
    assert key(group.components_by_search(edges)) == key(relations.related_clusters(edges))


def test_population_relations(spark):
    shared = group.population(spark, 2_000, 16, 16)
    pairs = relations.pairs(shared).collect()
    assert len(pairs) == 120 and {r.relationship for r in pairs} == {"EXACT_CHART_SET"}
    assert relations.pairs(group.population(spark, 2_000, 50)).count() == 0


def test_selection_and_owners(spark):
    clusters = spark.createDataFrame([("E1", "a"), ("E2", "b")], "cluster_id string, container string")
    assert group.select_components(clusters, []).count() == 2 and group.select_components(clusters, ["E2", "E2"]).first().container == "b"
    with pytest.raises(group.UnknownComponent):
        group.select_components(clusters, ["E1", "E9"])
    roots = spark.createDataFrame([("/a", True), ("/a/b", True), ("/c", False)], "root string, active boolean")
    got = {r.path: (r.owner, r.n) for r in group.owners(spark.createDataFrame([("/a/x",), ("/a/b/x",), ("/c/x",), ("/ab",)], "path string"), roots).collect()}
    assert got == {"/a/x": ("/a", 1), "/a/b/x": (None, 2), "/c/x": (None, 0), "/ab": (None, 0)}


@pytest.mark.parametrize("path,problem", [("a/b.txt", None), (".", None), ("", "EMPTY"), ("x" * 161, "TOO_LONG"), ("x" * 150, "ABSOLUTE_TOO_LONG"), ("a\\b", "ROOTED"), ("/a", "ROOTED"), ("a/../b", "UNSAFE_SEGMENT"), ("a/nul.x", "UNSAFE_SEGMENT"), ("a~1/b", "UNSAFE_SEGMENT"), ("a /b", "UNSAFE_SEGMENT")])
def test_stage_paths(spark, path, problem):
    assert spark.range(1).select(group.stage_path_problem(F.lit(path), 100).alias("p")).first().p == problem
