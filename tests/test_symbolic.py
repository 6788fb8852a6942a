"""Symbolic coverage as relations, against enumeration of all assignments and by the truth tables of the format."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from kinfold.operators import budget, resolve, symbolic
from kinfold.operators.symbolic import AMBIGUOUS, APART, COEXISTING, COVERED, CUT_SHORT, EXCLUSIVE, LIMITED, MAY_BIND, MAYBE, NEVER, NONE_FITS, OBLIGED, RELATION_LIMIT, SINGLE, UNBOUND, UNCLEAR, UNKNOWN, UNRESOLVED, UNSURE, UNUSED

PLAY = "#00111:01"


def files(spark, charts):
    return spark.createDataFrame([(f"{name}.bms", bytearray("\n".join(lines).encode())) for name, lines in charts.items()], "path string, content binary")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def branches(*own, head="#RANDOM 2", end="#ENDRANDOM"):
    return [head, *[x for k, b in enumerate(own, 1) for x in (f"#IF {k}", b, "#ENDIF")], end]


def cases(*own, head="#SWITCH 2"):
    return [head, *[x for k, b in enumerate(own, 1) for x in (f"#CASE {k}", b, "#SKIP")], "#ENDSW"]


# lines, effective declaration and coverage of each usage
TRUTH = {
    "plain": (["#WAV01 a.wav", PLAY], [(SINGLE, COVERED)]),
    "one_branch": ([*branches("#WAV01 a.wav"), PLAY], [(SINGLE, UNBOUND)]),
    "use_in_branch": (["#WAV01 a.wav", *branches(PLAY)], [(SINGLE, COVERED)]),
    "both_in_branch": (["#RANDOM 2", "#IF 1", "#WAV01 a.wav", PLAY, "#ENDIF", "#ENDRANDOM"], [(SINGLE, COVERED)]),
    "apart": (branches("#WAV01 a", PLAY), [(NONE_FITS, UNBOUND)]),
    "exclusive": ([*branches("#WAV01 a", "#WAV01 b"), PLAY], [(EXCLUSIVE, COVERED)]),
    "twice": (["#WAV01 a", "#WAV01 b", PLAY], [(AMBIGUOUS, COVERED)]),
    "redefined": (["#WAV01 a", *branches("#WAV01 b"), PLAY], [(AMBIGUOUS, COVERED)]),
    "switch": (["#SWITCH 3", "#CASE 1", "#WAV01 a", "#SKIP", "#CASE 2", "#WAV01 b", "#SKIP", "#DEF", "#WAV01 c", "#ENDSW", PLAY], [(EXCLUSIVE, COVERED)]),
    "fixed_switch": ([*cases("#WAV01 a", "#WAV01 b", head="#SETSWITCH 2"), PLAY], [(SINGLE, UNBOUND)]),
    "fall_through": (["#SWITCH 3", "#CASE 1", "#WAV01 a", "#CASE 2", "#WAV01 b", "#ENDSW", PLAY], [(UNSURE, UNCLEAR)]),
    "bare_random": (["#RANDOM 2", "#WAV01 a", "#ENDRANDOM", PLAY], [(UNSURE, UNCLEAR)]),
    "beyond_random": (["#RANDOM 2", "#IF 3", PLAY, "#ENDIF", "#ENDRANDOM", "#WAV01 a"], [(NONE_FITS, UNUSED)]),
    "undeclared": ([PLAY], [(UNRESOLVED, UNCLEAR)]),
    "with_impossible": (["#WAV01 a.wav", PLAY, "#RANDOM 2", "#IF 3", "#00211:01", "#ENDIF", "#ENDRANDOM"], [(SINGLE, COVERED), (NONE_FITS, UNUSED)]),
    "fixed_random": (["#WAV01 a.wav", "#SETRANDOM 2", "#IF 2", PLAY, "#ENDIF", "#IF 1", "#00211:01", "#ENDIF", "#ENDRANDOM"], [(SINGLE, COVERED), (NONE_FITS, UNUSED)]),
    "case_beyond": (["#WAV01 a.wav", "#SWITCH 2", "#CASE 1", PLAY, "#SKIP", "#CASE 3", "#00211:01", "#SKIP", "#DEF", "#ENDSW"], [(SINGLE, COVERED), (NONE_FITS, UNUSED)]),
    "unknown_directive": (["#WAV01 a.wav", "#IFDEF PLAYER", PLAY, "#ENDIF"], [(UNSURE, UNCLEAR)]),
    "unskipped": (["#WAV01 a.wav", "#SWITCH 2", "#CASE 1", PLAY, "#CASE 2", "#00211:01", "#ENDSW"], [(UNSURE, UNCLEAR)] * 2),
    "nested": (["#RANDOM 2", "#IF 1", "#RANDOM 3", "#IF 2", "#WAV01 a", "#ENDIF", "#ENDRANDOM", "#ELSE", "#WAV01 b", "#ENDIF", "#ENDRANDOM", PLAY], [(EXCLUSIVE, UNBOUND)]),
}
PROVEN = {"plain", "use_in_branch", "both_in_branch", "exclusive", "with_impossible", "fixed_random", "case_beyond", "switch"}


@pytest.fixture(scope="module")
def truth(spark):
    f = files(spark, {k: v[0] for k, v in TRUTH.items()})
    return f, symbolic.analysed(resolve.facts(f))


def test_truth_tables(truth):
    got = {}
    for r in truth[1].usages.orderBy("usage").collect():
        got.setdefault(r.path.removesuffix(".bms"), []).append((r.effective, r.coverage))
    assert got == {k: v[1] for k, v in TRUTH.items()}


def test_witness(truth):
    got = {r.path: r.witness for r in truth[1].usages.where("coverage = 'UNBOUND_ASSIGNMENTS_WITHIN_MODEL'").collect()}
    assert got == {"one_branch.bms": "0=2-2", "apart.bms": "0=2-2", "fixed_switch.bms": "0=1-1", "nested.bms": "0=1-1;2=1-1"}
    assert truth[1].usages.where("coverage <> 'UNBOUND_ASSIGNMENTS_WITHIN_MODEL' AND witness IS NOT NULL").isEmpty()


def test_coexistence_and_compatibility(truth):
    got = {r.path.removesuffix(".bms"): r.state for r in truth[1].coexistence.collect()}
    assert got == {"exclusive": APART, "twice": COEXISTING[0], "redefined": COEXISTING[1], "switch": APART, "fixed_switch": APART, "fall_through": "UNKNOWN_DECLARATION_COEXISTENCE", "nested": APART}
    met = {(r.path.removesuffix(".bms"), r.compatibility) for r in truth[1].relations.collect()}
    assert {("one_branch", MAY_BIND), ("apart", APART), ("undeclared", UNRESOLVED), ("bare_random", UNCLEAR), ("with_impossible", MAY_BIND), ("with_impossible", APART)} <= met and ("apart", MAY_BIND) not in met
    obliged = {r.path.removesuffix(".bms"): r.state for r in truth[1].obligations.where("declaration = 0").collect()}
    assert (obliged["plain"], obliged["exclusive"], obliged["apart"], obliged["bare_random"]) == (OBLIGED[1], OBLIGED[2], OBLIGED[3], OBLIGED[0])


def test_proofs_of_the_truth_tables(spark, truth):
    f, a = truth
    inventory = spark.createDataFrame([("a.wav",), ("a",), ("b",), ("c",)], "path string")
    got = {r.path.removesuffix(".bms"): r for r in resolve.proofs(a, resolve.evidence(a.facts, inventory)).collect()}
    assert {k for k, r in got.items() if r.proof == resolve.PROVEN} == PROVEN and all((r.proof == resolve.PROVEN) == (not r.blockers) for r in got.values())
    for k in ("beyond_random", "unknown_directive", "unskipped", "undeclared"):
        assert "NO_SATISFIABLE_USAGE_WITHIN_ADMITTED_MODEL" in got[k].blockers
    assert "NO_SATISFIABLE_USAGE_WITHIN_ADMITTED_MODEL" not in got["one_branch"].blockers


def test_place_in_text(spark):
    a = symbolic.analysed(resolve.facts(files(spark, {"x": [PLAY, "#WAV01 a", "#00112:01", "#BANNER b.png"]})))
    assert rows(a.relations.select("usage", "declaration", "place")) == [(0, 0, symbolic.AFTER), (1, 0, symbolic.BEFORE), (2, 1, symbolic.AFTER)]


def values(t):
    return {x for x in range(1, t["upper"] + 1) if (t["equal"] is None or x == t["equal"]) and x not in t["excluded"]}


def enumerated(facts, uppers):
    """The analysis of one path by going through all assignments."""
    every = list(itertools.product(*(range(1, n + 1) for n in uppers.values())))
    where = {}
    for i, (_, _, known, terms) in facts.items():
        where[i] = None if not known else {a for a in every if all(dict(zip(uppers, a))[t["variable"]] in values(t) for t in terms)}
    out = {}
    for u, (kind, key, _, _) in facts.items():
        if kind != "USAGE":
            continue
        own = [where[i] for i, f in facts.items() if f[0] == "DECLARATION" and f[1] == key and key is not None]
        use = where[u]
        unclear = use is None or None in own
        possible = 0 if unclear else sum(bool(use & d) for d in own)
        if not own:
            effective = UNRESOLVED
        elif unclear:
            effective = UNSURE
        elif any(use & a & b for a, b in itertools.combinations(own, 2)):
            effective = AMBIGUOUS
        else:
            effective = (NONE_FITS, SINGLE, EXCLUSIVE)[min(possible, 2)]
        coverage = UNCLEAR if unclear else UNUSED if not use else UNBOUND if use - set().union(*own) else COVERED
        out[u] = (effective, coverage, set() if coverage != UNBOUND else use - set().union(*own), every)
    return out


@pytest.mark.parametrize("round_", [16, 1])
def test_random_predicates_enumerated(spark, monkeypatch, round_):
    monkeypatch.setattr(symbolic, "ROUND", round_)
    r = random.Random(7 + round_)
    uppers = {0: 3, 1: 2, 2: 4, 3: 1}
    paths = {}
    for p in range(40):
        facts = {}
        for i in range(r.randint(1, 14)):
            terms = []
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                v = r.choice(list(uppers))
                equal = r.choice([None, r.randint(0, uppers[v] + 1)])
                terms.append({"variable": v, "upper": uppers[v], "equal": equal, "excluded": sorted({r.randint(1, uppers[v]) for _ in range(r.randint(0, 2))})})
            facts[i] = (r.choice(["DECLARATION", "DECLARATION", "USAGE"]), r.choice(["k", "l", None]), r.random() > 0.03, terms)
        paths[f"p{p}"] = facts
    table = [(p, kind, i, key, i, bool(t), known, t, None, False, True, False) for p, facts in paths.items() for i, (kind, key, known, t) in facts.items()]
    a = symbolic.analysed(spark.createDataFrame(table, symbolic.FACTS).repartition(3))
    seen = set()
    for row in a.usages.collect():
        effective, coverage, open_, every = enumerated(paths[row.path], uppers)[row.usage]
        assert (row.effective, row.coverage) == (effective, coverage), (row, paths[row.path])
        seen.add((effective, coverage))
        if coverage == UNBOUND:  # all that the witness names is open
            told = {int(v): tuple(map(int, x.split("-"))) for v, x in (e.split("=") for e in row.witness.split(";") if e)}
            inside = {x for x in every if all(lo <= dict(zip(uppers, x))[v] <= hi for v, (lo, hi) in told.items())}
            assert inside and inside <= open_
    assert a.usages.count() == sum(f[0] == "USAGE" for facts in paths.values() for f in facts.values()) and len(seen) >= 9


def test_states_of_predicates(spark):
    table = []
    for a, b, mask in itertools.product(range(5), range(5), range(8)):
        out = [x for x in (1, 2, 3) if mask >> (x - 1) & 1]
        table.append((a, b, out, [{"variable": 0, "upper": 3, "equal": a or None, "excluded": []}], [{"variable": 0, "upper": 3, "equal": b or None, "excluded": out}]))
    df = spark.createDataFrame(table, f"a int, b int, out array<int>, x {symbolic.TERMS}, y {symbolic.TERMS}")
    both = symbolic.joint(symbolic.box_of(F.col("x")), symbolic.box_of(F.col("y")))
    for r in df.select("a", "b", "out", symbolic.state_of(F.lit(True), both).alias("state"), symbolic.state_of(F.lit(False), both).alias("unknown")).collect():
        left = [x for x in (1, 2, 3) if (not r.a or x == r.a) and (not r.b or x == r.b) and x not in r.out]
        assert r.state == (MAYBE if left else NEVER) and r.unknown == UNKNOWN


def test_relation_limit_leaves_rows(spark):
    lines = ["#WAV01 a", "#WAV01 b", "#WAV02 c", *[f"#0{k:02d}11:01" for k in range(1, 9)], *[f"#0{k:02d}11:02" for k in range(11, 15)]]
    f = resolve.facts(files(spark, {"x": lines, "y": ["#WAV01 a", PLAY]}))
    # a pair, then three for each usage of 01 (two relations, a collision) and one for each of 02
    for limit in (6, 26, 100):
        a = symbolic.analysed(f, symbolic.Limits(relations=limit))
        got = {r.usage: (r.effective, r.coverage) for r in a.usages.where("path = 'x.bms'").collect()}
        spent, want = 1, {}
        for k in range(12):
            spent += 3 if k < 8 else 1
            want[k] = (UNSURE, LIMITED) if spent > limit else (AMBIGUOUS, COVERED) if k < 8 else (SINGLE, COVERED)
        assert got == want
        assert a.relations.where("path = 'x.bms' AND declaration IS NULL").count() == sum(v[1] == LIMITED for v in want.values())
        assert {r.state for r in a.obligations.where("path = 'x.bms'").collect()} == ({OBLIGED[0]} if spent > limit else {OBLIGED[1]})
        assert {r.coverage for r in a.usages.where("path = 'y.bms'").collect()} == {COVERED if limit > 0 else LIMITED}
    a = symbolic.analysed(f, symbolic.Limits(relations=0))
    assert rows(a.coexistence.select("path", "a", "state")) == [("x.bms", None, RELATION_LIMIT)] and {r.coverage for r in a.usages.collect()} == {LIMITED}
    inventory = spark.createDataFrame([("a",)], "path string")
    assert all("Relation/candidate/symbolic enumeration limited." in r.blockers for r in resolve.bounded_proof(files(spark, {"x": lines}), inventory, limits=symbolic.Limits(relations=4)).collect())


def test_piece_limit_leaves_rows(spark):
    lines = [x for k in range(6) for x in ("#RANDOM 9", "#IF 3", f"#WAV01 s{k}", "#ENDIF", "#ENDRANDOM")] + [PLAY]
    f = resolve.facts(files(spark, {"x": lines}))
    assert symbolic.analysed(f, symbolic.Limits(pieces=2)).usages.first().coverage == CUT_SHORT
    assert symbolic.analysed(f).usages.first().coverage == UNBOUND


def test_a_chart_of_many_facts(spark):
    """Fifty thousand facts in two charts, in which every declaration of an id meets every other and each usage of it."""
    many = [f"#WAV{k % 1295 // 36:X}{k % 36:X} s{k}.wav" for k in range(20_000)] + [f"#{m:03d}11:" + "".join(f"{(m * 7 + j) % 9 + 1:02d}" for j in range(30)) for m in range(1, 990)]
    branchy = ["#RANDOM 200", *[x for k in range(1, 201) for x in (f"#IF {k}", f"#WAV01 b{k}.wav", "#ENDIF")], "#ENDRANDOM", *[f"#{m:03d}11:01" for m in range(1, 201)]]
    f = symbolic.analysed(resolve.facts(files(spark, {"many": many, "branchy": branchy})))
    got = {(r.path, r.coverage): r["count"] for r in f.usages.groupBy("path", "coverage").count().collect()}
    assert got[("branchy.bms", COVERED)] == 200 and got[("many.bms", LIMITED)] > 0 and len(got) <= 4
    assert {r.effective for r in f.usages.where("path = 'branchy.bms'").collect()} == {EXCLUSIVE}


def test_no_facts(spark):
    a = symbolic.analysed(spark.createDataFrame([], symbolic.FACTS))
    assert a.usages.isEmpty() and a.relations.isEmpty() and a.coexistence.isEmpty() and a.obligations.isEmpty()


@pytest.mark.parametrize("parts", ["1", "7"])
def test_running_costs(spark, parts):
    r = random.Random(2)
    table = [(r.choice(["a", "a", "a", "b", None]), k, r.randint(0, 9)) for k in range(500)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        df = spark.createDataFrame(table, "g string, k int, c int").repartition(5)
        got, alone = (budget.running(df, g, ["k"], "c").collect() for g in (["g"], []))
        over = {r.k for r in budget.beyond(df, ["g"], ["k"], "c", 300, 10).collect()}
        assert budget.beyond(df, ["g"], ["k"], "c", 100_000) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    upto, all_ = {}, 0
    want, whole = {}, {}
    for g, k, c in sorted(table, key=lambda x: x[1]):
        upto[g] = upto.get(g, 0) + c
        all_ += c
        want[k], whole[k] = (upto[g], upto[g] + 10 > 300), all_
    assert {r.k: r.upto for r in got} == {k: v[0] for k, v in want.items()} and {r.k: r.upto for r in alone} == whole
    assert over == {k for k, v in want.items() if v[1]} and over


def test_first_rows_of_groups_within_a_budget(spark):
    r = random.Random(9)
    table = [(r.choice("aaabc"), k) for k in r.sample(range(1000), 200)]
    got = {(x.g, x.k): x.taken for x in budget.first_rows(spark.createDataFrame(table, "g string, k int").repartition(4), ["g"], ["k"], 30, 70).collect()}
    want, n = {}, 0
    for g in "abc":
        for i, k in enumerate(sorted(k for h, k in table if h == g)):
            n += i < 30
            want[g, k] = "GROUP_LIMIT" if i >= 30 else "BUDGET_LIMIT" if n > 70 else "TAKEN"
    assert got == want and set(want.values()) == {"TAKEN", "GROUP_LIMIT", "BUDGET_LIMIT"}


def test_coexistence_meets_no_usages(spark, monkeypatch):
    """What is not asked for is not computed: neither the usages' classes nor their regions."""
    def never(*_):
        raise AssertionError

    monkeypatch.setattr(symbolic, "covered", never)
    a = symbolic.analysed(resolve.facts(files(spark, {"x": ["#WAV01 a", "#WAV01 b", PLAY]})))
    assert [r.state for r in a.coexistence.collect()] == [symbolic.COEXISTING[0]]
    assert a.relations.count() == 2 and a.obligations.count() == 2


def test_written_paths_are_resolved_once(spark, monkeypatch):
    f = resolve.facts(files(spark, {x: ["#WAV01 a.wav", "#WAV02 b.wav", "#WAV03 a.wav"] for x in "xyz"}))
    seen, own = [], resolve.resolved
    monkeypatch.setattr(resolve, "resolved", lambda refs, *more: seen.append(refs.count()) or own(refs, *more))
    found = resolve.evidence(f, spark.createDataFrame([("a.wav",)], "path string"))
    assert seen == [2] and sorted((r.declaration, r.unique) for r in found.collect()) == sorted([(0, True), (1, False), (2, True)] * 3)


def test_regions_are_counted_without_meeting_declarations(spark, truth):
    """As the regions of the coverage, from charts and from files; the query joins, stores and shuffles no usages."""
    from kinfold.operators import extract
    from kinfold.plans.catalog import QUERIES

    f, a = truth
    want = rows(a.usages.groupBy("region").agg(F.count("*").alias("usages")))
    assert rows(resolve.usage_regions(f)) == rows(resolve.usage_regions(extract.extracted(f))) == want
    assert {r for r, _ in want} == {symbolic.ALWAYS, MAYBE, NEVER, UNKNOWN}
    assert rows(resolve.usage_regions(f.where("false"))) == []
    plan = QUERIES["a18_usage_counts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Join" not in plan and "ExistingRDD" not in plan


def test_charts_of_one_shape_are_analysed_once(spark, truth, monkeypatch):
    """The same rows as each chart's own analysis; copies under other names, with other written paths, cost no analysis."""
    f, a = truth
    copies = f.union(f.select(F.concat(F.lit("copy/"), "path").alias("path"), F.encode(F.replace(F.decode("content", "UTF-8"), F.lit(".wav"), F.lit(".ogg")), "UTF-8").alias("content")))
    seen, own = [], resolve.analysed
    monkeypatch.setattr(resolve, "analysed", lambda facts, *more: seen.append(facts.where("kind = 'CHART'").count()) or own(facts, *more))
    got = resolve.usage_coverage(copies.repartition(3))
    assert got.columns == a.usages.columns and 0 < seen[0] <= len(TRUTH)
    assert rows(got) == rows(a.usages.union(a.usages.withColumn("path", F.concat(F.lit("copy/"), "path"))))


def test_shapes_keep_apart_what_an_analysis_tells_apart(spark):
    charts = files(spark, {"x": ["#WAV01 a", PLAY], "late": [PLAY, "#WAV01 a"], "far": ["#WAV01 b", "", PLAY], "other": ["#WAV02 a", PLAY], "none": []})
    s = resolve.shaped(charts)
    shape = {r.path: r.shape for r in s.charts.collect()}
    assert shape["x.bms"] == shape["far.bms"] and len(set(shape.values())) == 4
    own = symbolic.analysed(resolve.facts(charts))
    a = symbolic.analysed(s.facts)
    for name in ("usages", "relations", "coexistence", "obligations"):
        assert rows(s.spread(getattr(a, name))) == rows(getattr(own, name))
    assert rows(s.spread(a.usages)) and rows(resolve.usage_coverage(charts.where("false"))) == []


def test_proofs_of_one_shape_share_their_analysis(spark, truth, monkeypatch):
    """As the proofs of each chart's own analysis, with written paths of its own; also of a chart that writes none."""
    more = files(spark, {"bare": [], "title": ["#TITLE t"], "off": ["#WAV01 b.wav", PLAY], "alike": ["#WAV01 A.wav", PLAY], "late": ["#WAV01 none.wav", PLAY]})
    f, inventory = truth[0].union(more), spark.createDataFrame([("a.wav",), ("b.wav",), ("b",), ("c",)], "path string")
    own = symbolic.analysed(resolve.facts(f))
    want = resolve.proofs(own, resolve.evidence(own.facts, inventory))
    seen, before = [], resolve.analysed
    monkeypatch.setattr(resolve, "analysed", lambda facts, *rest: seen.append(facts.where("kind = 'CHART'").count()) or before(facts, *rest))
    got = resolve.bounded_proof(f, inventory)
    assert got.columns == want.columns and rows(got) == rows(want) and len(rows(got)) == len(TRUTH) + 5
    assert len(TRUTH) < seen[0] <= len(TRUTH) + 2  # three of the five have the shape of one there


def test_evidence_is_counted_without_an_analysis(spark, truth, monkeypatch):
    from kinfold.plans import catalog

    def never(*_):
        raise AssertionError

    f, inventory = truth[0], spark.createDataFrame([("a.wav",), ("B",)], "path string")
    want = rows(resolve.evidence(resolve.facts(f), inventory).groupBy("state").agg(F.count("*").alias("n")))
    assert rows(resolve.evidence_states(f, inventory)) == want and len(want) > 2
    monkeypatch.setattr(resolve, "analysed", never)
    assert catalog.QUERIES["y11_binding_evidence"](spark, "/root/testdata/sf0.001").count() == 2


def test_budget_holds_for_each_chart_of_a_shape(spark):
    charts = files(spark, {x: ["#WAV01 a", "#WAV02 b", *["#00111:01"] * 3] for x in "xy"} | {"z": ["#WAV01 a", "#WAV01 b", PLAY, PLAY]})
    limits = symbolic.Limits(relations=2)
    assert rows(resolve.usage_coverage(charts, limits)) == rows(symbolic.analysed(resolve.facts(charts), limits).usages)
    assert [r.coverage for r in resolve.usage_coverage(charts, limits).where("path = 'y.bms'").orderBy("usage").collect()] == [COVERED, COVERED, LIMITED]
