"""Classification of the observed roots of a component: every two roots compared in one pass, within budgets that leave rows.

Roots and pairs are few (Limits) and admitted one after the other on the driver; their entries, and what is counted of
them, are rows keyed by pair, so one set of joins compares all pairs.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import compare
from kinfold.operators.budget import beyond
from kinfold.operators.relations import checkpointed

# States of a root or pair, diagnostics, and the labels of a pair in their order.
PROVEN, BLOCKED = "PROVEN_FROM_ACCEPTED_CONTENT", "BLOCKED"
ROOT_LIMIT, ENTRY_LIMIT, PAIR_LIMIT, PAIR_ENTRIES = "ROOT_LIMIT", "ENTRY_LIMIT", "PAIR_LIMIT", "PAIR_ENTRY_BUDGET_LIMIT"
CONFLICT_LIMIT, DISCOVERY_LIMIT, PAIRS_OPEN = "CONFLICT_LIMIT", "PHASE1_DISCOVERY_PAIR_LIMIT", "PAIR_COVERAGE_INCOMPLETE"
CANDIDATE = "CANDIDATE_FROM_PHASE1"


@dataclass(frozen=True)
class Limits:
    """Caps of one classification; they may only be lowered."""

    roots: int = 32
    pairs: int = 256
    entries: int = 100_000
    conflicts: int = 100_000
    discovery_pairs: int = 1024

    def __post_init__(self):
        for f in fields(self):
            if not 1 <= getattr(self, f.name) <= f.default:
                raise ValueError(f"{f.name} must lie between 1 and {f.default}")


@dataclass(frozen=True)
class Classification:
    """roots: root, path, entries, state, structure. pairs: a, b, state, with counts, flags, item_state, labels and
    conflict_coverage of those admitted. differences and groups: rows of admitted pairs. conflicts: a, b, path, kinds.
    discovery: a, b, state of candidate pairs that were not compared. diagnostics: code, key."""

    roots: DataFrame
    pairs: DataFrame
    differences: DataFrame
    groups: DataFrame
    conflicts: DataFrame
    discovery: DataFrame
    diagnostics: DataFrame

    def state(self) -> str:
        return "COMPLETE" if self.diagnostics.isEmpty() else "INCOMPLETE"


def structure(roots: DataFrame, entries: DataFrame) -> DataFrame:
    """root, structure: whether a root holds items in several folders or another root, so that it may be a container."""
    folders = entries.where("is_item").groupBy("root").agg(F.count_distinct(C.parent(F.col("path"))).alias("folders"))
    nested = compare.nested_roots(roots.select("path")).join(roots.select("root", F.col("path").alias("outer")), "outer").select("root").distinct().withColumn("nests", F.lit(True))
    state = F.when((F.col("folders") > 1) | F.col("nests"), "CONTAINER_DIRECTORY_CANDIDATE").otherwise("OBSERVATION_ROOT_ONLY")
    return roots.select("root").join(folders, "root", "left").join(nested, "root", "left").select("root", state.alias("structure"))


def classified(roots: DataFrame, entries: DataFrame, limits: Limits = Limits(), bindings: DataFrame | None = None, candidates: DataFrame | None = None) -> Classification:
    """Every two roots of a component classified.

    roots: root, path (where it lies). entries: root, path, kind, digest, is_item, native_id. bindings: root, key,
    target of admitted references. candidates: a, b of pairs that an earlier analysis names, by paths of roots.
    Roots go in the order of their paths. A root with more entries than are left of the budget stays unclassified, and
    smaller ones after it may still go; so do pairs. Conflicts are numbered over all pairs in order, those beyond the
    limit make their pair's enumeration incomplete. Nothing is dropped without a row that says so.
    """
    spark = roots.sparkSession
    sizes = roots.join(entries.groupBy("root").agg(F.count("*").alias("entries")), "root", "left").select("root", "path", F.coalesce("entries", F.lit(0)).alias("entries"))
    ordered = sizes.orderBy(C.ordinal(F.col("path")), "root").limit(limits.roots).collect()  # at most limits.roots rows
    left, taken, said = limits.entries, [], []
    for r in ordered:
        fits = r.entries <= left
        left -= r.entries if fits else 0
        taken.append((r.root, PROVEN if fits else BLOCKED, r.entries))
        if not fits:
            said.append((ENTRY_LIMIT, str(r.root)))
    left, pairs = limits.entries, []
    for i, (a, sa, na) in enumerate(taken):
        for b, sb, nb in taken[i + 1 :]:
            n = sum(p[3] == PROVEN for p in pairs)
            state = PAIR_LIMIT if n == limits.pairs else BLOCKED if BLOCKED in (sa, sb) else PAIR_ENTRIES if na + nb > left else PROVEN
            left -= na + nb if state == PROVEN else 0
            pairs.append((len(pairs), a, b, state))
            if state == PAIR_ENTRIES:
                said.append((PAIR_ENTRIES, f"{a}:{b}"))
    kind = roots.schema["root"].dataType.simpleString()
    told = F.broadcast(spark.createDataFrame([t[:2] for t in taken], f"root {kind}, state string"))
    out_roots = sizes.join(told, "root", "left").join(structure(roots, entries), "root").select("root", "path", "entries", F.coalesce("state", F.lit(ROOT_LIMIT)).alias("state"), "structure")
    pair = checkpointed(spark.createDataFrame(pairs, f"pair int, a {kind}, b {kind}, state string"))

    open_ = F.broadcast(pair.where(F.col("state") == PROVEN).select("pair", "a", "b"))
    side = lambda s: entries.join(open_.select("pair", F.col(s).alias("root")), "root").drop("root")
    x, y = checkpointed(side("a")), checkpointed(side("b"))
    by = ["pair"]
    diff = checkpointed(compare.tree_diff(x, y, by))
    flags, items, groups = compare.pair_flags(x, y, by), compare.item_set_state(x, y, by), compare.digest_groups(x, y, by)
    clash = checkpointed(compare.conflicts(x, y, by))
    cut = beyond(clash, [], ["pair", "path", "kinds"], F.lit(1), limits.conflicts)
    short = cut.groupBy("pair").agg(F.count("*").alias("cut")) if cut is not None else clash.select("pair").limit(0).withColumn("cut", F.lit(0))
    short = checkpointed(short)
    kept = clash if cut is None else clash.exceptAll(cut)

    nested = compare.nested_roots(roots.select("path"))
    path = lambda s: roots.select(F.col("root").alias(s), F.col("path").alias(f"path_{s}"))
    near = open_.join(path("a"), "a").join(path("b"), "b").join(nested, ((F.col("path_a") == F.col("outer")) & (F.col("path_b") == F.col("inner"))) | ((F.col("path_b") == F.col("outer")) & (F.col("path_a") == F.col("inner"))), "left_semi").select("pair", F.lit(True).alias("nested"))
    unlike = open_.select("pair").limit(0).withColumn("variants", F.lit(True))
    if bindings is not None:
        bound = lambda s: bindings.join(open_.select("pair", F.col(s).alias("root")), "root").select(F.struct("pair", "key").alias("key"), "target")
        unlike = compare.binding_variants(bound("a"), bound("b")).select("key.pair").distinct().withColumn("variants", F.lit(True))
    facts = compare.label_facts(diff, by).join(flags, by).join(items, by).join(clash.groupBy(*by).agg(F.count("*").alias("n_conflicts")), by, "left").join(near, by, "left").join(unlike, by, "left").join(short, by, "left")
    facts = facts.withColumns({"n_conflicts": F.coalesce("n_conflicts", F.lit(0)), "nested": F.coalesce("nested", F.lit(False)), "variants": F.coalesce("variants", F.lit(False)), "truncated": F.col("cut").isNotNull()})
    facts = facts.withColumn("labels", compare.labels())
    names = [*compare.COUNTS, "tree", "multiset", "nonchart_tree", "nonchart_multiset", "path_conflict", "a_in_b", "b_in_a"]
    out = pair.join(facts.select("pair", *names, F.col("item_state"), "common", "only_a", "only_b", "labels", F.when(F.col("truncated"), "INCOMPLETE").otherwise("COMPLETE").alias("conflict_coverage")), "pair", "left").drop("pair")
    of = lambda df: df.join(F.broadcast(pair.select("pair", "a", "b")), "pair").drop("pair")

    total = sizes.count()
    if total > limits.roots:
        said.append((ROOT_LIMIT, str(total - limits.roots)))
    done = sum(p[3] == PROVEN for p in pairs)
    if done != total * (total - 1) // 2:
        said.append((PAIRS_OPEN, str(total * (total - 1) // 2 - done)))
    if cut is not None:
        said.append((CONFLICT_LIMIT, str(short.agg(F.sum("cut")).first()[0])))
    discovery = discovered(out_roots, candidates, limits) if candidates is not None else spark.createDataFrame([], "a string, b string, state string")
    over = discovery.where(F.col("state") == DISCOVERY_LIMIT).count() if candidates is not None else 0
    if over:
        said.append((DISCOVERY_LIMIT, str(over)))
    return Classification(out_roots, out, of(diff), of(groups), of(kept), discovery, spark.createDataFrame(said, "code string, key string"))


def discovered(roots: DataFrame, candidates: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """a, b, state of candidate pairs (paths) of which one side or both were not classified, in order; those beyond the
    limit keep a row that says so."""
    proven = roots.where(F.col("state") == PROVEN).select(F.col("path").alias("root"))
    pending = checkpointed(compare.pending(candidates.select("a", "b").distinct(), proven))
    over = beyond(pending, [], ["a", "b"], F.lit(1), limits.discovery_pairs)
    if over is None:
        return pending.select("a", "b", F.lit(CANDIDATE).alias("state"))
    over = over.select("a", "b", F.lit(DISCOVERY_LIMIT).alias("state"))
    return pending.join(over, ["a", "b"], "left").select("a", "b", F.coalesce("state", F.lit(CANDIDATE)).alias("state"))
