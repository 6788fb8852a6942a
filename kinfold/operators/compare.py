"""Comparison of two trees by path and by content, with conflicts and labels.

A tree is a DataFrame path, kind (DIRECTORY or REGULAR_FILE), digest, is_item and, for conflicts, native_id. Functions with
`by` compare many pairs of trees at once: both sides then have these columns, which tell the pairs apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators import budget

# What a path is in two trees.
CATEGORIES = ("SAME_FILE", "SAME_DIRECTORY", "CONTENT_CONFLICT", "FILE_ONLY_A", "FILE_ONLY_B", "DIRECTORY_ONLY_A", "DIRECTORY_ONLY_B", "KIND_CONFLICT")
COUNTS = ("same_file", "content_conflict", "file_only_a", "file_only_b", "directory_only_a", "directory_only_b", "kind_conflict")


def tree_diff(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """path, category, digests and whether each side is an item, for every path of either tree. One full outer join."""
    x = a.select(*by, "path", F.col("kind").alias("kind_a"), F.col("digest").alias("digest_a"), F.col("is_item").alias("item_a"))
    y = b.select(*by, "path", F.col("kind").alias("kind_b"), F.col("digest").alias("digest_b"), F.col("is_item").alias("item_b"))
    only = lambda k, side: F.when(F.col(k) == "DIRECTORY", f"DIRECTORY_ONLY_{side}").otherwise(f"FILE_ONLY_{side}")
    category = (
        F.when(F.col("kind_a").isNull(), only("kind_b", "B")).when(F.col("kind_b").isNull(), only("kind_a", "A"))
        .when(F.col("kind_a") != F.col("kind_b"), "KIND_CONFLICT").when(F.col("kind_a") == "DIRECTORY", "SAME_DIRECTORY")
        .when(F.col("digest_a") == F.col("digest_b"), "SAME_FILE").otherwise("CONTENT_CONFLICT")
    )
    return x.join(y, [*by, "path"], "full_outer").select(*by, "path", category.alias("category"), "kind_a", "kind_b", "digest_a", "digest_b", "item_a", "item_b")


def digest_groups(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """projection (FULL, NON_CHART), digest, count_a, count_b, different_paths.

    Both trees are stacked and grouped once; path sets are compared by counts and sums of hashes, never collected.
    """
    both = a.select(*by, "path", "digest", "kind", "is_item", F.lit(0).alias("side")).unionByName(b.select(*by, "path", "digest", "kind", "is_item", F.lit(1).alias("side")))
    files = both.where("kind = 'REGULAR_FILE'").withColumn("projection", F.explode(F.when(F.col("is_item"), F.array(F.lit("FULL"))).otherwise(F.array(F.lit("FULL"), F.lit("NON_CHART")))))
    h = lambda seed: F.xxhash64(F.lit(seed), "path").cast("decimal(38,0)")
    of = lambda side, v: F.coalesce(F.sum(F.when(F.col("side") == side, v)), F.lit(0))
    g = files.groupBy(*by, "projection", "digest").agg(
        F.count_if(F.col("side") == 0).alias("count_a"), F.count_if(F.col("side") == 1).alias("count_b"),
        ((of(0, h(1)) != of(1, h(1))) | (of(0, h(2)) != of(1, h(2)))).alias("unlike"),
    )
    return g.select(*by, "projection", "digest", "count_a", "count_b", ((F.col("count_a") != F.col("count_b")) | F.col("unlike")).alias("different_paths"))


def difference_counts(diff: DataFrame) -> DataFrame:
    return diff.agg(*[F.count_if(F.col("category") == c.upper()).alias(c) for c in COUNTS])


def joined(one: DataFrame, two: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two aggregates by the same keys side by side; without keys they are one row each."""
    return one.join(two, list(by), "full_outer") if by else one.crossJoin(two)


def pair_flags(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or one for each key of `by` with an entry: tree, multiset, nonchart_tree, nonchart_multiset, path_conflict, fileset_variant. Empty trees are equal."""
    d = tree_diff(a, b, by)
    item = F.coalesce("item_a", F.lit(False)), F.coalesce("item_b", F.lit(False))
    file_a, file_b = (F.col(f"kind_{s}") == "REGULAR_FILE" for s in "ab")
    plain_a, plain_b = F.coalesce(file_a & ~item[0], F.lit(False)), F.coalesce(file_b & ~item[1], F.lit(False))
    dir_a, dir_b = F.coalesce(F.col("kind_a") == "DIRECTORY", F.lit(False)), F.coalesce(F.col("kind_b") == "DIRECTORY", F.lit(False))
    same_plain = (plain_a == plain_b) & (~plain_a | F.coalesce(F.col("digest_a") == F.col("digest_b"), F.lit(False)))
    one = d.groupBy(*by).agg(
        F.coalesce(F.every(F.col("category").isin("SAME_FILE", "SAME_DIRECTORY")), F.lit(True)).alias("tree"),
        F.coalesce(F.every((dir_a == dir_b) & same_plain), F.lit(True)).alias("nonchart_tree"),
        F.coalesce(F.some(F.col("category").isin("CONTENT_CONFLICT", "KIND_CONFLICT")), F.lit(False)).alias("path_conflict"),
    )
    even = lambda p: F.coalesce(F.every((F.col("projection") != p) | (F.col("count_a") == F.col("count_b"))), F.lit(True))
    two = digest_groups(a, b, by).groupBy(*by).agg(even("FULL").alias("multiset"), even("NON_CHART").alias("nonchart_multiset"))
    sure = lambda c: F.coalesce(c, F.lit(True)).alias(c)  # noqa: E731  # trees without files
    return joined(one, two, by).select(*by, "tree", sure("multiset"), "nonchart_tree", sure("nonchart_multiset"), "path_conflict", (~F.col("tree")).alias("fileset_variant"))


def item_set_state(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row: state of the two sets of item contents, and the sizes of the common part and of both rests. With `by` a
    row for each key that has an entry, and the state is called item_state."""
    item = F.when(F.col("is_item"), F.col("digest"))
    both = a.select(*by, item.alias("digest"), F.lit(1).alias("s")).union(b.select(*by, item.alias("digest"), F.lit(2).alias("s"))).distinct()
    s = both.groupBy(*by, "digest").agg(F.sum("s").alias("s"))
    s = s.groupBy(*by).agg(*[F.count_if((F.col("s") == k) & F.col("digest").isNotNull()).alias(n) for k, n in ((3, "common"), (1, "only_a"), (2, "only_b"))])
    c, x, y = F.col("common"), F.col("only_a"), F.col("only_b")
    state = (
        F.when((x == 0) & (y == 0), "CHART_SET_EXACT").when((c + x == 0) | (c + y == 0), "CHART_SET_DISJOINT").when(x == 0, "CHART_SET_SUBSET_A_IN_B")
        .when(y == 0, "CHART_SET_SUBSET_B_IN_A").when(c > 0, "CHART_SET_PARTIAL_OVERLAP").otherwise("CHART_SET_DISJOINT")
    )
    return s.select(*by, state.alias("item_state" if by else "state"), "common", "only_a", "only_b")


def folded(path):
    """Case-blind key of a path: simple upper case for ASCII; other letters whose upper case is longer stay."""
    return F.array_join(F.transform(F.split(path, ""), lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(c)), "")


def case_collisions(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """key, spellings: paths that differ only in case."""
    g = entries.select(*by, "path").distinct().withColumn("key", folded(F.col("path"))).groupBy(*by, "key").agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))
    return g.where("n > 1").select(*by, "key", F.col("n").alias("spellings"), "first", "last")


def alias_conflicts(entries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """native_id with more than one digest: one file of the system that was read with different bytes."""
    files = entries.where("kind = 'REGULAR_FILE' AND native_id IS NOT NULL")
    return files.groupBy(*by, "native_id").agg(F.count_distinct("digest").alias("digests"), F.min("path").alias("path")).where("digests > 1")


def conflicts(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """path, kinds: content and kind conflicts of the paths, case collisions, and aliases where native_id is given."""
    d = tree_diff(a, b, by)
    extra = F.when(F.col("item_a") != F.col("item_b"), F.array(F.lit("CHART_RESOURCE_PATH_CONFLICT"))).when(~F.col("item_a"), F.array(F.lit("RESOURCE_VARIANT"))).otherwise(F.array().cast("array<string>"))
    content = d.where("category = 'CONTENT_CONFLICT'").select(*by, "path", F.concat(F.array(F.lit("SAME_RELATIVE_PATH_DIFFERENT_BYTES")), extra).alias("kinds"))
    kind = d.where("category = 'KIND_CONFLICT'").select(*by, "path", F.array(F.lit("FILE_DIRECTORY_KIND_CONFLICT")).alias("kinds"))
    both = a.select(*by, "path").union(b.select(*by, "path"))
    out = content.union(kind).union(case_collisions(both, by).select(*by, "first", F.array(F.lit("CASE_COLLISION"))))
    if "native_id" in a.columns and "native_id" in b.columns:
        columns = [*by, "path", "kind", "digest", "native_id"]
        out = out.union(alias_conflicts(a.select(columns).union(b.select(columns)), by).select(*by, "path", F.array(F.lit("POTENTIAL_NATIVE_ALIAS_CONFLICT"))))
    return out


def label_facts(diff: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of a tree_diff(): a_in_b, b_in_a, plain_differs (an entry that is no item differs), and the COUNTS."""
    same = F.col("category").isin("SAME_FILE", "SAME_DIRECTORY")
    inside = lambda s: F.coalesce(F.every(same | F.col("category").isin(f"FILE_ONLY_{s}", f"DIRECTORY_ONLY_{s}")), F.lit(True))
    plain = F.coalesce(((F.col("kind_a") == "REGULAR_FILE") & ~F.col("item_a")), F.lit(False)) | F.coalesce(((F.col("kind_b") == "REGULAR_FILE") & ~F.col("item_b")), F.lit(False))
    return diff.groupBy(*by).agg(inside("B").alias("a_in_b"), inside("A").alias("b_in_a"), F.coalesce(F.some(~same & plain), F.lit(False)).alias("plain_differs"), *[F.count_if(F.col("category") == c.upper()).alias(c) for c in COUNTS])


def labels():
    """The labels of a pair in their fixed order, from columns of label_facts(), pair_flags(), item_state, n_conflicts,
    variants (bindings differ), nested (one root lies in the other) and truncated (not all conflicts are listed)."""
    c = F.col
    unlike = (c("item_state") == "CHART_SET_EXACT") & c("plain_differs")
    told = [
        (c("tree"), "OBSERVATION_TREE_EXACT"),
        (c("multiset") & ~c("tree"), "CONTENT_MULTISET_EXACT_WITH_PATH_VARIANTS"),
        (unlike, "CHART_EXACT_WITH_NONCHART_DIFFERENCES"),
        (unlike & c("variants"), "CHART_EXACT_POTENTIAL_REFERENCED_RESOURCE_VARIANT"),
        (~c("tree") & c("a_in_b"), "OBSERVED_TREE_SUBSET_A_IN_B"),
        (~c("tree") & c("b_in_a"), "OBSERVED_TREE_SUBSET_B_IN_A"),
        ((c("file_only_a") > 0) & (c("file_only_b") > 0) & ~c("path_conflict") & (c("n_conflicts") == 0) & ~c("truncated"), "OBSERVED_COMPLEMENTARY_CONTENT"),
        (c("content_conflict") > 0, "HARD_PATH_CONTENT_CONFLICT"),
        (c("kind_conflict") > 0, "HARD_PATH_KIND_CONFLICT"),
        (c("nested"), "NESTED_OBSERVATION_ROOTS"),
        (c("truncated"), "CONFLICT_ENUMERATION_INCOMPLETE"),
    ]
    return F.array_compact(F.array(*[F.when(holds, F.lit(x)) for holds, x in told]))


def pair_labels(a: DataFrame, b: DataFrame, variants: bool = False, nested: bool = False, max_conflicts: int | None = None) -> DataFrame:
    """One row: labels of two trees, in their fixed order."""
    n = conflicts(a, b).agg(F.count("*").alias("n_conflicts"))
    # aggregates without keys: one row each
    one = label_facts(tree_diff(a, b)).crossJoin(pair_flags(a, b)).crossJoin(item_set_state(a, b).select(F.col("state").alias("item_state"))).crossJoin(n)
    most = F.lit(False) if max_conflicts is None else F.col("n_conflicts") > max_conflicts
    return one.withColumns({"variants": F.lit(variants), "nested": F.lit(nested), "truncated": most}).select(labels().alias("labels"))


def revalidated(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """path, state of items as recorded and as read now: MATCH, CHANGED, MISSING, UNEXPECTED, UNKNOWN (a digest is missing)."""
    e = expected.select("path", F.col("digest").alias("expected"), F.lit(True).alias("_e"))
    o = observed.select("path", F.col("digest").alias("observed"), F.lit(True).alias("_o"))
    state = (
        F.when(F.col("_o").isNull(), "MISSING").when(F.col("_e").isNull(), "UNEXPECTED")
        .when(F.col("expected").isNull() | F.col("observed").isNull(), "UNKNOWN").when(F.col("expected") == F.col("observed"), "MATCH").otherwise("CHANGED")
    )
    return e.join(o, "path", "full_outer").select("path", "expected", "observed", state.alias("state"))


def sequence_differences(a: DataFrame, b: DataFrame, order: list[str]) -> DataFrame:
    """place, and a struct of each side's row, where two sequences differ: empty if both have the same rows in the same order.

    Rows are numbered in the given order by running counts, then joined by place; no task sees a whole sequence. The
    columns of `order` say where a row stands and are not compared; rows equal in them should be equal.
    """
    columns = [c for c in a.columns if c not in order]
    at = lambda df, side: budget.running(df.select(*order, *columns), [], order, F.lit(1)).select(F.col("upto").alias("place"), F.struct(*columns).alias(side))
    return at(a, "a").join(at(b, "b"), "place", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def root_pairs(roots: DataFrame) -> DataFrame:
    """component, a, b: every two roots of a component, a < b; the pairs that are to be compared, by an equi-join."""
    return roots.select("component", F.col("root").alias("a")).join(roots.select("component", F.col("root").alias("b")), "component").where("a < b")


def binding_variants(a: DataFrame, b: DataFrame) -> DataFrame:
    """key of references that both sides bind, to different sets of targets. a, b: key, target.

    Sets are compared by their sizes and sums of hashes, added up map-side.
    """
    both = a.select("key", "target", F.lit(0).alias("s")).union(b.select("key", "target", F.lit(1).alias("s"))).distinct()
    h = lambda seed: F.xxhash64(F.lit(seed), "target").cast("decimal(38,0)")
    of = lambda s, v: F.sum(F.when(F.col("s") == s, v))
    g = both.groupBy("key").agg(F.count_if(F.col("s") == 0).alias("na"), F.count_if(F.col("s") == 1).alias("nb"), (of(0, h(1)) != of(1, h(1))).alias("d1"), (of(0, h(2)) != of(1, h(2))).alias("d2"))
    return g.where("na > 0 AND nb > 0 AND (na <> nb OR d1 OR d2)").select("key")


def pending(pairs: DataFrame, proven: DataFrame) -> DataFrame:
    """Pairs a, b of which one side or both were not physically proven. proven: root."""
    p = proven.select(F.col("root").alias("_r")).distinct()
    both = pairs.join(p, F.col("a") == F.col("_r"), "left_semi").join(p, F.col("b") == F.col("_r"), "left_semi").select("a", "b")
    return pairs.join(both, ["a", "b"], "left_anti")


def nested_roots(roots: DataFrame) -> DataFrame:
    """outer, inner: roots (path) of which one lies inside the other, by ancestors and an equi-join."""
    from kinfold.functions import columns as C

    up = roots.select(F.col("path").alias("inner"), F.explode(C.ancestors(F.col("path"))).alias("outer"))
    return up.join(roots.select(F.col("path").alias("outer")), "outer").select("outer", "inner")


def outcomes(problems: DataFrame, membership: DataFrame, rank: dict[str, int]) -> DataFrame:
    """component, outcome: the worst outcome of any problem of an entry that a root of the component holds.

    problems: entry, outcome. membership: component, root, entry. A worse outcome is never taken back by a better one.
    """
    order = F.create_map(*[x for k, v in rank.items() for x in (F.lit(k), F.lit(v))])
    hit = membership.join(problems, "entry")
    worst = hit.groupBy("component").agg(F.max_by("outcome", order[F.col("outcome")]).alias("outcome"))
    return membership.select("component").distinct().join(worst, "component", "left").select("component", F.coalesce("outcome", F.lit("ADMITTED")).alias("outcome"))


def stage_outcomes(stage: str, roots: DataFrame, entries: DataFrame, reads: DataFrame, verified: DataFrame, state: str) -> DataFrame:
    """root, outcome, entries, required, successful of a stage (PREFLIGHT or CONTENT) that ended in `state`.

    roots: root. entries: root, entry, kind. reads: entry, status (of charts in PREFLIGHT). verified: root.
    """
    good = reads.where("status = 'SUCCESS'").select("entry").distinct().withColumn("good", F.lit(True))
    file = F.col("kind") == "REGULAR_FILE"
    counted = file & F.col("good") if stage == "CONTENT" else F.col("good")
    n = entries.join(good, "entry", "left").groupBy("root").agg(F.count("*").alias("entries"), F.count_if(file).alias("required"), F.count_if(counted).alias("successful"))
    out = roots.select("root").distinct().join(n, "root", "left").fillna(0, ["entries", "required", "successful"])
    out = out.join(verified.select("root").distinct().withColumn("ok", F.lit(True)), "root", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))
    if stage == "CONTENT":
        outcome = F.lit(state) if state in ("STALE", "CANCELLED", "FAILED", "BLOCKED") else F.when(F.col("ok") & (F.col("successful") == F.col("required")), "COMPLETE").otherwise("INCOMPLETE")
    else:
        outcome = F.when(F.col("ok") & F.lit(state == "INCOMPLETE"), "COMPLETE").otherwise(state)
    return out.select("root", outcome.alias("outcome"), "entries", "required", "successful")
