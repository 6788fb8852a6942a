"""Virtual unions of trees with a ledger that accounts for every entry, and the lattice of compatible groups of roots.

entries: root int, entry long, path, kind, digest, is_item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators.compare import folded

MAX_ROOTS = 6


def blocked_entries(entries: DataFrame, conflict_paths: DataFrame) -> DataFrame:
    """path of entries that lie at or below a path in conflict, case-blind. Ancestors are exploded and equi-joined."""
    keys = conflict_paths.select(folded(F.col("path")).alias("key")).distinct()
    up = entries.select("path").distinct().select("path", F.explode(C.ancestors(F.col("path"), own=True)).alias("up"))
    return up.withColumn("key", folded(F.col("up"))).join(keys, "key", "left_semi").select("path").distinct()


def virtual_entries(entries: DataFrame, conflict_paths: DataFrame) -> DataFrame:
    """path, kind, digest, n_sources, sources of each path that isn't blocked. Its sources, one a root, agree."""
    free = entries.join(blocked_entries(entries, conflict_paths), "path", "left_anti")
    return free.groupBy("path").agg(
        F.min("kind").alias("kind"), F.min("digest").alias("digest"), F.count("*").alias("n_sources"), F.array_sort(F.collect_list(F.struct("root", "entry"))).alias("sources")
    )


def ledger(entries: DataFrame, conflict_paths: DataFrame) -> DataFrame:
    """root, entry, path, disposition: every entry exactly once, represented or blocked."""
    held = blocked_entries(entries, conflict_paths).withColumn("_held", F.lit(True))
    return entries.join(held, "path", "left").select("root", "entry", "path", F.when(F.col("_held"), "BLOCKED_CONFLICT").otherwise("REPRESENTED_VIRTUALLY").alias("disposition"))


def plan_counts(entries: DataFrame, conflict_paths: DataFrame) -> DataFrame:
    """One row: entries, items, targets, shared, exclusive, blocked."""
    v = virtual_entries(entries, conflict_paths).agg(F.count("*").alias("targets"), F.count_if(F.col("n_sources") >= 2).alias("shared"), F.count_if(F.col("n_sources") == 1).alias("exclusive"))
    e = ledger(entries, conflict_paths).agg(F.count("*").alias("entries"), F.count_if(F.col("disposition") == "BLOCKED_CONFLICT").alias("blocked"))
    i = entries.agg(F.count_if("is_item").alias("items"))
    return e.crossJoin(i).crossJoin(v)  # aggregates without keys: one row each


def verify_plan(entries: DataFrame, virtual: DataFrame, accounts: DataFrame) -> DataFrame:
    """code, key of violations: entries without one account, represented ones without target, targets whose sources differ."""
    once = entries.select("root", "entry").join(accounts.groupBy("root", "entry").agg(F.count("*").alias("n")), ["root", "entry"], "left").where("coalesce(n, 0) <> 1")
    out = once.select(F.lit("ENTRY_NOT_ACCOUNTED_ONCE").alias("code"), F.concat_ws("/", "root", "entry").alias("key"))
    source = virtual.select("path", "kind", "digest", F.explode("sources").alias("s")).select("path", "kind", "digest", "s.root", "s.entry")
    kept = accounts.where("disposition = 'REPRESENTED_VIRTUALLY'")
    lost = kept.join(source, ["root", "entry"], "left_anti").select(F.lit("REPRESENTED_WITHOUT_TARGET"), F.concat_ws("/", "root", "entry"))
    extra = source.join(kept, ["root", "entry"], "left_anti").select(F.lit("TARGET_OF_BLOCKED_ENTRY"), F.concat_ws("/", "root", "entry"))
    e = entries.select("root", "entry", F.col("path").alias("p"), F.col("kind").alias("k"), F.col("digest").alias("d"))
    unlike = source.join(e, ["root", "entry"]).where(~F.col("path").eqNullSafe(F.col("p")) | ~F.col("kind").eqNullSafe(F.col("k")) | ~F.col("digest").eqNullSafe(F.col("d")))
    return out.union(lost).union(extra).union(unlike.select(F.lit("SOURCE_DIFFERS_FROM_TARGET"), F.concat_ws("/", "root", "entry")))


def subsets(entries: DataFrame) -> DataFrame:
    """mask, compatible for each non-empty set of roots (bit i is the i-th root in order).

    Compatible: no case-blind path with two spellings, kinds or digests among the set; every ancestor of a path is a
    folder with the same spelling; the folder "." is there. Roots are MAX_ROOTS at most, so masks are 63 at most; all
    counting is on (mask, path).
    """
    roots = [r.root for r in entries.select("root").distinct().orderBy("root").limit(MAX_ROOTS + 1).collect()]
    if not 0 < len(roots) <= MAX_ROOTS:
        raise ValueError(f"1 to {MAX_ROOTS} roots are compared, not {len(roots)}")
    bit = F.create_map(*[F.lit(x) for i, r in enumerate(roots) for x in (r, i)])
    masks = F.sequence(F.lit(1), F.lit((1 << len(roots)) - 1))
    own = entries.select("path", "kind", "digest", folded(F.col("path")).alias("key"), bit[F.col("root")].alias("bit"))
    own = own.withColumn("mask", F.explode(F.filter(masks, lambda m: F.expr("true") & (F.getbit(m, F.col("bit")) == 1))))
    of = F.struct("path", "kind", F.coalesce("digest", F.lit("")).alias("digest"))
    paths = own.groupBy("mask", "key").agg(F.min(of).alias("lo"), F.max(of).alias("hi"))
    clash = paths.where("lo <> hi").select("mask")
    up = paths.select("mask", "lo.path").select("mask", F.explode(C.ancestors(F.col("path"))).alias("up")).distinct()
    folders = paths.where("lo = hi AND lo.kind = 'DIRECTORY'").select(F.col("mask"), F.col("lo.path").alias("up"))
    orphan = up.join(folders, ["mask", "up"], "left_anti").select("mask")
    base = folders.where("up = '.'").select("mask")
    every = entries.sparkSession.range(1, 1 << len(roots)).select(F.col("id").cast("int").alias("mask"))
    bad = clash.union(orphan).union(every.join(base, "mask", "left_anti")).distinct().withColumn("bad", F.lit(True))
    return every.join(bad, "mask", "left").select("mask", F.col("bad").isNull().alias("compatible"))


def maximal(lattice: DataFrame) -> DataFrame:
    """Compatible masks that no larger compatible mask holds. 63 rows at most meet each other."""
    s = lattice.where("compatible").select("mask")
    t = s.select(F.col("mask").alias("other"))
    return s.join(F.broadcast(t), (F.col("mask") != F.col("other")) & (F.col("mask").bitwiseAND(F.col("other")) == F.col("mask")), "left_anti")


def copy_source(entries: DataFrame) -> DataFrame:
    """path, root, entry: of equivalent sources the first by root and entry."""
    return entries.groupBy("path").agg(F.min(F.struct("root", "entry")).alias("s")).select("path", "s.root", "s.entry")
