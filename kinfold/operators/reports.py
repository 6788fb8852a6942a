"""Report sets of an observation: what its roots hold, what both share, how reads and comparisons went, and what was diagnosed.

Entries are rows root, path, kind, size and more; a path that several roots hold is one entry by `entry` where that is given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import compare


def root_inventory(entries: DataFrame) -> DataFrame:
    """root, files, directories, bytes of each root."""
    file = F.col("kind") == "REGULAR_FILE"
    return entries.groupBy("root").agg(F.count_if(file).alias("files"), F.count_if(F.col("kind") == "DIRECTORY").alias("directories"), F.coalesce(F.sum(F.when(file, F.col("size"))), F.lit(0)).alias("bytes"))


def shared_paths(entries: DataFrame, entry: str = "path") -> DataFrame:
    """One row: shared, the entries that more than one root holds, and union_bytes, the bytes of all with each counted once."""
    one = entries.groupBy(entry).agg(F.count_distinct("root").alias("n"), F.min("size").alias("size"))
    return one.agg(F.count_if(F.col("n") > 1).alias("shared"), F.coalesce(F.sum("size"), F.lit(0)).alias("union_bytes"))


def extension_distribution(entries: DataFrame) -> DataFrame:
    """extension, files, bytes over all regular files."""
    files = entries.where("kind = 'REGULAR_FILE'")
    return files.groupBy(C.extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def diagnostic_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity", "code").agg(F.count("*").alias("n"))


def read_counts(reads: DataFrame) -> DataFrame:
    """One row: admitted, complete and incomplete files, and the bytes read of the complete ones. reads: admitted, status, bytes."""
    done = F.col("admitted") & (F.col("status") == "SUCCESS")
    return reads.agg(F.count_if("admitted").alias("admitted"), F.count_if(done).alias("complete"), F.count_if(F.col("admitted") & (F.col("status") != "SUCCESS")).alias("incomplete"), F.coalesce(F.sum(F.when(done, F.col("bytes"))), F.lit(0)).alias("bytes"))


def outcome_entries(reads: DataFrame, outcomes: dict[str, Column], by: str = "group") -> DataFrame:
    """One row: for each name the groups with a read that fulfils its condition, counted once each, and groups in all."""
    own = reads.where(F.col(by).isNotNull()).groupBy(by).agg(*[F.bool_or(cond).alias(name) for name, cond in outcomes.items()])
    return own.agg(*[F.count_if(name).alias(name) for name in outcomes], F.count("*").alias("groups"))


def projections(entries: DataFrame) -> DataFrame:
    """projection (FULL, NON_CHART), n: the files that each counts."""
    files = entries.where("kind = 'REGULAR_FILE'")
    return files.select(F.explode(F.when(F.col("is_item"), F.array(F.lit("FULL"))).otherwise(F.array(F.lit("FULL"), F.lit("NON_CHART")))).alias("projection")).groupBy("projection").agg(F.count("*").alias("n"))


def diagnostic_rows(diagnostics: DataFrame, components: DataFrame, roots: DataFrame, entries: DataFrame, physical: DataFrame) -> DataFrame:
    """component_key, root_key, entry_key, physical_path_key with the columns of each diagnostic, unknown ids as null.

    diagnostics: component_id, root_id, entry_id, physical_file_id, any of them null, and more. components: component_id,
    component_key. roots: root_id, root_key. entries: entry_id, entry_key; joined twice, by the diagnostic's entry and by
    that of its physical file (physical: physical_file_id, entry_id). Five joins by equal ids; null ids meet nothing.
    """
    ids = ["component_id", "root_id", "entry_id", "physical_file_id"]
    behind = physical.join(entries.select("entry_id", F.col("entry_key").alias("physical_path_key")), "entry_id", "left").select("physical_file_id", "physical_path_key")
    out = diagnostics.join(components.select("component_id", "component_key"), "component_id", "left").join(roots.select("root_id", "root_key"), "root_id", "left")
    out = out.join(entries.select("entry_id", "entry_key"), "entry_id", "left").join(behind, "physical_file_id", "left")
    return out.select("component_key", "root_key", "entry_key", "physical_path_key", *[c for c in diagnostics.columns if c not in ids])


def emitted(parts: dict[str, DataFrame], parents: DataFrame) -> DataFrame:
    """gate, severity, code, path, parent of the diagnostics of each gate (severity, code, path), with the entry above the
    path that parents (path) knows, the nearest."""
    all_ = None
    for gate, df in parts.items():
        own = df.select(F.lit(gate).alias("gate"), "severity", "code", "path")
        all_ = own if all_ is None else all_.unionByName(own)
    up = all_.select("path").distinct().withColumn("parent", F.explode(C.ancestors(F.col("path"))))
    near = up.join(parents.select(F.col("path").alias("parent")).distinct(), "parent", "left_semi").groupBy("path").agg(F.max_by("parent", F.length("parent")).alias("parent"))
    return all_.join(near, "path", "left").select("gate", "severity", "code", "path", "parent")


def scope_violations(components: DataFrame, required: DataFrame, results: DataFrame, outcomes: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """code, key of what breaks the scope of a content stage; no rows if all holds.

    components: component, outcome (ADMITTED or another). required: component, file, size, mtime - files that an admitted
    component needs. results: file, status, before_size, before_mtime. outcomes: component, outcome, required,
    successful, eligible. diagnostics: component, file, either null. The rules: results only of required files; those
    that succeeded have the stamps that were accepted; outcomes for admitted components, one each; their counts are those of
    the files; only complete ones are eligible; diagnostics name what is in scope.
    """
    admitted = components.where("outcome = 'ADMITTED'").select("component").distinct()
    files = required.join(admitted, "component", "left_semi")
    scope = files.select("file").distinct()
    n = files.join(results.select("file", "status"), "file", "left").groupBy("component").agg(F.count_distinct("file").alias("n"), F.count_distinct(F.when(F.col("status") == "SUCCESS", F.col("file"))).alias("good"))
    told = outcomes.join(n, "component", "left")
    rule = lambda df, code, key: df.select(F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))
    stamps = results.where("status = 'SUCCESS'").join(files.select("file", "size", "mtime").distinct(), "file")
    parts = [
        rule(results.join(scope, "file", "left_anti"), "CONTENT_SCOPE", "file"),
        rule(stamps.where("NOT (before_size <=> size AND before_mtime <=> mtime)"), "CONTENT_STAMP", "file"),
        rule(outcomes.join(admitted, "component", "left_anti"), "OUTCOME_SCOPE", "component"),
        rule(outcomes.groupBy("component").agg(F.count("*").alias("rows")).where("rows > 1"), "OUTCOME_REPEATED", "component"),
        rule(admitted.join(outcomes, "component", "left_anti"), "OUTCOME_MISSING", "component"),
        rule(told.where("n IS NOT NULL AND NOT (required <=> n AND successful <=> good)"), "OUTCOME_COUNT", "component"),
        rule(told.where("eligible AND NOT (outcome = 'COMPLETE' AND required = successful)"), "COMPARISON_ELIGIBILITY", "component"),
        rule(diagnostics.where("component IS NOT NULL").join(components, "component", "left_anti"), "DIAGNOSTIC_SCOPE", "component"),
        rule(diagnostics.where("file IS NOT NULL").join(scope, "file", "left_anti"), "DIAGNOSTIC_SCOPE", "file"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def preflight_set(entries: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """The tables of a PREFLIGHT report by file name, with their order."""
    return {
        "roots.csv": (root_inventory(entries), ("root",)),
        "inventory.csv": (entries.select("root", "path", "kind", "size", "mtime_ns", "is_item", "native_id"), ("root", "path")),
        "extensions.csv": (extension_distribution(entries), ("extension",)),
    }


def content_set(a: DataFrame, b: DataFrame) -> dict[str, tuple[DataFrame, tuple[str, ...]]]:
    """The tables that a CONTENT report adds: every path of both roots compared, and the contents by how often each has them."""
    diff = compare.tree_diff(a, b)
    return {
        "folder_comparisons.csv": (diff, ("path",)),
        "content_groups.csv": (compare.digest_groups(a, b), ("projection", "digest")),
        "comparison_counts.csv": (compare.difference_counts(diff), compare.COUNTS[:1]),
        "conflicts.csv": (compare.conflicts(a, b).select("path", F.array_join("kinds", " ").alias("kinds")), ("path", "kinds")),
    }
