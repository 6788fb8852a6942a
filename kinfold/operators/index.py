"""The incremental index: a scan merged with the index of the run before it. Indexes are written once, never updated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import columns as C

# What a scan counts.
COUNTERS = ("discovered", "reused", "hashed", "new", "changed", "missing", "errored", "unstable")


def merge(index: DataFrame, seen: DataFrame, run_id: int, rehash: bool = False, active_roots: DataFrame | None = None, blocked: DataFrame | None = None) -> DataFrame:
    """The index after a run, one row for each path ever known, with `outcome` and `counted`.

    index: path, root, size, mtime, content_id, status, first_seen, last_seen, present, and maybe more columns. seen:
    path, root, size, mtime, content_id (as read now; used where the old one can't be), maybe status (OK, ERROR,
    UNSTABLE) and the same further columns, which come from the scan where it has the row. outcome: REUSED (size and
    time as before, digest kept), NEW, CHANGED (digest differs), HASHED (read again, same digest), MISSING, UNVERIFIED
    (below a blocked folder), INACTIVE (root no longer scanned). counted: the COUNTERS that the row adds to; a new file
    is new and hashed, a changed stamp is changed whatever the digest, only what was present can be missing.
    first_seen stays. One full outer join on the path.
    """
    base = ("path", "root", "size", "mtime", "content_id")
    more = [c for c in seen.columns if c not in base and c != "status" and c in index.columns]
    o = index.select(*[F.col(c).alias(f"o_{c}") for c in (*base, "status", "first_seen", "last_seen", "present", *more)])
    state = F.col("status") if "status" in seen.columns else F.when(F.col("content_id").isNull(), "ERROR").otherwise("OK")
    s = seen.select(*[F.col(c).alias(f"s_{c}") for c in (*base, *more)], state.alias("s_status"))
    j = s.join(o, F.col("s_path") == F.col("o_path"), "full_outer")
    here, known = F.col("s_path").isNotNull(), F.col("o_path").isNotNull()
    stamp = F.col("s_size").eqNullSafe(F.col("o_size")) & F.col("s_mtime").eqNullSafe(F.col("o_mtime"))
    reuse = here & known & stamp & (F.col("o_status") == "OK") & F.col("o_content_id").isNotNull() & F.lit(not rehash)
    active, held = F.lit(True), F.lit(False)
    if active_roots is not None:
        j = j.join(active_roots.select(F.col("root").alias("a_root")).distinct(), F.coalesce("s_root", "o_root") == F.col("a_root"), "left")  # the configured roots
        active = F.col("a_root").isNotNull()
    if blocked is not None:  # of unseen rows alone, whose paths then go back to them
        unseen = index.select("path").join(seen.select("path"), "path", "left_anti")
        up = unseen.select("path", F.explode(C.ancestors(F.col("path"), own=True)).alias("_up"))
        below = up.join(blocked.select(F.col("blocked").alias("_up")).distinct(), "_up", "left_semi").select(F.col("path").alias("_held")).distinct()
        j = j.join(below, F.col("o_path") == F.col("_held"), "left")
        held = F.col("_held").isNotNull()
    outcome = (
        F.when(~active, "INACTIVE").when(here & ~known, "NEW").when(reuse, "REUSED")
        .when(here & ~F.col("s_content_id").eqNullSafe(F.col("o_content_id")), "CHANGED").when(here, "HASHED").when(held, "UNVERIFIED").otherwise("MISSING")
    )
    digest = F.when(reuse, F.col("o_content_id")).otherwise(F.when(here, F.col("s_content_id")).otherwise(F.col("o_content_id")))
    now = active & here
    counts = {
        "discovered": now, "reused": active & reuse, "hashed": now & ~reuse & (F.col("s_status") == "OK"), "new": now & ~known, "changed": now & known & ~stamp,
        "missing": active & ~here & F.col("o_present") & ~held, "errored": now & ~reuse & (F.col("s_status") != "OK"), "unstable": now & ~reuse & (F.col("s_status") == "UNSTABLE"),
    }
    j = j.withColumn("outcome", outcome)
    status = F.when(F.col("outcome").isin("MISSING", "UNVERIFIED", "INACTIVE"), F.col("outcome")).when(reuse, "OK").otherwise(F.col("s_status"))
    return j.select(
        F.coalesce("s_path", "o_path").alias("path"), F.coalesce("s_root", "o_root").alias("root"), F.coalesce("s_size", "o_size").alias("size"), F.coalesce("s_mtime", "o_mtime").alias("mtime"),
        digest.alias("content_id"), *[F.when(here & ~reuse, F.col(f"s_{c}")).otherwise(F.col(f"o_{c}")).alias(c) for c in more], status.alias("status"), F.coalesce("o_first_seen", F.lit(run_id)).alias("first_seen"),
        F.when(here, F.lit(run_id)).otherwise(F.col("o_last_seen")).alias("last_seen"), F.col("outcome").isin("NEW", "REUSED", "CHANGED", "HASHED").alias("present"), "outcome",
        F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in counts.items()])).alias("counted"),
    )


def statistics(merged: DataFrame) -> DataFrame:
    """One row of the COUNTERS; a row of the index may add to several."""
    return merged.agg(*[F.count_if(F.array_contains("counted", x)).alias(x) for x in COUNTERS])


def latest_completed(runs: DataFrame) -> DataFrame:
    """The last run that ended well; runs without an end are ignored."""
    return runs.where("status = 'COMPLETED'").orderBy(F.desc("run_id")).limit(1)


def with_interrupted(runs: DataFrame) -> DataFrame:
    """Runs that still say RUNNING when a new one begins have failed."""
    return runs.withColumn("status", F.when(F.col("status") == "RUNNING", "FAILED").otherwise(F.col("status")))
