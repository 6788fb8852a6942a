"""Integrity rules as queries that return violating rows, reconciliation of reports, canonical seals."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.functions import columns as C

PRECEDENCE = ("INVALID", "SCOPE_CHANGED", "RESOURCE_LIMIT")


def findings(df: DataFrame, kind: str, code: str, key: str, violated) -> DataFrame:
    return df.where(violated).select(F.lit(kind).alias("kind"), F.lit(code).alias("code"), F.col(key).cast("string").alias("key"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def item_rules(items: DataFrame) -> DataFrame:
    """Rows of the index that break a rule: digests, status against digest, sizes, instants, names, spelling of containers."""
    ok = F.col("status") == "OK"
    rules = [
        ("DIGEST_FORMAT", F.col("content_id").isNotNull() & ~C.is_digest(F.col("content_id"))),
        ("OK_WITHOUT_DIGEST", ok & F.col("content_id").isNull()),
        ("NEGATIVE_SIZE", F.col("size") < 0),
        ("SEEN_BEFORE_FIRST", F.col("last_seen") < F.col("first_seen")),
        ("ABSENT_BUT_OK", ~F.col("present") & ok),
        ("STATUS_UNKNOWN", ~F.col("status").isin("OK", "ERROR", "UNSTABLE", "MISSING", "UNVERIFIED", "INACTIVE")),
        ("OUTSIDE_CONTAINER", C.parent(F.col("path")) != F.col("container")),
    ]
    # one pass over the index: each row names the rules it breaks
    broken = F.array_compact(F.array(*[F.when(v, F.lit(c)) for c, v in rules]))
    return items.select(F.lit("INVALID").alias("kind"), F.explode(broken).alias("code"), F.col("path").alias("key"))


def digest_sizes(items: DataFrame) -> DataFrame:
    """Digests under which different sizes were recorded."""
    return items.where("content_id IS NOT NULL").groupBy("content_id").agg(F.min("size").alias("lo"), F.max("size").alias("hi")).where("lo <> hi")


def duplicate_keys(df: DataFrame, *key: str) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows of child whose key no row of parent has."""
    return child.join(parent.select(F.col(parent_key).alias("_k")).distinct(), F.col(child_key) == F.col("_k"), "left_anti")


def transitions(log: DataFrame) -> DataFrame:
    """Steps of a run's state (run_id, step, state) that aren't allowed: out of RUNNING only, into an end only."""
    from pyspark.sql import Window

    before = F.lag("state").over(Window.partitionBy("run_id").orderBy("step"))
    bad = F.when(F.col("_b").isNull(), F.col("state") != "RUNNING").otherwise((F.col("_b") != "RUNNING") | ~F.col("state").isin("COMPLETED", "FAILED", "CANCELLED", "STALE"))
    return log.withColumn("_b", before).where(bad).drop("_b")


def coverage_gaps(expected: DataFrame, outcomes: DataFrame, comparisons: DataFrame) -> DataFrame:
    """component of what is not complete: a root without outcome, or not n (n - 1) / 2 comparisons for n roots.

    expected and outcomes: component, root. comparisons: component, a, b.
    """
    missing = expected.join(outcomes, ["component", "root"], "left_anti").select("component", F.lit("ROOT_WITHOUT_OUTCOME").alias("code"))
    n = expected.groupBy("component").agg(F.count("*").alias("n")).join(comparisons.groupBy("component").agg(F.count("*").alias("c")), "component", "left")
    short = n.where(F.coalesce("c", F.lit(0)) != F.expr("n * (n - 1) div 2")).select("component", F.lit("PAIRS_INCOMPLETE").alias("code"))
    return missing.union(short).distinct()


def reconcile(report: DataFrame, derived: DataFrame) -> DataFrame:
    """Rows on one side only, multiplicity included, with side: empty if a report says what the index says."""
    c = derived.columns
    return report.select(c).exceptAll(derived).withColumn("side", F.lit("REPORT")).unionByName(derived.exceptAll(report.select(c)).withColumn("side", F.lit("DERIVED")))


def worst(found: DataFrame) -> DataFrame:
    """The finding that decides: invalid before changed scope before a limit, then by code and key."""
    rank = reduce(lambda w, kv: w.when(F.col("kind") == kv[1], kv[0]), list(enumerate(PRECEDENCE)), F.when(F.lit(False), 0)).otherwise(len(PRECEDENCE))
    return found.orderBy(rank, "code", "key").limit(1)


def bounded(found: DataFrame, cap: int, *order: str) -> DataFrame:
    """The first cap - 1 rows and, if there are more than cap, a row that says so. The rest is counted, never silent."""
    n = found.count()
    if n <= cap:
        return found
    head = found.orderBy(*order).limit(cap - 1)
    return head.unionByName(found.sparkSession.createDataFrame([("RESOURCE_LIMIT", "FINDINGS_TRUNCATED", str(n - cap + 1))], head.select("kind", "code", "key").schema), allowMissingColumns=True)


def row_tokens(df: DataFrame, fields: list[str]):
    """Canonical bytes of each row: name and value of every field."""
    parts = []
    for f in fields:
        kind = df.schema[f].dataType.typeName()
        value = F.when(F.col(f), "true").when(~F.col(f), "false") if kind == "boolean" else F.col(f).cast("string")
        parts += [C.token(F.lit(f)), C.token(value)]
    return F.concat(*parts)


def canonical_bytes(domain: str, groups: list[tuple[str, list[str], list[dict]]]) -> bytes:
    """Pre-image of a seal: domain, then for each group its name, rows, fields, and names and cells of each row."""

    def t(x) -> bytes:
        if x is None:
            return b"\xff\xff\xff\xff"
        raw = ("true" if x is True else "false" if x is False else str(x)).encode()
        return len(raw).to_bytes(4, "big") + raw

    out = [t(domain)]
    for name, fields, rows in groups:
        out += [t(name), t(len(rows)), t(len(fields))]
        out += [t(v) for r in rows for f in fields for v in (f, r[f])]
    return b"".join(out)


def seal_small(domain: str, groups: list[tuple[str, list[str], list[dict]]]) -> str:
    return hashlib.sha256(canonical_bytes(domain, groups)).hexdigest()


def chained(records: DataFrame) -> DataFrame:
    """Records (name, parent, digest, payload) whose parent no record has as digest, or whose digest isn't that of payload."""
    known = records.select(F.col("digest").alias("_d")).distinct()
    lost = records.where("parent IS NOT NULL").join(known, F.col("parent") == F.col("_d"), "left_anti").select("name", F.lit("PARENT_UNKNOWN").alias("code"))
    want = F.sha2(F.concat(C.token(F.col("name")), C.token(F.col("parent")), C.token(F.col("payload"))), 256)
    return lost.union(records.where(want != F.col("digest")).select("name", F.lit("DIGEST_MISMATCH").alias("code")))
