"""Relations between containers by the items they share: duplicates, set overlap, labels, clusters, summaries."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.functions import columns as C

#: Blocked by default beyond this many contributions of pairs, as the expansion grows with the square of a group.
MAX_PAIR_WORK = 10_000_000_000
#: Contributions of pairs that one task of the join makes, about, and containers of a content on one side of a cell.
TASK_WORK, BLOCK = 2_000_000, 2_048
#: Rows of a table that is broadcast, at most.
BROADCAST = 200_000


class PairBudgetExceeded(RuntimeError):
    """The join on shared items would make more rows than allowed; nothing was expanded or dropped."""


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that checkpoints go to; one of our own where it is unset."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        where = sc.getConf().get("spark.checkpoint.dir")
        if not where and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="kinfold-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """df stored in the shared folder of spark.checkpoint.dir; a folder of our own only where it is unset."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df stored as Parquet in the shared folder, in less room than a checkpoint takes; its rows come back in any partitions."""
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_not(df: DataFrame) -> DataFrame:
    """df, stored before, with a broadcast hint if it has at most BROADCAST rows by count; beyond that Spark joins by shuffle and splits skewed keys."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def eligible(items: DataFrame) -> DataFrame:
    """Items that were read well: present, status OK, with a content id."""
    return items.where("present AND status = 'OK' AND content_id IS NOT NULL")


def blocked_paths(diagnostics: DataFrame) -> DataFrame:
    """Folders that a scan could not read whole: a folder's own path, or the folder of an entry that failed."""
    path = F.when(F.col("code").isin("DIRECTORY_UNREADABLE", "REPARSE_SKIPPED"), F.col("path")).when(F.col("code").isin("ENTRY_METADATA", "CHART_READ", "CHART_UNSTABLE"), C.parent(F.col("path")))
    return diagnostics.select(path.alias("blocked")).where("blocked IS NOT NULL").distinct()


def incomplete_containers(items: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """Containers with a present item that isn't OK, or at or below a blocked folder.

    Containment is an equi-join on the ancestors of each container, not a comparison of all with all.
    """
    bad = items.where("present AND status <> 'OK'").select("container").distinct()
    if diagnostics is None:
        return bad
    up = items.where("present").select("container").distinct().select("container", F.explode(C.ancestors(F.col("container"), own=True)).alias("blocked"))
    return bad.union(up.join(blocked_paths(diagnostics), "blocked", "left_semi").select("container")).distinct()


def duplicates(items: DataFrame) -> DataFrame:
    """Items whose content lies at two places or more, with the number of places."""
    groups = items.groupBy("content_id").agg(F.count_distinct("path").alias("locations")).where("locations > 1")
    return items.join(groups, "content_id")


def members(items: DataFrame) -> DataFrame:
    """container, content_id without repeats."""
    return items.select("container", "content_id").distinct()


def containers(items: DataFrame) -> DataFrame:
    """container, physical_items, items (distinct contents). Sizes only: sets are never collected into a row."""
    return items.groupBy("container").agg(F.count("*").alias("physical_items"), F.count_distinct("content_id").alias("items"))


def pair_work(member: DataFrame) -> DataFrame:
    """How many rows the join on shared items would make: the sum of k (k - 1) / 2 over contents in k containers."""
    k = member.groupBy("content_id").agg(F.count("*").alias("k"))
    return k.agg(F.coalesce(F.sum(C.pair_count(F.col("k"))), F.lit(0).cast("decimal(38,0)")).alias("work"))


def celled(member: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of member with itself on content_id, with row and column: the cells of a square in which each
    two containers of a content meet once. Its sides grow with the containers, so that a cell has about BLOCK by BLOCK."""
    hot = member.groupBy("content_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    own = member.join(hot, "content_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    at, all_ = F.pmod(F.xxhash64("container"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    x = own.withColumn("row", at).withColumn("column", F.explode(all_))
    return x.drop("blocks"), own.withColumn("column", at).withColumn("row", F.explode(all_)).drop("blocks")


def holders(held: DataFrame) -> DataFrame:
    """content_id, k, cell, and the containers of a content with their sizes as three arrays in one order, by container.

    A content of more than BLOCK containers is dealt over cells of about BLOCK; k counts the containers in all of them.
    """
    size = held.groupBy("container").agg((F.sum("n") - F.count("content_id")).alias("more"), F.count("content_id").alias("items"))
    member = held.where("content_id IS NOT NULL").select("container", "content_id")
    k = member.groupBy("content_id").agg(F.count("*").alias("k")).where(F.col("k") > BLOCK)
    cell = F.pmod(F.xxhash64("container"), F.ceil(F.col("k") / BLOCK).cast("int")).cast("int")
    own = member.join(size, "container").join(k, "content_id", "left").withColumn("cell", F.coalesce(cell, F.lit(0)))
    out = own.groupBy("content_id", "cell").agg(F.first("k").alias("k"), F.array_sort(F.collect_list(F.struct(*HELD))).alias("h"))  # about BLOCK each
    return out.select("content_id", "cell", F.coalesce("k", F.size("h").cast("long")).alias("k"), *[F.col(f"h.{c}").alias(c) for c in HELD])


#: A container, how many contents it has, and how many more items; that is mostly none, and takes less room than all items.
HELD, A, B = ("container", "items", "more"), ("a", "items_a", "more_a"), ("b", "items_b", "more_b")


def met(lists: DataFrame) -> DataFrame:
    """a with its sizes, and the containers after it in one cell of a content they share, as arrays b, items_b, more_b."""
    one = lists.where(F.col("k") <= BLOCK).where(F.size("container") > 1)
    own = one.select(*HELD, F.explode(F.sequence(F.lit(0), F.size("container") - 2)).alias("i"))
    here = [F.element_at(c, F.col("i") + 1).alias(n) for c, n in zip(HELD, A)]
    rest = [F.slice(c, F.col("i") + 2, F.size("container")).alias(n) for c, n in zip(HELD, B)]
    single = own.select(*here, *rest)
    hot = lists.where(F.col("k") > BLOCK).select("content_id", F.explode(F.arrays_zip(*HELD)).alias("h")).select("content_id", "h.*")
    x, y = celled(hot)  # a content of many containers is spread over tasks
    cell = ["content_id", "row", "column"]
    y = y.groupBy(*cell).agg(F.array_sort(F.collect_list(F.struct(*HELD))).alias("y"))
    after = x.join(y, cell).select(*HELD, F.filter("y", lambda z: z["container"] > F.col("container")).alias("y")).where(F.size("y") > 0)
    return single.unionByName(after.select(*[F.col(c).alias(n) for c, n in zip(HELD, A)], *[F.col(f"y.{c}").alias(n) for c, n in zip(HELD, B)]))


def pairs(items: DataFrame, max_work: int = MAX_PAIR_WORK) -> DataFrame:
    """Every two containers a < b that share a content, with sizes, common, coverages, jaccard and relationship.

    The work is counted first and an excess raises. Containers go to tasks by a, each with those after it as arrays, so that a
    pair is not shuffled as a row of its own, and the task that adds it up has all of it. The number of tasks grows with the
    work, so that none adds up more than about TASK_WORK pairs: a container of more than that is dealt over parts by b.
    """
    held = stored(items.groupBy("container", "content_id").agg(F.count("*").alias("n")))  # one pass over the items
    lists = stored(holders(held))
    count = lists.select("content_id", "k", F.size("container").cast("decimal(38,0)").alias("m"))  # over the cells of a content, k (k - 1) / 2
    work = int(count.agg(F.coalesce(F.sum(F.col("m") * (F.col("k") - 1)), F.lit(0).cast("decimal(38,0)")).alias("work")).first().work) // 2
    if work > max_work:
        raise PairBudgetExceeded(f"{work} pair contributions, {max_work} allowed")
    tasks = max(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-work // TASK_WORK))
    load = lists.where("k > 1").select(F.explode("container").alias("a"), "k").groupBy("a").agg(F.sum(F.col("k") - 1).alias("load"))
    heavy = load.where(F.col("load") > TASK_WORK).select("a", F.ceil(F.col("load") / TASK_WORK).cast("int").alias("parts"))  # at most 2 work / TASK_WORK
    rows = met(lists).join(F.broadcast(heavy), "a", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    zipped = F.arrays_zip(*B)
    own = F.when(F.col("parts") == 1, zipped).otherwise(F.filter(zipped, lambda z: F.pmod(F.xxhash64(z["b"]), F.col("parts")) == F.col("part")))
    dealt = rows.repartition(tasks, "a", "part")
    each = dealt.select(*A, "part", F.explode(own).alias("z")).select(*A, "part", "z.*")
    out = each.groupBy(*A, "part", *B).agg(F.count("*").alias("common"))
    n, a, b = F.col("common"), F.col("items_a"), F.col("items_b")
    return out.select(
        "a", "b", (a + F.col("more_a")).alias("physical_a"), (b + F.col("more_b")).alias("physical_b"), "items_a", "items_b", "common",
        C.coverage(n, a).alias("coverage_a"), C.coverage(n, b).alias("coverage_b"), C.jaccard(n, a, b).alias("jaccard"), C.relationship(a, b, n).alias("relationship"),
    )


def label_counts(pair: DataFrame) -> DataFrame:
    """relationship, n with a row for each label, 0 included."""
    labels = pair.sparkSession.createDataFrame([(x,) for x in C.LABELS], "relationship string")
    return labels.join(pair.groupBy("relationship").agg(F.count("*").alias("n")), "relationship", "left").select("relationship", F.coalesce("n", F.lit(0)).alias("n"))


def exact_clusters(items: DataFrame) -> DataFrame:
    """cluster_key, container of containers with equal sets, two or more. Equality is transitive, so no iteration.

    A set's signature is its size with two sums of hashes, which add up map-side and hold no set in memory.
    """
    h1, h2 = F.xxhash64("content_id").cast("decimal(38,0)"), F.xxhash64(F.lit(11), "content_id").cast("decimal(38,0)")
    sig = members(items).groupBy("container").agg(F.count("*").alias("n"), F.sum(h1).alias("s1"), F.sum(h2).alias("s2"))
    groups = sig.groupBy("n", "s1", "s2").agg(F.min("container").alias("cluster_key"), F.count("*").alias("size")).where("size > 1")
    return sig.join(groups, ["n", "s1", "s2"]).select("cluster_key", "container", "size")


def related_clusters(edges: DataFrame, left: str = "a", right: str = "b", rounds: int = 60) -> DataFrame:
    """cluster_key (smallest member), container of the connected components of the edges.

    Each round lets every node point to the smallest node it knows and shortcuts two hops; the graph shrinks to stars.
    Raises if it does not settle.
    """
    e = checkpointed(edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v").distinct())
    last = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        star = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = star.groupBy("u").agg(F.min("v").alias("m"))
        e = checkpointed(star.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            stars = e.select(F.col("v").alias("cluster_key"), F.col("u").alias("container"))
            return stars.union(e.select("v", F.col("v").alias("w")).distinct())
        last = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def in_order(df: DataFrame, number: str, *keys: str) -> DataFrame:
    """df with `number`, from 1 in the order of keys, by a range sort and the row counts of the partitions before.

    No task sees more than its partition; the table of counts has a row for each partition. Rows equal in keys are
    numbered in any order.
    """
    laid = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    laid = checkpointed(laid.withColumn("_part", F.shiftright("_at", 33)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = laid.groupBy(F.col("_part").alias("_p")).agg(F.count("*").alias("_n")).select("_p", before.alias("_before"))
    within = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return laid.join(F.broadcast(parts), F.col("_part") == F.col("_p")).select(*df.columns, (F.col("_before") + within + 1).alias(number))


def numbered(clusters: DataFrame, kind: str) -> DataFrame:
    """kind, cluster_id, container: ids count clusters by their smallest member."""
    ids = in_order(clusters.select("cluster_key").distinct(), "k", "cluster_key")
    return clusters.join(ids, "cluster_key").select(F.lit(kind).alias("kind"), C.padded_id(F.lit(kind), F.col("k")).alias("cluster_id"), "container")


def size_distribution(clusters: DataFrame) -> DataFrame:
    return clusters.groupBy("cluster_key").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def summary(items: DataFrame, diagnostics: DataFrame | None = None) -> DataFrame:
    """One row of counts over the index: current, verified, unique contents, containers, unverified, warnings, errors."""
    ok = F.col("present") & (F.col("status") == "OK")
    out = items.agg(
        F.count_if("present").alias("current"), F.count_if(ok).alias("verified"), F.count_distinct(F.when(ok, F.col("content_id"))).alias("unique_contents"),
        F.count_distinct(F.when(ok, F.col("md5"))).alias("unique_md5"), F.count_distinct(F.when(F.col("present"), F.col("container"))).alias("containers"),
        F.count_if(F.col("status") == "UNVERIFIED").alias("unverified"),
    )
    if diagnostics is None:
        return out
    # two aggregates without keys: one row each
    return out.crossJoin(diagnostics.agg(F.count_if(F.col("severity") == "WARNING").alias("warnings"), F.count_if(F.col("severity") == "ERROR").alias("errors")))


def top_containers(items: DataFrame, k: int = 20) -> DataFrame:
    """The k containers with most bytes, ties by name."""
    return items.groupBy("container").agg(F.sum("size").alias("bytes"), F.count("*").alias("files")).orderBy(F.desc("bytes"), "container").limit(k)
