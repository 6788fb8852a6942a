"""Mixing sources to target weights: block quotas split down a tree of output shards, disjoint permuted blocks, local shuffle.

Native: DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
BLOCKS = 256
LEVELS = 4
#: Sources whose quotas are drawn in one fold; more are split into folds by a draw over their sums first.
FOLD = 1024
#: A draw looks so many standard deviations around its mode; what lies beyond is less than a double can tell.
REACH = 12


def words(text="text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")


def mark():
    """Names a row by id and text; the text decides its place among rows that share an id."""
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))


def draw(*parts):
    """A 52-bit number, fixed by the parts as text, the same on every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES) -> DataFrame:
    """source, source_size -> with target and i: weights repeat over the sources by code point, null last; i is that number from 1.

    A target stops at most_times its size and the excess is shared anew by weight: with sources sorted by
    size / weight, the stopped ones are a prefix. Numbers and sums come by a range sort, so sources may be many.
    """
    s = common.running(sources.withColumn("_none", F.col("source").isNull()), ["_none", "source"], {}).withColumn("i", F.col("rank") + 1).drop("rank")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int")).cast("long")
    s = s.withColumn("w", weight).withColumn("most", most_times * F.col("source_size")).withColumn("ratio", F.col("most") / F.col("w"))
    s = common.checkpointed(common.running(s, ["ratio", "_none", "source"], {"stopped": "most", "w_stopped": "w"}))
    whole = s.agg(F.sum("source_size").alias("all_size"), F.sum("w").alias("all_w"))
    s = s.join(F.broadcast(whole)).withColumn("share", (F.col("all_size") - F.col("stopped")).cast("double") / (F.col("all_w") - F.col("w_stopped")))
    # the share of the first source that is not stopped holds for it and all after it
    level = s.agg(F.min(F.when(F.col("share") * F.col("w") <= F.col("most"), F.struct("ratio", F.col("stopped"), "share")))["share"].alias("level"))
    target = F.when(F.col("level").isNull() | (F.col("level") * F.col("w") > F.col("most")), F.col("most").cast("double")).otherwise(F.col("level") * F.col("w"))
    return s.join(F.broadcast(level)).select("source", "source_size", target.alias("target"), "i")  # whole and level are one row each


def let(value, body):
    """body(value) with value computed once; expressions in lambdas are not shared otherwise."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total, marked, drawn, u):
    """How many of `drawn` out of `total`, of which `marked` are marked, are marked: the quantile at u in [0, 1).

    The probabilities follow from each other by a ratio, from the mode down, up, and then from the lowest until their
    sum passes u.
    """
    d = lambda c: c.cast("double")

    def ratio(s, k):  # probability of k + 1 by that of k
        return d((s["K"] - k) * (s["n"] - k)) / d((k + 1) * (s["all"] - s["K"] - s["n"] + k + 1))

    def bounds(s):
        low, high = F.greatest(F.lit(0), s["n"] - s["all"] + s["K"]), F.least(s["n"], s["K"])
        p = d(s["K"]) / d(F.greatest(s["all"], F.lit(1)))
        spread = F.sqrt(d(s["n"]) * p * (1 - p) * d(s["all"] - s["n"]) / d(F.greatest(s["all"] - 1, F.lit(1))))
        mode = F.least(high, F.greatest(low, F.floor(d(s["n"] + 1) * d(s["K"] + 1) / d(s["all"] + 2))))
        return let(F.struct(s["all"].alias("all"), s["K"].alias("K"), s["n"].alias("n"), s["u"].alias("u"), low.alias("low"), high.alias("high"), mode.cast("long").alias("mode"), (F.ceil(REACH * spread) + REACH).cast("long").alias("reach")), ends)

    def ends(s):
        first, last = F.greatest(s["low"], s["mode"] - s["reach"]), F.least(s["high"], s["mode"] + s["reach"])
        return let(F.struct(*[s[c].alias(c) for c in ("all", "K", "n", "u", "mode")], first.cast("long").alias("first"), last.cast("long").alias("last")), weighed)

    def weighed(s):
        none, one = F.array().cast("array<bigint>"), F.struct(F.lit(1.0).alias("now"), F.lit(0.0).alias("sum"))
        step = lambda now, a: F.struct(now.alias("now"), (a["sum"] + now).alias("sum"))
        down = F.aggregate(F.when(s["first"] < s["mode"], F.sequence(s["first"], s["mode"] - 1)).otherwise(none), one, lambda a, k: step(a["now"] / ratio(s, s["mode"] - 1 - (k - s["first"])), a))
        up = F.aggregate(F.when(s["mode"] < s["last"], F.sequence(s["mode"], s["last"] - 1)).otherwise(none), one, lambda a, k: step(a["now"] * ratio(s, k), a))
        return let(F.struct(down.alias("down"), up.alias("up")), lambda w: found(s, w["down"]["now"], s["u"] * (w["down"]["sum"] + 1 + w["up"]["sum"])))

    def found(s, lowest, mark):
        return let(F.struct(lowest.alias("lowest"), mark.alias("mark")), lambda m: F.aggregate(
            F.sequence(s["first"], s["last"]),
            F.struct(m["lowest"].alias("now"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("x")),
            lambda a, k: F.struct((a["now"] * ratio(s, k)).alias("now"), (a["sum"] + a["now"]).alias("sum"), F.when((a["x"] < 0) & (a["sum"] + a["now"] > m["mark"]), k).otherwise(a["x"]).alias("x")),
            lambda a: F.when(a["x"] < 0, s["last"]).otherwise(a["x"]),
        ))

    return let(F.struct(total.cast("long").alias("all"), marked.cast("long").alias("K"), drawn.cast("long").alias("n"), u.alias("u")), bounds)


def drawn_from(parts, total, drawn):
    """Of an array of (K, u) the number drawn from each, one after the other: a multivariate hypergeometric draw."""
    start = F.struct(total.cast("long").alias("all"), drawn.cast("long").alias("n"), F.array().cast("array<bigint>").alias("x"))

    def step(a, e):
        return let(hypergeometric(a["all"], e["K"], a["n"], e["u"]), lambda x: F.struct((a["all"] - e["K"]).alias("all"), (a["n"] - x).alias("n"), F.concat(a["x"], F.array(x)).alias("x")))

    return F.aggregate(parts, start, step, lambda a: a["x"])


def split_tree(quotas: DataFrame, levels: int = LEVELS) -> DataFrame:
    """quotas (i, q), the blocks that source number i gives -> (i, shard, q), exact: shards 0 to 2**levels - 1 add up to it.

    A node of the tree sends half of its blocks left, rounded down; how many of each source is a multivariate
    hypergeometric draw, fixed by level, node and source. Sources are drawn one after the other in folds of FOLD, the
    folds' shares before by their sums, so a million sources make folds of a thousand.
    """
    out = quotas.where("q > 0").select(F.lit(0).alias("node"), F.col("i").cast("long").alias("i"), F.col("q").cast("long").alias("q"))
    many = (out.agg(F.max("i")).first()[0] or 0) > FOLD
    for level in range(levels):
        u = lambda kind, of, level=level: draw(F.lit(kind), F.lit(str(level)), F.col("node").cast("string"), F.col(of).cast("string")) / float(1 << 52)
        own = out.withColumn("fold", F.floor((F.col("i") - 1) / FOLD).cast("long"))
        folds = own.groupBy("node", "fold").agg(F.array_sort(F.collect_list(F.struct("i", F.col("q").alias("K"), u("quota", "i").alias("u")))).alias("parts"), F.sum("q").alias("K"))
        if many:
            nodes = folds.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("fold", "K", u("fold", "fold").alias("u")))).alias("parts"), F.sum("K").alias("all"))
            nodes = nodes.withColumn("x", drawn_from(F.col("parts"), F.col("all"), F.floor(F.col("all") / 2)))
            share = nodes.select(F.col("node").alias("_n"), F.explode(F.arrays_zip("parts", "x")).alias("z")).select("_n", F.col("z.parts.fold").alias("_f"), F.col("z.x").alias("n"))
            folds = folds.join(share, (F.col("node") == F.col("_n")) & (F.col("fold") == F.col("_f")))
        else:  # one fold draws all that its node does
            folds = folds.withColumn("n", F.floor(F.col("K") / 2))
        left = folds.withColumn("x", drawn_from(F.col("parts"), F.col("K"), F.col("n")))
        rows = left.select("node", F.explode(F.arrays_zip("parts", "x")).alias("z")).select("node", F.col("z.parts.i").alias("i"), F.col("z.parts.K").alias("q"), F.col("z.x").alias("x"))
        sides = F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), F.col("x").alias("q")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("q") - F.col("x")).alias("q"))))
        out = common.checkpointed(rows.select("i", sides.alias("s")).select(F.col("s.node").alias("node"), "i", F.col("s.q").alias("q")).where("q > 0"))
    return out.select("i", F.col("node").alias("shard"), "q")


def dealt(copies: DataFrame, levels: int = LEVELS) -> DataFrame:
    """copies (i, block, copy) -> with shard: the quotas of split_tree are filled shard after shard from a permutation of each source's blocks."""
    ends = Window.partitionBy("i").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    quotas = split_tree(copies.groupBy("i").agg(F.count("*").alias("q")), levels).withColumn("end", F.sum("q").over(ends))
    quotas = quotas.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("end", "shard"))).alias("ends")).withColumnRenamed("i", "_i")
    # a source has at most BLOCKS blocks, a shard for each leaf of the tree
    order = Window.partitionBy("i").orderBy(draw(F.lit("deal"), *[F.col(c).cast("string") for c in ("i", "block", "copy")]), "block", "copy")
    rows = copies.withColumn("j", F.row_number().over(order)).join(quotas, F.col("i") == F.col("_i"))
    return rows.select("i", "block", "copy", F.filter("ends", lambda e: e["end"] >= F.col("j"))[0]["shard"].alias("shard"))


def cut_block(rows: DataFrame) -> DataFrame:
    """rows of the blocks in which a source ends, with extra: the row is among the first that pass half of `left`.

    The order is that of the mark. Sizes are added up by the mark's first three digits, map-side, so whole bins fall
    on one side; rows are put in order only in the bin that the cut meets, a small part of a block of any size.
    """
    bins = rows.groupBy("source", "block", "left", F.substring("mark", 1, 3).alias("bin")).agg(F.sum("size").alias("bin_size"))
    before = F.sum("bin_size").over(Window.partitionBy("source", "block").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn("before", F.coalesce(before, F.lit(0))).drop("left").withColumnsRenamed({"source": "_s", "block": "_b", "bin": "_bin"})
    x = rows.withColumn("bin", F.substring("mark", 1, 3)).join(bins, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")) & (F.col("bin") == F.col("_bin")))
    met = (F.col("before") <= F.col("left")) & (F.col("before") + F.col("bin_size") > F.col("left"))
    whole = x.where(~met).withColumn("extra", F.col("before") + F.col("bin_size") <= F.col("left"))
    # rows that share a mark are one here, so that all or none of them are taken
    marks = x.where(met).groupBy("source", "block", "left", "before", "mark").agg(F.sum("size").alias("mark_size"))
    inside = Window.partitionBy("source", "block").orderBy("mark").rowsBetween(Window.unboundedPreceding, 0)
    extra = 2 * (F.col("before") + F.sum("mark_size").over(inside)) - F.col("mark_size") <= 2 * F.col("left")
    marks = marks.select(F.col("source").alias("_ms"), F.col("block").alias("_mb"), F.col("mark").alias("_m"), extra.alias("extra"))
    part = x.where(met).join(common.small_or_not(marks, 200_000), F.col("source").eqNullSafe(F.col("_ms")) & (F.col("block") == F.col("_mb")) & (F.col("mark") == F.col("_m")))
    return whole.select(*rows.columns, "extra").unionByName(part.select(*rows.columns, "extra"))


def mixed(docs: DataFrame, weights=WEIGHTS, most_times: int = MOST_TIMES, blocks: int = BLOCKS, levels: int = LEVELS) -> DataFrame:
    """One row for each row of docs: doc_id, size, source_size, target, times, taken, shards, mark.

    Documents fall into `blocks` blocks of their source by a hash of id and text, so a source of any size is spread.
    A source gives floor(target / size) copies of all its blocks, then the first blocks of a permutation up to the
    rest of the target; of the block in which it ends, the first documents of a permutation up to the last that
    passes half. These numbers of blocks are the quotas that the splitting tree divides among the output shards, which
    are then filled with disjoint blocks; shards holds the shard of each copy. A null source is a source; null text
    has size 0 and taken 0; a source without words has target 0. Rows that repeat share a place in the permutation, and
    all of them are taken equally often; blocks that draw alike go by number. A text of any length is one number here. An empty
    table gives no rows. Extra columns are ignored.
    """
    d = docs.select("doc_id", F.col("source").cast("string").alias("source"), words().alias("size"), mark().alias("mark"))
    d = common.checkpointed(d.withColumn("block", (F.conv(F.substring("mark", 1, 8), 16, 10).cast("long") % blocks).cast("int")))
    sums = common.checkpointed(d.groupBy("source", "block").agg(F.sum("size").alias("block_size")))
    sources = targets(sums.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, most_times)
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_times))).otherwise(0).cast("int"))
    sources = sources.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    sources = sources.withColumnRenamed("source", "name")
    b = sums.join(sources, F.col("source").eqNullSafe(F.col("name"))).select("source", "i", "block", "block_size", "source_size", "target", "whole", "rest")
    permuted = Window.partitionBy("i").orderBy(draw(F.lit("block"), F.coalesce("source", F.lit("")), F.col("block").cast("string")), "block")
    b = b.withColumn("left", F.col("rest") - F.coalesce(F.sum("block_size").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    b = common.checkpointed(b.drop("rest"))
    last = (F.col("left") > 0) & (F.col("left") < F.col("block_size"))
    copies = b.where("whole > 0 OR left > 0").select("i", "block", F.explode(F.sequence(F.lit(1), F.col("whole") + F.when(F.col("left") > 0, 1).otherwise(0))).alias("copy"))
    shards = dealt(copies, levels).groupBy("i", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("at"))
    b = b.join(shards.select("i", "block", F.transform("at", lambda x: x["shard"]).alias("at")), ["i", "block"], "left").drop("i")
    b = common.small_or_not(common.checkpointed(b).withColumnsRenamed({"source": "_s", "block": "_b"}), 200_000)
    j = d.join(b, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b"))).select("doc_id", "size", "mark", "source", "block", "source_size", "target", "whole", "left", "block_size", "at")
    sure = j.where(~last).withColumn("extra", (F.col("left") >= F.col("block_size")) & (F.col("left") > 0))
    out = sure.unionByName(cut_block(j.where(last)))
    times = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra").cast("int"), F.lit(most_times))).otherwise(0)
    return out.withColumn("times", times).select("doc_id", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"), F.slice(F.coalesce("at", F.array().cast("array<int>")), 1, F.col("times")).alias("shards"), "mark")


def place(mark, copy):
    """The draw by which a copy is ordered in its shard."""
    return draw(F.lit("place"), mark, copy.cast("string"))


def op7_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix by document; shards has the output shard of each copy taken, places what orders it there, as numbers between commas."""
    m = mixed(common.table(spark, sf_dir, "documents"))
    places = F.transform("shards", lambda x, k: place(F.col("mark"), k).cast("string"))
    return m.select("doc_id", "size", "source_size", "target", "taken", F.array_join(F.col("shards").cast("array<string>"), ",").alias("shards"), F.array_join(places, ",").alias("places"))


def placed(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """docs with a row for each copy that the mix takes, and __kf_shard and __kf_place: its output shard and the draw that orders it there."""
    taken = mixed(docs, levels=levels).where("times > 0").groupBy(F.col("mark").alias("__kf_m")).agg(F.max(F.struct("times", "shards")).alias("__kf_t"))
    rows = docs.withColumn("__kf_mark", mark()).join(taken, F.col("__kf_mark") == F.col("__kf_m"))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], "__kf_mark", F.posexplode("__kf_t.shards").alias("__kf_copy", "__kf_shard"))
    return rows.withColumn("__kf_place", place(F.col("__kf_mark"), F.col("__kf_copy"))).drop("__kf_mark", "__kf_copy")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with each row as often as the mix takes it, shard after shard, shuffled in each; rows without words or outside the mix go.

    Partition k of n holds the copies whose shard and place lie in the k-th part of all: draws are even, so no task is
    larger than others by more than the shards are.
    """
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = F.floor((F.col("__kf_shard") + F.col("__kf_place") / float(1 << 52)) * n / (1 << LEVELS)).cast("int")
    laid = placed(docs).repartitionById(n, F.least(part, F.lit(n - 1))).sortWithinPartitions("__kf_shard", "__kf_place")
    return laid.select(*[F.col(f"`{c}`") for c in docs.columns])


QUOTAS = r"""
n{k} AS (SELECT node, sum(q)::BIGINT AS total, (sum(q) // 2)::BIGINT AS n FROM q{k} GROUP BY node),
r{k}(node, i, total, n, q, x) AS (
  SELECT node, 0::BIGINT, total, n, 0::BIGINT, 0::BIGINT FROM n{k}
  UNION ALL
  SELECT node, i, total - q, n - x, q, x FROM (
    SELECT *, lo + len(list_filter(range(lo, least(n, q)), lambda k: list_sum(list_transform(range(lo, k + 1), lambda j:
             exp(lgamma(q + 1) - lgamma(j + 1) - lgamma(q - j + 1) + lgamma(total - q + 1) - lgamma(n - j + 1) - lgamma(total - q - n + j + 1) - lgamma(total + 1) + lgamma(n + 1) + lgamma(total - n + 1)))) <= u)) AS x
    FROM (SELECT r.node, q.i, r.total, r.n, q.q, greatest(0, r.n - r.total + q.q)::BIGINT AS lo, ('0x' || substr(md5('quota:{k}:' || r.node || ':' || q.i), 1, 13))::BIGINT / 4503599627370496.0 AS u
          FROM r{k} r JOIN q{k} q ON q.node = r.node AND q.i = r.i + 1))),
q{next} AS (SELECT 2 * node AS node, i, x AS q FROM r{k} WHERE i > 0 UNION ALL SELECT 2 * node + 1, i, q - x FROM r{k} WHERE i > 0),"""

ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS mark FROM documents),
e AS (SELECT *, (('0x' || substr(mark, 1, 8))::BIGINT % 256)::INT AS block FROM d),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM e GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((i - 1) % 3 + 1)::INT]::BIGINT AS w, 3 * source_size AS most FROM s0),
s2 AS (SELECT *, coalesce(sum(most) OVER o, 0)::BIGINT AS stopped, coalesce(sum(w) OVER o, 0)::BIGINT AS w_stopped FROM s1
       WINDOW o AS (ORDER BY most::DOUBLE / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, ((sum(source_size) OVER ())::BIGINT - stopped)::DOUBLE / ((sum(w) OVER ())::BIGINT - w_stopped)::DOUBLE AS share FROM s2),
lv AS (SELECT arg_min(share, (most::DOUBLE / w::DOUBLE, stopped)) AS level FROM s3 WHERE share * w <= most),
s4 AS (SELECT source, source_size, i, CASE WHEN level IS NULL OR level * w > most THEN most::DOUBLE ELSE level * w END AS target FROM s3, lv),
s5 AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS whole FROM s4),
s6 AS (SELECT *, round(target - whole * source_size)::BIGINT AS rest FROM s5),
b0 AS (SELECT source, block, sum(size)::BIGINT AS block_size FROM e GROUP BY source, block),
b1 AS (SELECT b0.source, i, block, block_size, source_size, target, whole,
              rest - coalesce(sum(block_size) OVER (PARTITION BY b0.source ORDER BY ('0x' || substr(md5('block:' || coalesce(b0.source, '') || ':' || block::VARCHAR), 1, 13))::BIGINT, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS left_
       FROM b0 JOIN s6 ON b0.source IS NOT DISTINCT FROM s6.source),
c AS (SELECT i, block, unnest(range(1, whole + CASE WHEN left_ > 0 THEN 2 ELSE 1 END)) AS copy FROM b1),
q0 AS (SELECT 0::BIGINT AS node, s0.i, count(c.i)::BIGINT AS q FROM s0 LEFT JOIN c ON c.i = s0.i GROUP BY s0.i),
-- the tree: each level draws what goes left of each source, one source after the other""" + "".join(QUOTAS.format(k=k, next=k + 1) for k in range(LEVELS)) + r"""
ends AS (SELECT i, node AS shard, sum(q) OVER (PARTITION BY i ORDER BY node) AS stop, q FROM q4),
deal AS (SELECT i, block, copy, row_number() OVER (PARTITION BY i ORDER BY ('0x' || substr(md5('deal:' || i || ':' || block || ':' || copy), 1, 13))::BIGINT, block, copy) AS j FROM c),
spots AS (SELECT deal.i, block, list(shard ORDER BY copy) AS spots FROM deal JOIN ends ON deal.i = ends.i AND j > stop - q AND j <= stop GROUP BY deal.i, block),
j AS (SELECT doc_id, size, mark, source_size, target, whole, left_, block_size, b1.i, e.block, sum(size) OVER (PARTITION BY e.source, e.block ORDER BY mark RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY e.source, e.block, mark) AS mark_size
      FROM e JOIN b1 ON e.source IS NOT DISTINCT FROM b1.source AND e.block = b1.block),
t AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE least(whole + CASE WHEN left_ <= 0 THEN 0 WHEN left_ >= block_size THEN 1 WHEN 2 * upto - mark_size <= 2 * left_ THEN 1 ELSE 0 END, 3) END::BIGINT AS times FROM j)
SELECT doc_id, size, source_size, target, times * size AS taken, coalesce(array_to_string(spots[1:times], ','), '') AS shards,
       coalesce(array_to_string([('0x' || substr(md5('place:' || mark || ':' || k), 1, 13))::BIGINT for k in range(0, times)], ','), '') AS places
FROM t LEFT JOIN spots ON t.i = spots.i AND t.block = spots.block
"""
