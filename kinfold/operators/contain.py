"""Containment join: which sets lie whole in others, without comparing sets that can't."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.relations import checkpointed, members

#: Sets that hold one content are dealt over keys of about so many.
DEALT = 10_000
#: Words of 64 bits in a set's bitmap.
LANES = 4


class Sets:
    """Different sets of items (container, content_id), each with its size, its bitmap and its anchor.

    members: container, set - which containers are equal to which set, named by its least container.
    held: set, content_id. facts: set, n, bits. anchors: set, content_id (the rarest content of the set), copies (the
    sets that hold it).
    """

    def __init__(self, items: DataFrame):
        own = checkpointed(members(items).where("content_id IS NOT NULL"))
        h = F.xxhash64("content_id")
        sums = [F.sum(x.cast("decimal(38,0)")).alias(f"s{i}") for i, x in enumerate((h, F.xxhash64(F.lit(11), "content_id")))]
        lane, bit = F.pmod(h, F.lit(LANES)), F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(content_id), 58) AS INT))")
        bits = F.array(*[F.coalesce(F.bit_or(F.when(lane == i, bit)), F.lit(0).cast("long")) for i in range(LANES)])
        sets = checkpointed(own.groupBy("container").agg(F.count("*").alias("n"), *sums, bits.alias("bits")))
        reps = sets.groupBy("n", "s0", "s1").agg(F.min("container").alias("set"))
        self.members = checkpointed(sets.join(reps, ["n", "s0", "s1"]).select("container", "set", "n", "bits"))
        self.facts = self.members.where("container = set").select("set", "n", "bits")
        self.held = checkpointed(own.join(self.facts, F.col("container") == F.col("set")).select("set", "content_id", "n", "bits"))
        rare = self.held.groupBy("content_id").agg(F.count("*").alias("copies"))
        self.anchors = checkpointed(self.held.join(rare, "content_id").groupBy("set").agg(F.min(F.struct("copies", "content_id")).alias("a")).select("set", "a.content_id", "a.copies"))

    def work(self) -> DataFrame:
        """sets, candidates: how many sets there are, and how many others hold the anchors of all."""
        return self.anchors.agg(F.count("*").alias("sets"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("candidates"))

    def candidates(self) -> DataFrame:
        """inner_, outer_, n: sets that hold the anchor of another, larger one's size and all bits of it.

        A content that many sets hold is dealt: its holders over keys by their hash, the sets anchored there to each key.
        """
        keys = F.greatest(F.lit(1), F.ceil(F.col("copies") / DEALT)).cast("int")
        inner = self.anchors.join(self.facts, "set").select(F.col("set").alias("inner_"), F.col("content_id").alias("c"), F.col("n").alias("n_in"), F.col("bits").alias("b_in"), "copies", F.explode(F.sequence(F.lit(0), keys - 1)).alias("k"))
        at = self.anchors.groupBy("content_id").agg(F.first("copies").alias("copies"))
        outer = self.held.join(at, "content_id").select(F.col("set").alias("outer_"), F.col("content_id").alias("c_"), "n", F.col("bits"), F.pmod(F.xxhash64("set"), keys).cast("int").alias("k_"))
        fits = F.lit(True)
        for i in range(LANES):
            fits = fits & (F.col("b_in")[i].bitwiseAND(F.col("bits")[i]) == F.col("b_in")[i])
        met = inner.join(outer, (F.col("c") == F.col("c_")) & (F.col("k") == F.col("k_")))
        return met.where((F.col("n_in") < F.col("n")) & fits).select("inner_", "outer_", F.col("n_in").alias("n"))

    def edges(self) -> DataFrame:
        """inner_, outer_ of each two different sets of which the first lies whole in the second: candidates whose
        common contents, counted, are all that the inner set has."""
        c = checkpointed(self.candidates())
        more = c.where("n > 1").join(self.held.select(F.col("set").alias("inner_"), "content_id"), "inner_")
        both = more.join(self.held.select(F.col("set").alias("outer_"), "content_id"), ["outer_", "content_id"])
        whole = both.groupBy("inner_", "outer_", "n").agg(F.count("*").alias("common")).where("common = n")
        return c.where("n = 1").select("inner_", "outer_").unionByName(whole.select("inner_", "outer_"))


def subset_edges(items: DataFrame) -> DataFrame:
    """inner_, outer_ of each two containers of which the first's set of contents lies in the second's and is smaller.

    Containers with equal sets are compared once and spread afterwards. Null contents are in no set; a container without
    contents has no edge. Repeated items count once. No rows in, none out.
    """
    s = Sets(items)
    of = lambda name: s.members.select(F.col("set").alias(f"{name}set"), F.col("container").alias(f"{name}own"))
    e = s.edges().join(of("i"), F.col("inner_") == F.col("iset")).join(of("o"), F.col("outer_") == F.col("oset"))
    return e.select(F.col("iown").alias("inner_"), F.col("oown").alias("outer_"))
