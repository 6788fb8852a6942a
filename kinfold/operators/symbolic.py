"""Symbolic coverage as relations: which declarations a usage may mean, and whether they reach all it can reach.

Facts are rows with a predicate: terms over random variables, each with values from 1 to an upper bound. A predicate becomes a
box, the intervals left of each variable, by Column expressions. Declarations meet each other and usages by joins on
their logical key; coverage subtracts boxes in rounds over a table of pieces. Facts with the same key and box are one
class, so a chart with many thousand facts costs what its different predicates cost. Work is counted before it is done;
what lies beyond a limit keeps a row with a state that says so.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.budget import beyond
from kinfold.operators.relations import checkpointed

# Fixed values of the analysis: states of a region, of the coverage of a usage, of the place of a declaration in the text.
UNKNOWN, NEVER, MAYBE, ALWAYS = "UNKNOWN", "IMPOSSIBLE_WITHIN_MODEL", "POSSIBLE_WITHIN_MODEL", "UNCONDITIONAL_SYNTAX"
COVERED, UNBOUND, UNUSED, UNCLEAR, CUT_SHORT = "DECLARATIONS_COVER_USAGE_WITHIN_MODEL", "UNBOUND_ASSIGNMENTS_WITHIN_MODEL", "USAGE_IMPOSSIBLE_WITHIN_MODEL", "UNKNOWN_SEMANTICS", "INCOMPLETE_SYMBOLIC_COVERAGE"
LIMITED, RELATION_LIMIT = "INCOMPLETE_RELATION_COVERAGE", "SEMANTIC_RELATION_LIMIT"
BEFORE, AFTER, NO_ORDER = "DECLARATION_BEFORE_USAGE_IN_TEXT", "DECLARATION_AFTER_USAGE_IN_TEXT", "JSON_POINTERS_NO_APPLICATION_ORDER"
UNRESOLVED, MAY_BIND, APART = "UNRESOLVED_LOGICAL_REFERENCE", "MAY_BIND_WITHIN_MODEL", "CANNOT_CO_OCCUR_WITHIN_MODEL"
AMBIGUOUS, UNSURE = "AMBIGUOUS_EFFECTIVE_DECLARATION", "UNKNOWN_EFFECTIVE_DECLARATION"
SINGLE, EXCLUSIVE, NONE_FITS = "SINGLE_CANDIDATE_WITHIN_MODEL", "BRANCH_EXCLUSIVE_ALTERNATIVES_WITHIN_MODEL", "NO_COMPATIBLE_DECLARATION_WITHIN_MODEL"
COEXISTING = ("SIMULTANEOUS_DECLARATIONS_PRECEDENCE_UNKNOWN", "POSSIBLE_CONDITIONAL_REDEFINITION_PRECEDENCE_UNKNOWN", "COEXISTING_DECLARATIONS_PRECEDENCE_UNKNOWN")
OBLIGED = ("POTENTIAL_OBLIGATION_UNKNOWN_SEMANTICS", "POTENTIAL_OBSERVED_USE", "POTENTIAL_CONDITIONED_USE", "NO_CO_OCCURRING_USE_OBSERVED_WITHIN_MODEL")

#: A fact as a row. kind is CHART (one for each path), DECLARATION or USAGE; key is null where a fact has no logical id.
TERMS = "array<struct<variable: int, upper: bigint, equal: bigint, excluded: array<bigint>>>"
FACTS = f"path string, kind string, id int, key string, line int, conditioned boolean, known boolean, terms {TERMS}, written_path string, sound boolean, admitted boolean, limited boolean"
FAR = 1 << 40
#: Declaration classes of a key that one round subtracts.
ROUND = 16


@dataclass(frozen=True)
class Limits:
    """For each path: pairs, relations and collisions that are looked at, and pieces of regions that are held."""

    relations: int = 100_000
    pieces: int = 100_000


def let(x: Column, f) -> Column:
    return F.transform(F.array(x), f)[0]


def span(low, high) -> Column:
    return F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"))


def meet(a: Column, b: Column) -> Column:
    """The intervals of values that lie in both."""
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: span(F.greatest(x["lo"], y["lo"]), F.least(x["hi"], y["hi"])))))
    return F.filter(both, lambda x: x["lo"] <= x["hi"])


def complement(a: Column) -> Column:
    """The intervals between those of a, which are sorted and apart."""
    low, high = F.concat(F.array(F.lit(-FAR)), F.transform(a, lambda x: x["hi"] + 1)), F.concat(F.transform(a, lambda x: x["lo"] - 1), F.array(F.lit(FAR)))
    return F.filter(F.zip_with(low, high, span), lambda x: x["lo"] <= x["hi"])


def whole(upper: Column) -> Column:
    return F.array(span(F.lit(1), upper))


def allowed(t: Column) -> Column:
    """The values that fulfil a term."""
    own = F.when((t["equal"] >= 1) & (t["equal"] <= t["upper"]) & ~F.array_contains(t["excluded"], t["equal"]), F.array(span(t["equal"], t["equal"]))).otherwise(F.array().cast("array<struct<lo:bigint,hi:bigint>>"))
    rest = meet(whole(t["upper"]), complement(F.transform(F.array_sort(F.array_distinct(t["excluded"])), lambda x: span(x, x))))
    return F.when(t["equal"].isNotNull(), own).otherwise(rest)


def variables(*boxes: Column) -> Column:
    names = [F.transform(b, lambda x: F.struct(x["variable"].alias("variable"), x["upper"].alias("upper"))) for b in boxes]
    return F.array_sort(F.array_distinct(F.concat(*names)))


def entry(v: Column, values: Column) -> Column:
    return F.struct(v["variable"].alias("variable"), v["upper"].alias("upper"), values.alias("values"))


def box_of(terms: Column) -> Column:
    """The values left of each variable that the terms name."""
    left = lambda v: F.aggregate(F.filter(terms, lambda t: t["variable"] == v["variable"]), whole(v["upper"]), lambda a, t: meet(a, allowed(t)))
    return F.transform(variables(terms), lambda v: entry(v, left(v)))


def joint(a: Column, b: Column) -> Column:
    """The box where both hold."""
    left = lambda v: F.aggregate(F.filter(F.concat(a, b), lambda x: x["variable"] == v["variable"]), whole(v["upper"]), lambda c, x: meet(c, x["values"]))
    return F.transform(variables(a, b), lambda v: entry(v, left(v)))


def impossible(box: Column) -> Column:
    return F.exists(box, lambda x: F.size(x["values"]) == 0)


def state_of(known: Column, box: Column) -> Column:
    return F.when(~known, UNKNOWN).when(impossible(box), NEVER).when(F.size(box) == 0, ALWAYS).otherwise(MAYBE)


def cut(piece: Column, box: Column) -> Column:
    """inside: the piece in the box; out: what is left of it, split along one variable after another; alive: inside holds something."""
    put = lambda p, v, values: F.concat(F.filter(p, lambda x: x["variable"] != v["variable"]), F.array(entry(v, values)))

    def step(a, v):
        now = F.coalesce(F.get(F.filter(a["inside"], lambda x: x["variable"] == v["variable"]), 0)["values"], whole(v["upper"]))

        def of(n):
            rest, own = meet(n, complement(v["values"])), meet(n, v["values"])
            more = F.when(a["alive"] & (F.size(rest) > 0), F.concat(a["out"], F.array(put(a["inside"], v, rest)))).otherwise(a["out"])
            return F.struct(put(a["inside"], v, own).alias("inside"), more.alias("out"), (a["alive"] & (F.size(own) > 0)).alias("alive"))

        return let(now, of)

    start = F.struct(piece.cast(BOX).alias("inside"), F.array().cast(f"array<{BOX}>").alias("out"), F.lit(True).alias("alive"))
    return F.aggregate(box, start, step)


def subtracted(pieces: Column, boxes: Column) -> Column:
    """pieces (box, n) of a usage's region, cut at the boxes (box, m): n counts the declarations that hold on a piece, up to two."""

    def step(acc, d):
        def one(p):
            parts = lambda c: F.concat(F.when(c["alive"], F.array(F.struct(c["inside"].alias("box"), F.least(p["n"] + d["m"], F.lit(2)).alias("n")))).otherwise(F.array().cast(KIND)), F.transform(c["out"], lambda o: F.struct(o.alias("box"), p["n"].alias("n"))))
            return F.when(p["n"] >= 2, F.array(p)).otherwise(let(cut(p["box"], d["box"]), parts))

        return F.flatten(F.transform(acc, one))

    return F.aggregate(boxes, pieces, step)


BOX = "array<struct<variable:int,upper:bigint,values:array<struct<lo:bigint,hi:bigint>>>>"
KIND = "array<struct<box:array<struct<variable:int,upper:bigint,values:array<struct<lo:bigint,hi:bigint>>>>,n:int>>"


def witness(box: Column) -> Column:
    """One value range of each variable that the box restricts."""
    return F.array_join(F.transform(F.array_sort(box), lambda x: F.format_string("%d=%d-%d", x["variable"], x["values"][0]["lo"], x["values"][0]["hi"])), ";")


@dataclass(frozen=True)
class Analysis:
    """facts with box and state; and rows of

    coexistence: path, key, a, b, state - two declarations of a key; a key beyond the limit has one row without a and b.
    relations: path, usage, declaration, compatibility, place - a usage beyond the limit has one row without declaration.
    usages: path, usage, region, effective, coverage, witness.
    obligations: path, declaration, state.

    What is not asked for is not computed: usages are met with their declarations, and regions subtracted, on first use.
    """

    facts: DataFrame
    coexistence: DataFrame
    keys: DataFrame
    pairs: DataFrame
    limits: Limits

    @cached_property
    def declarations(self) -> DataFrame:
        return self.facts.where("kind = 'DECLARATION' AND key IS NOT NULL")

    @cached_property
    def uses(self) -> DataFrame:
        return self.facts.where("kind = 'USAGE'").withColumn("key", F.coalesce("key", F.lit("")))  # the key of no declaration

    @cached_property
    def asked(self) -> DataFrame:
        """Usages with what their key costs, and whether they lie within the limit."""
        keys, pairs, limits = self.keys, self.pairs, self.limits
        clashes = pairs.where(F.col("state") != APART).groupBy("path", "key").agg(F.count("*").alias("clashes"))
        full = keys.where("pairs > 0").groupBy("path").agg(F.sum("pairs").alias("pairs"), F.min("fits").alias("pairs_done"))
        asked = self.uses.join(keys.select("path", "key", "n", "unclear"), ["path", "key"], "left").join(clashes, ["path", "key"], "left").join(full, "path", "left")
        cost = F.greatest(F.lit(1), F.coalesce("n", F.lit(0))) + F.coalesce("clashes", F.lit(0))
        asked = checkpointed(asked.withColumn("cost", cost))
        asked = marked(asked, beyond(asked, ["path"], ["id"], "cost", limits.relations, F.coalesce("pairs", F.lit(0))), ["path", "id"])
        return asked.withColumn("fits", F.col("fits") & F.coalesce("pairs_done", F.lit(True)))

    @cached_property
    def met(self) -> DataFrame:
        """Usages within the limit with each declaration of their key."""
        d, asked = self.declarations, self.asked
        near = asked.where("fits").select("path", F.col("id").alias("usage"), "key", F.col("state").alias("use_state"), F.col("box").alias("use_box"), F.col("line").alias("use_line"))
        far = d.select("path", "key", F.col("id").alias("declaration"), F.col("state").alias("own_state"), F.col("box").alias("own_box"), F.col("line").alias("own_line"))
        met = together(F.col("use_state"), F.col("use_box"), F.col("own_state"), F.col("own_box"))
        compatibility = F.when(F.col("declaration").isNull(), UNRESOLVED).when(met == UNKNOWN, UNCLEAR).when(met == NEVER, APART).otherwise(MAY_BIND)
        place = F.when(F.col("declaration").isNull(), "NO_DECLARATION").when(F.col("own_line").isNull() | F.col("use_line").isNull(), NO_ORDER).when(F.col("own_line") < F.col("use_line"), BEFORE).otherwise(AFTER)
        return near.join(far, ["path", "key"], "left").select("path", "usage", "declaration", compatibility.alias("compatibility"), place.alias("place"))

    @cached_property
    def relations(self) -> DataFrame:
        none = F.lit(None).cast("int")
        unseen = self.asked.where("NOT fits").select("path", F.col("id").alias("usage"), none.alias("declaration"), F.lit(RELATION_LIMIT).alias("compatibility"), F.lit("NO_DECLARATION").alias("place"))
        return self.met.unionByName(unseen)

    @cached_property
    def usages(self) -> DataFrame:
        asked = self.asked
        x = asked.join(covered(asked.where("fits"), self.declarations, self.limits), ["path", "key", "region"], "left")
        unsure = (F.col("state") == UNKNOWN) | (F.col("unclear") > 0) | F.col("short")
        effective = (
            F.when(~F.col("fits"), UNSURE).when(F.coalesce("n", F.lit(0)) == 0, UNRESOLVED).when(unsure, UNSURE).when(F.col("overlap"), AMBIGUOUS)
            .when(F.coalesce("possible", F.lit(0)) == 0, NONE_FITS).when(F.col("possible") == 1, SINGLE).otherwise(EXCLUSIVE)
        )
        coverage = (
            F.when(~F.col("fits"), LIMITED).when((F.col("state") == UNKNOWN) | (F.col("unclear") > 0), UNCLEAR).when(F.col("state") == NEVER, UNUSED)
            .when(F.col("short"), CUT_SHORT).when(F.col("open").isNotNull(), UNBOUND).otherwise(COVERED)
        )
        return x.select("path", F.col("id").alias("usage"), F.col("state").alias("region"), effective.alias("effective"), coverage.alias("coverage"), F.when(coverage == UNBOUND, F.col("open")).alias("witness"))

    @cached_property
    def obligations(self) -> DataFrame:
        over = self.asked.where("NOT fits").select("path").union(self.keys.where("NOT fits").select("path")).distinct().withColumn("over", F.lit(True))
        seen = self.met.where("declaration IS NOT NULL").groupBy("path", "declaration").agg(F.count_if(F.col("compatibility") == UNCLEAR).alias("unclear"), F.count_if(F.col("compatibility") == MAY_BIND).alias("may"))
        o = self.facts.where("kind = 'DECLARATION'").withColumnRenamed("id", "declaration").join(seen, ["path", "declaration"], "left").join(over, "path", "left")
        doubt = F.coalesce("over", F.lit(False)) | (F.col("state") == UNKNOWN) | (F.coalesce("unclear", F.lit(0)) > 0)
        obliged = F.when(doubt, OBLIGED[0]).when(F.coalesce("may", F.lit(0)) > 0, F.when(F.col("conditioned"), OBLIGED[2]).otherwise(OBLIGED[1])).otherwise(OBLIGED[3])
        return o.select("path", "declaration", obliged.alias("state"))


def apart(a: Column, b: Column) -> Column:
    """Whether two boxes that hold something have no assignment in common."""
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["variable"] == y["variable"]) & (F.size(meet(x["values"], y["values"])) == 0)))


def together(state_a: Column, box_a: Column, state_b: Column, box_b: Column) -> Column:
    """The state of two facts at once; an unknown one makes both unknown, also beside an impossible one."""
    never = (state_a == NEVER) | (state_b == NEVER) | apart(box_a, box_b)
    return F.when((state_a == UNKNOWN) | (state_b == UNKNOWN), UNKNOWN).when(never, NEVER).when((state_a == ALWAYS) & (state_b == ALWAYS), ALWAYS).otherwise(MAYBE)


def boxed(predicates: DataFrame) -> DataFrame:
    """predicates (known, terms) with their box and state."""
    terms = F.coalesce("terms", F.array().cast(TERMS))
    box = F.when(F.size(terms) > 0, box_of(terms)).otherwise(F.array().cast(BOX))
    return predicates.withColumn("box", box).withColumn("state", state_of(F.col("known"), F.col("box")))


def analysed(facts: DataFrame, limits: Limits = Limits()) -> Analysis:
    """The analysis of facts (rows of FACTS) within limits. A hot path is spread by its keys, its order by ranges of ids.

    Repeated rows are facts of their own; a path without facts has no rows but its own. Null keys name nothing: such a
    usage is unresolved. No rows in, none out. What is not asked for of the result is not computed.
    """
    none, f = F.lit(None).cast("int"), boxed(facts)
    f = f.withColumn("region", F.concat(F.col("state"), F.when(F.size("box") > 0, F.to_json("box")).otherwise("")))  # tells classes apart
    f = checkpointed(f.drop("terms"))
    d = f.where("kind = 'DECLARATION' AND key IS NOT NULL")
    keys = d.groupBy("path", "key").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.count_if(F.col("state") == UNKNOWN).alias("unclear"))
    keys = checkpointed(keys.withColumn("pairs", F.expr("n * (n - 1) div 2")))
    keys = marked(keys, beyond(keys, ["path"], ["first"], "pairs", limits.relations), ["path", "key"])

    told = ["path", "key", "id", "box", "state", "conditioned"]
    side = lambda s: d.select("path", "key", *[F.col(c).alias(f"{c}_{s}") for c in told[2:]])
    pairs = side("a").join(keys.where("fits AND n > 1").select("path", "key"), ["path", "key"], "left_semi").join(side("b"), ["path", "key"]).where("id_a < id_b")
    both = together(F.col("state_a"), F.col("box_a"), F.col("state_b"), F.col("box_b"))
    n = F.col("conditioned_a").cast("int") + F.col("conditioned_b").cast("int")
    held = F.when(n == 0, COEXISTING[0]).when(n == 1, COEXISTING[1]).otherwise(COEXISTING[2])
    state = F.when(both == UNKNOWN, "UNKNOWN_DECLARATION_COEXISTENCE").when(both == NEVER, APART).otherwise(held)
    pairs = checkpointed(pairs.select("path", "key", F.col("id_a").alias("a"), F.col("id_b").alias("b"), state.alias("state")))
    coexistence = pairs.unionByName(keys.where("NOT fits AND n > 1").select("path", "key", none.alias("a"), none.alias("b"), F.lit(RELATION_LIMIT).alias("state")))
    return Analysis(f, coexistence, keys, pairs, limits)


def marked(df: DataFrame, over: DataFrame | None, key: list[str]) -> DataFrame:
    """df with fits: the row is not among those beyond a limit."""
    if over is None:
        return df.withColumn("fits", F.lit(True))
    over = over.select(*[F.col(k).alias(f"__{k}") for k in key]).withColumn("__over", F.lit(True))
    same = reduce(lambda a, b: a & b, [F.col(k) == F.col(f"__{k}") for k in key])
    return checkpointed(df.join(over, same, "left").withColumn("fits", F.col("__over").isNull()).select(*df.columns, "fits"))


def covered(usages: DataFrame, declarations: DataFrame, limits: Limits) -> DataFrame:
    """path, key, region, possible, overlap, open, short for each class of usages with a region.

    possible: declarations that may hold together with the usage. Where all declarations of a key hold always, their
    number tells the rest. Else each round cuts the pieces of the usages' regions at the next ROUND declaration classes of their
    key: a piece on which two declarations hold makes an overlap, one on which none holds at the end is open, and open is
    the least witness of them. Paths with more pieces than the limit are cut short from the class on that passes it.
    """
    here = ["path", "key", "region"]
    classes = usages.where(F.col("state").isin(ALWAYS, MAYBE) & (F.coalesce("unclear", F.lit(0)) == 0)).groupBy(*here).agg(F.first("box").alias("box"))
    by = declarations.where(F.col("state") != NEVER).groupBy("path", "key", F.col("region").alias("own")).agg(F.first("box").alias("own_box"), F.count("*").alias("many"), F.min("id").alias("id"))
    fits = ~apart(F.col("box"), F.col("own_box"))
    met = classes.join(by, ["path", "key"], "left").groupBy(*here).agg(
        F.first("box").alias("box"), F.coalesce(F.sum(F.when(fits, F.col("many"))), F.lit(0)).alias("possible"), F.coalesce(F.max(F.size("own_box")), F.lit(0)).alias("bounds")
    )
    met = checkpointed(met)
    plain = met.where("bounds = 0").select(*here, "possible", (F.col("possible") > 1).alias("overlap"), F.when(F.col("possible") == 0, witness(F.col("box"))).alias("open"), F.lit(False).alias("short"))
    hard = met.where("bounds > 0")
    at = F.row_number().over(Window.partitionBy("path", "key").orderBy("id")) - 1
    own = by.join(hard.select("path", "key").distinct(), ["path", "key"], "left_semi").withColumn("at", at)
    entry_ = F.struct("at", F.col("own_box").alias("box"), F.least("many", F.lit(2)).cast("int").alias("m"))
    rounds = checkpointed(own.groupBy("path", "key", F.floor(F.col("at") / ROUND).cast("int").alias("round")).agg(F.array_sort(F.collect_list(entry_)).alias("boxes")))  # at most ROUND each
    last = rounds.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]
    if not last:
        return plain
    pieces = hard.select(*here, "box", F.lit(0).alias("n"))
    done, overlaps, short = [], [], []
    for k in range(last):
        next_ = rounds.where(F.col("round") == k).select("path", "key", "boxes")
        done.append(pieces.join(next_, ["path", "key"], "left_anti").where("n = 0"))
        now = pieces.join(next_, ["path", "key"])
        now = checkpointed(now.select(*here, F.explode(subtracted(F.array(F.struct("box", "n")).cast(KIND), F.col("boxes"))).alias("p")).select(*here, "p.box", "p.n"))
        overlaps.append(now.where("n >= 2").select(*here).distinct())
        pieces = now.where("n < 2")
        over = beyond(pieces.groupBy(*here).agg(F.count("*").alias("held")), ["path"], ["key", "region"], "held", limits.pieces)
        if over is not None:
            short.append(checkpointed(over.select(*here)))
            pieces = checkpointed(pieces.join(short[-1], here, "left_anti"))
    done.append(pieces.where("n = 0"))
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    out = hard.select(*here, "possible").join(union(done).groupBy(*here).agg(F.min(witness(F.col("box"))).alias("open")), here, "left")
    flag = lambda parts, name: union(parts).distinct().withColumn(name, F.lit(True)) if parts else hard.select(*here).limit(0).withColumn(name, F.lit(True))
    out = out.join(flag(overlaps, "overlap"), here, "left").join(flag(short, "short"), here, "left")
    return plain.unionByName(out.select(*here, "possible", F.coalesce("overlap", F.lit(False)).alias("overlap"), "open", F.coalesce("short", F.lit(False)).alias("short")))
