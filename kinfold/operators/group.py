"""Group plans: the maximal compatible unions of up to six trees, what each keeps, and a check of a stored plan; components by name and by search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import plan
from kinfold.operators.relations import checkpointed

# Fixed values of a plan: the folder of variants, states of a selection, dispositions of an entry.
RESERVED = "_variantes"
CHOOSE, UNIQUE = "HUMAN_SELECTION_REQUIRED", "UNIQUE_PHYSICAL_PROPOSAL_NOT_SELECTED"
REPRESENTED, IN_PLACE = "REPRESENTED_VIRTUALLY", "PRESERVE_COMPLETE_VARIANT_IN_PLACE"


class UnknownComponent(ValueError):
    """A selection names a component that isn't there."""


def roots_of(entries: DataFrame) -> DataFrame:
    """root, bit, of at most plan.MAX_ROOTS roots in order."""
    roots = [r.root for r in entries.select("root").distinct().orderBy("root").limit(plan.MAX_ROOTS + 1).collect()]
    if not 0 < len(roots) <= plan.MAX_ROOTS:
        raise ValueError(f"1 to {plan.MAX_ROOTS} roots are planned, not {len(roots)}")
    kind = entries.schema["root"].dataType.simpleString()
    return entries.sparkSession.createDataFrame([(r, i) for i, r in enumerate(roots)], f"root {kind}, bit int")


def named(mask: Column) -> Column:
    return F.format_string("group-%02X", mask)


def members(entries: DataFrame, masks: DataFrame) -> DataFrame:
    """mask, root, inside, label: which roots a union takes; those left out get a folder each, numbered in order.

    Masks and roots are 63 and 6 at most, so they meet in a product.
    """
    all_ = masks.select("mask").crossJoin(F.broadcast(roots_of(entries))).withColumn("inside", F.col("mask").bitwiseAND(F.pow(F.lit(2), F.col("bit")).cast("int")) != 0)
    before = all_.alias("x").join(F.broadcast(all_.alias("y")), (F.col("x.mask") == F.col("y.mask")) & ~F.col("y.inside") & (F.col("y.bit") <= F.col("x.bit")), "left")
    number = before.groupBy("x.mask", "x.root", "x.inside").agg(F.count("y.bit").alias("k"))
    label = F.when(~F.col("inside"), F.concat(F.lit(RESERVED + "/"), F.lpad(F.col("k").cast("string"), 3, "0")))
    return number.select("mask", "root", "inside", label.alias("label"))


def targets(entries: DataFrame, masks: DataFrame) -> DataFrame:
    """candidate, path, kind, digest, sources: what each union shows, one row a path, with every entry behind it."""
    own = entries.join(F.broadcast(members(entries, masks).where("inside")), "root")
    one = F.struct("kind", "digest", "root", "entry")
    g = own.groupBy("mask", "path").agg(F.min(one).alias("first"), F.array_sort(F.collect_list(F.struct("root", "entry"))).alias("sources"))  # a root has a path once: 6 sources at most
    return g.select(named(F.col("mask")).alias("candidate"), "path", "first.kind", "first.digest", "sources")


def conservation(entries: DataFrame, masks: DataFrame) -> DataFrame:
    """candidate, root, entry, path, disposition, label: of each union a row for each entry of every root."""
    all_ = entries.select("root", "entry", "path").join(F.broadcast(members(entries, masks)), "root")
    return all_.select(named(F.col("mask")).alias("candidate"), "root", "entry", "path", F.when(F.col("inside"), REPRESENTED).otherwise(IN_PLACE).alias("disposition"), "label")


def layout_conflicts(shown: DataFrame, kept: DataFrame) -> DataFrame:
    """candidate, conflict: paths of a union that lie where its variants would."""
    having = kept.where("label IS NOT NULL").select("candidate").distinct()
    taken = shown.where(F.lower(F.element_at(F.split("path", "/"), 1)) == RESERVED)
    return taken.join(having, "candidate", "left_semi").select("candidate", F.concat(F.lit("VARIANT_LAYOUT_NAMESPACE_CONFLICT: "), F.col("path")).alias("conflict"))


def obligations(entries: DataFrame) -> DataFrame:
    """root, entry, digest, folder of each item; whatever is chosen, they stay unknown until someone decides."""
    return entries.where("is_item").select("root", "entry", "digest", C.parent(F.col("path")).alias("folder"))


def selection(masks: DataFrame) -> DataFrame:
    """One row: how many alternatives there are, and whether someone must choose. Nothing is chosen here."""
    return masks.agg(F.count("*").alias("alternatives")).select("alternatives", F.when(F.col("alternatives") > 1, CHOOSE).otherwise(UNIQUE).alias("state"))


def group_plan(entries: DataFrame) -> dict[str, DataFrame]:
    """The tables of a plan over entries (root, entry, path, kind, digest, is_item)."""
    lattice = checkpointed(plan.subsets(entries))
    masks = checkpointed(plan.maximal(lattice))
    shown, kept = targets(entries, masks), conservation(entries, masks)
    return {"lattice": lattice, "masks": masks, "targets": shown, "conservation": kept, "conflicts": layout_conflicts(shown, kept), "obligations": obligations(entries), "selection": selection(masks)}


def unextendable(lattice: DataFrame) -> DataFrame:
    """Compatible masks to which no root can be added: by single steps up, where plan.maximal compares all pairs."""
    good = lattice.where("compatible").select("mask")
    up = good.select("mask", F.explode(F.transform(F.sequence(F.lit(0), F.lit(plan.MAX_ROOTS - 1)), lambda b: F.pow(F.lit(2), b).cast("int"))).alias("bit"))
    wider = up.where(F.col("mask").bitwiseAND(F.col("bit")) == 0).select("mask", F.col("mask").bitwiseOR(F.col("bit")).alias("wide"))
    return good.join(wider.join(F.broadcast(good.withColumnRenamed("mask", "wide")), "wide", "left_semi"), "mask", "left_anti")


def verify_group(entries: DataFrame, stored: dict[str, DataFrame]) -> DataFrame:
    """code, key of what a stored plan says otherwise than entries do; nothing of the plan is taken on trust.

    Subsets and maximal unions are worked out anew, the latter by another rule; targets and the ledger are compared row
    by row, both ways.
    """

    def differing(code: str, ours: DataFrame, theirs: DataFrame, *key: str) -> DataFrame:
        theirs = theirs.select(ours.columns)
        rows = ours.exceptAll(theirs).unionByName(theirs.exceptAll(ours))
        return rows.select(F.lit(code).alias("code"), F.concat_ws("/", *[F.col(k).cast("string") for k in key]).alias("key")).distinct()

    lattice = checkpointed(plan.subsets(entries))
    masks = checkpointed(unextendable(lattice))
    shown, kept = targets(entries, masks), conservation(entries, masks)
    out = differing("SUBSETS", lattice, stored["lattice"], "mask")
    out = out.union(differing("MAXIMAL_ALTERNATIVES", masks, stored["masks"], "mask"))
    out = out.union(differing("VIRTUAL_NAMESPACE", shown, stored["targets"], "candidate", "path"))
    out = out.union(differing("CONSERVATION_LEDGER", kept, stored["conservation"], "candidate", "root", "entry"))
    out = out.union(differing("LAYOUT_CONFLICTS", layout_conflicts(shown, kept), stored["conflicts"], "candidate", "conflict"))
    out = out.union(differing("ITEM_OBLIGATIONS", obligations(entries), stored["obligations"], "root", "entry"))
    return out.union(differing("SELECTION_STATE", selection(masks), stored["selection"], "state"))


def components_by_search(edges: DataFrame, rounds: int = 10_000) -> DataFrame:
    """cluster_key, container as relations.related_clusters gives them, by a search that knows nothing of it.

    Every node passes the smallest name it has heard of to its neighbours until nobody hears anything new: as many
    rounds as the longest shortest path, so it serves to check, not to replace.
    """
    e = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).where("x <> y")
    e = checkpointed(e.union(e.select("y", "x")).distinct())
    told = checkpointed(e.select(F.col("x").alias("node")).distinct().withColumn("key", F.col("node")))
    for _ in range(rounds):
        heard = e.join(told, F.col("x") == F.col("node")).groupBy(F.col("y").alias("node")).agg(F.min("key").alias("heard"))
        told = checkpointed(told.join(heard, "node").select("node", F.least("key", "heard").alias("key"), (F.col("heard") < F.col("key")).alias("news")))
        if told.where("news").isEmpty():
            return told.select(F.col("key").alias("cluster_key"), F.col("node").alias("container"))
        told = told.drop("news")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def component_identity(members: DataFrame, domain: str = "Component.v1") -> DataFrame:
    """component, identity: a digest of a component's sorted roots and sorted distinct hashes, from members (component, root, content_id).

    The pre-image holds both lists, so it is for components whose lists fit in a row, as a folder's do.
    """

    def group(name: str, field: str, values: Column) -> Column:
        rows = F.array_join(F.transform(values, lambda v: F.hex(F.concat(C.token(F.lit(field)), C.token(v)))), "")
        return F.concat(C.token(F.lit(name)), C.token(F.size(values)), C.token(F.lit(1)), F.unhex(rows))

    g = members.groupBy("component").agg(F.array_sort(F.collect_set("root")).alias("roots"), F.array_sort(F.collect_set("content_id")).alias("hashes"))
    raw = F.concat(C.token(F.lit(domain)), group("member_roots", "normalized_path", F.col("roots")), group("chart_hashes", "sha256", F.col("hashes")))
    return g.select("component", F.sha2(raw, 256).alias("identity"))


def select_components(clusters: DataFrame, wanted: list[str]) -> DataFrame:
    """The clusters (cluster_id, container) of the wanted ids, or all of them if none are named; raises on an id that isn't there."""
    if not wanted:
        return clusters
    names = clusters.sparkSession.createDataFrame([(x,) for x in sorted(set(wanted))], "cluster_id string")
    lost = [r.cluster_id for r in names.join(clusters, "cluster_id", "left_anti").collect()]
    if lost:
        raise UnknownComponent(f"no component {lost[0]}")
    return clusters.join(F.broadcast(names), "cluster_id", "left_semi")


def owners(members: DataFrame, roots: DataFrame) -> DataFrame:
    """path, owner, n: the root (root, active) that holds each member (path), and how many do; owner only where it is one."""
    up = members.select("path").distinct().select("path", F.explode(C.ancestors(F.col("path"), own=True)).alias("root"))
    held = up.join(roots.where("active").select("root"), "root").groupBy("path").agg(F.count("*").alias("n"), F.min("root").alias("root"))
    out = members.select("path").distinct().join(held, "path", "left")
    return out.select("path", F.when(F.col("n") == 1, F.col("root")).alias("owner"), F.coalesce("n", F.lit(0)).alias("n"))


def drifted(expected: DataFrame, now: DataFrame, roots: DataFrame) -> DataFrame:
    """component, root, state of each root (component, root): STALE if an item right in it has come, gone or another stamp.

    expected and now: path, size, mtime of items.
    """
    e = expected.select("path", F.struct("size", "mtime").alias("was"))
    changed = e.join(now.select("path", F.struct("size", "mtime").alias("is")), "path", "full_outer").where(~F.col("was").eqNullSafe(F.col("is")))
    bad = changed.select(C.parent(F.col("path")).alias("root")).distinct().withColumn("stale", F.lit(True))
    return roots.join(bad, "root", "left").select("component", "root", F.when(F.col("stale"), "STALE").otherwise("ADMITTED").alias("state"))


def candidate_index(declared: DataFrame, proposed: DataFrame) -> DataFrame:
    """path, chart, declaration, policy, origin: every file that a declaration may mean, by the file; each once.

    declared: chart, declaration, policy, candidates. proposed: chart, declaration, found.
    """
    a = declared.select(F.explode("candidates").alias("path"), "chart", "declaration", "policy", F.lit("DECLARATION_RESOLUTION").alias("origin"))
    b = proposed.select(F.col("found").alias("path"), "chart", "declaration", F.lit("SAME_STEM_PROPOSAL").alias("policy"), F.lit("BMSON_AUDIO_LOOKUP_PROPOSAL").alias("origin"))
    return a.union(b).distinct()


def stage_path_problem(relative: Column, stage_chars: int, most_relative: int = 160, most_absolute: int = 247) -> Column:
    """Why a path can't be staged below a folder of stage_chars characters, or null: EMPTY, TOO_LONG, ROOTED, UNSAFE_SEGMENT, ABSOLUTE_TOO_LONG."""
    return (
        F.when(relative.isNull() | (relative == ""), "EMPTY").when(relative == ".", F.lit(None)).when(F.length(relative) > most_relative, "TOO_LONG")
        .when(C.rooted(relative) | relative.contains("\\"), "ROOTED").when(F.exists(F.split(relative, "/"), lambda s: s.isin("", ".", "..") | C.unsafe_segment(s)), "UNSAFE_SEGMENT")
        .when(F.length(relative) + stage_chars + 1 > most_absolute, "ABSOLUTE_TOO_LONG")
    )


def population(spark, charts: int, folders: int, shared: int | None = None) -> DataFrame:
    """A library made up by rule: chart i lies in folder i modulo folders; its content is its folder's own, or one of `shared`."""
    i = F.col("id")
    content = (F.floor(i / folders) % shared) if shared else i % folders
    folder = F.format_string("lib/F%05d", i % folders)
    return spark.range(charts).select(F.concat(folder, F.format_string("/c%d.bms", i)).alias("path"), folder.alias("container"), F.lpad(F.lower(F.hex(content.cast("long"))), 64, "0").alias("content_id"), F.lit("OK").alias("status"), F.lit(True).alias("present"))
