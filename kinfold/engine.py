"""The engine's front: scan, report, compare, extract, resolve, classify and plan, as an API and as a command line."""

from __future__ import annotations

import argparse
import contextlib
import fcntl
import functools
import json
import os
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import classify, compare, extract, group, index, observe, plan, relations, resolve, symbolic, validate
from kinfold.sources import files, guarded, sinks

DONE, FAILED, INCOMPLETE = 0, 1, 2


class Unreadable(ValueError):
    """A tree that was to be compared whole has entries that can't be read."""


class Busy(RuntimeError):
    """Another writer holds the store."""


@contextlib.contextmanager
def single_writer(store: str):
    """A lock beside a local store that the system releases with the process; other stores rely on write-once folders."""
    if "://" in store:
        yield
        return
    os.makedirs(store, exist_ok=True)
    with open(os.path.join(store, "_writer.lock"), "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            raise Busy(f"{store} has another writer") from None
        yield


def now() -> str:
    return datetime.now(timezone.utc).isoformat()


def jpath(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def outside(path: str, roots: list[str]) -> str:
    """path, if it is neither in, nor above, nor equal to any of the roots."""
    own = os.path.realpath(path)
    for root in map(os.path.realpath, roots):
        if os.path.commonpath([own, root]) in (own, root):
            raise ValueError(f"{path} and {root} overlap")
    return path


INDEX = "path string, root string, size long, mtime long, content_id string, root_id int, md5 string, status string, first_seen int, last_seen int, present boolean"


class Engine:
    """store: folder of runs, each written once. Sources are only read."""

    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store

    def runs(self) -> list[int]:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.store)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        done = [s.getPath() for s in fs.listStatus(path) if s.getPath().getName().startswith("run=")]
        return sorted(int(p.getName()[4:]) for p in done if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def index(self, run: int | None = None) -> DataFrame:
        """The index as of a run; the last complete one without a number."""
        known = self.runs()
        if not known or run is not None and run not in known:
            raise ValueError(f"no complete run {run} in {self.store}")
        return self.spark.read.parquet(f"{self.store}/run={run or known[-1]}")

    def scan(self, roots: list[str], rehash: bool = False) -> DataFrame:
        """Lists what lies under the roots, reads the items whose size or time changed, writes the next run; its counters.

        What can't be listed or read is a diagnostic and a status: such items stay in the index, and items that were
        known below an unreadable folder are UNVERIFIED, not missing.
        """
        roots = [os.path.abspath(r) for r in roots]
        for a in roots:
            for b in roots:
                if a != b:
                    outside(a, [b])
        if "://" not in self.store:
            outside(self.store, roots)
        with single_writer(self.store):
            sinks.claim_store(self.spark, self.store)
            known = self.runs()
            run = max([*known, *(s["run"] for s in self.scans())], default=0) + 1
            ids = self.root_ids()
            ids |= {r: len(ids) + k for k, r in enumerate((r for r in sorted(roots) if r not in ids), 1)}
            begun = {"run": run, "started_utc": now(), "roots": roots, "root_ids": ids}
            self.mark(begun | {"status": "RUNNING"})
            try:
                merged, diagnostics = self.merged(roots, run, rehash, ids)
                diagnostics.write.mode("errorifexists").parquet(f"{self.store}/diagnostics/run={run}")
                sinks.write_run(merged, self.store, run)
            except BaseException:
                self.mark(begun | {"status": "FAILED", "completed_utc": now()})
                raise
            counted = index.statistics(self.index(run)).first().asDict()
            self.mark(begun | {"status": "COMPLETED", "completed_utc": now(), "statistics": counted})
        return index.statistics(self.index(run))

    def merged(self, roots: list[str], run: int, rehash: bool, ids: dict[str, int]) -> tuple[DataFrame, DataFrame]:
        """The next index and the diagnostics of the listing and of the reads."""
        entries = relations.checkpointed(guarded.walk(self.spark, roots))
        named = self.spark.createDataFrame(list(ids.items()), "root string, root_id int")
        item = C.extension(F.col("path")).isin(*files.ITEM_EXTENSIONS) & F.col("kind").isin("REGULAR_FILE", "REPARSE", "UNKNOWN") & (F.col("status") != "ENUMERATION_ERROR")
        # a root is one of the item's folders
        found = entries.where(item).select("path", F.col("size").alias("size"), F.col("mtime_ns").alias("mtime"), F.explode(C.ancestors(F.col("path"))).alias("root")).join(F.broadcast(named.where(F.col("root").isin(roots))), "root")
        old = self.index().drop("outcome", "counted") if self.runs() else self.spark.createDataFrame([], INDEX)
        before = old.where("status = 'OK' AND content_id IS NOT NULL").select("path", "size", "mtime")
        fresh = found if rehash else found.join(before.select("path", F.struct("size", "mtime").alias("stamp")), "path", "left").where(~F.struct("size", "mtime").eqNullSafe(F.col("stamp")))
        read = relations.checkpointed(guarded.read_charts(fresh.select("path").repartition("path"))).withColumnRenamed("status", "read")
        seen = found.join(read.select("path", "read", "sha256", "md5", "size_after", "mtime_after"), "path", "left")
        seen = seen.select(
            "path", "root", "root_id", F.coalesce("size_after", "size", F.lit(-1)).alias("size"), F.coalesce("mtime_after", "mtime", F.lit(0)).alias("mtime"), F.col("sha256").alias("content_id"), "md5",
            F.when(F.col("read").isNull() | (F.col("read") == "SUCCESS"), "OK").when(F.col("read") == "UNSTABLE", "UNSTABLE").otherwise("ERROR").alias("status"),
        )
        said = entries.select(
            F.when(F.col("kind") == "REPARSE", "WARNING").otherwise("ERROR").alias("severity"),
            F.when(F.col("status") == "ENUMERATION_ERROR", "DIRECTORY_UNREADABLE").when(F.col("status") == "METADATA_ERROR", "ENTRY_METADATA").when(F.col("kind") == "REPARSE", "REPARSE_SKIPPED").alias("code"), "path",
        ).where("code IS NOT NULL")
        failed = read.where("read <> 'SUCCESS'").select(F.lit("ERROR").alias("severity"), F.when(F.col("read") == "UNSTABLE", "CHART_UNSTABLE").otherwise("CHART_READ").alias("code"), "path")
        blocked = said.select(F.col("path").alias("blocked"))
        merged = index.merge(old, seen, run, rehash, self.spark.createDataFrame([(r,) for r in roots], "root string"), blocked)
        return merged, said.unionByName(failed)

    def mark(self, scan: dict) -> None:
        """One state of a scan, as a small file that is never written again."""
        folder = jpath(self.spark, f"{self.store}/scans")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        out = fs.create(jpath(self.spark, f"{self.store}/scans/{scan['run']:08d}-{scan['status']}.json"), False)
        try:
            out.write(bytearray(json.dumps(scan).encode()))
        finally:
            out.close()

    def scans(self) -> list[dict]:
        """The scans begun so far with their last state; one that says RUNNING without a writer was interrupted."""
        folder = jpath(self.spark, f"{self.store}/scans")
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        last: dict[int, dict] = {}
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            stream = fs.open(f.getPath())
            try:
                scan = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
            if scan["run"] not in last or last[scan["run"]]["status"] == "RUNNING":
                last[scan["run"]] = scan
        return [s if s["status"] != "RUNNING" else s | {"status": "FAILED"} for _, s in sorted(last.items())]

    def root_ids(self) -> dict[str, int]:
        """Every root ever scanned and its number."""
        return {r: k for s in self.scans() for r, k in s["root_ids"].items()}

    def diagnostics(self, run: int | None = None) -> DataFrame:
        run = run or self.runs()[-1]
        return self.spark.read.schema("severity string, code string, path string").parquet(f"{self.store}/diagnostics/run={run}")

    def items(self, run: int | None = None) -> DataFrame:
        i = self.index(run)
        return i.withColumn("container", C.parent(F.col("path")))

    def report(self, folder: str, run: int | None = None) -> dict[str, int]:
        """duplicate_charts.csv, folder_candidates.csv, clusters.csv, diagnostics.csv and summary.json in a new folder; counts of each.

        Folders that were not read whole take no part in relations. The folder may lie neither in a root nor around the store.
        """
        if "://" not in folder:
            outside(folder, list(self.root_ids()))
            if os.path.commonpath([os.path.realpath(folder), os.path.realpath(self.store)]) == os.path.realpath(folder):
                raise ValueError(f"{folder} holds the store")
            if os.path.isdir(folder) and os.listdir(folder):
                raise ValueError(f"{folder} is not empty")
            os.makedirs(folder, exist_ok=True)
        run = run or (self.runs() or [0])[-1]
        i, said = self.items(run), self.diagnostics(run)
        broken = relations.checkpointed(relations.incomplete_containers(i, said))
        whole = relations.eligible(i).join(broken, "container", "left_anti")
        dup = relations.checkpointed(relations.duplicates(relations.eligible(i)))
        pairs = relations.checkpointed(relations.pairs(whole))
        related = relations.checkpointed(relations.numbered(relations.related_clusters(pairs), "RELATED"))
        exact = relations.checkpointed(relations.numbered(relations.exact_clusters(whole), "EXACT_ONLY"))
        ticks = F.col("mtime").cast("decimal(38,0)") / 100
        rows = dup.select(
            F.col("content_id").alias("sha256"), "md5", F.col("locations").alias("group_paths"), "root_id", F.col("path").alias("absolute_path"), F.col("container").alias("parent_folder"), C.name(F.col("path")).alias("filename"),
            C.extension(F.col("path")).alias("extension"), "size", C.ticks_to_text(F.floor(ticks).cast("long") + F.lit(C.TICKS_AT_EPOCH)).alias("mtime_utc"),
        )
        sinks.write_csv_file(rows, f"{folder}/duplicate_charts.csv", "sha256", "absolute_path")
        sides = {"a": "folder_a", "b": "folder_b", "physical_a": "physical_files_a", "physical_b": "physical_files_b", "items_a": "charts_a", "items_b": "charts_b"}
        sinks.write_csv_file(pairs.withColumnsRenamed(sides), f"{folder}/folder_candidates.csv", "folder_a", "folder_b")
        both = related.unionByName(exact)
        sized = both.join(both.groupBy("cluster_id").agg(F.count("*").alias("folder_count")), "cluster_id").select("kind", "cluster_id", "folder_count", F.col("container").alias("folder_path"))
        sinks.write_csv_file(sized, f"{folder}/clusters.csv", "kind", "cluster_id", "folder_path")
        sinks.write_csv_file(said, f"{folder}/diagnostics.csv", "severity", "code", "path")
        spread = lambda c: {str(r["size"]): r.clusters for r in relations.size_distribution(c.withColumnRenamed("cluster_id", "cluster_key")).orderBy("size").collect()}
        s = relations.summary(i, said).first()
        scan = next((x for x in self.scans() if x["run"] == run), {})
        counts = {"duplicates": dup.count(), "pairs": pairs.count(), "related": related.select("cluster_id").distinct().count(), "exact": exact.select("cluster_id").distinct().count()}
        summary = {
            "scan_id": run, "scan_started_utc": scan.get("started_utc"), "scan_completed_utc": scan.get("completed_utc"), "roots": scan.get("roots"), "current_chart_files": s.current, "verified_chart_files": s.verified,
            "unverified_previously_indexed_chart_files": s.unverified, "unique_sha256": s.unique_contents, "unique_md5": s.unique_md5, "physical_chart_folders": s.containers,
            "analyzed_chart_folders": whole.select("container").distinct().count(), "incomplete_folders": broken.count(), "duplicate_sha256_groups": dup.select("content_id").distinct().count(), "candidate_folder_pairs": counts["pairs"],
            "relationship_counts": {r.relationship: r.n for r in relations.label_counts(pairs).collect()}, "cluster_count": counts["related"], "cluster_size_distribution": spread(related),
            "exact_only_cluster_count": counts["exact"], "exact_only_cluster_size_distribution": spread(exact), "hash_cache_statistics": scan.get("statistics"), "warning_count": s.warnings, "error_count": s.errors,
        }
        sinks.publish_json(summary, f"{folder}/summary.json")
        return counts

    def tree(self, root: str) -> DataFrame:
        """What lies under root as a tree: path from root on, kind, digest, is_item, native_id.

        Listed and read as in a scan: by parts, links not followed, a file's digest counted only if it stayed as it was. A
        tree with entries that can't be observed so raises Unreadable, which names how many and the first.
        """
        base = os.path.realpath(root)
        entries = relations.checkpointed(guarded.walk(self.spark, [base]))
        read = relations.checkpointed(guarded.read_charts(entries.where("kind = 'REGULAR_FILE'").select("path").repartition("path")))
        bad = entries.where("status <> 'OK' OR kind NOT IN ('REGULAR_FILE', 'DIRECTORY')").select("path").unionByName(read.where("status <> 'SUCCESS'").select("path"))
        first = bad.agg(F.count("*").alias("n"), F.min("path").alias("path")).first()
        if first.n:
            raise Unreadable(f"{first.n} entries under {root} can't be observed, {first.path} first")
        path = F.when(F.col("path") == base, F.lit(".")).otherwise(F.substr("path", F.lit(len(base.rstrip("/")) + 2)))
        item = (F.col("kind") == "REGULAR_FILE") & C.extension(F.col("path")).isin(*files.ITEM_EXTENSIONS)
        return entries.join(read.select("path", "sha256"), "path", "left").select(path.alias("path"), "kind", F.col("sha256").alias("digest"), item.alias("is_item"), "native_id")

    def compare(self, a: str, b: str) -> dict[str, DataFrame]:
        x, y = relations.checkpointed(self.tree(a)), relations.checkpointed(self.tree(b))
        return {"entries": compare.tree_diff(x, y), "groups": compare.digest_groups(x, y), "flags": compare.pair_flags(x, y), "conflicts": compare.conflicts(x, y), "labels": compare.pair_labels(x, y), "items": compare.item_set_state(x, y)}

    def extract(self, root: str) -> DataFrame:
        f = files.tree(self.spark, root)
        # a file beyond the bound keeps its row, with SIZE_LIMIT; one byte more than the bound is enough to tell
        content = F.expr(f"IF(length > {8 << 20}, substring(content, 1, {(8 << 20) + 1}), content)").alias("content")
        return extract.extracted(f.where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*files.ITEM_EXTENSIONS)).select("path", content))

    def resolve(self, charts: DataFrame, inventory: DataFrame) -> dict[str, DataFrame]:
        """What the charts' usages bind to, and which files of the inventory (path) their declarations name."""
        d = charts.select("path", F.explode("declarations").alias("d")).select(F.concat_ws("#", "path", F.col("d.id").cast("string")).alias("ref"), C.parent(F.col("path")).alias("base"), F.col("d.written_path").alias("authored"))
        a = symbolic.analysed(resolve.facts(charts))
        proof = resolve.proofs(a, resolve.evidence(a.facts, inventory))
        return {"paths": resolve.resolved(d.where("authored IS NOT NULL"), inventory), "usages": a.usages, "relations": a.relations, "coexistence": a.coexistence, "obligations": a.obligations, "proof": proof}

    def bindings(self, root: str, tree: DataFrame) -> DataFrame:
        """key, target: for each usage and declaration of the root's charts that may bind, the files and digests it may mean."""
        base = F.lit(os.path.realpath(root) + "/")
        charts = self.extract(root).withColumn("path", F.substr(F.regexp_replace("path", "^file:/+", "/"), F.length(base) + 1))
        a = symbolic.analysed(resolve.facts(relations.checkpointed(charts)))
        d = a.facts.where("kind = 'DECLARATION' AND written_path IS NOT NULL")
        refs = d.select(F.struct("path", F.col("id").alias("declaration")).alias("ref"), C.parent(F.col("path")).alias("base"), F.col("written_path").alias("authored"))
        files_ = tree.where("kind = 'REGULAR_FILE'").select(F.col("path").alias("found"), "digest")
        found = resolve.resolved(refs, files_.select(F.col("found").alias("path"))).select("ref.path", "ref.declaration", F.explode("candidates").alias("found")).join(files_, "found")
        near = a.relations.where(F.col("compatibility") == symbolic.MAY_BIND)
        return near.join(found, ["path", "declaration"]).select(F.concat_ws("#", "path", "usage", "declaration").alias("key"), F.concat_ws(":", "found", "digest").alias("target"))

    def classify(self, roots: list[str], limits: classify.Limits = classify.Limits()) -> classify.Classification:
        """Every two roots compared by what lies under them and by what their charts may bind."""
        trees = [relations.checkpointed(self.tree(r)) for r in roots]
        of = lambda df, k: df.select(F.lit(os.path.realpath(roots[k])).alias("root"), "*")
        both = lambda parts: functools.reduce(DataFrame.unionByName, (of(p, k) for k, p in enumerate(parts)))
        where = self.spark.createDataFrame([(os.path.realpath(r),) * 2 for r in roots], "root string, path string")
        return classify.classified(where, both(trees), limits, both([self.bindings(r, t) for r, t in zip(roots, trees)]))

    def plan(self, roots: list[str]) -> dict[str, DataFrame]:
        """Two to six trees: virtual entries, ledger, the lattice and its maximal groups, what a check of the plan finds, and
        the roots that a maximal group leaves out as variants."""
        if not 2 <= len(roots) <= plan.MAX_ROOTS:
            raise ValueError(f"2 to {plan.MAX_ROOTS} roots")
        for a in roots:
            if sum(os.path.samefile(a, b) for b in roots) > 1:
                raise ValueError(f"{a} is named twice")
            for b in roots:
                if a != b:
                    outside(a, [b])
        e = None
        for k, r in enumerate(roots):
            own = self.tree(r).drop("native_id").withColumn("root", F.lit(k)).withColumn("entry", F.xxhash64("path"))
            e = own if e is None else e.unionByName(own)
        e = relations.checkpointed(e)
        clash = e.groupBy(compare.folded(F.col("path")).alias("k")).agg(F.count_distinct(F.struct("path", "kind", F.coalesce("digest", F.lit("")).alias("x"))).alias("n"), F.min("path").alias("path")).where("n > 1").select("path")
        v, ledger, lattice = plan.virtual_entries(e, clash), plan.ledger(e, clash), plan.subsets(e)
        return {"entries": v, "ledger": ledger, "lattice": lattice, "maximal": (best := plan.maximal(lattice)), "group": group.group_plan(e), "entries_of_roots": e, "variants": group.members(e, best).where("NOT inside").drop("inside"), "violations": plan.verify_plan(e, v, ledger)}

    def store_plan(self, roots: list[str], folder: str) -> None:
        """The tables of a group plan over the roots, written once under folder, which may not lie in a root."""
        outside(folder, roots)
        for name, table in self.plan(roots)["group"].items():
            table.write.mode("errorifexists").parquet(f"{folder}/{name}")

    def verify_plan(self, roots: list[str], folder: str) -> DataFrame:
        """What a stored group plan says otherwise than the roots as they are now."""
        parts = self.plan(roots)
        return group.verify_group(parts["entries_of_roots"], {k: self.spark.read.parquet(f"{folder}/{k}") for k in parts["group"]})

    def verify(self, run: int | None = None) -> DataFrame:
        """Rows of a run's index that break a rule."""
        return validate.item_rules(self.items(run))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="kinfold")
    p.add_argument("--store", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    scan = sub.add_parser("scan")
    scan.add_argument("--root", action="append", required=True)
    scan.add_argument("--rehash-all", action="store_true")
    for name in ("report", "verify"):
        x = sub.add_parser(name)
        x.add_argument("--run", type=int)
        if name == "report":
            x.add_argument("--output", required=True)
    for name in ("compare", "plan"):
        sub.add_parser(name).add_argument("--root", action="append", required=True)
    for name in ("group-plan", "group-verify", "inspect", "resolve", "classify"):
        x = sub.add_parser(name)
        x.add_argument("--root", action="append", required=True)
        x.add_argument("--output", required=True)
    x = sub.add_parser("observe")  # with --output the accepted stage is exported, without it taken
    x.add_argument("stage", choices=observe.STAGES)
    x.add_argument("--root", action="append")
    x.add_argument("--accepted")
    x.add_argument("--output")
    x.add_argument("--reports")  # a new folder for the report set of the accepted stage
    args = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("kinfold").getOrCreate(), args.store)
    try:
        if args.command == "scan":
            engine.scan(args.root, args.rehash_all).show()
        elif args.command == "report":
            print(engine.report(args.output, args.run))
        elif args.command == "verify":
            return INCOMPLETE if not engine.verify(args.run).isEmpty() else DONE
        elif args.command == "group-plan":
            engine.store_plan(args.root, args.output)
        elif args.command == "group-verify":
            return DONE if engine.verify_plan(args.root, args.output).isEmpty() else INCOMPLETE
        elif args.command == "classify":
            outside(args.output, args.root)
            found = engine.classify(args.root)
            for name in ("roots", "pairs", "differences", "groups", "conflicts", "diagnostics"):
                getattr(found, name).write.mode("errorifexists").parquet(f"{args.output}/{name}")
            return DONE if found.state() == "COMPLETE" else INCOMPLETE
        elif args.command in ("inspect", "resolve"):
            outside(args.output, args.root)
            charts = relations.checkpointed(functools.reduce(DataFrame.unionByName, (engine.extract(r) for r in args.root)))
            if args.command == "inspect":
                charts.write.mode("errorifexists").parquet(args.output)
            else:
                found = functools.reduce(DataFrame.unionByName, (files.stats(files.tree(engine.spark, r)).select("path") for r in args.root))
                for name, table in engine.resolve(charts, found).items():
                    table.write.mode("errorifexists").parquet(f"{args.output}/{name}")
            return DONE if charts.where("coverage <> 'COMPLETE_SUPPORTED_SYNTAX'").isEmpty() else INCOMPLETE
        elif args.command == "observe":
            o = observe.Observation(engine.spark, args.store)
            if args.stage == "SOURCE":
                if len(args.root or ()) != 2:
                    raise ValueError("SOURCE takes two roots")
                print(o.capture(*args.root))
            elif args.reports:
                print(o.reports(args.stage, args.accepted, args.reports)["result"])
            elif args.output:
                print(o.export(args.stage, args.accepted, args.output))
            else:
                print((o.preflight if args.stage == "PREFLIGHT" else o.content)(args.accepted))
        elif args.command == "compare":
            parts = engine.compare(*args.root)
            for k in ("flags", "labels", "items"):
                parts[k].show(truncate=False)
        else:
            parts = engine.plan(args.root)
            parts["maximal"].show()
            return DONE if parts["violations"].isEmpty() and parts["variants"].isEmpty() else INCOMPLETE
    except (ValueError, FileExistsError, Busy, observe.Stopped, relations.PairBudgetExceeded) as e:
        print(e, file=sys.stderr)
        return FAILED
    return DONE
