"""Observation of two trees in stages whose digests are accepted one by one: SOURCE, PREFLIGHT, CONTENT.

Records are appended once, each naming the digest of the one before it. Tables of a stage lie beside its record; the
record holds their seals, so it stays small whatever the trees hold.
"""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.functions import columns as C
from kinfold.operators import compare, merkle, reports
from kinfold.operators.relations import checkpointed
from kinfold.sources import files, guarded, sinks

RECORD = "name string, state string, parent string, digest string, payload string"
STAGES = ("SOURCE", "PREFLIGHT", "CONTENT")
INVENTORY = ["root", "path", "kind", "size", "mtime_ns", "native_id", "is_item", "full"]
CONTENT = ["root", "path", "kind", "digest", "is_item", "native_id"]


class Stopped(RuntimeError):
    """A budget is used up or evidence is stale: state and code say which."""

    def __init__(self, state: str, code: str):
        super().__init__(f"{state}: {code}")
        self.state, self.code = state, code


class Inadmissible(ValueError):
    """Evidence that is missing, altered, or not the accepted one."""


@dataclass(frozen=True)
class Budget:
    """Bounds of one observation. They may be lowered; None takes a bound away, for trees of any size."""

    entries: int | None = 8192
    files: int | None = 4096
    depth: int | None = 32
    file_bytes: int | None = 256 << 20
    total_bytes: int | None = 1 << 30
    payload_bytes: int = 16 << 20
    report_bytes: int = 32 << 20

    def __post_init__(self):
        for f in fields(self):
            v = getattr(self, f.name)
            if v is None and f.default is not None and f.name not in ("payload_bytes", "report_bytes"):
                continue
            if not isinstance(v, int) or not 0 < v <= f.default:
                raise ValueError(f"{f.name} must lie between 1 and {f.default}")


def within(entries: DataFrame, budget: Budget) -> DataFrame:
    """entries (path relative to its root, kind, size), or Stopped if together they pass the budget. One aggregate."""
    file = F.col("kind") == "REGULAR_FILE"
    deep = F.when(F.col("path") == ".", 0).otherwise(C.depth(F.col("path")) + 1)
    t = entries.agg(F.count("*").alias("entries"), F.count_if(file).alias("files"), F.max(deep).alias("depth"), F.max("size").alias("file_bytes"), F.sum("size").alias("total_bytes")).first()
    for name, code in (("entries", "INVENTORY_BUDGET_EXCEEDED"), ("depth", "INVENTORY_BUDGET_EXCEEDED"), ("files", "PAYLOAD_SCOPE_BUDGET_EXCEEDED"), ("file_bytes", "PAYLOAD_SCOPE_BUDGET_EXCEEDED"), ("total_bytes", "PAYLOAD_SCOPE_BUDGET_EXCEEDED")):
        most = getattr(budget, name)
        if most is not None and (t[name] or 0) > most:
            raise Stopped("INCOMPLETE", code)
    return entries


def text(value: dict) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def record_digest(name: str, parent: str | None, payload: str) -> str:
    """As validate.chained reckons it."""

    def token(x: str | None) -> bytes:
        return b"\xff\xff\xff\xff" if x is None else len(x.encode()).to_bytes(4, "big") + x.encode()

    return hashlib.sha256(token(name) + token(parent) + token(payload)).hexdigest()


class Observation:
    """Two roots observed into a new folder."""

    def __init__(self, spark: SparkSession, folder: str, budget: Budget = Budget()):
        self.spark, self.folder, self.budget = spark, folder, budget

    def put(self, name: str, parent: str | None, payload: dict) -> str:
        """Appends a record and gives its digest. A name is used once; the parent must be there."""
        body = text(payload)
        if len(body.encode()) > self.budget.payload_bytes:
            raise Stopped("INCOMPLETE", "PAYLOAD_BUDGET_EXCEEDED")
        if parent is not None and self.record(STAGES[STAGES.index(name) - 1])["digest"] != parent:
            raise Inadmissible(f"{name}: {parent} is not the digest of the stage before it")
        digest = record_digest(name, parent, body)
        self.spark.createDataFrame([(name, "COMPLETE", parent, digest, body)], RECORD).coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/records/{name}")
        return digest

    def record(self, name: str) -> dict:
        path = f"{self.folder}/records/{name}"
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            raise Inadmissible(f"no record {name}")
        (row,) = files.table(self.spark, path, RECORD).collect()
        return row.asDict()

    def records(self, upto: str) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(*[f"{self.folder}/records/{n}" for n in STAGES[: STAGES.index(upto) + 1]])

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/tables/{name}")

    def keep(self, name: str, df: DataFrame, columns: list[str]) -> dict:
        """df written once, and its seal as read back."""
        df.select(columns).write.mode("errorifexists").parquet(f"{self.folder}/tables/{name}")
        own = self.table(name)
        return {"rows": own.count(), "columns": columns, "seal": merkle.root(merkle.tree(own, columns, ["root", "path"]))}

    def capture(self, a: str, b: str) -> str:
        """SOURCE: the two roots and the bounds; reads no content. Roots that overlap each other or the folder are refused."""
        own = [os.path.realpath(x) for x in (a, b)]
        for x, y in ((own[0], own[1]), (own[0], os.path.realpath(self.folder)), (own[1], os.path.realpath(self.folder))):
            if os.path.commonpath([x, y]) in (x, y):
                raise ValueError(f"{x} and {y} overlap")
        roots = [guarded.facts(x) for x in own]
        if any(r["kind"] != "DIRECTORY" for r in roots):
            raise Stopped("STALE", "ROOT_NOT_A_DIRECTORY")
        return self.put("SOURCE", None, {"roots": [{"path": r["path"], "native_id": r["native_id"]} for r in roots], "budget": asdict(self.budget)})

    def preflight(self, accepted: str) -> str:
        """PREFLIGHT: every entry of both trees, within the budget. An entry that can't be observed stops it."""
        source = json.loads(self.admit("SOURCE", accepted)["payload"])
        parts = []
        for k, r in enumerate(source["roots"]):
            if guarded.facts(r["path"])["native_id"] != r["native_id"]:
                raise Stopped("STALE", "ROOT_CHANGED")
            try:
                own = guarded.walk(self.spark, [r["path"]], self.budget.depth or 1 << 10)
            except guarded.TooDeep:
                raise Stopped("INCOMPLETE", "INVENTORY_BUDGET_EXCEEDED") from None
            path = F.when(F.col("path") == r["path"], F.lit(".")).otherwise(F.substr("path", F.lit(len(r["path"].rstrip("/")) + 2)))
            item = (F.col("kind") == "REGULAR_FILE") & C.extension(F.col("path")).isin(*files.ITEM_EXTENSIONS)
            parts.append(own.withColumns({"full": F.col("path"), "root": F.lit(k), "is_item": item}).withColumn("path", path))
        entries = parts[0].unionByName(parts[1])
        if not entries.where("status <> 'OK' OR kind NOT IN ('REGULAR_FILE', 'DIRECTORY')").isEmpty():
            raise Stopped("INCOMPLETE", "INVENTORY_INCOMPLETE")
        within(entries, self.budget)
        return self.put("PREFLIGHT", accepted, {"inventory": self.keep("inventory", entries, INVENTORY)})

    def content(self, accepted: str) -> str:
        """CONTENT: the digest of every file as accepted at PREFLIGHT. A file that is another by now makes it stale."""
        self.admit("PREFLIGHT", accepted)
        inventory = self.table("inventory")
        expected = inventory.where("kind = 'REGULAR_FILE'").withColumn("path", F.col("full"))
        read = checkpointed(guarded.read_content(expected))  # a second evaluation might see other files
        try:
            guarded.refuse_stale(read)
        except guarded.StaleSource:
            raise Stopped("STALE", "SOURCE_CHANGED") from None
        if not read.where("status <> 'SUCCESS'").isEmpty():
            raise Stopped("INCOMPLETE", "CONTENT_INCOMPLETE")
        entries = inventory.join(read.select(F.col("path").alias("full"), F.col("sha256").alias("digest")), "full", "left")
        return self.put("CONTENT", accepted, {"content": self.keep("content", entries, CONTENT)})

    def admit(self, stage: str, accepted: str) -> dict:
        """The record of a stage, if the chain up to it holds, its digest is the accepted one and its tables have their seals.

        The budget is that of SOURCE from here on.
        """
        known = [self.record(n) for n in STAGES[: STAGES.index(stage) + 1]]
        for before, r in zip([None, *known], known):
            if r["state"] != "COMPLETE" or r["parent"] != (before and before["digest"]) or r["digest"] != record_digest(r["name"], r["parent"], r["payload"]):
                raise Inadmissible(f"record {r['name']} does not hold")
            for name, want in json.loads(r["payload"]).items():
                if isinstance(want, dict) and "seal" in want:
                    own = self.table(name)
                    if own.count() != want["rows"] or merkle.root(merkle.tree(own, want["columns"], ["root", "path"])) != want["seal"]:
                        raise Inadmissible(f"table {name} is not as it was sealed")
        if known[-1]["digest"] != accepted:
            raise Inadmissible(f"{accepted} is not the digest of {stage}")
        self.budget = Budget(**json.loads(known[0]["payload"])["budget"])
        return known[-1]

    def compared(self, accepted: str) -> dict[str, DataFrame]:
        """The comparison of both trees by their content, from the accepted CONTENT."""
        self.admit("CONTENT", accepted)
        a, b = (self.table("content").where(F.col("root") == k).drop("root") for k in (0, 1))
        return {"entries": compare.tree_diff(a, b), "groups": compare.digest_groups(a, b), "flags": compare.pair_flags(a, b), "conflicts": compare.conflicts(a, b), "labels": compare.pair_labels(a, b), "items": compare.item_set_state(a, b)}

    def verify(self, stage: str, accepted: str) -> dict:
        """What an admitted stage says. Nothing in it claims that the trees are so now, or that one may go."""
        r = self.admit(stage, accepted)
        return {"stage": stage, "state": r["state"], "digest": r["digest"], "pair_state": "COMPLETE" if stage == "CONTENT" else "BLOCKED", "current_freshness": "UNKNOWN", "removal_authority": False}

    def export(self, stage: str, accepted: str, path: str) -> dict:
        """verify(), its chain and the counts of the comparison as one new JSON document."""
        out = self.verify(stage, accepted)
        report = {"result": out, "records": [self.record(n) for n in STAGES[: STAGES.index(stage) + 1]]}
        if stage == "CONTENT":
            c = self.compared(accepted)
            report |= {"flags": c["flags"].first().asDict(), "labels": c["labels"].first().labels, "items": c["items"].first().asDict(), "counts": compare.difference_counts(c["entries"]).first().asDict()}
        if len(json.dumps(report, ensure_ascii=False).encode()) > self.budget.report_bytes:
            raise Stopped("FAILED", "REPORT_BUDGET_EXCEEDED")
        sinks.publish_json(report, path)
        return out

    def reports(self, stage: str, accepted: str, folder: str) -> dict:
        """The report set of an admitted stage in a new folder: its tables as CSV, summary.json last.

        A set begins with a mark RUNNING and ends with COMPLETED, each a file of its own that is written once; a folder
        without the second is an export that was interrupted. The summary has a receipt of every file, read back.
        """
        out = self.verify(stage, accepted)
        if stage == "SOURCE":
            raise Inadmissible("SOURCE has no tables to report")
        os.makedirs(folder)
        sinks.publish_json({"state": "RUNNING", "stage": stage, "digest": accepted}, f"{folder}/_export-RUNNING.json")
        entries = self.table("inventory")
        tables = reports.preflight_set(entries)
        if stage == "CONTENT":
            a, b = (self.table("content").where(F.col("root") == k).drop("root") for k in (0, 1))
            tables |= reports.content_set(a, b)
        for name, (df, order) in tables.items():
            sinks.write_csv_file(df, f"{folder}/{name}", *order)
        written = {os.path.basename(r.path): {"bytes": r.bytes, "sha256": r.sha256} for r in sinks.receipts(self.spark, folder).where("path LIKE '%.csv'").collect()}  # a row for each table
        summary = {"result": out, "inventory": reports.shared_paths(entries).first().asDict(), "files": written}
        sinks.publish_json(summary, f"{folder}/summary.json")
        sinks.publish_json({"state": "COMPLETED", "stage": stage, "digest": accepted}, f"{folder}/_export-COMPLETED.json")
        return summary


def export_state(folder: str) -> str:
    """COMPLETED, or FAILED for a report set that began and did not end, or NONE."""
    names = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    return "COMPLETED" if "_export-COMPLETED.json" in names else "FAILED" if "_export-RUNNING.json" in names else "NONE"
