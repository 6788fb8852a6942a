"""Quality rules by host: per-document rules, failures per host shrunk by an empirical beta prior, verdicts joined back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MAX_HOST_RATE = 0.5
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, how many words lie in a window of WINDOW words that the text holds twice or more."""
    total = np.zeros(len(counts), np.int64)
    start, h = common.windows(words, counts, WINDOW)
    if not len(start):
        return total
    doc = np.repeat(np.arange(len(counts)), counts)
    key = h + doc[start].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    found = np.sort(key)
    twice = np.unique(found[1:][found[1:] == found[:-1]])
    if not len(twice):
        return total
    hit = start[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    edge = np.zeros(len(words) + 1, np.int64)
    edge[hit] += 1
    np.subtract.at(edge, hit + WINDOW, 1)
    covered = np.cumsum(edge[:-1]) > 0
    return total + np.bincount(doc[covered], minlength=len(counts))


def text_stats(texts: list[bytes]) -> dict[str, list | np.ndarray]:
    words, counts, points = common.hashed_words(texts)
    dup = []
    for t in texts:
        lines = t.split(b"\n")
        if len(set(lines)) != len(lines):
            lines = [x for x in lines if x.strip()]
        dup.append(len(lines) - len(set(lines)))
    return {
        "n_words": counts,
        "word_chars": points,
        "n_symbols": [len(t) - len(t.translate(None, SYMBOLS)) for t in texts],
        "n_dup_lines": dup,
        "n_repeat_words": repeated_words(words, counts),
    }


def document_stats(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the rule figures of each whole text. Null text has no words and one empty line."""

    def measure(batches):
        for part in common.slices(batches, "text"):
            stats = text_stats(common.utf8(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(stats[k], pa.int64()) for k in STATS)], names=["doc_id", "host", *STATS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, host string, " + ", ".join(f"{k} long" for k in STATS)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return common.in_arrow(docs.select("doc_id", F.col(host).cast("string").alias("host"), "text"), measure, schema).withColumn("base_failed", failed)


def host_verdicts(stats: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """host, host_docs, host_failed, host_rate, host_rejected for each host that is not null.

    The beta prior is fitted by moments: its mean is the overall failure rate, its strength comes from the variance
    between hosts that sampling alone does not explain. Counts are added map-side, so a host of any size is one row.
    """
    hosts = stats.where(F.col("host").isNotNull()).groupBy("host").agg(F.count("*").alias("host_docs"), F.count_if("base_failed").alias("host_failed"))
    hosts = common.checkpointed(hosts)
    n, k = F.col("host_docs").cast("double"), F.col("host_failed").cast("double")
    fit = hosts.agg(F.sum(n).alias("N"), F.sum(k).alias("K"), F.count("*").alias("H"), F.sum(k * k / n).alias("Q"))
    m, noise = F.col("K") / F.col("N"), F.col("K") / F.col("N") * (1 - F.col("K") / F.col("N"))
    between = F.col("Q") / F.col("N") - m * m - noise * F.col("H") / F.col("N")
    strength = F.when((noise > 0) & (between > 0), F.least(F.greatest(noise / between - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
    fit = fit.where(F.col("N") > 0).select(m.alias("m"), strength.alias("s"))
    rate = (k + F.col("m") * F.col("s")) / (n + F.col("s"))
    # fit is an aggregate without keys: one row
    return hosts.join(F.broadcast(fit)).select("host", "host_docs", "host_failed", rate.alias("host_rate"), (rate > max_rate).alias("host_rejected"))


def quality_rules(docs: DataFrame, host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row for each row of docs: its figures, base_failed, kept and the host's figures.

    kept is false if the document fails a rule itself or its host's shrunk failure rate is above max_rate. A null
    host has no verdict: its documents stand on their own. Repeated rows count and return as often as they occur. A
    long text is measured whole, at some bytes a word. An empty table gives no rows. Extra columns of docs are ignored.
    """
    stats = common.checkpointed(document_stats(docs, host))
    verdicts = common.small_or_not(host_verdicts(stats, max_rate), 100_000)
    out = stats.join(verdicts, "host", "left")
    kept = ~F.col("base_failed") & ~F.coalesce("host_rejected", F.lit(False))
    return out.select("doc_id", *STATS, "base_failed", kept.alias("kept"), "host", "host_docs", "host_failed")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(common.table(spark, sf_dir, "documents")).drop("host")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept rows of docs. Verdicts join back by id and text, so rows that share an id keep their own."""
    key = F.xxhash64("doc_id", "text")
    kept = quality_rules(docs.select(key.alias("doc_id"), "text", "source")).where("kept").select(F.col("doc_id").alias("__kf_key")).distinct()
    return docs.withColumn("__kf_key", key).join(kept, "__kf_key", "left_semi").drop("__kf_key")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
l AS (SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id, line),
dup AS (SELECT doc_id, sum(n - 1) AS n_dup_lines FROM l GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(words[i:i+7], ' ') AS gram
        FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
hit AS (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM hit GROUP BY doc_id),
s AS (SELECT w.doc_id, w.source, len(words) AS n_words, coalesce(length(array_to_string(words, '')), 0) AS word_chars,
             length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s),
h AS (SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE base_failed) AS host_failed FROM b WHERE source IS NOT NULL GROUP BY source),
f AS (SELECT sum(host_docs)::DOUBLE AS n, sum(host_failed)::DOUBLE AS k, count(*) AS h, sum(host_failed::DOUBLE * host_failed / host_docs) AS q FROM h),
p AS (SELECT k / n AS m, k / n * (1 - k / n) AS noise, q / n - (k / n) * (k / n) - k / n * (1 - k / n) * h / n AS between_ FROM f),
g AS (SELECT m, CASE WHEN noise > 0 AND between_ > 0 THEN least(greatest(noise / between_ - 1, 1.0), 1e6) ELSE 1e6 END AS s FROM p),
v AS (SELECT source, host_docs, host_failed, (host_failed + m * s) / (host_docs + s) > 0.5 AS rejected FROM h, g)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(rejected, false) AS kept, host_docs, host_failed
FROM b LEFT JOIN v USING (source)
"""
