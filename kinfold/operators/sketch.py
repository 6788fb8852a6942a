"""Reconciliation by an invertible sketch: two tables are compared by cells of sums, and only rows that differ are moved.

Each row goes into HASHES cells, one of each part of the sketch, with its hash, a check hash and its sign; equal rows of
both sides cancel. Cells are added up map-side, so the shuffle is as large as the sketch, whatever the tables. A cell
that holds one row, once or several times, gives that row's hash away; taking it out of its other cells opens further
ones. What is left over means that the sketch was too small; a larger one is tried, then the tables are joined whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.operators.validate import reconcile

HASHES = 3
#: Cells of a part of the sketch, tried one after the other. The driver reads at most HASHES times the last.
SIZES = (1 << 8, 1 << 12, 1 << 15)
MASK = (1 << 64) - 1


def places(h: int, size: int) -> tuple[int, ...]:
    """The cells of a row by its hash: other bits of it for each part of the sketch."""
    return tuple((((h & MASK) >> (20 * i)) & (size - 1)) + i * size for i in range(HASHES))


def check(h: int) -> int:
    """What a sum of hashes does not add up to: a product of parts of the hash, below 2^62."""
    return (h & 0x7FFFFFFF) * ((h & MASK) >> 33)


def hashed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with __h and __c: two hashes of the whole row; null and the empty string differ."""
    whole = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return df.withColumn("__h", F.xxhash64(whole)).withColumn("__c", F.xxhash64(F.lit(3), whole))


def cells(left: DataFrame, right: DataFrame, columns: list[str], size: int) -> DataFrame:
    """cell, n, h, c, k: counts and sums of both hashes and of check() of the rows in each cell, the right side's taken off."""
    one = lambda df, sign: hashed(df, columns).select("__h", "__c", F.lit(sign).alias("n"))
    rows = one(left, 1).unionByName(one(right, -1))
    at = F.array(*[F.shiftrightunsigned("__h", 20 * i).bitwiseAND(F.lit(size - 1)) + i * size for i in range(HASHES)])  # places() as a Column
    big = lambda c: (c.cast("decimal(20,0)") * F.col("n")).cast("decimal(38,0)")
    product = F.col("__h").bitwiseAND(F.lit(0x7FFFFFFF)) * F.shiftrightunsigned("__h", 33)  # check() as a Column
    spread = rows.select(F.explode(at).alias("cell"), "n", big(F.col("__h")).alias("h"), big(F.col("__c")).alias("c"), big(product).alias("k"))
    return spread.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("h").alias("h"), F.sum("c").alias("c"), F.sum("k").alias("k")).where("n <> 0 OR h <> 0 OR c <> 0")


@dataclass(frozen=True)
class Difference:
    """Signed numbers of rows by (hash, check): positive on the left only. None if the sketch doesn't decode."""

    rows: dict[tuple[int, int], int] | None
    size: int


def decoded(sums: dict[int, tuple[int, int, int, int]], size: int) -> dict[tuple[int, int], int] | None:
    """The rows whose cells these are; None if some cells stay mixed."""
    left, out, ready = dict(sums), {}, list(sums)
    while ready:
        n, h, c, k = left.get(ready.pop(), (0, 0, 0, 0))
        if not n or h % n or c % n or not -(1 << 63) <= h // n < 1 << 63 or k != n * check(h // n):
            continue  # none, or several rows
        row, at = (h // n, c // n), places(h // n, size)
        if not all(x in left for x in at):
            continue
        out[row] = out.get(row, 0) + n
        for x in at:
            a, b, d, e = left[x]
            left[x] = (a - n, b - h, d - c, e - k)
            if left[x] == (0, 0, 0, 0):
                del left[x]
            else:
                ready.append(x)
    return None if left else {k: n for k, n in out.items() if n}


def difference(left: DataFrame, right: DataFrame, sizes: tuple[int, ...] = SIZES) -> Difference:
    """What the smallest sketch of `sizes` that decodes says of the two tables, which have the same columns."""
    columns = left.columns
    for size in sizes:
        sums = {r.cell: (int(r.n), int(r.h), int(r.c), int(r.k)) for r in cells(left, right.select(columns), columns, size).collect()}  # at most HASHES * size rows
        rows = decoded(sums, size)
        if rows is not None:
            return Difference(rows, size)
    return Difference(None, 0)


def reconciled(report: DataFrame, derived: DataFrame, sizes: tuple[int, ...] = SIZES) -> DataFrame:
    """The rows of validate.reconcile(): those on one side only, multiplicity included, with side.

    Where a sketch decodes, only rows with a hash that it names are compared, so equal rows are read and not shuffled;
    else both tables are joined whole. Two different rows of equal hash can't hide: their check hashes differ, and then
    no sketch decodes.
    """
    columns, spark = derived.columns, derived.sparkSession
    found = difference(report.select(columns), derived, sizes)
    if found.rows is None:
        return reconcile(report, derived)
    named = F.broadcast(spark.createDataFrame([(h,) for h, _ in found.rows], "__n long").distinct())  # no more than the sketch has cells
    some = lambda df: hashed(df.select(columns), columns).join(named, F.col("__h") == F.col("__n"), "left_semi").select(columns)
    return reconcile(some(report), some(derived))
